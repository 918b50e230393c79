"""SQL for the corpus queries that SQL can express."""

from __future__ import annotations

import math

from trellis.llm import license_scan, line_dedup, quality, url_filter

_LINES = r"""
select doc_id, raw, trim(line, e' \t\n\x0b\f\r') as line
from (select doc_id, unnest(string_split(text, e'\n')) as line, generate_subscripts(string_split(text, e'\n'), 1) - 1 as raw from documents where text is not null)
where trim(line, e' \t\n\x0b\f\r') <> ''
"""

#: All windows of whole lines that reach the words with their last or their first line, by content; later ones go.
OP1 = rf"""
with l as materialized (select *, row_number() over (partition by doc_id order by raw) as i, len(regexp_split_to_array(line, '[\x20\x09-\x0D]+')) as n from ({_LINES})),
c as materialized (select *, sum(n) over (partition by doc_id order by i) as e from l),
f as (select a.doc_id, a.i, min(b.i) as z from c a join c b on a.doc_id = b.doc_id and b.i >= a.i and b.e - a.e + a.n >= {line_dedup.MIN_WORDS} group by all),
g as (select b.doc_id, max(a.i) as i, b.i as z from c a join c b on a.doc_id = b.doc_id and b.i >= a.i and b.e - a.e + a.n >= {line_dedup.MIN_WORDS} group by b.doc_id, b.i),
w as (select distinct * from (select * from f union all select doc_id, i, z from g)),
k as materialized (select w.doc_id, w.i, w.z, string_agg(l.line, e'\n' order by l.i) as t from w join l on l.doc_id = w.doc_id and l.i between w.i and w.z group by all),
late as (select doc_id, i, z from (select *, row_number() over (partition by t order by doc_id, i) as p from k) where p > 1),
m as (select distinct late.doc_id, l.i from late join l on l.doc_id = late.doc_id and l.i between late.i and late.z),
runs as (select doc_id, min(i) as a, max(i) as b from (select *, i - row_number() over (partition by doc_id order by i) as s from m) group by doc_id, s),
x as (select r.doc_id, p.raw as a, q.raw + 1 as b from runs r join l p on p.doc_id = r.doc_id and p.i = r.a join l q on q.doc_id = r.doc_id and q.i = r.b),
d as (select doc_id, list(struct_pack(a, b) order by a) as runs from x group by doc_id),
o as (select documents.doc_id, text, string_split(text, e'\n') as ls, coalesce(runs, []) as runs from documents left join d on d.doc_id = documents.doc_id),
t as (select doc_id, runs, case when len(runs) = 0 then text else array_to_string(list_filter(ls, lambda s, i: len(list_filter(runs, lambda r: r.a <= i - 1 and i - 1 < r.b)) = 0), e'\n') end as text from o)
select doc_id, coalesce(list_sum(list_transform(runs, lambda r: r.b - r.a)), 0)::bigint as n_removed,
  array_to_string(list_transform(runs, lambda r: r.a || '-' || r.b), ',') as removed, length(text)::bigint as n_chars_left, sha256(text) as text_sha256
from t
"""

_RULES = ", ".join(f"('{r.text}', '{r.host}', '{r.path}', '{r.verdict}')" for r in url_filter.RULES)
_ROUNDS = url_filter.ROUNDS_A_STEP * math.ceil(math.log(url_filter.TOLERANCE) / math.log(url_filter.DAMPING) / url_filter.ROUNDS_A_STEP)

#: Both ranks as sums over rounds of what arrives, by recursion over the host edges.
OP2 = rf"""
with recursive rules(rule, h, start, verdict) as (values {_RULES}),
u as (select page_id, html, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) as path from pages),
p as materialized (select u.*, (select struct_pack(rule := arg_max(rule, length(rule)), verdict := arg_max(verdict, length(rule))) from rules where (host = h or ends_with(host, '.' || h)) and starts_with(path, start)) as hit from u),
hosts as materialized (select host, count(*) as pages, count(*) filter (where hit.verdict = 'allow') as good, count(*) filter (where hit.verdict = 'block') as bad from p where host <> '' group by 1),
links as (select host as src, translate(unnest(regexp_extract_all(html, '(?i)\bhref\s*=\s*["'']?(?:[a-z][a-z0-9+.-]*:)?//([^/?#"''\s>]+)', 1)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as dst from p where host <> '' and html is not null),
parts as (select string_split(host, '.') as l from hosts),
up as (select array_to_string(l[k:], '.') as src, array_to_string(l[k + 1:], '.') as dst from (select l, unnest(range(1, len(l) - 1)) as k from parts)),
edges as (select src, dst, sum(n) as n from (select src, dst, count(*) as n from links where src <> dst group by all union all select src, dst, 1 from (select src, dst from up union select dst, src from up)) group by all),
both_ways as (select 0 as way, src, dst, n from edges union all select 1, dst, src, n from edges),
steps as materialized (select way, src, dst, n / sum(n) over (partition by way, src) as share from both_ways),
seeds as (select 0 as way, host, good / pages as w from hosts where good > 0 union all select 1, host, bad / pages from hosts where bad > 0),
walk(i, way, host, moved) as (select 0, way, host, w / sum(w) over (partition by way) from seeds
  union all select i + 1, s.way, s.dst, sum(moved * share) * {url_filter.DAMPING} from walk join steps s on s.way = walk.way and s.src = walk.host where i < {_ROUNDS} group by i, s.way, s.dst),
scores as (select host, coalesce(sum(moved) filter (where way = 0), 0) as trust, coalesce(sum(moved) filter (where way = 1), 0) as distrust from walk group by 1)
select page_id, p.host, path, hit.rule as rule, coalesce(hit.verdict, case when trust + distrust > 0 and distrust >= {url_filter.THRESHOLD} * (trust + distrust) then 'block' else 'allow' end) as verdict
from p left join scores on scores.host = p.host
"""

_LOW = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all(" + _LOW + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_TOKENS = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"

OP3 = rf"""
with d as materialized (select doc_id, {_WORDS.format("coalesce(text, '')")} as w from documents),
b as materialized (select item_id, {_WORDS.format("coalesce(text, '')")} as w from benchmark),
s as (select item_id, w, least(10, len(w)) as n from b where len(w) > 0),
q as materialized (select item_id, n, array_to_string(w[i:i + n - 1], ' ') as t from (select *, unnest(range(1, len(w) - n + 2)) as i from s)),
sizes as (select distinct n from q),
p as (select doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') as t from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from d, sizes where len(w) >= n)),
h as materialized (select doc_id, item_id, i, p.n from p join q on p.n = q.n and p.t = q.t),
hit as (select doc_id, count(distinct k) as n_hit from (select doc_id, unnest(range(i, i + n)) as k from h) group by 1),
own as (select doc_id, count(*) as n_items, string_agg(item_id::varchar, ',' order by item_id::varchar) as items from (select distinct doc_id, item_id from h) group by 1)
select d.doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(items, '')) as items_sha256, n_hit is not null as contaminated
from d left join hit on hit.doc_id = d.doc_id left join own on own.doc_id = d.doc_id
"""

_CONDITIONS = " + ".join(f"case when {r.fails} then {quality.BIT[r.name]} else 0 end" for r in quality.RULES)

OP7 = rf"""
with d as materialized (select doc_id, coalesce(text, '') as t, {_TOKENS.format("coalesce(text, '')")} as w from documents),
g as (select doc_id, i, array_to_string(w[i:i + 2], ' ') as t from (select doc_id, w, unnest(range(1, len(w) - 1)) as i from d)),
r as (select doc_id, count(distinct k) as n from (select doc_id, unnest([i, i + 1, i + 2]) as k from (select *, count(*) over (partition by doc_id, t) as c from g) where c > 1) group by 1),
l as (select doc_id, count(*) as n_lines, count(*) - count(distinct line) as n_dup_lines from (select doc_id, unnest(string_split(t, e'\n')) as line from d) where regexp_matches(line, '[^\x20\x09-\x0D]') group by 1),
m as (select d.doc_id, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars, (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
  length(regexp_replace(t, '[^\p{{L}}]', '', 'g'))::bigint as n_letters, coalesce(n_lines, 0)::bigint as n_lines, coalesce(n_dup_lines, 0)::bigint as n_dup_lines, coalesce(r.n, 0)::bigint as n_repeat_words
  from d left join r on r.doc_id = d.doc_id left join l on l.doc_id = d.doc_id),
f as (select *, ({_CONDITIONS})::bigint as failed from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed & {quality.POLICIES["base"].mask} <> 0 as base_failed, failed & {quality.POLICIES[quality.CURRENT].mask} = 0 as kept, failed from f
"""

OP8 = rf"""
with recursive d as materialized (select doc_id, {_TOKENS.format(_LOW.format("coalesce(text, '')"))} as w from documents),
s as materialized (select distinct doc_id, array_to_string(w[i:i + 1], ' ') as t from (select doc_id, w, unnest(range(1, greatest(len(w), 2))) as i from d where len(w) > 0)),
n as materialized (select doc_id, count(*) as n from s group by 1),
x as (select s.doc_id, n, t from s join n on n.doc_id = s.doc_id),
e as materialized (select a, b from (select p.doc_id as a, q.doc_id as b, p.n + q.n as z, count(*) as c from x p join x q on p.t = q.t and p.doc_id <> q.doc_id and 100 * least(p.n, q.n) >= 80 * greatest(p.n, q.n) group by all) where 100 * c >= 80 * (z - c)),
r as (select a, b from e union select r.a, e.b from r join e on r.b = e.a)
select d.doc_id, coalesce(n, 0)::bigint as n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) as component_id, d.doc_id <= coalesce(m, d.doc_id) as kept
from d left join n on n.doc_id = d.doc_id left join (select a, min(b) as m from r group by 1) k on k.a = d.doc_id
"""

OP9 = """
with p as (select page_id, octet_length(encode(coalesce(html, ''))) as n, sha256(coalesce(html, '')) as h from pages),
f as (select h, min(page_id) as first from p where n >= 100 group by 1)
select page_id, n::bigint as payload_bytes, p.h as payload_digest, case when first < page_id and n >= 100 then 'revisit' else 'response' end as record_type, case when first < page_id and n >= 100 then first end as refers_to
from p left join f on f.h = p.h
"""

_PHRASES = ", ".join(f"('{phrase}', {len(phrase.split())}, '{label}')" for phrase, label in license_scan.PHRASES)
_TEMPLATES = ", ".join(
    f"({i}, '{label}', {license_scan.template_words(text)!r}, {license_scan.needed_words(text)}, {license_scan.block_words(text)})" for i, (label, text) in enumerate(license_scan.TEMPLATES)
)

OP5 = rf"""
with phrases(phrase, n, label) as (values {_PHRASES}), templates(id, label, ws, need, reach) as (values {_TEMPLATES}),
d as materialized (select doc_id, coalesce(text, '') as t, {_WORDS.format("coalesce(text, '')")} as w from documents),
k as (select doc_id, w, unnest(range(1, len(w) + 1)) as i from d where contains({_LOW.format("t")}, 'cc') or contains({_LOW.format("t")}, 'license') or contains({_LOW.format("t")}, 'reserved')),
h as (select doc_id, i - 1 as place, label from k join phrases on array_to_string(w[i:i + n - 1], ' ') = phrase),
b as (select doc_id, count(*) as n_base, min(place) as first_word, max(place) as last_word, list_sort(list_distinct(list(label))) as labels from h group by 1),
l as materialized (select doc_id, w, id, label, ws, need, reach from d, templates where len(list_intersect(list_distinct(w), ws)) >= need),
c as (select doc_id, label, len(list_intersect(list_distinct(w[i:i + reach - 1]), ws)) as common, len(ws) as n, need from (select *, unnest(range(1, len(w) + 1)) as i from l) where list_contains(ws, w[i])),
f as (select doc_id, list(distinct label) as found, max(common / n) as best from c where common >= need group by 1)
select d.doc_id, len(w)::bigint as n_words, coalesce(n_base, 0)::bigint as n_base, first_word::bigint as first_word, last_word::bigint as last_word,
  coalesce(array_to_string(labels, ','), '') as base_labels, coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(labels, []), coalesce(found, [])))), ','), '') as labels,
  case when n_base > 0 then 1.0 else coalesce(best, 0.0) end::double as score
from d left join b on b.doc_id = d.doc_id left join f on f.doc_id = d.doc_id
"""

ORACLES: dict[str, str] = {"op1_line_dedup": OP1, "op2_url_filter": OP2, "op3_decontaminate": OP3, "op5_license_scan": OP5, "op7_quality": OP7, "op8_near_dedup": OP8, "op9_warc": OP9}
