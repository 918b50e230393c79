"""Language-model scoring: a causal self-attention model, trained in numpy on subword ids.

A text is its words, each with one space before it, and an end; the white space as it stood is not modelled, as in the
base score. One pass over the training documents counts words in each task (all of them; counts are added up in
Spark). Each distinct word is cut into subwords once, which with its count gives the subwords' counts over the corpus.
A second pass writes every text's subword ids; all that follows reads these.

The model reads subword ids: the FREQUENT most frequent have an embedding each, others share their class's. It predicts
the next subword in two steps. One block of masked attention gives the next class; within a class a subword has its
smoothed share among what followed the class before it. So the probabilities of all continuations add up to one. The
commonest subwords are classes of their own; the others are clustered by what stands beside them in the corpus, so
classes part languages and the places within a word. Neighbours and followers are counted over all training texts; the
tables have as many entries as the vocabulary allows, whatever the corpus.

Each training text is cut into consecutive windows, in which each subword and the end is a target once. Training is
data-parallel: in a round every task descends from the same parameters over the next of SLOTS parts of its windows, and
the results are averaged in Spark, weighted by windows. Rounds go on until every window was trained on and the loss of
windows before they were falls by less than LEAST_GAIN from round to round, at most ROUNDS_MOST.

Scoring cuts a document into overlapping windows; each token is scored once, in a window where at least `OVERLAP`
tokens stand before it (fewer only at the text's start). Windows of many documents go through the model in batches.
The score is the sum of its tokens' log10 probabilities.

The base score needs each word's count. The most frequent words, at most TOP, are broadcast with their subwords; a
document's other words leave the task as (word, occurrences) and meet their counts in an equi-join. The score reads
subword counts only, which all training words enter, so the bound changes neither.

Defined cases: a null or empty text is the end token alone; very long texts are more windows; repeated rows are
scored and counted each; an empty table gives an empty result; a null id is in training (its text for the remainder
is empty); other columns are not read and may have any names."""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from trellis.llm.common import col, cut, small_batches
from trellis.llm.packing import _byte_letters, encoder

VOCABULARY = "byte_bpe_50k.json"
SIZE, END = 50257, 50256
OWN, SHARED = 40, 88  # classes of one subword (the end among them) and of many
CLASSES = OWN + SHARED
FREQUENT = 1024  # subwords with an embedding of their own
INPUTS = FREQUENT + CLASSES
START = INPUTS  # what stands before a text
NEIGHBOURS = 96  # subwords that tell clusters apart by standing beside theirs
PRIOR = 10.0  # occurrences that a class's own shares weigh against the followers of the class before
WIDTH, OVERLAP = 48, 8
DIM, HIDDEN = 16, 32
BATCH, RATE = 32, 0.01
SLOTS, LEAST_GAIN, ROUNDS_MOST = 4, 0.003, 40
WINDOWS_AT_ONCE = 8192
TOP = 300_000
SEED = 6
_BIG = 96  # windows in one forward pass


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 7 == 2


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def _joined(words: list[bytes]) -> str:
    return b"".join([b" " + w for w in words]).decode("utf-8", "surrogatepass")


# The model


def shapes() -> dict[str, tuple[int, ...]]:
    return {
        "embed": (INPUTS + 1, DIM), "place": (WIDTH, DIM), "q": (DIM, DIM), "k": (DIM, DIM), "v": (DIM, DIM), "o": (DIM, DIM),
        "up": (DIM, HIDDEN), "down": (HIDDEN, DIM), "out": (DIM, CLASSES), "bias": (CLASSES,),
    }


def views(flat: np.ndarray) -> dict[str, np.ndarray]:
    """The parameters by name, as parts of one vector."""
    out, at = {}, 0
    for name, shape in shapes().items():
        n = math.prod(shape)
        out[name] = flat[at : at + n].reshape(shape)
        at += n
    return out


def unpack(flat: np.ndarray) -> dict[str, np.ndarray]:
    return views(flat.astype(np.float32))


def pack(p: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([p[name].ravel() for name in shapes()]).astype(np.float64)


def initial(class_counts: np.ndarray) -> np.ndarray:
    rng = np.random.default_rng(SEED)
    p = {name: rng.normal(0, 0.3 if name == "embed" else 1 / math.sqrt(shape[0]) * 0.5, shape) for name, shape in shapes().items()}
    p["place"] *= 0.1
    p["bias"] = np.log((class_counts + 1) / (class_counts.sum() + CLASSES))
    return pack(p)


_MASK = np.tril(np.ones((WIDTH, WIDTH), np.float32))


def _norm(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    r = 1 / np.sqrt(np.einsum("...i,...i->...", x, x)[..., None] / DIM + np.float32(1e-5))
    return x * r, r


def _norm_back(g: np.ndarray, y: np.ndarray, r: np.ndarray) -> np.ndarray:
    return r * (g - y * (np.einsum("...i,...i->...", g, y)[..., None] / DIM))


def _mul(b: np.ndarray, w: np.ndarray) -> np.ndarray:
    """b @ w as one product of matrices."""
    return (b.reshape(-1, b.shape[-1]) @ w).reshape(*b.shape[:-1], w.shape[1])


def forward(p: dict[str, np.ndarray], x: np.ndarray) -> tuple:
    """x: (windows, WIDTH) input ids -> logits of the next classes and what the way back needs."""
    y, rest = hidden(p, x)
    return _mul(y, p["out"]) + p["bias"], rest


_SCALE = np.float32(1 / math.sqrt(DIM))
_ONES = {n: np.ones(n, np.float32) for n in (WIDTH, CLASSES)}  # sums over the last axis are products with these


def hidden(p: dict[str, np.ndarray], x: np.ndarray) -> tuple:
    """What the output layer reads."""
    e = p["embed"][x] + p["place"]
    n, rn = _norm(e)
    q, k, v = _mul(n, p["q"] * _SCALE), _mul(n, p["k"]), _mul(n, p["v"])
    a = q @ k.transpose(0, 2, 1)
    np.exp(a, out=a)
    a *= _MASK
    a *= (1 / (a @ _ONES[WIDTH]))[..., None]
    c = a @ v
    h = e + _mul(c, p["o"])
    m, rm = _norm(h)
    u = np.maximum(_mul(m, p["up"]), 0)
    g = h + _mul(u, p["down"])
    y, ry = _norm(g)
    return y, (n, rn, q, k, v, a, c, m, rm, u, y, ry)


def infer(p: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    """hidden() in fewer passes: the attention's sums come with a column of ones among the values."""
    e = p["embed"][x] + p["place"]
    n = _norm(e)[0]
    v = np.ones((*x.shape, DIM + 1), np.float32)
    v[..., :DIM] = _mul(n, p["v"])
    a = _mul(n, p["q"] * _SCALE) @ _mul(n, p["k"]).transpose(0, 2, 1)
    np.exp(a, out=a)
    a *= _MASK
    c = a @ v
    h = e + _mul(c[..., :DIM] / c[..., DIM:], p["o"])
    return _norm(h + _mul(np.maximum(_mul(_norm(h)[0], p["up"]), 0), p["down"]))[0]


def _summed_by(ids: np.ndarray, rows: np.ndarray, out: np.ndarray) -> None:
    """out[i] becomes the sum of the rows of each id."""
    order = np.argsort(ids, kind="stable")
    ids = ids[order]
    starts = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
    out[ids[starts]] = np.add.reduceat(rows[order], starts)


def gradients(p: dict[str, np.ndarray], x: np.ndarray, t: np.ndarray, mask: np.ndarray, out: dict[str, np.ndarray] | None = None) -> tuple[float, dict[str, np.ndarray]]:
    """Mean cross-entropy (nats) of the masked target classes t after input ids x, and its gradient (into out, if given).

    Logits stay far below what exp can take, as y has a fixed length, so none is subtracted from them."""
    out = {name: np.empty(shape, np.float32) for name, shape in shapes().items()} if out is None else out
    z, (n, rn, q, k, v, a, c, m, rm, u, y, ry) = forward(p, x)
    rows = lambda b: b.reshape(-1, b.shape[-1])
    d, mask = np.exp(rows(z), out=rows(z)), mask.ravel()
    total, every, at = max(1.0, float(mask.sum())), d @ _ONES[CLASSES], (np.arange(len(d)), t.ravel())
    loss = -float((np.log(d[at] / every + 1e-30) * mask).sum()) / total
    weight = mask * np.float32(1 / total)
    d *= (weight / every)[:, None]
    d[at] -= weight
    np.matmul(rows(y).T, d, out=out["out"])
    np.sum(d, 0, out=out["bias"])
    dg = _norm_back((d @ p["out"].T).reshape(y.shape), y, ry)
    np.matmul(rows(u).T, rows(dg), out=out["down"])
    du = _mul(dg, p["down"].T)
    du *= u > 0
    np.matmul(rows(m).T, rows(du), out=out["up"])
    dh = dg + _norm_back(_mul(du, p["up"].T), m, rm)
    np.matmul(rows(c).T, rows(dh), out=out["o"])
    dc = _mul(dh, p["o"].T)
    ds = dc @ v.transpose(0, 2, 1)
    dv = a.transpose(0, 2, 1) @ dc
    ds -= np.einsum("bij,bij->bi", ds, a)[..., None]
    ds *= a
    dq, dk = (ds @ k) * _SCALE, ds.transpose(0, 2, 1) @ q
    for name, b in (("q", dq), ("k", dk), ("v", dv)):
        np.matmul(rows(n).T, rows(b), out=out[name])
    de = dh + _norm_back(_mul(dq, p["q"].T) + _mul(dk, p["k"].T) + _mul(dv, p["v"].T), n, rn)
    np.sum(de, 0, out=out["place"])
    out["embed"].fill(0)
    _summed_by(x.ravel(), rows(de), out["embed"])
    return loss, out


def descend(flat: np.ndarray, windows: np.ndarray, of_input: np.ndarray, seed: int, rate: float = RATE) -> tuple[np.ndarray, float, int]:
    """One pass of Adam over windows (n, WIDTH + 1) of input ids, -1 behind their ends; of_input gives an id's class.

    Also the sum of the losses of all targets, each before the step that it is in, and their number."""
    whole, grads, first, second = flat.astype(np.float32), *(np.zeros(len(flat), np.float32) for _ in range(3))
    p, g = views(whole), views(grads)
    order = np.random.default_rng(seed).permutation(len(windows))
    lost, targets = 0.0, 0
    for step, at in enumerate(range(0, len(order), BATCH), 1):
        w = windows[order[at : at + BATCH]]
        inside = w[:, 1:] >= 0
        loss, _ = gradients(p, np.maximum(w[:, :-1], 0), of_input[np.maximum(w[:, 1:], 0)], inside.astype(np.float32), g)
        n = int(inside.sum())
        lost, targets = lost + loss * n, targets + n
        first += np.float32(0.1) * (grads - first)
        grads *= grads
        second += np.float32(0.01) * (grads - second)
        np.sqrt(second * np.float32(1 / (1 - 0.99**step)), out=grads)
        grads += np.float32(1e-6)
        np.divide(first, grads, out=grads)
        grads *= np.float32(rate / (1 - 0.9**step))
        whole -= grads
    return whole.astype(np.float64), lost, targets


class Classes:
    """What the model makes of subword ids: of_id, their classes; inputs, what it reads for them; of_input, its class."""

    def __init__(self, of_id: np.ndarray, order: np.ndarray):
        """order: ids by falling count."""
        self.of_id = of_id.astype(np.int16)
        self.inputs = (FREQUENT + self.of_id).astype(np.uint16)
        self.inputs[order[:FREQUENT]] = np.arange(FREQUENT)
        self.of_input = np.concatenate([self.of_id[order[:FREQUENT]], np.arange(CLASSES)]).astype(np.int64)


class Model:
    """Parameters, classes, and the log10 shares of subwords within their class, by the class before (CLASSES at the start)."""

    def __init__(self, flat: np.ndarray, classes: Classes, shares: np.ndarray):
        self.flat, self.classes, self.shares = flat, classes, shares

    def tokens(self, texts: list[np.ndarray]) -> np.ndarray:
        """log10 probability of each subword and end of the texts, one text after the other."""
        if not texts:
            return np.zeros(0)
        p, rows, indices, begins, befores, first = unpack(self.flat), [], [], [], [], 0
        places = np.arange(WIDTH)
        every_id = np.concatenate([x for ids in texts for x in (ids, [END])]).astype(np.int64)
        every_class, every_input = self.classes.of_id[every_id].astype(np.int64), self.classes.inputs[every_id].astype(np.int64)
        for ids in texts:
            n = len(ids) + 1
            starts = np.arange(0, max(1, n - OVERLAP), WIDTH - OVERLAP)
            padded = np.full(starts[-1] + WIDTH + 1, -1, np.int64)
            padded[0], padded[1 : n + 1] = START, every_input[first : first + n]
            rows.append(padded[starts[:, None] + np.arange(WIDTH + 1)])
            befores.append(np.append(CLASSES, every_class[first : first + n - 1]))
            indices.append(first + starts)
            begins.append(np.where(starts > 0, OVERLAP, 0))
            first += n
        out = self.shares[np.concatenate(befores), every_id].astype(np.float64)
        w, index, begin = map(np.concatenate, (rows, indices, begins))
        counted = (w[:, 1:] >= 0) & (places >= begin[:, None])
        x, t, raised = np.maximum(w[:, :-1], 0), self.classes.of_input[np.maximum(w[:, 1:], 0)], np.exp(p["bias"])
        for at in range(0, len(x), _BIG):
            part = counted[at : at + _BIG]
            goal = t[at : at + _BIG][part]
            z = infer(p, x[at : at + _BIG])[part] @ p["out"]
            hit = z[np.arange(len(goal)), goal] + p["bias"][goal]
            every = np.log(np.exp(z, out=z) @ raised)
            out[(index[at : at + _BIG, None] + places)[part]] += (hit - every) / math.log(10)
        return out

    def score(self, texts: list[np.ndarray]) -> np.ndarray:
        """log10 probability of each text, given as its subword ids."""
        if not texts:
            return np.zeros(0)
        n = np.array([len(ids) + 1 for ids in texts])
        return np.add.reduceat(self.tokens(texts), np.cumsum(n) - n)


# Gathering and scoring


def _count(rows: DataFrame) -> DataFrame:
    """Word counts of the training documents, the end under null; a word can have more rows than one."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, documents = Counter(), 0
        schema = pa.schema([("key", pa.binary()), ("n", pa.int64())])
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if held_out(doc):
                    continue
                documents += 1
                counts.update(_words(text.as_py()))
            if len(counts) > 500_000:  # counts add up, so a full table can leave early
                yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], schema=schema)
                counts = Counter()
        if documents:
            yield pa.RecordBatch.from_arrays([pa.array([*counts, None], pa.binary()), pa.array([*counts.values(), documents], pa.int64())], schema=schema)

    return rows.mapInArrow(task, "key binary, n long")


def text_windows(inputs: np.ndarray) -> np.ndarray:
    """Windows (n, WIDTH + 1) of a text's input ids with the end's, -1 behind its end: each is a target in one of them."""
    n = -(-len(inputs) // WIDTH)
    rows = np.full(n * WIDTH + 1, -1, np.int64)
    rows[0], rows[1 : len(inputs) + 1] = START, inputs
    return rows[np.arange(0, n * WIDTH, WIDTH)[:, None] + np.arange(WIDTH + 1)]


class Lookup:
    """Frequent words by number, with their log10(count + 1) and subwords in one array; other words are encoded."""

    def __init__(self, words: list[bytes], counts: np.ndarray, vocabulary: str):
        encode = encoder(vocabulary)
        made = [encode(" " + w.decode("utf-8", "surrogatepass")) for w in words]
        self.vocabulary, self.number = vocabulary, {w: i for i, w in enumerate(words)}
        self.value = np.append(np.log10(counts + 1.0), 0)
        self.size = np.array([*(len(x) for x in made), 0], np.int64)  # the last stands for words that aren't held
        self.start = np.cumsum(self.size) - self.size
        self.flat = np.concatenate([*made, np.empty(0, np.uint32)]).astype(np.uint32)

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """-1 for words that aren't held."""
        return np.array(list(map(self.number.get, words, repeat(-1))), np.int64)

    def subwords(self, words: list[bytes], numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The words' subwords in order, and how many each has; what isn't held is encoded together."""
        other = numbers < 0
        size, start, flat = self.size[numbers], self.start[numbers], self.flat
        if other.any():
            more, sizes = self._encode([words[i] for i in np.flatnonzero(other).tolist()])
            size[other], start[other] = sizes, np.cumsum(sizes) - sizes
        of = np.repeat(np.arange(len(words)), size)
        at = np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size) + start[of]
        if not other.any():
            return flat[at], size
        new = other[of]
        out = np.empty(len(of), np.uint32)
        out[~new], out[new] = flat[at[~new]], more[at[new]]
        return out, size

    def _encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        encode = encoder(self.vocabulary)
        ids = encode(_joined(words))
        first = np.flatnonzero(_begins_with_space(self.vocabulary)[ids])
        if len(first) == len(words) and (not len(first) or first[0] == 0):  # so each word begins a subword
            return ids, np.diff(first, append=len(ids))
        made = [encode(_joined([w])) for w in words]
        return np.concatenate(made), np.array([len(x) for x in made])


@cache
def _begins_with_space(vocabulary: str) -> np.ndarray:
    """By subword id."""
    import json

    import public_tokenizers

    with open(vocabulary if "/" in vocabulary else public_tokenizers.path(vocabulary), encoding="utf-8") as f:
        tokens = json.load(f)["model"]["vocab"]
    out = np.zeros(SIZE, bool)
    out[[i for token, i in tokens.items() if token.startswith(_byte_letters()[0x20])]] = True
    return out


def subword_counts(words: DataFrame, vocabulary: str) -> np.ndarray:
    """How often each subword stands in the words (key, c); the end is the null key. SIZE rows at most are collected."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        total = np.zeros(SIZE, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                keys, counts = batch.column(0)[at : at + 4096].to_pylist(), batch.column(1)[at : at + 4096].to_numpy()
                cut_up = [np.array([END], np.uint32) if k is None else encode(" " + k.decode("utf-8", "surrogatepass")) for k in keys]
                ids = np.concatenate(cut_up)
                total += np.bincount(ids, np.repeat(counts, [len(x) for x in cut_up]), SIZE).astype(np.int64)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], names=["id", "n"])

    out = np.zeros(SIZE, np.int64)
    for r in words.select("key", "c").mapInArrow(task, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        out[r["id"]] = r["n"]
    return out


def _ids(column: pa.Array) -> Iterator[np.ndarray]:
    """The ids of each text, with the end."""
    for x in column:
        yield np.append(np.frombuffer(x.as_buffer(), "<u2"), np.uint16(END)).astype(np.int64)


def pair_counts(texts: DataFrame, groups: np.ndarray, n: int, after: bool = False) -> np.ndarray:
    """texts (ids), groups (the group of each id, below n) -> how often each id follows each group, the text's start as
    group n; with `after`, below that how often each id stands before each group.

    A task adds up one table, n + 1 or 2 n + 1 rows of SIZE counts, and sends what isn't 0; no more comes to the driver."""
    shared, rows = texts.sparkSession.sparkContext.broadcast(groups), 2 * n + 1 if after else n + 1

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, total = shared.value.astype(np.int64), None
        for batch in batches:
            total = np.zeros(rows * SIZE, np.int64) if total is None else total
            for at in range(0, batch.num_rows, 64):
                codes = [np.empty(0, np.int64)]
                for ids in _ids(batch.column(0).slice(at, 64)):
                    codes.append(np.append(n, group[ids[:-1]]) * SIZE + ids)
                    if after:
                        codes.append((n + 1 + group[ids[1:]]) * SIZE + ids[:-1])
                made, counts = np.unique(np.concatenate(codes), return_counts=True)
                total[made] += counts
        if total is not None:
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["code", "n"])

    out = np.zeros(rows * SIZE, np.int64)
    got = texts.mapInArrow(task, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    out[got.column("code").to_numpy()] = got.column("n").to_numpy()
    return out.reshape(rows, SIZE)


def by_count(counts: np.ndarray) -> np.ndarray:
    """Ids by falling count, then by id; the end comes first."""
    order = np.lexsort((np.arange(SIZE), -counts))
    return np.concatenate([[END], order[order != END]])


def neighbour_groups(order: np.ndarray) -> np.ndarray:
    """The most frequent ids have a group each, all others one."""
    out = np.full(SIZE, NEIGHBOURS, np.int16)
    out[order[:NEIGHBOURS]] = np.arange(NEIGHBOURS)
    return out


def cluster(beside: np.ndarray, counts: np.ndarray, order: np.ndarray, rounds: int = 15) -> np.ndarray:
    """The class of each id: the first OWN in order have their own; the others are grouped by weighted k-means over the
    square roots of their smoothed shares of neighbours. beside: how often ids stand beside each group."""
    of = np.zeros(SIZE, np.int64)
    of[order[:OWN]] = np.arange(OWN)
    rest = order[OWN:]
    sides = beside.T[rest].astype(np.float64)
    mean = beside.sum(1) / max(1, beside.sum())
    points = np.sqrt((sides + 16 * mean) / (sides.sum(1) + 16)[:, None])
    weight = counts[rest] + 0.1
    centres = points[:SHARED].copy()
    for _ in range(rounds):
        near = ((centres**2).sum(1) - 2 * points @ centres.T).argmin(1)
        for k in range(SHARED):
            inside = near == k
            if inside.any():
                centres[k] = np.average(points[inside], axis=0, weights=weight[inside])
    of[rest] = OWN + near
    return of


def shares_by_class(followers: np.ndarray, of: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """(CLASSES + 1, SIZE) log10 shares of ids within their class after each class; followers: pair_counts by class."""
    alone = (counts + 1) / (np.bincount(of, counts, CLASSES) + np.bincount(of, minlength=CLASSES))[of]
    out = np.empty((CLASSES + 1, SIZE), np.float32)
    for before in range(CLASSES + 1):
        out[before] = np.log10((followers[before] + PRIOR * alone) / (np.bincount(of, followers[before], CLASSES) + PRIOR)[of])
    return out


def train(texts: DataFrame, classes: Classes, sums: np.ndarray) -> np.ndarray:
    """texts (ids) -> parameters, after rounds of local descent from shared parameters and their average."""
    spark = texts.sparkSession
    flat, before = initial(sums), math.inf
    for round_ in range(ROUNDS_MOST):
        shared = spark.sparkContext.broadcast((flat, classes))

        def task(batches: Iterator[pa.RecordBatch], shared=shared, round_=round_) -> Iterator[pa.RecordBatch]:
            (made, known), seen, held, n = shared.value, 0, [], 0
            lost = targets = windows = 0
            for ids in chain((x for batch in batches for x in _ids(batch.column(0))), [None]):  # the last is what is left
                if ids is not None:
                    every = text_windows(known.inputs[ids])
                    mine = every[(round_ - seen) % SLOTS :: SLOTS]
                    seen += len(every)
                    held.append(mine)
                    n += len(mine)
                if n >= WINDOWS_AT_ONCE or (ids is None and n):
                    w, held, n = np.concatenate(held), [], 0
                    made, a, b = descend(made, w, known.of_input, round_)
                    lost, targets, windows = lost + a, targets + b, windows + len(w)
            if windows:
                values = np.concatenate([made * windows, [lost, targets]])
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values), dtype=np.int32)), pa.array(values), pa.array(np.full(len(values), windows, np.int64))], names=["i", "v", "w"])

        got = texts.mapInArrow(task, "i int, v double, w long").groupBy("i").agg(F.sum("v").alias("v"), F.sum("w").alias("w")).toArrow().sort_by("i")
        if not got.num_rows:  # no window is in this part
            if round_ + 1 >= SLOTS and before == math.inf:
                break
            continue
        v, w = got.column("v").to_numpy(), got.column("w").to_numpy()
        flat = np.round(v[:-2] / w[:-2], 7)
        loss = v[-2] / v[-1]
        if round_ + 1 >= SLOTS and loss > before * (1 - LEAST_GAIN):
            break
        before = loss
    return flat


def frequent_words(words: DataFrame, top: int) -> tuple[list[bytes], np.ndarray]:
    """Words (key, c) with the greatest counts, at most top: all from that count on from which there are no more.

    Counts fall into some hundred classes by their logarithm, so this needs no sort."""
    level = F.floor(F.log2("c") * 8)
    levels = sorted(((r["l"], r["n"]) for r in words.groupBy(level.alias("l")).agg(F.count("*").alias("n")).collect()), reverse=True)
    least, held = None, 0
    for l, n in levels:
        if held + n > top:
            break
        least, held = l, held + n
    if least is None:
        return [], np.zeros(0, np.int64)
    got = words.where(level >= least).toArrow().sort_by("key")
    return got.column("key").to_pylist(), got.column("c").to_numpy()


def _tokens(rows: DataFrame, shared, vocabulary: str) -> DataFrame:
    """Every text as subword ids, with what the base score needs. shared: a broadcast of (Lookup, the end's count)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, ends = shared.value
        row = TaskContext.get().partitionId() << 40
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                batch = whole.slice(at, 64)
                docs = batch.column(0).to_pylist()
                ids, parts, tokens, seen, rare, times, ends_at = [], [], [], [], [], [], [0]
                for text in batch.column(1):
                    words = _words(text.as_py())
                    numbers = known.numbers(words)
                    other = numbers < 0
                    ids.append(known.subwords(words, numbers)[0].astype("<u2").tobytes())
                    parts.append(math.log10(ends + 1) + float(known.value[numbers].sum()))  # 0 for words that aren't held
                    tokens.append(len(words) + 1)
                    seen.append(len(words) - int(other.sum()) + int(ends > 0))
                    counts = Counter([words[i] for i in np.flatnonzero(other).tolist()])
                    rare += counts
                    times += counts.values()
                    ends_at.append(len(rare))
                listed = pa.ListArray.from_arrays(pa.array(ends_at, pa.int32()), pa.StructArray.from_arrays([pa.array(rare, pa.binary()), pa.array(times, pa.int64())], names=["w", "n"]))
                arrays = [np.arange(row, row + len(docs)), docs, [held_out(d) for d in docs], tokens, seen, parts, listed, ids]
                row += len(docs)
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, f.type) for x, f in zip(arrays, schema, strict=True)], schema=schema)

    schema = pa.schema([
        ("row", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("part", pa.float64()),
        ("rare", pa.list_(pa.struct([("w", pa.binary()), ("n", pa.int64())]))), ("ids", pa.binary()),
    ])
    return rows.mapInArrow(task, "row long, doc_id long, held_out boolean, n_tokens long, n_known long, part double, rare array<struct<w:binary,n:long>>, ids binary")


def learn(texts: DataFrame, counts: np.ndarray) -> Model:
    """texts (ids) of training documents, and the counts of subwords in them -> the model."""
    order = by_count(counts)
    of = cluster(pair_counts(texts, neighbour_groups(order), NEIGHBOURS + 1, after=True), counts, order)
    classes = Classes(of, order)
    shares = shares_by_class(pair_counts(texts, classes.of_id, CLASSES), of, counts)
    return Model(train(texts, classes, np.bincount(of, counts, CLASSES)), classes, shares)


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, top: int = TOP) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row."""
    spark = docs.sparkSession
    rows = docs.select(col(id_col).cast("long").alias("doc_id"), col(text_col).cast("string").alias("text"))
    words = cut(_count(rows).groupBy("key").agg(F.sum("n").alias("c")), "words")
    total, types = words.select(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    ends = words.where("key is null").select("c").first()
    ends = ends["c"] if ends else 0
    subwords = subword_counts(words, vocabulary)
    known = Lookup(*frequent_words(words.where("key is not null"), top), vocabulary)
    texts = cut(_tokens(rows, spark.sparkContext.broadcast((known, ends)), vocabulary), "tokens")
    with small_batches(spark):
        shared = spark.sparkContext.broadcast(learn(texts.where("not held_out").select("ids"), subwords))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                batch = whole.slice(at, 64)
                made = model.score([ids[:-1] for ids in _ids(batch.column(1))])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.float64()), *batch.columns[2:]], names=["row", "score", *names])

    names = ["doc_id", "held_out", "n_tokens", "n_known", "part"]
    scored = texts.select("row", "ids", *names).mapInArrow(task, "row long, score double, doc_id long, held_out boolean, n_tokens long, n_known long, part double")
    rare = texts.select("row", F.explode("rare").alias("x")).select("row", F.col("x.w").alias("key"), "x.n")
    rare = rare.join(words.where("key is not null"), "key").groupBy("row").agg(F.sum("n").alias("more"), F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("add"))
    out = cut(scored, "scored").join(rare, "row", "left")
    base = F.col("part") + F.coalesce("add", F.lit(0.0)) - F.col("n_tokens") * math.log10(total + types + 1)
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"), base.alias("base_score"), "score",
    )
