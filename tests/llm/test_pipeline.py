"""The pipeline's stages against brute force on a small table."""

import pytest

import corpus_pipeline
from tests.llm import brute
from tests.llm.test_contracts import DOC, documents, prose
from trellis.llm import line_dedup
import random


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("pipe")
    rng = random.Random(11)
    rows = documents()
    clean = [(1000 + i, prose(90, rng) + "\n" + prose(40, rng), "en", "s", 1) for i in range(20)]
    leak = prose(40, rng)
    rows += clean + [(2000, prose(60, rng) + " " + leak + " " + prose(60, rng), "en", "s", 1)]
    spark.createDataFrame(rows, DOC).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(1, leak), (2, None)], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    docs, out = spark.read.parquet(f"{root}/documents.parquet"), [rows]
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, docs, str(root))
        made.write.parquet(f"{root}/{name}")
        docs = spark.read.parquet(f"{root}/{name}")
        out.append([tuple(r) for r in docs.collect()])
    return out, [(1, leak), (2, None)], {c[0] for c in clean}


def test_stages(stages):
    (rows, quality, lines, near, clean, pieces), items, good = stages
    ids = lambda xs: {x[0] for x in xs}
    for x in rows:
        if brute.quality(x[1])[-1]:
            assert x[0] not in ids(quality)
    assert good <= ids(quality) and good <= ids(clean)
    assert set(quality) <= set(rows)
    gone = brute.line_runs([(x[0], x[1]) for x in quality], line_dedup.MIN_WORDS)
    left = {x[0]: x[1] for x in lines}
    for d, text, *_ in quality:
        kept = [x for i, x in enumerate((text or "").split("\n")) if i not in gone[d]]
        if "\n".join(kept).strip():
            assert [x for x in left[d].split("\n") if x.strip()] == [x for x in kept if x.strip()]
        else:
            assert d not in left
    groups = brute.groups([(x[0], x[1]) for x in lines], 5, 80)
    assert ids(near) == {d for d, (_, c) in groups.items() if c == d}
    assert ids(clean) == {x[0] for x in near if not brute.leaks(x[1], items)[-1]} and 2000 not in ids(clean)
    assert ids(pieces) == ids(clean)


def test_registered_run(spark, tmp_path):
    spark.createDataFrame(documents()[:12], DOC).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "x")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = corpus_pipeline.run(spark, str(tmp_path))
    assert rows.columns[:4] == ["doc_id", "start", "length", "ids_crc32"] and rows.count() > 0
