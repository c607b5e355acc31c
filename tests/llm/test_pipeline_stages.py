"""The pipeline stage by stage: columns, what goes and what stays, on odd input and on given tables."""

from __future__ import annotations

import zlib
from collections import Counter

import corpus_pipeline

from .samples import frame, prose, removed_bytes, rows
from .test_dedup import bare, classes


def test_stages(spark, tmp_path):
    data = rows()
    labels = []
    for k in range(300):
        text = prose(2000 + k, 50)
        if k % 4 == 0:
            text += " you worthless idiot and scum"
        data.append((3000 + k, text))
        labels.append((3000 + k, int(k % 4 == 0)))
    frame(spark, data).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.kept(stage(spark, docs, str(tmp_path)))
        seen[name] = docs
        if name != "packing":
            assert docs.columns == columns
    as_rows = lambda name: [(r["doc_id"], r["text"]) for r in seen[name].collect()]
    clean = as_rows("toxicity")
    assert Counter(clean) == Counter(d for d in data if d[0] is None or d[0] < 3000 or (d[0] - 3000) % 4)
    distinct = as_rows("exact_dedup")
    assert Counter(bare(t) for _, t in distinct) == Counter({bare(t) for _, t in clean})
    near = as_rows("near_dedup")
    assert len(near) == len(set(classes(distinct)))
    order = sorted(near, key=lambda r: (r[0] is not None, r[0] or 0))
    left = {}
    for (i, t), mask in zip(order, removed_bytes([(t or "").encode() for _, t in order])):
        rest = bytes(b for b, m in zip((t or "").encode(), mask) if not m).decode("utf-8", "ignore")
        if rest or not mask:
            left[i] = rest
    cut = as_rows("suffix_dedup")
    assert {i: t or "" for i, t in cut} == left
    pieces = seen["packing"].collect()
    assert {r["doc_id"] for r in pieces} == {i for i, _ in cut}
    assert all(r["ids_crc32"] == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in r["ids"])) for r in pieces)


def test_on_given_tables(spark):
    done = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert {"doc_id", "start", "length", "sequence_id", "offset"} <= set(done.columns) and done.count() > 0


def test_nothing(spark, tmp_path):
    empty = spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    empty.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, toxic int, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
