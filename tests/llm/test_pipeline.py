"""The pipeline's stages take effect, each on what the one before has kept."""

import hashlib

import corpus_pipeline as c
from tallyforge.llm.shared import read, staged
from tallyforge.llm import decontamination, near_dedup, quality

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    assert [n for n, _ in c.STAGES] == ["quality classifier", "near-duplicate removal", "suffix-array dedup", "benchmark decontamination", "best-fit packing"]
    docs = read(spark, SF, "documents")
    columns, tables = docs.columns, [docs]
    for name, stage in c.STAGES:
        docs = staged(stage(spark, docs, SF), "t")
        tables.append(docs)
        if name != "best-fit packing":
            assert docs.columns == columns
    n = [t.count() for t in tables]
    assert n[0] > n[1] > n[2] == n[3] >= n[4] > 0
    first = tables[2].limit(1000).collect()
    assert len({r["doc_id"] for r in first}) == len(first)
    # a second pass of a stage finds nothing more
    assert near_dedup.near_duplicates(tables[2]).where("NOT kept").count() == 0
    assert decontamination.contamination(tables[4], read(spark, SF, "benchmark")).where("contaminated").count() == 0
    labels = read(spark, SF, "labels").where("quality = 1").join(tables[0], "doc_id")
    kept = tables[1].join(labels.select("doc_id"), "doc_id").count()
    assert kept >= 0.97 * labels.count()
    # the cut against brute force on the stage's own input
    rows = [(r["doc_id"], (r["text"] or "").encode()) for r in tables[2].collect()]
    seen = {}
    for _, b in rows:
        for j in range(len(b) - 199):
            k = hashlib.md5(b[j : j + 200]).digest()
            seen[k] = seen.get(k, 0) + 1
    after = {r["doc_id"]: r["text"] for r in tables[3].collect()}
    for i, b in rows:
        gone = bytearray(len(b))
        for j in range(len(b) - 199):
            if seen[hashlib.md5(b[j : j + 200]).digest()] > 1:
                gone[j : j + 200] = b"\1" * 200
        assert after[i] == bytes(x for x, g in zip(b, gone, strict=True) if not g).decode("utf-8", "ignore")
    packed = tables[5].groupBy("sequence_id").agg({"length": "sum"}).collect()
    assert max(r[1] for r in packed) <= 2048
    assert {r["doc_id"] for r in tables[5].select("doc_id").distinct().collect()} == {r["doc_id"] for r in tables[4].select("doc_id").collect()}
    assert quality and c.ORACLE_SQL is None


def test_stages_on_odd_rows(spark, tmp_path):
    """Nulls, empty and long texts, repeated rows, an extra column with a clashing name; and empty tables."""
    rows = [(None, None, "x"), (1, "", "x"), (2, "a b", None), (2, "a b", None), (3, "word " * 30_000, "x"), (None, "some text of the page " * 30, "x")]
    docs = spark.createDataFrame([(i, t, "en", s, len(t or ""), "k", 7, "h", "r") for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars int, kept_text string, _key int, _hit string, rest string")
    for own, least in ((docs, 5), (docs.where("1 = 0"), 0)):
        for name, stage in c.STAGES[1:]:
            own = staged(stage(spark, own, SF), "odd")
            assert own.count() >= least, name
            if name != "best-fit packing":
                assert own.columns == docs.columns
                assert own.where("_key <> 7 OR _hit <> 'h' OR rest <> 'r'").count() == 0, name
        rated = c.STAGES[0][1](spark, docs if least else docs.where("1 = 0"), SF)
        assert rated.columns == docs.columns and rated.where("_key <> 7").count() == 0 and rated.count() <= 6
