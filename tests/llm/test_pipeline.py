"""The registered queries, and the pipeline against brute-force versions of its stages."""

import os
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from linelens.llm import mixing
from linelens.llm.queries import ORACLE, QUERIES

from .test_operators import brute_components, brute_contamination, brute_fingerprint

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables aren't there")


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_oracle(spark, name):
    import glob

    import duckdb

    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    df, want = QUERIES[name](spark, SF), c.sql(ORACLE[name])
    cols = sorted(df.columns)
    assert cols == sorted(want.columns)
    mine = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)
    assert mine == sorted((tuple(r[want.columns.index(c)] for c in cols) for r in want.fetchall()), key=repr)


def test_registered():
    names = entry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    items = [(str(r["item_id"]), r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), stage(spark, docs, SF).schema)
        after = docs.collect()
        ids = sorted(r["doc_id"] for r in after)
        if name != "shards":
            assert docs.columns == columns
        if name == "toxicity":
            labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
            gone = {r["doc_id"] for r in before} - set(ids)
            assert sum(labels.get(i) == 0 for i in gone) <= 0.03 * len(before)
        elif name == "near_copies":
            label = brute_components([brute_fingerprint(r["text"]) for r in before])
            assert ids == sorted(min(before[i]["doc_id"] for i in np.flatnonzero(label == c)) for c in set(label))
        elif name == "decontamination":
            assert ids == sorted(r["doc_id"] for r, w in zip(before, brute_contamination([r["text"] for r in before], items)) if not w[4])
        elif name == "mixing":
            size = {r["doc_id"]: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) for r in before}
            source = {r["doc_id"]: r["source"] for r in before}
            totals = {}
            for i, s in source.items():
                totals[s] = totals.get(s, 0) + size[i]
            targets = mixing.quotas([(s, totals[s]) for s in sorted(totals)])
            taken = {}
            for i in ids:
                taken[source[i]] = taken.get(source[i], 0) + size[i]
            assert max(ids.count(i) for i in set(ids)) <= 3
            assert all(taken.get(s, 0) <= t + max(size.values()) for s, t in targets.items())
        else:
            assert ids == sorted(r["doc_id"] for r in before)
            assert set(columns) <= set(docs.columns)


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 0 and out.agg(F.max("shard")).first()[0] <= 39


def test_run_on_odd_tables(spark, tmp_path):
    """Null and empty texts and ids, repeated rows, clashing columns, and tables without rows."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, size string, __row string"
    rows = [(i, f"words of text number {i} that go on for a while {'and on ' * i}", "en", "ab"[i % 2], 1, "s", "r") for i in range(30)]
    rows += [(30, None, None, None, None, None, None), (31, "", "en", "a", 0, "s", "r"), (None, "without an id, this one", "en", "b", 1, "s", "r"), rows[3], rows[3]]
    labels, items = spark.createDataFrame([], "doc_id long, quality int, toxic int"), spark.createDataFrame([], "item_id long, text string")
    for name, own in (("some", rows), ("none", [])):
        spark.createDataFrame(own, schema).write.parquet(str(tmp_path / name / "documents.parquet"))
        labels.write.parquet(str(tmp_path / name / "labels.parquet"))
        items.write.parquet(str(tmp_path / name / "benchmark.parquet"))
        out = corpus_pipeline.run(spark, str(tmp_path / name))
        assert {"doc_id", "text", "size", "size_in", "__row", "shard", "slot"} <= set(out.columns)
        got = out.collect()
        assert bool(got) == bool(own) and all(r["size_in"] == "s" and r["__row"] == "r" for r in got if r["text"])
        slots = sorted((r["shard"], r["slot"]) for r in got)
        assert all(b == (a[0], a[1] + 1) or (b[0] > a[0] and b[1] == 0) for a, b in zip(slots, slots[1:]))
