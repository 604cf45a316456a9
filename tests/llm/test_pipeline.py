"""Whole queries and the pipeline on the smallest tables."""

from collections import Counter
from pathlib import Path

import pytest

SF = "/root/testdata/sf0.001"
pipeline = pytest.importorskip("corpus_pipeline")
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


def test_stages_follow_each_other(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    ids, columns = {r.doc_id for r in docs.collect()}, docs.columns
    for name, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == columns, name
        now = Counter(r.doc_id for r in docs.select("doc_id").collect())
        assert set(now) <= ids and max(now.values()) <= 2
        ids = set(now)
    pieces = pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert Counter(r.doc_id for r in pieces if r.piece == 0) == now


def test_run(spark):
    rows = pipeline.run(spark, SF).collect()
    size = Counter()
    for r in rows:
        size[r.sequence_id] += r.length
    assert rows and max(size.values()) <= 4096


def test_every_query_is_registered():
    from keyfold.llm.queries import queries

    assert sorted(int(n[2:].split("_")[0]) for n in queries()) == list(range(1, 11))
