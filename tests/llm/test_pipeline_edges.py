"""The pipeline's stages on rows that are odd in every column, one stage after the other."""

import random
from collections import Counter

import pytest

pipeline = pytest.importorskip("corpus_pipeline")

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kf_size long, sha string, c0 string"


def text(seed, n=60):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice(["th", "er", "ing", "and", "ou", "wh"]) for _ in range(3)) for _ in range(n))


def odd_rows():
    long = text(5, 30_000)
    near = text(7, 100).split()
    rows = [(i, text(100 + i), "en", "web" if i % 3 else None) for i in range(40)]
    rows += [(50, None, "en", "web"), (51, "", None, None), (52, " \n", "en", "web"), (53, "12 34", None, "web"), (None, text(900), "en", "web")]
    rows += [(60, text(100), "en", "web"), (61, text(100).replace(" ", "\n", 5), None, "book"), (62, text(101), "en", None), (62, text(101), "en", None)]
    rows += [(70, long, "en", "book"), (71, long + " more", "en", "book")]
    rows += [(80 + k, " ".join([*near[:k], "other", *near[k + 1 :]]), "en", "web") for k in range(0, 8, 2)]
    return [(*r, None, k, None, "c" if k % 2 else None) for k, r in enumerate(rows)]


def test_odd_rows_through_every_stage(spark, tmp_path):
    docs = spark.createDataFrame(odd_rows(), SCHEMA)
    kept = []
    for k, (_, stage) in enumerate(pipeline.STAGES):
        stage(spark, docs, "").write.parquet(f"{tmp_path}/{k}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{k}")
        if k < 4:
            assert docs.columns == before.columns
            kept.append(Counter(r.doc_id for r in docs.collect()))
            assert {tuple(r) for r in docs.collect()} <= {tuple(r) for r in before.collect()}
    everything = Counter(r[0] for r in odd_rows())
    assert kept[0] == everything - Counter([50, 51, 52, 53])
    assert kept[1] == kept[0] - Counter([60, 61, 62, 62])
    assert kept[2] == kept[1] - Counter([71, 82, 84, 86])
    assert set(kept[3]) <= set(kept[2]) and max(kept[3].values()) <= 2
    assert Counter(r.doc_id for r in docs.where("piece = 0").collect()) == kept[3]


def test_empty_table_through_every_stage(spark, tmp_path):
    docs = spark.createDataFrame([], SCHEMA)
    for k, (_, stage) in enumerate(pipeline.STAGES):
        stage(spark, docs, "").write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        assert docs.count() == 0
