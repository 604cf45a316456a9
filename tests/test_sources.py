import json
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import keyfold
from keyfold.operators.fixpoint import fixpoint
from keyfold.plans.types import row_type
from keyfold.sources import sinks
from keyfold.streaming.windows import windowed_group


def test_csv_tbl_ndjson(spark, tmp_path):
    (tmp_path / "d.csv").write_text("k,v\nA,1\nB,2\nA,3\n")
    (tmp_path / "d.tbl").write_text("A|1|\nB|2|\nA|3|\n")
    (tmp_path / "d.ndjson").write_text("\n".join(json.dumps({"k": k, "v": v}) for k, v in (("A", 1), ("B", 2), ("A", 3))))
    schema = row_type("{k: string, v: i32}")
    for form in ("csv", "tbl", "ndjson"):
        table = keyfold.load(spark, form, str(tmp_path / f"d.{form}"), schema)
        assert keyfold.run(spark, keyfold.query("{t.*.k: sum t.*.v}"), t=table).collect() == {"A": 4, "B": 2}
    text = keyfold.query("sum (loadCSV @file @schema).*.v", file=keyfold.plans.ir.const(str(tmp_path / "d.csv")), schema=keyfold.plans.ir.const("k string, v int"))
    assert keyfold.run(spark, text).collect() == 6


def test_file_names_from_a_table(spark, tmp_path):
    for name, v in (("a", 1), ("b", 5)):
        (tmp_path / f"{name}.csv").write_text(f"k,v\nA,{v}\nB,{v + 1}\n")
    files = [{"file": str(tmp_path / "a.csv")}, {"file": str(tmp_path / "b.csv")}]
    schema = keyfold.plans.ir.const("k string, v int")
    assert keyfold.run(spark, keyfold.query("sum (loadCSV files.*f.file @schema).*r.v", schema=schema), files=files).collect() == 14
    assert keyfold.run(spark, keyfold.query("{*f: sum (loadCSV files.*f.file @schema).*r.v}", schema=schema), files=files).collect() == {"0": 3, "1": 11}


def test_text_output(spark, tmp_path):
    df = spark.createDataFrame([("A", 1.5, None)], "k string, v double, n int")
    assert list(sinks.lines(df, "bars")) == ["A|1.5000|null|"]
    assert list(sinks.lines(df)) == ['{"k":"A","v":1.5}']
    sinks.write(df, str(tmp_path / "out"), "bars")
    assert spark.read.text(str(tmp_path / "out")).head()[0] == "A|1.5000|null|"


def test_fixpoint(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4)], "a int, b int")
    step = lambda r: r.unionByName(r.join(edges.select(F.col("a").alias("b"), F.col("b").alias("c")), "b").select("a", F.col("c").alias("b")))
    assert fixpoint(edges, step).count() == 6


def test_windows_on_streams_match_batches(spark, tmp_path):
    rows = [(f"2024-01-01 00:0{i}:00", "x" if i % 2 else "y", float(i)) for i in range(8)]
    df = spark.createDataFrame(rows, "t string, k string, v double").withColumn("t", F.to_timestamp("t"))
    df.write.parquet(str(tmp_path / "in"))
    want = sorted(map(tuple, windowed_group(df, "t", "5 minutes", ["k"], {"n": ("count", "v"), "s": ("sum", "v")}).collect()))
    stream = windowed_group(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), "t", "5 minutes", ["k"], {"n": ("count", "v"), "s": ("sum", "v")})
    query = stream.writeStream.outputMode("complete").format("memory").queryName("windows").start()
    query.processAllAvailable()
    query.stop()
    assert sorted(map(tuple, spark.table("windows").collect())) == want


def test_command_line():
    root = str(Path(__file__).resolve().parent.parent)
    done = subprocess.run([sys.executable, "-m", "keyfold", "sum stdin.*"], input="[1, 2, 3]", capture_output=True, text=True, cwd=root, timeout=180)
    assert done.stdout.strip() == "6", done.stderr[-500:]


def test_vectorised_functions_arity_and_preload(spark):
    df = spark.createDataFrame([(1, 2.0), (2, 5.0)], "id int, v double")
    udf = {"double": keyfold.Udf(lambda v: v * 2, "double", vectorized=True), "one": keyfold.Udf(lambda v: v, "double")}
    table = keyfold.preload(keyfold.Table(df, "id"))
    assert keyfold.run(spark, keyfold.query("sum (udf.double t.*.v)"), t=table, udf=udf).collect() == 14
    assert keyfold.run(spark, keyfold.query('hint "broadcast" (max t.*.v)'), t=table, udf=udf).collect() == 5
    assert table.df.storageLevel.useMemory
    with pytest.raises(TypeError, match="argument"):
        keyfold.run(spark, keyfold.query("udf.one t.*.v t.*.v"), t=table, udf=udf).collect()


def test_json_documents(spark, tmp_path):
    (tmp_path / "d.json").write_text(json.dumps([{"k": "A", "v": 1, "in": {"x": [1, 2]}}, {"k": "B", "v": "wrong"}, {"k": "A", "v": 5, "in": None}]))
    table = keyfold.load(spark, "json", str(tmp_path / "d.json"), row_type("{k: string, v: i32, in: {x: [i32]}}"))
    assert keyfold.run(spark, keyfold.query("{t.*.k: {v: sum t.*.v, n: count t.*.in.x.*i}}"), t=table).collect() == {"A": {"v": 6, "n": 2}, "B": {"v": 0, "n": 0}}
