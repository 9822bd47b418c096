"""Streams over finished inputs give what the batch forms give."""

import datetime as dt

from pyspark.sql import functions as F

from lorespark.operators import telemetry as M
from lorespark.streaming import stateful as S

T0 = dt.datetime(2024, 1, 1)
ROWS = [(f"k{i % 3}", T0 + dt.timedelta(seconds=10 * i), i % 4 != 0, float(i)) for i in range(40)]


def source(spark, tmp_path, rows, shape):
    d = str(tmp_path / "in")
    spark.createDataFrame(rows, shape).coalesce(1).write.parquet(d)
    return spark.readStream.schema(shape).parquet(d)


def drain(df, tmp_path, name, mode):
    df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination()
    return df.sparkSession.table(name)


def test_confidence(spark, tmp_path):
    shape = "name string, ts timestamp, ok boolean, value double"
    got = drain(S.confidence(source(spark, tmp_path, ROWS, shape)), tmp_path, "conf", "update")
    want = M.confidence(spark.createDataFrame(ROWS, shape), "name", ["ts"], F.col("ok"))
    cols = ["name", F.round("confidence", 9), "confirmations", "contradictions"]
    assert sorted(got.select(*cols).collect()) == sorted(want.select(*cols).collect())


def test_reformulated(spark, tmp_path):
    rows = [("s", "k", "h1", T0), ("s", "k", "h2", T0 + dt.timedelta(seconds=30)), ("s", "k", "h3", T0 + dt.timedelta(seconds=100)), ("s", "z", "h1", T0)]
    got = drain(S.reformulated(source(spark, tmp_path, rows, "session_id string, search_key string, query_hash string, ts timestamp")), tmp_path, "ref", "append")
    assert [(r.query_hash, r.cluster_size) for r in got.collect()] == [("h2", 2)]


def test_windows_sessions_and_once(spark, tmp_path):
    shape = "name string, ts timestamp, ok boolean, value double"
    src = source(spark, tmp_path, ROWS + ROWS[:5], shape)
    assert sum(r.n for r in drain(S.tumbling(src, ["name"], "1 minute"), tmp_path, "tumb", "complete").collect()) == 45
    assert {r.n for r in drain(S.sliding(src, [], "2 minutes", "1 minute"), tmp_path, "slid", "complete").collect()} >= {12}
    assert sum(r.n for r in drain(S.sessions(src, "name", "25 seconds"), tmp_path, "sess", "complete").collect()) == 45
    assert drain(S.once(src, ["name", "ts"]), tmp_path, "once", "append").count() == 40


def test_upsert(spark, tmp_path):
    shape = "name string, ts timestamp, ok boolean, value double"
    S.upsert_each(source(spark, tmp_path, ROWS, shape), str(tmp_path / "t"), "name", str(tmp_path / "cp")).start().awaitTermination()
    assert sorted((r.name, r.value) for r in spark.read.parquet(str(tmp_path / "t/v=0")).collect()) == [("k0", 39.0), ("k1", 37.0), ("k2", 38.0)]
