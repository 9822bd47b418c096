"""Structured Streaming forms of the event operators: each gives, on a finished input, what its batch form gives."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lorespark.operators.telemetry import CONFIRM, CONTRADICT


def confidence(events: DataFrame, key: str = "name") -> DataFrame:
    """(key, confidence, confirmations, contradictions) after each batch: events of (key, ts, ok) folded in time order within a batch.

    The state of a key is three numbers, so it grows with the keys and not with the events.
    """

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        c, yes, no = state.get if state.exists else (0.0, 0, 0)
        for ok in pd.concat(list(batches)).sort_values(["ts", "ok"])["ok"]:
            c, yes, no = (c + (1 - c) * CONFIRM, yes + 1, no) if ok else (c * CONTRADICT, yes, no + 1)
        state.update((c, yes, no))
        yield pd.DataFrame({key: [k[0]], "confidence": [c], "confirmations": [yes], "contradictions": [no]})

    out = f"{key} string, confidence double, confirmations long, contradictions long"
    return events.groupBy(key).applyInPandasWithState(step, out, "c double, yes long, no long", "update", GroupStateTimeout.NoTimeout)


def reformulated(searches: DataFrame, window_s: int = 60, least: int = 2, late: str = "10 minutes") -> DataFrame:
    """Searches that reword, within ``window_s`` seconds and a session, an earlier one with the same key.

    A session's state holds only the wordings of the last ``window_s`` seconds, and ends after that much silence.
    """

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        times, hashes = state.get if state.exists else ([], [])
        held, out = list(zip(times, hashes)), []
        for r in pd.concat(list(batches)).sort_values(["ts", "query_hash"]).itertuples():
            now = int(r.ts.timestamp())
            held = [(t, h) for t, h in held if t >= now - window_s] + [(now, r.query_hash)]
            n = len({h for _, h in held})
            if n >= least:
                out.append((k[0], k[1], r.query_hash, r.ts, n))
        state.update(([t for t, _ in held], [h for _, h in held]))
        state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs() + 1, (held[-1][0] + window_s) * 1000))
        yield pd.DataFrame(out, columns=["session_id", "search_key", "query_hash", "ts", "cluster_size"])

    shape = "session_id string, search_key string, query_hash string, ts timestamp, cluster_size int"
    s = searches.withWatermark("ts", late).groupBy("session_id", "search_key")
    return s.applyInPandasWithState(step, shape, "times array<long>, hashes array<string>", "append", GroupStateTimeout.EventTimeTimeout)


def tumbling(events: DataFrame, by: list[str], width: str, late: str = "10 minutes") -> DataFrame:
    """Counts and totals by window; events later than ``late`` are dropped with the window's state."""
    g = events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), *by).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("w.start").alias("started"), *by, "n", "total")


def sliding(events: DataFrame, by: list[str], width: str, slide: str, late: str = "10 minutes") -> DataFrame:
    g = events.withWatermark("ts", late).groupBy(F.window("ts", width, slide).alias("w"), *by).agg(F.count("*").alias("n"))
    return g.select(F.col("w.start").alias("started"), *by, "n")


def sessions(events: DataFrame, by: str, gap: str, late: str = "10 minutes") -> DataFrame:
    g = events.withWatermark("ts", late).groupBy(by, F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return g.select(by, F.col("w.start").alias("started"), "n", "total")


def once(events: DataFrame, key: list[str], late: str = "10 minutes") -> DataFrame:
    """Events without those repeated, by key, within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(key)


def upsert_each(changes: DataFrame, table: str, key: str, checkpoint: str, order: str = "ts"):
    """Keeps the parquet snapshots ``table/v=N`` current: every micro-batch writes the next one, from the last and its newest rows.

    A batch that runs again after a failure writes the same snapshot again.
    """
    from pyspark.sql import Window

    def apply(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        new = batch.withColumn("k_", F.row_number().over(Window.partitionBy(key).orderBy(F.col(order).desc()))).filter("k_ = 1").drop("k_")
        if n > 0:
            new = spark.read.parquet(f"{table}/v={n - 1}").join(new.select(key), key, "left_anti").unionByName(new)
        new.write.mode("overwrite").parquet(f"{table}/v={n}")

    return changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True)
