"""Snapshots: change classification, reuse, document diffs, nested folders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def classify(old: DataFrame, new: DataFrame, path: str = "path") -> DataFrame:
    """(path, state) of two snapshots (path, mtime, sha256): new, deleted, unchanged (same time, or else same hash), modified."""
    o = old.select(F.col(path), F.col("mtime").alias("m0"), F.col("sha256").alias("h0"), F.lit(True).alias("had"))
    n = new.select(F.col(path), F.col("mtime").alias("m1"), F.col("sha256").alias("h1"), F.lit(True).alias("has"))
    state = F.when(F.col("had").isNull(), "new").when(F.col("has").isNull(), "deleted").when((F.col("m0") == F.col("m1")) | (F.col("h0") == F.col("h1")), "unchanged").otherwise("modified")
    return o.join(n, path, "full_outer").select(path, state.alias("state"))


def to_parse(files: DataFrame, prior: DataFrame, path: str = "path") -> DataFrame:
    """Files that no prior snapshot holds with the same hash: only these are read again."""
    return files.join(prior.select(path, "sha256"), [path, "sha256"], "left_anti")


def diff(old: DataFrame, new: DataFrame, key: list[str], value: str = "value") -> DataFrame:
    """(key, change, old_value, new_value): what was added, removed or changed."""
    o = old.select(*key, F.col(value).alias("old_value"), F.lit(1).alias("o_"))
    n = new.select(*key, F.col(value).alias("new_value"), F.lit(1).alias("n_"))
    j = o.join(n, key, "full_outer")
    change = F.when(F.col("o_").isNull(), "added").when(F.col("n_").isNull(), "removed").when(~F.col("old_value").eqNullSafe(F.col("new_value")), "changed")
    return j.withColumn("change", change).filter("change IS NOT NULL").select(*key, "change", "old_value", "new_value")


def line_diff(old: DataFrame, new: DataFrame, key: str, line: str = "line") -> DataFrame:
    """(key, line, change) of lines as sets."""
    o, n = old.select(key, line).distinct(), new.select(key, line).distinct()
    return n.exceptAll(o).withColumn("change", F.lit("added")).unionByName(o.exceptAll(n).withColumn("change", F.lit("removed")))


def upsert(state: DataFrame, packed: DataFrame, deleted: DataFrame, path: str = "path") -> DataFrame:
    """The state table after a run: packed rows replace their paths, deleted paths go."""
    return state.join(packed.select(path).unionByName(deleted.select(path)), path, "left_anti").unionByName(packed)


def outermost(folders: DataFrame, path: str = "path") -> DataFrame:
    """Folders that lie in no other one: an equi join with all ancestors of each, not a comparison of all pairs."""
    parts = F.split(F.col(path), "/")
    above = folders.filter(F.size(parts) > 1).select(path, F.explode(F.sequence(F.lit(1), F.size(parts) - 1)).alias("k")).select(path, F.array_join(F.slice(F.split(F.col(path), "/"), F.lit(1), F.col("k")), "/").alias("up"))
    nested = above.join(folders.select(F.col(path).alias("up")).distinct(), "up", "left_semi").select(path)
    return folders.distinct().join(nested, path, "left_anti")


def not_yet(requested: DataFrame, seen: DataFrame, by: str, name: str) -> DataFrame:
    """Requested names that a session has not had, whatever their case."""
    return requested.join(seen.select(F.col(by).alias("b_"), F.upper(F.col(name)).alias("u_")).distinct(), (requested[by] == F.col("b_")) & (F.upper(requested[name]) == F.col("u_")), "left_anti")
