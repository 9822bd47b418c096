"""Event-log analytics: summaries, co-occurrence, gaps, state folds and sequence patterns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CONFIRM, CONTRADICT, DECAY, PRUNE = 0.1, 0.5, 0.95, 0.2
FULL_CONFIDENCE = 20


def summary(events: DataFrame) -> DataFrame:
    """One row over (session_id, sections_requested, sections_matched, tokens, rehydrated, latency_ms); zeros for an empty log."""
    rate = lambda c: F.coalesce(F.avg(c.cast("double")), F.lit(0.0))
    return events.agg(
        F.count("*").alias("total"), F.countDistinct(F.coalesce("session_id", F.lit(""))).alias("sessions"), F.round(rate(F.coalesce("tokens", F.lit(0))), 6).alias("avg_tokens"),
        F.round(rate(F.coalesce("rehydrated", F.lit(False)).cast("int")), 6).alias("rehydration_rate"), F.round(rate(F.coalesce("latency_ms", F.lit(0.0))), 6).alias("avg_latency_ms"),
        F.round(rate((F.coalesce("sections_matched", F.lit(0)) == 0).cast("int")), 6).alias("zero_match_rate"),
    )


def top_sections(events: DataFrame) -> DataFrame:
    """How often each section was requested; repeats inside an event count."""
    return events.select(F.explode("sections_requested").alias("section")).groupBy("section").agg(F.count("*").alias("n"))


def rates(events: DataFrame, hydrate: str, raw: str, search: str, reformulated: str, unknown: str) -> DataFrame:
    """Counts by type and three rates; a rate is null where its denominator is 0."""
    n = lambda t: F.count_if(F.col("event_type") == t)
    per = lambda a, b: F.round(n(a) / F.nullif(n(b), F.lit(0)), 6)
    return events.agg(F.count("*").alias("total"), per(raw, hydrate).alias("raw_rate"), per(unknown, hydrate).alias("unknown_rate"), per(reformulated, search).alias("reformulated_rate"))


def co_occurrences(events: DataFrame, least: int = 3) -> DataFrame:
    """(a, b, n, questions): pairs of distinct sections of one event, a < b, that at least ``least`` events share."""
    each = events.select("event", "question_hash", F.explode(F.array_distinct("sections_requested")).alias("s"))
    pairs = each.select("event", F.col("s").alias("a")).join(each.select("event", "question_hash", F.col("s").alias("b")), "event").filter("a < b")
    return pairs.groupBy("a", "b").agg(F.count("*").alias("n"), F.countDistinct(F.nullif("question_hash", F.lit(""))).alias("questions")).filter(F.col("n") >= least)


def pattern_fields(pairs: DataFrame) -> DataFrame:
    """Entities made of pairs: four fields each, confidence n / 20 and 1 at most."""
    name = F.concat(F.lit("PATTERN-"), "a", F.lit("-AND-"), "b")
    fields = F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in (("pattern", F.lit("co-retrieved")), ("section_a", F.col("a")), ("section_b", F.col("b")), ("observed_in_questions", F.col("questions").cast("string")))])
    rows = pairs.select(name.alias("name"), F.least(F.lit(1.0), F.col("n") / FULL_CONFIDENCE).alias("confidence"), F.col("n").alias("observations"), F.explode(fields).alias("f"))
    return rows.select("name", "confidence", "observations", "f.key", "f.value")


def gaps(events: DataFrame, least: int = 3) -> DataFrame:
    """Questions that matched nothing at least ``least`` times, with the first and last time."""
    missed = events.filter((F.coalesce("sections_matched", F.lit(0)) == 0) & (F.coalesce("question_hash", F.lit("")) != ""))
    g = missed.groupBy("question_hash").agg(F.count("*").alias("n"), F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen"))
    return g.filter(F.col("n") >= least)


def confidence(events: DataFrame, key: str, order: list[str], confirmed: Column, start: float = 0.0) -> DataFrame:
    """Ordered fold per key: a confirmation closes a tenth of the gap to 1, a contradiction halves; counts and the last time."""
    steps = F.array_sort(F.collect_list(F.struct(*order, confirmed.alias("ok"))))
    fold = F.aggregate(steps, F.lit(start), lambda c, s: F.when(s["ok"], c + (1 - c) * CONFIRM).otherwise(c * CONTRADICT))
    return events.groupBy(key).agg(fold.alias("confidence"), F.count_if(confirmed).alias("confirmations"), F.count_if(~confirmed).alias("contradictions"), F.max(order[0]).alias("last_observed"))


def decayed(state: DataFrame, now: Column, prune: float | None = None) -> DataFrame:
    """Confidence times 0.95 a (fractional) day since the last observation; rows below ``prune`` go."""
    days = F.greatest(F.lit(0.0), (F.unix_micros(now) - F.unix_micros(F.col("last_observed").cast("timestamp"))) / 86_400_000_000)
    out = state.withColumn("current", F.col("confidence") * F.pow(F.lit(DECAY), days))
    return out if prune is None else out.filter(F.col("current") >= prune)


def stamped(entities: DataFrame, state: DataFrame) -> DataFrame:
    """Confidence of entities: that of the prefixed name first, then of the bare one; rule entities keep their own."""
    full, bare = state.select(F.col("name").alias("full"), F.col("confidence").alias("c1")), state.select(F.col("name").alias("bare"), F.col("confidence").alias("c2"))
    e = entities.join(full, F.concat(F.lit("ENTITY-"), "name") == F.col("full"), "left").join(bare, F.col("name") == F.col("bare"), "left")
    return e.withColumn("stamped", F.when(F.col("layer") == "rules", F.col("confidence")).otherwise(F.coalesce("c1", "c2", "confidence"))).drop("full", "bare", "c1", "c2")


def fact_ladder(actions: DataFrame) -> DataFrame:
    """Facts through add (0.7), confirm (the first raises to 0.95, later ones are recorded) and challenge (halves).

    Acts of the fact's own expert other than adding it are invalid and only counted.
    """
    steps = F.array_sort(F.collect_list(F.struct("ord", "act", "expert")))
    first = F.aggregate(steps, F.lit(None).cast("string"), lambda a, s: F.coalesce(a, F.when(s["act"] == "add", s["expert"])))
    g = actions.groupBy("fact").agg(steps.alias("steps"), first.alias("owner"))
    zero = F.struct(F.lit(0.0).alias("c"), F.lit(0).alias("confirms"), F.lit(0).alias("dissents"), F.lit(0).alias("invalid"))

    def step(a: Column, s: Column) -> Column:
        own = (s["act"] != "add") & (s["expert"] == F.col("owner"))
        c = F.when(s["act"] == "add", F.lit(0.7)).when(own, a["c"]).when((s["act"] == "confirm") & (a["confirms"] == 0), F.greatest(a["c"], F.lit(0.95))).when(s["act"] == "challenge", a["c"] * 0.5).otherwise(a["c"])
        one = lambda act: F.when((s["act"] == act) & ~own, 1).otherwise(0)
        return F.struct(c.alias("c"), (a["confirms"] + one("confirm")).alias("confirms"), (a["dissents"] + one("challenge")).alias("dissents"), (a["invalid"] + F.when(own, 1).otherwise(0)).alias("invalid"))

    s = g.withColumn("s", F.aggregate("steps", zero, step))
    return s.select("fact", "owner", F.col("s.c").alias("confidence"), F.col("s.confirms").alias("confirms"), F.col("s.dissents").alias("dissents"), F.col("s.invalid").alias("invalid"))


def reformulated(searches: DataFrame, by: list[str], window_s: int = 60, least: int = 2) -> DataFrame:
    """Searches at which the same normalised key had ``least`` or more distinct wordings within the last seconds; one row a qualifying search."""
    w = Window.partitionBy(*by, "search_key").orderBy(F.col("ts").cast("timestamp").cast("long")).rangeBetween(-window_s, Window.currentRow)
    return searches.withColumn("cluster_size", F.size(F.collect_set("query_hash").over(w))).filter(F.col("cluster_size") >= least)


def previous_match(events: DataFrame, by: list[str], order: list[str], is_call: Column, is_source: Column, item: str, look_back: int = 5) -> DataFrame:
    """As-of match: each call with the nearest of the last ``look_back`` sources of its session that has the same item, and the distance in sources."""
    before = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    numbered = events.withColumn("seq", F.count(F.when(is_source, 1)).over(before))
    last = Window.partitionBy(*by, item).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    near = numbered.withColumn("at", F.max(F.when(is_source, F.col("seq") + 1)).over(last))
    return near.filter(is_call & (F.col("seq") - F.col("at") < look_back)).withColumn("elapsed", F.col("seq") - F.col("at") + 1)


def islands(events: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """A number for each run of equal ``value`` in order: the partition key after which state starts anew."""
    w = Window.partitionBy(*by).orderBy(*order)
    change = F.when(F.lag(value).over(w).eqNullSafe(F.col(value)), 0).otherwise(1)
    return events.withColumn("c_", change).withColumn("island", F.sum("c_").over(w).cast("long")).drop("c_")


def sessions(events: DataFrame, by: str, gap_s: int) -> DataFrame:
    """Session windows: events of a key with no gap of ``gap_s`` seconds or more."""
    return events.groupBy(by, F.session_window("ts", f"{gap_s} seconds").alias("w")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(by, F.col("w.start").alias("started"), "n", "total")
