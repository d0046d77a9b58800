"""Counts of what preprocessing kept and dropped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .metrics import quantile, ranked
from .scales import day_steps


def step_quantiles(stays: DataFrame) -> DataFrame:
    """``(p50, p95, longest)`` of step distances in km, exact and interpolated between values; nulls without steps."""
    rows = ranked(day_steps(stays).select(F.lit("all").alias("side"), F.col("km").alias("x")))
    return rows.agg(quantile(0.5).alias("p50"), quantile(0.95).alias("p95"), F.max("x").alias("longest"))


def kept_report(before: DataFrame, after: DataFrame) -> DataFrame:
    """``(item, value)``: users, days and stays before and after, and averages of what is kept."""
    count = lambda df, p: df.agg(F.countDistinct("user_id").alias(f"{p}_users"), F.countDistinct("user_id", "date").alias(f"{p}_days"), F.count("*").alias(f"{p}_stays"))
    one = count(before, "all").join(count(after, "kept"))
    one = one.withColumn("stays_per_day", F.try_divide("kept_stays", "kept_days")).withColumn("days_per_user", F.try_divide("kept_days", "kept_users"))
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("item"), F.col(c).cast("double").alias("value")) for c in one.columns])).alias("r")).select("r.item", "r.value")


def shares(stays: DataFrame, column: str) -> DataFrame:
    """``(label, n)``: stays by intent, or user-days by day type."""
    rows = stays if column == "intent_class" else stays.select("user_id", "date", column).distinct()
    return rows.groupBy(F.col(column).alias("label")).agg(F.count("*").alias("n"))


def drop_reasons(stays: DataFrame, rules: dict[str, DataFrame]) -> DataFrame:
    """``(reason, users)``: users of ``stays`` that each rule, on its own, leaves nothing of."""
    users = stays.select("user_id").distinct()
    parts = [users.join(kept.select("user_id").distinct(), "user_id", "left_anti").agg(F.count("*").alias("users")).select(F.lit(name).alias("reason"), "users") for name, kept in rules.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def exclusive_quartiles(values: DataFrame, column: str) -> DataFrame:
    """``(q1, q2, q3)`` at places (n + 1) p between the sorted values of small integers, which are counted first."""
    counts = values.groupBy(F.col(column).cast("double").alias("v")).agg(F.count("*").alias("n"))
    table = counts.agg(F.array_sort(F.collect_list(F.struct("v", "n"))).alias("t"), F.sum("n").alias("total"))

    def nth(k: Column) -> Column:
        """The k-th smallest value, from 1."""
        state = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("double").alias("v"))
        step = lambda a, x: F.struct((a["seen"] + x["n"]).alias("seen"), F.when(a["v"].isNull() & (a["seen"] + x["n"] >= k), x["v"]).otherwise(a["v"]).alias("v"))
        return F.aggregate("t", state, step)["v"]

    cols = []
    for i, p in enumerate((0.25, 0.5, 0.75), 1):
        at = (F.col("total") + 1) * p
        low = F.greatest(F.lit(1), F.least(F.floor(at), F.col("total") - 1))
        cols.append((nth(low) + (at - low) * (nth(low + 1) - nth(low))).alias(f"q{i}"))
    return table.select(*cols)


class Ledger:
    """Counters that ride along with the steps of a run: each is observed when its step is written, without a scan of its own."""

    def __init__(self) -> None:
        self.seen: list[tuple[Observation, dict[str, Column]]] = []

    def watch(self, df: DataFrame, **counts: Column) -> DataFrame:
        """``df`` with counters; it must be written once by the run, and only once."""
        observed = Observation()
        self.seen.append((observed, counts))
        return df.observe(observed, *[F.coalesce(c.cast("double"), F.lit(0.0)).alias(n) for n, c in counts.items()])

    def values(self) -> dict[str, float]:
        """All counters; waits for the steps that hold them."""
        return {name: float(seen.get.get(name) or 0.0) for seen, counts in self.seen for name in counts}

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(sorted(self.values().items()), "item string, value double")


def fates(users: DataFrame, steps: dict[str, DataFrame]) -> DataFrame:
    """``(item, value)``: how many of ``users(user_id)`` each step lost first. ``steps`` in order, by the reason that one has
    for losing a user: tables that hold the users left behind it."""
    rows = users.select("user_id").distinct()
    reason = F.lit(None).cast("string")
    for name, left in steps.items():
        rows = rows.join(left.select("user_id").distinct().withColumn(f"in_{name}", F.lit(True)), "user_id", "left")
    for name in reversed(steps):
        reason = F.when(F.col(f"in_{name}").isNull(), f"dropped.{name}").otherwise(reason)
    counts = rows.agg(F.count("*").alias("n_users_in"), *[F.count_if(reason == f"dropped.{n}").alias(f"dropped.{n}") for n in steps], F.count_if(reason.isNull()).alias("n_users_kept"))
    return items(counts)


def items(one: DataFrame) -> DataFrame:
    """The columns of a single row as ``(item, value)``."""
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("item"), F.col(f"`{c}`").cast("double").alias("value")) for c in one.columns])).alias("r")).select("r.item", "r.value")


def kept_summary(stays: DataFrame) -> DataFrame:
    """``(item, value)`` of labelled stays: days, stays, averages, shares of intents and day types, steps in km."""
    one = stays.agg(F.countDistinct("user_id").alias("users"), F.countDistinct("user_id", "date").alias("n_days"), F.count("*").alias("n_stays"))
    one = one.select("n_days", "n_stays", F.round(F.col("n_days") / F.greatest(F.lit(1), "users"), 1).alias("avg_days_per_user"), F.round(F.col("n_stays") / F.greatest(F.lit(1), "n_days"), 1).alias("avg_stays_per_day"))
    named = lambda df, head: df.select(F.concat(F.lit(head), F.col("label").cast("string")).alias("item"), F.col("n").cast("double").alias("value"))
    steps = step_quantiles(stays).select(F.coalesce(F.round("p50", 2), F.lit(0.0)).alias("step_km.p50"), F.coalesce(F.round("p95", 1), F.lit(0.0)).alias("step_km.p95"), F.coalesce(F.round("longest", 1), F.lit(0.0)).alias("step_km.max"))
    return items(one).unionByName(named(shares(stays, "intent_class"), "intent.")).unionByName(named(shares(stays, "day_type"), "day_type.")).unionByName(items(steps))
