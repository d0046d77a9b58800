"""Training samples: context and history windows over a user's days, flattened into parallel arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import duration_low, duration_middle
from .tokens import activity

#: Special tokens behind the vocabulary, and limits of a sample.
PAD, BOS, EOS, SEP = 0, 1, 2, 3
CONTEXT_DAYS, HISTORY_DAYS, DAY_TOKENS, HISTORY_TOKENS = 3, 30, 20, 200
FIELDS = ("cell_id", "scale", "duration", "arrival", "loc_type")
PAD_ACTIVITY, PAD_DURATION, PAD_ARRIVAL = 4, 24, 288


def _field(tokens: str, name: str) -> Column:
    return F.transform(tokens, lambda t: t[name])


def windows(days: DataFrame, context: int = CONTEXT_DAYS, history: int = HISTORY_DAYS) -> DataFrame:
    """Adds ``context`` and ``hist`` (arrays of token days before a day) to ``days(user_id, date, day_type, tokens)``.

    Days are cut to the tokens that a sample may hold before they are copied.
    """
    short = days.withColumn("tokens", F.slice("tokens", 1, DAY_TOKENS))
    w = Window.partitionBy("user_id").orderBy("date")
    rows = short.withColumn("context", F.collect_list("tokens").over(w.rowsBetween(-context, -1)))
    return rows.withColumn("hist", F.collect_list("tokens").over(w.rowsBetween(-context - history, -context - 1)))


def flatten(windowed: DataFrame, n_cells: int, n_scales: int, anchors: DataFrame) -> DataFrame:
    """Parallel arrays of a sample: begin, context days each with a separator, the day itself, end; with its statistics."""
    rows = windowed.join(anchors, "user_id", "left")

    def special(code: int, duration: int = 0, arrival: int = 0) -> Column:
        values = (n_cells + code, n_scales + code, duration, arrival, 0)
        return F.struct(*[F.lit(v).alias(f) for f, v in zip(FIELDS, values, strict=True)], F.lit(True).alias("special"))

    mark = lambda d: F.transform(d, lambda t: t.withField("special", F.lit(False)))
    ctx = F.flatten(F.transform("context", lambda d: F.concat(mark(d), F.array(special(SEP)))))
    rows = rows.withColumn("ctx", F.concat(F.array(special(BOS)), ctx)).withColumn("all", F.concat("ctx", mark(F.col("tokens")), F.array(special(EOS, PAD_DURATION, PAD_ARRIVAL))))
    act = lambda t: F.when(t["special"], PAD_ACTIVITY).otherwise(activity(t["cell_id"], F.col("home_cell"), F.col("work_cell"), t["arrival"] * 5.0, duration_low(t["duration"])))
    arrays = [_field("all", f).alias(name) for f, name in zip(FIELDS, ("cells", "scales", "durations", "arrivals", "loc_types"), strict=True)]
    size = F.size("tokens")
    minutes = F.aggregate("tokens", F.lit(0.0), lambda a, t: a + duration_low(t["duration"]))
    pad = F.lit(n_cells + PAD)
    return rows.select(
        "user_id", "date", "day_type", *arrays, F.transform("all", act).alias("activities"), F.size("ctx").alias("ctx_len"),
        F.coalesce("home_cell", pad).alias("home_cell"), F.coalesce("work_cell", pad).alias("work_cell"), "hist",
        F.array(size.cast("double"), F.coalesce(minutes / F.nullif(size, F.lit(0)) / 1440, F.lit(0.0)), F.coalesce(F.array_max(F.transform("tokens", lambda t: t["scale"])), F.lit(0)).cast("double")).alias("daily_stats"),
    )


def history_arrays(rows: DataFrame, newest_first: bool = False) -> DataFrame:
    """``hist`` as one array of tokens with day boundaries: whole days, up to the one that reaches the limit.

    Days are taken from the oldest on, or from the newest if asked for. Without tokens a zero stands in.
    """
    days = F.reverse("hist") if newest_first else F.col("hist")
    state = F.named_struct(F.lit("open"), F.lit(True), F.lit("n"), F.lit(0), F.lit("days"), F.expr("CAST(array() AS array<int>)"))

    def step(acc: Column, d: Column) -> Column:
        n = acc["n"] + F.size(d)
        return F.when(acc["open"], F.named_struct(F.lit("open"), n < HISTORY_TOKENS, F.lit("n"), n, F.lit("days"), F.concat(acc["days"], F.array(F.size(d))))).otherwise(acc)

    rows = rows.withColumn("_k", F.aggregate(days, state, step)).withColumn("_h", F.flatten(F.slice(days, F.lit(1), F.size("_k.days"))))
    ends = F.transform("_k.days", lambda v, i: F.aggregate(F.slice("_k.days", F.lit(1), i + 1), F.lit(0), lambda a, x: a + x))
    bounds = F.filter(F.zip_with(F.transform(ends, lambda e, i: e - F.col("_k.days")[i]), ends, lambda a, b: F.array(a, b)), lambda p: p[1] > p[0])
    zero = F.array(F.lit(0))
    arrays = {f"hist_{n}": F.when(F.size("_h") > 0, _field("_h", f)).otherwise(zero) for f, n in zip(FIELDS, ("cells", "scales", "durations", "arrivals", "loc_types"), strict=True)}
    return rows.withColumns(arrays).withColumn("hist_day_boundaries", F.when(F.size(bounds) > 0, bounds).otherwise(F.array(F.array(F.lit(0), F.lit(0))))).withColumn("hist_day_counts", F.size(bounds)).drop("_k", "_h", "hist")


def with_people(rows: DataFrame, members: DataFrame, index: DataFrame) -> DataFrame:
    """Adds ``persona_id`` (0 for users without one) and ``user_idx`` to samples. Both tables have a row a user."""
    rows = rows.join(members.select("user_id", F.col("persona").alias("persona_id")), "user_id", "left").join(index, "user_id", "left")
    return rows.withColumn("persona_id", F.coalesce("persona_id", F.lit(0)))


def pad_history(rows: DataFrame, tokens: int, days: int = HISTORY_DAYS) -> DataFrame:
    """History arrays of ``history_arrays`` filled up with zeros to ``tokens`` tokens and ``days`` boundaries."""
    names = [f"hist_{n}" for n in ("cells", "scales", "durations", "arrivals", "loc_types")]
    missing = lambda c, n: F.greatest(F.lit(n) - F.size(c), F.lit(0))
    cols = {c: F.concat(c, F.array_repeat(F.lit(0), missing(c, tokens))) for c in names}
    none = F.array(F.lit(0), F.lit(0))
    return rows.withColumns(cols | {"hist_day_boundaries": F.concat("hist_day_boundaries", F.array_repeat(none, missing("hist_day_boundaries", days)))})


def pad_to(rows: DataFrame, length: int, n_cells: int, n_scales: int) -> DataFrame:
    """Sample arrays filled up to ``length``, with ``mask`` (1 for what is there)."""
    fill = {"cells": n_cells + PAD, "scales": n_scales + PAD, "durations": PAD_DURATION, "arrivals": PAD_ARRIVAL, "loc_types": 0, "activities": PAD_ACTIVITY}
    short = F.greatest(F.lit(length) - F.size("cells"), F.lit(0))
    out = rows.withColumn("mask", F.concat(F.array_repeat(F.lit(1), F.size("cells")), F.array_repeat(F.lit(0), short)))
    return out.withColumns({c: F.concat(c, F.array_repeat(F.lit(v), short)) for c, v in fill.items()})


def day_weights(rows: DataFrame) -> DataFrame:
    """``weights``: one over the day's tokens for positions that predict the day, else zero."""
    last = F.size("cells") - 2
    n = F.greatest(last - F.col("ctx_len") + 2, F.lit(1))
    return rows.withColumn("weights", F.transform("cells", lambda _, i: F.when((i >= F.col("ctx_len") - 1) & (i <= last), F.lit(1.0) / n).otherwise(0.0)))


def time_features(token_rows: DataFrame) -> DataFrame:
    """Budget left in the day, departure, gap since the departure before, arrival and duration as numbers."""
    w = Window.partitionBy("user_id", "date").orderBy("nth")
    start, low, mid = F.col("arrival") * 5.0, duration_low(F.col("duration")), duration_middle(F.col("duration"))
    leave = start + mid
    return token_rows.select(
        "user_id", "date", "nth", (F.greatest(F.lit(0.0), F.lit(1440.0) - (start + low)) / 1440).alias("budget"), leave.alias("departure"),
        F.coalesce(F.greatest(F.lit(0.0), start - F.lag(leave).over(w)), F.lit(0.0)).alias("gap"), (F.col("arrival") / 288.0).alias("arrival_share"),
        (F.log1p(mid) / F.log(F.lit(1441.0))).alias("duration_share"), F.log(F.when(F.col("duration") == 0, 3.0).otherwise(mid)).alias("log_middle"),
    )
