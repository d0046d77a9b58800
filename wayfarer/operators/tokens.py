"""Days as tokens and back, personas, priors."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import arrival_bin, duration_bin, duration_middle, haversine
from ..functions.hashing import DRAWS, draw
from ..sources.readers import stored
from .scales import Scales, day_steps, step_distances
from .vocab import with_cell_id

#: Day types by index, activities, kinds of place.
DAY_TYPES = ("workday", "weekend", "holiday")
HOME, WORK, TRANSIT, OTHER = 0, 1, 2, 3
LOC_OTHER, LOC_HOME, LOC_WORK = 0, 1, 2
#: Whole units of a share in sums, and users among whom the starts of personas are chosen.
UNITS, POOL = 2.0**40, 2000


def day_type_index(c: Column | str) -> Column:
    """Unknown types count as the first."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c == DAY_TYPES[1], 1).when(c == DAY_TYPES[2], 2).otherwise(0)


def activity(cell: Column, home: Column, work: Column, arrival: Column, minutes: Column) -> Column:
    """What a stay is for, from its place, time of arrival and length; the first rule that holds counts."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    return (
        F.when(yes(cell == home), HOME).when(yes(cell == work), WORK).when(minutes <= 30, TRANSIT)
        .when(arrival.between(360, 1320) & (minutes >= 180), WORK)
        .when(((arrival <= 360) | (arrival >= 1260)) & (minutes >= 240), HOME).otherwise(OTHER)
    )


def tokens(stays: DataFrame, vocab: DataFrame, meta: DataFrame, scales: Scales, anchors: DataFrame) -> DataFrame:
    """One row per kept stay: ``(user_id, date, day_type, nth, cell_id, scale, duration, arrival, loc_type)``.

    Stays outside the vocabulary go first; a scale is that of the step from the kept stay before.
    """
    rows = with_cell_id(stays, vocab, meta).where("cell_id >= 0").join(anchors, "user_id", "left")
    w = Window.partitionBy("user_id", "date").orderBy("start_min", "seq")
    rows = rows.withColumn("km", haversine(F.lag("lat").over(w), F.lag("lng").over(w), "lat", "lng")).withColumn("nth", F.row_number().over(w))
    at = lambda c: F.coalesce(F.col("cell_id") == F.col(c), F.lit(False))
    return rows.select(
        "user_id", "date", day_type_index("day_type").alias("day_type"), "nth", "cell_id", F.coalesce(scales.assign(F.col("km")), F.lit(0)).alias("scale"),
        duration_bin(F.greatest(F.col("end_min") - F.col("start_min"), F.lit(0.0))).alias("duration"), arrival_bin("start_min").alias("arrival"),
        F.when(at("home_cell"), LOC_HOME).when(at("work_cell"), LOC_WORK).otherwise(LOC_OTHER).alias("loc_type"),
    )


def day_sequences(token_rows: DataFrame) -> DataFrame:
    """``(user_id, date, day_type, tokens)`` with a day's tokens as one array."""
    token = F.struct("nth", "cell_id", "scale", "duration", "arrival", "loc_type")
    days = token_rows.groupBy("user_id", "date").agg(F.first("day_type").alias("day_type"), F.array_sort(F.collect_list(token)).alias("t"))
    return days.select("user_id", "date", "day_type", F.transform("t", lambda t: t.dropFields("nth")).alias("tokens"))


def user_index(rows: DataFrame) -> DataFrame:
    """``(user_id, user_idx)`` in the order of ids: places within ranges of ids, after the sizes of the ranges before."""
    users = rows.select("user_id").distinct()
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = stored(users.repartitionByRange(parts, "user_id").withColumn("part", F.spark_partition_id()))
    sizes = ranged.groupBy("part").agg(F.count("*").alias("n"))
    before = sizes.withColumn("before", F.sum("n").over(Window.orderBy("part")) - F.col("n")).select("part", "before")  # a row a range
    place = F.row_number().over(Window.partitionBy("part").orderBy("user_id")) - 1
    return ranged.withColumn("place", place).join(F.broadcast(before), "part").select("user_id", (F.col("before") + F.col("place")).cast("int").alias("user_idx"))


def decode_days(days: DataFrame, vocab: DataFrame, anchors: DataFrame) -> DataFrame:
    """Stays of token days: ``(user_id, date, nth, start_min, end_min, lng, lat, intent_class)``.

    A stay starts at the middle of its slot, or when the one before ends; it lasts as its bin's middle.
    """
    state = F.named_struct(F.lit("now"), F.lit(0.0), F.lit("out"), F.expr("CAST(array() AS array<struct<start_min: double, end_min: double, cell_id: int>>)"))

    def step(acc: Column, t: Column) -> Column:
        start = F.greatest(t["arrival"] * 5.0 + 2.5, acc["now"])
        end = F.least(start + F.greatest(duration_middle(t["duration"]), F.lit(5.0)), F.lit(1440.0))
        one = F.struct(start.alias("start_min"), end.alias("end_min"), t["cell_id"].alias("cell_id"))
        return F.named_struct(F.lit("now"), end, F.lit("out"), F.concat(acc["out"], F.array(one)))

    rows = days.select("user_id", "date", F.posexplode(F.aggregate("tokens", state, step)["out"]).alias("nth", "s")).select("user_id", "date", "nth", "s.*")
    last = vocab.agg((F.max("cell_id")).alias("last"))
    rows = rows.join(F.broadcast(last)).withColumn("cell_id", F.least("cell_id", "last")).drop("last")
    rows = rows.join(vocab.select("cell_id", "lng", "lat"), "cell_id").join(anchors, "user_id", "left")
    at = lambda c: F.coalesce(F.col("cell_id") == F.col(c), F.lit(False))
    return rows.select("user_id", "date", "nth", F.bround("start_min", 1).alias("start_min"), F.bround("end_min", 1).alias("end_min"), F.bround("lng", 6).alias("lng"), F.bround("lat", 6).alias("lat"), F.when(at("home_cell"), "home").when(at("work_cell"), "work").otherwise("other").alias("intent_class"))


# -- corpus statistics ---------------------------------------------------------------------------


def top_cells(token_rows: DataFrame, k: int = 5) -> DataFrame:
    total = token_rows.agg(F.count("*").alias("total"))
    return token_rows.groupBy("cell_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "cell_id").limit(k).join(F.broadcast(total)).select("cell_id", "n", (F.col("n") * 100.0 / F.col("total")).alias("percent"))


def scale_shares(token_rows: DataFrame) -> DataFrame:
    total = token_rows.agg(F.count("*").alias("total"))
    return token_rows.groupBy("scale").agg(F.count("*").alias("n")).join(F.broadcast(total)).select("scale", "n", (F.col("n") / F.col("total")).alias("share"))


# -- personas ------------------------------------------------------------------------------------


def scale_vectors(stays: DataFrame, scales: Scales) -> DataFrame:
    """``(user_id, s0, s1, …)``: shares of a user's steps by scale; users without steps go."""
    rows = day_steps(stays).withColumn("scale", scales.assign(F.col("km")))
    return rows.groupBy("user_id").agg(*[(F.count_if(F.col("scale") == i) / F.count("*")).alias(f"s{i}") for i in range(len(scales.mu))])


def personas(vectors: DataFrame, k: int = 4, seed: int = 42, starts: int = 10, rounds: int = 100, given: list[list[float]] | None = None) -> DataFrame:
    """``(user_id, persona)`` by k-means on the shares; the best of several ``starts``, or of the one that is ``given``.

    Starts are spread over POOL users by their draws. All of them take a round in one aggregate, over sums of whole units, so
    partitions don't matter. Equal distances go to the first centre, an empty cluster keeps its centre, and personas are
    numbered by the order of their centres. A given start takes all its ``rounds``, but for those that would change nothing.
    """
    cols = [c for c in vectors.columns if c != "user_id"]
    rows = stored(vectors.select("user_id", *[F.col(c).cast("double").alias(c) for c in cols]))
    centres = _starts(rows, cols, k, seed, starts) if given is None else [given]
    if not centres:
        return rows.select("user_id", F.lit(0).alias("persona"))
    found: list[tuple[int, list[list[float]]]] = []
    before = [-1] * len(centres)
    for _ in range(rounds):
        each = rows.select(*cols, F.posexplode(F.array(*[_nearest(cols, c) for c in centres])).alias("start", "to"))
        units = lambda c: F.sum(F.rint(c * UNITS).cast("decimal(20,0)"))
        sums = each.groupBy("start", "to.at").agg(F.count("*").alias("n"), units(F.col("to.d")).alias("cost"), *[units(F.col(c)).alias(c) for c in cols]).collect()
        costs = [sum(int(r["cost"]) for r in sums if r["start"] == i) for i in range(len(centres))]
        moved = [[list(m) for m in c] for c in centres]
        for r in sums:
            moved[r["start"]][r["at"]] = [float(r[c]) / r["n"] / UNITS for c in cols]
        settled = [moved[i] == centres[i] or (given is None and costs[i] == before[i]) for i in range(len(centres))]
        found += [(costs[i], moved[i]) for i in range(len(centres)) if settled[i]]
        centres, before = [m for m, done in zip(moved, settled, strict=True) if not done], [c for c, done in zip(costs, settled, strict=True) if not done]
        if not centres:
            break
    best = sorted(min(found + list(zip(before, centres, strict=True)))[1])
    return rows.select("user_id", _nearest(cols, best)["at"].cast("int").alias("persona"))


def _nearest(cols: list[str], centres: list[list[float]]) -> Column:
    """Distance to the nearest centre, squared, and its number."""

    def apart(m: list[float]) -> Column:
        parts = [(F.col(c) - F.lit(x)) * (F.col(c) - F.lit(x)) for c, x in zip(cols, m, strict=True)]
        out = parts[0]
        for p in parts[1:]:
            out = out + p
        return out

    return F.array_min(F.array(*[F.struct(apart(m).alias("d"), F.lit(i).alias("at")) for i, m in enumerate(centres)]))


def _starts(rows: DataFrame, cols: list[str], k: int, seed: int, n: int) -> list[list[list[float]]]:
    """``n`` lists of up to k different centres among the POOL users with the lowest draws: each far from those before it, by
    squared distance and a fixed sequence of numbers."""
    pool = rows.select(draw("user_id", seed=seed).alias("draw"), "user_id", *cols).orderBy("draw", "user_id").limit(POOL).collect()
    x = np.array([[r[c] for c in cols] for r in pool], float).reshape(len(pool), len(cols))
    out = []
    for i in range(n if len(x) else 0):
        rng = np.random.default_rng([seed, i])
        chosen = [x[int(rng.integers(len(x)))]]
        while len(chosen) < k:
            d = ((x[:, None] - np.array(chosen)[None]) ** 2).sum(axis=2).min(axis=1)
            if d.sum() <= 0:
                break
            chosen.append(x[int(np.searchsorted(np.cumsum(d), rng.random() * d.sum(), "right"))])
        out.append([c.tolist() for c in chosen])
    return out


def persona_places(members: DataFrame, anchors: DataFrame) -> DataFrame:
    """``(persona, kind, cell_id, prob)``: how likely a persona's home or work is in a cell."""
    rows = members.join(anchors, "user_id").select("persona", F.explode(F.create_map(F.lit("home"), "home_cell", F.lit("work"), "work_cell")).alias("kind", "cell_id")).where("cell_id IS NOT NULL")
    n = rows.groupBy("persona", "kind", "cell_id").agg(F.count("*").alias("n"))
    return n.select("persona", "kind", "cell_id", (F.col("n") / F.sum("n").over(Window.partitionBy("persona", "kind"))).alias("prob"))


# -- priors --------------------------------------------------------------------------------------


def stays_per_day_prior(stays: DataFrame) -> DataFrame:
    """``(day_type, n, prob)`` for every n from 0 to the type's largest; a type without days has n = 1 surely."""
    known = F.when(F.col("day_type").isin(*DAY_TYPES), F.col("day_type")).otherwise(DAY_TYPES[0])
    days = stays.withColumn("day_type", known).groupBy("user_id", "date", "day_type").agg(F.count("*").alias("n"))
    counts = days.groupBy("day_type", "n").agg(F.count("*").alias("c"))
    types = stays.sparkSession.createDataFrame([(t,) for t in DAY_TYPES], "day_type string")
    ends = types.join(counts.groupBy("day_type").agg(F.max("n").alias("top"), F.sum("c").alias("total")), "day_type", "left")
    grid = ends.select("day_type", "total", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("top", F.lit(1).cast("long")))).alias("n"))
    rows = grid.join(counts, ["day_type", "n"], "left")
    return rows.select("day_type", "n", F.when(F.col("total").isNull(), F.col("n").cast("double")).otherwise(F.coalesce("c", F.lit(0)) / F.col("total")).alias("prob"))


def draw_stay_counts(days: DataFrame, prior: DataFrame, seed: int = 42) -> DataFrame:
    """Adds ``n``, at least 2, to ``days(user_id, date, day_type)``: the inverse of the prior at the day's draw."""
    w = Window.partitionBy("day_type").orderBy("n")
    upto = prior.withColumn("upto", F.sum("prob").over(w)).groupBy("day_type").agg(F.array_sort(F.collect_list(F.struct("upto", "n"))).alias("steps"))
    rows = days.withColumn("_u", draw("user_id", "date", seed=seed) / DRAWS).join(F.broadcast(upto), "day_type", "left")
    hit = F.filter("steps", lambda s: F.col("_u") <= s["upto"])
    return rows.withColumn("n", F.greatest(F.coalesce(F.get(hit, F.lit(0))["n"], F.element_at("steps", -1)["n"], F.lit(2)), F.lit(2))).drop("_u", "steps")


def scale_counts(stays: DataFrame, scales: Scales) -> DataFrame:
    return day_steps(stays).groupBy(scales.assign(F.col("km")).alias("scale")).agg(F.count("*").alias("n"))


def cell_log_frequency(vocab: DataFrame) -> DataFrame:
    total = vocab.agg(F.sum("cnt").alias("total"))
    return vocab.join(F.broadcast(total)).select("cell_id", F.log(F.greatest(F.col("cnt") / F.col("total"), F.lit(1e-8))).alias("log_freq"))


def day_type_pool(stays: DataFrame, holidays: bool = True) -> DataFrame:
    days = stays.select("user_id", "date", "day_type").distinct()
    return (days if holidays else days.where("day_type != 'holiday'")).groupBy("day_type").agg(F.count("*").alias("n"))


def dates_of_users(stays: DataFrame) -> DataFrame:
    """``(user_id, dates)``: a user's days, sorted."""
    return stays.groupBy("user_id").agg(F.array_sort(F.collect_set("date")).alias("dates"))
