"""The three workflows: raw data to split days, days to samples, two sides to metrics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import anchors as an
from ..operators import evaluation as ev
from ..operators import filters as fl
from ..operators import relabel as rl
from ..operators import reports as rp
from ..operators import samples as sa
from ..operators import scales as sc
from ..operators import split as sp
from ..operators import stays as st
from ..operators import tokens as tk
from ..operators import vocab as vo
from ..sources.readers import stored


@dataclass(frozen=True)
class DatasetConfig:
    """Thresholds of a data set. ``sample`` users are kept, all if None; ``most_stays`` a day, any number if None.

    ``relabel`` is None, ``grid`` or ``cluster``: labels and anchors from how often places are visited.
    """

    name: str
    least_days: int
    least_stays: int = 2
    most_stays: int | None = None
    sample: int | None = None
    seed: int = 42
    train_share: float = 0.8
    relabel: str | None = None
    anchor_degrees: float = 0.005
    grid_degrees: float = 0.001
    cluster_metres: float = 300.0


#: Settings of the two data sets.
GPS = DatasetConfig("gps", least_days=3, most_stays=20)
TOWER = DatasetConfig("tower", least_days=5, sample=500)


def preprocess_gps(points: DataFrame, calendar: DataFrame, config: DatasetConfig = GPS) -> tuple[DataFrame, DataFrame]:
    """Labelled long stays with their split, and anchors, of ``points(user_id, ts, lng, lat)``.

    The points are shuffled once, by user; everything behind reads far fewer stays.
    """
    return preprocess_gps_reported(points, calendar, config)[:2]


def preprocess_gps_reported(points: DataFrame, calendar: DataFrame, config: DatasetConfig = GPS, users: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``preprocess_gps`` and its report ``(item, value)``: users in, lost by reason and kept, and what is kept of days and stays.

    ``users(user_id)`` are all that the data set names, those with points if None. The report reads the steps that the run
    has stored, which hold stays, and no point again.
    """
    raw, seen = st.detect_stays_of_users(points)
    raw = stored(raw)
    anchors = stored(an.detect_home_work(raw))
    stays = st.with_local_time(raw, with_seconds=True).withColumns({c: F.bround(c, 6) for c in ("lng", "lat")})
    inside = fl.home_in_box(stays, anchors)
    days = stored(fl.full_days(fl.near_home(inside, anchors), config.least_stays))
    observed = fl.observed_users(days, config.least_days)
    stays = observed if config.most_stays is None else fl.few_stays_a_day(observed, config.most_stays)
    homes = fl.home_in_box(anchors, anchors)
    rounded = anchors.withColumns({c: F.bround(c, 6) for c in ("t1_lng", "t1_lat", "t2_lng", "t2_lat")})
    labelled = stored(st.with_day_type(an.intent_by_distance(stays, anchors), calendar))
    split, moved = _finish(labelled, rounded, config)
    steps = {"no_points": seen, "no_stays": raw, "no_home": anchors, "outside_box": homes, "few_days": observed}
    if config.most_stays is not None:
        steps["many_stays"] = labelled
    return split, moved, rp.fates(seen if users is None else users, steps).unionByName(rp.kept_summary(labelled))


def preprocess_tower(raw: DataFrame, hints: DataFrame, calendar: DataFrame, config: DatasetConfig = TOWER) -> tuple[DataFrame, DataFrame]:
    """The same of ``raw(user_id, seq, lng, lat, t_in, t_out)`` with home and work hints."""
    return _tower(raw, hints, calendar, config)[:2]


def preprocess_tower_reported(raw: DataFrame, hints: DataFrame, calendar: DataFrame, config: DatasetConfig = TOWER, ledger: rp.Ledger | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``preprocess_tower`` and its report ``(item, value)``: what a ``ledger`` counted while ``raw`` was read, users and days
    lost by reason, and what is kept."""
    ledger = ledger or rp.Ledger()
    split, anchors, steps, report = _tower(raw, ledger.watch(hints, n_hw_entries=F.count(F.lit(1))), calendar, config, ledger)
    return split, anchors, ledger.table(split.sparkSession).unionByName(report())


def _tower(raw: DataFrame, hints: DataFrame, calendar: DataFrame, config: DatasetConfig, ledger: rp.Ledger | None = None) -> tuple:
    timed = st.with_local_time(raw)
    if ledger is not None:
        timed = ledger.watch(timed, n_past_midnight=F.count_if(F.col("end_raw") > 1440))
    stays = loaded = stored(st.merge_fragments(timed))
    anchors = stored(an.anchors_from_hints(stays, stored(hints) if ledger is not None else hints, config.anchor_degrees))
    homed, _ = fl.with_anchor(stays, anchors)
    observed = fl.observed_users(homed, config.least_days)
    plausible = stored(fl.plausible_steps(observed))
    long = fl.long_days(plausible)
    stays = stored(fl.observed_users(long, config.least_days))
    if config.most_stays is not None:
        stays = fl.few_stays_a_day(stays, config.most_stays)
    few = stays
    if config.sample is not None:
        stays = fl.sample_users(stays, config.sample, config.seed)
    labelled = stored(st.with_day_type(an.intent_by_cell(stays, anchors, config.anchor_degrees), calendar))
    split, moved = _finish(labelled, anchors, config)

    def report() -> DataFrame:
        lost = rp.fates(loaded, {"no_home": homed, "few_days": observed, "median_step": plausible, "few_long_days": few, "not_sampled": labelled})
        days = lambda df: df.select("user_id", "date").distinct()
        counts = days(plausible).join(days(long).withColumn("long", F.lit(True)), ["user_id", "date"], "left").agg(F.count("*").alias("n_user_days_in"), F.count_if(F.col("long").isNull()).alias("n_user_days_dropped.span"))
        return lost.unionByName(rp.items(counts)).unionByName(rp.kept_summary(labelled))

    return split, moved, labelled, report


def _finish(stays: DataFrame, anchors: DataFrame, config: DatasetConfig) -> tuple[DataFrame, DataFrame]:
    """Split by days of stored stays, anchors of training users; if asked for, labels and anchors anew from the ranks of training days."""
    split, anchors = sp.aligned_anchors(sp.split_days(stays, config.train_share), anchors)
    split = stored(split)
    if config.relabel is None:
        return split, anchors
    train = split.where("split = 'train'")
    if config.relabel == "grid":
        ranks = stored(rl.rank_cells(train, config.grid_degrees))
        split = rl.relabel_by_cell(split, ranks, config.grid_degrees)
    elif config.relabel == "cluster":
        ranks = stored(rl.rank_clusters(train, config.cluster_metres))
        split = rl.relabel_by_distance(split, ranks, config.cluster_metres)
    else:
        raise ValueError(f"unknown relabelling {config.relabel!r}")
    return split, rl.anchors_from_ranks(ranks)


@dataclass
class Prepared:
    meta: DataFrame
    vocab: DataFrame
    scales: sc.Scales
    places: DataFrame
    personas: DataFrame
    persona_places: DataFrame
    samples: DataFrame


def prepare_training(stays: DataFrame, min_count: int = 1, scales: int = 4, max_sigma: float = 0.7, fitted: sc.Scales | None = None) -> Prepared:
    """Vocabulary, scales, personas and samples of training stays with day types; ``fitted`` are scales of an earlier job."""
    stays = stored(stays)
    meta = stored(vo.grid_meta(stays))
    vocab = stored(vo.build_vocab(stays, meta, min_count))
    fitted = fitted or sc.fit_capped_scales(sc.weighted_logs(sc.day_steps(stays, 0.01)), scales, max_sigma)
    scales = len(fitted.mu)
    places = stored(an.frequent_cells(vo.with_cell_id(stays, vocab, meta)))
    rows = stored(tk.tokens(stays, vocab, meta, fitted, places))
    members = stored(tk.personas(tk.scale_vectors(stays, fitted)))
    samples = sa.history_arrays(sa.flatten(sa.windows(tk.day_sequences(rows)), vocab.count(), scales, places))
    samples = sa.with_people(samples, members, tk.user_index(rows))
    return Prepared(meta, vocab, fitted, places, members, tk.persona_places(members, places), samples)


def compare(real: DataFrame, sim: DataFrame, known: DataFrame | None = None, boundaries: list[float] | None = None, **settings) -> DataFrame:
    """``(metric, value)`` of points of both sides; further settings are those of ``evaluate``."""
    return ev.evaluate(real.unionByName(sim), known, sc.bands_from(boundaries) if boundaries else sc.BANDS, **settings)
