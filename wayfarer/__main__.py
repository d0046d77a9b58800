"""Jobs: ``python -m wayfarer <job> ...``; each reads tables or files, runs a workflow and writes Parquet."""

from __future__ import annotations

import argparse
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.reports import Ledger
from .operators.scales import Scales
from .plans import workflows
from .sources import readers


def main(args_given: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="wayfarer", description=__doc__)
    jobs = parser.add_subparsers(dest="job", required=True)
    for name, args in {"gps": ("root", "calendar", "out"), "tower": ("stays", "hints", "calendar", "out"), "prepare": ("stays", "out"), "compare": ("real", "sim", "out")}.items():
        job = jobs.add_parser(name)
        for a in args:
            job.add_argument(a)
        if name in ("gps", "tower"):
            job.add_argument("--relabel", choices=("grid", "cluster"), help="labels and anchors anew from how often places are visited")
            job.add_argument("--least-days", type=int, help="days that a user needs")
        elif name == "prepare":
            job.add_argument("--scales", help="a stored mixture to cut steps by, instead of fitting one")
        else:
            job.add_argument("--known", help="Parquet table of locations (lat, lng) that simulated points are moved to")
            job.add_argument("--boundaries", type=float, nargs="+", help="kilometres where one band of distances ends and the next begins")
            job.add_argument("--most-km", type=float, help="longest step in what is told of scales")
            job.add_argument("--r0", type=float, default=1.5, help="kilometres added to distances in power laws")
            job.add_argument("--sizes", type=int, nargs="+", default=[2, 3, 4, 5], help="numbers of scales to choose from")
            job.add_argument("--criterion", choices=("bic", "aic"), default="bic")
            job.add_argument("--no-scaling", action="store_true", help="divergences and moments alone")
    a = parser.parse_args(args_given)
    spark = SparkSession.builder.appName(f"wayfarer-{a.job}").config("spark.sql.adaptive.enabled", "true").getOrCreate()
    try:
        run(spark, a)
    finally:
        readers.forget_stored(spark)


def points_of(spark: SparkSession, path: str, side: str) -> DataFrame:
    """One side's points: a Parquet table of them, or daily records as JSON lines."""
    if not path.endswith((".json", ".jsonl")):
        return spark.read.parquet(path)
    days = readers.read_daily(spark, path)
    return readers.normalise_points(days.select(F.concat_ws("|", "user_id", "date").alias("traj_id"), F.col("stays").alias("points")), None, side)


def run(spark: SparkSession, a: argparse.Namespace) -> None:
    if a.job == "compare":
        known = spark.read.parquet(a.known) if a.known else None
        settings = {"scaling": not a.no_scaling, "most_km": a.most_km, "r0": a.r0, "sizes": tuple(a.sizes), "criterion": a.criterion}
        readers.write_table(workflows.compare(points_of(spark, a.real, "real"), points_of(spark, a.sim, "sim"), known, a.boundaries, **settings), f"{a.out}/metrics")
        return
    if a.job == "prepare":
        got = workflows.prepare_training(spark.read.parquet(a.stays), fitted=Scales.of(spark.read.parquet(a.scales)) if a.scales else None)
        for name in ("meta", "vocab", "places", "personas", "persona_places", "samples"):
            readers.write_table(getattr(got, name), f"{a.out}/{name}")
        readers.write_table(got.scales.table(spark), f"{a.out}/scales")
        return
    calendar = spark.read.parquet(a.calendar)
    config = replace(workflows.GPS if a.job == "gps" else workflows.TOWER, relabel=a.relabel)
    config = config if a.least_days is None else replace(config, least_days=a.least_days)
    if a.job == "gps":
        stays, anchors, report = workflows.preprocess_gps_reported(readers.read_gps(spark, a.root), calendar, config, readers.gps_users(spark, a.root))
    else:
        ledger = Ledger()
        raw = readers.parse_tower(spark.read.text(a.stays), ledger)
        stays, anchors, report = workflows.preprocess_tower_reported(raw, readers.parse_hints(spark.read.text(a.hints)), calendar, config, ledger)
    readers.write_table(stays, f"{a.out}/stays", "split")
    readers.write_table(anchors, f"{a.out}/anchors")
    readers.write_table(report, f"{a.out}/report")


if __name__ == "__main__":
    main()
