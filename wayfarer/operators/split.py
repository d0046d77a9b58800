"""Training and test days, training and validation samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import DRAWS, draw


def split_days(stays: DataFrame, share: float = 0.8) -> DataFrame:
    """Adds ``split``: the first days of each user train, at least one."""
    days = stays.select("user_id", "date").distinct()
    w = Window.partitionBy("user_id")
    days = days.withColumn("_r", F.row_number().over(w.orderBy("date"))).withColumn("_n", F.count("*").over(w))
    days = days.withColumn("split", F.when(F.col("_r") <= F.greatest(F.lit(1), F.floor(F.col("_n") * share)), "train").otherwise("test"))
    return stays.join(days.select("user_id", "date", "split"), ["user_id", "date"])


def aligned_anchors(split: DataFrame, anchors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stays of users that have anchors, and the anchors of training users."""
    known = split.join(anchors.select("user_id"), "user_id", "left_semi")
    users = known.where("split = 'train'").select("user_id").distinct()
    return known, anchors.join(users, "user_id", "left_semi")


def misaligned(split: DataFrame, anchors: DataFrame) -> DataFrame:
    """``(user_id, missing)``: training users without anchors and anchors without training days; none if all is well."""
    a = split.where("split = 'train'").select("user_id").distinct()
    b = anchors.select("user_id").distinct()
    return a.subtract(b).withColumn("missing", F.lit("anchor")).unionByName(b.subtract(a).withColumn("missing", F.lit("train")))


def split_statistics(split: DataFrame) -> DataFrame:
    """``(split, users, days, stays)``."""
    return split.groupBy("split").agg(F.countDistinct("user_id").alias("users"), F.countDistinct("user_id", "date").alias("days"), F.count("*").alias("stays"))


def validation_split(samples: DataFrame, keys: list[str], share: float = 0.1, seed: int = 42) -> DataFrame:
    """Adds ``fold``: samples whose draw lies in the first ``share`` of all draws validate."""
    return samples.withColumn("fold", F.when(draw(*keys, seed=seed) < int(share * DRAWS), "validation").otherwise("train"))
