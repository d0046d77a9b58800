import datetime as dt
import uuid

from wayfarer.streaming import daily


def run(spark, tmp_path, build, schema, batches):
    """Feeds batches as files, one after another, and returns the rows given out."""
    src = tmp_path / uuid.uuid4().hex
    src.mkdir()
    name = "t" + uuid.uuid4().hex
    q = build(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(src))).writeStream.format("memory").queryName(name).outputMode("append").start()
    try:
        for rows in batches:
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(src))
            q.processAllAvailable()
        return spark.table(name).collect()
    finally:
        q.stop()


def test_daily_totals_close_days_and_drop_late_rows(spark, tmp_path):
    at = lambda d, h: dt.datetime(2024, 1, d, h)
    out = run(spark, tmp_path, lambda s: daily.daily_totals(s), "user_id string, at timestamp, minutes double", [[("a", at(1, 8), 30.0), ("a", at(1, 9), 15.0)], [("a", at(5, 8), 10.0)], [("a", at(1, 10), 99.0)]])
    assert [(r["day"], r["stays"], r["minutes"]) for r in out] == [(dt.date(2024, 1, 1), 2, 45.0)]


def test_fragments_merge_across_batches(spark, tmp_path):
    t = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    row = lambda m, x: ("a", t(m), x, 39.0, 1704067200 + m * 60, 1704067200 + m * 60 + 300)
    out = run(spark, tmp_path, lambda s: daily.merged_fragments(s), "user_id string, at timestamp, lng double, lat double, t_in long, t_out long", [[row(0, 116.0)], [row(10, 116.0)], [row(20, 117.0)]])
    assert [(r["lng"], r["merged"], r["t_out"] - r["t_in"]) for r in out] == [(116.0, 1, 900)]
