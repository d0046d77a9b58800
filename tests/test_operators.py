"""Helpers against naive forms, invariants and edge tables."""

import dataclasses
import datetime as dt
import math
import pathlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayfarer.functions import geo
from wayfarer.operators import evaluation, filters, metrics, powerlaw, relabel, samples, scales, split, stays, tokens, vocab
from wayfarer.plans import workflows
from wayfarer.sources import readers

DAY = dt.date(2024, 1, 2)
STAY = "user_id string, date date, seq int, start_min double, end_min double, lng double, lat double"


def naive_stays(lng, lat, ts, metres, minutes):
    out, i = [], 0
    while i < len(ts):
        j = i + 1
        while j < len(ts) and stays._metres(lat[i], lng[i], lat[j], lng[j]) <= metres:
            j += 1
        if ts[j - 1] - ts[i] >= minutes * 60:
            out.append((np.mean(lng[i:j]), np.mean(lat[i:j]), ts[i], ts[j - 1]))
            i = j
        else:
            i += 1
    return out


def test_stay_scan_is_the_naive_one():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 50, 400):
        walk = np.cumsum(rng.normal(0, 4e-4, (n, 2)) * (rng.random((n, 1)) < 0.3), axis=0)
        lng, lat, ts = 116 + walk[:, 0], 39 + walk[:, 1], np.cumsum(rng.integers(10, 200, n)).astype(float)
        got = stays.scan_stays(lng, lat, ts, 200, 10)
        assert np.allclose(got, naive_stays(lng, lat, ts, 200, 10)) if got else not naive_stays(lng, lat, ts, 200, 10)


def test_merge_follows_the_weighted_centre():
    out = stays.merge_near([(116.0, 39.0, 0, 600), (116.001, 39.0, 700, 1300), (117.0, 39.0, 1400, 2000)], 200)
    assert len(out) == 2 and out[0][0] == pytest.approx(116.0005) and out[0][3] == 1300


def test_clusters_are_components():
    rng = np.random.default_rng(2)
    lng, lat = 116 + rng.random(120) * 0.05, 39 + rng.random(120) * 0.05
    got = relabel.eps_components(lng, lat, 400)
    label = np.arange(120)
    near = stays._metres(lat[:, None], lng[:, None], lat[None], lng[None]) <= 400
    for _ in range(120):
        label = np.array([label[near[i]].min() for i in range(120)])
    assert len(set(got)) == len(set(label)) and all((got == got[i]).tolist() == (label == label[i]).tolist() for i in range(120))
    assert len(relabel.eps_components(np.zeros(0), np.zeros(0), 300)) == 0


def test_fragments_and_days(spark):
    rows = [("a", DAY, 0, 0.0, 50.0, 1.0, 1.0), ("a", DAY, 1, 60.0, 70.0, 1.0, 1.0), ("a", DAY, 2, 80.0, 1440.0, 2.0, 1.0), ("b", DAY, 0, 0.0, 5.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, STAY)
    out = {(r["user_id"], r["seq"]): r for r in stays.merge_fragments(df).collect()}
    assert out["a", 0]["end_min"] == 70 and out["a", 0]["merged"] == 1 and len(out) == 3
    assert stays.merge_fragments(df, 5).count() == 4
    assert {r["user_id"] for r in filters.full_days(df).collect()} == {"a"}
    assert filters.full_days(df.limit(0)).count() == 0


def test_unknown_date_stops(spark):
    df = spark.createDataFrame([("a", DAY, 0, 0.0, 5.0, 1.0, 1.0)], STAY)
    calendar = spark.createDataFrame([(dt.date(2020, 1, 1), "holiday")], "date date, day_type string")
    with pytest.raises(Exception, match="no day type for 2024-01-02"):
        stays.with_day_type(df, calendar).collect()


def test_parsers_drop_what_is_broken(spark):
    text = "\n".join(["h"] * 6 + ["39.9,116.3,0,0,0,2024-01-01,08:00:00", "0,116.3,0,0,0,2024-01-01,08:00:00", "x,116.3,0,0,0,2024-01-01,08:00:00", "39.9,116.3,0,0,0,2024-01-01,99:00:00", "39.9,116.3"])
    got = readers.parse_gps(spark.createDataFrame([("/d/u7/Trajectory/1.plt", text)], "path string, value string")).collect()
    assert [(r["user_id"], r["lat"], r["ts"]) for r in got] == [("u7", 39.9, 1704067200.0)]
    lines = [("u\t[(1.5, 2.5, 10, 20), (0, 0, 1, 2), (1.0, 2.0, 9, 9)]",), ("",), ("v\tnonsense",)]
    assert [(r["user_id"], r["lng"]) for r in readers.parse_tower(spark.createDataFrame(lines, "value string")).collect()] == [("u", 1.5)]
    hints = [("{'user_id': 'u', 'home': [116.0, 39.0], 'work': None}",), ("{'user_id': 'v', 'home': [0, 39.0], 'work': [1.0]}",)]
    got = {r["user_id"]: (r["home"], r["work"]) for r in readers.parse_hints(spark.createDataFrame(hints, "value string")).collect()}
    assert got["u"][0]["lng"] == 116.0 and got["u"][1] is None and got["v"] == (None, None)


def test_gps_reader_reads_files(spark, tmp_path):
    folder = tmp_path / "007" / "Trajectory"
    folder.mkdir(parents=True)
    (folder / "a.plt").write_text("\n".join(["h"] * 6 + ["39.9,116.3,0,0,0,2024-01-01,08:00:00"]))
    assert [(r["user_id"], r["lng"]) for r in readers.read_gps(spark, str(tmp_path)).collect()] == [("007", 116.3)]


def test_vocabulary_edges(spark):
    df = spark.createDataFrame([("a", DAY, i, 0.0, 1.0, x, y) for i, (x, y) in enumerate([(116.0, 39.0), (116.01, 39.01), (116.0, 39.0)])], STAY)
    meta = vocab.grid_meta(df)
    v = vocab.build_vocab(df, meta)
    assert [(r["cell_id"], r["cnt"]) for r in v.orderBy("cell_id").collect()] == [(0, 2), (1, 1)]
    far = spark.createDataFrame([("a", DAY, 0, 0.0, 1.0, 120.0, 39.0), ("a", DAY, 1, 0.0, 1.0, 116.006, 39.0)], STAY)
    assert [r["cell_id"] for r in vocab.with_cell_id(far, v, meta).orderBy("seq").collect()] == [-1, -1]
    with pytest.raises(ValueError):
        readers.load_vocab(v.drop("city_cell"), meta)


def test_scales_recover_a_mixture(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(-1, 0.3, 3000), rng.normal(2, 0.4, 7000)])
    km = spark.createDataFrame([(float(v),) for v in np.exp(x)], "km double")
    fit = scales.fit_scales(scales.weighted_logs(km), 2)
    assert fit.mu == pytest.approx((-1, 2), abs=0.05) and fit.weight == pytest.approx((0.3, 0.7), abs=0.02)
    rows = scales.fit_scales(scales._Rows(scales.weighted_logs(km)), 2, rounds=3)
    same = scales.fit_scales(scales.weighted_logs(km), 2, rounds=3)
    assert rows.mu == pytest.approx(same.mu, abs=1e-3)
    cut = math.log(fit.boundaries()[0])
    dens = [w * math.exp(-((cut - m) ** 2) / 2 / v) / math.sqrt(v) for m, v, w in zip(fit.mu, fit.var, fit.weight, strict=True)]
    assert dens[0] == pytest.approx(dens[1], rel=1e-6)
    assert max(scales.fit_capped_scales(scales.weighted_logs(km), 2, 0.2).var) <= 0.04 + 1e-12
    best, scores = scales.choose_scales(scales.weighted_logs(km), (1, 2))
    assert len(best.mu) == 2 and len(scores) == 2


def test_divergence_limits(spark):
    same = [("m", s, float(v)) for s in ("real", "sim") for v in range(1, 50)]
    apart = [("n", "real", 1.0), ("n", "sim", 100.0), ("z", "real", 0.0), ("z", "sim", 0.0), ("o", "real", 1.0)]
    from pyspark.sql import functions as F

    got = {r["metric"]: r["jsd"] for r in metrics.divergences(spark.createDataFrame(same + apart, "metric string, side string, value double"), F.lit(False), ["metric"]).collect()}
    assert got["m"] == pytest.approx(0, abs=1e-9) and got["n"] == pytest.approx(math.log(2), abs=1e-6) and got["z"] == 0 and math.isnan(got["o"])


def test_snapping_is_brute_force(spark):
    rng = np.random.default_rng(4)
    pts, known = rng.random((80, 2)) * 0.3, rng.random((25, 2)) * 0.3
    got = metrics.snap_to_known(spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(pts)], "seq int, lat double, lng double"), spark.createDataFrame([(float(a), float(b)) for a, b in known], "lat double, lng double"))
    for r in got.collect():
        best = known[((known - pts[r["seq"]]) ** 2).sum(axis=1).argmin()]
        assert (r["lat"], r["lng"]) == tuple(best)
    assert got.count() == 80


def test_power_law(spark):
    rng = np.random.default_rng(5)
    x = 2 * (1 - rng.random(5000)) ** (-1 / 1.5)
    km = spark.createDataFrame([("real", float(v)) for v in x], "side string, km double")
    best = powerlaw.best_tail(powerlaw.tail_fits(km)).first()
    assert best["alpha_2km"] == pytest.approx(2.5, abs=0.1) and best["ks"] < 0.05
    few = km.limit(60)
    assert powerlaw.tail_fits(few).count() == 0 and math.isnan(powerlaw.fit_cutoff({"n": 60}, 1.5))
    stats = powerlaw.sums_of(km)["real"]
    kappa = powerlaw.fit_cutoff(stats, 1.5)
    cost = lambda k: stats["n"] * powerlaw._log_norm(1.5, k, 1.5, 2.0) + 1.5 * stats["logs"] + stats["sum"] / k
    assert all(cost(kappa) <= cost(k) + 1e-6 for k in np.exp(np.linspace(math.log(1), math.log(15_000), 60)))
    beta, _ = powerlaw.fit_joint(stats)
    assert 0.5 <= beta <= 5


def test_split_is_chronological(spark):
    rows = [("a", dt.date(2024, 1, i), 0, 0.0, 1.0, 1.0, 1.0) for i in range(1, 11)] + [("b", DAY, 0, 0.0, 1.0, 1.0, 1.0)]
    out = split.split_days(spark.createDataFrame(rows, STAY)).collect()
    train, test = ([r["date"] for r in out if r["user_id"] == "a" and r["split"] == s] for s in ("train", "test"))
    assert len(train) == 8 and max(train) < min(test) and [r["split"] for r in out if r["user_id"] == "b"] == ["train"]


def test_samples_cut_and_history(spark):
    token = [(1, 0, 3, 10, 0)]
    days = [("u", dt.date(2024, 1, 1) + dt.timedelta(i), 0, token * 25) for i in range(40)]
    df = spark.createDataFrame(days, "user_id string, date date, day_type int, tokens array<struct<cell_id:int,scale:int,duration:int,arrival:int,loc_type:int>>")
    places = spark.createDataFrame([("u", 1, None)], "user_id string, home_cell int, work_cell int")
    out = samples.history_arrays(samples.flatten(samples.windows(df), 5, 4, places)).orderBy("date").collect()
    last = out[-1]
    assert len(last["cells"]) == 1 + 3 * 21 + 20 + 1 and last["ctx_len"] == 64
    assert len(last["hist_cells"]) == 200 and len(last["hist_day_boundaries"]) == 10 and last["hist_day_boundaries"][-1] == [180, 200]
    assert out[0]["hist_cells"] == [0] and out[0]["hist_day_boundaries"] == [[0, 0]] and out[0]["work_cell"] == 5
    assert set(last["activities"][1:21]) == {tokens.HOME} and last["cells"][0] == 6 and last["cells"][-1] == 7
    padded = samples.pad_to(samples.flatten(samples.windows(df), 5, 4, places), 90, 5, 4).orderBy("date").first()
    assert len(padded["cells"]) == 90 and sum(padded["mask"]) == 22


def test_tokens_decode_to_the_same_cells(spark, small):
    from wayfarer import queries

    rows, words, places = queries.token_rows(spark, small)
    back = tokens.decode_days(tokens.day_sequences(rows), words, places)
    assert back.count() == rows.count() and back.where("end_min < start_min").count() == 0


def test_workflows(spark, small):
    from wayfarer import fixtures as fx
    from wayfarer import queries

    raw = fx.stays(spark, small, jitter=False).select("user_id", "seq", "lng", "lat", "t_in", "t_out").where("t_in < t_out")
    rows, anchors = workflows.preprocess_tower(raw, fx.hints(spark, small), fx.calendar(spark, small))
    assert split.misaligned(rows, anchors).count() == 0 and {r["intent_class"] for r in rows.select("intent_class").distinct().collect()} <= {"t1", "t2", "other"}
    got = workflows.prepare_training(rows.where("split = 'train'"))
    assert got.samples.count() > 0 and got.personas.count() > 0
    gps, _ = workflows.preprocess_gps(fx.points(fx.stays(spark, small)), fx.calendar(spark, small))
    assert gps.count() > 0
    p = queries.pts(spark, small)
    with pytest.raises(ValueError):
        workflows.compare(p.where("side = 'real'"), p.limit(0))


def test_a_user_with_21_stays_a_day_goes_from_gps_only(spark):
    """Two users over six days; on one day the first has 21 stays."""
    day, home, work = 86400, (116.4, 39.9), (116.45, 39.95)
    stays = []
    for user in ("many", "few"):
        for k in range(6):
            n = 21 if user == "many" and k == 2 else 2
            for i in range(n):
                lng, lat = home if i % 2 == 0 else work
                t = k * day + (i + 1) * day // (n + 1) - 28800
                stays.append((user, k * 100 + i, lng, lat, float(t), float(t + 1800)))
    cal = spark.createDataFrame([(dt.date(1970, 1, 1) + dt.timedelta(k), "workday") for k in range(-1, 8)], "date date, day_type string")
    hints = spark.createDataFrame([(u, home, work) for u in ("many", "few")], "user_id string, home struct<lng: double, lat: double>, work struct<lng: double, lat: double>")
    raw = spark.createDataFrame(stays, "user_id string, seq int, lng double, lat double, t_in double, t_out double")
    tower, anchors = workflows.preprocess_tower(raw, hints, cal)
    assert {r["user_id"] for r in tower.select("user_id").distinct().collect()} == {"many", "few"} == {r["user_id"] for r in anchors.collect()}
    points = [(u, t + m * 60.0, lng + 1e-7, lat) for u, _, lng, lat, t, _ in stays for m in range(0, 31, 10)]
    gps, anchors = workflows.preprocess_gps(spark.createDataFrame(points, "user_id string, ts double, lng double, lat double"), cal)
    assert {r["user_id"] for r in gps.select("user_id").distinct().collect()} == {"few"} == {r["user_id"] for r in anchors.collect()}
    assert all(round(r["lng"], 6) == r["lng"] for r in gps.collect())


def test_relabelling_rewrites_anchors(spark, small):
    from wayfarer import fixtures as fx

    raw = fx.stays(spark, small, jitter=False).select("user_id", "seq", "lng", "lat", "t_in", "t_out")
    plain = workflows.preprocess_tower(raw, fx.hints(spark, small), fx.calendar(spark, small))[1]
    rows, moved = workflows.preprocess_tower(raw, fx.hints(spark, small), fx.calendar(spark, small), dataclasses.replace(workflows.TOWER, relabel="grid"))
    ranks = {r["user_id"]: r for r in relabel.rank_cells(rows.where("split = 'train'")).collect()}
    got = {r["user_id"]: (r["t1_lng"], r["t1_lat"], r["t2_lng"], r["t2_lat"]) for r in moved.collect()}
    assert got == {u: (r["p_lng"], r["p_lat"], r["s_lng"], r["s_lat"]) for u, r in ranks.items()} and got
    assert any(got[r["user_id"]][:2] != (r["t1_lng"], r["t1_lat"]) for r in plain.collect())


@pytest.mark.parametrize("zone", ["UTC", "Asia/Shanghai", "America/New_York"])
def test_gps_times_know_no_session_zone(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        text = "h\n" * 6 + "39.9,116.4,0,0,0,2024-01-01,08:00:00\n39.9,116.4,0,0,0,2024-03-10,02:30:00\n39.9,116.4,0,0,0,2024-13-01,08:00:00"
        got = readers.parse_gps(spark.createDataFrame([("x/u1/Trajectory/a.plt", text)], "path string, value string")).collect()
        assert sorted(r["ts"] for r in got) == [1704067200.0, 1710009000.0]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_padded_durations_have_a_middle(spark):
    row = spark.range(1).select(geo.duration_middle(F.lit(24)).alias("m"), geo.duration_low(F.lit(-1)).alias("l"), geo.duration_middle(F.lit(None).cast("int")).alias("n")).first()
    assert (row["m"], row["l"], row["n"]) == (1260.0, 0.0, None)


@pytest.mark.parametrize(("n", "some"), [(49, False), (50, True)])
def test_few_distances_have_no_mixture(spark, n, some):
    km = spark.range(n).selectExpr("CAST(1 + id * 0.37 AS DOUBLE) AS km")
    best, scores = scales.choose_scales(scales.weighted_logs(km))
    assert (best is not None) == some == bool(scores)


def test_deltas_without_a_side_are_nan(spark):
    km = spark.range(300).selectExpr("'real' AS side", "CAST(2 + id * 0.1 AS DOUBLE) AS km")
    got = dict(powerlaw.fit_deltas(km))
    assert math.isnan(got["beta"]) and math.isnan(got["kappa"]) and not any(k.startswith("scale") for k in got)
    rows = {r["metric"]: r["value"] for r in evaluation.band_scores(km).collect()}
    assert math.isnan(rows["bands.delta.urban"])


def test_boundaries_are_where_densities_meet():
    s = scales.Scales((-1.0, 0.5, 2.5), (0.4, 0.9, 0.3), (0.3, 0.5, 0.2))
    density = lambda x, i: s.weight[i] / math.sqrt(s.var[i]) * math.exp(-((x - s.mu[i]) ** 2) / 2 / s.var[i])
    for i, km in enumerate(s.boundaries()):
        assert density(math.log(km), i) == pytest.approx(density(math.log(km), i + 1))
    even = scales.Scales((0.0, 2.0), (0.5, 0.5), (0.5, 0.5))
    assert even.boundaries() == pytest.approx([math.e]) == even.boundaries(compat=True)


def test_points_by_aliases_and_type(spark):
    df = spark.createDataFrame([("t", [(39.9, 116.4, 72.0, "x")]), ("u", [(99.0, 1.0, 0.5, "y")])], "traj_id string, points array<struct<latitude: double, longitude: double, t_i: double, activity: string>>")
    got = readers.normalise_points(df, None, "real").collect()
    assert [(r["traj_id"], r["lat"], r["lng"], r["t_start"], r["t_end"], r["category"]) for r in got] == [("t", 39.9, 116.4, 0.5, 0.5, "x")]
    lists = spark.createDataFrame([("t", [["0.1", "0.2", "n", "i", "116.4", "39.9"], ["0.3", "p", "39.8", "116.3"]])], "traj_id string, points array<array<string>>")
    got = sorted((r["seq"], r["lat"], r["lng"], r["t_end"], r["poi_id"]) for r in readers.normalise_points(lists, None, "sim").collect())
    assert [g[1:] for g in sorted(got, key=lambda g: g[1])] == [(39.8, 116.3, 0.3, "p"), (39.9, 116.4, 0.2, "i")]


def test_stored_steps_are_forgotten(spark):
    df = readers.stored(spark.range(3))
    assert df.count() == 3 and readers.counted(spark.range(5))[1] == 5
    path = pathlib.Path(readers.shared_folder(spark))
    assert any(path.iterdir())


def test_rings_widen_before_far_points_meet_degrees(spark):
    known = [(float(i % 9) * 0.5, float(i // 9) * 0.5) for i in range(81)]
    pts = [(0, 0.6, 0.6), (1, 1.12, 2.03), (2, -40.0, 70.0), (3, 2.0, 9.0), (4, 0.0, 0.0)]
    table = lambda rows: spark.createDataFrame([(*r,) for r in rows], "seq int, lat double, lng double")
    places = spark.createDataFrame(known, "lat double, lng double")
    for rows in (pts, pts[:2]):
        out = metrics.snap_to_known(table(rows), places)
        want = {s: min(known, key=lambda k: ((k[0] - a) ** 2 + (k[1] - b) ** 2, k)) for s, a, b in rows}
        assert {r["seq"]: (r["lat"], r["lng"]) for r in out.collect()} == want
    # Both are within the widest ring, so no spot meets a whole table.
    plan = out._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_a_long_history_is_cut_without_a_change(spark):
    rng = np.random.default_rng(6)
    rows = []
    for user, n in (("a", 3000), ("b", 7), ("c", 900)):
        walk = np.cumsum(rng.normal(0, 1.5e-3, (n, 2)) * (rng.random((n, 1)) < 0.15), axis=0)
        ts = np.cumsum(np.where(rng.random(n) < 0.02, 9000, rng.integers(20, 200, n))).astype(float)
        rows += [(user, float(t), float(116 + x), float(39 + y)) for t, (x, y) in zip(ts, walk, strict=True)]
    df = spark.createDataFrame(rows, "user_id string, ts double, lng double, lat double").repartition(5)
    for merge in (None, 200.0):
        want = []
        for user in "abc":
            lng, lat, ts = (np.array([r[i] for r in rows if r[0] == user]) for i in (2, 3, 1))
            found = naive_stays(lng, lat, ts, 200, 10)
            want += [(user, i, *s) for i, s in enumerate(found if merge is None else stays.merge_near(found, merge))]
        out = stays.detect_stays(df, merge_metres=merge, chunk=40)
        got = sorted(tuple(r) for r in out.collect())
        assert [g[:2] for g in got] == [x[:2] for x in want] and np.allclose([g[2:] for g in got], [x[2:] for x in want], rtol=1e-12)
    gaps = lambda chunk: sorted(tuple(r) for r in stays.detect_stays(df, max_gap_s=3600, chunk=chunk).collect())
    assert gaps(40) == gaps(10**9) and len(gaps(40)) > len(got)


def test_one_history_in_many_ranges_is_the_scan(spark):
    rng = np.random.default_rng(8)
    n = 6000
    # A walk, then a long rest that holds whole ranges, then places near each other; some points share their time.
    step = rng.normal(0, 1.2e-3, (n, 2)) * (rng.random((n, 1)) < 0.2)
    step[2000:3800] = rng.normal(0, 1e-6, (1800, 2))
    step[4500:] = rng.normal(0, 3e-4, (n - 4500, 2))
    walk = np.cumsum(step, axis=0)
    ts = np.cumsum(rng.integers(0, 90, n)).astype(float) + 0.25
    rows = [("hot", float(t), float(116 + x), float(39 + y)) for t, (x, y) in zip(ts, walk, strict=True)]
    rows = sorted(rows, key=lambda r: r[1:]) + [("cold", 5.0, 116.0, 39.0), ("zero", None, 116.0, 39.0), ("zero", 5.0, None, 39.0)]
    lng, lat, ts = (np.array([r[i] for r in rows[:n]]) for i in (2, 3, 1))
    want = naive_stays(lng, lat, ts, 200, 10)
    df = spark.createDataFrame(rows, "user_id string, ts double, lng double, lat double").repartition(5)
    for ranges, chunk in ((1, 10**9), (3, 100), (17, 64)):
        got = sorted(tuple(r) for r in stays.detect_stays(df, merge_metres=None, chunk=chunk, ranges=ranges).collect())
        assert [g[:2] for g in got] == [("hot", i) for i in range(len(want))] and np.allclose([g[2:] for g in got], want, rtol=1e-12)
    assert stays.detect_stays(df.limit(0)).count() == 0


def test_a_search_goes_on_from_its_state():
    rng = np.random.default_rng(9)
    walk = np.cumsum(rng.normal(0, 1e-3, (900, 2)) * (rng.random((900, 1)) < 0.1), axis=0)
    p = np.stack([116 + walk[:, 0], 39 + walk[:, 1], np.cumsum(rng.integers(1, 200, 900)).astype(float)])
    for gap in (None, 180.0):
        whole = stays.StayScan(200, 10, gap)
        want = whole.feed(p) + whole.finish()
        for size in (1, 7, 400):
            state, got = b"", []
            for at in range(0, 900, size):
                scan = stays.StayScan(200, 10, gap, state)
                got += scan.feed(p[:, at : at + size])
                state = scan.state()
            assert got + stays.StayScan(200, 10, gap, state).finish() == want and len(want) > 5


def test_clusters_across_tasks_are_those_of_a_group(spark):
    rng = np.random.default_rng(12)
    rows = []
    for user, base, n in (("mid", 39.9, 700), ("north", 78.0, 300), ("south", -45.0, 200), ("one", 10.0, 1)):
        # Rows of places close together, thin bridges of places between them, and single ones.
        lat = base + np.concatenate([rng.normal(0, 0.004, n // 2), rng.random(n - n // 2) * 0.05])
        lng = 116 + np.concatenate([rng.normal(0, 0.004, n // 2), rng.random(n - n // 2) * 0.05]) / math.cos(math.radians(base))
        rows += [(user, DAY, i, float(i % 1440), 1440.0, float(x), float(y)) for i, (x, y) in enumerate(zip(lng, lat, strict=True))]
    df = spark.createDataFrame(rows + rows[:50], STAY)
    for metres in (120.0, 300.0):
        near, far = relabel.rank_clusters(df, metres), relabel.rank_clusters(df, metres, most=0)
        key = lambda r: (r["user_id"], r["p_n"], r["s_n"], *(round(r[c], 9) for c in ("p_lng", "p_lat", "s_lng", "s_lat")))
        assert sorted(map(key, near.collect())) == sorted(map(key, far.collect())) and near.count() == 4
    assert relabel.rank_clusters(df.limit(0), most=0).count() == 0


def test_nearest_places_of_many_tiles(spark):
    rng = np.random.default_rng(14)
    known = [(float(a), float(b)) for a, b in np.concatenate([rng.normal(0, 0.2, (400, 2)), rng.integers(-9, 9, (200, 2)), [[60.0, 170.0]]])]
    spots = [(float(a), float(b)) for a, b in np.concatenate([rng.normal(0, 0.3, (300, 2)), rng.integers(-19, 19, (200, 2)) / 2, [[-80.0, -179.0], [60.0, 171.0]]])]
    rows = [(i, *s) for i, s in enumerate(spots + spots[:40] + [spots[7]] * 3000)] + [(9999, None, 1.0)]
    df = spark.createDataFrame(rows, "seq int, lat double, lng double").repartition(6)
    places = spark.createDataFrame(known + known[:9], "lat double, lng double")
    want = {s: min(known, key=lambda k: ((s[0] - k[0]) * (s[0] - k[0]) + (s[1] - k[1]) * (s[1] - k[1]), k)) for s in spots}
    for tile in (4, 50, 1024):
        got = {r["seq"]: (r["lat"], r["lng"]) for r in metrics.snap_to_known(df, places, tile=tile).collect()}
        assert got == {i: want[y, x] for i, y, x in rows[:-1]}
    assert metrics.snap_to_known(df, places.limit(0)).count() == 0 == metrics.snap_to_known(df.limit(0), places).count()


def test_a_run_over_points_reports_what_it_lost(spark):
    day, at = 86400, {"home": (116.4, 39.9), "work": (116.45, 39.95), "far": (100.0, 20.0), "there": (100.05, 20.05)}
    points = []

    def stay(user, place, t, n=5):
        points.extend((user, t + m * 300.0, at[place][0] + 1e-7, at[place][1]) for m in range(n))

    for user, places, days in (("kept", ("home", "work"), 5), ("short", ("home", "work"), 2), ("away", ("far", "there"), 5)):
        for k in range(days):
            for i in range(4):
                stay(user, places[i % 2], k * day + i * 18000.0 - 28800 + 3600)
    stay("one place", "home", 0.0)
    points += [("passing", i * 60.0, 116 + i * 0.01, 39.9) for i in range(30)] + [("silent", None, 116.0, 39.0)]
    df = spark.createDataFrame(points, "user_id string, ts double, lng double, lat double")
    cal = spark.createDataFrame([(dt.date(1970, 1, 1) + dt.timedelta(k), "workday") for k in range(-1, 8)], "date date, day_type string")
    stays_, anchors, report = workflows.preprocess_gps_reported(df, cal, users=df.select("user_id"))
    got = {r["item"]: r["value"] for r in report.collect()}
    lost = {k[8:]: v for k, v in got.items() if k.startswith("dropped.") and v}
    assert lost.pop("few_days", 0) + lost.pop("no_home", 0) == 2  # "short" and "one place"
    assert lost == {"no_points": 1, "no_stays": 1, "outside_box": 1} and (got["n_users_in"], got["n_users_kept"]) == (6, 1)
    assert (got["n_stays"], got["n_days"]) == (stays_.count(), stays_.select("date").distinct().count()) and got["avg_stays_per_day"] == got["n_stays"] / got["n_days"]
    assert sum(v for k, v in got.items() if k.startswith("intent.")) == got["n_stays"] and got["day_type.workday"] == got["n_days"]
    assert got["step_km.max"] == got["step_km.p95"] == round(got["step_km.p50"], 1) > 5


def test_tower_text_is_counted_while_it_is_read(spark):
    from wayfarer.operators import reports

    lines = ["u\t[(116.4, 39.9, 0, 3600), (0, 0, 10, 20), (116.4, 39.9, 30, 30)]", "", "v\t[(116.5, 39.9, 0, 90000)]", "w", "x\t[oops]", "y\t[]", "z\t[(1, 2)]"]
    ledger = reports.Ledger()
    rows = readers.stored(readers.parse_tower(spark.createDataFrame([(x,) for x in lines], "value string"), ledger))
    assert {(r["user_id"], r["t_out"]) for r in rows.collect()} == {("u", 3600), ("v", 90000)}
    assert ledger.values() == {"n_lines": 6, "n_dropped_unparsed": 4, "n_dropped_coord": 1, "n_dropped_duration": 1, "n_stays_loaded": 2}


def test_gps_files_are_read_in_splits(spark, tmp_path):
    want = []
    for user, name, n in (("000", "a", 4000), ("000", "b", 3), ("zz", "c", 0), ("zz", "d", 700), ("none", "e", 0)):
        folder = tmp_path / user / "Trajectory"
        folder.mkdir(parents=True, exist_ok=True)
        lines = [f"39.{i:06d},116.5,0,0,0,2024-01-02,{i // 3600:02d}:{i // 60 % 60:02d}:{i % 60:02d}" for i in range(1, n + 1)]
        # A header may look like a point, which it isn't.
        (folder / f"{name}.plt").write_text("\r\n".join(["39.5,116.5,0,0,0,2024-01-02,00:00:00"] * 6 + lines + ["bad,line"]) + "\r\n")
        want += [(user, 116.5, float(f"39.{i:06d}"), 1704124800.0 + i) for i in range(1, n + 1)]
    key, keep = "spark.sql.files.maxPartitionBytes", spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set(key, "20000")
        df = readers.read_gps(spark, str(tmp_path))
        assert df.rdd.getNumPartitions() > 5 and sorted(tuple(r) for r in df.collect()) == sorted(want)
        assert {r["user_id"] for r in readers.gps_users(spark, str(tmp_path)).collect()} == {"000", "zz", "none"}
    finally:
        spark.conf.set(key, keep)


def test_a_stored_mixture_is_loaded(spark):
    from wayfarer import queries

    table = queries.SCALES.table(spark)
    got = scales.Scales.of(table.repartition(3))
    assert (got.mu, got.var, got.weight) == (queries.SCALES.mu, queries.SCALES.var, queries.SCALES.weight)
    for bad in (table.limit(0), table.where("rank > 0"), table.withColumn("var_log", F.lit(0.0)), table.withColumn("mu_log", -F.col("mu_log")), table.withColumn("weight", F.lit(None).cast("double"))):
        with pytest.raises(ValueError):
            scales.Scales.of(bad)


def test_fits_start_alike_from_counts_and_from_rows(spark):
    rng = np.random.default_rng(5)
    logs = spark.createDataFrame([(float(x), int(n)) for x, n in zip(np.sort(rng.normal(0, 1, 300)), rng.integers(1, 9, 300), strict=True)], "x double, n long")
    pdf = logs.toPandas()
    a, b = scales._Counts(pdf["x"].to_numpy(), pdf["n"].to_numpy()), scales._Rows(logs)
    for k in (1, 2, 5):
        (qa, va), (qb, vb) = a.start(k), b.start(k)
        assert qa == pytest.approx(qb, rel=1e-12) and va == pytest.approx(vb, rel=1e-9)
        assert scales.fit_scales(a, k, 5).mu == pytest.approx(scales.fit_scales(b, k, 5).mu, rel=1e-9)


def test_a_thin_side_has_no_cutoff(spark):
    km = [("real", 2.0 + 40 * i / 400) for i in range(400)] + [("sim", 5.0)] * 9
    got = {r[0]: r for r in powerlaw.cutoffs(spark.createDataFrame(km, "side string, km double"))}
    assert got["real"][3] == 400 and got["real"][2] > 0 and got["sim"][3] == 9 and math.isnan(got["sim"][1]) and math.isnan(got["sim"][2])
    assert [r[3] for r in powerlaw.cutoffs(spark.createDataFrame([], "side string, km double"))] == [0, 0]


def test_jobs_of_the_command_line(spark, tmp_path, small):
    from wayfarer import __main__ as command
    from wayfarer import fixtures as fx
    from wayfarer import queries

    p = queries.pts(spark, small)
    for side in ("real", "sim"):
        p.where(f"side = '{side}'").write.parquet(str(tmp_path / side))
    p.where("side = 'real'").select("lat", "lng").write.parquet(str(tmp_path / "known"))
    fx.calendar(spark, small).write.parquet(str(tmp_path / "calendar"))
    lines = [f"{u}\t[" + ", ".join(f"(116.4{j % 2}, 39.9, {1704067200 + k * 86400 + j * 20000 - 28800}, {1704067200 + k * 86400 + j * 20000 + 15000 - 28800})" for k in range(7) for j in range(3)) + ", (0, 0, 1, 2)]" for u in ("a", "b")]
    (tmp_path / "stays.txt").write_text("\n".join(lines))
    (tmp_path / "hints.txt").write_text("{'user_id': 'a', 'home': [116.4, 39.9], 'work': [116.41, 39.9]}\n{'user_id': 'b', 'home': None, 'work': None}\n")
    out = lambda *names: str(tmp_path.joinpath("out", *names))
    stop, command.readers.forget_stored = command.readers.forget_stored, lambda s: None
    try:
        command.main(["compare", str(tmp_path / "real"), str(tmp_path / "sim"), out("plain"), "--no-scaling"])
        command.main(["compare", str(tmp_path / "real"), str(tmp_path / "sim"), out("bands"), "--boundaries", "1", "10", "--sizes", "2", "--most-km", "30", "--known", str(tmp_path / "known")])
        command.main(["tower", str(tmp_path / "stays.txt"), str(tmp_path / "hints.txt"), str(tmp_path / "calendar"), out("tower"), "--relabel", "grid"])
    finally:
        command.readers.forget_stored = stop
    plain, bands = ({r["metric"] for r in spark.read.parquet(out(k, "metrics")).collect()} for k in ("plain", "bands"))
    assert "SD.jsd" in plain & bands and not any(m.startswith("SFP") for m in plain) and sum(m.startswith("SFP.") for m in bands) == 5
    report = {r["item"]: r["value"] for r in spark.read.parquet(out("tower", "report")).collect()}
    assert (report["n_lines"], report["n_stays_loaded"], report["n_dropped_coord"], report["n_hw_entries"]) == (2, 42, 2, 2)
    assert report["n_users_in"] == 2 and report["n_users_kept"] + report["dropped.no_home"] == 2 and spark.read.parquet(out("tower", "stays")).count() == report["n_stays"]


def test_personas_do_not_depend_on_partitions(spark):
    rng = np.random.default_rng(11)
    x = np.concatenate([rng.dirichlet(30 * np.array(c), 70) for c in ((1, 0.1, 0.1), (0.1, 1, 0.1), (0.1, 0.1, 1), (1, 1, 1))])
    rows = [(f"u{i}", *map(float, v)) for i, v in enumerate(x)] + [("twin", *map(float, x[3]))]
    df = spark.createDataFrame(rows, "user_id string, s0 double, s1 double, s2 double")
    got = [{r["user_id"]: r["persona"] for r in tokens.personas(df.repartition(n, "user_id")).collect()} for n in (1, 7, 40)]
    assert got[0] == got[1] == got[2] and set(got[0].values()) == {0, 1, 2, 3} and got[0]["twin"] == got[0]["u3"]
    # The four clouds are found, whatever single starts would have found.
    assert all(len({got[0][f"u{i}"] for i in range(70 * k, 70 * k + 70)}) == 1 for k in range(4))
    same = spark.createDataFrame([(str(i), 0.5, 0.25, 0.25) for i in range(9)], df.schema)
    assert {r["persona"] for r in tokens.personas(same).collect()} == {0} and tokens.personas(df.limit(0)).count() == 0


def test_personas_from_a_given_start_go_on_at_equal_costs(spark):
    # 512 first goes to the lower centre, then, as near to both, to the first: at no gain, but 480 and after it 448 follow.
    low, rest = [0] * 5, [448, 480, 512] + [844] * 7
    df = spark.createDataFrame([(str(i), x / 1024) for i, x in enumerate(low + rest)], "user_id string, s0 double")
    got = {int(r["user_id"]): r["persona"] for r in tokens.personas(df, given=[[844 / 1024], [180 / 1024 + 1e-14]]).collect()}
    assert got == {i: int(i >= len(low)) for i in range(len(low + rest))}


def test_kernel_means_are_within_their_bound():
    from wayfarer.operators import priors

    rng = np.random.default_rng(4)
    bound = 2.2 * 0.5**priors.TERMS / math.sqrt(math.factorial(priors.TERMS))
    for d in (rng.normal(0, 1.5, (3, 400)), np.log(np.maximum(0.05, rng.random((2, 300)) * 40)), np.full((2, 5), 0.7), rng.random((1, 1))):
        for width in (0.05, 0.22, 0.5, 3.0):
            assert np.abs(priors.kernel_means(d, width) - priors.exact_kernel_means(d, width)).max() <= bound < 1e-11


def test_rare_cells_are_next_cells(spark, small):
    from wayfarer import queries

    cells = queries.grid(spark, small)[2].orderBy("cell_id").toPandas()
    lat, lng = np.radians(cells["lat"].to_numpy()), np.radians(cells["lng"].to_numpy())
    h = np.sin((lat[:, None] - lat) / 2) ** 2 + np.cos(lat[:, None]) * np.cos(lat) * np.sin((lng[:, None] - lng) / 2) ** 2
    d = np.log(np.maximum(2 * 6371.0 * np.arcsin(np.sqrt(h)), 0.05))
    got = queries.QUERIES["pri9_next_cells"](spark, small).toPandas()
    assert set(got["prev"]) == set(cells["cell_id"]) and (cells["cnt"] < 60).any()
    for r in got.sample(60, random_state=1).itertuples():
        mu, var, w = queries.SCALES.mu[r.scale], queries.SCALES.var[r.scale], max(0.05, math.sqrt(queries.SCALES.var[r.scale]) * 0.5)
        dens = np.exp(-0.5 * ((d[r.prev][:, None] - d[r.prev]) / w) ** 2).mean(axis=1)
        score = -0.5 * (d[r.prev] - mu) ** 2 / max(var, 0.01) - np.log(np.maximum(dens, 1e-9))
        assert r.score == pytest.approx(score[r.cell], abs=1e-5) and (score > r.score + 1e-5).sum() < r.nth


@pytest.mark.parametrize(("n", "spread", "metres"), [(400, 0.02, 300), (600, 0.004, 100), (60, 3.0, 20_000), (300, 0.0, 50)])
def test_clusters_of_dense_and_thin_places(n, spread, metres):
    rng = np.random.default_rng(n)
    for south in (0.0, 64.0, -39.0):
        lng, lat = -1 + np.round(rng.random(n) * spread, 4), south + np.round(rng.random(n) * spread, 4)
        got = relabel.eps_components(lng, lat, metres)
        near, label = stays._metres(lat[:, None], lng[:, None], lat[None], lng[None]) <= metres, np.arange(n)
        while True:
            low = np.where(near, label[None], n).min(axis=1)
            if (low == label).all():
                break
            label = low
        seen = {}
        assert got.tolist() == [seen.setdefault(int(v), len(seen)) for v in label]


def test_median_steps_by_counts(spark):
    rng = np.random.default_rng(5)
    rows, want = [], set()
    for user in range(60):
        n = int(rng.integers(1, 9))
        lat = 39 + np.cumsum(rng.choice([0.0, 0.05, 0.1, 0.2], n))
        rows += [(str(user), "2024-01-01", i, i, 116.0, float(v)) for i, v in enumerate(lat)]
        km = np.diff(lat) * np.pi / 180 * 6371.0
        if not len(km) or np.median(km) <= 8.5:
            want.add(str(user))
    df = spark.createDataFrame(rows, "user_id string, date string, start_min int, seq int, lng double, lat double")
    got = {r["user_id"] for r in filters.plausible_steps(df, 8.5).select("user_id").distinct().collect()}
    assert got == want and 0 < len(want) < 60


@pytest.mark.parametrize("values", [[], [3.0], [1.0, 1.0, 5.0], [0.0, 0.5, 2.0, 9.0, 9.0, 9.5, 20.0]])
def test_quantiles_of_ranked_values(spark, values):
    df = spark.createDataFrame([("a", v) for v in values], "side string, x double")
    got = metrics.ranked(df, 3).agg(*[metrics.quantile(p) for p in (0.0, 0.3, 0.5, 0.95, 1.0)]).first()
    assert list(got) == (pytest.approx(np.quantile(values, [0, 0.3, 0.5, 0.95, 1]).tolist()) if values else [None] * 5)
