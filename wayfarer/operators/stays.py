"""From points and raw stays to days of stays."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.readers import stored

UTC8_SECONDS = 28800
_RAW = "user_id string, seq int, lng double, lat double, t_in double, t_out double"
_STAY = [("user_id", pa.string()), ("part", pa.int32()), ("kind", pa.string()), ("nth", pa.int32()), ("lng", pa.float64()), ("lat", pa.float64()), ("t_in", pa.float64()), ("t_out", pa.float64()), ("cut", pa.bool_()), ("data", pa.binary())]
_FOUND, _AGAIN = pa.schema([*_STAY, ("box", pa.binary())]), pa.schema([*_STAY, ("entry", pa.binary())])
_STAY_SQL = "user_id string, part int, kind string, nth int, lng double, lat double, t_in double, t_out double, cut boolean, data binary"
_FOUND_SQL, _AGAIN_SQL = f"{_STAY_SQL}, box binary", f"{_STAY_SQL}, entry binary"
_WAY = "user_id string, part int, action string, entry binary, lng double, lat double, t_in double, t_out double, cut boolean"


def _metres(lat1, lng1, lat2, lng2):
    p1, p2 = np.radians(lat1), np.radians(lat2)
    a = np.sin((p2 - p1) / 2) ** 2 + np.cos(p1) * np.cos(p2) * np.sin(np.radians(lng2 - lng1) / 2) ** 2
    return 2 * 6371000.0 * np.arcsin(np.minimum(1.0, np.sqrt(a)))


def _first_beyond(lat: np.ndarray, lng: np.ndarray, i: int, limit: float, start: tuple[float, float] | None = None) -> int:
    """First index after i that lies further than ``limit`` from point i, or from ``start``; looks ahead in growing chunks."""
    at, size, (y, x) = i + 1, 32, start or (lat[i], lng[i])
    while at < len(lat):
        far = np.flatnonzero(_metres(y, x, lat[at : at + size], lng[at : at + size]) > limit)
        if len(far):
            return at + int(far[0])
        at, size = at + size, min(size * 2, 65_536)
    return len(lat)


def _units(x):
    """Coordinates in whole units of 2**-36 degrees, so that their sums are exact in any order."""
    return np.rint(np.asarray(x) * 2.0**36)


class StayScan:
    """The search for stays along one history, fed with its points in any portions.

    A stay is a run of points within ``metres`` of its first one that lasts ``minutes``; without one the search
    goes on from the next point. What can't be told before more points come is kept: the points of the last
    ``minutes``, or the first point and the sums of a stay that hasn't ended. ``state`` carries that to another task.
    A gap of over ``max_gap_s`` ends a stay; the next one is marked as ``cut`` off.
    """

    def __init__(self, metres: float, minutes: float, max_gap_s: float | None = None, state: bytes = b"") -> None:
        self.metres, self.seconds, self.gap = metres, minutes * 60, max_gap_s
        x = np.frombuffer(state, float) if state else np.array([0.0, 0.0, np.nan])
        #: Whether a gap came since the last stay; first point, size, sums and end of an open stay; waiting points.
        self.cut, self.open, self.last = bool(x[0]), list(x[3:10]) if x[1] else None, float(x[2])
        self.tail = x[10:].reshape(3, -1) if state else np.zeros((3, 0))

    def state(self) -> bytes:
        return np.concatenate([[float(self.cut), float(self.open is not None), self.last], self.open or np.zeros(7), self.tail.reshape(-1)]).tobytes()

    def feed(self, p: np.ndarray) -> list[tuple]:
        """Stays (lng, lat, first and last time, cut) that are complete with the next points ``p`` (lng, lat, ts; in order)."""
        if not p.shape[1]:
            return []
        gaps = [] if self.gap is None else (np.flatnonzero(np.diff(p[2], prepend=self.last) > self.gap)).tolist()
        out, at = [], 0
        for to in gaps:
            out += self._feed(p[:, at:to]) + self.finish()
            self.cut, at = True, to
        self.last = float(p[2, -1])
        return out + self._feed(p[:, at:])

    def finish(self) -> list[tuple]:
        """The open stay, for the end of a history. Points that wait are too few minutes for one."""
        self.tail = np.zeros((3, 0))
        return [self._close()] if self.open else []

    def _close(self) -> tuple:
        x, y, began, n, lng, lat, ended = self.open
        self.open, cut, self.cut = None, self.cut, False
        return (float(_units(x) + lng / n) / 2.0**36, float(_units(y) + lat / n) / 2.0**36, float(began), float(ended), cut)

    def grow(self, n: float, lng: float, lat: float, ended: float) -> None:
        """Adds points to the open stay: their number, sums of units from its first point's, last time."""
        self.open[3:] = [self.open[3] + n, self.open[4] + lng, self.open[5] + lat, ended]

    def _feed(self, p: np.ndarray) -> list[tuple]:
        out = []
        if self.open:
            j = _first_beyond(p[1], p[0], -1, self.metres, (self.open[1], self.open[0]))
            if j:
                self.grow(j, (_units(p[0, :j]) - _units(self.open[0])).sum(), (_units(p[1, :j]) - _units(self.open[1])).sum(), p[2, j - 1])
            if j == p.shape[1]:
                return out
            out.append(self._close())
            p = p[:, j:]
        p = np.concatenate([self.tail, p], axis=1) if self.tail.shape[1] else p
        lng, lat, ts = p
        reach = self._reach(ts)
        sure = int(np.searchsorted(reach, len(ts)))
        # A stay reaches the point that completes its time, so that one must be near; few others pass.
        there = reach[:sure]
        maybe = np.flatnonzero(~(_metres(lat[:sure], lng[:sure], lat[there], lng[there]) > self.metres))
        i = 0
        while (k := int(np.searchsorted(maybe, i))) < len(maybe):
            i = int(maybe[k])
            j = _first_beyond(lat, lng, i, self.metres)
            if j <= reach[i]:
                i += 1
                continue
            self.open = [lng[i], lat[i], ts[i], j - i, (_units(lng[i:j]) - _units(lng[i])).sum(), (_units(lat[i:j]) - _units(lat[i])).sum(), ts[j - 1]]
            if j == len(ts):
                self.tail = np.zeros((3, 0))
                return out
            out.append(self._close())
            i = j
        self.tail = p[:, max(i, sure) :]
        return out

    def _reach(self, ts: np.ndarray) -> np.ndarray:
        """First point of each one's list that is late enough to end a stay there; their number if none is."""
        at = np.searchsorted(ts, ts + self.seconds)
        # Sums of times are rounded, differences of times this near are not.
        at -= (at > 0) & (ts[np.maximum(at - 1, 0)] - ts >= self.seconds)
        at += (at < len(ts)) & (ts[np.minimum(at, len(ts) - 1)] - ts < self.seconds)
        return np.where(at < len(ts), np.searchsorted(ts, ts[np.minimum(at, len(ts) - 1)]), len(ts))


def scan_stays(lng: np.ndarray, lat: np.ndarray, ts: np.ndarray, metres: float, minutes: float) -> list[tuple[float, float, float, float]]:
    """Stays of a whole history: (mean lng, mean lat, first and last time)."""
    scan = StayScan(metres, minutes)
    return [s[:4] for s in scan.feed(np.stack([lng, lat, ts]).astype(float)) + scan.finish()]


def merge_near(stays: list[tuple[float, float, float, float]], metres: float) -> list[tuple[float, float, float, float]]:
    """Joins a stay to the one before while it is near that one's centre, weighted by time."""
    out: list[tuple[float, float, float, float]] = []
    for lng, lat, t_in, t_out in stays:
        if out:
            plng, plat, pin, pout = out[-1]
            if _metres(plat, plng, lat, lng) <= metres:
                a, b = max(1.0, pout - pin), max(1.0, t_out - t_in)
                out[-1] = ((plng * a + lng * b) / (a + b), (plat * a + lat * b) / (a + b), pin, t_out)
                continue
        out.append((lng, lat, t_in, t_out))
    return out


def _stay_rows(user: str, part: int, kind: str, nth: int, stays: list[tuple]) -> list[dict]:
    return [{"user_id": user, "part": part, "kind": kind, "nth": nth + i, **dict(zip(("lng", "lat", "t_in", "t_out", "cut"), s, strict=True))} for i, s in enumerate(stays)]


def _scan_range(batches: Iterator[pa.RecordBatch], new: Callable[[], StayScan], chunk: int) -> Iterator[pa.RecordBatch]:
    """Stays of a range of points in order of users and times.

    A user inside the range is done here (``stay``). The first and the last one may go on in other ranges: theirs are ``guess``, as
    if the history began here, with what the search keeps at the end (``state``), the box, size and sums of the points, and
    the points themselves in blocks.
    """
    part, opening = TaskContext.get().partitionId(), True
    user, scan, nth, held, n, blocks, box, rows = None, None, 0, [], 0, 0, None, []

    def block() -> None:
        nonlocal held, n, blocks
        if held:
            rows.append({"user_id": user, "part": part, "kind": "points", "nth": blocks, "data": np.concatenate(held, axis=1).tobytes()})
            held, n, blocks = [], 0, blocks + 1

    def close(last: bool) -> None:
        rows.append({"user_id": user, "part": part, "kind": "user"})
        if opening or last:
            block()
            rows.append({"user_id": user, "part": part, "kind": "state", "nth": nth, "data": scan.state(), "box": box.tobytes()})
        else:
            rows.extend(_stay_rows(user, part, "stay", nth, scan.finish()))

    guesses: list[dict] = []
    for batch in batches:
        names = batch.column(0).dictionary_encode()
        code, p = names.indices.to_numpy(), np.stack([batch.column(i).to_numpy() for i in (1, 2, 3)])
        edges = (np.flatnonzero(code[1:] != code[:-1]) + 1).tolist()
        for lo, hi in zip([0, *edges], [*edges, len(code)], strict=True):
            if lo == hi:
                continue
            name = names.dictionary[int(code[lo])].as_py()
            if name != user or scan is None:
                if scan is not None:
                    rows += [g | {"kind": "guess" if opening else "stay"} for g in guesses]
                    guesses = []
                    close(False)
                    opening = False
                user, scan, nth, held, n, blocks, box = name, new(), 0, [], 0, 0, np.array([np.inf, np.inf, -np.inf, -np.inf, p[0, lo], p[1, lo], 0, 0, 0, 0])
            own = p[:, lo:hi]
            found = scan.feed(own)
            guesses += _stay_rows(user, part, "guess", nth, found)
            nth += len(found)
            held.append(own)
            n += hi - lo
            total = (_units(own[:2]) - _units(box[4:6, None])).sum(axis=1)
            box = np.array([*np.minimum(box[:2], own[:2].min(axis=1)), *np.maximum(box[2:4], own[:2].max(axis=1)), *box[4:6], box[6] + hi - lo, *(box[7:9] + total), own[2, -1]])
            if n >= chunk:
                block()
        yield pa.RecordBatch.from_pylist(rows, _FOUND)
        rows = []
    if scan is not None:
        rows += [g | {"kind": "guess"} for g in guesses]
        close(True)
        yield pa.RecordBatch.from_pylist(rows, _FOUND)


def _inside(x: np.ndarray, box: np.ndarray, metres: float) -> bool:
    """Whether a whole box is surely within ``metres`` of the first point of an open stay."""
    dy, dx = np.radians(max(abs(box[1] - x[1]), abs(box[3] - x[1]))), np.radians(max(abs(box[0] - x[0]), abs(box[2] - x[0])))
    return 6371000.0 * 1.001 * float(np.hypot(dy, dx)) < metres


def _walk(rows: pd.DataFrame, new: Callable[[bytes], StayScan]) -> pd.DataFrame:
    """How one user's ranges follow each other: with which state each one is entered, as far as that is known.

    ``rows``: part, entry, exit and box of the ranges that were searched. A range that wasn't searched from its entry is asked for,
    and what comes after is judged by what it gave last. A stay that holds a whole range passes it.
    """
    known: dict[int, dict] = {}
    for part, entry, leave, box in rows.sort_values(["part", "round"])[["part", "entry", "exit", "box"]].itertuples(index=False, name=None):
        known.setdefault(part, {"box": np.frombuffer(box, float)})[entry] = known[part]["last"] = leave
    out, state = [], b""
    for part in sorted(known):
        way, scan = known[part], new(state)
        if state in way:
            out.append((part, "use", state, None))
            state = way[state]
        elif scan.open and scan.gap is None and _inside(scan.open, way["box"], scan.metres):
            x, y, n, lng, lat, last = way["box"][4:]
            scan.grow(n, lng + n * (_units(x) - _units(scan.open[0])), lat + n * (_units(y) - _units(scan.open[1])), last)
            scan.last = last
            out.append((part, "pass", state, None))
            state = scan.state()
        else:
            out.append((part, "ask", state, None))
            state = way["last"]
    end = new(state).finish()
    out += [(part, "end", state, s) for s in end]
    frame = pd.DataFrame([(p, a, e, *(s or (None,) * 5)) for p, a, e, s in out], columns=["part", "action", "entry", "lng", "lat", "t_in", "t_out", "cut"])
    frame.insert(0, "user_id", rows["user_id"].iloc[0])
    return frame


def _search_again(batches: Iterator[pa.RecordBatch], new: Callable[[bytes], StayScan]) -> Iterator[pa.RecordBatch]:
    """Stays and last state of ranges whose blocks of points come in order, each range from its entry."""
    key, scan, nth, entry = None, None, 0, b""

    def close() -> list[dict]:
        return [] if scan is None else [{"user_id": key[0], "part": key[1], "kind": "state", "nth": nth, "data": scan.state(), "entry": entry}]

    for batch in batches:
        rows = []
        for user, part, came_with, data in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if (user, part) != key:
                rows += close()
                key, scan, nth, entry = (user, part), new(came_with), 0, came_with
            found = scan.feed(np.frombuffer(data, float).reshape(3, -1))
            rows += [r | {"entry": entry} for r in _stay_rows(user, part, "guess", nth, found)]
            nth += len(found)
        yield pa.RecordBatch.from_pylist(rows, _AGAIN)
    yield pa.RecordBatch.from_pylist(close(), _AGAIN)


def _found_stays(points: DataFrame, metres: float, minutes: float, max_gap_s: float | None, chunk: int, ranges: int | None) -> tuple[DataFrame, DataFrame]:
    """``(user_id, part, nth, lng, lat, t_in, t_out, cut)``: stays in order of part and nth; and ``(user_id)`` of all with points."""
    n = ranges or int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    number = lambda c: F.col(c).cast("double").alias(c)
    rows = points.select(F.col("user_id").cast("string").alias("user_id"), number("lng"), number("lat"), number("ts")).where("lng IS NOT NULL AND lat IS NOT NULL AND ts IS NOT NULL")
    order = ["user_id", "ts", "lng", "lat"]
    new = lambda state=b"": StayScan(metres, minutes, max_gap_s, state)
    first = stored(rows.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(lambda b: _scan_range(b, new, chunk), _FOUND_SQL))
    columns = ["user_id", "part", "nth", "lng", "lat", "t_in", "t_out", "cut"]
    # Two users a range at most, so what follows is small, but for the points of those that are searched again.
    known = first.where("kind = 'state'").select("user_id", "part", F.lit(b"").alias("entry"), F.col("data").alias("exit"), "box", F.lit(0).alias("round"))
    boxes, blocks = known.select("user_id", "part", "box"), first.where("kind = 'points'").select("user_id", "part", "nth", "data")
    searched = first.where("kind = 'guess'").select(*columns, F.lit(b"").alias("entry"))
    for at in range(1, n + 2):
        way = stored(known.groupBy("user_id").applyInPandas(lambda pdf: _walk(pdf, new), _WAY))
        asked = way.where("action = 'ask'").select("user_id", "part", "entry")
        if asked.isEmpty():
            break
        again = asked.join(blocks, ["user_id", "part"]).repartition(n, "user_id", "part").sortWithinPartitions("user_id", "part", "nth").select("user_id", "part", "entry", "data")
        again = stored(again.mapInArrow(lambda b: _search_again(b, new), _AGAIN_SQL))
        exits = again.where("kind = 'state'").select("user_id", "part", "entry", F.col("data").alias("exit")).join(boxes, ["user_id", "part"])
        known = known.unionByName(exits.withColumn("round", F.lit(at)))
        searched = searched.unionByName(again.where("kind = 'guess'").select(*columns, "entry"))
    used = searched.join(way.where("action = 'use'").select("user_id", "part", "entry"), ["user_id", "part", "entry"]).select(*columns)
    ends = way.where("action = 'end'").withColumn("nth", F.lit(2**31 - 1)).select(*columns)
    return first.where("kind = 'stay'").select(*columns).unionByName(used).unionByName(ends), first.where("kind = 'user'").select("user_id").distinct()


def detect_stays(points: DataFrame, metres: float = 200.0, minutes: float = 10.0, merge_metres: float | None = 200.0, max_gap_s: float | None = None, chunk: int = 50_000, ranges: int | None = None) -> DataFrame:
    """Raw stays of ``points(user_id, ts, lng, lat, ...)``, merged unless ``merge_metres`` is None.

    Points are dealt once, by ranges of user and time, as many as there are shuffle partitions, and searched as they stream by. A
    history that lies in several ranges is searched in each of them as if it began there; then each range is entered with what the one
    before it left, and searched again only if that differs from what it was searched with. Searches soon meet, whatever
    they began with, so what a range leaves rarely changes, and a stay that holds whole ranges passes them by their boxes.
    ``max_gap_s`` also cuts histories at longer gaps, with numbers of their own. Points without a time or place go.
    Stays, far fewer, are then merged and numbered row by row.
    """
    return detect_stays_of_users(points, metres, minutes, merge_metres, max_gap_s, chunk, ranges)[0]


def detect_stays_of_users(points: DataFrame, metres: float = 200.0, minutes: float = 10.0, merge_metres: float | None = 200.0, max_gap_s: float | None = None, chunk: int = 50_000, ranges: int | None = None) -> tuple[DataFrame, DataFrame]:
    """``detect_stays``, and ``(user_id)`` of all users that have points, from the same pass."""
    found, users = _found_stays(points, metres, minutes, max_gap_s, chunk, ranges)
    in_order = found.repartition("user_id").sortWithinPartitions("user_id", "part", "nth").select("user_id", "lng", "lat", "t_in", "t_out", "cut")

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, seq, last = None, 0, []
        for pdf in batches:
            out = []
            for user, *stay, cut in pdf.itertuples(index=False, name=None):
                if user != key or cut:
                    out += [(key, seq, *s) for s in last]
                    key, seq, last = user, 0, []
                last = [*last, tuple(stay)] if merge_metres is None else merge_near([*last, tuple(stay)], merge_metres)
                if len(last) > 1:
                    out.append((user, seq, *last[0]))
                    seq, last = seq + 1, last[1:]
            yield pd.DataFrame(out, columns=["user_id", "seq", "lng", "lat", "t_in", "t_out"])
        if last:
            yield pd.DataFrame([(key, seq, *last[0])], columns=["user_id", "seq", "lng", "lat", "t_in", "t_out"])

    return in_order.mapInPandas(join, _RAW), users


def with_local_time(raw: DataFrame, with_seconds: bool = False, day_start_hour: int = 0) -> DataFrame:
    """Adds ``date``, ``start_min``, ``end_raw`` and ``end_min`` in UTC+8 to ``raw(t_in, t_out, ...)``.

    A stay belongs to the day that it starts in; ``end_min`` stops at the day's end.
    """
    local = F.col("t_in").cast("long") + UTC8_SECONDS - day_start_hour * 3600
    second = F.pmod(local, F.lit(86400))
    start = second / 60 if with_seconds else F.floor(second / 60).cast("double")
    end = start + (F.col("t_out") - F.col("t_in")) / 60
    return raw.withColumns({"date": F.date_add(F.lit("1970-01-01").cast("date"), F.floor(local / 86400).cast("int")), "start_min": F.bround(start, 1), "end_raw": F.bround(end, 1)}).withColumn("end_min", F.least("end_raw", F.lit(1440.0)))


def with_day_type(stays: DataFrame, calendar: DataFrame) -> DataFrame:
    """Adds ``day_type``; a date that the calendar lacks stops the job."""
    days = F.broadcast(calendar.select("date", "day_type"))
    out = stays.join(days, "date", "left")
    known = F.when(F.col("day_type").isNull(), F.raise_error(F.concat(F.lit("no day type for "), F.col("date").cast("string")))).otherwise(F.col("day_type"))
    return out.withColumn("day_type", known)


def target_day_types(dates: DataFrame, calendar: DataFrame, training: DataFrame) -> DataFrame:
    """``(date, day_type)`` of target dates; a holiday counts as a weekend if the training days have no holiday."""
    seen = training.agg(F.coalesce(F.bool_or(F.col("day_type") == "holiday"), F.lit(False)).alias("seen"))
    rows = dates.select("date").distinct().join(F.broadcast(calendar), "date").join(F.broadcast(seen))
    return rows.select("date", F.when((F.col("day_type") == "holiday") & ~F.col("seen"), "weekend").otherwise(F.col("day_type")).alias("day_type"))


def merge_fragments(stays: DataFrame, max_gap_min: float | None = None) -> DataFrame:
    """Joins consecutive stays of a user-day in exactly the same place: first start, last end, ``merged`` count.

    ``stays(user_id, date, seq, start_min, end_min, lng, lat)``; order is start, then seq.
    """
    w = Window.partitionBy("user_id", "date").orderBy("start_min", "seq")
    same = (F.lag("lng").over(w) == F.col("lng")) & (F.lag("lat").over(w) == F.col("lat"))
    if max_gap_min is not None:
        same = same & (F.col("start_min") - F.lag("end_min").over(w) <= max_gap_min)
    rows = stays.withColumn("new", (~F.coalesce(same, F.lit(False))).cast("int")).withColumn("island", F.sum("new").over(w))
    order = F.struct("start_min", "seq")
    return rows.groupBy("user_id", "date", "island").agg(F.min("seq").alias("seq"), F.min("start_min").alias("start_min"), F.max_by("end_min", order).alias("end_min"), F.first("lng").alias("lng"), F.first("lat").alias("lat"), (F.count("*") - 1).alias("merged")).drop("island")


def number_in_day(stays: DataFrame) -> DataFrame:
    """Adds ``nth``, the place of a stay in its user-day."""
    return stays.withColumn("nth", F.row_number().over(Window.partitionBy("user_id", "date").orderBy("start_min", "seq")))
