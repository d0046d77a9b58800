"""Stays as a stream: late data, days that close, totals per user and day."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

_MERGED = "user_id string, lng double, lat double, t_in long, t_out long, merged long"
_STATE = "lng double, lat double, t_in long, t_out long, merged long"


def daily_totals(stays: DataFrame, late: str = "1 day") -> DataFrame:
    """``(day, user_id, stays, minutes)`` of a stream ``stays(user_id, at timestamp, minutes)``; a day is given out once it can't change."""
    rows = stays.withWatermark("at", late)
    out = rows.groupBy(F.window("at", "1 day").alias("w"), "user_id").agg(F.count("*").alias("stays"), F.sum("minutes").alias("minutes"))
    return out.select(F.col("w.start").cast("date").alias("day"), "user_id", "stays", "minutes")


def merged_fragments(stays: DataFrame, late: str = "1 day") -> DataFrame:
    """Consecutive stays of a user in one place as one, of a stream ``stays(user_id, at, lng, lat, t_in, t_out)``.

    A user's open stay is state; it is given out when another place follows, or when the watermark passes
    its end by a day. Stays come in order within a batch; what comes later than the watermark is dropped.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        done: list[tuple] = []
        now = state.get if state.exists else None
        if state.hasTimedOut:
            done.append(now)
            state.remove()
        else:
            for pdf in frames:
                for r in pdf.sort_values(["t_in", "t_out"]).itertuples():
                    if now and (now[0], now[1]) == (r.lng, r.lat):
                        now = (now[0], now[1], now[2], max(now[3], int(r.t_out)), now[4] + 1)
                    else:
                        if now:
                            done.append(now)
                        now = (float(r.lng), float(r.lat), int(r.t_in), int(r.t_out), 0)
            if now:
                state.update(now)
                state.setTimeoutTimestamp(max((now[3] + 86400) * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame([(key[0], *d) for d in done], columns=["user_id", "lng", "lat", "t_in", "t_out", "merged"])

    return stays.withWatermark("at", late).groupBy("user_id").applyInPandasWithState(run, _MERGED, _STATE, "append", GroupStateTimeout.EventTimeTimeout)
