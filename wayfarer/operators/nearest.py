"""Nearest places by a packed index: tiles of places sorted by strips, and the envelopes of all tiles in every task."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.graph import join_skewed
from ..sources.readers import counted, stored

#: Places of a tile, unless that made more tiles than tasks should know of (some 40 bytes each).
TILE, MOST_TILES = 1024, 100_000
#: Spots that are searched together in a tile, and that are sent on their way together.
BLOCK, TOGETHER = 1024, 20_000
_TILE = pa.schema([("tile", pa.int64()), ("south", pa.float64()), ("west", pa.float64()), ("north", pa.float64()), ("east", pa.float64()), ("places", pa.binary())])


def pack_tiles(places: DataFrame, n: int, tile: int = TILE, most: int = MOST_TILES) -> DataFrame:
    """``(tile, south, west, north, east, places)`` of the ``n`` distinct places of ``places(k_lat, k_lng)``.

    Ranges of longitude are strips, as many as a strip has tiles; each is sorted by latitude and cut into tiles as it streams by.
    """
    size = max(tile, -(-n // most))
    strips = max(1, math.isqrt(max(1, n // size)))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, parts, held = TaskContext.get().partitionId() << 32, [], 0

        def one(p: np.ndarray) -> dict:
            return {"tile": number, "south": p[0].min(), "west": p[1].min(), "north": p[0].max(), "east": p[1].max(), "places": np.ascontiguousarray(p).tobytes()}

        for batch in batches:
            parts.append(np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()]))
            held += batch.num_rows
            while held >= size:
                p = np.concatenate(parts, axis=1)
                parts, held = [p[:, size:]], held - size
                yield pa.RecordBatch.from_pylist([one(p[:, :size])], _TILE)
                number += 1
        if held:
            yield pa.RecordBatch.from_pylist([one(np.concatenate(parts, axis=1))], _TILE)

    rows = places.select("k_lat", "k_lng").repartitionByRange(strips, "k_lng").sortWithinPartitions("k_lat", "k_lng")
    return stored(rows.mapInArrow(cut, "tile long, south double, west double, north double, east double, places binary"))


class Envelopes:
    """A tree of two levels over tiles: strips, and the tiles of each. All distances are squares of degrees."""

    def __init__(self, tiles: np.ndarray, boxes: np.ndarray) -> None:
        order = np.argsort(tiles)
        self.tiles, self.boxes = tiles[order], boxes[:, order]
        strip = self.tiles >> 32
        self.first = np.flatnonzero(np.diff(strip, prepend=-1))
        self.size = np.diff(self.first, append=len(strip))
        low, high = (np.stack([f.reduceat(self.boxes[i], self.first) for i in at]) for f, at in ((np.minimum, (0, 1)), (np.maximum, (2, 3))))
        self.strips = np.concatenate([low, high])

    @staticmethod
    def _least(p: np.ndarray, box: np.ndarray) -> np.ndarray:
        """Distance to the nearest point that a box could hold."""
        d = np.maximum(0, np.maximum(box[:2] - p, p - box[2:]))
        return (d * d).sum(axis=0)

    @staticmethod
    def _sure(p: np.ndarray, box: np.ndarray) -> np.ndarray:
        """Distance within which a box surely holds a place, as each of its sides touches one."""
        low, high = np.abs(p - box[:2]), np.abs(p - box[2:])
        near, far = np.minimum(low, high) ** 2, np.maximum(low, high) ** 2
        return np.minimum(near[0] + far[1], near[1] + far[0])

    def visits(self, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which tiles may hold the nearest place of which spot of ``p`` (lat, lng): spots and tiles, in pairs."""
        spots, slack, out = np.arange(p.shape[1]), 1 + 1e-9, []
        for at in range(0, p.shape[1], 4096):
            own = p[:, at : at + 4096]
            least = self._least(own[:, :, None], self.strips[:, None, :])
            within = self._sure(own[:, :, None], self.strips[:, None, :]).min(axis=1)
            spot, strip = np.nonzero(least <= within[:, None] * slack + 1e-18)
            size = self.size[strip]
            tile = np.arange(size.sum()) + np.repeat(self.first[strip] - np.cumsum(size) + size, size)
            spot = np.repeat(spot, size)
            q, box = own[:, spot], self.boxes[:, tile]
            np.minimum.at(within, spot, self._sure(q, box))
            keep = self._least(q, box) <= within[spot] * slack + 1e-18
            out.append((spots[at : at + 4096][spot[keep]], tile[keep]))
        return np.concatenate([o[0] for o in out]), self.tiles[np.concatenate([o[1] for o in out])]


def nearest_places(spots: DataFrame, tiles: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """``(lat, lng, n, k_lat, k_lng)``: for each row of ``spots(lat, lng, n)`` the places of ``tiles`` that no other one in the same
    tile is nearer than, by more than ``tolerance`` squares of degrees. The nearest of all is among them, and so are its ties.

    Spots go to the tiles whose envelopes allow for their nearest place, mostly one, in blocks; tiles with many blocks are
    dealt over several tasks.
    """
    known = tiles.select("tile", "south", "west", "north", "east").toArrow()
    schema = "lat double, lng double, n long, k_lat double, k_lng double"
    if not known.num_rows:
        return spots.sparkSession.createDataFrame([], schema)
    tree = Envelopes(known["tile"].to_numpy(), np.stack([known[c].to_numpy() for c in ("south", "west", "north", "east")]))
    shared = spots.sparkSession.sparkContext.broadcast(tree)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0

        def send() -> pa.RecordBatch:
            p = np.concatenate(parts, axis=1)
            spot, tile = shared.value.visits(p[:2])
            order = np.argsort(tile, kind="stable")
            spot, tile = spot[order], tile[order]
            edges = [0, *(np.flatnonzero(np.diff(tile)) + 1).tolist(), len(tile)] if len(tile) else [0]
            cuts = [(lo, min(hi, lo + BLOCK)) for a, hi in zip(edges[:-1], edges[1:], strict=True) for lo in range(a, hi, BLOCK)]
            blocks = [np.ascontiguousarray(p[:, spot[lo:hi]]).tobytes() for lo, hi in cuts]
            return pa.RecordBatch.from_arrays([pa.array([int(tile[lo]) for lo, _ in cuts], pa.int64()), pa.array([int(spot[lo]) for lo, _ in cuts], pa.int64()), pa.array(blocks, pa.binary())], ["tile", "block", "spots"])

        for batch in batches:
            parts.append(np.stack([batch.column(i).to_numpy() for i in range(3)]).astype(float))
            held += batch.num_rows
            if held >= TOGETHER:
                yield send()
                parts, held = [], 0
        if held:
            yield send()

    visits, total = counted(spots.select("lat", "lng", "n").mapInArrow(route, "tile long, block long, spots binary"))
    uses = visits.groupBy("tile").agg(F.count("*").alias("m"))
    rows = join_skewed(visits, tiles.select("tile", "places").join(uses, "tile"), ["tile"], "m", total, "block")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for packed, places in zip(batch.column(0), batch.column(1), strict=True):
                p, k = np.frombuffer(packed.as_buffer(), float).reshape(3, -1), np.frombuffer(places.as_buffer(), float).reshape(2, -1)
                for at in range(0, p.shape[1], max(1, 1_000_000 // k.shape[1])):
                    own = p[:, at : at + max(1, 1_000_000 // k.shape[1])]
                    y, x = own[0][:, None] - k[0][None], own[1][:, None] - k[1][None]
                    d2 = y * y + x * x
                    spot, place = np.nonzero(d2 <= d2.min(axis=1, keepdims=True) + tolerance)
                    yield pa.RecordBatch.from_arrays([pa.array(own[0][spot]), pa.array(own[1][spot]), pa.array(own[2][spot].astype(np.int64)), pa.array(k[0][place]), pa.array(k[1][place])], ["lat", "lng", "n", "k_lat", "k_lng"])

    return rows.select("spots", "places").mapInArrow(search, schema)
