"""Points in regions by an adaptive polygon coverage.

Each polygon is covered by square lon/lat cells of several sizes. Cells wholly inside
are kept whole; cells that an edge crosses are split until they are small against the
polygon and then carry only the edges that matter to them. A point meets the coverage
by an equi-join on cell keys: an interior cell accepts it at once, a boundary cell
counts edge crossings exactly.

Defined results: a point is in a polygon when a ray from it crosses the rings an odd
number of times (holes are outside, ring direction is irrelevant); with ``on_edge`` also
when it lies on a ring; a MultiPolygon is all of its polygons; polygons that cannot
be read, and points with a null or impossible coordinate, match nothing; repeated
points each match; an empty side gives an empty result.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wakeline.functions import geo
from wakeline.workspace import cut

LEVELS = (2, 4, 6, 8, 10, 12, 14, 16, 18, 20)
COVER = "region_id long, level int, cell long, interior boolean, edges array<struct<x1:double,y1:double,x2:double,y2:double>>"
#: A coverage of at most so many bytes is broadcast, at about 100 a cell and 40 an edge.
BROADCAST_BYTES = 64_000_000
#: Cells with more edges are split further.
MOST_EDGES = 64
SALTS = 16


def cell_key(lon: Column, lat: Column, level: Column) -> Column:
    """Key of the cell of size 360 / 2**level degrees that holds a point."""
    per_degree = F.pow(F.lit(2.0), level) / 360.0
    ix, iy = F.floor((lon + 180.0) * per_degree), F.floor((lat + 90.0) * per_degree)
    return F.shiftleft(level.cast("long"), 56).bitwiseOR(F.shiftleft(ix, 28)).bitwiseOR(iy)


def _touched(edges: np.ndarray, boxes: np.ndarray) -> np.ndarray:
    """boxes x edges: which edges meet which closed boxes, by clipping the segment parameter."""
    ax, ay, bx, by = edges.T
    x0, y0, x1, y1 = (c[:, None] for c in boxes.T)
    lo, hi = np.zeros((len(boxes), len(edges))), np.ones((len(boxes), len(edges)))
    with np.errstate(divide="ignore", invalid="ignore"):
        for a, d, low, high in ((ax, bx - ax, x0, x1), (ay, by - ay, y0, y1)):
            t0, t1 = (low - a) / d, (high - a) / d
            flat, off = (d == 0), (a < low) | (a > high)
            lo = np.where(flat, lo, np.maximum(lo, np.minimum(t0, t1)))
            hi = np.where(flat, np.where(off, -1.0, hi), np.minimum(hi, np.maximum(t0, t1)))
    return lo <= hi


def _holds(edges: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which points lie inside, by crossings of a ray to the right."""
    ax, ay, bx, by = edges.T
    x, y = x[:, None], y[:, None]
    with np.errstate(divide="ignore", invalid="ignore"):
        return (((ay > y) != (by > y)) & (x < (bx - ax) * (y - ay) / (by - ay) + ax)).sum(1) % 2 == 1


def cover_polygon(geojson: str | None, split: int = 8) -> list[tuple[int, int, bool, np.ndarray]]:
    """(level, cell, interior, edges) rows of one polygon; none if it cannot be read.

    Cells that an edge meets are split until they are at most 1/``split`` of the polygon and
    carry at most ``MOST_EDGES`` edges, or are the smallest there are."""
    try:
        shape = json.loads(geojson)
        parts = shape["coordinates"] if shape.get("type") == "MultiPolygon" else [shape["coordinates"]]
        rings = [np.asarray(r, float)[:, :2] for part in parts for r in part]
        edges = np.concatenate([np.hstack([r[:-1], r[1:]]) for r in rings])
    except (TypeError, ValueError, KeyError, IndexError, AttributeError):
        return []
    if not len(edges) or not np.isfinite(edges).all():
        return []
    (x0, y0), (x1, y1) = edges.reshape(-1, 2).min(0), edges.reshape(-1, 2).max(0)
    extent = max(x1 - x0, y1 - y0, 1e-9)
    first = max([i for i, v in enumerate(LEVELS) if 360 / 2**v >= extent], default=0)
    last = min([i for i, v in enumerate(LEVELS) if 360 / 2**v <= extent / split], default=len(LEVELS) - 1)
    size = 360 / 2 ** LEVELS[first]
    ix, iy = (m.ravel() for m in np.meshgrid(np.arange((x0 + 180) // size, (x1 + 180) // size + 1), np.arange((y0 + 90) // size, (y1 + 90) // size + 1)))
    ix, iy = ix.astype(np.int64), iy.astype(np.int64)
    rows = []
    for i in range(first, len(LEVELS)):
        level, size = LEVELS[i], 360 / 2 ** LEVELS[i]
        pad = size * 1e-9
        kept = []
        for at in range(0, len(ix), max(1, 2_000_000 // len(edges))):
            cx, cy = ix[at : at + max(1, 2_000_000 // len(edges))], iy[at : at + max(1, 2_000_000 // len(edges))]
            low_x, low_y = cx * size - 180, cy * size - 90
            touched = _touched(edges, np.stack([low_x - pad, low_y - pad, low_x + size + pad, low_y + size + pad], axis=1))
            some = touched.any(1)
            inner = np.flatnonzero(~some)[_holds(edges, low_x[~some] + size / 2, low_y[~some] + size / 2)]
            rows += [(level, (level << 56) | (int(a) << 28) | int(b), True, edges[:0]) for a, b in zip(cx[inner], cy[inner])]
            if i < last:
                kept.append((cx[some], cy[some]))
                continue
            ys, right = np.sort(edges[:, [1, 3]], axis=1), edges[:, [0, 2]].max(1)
            for k in np.flatnonzero(some):
                # what a ray to the right from within the cell can cross
                matter = (ys[:, 1] >= low_y[k] - pad) & (ys[:, 0] <= low_y[k] + size + pad) & (right >= low_x[k] - pad)
                if matter.sum() > MOST_EDGES and i + 1 < len(LEVELS):
                    kept.append((cx[k : k + 1], cy[k : k + 1]))
                    continue
                rows.append((level, (level << 56) | (int(cx[k]) << 28) | int(cy[k]), False, edges[matter]))
        if not kept:
            break
        if i + 1 < len(LEVELS):
            n = 2 ** (LEVELS[i + 1] - level)
            cx, cy = (np.concatenate(c) for c in zip(*kept))
            steps = np.arange(n)
            ix = (cx[:, None, None] * n + steps[None, :, None] + 0 * steps[None, None, :]).ravel()
            iy = (cy[:, None, None] * n + steps[None, None, :] + 0 * steps[None, :, None]).ravel()
    return rows


def coverage(regions: DataFrame, region_id: str = "id", polygon: str = "polygon") -> DataFrame:
    """The cells of every region; built per region on the executors."""

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["x1", "y1", "x2", "y2"]
        for pdf in batches:
            out = [
                (rid, level, key, interior, [dict(zip(names, map(float, e))) for e in kept])
                for rid, text in zip(pdf["region_id"], pdf["polygon"])
                for level, key, interior, kept in cover_polygon(text)
            ]
            yield pd.DataFrame(out, columns=["region_id", "level", "cell", "interior", "edges"])

    return (
        regions.select(F.col(region_id).cast("long").alias("region_id"), F.col(polygon).alias("polygon"))
        .where("region_id is not null and polygon is not null")
        .repartition(32, "region_id")  # regions are few and dear, more tasks than data would ask for
        .mapInPandas(build, COVER)
    )


def containing(points: DataFrame, cover: DataFrame, key: str, lon: str = "lon", lat: str = "lat", *, on_edge: bool = False) -> DataFrame:
    """(``key``, region_id) for every point and region that contains it.

    ``cover`` must be materialised (``cut``). Up to ``BROADCAST_BYTES`` it is
    broadcast, and points never move; beyond that both sides are shuffled by cell with
    a salt, so that a harbour with a third of all points is spread over tasks."""
    size, levels = cover.agg(F.coalesce(F.sum(100 + 40 * F.size("edges")), F.lit(0)), F.sort_array(F.collect_set("level"))).first()
    valid = points.select(F.col(key), F.col(lon).alias("lon"), F.col(lat).alias("lat")).where(
        "abs(lat) <= 90 and abs(lon) <= 180"
    )
    levels = levels or [LEVELS[0]]  # at most len(LEVELS) values
    keyed = valid.select(
        "*", F.explode(F.array(*[cell_key(F.col("lon"), F.col("lat"), F.lit(v)) for v in levels])).alias("cell")
    )
    if size <= BROADCAST_BYTES:
        met = keyed.join(F.broadcast(cover), "cell")
    else:
        salted = keyed.withColumn("salt", F.pmod(F.xxhash64(key), F.lit(SALTS).cast("long")))
        met = salted.join(
            cover.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))), ["cell", "salt"]
        )
    return met.where(F.when(F.col("interior"), True).otherwise(geo.inside(F.col("lon"), F.col("lat"), F.col("edges"), on_edge))).select(
        key, "region_id"
    )


def positions_in_regions(positions: DataFrame, regions: DataFrame, key: str = "position_id") -> DataFrame:
    """(position_id, region_id) over all active regions."""
    return containing(positions, cut(coverage(regions.where("active"))), key)
