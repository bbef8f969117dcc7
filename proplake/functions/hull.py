"""Convex hulls of places, and their farthest pairs.

Seen from the earth's centre, the hull of nearby places is that of their points on a plane that touches the globe; which plane
does not matter, as great circles are straight on all of them. So hulls of parts can be merged into the hull of the whole, and
the two places of a set that lie furthest apart are corners of its hull that face each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd

from proplake.config import EARTH_RADIUS_M

MOST_HELD = 50_000  # places of one key that a task holds before it keeps their hull alone


def _on_plane(lat: np.ndarray, lng: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Metres east and north of the first place, on the plane that touches the globe there."""
    la, lo = np.radians(lat), np.radians(lng)
    turn = lo - lo[0]
    depth = np.sin(la[0]) * np.sin(la) + np.cos(la[0]) * np.cos(la) * np.cos(turn)
    east = np.cos(la) * np.sin(turn) / depth
    north = (np.cos(la[0]) * np.sin(la) - np.sin(la[0]) * np.cos(la) * np.cos(turn)) / depth
    return east * EARTH_RADIUS_M, north * EARTH_RADIUS_M


def hull(lat: np.ndarray, lng: np.ndarray) -> np.ndarray:
    """Numbers of the places at the corners of the hull, counter-clockwise. All places must be within a quarter of the globe."""
    if len(lat) < 3:
        return np.arange(len(lat))
    x, y = _on_plane(lat, lng)
    order = np.lexsort((y, x)).tolist()
    xs, ys = x.tolist(), y.tolist()

    def chain(places: list[int]) -> list[int]:
        kept: list[int] = []
        for p in places:
            while len(kept) > 1:
                a, b = kept[-2], kept[-1]
                if (xs[b] - xs[a]) * (ys[p] - ys[a]) - (ys[b] - ys[a]) * (xs[p] - xs[a]) > 0:
                    break
                kept.pop()
            kept.append(p)
        return kept[:-1]

    return np.array(chain(order) + chain(order[::-1]))


def _metres(lat: np.ndarray, lng: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    la, lo = np.radians(lat), np.radians(lng)
    h = np.sin((la[b] - la[a]) / 2) ** 2 + np.cos(la[a]) * np.cos(la[b]) * np.sin((lo[b] - lo[a]) / 2) ** 2
    return 2 * EARTH_RADIUS_M * np.arcsin(np.sqrt(np.minimum(1.0, h)))


def farthest_pair(lat: np.ndarray, lng: np.ndarray) -> float:
    """Metres between the two places furthest apart, by calipers round the hull."""
    corners = hull(lat, lng)
    lat, lng, n = lat[corners], lng[corners], len(corners)
    if n < 2:
        return 0.0
    x, y = _on_plane(lat, lng)
    a, b, far = [], [], 1
    for i in range(n):
        j = (i + 1) % n
        height = lambda k: (x[j] - x[i]) * (y[k] - y[i]) - (y[j] - y[i]) * (x[k] - x[i])  # noqa: E731, B023
        while height((far + 1) % n) > height(far):
            far = (far + 1) % n
        for end in (far, (far + 1) % n):  # parallel sides face each other with both ends
            a += [i, j]
            b += [end, end]
    return float(_metres(lat, lng, np.array(a), np.array(b)).max())


def hulls_of_runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of rows (cluster_id, latitude, longitude) that come run by run, the corners of each run's hull."""
    held: pd.DataFrame | None = None

    def corners(rows: pd.DataFrame) -> pd.DataFrame:
        return rows.iloc[hull(rows["latitude"].to_numpy(), rows["longitude"].to_numpy())]

    for batch in batches:
        for key, rows in batch.groupby("cluster_id", sort=False):
            if held is not None and held["cluster_id"].iloc[0] == key:
                held = pd.concat([held, rows])
                if len(held) > MOST_HELD:
                    held = corners(held)
                continue
            if held is not None:
                yield corners(held)
            held = rows
    if held is not None:
        yield corners(held)
