"""Tracks smoothed offline: a Kalman pass forward and a Rauch-Tung-Striebel pass back, or a refusal.

A box is its centre and size, each moving with its own velocity under random acceleration; the noises of the two
centre channels are one, as are those of the two sizes, so each channel is a filter of two states, and they share only
the gate. A box too surprising for all four together counts as a bad detection, with its noise inflated. The strength of
the acceleration is the track's own median, within bounds.

A track is refused, its boxes given back as they are, when many of its steps leave the box before and many turn back on
the step before: that is more than one object under one id. Tracks of fewer than three boxes are given back too. Passes
are sequential, so a track is whole in one task; the tracks of a task are passed side by side, in blocks of about `BLOCK`
rows (a longer track is a block of its own). Rows with a null track, time or corner are given back unsmoothed; of equal times
the order is that of the corners, and then of the other columns.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, VariantType

# Fixed values of the model: noise of acceleration and of measurements (pixels) for centre and size, the 99.9 % point of
# chi-square with four degrees of freedom, how a gated measurement's variance grows, bounds of the acceleration.
ACCELERATION = (4.0, 2.0)
MEASURED = (3.0, 4.0)
GATE = 18.467
INFLATE = 25.0
BOUNDS = (4.0, 4000.0)
# Fixed values of the refusal: shares of steps without overlap and of steps that turn back.
APART = 0.25
TURNS = 0.4
LEAST_STEP_S = 1e-3
BLOCK = 50_000
CHANNEL = np.array([0, 0, 1, 1])


def centre_size(boxes: np.ndarray) -> np.ndarray:
    x1, y1, x2, y2 = boxes.T
    return np.stack([(x1 + x2) / 2, (y1 + y2) / 2, np.abs(x2 - x1), np.abs(y2 - y1)], axis=1)


def incoherent(boxes: np.ndarray) -> bool:
    """Whether the boxes in order of time look like several objects."""
    if len(boxes) < 3:
        return False
    a, b = boxes[:-1], boxes[1:]
    both = np.clip(np.minimum(a[:, 2:], b[:, 2:]) - np.maximum(a[:, :2], b[:, :2]), 0, None).prod(axis=1)
    steps = np.diff(centre_size(boxes)[:, :2], axis=0)
    size = np.linalg.norm(steps, axis=1)
    sizes = size[1:] * size[:-1]
    turn = np.where(sizes > 1e-9, (steps[1:] * steps[:-1]).sum(axis=1) / np.where(sizes > 1e-9, sizes, 1), 0)
    return bool((both <= 0).mean() > APART and (turn < -0.5).mean() > TURNS)


def accelerations(z: np.ndarray, dt: np.ndarray) -> np.ndarray:
    """For centre and size, the median size of the second differences, within bounds."""
    a = np.abs(np.diff(np.diff(z, axis=0) / dt[:, None], axis=0) / dt[1:, None])
    return np.array([np.clip(np.median(a[:, CHANNEL == k]), max(ACCELERATION[k], BOUNDS[0]), BOUNDS[1]) for k in (0, 1)])


def smoothed_together(z: np.ndarray, dt: np.ndarray, q: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Smoothed centre and size, standard deviation of the centre, gated, of tracks that are passed side by side.

    The tracks, longest first, lie in steps: z[k, i] is the k-th box of track i, dt[k, i] the time to its next, q the
    square of each channel's acceleration. Each step works on the tracks that are as long."""
    steps, tracks = z.shape[:2]
    live = np.searchsorted(-lengths, -np.arange(steps), side="left")  # tracks of more than k boxes
    r = (np.array(MEASURED) ** 2)[CHANNEL]
    # one by one: NumPy's powers of arrays differ from those of numbers in the last bit, which long gaps in time blow up
    square, cube, fourth = (np.array([x**e for x in dt.ravel().tolist()]).reshape(dt.shape) for e in (2, 3, 4))
    # of each channel: position and velocity, and the three different entries of their covariance
    x, v = z[0].copy(), (z[1] - z[0]) / dt[0][:, None]
    pp, pv, vv = np.full((tracks, 4), 1e3), np.zeros((tracks, 4)), np.full((tracks, 4), 1e3)
    ahead, after, gated = [], [], np.zeros((steps, tracks), bool)
    for k in range(steps):
        m = live[k]
        x, v, pp, pv, vv = x[:m], v[:m], pp[:m], pv[:m], vv[:m]
        if k:
            (t, t2, t3, t4), a = (x[k - 1, :m, None] for x in (dt, square, cube, fourth)), q[:m]
            x, pp, pv, vv = x + t * v, pp + 2 * t * pv + t * t * vv + a * t4 / 4, pv + t * vv + a * t3 / 2, vv + a * t2
        ahead.append((x, v, pp, pv, vv))
        off = z[k, :m] - x
        if k:
            gated[k, :m] = (off**2 / (pp + r)).sum(axis=1) > GATE
        noise = np.where(gated[k, :m, None], r * INFLATE, r)
        gain, drag = pp / (pp + noise), pv / (pp + noise)
        x, v, pp, pv, vv = x + gain * off, v + drag * off, (1 - gain) * pp, (1 - gain) * pv, vv - drag * pv
        after.append((x, v, pp, pv, vv))
    out, std = np.empty((steps, tracks, 4)), np.empty((steps, tracks))
    for k in range(steps - 1, -1, -1):
        fx, fv, fpp, fpv, fvv = after[k]
        n = live[k + 1] if k < steps - 1 else 0  # tracks that go on; the others begin their way back here
        if n:
            t, (ax, av, app, apv, avv) = dt[k, :n, None], ahead[k + 1]
            # the gain of looking back: covariance with the next state, times the inverse of what was expected of it
            gpp, gpv, gvv = fpp[:n], fpv[:n], fvv[:n]
            a, b, c, d = gpp + t * gpv, gpv, gpv + t * gvv, gvv
            det = app * avv - apv**2
            det = np.where(det == 0, 1, det)
            g = (a * avv - b * apv) / det, (b * app - a * apv) / det, (c * avv - d * apv) / det, (d * app - c * apv) / det
            dx, dv, epp, epv, evv = x - ax, v - av, pp - app, pv - apv, vv - avv
            x, v = fx[:n] + g[0] * dx + g[1] * dv, fv[:n] + g[2] * dx + g[3] * dv
            m = g[0] * epp + g[1] * epv, g[0] * epv + g[1] * evv, g[2] * epp + g[3] * epv, g[2] * epv + g[3] * evv
            pp, pv, vv = gpp + m[0] * g[0] + m[1] * g[1], gpv + m[0] * g[2] + m[1] * g[3], gvv + m[2] * g[2] + m[3] * g[3]
            x, v, pp, pv, vv = (np.concatenate([back, start[n:]]) for back, start in zip((x, v, pp, pv, vv), after[k], strict=True))
        else:
            x, v, pp, pv, vv = after[k]
        out[k, : live[k]], std[k, : live[k]] = x, np.sqrt(np.maximum(pp[:, :2], 0).mean(axis=1))
    return out, std, gated


def smoothed(boxes: np.ndarray, seconds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Smoothed centre and size, standard deviation of the centre, gated, of one track: three boxes or more in order of time."""
    return smoothed_block(boxes, seconds, np.array([0]), np.array([len(boxes)]))


def smoothed_block(boxes: np.ndarray, seconds: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same of several tracks, which lie one after another in the rows; rows of none are left at nought."""
    z, n = centre_size(boxes), len(boxes)
    out, std, gated = np.zeros((n, 4)), np.zeros(n), np.zeros(n, bool)
    by = np.argsort(-lengths, kind="stable")
    a = 0
    while a < len(by):
        # tracks of like length go together: of a group's places for boxes at least half are filled
        b = a + int(np.searchsorted(-lengths[by[a:]], -(lengths[by[a]] // 2), side="left"))
        b = max(b, a + 1)
        some, sizes = starts[by[a:b]], lengths[by[a:b]]
        step = np.arange(sizes[0])[:, None]
        filled = step < sizes[None, :]
        place = some[None, :] + np.minimum(step, sizes[None, :] - 1)
        dt = np.maximum(np.diff(seconds[place], axis=0), LEAST_STEP_S)
        q = np.stack([(accelerations(z[i : i + m], np.maximum(np.diff(seconds[i : i + m]), LEAST_STEP_S)) ** 2)[CHANNEL] for i, m in zip(some.tolist(), sizes.tolist(), strict=True)])
        found = smoothed_together(z[place], dt, q, sizes)
        for whole, part in zip((out, std, gated), found, strict=True):
            whole[place[filled]] = part[filled]
        a = b
    return out, std, gated


def new_track(tracks: pd.Series) -> np.ndarray:
    """Whether each row begins a track, of rows in order of tracks; not a number is one track."""
    before = tracks.shift()
    out = (tracks.ne(before) & ~(tracks.isna() & before.isna())).to_numpy(bool)
    out[:1] = True
    return out


def smooth_tracks(df: DataFrame, track: str = "track", t: str = "t") -> DataFrame:
    """Adds sx1, sy1, sx2, sy2, std, gated and smoothed to rows with x1, y1, x2, y2 and a time in seconds."""
    added = "sx1 double, sy1 double, sx2 double, sy2 double, std double, gated boolean, smoothed boolean"
    corners = ["x1", "y1", "x2", "y2"]
    plain = [F.col(c).cast("double").alias(f"s{c}") for c in corners]
    missing = F.col(track).isNull() | F.col(t).isNull()
    for c in corners:
        missing = missing | F.col(c).isNull()
    as_is = df.where(missing).select("*", *plain, F.lit(None).cast("double").alias("std"), F.lit(False).alias("gated"), F.lit(False).alias("smoothed"))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        boxes, seconds = rows[corners].to_numpy(float), rows[t].to_numpy(float)
        starts = np.flatnonzero(new_track(rows[track]))
        lengths = np.diff(np.append(starts, len(rows)))
        good = np.array([m >= 3 and not incoherent(boxes[i : i + m]) for i, m in zip(starts.tolist(), lengths.tolist(), strict=True)], bool)
        z, std, gated = smoothed_block(boxes, seconds, starts[good], lengths[good])
        half, done = np.maximum(z[:, 2:], 0) / 2, np.repeat(good, lengths)
        rows[[f"s{c}" for c in corners]] = np.where(done[:, None], np.hstack([z[:, :2] - half, z[:, :2] + half]), boxes)
        rows["std"], rows["gated"], rows["smoothed"] = np.where(done, std, np.nan), gated, done
        return rows

    def blocks(batches):
        held, n = [], 0
        for rows in batches:
            if not len(rows):
                continue
            held.append(rows)
            n += len(rows)
            last = rows[track].iloc[-1]
            if n >= BLOCK and (held[0][track].iloc[0] != last):
                rows = pd.concat(held, ignore_index=True)
                end = int(np.flatnonzero(new_track(rows[track]))[-1])
                if end:
                    yield run(rows[:end].reset_index(drop=True))
                held, n = [rows[end:]], len(rows) - end
        if held:
            yield run(pd.concat(held, ignore_index=True))

    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    rest = [f.name for f in df.schema if f.name not in (track, t, *corners) and not isinstance(f.dataType, (MapType, VariantType))]
    whole = df.where(~missing).repartition(track).sortWithinPartitions(track, t, *corners, *rest)
    return whole.mapInPandas(blocks, f"{names}, {added}").unionByName(as_is)
