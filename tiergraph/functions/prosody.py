"""Pitch targets and tone labels of fundamental-frequency contours, with numpy, and as pandas UDFs.

A contour is an array of Hz in frames of 10 ms, 0 where there is no voice. Around each frame a parabola is fitted to
the values that don't lie far below it; its vertex is a candidate. Candidates are parted where neighbours differ, each
part is averaged without its outliers, and the ends are extended. Tones are chosen against a key and a range; all keys
and ranges of the grid are tried side by side as arrays.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Frame length, voice threshold and limits in Hz, and how far inside the outer targets may stand.
FRAME_MS = 10.0
VOICED = 50.0
LOW, HIGH, HIGHEST_TARGET = 60.0, 600.0, 750.0
GLITCH = 1.05
EDGE_FRAMES = 4
LEAST_VARIANCE = 0.1
#: The pause in frames after which only three tones are possible, and the grid.
PAUSE_FRAMES = 50.0
RANGES = np.arange(0.5, 2.5, 0.1)
KEY_SPAN = 50
#: How far a tone goes from the last target to the top (T, H, U) or bottom (B, L, D) of the range.
SHARES = {"S": (0.0, 0.0), "T": (1.0, 0.0), "B": (0.0, 1.0), "H": (0.5, 0.0), "L": (0.0, 0.5), "U": (0.25, 0.0), "D": (0.0, 0.25)}


def smooth(f0: np.ndarray) -> np.ndarray:
    """Zero where a value is over GLITCH times both its neighbours."""
    out = f0.copy()
    if len(f0) > 2:
        out[1:-1][(f0[1:-1] > GLITCH * f0[:-2]) & (f0[1:-1] > GLITCH * f0[2:])] = 0.0
    return out


def candidates(f0: np.ndarray, window: int = 30, error: float = 1.04, low: float = LOW, high: float = HIGHEST_TARGET) -> np.ndarray:
    """Rows (frame, Hz) of vertices in reach of their frame and between low and high."""
    found = []
    for k in range(len(f0)):
        at = np.arange(max(0, k - window // 2), min(len(f0), k - window // 2 + window + 1))
        y, x = f0[at], (at - k).astype(float)
        use, over, before, curve = y > VOICED, 0, -1, None
        while over > before:
            before, curve = over, None
            if use.sum() < 3:
                break
            curve = np.polyfit(x[use], y[use], 2)
            far = (y == 0) | (np.polyval(curve, x) > error * y)
            use, over = use & ~far, int(far.sum())
        if curve is not None and curve[0] != 0:
            vertex = -curve[1] / (2 * curve[0])
            value = np.polyval(curve, vertex)
            if abs(vertex) < window and low < value < high:
                found.append((k + vertex, value))
    return np.array(found).reshape(-1, 2)


def _parts(rows: np.ndarray, half: int) -> list[int]:
    """Where candidates in order of time are parted: at the peak of each stretch of large differences."""
    n = len(rows)
    total = np.vstack((np.zeros(2), np.cumsum(rows, axis=0)))
    here = np.arange(n - 1)
    a, b = np.maximum(0, here - half), np.minimum(n, here + half + 1)
    left = (total[here + 1] - total[a]) / (here + 1 - a)[:, None]
    right = (total[b] - total[here + 1]) / (b - here - 1)[:, None]
    apart = np.abs(left - right)
    sums = apart[apart[:, 0] > 0].sum(axis=0)
    if not sums.all():
        return []
    scale = (apart[:, 0] > 0).sum() / sums
    distance = np.where(apart[:, 0] > 0, apart @ scale / scale.sum(), -1.0)
    limit = 2.0 / scale.sum()
    cuts, peak = [], None
    for k, d in enumerate(distance):
        if peak is None:
            peak = k if d > limit else None
        else:
            peak = k if d > distance[peak] else peak
            if d < limit:
                cuts.append(peak)
                peak = None
    return cuts + ([peak] if peak is not None else [])


def reduce_targets(rows: np.ndarray, window: int = 20, distance: float = 5.0, ratio: float = 0.05) -> np.ndarray:
    """Means of the parts without their outliers; near ones are joined, or the later left out if its pitch differs."""
    rows = rows[np.argsort(rows[:, 0], kind="stable")]
    if len(rows) < 2:
        return rows
    apart = _parts(rows, window // 2)
    if not apart and not np.ptp(rows, axis=0).all():
        return rows[:1]
    means = []
    for part in np.split(rows, apart):
        if len(part) > 1:
            spread = np.sqrt(np.maximum(LEAST_VARIANCE, part.var(axis=0)))
            near = (np.abs(part - part.mean(axis=0)) <= spread).all(axis=1)
            part = part[near] if near.any() else part
        if len(part):
            means.append(part.mean(axis=0))
    out = means[:1]
    for row in means[1:]:
        if row[0] - out[-1][0] >= distance:
            out.append(row)
        elif abs(row[1] - out[-1][1]) / out[-1][1] < ratio:
            out[-1] = (out[-1] + row) / 2
    return np.array(out)


def extend(targets: np.ndarray, f0: np.ndarray) -> np.ndarray:
    """Targets mirrored over the first and last voiced frames, on parabolas whose vertices are the outer targets."""
    voiced = np.flatnonzero(f0 >= VOICED)
    if not len(targets):
        return targets
    first, last = (voiced[0], voiced[-1]) if len(voiced) else (0, len(f0) - 1)
    out = [targets]
    for row, edge, side in ((targets[0], float(first), -1), (targets[-1], float(last), 1)):
        if side * (edge - row[0]) <= EDGE_FRAMES:
            continue
        start = int(row[0])
        y = f0[start::-1] if side < 0 else f0[start:]
        squares = np.arange(len(y), dtype=float) ** 2
        use = y > VOICED
        weight = (squares[use] ** 2).sum()
        if weight:
            bend = (squares[use] * (y[use] - row[1])).sum() / weight
            reach = row[0] - edge
            new = np.array([[edge - reach, row[1] + 2 * bend * reach**2]])
            out = [new, *out] if side < 0 else [*out, new]
    return np.vstack(out)


def pitch_targets(f0, keep_unvoiced: bool = False, window: int = 30, error: float = 1.04, low: float = LOW, high: float = HIGHEST_TARGET) -> list[tuple[float, float]]:
    """(frame, Hz) of a contour's targets. Frames without voice are lifted to LOW like other values, unless keep_unvoiced."""
    raw = np.nan_to_num(np.asarray(f0, float))
    if not len(raw):
        return []
    lifted = np.clip(raw, LOW, HIGH)
    y = smooth(np.where(raw > 0, lifted, 0.0) if keep_unvoiced else lifted)
    return [(float(t), float(hz)) for t, hz in extend(reduce_targets(candidates(y, window, error, low, high)), y)]


def tones(targets: list[tuple[float, float]]) -> dict:
    """Tones of targets (frame, Hz), with the range in octaves and the key in Hz that miss them least."""
    targets = [(t, hz) for t, hz in targets if hz > 0]
    if not targets:
        return {"targets": [], "range": 0.0, "key": 0.0}
    octaves = np.log2([hz for _, hz in targets])
    center = round(float(2 ** octaves.mean()))
    keys = np.arange(center - KEY_SPAN, center + KEY_SPAN + 1)
    span, key = (x.ravel() for x in np.meshgrid(RANGES, keys, indexing="ij"))
    mid = np.where(key > 0, np.log2(np.maximum(key, 1)), 0.0)
    top, bottom = mid + span / 2, mid - span / 2
    names = list(SHARES)
    last, miss = np.zeros(len(mid)), np.zeros(len(mid))
    chosen, made, before = [], [], None
    for (time, _), y in zip(targets, octaves, strict=True):
        if before is None or time - before > PAUSE_FRAMES:
            off = np.abs(y - mid)
            tone = np.where(top - y < off, "T", np.where(y - bottom < off, "B", "M"))
            value = np.where(tone == "T", top, np.where(tone == "B", bottom, mid))
        else:
            tried = np.array([np.where(up == 1, top, np.where(down == 1, bottom, last + up * (top - last) - down * (last - bottom))) for up, down in SHARES.values()])
            best = np.abs(y - tried).argmin(axis=0)
            tone, value = np.array(names)[best], tried[best, np.arange(len(mid))]
        chosen.append(tone)
        made.append(value)
        miss += (value - y) ** 2
        last, before = value, time
    at = int(miss.argmin())
    rows = [{"time": t * FRAME_MS / 1000, "tone": str(x[at]), "target": float(hz), "estimate": float(2 ** e[at])} for (t, hz), x, e in zip(targets, chosen, made, strict=True)]
    return {"targets": rows, "range": float(span[at]), "key": float(2 ** mid[at])}


def momel(f0) -> Column:
    """Pitch targets of an array column."""

    @F.pandas_udf("array<struct<time:double,freq:double>>")
    def targets(f0: pd.Series) -> pd.Series:
        return f0.map(lambda x: [{"time": t, "freq": y} for t, y in pitch_targets(x)] if x is not None else [])

    return targets(f0)


def intsint(f0) -> Column:
    """Tones, range and key of an array column."""

    @F.pandas_udf("struct<targets:array<struct<time:double,tone:string,target:double,estimate:double>>,range:double,key:double>")
    def coded(f0: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([tones(pitch_targets(x) if x is not None else []) for x in f0], columns=["targets", "range", "key"])

    return coded(f0)
