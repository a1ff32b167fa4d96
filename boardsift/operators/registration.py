"""Board coordinates and pixels: projection by a 3x3 matrix, and matrices fitted to points."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column


def projected(m: list[list[float]], x: Column, y: Column) -> tuple[Column, Column]:
    w = m[2][0] * x + m[2][1] * y + m[2][2]
    return (m[0][0] * x + m[0][1] * y + m[0][2]) / w, (m[1][0] * x + m[1][1] * y + m[1][2]) / w


def pixel_scale(m: list[list[float]]) -> float:
    return math.sqrt(abs(m[0][0] * m[1][1] - m[0][1] * m[1][0]))


def angle(m: list[list[float]]) -> float:
    return math.degrees(math.atan2(m[1][0], m[0][0]))


def similarity(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Least-squares turn, scale and shift (Umeyama, 1991, without mirroring)."""
    ms, mt = source.mean(0), target.mean(0)
    s, t = source - ms, target - mt
    a, b = (s * t).sum(), (s[:, 0] * t[:, 1] - s[:, 1] * t[:, 0]).sum()
    n = (s * s).sum()
    c, d = (a / n, b / n) if n else (1.0, 0.0)
    m = np.array([[c, -d, 0], [d, c, 0], [0, 0, 1.0]])
    m[:2, 2] = mt - m[:2, :2] @ ms
    return m


def affine(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    x, *_ = np.linalg.lstsq(np.c_[source, np.ones(len(source))], target, rcond=None)
    return np.r_[x.T, [[0, 0, 1]]]


def _equations(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    rows = []
    for (x, y), (u, v) in zip(source, target, strict=True):
        rows += [[x, y, 1, 0, 0, 0, -u * x, -u * y, -u], [0, 0, 0, x, y, 1, -v * x, -v * y, -v]]
    return np.array(rows)


def homography(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    m = np.linalg.svd(_equations(source, target))[2][-1].reshape(3, 3)
    return m / m[2, 2]


def determined(source: np.ndarray, target: np.ndarray) -> bool:
    """Whether the points leave one homography only: their equations, of centred and scaled points, have rank 8."""
    near = [(p - p.mean(0)) / max(1e-300, np.abs(p - p.mean(0)).max()) for p in (source, target)]
    sizes = np.linalg.svd(_equations(*near), compute_uv=False)
    return bool(sizes[7] > DEGENERATE * sizes[0])


def apply(m: np.ndarray, points: np.ndarray) -> np.ndarray:
    p = np.c_[points, np.ones(len(points))] @ m.T
    return p[:, :2] / p[:, 2:]


#: Share of the largest singular value below which points count as being on one line, or a matrix as not determined.
DEGENERATE = 1e-7


def from_fiducials(source: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, float]:
    """Two points: similarity; three: affine; more: homography. And the mean residual.

    Points that leave a matrix open (on one line, repeated, or all but one on a line) get the simpler one that they determine.
    Points that all coincide determine a shift only.
    """
    fit = similarity
    spread = np.linalg.svd(source - source.mean(0), compute_uv=False)
    if len(source) > 2 and spread[1] > DEGENERATE * spread[0]:
        fit = homography if len(source) > 3 and determined(source, target) else affine
    m = fit(source, target)
    return m, float(np.linalg.norm(apply(m, source) - target, axis=1).mean())


def nearest_pairs(moved: np.ndarray, target: np.ndarray, agree: np.ndarray, tolerance: float) -> list[tuple[int, int]]:
    """One to one, nearest first; pairs of unlike classes count half the tolerance farther."""
    x, y = moved[:, None, 0] - target[None, :, 0], moved[:, None, 1] - target[None, :, 1]
    gap = (np.sqrt(x * x + y * y) + np.where(agree, 0.0, 0.5 * tolerance)).ravel()
    close = np.flatnonzero(gap <= tolerance)
    close = close[np.argsort(gap[close], kind="stable")]
    free_a, free_b, out = [True] * len(moved), [True] * len(target), []
    for i, j in zip((close // len(target)).tolist(), (close % len(target)).tolist(), strict=True):
        if free_a[i] and free_b[j]:
            free_a[i] = free_b[j] = False
            out.append((i, j))
    return out


# Share of the frame's diagonal that a board's image may take, share of placements that must be met, mean residual in pixels.
SPANS, LEAST_MET, MOST_RESIDUAL = (0.02, 4.0), 0.35, 25


def voted(cells: np.ndarray, most: int) -> list[np.ndarray]:
    """Members of the fullest cells (with their neighbours), the fullest first."""
    low = cells.min(0)
    wide = int(cells[:, 1].max() - low[1]) + 1
    x, y = (cells - low).T
    packed, inverse, counts = np.unique(x * wide + y, return_inverse=True, return_counts=True)  # one number a cell sorts faster than rows do
    x, y = packed // wide, packed % wide
    out = []
    for k in np.argsort(-counts, kind="stable")[:most]:
        near = (np.abs(x - x[k]) <= 1) & (np.abs(y - y[k]) <= 1)
        out.append(np.flatnonzero(near[inverse]))
    return out


def turns(source: np.ndarray, classes: np.ndarray, target: np.ndarray, labels: np.ndarray, votes: int = 20_000, most: int = 4) -> list[complex]:
    """Likely turns and scales as complex factors: what maps a baseline between two placements to one between two detections of
    the same classes. Baselines of rare classes vote first, as they have fewest rivals."""
    s, t = source @ [1, 1j], target @ [1, 1j]
    rivals = {c: int((classes == c).sum()) * int((labels == c).sum()) for c in set(classes.tolist())}
    order = sorted((i for i in range(len(s)) if rivals[classes[i]]), key=lambda i: (rivals[classes[i]], i))
    far, found, spent = 0.25 * np.hypot(*np.ptp(source, axis=0)), [], 0
    own = {c: np.flatnonzero(labels == c) for c in rivals}
    for n, k in enumerate(order):
        for i in order[:n]:
            base = s[k] - s[i]
            if abs(base) < far or spent >= votes:
                continue
            z = ((t[own[classes[k]]][:, None] - t[own[classes[i]]][None]) / base).ravel()
            found.append(z[np.abs(z) > 1e-9])
            spent += len(z)
        if spent >= votes:
            break
    z = np.concatenate(found) if found else np.zeros(0, complex)
    if not len(z):
        return []
    cells = np.c_[np.floor(np.log(np.abs(z)) / 0.02), np.floor(np.angle(z) / 0.02)].astype(int)
    return [complex(np.exp(np.median(np.log(np.abs(z[m])))) * np.exp(1j * np.angle(np.exp(1j * np.angle(z[m])).mean()))) for m in voted(cells, most)]


def shifts(moved: np.ndarray, target: np.ndarray, agree: np.ndarray, tolerance: float, most: int = 3) -> list[np.ndarray]:
    """Likely shifts: those that bring most placements onto detections of their class."""
    i, j = np.nonzero(agree)
    gap = target[j] - moved[i]
    if not len(gap):
        return []
    return [np.median(gap[m], axis=0) for m in voted(np.floor(gap / tolerance).astype(int), most)]


def settled(m: np.ndarray, own: np.ndarray, target: np.ndarray, agree: np.ndarray, tolerance: float) -> tuple[np.ndarray, list[tuple[int, int]], float] | None:
    """The matrix refitted to the pairs that it makes, until they don't change; then again with what their residual allows."""
    near: list[tuple[int, int]] = []
    for reach in (tolerance, None):
        for _ in range(8):
            if reach is None:
                i, j = np.array(near).T
                reach = max(4.0, 3 * float(np.median(np.linalg.norm(apply(m, own[i]) - target[j], axis=1))))
            pairs = nearest_pairs(apply(m, own), target, agree, reach)
            if len(pairs) < 2:
                return None
            i, j = np.array(pairs).T
            m = similarity(own[i], target[j])
            if pairs == near:
                break
            near = pairs
    i, j = np.array(near).T
    return m, near, float(np.linalg.norm(apply(m, own)[i] - target[j], axis=1).mean())


def register(source: np.ndarray, classes: list, target: np.ndarray, labels: list, tolerance: float | None = None) -> dict:
    """Find the similarity of placements to detections without fiducials.

    Baselines between placements vote for turn and scale, then pairs of equal class vote for the shift, for both directions
    of the y axis; what wins is refitted to the pairs it makes. The best has most agreeing classes, then most pairs, then
    the least residual; `ambiguous` says that another placement has as many agreeing classes.
    """
    if len(source) < 2 or len(target) < 2:
        return {"usable": False}
    kinds, seen = np.array(classes, object), np.array(labels, object)
    if not set(classes) & set(labels):  # nothing agrees: any detection may be any placement
        kinds, seen = np.full(len(classes), ""), np.full(len(labels), "")
    agree = kinds[:, None] == seen[None]
    diagonal = float(np.hypot(*np.ptp(target, axis=0)))
    tolerance = tolerance or 0.025 * diagonal
    found = []
    for flip in (1.0, -1.0):
        own = source * [1.0, flip]
        span = float(np.hypot(*np.ptp(own, axis=0)))
        for z in turns(own, kinds, target, seen):
            if not SPANS[0] <= abs(z) * span / max(1e-9, diagonal) <= SPANS[1]:
                continue
            turn = np.array([[z.real, -z.imag], [z.imag, z.real]])
            for shift in shifts(own @ turn.T, target, agree, tolerance):
                m = np.eye(3)
                m[:2, :2], m[:2, 2] = turn, shift
                best = settled(m, own, target, agree, tolerance)
                if best:
                    m, near, residual = best
                    i, j = np.array(near).T
                    found.append(((int(agree[i, j].sum()), len(near), -residual), m @ np.diag([1.0, flip, 1.0])))
                    if found[-1][0][0] == len(source) and residual < 1e-6:
                        return _result(found, source, tolerance)  # nothing can be better
    return _result(found, source, tolerance)


def _result(found: list, source: np.ndarray, tolerance: float) -> dict:
    if not found:
        return {"usable": False}
    found = sorted(found, key=lambda x: x[0], reverse=True)
    (agreements, n, gap), m = found[0]
    rival = any(x[0][0] >= agreements and np.linalg.norm(apply(x[1], source) - apply(m, source), axis=1).mean() > tolerance for x in found[1:])
    return {"usable": n / len(source) >= LEAST_MET and -gap <= MOST_RESIDUAL, "matrix": m, "matched": n, "agreements": agreements, "residual": -gap, "inlier_ratio": n / len(source), "ambiguous": rival}


def clipped_area(outline: list[tuple[float, float]], box: tuple[float, float, float, float]) -> float:
    """Area of a convex outline inside a box: the outline is cut along one side of the box after the other."""
    x1, y1, x2, y2 = box
    points = list(outline)
    for axis, bound, sign in ((0, x1, 1), (0, x2, -1), (1, y1, 1), (1, y2, -1)):
        kept = []
        for p, q in zip(points, points[1:] + points[:1], strict=True):
            dp, dq = sign * (p[axis] - bound), sign * (q[axis] - bound)
            if dp >= 0:
                kept.append(p)
            if (dp > 0 > dq) or (dp < 0 < dq):
                t = dp / (dp - dq)
                kept.append((p[0] + t * (q[0] - p[0]), p[1] + t * (q[1] - p[1])))
        points = kept
    if len(points) < 3:
        return 0.0
    return abs(sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(points, points[1:] + points[:1], strict=True))) / 2
