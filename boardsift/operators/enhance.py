"""What is done to a frame before anything is looked for in it, in numpy: lens, size, noise, colour, contrast, sharpness."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from boardsift.operators.pixels import luminance, resized


def bilinear(image: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values at real-valued places, 0 outside; and which places are inside."""
    h, w = image.shape[:2]
    inside = (x >= 0) & (x <= w - 1) & (y >= 0) & (y <= h - 1)
    x0, y0 = np.clip(np.floor(x).astype(int), 0, max(0, w - 2)), np.clip(np.floor(y).astype(int), 0, max(0, h - 2))
    x1, y1 = np.minimum(x0 + 1, w - 1), np.minimum(y0 + 1, h - 1)
    fx, fy = x - x0, y - y0
    if image.ndim == 3:
        fx, fy = fx[..., None], fy[..., None]
    a = image.astype(float)
    out = (a[y0, x0] * (1 - fx) + a[y0, x1] * fx) * (1 - fy) + (a[y1, x0] * (1 - fx) + a[y1, x1] * fx) * fy
    return np.where(inside[..., None] if image.ndim == 3 else inside, out, 0.0), inside


@lru_cache(8)
def lens_map(h: int, w: int, camera: tuple[float, ...], lens: tuple[float, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Where each pixel of a corrected frame lies in the distorted one; kept a resolution. lens: k1, k2, p1, p2, k3, k4, k5, k6 (or fewer)."""
    k1, k2, p1, p2, k3, k4, k5, k6 = (*lens, *[0.0] * (8 - len(lens)))
    fx, fy, cx, cy = camera
    y, x = np.mgrid[:h, :w].astype(float)
    u, v = (x - cx) / fx, (y - cy) / fy
    r = u * u + v * v
    f = (1 + r * (k1 + r * (k2 + r * k3))) / (1 + r * (k4 + r * (k5 + r * k6)))
    du, dv = 2 * p1 * u * v + p2 * (r + 2 * u * u), p1 * (r + 2 * v * v) + 2 * p2 * u * v
    return (u * f + du) * fx + cx, (v * f + dv) * fy + cy


def undistorted(image: np.ndarray, camera: np.ndarray, lens: tuple[float, ...]) -> tuple[np.ndarray, np.ndarray]:
    """The frame without its lens's distortion, and where it has a source."""
    x, y = lens_map(*image.shape[:2], (camera[0, 0], camera[1, 1], camera[0, 2], camera[1, 2]), tuple(lens))
    out, valid = bilinear(image, x, y)
    return np.rint(out).astype(np.uint8), valid


def gaussian(a: np.ndarray, sigma: float) -> np.ndarray:
    """Each channel blurred."""
    n = max(1, int(3 * sigma + 0.5))
    k = np.exp(-(np.arange(-n, n + 1) ** 2) / (2 * sigma**2))
    k /= k.sum()
    a = a.astype(float)
    for axis in (0, 1):
        p = np.pad(a, [(n, n) if i == axis else (0, 0) for i in range(a.ndim)], mode="reflect" if a.shape[axis] > n else "edge")
        a = sum(k[i] * np.take(p, range(i, i + a.shape[axis]), axis) for i in range(2 * n + 1))
    return a


def bilateral(image: np.ndarray, reach: int = 2, space: float = 1.5, colour: float = 30.0) -> np.ndarray:
    """Blurred among pixels of like colour: edges stay."""
    a = image.astype(float)
    p = np.pad(a, ((reach, reach), (reach, reach), (0, 0)), mode="edge")
    total, weight = np.zeros_like(a), np.zeros(a.shape[:2])
    h, w = weight.shape
    for dy in range(2 * reach + 1):
        for dx in range(2 * reach + 1):
            q = p[dy : dy + h, dx : dx + w]
            g = np.exp(-((dy - reach) ** 2 + (dx - reach) ** 2) / (2 * space**2) - ((q - a) ** 2).sum(2) / (2 * colour**2))
            total += g[..., None] * q
            weight += g
    return np.rint(total / weight[..., None]).astype(np.uint8)


def grey_world(bgr: np.ndarray) -> np.ndarray:
    mean = bgr.reshape(-1, 3).mean(0)
    return np.clip(bgr * (mean.mean() / np.maximum(mean, 1e-6)), 0, 255).astype(np.uint8)


def _relit(bgr: np.ndarray, old: np.ndarray, new: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(bgr * (new / np.maximum(old, 1))[..., None]), 0, 255).astype(np.uint8)


def local_contrast(bgr: np.ndarray, tiles: int = 4, limit: float = 2.0) -> np.ndarray:
    """Brightness evened out tile by tile, with clipped histograms, and blended between tiles (Zuiderveld, 1994)."""
    light = luminance(bgr)
    h, w = light.shape
    ys, xs = np.linspace(0, h, tiles + 1).astype(int), np.linspace(0, w, tiles + 1).astype(int)
    maps = np.empty((tiles, tiles, 256))
    for i in range(tiles):
        for j in range(tiles):
            part = light[ys[i] : max(ys[i + 1], ys[i] + 1), xs[j] : max(xs[j + 1], xs[j] + 1)].astype(int)
            count = np.bincount(part.ravel(), minlength=256).astype(float)
            most = max(1.0, limit * part.size / 256)
            count = np.minimum(count, most) + np.maximum(count - most, 0).sum() / 256
            maps[i, j] = np.cumsum(count) * 255 / count.sum()
    fy = np.clip((np.arange(h) + 0.5) * tiles / h - 0.5, 0, tiles - 1)
    fx = np.clip((np.arange(w) + 0.5) * tiles / w - 0.5, 0, tiles - 1)
    i0, j0 = np.floor(fy).astype(int), np.floor(fx).astype(int)
    i1, j1 = np.minimum(i0 + 1, tiles - 1), np.minimum(j0 + 1, tiles - 1)
    ty, tx, at = (fy - i0)[:, None], (fx - j0)[None], light.astype(int)
    pick = lambda i, j: maps[i[:, None], j[None], at]
    new = (pick(i0, j0) * (1 - tx) + pick(i0, j1) * tx) * (1 - ty) + (pick(i1, j0) * (1 - tx) + pick(i1, j1) * tx) * ty
    return _relit(bgr, light, new)


def stretched(bgr: np.ndarray, low: float = 1, high: float = 99) -> np.ndarray:
    """Brightness between two percentiles spread over its whole range."""
    light = luminance(bgr)
    a, b = np.percentile(light, [low, high])
    return _relit(bgr, light, np.clip((light - a) * 255 / max(1e-6, b - a), 0, 255)) if b - a >= 1 else bgr


def sharpened(bgr: np.ndarray, amount: float = 0.5, sigma: float = 1.0) -> np.ndarray:
    return np.clip(np.rint(bgr * (1 + amount) - amount * gaussian(bgr, sigma)), 0, 255).astype(np.uint8)


def preprocessed(bgr: np.ndarray, camera: np.ndarray | None = None, lens: tuple[float, ...] = (), most: int = 2048, noise: str = "none", white: bool = True, local: bool = False, stretch: bool = True, sharpen: float = 0.0) -> tuple[np.ndarray, list[str], float]:
    """The chosen steps in their fixed order: the image, what was done, and the scale."""
    done, scale = [], 1.0
    if camera is not None:
        bgr, _ = undistorted(bgr, camera, lens)
        done.append("undistort")
    if max(bgr.shape[:2]) > most:
        scale = most / max(bgr.shape[:2])
        bgr = resized(bgr, max(1, round(bgr.shape[0] * scale)), max(1, round(bgr.shape[1] * scale)))
        done.append("resize")
    if noise not in ("none", "gaussian", "bilateral"):
        raise ValueError(f"not a way to remove noise: {noise}")
    if noise != "none":
        bgr = bilateral(bgr) if noise == "bilateral" else np.rint(gaussian(bgr, 0.8)).astype(np.uint8)
        done.append(f"denoise_{noise}")
    for wanted, name, step in ((white, "white_balance", grey_world), (local, "local_contrast", local_contrast), (stretch, "stretch", stretched), (sharpen > 0, "sharpen", lambda x: sharpened(x, sharpen))):
        if wanted:
            bgr = step(bgr)
            done.append(name)
    return bgr, done, scale


def calibrated(board: np.ndarray, views: list[np.ndarray], least: int = 10) -> tuple[np.ndarray, tuple[float, float], float]:
    """Camera matrix, radial distortion (k1, k2) and RMS error from the corners of a flat board in many views (Zhang, 2000).

    board: corners on the board (n, 2); views: the same corners in each image (n, 2). Fewer than `least` views are an error.
    """
    if len(views) < least:
        raise ValueError(f"{len(views)} views, at least {least} are needed")
    hs = [normalised_homography(board, v) for v in views]

    def v(h, i, j):
        a, b = h[:, i], h[:, j]
        return [a[0] * b[0], a[0] * b[1] + a[1] * b[0], a[1] * b[1], a[2] * b[0] + a[0] * b[2], a[2] * b[1] + a[1] * b[2], a[2] * b[2]]

    rows = [r for h in hs for r in (v(h, 0, 1), np.subtract(v(h, 0, 0), v(h, 1, 1)))] + [[0, 1e6, 0, 0, 0, 0]]  # no skew
    rows = np.array(rows, float)
    size = np.abs(rows).max(0)
    b = np.linalg.svd(rows / size)[2][-1] / size
    b11, b12, b22, b13, b23, b33 = b
    cy = (b12 * b13 - b11 * b23) / (b11 * b22 - b12**2)
    lam = b33 - (b13**2 + cy * (b12 * b13 - b11 * b23)) / b11
    fx, fy = np.sqrt(lam / b11), np.sqrt(lam * b11 / (b11 * b22 - b12**2))
    cx = -b13 * fx**2 / lam
    k = np.array([[fx, 0, cx], [0, fy, cy], [0, 0, 1]])
    inverse, lhs, rhs = np.linalg.inv(k), [], []
    for h, seen in zip(hs, views, strict=True):
        m = inverse @ h
        m /= np.linalg.norm(m[:, 0])
        if m[2, 2] < 0:
            m = -m
        p = np.c_[board, np.ones(len(board))] @ m.T
        u, w = p[:, 0] / p[:, 2], p[:, 1] / p[:, 2]
        r = u * u + w * w
        ideal = np.c_[fx * u + cx, fy * w + cy]
        lhs.append(np.stack([np.c_[(ideal[:, 0] - cx) * r, (ideal[:, 0] - cx) * r * r], np.c_[(ideal[:, 1] - cy) * r, (ideal[:, 1] - cy) * r * r]], 1).reshape(-1, 2))
        rhs.append((seen - ideal).reshape(-1))
    lens, *_ = np.linalg.lstsq(np.concatenate(lhs), np.concatenate(rhs), rcond=None)
    error = np.concatenate(rhs) - np.concatenate(lhs) @ lens
    return k, (float(lens[0]), float(lens[1])), float(np.sqrt((error**2).mean() * 2))


def normalised_homography(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """A homography fitted to points that are first centred and scaled (Hartley, 1997)."""
    from boardsift.operators.registration import homography

    def frame(p):
        centre, size = p.mean(0), max(1e-12, np.linalg.norm(p - p.mean(0), axis=1).mean() / np.sqrt(2))
        return np.array([[1 / size, 0, -centre[0] / size], [0, 1 / size, -centre[1] / size], [0, 0, 1]])

    a, b = frame(source), frame(target)
    move = lambda m, p: p @ m[:2, :2].T + m[:2, 2]
    h = np.linalg.inv(b) @ homography(move(a, source), move(b, target)) @ a
    return h / h[2, 2]
