"""Pixel kernels in numpy. Images are height x width x 3 bytes in BGR order, as Spark's image source has them."""

from __future__ import annotations

import numpy as np


def coerced(a: np.ndarray) -> np.ndarray:
    """Any numeric image as three channels of bytes."""
    a = np.asarray(a)
    if a.dtype == bool:
        a = a.astype(np.uint8) * 255
    elif a.dtype.kind == "u" and a.dtype != np.uint8:
        a = (a.astype(np.float64) * 255 / np.iinfo(a.dtype).max).astype(np.uint8)
    elif a.dtype.kind == "f":
        a = np.nan_to_num(a, nan=0.0, posinf=255.0, neginf=0.0)
        a = np.clip(a * 255 if a.size and a.min() >= 0 and a.max() <= 1 else a, 0, 255).astype(np.uint8)
    elif a.dtype != np.uint8:
        a = np.clip(a, 0, 255).astype(np.uint8)
    if a.ndim == 2:
        a = a[:, :, None]
    if a.ndim != 3 or a.shape[2] not in (1, 3, 4):
        raise ValueError(f"not an image: {a.shape}")
    return np.repeat(a, 3, 2) if a.shape[2] == 1 else a[:, :, :3]


def value_saturation(bgr: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Brightest channel, and how far the darkest is from it, both of 255."""
    b, g, r = (bgr[..., k] for k in range(3))
    most, least = np.maximum(np.maximum(b, g), r).astype(np.int32), np.minimum(np.minimum(b, g), r).astype(np.int32)
    share = np.rint((most - least) * 255 / np.maximum(most, 1))
    return most.astype(np.uint8), np.where(most > 0, share, 0).astype(np.uint8)


def luminance(bgr: np.ndarray) -> np.ndarray:
    return np.rint(bgr @ np.array([0.114, 0.587, 0.299]))


def otsu(v: np.ndarray) -> int:
    """The level that separates two classes best."""
    h = np.bincount(v.ravel(), minlength=256).astype(float)
    below, sums = np.cumsum(h), np.cumsum(h * np.arange(256))
    above = below[-1] - below
    with np.errstate(divide="ignore", invalid="ignore"):
        between = below * above * (sums / below - (sums[-1] - sums) / above) ** 2
    return int(np.nan_to_num(between, nan=-1.0).argmax())


def _window(m: np.ndarray, f) -> np.ndarray:
    p = np.pad(m, 1, mode="edge")
    h, w = m.shape
    return f.reduce([p[i : i + h, j : j + w] for i in range(3) for j in range(3)])


def opened(m: np.ndarray) -> np.ndarray:
    return _window(_window(m, np.logical_and), np.logical_or)


def closed(m: np.ndarray) -> np.ndarray:
    return _window(_window(m, np.logical_or), np.logical_and)


# What solder is like. Saturation at most; brightness that a threshold mustn't fall below; spread of brightness and
# share of bright pixels within which brightness alone may decide; percentile and floor of a glint.
SATURATION, DARK, SPREAD, BRIGHT_SHARE, GLINT, GLINT_FLOOR = 110, 40, 35, 0.90, 99.0, 200.0
FEATURES = (
    "solder_ratio", "solder_area_px", "span_ratio", "width_ratio", "centroid_offset_ratio", "specular_ratio", "edge_density", "contrast", "uniformity",
    "edge_contact_start", "edge_contact_end", "mean_value", "mean_saturation",
)


def solder(bgr: np.ndarray, saturation: int = SATURATION) -> np.ndarray:
    """Bright and nearly grey pixels, cleaned of specks unless that would leave nothing.

    Where no bright pixel is grey, brightness alone decides if the region has both bright and dark parts: a flat region
    has no solder, whatever its brightness.
    """
    if not bgr.size:
        return np.zeros(bgr.shape[:2], bool)
    v, s = value_saturation(bgr)
    level = otsu(v)
    bright = v > level if level >= DARK else v >= DARK
    mask = bright & (s <= saturation)
    if not mask.any():
        if int(v.max()) - int(v.min()) < SPREAD or bright.mean() > BRIGHT_SHARE:
            return mask
        mask = bright
    clean = closed(opened(mask))
    return clean if clean.any() else mask


def edges_of(bgr: np.ndarray) -> float:
    """Mean size of the second difference of brightness, of 255."""
    p = np.pad(luminance(bgr), 1, mode="reflect")
    return float(np.abs(p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * p[1:-1, 1:-1]).mean()) / 255


def measured(bgr: np.ndarray, axis: str = "auto") -> dict:
    """The 13 measurements of a region, spans and contacts along its longer side or the axis given (x or y)."""
    out = dict.fromkeys(FEATURES, 0.0) | {"solder_area_px": 0}
    if not bgr.size or min(bgr.shape[:2]) < 2:
        return out
    if axis == "y" or (axis == "auto" and bgr.shape[0] > bgr.shape[1]):
        bgr = bgr.transpose(1, 0, 2)  # the joint runs along the rows from here on
    mask, (v, s) = solder(bgr), value_saturation(bgr)
    h, w = mask.shape
    out |= {"edge_density": edges_of(bgr), "mean_value": float(v.mean()) / 255, "mean_saturation": float(s.mean()) / 255}
    n = int(mask.sum())
    if not n:
        return out
    along, across = mask.sum(0) / h, mask.any(1)
    where, heights = np.flatnonzero(along), np.flatnonzero(across)
    centre = float(np.nonzero(mask)[1].mean())
    shine, ground = v[mask].astype(float), v[~mask].astype(float)
    return out | {
        "solder_ratio": n / mask.size,
        "solder_area_px": n,
        "span_ratio": (where[-1] - where[0] + 1) / w,
        "width_ratio": (heights[-1] - heights[0] + 1) / h,
        "centroid_offset_ratio": min(1.0, abs(centre - w / 2) / max(1.0, w / 2)),
        "specular_ratio": float((shine >= max(np.percentile(v, GLINT), GLINT_FLOOR)).mean()),
        "contrast": float(np.clip((shine.mean() - ground.mean()) / 255, -1, 1)) if len(ground) else 0.0,
        "uniformity": float(np.clip(1 - along.std() / (along.mean() + 1e-6), 0, 1)),
        "edge_contact_start": float(mask[:, 0].mean()),
        "edge_contact_end": float(mask[:, -1].mean()),
    }


def _runs_to_most(label: np.ndarray) -> np.ndarray:
    """Each horizontal run of pixels takes its largest number."""
    flat = np.pad(label, ((0, 0), (0, 1))).ravel()
    on = flat > 0
    starts = np.flatnonzero(on & ~np.r_[False, on[:-1]])
    if not len(starts):
        return label
    sizes = np.add.reduceat(on, starts, dtype=np.int64)
    flat[on] = np.repeat(np.maximum.reduceat(flat, starts), sizes)
    return flat.reshape(label.shape[0], -1)[:, :-1]


def components(mask: np.ndarray) -> np.ndarray:
    """Number of each pixel's 8-connected component, 0 outside."""
    label = np.where(mask, np.arange(1, mask.size + 1).reshape(mask.shape), 0)
    h, w = mask.shape
    while True:
        new = _runs_to_most(_runs_to_most(label).T).T
        p = np.pad(new, 1)
        new = np.where(mask, np.maximum.reduce([p[i : i + h, j : j + w] for i in range(3) for j in range(3)]), 0)
        if (new == label).all():
            return label
        label = new


def refined(bgr: np.ndarray, least_metal: float = 0.02, least_area: float = 0.10) -> tuple[int, int, int, int] | None:
    """Box of the largest piece of metal, if it is neither a speck nor a collapse."""
    label = components(solder(bgr))
    names, sizes = np.unique(label[label > 0], return_counts=True)
    if not len(names) or sizes.max() < least_metal * label.size:
        return None
    ys, xs = np.nonzero(label == names[sizes.argmax()])
    box = (int(xs.min()), int(ys.min()), int(xs.max()) + 1, int(ys.max()) + 1)
    return box if (box[2] - box[0]) * (box[3] - box[1]) >= least_area * label.size else None


class Crops:
    """Regions of one image as one array, so that a measurement is a few operations for all of them.

    `measured` and `refined` give what the functions of these names give for each region. Boxes as slices take them. With
    `turn`, regions higher than wide are laid on their side.
    """

    def __init__(self, bgr: np.ndarray, boxes: list[tuple[int, int, int, int]], turn: bool = False):
        v, s = value_saturation(bgr)
        planes = np.stack([v.astype(np.int16), s.astype(np.int16), luminance(bgr).astype(np.int16)])
        views = [planes[:, y1:y2, x1:x2] for x1, y1, x2, y2 in boxes]
        if turn:
            views = [c.transpose(0, 2, 1) if c.shape[1] > c.shape[2] else c for c in views]
        self.h, self.w = (np.array([c.shape[k] for c in views], np.int64) for k in (1, 2))
        self.n = self.h * self.w
        # one more row and column, so that nothing touches what lies in another region
        high, wide = (int(x.max(initial=0)) + 1 for x in (self.h, self.w))
        self.planes = np.zeros((3, len(views), high, wide), np.int16)
        for k, c in enumerate(views):
            self.planes[:, k, : c.shape[1], : c.shape[2]] = c
        self.v, self.s, self.l = self.planes
        self.inside = (np.arange(high)[:, None] < self.h[:, None, None]) & (np.arange(wide) < self.w[:, None, None])
        at = self.v + np.arange(len(views))[:, None, None] * 256
        self.levels = np.bincount(at.ravel(), minlength=256 * len(views)).reshape(-1, 256)
        self.levels[:, 0] -= high * wide - self.n  # what lies outside is 0

    def _otsu(self) -> np.ndarray:
        h = self.levels.astype(float)
        below, sums = np.cumsum(h, 1), np.cumsum(h * np.arange(256), 1)
        above = below[:, -1:] - below
        with np.errstate(divide="ignore", invalid="ignore"):
            between = below * above * (sums / below - (sums[:, -1:] - sums) / above) ** 2
        return np.nan_to_num(between, nan=-1.0).argmax(1)

    def _window(self, m: np.ndarray, grow: bool) -> np.ndarray:
        """The 3 x 3 neighbours within the region: any of them, or all."""
        if not grow:
            return self.inside & ~self._window(self.inside & ~m, True)
        rows = m.copy()
        rows[:, 1:] |= m[:, :-1]
        rows[:, :-1] |= m[:, 1:]
        out = rows.copy()
        out[:, :, 1:] |= rows[:, :, :-1]
        out[:, :, :-1] |= rows[:, :, 1:]
        return out & self.inside

    def solder(self, saturation: int = SATURATION) -> np.ndarray:
        level = self._otsu()[:, None, None]
        bright = self.inside & np.where(level >= DARK, self.v > level, self.v >= DARK)
        mask = bright & (self.s <= saturation)
        held = self.levels > 0
        spread = np.where(self.n > 0, 255 - held[:, ::-1].argmax(1) - held.argmax(1), 0)
        share = bright.sum((1, 2)) / np.maximum(self.n, 1)
        by_light = ~mask.any((1, 2)) & (spread >= SPREAD) & (share <= BRIGHT_SHARE)
        mask = np.where(by_light[:, None, None], bright, mask)
        opened = self._window(self._window(mask, False), True)
        clean = self._window(self._window(opened, True), False)
        return np.where(clean.any((1, 2))[:, None, None], clean, mask)

    def _edges(self) -> np.ndarray:
        """Sum of the second differences of brightness, each region mirrored at its sides."""
        k, (count, high, wide) = np.arange(len(self.n)), self.l.shape
        p = np.zeros((count, high + 1, wide + 1), np.int16)
        p[:, 1:, 1:] = self.l
        p[:, 0], p[k, self.h + 1] = p[:, 2], p[k, np.maximum(self.h - 1, 0)]
        p[:, :, 0], p[k, :, self.w + 1] = p[:, :, 2], p[k, :, np.maximum(self.w - 1, 0)]
        c = p[:, 1:-1, 1:-1]
        d = np.abs(p[:, :-2, 1:-1] + p[:, 2:, 1:-1] + p[:, 1:-1, :-2] + p[:, 1:-1, 2:] - 4 * c)
        return (d * self.inside[:, :-1, :-1]).sum((1, 2), dtype=np.int64)

    def measured(self) -> dict[str, np.ndarray]:
        out = dict.fromkeys(FEATURES, np.zeros(len(self.n))) | {"solder_area_px": np.zeros(len(self.n), np.int64)}
        if not len(self.n):
            return out
        enough, size = np.minimum(self.h, self.w) >= 2, np.maximum(self.n, 1)
        mask = self.solder()
        light = (self.levels * np.arange(256)).sum(1)
        own = {"edge_density": self._edges() / size / 255, "mean_value": light / size / 255, "mean_saturation": self.s.sum((1, 2), dtype=np.int64) / size / 255}
        columns, across = mask.sum(1), mask.any(2)
        n = columns.sum(1)
        some, least = n > 0, np.maximum(n, 1)
        high, wide = np.maximum(self.h, 1), np.maximum(self.w, 1)
        span = lambda x: x.shape[1] - x[:, ::-1].argmax(1) - x.argmax(1)
        centre = (columns * np.arange(columns.shape[1])).sum(1) / least
        # the percentile, between two values of the sorted region
        place = np.maximum(self.n - 1, 0) * (GLINT / 100)
        upto, low = np.cumsum(self.levels, 1), np.floor(place).astype(np.int64)
        a, b = ((upto > x[:, None]).argmax(1).astype(float) for x in (low, np.minimum(low + 1, size - 1)))
        t = place - low
        glint = np.maximum(np.where(t >= 0.5, b - (b - a) * (1 - t), a + (b - a) * t), GLINT_FLOOR)
        shine = np.where(mask, self.v, 0)
        bright, rest = shine.sum((1, 2), dtype=np.int64), self.n - n
        along = columns / high[:, None]
        mean = along.sum(1) / wide
        off = np.where(np.arange(along.shape[1]) < self.w[:, None], along - mean[:, None], 0)
        inner = {
            "solder_ratio": n / size,
            "solder_area_px": n,
            "span_ratio": span(columns > 0) / wide,
            "width_ratio": span(across) / high,
            "centroid_offset_ratio": np.minimum(1.0, np.abs(centre - self.w / 2) / np.maximum(1.0, self.w / 2)),
            "specular_ratio": (mask & (self.v >= glint[:, None, None])).sum((1, 2)) / least,
            "contrast": np.where(rest > 0, np.clip((bright / least - (light - bright) / np.maximum(rest, 1)) / 255, -1, 1), 0.0),
            "uniformity": np.clip(1 - np.sqrt((off * off).sum(1) / wide) / (mean + 1e-6), 0, 1),
            "edge_contact_start": mask[:, :, 0].sum(1) / high,
            "edge_contact_end": mask[np.arange(len(n)), :, wide - 1].sum(1) / high,
        }
        return out | {k: np.where(enough, x, 0) for k, x in own.items()} | {k: np.where(enough & some, x, 0) for k, x in inner.items()}

    def refined(self, least_metal: float = 0.02, least_area: float = 0.10) -> tuple[np.ndarray, np.ndarray]:
        """Boxes within the regions, and which regions have one. Pieces are made of the rows' runs of pixels."""
        boxes, found = np.zeros((len(self.n), 4), np.int64), np.zeros(len(self.n), bool)
        mask = self.solder()
        count, high, wide = mask.shape
        step = np.diff(mask.ravel().astype(np.int8), prepend=0)  # the last column is empty, so each run ends within its row
        first, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        if not len(first):
            return boxes, found
        # runs of the next row that touch a run, corners included
        low, high_ = np.searchsorted(end, first + wide), np.searchsorted(first, end + wide, side="right")
        many = np.maximum(high_ - low, 0)
        a = np.repeat(np.arange(len(first)), many)
        b = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(low, many)
        label = np.arange(len(first))
        while True:
            both = np.minimum(label[a], label[b])
            new = label.copy()
            for side in (a, b):
                np.minimum.at(new, label[side], both)
            new = new[new]
            if (new == label).all():
                break
            label = new
        names, piece = np.unique(label, return_inverse=True)
        sizes, last = np.bincount(piece, weights=end - first), np.zeros(len(names), np.int64)
        np.maximum.at(last, piece, end)
        owner = first[names] // (high * wide)
        order = np.lexsort((last, -sizes, owner))  # the largest piece of each region, of equal ones that which ends first
        best = order[np.r_[True, owner[order][1:] != owner[order][:-1]]]
        y, x1, x2 = first // wide % high, first % wide, end - first // wide * wide
        sides = np.full((4, len(names)), 1 << 30)
        for k, value in enumerate((x1, y, -x2, -y - 1)):
            np.minimum.at(sides[k], piece, value)
        mine, sides = owner[best], np.abs(sides[:, best])
        area = (sides[2] - sides[0]) * (sides[3] - sides[1])
        boxes[mine], found[mine] = sides.T, (sizes[best] >= least_metal * self.n[mine]) & (area >= least_area * self.n[mine])
        return boxes, found


def resized(a: np.ndarray, h: int, w: int) -> np.ndarray:
    """Bilinear, pixel centres aligned."""
    y = np.clip((np.arange(h) + 0.5) * a.shape[0] / h - 0.5, 0, a.shape[0] - 1)
    x = np.clip((np.arange(w) + 0.5) * a.shape[1] / w - 0.5, 0, a.shape[1] - 1)
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    y1, x1 = np.minimum(y0 + 1, a.shape[0] - 1), np.minimum(x0 + 1, a.shape[1] - 1)
    fy, fx = (y - y0)[:, None, None], (x - x0)[None, :, None]
    b = a.astype(float)
    top, low = b[y0][:, x0] * (1 - fx) + b[y0][:, x1] * fx, b[y1][:, x0] * (1 - fx) + b[y1][:, x1] * fx
    return np.rint(top * (1 - fy) + low * fy).astype(np.uint8)


def letterboxed(a: np.ndarray, h: int, w: int, colour: int = 114) -> np.ndarray:
    """Scaled to fit, the rest filled."""
    scale = min(h / a.shape[0], w / a.shape[1])
    nh, nw = max(1, round(a.shape[0] * scale)), max(1, round(a.shape[1] * scale))
    out = np.full((h, w, 3), colour, np.uint8)
    y, x = (h - nh) // 2, (w - nw) // 2
    out[y : y + nh, x : x + nw] = resized(a, nh, nw)
    return out


def correlation(image: np.ndarray, template: np.ndarray) -> np.ndarray:
    """Normalised cross-correlation at every place where the template fits."""
    image, template = image.astype(float), template.astype(float)
    h, w = template.shape
    t = template - template.mean()
    views = np.lib.stride_tricks.sliding_window_view(image, (h, w))
    mean = views.mean((2, 3))
    spread = np.sqrt(np.maximum((views**2).mean((2, 3)) - mean**2, 0) * h * w * (t**2).sum())
    return np.where(spread > 1e-9, np.einsum("ijkl,kl->ij", views, t) / np.maximum(spread, 1e-9), 0.0)


def shift(image: np.ndarray, template: np.ndarray) -> tuple[float, float, float]:
    """Sub-pixel place of the best match, and its score."""
    c = correlation(image, template)
    y, x = np.unravel_index(c.argmax(), c.shape)

    def between(a, b, d):
        bend = a - 2 * b + d
        return 0.0 if abs(bend) < 1e-12 else float(np.clip(0.5 * (a - d) / bend, -1, 1))

    dy = between(c[y - 1, x], c[y, x], c[y + 1, x]) if 0 < y < c.shape[0] - 1 else 0.0
    dx = between(c[y, x - 1], c[y, x], c[y, x + 1]) if 0 < x < c.shape[1] - 1 else 0.0
    return float(x + dx), float(y + dy), float(c[y, x])


def similarity(a: np.ndarray, b: np.ndarray, sigma: float = 1.5) -> float:
    """Mean structural similarity of grey images, Gaussian windows."""
    k = np.exp(-(np.arange(-5, 6) ** 2) / (2 * sigma**2))
    k /= k.sum()

    def blur(x):
        x = np.apply_along_axis(lambda r: np.convolve(np.pad(r, 5, mode="reflect"), k, "valid"), 1, x)
        return np.apply_along_axis(lambda r: np.convolve(np.pad(r, 5, mode="reflect"), k, "valid"), 0, x)

    a, b = a.astype(float), b.astype(float)
    ma, mb = blur(a), blur(b)
    va, vb, cov = blur(a * a) - ma**2, blur(b * b) - mb**2, blur(a * b) - ma * mb
    c1, c2 = (0.01 * 255) ** 2, (0.03 * 255) ** 2
    return float((((2 * ma * mb + c1) * (2 * cov + c2)) / ((ma**2 + mb**2 + c1) * (va + vb + c2))).mean())


def drawn(rows: np.ndarray, h: int = 190, w: int = 270) -> np.ndarray:
    """A synthetic board: green, with bright boxes."""
    out = np.empty((h, w, 3), np.uint8)
    out[:] = (40, 90, 40)
    for x1, y1, x2, y2, v in rows.astype(int).tolist():
        out[max(0, y1) : y2, max(0, x1) : x2] = v
    return out


def outlined(image: np.ndarray, boxes: list[tuple[int, int, int, int]], colour: tuple[int, int, int]) -> np.ndarray:
    """The image with each box's edge drawn on it."""
    out = image.copy()
    for x1, y1, x2, y2 in boxes:
        out[[y1, y2 - 1], x1:x2] = colour
        out[y1:y2, [x1, x2 - 1]] = colour
    return out


def camera_for(camera: np.ndarray, calibrated: tuple[int, int], size: tuple[int, int], tolerance: float = 0.01) -> np.ndarray:
    """Intrinsics for another resolution of the same shape."""
    sx, sy = size[0] / calibrated[0], size[1] / calibrated[1]
    if abs(sx - sy) > tolerance * max(sx, sy):
        raise ValueError(f"calibrated for {calibrated}, not for {size}")
    return np.diag([sx, sy, 1.0]) @ camera
