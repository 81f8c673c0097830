"""Image kernels as vectorised NumPy over whole batches, and their Arrow columns.

Images are arrays (..., height, width, 3) with values in [0, 1] unless said otherwise; leading axes are a batch, so that a column of arrays is
computed in one call a batch and not image by image.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F

# The thresholds of the quality gate and of the tissue measure.
SATURATED, TEXTURED, WINDOW = 0.12, 0.003, 11
MIDDLING = (0.12, 0.45)


# ---------------------------------------------------------------- range and bytes
def unit(x: np.ndarray, limit: float = 1.0) -> np.ndarray:
    """Values in [0, 1]; an image with a value over the limit is taken to be on 0..255."""
    x = np.asarray(x, np.float64)
    wide = x.max(axis=(-3, -2, -1), keepdims=True) > limit
    return np.clip(np.where(wide, x / 255.0, x), 0.0, 1.0)


def to_u8(x: np.ndarray) -> np.ndarray:
    """Bytes, truncating; an image with a value over 1 is on 0..255 already."""
    wide = x.max(axis=(-3, -2, -1), keepdims=True) > 1.0
    return np.where(wide, np.clip(x, 0, 255), np.clip(x, 0, 1) * 255).astype(np.uint8)


def to_u8_half_even(x: np.ndarray) -> np.ndarray:
    """Bytes, rounding halves to even; over 1 by more than a millionth means 0..255."""
    wide = x.max(axis=(-3, -2, -1), keepdims=True) > 1.0 + 1e-6
    return np.rint(np.clip(np.where(wide, x, x * 255.0), 0, 255)).astype(np.uint8)


def to_u8_clip(x: np.ndarray) -> np.ndarray:
    """Bytes by clipping to 0..255 without scaling; a fourth channel goes. Only right for values on 0..255."""
    return np.clip(x[..., :3], 0, 255).astype(np.uint8)


def stretch(x: np.ndarray, low: float = 2, high: float = 98) -> np.ndarray:
    """Contrast between two percentiles of each image to 0..255, truncating; an image without contrast stays (its values truncated)."""
    flat = x.reshape(*x.shape[:-3], -1)
    a, b = np.percentile(flat, [low, high], axis=-1)[..., None, None, None]
    span = np.where(b > a, b - a, 1.0)
    return np.where(b > a, (np.clip(x, a, b) - a) / span * 255, x).astype(np.uint8)


# ---------------------------------------------------------------- gray images (..., height, width)
def saturation(rgb: np.ndarray) -> np.ndarray:
    top, low = rgb.max(axis=-1), rgb.min(axis=-1)
    return np.where(top > 1e-8, (top - low) / np.maximum(top, 1e-8), 0.0)


def _box(x: np.ndarray, size: int) -> np.ndarray:
    """Means of a size x size box, edges repeated, by running sums along each axis."""
    pad = size // 2
    for axis in (-2, -1):
        wide = np.pad(x, [(pad, size - 1 - pad) if a == x.ndim + axis else (0, 0) for a in range(x.ndim)], mode="edge")
        total = np.cumsum(wide, axis=axis)
        zero = np.zeros_like(np.take(total, [0], axis=axis))
        total = np.concatenate([zero, total], axis=axis)
        n = total.shape[axis]
        x = (np.take(total, range(size, n), axis=axis) - np.take(total, range(n - size), axis=axis)) / size
    return x


def box_variance(gray: np.ndarray, size: int = WINDOW) -> np.ndarray:
    """E[g^2] - E[g]^2 on a size x size box, edges repeated."""
    return np.maximum(_box(gray * gray, size) - _box(gray, size) ** 2, 0)


def otsu(gray: np.ndarray, top: float = 1.0, bins: int = 256) -> np.ndarray | float:
    """Centre of the first bin of the upper class for the split with the greatest between-class variance, the first on ties; the middle
    where no split has two classes. The last bin is never an upper class of its own."""
    flat = np.asarray(gray, np.float64).reshape(-1, gray.shape[-2] * gray.shape[-1])
    inside = (flat >= 0) & (flat <= top)
    at = np.minimum((flat * (bins / top)).astype(np.int64), bins - 1)
    counts = np.bincount((np.arange(len(flat))[:, None] * bins + at)[inside], minlength=len(flat) * bins).reshape(-1, bins).astype(np.float64)
    centre = (np.arange(bins) + 0.5) * (top / bins)
    below, mass = np.cumsum(counts, axis=1)[:, :-2], np.cumsum(counts * centre, axis=1)
    above = counts.sum(axis=1, keepdims=True) - below
    with np.errstate(divide="ignore", invalid="ignore"):
        score = below * above * (mass[:, :-2] / below - (mass[:, -1:] - mass[:, :-2]) / above) ** 2
    score = np.where((below > 0) & (above > 0), score, -1.0)
    out = np.where(score.max(axis=1) >= 0, centre[1 + score.argmax(axis=1)], 0.5 * top)
    return float(out[0]) if gray.ndim == 2 else out.reshape(gray.shape[:-2])


def laplacian_variance(gray: np.ndarray) -> np.ndarray:
    """Variance of the four-neighbour Laplacian, edges mirrored."""
    g = np.pad(gray, [(0, 0)] * (gray.ndim - 2) + [(1, 1), (1, 1)], mode="symmetric")
    return (g[..., :-2, 1:-1] + g[..., 2:, 1:-1] + g[..., 1:-1, :-2] + g[..., 1:-1, 2:] - 4 * g[..., 1:-1, 1:-1]).var(axis=(-2, -1))


def tissue_share(rgb: np.ndarray) -> np.ndarray:
    """Share of saturated or textured pixels; a middling share is raised to that of the pixels darker than Otsu's threshold of the
    gray image stretched between its 5th and 95th percentiles, if that is more."""
    gray = np.clip(rgb.mean(axis=-1), 0, 1)
    share = ((saturation(rgb) > SATURATED) | (box_variance(gray) > TEXTURED)).mean(axis=(-2, -1))
    edge = (share >= MIDDLING[0]) & (share <= MIDDLING[1])
    if edge.any():
        g = gray[edge] if gray.ndim > 2 else gray[None]
        a, b = np.percentile(g, [5, 95], axis=(-2, -1))[..., None, None]
        flat = np.clip((g - a) / np.maximum(b - a, 1e-8), 0, 1)
        dark = (flat < np.asarray(otsu(flat))[:, None, None]).mean(axis=(-2, -1))
        share = np.asarray(share)
        share[edge] = np.maximum(share[edge], dark)
    return share


# ---------------------------------------------------------------- all features of a batch
def features(px: np.ndarray) -> dict[str, np.ndarray]:
    """Every per-image number that gates, routers and audits use, for a batch (n, height, width, 3)."""
    r, g, b = px[..., 0], px[..., 1], px[..., 2]
    gray, luma, sat = px.mean(axis=-1), 0.299 * r + 0.587 * g + 0.114 * b, saturation(px)
    whole, plane = (-3, -2, -1), (-2, -1)
    out = {f"mean_{n}": c.mean(axis=plane) for n, c in zip("rgb", (r, g, b), strict=True)}
    out |= {f"std_{n}": c.std(axis=plane) for n, c in zip("rgb", (r, g, b), strict=True)}
    return out | {
        "mean_gray": gray.mean(axis=plane), "std_gray": gray.std(axis=plane), "mean_luma": luma.mean(axis=plane), "std_luma": luma.std(axis=plane),
        "sat_mean": sat.mean(axis=plane), "tissue_proxy": (sat > SATURATED).mean(axis=plane), "tissue": tissue_share(px),
        "tissue_gray": (gray < 0.9).mean(axis=plane), "black": (px <= 0.1).mean(axis=whole), "white": (px >= 0.9).mean(axis=whole),
        "black_strict": (px <= 1 / 255).mean(axis=whole), "white_strict": (px >= 254 / 255).mean(axis=whole), "black_luma": (luma < 0.05).mean(axis=plane),
        "blue_dom": (b > r).mean(axis=plane), "pink": (r > b).mean(axis=plane), "pink_proxy": ((r > 0.55) & (g > 0.35) & (b > 0.55)).mean(axis=plane),
        "min_px": px.min(axis=whole), "max_px": px.max(axis=whole), "std_px": px.std(axis=whole), "blur": laplacian_variance(gray),
    }


FEATURES = list(features(np.zeros((1, 2, 2, 3))))


# ---------------------------------------------------------------- regions
def components(mask: np.ndarray, least: int = 5) -> list[int]:
    """Areas of the 4-connected regions of a mask with at least ``least`` pixels, by union of runs of neighbours."""
    root = np.arange(mask.size)

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    at = np.arange(mask.size).reshape(mask.shape)
    for one, two in ((np.s_[:, :-1], np.s_[:, 1:]), (np.s_[:-1], np.s_[1:])):
        both = mask[one] & mask[two]
        for i, j in zip(at[one][both].tolist(), at[two][both].tolist(), strict=True):
            i, j = find(i), find(j)
            root[max(i, j)] = min(i, j)
    inside = np.flatnonzero(mask.ravel())
    counts = np.bincount([find(i) for i in inside.tolist()]) if len(inside) else np.zeros(0, int)
    return sorted(int(c) for c in counts if c >= least)


def nucleus_channel(rgb: np.ndarray, method: str = "inverted_green") -> np.ndarray:
    """A gray image on 0..255 in which nuclei are bright."""
    x = np.where(rgb.max(axis=(-3, -2, -1), keepdims=True) <= 1.0, np.floor(np.clip(rgb, 0, 1) * 255), rgb).astype(np.float64)
    r, g, b = x[..., 0], x[..., 1], x[..., 2]
    return {"blue": b, "purple": np.maximum(0, 2 * b - r - g)}.get(method, 255 - g)


def nucleus_diameters(rgb: np.ndarray, method: str = "inverted_green", threshold: str = "otsu", darkest: float = 12, band: tuple[float, float] = (25, 75), least: int = 5) -> np.ndarray:
    """Diameters of discs with the areas of the bright regions of one image, between two percentiles of the areas; none for fewer than three regions."""
    gray = nucleus_channel(rgb, method)
    cut = otsu(gray, 256.0) if threshold == "otsu" else np.percentile(gray, 100 - darkest)
    areas = np.array(components(gray >= cut, least), float)
    if len(areas) < 3:
        return np.zeros(0)
    low, high = np.percentile(areas, band)
    return 2 * np.sqrt(areas[(areas >= low) & (areas <= high)] / np.pi)


def resolution(diameters: np.ndarray, physical: float = 7.0) -> float:
    """Units a pixel, from the known size of a nucleus; NaN without any."""
    return physical / float(np.median(diameters)) if len(diameters) else float("nan")


def rasterize(polygons: list[np.ndarray], x0: float, y0: float, width: float, height: float, out_w: int, out_h: int) -> np.ndarray:
    """Mask of the pixels whose centre lies in, or whose square meets the outline of, any polygon of a window of level-0 coordinates.
    Polygons whose bounds miss the window are skipped."""
    mask = np.zeros((out_h, out_w), np.uint8)
    cx, cy = np.arange(out_w) + 0.5, np.arange(out_h) + 0.5
    for poly in polygons:
        low, high = poly.min(axis=0), poly.max(axis=0)
        if len(poly) < 3 or high[0] < x0 or high[1] < y0 or low[0] > x0 + width or low[1] > y0 + height:
            continue
        p = (np.asarray(poly, float) - (x0, y0)) * (out_w / width, out_h / height)
        a, b = p, np.roll(p, -1, axis=0)
        inside = np.zeros((out_h, out_w), bool)
        for (ax, ay), (bx, by) in zip(a, b, strict=True):
            if ay != by:  # an edge turns the pixels right of it
                rows = (cy >= min(ay, by)) & (cy < max(ay, by))
                inside[rows] ^= cx[None, :] > (ax + (cy[rows] - ay) * (bx - ax) / (by - ay))[:, None]
            steps = int(2 * max(abs(bx - ax), abs(by - ay))) + 2
            t = np.linspace(0, 1, steps)
            ex, ey = np.floor(ax + t * (bx - ax)).astype(int), np.floor(ay + t * (by - ay)).astype(int)
            ok = (ex >= 0) & (ex < out_w) & (ey >= 0) & (ey < out_h)
            mask[ey[ok], ex[ok]] = 1
        mask |= inside
    return mask


def center_label(mask: np.ndarray, size: int = 32, least: float = 0.0) -> tuple[int, float]:
    """Whether the share of a mask's centre window exceeds least, and that share."""
    h, w = mask.shape
    part = mask[h // 2 - size // 2 : h // 2 + size // 2, w // 2 - size // 2 : w // 2 + size // 2]
    share = float(part.mean())
    return int(share > least), share


# ---------------------------------------------------------------- resampling
def _cubic(n: int, m: int, a: float = -0.75) -> np.ndarray:
    """m x n weights of bicubic interpolation with half-pixel centres and repeated edges."""
    at = (np.arange(m) + 0.5) * n / m - 0.5
    base = np.floor(at).astype(int)
    out = np.zeros((m, n))
    for k in range(-1, 3):
        d = np.abs(at - (base + k))
        w = np.where(d <= 1, (a + 2) * d**3 - (a + 3) * d**2 + 1, np.where(d < 2, a * d**3 - 5 * a * d**2 + 8 * a * d - 4 * a, 0))
        np.add.at(out, (np.arange(m), np.clip(base + k, 0, n - 1)), w)
    return out


def resize(x: np.ndarray, height: int, width: int) -> np.ndarray:
    """Bicubic, clamped to [0, 1]."""
    rows, columns = _cubic(x.shape[-3], height), _cubic(x.shape[-2], width)
    return np.clip(np.einsum("hi,...ijc,wj->...hwc", rows, x, columns, optimize=True), 0, 1)


# Channel means and deviations that image encoders are commonly fed with.
ENCODER_MEAN, ENCODER_STD = np.array([0.485, 0.456, 0.406]), np.array([0.229, 0.224, 0.225])


def encoder_input(x: np.ndarray, side: int = 224) -> np.ndarray:
    return (resize(x, side, side) - ENCODER_MEAN) / ENCODER_STD


def jitter(x: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """Gain, bias and saturation from three draws of U(0, 1) per image: factors within a tenth of 1, a bias within 0.03."""
    gain, bias, sat = (draws[..., k, None, None, None] for k in range(3))
    x = np.clip(x * (0.9 + 0.2 * gain) + (0.06 * bias - 0.03), 0, 1)
    mean = x.mean(axis=-1, keepdims=True)
    return np.clip((x - mean) * (0.9 + 0.2 * sat) + mean, 0, 1)


# ---------------------------------------------------------------- Arrow columns
def batch_of(px: pa.Array, side: int) -> np.ndarray:
    """An Arrow list column of flattened side x side images as one array."""
    if isinstance(px, pa.ChunkedArray):
        px = px.combine_chunks()
    return np.asarray(px.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(px), side, side, 3)


def list_of(x: np.ndarray, kind: pa.DataType = pa.float64()) -> pa.Array:
    n = len(x)
    width = int(np.prod(x.shape[1:])) if n else 0
    return pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * width, pa.array(x.reshape(-1), kind))


def column(kernel: Callable[[np.ndarray], np.ndarray], side: int):
    """Column function from a kernel of batches to one number an image."""

    @F.arrow_udf("double")
    def run(px: pa.Array) -> pa.Array:
        return pa.array(np.asarray(kernel(batch_of(px, side)), np.float64), pa.float64())

    return run


def image_column(kernel: Callable[[np.ndarray], np.ndarray], side: int, kind: str = "array<double>"):
    """Column function from a kernel of batches to an image, flattened; null gives null and isn't computed."""
    element = pa.int32() if kind == "array<int>" else pa.float64()

    @F.arrow_udf(kind)
    def run(px: pa.Array) -> pa.Array:
        there = np.asarray(px.is_valid().to_numpy(zero_copy_only=False), bool)
        made = list_of(np.asarray(kernel(batch_of(px.drop_null(), side))), element) if there.any() else pa.array([], pa.list_(element))
        place = np.where(there, np.cumsum(there) - 1, 0)
        return made.take(pa.array(place, mask=~there))

    return run


def list_column(kernel: Callable[[np.ndarray], np.ndarray], side: int):
    """Column function from a kernel of single images to a list of any length."""

    @F.arrow_udf("array<double>")
    def run(px: pa.Array) -> pa.Array:
        found = [np.asarray(kernel(x), np.float64) for x in batch_of(px, side)]
        at = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
        return pa.ListArray.from_arrays(at, pa.array(np.concatenate(found) if found else np.zeros(0), pa.float64()))

    return run


def feature_struct(px: str, side: int) -> Column:
    """All features of an image as one struct, in one pass."""

    @F.arrow_udf(f"struct<{', '.join(f'{n}: double' for n in FEATURES)}>")
    def run(x: pa.Array) -> pa.Array:
        found = features(batch_of(x, side)) if len(x) else dict.fromkeys(FEATURES, np.zeros(0))
        return pa.StructArray.from_arrays([pa.array(found[n], pa.float64()) for n in FEATURES], names=FEATURES)

    return run(px)


# ---------------------------------------------------------------- logistic curve and entropy, with the C library's exp and log
def _each(f: Callable[[float], float], x: pa.Array) -> pa.Array:
    """f of each distinct value of a batch; nulls stay."""
    coded = x.dictionary_encode()
    return pa.array([f(v) for v in coded.dictionary.to_pylist()], pa.float64()).take(coded.indices)


def _logistic(z: float) -> float:
    try:
        return 1.0 / (1.0 + math.exp(-z))
    except OverflowError:
        return 0.0


def _entropy(q: float) -> float:
    return -(q * math.log(q) + (1.0 - q) * math.log(1.0 - q))


def logistic(z: str | Column) -> Column:
    """1 / (1 + exp(-z)). Spark's own exp, of another library, is now and then a last bit off, which parts or joins values that tie."""

    @F.arrow_udf("double")
    def run(x: pa.Array) -> pa.Array:
        return _each(_logistic, x)

    return run(z)


def entropy(q: str | Column) -> Column:
    """Of a probability between 0 and 1, both excluded; see logistic."""

    @F.arrow_udf("double")
    def run(x: pa.Array) -> pa.Array:
        return _each(_entropy, x)

    return run(q)
