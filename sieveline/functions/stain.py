"""Colour normalisation of stained images: luminosity in CIELAB, Reinhard, Macenko and Vahadane, and the router between them.

Written from the publications (Reinhard et al., 2001; Macenko et al., 2009; Vahadane et al., 2016). Images are float arrays (height, width, 3) in [0, 1]. A fitted normaliser is a
small object that is shipped to the tasks with the closure; one that cannot treat an image returns None, and the router takes the next.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np

from sieveline.functions import kernels as K

#: Codes of the normaliser that produced a row.
MACENKO, REINHARD, MACENKO_FALLBACK, REINHARD_FALLBACK, LUMINOSITY = range(5)
CODES = ("macenko", "reinhard", "macenko_fallback", "reinhard_fallback", "luminosity_only")
#: Least red mean, pink share and saturation of a plausible result.
GUARD = (0.08, 0.01, 0.03)

# Linear sRGB to XYZ under D65, and that white.
_XYZ = np.array([[0.412453, 0.357580, 0.180423], [0.212671, 0.715160, 0.072169], [0.019334, 0.119193, 0.950227]])
_WHITE = np.array([0.950456, 1.0, 1.088754])


def to_lab(rgb: np.ndarray) -> np.ndarray:
    linear = np.where(rgb > 0.04045, ((rgb + 0.055) / 1.055) ** 2.4, rgb / 12.92)
    t = linear @ _XYZ.T / _WHITE
    f = np.where(t > 0.008856, np.cbrt(t), 7.787 * t + 16 / 116)
    return np.stack([116 * f[..., 1] - 16, 500 * (f[..., 0] - f[..., 1]), 200 * (f[..., 1] - f[..., 2])], axis=-1)


def from_lab(lab: np.ndarray) -> np.ndarray:
    y = (lab[..., 0] + 16) / 116
    f = np.stack([y + lab[..., 1] / 500, y, y - lab[..., 2] / 200], axis=-1)
    t = np.where(f > 0.206893, f**3, (f - 16 / 116) / 7.787) * _WHITE
    linear = np.clip(t @ np.linalg.inv(_XYZ).T, 0, 1)
    return np.clip(np.where(linear > 0.0031308, 1.055 * linear ** (1 / 2.4) - 0.055, 12.92 * linear), 0, 1)


def luminosity(rgb: np.ndarray, percentile: float = 95) -> np.ndarray:
    """Scale L so that its percentile becomes white, on whole batches; an image that is black there stays."""
    lab = to_lab(rgb)
    top = np.percentile(lab[..., 0], percentile, axis=(-2, -1), keepdims=True)
    lab[..., 0] = np.where(top > 1e-6, np.clip(100 * lab[..., 0] / np.maximum(top, 1e-6), 0, 100), lab[..., 0])
    return np.where(top[..., None] > 1e-6, from_lab(lab), rgb)


@dataclass
class Reinhard:
    """Means and deviations of the LAB channels become those of the reference."""

    mean: np.ndarray
    std: np.ndarray

    @classmethod
    def fit(cls, rgb: np.ndarray) -> Reinhard:
        lab = to_lab(rgb)
        return cls(lab.mean(axis=(0, 1)), lab.std(axis=(0, 1)))

    def transform(self, rgb: np.ndarray) -> np.ndarray | None:
        lab = to_lab(rgb)
        std = lab.std(axis=(0, 1))
        if (std < 1e-8).any():
            return None
        return from_lab((lab - lab.mean(axis=(0, 1))) / std * self.std + self.mean)


def density(rgb: np.ndarray) -> np.ndarray:
    return -np.log(np.maximum(rgb, 1e-6))


def tissue_pixels(rgb: np.ndarray, limit: float = 0.8) -> np.ndarray:
    """Optical densities of the pixels whose lightness is under the limit."""
    return density(rgb)[to_lab(rgb)[..., 0] / 100 < limit]


def macenko_stains(rgb: np.ndarray, percentile: float = 99) -> np.ndarray | None:
    """Two unit rows: the extreme directions of tissue densities in the plane of their greatest variance."""
    dense = tissue_pixels(rgb)
    if len(dense) < 3:
        return None
    values, vectors = np.linalg.eigh(np.cov(dense, rowvar=False))
    if values[1] < 1e-12:
        return None
    plane = vectors[:, [2, 1]]
    plane = plane * np.where(plane[0] < 0, -1, 1)
    angle = np.arctan2(dense @ plane[:, 1], dense @ plane[:, 0])
    ends = np.percentile(angle, [100 - percentile, percentile])
    rows = np.stack([plane @ (np.cos(t), np.sin(t)) for t in ends])
    rows = rows[np.argsort(-rows[:, 0], kind="stable")]
    norm = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / norm if (norm > 1e-8).all() else None


def amounts(dense: np.ndarray, stains: np.ndarray, penalty: float = 0.01) -> np.ndarray:
    """Non-negative amounts of two stains with an L1 penalty, exactly: both, or the better single one, or none."""
    gram, target = stains @ stains.T, dense @ stains.T - penalty
    det = gram[0, 0] * gram[1, 1] - gram[0, 1] ** 2
    if det < 1e-12:
        return np.maximum(target / np.diag(gram), 0) * (1, 0)
    both = np.stack([gram[1, 1] * target[:, 0] - gram[0, 1] * target[:, 1], gram[0, 0] * target[:, 1] - gram[0, 1] * target[:, 0]], axis=1) / det
    single = np.maximum(target / np.diag(gram), 0)
    first = single[:, 0] ** 2 * gram[0, 0] >= single[:, 1] ** 2 * gram[1, 1]
    one = np.where(np.stack([first, ~first], axis=1), single, 0)
    return np.where((both >= 0).all(axis=1, keepdims=True), both, one)


def vahadane_stains(rgb: np.ndarray, penalty: float = 0.1, rounds: int = 50) -> np.ndarray | None:
    """Two non-negative unit rows by sparse dictionary learning: amounts and stains in turn, from Macenko's as the start."""
    rows, dense = macenko_stains(rgb), tissue_pixels(rgb)
    if rows is None:
        return None
    rows = np.maximum(rows, 1e-3)
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    for _ in range(rounds):
        c = amounts(dense, rows, penalty)
        gram, target, last = c.T @ c, c.T @ dense, rows.copy()
        for k in range(2):  # a coordinate step for each stain
            if gram[k, k] > 1e-12:
                rows[k] = np.maximum(rows[k] + (target[k] - gram[k] @ rows) / gram[k, k], 0)
                rows[k] /= max(np.linalg.norm(rows[k]), 1e-12)
        if np.abs(rows - last).max() < 1e-7:
            break
    return rows[np.argsort(-rows[:, 0], kind="stable")]


@dataclass
class Stain:
    """Amounts of an image's own stains, scaled to the reference's and given its colours."""

    separate: Callable[[np.ndarray], np.ndarray | None]
    stains: np.ndarray
    high: np.ndarray

    @classmethod
    def fit(cls, rgb: np.ndarray, separate: Callable[[np.ndarray], np.ndarray | None] = macenko_stains) -> Stain:
        rows = separate(rgb)
        if rows is None:
            raise ValueError("the reference has no tissue to separate stains in")
        return cls(separate, rows, np.percentile(amounts(density(rgb).reshape(-1, 3), rows), 99, axis=0))

    def transform(self, rgb: np.ndarray) -> np.ndarray | None:
        rows = self.separate(rgb)
        if rows is None:
            return None
        c = amounts(density(rgb).reshape(-1, 3), rows)
        high = np.percentile(c, 99, axis=0)
        if (high < 1e-8).any():
            return None
        return np.clip(np.exp(-(c * (self.high / high)) @ self.stains), 0, 1).reshape(rgb.shape)


@dataclass
class Pack:
    """Normalisers fitted to one reference image, and its mean colour."""

    macenko: Stain | None
    reinhard: Reinhard
    mean_rgb: np.ndarray
    vahadane: Stain | None = field(default=None)

    @classmethod
    def fit(cls, rgb: np.ndarray, vahadane: bool = False, standardize: Callable = luminosity) -> Pack:
        light = standardize(rgb)
        return cls(Stain.fit(light), Reinhard.fit(rgb), rgb.mean(axis=(0, 1)), Stain.fit(light, vahadane_stains) if vahadane else None)


def implausible(rgb: np.ndarray, guard: tuple[float, float, float] = GUARD) -> bool:
    """Whether a result is too dark in red, lacks pink, or lacks saturation."""
    return bool(rgb[..., 0].mean() < guard[0] or (rgb[..., 0] > rgb[..., 2]).mean() < guard[1] or K.saturation(rgb).mean() < guard[2])


def _quantised(rgb: np.ndarray) -> np.ndarray:
    """Results are bytes before they are values again."""
    return np.floor(np.clip(rgb, 0, 1) * 255) / 255


def adaptive(rgb: np.ndarray, pack: Pack, threshold: float, standardize: Callable = luminosity) -> tuple[np.ndarray, int]:
    """Reinhard under the threshold of blue dominance, else Macenko; the other where that fails; luminosity alone where both fail
    or the result is implausible. Returns the image and the code of what made it."""
    light, first = standardize(rgb), float((rgb[..., 2] > rgb[..., 0]).mean()) < threshold
    order = [(pack.reinhard, REINHARD), (pack.macenko, MACENKO_FALLBACK)] if first else [(pack.macenko, MACENKO), (pack.reinhard, REINHARD_FALLBACK)]
    for tool, code in order:
        out = tool.transform(light) if tool is not None else None
        if out is not None:
            out = _quantised(out)
            return (out, code) if not implausible(out) else (_quantised(light), LUMINOSITY)
    return _quantised(light), LUMINOSITY


def classical(rgb: np.ndarray, tool, code: int = MACENKO, standardize: Callable = luminosity) -> tuple[np.ndarray, int]:
    """One normaliser after luminosity, without guardrails; luminosity alone where it fails."""
    light = standardize(rgb)
    out = tool.transform(light) if tool is not None else None
    return (_quantised(light), LUMINOSITY) if out is None else (_quantised(out), code)


def transform_of(tool, standardize: Callable = luminosity) -> Callable[[np.ndarray], np.ndarray]:
    """A function of images that closes over a fitted normaliser."""
    return lambda rgb: classical(rgb, tool, standardize=standardize)[0]
