"""Array columns of interleaved RGB values in [0, 1] as SQL expressions over higher-order functions; no Python per row."""

from __future__ import annotations


def mean(px: str) -> str:
    return f"(aggregate({px}, 0d, (a, x) -> a + x) / size({px}))"


def std(px: str) -> str:
    """Population standard deviation, two passes."""
    return f"sqrt(aggregate(transform({px}, x -> (x - {mean(px)}) * (x - {mean(px)})), 0d, (a, x) -> a + x) / size({px}))"


def channel(px: str, c: int) -> str:
    return f"transform(sequence(0, size({px}) div 3 - 1), k -> {px}[3 * k + {c}])"


def share(px: str, condition: str) -> str:
    """Share of the elements x for which the condition holds."""
    return f"(size(filter({px}, x -> {condition})) / cast(size({px}) as double))"


def gray(px: str) -> str:
    return f"transform(sequence(0, size({px}) div 3 - 1), k -> ({px}[3 * k] + {px}[3 * k + 1] + {px}[3 * k + 2]) / 3d)"


def luma(px: str) -> str:
    return f"transform(sequence(0, size({px}) div 3 - 1), k -> 0.299d * {px}[3 * k] + 0.587d * {px}[3 * k + 1] + 0.114d * {px}[3 * k + 2])"


def saturation(px: str, eps: str = "1e-8d") -> str:
    top = f"greatest({px}[3 * k], {px}[3 * k + 1], {px}[3 * k + 2])"
    low = f"least({px}[3 * k], {px}[3 * k + 1], {px}[3 * k + 2])"
    return f"transform(sequence(0, size({px}) div 3 - 1), k -> case when {top} > {eps} then ({top} - {low}) / {top} else 0d end)"


def pixel_share(px: str, condition: str) -> str:
    """Share of pixels q for which a condition on q.r, q.g and q.b holds."""
    pixel = f"transform(sequence(0, size({px}) div 3 - 1), k -> named_struct('r', {px}[3 * k], 'g', {px}[3 * k + 1], 'b', {px}[3 * k + 2]))"
    return f"(size(filter({pixel}, q -> {condition})) / (size({px}) / 3d))"


def to_unit(px: str, limit: str = "1d") -> str:
    """Values over the limit anywhere mean a 0..255 scale."""
    return f"case when array_max({px}) > {limit} then transform({px}, x -> least(greatest(x / 255d, 0d), 1d)) else transform({px}, x -> least(greatest(x, 0d), 1d)) end"


def to_u8(px: str) -> str:
    """Truncating; a value over 1 anywhere means a 0..255 scale."""
    return f"case when array_max({px}) > 1d then transform({px}, x -> cast(floor(least(greatest(x, 0d), 255d)) as int)) else transform({px}, x -> cast(floor(least(greatest(x, 0d), 1d) * 255d) as int)) end"


def to_u8_half_even(px: str) -> str:
    """Rounding halves to even; over 1 by more than a millionth anywhere means a 0..255 scale."""
    return f"case when array_max({px}) <= 1d + 1e-6d then transform({px}, x -> cast(bround(least(greatest(x * 255d, 0d), 255d), 0) as int)) else transform({px}, x -> cast(bround(least(greatest(x, 0d), 255d), 0) as int)) end"


def to_u8_clip(px: str) -> str:
    """Clipped to 0..255 without scaling: only right for values on that scale."""
    return f"transform({px}, x -> cast(floor(least(greatest(x, 0d), 255d)) as int))"


def _place(values: str, q: str) -> str:
    """Linear interpolation in sorted values."""
    at = f"({q} * (size({values}) - 1))"
    low = f"{values}[cast(floor({at}) as int)]"
    return f"({low} + ({at} - floor({at})) * ({values}[cast(ceil({at}) as int)] - {low}))"


def percentile(px: str, q: str) -> str:
    """Linear interpolation between sorted values; the array is sorted once."""
    return f"transform(array(array_sort({px})), s -> {_place('s', q)})[0]"


def stretch(px: str, low: str, high: str) -> str:
    """Contrast between two percentiles to [0, 1]; the span is at least 1e-8."""
    ends = f"transform(array(array_sort({px})), s -> named_struct('a', {_place('s', low)}, 'b', {_place('s', high)}))[0]"
    return f"flatten(transform(array({ends}), e -> transform({px}, x -> least(greatest((x - e.a) / greatest(e.b - e.a, 1e-8d), 0d), 1d))))"


def center(mask: str, side: int, size: int):
    """Mean of the size x size window in the middle of a side x side mask."""
    from pyspark.sql import functions as F

    first = side // 2 - size // 2
    inside = f"filter({mask}, (x, i) -> i div {side} >= {first} and i div {side} < {first + size} and i % {side} >= {first} and i % {side} < {first + size})"
    return F.expr(f"aggregate(transform({inside}, x -> cast(x as double)), 0d, (a, x) -> a + x) / {size * size}d")


def pooled(tokens: str, first: int):
    """Token 0 and the mean of the tokens from place ``first`` on, one vector after the other; tokens is an array of arrays."""
    from pyspark.sql import functions as F

    rest = f"slice({tokens}, {first + 1}, size({tokens}) - {first})"
    mean = f"transform({tokens}[0], (x, i) -> aggregate(transform({rest}, t -> t[i]), 0d, (a, v) -> a + v) / size({rest}))"
    return F.expr(f"concat({tokens}[0], {mean})")
