"""Column functions of classes and probability vectors; class order is DOWN, FLAT, UP."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CLASSES = ("DOWN", "FLAT", "UP")


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def classify(x: Column | str, t: float | Column) -> Column:
    """UP above t, DOWN below -t, both bounds FLAT; null and NaN are null, never FLAT."""
    x, t = _col(x), t if isinstance(t, Column) else F.lit(t)
    return F.when(x.isNull() | F.isnan(x), None).when(x > t, "UP").when(x < -t, "DOWN").otherwise("FLAT")


def argmax_class(down: Column | str, flat: Column | str, up: Column | str) -> Column:
    """Class with the largest probability, the earlier one of equal ones."""
    d, f, u = map(_col, (down, flat, up))
    return F.when((d >= f) & (d >= u), "DOWN").when(f >= u, "FLAT").otherwise("UP")


def primary_direction(down: Column | str, up: Column | str) -> Column:
    """UP only if it is likelier than DOWN."""
    return F.when(_col(up) > _col(down), "UP").otherwise("DOWN")


def normalize(ps: list[Column | str], floor: float) -> list[Column]:
    """Each at least floor, divided by their sum."""
    clipped = [F.least(F.greatest(_col(p), F.lit(floor)), F.lit(1.0)) for p in ps]
    total = clipped[0]
    for c in clipped[1:]:
        total = total + c
    return [c / total for c in clipped]


def compose(move: Column | str, up: Column | str) -> list[Column]:
    """Hurdle: down, flat, up from the chance of a move and of up given a move."""
    m, u = _col(move), _col(up)
    return [m * (1 - u), 1 - m, m * u]


def decompose(down: Column | str, flat: Column | str, up: Column | str) -> list[Column]:
    """The inverse; up given a move is 0.5 if there is none."""
    d, u = _col(down), _col(up)
    return [d + u, F.when(d + u > 0, u / (d + u)).otherwise(0.5)]


def mix(a: list[Column | str], b: list[Column | str], w: float = 0.5) -> list[Column]:
    return [_col(x) * w + _col(y) * (1 - w) for x, y in zip(a, b)]


def round_to_100(ps: list[Column | str]) -> list[Column]:
    """Whole percentages that add up to 100: the largest remainders are rounded up, the earlier ones first."""
    scaled = [F.round(_col(p) * 100, 9) for p in ps]
    floors = [F.floor(s) for s in scaled]
    left = F.lit(100)
    for f in floors:
        left = left - f
    out = []
    for i, (s, f) in enumerate(zip(scaled, floors)):
        rank = F.lit(0)
        for j, (t, g) in enumerate(zip(scaled, floors)):
            if j != i:
                ahead = (t - g >= s - f) if j < i else (t - g > s - f)
                rank = rank + ahead.cast("int")
        out.append((f + (rank < left).cast("int")).cast("int"))
    return out


def valid_percentages(ps: list[Column | str]) -> Column:
    """Whole numbers from 0 to 100 that add up to 100."""
    total, ok = F.lit(0), F.lit(True)
    for p in map(_col, ps):
        ok, total = ok & p.between(0, 100), total + p
    return F.coalesce(ok & (total == 100), F.lit(False))


def wilson(k: Column | str, n: Column | str, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """95 % interval of a share; null without rows."""
    k, n = _col(k).cast("double"), _col(n).cast("double")
    p, d = k / n, 1 + z * z / n
    mid, half = (p + z * z / (2 * n)) / d, z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / d
    return mid - half, mid + half


def half_up_step(x: Column | str, step: float, least: float) -> Column:
    """Nearest multiple of step, halves up, at least `least`."""
    return F.greatest(F.lit(least), F.floor(_col(x) / step + 0.5) * step)


def js_round(x: Column | str, digits: int) -> Column:
    """Rounded with halves towards plus infinity."""
    return F.floor(_col(x) * 10**digits + 0.5) / 10**digits


def cdf_to_classes(quantiles: Column, levels: list[float], t: float) -> list[Column]:
    """Class probabilities from predicted quantiles (array, sorted here) at levels, by linear interpolation; tails reach out by one quantile range."""
    q = F.array_sort(quantiles)
    n = len(levels)
    span = F.greatest(q[n - 1] - q[0], F.lit(1e-6))
    xs = F.concat(F.array(q[0] - span), q, F.array(q[n - 1] + span))
    ys = [0.0, *levels, 1.0]

    def below(x: float) -> Column:
        out = F.when(F.lit(x) <= xs[0], 0.0)
        for i in range(n + 1):
            a, b = xs[i], xs[i + 1]
            out = out.when(F.lit(x) <= b, ys[i] + (ys[i + 1] - ys[i]) * F.when(b > a, (F.lit(x) - a) / (b - a)).otherwise(1.0))
        return out.otherwise(1.0)

    down, up = below(-t), 1 - below(t)
    return [down, 1 - down - up, up]
