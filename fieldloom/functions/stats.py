"""Statistics as column expressions. What has not been measured is null, never zero."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Normal quantiles of the two-sided confidence levels.
Z = {0.80: 1.2816, 0.90: 1.6449, 0.95: 1.959964, 0.99: 2.5758}


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b)


def wilson(successes: Column, n: Column, confidence: float = 0.95) -> Column:
    """struct(p, lo, hi); without observations p is null and the interval is [0, 1]."""
    z = Z[confidence]
    p, z2 = successes / n, z * z
    centre = (p + z2 / (2 * n)) / (1 + z2 / n)
    half = z * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n)) / (1 + z2 / n)
    lo, hi = F.greatest(F.lit(0.0), centre - half), F.least(F.lit(1.0), centre + half)
    return F.struct(
        F.when(n > 0, F.round(p, 4)).alias("p"),
        F.when(n > 0, F.round(lo, 4)).otherwise(0.0).alias("lo"),
        F.when(n > 0, F.round(hi, 4)).otherwise(1.0).alias("hi"),
    )


def required_n(margin: Column, p: float = 0.5, confidence: float = 0.95) -> Column:
    return F.ceil(Z[confidence] ** 2 * p * (1 - p) / (margin * margin))


def separated(a: Column, b: Column) -> Column:
    """Whether two intervals have no point in common."""
    return (a["lo"] > b["hi"]) | (b["lo"] > a["hi"])


def rogan_gladen(p: Column, sensitivity: Column, specificity: Column) -> Column:
    """The true rate behind one observed with an imperfect judge; null if the judge can't tell at all."""
    power = sensitivity + specificity - 1
    raw = (p + specificity - 1) / power
    return F.when(power > 1e-9, F.least(F.lit(1.0), F.greatest(F.lit(0.0), raw)))


def rogan_gladen_interval(p: Column, sensitivity: Column, specificity: Column) -> Column:
    """struct(p, lo, hi, clamped): an observed rate corrected at the lower ends, the middle and the upper ends of the judge's
    intervals (structs of p, lo, hi). The rate is held as it is: its own sampling error is not in the interval, which is
    the judge's alone. `clamped` says that the judge can't explain the rate; nulls that it can't tell at all."""
    points = [(sensitivity[e], specificity[e]) for e in ("lo", "p", "hi")]
    fixed = [rogan_gladen(p, *x) for x in points]
    raw = [(p + sp - 1) / F.when(se + sp - 1 > 1e-9, se + sp - 1) for se, sp in points]
    clamped = F.lit(False)
    for r in raw:
        clamped = clamped | F.coalesce((r < 0) | (r > 1), F.lit(False))
    return F.struct(fixed[1].alias("p"), F.least(*fixed).alias("lo"), F.greatest(*fixed).alias("hi"), clamped.alias("clamped"))


def acceptance(interval: Column, limit: float) -> Column:
    return F.when(interval["hi"] <= limit, "accept").when(interval["lo"] > limit, "reject").otherwise("inconclusive")


def chapman(both: Column, first_only: Column, second_only: Column) -> Column:
    """struct(n, var): capture-recapture estimate, never below what was seen; null where nothing was caught twice."""
    n1, n2, m = both + first_only, both + second_only, both
    n = (n1 + 1.0) * (n2 + 1.0) / (m + 1) - 1
    var = (n1 + 1.0) * (n2 + 1.0) * (n1 - m) * (n2 - m) / ((m + 1) * (m + 1) * (m + 2.0))
    return F.when(m > 0, F.struct(F.greatest(n, (n1 + n2 - m).cast("double")).alias("n"), var.alias("var")))


def entropy(p: Column) -> Column:
    """Entropy of an array of probabilities, as a share of the largest possible."""
    h = F.aggregate(F.filter(p, lambda x: x > 0), F.lit(0.0), lambda s, x: s - x * F.log(x))
    return F.when(F.size(p) > 1, h / F.log(F.size(p)))


def margin(p: Column) -> Column:
    """The lead of the most probable over the next."""
    top = F.sort_array(p, False)
    return F.get(top, F.lit(0)) - F.coalesce(F.get(top, F.lit(1)), F.lit(0.0))


def band_uncertainty(conf: Column, low: float, high: float, agree: Column | None = None, mask_differs: Column | None = None) -> Column:
    """A bell over a confidence band, raised where paths or masks disagree, at most 1."""
    mid, half = (low + high) / 2, (high - low) / 2
    u = F.exp(-F.pow((conf - mid) / half, 2))
    if agree is not None:
        u = u + F.when(agree, 0.0).otherwise(0.35)
    if mask_differs is not None:
        u = u + F.when(mask_differs, 0.2).otherwise(0.0)
    return F.least(F.lit(1.0), u)


def min_max(x: Column, window) -> Column:
    """Scaled to [0, 1] over a window; all zero where all are equal."""
    lo, hi = F.min(x).over(window), F.max(x).over(window)
    return F.when(hi > lo, (x - lo) / (hi - lo)).otherwise(0.0)
