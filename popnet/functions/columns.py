"""Scalar functions as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Double precision: the distance from 1 to the next number.
EPSILON = 2.220446049250313e-16


def gaussian(distance: Column, bandwidth: Column) -> Column:
    """exp(-(d/h)^2 / 2)."""
    r = distance / bandwidth
    return F.exp(F.lit(-0.5) * r * r)


def exponential(distance: Column, bandwidth: Column) -> Column:
    """exp(-d/h)."""
    return F.exp(-(distance / bandwidth))


KERNELS = {"gaussian": gaussian, "exponential": exponential}


def kernel(name: str, distance: Column, bandwidth: Column) -> Column:
    """The kernel ``name`` (in any case), in [0, 1]; a distance that is negative or not finite, or such a bandwidth or zero, raises."""
    try:
        value = KERNELS[name.strip().lower()](distance, bandwidth)
    except KeyError:
        raise ValueError(f"unknown kernel {name!r}; one of {sorted(KERNELS)}") from None
    number = lambda c: ~F.isnan(c) & (F.abs(c) < float("inf"))
    fine = number(distance) & (distance >= 0) & number(bandwidth) & (bandwidth > 0)
    return F.when(distance.isNull() | bandwidth.isNull() | fine, value).otherwise(F.raise_error(F.lit("a kernel needs finite distances of at least zero and a finite positive bandwidth")))


def size_factor(correction: str, n_target: Column, n_source: Column, same: Column) -> Column:
    """What a source group's cells count: 1, or at most the target group's size by its own."""
    if correction == "none":
        return F.lit(1.0)
    if correction != "cap-to-target":
        raise ValueError(f"unknown group size correction {correction!r}")
    return F.when(same, F.lit(1.0)).otherwise(F.least(F.lit(1.0), n_target.cast("double") / n_source))


def library_log1p(count: Column, library: Column, target_sum: float) -> Column:
    """log(1 + count * (target_sum / library))."""
    return F.log1p(count * (F.lit(float(target_sum)) / library))


def slug(name: Column) -> Column:
    """A directory name: runs of other characters than ASCII letters and digits become one hyphen; 64 characters at most."""
    plain = F.trim(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), F.lit("-"))
    cut = F.rtrim(F.substring(plain, 1, 64), F.lit("-"))
    return F.when(cut == "", F.lit("analysis")).otherwise(cut)


def name_hash(name: Column) -> Column:
    """The first 16 hexadecimal digits of a name's SHA-256: their order is that of the unsigned number."""
    return F.substring(F.sha2(name.cast("string"), 256), 1, 16)


def finite(text: Column) -> Column:
    """A text as a finite double, else null; suffixes such as ``1d`` are no numbers."""
    tried = text.try_cast("double")
    bad = F.isnan(tried) | (F.abs(tried) == float("inf")) | text.rlike(r"[dDfF]\s*$")
    return F.when(~bad, tried)


def identifier_fault(name: Column) -> Column:
    """Why a name is no identifier (``empty``, ``untrimmed``, ``control``), or null."""
    return (
        F.when(name.isNull() | (F.trim(name) == ""), "empty")
        .when(name.rlike("[\\x00\\r\\n]"), "control")
        .when(name.rlike(r"^\s|\s$"), "untrimmed")
    )
