"""Immutable settings of a preparation and of an inference run; scalars are checked when made."""

from __future__ import annotations

import math
import os
from collections.abc import Callable
from dataclasses import MISSING, asdict, dataclass, field, fields
from typing import Any

from popnet.operators.weighting import MODES

MAX_SEED = 2**32 - 1
#: Accepted values of the settings that are choices.
CHOICES = {
    "weight_mode": MODES,
    "distance_space": ("pca", "expression"),
    "distance_standardization": ("none", "standard"),
    "distance_metric": ("euclidean", "cosine"),
    "kernel": ("gaussian", "exponential"),
    "group_size_correction": ("none", "cap-to-target"),
    "pca_svd_solver": ("auto", "randomized", "full"),
    "parallel_backend": ("auto", "threads", "processes"),
    "tree_method": ("extra-trees", "random-forest"),
    "gene_identifier": ("name", "id"),
    "duplicate_gene_policy": ("sum", "error"),
    "uncounted_cells": ("error", "exclude"),
    "normalization": ("library-size-log1p",),
}


Rule = Callable[[str, Any], Any]


def _number(value: object) -> bool:
    return isinstance(value, (int, float)) and not isinstance(value, bool)


def setting(rule: Rule, default: Any = MISSING) -> Any:
    """A field whose values ``rule`` (name, value) checks and brings to their form."""
    return field(default=default, metadata={"rule": rule})


def path(name: str, value: Any) -> str:
    """A path as a text."""
    if not isinstance(value, (str, os.PathLike)):
        raise TypeError(f"{name}: {value!r} is no path")
    return os.fspath(value)


def choice(name: str, value: Any) -> Any:
    """One of the field's CHOICES."""
    if value not in CHOICES[name]:
        raise ValueError(f"{name}: {value!r} is none of {', '.join(CHOICES[name])}")
    return value


def whole(least: int, most: int | None = None) -> Rule:
    """Whole numbers of a range."""

    def rule(name: str, value: Any) -> int:
        if type(value) is not int:
            raise TypeError(f"{name}: {value!r} is no whole number")
        if value < least or most is not None and value > most:
            raise ValueError(f"{name}: {value} is under {least}" if value < least else f"{name}: {value} is over {most}")
        return value

    return rule


def between(low: float, high: float, open_low: bool = False) -> Rule:
    """Finite numbers of a range, as doubles."""

    def rule(name: str, value: Any) -> float:
        if not _number(value):
            raise TypeError(f"{name}: {value!r} is no number")
        if not math.isfinite(value) or not low <= value <= high or open_low and value == low:
            raise ValueError(f"{name}: {value} is outside {'(' if open_low else '['}{low}, {high}]")
        return float(value)

    return rule


positive = between(0, math.inf, open_low=True)


def either(fixed: object, other: Rule) -> Rule:
    """``fixed`` itself, or what ``other`` accepts; a text that is not ``fixed`` is a wrong value, not a wrong type."""

    def rule(name: str, value: Any) -> Any:
        if value is fixed or isinstance(value, str) and value == fixed:
            return value
        if isinstance(value, str) and isinstance(fixed, str):
            raise ValueError(f"{name}: the only text is {fixed!r}")
        return other(name, value)

    return rule


def flag(name: str, value: Any) -> bool:
    """True or False."""
    if type(value) is not bool:
        raise TypeError(f"{name}: {value!r} is neither True nor False")
    return value


def feature_share(name: str, value: Any) -> Any:
    """How many features a split looks at: a root or logarithm of them, their number, or their share."""
    if isinstance(value, str):
        if value not in ("sqrt", "log2"):
            raise ValueError(f"{name}: {value!r} is neither 'sqrt' nor 'log2'")
        return value
    return whole(1)(name, value) if type(value) is int else between(0, 1, open_low=True)(name, value)


class _Checked:
    def __post_init__(self) -> None:
        for f in fields(self):
            object.__setattr__(self, f.name, f.metadata["rule"](f.name, getattr(self, f.name)))

    def to_dict(self) -> dict[str, Any]:
        """All settings, ready for JSON."""
        return asdict(self)


@dataclass(frozen=True, kw_only=True)
class PrepareConfig(_Checked):
    """Settings of a preparation.  ``counts`` is a folder of Parquet or matrix-market tables, or an HDF5 file.

    Annotated cells that the matrix lacks, or without counts there, are an error, or (``uncounted_cells`` ``exclude``) have
    no column in their unit; they count for ``min_cells`` all the same, which is a rule on annotations.
    """

    counts: str = setting(path)
    annotations: str = setting(path)
    tf_list: str = setting(path)
    output_dir: str = setting(path)
    centroid_weights: str | None = setting(either(None, path), None)
    gene_identifier: str = setting(choice, "name")
    duplicate_gene_policy: str = setting(choice, "sum")
    uncounted_cells: str = setting(choice, "error")
    min_cells: int = setting(whole(1), 300)
    min_gene_cells: int = setting(whole(1), 1)
    normalization: str = setting(choice, "library-size-log1p")
    target_sum: float = setting(positive, 10_000.0)


@dataclass(frozen=True, kw_only=True)
class InferConfig(_Checked):
    """Settings of an inference run.

    ``threads`` and ``parallel_backend`` are accepted and recorded: Spark schedules the work.
    The run's metadata says how components were found and how far they can be off.
    """

    expression: str = setting(path)
    tf_list: str = setting(path)
    groups: str = setting(path)
    output_dir: str = setting(path)
    weight_mode: str = setting(choice, "cell-distance-group-anchored")
    distance_space: str = setting(choice, "pca")
    n_components: int = setting(whole(1), 50)
    distance_standardization: str = setting(choice, "none")
    distance_metric: str = setting(choice, "cosine")
    kernel: str = setting(choice, "gaussian")
    bandwidth: float | str = setting(either("auto", positive), "auto")
    bandwidth_scale: float = setting(positive, 1.0)
    group_size_correction: str = setting(choice, "none")
    tree_method: str = setting(choice, "extra-trees")
    n_estimators: int = setting(whole(1), 50)
    max_features: str | int | float = setting(feature_share, 0.5)
    min_samples_leaf: int = setting(whole(1), 2)
    max_depth: int | None = setting(either(None, whole(1)), None)
    min_weight_fraction_leaf: float = setting(between(0, 0.5), 0.1)
    bootstrap: bool | None = setting(either(None, flag), None)
    random_seed: int = setting(whole(0, MAX_SEED), 123)
    pca_svd_solver: str = setting(choice, "auto")
    threads: int | str = setting(either("auto", whole(1)), "auto")
    parallel_backend: str = setting(choice, "auto")
    report: bool = setting(flag, True)
    target_list: str | None = setting(either(None, path), None)
    centroid_weights: str | None = setting(either(None, path), None)

    def __post_init__(self) -> None:
        super().__post_init__()
        if self.bandwidth != "auto" and self.bandwidth_scale != 1.0:
            raise ValueError("bandwidth_scale: only an automatic bandwidth is scaled")
