"""Hyper-parameter search that computes each fingerprint setting once for all estimator settings."""

from __future__ import annotations

import itertools
import random
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from typing import Any

from pyspark.ml.tuning import CrossValidator, CrossValidatorModel
from pyspark.sql import DataFrame


@dataclass
class Found:
    """The best setting of the features, its cross-validated model, its score and all scores."""

    params: dict[str, Any]
    model: CrossValidatorModel
    score: float
    scores: list[tuple[dict[str, Any], float]]


def grid(values: dict[str, Iterable]) -> list[dict[str, Any]]:
    names = sorted(values)
    return [dict(zip(names, v, strict=True)) for v in itertools.product(*(list(values[n]) for n in names))]


def sampled(values: dict[str, Iterable], n_iter: int, seed: int = 0) -> list[dict[str, Any]]:
    """``n_iter`` different settings of the grid, or all if it has fewer."""
    every = grid(values)
    return random.Random(seed).sample(every, min(n_iter, len(every)))


def search(df: DataFrame, features: Callable[..., DataFrame], settings: list[dict[str, Any]], validator: CrossValidator, greater_is_better: bool = True) -> Found:
    """Tries every setting of ``features`` (df, **setting) with the inner ``validator``; the first of
    equal scores stays. Features of one setting are cached while its estimators are fitted."""
    if not settings:
        raise ValueError("no settings to try")
    best: Found | None = None
    scores = []
    for s in settings:
        table = features(df, **s).cache()
        try:
            model = validator.fit(table)
        finally:
            table.unpersist()
        score = max(model.avgMetrics) if greater_is_better else min(model.avgMetrics)
        scores.append((s, score))
        if best is None or (score > best.score if greater_is_better else score < best.score):
            best = Found(s, model, score, scores)
    best.scores = scores
    return best
