"""Row-local operators on streams: fingerprints and rules need no state, so a streaming DataFrame
goes through the same functions as a static one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame

from ..functions import similarity
from ..operators.rules import RuleSet, apply_rules


def filter_stream(stream: DataFrame, rules: RuleSet | str, **options) -> DataFrame:
    """apply_rules on a stream; options as there."""
    return apply_rules(stream, rules, **options)


def score_stream(stream: DataFrame, bits: str, reference: Column, width: int, metric: str = "tanimoto", out: str = "similarity") -> DataFrame:
    """The stream with its similarity to one packed reference vector."""
    return stream.withColumn(out, similarity.binary_similarity(metric, stream[bits], reference, width))
