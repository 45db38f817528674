"""Classification, regression and virtual-screening metrics over long tables (task, y, p).

A task whose metric is undefined gives null; ``mean_over_tasks`` averages the others. Rows with
a null label or prediction are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.moments import beta_cdf
from .running import running_sums


def _clean(df: DataFrame, y: str, p: str) -> DataFrame:
    return df.filter(F.col(y).isNotNull() & F.col(p).isNotNull() & ~F.isnan(F.col(y).cast("double")) & ~F.isnan(F.col(p).cast("double")))


def _confusion(y: Column, p: Column) -> dict[str, Column]:
    of = lambda a, b: F.sum(((y == a) & (p == b)).cast("double"))
    return {"tp": of(1, 1), "fp": of(0, 1), "fn": of(1, 0), "tn": of(0, 0)}


def _div(top: Column, bottom: Column, empty: float | None = None) -> Column:
    return F.when(bottom != 0, F.try_divide(top, bottom)).otherwise(F.lit(empty).cast("double"))


def confusion_metrics(df: DataFrame, task: str = "task", y: str = "y", p: str = "p") -> DataFrame:
    """One row a task: accuracy, balanced accuracy, Cohen's kappa, F1, Matthews correlation, precision, recall."""
    t = _clean(df, y, p).groupBy(task).agg(*[c.alias(k) for k, c in _confusion(F.col(y), F.col(p)).items()])
    tp, fp, fn, tn = (F.col(k) for k in ("tp", "fp", "fn", "tn"))
    n = tp + fp + fn + tn
    expected = ((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn)) / (n * n)
    accuracy = (tp + tn) / n
    recall, specificity = _div(tp, tp + fn), _div(tn, tn + fp)
    root = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    return t.select(
        task,
        accuracy.alias("accuracy"),
        F.when(recall.isNull(), specificity).when(specificity.isNull(), recall).otherwise((recall + specificity) / 2).alias("balanced_accuracy"),
        _div(accuracy - expected, 1 - expected).alias("cohen_kappa"),
        _div(2 * tp, 2 * tp + fp + fn, 0.0).alias("f1"),
        _div(tp * tn - fp * fn, root, 0.0).alias("matthews"),
        _div(tp, tp + fp, 0.0).alias("precision"),
        _div(tp, tp + fn, 0.0).alias("recall"),
    )


def regression_metrics(df: DataFrame, task: str = "task", y: str = "y", p: str = "p") -> DataFrame:
    """One row a task: mean absolute error, mean squared error and its root."""
    e = F.col(y).cast("double") - F.col(p).cast("double")
    return _clean(df, y, p).groupBy(task).agg(F.avg(F.abs(e)).alias("mae"), F.avg(e * e).alias("mse"), F.sqrt(F.avg(e * e)).alias("rmse"))


def _by_score(df: DataFrame, task: str, y: str, p: str) -> DataFrame:
    """Positives and negatives of each different score: windows then run over scores, not rows."""
    clean = _clean(df, y, p)
    return clean.groupBy(F.col(task).alias("task"), F.col(p).cast("double").alias("s")).agg(F.sum(F.col(y).cast("double")).alias("pos"), F.sum(1.0 - F.col(y).cast("double")).alias("neg"))


def auroc(df: DataFrame, task: str = "task", y: str = "y", p: str = "p", constant_target: str = "null") -> DataFrame:
    """(task, auroc) by the rank sum with ties at half. With one class only: null, 1.0 (``constant_target``
    "pass"), or an error ("raise")."""
    if constant_target not in ("null", "pass", "raise"):
        raise ValueError("constant_target must be null, pass or raise")
    t = running_sums(_by_score(df, task, y, p), ["task"], "s", {"under": F.col("neg")})
    sums = t.groupBy("task").agg(F.sum(F.col("pos") * (F.col("under") + F.col("neg") / 2)).alias("u"), F.sum("pos").alias("n1"), F.sum("neg").alias("n0"))
    alone = {"null": F.lit(None).cast("double"), "pass": F.lit(1.0), "raise": F.raise_error(F.lit("a task has one class only")).cast("double")}[constant_target]
    area = F.when(F.col("n1") * F.col("n0") == 0, alone).otherwise(F.try_divide(F.col("u"), F.col("n1") * F.col("n0")))
    return sums.select(F.col("task").alias(task), area.alias("auroc"))


def auprc(df: DataFrame, task: str = "task", y: str = "y", p: str = "p") -> DataFrame:
    """(task, auprc): average precision over falling scores, ties together; null without positives."""
    t = running_sums(_by_score(df, task, y, p), ["task"], "s", {"tp": F.col("pos"), "fp": F.col("neg")}, descending=True)
    t = t.withColumns({"tp": F.col("tp") + F.col("pos"), "fp": F.col("fp") + F.col("neg")})
    sums = t.groupBy("task").agg(F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))).alias("a"), F.sum("pos").alias("n1"))
    return sums.select(F.col("task").alias(task), _div(F.col("a"), F.col("n1")).alias("auprc"))


def _average_rank(df: DataFrame, task: str, value: str, out: str) -> DataFrame:
    counts = df.groupBy(F.col(task).alias("_k"), F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    ranks = running_sums(counts, ["_k"], "_v", {"_before": F.col("_n")})
    ranks = ranks.select("_k", "_v", (F.col("_before") + (F.col("_n") + 1) / 2).alias(out))
    return df.join(ranks, (df[task].eqNullSafe(F.col("_k"))) & (df[value] == F.col("_v"))).drop("_k", "_v")


ALTERNATIVES = ("two-sided", "less", "greater")


def spearman(df: DataFrame, task: str = "task", y: str = "y", p: str = "p", equal_values_result: float = 1.0, alternative: str = "two-sided", p_value: bool = False) -> DataFrame:
    """(task, spearman): correlation of average ranks; ``equal_values_result`` where all values are
    close to equal between label and prediction, null where one side is constant.

    With ``p_value`` beside it the probability of such a correlation by chance, from Student's
    distribution with n - 2 degrees of freedom, for the given alternative.
    """
    if alternative not in ALTERNATIVES:
        raise ValueError(f"alternative must be one of {ALTERNATIVES}")
    clean = _clean(df, y, p).select(F.col(task).alias("task"), F.col(y).cast("double").alias("y"), F.col(p).cast("double").alias("p"))
    ranked = _average_rank(_average_rank(clean, "task", "y", "ry"), "task", "p", "rp")
    close = F.min((F.abs(F.col("y") - F.col("p")) <= 1e-8 + 1e-5 * F.abs(F.col("p"))).cast("int"))
    got = ranked.groupBy("task").agg(close.alias("close"), F.try_divide(F.covar_pop("ry", "rp"), F.stddev_pop("ry") * F.stddev_pop("rp")).alias("rho"), F.count("*").alias("n"), F.min("y").alias("a"), F.max("y").alias("b"), F.min("p").alias("c"), F.max("p").alias("d"))
    rho = F.when(F.col("close") == 1, F.lit(float(equal_values_result))).when((F.col("a") == F.col("b")) | (F.col("c") == F.col("d")), F.lit(None)).otherwise(F.col("rho"))
    out = got.select(F.col("task").alias(task), rho.cast("double").alias("spearman"), "n")
    if not p_value:
        return out.drop("n")

    def chance(r: float | None, n: int) -> float | None:
        if r is None or n < 3:
            return None
        tail = 0.0 if abs(r) >= 1 else beta_cdf(1 - r * r, (n - 2) / 2, 0.5) / 2  # P(T >= |t|)
        if alternative == "two-sided":
            return 2 * tail
        return tail if (r > 0) == (alternative == "greater") else 1 - tail

    return out.withColumn("p_value", F.udf(chance, "double")("spearman", "n")).drop("n")  # a row a task


def _ranked_actives(df: DataFrame, y: str, p: str) -> DataFrame:
    """First rank and number of actives of each score; ties favour actives, as with sorted (score, label)."""
    t = _clean(df, y, p).groupBy(F.col(p).cast("double").alias("s")).agg(F.count("*").alias("n"), F.sum(F.col(y).cast("long")).alias("pos"), F.min(F.col(y).isin(0, 1)).alias("ok"))
    return running_sums(t, [], "s", {"_above": F.col("n")}, descending=True).withColumn("first", F.col("_above") + 1).drop("_above")


def screening_metrics(df: DataFrame, y: str = "y", p: str = "p", fraction: float = 0.05, alpha: float = 20.0) -> DataFrame:
    """One row: enrichment_factor, rie, bedroc of a ranking (first ranks are best).

    Windows run over different scores. The sum over the actives of a score is a geometric series.
    """
    if not 0 < fraction <= 1 or alpha <= 0:
        raise ValueError("fraction must be in (0, 1] and alpha positive")
    t = _ranked_actives(df, y, p)
    total = t.agg(F.sum("n").alias("rows"), F.sum("pos").alias("actives"), F.min("ok").alias("valid"))
    top = F.ceil(F.lit(fraction) * F.col("rows"))
    inside = F.greatest(F.lit(0), F.least(F.col("pos"), top - F.col("first") + 1))
    q = F.exp(F.lit(-alpha) / F.col("rows"))
    series = F.pow(q, F.col("first")) * (1 - F.pow(q, F.col("pos"))) / (1 - q)
    sums = t.crossJoin(F.broadcast(total)).groupBy("rows", "actives", "valid").agg(F.sum(inside).alias("hits"), F.sum(series).alias("w"))
    n, a = F.col("rows").cast("double"), F.col("actives").cast("double")
    rie = (n / a) * F.col("w") / ((1 - F.exp(F.lit(-alpha))) / (F.exp(F.lit(alpha) / n) - 1))
    ratio = a / n
    low = (1 - F.exp(F.lit(alpha) * ratio)) / (ratio * (1 - F.exp(F.lit(alpha))))
    high = (1 - F.exp(F.lit(-alpha) * ratio)) / (ratio * (1 - F.exp(F.lit(-alpha))))
    checked = sums.filter(F.when(F.col("valid"), F.lit(True)).otherwise(F.raise_error(F.lit("labels must be 0 or 1")).cast("boolean")))
    return checked.select((F.col("hits") / (F.lit(fraction) * a)).alias("enrichment_factor"), rie.alias("rie"), ((rie - low) / (high - low)).alias("bedroc"))


def mean_over_tasks(per_task: DataFrame, metric: str) -> DataFrame:
    """One row: the unweighted mean over tasks where the metric is defined; an error if it never is."""
    out = per_task.agg(F.avg(metric).alias(metric))
    return out.withColumn(metric, F.coalesce(F.col(metric), F.raise_error(F.lit("no task has a defined metric")).cast("double")))


def positive_probability(df: DataFrame, probabilities: str, out: str = "p", positive: int = 1) -> DataFrame:
    """``df`` with the probability of the positive class from an array column of class probabilities."""
    checked = F.when(F.size(probabilities) > positive, F.get(probabilities, F.lit(positive))).otherwise(F.raise_error(F.lit("too few classes")).cast("double"))
    return df.withColumn(out, F.when(F.col(probabilities).isNotNull(), checked))


def aligned(labels: DataFrame, predictions: DataFrame, on: list[str], y: str = "y", p: str = "p") -> DataFrame:
    """Labels beside predictions with the same keys; a key of one side only, or twice on a side, is an error."""
    def counted(df: DataFrame, value: str, n: str) -> DataFrame:
        return df.groupBy(*on).agg(F.first(value).alias(value), F.count("*").alias(n))

    both = counted(labels, y, "_a").join(counted(predictions, p, "_b"), on, "full")
    same = F.coalesce((F.col("_a") == 1) & (F.col("_b") == 1), F.lit(False))
    return both.filter(F.when(same, F.lit(True)).otherwise(F.raise_error(F.lit("labels and predictions must have the same keys, each once")).cast("boolean"))).select(*on, y, p)
