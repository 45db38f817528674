"""URL filtering by fixed rules and, beyond them, a tree of path templates for each host."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .staging import Staging

DEPTH = 8
UPPER, LOWER_ = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.regexp_extract(_tail(url), r"\A([^/?#]*)", 1), UPPER, LOWER_)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.regexp_extract(_tail(url), r"\A[^/?#]*([^?#]*)", 1)


def _tail(url: Column) -> Column:
    at = F.locate("://", F.coalesce(url, F.lit("")))
    return F.when(at > 0, url.substr(at + F.lit(3), F.length(url))).otherwise(F.lit(""))


def matched_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest of ``rules`` (verdict, host, path) that fits; both null if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def shaped(depth: int) -> Column:
    """The path's segments with numbers and long hexadecimal names replaced by their shape."""
    number = lambda s: F.regexp_extract(s, r"\A[0-9]+(\.\w+)\z", 1)
    one = lambda s: F.when(s.rlike(r"\A[0-9]+\z"), F.lit("#")).when(number(s) != "", F.concat(F.lit("#"), number(s))).when(s.rlike(r"\A[0-9a-fA-F-]{16,}\z"), F.lit("#x")).otherwise(s)
    return F.transform(F.split(F.regexp_replace("path", r"\A/", ""), "/", depth), one)


def templates(urls: DataFrame, stage: Staging, depth: int = DEPTH, variable_at: int = 12, variable_share: float = 0.3) -> DataFrame:
    """``urls`` (host, path, bad, n) with ``template``: segments that vary become ``*``.

    Level by level, under one host and template so far: a segment with a digit shape of its own
    (numbers, hashes) is generalised to its shape first; a level whose distinct segments are
    many (over ``variable_at``, and over ``variable_share`` of its rows) becomes ``*``. What lies
    below ``depth`` stays one segment. Each level is one aggregation on (host, template, segment)
    after map-side sums, so a host with a third of all rows is spread over its segments.
    """
    now = urls.withColumn("_parts", shaped(depth)).withColumn("template", F.lit("")).groupBy("host", "_parts", "template").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.sum("known").alias("known"))
    now = stage.put(now, "level-0")
    deepest = now.agg(F.max(F.size("_parts"))).first()[0] or 0
    for level in range(min(depth, deepest)):
        segment = F.get("_parts", F.lit(level))
        sums = now.withColumn("_s", segment).groupBy("host", "template", "_s").agg(F.sum("n").alias("n"))
        width = sums.filter("_s is not null").groupBy("host", "template").agg(F.count("*").alias("_kinds"), F.sum("n").alias("_rows"))
        varies = width.filter((F.col("_kinds") > variable_at) & (F.col("_kinds") > variable_share * F.col("_rows"))).select("host", "template", F.lit(True).alias("_varies"))
        joined = now.join(varies, ["host", "template"], "left")
        step = F.when(segment.isNull(), F.lit("")).otherwise(F.concat(F.lit("/"), F.when(F.col("_varies"), F.lit("*")).otherwise(segment)))
        now = stage.put(joined.withColumn("template", F.concat("template", step)).drop("_varies"), f"level-{level + 1}")
        stage.drop(f"level-{level}")
    return now


def _apart(branches: DataFrame, by: list[str], z: float) -> DataFrame:
    """``branches`` (n, bad, known) with ``apart``: whether a branch's bad share differs by ``z`` standard
    errors from that of all others with the same ``by``, and ``above``: whether it is higher."""
    totals = branches.groupBy(*by).agg(F.sum("bad").alias("pb"), F.sum("known").alias("pk"))
    both = branches.join(totals, by)
    rest, share = F.col("pk") - F.col("known"), F.try_divide(F.col("pb"), F.col("pk"))
    gap = F.try_divide("bad", "known") - F.try_divide(F.col("pb") - F.col("bad"), rest)
    error = F.sqrt(share * (1 - share) * (F.try_divide(F.lit(1.0), F.col("known")) + F.try_divide(F.lit(1.0), rest)))
    apart = F.coalesce((F.abs(gap) > z * error) & (F.col("known") >= 5), F.lit(False))
    return both.select(*(F.col(c) for c in branches.columns), apart.alias("apart"), F.coalesce(gap > 0, F.lit(False)).alias("above"))


def merged(tree: DataFrame, stage: Staging, z: float = 1.96) -> DataFrame:
    """(host, template, branch, n, bad, known): sibling templates with similar bad shares share a branch.

    Templates whose share does not differ by ``z`` standard errors from their parent's others go
    together (``~``). Those that stand out upwards are then held against each other the same way,
    and so are those that stand out downwards (``~+`` and ``~-``); only what still differs is a
    branch of its own.
    """
    leaves = tree.groupBy("host", "template").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.sum("known").alias("known"))
    leaves = leaves.withColumn("parent", F.regexp_replace("template", r"/[^/]*\z", ""))
    first = _apart(leaves, ["host", "parent"], z).withColumnRenamed("apart", "out")
    side = F.when(~F.col("out"), F.lit("/~")).when(F.col("above"), F.lit("/~+")).otherwise(F.lit("/~-"))
    first = stage.put(first.withColumn("side", F.concat("parent", side)).drop("above"), "sides")
    second = _apart(first, ["host", "side"], z)
    branch = F.when(F.col("out") & F.col("apart"), F.col("template")).otherwise(F.col("side"))
    return stage.put(second.select("host", "template", branch.alias("branch"), "n", "bad", "known"), "merged")


def url_filter(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str, str]], id_col: str = "page_id", url_col: str = "url", label_id: str = "doc_id", label: str = "quality", strength: float = 10.0, reject: float = 0.5) -> DataFrame:
    """One row for each row of ``pages``: id, host, path, rule, verdict, template, impurity.

    A fixed rule decides where one fits. Elsewhere the page's template does: bad labels of its
    branch (label 0), smoothed by the host's share, itself smoothed by the corpus's, each with
    the weight of ``strength`` labelled pages, block it at ``reject`` or more, if the branch has
    a bad label of its own. ``labels`` tells which pages are good (1) or bad (0), by ``label_id``,
    which is held against the pages' id; with several labels of a page the least counts.

    Cases: a null url or one without ``://`` has empty host and path and one template of its
    own; unlabelled pages count for the shape of the tree only; without labels nothing is
    blocked; repeated rows are judged each; an empty table gives an empty table; other columns
    are ignored.
    """
    stage = Staging(pages.sparkSession)
    seen = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("url"))
    rows = seen.select("_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    marks = labels.filter(F.col(label).isin(0, 1)).groupBy(F.col(label_id).alias("_id")).agg(F.min(label).alias("_label"))
    rows = stage.put(rows.join(marks, "_id", "left"), "rows")
    urls = rows.groupBy("host", "path").agg(F.count("*").alias("n"), F.count("_label").alias("known"), F.sum((F.col("_label") == 0).cast("int")).alias("bad")).withColumn("bad", F.coalesce("bad", F.lit(0)))
    urls = stage.put(urls, "urls")
    total = urls.agg(F.sum("bad"), F.sum("known")).first()
    overall = (total[0] or 0) / (total[1] or 1)
    tree = templates(urls, stage)
    leaves = merged(tree, stage)
    for name in ("urls", "sides"):
        stage.drop(name)
    hosts = leaves.groupBy("host").agg(((F.sum("bad") + strength * overall) / (F.sum("known") + strength)).alias("_host_share"))
    branches = leaves.groupBy("host", "branch").agg(F.sum("bad").alias("bad"), F.sum("known").alias("known")).join(hosts, "host")
    impure = branches.select("host", "branch", ((F.col("bad") + strength * F.col("_host_share")) / (F.col("known") + strength)).alias("impurity"), (F.col("bad") > 0).alias("seen_bad"))
    judged = leaves.select("host", "template", "branch").join(impure, ["host", "branch"]).select("host", "template", "impurity", "seen_bad")
    return _verdicts(rows, tree, judged, stage, rules, id_col, reject)


def _verdicts(rows: DataFrame, tree: DataFrame, judged: DataFrame, stage: Staging, rules, id_col: str, reject: float) -> DataFrame:
    """Carries the judgement of templates back to the pages by their shaped segments."""
    by_parts = tree.join(judged, ["host", "template"]).select(F.col("host").alias("_h"), F.concat_ws("/", "_parts").alias("_k"), "template", "impurity", "seen_bad")
    keyed = rows.withColumn("_key", F.concat_ws("/", shaped(DEPTH)))
    out = keyed.join(by_parts, (F.col("host") == F.col("_h")) & (F.col("_key") == F.col("_k")), "left")
    rule, verdict = matched_rule(F.col("host"), F.col("path"), rules)
    method = F.when(F.col("seen_bad") & (F.col("impurity") >= reject), F.lit("block")).otherwise(F.lit("allow"))
    return out.select(F.col("_id").alias(id_col), "host", "path", rule.alias("rule"), F.coalesce(verdict, method).alias("verdict"), "template", "impurity")


#: The fixed rules of the query: verdict, host, path.
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def op1_url_filter(spark, sf_dir: str) -> DataFrame:
    """All pages. The tables tie no label to a page but by number, so the label with a page's number is taken as its own."""
    return url_filter(spark.read.parquet(f"{sf_dir}/pages.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"), RULES)
