"""Queries over the test tables, one for each operator family, with SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..chem import fingerprints
from ..functions import similarity
from ..functions.shingles import fold_shingles, lingo
from ..operators import domain, metrics, packed, pairs, search, splits
from . import molecules, sources

Query = Callable[[SparkSession, str], DataFrame]
WIDTH = 64
#: Searches take the rows whose id is divisible by this as queries, against all rows.
EVERY = 100


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, bits (packed signs), counts (quarter steps of the absolute values), x, label."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(
        "vec_id",
        similarity.pack_bits(F.transform("embedding", lambda v: v > 0), WIDTH).alias("bits"),
        F.transform("embedding", lambda v: F.floor(F.abs(v.cast("double")) * 4).cast("double")).alias("counts"),
        F.col("embedding").cast("array<double>").alias("x"),
        "label",
    )


V = "v AS (SELECT vec_id, label, list_transform(embedding, lambda e: CASE WHEN e > 0 THEN 1.0 ELSE 0.0 END::DOUBLE) AS b, list_transform(embedding, lambda e: floor(abs(e::DOUBLE) * 4)) AS c, list_transform(embedding, lambda e: e::DOUBLE) AS x FROM embeddings)"
BITS_SQL = f"{V}, t AS (SELECT q.vec_id AS i, r.vec_id AS j, list_inner_product(q.b, r.b) AS a, list_sum(q.b) - list_inner_product(q.b, r.b) AS b, list_sum(r.b) - list_inner_product(q.b, r.b) AS c, 64.0::DOUBLE - list_sum(q.b) - list_sum(r.b) + list_inner_product(q.b, r.b) AS d FROM v q, v r WHERE q.vec_id % {EVERY} = 0)"
COUNTS_SQL = f"{V}, t AS (SELECT q.vec_id AS i, r.vec_id AS j, list_inner_product(q.c, r.c) AS ab, list_inner_product(q.c, q.c) AS aa, list_inner_product(r.c, r.c) AS bb FROM v q, v r WHERE q.vec_id % {EVERY} = 0)"
#: Similarity, and the similarity whose complement is the distance.
BINARY_SQL = {
    "tanimoto": "CASE WHEN a+b+c = 0 THEN 1 ELSE a/(a+b+c) END",
    "dice": "CASE WHEN 2*a+b+c = 0 THEN 1 ELSE 2*a/(2*a+b+c) END",
    "ct4": "CASE WHEN a+b+c = 0 THEN 1 ELSE ln(1+a)/ln(1+a+b+c) END",
    "braun_blanquet": "CASE WHEN a+greatest(b,c) = 0 THEN 1 ELSE a/(a+greatest(b,c)) END",
    "simpson": "CASE WHEN a+least(b,c) = 0 THEN 0 ELSE a/(a+least(b,c)) END",
    "kulczynski": "CASE WHEN a+b+c = 0 THEN 1 WHEN a+b = 0 OR a+c = 0 THEN 0 ELSE (a/(a+b)+a/(a+c))/2 END",
    "mcconnaughey": "CASE WHEN a+b+c = 0 THEN 1 WHEN (a+b)*(a+c) = 0 THEN -1 ELSE (a*(2*a+b+c)-(a+b)*(a+c))/((a+b)*(a+c)) END",
    "sokal_sneath_2": "CASE WHEN a+2*b+2*c = 0 THEN 1 ELSE a/(a+2*b+2*c) END",
    "rand": "(a+d)/64.0",
    "russell": "a/64.0",
    "rogot_goldberg": "CASE WHEN 2*a+b+c = 0 OR 2*d+b+c = 0 THEN 1 ELSE a/(2*a+b+c)+d/(2*d+b+c) END",
    "harris_lahey": "CASE WHEN a+b+c = 0 OR b+c+d = 0 THEN 1 ELSE a*(2*d+b+c)/(2*(a+b+c))+d*(2*a+b+c)/(2*(b+c+d)) END",
}
NORMAL_SQL = {
    "mcconnaughey": f"(1+{BINARY_SQL['mcconnaughey']})/2",
    "harris_lahey": "CASE WHEN a+b+c = 0 OR b+c+d = 0 THEN 1 ELSE (a*(2*d+b+c)/(2*(a+b+c))+d*(2*a+b+c)/(2*(b+c+d)))/64.0 END",
}
COUNT_SQL = {
    "tanimoto": "CASE WHEN aa+bb-ab < 1e-8 THEN 1 ELSE ab/(aa+bb-ab) END",
    "dice": "CASE WHEN aa+bb < 1e-8 THEN 1 ELSE 2*ab/(aa+bb) END",
    "ct4": "CASE WHEN aa+bb-ab < 1e-8 THEN 1 ELSE ln(1+ab)/ln(1+aa+bb-ab) END",
}


def _bulk(family: str, counts: bool) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        v = vectors(spark, sf_dir)
        both = pairs.bulk_similarity(v.filter(F.col("vec_id") % EVERY == 0), v, "vec_id", "vec_id", "counts" if counts else "bits", family, WIDTH, counts)
        return both.select("i", "j", F.round("similarity", 6).alias("similarity"), F.round("distance", 6).alias("distance"))

    return run


def _similarity_queries() -> tuple[dict[str, Query], dict[str, str]]:
    q, s = {}, {}
    for name in similarity.BINARY:
        q[f"bulk_{name}_binary"] = _bulk(name, False)
        s[f"bulk_{name}_binary"] = f"WITH {BITS_SQL} SELECT i, j, round(({BINARY_SQL[name]})::DOUBLE, 6) AS similarity, round((1 - ({NORMAL_SQL.get(name, BINARY_SQL[name])}))::DOUBLE, 6) AS distance FROM t"
    for name in similarity.COUNT:
        q[f"bulk_{name}_count"] = _bulk(name, True)
        s[f"bulk_{name}_count"] = f"WITH {COUNTS_SQL} SELECT i, j, round(({COUNT_SQL[name]})::DOUBLE, 6) AS similarity, round((1 - ({COUNT_SQL[name]}))::DOUBLE, 6) AS distance FROM t"
    return q, s


def _bit_distance(x, y):
    return similarity.binary_distance("tanimoto", x, y, WIDTH)


def knn_tanimoto(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return pairs.knn_join(v.filter(F.col("vec_id") % EVERY == 0), v, "vec_id", "vec_id", "bits", "bits", lambda x, y: F.round(_bit_distance(x, y), 9), 5, exclude_self=True).select("i", "j", F.round("distance", 6).alias("distance"), "rank")


def threshold_join(spark, sf_dir):
    """(vec_id, class_id, n_links): all vectors against all. Equal bit vectors are a class, named by
    its least id; n_links counts the other vectors with similarity at least 0.4."""
    v = vectors(spark, sf_dir).select("vec_id", "bits")
    classes = v.groupBy("bits").agg(F.min("vec_id").alias("class_id"), F.count("*").alias("size"))
    met = packed.tanimoto_links(classes, classes, "class_id", "bits", "bits", "size", 0.4, WIDTH)
    links = met.select(F.col("i").alias("class_id"), (F.col("links") - 1).alias("n_links"))
    return v.join(classes, "bits").join(links, "class_id").select("vec_id", "class_id", "n_links")


def lingo_names(spark, sf_dir):
    return lingo(table(spark, sf_dir, "part"), "p_partkey", "p_name")


def folded_words(spark, sf_dir):
    part = table(spark, sf_dir, "part").withColumn("s", F.split("p_name", " "))
    return fold_shingles(part, "p_partkey", "s", 1024, count=True)


def labelled(spark, sf_dir):
    """(task, y, p, s) in long form: two tasks, a hard prediction and a score from text length."""
    joined = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id")
    tasks = F.explode(F.array(*[F.struct(F.lit(t).alias("task"), F.col(t).cast("int").alias("y")) for t in ("quality", "toxic")]))
    return joined.select("doc_id", "n_chars", tasks.alias("t")).select("doc_id", "t.task", "t.y", (F.col("n_chars") > 1000).cast("int").alias("p"), F.col("n_chars").cast("double").alias("s"))


L = "l AS (SELECT doc_id, task, y, CASE WHEN n_chars > 1000 THEN 1 ELSE 0 END AS p, n_chars::DOUBLE AS s FROM (SELECT doc_id, 'quality' AS task, quality AS y FROM labels UNION ALL SELECT doc_id, 'toxic', toxic FROM labels) JOIN documents USING (doc_id))"


def confusion(spark, sf_dir):
    m = metrics.confusion_metrics(labelled(spark, sf_dir))
    return m.select("task", *[F.round(c, 6).alias(c) for c in m.columns if c != "task"])


CONFUSION_SQL = f"""WITH {L}, c AS (SELECT task, sum((y=1 AND p=1)::INT)::DOUBLE tp, sum((y=0 AND p=1)::INT)::DOUBLE fp, sum((y=1 AND p=0)::INT)::DOUBLE fn, sum((y=0 AND p=0)::INT)::DOUBLE tn FROM l GROUP BY task),
e AS (SELECT *, tp+fp+fn+tn AS n, (tp+tn)/(tp+fp+fn+tn) AS po, ((tp+fp)*(tp+fn)+(fn+tn)*(fp+tn))/((tp+fp+fn+tn)*(tp+fp+fn+tn)) AS pe FROM c)
SELECT task, round(po, 6) AS accuracy, round((tp/(tp+fn)+tn/(tn+fp))/2, 6) AS balanced_accuracy, round((po-pe)/(1-pe), 6) AS cohen_kappa, round(2*tp/(2*tp+fp+fn), 6) AS f1,
round((tp*tn-fp*fn)/sqrt((tp+fp)*(tp+fn)*(tn+fp)*(tn+fn)), 6) AS matthews, round(tp/(tp+fp), 6) AS precision, round(tp/(tp+fn), 6) AS recall FROM e"""


def regression(spark, sf_dir):
    m = metrics.regression_metrics(labelled(spark, sf_dir).withColumn("p", F.col("s") / 1000))
    return m.select("task", *[F.round(c, 6).alias(c) for c in ("mae", "mse", "rmse")])


REGRESSION_SQL = f"WITH {L} SELECT task, round(avg(abs(y-s/1000)), 6) AS mae, round(avg((y-s/1000)*(y-s/1000)), 6) AS mse, round(sqrt(avg((y-s/1000)*(y-s/1000))), 6) AS rmse FROM l GROUP BY task"


def ranking(spark, sf_dir):
    l = labelled(spark, sf_dir)
    out = metrics.auroc(l, p="s").join(metrics.auprc(l, p="s"), "task").join(metrics.spearman(l, p="s"), "task")
    return out.select("task", *[F.round(c, 6).alias(c) for c in ("auroc", "auprc", "spearman")])


RANKING_SQL = f"""WITH {L}, g AS (SELECT task, s, sum(y)::DOUBLE AS pos, sum(1-y)::DOUBLE AS neg FROM l GROUP BY task, s),
w AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY task ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS under, sum(pos) OVER (PARTITION BY task ORDER BY s DESC) AS tp, sum(neg) OVER (PARTITION BY task ORDER BY s DESC) AS fp FROM g),
a AS (SELECT task, sum(pos*(under+neg/2))/(sum(pos)*sum(neg)) AS auroc, sum(pos*tp/(tp+fp))/sum(pos) AS auprc FROM w GROUP BY task),
r AS (SELECT task, rank() OVER (PARTITION BY task ORDER BY y) + (count(*) OVER (PARTITION BY task, y) - 1) / 2.0 AS ry, rank() OVER (PARTITION BY task ORDER BY s) + (count(*) OVER (PARTITION BY task, s) - 1) / 2.0 AS rs FROM l)
SELECT task, round(auroc, 6) AS auroc, round(auprc, 6) AS auprc, round(spearman, 6) AS spearman FROM a JOIN (SELECT task, corr(ry, rs) AS spearman FROM r GROUP BY task) USING (task)"""


def screening(spark, sf_dir):
    l = labelled(spark, sf_dir).filter("task = 'toxic'")
    return metrics.screening_metrics(l, p="s").select(*[F.round(c, 6).alias(c) for c in ("enrichment_factor", "rie", "bedroc")])


SCREENING_SQL = f"""WITH {L}, r AS (SELECT y, row_number() OVER (ORDER BY s DESC, y DESC) AS k, count(*) OVER ()::DOUBLE AS n, sum(y) OVER ()::DOUBLE AS a FROM l WHERE task = 'toxic'),
m AS (SELECT any_value(n) AS n, any_value(a) AS a, sum(CASE WHEN k <= ceil(0.05*n) THEN y ELSE 0 END) AS hits, sum(CASE WHEN y = 1 THEN exp(-20.0*k/n) ELSE 0 END) AS w FROM r),
e AS (SELECT hits/(0.05*a) AS ef, (n/a)*w/((1-exp(-20.0))/(exp(20.0/n)-1)) AS rie, (1-exp(20.0*a/n))/(a/n*(1-exp(20.0))) AS lo, (1-exp(-20.0*a/n))/(a/n*(1-exp(-20.0))) AS hi FROM m)
SELECT round(ef::DOUBLE, 6) AS enrichment_factor, round(rie::DOUBLE, 6) AS rie, round(((rie-lo)/(hi-lo))::DOUBLE, 6) AS bedroc FROM e"""


def metrics_means(spark, sf_dir):
    """(metric, value): the mean of every metric over the tasks where it is defined, one task having one class only."""
    l = labelled(spark, sf_dir)
    l = l.unionByName(l.filter("task = 'toxic'").withColumns({"task": F.lit("none"), "y": F.lit(0)}))
    tables = {
        **dict.fromkeys(("accuracy", "balanced_accuracy", "cohen_kappa", "f1", "matthews", "precision", "recall"), metrics.confusion_metrics(l)),
        **dict.fromkeys(("mae", "mse", "rmse"), metrics.regression_metrics(l)), "auroc": metrics.auroc(l, p="s"), "auprc": metrics.auprc(l, p="s"), "spearman": metrics.spearman(l, p="s"),
    }
    one = [metrics.mean_over_tasks(t, m).select(F.lit(m).alias("metric"), F.round(m, 6).alias("value")) for m, t in tables.items()]
    out = one[0]
    for more in one[1:]:
        out = out.unionAll(more)
    return out


MEANS_SQL = f"""WITH {L}, k AS (SELECT * FROM l UNION ALL SELECT doc_id, 'none', 0, p, s FROM l WHERE task = 'toxic'), c AS (SELECT task, sum((y=1 AND p=1)::INT)::DOUBLE tp, sum((y=0 AND p=1)::INT)::DOUBLE fp, sum((y=1 AND p=0)::INT)::DOUBLE fn, sum((y=0 AND p=0)::INT)::DOUBLE tn, avg(abs(y-p)) AS mae, avg((y-p)*(y-p)) AS mse FROM k GROUP BY task),
e AS (SELECT *, tp+fp+fn+tn AS n, (tp+tn)/(tp+fp+fn+tn) AS po, ((tp+fp)*(tp+fn)+(fn+tn)*(fp+tn))/((tp+fp+fn+tn)*(tp+fp+fn+tn)) AS pe FROM c),
h AS (SELECT task, po AS accuracy, CASE WHEN tp+fn = 0 THEN tn/(tn+fp) ELSE (tp/(tp+fn)+tn/(tn+fp))/2 END AS balanced_accuracy, CASE WHEN pe <> 1 THEN (po-pe)/(1-pe) END AS cohen_kappa, CASE WHEN 2*tp+fp+fn = 0 THEN 0 ELSE 2*tp/(2*tp+fp+fn) END AS f1,
CASE WHEN (tp+fp)*(tp+fn)*(tn+fp)*(tn+fn) = 0 THEN 0 ELSE (tp*tn-fp*fn)/sqrt((tp+fp)*(tp+fn)*(tn+fp)*(tn+fn)) END AS matthews, CASE WHEN tp+fp = 0 THEN 0 ELSE tp/(tp+fp) END AS precision, CASE WHEN tp+fn = 0 THEN 0 ELSE tp/(tp+fn) END AS recall, mae, mse, sqrt(mse) AS rmse FROM e),
g AS (SELECT task, s, sum(y)::DOUBLE AS pos, sum(1-y)::DOUBLE AS neg FROM k GROUP BY task, s), w AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY task ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS under, sum(pos) OVER (PARTITION BY task ORDER BY s DESC) AS tp, sum(neg) OVER (PARTITION BY task ORDER BY s DESC) AS fp FROM g),
a AS (SELECT task, CASE WHEN sum(pos)*sum(neg) > 0 THEN sum(pos*(under+neg/2))/(sum(pos)*sum(neg)) END AS auroc, CASE WHEN sum(pos) > 0 THEN sum(pos*tp/(tp+fp))/sum(pos) END AS auprc FROM w GROUP BY task),
r AS (SELECT task, rank() OVER (PARTITION BY task ORDER BY y) + (count(*) OVER (PARTITION BY task, y) - 1) / 2.0 AS ry, rank() OVER (PARTITION BY task ORDER BY s) + (count(*) OVER (PARTITION BY task, s) - 1) / 2.0 AS rs FROM k WHERE task <> 'none'),
x AS (SELECT avg(accuracy) AS accuracy, avg(balanced_accuracy) AS balanced_accuracy, avg(cohen_kappa) AS cohen_kappa, avg(f1) AS f1, avg(matthews) AS matthews, avg(precision) AS precision, avg(recall) AS recall, avg(mae) AS mae, avg(mse) AS mse, avg(rmse) AS rmse FROM h),
y AS (SELECT avg(auroc) AS auroc, avg(auprc) AS auprc FROM a), z AS (SELECT avg(q) AS spearman FROM (SELECT corr(ry, rs) AS q FROM r GROUP BY task))
SELECT metric, round(value, 6) AS value FROM (UNPIVOT (SELECT * FROM x, y, z) ON COLUMNS(*) INTO NAME metric VALUE value)"""


def metrics_probabilities(spark, sf_dir):
    """(doc_id, task, y, p): labels beside the positive one of two class probabilities, by their keys."""
    l = labelled(spark, sf_dir)
    share = F.col("n") / (F.col("n") + 1000)
    scored = l.select("doc_id", "task", F.col("s").alias("n")).withColumn("classes", F.array(1 - share, share))
    out = metrics.aligned(l.select("doc_id", "task", "y"), metrics.positive_probability(scored, "classes"), ["doc_id", "task"])
    return out.select("doc_id", "task", "y", F.round("p", 6).alias("p"))


def search_grid(spark, sf_dir):
    """(threshold, score): two settings of features from vectors, a cross-validated classifier of the first label for each."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.tuning import CrossValidator, ParamGridBuilder

    e = table(spark, sf_dir, "embeddings").select(F.col("embedding").alias("x"), (F.col("label") < 5).cast("double").alias("label"))
    bits = lambda df, threshold: df.select("label", array_to_vector(F.transform("x", lambda v: (v > threshold).cast("double"))).alias("features"))
    model = LogisticRegression(maxIter=5)
    inner = CrossValidator(estimator=model, estimatorParamMaps=ParamGridBuilder().addGrid(model.regParam, [0.1, 1.0]).build(), evaluator=BinaryClassificationEvaluator(), numFolds=2, seed=1)
    found = search.search(e, bits, search.grid({"threshold": [0.0, 0.5]}), inner)
    return spark.createDataFrame([(s["threshold"], round(float(v), 6)) for s, v in found.scores], "threshold double, score double")


def _train_test(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return v.filter("label < 5"), v.filter("label >= 5")


def ad_bounding_box(spark, sf_dir):
    train, test = _train_test(spark, sf_dir)
    m = domain.bounding_box(train, "x", 1, 99, 2)
    return m.predict(m.score(test, "x"), "x").select("vec_id", F.col("score").cast("long").alias("score"), "inside")


AD_BOX_SQL = f"""WITH {V}, u AS (SELECT vec_id, label, unnest(range(1, 65)) AS i, unnest(x) AS e FROM v),
b AS (SELECT i, quantile_cont(e, 0.01) AS lo, quantile_cont(e, 0.99) AS hi FROM u WHERE label < 5 GROUP BY i)
SELECT vec_id, sum((e >= lo AND e <= hi)::INT)::BIGINT AS score, sum((e >= lo AND e <= hi)::INT) >= 62 AS inside FROM u JOIN b USING (i) WHERE label >= 5 GROUP BY vec_id"""


def ad_centroid(spark, sf_dir):
    train, test = _train_test(spark, sf_dir)
    m = domain.distance_to_centroid(train, "x")
    return m.predict(m.score(test, "x"), "x").select("vec_id", F.round("score", 6).alias("score"), "inside")


AD_CENTROID_SQL = f"""WITH {V}, u AS (SELECT vec_id, label, unnest(range(1, 65)) AS i, unnest(x) AS e FROM v), m AS (SELECT i, avg(e) AS c FROM u WHERE label < 5 GROUP BY i),
d AS (SELECT vec_id, label, sqrt(sum((e-c)*(e-c))) AS s FROM u JOIN m USING (i) GROUP BY vec_id, label), q AS (SELECT quantile_cont(s, 0.99) AS t FROM d WHERE label < 5)
SELECT vec_id, round(s, 6) AS score, s <= t AS inside FROM d, q WHERE label >= 5"""


def ad_response_range(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    m = domain.response_range(o.filter("o_orderstatus = 'F'"), "o_totalprice")
    test = o.filter("o_orderstatus <> 'F'")
    return m.predict(m.score(test, "o_totalprice"), "o_totalprice").select("o_orderkey", F.round("score", 4).alias("score"), "inside")


AD_RESPONSE_SQL = "WITH t AS (SELECT min(o_totalprice) AS a, max(o_totalprice) AS b, avg(o_totalprice) AS m FROM orders WHERE o_orderstatus = 'F') SELECT o_orderkey, round(abs(o_totalprice - m), 4) AS score, o_totalprice BETWEEN a AND b AS inside FROM orders, t WHERE o_orderstatus <> 'F'"


def _bit_neighbours(queries, rows, q_id, r_id, q_vec, r_vec, k):
    return packed.tanimoto_knn(queries, rows, q_id, r_id, q_vec, r_vec, k, WIDTH).withColumn("distance", F.round("distance", 9))


def ad_knn(spark, sf_dir):
    """Judges every test vector; one that is null has neither score nor verdict."""
    train, test = _train_test(spark, sf_dir)
    m = domain.knn_domain(train, "vec_id", "bits", lambda x, y: F.round(_bit_distance(x, y), 9), k=2, agg="mean", threshold=95, nearest=_bit_neighbours)
    # SQL rounds the product with 10^6: means of three that end in a half differ from round(score, 6).
    judged = m.predict(test, "vec_id", "bits").select("vec_id", (F.round(F.col("score") * 1e6) / 1e6).alias("score"), "inside")
    return judged.union(test.filter("x IS NULL").select("vec_id", F.lit(None).cast("double"), F.lit(None).cast("boolean")))


def _matrix_domain(make: Callable, score: bool = True, inside: bool = True) -> Query:
    def run(spark, sf_dir):
        train, test = _train_test(spark, sf_dir)
        m = make(train)
        out = m.predict(m.score(test, "x"), "x")
        return out.select("vec_id", *([F.round("score", 6).alias("score")] if score else []), *(["inside"] if inside else []))

    return run


def _inverse_sql(name: str, size: int) -> str:
    """CTEs that invert the symmetric positive matrix ``m`` of the table ``name``(i, j, e) by elimination: inv(r) has its rows."""
    rows = f"SELECT i, list(e ORDER BY j) AS r FROM {name} GROUP BY i"
    start = f"list_concat(r, list_transform(range(1, {size + 1}), lambda j: CASE WHEN j = i THEN 1.0 ELSE 0.0 END::DOUBLE))"
    pivot = "list_transform(a[k], lambda v: v / a[k][k])"
    step = "list_transform(a, lambda r, i: CASE WHEN i = k THEN p ELSE list_transform(r, lambda v, j: v - r[k] * p[j]) END)"
    return f"""s0 AS (SELECT list({start} ORDER BY i) AS a FROM ({rows})), e0(k, a) AS (SELECT 1, a FROM s0 UNION ALL SELECT k + 1, {step} FROM (SELECT k, a, {pivot} AS p FROM e0 WHERE k <= {size})),
inv AS (SELECT list_transform(a, lambda r: r[{size + 1}:{2 * size}]) AS q FROM e0 WHERE k = {size + 1})"""


_FORM = "list_inner_product({x}, list_transform(q, lambda r: list_inner_product(r, {x})))"
_TRAIN_U = f"{V}, u AS (SELECT vec_id, unnest(range(1, 65)) AS i, unnest(x) AS e FROM v WHERE label < 5)"
AD_LEVERAGE_SQL = f"""WITH RECURSIVE {_TRAIN_U}, n AS (SELECT count(*)::DOUBLE AS n FROM v WHERE label < 5), m AS (SELECT a.i, b.i AS j, sum(a.e * b.e) AS e FROM u a JOIN u b USING (vec_id) GROUP BY a.i, b.i), {_inverse_sql("m", 64)},
z AS (SELECT vec_id, {_FORM.format(x="x")} AS s FROM v, inv WHERE label >= 5) SELECT vec_id, round(s, 6) AS score, s <= 3 * 65 / n AS inside FROM z, n"""
AD_HOTELLING_SQL = f"""WITH RECURSIVE {_TRAIN_U}, c AS (SELECT i, avg(e) AS c FROM u GROUP BY i), w AS (SELECT vec_id, i, e - c AS e FROM u JOIN c USING (i)),
m AS (SELECT a.i, b.i AS j, sum(a.e * b.e) / (count(*) - 1) AS e FROM w a JOIN w b USING (vec_id) GROUP BY a.i, b.i), {_inverse_sql("m", 64)}, k AS (SELECT list(c ORDER BY i) AS middle FROM c),
z AS (SELECT vec_id, list_transform(x, lambda e, i: e - middle[i]) AS x FROM v, k WHERE label >= 5) SELECT vec_id, round({_FORM.format(x="x")}, 6) AS score FROM z, inv"""
AD_TOPKAT_SQL = f"""WITH RECURSIVE {_TRAIN_U}, c AS (SELECT i, min(e) AS lo, max(e) AS hi FROM u GROUP BY i), k AS (SELECT list(lo ORDER BY i) AS lo, list(hi ORDER BY i) AS hi FROM c), n AS (SELECT count(*)::DOUBLE AS n FROM v WHERE label < 5),
y AS (SELECT vec_id, label, list_append(list_transform(x, lambda e, i: (2 * e - lo[i] - hi[i]) / (hi[i] - lo[i])), 1.0::DOUBLE) AS x FROM v, k), w AS (SELECT vec_id, unnest(range(1, 66)) AS i, unnest(x) AS e FROM y WHERE label < 5),
m AS (SELECT a.i, b.i AS j, sum(a.e * b.e) AS e FROM w a JOIN w b USING (vec_id) GROUP BY a.i, b.i), {_inverse_sql("m", 65)}, z AS (SELECT vec_id, {_FORM.format(x="x")} AS s FROM y, inv WHERE label >= 5) SELECT vec_id, round(s, 6) AS score, s < 5 * 64 / (2 * n) AS inside FROM z, n"""
AD_KNN_SQL = f"""WITH {V}, t AS (SELECT q.vec_id AS i, q.label AS l, r.vec_id AS j, list_inner_product(q.b, r.b) AS a, list_sum(q.b) + list_sum(r.b) - list_inner_product(q.b, r.b) AS o FROM v q, v r WHERE r.label < 5),
d AS (SELECT i, l, j, round((1 - CASE WHEN o = 0 THEN 1 ELSE a / o END)::DOUBLE, 9) AS d FROM t), k AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY d, j) AS rank FROM d),
f AS (SELECT quantile_cont(s, 0.95) AS f FROM (SELECT avg(d) AS s FROM k WHERE l < 5 AND rank IN (2, 3) GROUP BY i))
SELECT i AS vec_id, round(s, 6) AS score, s <= f AS inside FROM (SELECT i, avg(d) AS s FROM k WHERE l >= 5 AND rank <= 3 GROUP BY i), f"""


def ad_centroid_metrics(spark, sf_dir):
    """A column for each metric but the plain one: the distance of every test vector to the training mean."""
    v = vectors(spark, sf_dir)
    bits = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: (x > 0).cast("double")).alias("x"))
    out = v.filter("label >= 5").select("vec_id", "x").join(bits.select("vec_id", F.col("x").alias("bits")), "vec_id")
    for name in CENTROID_SQL:
        column, train = ("bits", bits) if name in BIT_METRICS else ("x", v)
        out = domain.distance_to_centroid(train.filter("label < 5"), "x", 1.0, name).score(out, column, name)
    return out.select("vec_id", *(F.round(name, 6).alias(name) for name in CENTROID_SQL))


#: Metrics over entries that are 0 or not; the centroid of bits has hardly a 0.
BIT_METRICS = ("hamming", "dice", "jaccard", "rogerstanimoto", "russellrao", "sokalmichener", "sokalsneath", "yule")
def _against(x: str) -> str:
    """CTEs b_x: sums of each test vector ``x`` against the mean of the training ones."""
    return f"""c_{x} AS (SELECT list(m ORDER BY i) AS middle FROM (SELECT i, avg(e) AS m FROM (SELECT unnest(range(1, 65)) AS i, unnest({x}) AS e FROM v WHERE label < 5) GROUP BY i)), z_{x} AS (SELECT vec_id, unnest({x}) AS x, unnest(middle) AS c FROM v, c_{x} WHERE label >= 5),
b_{x} AS (SELECT vec_id, sum((x <> 0 AND c <> 0)::INT)::DOUBLE AS t, sum((x <> 0 AND c = 0)::INT)::DOUBLE AS tf, sum((x = 0 AND c <> 0)::INT)::DOUBLE AS ft, sum((x = 0 AND c = 0)::INT)::DOUBLE AS f, sum((x <> c)::INT)::DOUBLE AS ne, sum((x <> c AND (x <> 0 OR c <> 0))::INT)::DOUBLE AS ne_any,
corr(x, c) AS r, sum(abs(x-c)) AS man, max(abs(x-c)) AS che, sum((x-c)*(x-c)) AS sq, sum(abs(x+c)) AS plus, sum(CASE WHEN x = 0 AND c = 0 THEN 0 ELSE abs(x-c)/(abs(x)+abs(c)) END) AS can, sum(x*c)/sqrt(sum(x*x)*sum(c*c)) AS cos FROM z_{x} GROUP BY vec_id)"""


CENTROID_SQL = {
    "braycurtis": "man/plus", "canberra": "can", "chebyshev": "che", "cityblock": "man", "correlation": "1-r", "cosine": "1-cos", "euclidean": "sqrt(sq)", "sqeuclidean": "sq", "minkowski": "sqrt(sq)",
    "hamming": "ne/64", "dice": "ne/(2*t+ne)", "jaccard": "ne_any/(t+tf+ft)", "rogerstanimoto": "2*(tf+ft)/(t+f+2*(tf+ft))", "russellrao": "1-t/64", "sokalmichener": "2*(tf+ft)/(t+f+2*(tf+ft))", "sokalsneath": "CASE WHEN t+tf+ft = 0 THEN 0 ELSE (tf+ft)/(0.5*t+tf+ft) END", "yule": "CASE WHEN tf*ft = 0 THEN 0 ELSE 2*tf*ft/(t*f+tf*ft) END",
}


def _members(spark, sf_dir: str) -> DataFrame:
    """The numbers of a vector as the predictions of 64 members."""
    return vectors(spark, sf_dir).select("vec_id", F.explode("x").alias("value"))


def ad_ensemble_spread(spark, sf_dir):
    return domain.ensemble_spread(_members(spark, sf_dir), "vec_id", "value").select("vec_id", F.round("score", 6).alias("score"), "inside")


def ad_prob_std(spark, sf_dir):
    out = domain.prob_std(_members(spark, sf_dir).withColumn("value", F.col("value") + F.col("vec_id") % 4), "vec_id", "value")
    return out.select("vec_id", F.round("score", 6).alias("score"), "inside")


#: The normal tail by Simpson's rule over 2,000 steps from 0.
PROB_SQL = f"""WITH {V}, s AS (SELECT vec_id, avg(e) AS m, stddev_pop(e) AS d FROM (SELECT vec_id, unnest(x) + vec_id % 4 AS e FROM v) GROUP BY vec_id), z AS (SELECT vec_id, abs((0.5 - m) / d) AS z FROM s),
i AS (SELECT vec_id, 0.5 - any_value(z) / 6000 / sqrt(2 * pi()) * sum((CASE WHEN k IN (0, 2000) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END) * exp(-(z * k / 2000) * (z * k / 2000) / 2)) AS t FROM z, (SELECT range AS k FROM range(2001)) GROUP BY vec_id)
SELECT vec_id, round(t, 6) AS score, t <= 0.1 AS inside FROM i"""


def ad_convex_hull(spark, sf_dir):
    """Price and size of parts against the hull of the others of their brand's first kind."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.array(F.col("p_retailprice"), F.col("p_size").cast("double")).alias("x"))
    inside = domain.convex_hull(p.filter("p_partkey % 50 = 0"), "x")
    return inside(p.filter("p_partkey % 50 <> 0"), "x").select("p_partkey", "inside")


#: A point is in a plane hull if no half turn around it is free of points.
HULL_SQL = """WITH p AS (SELECT p_partkey, p_retailprice AS x, p_size::DOUBLE AS y FROM part), a AS (SELECT q.p_partkey, atan2(t.y - q.y, t.x - q.x) AS w, t.x = q.x AND t.y = q.y AS same FROM p q, p t WHERE q.p_partkey % 50 <> 0 AND t.p_partkey % 50 = 0),
g AS (SELECT p_partkey, same, w, coalesce(lead(w) OVER k, first(w) OVER k + 2 * pi()) - w AS gap FROM a WINDOW k AS (PARTITION BY p_partkey ORDER BY w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT p_partkey, bool_or(same) OR max(gap) <= pi() + 1e-9 AS inside FROM g GROUP BY p_partkey"""


def split_groups(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source")
    n = d.count()
    return splits.group_fill_split(d, F.col("source"), "doc_id", n // 10, n // 5).select("doc_id", "subset")


SPLIT_GROUPS_SQL = """WITH n AS (SELECT count(*) AS n FROM documents), g AS (SELECT source, count(*) AS size, min(doc_id) AS f FROM documents GROUP BY source),
s AS (SELECT source, size, coalesce(sum(size) OVER (ORDER BY size, f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM g),
t AS (SELECT coalesce(sum(size), 0) AS tested FROM s, n WHERE before < n // 5)
SELECT doc_id, CASE WHEN before < n // 5 THEN 'test' WHEN before - tested < n // 10 THEN 'valid' ELSE 'train' END AS subset FROM documents JOIN s USING (source), t, n"""


def split_time(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    n = o.count()
    return splits.time_split(o, "o_orderdate", "o_orderkey", n * 8 // 10, n // 10).select("o_orderkey", "subset")


SPLIT_TIME_SQL = "WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS k, count(*) OVER () AS n FROM orders) SELECT o_orderkey, CASE WHEN k <= n * 8 // 10 THEN 'train' WHEN k <= n * 8 // 10 + n // 10 THEN 'valid' ELSE 'test' END AS subset FROM r"


def split_randomized(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source")
    n = d.count()
    return splits.randomized_group_split(d, F.col("source"), "doc_id", n // 10, n // 5, seed=1).select("doc_id", "subset")


def split_maxmin(spark, sf_dir):
    v = vectors(spark, sf_dir).select("vec_id", "bits")
    n = v.count()
    return splits.maxmin_split(v, "vec_id", "bits", n // 20, n // 10, start=v.agg(F.min("vec_id")).first()[0]).select("vec_id", "subset")


def split_stratified(spark, sf_dir):
    return splits.stratified_maxmin_split(vectors(spark, sf_dir).select("vec_id", "bits", "label"), "vec_id", "bits", "label", 0.1, 0.1, from_least=True).select("vec_id", "subset")


def split_butina(spark, sf_dir):
    v = vectors(spark, sf_dir).select("vec_id", "bits")
    n = v.count()
    return splits.butina_split(v, "vec_id", "bits", n // 10, n // 5).select("vec_id", "subset")


def _apart(x: str, y: str) -> str:
    """Tanimoto distance of two bit lists with their sums beside them."""
    both = f"list_inner_product({x}, {y})"
    return f"CASE WHEN list_sum({x}) + list_sum({y}) = {both} THEN 0 ELSE 1 - {both} / (list_sum({x}) + list_sum({y}) - {both}) END"


#: Picks one after the other; near has the distance of each vector to the picks so far, -1 for those.
SPLIT_MAXMIN_SQL = f"""WITH RECURSIVE {V}, a AS (SELECT list(b ORDER BY vec_id) AS vs, list(vec_id ORDER BY vec_id) AS ids, count(*) AS n FROM v),
s(k, pick, near) AS (SELECT 1, 1::BIGINT, list_transform(vs, lambda b: 9.0::DOUBLE) FROM a UNION ALL SELECT k + 1, list_position(x, list_max(x))::BIGINT, x FROM (SELECT k, list_transform(near, lambda d, i: CASE WHEN i = pick OR d < 0 THEN -1.0 ELSE least(d, {_apart("vs[i]", "vs[pick]")}) END::DOUBLE) AS x FROM s, a WHERE k < n // 20 + n // 10)),
p AS (SELECT ids[pick] AS vec_id, CASE WHEN k <= n // 20 THEN 'test' ELSE 'valid' END AS subset FROM s, a) SELECT vec_id, coalesce(subset, 'train') AS subset FROM v LEFT JOIN p USING (vec_id)"""
SPLIT_STRATIFIED_SQL = f"""WITH RECURSIVE {V}, a AS (SELECT label, list(b ORDER BY vec_id) AS vs, list(vec_id ORDER BY vec_id) AS ids, greatest(1, floor(count(*) * 0.1))::BIGINT AS m FROM v GROUP BY label),
s(label, k, pick, near) AS (SELECT label, 1, 1::BIGINT, list_transform(vs, lambda b: 9.0::DOUBLE) FROM a UNION ALL SELECT label, k + 1, list_position(x, list_max(x))::BIGINT, x FROM (SELECT s.label, k, list_transform(near, lambda d, i: CASE WHEN i = pick OR d < 0 THEN -1.0 ELSE least(d, {_apart("vs[i]", "vs[pick]")}) END::DOUBLE) AS x FROM s JOIN a ON s.label = a.label WHERE k < 2 * m)),
p AS (SELECT ids[pick] AS vec_id, CASE WHEN k <= m THEN 'test' ELSE 'valid' END AS subset FROM s JOIN a ON s.label = a.label) SELECT vec_id, coalesce(subset, 'train') AS subset FROM v LEFT JOIN p USING (vec_id)"""
#: Leaders one after the other; free tells which vectors none covers.
SPLIT_BUTINA_SQL = f"""WITH RECURSIVE {V}, a AS (SELECT list(b ORDER BY vec_id) AS vs, list(vec_id ORDER BY vec_id) AS ids, count(*) AS n FROM v),
s(k, pick, free) AS (SELECT 1, 1::BIGINT, list_transform(vs, lambda b, i: {_apart("b", "vs[1]")} > 0.65) FROM a UNION ALL SELECT k + 1, p, list_transform(free, lambda f, i: f AND {_apart("vs[i]", "vs[p]")} > 0.65) FROM (SELECT k, free, list_position(free, true)::BIGINT AS p FROM s WHERE list_contains(free, true)), a),
l AS (SELECT k, ids[pick] AS leader, vs[pick] AS lb FROM s, a), c AS (SELECT vec_id, leader AS cluster FROM (SELECT vec_id, leader, row_number() OVER (PARTITION BY vec_id ORDER BY {_apart("b", "lb")}, k) AS r FROM v, l) WHERE r = 1),
g AS (SELECT cluster, count(*) AS size, min(vec_id) AS f FROM c GROUP BY cluster), o AS (SELECT cluster, size, coalesce(sum(size) OVER (ORDER BY size, f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM g), t AS (SELECT coalesce(sum(size), 0) AS tested FROM o, a WHERE before < n // 5)
SELECT vec_id, CASE WHEN before < n // 5 THEN 'test' WHEN before - tested < n // 10 THEN 'valid' ELSE 'train' END AS subset FROM c JOIN o USING (cluster), t, a"""


def _fingerprint_query(kind: str) -> Query:
    return lambda spark, sf_dir: fingerprints.fingerprint(molecules.molecules(spark, sf_dir), "p_partkey", "smiles", kind, count=True)


def _all() -> tuple[dict[str, Query], dict[str, str]]:
    q, s = _similarity_queries()
    q |= {"lingo": lingo_names, "folded_shingles": folded_words, "knn_tanimoto": knn_tanimoto, "tanimoto_threshold_join": threshold_join, "metrics_confusion": confusion, "metrics_regression": regression, "metrics_ranking": ranking, "metrics_screening": screening, "metrics_means": metrics_means, "metrics_probabilities": metrics_probabilities, "search_grid": search_grid}
    q |= {"ad_bounding_box": ad_bounding_box, "ad_centroid": ad_centroid, "ad_response_range": ad_response_range, "ad_knn": ad_knn}
    q |= {"ad_leverage": _matrix_domain(lambda t: domain.leverage(t, "x")), "ad_hotelling_t2": _matrix_domain(lambda t: domain.hotelling_t2(t, "x"), inside=False), "ad_topkat": _matrix_domain(lambda t: domain.topkat(t, "x"))}
    q |= {"ad_pca_box": _matrix_domain(lambda t: domain.pca_box(t, "x"), score=False), "ad_ensemble_spread": ad_ensemble_spread, "ad_prob_std": ad_prob_std, "ad_convex_hull": ad_convex_hull}
    q["ad_centroid_metrics"] = ad_centroid_metrics
    plain = ", ".join(f"round(({e})::DOUBLE, 6) AS {name}" for name, e in CENTROID_SQL.items() if name not in BIT_METRICS)
    bits = ", ".join(f"round(({e})::DOUBLE, 6) AS {name}" for name, e in CENTROID_SQL.items() if name in BIT_METRICS)
    s["ad_centroid_metrics"] = f"WITH {V}, {_against('x')}, {_against('b')} SELECT * FROM (SELECT vec_id, {plain} FROM b_x) JOIN (SELECT vec_id, {bits} FROM b_b) USING (vec_id)"
    s |= {"ad_leverage": AD_LEVERAGE_SQL, "ad_hotelling_t2": AD_HOTELLING_SQL, "ad_topkat": AD_TOPKAT_SQL, "ad_knn": AD_KNN_SQL, "ad_prob_std": PROB_SQL, "ad_convex_hull": HULL_SQL}
    s["ad_ensemble_spread"] = f"WITH {V} SELECT vec_id, round(s, 6) AS score, s <= 1 AS inside FROM (SELECT vec_id, stddev_pop(e) AS s FROM (SELECT vec_id, unnest(x) AS e FROM v) GROUP BY vec_id)"
    q |= {"split_group_fill": split_groups, "split_time": split_time, "split_randomized_groups": split_randomized, "split_maxmin": split_maxmin, "split_stratified_maxmin": split_stratified, "split_butina": split_butina}
    q |= {f"fingerprint_{k}": _fingerprint_query(k) for k in fingerprints.KINDS}
    s |= {
        "lingo": "WITH n AS (SELECT p_partkey, replace(replace(regexp_replace(p_name, '[1-9]', '0', 'g'), 'Cl', 'L'), 'Br', 'R') AS t FROM part), g AS (SELECT p_partkey, unnest(list_transform(range(1, greatest(length(t) - 2, 1)), lambda i: substr(t, i::INT, 4))) AS gram FROM n) SELECT p_partkey, (('0x' || right(sha1(gram), 3))::INT & 1023)::INT AS bit, count(*) AS count FROM g GROUP BY 1, 2",
        "folded_shingles": "WITH g AS (SELECT p_partkey, sha256(unnest(string_split(p_name, ' '))) AS h FROM part) SELECT p_partkey, (('0x' || h[7:8] || h[5:6] || h[3:4] || h[1:2])::BIGINT % 1024)::INT AS bit, count(*) AS count FROM g GROUP BY 1, 2",
        "knn_tanimoto": f"WITH {BITS_SQL}, d AS (SELECT i, j, round((1 - ({BINARY_SQL['tanimoto']}))::DOUBLE, 9) AS distance FROM t WHERE i <> j), r AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY distance, j)::INT AS rank FROM d) SELECT i, j, round(distance, 6) AS distance, rank FROM r WHERE rank <= 5",
        "tanimoto_threshold_join": f"WITH {V}, c AS (SELECT vec_id, b, list_sum(b) AS n, min(vec_id) OVER (PARTITION BY b) AS class_id FROM v), m AS (SELECT q.vec_id, q.class_id, q.n + r.n - list_inner_product(q.b, r.b) AS u, list_inner_product(q.b, r.b) AS a FROM c q, c r) SELECT vec_id, class_id, count(*) - 1 AS n_links FROM m WHERE CASE WHEN u = 0 THEN 1 ELSE a / u END >= 0.4 GROUP BY 1, 2",
        "metrics_confusion": CONFUSION_SQL, "metrics_means": MEANS_SQL, "metrics_probabilities": f"WITH {L} SELECT doc_id, task, y, round(s / (s + 1000), 6) AS p FROM l", "metrics_regression": REGRESSION_SQL, "metrics_ranking": RANKING_SQL, "metrics_screening": SCREENING_SQL,
        "ad_bounding_box": AD_BOX_SQL, "ad_centroid": AD_CENTROID_SQL, "ad_response_range": AD_RESPONSE_SQL, "split_group_fill": SPLIT_GROUPS_SQL, "split_maxmin": SPLIT_MAXMIN_SQL, "split_stratified_maxmin": SPLIT_STRATIFIED_SQL, "split_butina": SPLIT_BUTINA_SQL, "split_time": SPLIT_TIME_SQL,
    }
    return q, s


def queries() -> dict[str, Query]:
    return _all()[0] | molecules.QUERIES | sources.QUERIES


def oracle_sql() -> dict[str, str]:
    return _all()[1] | molecules.SQL | sources.SQL
