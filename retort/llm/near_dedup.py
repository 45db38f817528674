"""Near duplicates: SuperMinHash signatures, banding, verification on whole sets, union-find."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import components
from .staging import Staging, bitmap, in_bitmap
from .words import Words, mix, pieces

U = np.uint64
EMPTY = np.iinfo(np.uint64).max
#: A shingle is rare if so many rows of large buckets hold it at most.
RARE = 16
#: Buckets of so many members at most are compared pair by pair.
SMALL = 8
#: So many rows of a bucket meet one copy of its hub's set.
ROWS_PER_COPY = 512


def shingle_sets(texts: pa.Array, k: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the k-word shingles of each text; fewer words count as one shingle."""
    w = Words(texts, lower=True)
    starts, hashes = w.windows(k)
    cut = np.searchsorted(starts, w.first)
    short = np.flatnonzero((w.counts > 0) & (w.counts < k))
    whole = dict(zip(short.tolist(), w.whole(short).tolist(), strict=True))
    out = []
    for i in range(len(texts)):
        if i in whole:
            out.append(np.array([whole[i]], np.uint64))
        else:
            h = np.sort(hashes[cut[i] : cut[i + 1]])
            out.append(h[np.concatenate(([True], h[1:] != h[:-1]))] if len(h) else h)
    return out


def superminhash(sets: list[np.ndarray], size: int) -> np.ndarray:
    """One row of ``size`` values for each set (EMPTY throughout for an empty one).

    Element e meets the slots in an order p_e of its own, and at step j offers j plus a fraction
    to slot p_e(j); a slot keeps the least offer. An offer of step j is at least j, so a set is
    done as soon as all its slots hold something: long sets end after a step or two.
    """
    n = len(sets)
    out = np.full(n * size, EMPTY, np.uint64)
    live = np.flatnonzero([len(s) for s in sets])
    if not len(live):
        return out.reshape(n, size)
    element = np.concatenate([sets[i] for i in live])
    row = np.repeat(live, [len(sets[i]) for i in live])
    order: np.ndarray | None = None
    for j in range(size):
        drawn = mix(element, 1000 + j)
        pick = (j + ((drawn >> U(40)) * U(size - j) >> U(24))).astype(np.int64)
        offer = (U(j) << U(40)) | (drawn & U((1 << 40) - 1))
        if order is None:
            slot = pick
        else:
            at = np.arange(len(element))
            slot = order[at, pick].astype(np.int64)
            order[at, pick] = order[:, j]
        np.minimum.at(out, row * size + slot, offer)
        open_rows = (out.reshape(n, size) == EMPTY).any(1)
        more = open_rows[row]
        if not more.any():
            break
        if order is None:
            element, row, pick = element[more], row[more], pick[more]
            order = np.tile(np.arange(size, dtype=np.uint8 if size <= 256 else np.uint16), (len(element), 1))
            at = np.arange(len(element))
            order[at, pick] = order[:, 0]
        elif more.mean() < 0.5:
            element, row, order = element[more], row[more], order[more]
    return out.reshape(n, size)


def band_keys(signatures: np.ndarray, rows: int) -> np.ndarray:
    """A hash for each band of ``rows`` signature values."""
    n, size = signatures.shape
    bands = size // rows
    parts = signatures[:, : bands * rows].reshape(n, bands, rows)
    key = np.broadcast_to(mix(np.arange(bands, dtype=np.uint64), 77), (n, bands)).copy()
    for r in range(rows):
        key = mix(key ^ mix(parts[:, :, r], 50 + r), 60)
    return key


def digests(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit digests of each whole set."""
    with np.errstate(over="ignore"):
        one = np.array([mix(s, 90).sum(dtype=np.uint64) for s in sets], np.uint64)
    two = np.array([np.bitwise_xor.reduce(mix(s, 91)) if len(s) else 0 for s in sets], np.uint64)
    return one.view(np.int64), two.view(np.int64)


def signatures(docs: DataFrame, id_col: str, text_col: str, k: int, size: int, rows: int) -> DataFrame:
    """(id, n, one, two, bands): size, digests and band hashes of each row's set of shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text_col):
            sets = shingle_sets(batch.column(text_col), k)
            keys = band_keys(superminhash(sets, size), rows).view(np.int64)
            one, two = digests(sets)
            cut = np.arange(len(sets) + 1, dtype=np.int32) * keys.shape[1]
            yield pa.RecordBatch.from_arrays(
                [batch.column(id_col), pa.array([len(s) for s in sets], pa.int64()), pa.array(one), pa.array(two), pa.ListArray.from_arrays(cut, pa.array(keys.ravel()))],
                ["id", "n", "one", "two", "bands"],
            )

    return docs.select(id_col, text_col).mapInArrow(run, "id long, n long, one long, two long, bands array<long>")


def _sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """(id, one, members) of the rows with a wanted id; a bitmap of fixed size may let others pass."""
    held = docs.sparkSession.sparkContext.broadcast(bitmap(wanted.select(F.xxhash64("id").alias("h")), "h"))  # 2**26 bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text_col):
            batch = batch.filter(pa.array(in_bitmap(held.value, batch.column("_h").to_numpy().view(np.uint64))))
            sets = shingle_sets(batch.column(text_col), k)
            yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(digests(sets)[0]), pa.array([s.tobytes() for s in sets], pa.binary())], ["id", "one", "members"])

    rows = docs.filter(F.col(id_col).isNotNull()).select(id_col, text_col, F.xxhash64(id_col).alias("_h"))
    return rows.mapInArrow(run, "id long, one long, members binary")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (u, u1, v, v1, salt) of sets with ``shared`` and ``linked``: 100 * shared >= percent * union.

    (v, v1) may stand in many pairs; its set is sent once for each salt, so no task gets them all.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both, link = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, bool)
            a, b = batch.column("a"), batch.column("b")
            for i in range(batch.num_rows):
                x, y = np.frombuffer(a[i].as_buffer(), np.uint64), np.frombuffer(b[i].as_buffer(), np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                if len(x):
                    at = np.searchsorted(y, x)
                    at[at == len(y)] = 0
                    both[i] = int((y[at] == x).sum())
                    link[i] = both[i] > 0 and 100 * both[i] >= percent * (len(x) + len(y) - both[i])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("u", "u1", "v", "v1")), pa.array(both), pa.array(link)], ["u", "u1", "v", "v1", "shared", "linked"])

    mine = sets.select(F.col("id").alias("u"), F.col("one").alias("u1"), F.col("members").alias("a"))
    theirs = sets.select(F.col("id").alias("v"), F.col("one").alias("v1"), F.col("members").alias("b"))
    copies = pairs.select("v", "v1", "salt").distinct().join(theirs, ["v", "v1"])
    both = pairs.join(mine, ["u", "u1"]).join(copies, ["v", "v1", "salt"])
    return both.select("u", "u1", "v", "v1", "a", "b").mapInArrow(run, "u long, u1 long, v long, v1 long, shared long, linked boolean")


def _fits(x: str, y: str, percent: int) -> Column:
    """Sets of sizes x and y can be similar enough at all."""
    return F.expr(f"100 * least({x}, {y}) >= {percent} * greatest({x}, {y})")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80, size: int = 130, rows: int = 5) -> DataFrame:
    """One row for each row of ``docs``: id, n_shingles, component_id, kept.

    Texts with one set of shingles form a class that goes on as one vertex. Bands of the
    signatures give buckets; with 26 bands of 5 values a pair of similarity 0.8 shares a bucket
    but for 3 in 10^5 cases. All links inside a bucket matter only for the component, so its
    members are first held against its hub, the member that meets most others. Where several
    components are left, small buckets are compared pair by pair; in larger ones a pair must
    share a rare shingle, or its sizes, its rare shingles and what it shares with the hub must
    allow a link (exact bounds, so none is lost). Every link is verified on whole sets.

    Cases: without words or text a row has no shingle and is linked with nothing; equal sets
    are linked; rows with one id are one vertex; a null id has a null component and stays; an
    empty table gives an empty table; other columns are ignored.
    """
    if not 1 <= percent <= 100 or k < 1 or size < rows:
        raise ValueError("percent must be 1 to 100, k at least 1 and size at least rows")
    stage = Staging(docs.sparkSession)
    signed = stage.put(signatures(docs, id_col, text_col, k, size, rows), "signatures")
    known = signed.filter("id is not null and n > 0")
    classes = stage.put(known.groupBy("one", "two", "n").agg(F.min("id").alias("id"), F.first("bands").alias("bands")), "classes")
    bands = classes.select("id", "one", "n", F.explode("bands").alias("band"))
    sizes = bands.groupBy("band").agg(F.count("*").alias("size")).filter("size > 1")
    buckets = stage.put(bands.join(sizes, "band"), "buckets")
    crowd = buckets.groupBy("id", "one").agg(F.sum("size").alias("crowd"))
    hubs = buckets.join(crowd, ["id", "one"]).groupBy("band").agg(F.max(F.struct("crowd", "id", "one", "n")).alias("h"))
    hubs = hubs.select("band", F.col("h.id").alias("hub"), F.col("h.one").alias("hub1"), F.col("h.n").alias("hub_n"))
    members = buckets.join(hubs, "band").filter("id <> hub or one <> hub1")
    members = stage.put(members, "members")
    sets = stage.put(_sets(docs, buckets.select("id").distinct(), id_col, text_col, k), "sets")

    salt = F.pmod(F.xxhash64("id"), F.ceil(F.col("size") / ROWS_PER_COPY)).alias("salt")
    stars = members.filter(_fits("n", "hub_n", percent)).select(F.col("id").alias("u"), F.col("one").alias("u1"), F.col("hub").alias("v"), F.col("hub1").alias("v1"), salt)
    stars = stars.groupBy("u", "u1", "v", "v1").agg(F.max("salt").alias("salt"))
    stars = stage.put(verified(stars, sets, percent), "stars")
    roots = components(stars.filter("linked").select("u", "v"), stage, "components-0")

    rooted = members.filter("size > 2").join(roots, F.col("id") == F.col("node"), "left").withColumn("root", F.coalesce("root", "id")).drop("node")
    rooted = stage.put(rooted, "rooted")
    several = rooted.groupBy("band").agg(F.min("root").alias("a"), F.max("root").alias("b")).filter("a <> b").select("band")
    apart = stage.put(rooted.join(several, "band"), "apart")
    small = apart.filter(F.col("size") <= SMALL)
    x, y = small.alias("x"), small.alias("y")
    met = x.join(y, (F.col("x.band") == F.col("y.band")) & F.expr("x.id < y.id and x.root <> y.root") & _fits("x.n", "y.n", percent))
    met = met.select(*_ends())
    large = apart.filter(F.col("size") > SMALL)
    rest = met.unionAll(_in_large(large, stars, roots, sets, stage, percent)).distinct().withColumn("salt", F.lit(0).cast("long"))
    links = stage.put(verified(stage.put(rest, "pairs"), sets, percent), "links").filter("linked").select("u", "v")

    same = known.join(classes.select("one", "two", "n", F.col("id").alias("rep")), ["one", "two", "n"]).filter("id <> rep").select(F.col("id").alias("u"), F.col("rep").alias("v"))
    so_far = roots.select(F.col("node").alias("u"), F.col("root").alias("v"))
    roots = components(so_far.unionAll(links).unionAll(same), stage, "components-1")
    for name in ("classes", "buckets", "members", "sets", "stars", "rooted", "apart", "pairs", "links", "components-0"):
        stage.drop(name)
    out = signed.select("id", "n").join(roots, F.col("id") == F.col("node"), "left").withColumn("component_id", F.coalesce("root", "id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def _ends() -> list[Column]:
    return [F.col("x.id").alias("u"), F.col("x.one").alias("u1"), F.col("y.id").alias("v"), F.col("y.one").alias("v1")]


def _in_large(large: DataFrame, stars: DataFrame, roots: DataFrame, sets: DataFrame, stage: Staging, percent: int) -> DataFrame:
    """Pairs (u, u1, v, v1) of different components in large buckets that may be similar enough.

    A pair shares a rare shingle, or what it shares lies in the rest of either set; that is at
    most what the smaller share of the hub's set holds, and what either has of its rest beyond
    the hub. Two members tied to the hub are in its component, so one of each pair is not.
    """

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                held = np.frombuffer(batch.column("members")[i].as_buffer(), np.int64)
                own = [pa.array(np.full(len(held), batch.column(c)[i].as_py(), np.int64)) for c in ("id", "one", "n", "root")]
                yield pa.RecordBatch.from_arrays([*own, pa.array(held)], ["id", "one", "n", "root", "shingle"])

    tied = roots.select(F.col("node").alias("hub"), F.col("root").alias("tied"))
    hubs = large.select("hub", "hub1", "hub_n").distinct().join(tied, "hub", "left").withColumn("hub_root", F.coalesce("tied", "hub")).drop("tied")
    hubs = stage.put(hubs, "hubs")
    ids = large.select("id", "one", "n", "root").unionAll(hubs.select("hub", "hub1", "hub_n", "hub_root")).distinct()
    members = stage.put(ids.join(sets, ["id", "one"]).mapInArrow(explode, "id long, one long, n long, root long, shingle long"), "shingles")
    few = members.groupBy("shingle").agg(F.count("*").alias("f")).filter(F.col("f") <= RARE)
    rare = stage.put(members.join(few, "shingle"), "rare")
    stage.drop("shingles")
    x, y = rare.filter("f > 1").alias("x"), rare.filter("f > 1").alias("y")
    by_rare = x.join(y, (F.col("x.shingle") == F.col("y.shingle")) & F.expr("x.id < y.id and x.root <> y.root") & _fits("x.n", "y.n", percent)).select(*_ends()).distinct()

    counts = rare.groupBy("id", "one").agg(F.count("*").alias("r"))
    of_hub = counts.select(F.col("id").alias("hub"), F.col("one").alias("hub1"), F.col("r").alias("hub_r"))
    hubs = hubs.join(of_hub, ["hub", "hub1"], "left")
    near = stars.select(F.col("u").alias("id"), F.col("u1").alias("one"), F.col("v").alias("hub"), F.col("v1").alias("hub1"), "shared")
    each = large.select("hub", "hub1", "id", "one", "n", "root").distinct().join(counts, ["id", "one"], "left").join(near, ["id", "one", "hub", "hub1"], "left")
    each = each.join(hubs, ["hub", "hub1"]).withColumn("r", F.coalesce("r", F.lit(0))).withColumn("rest", F.col("n") - F.col("r"))
    each = each.withColumn("s", F.coalesce("shared", F.least("n", "hub_n"))).withColumn("q", F.col("n") - F.col("s") - F.greatest(F.lit(0), F.col("r") - F.coalesce("hub_r", F.lit(0))))
    each = each.withColumn("q", F.when(F.col("shared").isNull(), F.col("rest")).otherwise(F.col("q")))  # not held against the hub: no bound
    least = large.groupBy("hub", "hub1").agg(F.min("n").alias("least_n"))
    able = each.join(least, ["hub", "hub1"]).filter(100 * F.col("rest") >= percent * (F.col("least_n") + F.col("r")))
    able = stage.put(able.select("hub", "hub1", "hub_root", "id", "one", "n", "root", "rest", "s", "q"), "able")
    x, y = able.filter("root <> hub_root").alias("x"), able.alias("y")
    shared = F.expr("least(x.rest, y.rest, least(x.s, y.s) + least(x.q, y.q))")
    possible = 100 * shared >= percent * (F.col("x.n") + F.col("y.n") - shared)
    on = F.expr("x.hub = y.hub and x.hub1 = y.hub1 and x.root <> y.root and (x.id < y.id or y.root = y.hub_root)")
    by_bound = x.join(y, on & possible & _fits("x.n", "y.n", percent))
    return by_rare.unionAll(by_bound.select(*_ends()))


def op5_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), k=4, percent=80)


#: All pairs that share a shingle, and all vertices that links reach.
OP5_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id), p AS (SELECT a.doc_id AS i, b.doc_id AS j, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT i, j FROM p JOIN n x ON x.doc_id = i JOIN n y ON y.doc_id = j WHERE 100 * c >= 80 * (x.n + y.n - c)), e AS (SELECT i, j FROM l UNION ALL SELECT j, i FROM l),
r AS (SELECT doc_id AS v, doc_id AS root FROM documents UNION SELECT e.j, r.root FROM r JOIN e ON e.i = r.v)
SELECT d.doc_id, coalesce(any_value(n), 0) AS n_shingles, min(root) AS component_id, d.doc_id = min(root) AS kept FROM documents d JOIN r ON r.v = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id
"""


def keep_one(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` that stay: of every component the one with the least id.

    Cases are those of ``near_dedup``: rows without words and rows with a null id all stay, of
    repeated rows with one id all stay; an empty table gives an empty table; all columns are kept.
    """
    dropped = near_dedup(docs, id_col, **options).filter("not kept").select(F.col(id_col).alias("_dropped_id")).distinct()
    return docs.join(dropped, docs[id_col] == dropped["_dropped_id"], "left_anti")
