"""Longest-processing-time assignment of groups of equal texts to shards."""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .staging import Staging, fresh, numbered, unused

#: A group with over this share of all rows is hot; there are fewer than HOT of them.
HOT = 1000


def lpt(sizes: list[int], shards: int) -> list[int]:
    """Shard of each item: largest first, each to the least loaded shard (ties: lowest number)."""
    heap = [(0, s) for s in range(shards)]
    out = [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        load, shard = heap[0]
        out[i] = shard
        heapq.heapreplace(heap, (load + sizes[i], shard))
    return out


def bulk_lpt(histogram: Iterable[tuple[int, int]], shards: int) -> Iterator[tuple[int, list[int]]]:
    """For each (size, items) of the histogram, largest size first: how many of its items each shard gets.

    The schedule is that of ``lpt``. Of many equal items each shard below the water level that all
    of them together reach gets at once what it gets in any case; the heap deals out the rest.
    """
    load = np.zeros(shards, object)
    for size, items in sorted(histogram, reverse=True):
        given = [0] * shards
        if size == 0:  # the least loaded shard stays so
            given[min(range(shards), key=lambda s: (load[s], s))] = items
            yield size, given
            continue
        left = items
        if items > 2 * shards:
            order = sorted(load)
            level, below = 0, 0
            for n in range(1, shards + 1):  # n lowest shards, filled to one level
                below += order[n - 1]
                level = (below + items * size) // n
                if n == shards or level <= order[n]:
                    break
            for s in range(shards):
                given[s] = max(0, (level - load[s]) // size - 1)
            left -= sum(given)
        heap = [(load[s] + given[s] * size, s) for s in range(shards)]
        heapq.heapify(heap)
        for _ in range(left):
            now, s = heap[0]
            given[s] += 1
            heapq.heapreplace(heap, (now + size, s))
        for now, s in heap:
            load[s] = now
        yield size, given


def shard_lpt(docs: DataFrame, shards: int, size: Column, group: Column, order: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Rows of ``docs`` with ``shard`` (0 to shards-1) and ``slot`` (gapless from 0 in a shard).

    Rows with one value of ``group`` go to one shard. The schedule is exact LPT at any size: the
    driver gets how many groups have each total size (different sizes of B bytes in all are fewer
    than the root of 2 B) and deals equal groups out in bulk; each group's rank among those of its
    size (by its least ``order``) then decides its shard, by a join with the table of ranks. Rows of a hot group find their
    shard by a broadcast of fewer than HOT groups, the others by a join.

    Cases: null group values are one group; null sizes count 0, negative ones are an error; an
    empty table gives an empty table; rows equal in ``order`` get slots in an unspecified order;
    columns named shard or slot are renamed to ``*_in``, others are kept as they are.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    docs = fresh(docs, "shard", "slot")
    spark, stage = docs.sparkSession, Staging(docs.sparkSession)
    g, b = unused(docs, "_group"), unused(docs, "_size")
    rows = docs.withColumns({g: F.coalesce(F.xxhash64(group.cast("string"), F.lit(1)), F.lit(0)), b: F.coalesce(size.cast("long"), F.lit(0))})
    rows = stage.put(rows, "rows")
    groups = stage.put(rows.groupBy(F.col(g).alias("_group")).agg(F.sum(b).alias("_bytes"), F.count("*").alias("_times"), F.min(order[0]).alias("_first")), "groups")
    histogram = groups.groupBy("_bytes").agg(F.count("*").alias("n"), F.sum("_times").alias("rows")).toArrow()
    sizes, counts = histogram.column("_bytes").to_pylist(), histogram.column("n").to_pylist()
    if min(sizes, default=0) < 0:
        raise ValueError("sizes must not be negative")
    table: list[list[int]] = [[], [], [], []]
    for total, given in bulk_lpt(zip(sizes, counts, strict=True), shards):
        at = 0
        for s, n in enumerate(given):
            if n:
                for column, x in zip(table, (total, at, at + n, s), strict=True):
                    column.append(x)
                at += n
    plan = spark.createDataFrame(pa.table([pa.array(c, pa.int64()) for c in table], ["_bytes", "_lo", "_hi", "_shard"]))
    plan = stage.put(plan, "plan")
    ranked = numbered(groups, stage, "ranks", ["_bytes"], ["_first", "_group"], "_rank")
    placed = ranked.join(plan, "_bytes").filter("_rank >= _lo and _rank < _hi").select("_group", "_shard", "_times")
    placed = stage.put(placed, "placed")

    hot = placed.filter(F.col("_times") > max(sum(histogram.column("rows").to_pylist()) / HOT, HOT)).select(F.col("_group").alias("_hot"), F.col("_shard").alias("_there"))  # fewer than HOT rows
    own = F.when(F.col("h._hot").isNull(), F.col(f"d.{g}")).otherwise(F.xxhash64(*(f"d.`{c}`" for c in order)))  # hot rows need no partner and are spread
    found = rows.alias("d").join(F.broadcast(hot).alias("h"), F.col(f"d.{g}") == F.col("h._hot"), "left")
    found = found.select(F.struct(*(F.col(f"d.`{c}`") for c in docs.columns)).alias("row"), "h._there", own.alias("key"))
    dealt = found.join(placed.select("_group", "_shard"), F.col("key") == F.col("_group"), "left").select("row.*", F.coalesce("_there", "_shard").cast("int").alias("shard"))
    out = numbered(dealt, stage, "slots", ["shard"], list(order), "slot")
    for name in ("rows", "groups", "plan", "ranks-local", "placed"):
        stage.drop(name)
    return out


def op2_sharding(spark, sf_dir: str) -> DataFrame:
    """All documents in 40 shards under the law ``bytes``; a null text counts like an empty one."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.sha2(text.cast("binary"), 256).alias("digest"))
    out = shard_lpt(rows, 40, F.col("size"), F.col("digest"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


#: The schedule by one step a group, its loads a list. Equal sizes go by rank to the shards in their order, as many as each got.
OP2_SQL = """
WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS t, octet_length(encode(coalesce(text, ''))) + 16 AS size FROM documents),
g AS (SELECT t, sum(size)::BIGINT AS bytes, min(doc_id) AS first FROM d GROUP BY t),
o AS (SELECT list(bytes ORDER BY bytes DESC) AS sizes FROM g),
s(k, shard, loads) AS (SELECT 0, 0, list_transform(range(40), lambda i: 0::BIGINT) UNION ALL
  SELECT k + 1, p, list_transform(loads, lambda v, i: CASE WHEN i = p THEN v + sizes[k + 1] ELSE v END) FROM (SELECT k, loads, list_position(loads, list_min(loads))::INT AS p FROM s) q, o WHERE k < len(sizes)),
a AS (SELECT sizes[k] AS bytes, shard - 1 AS shard, count(*) AS n FROM s, o WHERE k > 0 GROUP BY 1, 2),
i AS (SELECT *, sum(n) OVER (PARTITION BY bytes ORDER BY shard) AS hi FROM a), r AS (SELECT *, row_number() OVER (PARTITION BY bytes ORDER BY first) AS rank FROM g),
p AS (SELECT t, shard FROM r JOIN i ON r.bytes = i.bytes AND rank > hi - n AND rank <= hi),
b AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i::BIGINT, [0, 1, 2, 3, 4, 5, 6, 7]), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tb),
h AS (SELECT t, hex(encode(t)) AS x FROM g), c AS (SELECT t, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, len(x), 2), lambda i: ('0x' || substr(x, i + 1, 2))::BIGINT)), lambda c, v: xor(tb[(xor(c, v) & 255) + 1], c >> 8)), 4294967295) AS crc FROM h, b)
SELECT doc_id, size::BIGINT AS size, crc AS text_crc32, 'bytes' AS law, shard::INT AS shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS slot, NULL::INT AS grown_shard FROM d JOIN p USING (t) JOIN c USING (t)
"""
