"""Operators against plain versions, and the rows that break things."""

import itertools
import math
import random
import re
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest

from retort.llm import decontamination, exact_dedup, near_dedup, pii, queries, sharding, substring_dedup, words

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, texts, first=0):
    return spark.createDataFrame([(first + i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)], SCHEMA)


def thue_morse(n, a, b):
    out = [0]
    while len(out) < n:
        out += [1 - x for x in out]
    return "".join((a, b)[x] for x in out[:n]), "".join((a, b)[1 - x] for x in out[:n])


def test_word_hashes_have_no_pattern_that_cancels(spark):
    one, two = thue_morse(1024, "a", "b")
    for first, second in ((one, two), (one[:64], two[:64]), (one[:8], two[:8])):
        w = words.Words(pa.array([first, second]))
        assert w.hash[0] != w.hash[1] and w.other_hash()[0] != w.other_hash()[1]
    plain = " ".join(f"w{i}" for i in range(19))
    texts = [f"{one} {plain}", f"{two} {plain}"]
    got = {r["doc_id"]: r for r in substring_dedup.substring_dedup(frame(spark, texts)).collect()}
    assert got[1]["n_removed"] == 0
    pair = [f"{one} {plain[:20]}", f"{two} {plain[:20]}"]
    assert all(r["kept"] for r in near_dedup.near_dedup(frame(spark, pair), k=40, percent=100).collect())
    bench = spark.createDataFrame([(1, " ".join([one] * 8))], "item_id long, text string")
    assert [r["n_hits"] for r in decontamination.contamination(frame(spark, [" ".join([two] * 8)]), bench).collect()] == [0]


def test_words_of_a_very_long_row_in_bounded_memory():
    text = pa.array(["abcde " * (50_000_000 // 6)])
    tracemalloc.start()
    w = words.Words(text, lower=True)
    w.windows(5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 16 * 50_000_000 and len(w.hash) == 50_000_000 // 6


def test_runs_are_one_hash_for_one_sequence():
    rng = random.Random(3)
    texts = [" ".join(rng.choice("abc") for _ in range(200)) for _ in range(3)]
    w = words.Words(pa.array(texts))
    for k in (1, 2, 3, 5, 6, 20):
        starts, h = w.windows(k)
        seen = {}
        for s, x in zip(starts.tolist(), h.tolist(), strict=True):
            key = tuple(w.word(i) for i in range(s, s + k))
            assert seen.setdefault(key, x) == x
        assert len(set(seen.values())) == len(seen) and len(starts) == 3 * (201 - k)


def test_masks_hit_every_allowed_pattern():
    for n in range(decontamination.MIN_WORDS, 20):
        need = min(n, decontamination.WINDOW)
        off = need - math.ceil(decontamination.SHARE * need - 1e-9)
        for start in range(n - need + 1):
            for wrong in itertools.combinations(range(start, start + need), off):
                assert any(all(m[j] == "0" or at + j not in wrong for j in range(len(m))) for m in decontamination.MASKS for at in range(start, start + need - len(m) + 1))


def plain_hits(text, item):
    """Whether a window of the item agrees with the text in place by 80 %."""
    need = min(13, len(item))
    for a in range(len(text) - need + 1):
        for b in range(len(item) - need + 1):
            if sum(text[a + i] == item[b + i] for i in range(need)) >= 0.8 * need:
                return True
    return False


@pytest.mark.parametrize("seed", [1, 2])
def test_decontamination_against_brute_force(spark, seed):
    rng = random.Random(seed)
    word = lambda: "w%d" % rng.randrange(30)
    items = [[word() for _ in range(n)] for n in (8, 9, 10, 11, 12, 13, 20, 40, 7, 9)]
    items.append(items[0])
    items.append(["same"] * 30)
    texts = []
    for item in items * 4:
        part = item[rng.randrange(3) :][: rng.randrange(8, 50)]
        part = [word() if rng.random() < 0.15 else x for x in part]
        texts.append([word() for _ in range(rng.randrange(10))] + part + [word() for _ in range(rng.randrange(10))])
    texts += [["same"] * 3000, [], ["same"] * 12]
    bench = spark.createDataFrame([(f"i{i}", " ".join(x)) for i, x in enumerate(items)] + [(None, " ".join(items[7]).upper())], "item_id string, text string")
    got = {r["doc_id"]: r for r in decontamination.contamination(frame(spark, [" ".join(t) for t in texts]), bench).collect()}
    for i, t in enumerate(texts):
        want = {f"i{j}" for j, x in enumerate(items) if len(x) >= 8 and plain_hits(t, x)} | ({None} if plain_hits(t, items[7]) else set())
        assert set(got[i]["item_ids"]) == want and got[i]["contaminated"] == bool(want)


def test_decontamination_keeps_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h", 5, 6, "x"), (1, "a b c d e f g h", 5, 6, "x"), (None, None, 1, 2, "y"), (3, "", 0, 0, "z")], "doc_id long, text string, _t long, _n long, item_ids string")
    bench = spark.createDataFrame([(1, "A b c d e f g h")], "item_id int, text string")
    left = decontamination.decontaminate(docs, bench)
    assert left.columns == docs.columns and sorted(r["item_ids"] for r in left.collect()) == ["y", "z"]
    assert len(decontamination.contamination(docs, bench).collect()) == 4


def test_bulk_schedule_is_that_of_the_heap():
    for seed in range(60):
        rng = random.Random(seed)
        shards = rng.randrange(1, 9)
        sizes = [rng.choice([0, 1, 2, 3, 7, 50, 1000, rng.randrange(200)]) for _ in range(rng.randrange(400))]
        loads = np.zeros(shards, int)
        counts = {s: sizes.count(s) for s in set(sizes)}
        for s, given in sharding.bulk_lpt(counts.items(), shards):
            assert sum(given) == counts[s]
            loads += s * np.array(given)
        want = np.zeros(shards, int)
        for s, i in zip(sizes, sharding.lpt(sizes, shards), strict=True):
            want[i] += s
        assert (loads == want).all()


def test_sharding_against_the_plain_schedule(spark):
    from pyspark.sql import functions as F

    rng = random.Random(5)
    texts = ["t%d" % rng.randrange(400) * rng.randrange(1, 6) for _ in range(3000)] + ["hot"] * 3000 + [None] * 50
    docs = frame(spark, texts).withColumns({"_group": F.lit("keep"), "_size": F.lit(7), "_key": F.lit(1), "slot": F.lit(-1)})
    out = sharding.shard_lpt(docs, 7, F.coalesce(F.octet_length("text"), F.lit(0)) + 16, F.col("text"))
    got = [r.asDict() for r in out.collect()]
    assert len(got) == len(texts) and all((r["_group"], r["_size"], r["_key"], r["slot_in"]) == ("keep", 7, 1, -1) for r in got)
    of, loads, sizes = {}, [0] * 7, {}
    for r in got:
        assert of.setdefault(r["text"], r["shard"]) == r["shard"]
        loads[r["shard"]] += len(r["text"] or "") + 16
        sizes[r["text"]] = sizes.get(r["text"], 0) + len(r["text"] or "") + 16
    want = [0] * 7
    items = sorted(sizes.values(), reverse=True)
    for s, i in zip(items, sharding.lpt(items, 7), strict=True):
        want[i] += s
    assert sorted(loads) == sorted(want)
    for s in range(7):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    assert sharding.shard_lpt(docs.limit(0), 7, F.lit(1), F.col("text")).collect() == []


def test_exact_dedup_keeps_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a", "p"), (2, "a", "q")], "doc_id long, text string, _hex2 string")
    assert [tuple(r) for r in exact_dedup.exact_dedup(docs, keep="min").collect()] == [(1, "a", "p")]


@pytest.mark.parametrize("seed", [6, 7])
def test_near_dedup_in_dense_buckets(spark, seed, monkeypatch):
    """Many variants of one text, most of them apart: all pairs decide."""
    monkeypatch.setattr(near_dedup, "ROWS_PER_COPY", 16)
    rng = random.Random(seed)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for _ in range(150):
        t = list(base)
        for _ in range(rng.randrange(14)):
            t[rng.randrange(len(t))] = rng.choice(["and", "the", "of", f"x{rng.randrange(10**6)}"])
        texts.append(t)
    sets = [frozenset(tuple(t[i : i + 4]) for i in range(len(t) - 3)) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(texts)), 2):
        if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_dedup(frame(spark, [" ".join(t) for t in texts]), k=4).collect()}
    assert got == {i: find(i) for i in range(len(texts))}


def test_pii_of_many_values_in_one_text_against_plain_neighbourhoods(spark):
    text = " ".join(f"name{i % 7} n{i % 7}@site.org, and" for i in range(4000))
    docs = frame(spark, [text] * 3 + ["other words"] * 20)
    got = pii.pii(docs).filter("n_email > 0").collect()
    assert [r["n_email"] for r in got] == [4000] * 3
    begins = [m.span() for m in re.finditer(r"\S+", "aa b@c.de,x ff g@h.io zz")]
    base = pii.base_spans("aa b@c.de,x ff g@h.io zz")
    free = pii._free(np.array([a for a, _ in begins]), np.array([b for _, b in begins]), base)
    assert free.tolist() == [not any(a < y and x < b for _, x, y, _ in base) for a, b in begins]


COLUMNS = {
    "op1_url_filter": ["page_id", "host", "path", "rule", "verdict"],
    "op2_sharding": ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"],
    "op3_exact_dedup": ["doc_id", "keep_id", "group_size", "kept", "text_sha256"],
    "op4_toxicity": ["doc_id", "held_out", "score", "predicted"],
    "op5_near_dedup": ["doc_id", "n_shingles", "component_id", "kept"],
    "op6_packing": ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
    "op8_quality": ["doc_id", "held_out", "score", "predicted"],
    "op9_substring_dedup": ["doc_id", "n_words", "n_removed", "kept_sha256"],
    "op10_pii": ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_queries_hold_their_contract(spark, name, tmp_path):
    texts = ["one two three four five six", None, "", "a@b.co 10.0.0.1", "one two three four five six", "x " * 300]
    frame(spark, texts * 10).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, i % 2, (i // 2) % 2) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(i, u) for i, u in enumerate(["https://a.org/x", None, "none", "http://x.com/de/1"])], "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    out = queries.queries()[name](spark, str(tmp_path))
    assert set(COLUMNS[name]) <= set(out.columns)
    got = [r.asDict() for r in out.collect()]
    if name == "op2_sharding":
        assert {r["law"] for r in got} == {"bytes"} and {r["grown_shard"] for r in got} == {None} and all(0 <= r["shard"] < 40 for r in got)
        assert {(r["size"], r["text_crc32"]) for r in got} == {(len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for t in texts}
    if "held_out" in out.columns:
        limit = 0.5 if name.startswith("op4") else 0.3
        assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == int(r["score"] >= limit) for r in got)
    if name != "op6_packing":
        assert len(got) == (4 if name == "op1_url_filter" else 60)


def plain_branches(leaves, z=1.96):
    """{(host, template): branch} of {(host, template): (bad, known)} by loops."""

    def apart(group):
        pb, pk = sum(b for b, _ in group.values()), sum(k for _, k in group.values())
        out = {}
        for key, (b, k) in group.items():
            rest = pk - k
            if not k or not rest:
                out[key] = (False, False)
                continue
            share = pb / pk
            gap = b / k - (pb - b) / rest
            out[key] = (abs(gap) > z * math.sqrt(share * (1 - share) * (1 / k + 1 / rest)) and k >= 5, gap > 0)
        return out

    groups = {}
    for (host, t), v in leaves.items():
        groups.setdefault((host, t.rsplit("/", 1)[0] if "/" in t else t), {})[host, t] = v
    sides, out = {}, {}
    for (host, parent), group in groups.items():
        for key, (far, above) in apart(group).items():
            side = parent + ("/~" if not far else "/~+" if above else "/~-")
            sides.setdefault((host, side), {})[key] = (leaves[key], far)
    for (_, side), group in sides.items():
        for key, (far, _) in apart({k: v for k, (v, _) in group.items()}).items():
            out[key] = key[1] if far and group[key][1] else side
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_url_filter_against_plain_loops(spark, seed):
    from retort.llm import url_filter

    rng = random.Random(seed)
    shares = {(h, s): rng.choice([0.05, 0.1, 0.6, 0.9]) for h in ("a.net", "b.net") for s in ("news", "spam", "shop", "wiki", "tags")}
    pages, labels = [(None, None), (10_000, "http://a.net/news/1"), (10_000, "http://a.net/news/1"), (10_001, ""), (10_002, "x://"), (10_003, "http://a.net/" + "long/" * 500)], []
    for i in range(1500):
        h, s = rng.choice(sorted(shares))
        pages.append((i, f"http://{h}/{s}/{rng.randrange(900)}{rng.choice(['', '?q', '.html'])}"))
        if rng.random() < 0.4:
            labels.append((i, int(rng.random() >= shares[h, s])))
    columns = spark.createDataFrame([(*p, 1, "x") for p in pages], "page_id long, url string, template int, n string")
    got = url_filter.url_filter(columns, spark.createDataFrame(labels, "doc_id long, quality int"), [])
    got = [r.asDict() for r in got.collect()]
    assert len(got) == len(pages)
    known = dict(labels)
    leaves, hosts = {}, {}
    for r in got:
        b, k = leaves.get((r["host"], r["template"]), (0, 0))
        if r["page_id"] in known:
            b, k = b + (known[r["page_id"]] == 0), k + 1
        leaves[r["host"], r["template"]] = (b, k)
    branch = plain_branches(leaves)
    overall = sum(b for b, _ in leaves.values()) / sum(k for _, k in leaves.values())
    sums = {}
    for key, (b, k) in leaves.items():
        for table, name in ((sums, (key[0], branch[key])), (hosts, key[0])):
            x, y = table.get(name, (0, 0))
            table[name] = (x + b, y + k)
    for r in got:
        b, k = sums[r["host"], branch[r["host"], r["template"]]]
        hb, hk = hosts[r["host"]]
        impurity = (b + 10 * (hb + 10 * overall) / (hk + 10)) / (k + 10)
        assert r["impurity"] == pytest.approx(impurity)
        assert r["verdict"] == ("block" if b and impurity >= 0.5 else "allow")
    assert {r["template"] for r in got if r["host"] == "a.net"} >= {"/news/#", "/spam/#.html"}


def plain_terms(texts, reach=8, least=3, probability=0.5, npmi=0.5):
    """Places of disclosing words by loops over documents."""
    low = lambda w: w.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    held, near, spans = [], set(), []
    for t in texts:
        words = [(m.start(), m.end(), low(m[0])) for m in re.finditer(r"[^\x20\x09-\x0D]+", t or "")]
        base = pii.base_spans(t or "")
        free = [w for w in words if not any(w[0] < b and a < w[1] for _, a, b, _ in base)]
        held.append(({w for _, _, w in words}, {(k, v) for k, _, _, v in base}))
        spans.append(free)
        for k, a, b, v in base:
            first = max((i for i, w in enumerate(words) if w[0] <= a), default=-1)
            last = next((i for i, w in enumerate(words) if w[0] >= b), len(words))
            near |= {((k, v), w[2]) for i, w in enumerate(words) if first - reach <= i < last + reach and w in free}
    total = sum(bool(w) for w, _ in held)
    terms = set()
    for e, t in near:
        n_e, n_t = sum(e in x for _, x in held), sum(t in w for w, _ in held)
        n_et = sum(e in x and t in w for w, x in held)
        if n_e >= least and n_et >= least and n_et / n_t >= probability:
            p = n_et / total
            if p == 1 or math.log(n_et * total / (n_t * n_e)) / -math.log(p) >= npmi:
                terms.add(t)
    return [{(a, b) for a, b, w in free if w in terms} for free in spans]


@pytest.mark.parametrize("seed", [3, 4])
def test_pii_terms_against_plain_counts(spark, seed):
    rng = random.Random(seed)
    names = [f"person{i}" for i in range(12)]
    texts = [None, "", " "]
    for _ in range(250):
        words = [rng.choice(["alpha", "beta", "gamma", "delta", "Omega"]) for _ in range(rng.randrange(3, 40))]
        for _ in range(rng.randrange(3)):
            n = rng.choice(names)
            at = rng.randrange(len(words))
            words[at:at] = [n] * (rng.random() < 0.8) + [f"{n}@mail.org"] * (rng.random() < 0.8) + [rng.choice(["filler"] * 3 + [n.upper()])]
        texts.append(" ".join(words))
    texts += texts[5:8] * 5
    got = {r["doc_id"]: r for r in pii.pii(frame(spark, texts)).collect()}
    want = plain_terms(texts)
    assert any(want)
    for i in range(len(texts)):
        found = {tuple(map(int, s.split(":")[1:])) for s in got[i]["spans"].split(",") if s.startswith("term")}
        assert found == want[i], (i, texts[i])
