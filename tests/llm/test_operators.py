"""Each operator against brute force on small fixtures, and with nulls, empty and very long texts, ties,
repeated rows, empty tables and clashing extra columns."""

import base64
import gzip
import hashlib
import json
import math
import os
import random
import re
import unicodedata
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from cirque.llm import decontaminate, html, linededup, packing, quality, queries, rules, sharding, simhash, urls, warc
from cirque.operators.components import components

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
RNG = random.Random(5)
VOCAB = ["".join(RNG.choice("abcdefghijklmnop") for _ in range(RNG.randint(2, 9))) for _ in range(3000)]


def prose(n, seed):
    r = random.Random(seed)
    out, k = [], 0
    while k < n:
        m = r.randint(6, 14)
        out.append(" ".join(r.choice(VOCAB) for _ in range(m)).capitalize() + ".")
        k += m
    return " ".join(out)


def odd_docs(spark):
    """Nulls in every column, empty and blank texts, a very long text, repeated rows, ties, clashing columns."""
    long_ = " ".join(prose(50, 7000 + k) for k in range(400))
    rows = [
        (1, None, "en", "a", None), (2, "", None, "a", 0), (3, " \t\n\x0b ", "en", None, 3), (4, long_, "en", "a", 9), (5, prose(60, 1), "en", "a", 1), (5, prose(60, 1), "en", "a", 1),
        (6, prose(60, 1), "de", "b", 1), (None, prose(60, 2), "en", "a", 1), (7, "one", "en", "a", 3), (8, "É\x1cx  y <|endoftext|>", "fr", "c", 9), (9, "x\r\ny\r\n" * 5, "fr", "c", 9),
    ]
    d = spark.createDataFrame(rows, DOCS)
    for extra in ("node", "rank", "f0", "component_id", "key", "n", "size", "shard", "score", "_w", "_m", "y", "th", "gone", "lid"):
        d = d.withColumn(extra, F.lit("clash"))
    return d


def none(df):
    return df.limit(0)


# simhash


def slow_fingerprint(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def reach(ids, linked):
    group = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            low = min(group[a], group[b])
            changed |= group[a] != low or group[b] != low
            group[a] = group[b] = low
    return group


def test_simhash_is_the_contract(spark):
    got = queries.queries()["op5_simhash"](spark, SF).collect()
    text = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    want = {k: slow_fingerprint(t) for k, t in text.items()}
    assert {r["doc_id"]: int(r["fingerprint"], 16) for r in got} == want and all(len(r["fingerprint"]) == 16 for r in got)
    linked = [(a, b) for a in want for b in want if a < b and (want[a] ^ want[b]).bit_count() <= 2]
    assert {r["doc_id"]: r["component_id"] for r in got} == reach(want, linked)


def test_simhash_links_at_every_distance(spark):
    rng, base = random.Random(1), []
    for _ in range(30):
        f = rng.getrandbits(64)
        base += [f, f ^ 1 << rng.randrange(64), f ^ 3 << rng.randrange(60), f ^ 7 << rng.randrange(60)]
    base += [0, 1, 1 << 63, (1 << 63) | 1]
    signed = [x - (1 << 64) if x >> 63 else x for x in base]
    d = spark.createDataFrame([(x, i) for i, x in enumerate(signed)], "f0 long, node long").groupBy("f0").agg(F.min("node").alias("node"))
    nodes = {r["node"]: r["f0"] & (1 << 64) - 1 for r in d.collect()}
    want = reach(nodes, [(a, b) for a in nodes for b in nodes if a < b and (nodes[a] ^ nodes[b]).bit_count() <= 2])
    edges = simhash.links(d, simhash.CONTRACT)
    assert all((nodes[r["a"]] ^ nodes[r["b"]]).bit_count() <= 2 for r in edges.collect())
    got = {r["node"]: r["component"] for r in components(edges).collect()}
    assert {n: got.get(n, n) for n in nodes} == want


def test_components_of_chains_and_stars(spark):
    e = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 100)] + [(5000, 5000)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(e, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(201)}, **{1000 + i: 1000 for i in range(100)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_copies_at_08_are_found_and_others_left(spark):
    rows, r = [], random.Random(3)
    for k in range(40):
        t = prose(400, 1000 + k)
        rows.append((2 * k, t, "en", "a", 0))
        w = t.split(" ")
        for _ in range(3):
            w[r.randrange(len(w))] = "changed"
        rows.append((2 * k + 1, " ".join(w), "en", "a", 0))
    kept = {x["doc_id"] for x in simhash.keep_first(spark, spark.createDataFrame(rows, DOCS), SF).collect()}
    assert all(2 * k in kept for k in range(40)) and sum(2 * k + 1 in kept for k in range(40)) <= 1


def test_lanes_cut_the_whole_fingerprint(spark):
    """Lanes of any width, across the parts of a fingerprint too, against plain slices of its bits."""
    r = random.Random(21)
    for longs, bits in ((8, 30), (5, 32), (2, 7), (3, 1)):
        p = simhash.SimHashParams(words=5, longs=longs, lane_bits=bits, distance=9)
        x = [r.getrandbits(64 * longs) for _ in range(20)]
        signed = lambda v: v - (1 << 64) if v >> 63 else v
        d = spark.createDataFrame([(k, *(signed(v >> 64 * i & (1 << 64) - 1) for i in range(longs))) for k, v in enumerate(x)], "node long, " + ", ".join(f"f{k} long" for k in range(longs)))
        want = {k: [v >> bits * lane & (1 << bits) - 1 | lane << 32 for lane in range(64 * longs // bits)] for k, v in enumerate(x)}
        assert {q["node"]: q["l"] for q in d.select("node", F.array(*simhash._lanes(p)).alias("l")).collect()} == want


def test_recall_at_08(spark):
    """Pairs of a similarity a little above 0.8, none equal: at least nine tenths are found, and no pair below is linked."""
    rows, want, r = [], set(), random.Random(33)
    for k in range(150):
        w = prose(300, 40_000 + k).split(" ")
        v = list(w)
        for at in r.sample(range(10, 290), 6):
            v[at] = "changed"
        a, b = " ".join(w), " ".join(v)
        rows += [(2 * k, a, "en", "a", 0), (2 * k + 1, b, "en", "a", 0)]
        if jaccard(a, b) >= 0.8:
            want.add(2 * k)
    got = {x["doc_id"]: x["component_id"] for x in simhash.near_duplicates(spark.createDataFrame(rows, DOCS), simhash.SIMILAR_08).collect()}
    linked = {k for k in got if got[k] != k}
    assert len(want) > 50 and {k - 1 for k in linked} <= want and all(got[k] == k - 1 for k in linked)
    assert len(linked) >= 0.9 * len(want)


def test_crowded_lanes_lose_no_pair(spark):
    """Strangers between two near copies in a bucket, a long bucket of strangers, and bridges between groups."""
    r, p, lane = random.Random(8), simhash.SimHashParams(words=5, longs=5, lane_bits=32, distance=60, similarity=0.8), 0x1234ABCD
    wide = lambda bits: [x - (1 << 64) if x >> 63 else x for x in (bits >> 64 * k & (1 << 64) - 1 for k in range(p.longs))]
    prints = {k: r.getrandbits(320) >> 32 << 32 | lane for k in range(60)}
    for k in range(0, 60, 3):
        prints[100 + k] = prints[k] ^ sum(1 << b for b in r.sample(range(32, 320), 50))
        prints[200 + k] = prints[100 + k] ^ sum(1 << b for b in r.sample(range(32, 320), 50)) ^ 1 << r.randrange(32)
    d = spark.createDataFrame([(*wide(x), k) for k, x in prints.items()], ", ".join(f"f{k} long" for k in range(p.longs)) + ", node long")
    want = reach(prints, [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= p.distance])
    assert sum(want[k] != k for k in want) == 40
    got = {x["node"]: x["component"] for x in components(simhash.links(d, p)).collect()}
    assert {k: got.get(k, k) for k in prints} == want


def jaccard(a, b):
    a, b = (set(zip(*(t.lower().split()[k:] for k in range(5)))) for t in (a, b))
    return len(a & b) / len(a | b)


def test_near_dedup_links_only_similar_texts(spark):
    """A family that shares a template, against the true similarity of five words: at 0.7 and below all stay, copies go."""
    r, texts = random.Random(12), {}
    for k in range(120):
        share = (230, 250, 262)[k % 3]
        texts[k] = prose(share, 9000 + k % 3) + " " + prose(300 - share, 9100 + k)
    for k in range(0, 120, 4):
        w = texts[k].split(" ")
        w[r.randrange(len(w))] = "changed"
        texts[500 + k] = " ".join(w)
    pump = "all of it again and " * 300
    texts.update({800: pump + prose(40, 31), 801: pump + prose(40, 32)})
    linked = [(a, b) for a in texts for b in texts if a < b and jaccard(texts[a], texts[b]) >= 0.8]
    want = reach(texts, linked)
    prints = {k: simhash.fingerprint(t, 5, 5) for k, t in texts.items()}
    close = {(a, b) for a in texts for b in texts if a < b and sum(((x ^ y) & (1 << 64) - 1).bit_count() for x, y in zip(prints[a], prints[b])) <= 60}
    assert len(close) > 2 * len(linked) and (800, 801) in close
    d = spark.createDataFrame([(k, t, "en", "a", 0) for k, t in texts.items()], DOCS)
    got = {x["doc_id"]: x["component_id"] for x in simhash.near_duplicates(d, simhash.SIMILAR_08).collect()}
    assert all(want[k] == want[c] for k, c in got.items()) and all(got[500 + k] == got[k] for k in range(0, 120, 4))
    assert got[800] == 800 and got[801] == 801


def test_simhash_odd(spark):
    d = odd_docs(spark)
    out = simhash.near_duplicates(d).collect()
    by = {}
    for r in out:
        by.setdefault(r["doc_id"], set()).add((r["f0"], r["component_id"]))
    assert len(out) == 11 and {k: {c for _, c in v} for k, v in by.items()}[6] == {5} and by[1] == by[2] == by[3]
    assert simhash.near_duplicates(none(d)).count() == 0
    assert simhash.keep_first(spark, d, SF).columns == d.columns


# sharding


def test_shards_law_and_slots(spark):
    r = sharding.shard(odd_docs(spark).select(*DOCS.replace(" long", "").replace(" string", "").split(", ")), 4).collect()
    by = {}
    for x in r:
        by.setdefault(x["shard"], []).append(x["slot"])
    assert sorted(map(len, by.values())) == [2, 3, 3, 3] and all(sorted(v) == list(range(len(v))) for v in by.values())
    one = next(x for x in r if x["doc_id"] == 8)
    t = "É\x1cx  y <|endoftext|>".encode()
    assert one["size"] == len(t) + 16 and one["text_crc32"] == zlib.crc32(t)
    assert sharding.shard(none(odd_docs(spark)), 40).count() == 0 and sharding.shard(odd_docs(spark), 40).count() == 11


def slow_hilbert(x, bits):
    """Skilling's axes to index, on Python integers."""
    x, n, level = list(x), len(x), 1 << bits - 1
    while level > 1:
        for i in range(n):
            if x[i] & level:
                x[0] ^= level - 1
            else:
                t = (x[0] ^ x[i]) & level - 1
                x[0] ^= t
                x[i] ^= t
        level >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = 0
    for k in range(bits - 1, 0, -1):
        if x[n - 1] & 1 << k:
            t ^= (1 << k) - 1
    return int("".join(str((v ^ t) >> b & 1) for b in range(bits - 1, -1, -1) for v in x), 2)


def test_shards_are_brute_force(spark):
    """The whole query: quantised metadata, curve, order, shards and slots, plainly."""
    docs, got = spark.read.parquet(f"{SF}/documents.parquet").collect(), queries.queries()["op3_hilbert_shards"](spark, SF).collect()
    size = {r["doc_id"]: len((r["text"] or "").encode()) + 16 for r in docs}
    crc = {r["doc_id"]: zlib.crc32((r["text"] or "").encode()) for r in docs}
    cuts = lambda v: [sorted(v)[max(0, math.ceil(len(v) * i / 64) - 1)] for i in range(1, 64)]
    sizes, ids = cuts(size.values()), cuts(size)
    hashed = lambda s: 42 % 64 if s is None else xxhash.xxh64_intdigest(s.encode(), 42) % 64
    key = {}
    for r in docs:
        d = r["doc_id"]
        key[d] = (slow_hilbert((hashed(r["lang"]), hashed(r["source"]), sum(c < size[d] for c in sizes), sum(c < d for c in ids)), sharding.BITS), d)
    order, n = sorted(key, key=key.get), len(key)
    want = {}
    for rank, d in enumerate(order):
        shard = rank * 40 // n
        want[d] = (size[d], crc[d], "rows", shard, rank - -(-shard * n // 40), None, key[d][0])
    assert {r["doc_id"]: tuple(r[c] for c in ("size", "text_crc32", "law", "shard", "slot", "grown_shard", "hilbert")) for r in got} == want and len(got) == n


def test_shards_prune_by_several_columns(spark):
    """Shards whose minima and maxima can't hold a value, by the curve and by doc_id alone."""
    d = sharding.shard(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), 40)
    ends = sharding.shard_ends(d).collect()
    assert len(ends) == 40 and sum(r["rows"] for r in ends) == d.count()
    held = {}
    for r in d.collect():
        held.setdefault(r["shard"], []).append(r)
    for r in ends:
        for c in ("lang", "source", "size", "doc_id"):
            v = [x[c] for x in held[r["shard"]] if x[c] is not None]
            assert (r[f"min_{c}"], r[f"max_{c}"]) == (min(v), max(v))
    # a size within the top tenth, then the same within a tenth of the ids
    sizes, ids = sorted(r["size"] for v in held.values() for r in v), sorted(r["doc_id"] for v in held.values() for r in v)
    big, low = sizes[len(sizes) * 9 // 10], ids[len(ids) // 10]
    by_size = sum(r["max_size"] < big for r in ends)
    both = sum(r["max_size"] < big or r["min_doc_id"] > low for r in ends)
    print("pruned of 40:", by_size, both)
    assert by_size >= 4 and both >= 20


def test_hilbert_is_a_curve(spark):
    for n, bits in ((2, 3), (3, 2), (4, 2)):
        side = 1 << bits
        d = spark.range(side**n).select(*[F.expr(f"cast(id div {side**k} % {side} as long)").alias(f"d{k}") for k in range(n)])
        rows = sharding.with_hilbert(d, [f"d{k}" for k in range(n)], bits).orderBy("hilbert").collect()
        assert [r["hilbert"] for r in rows] == list(range(side**n))
        assert all(sum(abs(a[k] - b[k]) for k in range(n)) == 1 for a, b in zip(rows, rows[1:]))


# urls


def test_urls(spark):
    u = ["http://A.Example.NET/en/1?x", "https://b.net", "http://example.com/de/3#x", "http://badexample.com/de/3", "http://x.org/fr/", "nothing", None, "ftp://q.org?/fr/", "://H/p", "http://example.com/de"]
    d = spark.createDataFrame(list(enumerate(u)), "page_id long, url string").withColumn("host", F.lit("clash")).withColumn("rule", F.lit(1))
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge(d).collect()}
    assert got == {
        0: ("a.example.net", "/en/1", "example.net/en/", "allow"), 1: ("b.net", "", None, "allow"), 2: ("example.com", "/de/3", "example.com/de/", "block"),
        3: ("badexample.com", "/de/3", None, "allow"), 4: ("x.org", "/fr/", "org/fr/", "allow"), 5: ("", "", None, "allow"), 6: ("", "", None, "allow"),
        7: ("q.org", "", None, "allow"), 8: ("h", "/p", None, "allow"), 9: ("example.com", "/de", None, "allow"),
    }
    assert urls.judge(none(d)).count() == 0


def slow_tree(rows, p):
    """(host, template) -> (leaf, purity, support, judged), plainly."""
    known, bad = {}, {}
    for h, t, y in rows:
        key = (h, tuple(t))
        known[key] = known.get(key, 0) + (y is not None)
        bad[key] = bad.get(key, 0) + (y or 0)
    found = {}
    for kind, scope_of in (("h", lambda h: h), ("d", lambda h: ".".join(h.split(".")[-2:])), ("a", lambda h: "")):
        for scope in {scope_of(h) for h, _ in known if h}:
            mine = [k for k in known if k[0] and scope_of(k[0]) == scope]
            total = lambda ks: (sum(known[k] for k in ks), sum(bad[k] for k in ks), len({k[0] for k in ks if known[k]}))
            smooth = lambda b, k, up: (b + p.strength * up) / (k + p.strength)
            n, b, hosts = total(mine)
            state = {k: ("", (n, b, hosts), smooth(b, n, p.prior)) for k in mine}
            for level in range(p.depth + 1):
                nodes = {}
                for k in mine:
                    if len(k[1]) > level:
                        nodes.setdefault(state[k][0], []).append(k)
                for node, ks in nodes.items():
                    segs = {}
                    for k in ks:
                        segs.setdefault(k[1][level], set()).add(k[0])
                    part = lambda k: k[1][level] if (len(segs) <= p.fan_out if kind == "h" else len(segs[k[1][level]]) >= p.hosts) else "*"  # noqa: B023, E731
                    pk, pb, _ = total(ks)
                    for q in {part(k) for k in ks}:
                        these = [k for k in ks if part(k) == q]
                        ck, cb, ch = total(these)
                        rk, rb = pk - ck, pb - cb
                        share = pb / max(pk, 1)
                        alike = ck > 0 and rk > 0 and abs(cb / ck - rb / rk) <= p.z * math.sqrt(share * (1 - share) * (1 / ck + 1 / rk))
                        for k in these:
                            _, stats, score = state[k]
                            state[k] = (node + "/*", stats, score) if alike else (node + "/" + q, (ck, cb, ch), smooth(cb, ck, score))
            for k in mine:
                found.setdefault(k, {})[kind] = state[k]
    out = {}
    for k, s in found.items():
        (_, _, ah), a_score = s["a"][1], s["a"][2]
        x = a_score if ah >= p.hosts else p.prior
        dk, db, dh = s["d"][1]
        x = smooth(db, dk, x) if dh >= p.hosts else x
        hk, hb, _ = s["h"][1]
        out[k] = (s["h"][0], smooth(hb, hk, x), hk, hk >= p.support or dh >= p.hosts or ah >= p.hosts)
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_template_tree_is_brute_force(spark, seed):
    r, p = random.Random(seed), urls.TreeParams(depth=2, fan_out=4, hosts=2)
    rows = []
    for _ in range(500):
        t = [r.choice(("news", "spam", "mixed", f"s{r.randrange(40)}", "<n>")) for _ in range(r.choice((0, 1, 2, 2, 3)))]
        y = r.choice((None, 1 if t[:1] == ["spam"] else 0 if t[:1] == ["news"] else r.randrange(2)))
        rows.append((r.choice(("a.x.com", "b.x.com", "c.x.com", "y.org", "z.y.org", "", "lone")), t, y))
    got = urls.template_tree(spark.createDataFrame(rows, "host string, template array<string>, label int"), p).collect()
    want = slow_tree(rows, p)
    assert {(x["host"], tuple(x["template"])): (x["leaf"], pytest.approx(x["purity"]), x["support"], x["judged"]) for x in got} == want and len(got) == len(want)
    assert any("*" in v[0] for v in want.values())


def test_template_tree_learns_labels(spark):
    """Many spam pages under different names, good ones, mixed ones; branches without labels, with and without their like elsewhere."""
    rows = [("h", ["spam", f"s{k}", "<n>"], 1) for k in range(60)] + [("h", ["news", "<n>"], 0)] * 30 + [("h", ["mixed", "<n>"], k % 2) for k in range(20)] + [("h", ["fresh", "<n>"], None)]
    rows += [(f"o{k}", ["casino", "<n>"], 1) for k in range(20)] + [("h", ["casino", "<n>"], None), ("new", ["casino", "<n>"], None)]
    d = spark.createDataFrame(rows, "host string, template array<string>, label int")
    t = {(r["host"], *r["template"]): r for r in urls.template_tree(d).collect()}
    assert all(t["h", "spam", f"s{k}", "<n>"]["purity"] > 0.9 and t["h", "spam", f"s{k}", "<n>"]["support"] >= 3 for k in range(60))
    assert t["h", "news", "<n>"]["purity"] < 0.1 and 0.3 < t["h", "mixed", "<n>"]["purity"] < 0.7 and t["h", "fresh", "<n>"]["support"] == 0
    assert t["h", "fresh", "<n>"]["purity"] < 0.8 and all(t[h, "casino", "<n>"]["purity"] > 0.8 and t[h, "casino", "<n>"]["judged"] for h in ("h", "new"))
    assert "*" in t["h", "spam", "s1", "<n>"]["leaf"]


def test_tree_agrees_with_rules_it_has_not_seen(spark):
    """Labels of a fifth of the hosts are held back: what the tree then rejects, the rules block."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    seen = urls.judge(pages).where("rule is not null").select("page_id", "host", "path", "verdict").withColumn("template", urls.template_of(F.col("path"), 4))
    held = F.crc32("host") % 5 == 0
    label = F.when(~held, (F.col("verdict") == "block").cast("int"))
    tree = urls.template_tree(seen.select("host", "template", label.alias("label")))
    r = seen.where(held).join(tree, ["host", "template"]).groupBy((F.col("judged") & (F.col("purity") >= 0.8)).alias("reject"), "verdict").count().collect()
    n = {(x["reject"], x["verdict"]): x["count"] for x in r}
    assert n[True, "block"] > 50 and n[True, "block"] / (n[True, "block"] + n.get((True, "allow"), 0)) > 0.95
    print("held out:", n)


def test_urls_odd(spark):
    long_, same = "http://h.org/" + "x/" * 100_000, "http://a.net/p/1"
    rows = [(1, long_), (2, same), (2, same), (None, same), (3, None), (4, ""), (5, "://"), (6, "http:///only/path"), (7, "HTTP://É.NET/ä?x"), (8, "a://b://c/d")]
    d = spark.createDataFrame(rows, "page_id long, url string")
    for extra in ("host", "path", "template", "says", "leaf", "k", "seg", "scope", "node"):
        d = d.withColumn(extra, F.lit("clash"))
    got = sorted(((r["page_id"] or 0, r["host"], len(r["path"]), r["rule"], r["verdict"]) for r in urls.judge(d).collect()))
    assert got == sorted([
        (1, "h.org", 200_001, None, "allow"), (2, "a.net", 4, "net/", "block"), (2, "a.net", 4, "net/", "block"), (0, "a.net", 4, "net/", "block"), (3, "", 0, None, "allow"),
        (4, "", 0, None, "allow"), (5, "", 0, None, "allow"), (6, "", 10, None, "allow"), (7, "É.net", 2, "net/", "block"), (8, "b:", 5, None, "allow"),
    ])


# rules


def slow_counts(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen = {}
    for i in range(len(w) - 7):
        seen.setdefault(tuple(w[i : i + 8]), []).append(i)
    hit = {j for at in seen.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit)


def test_rules_are_the_contract(spark):
    d = odd_docs(spark).select("doc_id", "text", "lang", "source")
    more = [(100 + k, " ".join(["a b c d e f g h"] * n) + " #$% <x>\n" + "same\n" * n, "en", "a") for k, n in enumerate((1, 2, 3, 9))]
    d = d.union(spark.createDataFrame(more, d.schema)).union(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source").withColumn("doc_id", F.col("doc_id") + 1000))
    text = {r["doc_id"]: r["text"] for r in d.collect()}
    got = rules.judge(d).collect()
    assert len(got) == d.count()
    for r in got:
        want = slow_counts(text[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want, r["doc_id"]
        assert r["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0]) and not (r["base_failed"] and r["kept"])
    labels = {r["doc_id"] + 1000: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    good = [r["kept"] for r in got if labels.get(r["doc_id"]) == 1 and not r["base_failed"]]
    assert sum(good) / len(good) > 0.95
    assert rules.judge(none(odd_docs(spark))).count() == 0 and rules.filter_documents(odd_docs(spark)).columns == odd_docs(spark).columns


def test_fences_are_brute_force(spark):
    """Fences and verdicts from sorted shares: quartiles, two classes, ranks, empty spread, small groups, groups of nulls."""
    r, p, rows = random.Random(9), rules.RuleParams(), []
    for k in range(1500):
        lang, source = (("en", "a") if k % 3 == 0 else ("en", f"s{k % 7}") if k % 3 == 1 else (None, None))
        v = {"symbol_share": 0 if r.random() < 0.9 else r.randint(300_000, 400_000), "dup_line_share": 0 if r.random() < 0.97 else r.randint(1, 300_000), "repeat_share": 5, "upper_share": int(r.gauss(20_000, 4_000))}
        rows.append((k, lang, source, r.random() < 0.1, *v.values()))
    d = spark.createDataFrame(rows, "doc_id long, lang string, source string, base_failed boolean, " + ", ".join(f"{m} long" for m in rules.METRICS))

    def edge(v):
        drop = max(0, v.bit_length() - p.bits)
        return ((v >> drop) + 1 << drop) - 1

    def fence(values):
        v, n = sorted(map(edge, values)), len(values)
        at = lambda q: v[-(-q * n // 1000) - 1]
        if at(750) > at(250):
            return at(750) + p.spread * (at(750) - at(250))
        whole = sum(x * x for x in v) - sum(v) ** 2 / n
        cuts = [(w0 * (n - w0) / n * (sum(v[:w0]) / w0 - sum(v[w0:]) / (n - w0)) ** 2, -v[w0 - 1]) for w0 in range(1, n) if v[w0] > v[w0 - 1] and n - w0 >= p.few]
        return -max(cuts)[1] if cuts and max(cuts)[0] >= p.clear * whole else at(1000 - p.tail)

    got = {(x["f_lang"], x["f_source"]): x for x in rules.fences(d, p).collect()}
    ok = [x for x in rows if not x[3]]
    assert set(got) == {(x[1], x[2]) for x in ok}
    drawn = lambda n, f, to: (n * f + p.shrink * to) // (n + p.shrink)
    for k, m in enumerate(rules.METRICS):
        whole = fence([x[4 + k] for x in ok])
        for lang, source in got:
            of_lang, own = [x[4 + k] for x in ok if x[1] == lang], [x[4 + k] for x in ok if x[1:3] == (lang, source)]
            assert got[lang, source][f"fence_{m}"] == drawn(len(own), fence(own), drawn(len(of_lang), fence(of_lang), whole)), (m, lang, source)
        exact = sorted(x[4 + k] for x in ok)[-(-995 * len(ok) // 1000) - 1]
        assert exact <= edge(exact) <= exact * (1 + 2 ** (1 - p.bits)) + 1
    whole = {m: fence([x[4 + k] for x in ok]) for k, m in enumerate(rules.METRICS)}
    assert whole["repeat_share"] == 5 and 0 <= whole["symbol_share"] < 300_000  # the two classes, not a rank


# quality


def test_quality_learns(spark):
    sf = "/root/testdata/sf0.01"
    out = {r["doc_id"]: r for r in queries.queries()["op6_quality_crf"](spark, sf).collect()}
    y = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [k for k in y if out[k]["held_out"]]
    assert all(out[k]["held_out"] == (zlib.crc32(str(k).encode()) % 5 == 0) for k in out)
    assert sum(out[k]["predicted"] == y[k] for k in held) / len(held) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in out.values())


def test_marginals_are_exact():
    rng = np.random.default_rng(0)
    scores, trans = [rng.normal(size=n) for n in (1, 4, 3)], rng.normal(size=(2, 2))
    good, pairs, z = quality.marginals(scores, trans)
    for s, g, p, logz in zip(scores, good, pairs, z):
        total, mine, both = 0.0, np.zeros(len(s)), np.zeros((2, 2))
        for m in range(1 << len(s)):
            y = [m >> i & 1 for i in range(len(s))]
            w = np.exp(sum(a * b for a, b in zip(s, y)) + sum(trans[a, b] for a, b in zip(y, y[1:])))
            total += w
            mine += w * np.array(y)
            for a, b in zip(y, y[1:]):
                both[a, b] += w
        assert np.allclose(g, mine / total) and np.allclose(p, both / total) and np.isclose(logz, np.log(total))


def test_quality_odd(spark):
    d = odd_docs(spark)
    labels = spark.createDataFrame([(4, 1, 0), (7, 0, 0), (7, 1, 0), (None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    for l in (labels, none(labels)):
        out = quality.scored(d, quality.fit(d, l)).collect()
        assert len(out) == 11 and all(0 <= r["score"] <= 1 for r in out)
    assert quality.scored(none(d), quality.fit(none(d), labels)).count() == 0


# line dedup


def cut(text):
    return re.split(r"(?<=\n)|(?<=[.!?] )", text)


def test_units_are_the_cuts():
    for t in ("", "a", "a. b! c? d.\ne\n\nf. ", "x\0y. z", ". . \n"):
        assert [u.decode() for u in linededup.units_of(t.encode())] == cut(t)


def slow_line_dedup(docs, min_words):
    """Deleted unit places by comparing every run with every earlier one."""
    units = {k: [(u.strip(), len(u.split())) for u in cut(t) if u.split()] for k, t in docs.items()}
    first, gone = {}, {k: set() for k in docs}
    for k in sorted(units):
        for i in range(len(units[k])):
            for j in range(i + 1, len(units[k]) + 1):
                run = units[k][i:j]
                if sum(w for _, w in run) >= min_words:
                    key = tuple(u for u, _ in run)
                    if key in first and first[key] != (k, i):
                        gone[k].update(range(i, j))
                    first.setdefault(key, (k, i))
    return gone


def test_line_dedup_is_brute_force(spark):
    r = random.Random(2)
    bits = [" ".join(r.choice(VOCAB) for _ in range(r.choice((1, 3, 8, 15)))).capitalize() + "." for _ in range(30)]
    docs = {k: r.choice((" ", "\n")).join(r.choice(bits) for _ in range(r.randint(0, 14))) for k in range(40)}
    docs.update({50: docs[3], 51: docs[3] + "\n" + docs[4]})
    d = spark.createDataFrame([(k, t, "en", "a", len(t)) for k, t in docs.items()], DOCS)
    got = {x["doc_id"]: x for x in linededup.dedup(d, linededup.LineDedupParams(min_words=20)).collect()}
    want = slow_line_dedup(docs, 20)
    assert {k: x["n_deleted"] for k, x in got.items()} == {k: len(v) for k, v in want.items()} and any(want.values())
    for k, x in got.items():
        left = [u.strip() for u in cut(docs[k]) if u.split()]
        assert [u.strip() for u in cut(x["text"]) if u.split()] == [u for i, u in enumerate(left) if i not in want[k]]
        assert want[k] or x["text"] == docs[k]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_intervals_across_partitions(spark, seed):
    """The sort of a round, with more partitions than some intervals are long and fewer than others: first copies, later
    ones, ranks in the order of the keys, rows alone left out, one document twice."""
    r = random.Random(seed)
    keys = [(r.randrange(-3, 4), r.choice((0, 0, 0, 7)), r.choice((1, 2))) for _ in range(60)] + [(5, 5, 2)] * 200 + [(900 + k, 0, 2) for k in range(5)]
    rows = [(a, b, m, r.randrange(30), r.randrange(2), k, r.choice((0, 1 << m, 6)), r.choice((0, 2, 4, 6)) if m == 2 else 0) for k, (a, b, m) in enumerate(keys)]
    table_ = rows + rows[:20]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", (3, 17, 60)[seed - 1])
    try:
        later, longer, ends = linededup.ranked(spark.createDataFrame(table_, linededup.ROWS), "test-ranks")
        later, longer = later.collect(), longer.collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    groups = {}
    for x in sorted(rows, key=lambda x: (*x[:3], *x[3:6])):
        groups.setdefault(x[:3], []).append(x)
    want = sorted((x[3], x[4], x[5], k[2]) for k, g in groups.items() for x in g[1:] if x[6] >> k[2] & 1)
    assert sorted((x["doc_id"], x["th"], x["pos"], x["m"]) for x in later) == want and want
    rank = {x["pos"]: int(ends.rank(np.array([x["part"]]), np.array([x["start"]]))[0]) for x in longer}
    assert set(rank) == {x[5] for k, g in groups.items() if len(g) > 1 for x in g if x[7] & 2}
    by_key = {}
    for pos, value in rank.items():
        by_key.setdefault(keys[pos], set()).add(value)
    assert all(len(v) == 1 for v in by_key.values()) and [by_key[k] for k in sorted(by_key)] == sorted(by_key.values(), key=min)
    assert len({min(v) for v in by_key.values()}) == len(by_key)


@pytest.mark.parametrize("seed,words", [(4, 16), (5, 3), (6, 40)])
def test_line_dedup_of_long_runs_is_brute_force(spark, seed, words):
    """Few different units, long repeats, overlaps with oneself, many partitions; runs of up to `words` units."""
    r = random.Random(seed)
    bits = ["a.", "b b.", "c c c.", " ".join(VOCAB[:7]) + ".", " ".join(VOCAB[9:30]) + "."]
    shared = [r.choice(bits) for _ in range(30)]
    docs = {k: " ".join([r.choice(bits) for _ in range(r.randint(0, 12))] + shared[r.randrange(10) : r.randint(10, 30)] + [r.choice(bits) for _ in range(r.randint(0, 5))]) for k in range(14)}
    docs[20] = " ".join(["a."] * 60)
    d = spark.createDataFrame([(k, t, "en", "a", len(t)) for k, t in docs.items()], DOCS)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 13)
    try:
        got = {x["doc_id"]: x["n_deleted"] for x in linededup.dedup(d, linededup.LineDedupParams(min_words=words)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == {k: len(v) for k, v in slow_line_dedup(docs, words).items()} and any(got.values())


def test_minimal_runs_are_told_apart():
    """Runs of each document, and the ranks that their names are made of: those of one level are enough for the level below."""
    r = random.Random(13)
    for _ in range(60):
        docs = [[r.choice((1, 1, 2, 5, 20)) for _ in range(r.randint(0, 14))] for _ in range(3)]
        least, runs, at = r.choice((1, 4, 16)), set(), 0
        for w in docs:
            for i in range(len(w)):
                fwd = next((j for j in range(i + 1, len(w) + 1) if sum(w[i:j]) >= least), None)
                bwd = next((s for s in range(i, -1, -1) if sum(w[s : i + 1]) >= least), None)
                runs |= {(at + i, fwd - i)} if fwd else set()
                runs |= {(at + bwd, i + 1 - bwd)} if bwd is not None else set()
            at += len(w)
        bits, need = linededup.wanted(np.array(sum(docs, []), np.int64), np.repeat(np.arange(3), list(map(len, docs))), least)
        assert {(i, m) for i in range(at) for m in range(1, 63) if int(bits[i]) >> m & 1} == runs
        want = {k: set() for k in range(1, 8)}
        for k in range(6, linededup.FIRST.bit_length() - 2, -1):  # up to FIRST units names are hashes
            for s, m in runs:
                want[k] |= {s, s + m - (1 << k)} if 1 << k < m <= 2 << k else set()
            want[k] |= want[k + 1] | {j + (1 << k) for j in want[k + 1]}
        assert {k: {i for i in range(at) if int(need[i]) >> k & 1} for k in range(1, 7)} == {k: want[k] for k in range(1, 7)}


def test_pasted_passage_goes_from_later_documents(spark):
    passage = prose(68, 77)
    docs = [(k, prose(40, 200 + k) + "\n" + prose(30, 300 + k).rstrip(".") + " " + passage + " and so on. " + prose(20, 400 + k), "en", "a", 0) for k in range(6)]
    got = {x["doc_id"]: x for x in linededup.dedup(spark.createDataFrame(docs, DOCS)).collect()}
    assert passage in got[0]["text"] and all(passage not in got[k]["text"] and prose(40, 200 + k) in got[k]["text"] for k in range(1, 6))


def test_line_dedup_odd(spark):
    d = odd_docs(spark)
    out = linededup.dedup(d)
    assert out.columns == [*d.columns, "n_deleted", "words_deleted"] and out.count() == 11
    rows = {r["doc_id"]: r for r in out.collect()}
    assert rows[1]["text"] is None and rows[2]["text"] == "" and rows[5]["text"] == prose(60, 1) and rows[6]["text"] == ""
    assert linededup.dedup(none(d)).count() == 0 and linededup.dedup_stage(spark, d, SF).columns == d.columns


# decontamination


def slow_align(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1), int)
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (2 if x == y else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
    return h.max() / (2 * len(a))


def test_alignment_is_smith_waterman():
    r = random.Random(4)
    for _ in range(30):
        a, b = ([r.randrange(5) for _ in range(r.randint(1, 12))] for _ in range(2))
        got, s, e = decontaminate.align(np.array(a, np.uint64), np.array(b, np.uint64), decontaminate.DecontaminationParams())
        assert got == pytest.approx(slow_align(a, b))
        if got:
            assert slow_align(a, b[s:e]) == pytest.approx(got)


def test_decontamination_finds_edited_copies(spark):
    items = [(k, prose(30, 900 + k)) for k in range(20)] + [(50, "only three words"), (51, None), (52, ""), (3, prose(30, 903))]
    b = spark.createDataFrame(items, "item_id long, text string").withColumn("df", F.lit("clash"))
    r, docs = random.Random(6), []
    for k in range(20):
        w = dict(items)[k].split(" ")
        for _ in range(3):
            w[r.randrange(len(w))] = "edited"
        docs += [(k, prose(50, k) + " " + " ".join(w).upper() + " " + prose(50, 60 + k), "en", "a", 0), (100 + k, prose(120, 500 + k), "en", "a", 0)]
    d = spark.createDataFrame(docs, DOCS)
    for p in (decontaminate.DecontaminationParams(), decontaminate.DecontaminationParams(block=200)):
        got = {(x["doc_id"], x["item_id"]) for x in decontaminate.contaminated(d, b, p).collect()}
        assert got == {(k, k) for k in range(20)}
    odd = odd_docs(spark)
    assert decontaminate.contaminated(odd, b).count() == 0 and decontaminate.contaminated(none(odd), b).count() == 0
    assert decontaminate.contaminated(odd, none(b)).count() == 0
    hit = odd.withColumn("text", F.lit("so only Three, words.")).where("doc_id = 5 or doc_id is null")
    assert decontaminate.contaminated(hit, b).count() == 3


def test_common_seeds_find_edited_copies(spark):
    """Copies whose only intact n-grams are the item's common ones, with a small `rare`, against brute force."""
    p, items = decontaminate.DecontaminationParams(rare=1), {k: prose(20, 5000 + k).split(" ")[:20] for k in range(3)}
    items[3] = items[0][:11] + prose(9, 5100).split(" ")[:9]
    docs = {}
    for k in range(12):
        w = items[k % 3]
        docs[k] = prose(30, 5200 + k) + " " + " ".join([*w[:11], "edited", *w[12:14], "and", "other"]) + " " + prose(30, 5300 + k)
        docs[100 + k] = prose(30, 5400 + k) + " " + " ".join(w[:11]) + " " + prose(30, 5500 + k)
    want = set()
    for d, t in docs.items():
        w = decontaminate.normal(t)
        for i, x in items.items():
            x = decontaminate.normal(" ".join(x))
            shared = {tuple(x[j : j + 4]) for j in range(len(x) - 3)} & {tuple(w[j : j + 4]) for j in range(len(w) - 3)}
            if shared and slow_align(x, w) >= p.score:
                want.add((d, i))
    assert {(k, k % 3) for k in range(12)} <= want
    b = spark.createDataFrame([(k, " ".join(x)) for k, x in items.items()], "item_id long, text string")
    d = spark.createDataFrame([(k, t, "en", "a", 0) for k, t in docs.items()], DOCS)
    assert {(x["doc_id"], x["item_id"]) for x in decontaminate.contaminated(d, b, p).collect()} == want


def test_word_hashes_are_by_word():
    words = [w.encode() for w in VOCAB[:500]] * 2
    h = decontaminate.word_hashes(b" ".join(words))
    assert len(set(h.tolist())) == len(set(words)) and (h[:500] == h[500:]).all()


# packing


def test_packing_is_a_partition(spark):
    from tokenizers import Tokenizer

    p = packing.default_params()
    t = Tokenizer.from_file(p.tokenizer)
    d = odd_docs(spark).unionByName(spark.read.parquet(f"{SF}/documents.parquet").withColumn("doc_id", F.col("doc_id") + 1000), allowMissingColumns=True)
    ids = {r["doc_id"]: t.encode(r["text"] or "", add_special_tokens=False).ids + [0] for r in d.collect()}
    rows = packing.pack(d, p).collect()
    by, bins = {}, {}
    for r in rows:
        by.setdefault(r["doc_id"], {})[r["piece"]] = r
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for k, v in ids.items():
        for j, s in enumerate(range(0, len(v), 2048)):
            r, part = by[k][j], np.array(v[s : s + 2048], "<u4")
            assert (r["start"], r["length"], r["ids_crc32"]) == (s, len(part), zlib.crc32(part.tobytes()))
        assert len(by[k]) == -(-len(v) // 2048)
    for parts in bins.values():
        at = 0
        for off, n in sorted(parts):
            assert off == at
            at += n
        assert at <= 2048
    assert len(bins) <= 1.02 * (sum(r["length"] for r in rows) / 2048) + 1
    assert packing.pack(none(d), p).count() == 0


def test_chunks_give_the_tokenizers_ids():
    """Letters whose normal form is another kind of character, marks that compose with one case only, marks after words."""
    enc, r = packing.Encoder(packing.default_params().tokenizer), random.Random(11)
    plain = [chr(c) for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    odd = [c for c in plain if unicodedata.normalize("NFC", c).lower() != c.lower() or len(c.lower()) > 1]
    marks, near = [chr(c) for c in range(0x300, 0x370)], list("abcJHTWYIis'.,-!?;:)=<>|(2 \n\t\x0b\x1c\x85\xa0 ")
    texts = [f"a{c}. {c}-2 {c}! x{c}y" for c in [*odd, *r.sample(plain, 4000)]] + ["", ".", " . ", "é. İ. J\u030c. J\u030c, 3. a. \nb,\tc;"]
    texts += ["".join(r.choice(r.choice((odd, marks, near, near, near, plain))) for _ in range(r.randint(1, 9))) for _ in range(15_000)]
    for at in range(0, len(texts), 500):
        part = texts[at : at + 500]
        want = [x.ids for x in enc.tokenizer.encode_batch(part, add_special_tokens=False)]
        assert [x.tolist() for x in enc.batch([t.encode() for t in part])] == want


def test_chunks_of_texts_longer_than_a_block(monkeypatch):
    """Blocks end at white space; a chunk longer than a block is one all the same; what is forgotten is learnt again."""
    monkeypatch.setattr(packing, "BLOCK", 64)
    monkeypatch.setattr(packing, "CACHE", 40)
    enc = packing.Encoder(packing.default_params().tokenizer)
    texts = [prose(200, 51), "x" * 500 + " y", " " * 300, "a" * 100 + "\n" + "b. " * 90, "É" * 90 + ".", "", "z.", "<|endoftext|> end", "tab\tonly\t" * 40, "w" * 63 + " v", "w" * 64 + " v"] * 3
    want = [x.ids for x in enc.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in enc.batch(texts and [t.encode() for t in texts])] == want
    assert [y.tolist() for a, b in packing.together([t.encode() for t in texts]) for y in enc.batch([t.encode() for t in texts[a:b]])] == want
    assert [b - a for a, b in packing.together([b"x" * 10] * 12)] == [5, 5, 2] and list(packing.together([])) == []


def test_plan_places_all():
    rng = np.random.default_rng(1)
    for n in (0, 1, 50, 20_000):
        h = np.bincount(np.minimum(2048, rng.lognormal(5, 1.2, n).astype(int) + 1), minlength=2049)
        made, total = packing.plan(h, packing.PackParams(""))
        used = np.zeros(2049, int)
        for parts, k in made:
            assert sum(parts) <= 2048
            for v in parts:
                used[v] += k
        assert (used == h).all() and total <= 1.01 * (h * np.arange(2049)).sum() / 2048 + 2


# html


PAGE = """<html><head><title>T</title><script>var a="<p>no</p>";</script></head><body class="page has-sidebar"><header><h1>Site</h1></header><nav><a href=x>menu</a></nav>
<div id="main"><article class="post-12"><header><h1>Head &amp; line</h1></header><div class="ad"><p>Buy now</p></div><p>First   <b>para</b>graph
of text that is long enough &lt;here&gt;.<p>Second one, &#233;&eacute; with <a href=y>a link</a> in it.<br>Next.</p><form><p>Mail</p></form>
<aside>Side</aside><section class="comments"><p>Nice, said a reader.</p></section></article></div><div class="cookie-notice">We use cookies</div><!-- <p>no</p> --><footer>&copy; all</footer></body></html>"""
WANT = "Head & line\nFirst paragraph of text that is long enough <here>.\nSecond one, éé with a link in it. Next."


def test_html(spark):
    rows = [(k, f"http://h/{k}", PAGE) for k in range(3)] + [(3, None, None), (4, "http://h/4", ""), (5, "http://g/", "plain words &am"), (6, "http://g/", "<div><p>broken <b>markup<p>here</div>"), (0, "http://h/0", PAGE)]
    d = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("path", F.lit(1)).withColumn("host", F.lit(1))
    got = [(r["page_id"], r["text"]) for r in html.main_text(d).collect()]
    assert sorted(got) == sorted([(0, WANT), (0, WANT), (1, WANT), (2, WANT), (3, ""), (4, ""), (5, "plain words &am"), (6, "broken markup\nhere")])
    assert html.main_text(none(d)).count() == 0


def test_html_consensus_wins(spark):
    page = lambda n, m: f"<body><div class='story'><p>{prose(n, 1)}</p></div><div class='more'><p>{prose(m, 2)}</p></div></body>"
    d = spark.createDataFrame([(k, "http://h/", page(300, 20)) for k in range(5)] + [(9, "http://h/", page(20, 300))], "page_id long, url string, html string")
    assert {r["page_id"]: r["text"] for r in html.main_text(d).collect()}[9] == prose(20, 1)


# warc


def test_warc_round_trip(spark, tmp_path):
    rows = [(3, "u3", "same"), (1, "u1\r\nx", "same"), (2, None, "other é"), (7, "u", None), (5, "u", ""), (2, None, "other é"), (None, "n", "same"), (9, "z", "long " * 200_000)]
    d = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("sha", F.lit(1)).withColumn("first", F.lit(1))
    got = sorted(((r["page_id"] if r["page_id"] is not None else -1, r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.round_trip(d).collect()), key=str)
    sha = lambda s: base64.b32encode(hashlib.sha1(s.encode()).digest()).decode()
    want = [
        (3, 4, sha("same"), "revisit", 1), (1, 4, sha("same"), "response", None), (2, 8, sha("other é"), "response", None), (2, 8, sha("other é"), "response", None), (7, 0, sha(""), "revisit", 5),
        (5, 0, sha(""), "response", None), (-1, 4, sha("same"), "revisit", 1), (9, 1_000_000, sha("long " * 200_000), "response", None),
    ]
    assert got == sorted(want, key=str)
    assert warc.round_trip(none(d)).count() == 0


def test_normaliser_splits_any_gzip(tmp_path):
    p = warc.WarcParams()
    recs = [warc.record(k, f"u{k}", os.urandom(k * 1000), warc.digest(b""), None, p) for k in range(6)]
    a, b = tmp_path / "a.warc.gz", tmp_path / "b.warc.gz"
    a.write_bytes(gzip.compress(b"".join(recs[:4])) + gzip.compress(b"".join(recs[4:])))
    index = warc.normalise(str(a), str(b))
    raw = b.read_bytes()
    assert [gzip.decompress(raw[x["offset"] : x["offset"] + x["length"]]) for x in index] == recs
    assert [json.loads(x) for x in (tmp_path / "b.warc.gz.idx").read_text().splitlines()] == index
    (tmp_path / "c.gz").write_bytes(a.read_bytes()[:-20])
    with pytest.raises(ValueError):
        warc.normalise(str(tmp_path / "c.gz"), str(tmp_path / "d.gz"))
    assert not (tmp_path / "d.gz").exists()


# all


def test_pipeline(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 0 and [n for n, _ in corpus_pipeline.STAGES][0] == "quality classifier"
    docs = odd_docs(spark)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == odd_docs(spark).columns
    assert corpus_pipeline.STAGES[-1][1](spark, none(odd_docs(spark)), SF).count() == 0


def test_queries_match_sql(spark):
    import duckdb

    con = duckdb.connect()
    for t in ("pages", "documents"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    for name, sql in queries.oracle_sql().items():
        a, b = queries.queries()[name](spark, SF).toPandas(), con.execute(sql).df()
        cols = sorted(a.columns)
        rows = lambda d: sorted(map(repr, d[cols].astype(object).where(d[cols].notna(), None).values.tolist()))  # noqa: B023, E731
        assert cols == sorted(b.columns) and rows(a) == rows(b)


def test_pipeline_is_brute_force(spark, monkeypatch, tmp_path):
    """run() on a fixture (short documents of the smallest tables, and planted cases) against each stage done plainly on its own input."""
    base = spark.read.parquet(f"{SF}/documents.parquet").where("length(text) < 2500").collect()
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    top = max(r["doc_id"] for r in base) + 1
    passage, near = prose(68, 4321), prose(300, 4322)
    extra = [prose(40, 80 + k) + " " + passage + " " + prose(40, 90 + k) for k in range(3)] + [near, near.replace(near.split(" ")[100], "changed"), prose(40, 70) + " " + items[0][1] + ". " + prose(40, 71)]
    rows = [tuple(r) for r in base] + [(top + k, t, "en", "planted", len(t)) for k, t in enumerate(extra)]
    names = ["doc_id", "text", "lang", "source", "n_chars"]
    spark.createDataFrame([dict(zip(base[0].__fields__, r)) for r in rows], DOCS).select(*names).write.parquet(str(tmp_path / "documents.parquet"))
    for t in ("labels", "benchmark"):
        os.symlink(f"{SF}/{t}.parquet", tmp_path / f"{t}.parquet")
    sf, seen = str(tmp_path), [("documents", spark.read.parquet(str(tmp_path / "documents.parquet")).collect())]
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    field = quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    real = corpus_pipeline.materialise
    monkeypatch.setattr(corpus_pipeline, "materialise", lambda df, name: (out := real(df, name), seen.append((name, out.collect())))[0])
    packed = corpus_pipeline.run(spark, sf).collect()
    tables = [{r["doc_id"]: r["text"] or "" for r in x} for _, x in seen[:5]]

    good = {d for d, t in tables[0].items() if field.score([quality.line_features(t)])[0] >= 0.3}
    assert set(tables[1]) == good and all(tables[1][d] == tables[0][d] for d in good) and set(range(top, top + 6)) <= good

    gone = slow_line_dedup(tables[1], linededup.LineDedupParams().min_words)
    units = {d: [u.strip() for u in cut(t) if u.split()] for d, t in tables[1].items()}
    left = {d: [u for i, u in enumerate(us) if i not in gone[d]] for d, us in units.items()}
    count = lambda us: sum(len(u.split()) for u in us)
    assert {d: [u.strip() for u in cut(t) if u.split()] for d, t in tables[2].items()} == {d: us for d, us in left.items() if not gone[d] or 5 * count(us) >= count(units[d])}
    assert passage in tables[2][top] and passage not in tables[2][top + 1] and passage not in tables[2][top + 2]

    texts = tables[2]
    ids = sorted(texts)
    words5 = {d: set(simhash.shingles(t, 5).tolist()) for d, t in texts.items()}
    linked = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if len(words5[a] & words5[b]) >= 0.8 * len(words5[a] | words5[b]) and (words5[a] or not words5[b])]
    group = reach(ids, linked)
    assert set(tables[3]) == {d for d in ids if group[d] == d}

    q, dirty = decontaminate.DecontaminationParams(), set()
    hashed = [w for _, t in items if len(w := decontaminate.word_hashes(b" ".join(decontaminate.normal(t))))]
    for d, t in tables[3].items():
        w = decontaminate.word_hashes(b" ".join(decontaminate.normal(t)))
        grams = [set(decontaminate.gram_hashes(w, min(q.n, len(h))).tolist()) for h in hashed]
        if any(g & set(decontaminate.gram_hashes(h, min(q.n, len(h))).tolist()) and decontaminate.align(h, w, q)[0] >= q.score for g, h in zip(grams, hashed)):
            dirty.add(d)
    assert set(tables[4]) == set(tables[3]) - dirty and top + 5 in dirty

    from tokenizers import Tokenizer

    tokenizer, want = Tokenizer.from_file(packing.default_params().tokenizer), set()
    for d, t in tables[4].items():
        i = np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 0], "<u4")
        want |= {(d, k, s, len(i[s : s + 2048]), zlib.crc32(i[s : s + 2048].tobytes())) for k, s in enumerate(range(0, len(i), 2048))}
    assert {(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in packed} == want and len(packed) == len(want)
    ends = {}
    for r in sorted(packed, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends.get(r["sequence_id"], 0)
        ends[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(ends.values()) <= 2048
