import collections
import random
import re

import xxhash

from veridra.llm import graph, linededup, simhash


def brute_print(text):
    words = [w for w in re.split(rb"[\x20\x09-\x0d]+", (text or "").encode().lower()) if w]
    if not words:
        return 0
    each = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(len(words) - 2)] or [xxhash.xxh64_intdigest(b" ".join(words), 42)]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in each) > len(each))


def roots(nodes, edges):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {n: find(n) for n in nodes}


def test_fingerprints():
    rnd = random.Random(1)
    for n in [0, 1, 2, 3, 4, 5, 50, 255, 256, 258, 700]:
        text = " ".join(rnd.choice(["Ab", "c", "dé", "e\x0bf"]) + str(rnd.randrange(9)) for _ in range(n))
        assert simhash.fingerprint(text) == brute_print(text)


def near(rnd, n):
    base = [rnd.getrandbits(64) for _ in range(n // 8)]
    out = []
    for _ in range(n):
        x = rnd.choice(base)
        for _ in range(rnd.randrange(4)):
            x ^= 1 << rnd.randrange(64)
        out.append(x - (1 << 64) if x >> 63 else x)
    return out


def test_components_equal_brute_force(spark):
    rnd = random.Random(2)
    prints = near(rnd, 160)
    df = spark.createDataFrame(list(enumerate(prints)), "doc_id long, fp long")
    edges = [(a, b) for a in range(160) for b in range(a) if bin((prints[a] ^ prints[b]) & (2**64 - 1)).count("1") <= 2]
    want = roots(range(160), edges)
    for hot in (64, 2):  # pairs under keys, and midpoints for all larger groups
        got = {r.doc_id: r.component_id for r in simhash.classes(df, hot).collect()}
        assert got == want


def test_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 100), (None, 3)], "a long, b long")
    got = {r.node: r.root for r in graph.components(edges).collect()}
    assert got == {i: 0 for i in range(61)}
    assert graph.components(edges.limit(0)).count() == 0


def test_edge_rows(spark):
    text = "one two three four five six seven eight nine ten"
    rows = [(5, text), (3, text), (3, text), (None, text), (7, None), (8, " \n"), (9, "other words here entirely"), (9, "unlike anything else again")]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, fp int")
    got = simhash.near_duplicates(df).collect()
    assert len(got) == len(rows)
    assert {(r.doc_id, r.component_id) for r in got} >= {(5, 3), (3, 3), (None, 3), (7, 7), (8, 7), (9, 9)}
    kept = simhash.dedup(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id is None, r.doc_id) for r in kept.collect()) == [(False, 3), (False, 7), (False, 9), (False, 9), (True, None)]
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_dedup_takes_edited_copies(spark):
    pick, texts, pairs = random.Random(11), [], []
    for size, edits in ((100, 1), (200, 1), (200, 3), (400, 5), (1000, 10)):
        for _ in range(40):
            x = [f"w{pick.randrange(5000)}" for _ in range(size)]
            y = list(x)
            for i in pick.sample(range(size), edits):
                y[i] = "edited"
            sets = [{tuple(t[i : i + 5]) for i in range(size - 4)} for t in (x, y)]
            assert len(sets[0] & sets[1]) >= 0.8 * len(sets[0] | sets[1])
            pairs.append((len(texts), len(texts) + 1, (size, edits)))
            texts += [" ".join(x), " ".join(y)]
    far = [f"w{pick.randrange(5000)}" for _ in range(100)]
    texts += [" ".join(far), " ".join("edited" if k % 12 == 0 else w for k, w in enumerate(far))]  # below 0.8: both stay
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for hot in (32, 1):
        kept = {r.doc_id for r in simhash.dedup(df, hot).collect()}
        print("gone", collections.Counter(n for a, b, n in pairs if b not in kept))
        assert all(a in kept for a, *_ in pairs) and sum(b not in kept for _, b, _ in pairs) >= 0.98 * len(pairs)
        assert {len(texts) - 2, len(texts) - 1} <= kept


def test_dedup_links_by_fingerprints(spark, monkeypatch):
    """Without the bands of the second turn, near copies within two bits go and only those."""
    pick, texts, near = random.Random(4), [], {}
    for _ in range(20):
        x = [f"w{pick.randrange(5000)}" for _ in range(600)]
        y = list(x)
        for i in pick.sample(range(600), 2):
            y[i] = "edited"
        near[len(texts) + 1] = bin(brute_print(" ".join(x)) ^ brute_print(" ".join(y))).count("1") <= 2
        texts += [" ".join(x), " ".join(y)]
    grouped = linededup.grouped
    monkeypatch.setattr(linededup, "grouped", lambda signs, hot: tuple(part.limit(0) for part in grouped(signs, hot)))
    kept = {r.doc_id for r in simhash.dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert 3 < sum(near.values()) < 20 and {k: k not in kept for k in near} == near
