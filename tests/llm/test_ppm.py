import collections
import math
import re
import zlib

from veridra.llm import ppm

TEXTS = ["the cat sat on the mat", "the cat ate", None, "", "é漢 the the", "a\x0bb\x1cc A a", "the cat sat on the mat", "zzz " * 3000]


def brute_scores(rows, held):
    """log10 of each text's probability, symbol by symbol with sets of excluded symbols."""
    counts = [collections.defaultdict(collections.Counter) for _ in range(ppm.ORDER + 1)]
    gap = bytes(ppm.ORDER)
    for i, t in rows:
        b = gap + (t or "").encode() + b"\0"
        for at in range(ppm.ORDER, len(b)) if not held(i) else ():
            for k in range(ppm.ORDER + 1):
                counts[k][b[at - k : at]][b[at]] += 1
    used = len(counts[0][b""])

    def chance(history, symbol):
        out, seen = 1.0, set()
        for k in range(ppm.ORDER, -1, -1):
            own = {s: c for s, c in counts[k][history[len(history) - k :]].items() if s not in seen}
            if own:
                all_ = sum(own.values()) + len(own)
                if symbol in own:
                    return out * own[symbol] / all_
                out *= len(own) / all_
                seen |= set(own)
        return out / max(256 - used, 1)

    if any(counts[0].values()):
        assert abs(sum(chance(b"a the", c) for c in range(256)) - 1) < 1e-9
    bytes_of = lambda t: gap + (t or "").encode() + b"\0"
    return [(i, sum(math.log10(chance(b[:at], b[at])) for b in [bytes_of(t)] for at in range(ppm.ORDER, len(b)))) for i, t in rows]


def test_scores_equal_brute_force(spark):
    rows = [(k, t) for k, t in enumerate(TEXTS + ["the dog sat", "qué the cat", "tha cot", "x\0y", "the cat " * 40, "mat on the mat é"] * 3)] + [(0, TEXTS[0]), (None, "the end")]
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for kept, hot, group in ((rows, 1 << 21, 1), (rows, 50, 200_000), ([r for r in rows if held(r[0])], 50, 1)):
        want = collections.Counter((i, round(x, 4)) for i, x in brute_scores(kept, held))
        limit, ppm.GROUP = ppm.GROUP, group
        try:
            got = ppm.score(df if kept is rows else df.where(ppm.held_out(df.doc_id)), hot).collect()
        finally:
            ppm.GROUP = limit
        assert collections.Counter((r.doc_id, round(r.score, 4)) for r in got) == want and any(map(held, (r[0] for r in rows)))


def test_base_equals_brute_force(spark):
    rows = [(k, t) for k, t in enumerate(TEXTS)] + [(0, TEXTS[0]), (None, "the end")]
    df = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, score double")
    words = lambda t: [w for w in re.split(rb"[\x20\x09-\x0d]+", (t or "").encode().lower()) if w] + [b"\n"]
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2
    seen = collections.Counter(w for i, t in rows if not held(i) for w in words(t))
    n, v = sum(seen.values()), len(seen)
    for hot in (1 << 20, 2):  # all counts broadcast, and nearly all joined
        got = ppm.score(df, hot_words=hot).collect()
        assert len(got) == len(rows)
        want = collections.Counter((i, held(i), len(words(t)), sum(seen[w] > 0 for w in words(t)), n, round(sum(math.log10((seen[w] + 1) / (n + v + 1)) for w in words(t)), 4)) for i, t in rows)
        assert collections.Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == want
    assert ppm.score(df.limit(0)).count() == 0
