"""Line dedup and decontamination against brute force, and the pipeline that ties the operators together."""

import collections
import os
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from veridra.llm import decontam, linededup

TINY = "/root/testdata/sf0.001"


def brute_removed(rows):
    """Places that go from each document, by comparing every pair of lines."""
    lines = [(d, p, x) for d, t in sorted(rows) for p, x in enumerate((t or "").split("\n")) if x.strip(" \t\n\x0b\x0c\r")]
    texts = list(dict.fromkeys(x for *_, x in lines))
    sets = [frozenset(x[i : i + 5] for i in range(len(x) - 4)) or frozenset([x]) for x in texts]
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common >= 0.8 * (len(sets[i]) + len(sets[j]) - common):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    number, best, out = {x: i for i, x in enumerate(texts)}, {}, collections.defaultdict(list)
    for d, p, x in lines:
        best.setdefault(find(number[x]), (d, p))
        if best[find(number[x])] != (d, p):
            out[d].append(p)
    return out


def test_lines_equal_brute_force(spark):
    docs = spark.read.parquet(f"{TINY}/documents.parquet")
    want = brute_removed([(r.doc_id, r.text) for r in docs.collect()])
    for r in linededup.report(docs).collect():
        assert r.removed == ",".join(map(str, want[r.doc_id]))


def test_lines_edge_cases(spark):
    long = " ".join(f"word{k}" for k in range(300))
    rows = [(2, "a\nb\na"), (1, "b\n\n \nc"), (3, None), (4, ""), (5, long), (6, long + " more"), (7, long.replace("word7 ", "wort7 ")), (None, "c\nz"), (8, "hé")]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, pos int")
    for hot in (32, 1):  # pairs, and stars for every larger key
        out = {r.doc_id: r for r in linededup.dedup(df, hot).collect()}
        assert len(out) == len(rows) and list(out[1].asDict()) == df.columns
        assert {i: r.text for i, r in out.items()} == {2: "a", 1: "b\n\n \nc", 3: None, 4: "", 5: long, 6: "", 7: "", None: "z", 8: "hé"}
    assert linededup.report(df.limit(0)).count() == 0


def test_similar_equals_brute_force(spark):
    pick, rows = random.Random(1), [(" ".join(map(str, range(2000))), "x " + " ".join(map(str, range(2000))))]
    letters = ["a", "b", " ", "é", "中", "\t", "\U0001f600", "\r", "cd "]
    for _ in range(1500):
        x = [pick.choice(letters) for _ in range(pick.choice([1, 2, 4, 6, 9, 20, 60, 200]))]
        y = list(x)
        for _ in range(pick.randint(0, 6)):
            i = pick.randrange(len(y) + 1)
            y[i : i + pick.randint(0, 1)] = [pick.choice(letters)] * pick.randint(0, 2)
        if x != y and "".join(x).strip() and "".join(y).strip():
            rows.append(("".join(x), "".join(y)))
    sets = [[{t[i : i + 5] for i in range(len(t) - 4)} or {t} for t in pair] for pair in rows]
    df = spark.createDataFrame([(k, *pair) for k, pair in enumerate(rows)], "k long, x string, y string")
    got = df.select("k", linededup.similar(*(F.array_distinct(linededup.shingles(F.col(c))) for c in "xy"), 0.8).alias("like"), F.size(F.array_distinct(linededup.shingles(F.col("x")))).alias("n")).collect()
    assert len(got) == len(rows) and sum(r.like for r in got) > 100
    for r in got:
        s, t = sets[r.k]
        same = rows[r.k][0] == rows[r.k][1] or len(s & t) >= 0.8 * len(s | t)
        assert r.n == len(s) and (r.like == same or rows[r.k][0] == rows[r.k][1])


def shingled(x):
    return frozenset(x[i : i + 5] for i in range(len(x) - 4)) or frozenset([x])


def jaccard(x, y):
    return len(shingled(x) & shingled(y)) / len(shingled(x) | shingled(y))


def test_recall_by_line_length(spark):
    """Pairs at 0.8 to 0.85, or as near to it as an edit of a short line gets, share a key."""
    pick, pairs = random.Random(5), [("short", "http://www.example.com/catalogue/items/2024/overview.html", "https://www.example.com/catalogue/items/2024/overview.html")]
    word = lambda n: "".join(pick.choices("abcdefghijklmnopqrstuvwxyz", k=n))
    for size in (1, 2, 3, 4, 5, 6, 8, 12, 20, 40):
        made = 0
        while made < 300:
            x = " ".join(word(pick.randint(2, 9) if size > 3 else pick.randint(8, 30)) for _ in range(size))
            y = list(x)
            for _ in range(pick.randint(1, max(1, size // 3))):
                i = pick.randrange(len(y))
                y[i : i + pick.randint(0, 1)] = [pick.choice("abcdefghijklmnopqrstuvwxyz")]
            y = "".join(y)
            if x != y and 0.8 <= jaccard(x, y) < (0.85 if size > 6 else 1):
                pairs.append((size, x, y))
                made += 1
    texts = spark.createDataFrame([(2 * k + j, t) for k, (_, *pair) in enumerate(pairs) for j, t in enumerate(pair)], "doc_id long, text string")
    keys = {r.doc_id: set(r["keys"]) for r in linededup.signed(texts).collect()}
    met = collections.Counter(n for k, (n, *_) in enumerate(pairs) if keys[2 * k] & keys[2 * k + 1])
    print("met", dict(met))
    assert met["short"] == 1 and all(met[n] >= (0.99 if n < 20 else 0.97) * 300 for n in (1, 2, 3, 4, 5, 6, 8, 12, 20, 40))


def test_links_between_lines_of_one_word(spark):
    """A thousand addresses in two spellings each, one of a thousand other tokens without spaces: all find their pair."""
    pick, texts = random.Random(3), []
    token = lambda n: "".join(pick.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=n))
    for k in range(1000):
        x = f"https://www.{token(60)}/index.html" if k % 2 else token(pick.randint(40, 90))
        at = pick.randrange(12, len(x) - 12) if k % 2 else 0
        texts += [x, x[:at] + "_" + x[at + 1 :]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    lost = [r.doc_id for r in linededup.report(df).where("n_removed = 0").collect() if r.doc_id % 2]
    assert len(lost) <= 10, [texts[i] for i in lost]


def test_hot_keys_lose_no_link(spark):
    """Lines of a few templates, all under one key: the components are those of brute force."""
    pick, texts = random.Random(9), []
    for _ in range(3):
        fixed = ["".join(pick.choices("abcdefghij", k=6)) for _ in range(11)]
        for _ in range(150):
            x = fixed[:4] + ["".join(pick.choices("klmnopqrst", k=7)) for _ in range(3)] + fixed[4:]
            texts.append(" ".join(x))
            if pick.random() < 0.4:
                x[5] = x[5][:3] + "z" + x[5][4:]
                texts.append(" ".join(x))
    pick.shuffle(texts)
    each = spark.createDataFrame([(k, t, [7]) for k, t in enumerate(texts)], "id long, line string, keys array<long>")
    root = {r.node: r.root for r in linededup.linked(each, each).collect()}
    stars = linededup.verified(linededup.candidates(each), each).count()
    want = {(i, j) for j in range(len(texts)) for i in range(j) if jaccard(texts[i], texts[j]) >= 0.8}
    print("links", len(want), "by stars", stars)
    assert len(want) > 100 > stars and all(root.get(i, i) == root.get(j, j) for i, j in want)
    parent = list(range(len(texts)))
    for i, j in sorted(want):
        while parent[i] != i:
            i = parent[i]
        while parent[j] != j:
            j = parent[j]
        parent[max(i, j)] = min(i, j)
    assert len(set(root.values())) + len(texts) - len(root) == sum(p == k for k, p in enumerate(parent))


def test_turns_store_little(spark, monkeypatch):
    """Shingles that a whole family has get no row each, and union-find leaves the rows of its last round only."""
    from veridra.llm import common, graph

    pick, stored = random.Random(6), []
    word = lambda: "".join(pick.choices("abcdefghij", k=7))
    fixed = [word() for _ in range(30)]
    texts = [" ".join([*fixed, word(), word(), word(), word(), word(), word(), word(), word()]) for _ in range(120)]
    each = spark.createDataFrame([(k, t, [7]) for k, t in enumerate(texts)], "id long, line string, keys array<long>")
    *_, many = linededup.grouped(each)
    links = spark.createDataFrame([(0, 0)], "node long, root long").limit(0)
    pairs = {(r.a, r.b) for r in linededup.unsettled(many, links, lambda ids: linededup.shingle_sets(ids, each)).collect()}
    want = {(i, j) for j in range(120) for i in range(j) if jaccard(texts[i], texts[j]) >= 0.8}
    assert want <= pairs
    monkeypatch.setattr(graph, "cut", lambda df: stored.append(common.cut(df)) or stored[-1])
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)], "a long, b long")
    assert {r.root for r in graph.components(edges).collect()} == {0}
    there = [os.path.exists(df._jdf.queryExecution().logical().rdd().getCheckpointFile().get().removeprefix("file:")) for df in stored]
    assert len(there) > 2 and there == [False] * (len(there) - 1) + [True]


def test_cut_leaves_no_shuffle_files(spark):
    """Rows that are stored need the shuffles that made them no longer; the stored rows can be read all the same."""
    import time

    from veridra.llm import common

    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffles = lambda: {x.rsplit("/", 1)[-1] for x in disk.getAllFiles().mkString("\n").split("\n") if "shuffle_" in x}
    before = shuffles()
    rows = spark.range(1000).groupBy((F.col("id") % 10).alias("k")).count()
    twice = rows.join(rows.withColumnRenamed("count", "n"), "k").repartition(3, "k")
    stored = common.cut(twice)
    for _ in range(50):  # files are deleted in the background
        if not shuffles() - before:
            break
        time.sleep(0.2)
    assert not shuffles() - before
    assert {(r.k, r.n) for r in stored.collect()} == {(k, 100) for k in range(10)} and twice.count() == 10


def test_sketches_spare_pairs_but_no_link(spark, monkeypatch):
    """Two thousand pairs of lines a little below the similarity: few are compared shingle by shingle, and no like pair is lost."""
    pick, checked, verified = random.Random(8), [], linededup.verified
    word = lambda: "".join(pick.choices("abcdefghij", k=7))
    fixed = [word() for _ in range(20)]
    texts = [" ".join([*fixed, *(word() for _ in range(5))]) for _ in range(64)] + ["aaaaaaaaaaaa", "aaaaaaaaaaa", "a", ""]
    texts += [t[:-1] + "z" for t in texts[:10]]
    each = spark.createDataFrame([(k, t, [7]) for k, t in enumerate(texts)], "id long, line string, keys array<long>")
    monkeypatch.setattr(linededup, "verified", lambda pairs, *more: checked.append(pairs.count()) or verified(pairs, *more))
    want = {(i, j) for j in range(len(texts)) for i in range(j) if jaccard(texts[i], texts[j]) >= 0.8}
    for hot in (100, 32):  # all pairs under a smaller key; a hot one
        checked.clear()
        root = {r.node: r.root for r in linededup.linked(each, each, hot).collect()}
        assert all(i in root and root[i] == root[j] for i, j in want) and len(set(root.values())) == len(want) == 11
        assert sum(checked) < 300, checked


def test_middling_keys_need_no_prefix_filter(spark, monkeypatch):
    """Two hundred lines under one key are paired by sketches, larger keys by prefixes: the same components both ways."""
    pick, calls, unsettled = random.Random(12), [], linededup.unsettled
    word = lambda: "".join(pick.choices("abcdefghij", k=7))
    fixed = [word() for _ in range(20)]
    texts = [" ".join([*fixed, *(word() for _ in range(5))]) for _ in range(170)]
    texts += [t[:-1] + "z" for t in texts[:30]]
    want = {(i, j) for j in range(len(texts)) for i in range(j) if jaccard(texts[i], texts[j]) >= 0.8}
    each = spark.createDataFrame([(k, t, [7]) for k, t in enumerate(texts)], "id long, line string, keys array<long>")
    monkeypatch.setattr(linededup, "unsettled", lambda *a, **k: calls.append(1) or unsettled(*a, **k))
    by = [{r.node: r.root for r in linededup.linked(each, each, *hot).collect()} for hot in ((), (32,))]
    assert len(calls) == 1 and by[0] == by[1] and len(by[0]) == 60
    assert len(want) == 30 and all(by[0][i] == by[0][j] for i, j in want)
    two, few, many = linededup.grouped(each)
    drawn = linededup.sketches(each)
    left = linededup.paired(few, None, drawn).collect()
    assert want <= {(r.a, r.b) for r in left} and len(left) < 200 and many.count() == 0
    assert all(r.total == len(shingled(texts[r.a])) + len(shingled(texts[r.b])) for r in left)
    pairs = spark.createDataFrame([(a, b) for a, b in sorted(want)] + [(0, 1)], "a long, b long")  # by union, and by total
    assert {(r.a, r.b) for r in linededup.verified(pairs, each).collect()} == want
    _, _, many = linededup.grouped(each, 32)
    none = spark.createDataFrame([(0, 0)], "node long, root long").limit(0)
    sets_of = lambda ids: linededup.shingle_sets(ids, each)
    for more in (None, drawn):
        assert want <= {(r.a, r.b) for r in unsettled(many, none, sets_of, 0.8, more).collect()}


def test_many_copies_of_few_lines(spark):
    long = " ".join(f"word{k}" for k in range(60))
    texts = [long] * 40 + [long.replace(f"word{k} ", f"wort{k} ") for k in range(5, 30)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r.doc_id for r in linededup.dedup(df).where("text != ''").collect()] == [0]
    keys = spark.createDataFrame([(k % 20, [7]) for k in range(200)], "id long, keys array<long>")
    assert linededup.candidates(keys).count() == 190  # twenty lines in ten copies each: every pair


def test_leaks_equal_brute_force(spark):
    root = "/root/testdata/sf0.01"
    docs, bench = spark.read.parquet(f"{root}/documents.parquet"), spark.read.parquet(f"{root}/benchmark.parquet")
    texts = {r.doc_id: " ".join(r.text.split()) for r in docs.collect()}
    want = {(d, r.item_id) for r in bench.collect() for d, t in texts.items() if " ".join(r.text.split()) in t}
    got = {(r.doc_id, r.item_id) for r in decontam.leaks(docs, bench).collect()}
    assert len(want) > 10 and len(got & want) >= 0.99 * len(want) and len(got - want) <= 0.1 * len(want)


def test_recall_of_paraphrases(spark):
    """Benchmark passages in other prose, with words swapped at random."""
    root, pick = "/root/testdata/sf0.01", random.Random(8)
    bench = spark.read.parquet(f"{root}/benchmark.parquet")
    items = [(r.item_id, r.text.split()) for r in bench.collect() if r.text and len(r.text.split()) >= 12]
    hosts = [r.text.split() for r in spark.read.parquet(f"{root}/documents.parquet").limit(400).collect() if r.text]
    words, rows, planted = [w for h in hosts for w in h], [], {}
    for share in (0.1, 0.2, 0.3, 0.4):
        for item, text in items:
            new = [pick.choice(words) if pick.random() < share else w for w in text]
            host = pick.choice(hosts)[:120]
            planted[len(rows)] = (item, share)
            rows.append((len(rows), " ".join([*host, *new, *host])))
    got = {(r.doc_id, r.item_id) for r in decontam.leaks(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    found = collections.Counter(share for d, (item, share) in planted.items() if (d, item) in got)
    print("paraphrases", len(items), dict(found))
    assert all(found[share] >= (0.95 if share < 0.35 else 0.9) * len(items) for share in (0.1, 0.2, 0.3, 0.4))


def test_paraphrases_and_edge_cases(spark):
    item = "quorble fenwick attends the marsh where olden zibbets gather and pelliform reeds conceal their amber nests"
    changed = item.replace("attends", "visits").replace("conceal", "hide").replace("and", "while")
    filler = " ".join(f"lorem{k} the and" for k in range(80))
    docs = [(1, f"{filler} {item} {filler}"), (2, f"{filler} {changed.upper()} {filler}"), (3, filler), (4, None), (5, ""), (None, item), (1, f"{filler} {item} {filler}"), (6, item.replace(" ", "\n"))]
    frame = spark.createDataFrame([(i, t, 0.0) for i, t in docs], "doc_id long, text string, cosine double")
    bench = spark.createDataFrame([(10, item), (11, None), (12, ""), (13, "utterly different words that nobody wrote anywhere")], "item_id long, text string")
    got = collections.Counter((r.doc_id, r.item_id) for r in decontam.leaks(frame, bench).collect())
    assert got == {(1, 10): 2, (2, 10): 1, (None, 10): 1, (6, 10): 1}
    assert sorted(r.doc_id for r in decontam.clean(frame, bench).collect()) == [3, 4, 5]
    assert decontam.leaks(frame, bench.limit(0)).count() == 0 and decontam.leaks(frame.limit(0), bench).count() == 0


@pytest.mark.parametrize("size", [1_000, 5_000, 20_000])
def test_verbatim_recall_holds_for_large_benchmarks(spark, size):
    pick, names = random.Random(size), [f"w{k}" for k in range(20_000)]
    weights = [1 / (k + 1) for k in range(20_000)]
    prose = lambda n: " ".join(pick.choices(names, weights, k=n))
    items = [prose(pick.randint(15, 19 if k % 2 else 59)) for k in range(size)]
    planted = pick.sample(range(size), 200)
    docs = spark.createDataFrame([(d, f"{prose(60)} {items[i]} {prose(60)}") for d, i in enumerate(planted)], "doc_id long, text string").repartition(4)
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    texts = {r.doc_id: f" {r.text} " for r in docs.collect()}
    want = {(d, i) for d, t in texts.items() for i, x in enumerate(items) if f" {x} " in t}
    got = {(r.doc_id, r.item_id) for r in decontam.leaks(docs, bench).collect()}
    print(size, len(want), len(want & got), len(got))
    assert len(want) >= 200 and len(want & got) >= 0.99 * len(want)


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    root, docs, out = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{TINY}/documents.parquet"), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, TINY).write.parquet(f"{root}/{k}")
        out.append((name, docs, spark.read.parquet(f"{root}/{k}")))
        docs = out[-1][2]
    return out


def test_stages(spark, stages):
    assert [n for n, *_ in stages] == ["quality", "lines", "simhash", "decontamination", "bpe"]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{TINY}/labels.parquet").collect()}
    for _, before, after in stages[:-1]:
        assert after.columns == before.columns and after.count() <= before.count()
    (_, docs, good), (_, _, thin), (_, _, single), (_, _, clean), (_, _, last) = stages
    lost = [r.doc_id for r in docs.join(good, "doc_id", "left_anti").collect()]
    assert all(labels.get(i) != 1 or len(t.split()) < 50 for i, t in ((r.doc_id, r.text) for r in docs.where(docs.doc_id.isin(lost)).collect()))
    want = brute_removed([(r.doc_id, r.text) for r in good.collect()])
    kept = {r.doc_id: r.text for r in thin.collect()}
    for r in good.collect():
        assert kept[r.doc_id] == "\n".join(x for p, x in enumerate(r.text.split("\n")) if p not in want[r.doc_id])
    assert last.count() == clean.count() and "ids_sha256" in last.columns and single.count() >= clean.count()


def test_run_equals_stages(spark, stages):
    got = corpus_pipeline.run(spark, TINY).collect()
    assert sorted(map(str, got)) == sorted(map(str, stages[-1][2].collect()))


def test_stages_take_odd_rows(spark):
    """Null and empty values, a very long text, repeated rows, columns whose names clash, and no rows at all."""
    prose = " ".join(f"word{k} some other things" for k in range(40))
    rows = [(1, prose, "en", "web"), (1, prose, "en", "web"), (2, None, None, None), (3, "", "en", "web"), (None, prose + " end", "en", None), (4, "\n".join([prose] * 300), "en", "web"), (5, " \n\n", "xx", "y")]
    df = spark.createDataFrame([(*r, 0, 1, 2, 3) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, id long, key long, root long")
    for docs in (df, df.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, TINY).collect()
            assert len(out) <= docs.count() and (name == "bpe" or not out or list(out[0].asDict()) == docs.columns), name
            if name in ("lines", "bpe"):
                assert len(out) == docs.count()
