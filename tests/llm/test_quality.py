import collections
import re

from veridra.llm import quality


def brute(text):
    text = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen = collections.Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + j for i in range(len(words) - 2) if seen[tuple(words[i : i + 3])] > 1 for j in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


ROWS = [
    (1, None, "en", "s"), (2, "  ", None, None), (3, "a b c a b c a b c x\n\nq\nq\n q", "en", "s"), (None, "a\x0bb a b\n" * 30, "en", None), (4, " lead trail ", "en", "s"),
    (5, "aa aa aa aa", "de", "t"), (5, "aa aa aa aa", "de", "t"), (6, "ß#漢 $é " * 20000, "fr", "t"), (7, " ".join(f"w{k}" for k in range(60)), "en", "s"),
]


def test_measures_equal_brute_force(spark):
    df = spark.createDataFrame([(*r, 1) for r in ROWS], "doc_id long, text string, lang string, source string, n_words int")
    got = quality.verdicts(df).collect()
    assert len(got) == len(ROWS)
    want = collections.Counter((i, *brute(t)) for i, t, *_ in ROWS)
    assert collections.Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)
    assert quality.verdicts(df.limit(0)).count() == 0
    kept = quality.keep(df)
    assert kept.columns == df.columns and [r.doc_id for r in kept.collect()] == [7]


def test_junk_goes_and_clean_text_stays(spark):
    root = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{root}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{root}/labels.parquet").collect()}
    got = [r for r in quality.verdicts(docs).collect() if r.doc_id in labels and not r.base_failed]
    clean, junk = [r.kept for r in got if labels[r.doc_id]], [r.kept for r in got if not labels[r.doc_id]]
    assert all(clean) and junk and not any(junk)
