"""Operator 5, quality rules with adaptive thresholds (DataFrame and SQL functions only).

Each text is measured in one row, without exploding: words, their characters, symbols, repeated lines, and words
inside three-word windows that the text holds twice. Equal windows are found by their 64-bit hashes: a text is
taken apart further only if two of its hashes are equal, and then the hashes are sorted together with their places.

Thresholds replace fixed cutoffs: mergeable KLL sketches of the measures are built per language and source, merged
to languages and to the whole, and a text fails if a measure lies beyond the quartile by `spread` times the
quartile distance (a least distance keeps uniform groups from turning strict). A group below `least_rows` uses its
language's thresholds, and that the whole's. Thresholds are a small table joined on language and source.

Sketches pick what they keep at random in groups of more than about SKETCH rows, so `kept` may differ between runs for
rows within 0.4 % of a fence's rank; smaller groups are exact. `least_rows` is a switch of the method: a small group has no
quartiles of its own worth the name.

Results: very long texts are measured whole, in one row; columns that clash with a measure's name are replaced by it, all
others stay; repeated rows count as rows; null text has no words and fails the base; null lang or source is a group of its own; every input row
gives one output row; no rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veridra.llm.common import SPACE, cut

MIN_WORDS, MAX_REPEAT = 50, 50
LEAST_ROWS, SPREAD = 200, 6.0
#: Items that a sketch keeps at each level: quantiles of smaller groups are exact, of larger ones within 0.4 %.
SKETCH = 800
#: Measures with the least quartile distance that counts, and the sides that fail.
MEASURES = {
    "word_length": (0.5, "both"), "symbol_share": (0.01, "high"), "upper_share": (0.05, "high"),
    "line_share": (0.06, "high"), "repeat_share": (0.06, "high"),
}
SIGNS = r"[#*$%&|<>]"
BLANKS = " \t\n\x0b\x0c\r"


def _let(value: Column, body) -> Column:
    """body(value) with the value worked out once for each row, though a lambda inside uses it often."""
    return F.get(F.transform(F.array(value), body), 0)


def _covered(hashes: Column) -> Column:
    """Words that lie in a window whose hash comes twice: the union of runs of three places."""
    placed = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def again(p: Column) -> Column:
        same = F.filter(p, lambda x, k: (x["h"] == F.get(p, k - 1)["h"]) | (x["h"] == F.get(p, k + 1)["h"]))
        return F.array_sort(F.transform(same, lambda x: x["i"]))

    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    union = F.aggregate(
        _let(placed, again), start,
        lambda acc, i: F.struct((acc["n"] + i + 3 - F.greatest(i, acc["end"])).alias("n"), (i + 3).alias("end")),
        lambda acc: acc["n"],
    )
    return union


def measures(docs: DataFrame) -> DataFrame:
    """docs (column text) with n_words, word_chars, n_symbols, n_upper, n_dup_lines and n_repeat_words in place of those."""
    own = ["n_words", "word_chars", "n_symbols", "n_upper", "n_dup_lines", "n_repeat_words"]
    kept = [c for c in docs.columns if c not in own]
    out = docs.select(*kept, F.coalesce("text", F.lit("")).alias("_text"))
    out = out.withColumn("_trimmed", F.btrim("_text", F.lit(BLANKS)))
    out = out.withColumn("_words", F.when(F.col("_trimmed") == "", F.array().cast("array<string>")).otherwise(F.split("_trimmed", rf"[{SPACE}]+")))
    words = F.col("_words")
    last = F.size(words) - 3
    window = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    out = out.withColumn("_hashes", F.when(last >= 0, window).otherwise(F.array().cast("array<bigint>")))
    out = out.withColumn("_lines", F.filter(F.split("_text", "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != ""))
    return out.select(
        *kept,
        F.size(words).cast("long").alias("n_words"),
        F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
        F.regexp_count("_text", F.lit(SIGNS)).cast("long").alias("n_symbols"),
        F.regexp_count("_text", F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size(F.array_distinct("_hashes")) < F.size("_hashes"), _covered(F.col("_hashes"))).otherwise(0).cast("long").alias("n_repeat_words"),
    )


def _shares(measured: DataFrame) -> DataFrame:
    chars, words = F.greatest("word_chars", F.lit(1)), F.greatest("n_words", F.lit(1))
    return measured.withColumns({
        "word_length": F.col("word_chars") / words, "symbol_share": F.col("n_symbols") / chars, "upper_share": F.col("n_upper") / chars,
        "line_share": F.col("n_dup_lines") / words, "repeat_share": F.col("n_repeat_words") / words,
    })


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))


def thresholds(measured: DataFrame, least_rows: int = LEAST_ROWS, spread: float = SPREAD) -> DataFrame:
    """lang, source, and low_x and high_x for each measure x; one row for each pair of lang and source.

    Quartiles are those of the rows that pass the base, so that short texts and plain repetition don't shift them.
    """
    good = _shares(measured).where(~base_failed())
    by = good.groupBy("lang", "source").agg(F.count("*").alias("rows"), *(F.kll_sketch_agg_double(m, F.lit(SKETCH)).alias(m) for m in MEASURES))
    by = cut(by)
    merged = [F.kll_merge_agg_double(m).alias(m) for m in MEASURES]
    lang = by.groupBy("lang").agg(F.sum("rows").alias("rows"), *merged)
    whole = by.agg(F.sum("rows").alias("rows"), *merged)

    def limits(df: DataFrame, *keys: str) -> DataFrame:
        cols = []
        for m, (least, side) in MEASURES.items():
            low, high = (F.kll_sketch_get_quantile_double(m, F.lit(q)) for q in (0.25, 0.75))
            width = F.greatest(high - low, F.lit(least)) * spread
            cols.append(F.struct((low - width if side == "both" else F.lit(float("-inf"))).alias("low"), (high + width).alias("high")).alias(m))
        return df.where("rows > 0").select(*keys, "rows", *cols)

    # the pairs that only failed rows have need limits too
    pairs = measured.select("lang", "source").distinct()
    a, b, c = limits(by, "lang", "source").alias("a"), limits(lang, "lang").alias("b"), limits(whole).alias("c")
    on = lambda x, y, *keys: [F.col(f"{x}.{k}").eqNullSafe(F.col(f"{y}.{k}")) for k in keys]
    joined = pairs.alias("p").join(a, on("p", "a", "lang", "source"), "left").join(b, on("p", "b", "lang"), "left").join(F.broadcast(c), F.lit(True), "left")
    best = {m: F.when(F.col("a.rows") >= least_rows, F.col(f"a.{m}")).when(F.col("b.rows") >= least_rows, F.col(f"b.{m}")).otherwise(F.col(f"c.{m}")) for m in MEASURES}
    return joined.select("p.lang", "p.source", *(v[x].alias(f"{x}_{m}") for m, v in best.items() for x in ("low", "high")))


def judge(measured: DataFrame, limits: DataFrame) -> DataFrame:
    """The rows of measured with base_failed and kept."""
    within = F.lit(True)
    for m in MEASURES:
        within = within & F.coalesce(F.col(m).between(F.col(f"low_{m}"), F.col(f"high_{m}")), F.lit(True))
    left = _shares(measured).alias("d")
    on = F.col("d.lang").eqNullSafe(F.col("t.lang")) & F.col("d.source").eqNullSafe(F.col("t.source"))
    return left.join(limits.alias("t"), on, "left").select("d.*", base_failed().alias("base_failed"), (~base_failed() & within).alias("kept"))


DIGEST = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def verdicts(docs: DataFrame) -> DataFrame:
    """The measures, base_failed and kept for each row of docs (columns doc_id, text, lang and source)."""
    measured = cut(measures(docs.select("doc_id", "text", "lang", "source")).drop("text"))
    return judge(measured, thresholds(measured)).select(*DIGEST, "base_failed", "kept")


def keep(docs: DataFrame) -> DataFrame:
    """The rows of docs (all columns) whose verdict is to keep them.

    Verdicts belong to texts: they are joined back on doc_id and a hash of the text, and only those that go are
    joined, so the texts themselves aren't shuffled while those are few enough to broadcast.
    """
    key = docs.select("doc_id", "text", "lang", "source", F.xxhash64("text").alias("row_hash"))
    measured = cut(measures(key).drop("text"))
    gone = judge(measured, thresholds(measured)).where("not kept").select("doc_id", "row_hash", "lang", "source").distinct().alias("g")
    on = F.col("d.doc_id").eqNullSafe(F.col("g.doc_id")) & (F.xxhash64("d.text") == F.col("g.row_hash"))
    for c in ("lang", "source"):
        on = on & F.col(f"d.{c}").eqNullSafe(F.col(f"g.{c}"))
    return docs.alias("d").join(gone, on, "left_anti")
