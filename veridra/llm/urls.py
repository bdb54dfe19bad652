"""Operator 7, URL filters: host word segmentation, then multinomial naive Bayes, behind explicit rules.

Hosts and paths are cut out by SQL functions, and rules are tried there, the longest first. Where none fits, the
registered part of the host and the path are split into words: at marks, then by a Viterbi search over unigram
counts (words of the pages and a list of telling words). Naive Bayes scores the words. Its counts come from all
rows, labelled by whether a telling word is among their words; with too little of either class it allows.

Models are bounded: a word is kept if it makes up at least one in `words` of all, so at most that many are.
Results: null url, or none with "://", has empty host and path and is allowed; every input row gives one output
row; no rows give no rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veridra.llm.common import cut

# The rules of the contract, and words that tell unwanted hosts.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
TELLING = (
    "adult", "bet", "betting", "bonus", "casino", "cheap", "click", "credit", "dating", "escort", "farm", "free", "gamble",
    "jackpot", "loan", "loans", "lottery", "malware", "nude", "pharma", "pharmacy", "phish", "phishing", "pill", "pills",
    "pirate", "poker", "porn", "replica", "sex", "slots", "spam", "torrent", "viagra", "warez", "win", "winner", "xxx",
)
#: Telling words strong enough to label a row by themselves; the others only carry counts.
LABELS = ("adult", "casino", "escort", "jackpot", "malware", "nude", "phish", "phishing", "pills", "poker", "porn", "spam", "torrent", "viagra", "warez", "xxx")
WORDS, LONGEST = 1 << 16, 24
SCHEMA = "page_id long, host string, path string, rule string, ruled string, words array<string>"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits (null: none) and its verdict."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: len(r[1])):
        name, _, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


class Segmenter:
    """Splits runs of letters into the likeliest words; an unknown word's odds fall tenfold with each letter."""

    def __init__(self, counts: dict[str, int], rest: int = 0):
        """counts of the common words, and how often all other words are met together."""
        total = sum(counts.values()) + rest + len(TELLING)
        least = max(total // 1000, 1)  # telling words count as common ones
        counts = counts | {w: max(counts.get(w, 0), least) for w in TELLING}
        self.rare: dict[str, int] = {}  # counts of other words that are in the runs to split
        self.total = math.log(sum(counts.values()) + rest or 1)
        self.cost = {w: self.total - math.log(n) for w, n in counts.items()}
        self._kept = lru_cache(maxsize=100_000)(self._split)

    def split(self, run: str) -> tuple[str, ...]:
        """The likeliest words of a run of letters; those of short runs are kept for the next time."""
        return self._kept(run) if len(run) <= 64 else self._split(run)

    def _split(self, run: str) -> tuple[str, ...]:
        best: list[tuple[float, int]] = [(0.0, 0)]
        for end in range(1, len(run) + 1):
            found = (math.inf, 0)
            for start in range(max(0, end - LONGEST), end):
                word = run[start:end]
                cost = self.cost.get(word)
                if cost is None:
                    cost = self.total - math.log(self.rare[word]) if word in self.rare else self.total + len(word) * math.log(10)
                cost += best[start][0]
                found = min(found, (cost, start))
            best.append(found)
        out, end = [], len(run)
        while end:
            out.append(run[best[end][1] : end])
            end = best[end][1]
        return tuple(reversed(out))

    def words(self, host: str, path: str) -> list[str]:
        """Words of the host without its last label, and of the path (marked by a slash)."""
        labels = host.split(":")[0].split(".")
        own = [w for label in (labels[:-1] or labels) for run in re.findall(r"[^\W\d_]+", label) for w in self.split(run)]
        return own + ["/" + w for run in re.findall(r"[^\W\d_]+", path.lower()) for w in self.split(run)]


def word_counts(pages: DataFrame, words: int = WORDS) -> tuple[dict[str, int], int, DataFrame]:
    """Counts of the common words of the pages' text (at most `words`), the sum of the others, and the others' counts."""
    parts = F.split(F.translate(F.coalesce("html", F.lit("")), UPPER, LOWER), r"<[^>]*>|[^a-z]+")
    each = pages.select(F.explode(parts).alias("word")).where(F.length("word").between(2, LONGEST)).groupBy("word").count()
    each = cut(each)
    total = each.agg(F.sum("count")).first()[0] or 0
    common = {r["word"]: r["count"] for r in each.where(F.col("count") * words >= total).collect()}
    return common, total - sum(common.values()), each.where(F.col("count") * words < total)


def rare_words(urls: DataFrame, rare: DataFrame) -> DataFrame:
    """urls (with host, path and row) and rare: words and counts of the rare words that a row's runs of letters hold."""
    runs = F.array_distinct(F.regexp_extract_all(F.lower(F.concat_ws("/", "host", "path")), F.lit("[a-z]{2,}"), F.lit(0)))
    each = cut(urls.select("row", F.explode(runs).alias("run")))
    starts, sizes = F.sequence(F.lit(1), F.length("run") - 1), F.sequence(F.lit(2), F.lit(LONGEST))
    parts = F.flatten(F.transform(starts, lambda i: F.transform(F.filter(sizes, lambda n: i + n - 1 <= F.length("run")), lambda n: F.substring("run", i, n))))
    held = each.select("run").distinct().select("run", F.explode(F.array_distinct(parts)).alias("word")).join(rare, "word")
    found = each.join(held, "run").groupBy("row").agg(F.collect_set(F.struct("word", "count")).alias("rare"))
    return urls.join(found, "row", "left").select(*urls.columns, F.col("rare.word").alias("rare"), F.col("rare.count").alias("n"))


def classify(pages: DataFrame, rules=RULES, words: int = WORDS) -> DataFrame:
    """page_id, host, path, rule, verdict and score (log odds of blocking; null under a rule) for each row of pages."""
    sc = pages.sparkSession.sparkContext
    counts, others, rare = word_counts(pages, words)
    known = sc.broadcast((counts, others))
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rule, ruled = rule_of(F.col("host"), F.col("path"), rules)
    urls = pages.select("page_id", host.alias("host"), path.alias("path")).select("page_id", "host", "path", rule.alias("rule"), ruled.alias("ruled"))
    if others:  # the rare ones are looked up by a join
        urls = rare_words(cut(urls).withColumn("row", F.monotonically_increasing_id()), rare).drop("row")
    else:
        urls = urls.select("*", F.lit(None).cast("array<string>").alias("rare"), F.lit(None).cast("array<long>").alias("n"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Segmenter(*known.value)
        for batch in batches:
            found = []
            for h, p, rare, n in zip(*(batch.column(k).to_pylist() for k in (1, 2, 5, 6)), strict=True):
                own.rare = dict(zip(rare or (), n or (), strict=True))  # all that a run holds, so a split can be kept by run
                found.append(own.words(h, p))
            cols = [batch.column(0).cast(pa.int64()), *(batch.column(k).cast(pa.string()) for k in (1, 2, 3, 4)), pa.array(found, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(cols, names=["page_id", "host", "path", "rule", "ruled", "words"])

    split = cut(urls.mapInArrow(rows, SCHEMA)).withColumn("row", F.monotonically_increasing_id())
    bad = F.arrays_overlap("words", F.array(*map(F.lit, LABELS)))
    tokens = split.select(bad.alias("bad"), F.explode("words").alias("word")).groupBy("word").agg(F.count_if("bad").alias("b"), F.count_if(~F.col("bad")).alias("a"))
    tokens = cut(tokens)
    sums = tokens.agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.count("*").alias("v")).first()
    n_a, n_b, v = sums["a"] or 0, sums["b"] or 0, sums["v"]
    docs = split.agg(F.count_if(bad).alias("b"), F.count_if(~bad).alias("a")).first()
    often = (F.col("a") + F.col("b")) * words >= n_a + n_b
    common = tokens.where(often).collect()
    prior = math.log((docs["b"] + 1) / (docs["a"] + 1))
    unseen = math.log((n_a + v + 1) / (n_b + v + 1))
    odds = sc.broadcast({r["word"]: math.log((r["b"] + 1) / (r["a"] + 1)) + unseen for r in common})

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = odds.value
        for batch in batches:
            found = batch.column(5).to_pylist()
            score = [prior + sum(table.get(w, 0.0) for w in own) for own in found]
            rest = [[w for w in own if w not in table] for own in found]
            cols = [*batch.columns[:5], batch.column(6), pa.array(score, pa.float64()), pa.array(rest, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(cols, names=["page_id", "host", "path", "rule", "ruled", "row", "score", "rest"])

    scored = split.mapInArrow(scores, "page_id long, host string, path string, rule string, ruled string, row long, score double, rest array<string>")
    few = tokens.where(~often)
    if few.limit(1).count():  # words too rare to broadcast meet their counts in a shuffled join
        weight = few.select("word", (F.log((F.col("b") + 1) / (F.col("a") + 1)) + unseen).alias("w"))
        scored = cut(scored)
        more = scored.select("row", F.explode("rest").alias("word")).join(weight, "word").groupBy("row").agg(F.sum("w").alias("more"))
        scored = scored.join(more, "row", "left").withColumn("score", F.col("score") + F.coalesce("more", F.lit(0.0)))
    own = F.when(F.col("score") > 0, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("ruled", own).alias("verdict"), F.when(F.col("rule").isNull(), F.round("score", 9)).alias("score"))
