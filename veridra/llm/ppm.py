"""Operator 6, LM scoring: prediction by partial matching over bytes, beside a smoothed unigram base.

Training counts every run of ORDER + 1 bytes in the training rows: the trie of all contexts of up to ORDER bytes, none
left out, so it grows with the corpus. Code lengths (escape as in method C, symbols of longer contexts excluded from
shorter ones) are worked out for every run of the corpus, in groups by the last three bytes of the context: what follows
a context also follows its suffix, so what an escape leaves over is a difference of sums of the two (`price`). Runs that
make up at least one in `hot_grams` of all are broadcast (at most that many, 16 bytes each); others meet their code
length in a shuffled join. Contexts of up to two bytes are broadcast: at most 2^24 runs of 16 bytes, 268 MB if every
triple of bytes occurs; the driver holds no more than that and the hot runs and words.

The base needs every word's count. Words that make up at least one in `hot_words` of the training tokens (again
at most that many) are broadcast; the rest meet their counts in a shuffled join keyed by the word.

Results: null text counts as empty (one token, the end); null doc_id hashes as the empty string; every input row
gives one output row; without training rows the base is 0 for each token and the model uniform over bytes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veridra.llm.common import cut, text_slices

ORDER, HOT_GRAMS, HOT_WORDS = 4, 1 << 21, 1 << 20
#: Bytes of text that a worker counts at once, different runs that it holds before it passes them on, and runs that are
#: priced together (a group is larger only if one context of three bytes is).
TRAIN_SLICE, HELD, GROUP = 5_000_000, 3_000_000, 200_000
#: Stands for the end token in counts: no word holds a space.
END = " "


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 7 == 2


def _words(batch: pa.RecordBatch) -> tuple[np.ndarray, pa.DictionaryArray]:
    """Of each word of the batch: the row, and the word itself (dictionary-encoded)."""
    low = pc.ascii_lower(pc.fill_null(batch.column(batch.schema.get_field_index("text")).cast(pa.string()), ""))
    lists = pc.ascii_split_whitespace(low)
    rows, flat = pc.list_parent_indices(lists), pc.list_flatten(lists)
    real = pc.not_equal(flat, "")
    return np.asarray(rows.filter(real), dtype=np.int64), flat.filter(real).dictionary_encode()


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_slices(batches, TRAIN_SLICE):
        _, words = _words(batch)
        n = np.bincount(np.asarray(words.indices, dtype=np.int64), minlength=len(words.dictionary))
        names = pa.concat_arrays([words.dictionary.cast(pa.string()), pa.array([END])])
        yield pa.RecordBatch.from_arrays([names, pa.array(np.r_[n, batch.num_rows].astype(np.int64))], names=["word", "n"])


def _pairs(row: np.ndarray, code: np.ndarray, wanted: np.ndarray, codes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different pairs of a row and a code, of the codes that are wanted, and how often each comes."""
    some = wanted[code] if len(wanted) else np.zeros(len(code), bool)
    pair, times = np.unique(row[some] * max(codes, 1) + code[some], return_counts=True)
    return *np.divmod(pair, max(codes, 1)), times


def runs(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Of each byte of the texts, and of the zero that ends each: the row, and the run of ORDER bytes before it and itself.
    Before a text stand zeros."""
    text = pc.fill_null(batch.column(batch.schema.get_field_index("text")).cast(pa.binary()), b"")
    sizes = np.asarray(pc.binary_length(text), dtype=np.int64)
    gap = bytes(ORDER)
    whole = pc.binary_join(pa.array([text.to_pylist()], pa.list_(pa.binary())), gap)[0].as_py() if len(text) else b""
    wide = np.frombuffer(gap + whole + gap, np.uint8).astype(np.int64)
    run = np.zeros(max(len(wide) - ORDER, 0), np.int64)  # run i ends at byte i + ORDER
    for k in range(ORDER + 1):
        run = (run << 8) | wide[k : len(run) + k]
    row = np.repeat(np.arange(len(sizes)), sizes + 1)
    return row, run[np.arange(len(row)) + row * (ORDER - 1)]  # the zeros after an end aren't predicted


def _added(grams: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different grams, sorted, and the sums of their n."""
    order = np.argsort(grams, kind="stable")
    grams, n = grams[order], n[order]
    first = np.flatnonzero(np.r_[True, grams[1:] != grams[:-1]][: len(grams)])
    return grams[first], np.add.reduceat(n, first) if len(first) else n


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of texts and their number in training texts (column train); others are asked for, so they come with zero."""
    grams, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
    out = lambda: pa.RecordBatch.from_arrays([pa.array(grams), pa.array(n)], names=["gram", "n"])
    for batch in text_slices(batches, TRAIN_SLICE):
        train = np.asarray(batch.column(batch.schema.get_field_index("train")).to_numpy(zero_copy_only=False), dtype=bool)
        row, run = runs(batch)
        parts = [(grams, n)]
        for kind in (True, False):
            own, times = np.unique(run[train[row] == kind], return_counts=True)
            parts.append((own, times * kind))
        grams, n = _added(np.concatenate([x for x, _ in parts]), np.concatenate([x for _, x in parts]))
        if len(grams) > HELD:
            yield out()
            grams, n = grams[:0], n[:0]
    yield out()


class Level:
    """Contexts of one length: their grams (context and symbol) with counts; of each context the total, the kinds of
    symbols, and how often those follow the next shorter context (`below`)."""

    def __init__(self, grams: np.ndarray, n: np.ndarray, order: int, lower: Level | None):
        self.order, (self.grams, self.n) = order, _added(grams, n)
        self.contexts, start = np.unique(self.grams >> 8, return_index=True)
        add = lambda x: np.add.reduceat(x, start) if len(start) else x
        self.total, self.kinds = add(self.n), np.diff(np.r_[start, len(self.grams)])
        self.below = add(lower.count(self.grams)) if lower else np.zeros(len(self.contexts), np.int64)

    @staticmethod
    def _find(inside: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(inside, x), max(len(inside) - 1, 0))
        return at, inside[at] == x if len(inside) else np.zeros(len(x), bool)

    def count(self, grams: np.ndarray) -> np.ndarray:
        at, there = self._find(self.grams, grams & ((1 << 8 * (self.order + 1)) - 1))
        return np.where(there, self.n[at], 0) if len(self.n) else np.zeros(len(grams), np.int64)

    def context(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self._find(self.contexts, (grams >> 8) & ((1 << 8 * self.order) - 1))


def short_levels(grams: np.ndarray, n: np.ndarray) -> list[Level]:
    """The levels of no, one and two bytes, from all runs of three bytes and their counts."""
    levels: list[Level] = []
    for k in range(3):
        levels.append(Level(grams & ((1 << 8 * (k + 1)) - 1), n, k, levels[-1] if levels else None))
    return levels


def price(grams: np.ndarray, n: np.ndarray, short: list[Level]) -> np.ndarray:
    """log10 of the probability of the last byte of each gram after the others. The grams are all of their contexts of
    three bytes, n their counts (0: only asked for)."""
    levels, known = list(short), n > 0
    for k in range(3, ORDER + 1):
        levels.append(Level(grams[known] & ((1 << 8 * (k + 1)) - 1), n[known], k, levels[-1]))
    out, done = np.zeros(len(grams)), np.zeros(len(grams), bool)
    kinds = below = np.zeros(len(grams), np.int64)  # of the next longer context: those symbols are excluded
    for level in reversed(levels):
        at, met = level.context(grams)
        if not len(level.contexts):
            continue
        own, times = level.kinds[at], level.count(grams)
        left = np.where(met, own - kinds, 0)
        size = np.maximum(np.where(met, level.total[at] - below + left, 1), 1)
        hit, escape = ~done & met & (times > 0), ~done & met & (times == 0) & (left > 0)
        out += np.log10(np.where(hit, times / size, np.where(escape, left / size, 1.0)))
        done |= hit
        kinds, below = np.where(met, own, 0), np.where(met, level.below[at], 0)
    free = 256 - len(short[0].grams)  # symbols that were never seen
    return np.where(done, out, out - np.log10(max(free, 1)))


def priced(docs: DataFrame) -> DataFrame:
    """gram, n (in training) and cost of every run in docs (columns text and train)."""
    grams = cut(docs.select("text", "train").mapInArrow(_count_grams, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")))
    triples = grams.where("n > 0").groupBy((F.col("gram") % (1 << 24)).alias("gram")).agg(F.sum("n").alias("n")).toArrow()
    sc = docs.sparkSession.sparkContext
    short = sc.broadcast(short_levels(*(np.asarray(triples[c].combine_chunks(), dtype=np.int64) for c in ("gram", "n"))))

    def group(table: pa.Table) -> pa.Table:
        gram, n = (np.asarray(table[c].combine_chunks(), dtype=np.int64) for c in ("gram", "n"))
        return pa.table({"gram": gram, "n": n, "cost": price(gram, n, short.value)})

    groups = max(16, grams.count() // GROUP)
    own = F.pmod(F.xxhash64(F.shiftright("gram", 8) % (1 << 24)), F.lit(groups))
    return cut(grams.withColumn("own", own).groupBy("own").applyInArrow(group, "gram long, n long, cost double"))


def score(docs: DataFrame, hot_grams: int = HOT_GRAMS, hot_words: int = HOT_WORDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score for each row of docs."""
    docs = docs.select("doc_id", "text", (~held_out(F.col("doc_id"))).alias("train"))
    counts = cut(docs.where("train").select("text").mapInArrow(_count_words, "word string, n long").groupBy("word").agg(F.sum("n").alias("c")).where("c > 0"))
    total = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    n_all, v_all = total["n"] or 0, total["v"]
    hot = counts.where(F.col("c") * hot_words >= n_all).toArrow()
    sc = docs.sparkSession.sparkContext
    known = sc.broadcast((hot["word"].combine_chunks(), np.log10(np.asarray(hot["c"].combine_chunks(), dtype=np.float64) + 1)))
    costs = priced(docs)
    positions = costs.agg(F.sum("n")).first()[0] or 0
    often = costs.where((F.col("n") > 0) & (F.col("n") * hot_grams >= positions)).orderBy("gram").toArrow()
    model = sc.broadcast(tuple(np.asarray(often[c].combine_chunks(), dtype=t) for c, t in (("gram", np.int64), ("cost", np.float64))))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Two rows of sums for each document (their keys match nothing), and a row for each of its other words and runs."""
        names, logs = known.value
        common, cost = model.value
        end = pc.index_in(pa.scalar(END), value_set=names).as_py() if len(names) else None
        for batch in text_slices(batches, 2_000_000):
            row, words = _words(batch)
            k, code = batch.num_rows, np.asarray(words.indices, dtype=np.int64)
            at = pc.index_in(words.dictionary.cast(pa.string()), value_set=names)
            is_hot = np.asarray(at.is_valid())
            gain = np.where(is_hot, logs[np.asarray(at.fill_null(0), dtype=np.int64)] if len(logs) else 0.0, 0.0)
            n = np.bincount(row, minlength=k) + 1
            n_known = np.bincount(row, weights=is_hot[code], minlength=k).astype(np.int64) + (end is not None)
            base = np.bincount(row, weights=gain[code], minlength=k) + (logs[end] if end is not None else 0.0)
            own, word, tf = _pairs(row, code, ~is_hot, len(words.dictionary))
            if end is None:  # the end is then a rare token too
                own, word, tf = np.r_[own, np.arange(k)], np.r_[word, np.full(k, len(words.dictionary))], np.r_[tf, np.ones(k, np.int64)]
            every = pa.concat_arrays([words.dictionary.cast(pa.string()), pa.array([END])])
            place, run = runs(batch)
            kinds, which = np.unique(run, return_inverse=True)
            at, there = Level._find(common, kinds)
            bits = np.bincount(place, weights=np.where(there, cost[at] if len(cost) else 0.0, 0.0)[which], minlength=k)
            whose, gram, times = _pairs(place, which, ~there, len(kinds))
            key = np.asarray(batch.column(batch.schema.get_field_index("h")), dtype=np.int64)
            mark = pa.array([f" {h}" for h in key.tolist()], pa.string())
            who = np.r_[np.arange(k), np.arange(k), own, whose]
            cols = [
                pa.concat_arrays([mark, mark, every.take(pa.array(word)), pc.binary_join_element_wise("  ", pa.array(kinds).cast(pa.string()).take(pa.array(gram)), "")]),
                pa.array(key[who]),
                batch.column(batch.schema.get_field_index("doc_id")).cast(pa.int64()).take(pa.array(who)),
                pa.array(np.repeat(np.arange(4, dtype=np.int8), [k, k, len(own), len(whose)])),
                pa.array(np.r_[n, n_known, tf, times].astype(np.int32)),
                pa.array(np.r_[bits, base, np.zeros(len(own) + len(whose))]),
            ]
            yield pa.RecordBatch.from_arrays(cols, names=["word", "h", "doc_id", "kind", "tf", "x"])

    kind, tf, x = F.col("kind"), F.col("tf"), F.col("x")
    parts = docs.select("doc_id", "text", F.xxhash64("text").alias("h")).mapInArrow(rows, "word string, h long, doc_id long, kind byte, tf int, x double")
    rest = counts.where(F.col("c") * hot_words < n_all).select("word", F.log10(F.col("c") + 1).alias("v"))
    seldom = costs.where((F.col("n") == 0) | (F.col("n") * hot_grams < positions)).select(F.concat(F.lit("  "), F.col("gram").cast("string")).alias("word"), F.col("cost").alias("v"))
    found = parts.join(rest.union(seldom).hint("shuffle_hash"), "word", "left")
    sums = found.groupBy("doc_id", "h").agg(
        F.sum(F.when(kind == 0, 1).otherwise(0)).alias("copies"),
        F.sum(F.when(kind == 0, tf).otherwise(0)).alias("n"),
        F.sum(F.when(kind == 1, tf).when((kind == 2) & F.col("v").isNotNull(), tf).otherwise(0)).alias("k"),
        F.sum(F.when(kind == 0, x).when(kind == 3, tf * F.col("v")).otherwise(0.0)).alias("s"),
        F.sum(F.when(kind == 1, x).when(kind == 2, tf * F.coalesce("v", F.lit(0.0))).otherwise(0.0)).alias("b"),
    )
    each = sums.select("*", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))).alias("one"))
    tokens = (F.col("n") / F.col("copies")).cast("long")
    return each.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        tokens.alias("n_tokens"),
        (F.col("k") / F.col("copies")).cast("long").alias("n_known"),
        F.lit(n_all).cast("long").alias("train_tokens"),
        (F.col("b") / F.col("copies") - tokens * F.lit(math.log10(n_all + v_all + 1))).alias("base_score"),
        (F.col("s") / F.col("copies")).alias("score"),
    )
