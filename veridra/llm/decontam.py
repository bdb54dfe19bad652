"""Operator 2, benchmark decontamination by latent semantic retrieval.

Texts are lower-cased, ASCII punctuation counts as white space, and words are looked up among those of the benchmark
(Arrow kernels; no word is handled in Python). Document frequencies of those words come from all documents; a word
that the benchmark lacks weighs as the rarest. Randomised SVDs of the benchmark's TF-IDF passages give the latent
spaces: each is of GROUP passages, no more than its RANK, so that at any size of the benchmark every passage keeps
ENERGY_KEPT of its energy (of 20,000 passages in one space of that rank most would keep next to none).
Every text is then cut into windows of 24 words that overlap by half. A window that puts enough of its weight on
words of the benchmark is compared with all benchmark passages by the cosine of the latent vectors (of the words that
the space knows; others don't count against a window); candidates are
verified in the same pass: the longest common subsequence of words (weighted by inverse document frequency) must
cover `COVER` of the passage, or `PARAPHRASE` of it with the words of the answer (the last quarter) present.

The benchmark is a stated set of queries; it is taken in blocks of up to `BLOCK` passages, which share a vocabulary and
its frequencies, and searched by `PART` of them, each a bounded broadcast (a passage has at most 48 words). Results: one row for each row of docs and item
found in it; null or empty texts and items have none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veridra.llm.common import cut, text_slices

RANK, OVERSAMPLE, SEED = 128, 16, 7
#: Passages of one latent space (at most RANK), and the least share of each one's energy that the space keeps.
GROUP, ENERGY_KEPT = RANK, 0.99
STEP, PASSAGE, BLOCK, PART = 12, 48, 20_000, 4096
#: Least cosine in the latent space, least share of the window's weight on the benchmark's words; then what the
#: verification asks for.
COSINE, ENERGY, COVER, PARAPHRASE, ANSWER = 0.3, 0.1, 0.5, 0.4, 0.6
HITS = "doc_id long, item_id long, cosine double, lcs_share double, answer_share double"
_BLANK = bytes(32 if chr(c) in ".,;:!?\"'()[]{}<>|*#$%&-_/\\" else c for c in range(256))


def words(text: pa.Array) -> tuple[np.ndarray, pa.StringArray]:
    """The row of each word, and the words."""
    low = pc.utf8_lower(pc.fill_null(text.cast(pa.large_string()), ""))
    if low.null_count or low.offset:
        low = pa.concat_arrays([low])
    _, offsets, data = low.buffers()
    plain = pa.LargeStringArray.from_buffers(len(low), offsets, pa.py_buffer(data.to_pybytes().translate(_BLANK)) if data else pa.py_buffer(b""))
    lists = pc.ascii_split_whitespace(plain)
    rows, flat = pc.list_parent_indices(lists), pc.list_flatten(lists)
    real = pc.greater(pc.binary_length(flat), 0)
    return np.asarray(rows.filter(real), dtype=np.int64), flat.filter(real)


def coded(text: pa.Array, vocab: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """The row of each word, its place in the vocabulary (-1: none), and the words."""
    row, flat = words(text)
    code = np.asarray(pc.fill_null(pc.index_in(flat, value_set=vocab), -1), dtype=np.int32)
    return row, code, flat


def vocabulary(runs: list[str]) -> pa.Array:
    return pc.unique(words(pa.array(runs, pa.string()))[1]).cast(pa.large_string())


def inverse_frequencies(docs: DataFrame, vocab: pa.Array) -> tuple[np.ndarray, float]:
    """log of documents over documents with the word, for each word of the vocabulary, and for a word met once."""
    shared = docs.sparkSession.sparkContext.broadcast(vocab)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        total, seen = 0, np.zeros(len(known), np.int64)
        for batch in text_slices(batches, 4_000_000):
            row, code, _ = coded(batch.column(0), known)
            total += batch.num_rows
            row, code = row[code >= 0], code[code >= 0]
            for k in range(0, batch.num_rows, 1024):  # a bit for each text and word
                a, b = np.searchsorted(row, [k, k + 1024])
                there = np.zeros((min(1024, batch.num_rows - k), len(known)), bool)
                there[row[a:b] - k, code[a:b]] = True
                seen += there.sum(axis=0)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, at].astype(np.int32)), pa.array(np.r_[total, seen[at]])], names=["word", "n"])

    counts = docs.select("text").mapInArrow(part, "word int, n long").groupBy("word").agg(F.sum("n").alias("n")).toArrow()
    at, n = (np.asarray(counts[c].combine_chunks(), dtype=np.int64) for c in ("word", "n"))
    total = int(n[at < 0].sum())
    out = np.zeros(len(vocab))
    out[at[at >= 0]] = n[at >= 0]
    return (np.log((total + 1) / (out + 1)) + 0.01).astype(np.float32), float(np.log((total + 1) / 2) + 0.01)


def passages(benchmark: DataFrame) -> DataFrame:
    """item_id and text of each run of up to PASSAGE words; longer items give runs that overlap by half."""
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda x: x != "")
    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - PASSAGE, F.lit(0)) + PASSAGE // 2 - 1, F.lit(PASSAGE // 2))
    runs = F.transform(starts, lambda s: F.array_join(F.slice("words", s + 1, PASSAGE), " "))
    return benchmark.select("item_id", words.alias("words")).where(F.size("words") > 0).select("item_id", F.explode(runs).alias("text")).distinct()


def latent_basis(matrix: np.ndarray) -> np.ndarray:
    """Orthonormal columns over the words that span the leading right singular vectors of the normed passages (rows): a
    randomised SVD, sharpened by one more multiplication. Every passage keeps ENERGY_KEPT of its energy in the space;
    as GROUP is at most RANK, all directions can be kept where it takes them."""
    start = np.linalg.qr(matrix.T @ np.random.default_rng(SEED).standard_normal((len(matrix), RANK + OVERSAMPLE)))[0]
    left, size, _ = np.linalg.svd(matrix.T @ (matrix @ start), full_matrices=False)
    left = left[:, : min(RANK, int((size > 1e-9 * size[0]).sum()))]
    kept = np.cumsum((matrix @ left) ** 2, axis=1).min(axis=0, initial=1.0)  # of the passage that keeps least, by rank
    return left[:, : int(np.searchsorted(kept, ENERGY_KEPT)) + 1].astype(np.float32)


class Group:
    """The latent space of up to GROUP passages, given by their words' places in the vocabulary."""

    def __init__(self, passages: list[np.ndarray], idf: np.ndarray):
        words, at = np.unique(np.concatenate(passages), return_inverse=True)
        self.local = np.full(len(idf) + 1, -1, np.int32)  # the last: any other word
        self.local[words] = np.arange(len(words))
        matrix = np.zeros((len(passages), len(words)))
        np.add.at(matrix, (np.repeat(np.arange(len(passages)), list(map(len, passages))), at), idf[words][at])
        matrix /= np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-9)
        basis = latent_basis(matrix)
        self.vectors = (idf[words][:, None] * basis).astype(np.float32)
        latent = (matrix @ basis).astype(np.float32)
        self.latent = np.ascontiguousarray((latent / np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-9)).T)


def weighted_lcs(a: list, weight: list[float], b: list) -> float:
    """The greatest weight of words of a that are a common subsequence of a and b."""
    at = {}
    for k, w in enumerate(b):
        at.setdefault(w, []).append(k)
    best = np.zeros(len(b) + 1)  # best[k]: of the first k words of b
    for w, x in zip(a, weight, strict=True):
        if places := at.get(w):
            old = best.copy()
            for k in places:
                best[k + 1] = max(best[k + 1], old[k] + x)
            np.maximum.accumulate(best, out=best)
    return float(best[-1])


class Index:
    """Latent vectors of benchmark passages, and the search of texts against them."""

    def __init__(self, items: list[int], runs: list[str], vocab: pa.Array, idf: np.ndarray, rare: float):
        row, code, flat = coded(pa.array(runs, pa.string()), vocab)
        self.items, self.vocab, self.idf = items, vocab, idf
        self.inside, self.square = np.r_[idf**2, 0].astype(np.float32), np.r_[idf**2, rare**2].astype(np.float32)  # the last: any other word
        cuts = np.searchsorted(row, np.arange(len(runs) + 1))
        codes = [code[a:b] for a, b in zip(cuts, cuts[1:])]
        self.passages = [(c.tolist(), idf[c].tolist(), float(idf[c].sum())) for c in codes]
        full = [p for p, c in enumerate(codes) if len(c)]  # a run of punctuation has no words
        numbers = [np.array(full[k : k + GROUP]) for k in range(0, len(full), GROUP)]
        self.groups = [(own, Group([codes[p] for p in own], idf)) for own in numbers]

    def windows(self, row: np.ndarray, code: np.ndarray) -> Iterator[tuple[int, int, int, float]]:
        """Start of a window, its end, number of the passage, and cosine, of each candidate."""
        if not len(row) or not len(self.items):
            return
        first = np.r_[0, np.flatnonzero(row[1:] != row[:-1]) + 1]
        since = np.arange(len(row)) - np.repeat(first, np.diff(np.r_[first, len(row)]))
        start = np.flatnonzero(since % STEP == 0)
        end = np.r_[start[1:], len(row)]
        whole, inside = (np.add.reduceat(x[code], start) for x in (self.square, self.inside))
        joins = np.r_[row[start[1:]] == row[start[:-1]], False]  # the next block is of the same text
        whole, inside = (x + np.where(joins, np.r_[x[1:], 0], 0) for x in (whole, inside))
        # a text's last block alone is no window, unless it is the only one
        alone = ~joins & ~np.r_[False, joins[:-1]]
        likely = np.flatnonzero((joins | alone) & (inside >= ENERGY * whole))
        for k in range(0, len(likely), 2048):
            part = likely[k : k + 2048]
            stop = np.where(joins[part], end[np.minimum(part + 1, len(end) - 1)], end[part])
            size = stop - start[part]
            at = np.repeat(start[part] - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())
            own = np.repeat(np.arange(len(part)), size)
            own, place = own[code[at] >= 0], code[at][code[at] >= 0]
            if not len(place):
                continue
            for numbers, group in self.groups:
                local = group.local[place]
                mine, local = own[local >= 0], local[local >= 0]
                if not len(local):
                    continue
                begins = np.r_[0, np.flatnonzero(mine[1:] != mine[:-1]) + 1]
                latent = np.add.reduceat(group.vectors[local], begins, axis=0)
                norm, at = np.maximum(np.linalg.norm(latent, axis=1), 1e-9), mine[begins]
                dot = latent @ group.latent
                for flat in np.flatnonzero((dot >= (COSINE * norm)[:, None]).ravel()).tolist():
                    w, p = divmod(flat, dot.shape[1])
                    yield int(start[part[at[w]]]), int(stop[at[w]]), int(numbers[p]), float(dot[w, p] / norm[w])

    def search(self, text: pa.Array) -> list[tuple[int, int, float, float, float]]:
        """Row, item, cosine, share of the subsequence and of the answer, of everything verified."""
        row, code, _ = coded(text, self.vocab)
        found: dict[tuple[int, int], tuple[float, float, float]] = {}
        for a, b, p, cosine in self.windows(row, code):
            key = int(row[a]), self.items[p]
            if found.get(key, (0, 0, 0))[1] >= 0.999:
                continue
            passage, weights, total = self.passages[p]
            size = len(passage)
            a, b = max(0, a - size), min(len(row), b + size)
            around = [c for c, r in zip(code[a:b].tolist(), row[a:b].tolist(), strict=True) if r == key[0]]
            there = set(around)
            if sum([x for c, x in zip(passage, weights, strict=True) if c in there]) < PARAPHRASE * total:
                continue  # words in common bound the subsequence from above
            own = set(passage)
            share = weighted_lcs(passage, weights, [c for c in around if c in own]) / max(total, 1e-9)
            tail = slice(size - max(1, size // 4), size)
            answer = sum([x for c, x in zip(passage[tail], weights[tail], strict=True) if c in there]) / max(sum(weights[tail]), 1e-9)
            if share >= COVER or (share >= PARAPHRASE and answer >= ANSWER):
                found[key] = max(found.get(key, (0.0, 0.0, 0.0)), (cosine, share, answer), key=lambda x: (x[1], x[0]))
        return [(r, i, *x) for (r, i), x in found.items()]


def hits(index):
    """The search of batches of doc_id, text and h against a broadcast index."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, 4_000_000):
            found = index.value.search(batch.column(1))
            at = pa.array([x[0] for x in found], pa.int64())
            cols = [pa.array([x[j] for x in found], kind) for j, kind in ((1, pa.int64()), (2, pa.float64()), (3, pa.float64()), (4, pa.float64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()).take(at), *cols, batch.column(2).cast(pa.int64()).take(at)], names=["doc_id", "item_id", "cosine", "lcs_share", "answer_share", "h"])

    return rows


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, cosine, lcs_share and answer_share of every leak, and h (a hash of the row's text)."""
    spark = docs.sparkSession
    runs = cut(passages(benchmark.select("item_id", "text")))
    blocks, rest = max(1, -(-runs.count() // BLOCK)), docs.select("doc_id", "text", F.xxhash64("text").alias("h"))
    out = None
    for k in range(blocks):
        own = runs.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).toArrow()
        items, own = own["item_id"].to_pylist(), own["text"].to_pylist()
        vocab = vocabulary(own)
        idf, rare = inverse_frequencies(docs, vocab)
        for j in range(0, max(1, len(own)), PART):
            index = spark.sparkContext.broadcast(Index(items[j : j + PART], own[j : j + PART], vocab, idf, rare))
            part = rest.mapInArrow(hits(index), HITS + ", h long")
            out = part if out is None else out.union(part)
    return out


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs (all columns) that hold no item of the benchmark."""
    hit = cut(leaks(docs, benchmark).select("doc_id", "h").distinct()).alias("g")
    on = F.col("d.doc_id").eqNullSafe(F.col("g.doc_id")) & (F.xxhash64("d.text") == F.col("g.h"))
    return docs.alias("d").join(hit, on, "left_anti")
