"""Operator 3, SimHash near-dedup by pigeonhole blocks.

Fingerprints are made in Python workers (bits are counted in byte lanes of 64-bit words). Rows of one fingerprint
fold into one before anything is joined. Fingerprints at two or fewer differing bits agree on two of four 16-bit
blocks, so each goes under six keys of 32 bits; pairs under a key are verified by their bit count. A key with more
than `hot` fingerprints isn't paired: its members are linked through midpoints instead, which is exact too: two
fingerprints within two bits share a value that differs from each in one bit at most, and all that share such a
value are within two bits of each other, so each is linked to the least of them only. Rows stay linear there.

`dedup`, the stage of a corpus pipeline, makes the same fingerprints, finds those within MAX_BITS by the same blocks and
links what the exact check confirms: a Jaccard similarity of SIMILARITY over five-word shingles. At that similarity
fingerprints differ in about ten of 64 bits, which no number of blocks finds at a bearable cost, so a second turn adds
what lies beyond the radius: MinHash ring bands of the shingles' hashes (as in linededup), for pairs that the
fingerprints haven't joined, with the same check. Sets are made for texts that have a candidate only.

Results: null or wordless text has fingerprint zero; every input row gives one output row; null doc_id never
becomes a component_id unless the component has no other; no rows give no rows. A very long text is one slice in a
worker. Columns besides doc_id and text are ignored by `near_duplicates`, and all kept by `dedup`, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veridra.llm import linededup
from veridra.llm.common import cut, small, text_slices, texts
from veridra.llm.graph import components

SEED, SHINGLE, MAX_BITS, HOT = 42, 3, 2, 64
#: Of dedup: words of a shingle, least Jaccard similarity, bands and hashes of each.
NEAR_SHINGLE, SIMILARITY, BANDS, ROWS = 5, 0.8, 12, 3
NEAR_HOT = 32
_ANCHORS = np.arange(BANDS, dtype=np.uint64) * np.uint64((1 << 64) // BANDS)
_LANES = np.uint64(0x0101010101010101)
_SHIFTS = np.arange(8, dtype=np.uint64)[:, None]


def shingle_hashes(text: str, size: int) -> np.ndarray:
    """Hashes of the runs of `size` words (of the whole text, if it has no more); none without words."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if n <= size:
        return np.array([digest(joined, SEED)] if n else [], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.r_[0, ends[: n - size] + 1]
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends[size - 1 :].tolist(), strict=True)], np.uint64)


def fingerprint(text: str) -> int:
    """Unsigned 64-bit fingerprint of a text."""
    h = shingle_hashes(text, SHINGLE)
    if len(h) < 2:
        return int(h[0]) if len(h) else 0
    counts = np.zeros((8, 8), np.int64)
    for k in range(0, len(h), 255 * 64):  # at most 255 values go into a byte lane
        part = h[k : k + 255 * 64]
        part = np.pad(part, (0, -len(part) % 255)).reshape(-1, 255)
        for lanes in part:
            counts += ((lanes[None, :] >> _SHIFTS) & _LANES).sum(axis=1, dtype=np.uint64).view(np.uint8).reshape(8, 8)
    bits = (counts * 2 > len(h)).astype(np.uint64)  # [bit of a byte, byte]
    return int((bits << (np.arange(8, dtype=np.uint64)[None, :] * np.uint64(8) + _SHIFTS)).sum(dtype=np.uint64))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_slices(batches):
        fp = np.array([fingerprint(t) for t in texts(batch)], np.uint64).view(np.int64)
        kept = [batch.column(batch.schema.get_field_index(c)).cast(pa.int64()) for c in ("doc_id", "row_hash")]
        yield pa.RecordBatch.from_arrays([*kept, pa.array(fp)], names=["doc_id", "row_hash", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, row_hash (of the text) and fp (the fingerprint as a signed long) for each row of docs."""
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("row_hash"))
    return rows.mapInArrow(_rows, "doc_id long, row_hash long, fp long")


def _block_keys(fp) -> list:
    block = [F.shiftrightunsigned(fp, 16 * k).bitwiseAND(F.lit(0xFFFF)) for k in range(4)]
    pairs = [(i, j) for i in range(4) for j in range(i + 1, 4)]
    return [F.lit(k).cast("long") * F.lit(1 << 32) + block[i] * F.lit(1 << 16) + block[j] for k, (i, j) in enumerate(pairs)]


def links(uniq: DataFrame, hot: int = HOT) -> DataFrame:
    """Edges a, b between distinct fingerprints (column fp) that connect all at MAX_BITS or fewer differing bits."""
    fp = F.col("fp")
    rows = uniq.select("fp", F.explode(F.array(*_block_keys(fp))).alias("k"))
    sizes = rows.groupBy("k").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    members = cut(rows.join(sizes, "k"))
    few, many = members.where(F.col("n") <= hot), members.where(F.col("n") > hot).select("fp").distinct()
    pairs = few.select("k", fp.alias("a")).join(few.select("k", fp.alias("b")), "k").where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_BITS)).select("a", "b")
    around = many.select("fp", F.explode(F.array(fp, *(fp.bitwiseXOR(F.lit((1 << k) if k < 63 else -(1 << 63))) for k in range(64)))).alias("mid"))
    centre = around.groupBy("mid").agg(F.min("fp").alias("low"), F.count("*").alias("n")).where(F.col("n") > 1)
    stars = around.join(centre, "mid").where(fp != F.col("low")).select(fp.alias("a"), F.col("low").alias("b"))
    return pairs.union(stars).distinct()


def classes(prints: DataFrame, hot: int = HOT) -> DataFrame:
    """The rows of prints (columns doc_id and fp, maybe more) with root, a name of the component, and component_id."""
    uniq = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    named = uniq.join(components(links(uniq, hot)).withColumnRenamed("node", "fp"), "fp", "left")
    least = named.where("root is not null").groupBy("root").agg(F.min("first").alias("least"))  # a fingerprint alone is its own
    component = F.when(F.col("root").isNull(), F.col("first")).otherwise(F.col("least"))
    named = named.join(small(least), "root", "left").select("fp", F.coalesce("root", "fp").alias("root"), component.alias("component_id"))
    return prints.join(named, "fp")


def near_duplicates(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (the least doc_id reachable) for each row of docs."""
    return classes(cut(fingerprints(docs)), hot).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import xxhash

    for batch in text_slices(batches):
        prints, ids, keys = [], [], []
        for text in texts(batch):
            h = np.unique(shingle_hashes(text, NEAR_SHINGLE))
            prints.append(fingerprint(text))
            ids.append(xxhash.xxh64_intdigest(h.tobytes(), SEED))  # texts of one set are one node
            if len(h):
                at = (np.searchsorted(h, _ANCHORS)[:, None] + np.arange(min(ROWS, len(h)))) % len(h)
                keys.append(np.array([xxhash.xxh64_intdigest(h[a].tobytes(), j) for j, a in enumerate(at)], np.uint64).view(np.int64))
            else:
                keys.append(np.zeros(0, np.int64))
        kept = [batch.column(batch.schema.get_field_index(c)).cast(pa.int64()) for c in ("doc_id", "row_hash")]
        made = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (prints, ids)]
        yield pa.RecordBatch.from_arrays([*kept, *made, pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "row_hash", "fp", "id", "keys"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_slices(batches):
        sets = [np.unique(shingle_hashes(text, NEAR_SHINGLE)).view(np.int64) for text in texts(batch)]
        yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("id")), pa.array(sets, pa.list_(pa.int64()))], names=["id", "s"])


def shingle_sets(rows: DataFrame, signs: DataFrame, ids: DataFrame) -> DataFrame:
    """id and s (the hashes of its shingles) of those nodes, of one text each; signs has doc_id, row_hash and id of rows."""
    one = signs.join(small(ids), "id", "left_semi").groupBy("id").agg(F.min(F.struct("doc_id", "row_hash")).alias("row"))
    named = rows.join(small(one.select("id", "row.doc_id", "row.row_hash")), ["doc_id", "row_hash"]).select("id", "text")
    return named.mapInArrow(_sets, "id long, s array<long>").dropDuplicates(["id"])


def print_pairs(prints: DataFrame, hot: int = HOT) -> DataFrame:
    """Pairs a < b of ids that join all whose fingerprints link: those of one fingerprint with the least of them, and the
    least of two linked fingerprints; prints has fp and id."""
    first = cut(prints.groupBy("fp").agg(F.min("id").alias("to")))
    own = prints.join(first, "fp").select("id", "to")
    a, b = (first.select(F.col("fp").alias(x), F.col("to").alias(t)) for x, t in (("a", "id"), ("b", "to")))
    pairs = own.union(cut(links(first.select("fp"), hot)).join(a, "a").join(b, "b").select("id", "to")).where("id != to")
    return pairs.select(F.least("id", "to").alias("a"), F.greatest("id", "to").alias("b")).distinct()


def alike(pairs: DataFrame, sets: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The pairs of a and b whose sets (columns id and s) have that Jaccard similarity."""
    x, y = (sets.select(F.col("id").alias(i), F.col("s").alias(s)) for i, s in (("a", "x"), ("b", "y")))
    both, n, m = F.size(F.array_intersect("x", "y")), F.size("x"), F.size("y")
    fit = F.least(n, m) >= similarity * F.greatest(n, m) - 1e-6
    return pairs.join(x, "a").join(y, "b").where(fit & (both / (n + m - both) >= similarity)).select("a", "b")


def near_classes(docs: DataFrame, hot: int = NEAR_HOT) -> DataFrame:
    """doc_id, row_hash and root (a name of the component of near copies) for each row of docs."""
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("row_hash"))
    signs = cut(rows.mapInArrow(_signed, "doc_id long, row_hash long, fp long, id long, keys array<long>"))
    near = cut(print_pairs(signs.select("fp", "id").distinct()))
    groups = linededup.grouped(signs.groupBy("id").agg(F.any_value("keys").alias("keys")), hot)
    two, few, many = groups
    ends = lambda pairs: pairs.select(F.explode(F.array("a", "b")).alias("id"))
    sets = cut(shingle_sets(rows, signs, ends(near).union(ends(two)).union(few.select("id")).union(many.select("id")).distinct()))
    check = lambda pairs: alike(pairs, sets)
    found = linededup.added(None, cut(check(near)))
    found = linededup.joined(groups, check, lambda ids: sets.join(ids, "id", "left_semi"), SIMILARITY, found)
    return signs.select("doc_id", "row_hash", "id").join(found.withColumnRenamed("node", "id"), "id", "left").select("doc_id", "row_hash", F.coalesce("root", "id").alias("root"))


def dedup(docs: DataFrame, hot: int = NEAR_HOT) -> DataFrame:
    """docs with one row of each component of near copies: the one with the least doc_id (then the least hash of its text).

    Rows without doc_id stay. Only the ids that go are joined to the texts (Spark broadcasts them while they are
    few). Rows that repeat both doc_id and text are folded to one, which shuffles texts and so happens only where
    such rows exist.
    """
    prints = cut(docs.where("doc_id is not null").select("doc_id", F.xxhash64("text").alias("row_hash")))
    named = near_classes(docs.where("doc_id is not null"), hot).select("root", F.struct("doc_id", "row_hash").alias("row"))
    named = cut(named)
    best = named.groupBy("root").agg(F.min("row").alias("best"), F.count("*").alias("n")).where("n > 1").select("root", "best")
    gone = named.join(small(best), "root").where(F.col("row") != F.col("best")).select("row.doc_id", "row.row_hash").distinct()
    on = (docs["doc_id"] == gone["doc_id"]) & (F.xxhash64(docs["text"]) == gone["row_hash"])
    kept = docs.join(gone, on, "left_anti")
    ids = prints.groupBy("doc_id", "row_hash").count()
    if ids.where("count > 1").limit(1).count():
        kept = kept.where("doc_id is not null").dropDuplicates(["doc_id", "text"]).union(kept.where("doc_id is null"))
    return kept
