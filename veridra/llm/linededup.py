"""Operator 9, fuzzy line dedup by MinHash (DataFrame and SQL functions only).

Lines are told apart by a 64-bit hash of their text. Signatures are made within a row, without exploding shingles.
A ring is the sorted hashes of a line's shingles; band j is the three hashes that follow anchor j on it (the three least
under the order that starts there, so two lines share a band with about the third power of their similarity). All lines
have a ring of their longer words, each with the start of the next. Lines of few words (up to SHORT characters, or long words) also
have one of all runs of RUN characters, those of up to TINY characters one of all five-character shingles; longer lines
have more bands of words. Of 300 pairs at 0.8 to 0.85 (short lines: 0.8 and more) at most three share no key, at any
length from one word to forty (`test_recall_by_line_length`). What is stored of a line is its place, its hash and its
keys, not its text.

Keys that hold two or more lines give pairs, verified by the exact Jaccard similarity of all their five-character
shingles and joined by distributed union-find in three turns, so groups of copies aren't paired out. First come pairs
that such a group is joined by (`stars`). Then, under keys of up to `hot` different lines (copies count once), all pairs
that are in different components yet and whose sketches leave it possible; last, among lines that larger keys tie together,
those of them that pass a prefix filter (`unsettled`). So
every pair that shares a key is checked, in one component already, or below the similarity for certain. Of each
component the line of the least doc_id and place stays.

Results: blank lines always stay and null text has no lines; rows that share a doc_id (or have none, which sorts
last) are told apart only by their lines' places: lines of one component at one place stay or go together.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veridra.llm.common import cut, small
from veridra.llm.graph import components

#: Hashes of a band, and characters of a shingle: of the similarity, and of the ring of short lines.
ROWS, SHINGLE, RUN = 3, 5, 8
#: Bands of the ring of words that all lines have, that the other lines have, and bands of the ring of runs.
COMMON, LONG_BANDS, RUN_BANDS = 6, 6, 10
#: Lines of up to SHORT characters, and those of fewer than one word in SPARSE characters, have the ring of runs.
SHORT, SPARSE = 160, 32
#: Words of fewer than LEAST characters give no shingle of their own: the commonest words are short, and three of those
#: together would be a key of a great many lines that have nothing else in common. A shingle is a word and the first
#: NEXT characters after it.
LEAST, NEXT = 5, 3
#: Lines of up to TINY characters have a third ring, of their shingles.
TINY = 32
SIMILARITY = 0.8
#: Keys of up to HOT different lines pair all of them: by sketches that costs less than one shingle of a line a pair.
HOT = 512
#: Words of 64 bits of a line's sketch.
SKETCH = 16
BLANKS = " \t\n\x0b\x0c\r"
NO_ID = "9223372036854775808"


def place(doc_id: Column, pos: Column) -> Column:
    """Order of lines: by doc_id, then by place in the text."""
    return (F.coalesce(doc_id.cast("decimal(20,0)"), F.lit(NO_ID).cast("decimal(20,0)")) * F.lit(10**10).cast("decimal(11,0)") + pos).cast("decimal(38,0)")


def lines(docs: DataFrame) -> DataFrame:
    """doc_id, pos, line and id for each line with a character that isn't white space."""
    each = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).where(F.ltrim("line", F.lit(BLANKS)) != "")  # btrim would list all characters of the line first
    return each.select("doc_id", "pos", "line", F.xxhash64("line").alias("id"))


def _let(value: Column, body) -> Column:
    """body(value), with the value worked out once: as a plain column it would be made anew at every use."""
    return F.get(F.transform(F.array(value), body), 0)


def shingles(line: Column, size: int = SHINGLE) -> Column:
    """Hashes of all runs of `size` characters of a line, repeats included; a shorter line is its own run."""
    wide = 4 * size  # in UTF-32 each character has four bytes, so a run is found without counting characters
    starts = lambda b: F.sequence(F.lit(1), F.greatest(F.length(b) - (wide - 1), F.lit(1)), F.lit(4))
    return _let(F.encode(line, "UTF-32"), lambda b: F.transform(starts(b), lambda i: F.xxhash64(F.substring(b, i, F.lit(wide)))))


def words(line: Column) -> Column:
    """Different hashes of the words of a line, each with the first NEXT characters of the word after it, but of the short ones."""
    shingle = lambda p: lambda x, i: F.when(F.length(x) >= LEAST, F.xxhash64(x, F.substring(F.get(p, i + 1), 1, NEXT))).otherwise(0)
    # zero stands for a short word: without nulls the arrays are sorted as plain longs, and one pass takes it and repeats out
    return F.array_except(_let(F.split(line, " "), lambda p: F.transform(p, shingle(p))), F.array(F.lit(0).cast("long")))


def marks(bands: int) -> list[int]:
    """Anchors on a ring of 64-bit hashes, spread evenly."""
    return [-(1 << 63) + j * ((1 << 64) // bands) + 1 for j in range(bands)]


def signed(docs: DataFrame) -> DataFrame:
    """doc_id, pos, id and keys (one for each band of each ring) of each line.

    The steps are separate projections: only what must runs interpreted. The last would be one generated method too
    long for the JIT compiler; a lambda beside it keeps Spark from fusing it, and then it is generated in parts."""
    line, ring = F.col("line"), {"w": marks(COMMON + LONG_BANDS), "c": marks(RUN_BANDS), "t": marks(RUN_BANDS)}
    out = lines(docs).select("doc_id", "pos", "id", line, F.length(line).alias("size"), words(line).alias("w"))
    short = (F.col("size") <= SHORT) | (F.size("w") * SPARSE < F.col("size"))
    none = F.slice(F.array(F.lit(0).cast("long")), 1, 0)  # of a type without nulls, so rings are sorted as plain longs
    runs = lambda size, where: F.when(where, F.array_distinct(shingles(line, size))).otherwise(none)
    out = out.select("doc_id", "pos", "id", "w", runs(RUN, short).alias("c"), runs(SHINGLE, F.col("size") <= TINY).alias("t"))
    anchors = {x: F.array(*map(F.lit, ring[x])) for x in ring}
    steps = [f(x) for x in ring for f in (
        lambda x: F.size(x).alias(f"n{x}"), lambda x: F.sort_array(F.concat(x, anchors[x])).alias(f"marked{x}"), lambda x: F.sort_array(x).alias(f"ring{x}"))]
    out = out.select("doc_id", "pos", "id", *steps)

    # an anchor's place is a column of its own: within a key it would be looked for once for each of the ROWS hashes
    place_of = lambda x, j: F.array_position(f"marked{x}", F.lit(ring[x][j])).cast("int") - (j + 1)
    at = [F.when(F.col(f"n{x}") > 0, place_of(x, j)).otherwise(0).alias(f"at{x}{j}") for x in ring for j in range(len(ring[x]))]
    apart = F.get(F.transform(F.array("pos"), lambda x: x), 0).alias("pos")
    out = out.select("doc_id", apart, "id", *(f"{c}{x}" for x in ring for c in ("n", "ring")), *at)

    def key(x: str, j: int) -> Column:
        n, at = F.col(f"n{x}"), F.col(f"at{x}{j}")
        turn = F.greatest(n, F.lit(1))
        # hashes are folded one by one, so this is the hash of a slice without making it; what a short ring lacks is null and skipped
        return F.xxhash64(F.lit(100 * "wct".index(x) + j), *(F.when(n > k, F.get(f"ring{x}", (at + k) % turn)) for k in range(ROWS)))

    # every other mark of the words' ring is common to all lines, so those are spread evenly too
    own, more = (F.array(*(key("w", j) for j in range(k, COMMON + LONG_BANDS, 2))) for k in (0, 1))
    run, tiny = (F.array(*(key(x, j) for j in range(RUN_BANDS))) for x in "ct")
    own = F.when(F.col("nw") >= ROWS, own).otherwise(none)  # fewer words than a band are no evidence; such lines have runs
    more = F.when(F.col("nt") > 0, F.concat(run, tiny)).when(F.col("nc") > 0, run).otherwise(more)
    return out.select("doc_id", apart, "id", F.concat(own, more).alias("keys"))


def grouped(signs: DataFrame, hot: int = HOT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pairs a < b of ids that have a key to themselves, and key and id of the members of smaller and of hot keys."""
    # keys are exchanged as they are: most are one line's alone, so next to none would fold before
    rows = signs.select("id", F.explode("keys").alias("key"))
    shared = cut(rows.repartition("key").groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("low"), F.max("id").alias("high")).where("low < high"))
    two = shared.where("n = 2").select(F.col("low").alias("a"), F.col("high").alias("b"))
    members = cut(rows.join(small(shared.where("n > 2").select("key")), "key", "left_semi").select("key", "id").distinct())
    members = cut(members.join(small(members.groupBy("key").agg(F.count("*").alias("n"))), "key"))
    return two, members.where(F.col("n") <= hot), members.where(F.col("n") > hot)


def candidates(signs: DataFrame, hot: int = HOT) -> DataFrame:
    """Pairs a < b of ids that share a band, of hot keys some; signs has id and keys."""
    two, few, many = grouped(signs, hot)
    return stars(two, few, many).union(paired(few)).distinct()


def stars(two: DataFrame, few: DataFrame, many: DataFrame) -> DataFrame:
    """Pairs that a group of like lines is joined by: under a smaller key each line with the least one, under a hot one
    each with one picked by hash, another one under each key."""
    least = few.groupBy("key").agg(F.min("id").alias("to"))
    picks = many.groupBy("key").agg(F.min_by("id", F.xxhash64("key", "id")).alias("to"))
    spokes = few.select("key", "id").join(least, "key").union(many.select("key", "id").join(small(picks), "key")).where("id != to")
    return two.union(spokes.select(F.least("id", "to").alias("a"), F.greatest("id", "to").alias("b"))).distinct()


def paired(few: DataFrame, links: DataFrame | None = None, drawn: DataFrame | None = None, similarity: float = SIMILARITY) -> DataFrame:
    """All pairs a < b under the smaller keys; with links (node, root) those of different components only. With drawn
    (sketches) those only that the sketches leave possible, with their `total`: a pair that isn't makes no row."""
    own = few.select("key", "id", F.col("id").alias("root"))
    if links is not None:
        own = few.join(links.withColumnRenamed("node", "id"), "id", "left").select("key", "id", F.coalesce("root", "id").alias("root"))
    if drawn is None:
        x, y = (own.select("key", F.col("id").alias(i), F.col("root").alias(r)) for i, r in (("a", "x"), ("b", "y")))
        return x.join(y, "key").where("a < b and x != y").select("a", "b").distinct()
    # only keys that tie different components have pairs left, and only their lines need a sketch
    mixed = own.groupBy("key").agg((F.min("root") < F.max("root")).alias("mixed")).where("mixed").select("key")
    own = cut(own.join(small(mixed), "key", "left_semi").join(drawn, "id"))
    x, y = own.alias("x"), own.alias("y")
    pairs = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.id") < F.col("y.id")) & (F.col("x.root") != F.col("y.root")) & possible("x.", "y.", similarity))
    return pairs.select(F.col("x.id").alias("a"), F.col("y.id").alias("b"), (F.col("x.size") + F.col("y.size")).alias("total")).distinct()


def similar(x: Column, y: Column, similarity: float) -> Column:
    """Whether x and y, the hashes of all shingles of two different lines with or without repeats, have that Jaccard similarity."""
    return F.size(F.array_intersect(x, y)) >= similarity * F.size(F.array_union(x, y))


def texts_of(ids: DataFrame, each: DataFrame) -> DataFrame:
    """id and line of those lines that have a shingle; each has id and line."""
    known = each.select("id", "line").join(small(ids), "id", "left_semi").groupBy("id").agg(F.any_value("line").alias("line"))
    return known.where(F.length("line") >= SHINGLE)


def sketches(known: DataFrame) -> DataFrame:
    """id, size (different shingles) and b0, b1, ...: a bit for each hash's place among 64 * SKETCH, set if an odd number of
    the line's shingles are there; known has id and line. A line's rows fold into one before they are exchanged."""
    h = F.col("h")
    each = known.where(F.length("line") >= SHINGLE).select("id", F.array_distinct(shingles(F.col("line"))).alias("s")).select("id", F.explode("s").alias("h"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(63).cast("int"))
    word = F.shiftrightunsigned(h, 6).bitwiseAND(SKETCH - 1)
    return each.groupBy("id").agg(F.count("*").alias("size"), *(F.bit_xor(F.when(word == k, bit).otherwise(0)).alias(f"b{k}") for k in range(SKETCH)))


def possible(x: str, y: str, similarity: float, size: str = "size") -> Column:
    """False only where the sketches of x and y (prefixes of columns) show their lines to be below `similarity`: shingles that
    both have cancel out, so at least as many as bits differ are in one of them alone."""
    apart = sum((F.bit_count(F.col(f"{x}b{k}").bitwiseXOR(F.col(f"{y}b{k}"))) for k in range(SKETCH)), F.lit(0))
    return apart * (1 + similarity) <= (F.col(x + size) + F.col(y + size)) * (1 - similarity) + 1e-6


def likely(pairs: DataFrame, drawn: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The pairs that the sketches (drawn) leave possible, with the total of their lines' different shingles; lines without
    a sketch have no shingle and no like."""
    x, y = (drawn.select(F.col("id").alias(i), *(F.col(c).alias(i + c) for c in drawn.columns[1:])) for i in "ab")
    return x.join(small(pairs), "a").join(y, "b").where(possible("a", "b", similarity)).select("a", "b", (F.col("asize") + F.col("bsize")).alias("total"))


def verified(pairs: DataFrame, known: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The pairs at `similarity` or more; known has id and line. Texts travel and sets are made where both
    meet, as a set is many times the size of its text. With a pair's `total` (different shingles of either line, added up)
    its union needn't be made: it is what the intersection leaves of the total."""
    known = known.where(F.length("line") >= SHINGLE)
    x, y = (known.select(F.col("id").alias(i), F.col("line").alias(t)) for i, t in (("a", "x"), ("b", "y")))
    both = x.join(small(pairs), "a").join(y, "b")  # the texts are exchanged once
    sets = F.struct(*(shingles(F.col(t)).alias(t) for t in "xy"))
    both = both.select(*pairs.columns, F.explode(F.array(sets)).alias("s"))  # no filter is moved below an explode, so sets are made once
    if "total" not in pairs.columns:
        return both.where(similar(F.col("s.x"), F.col("s.y"), similarity)).select("a", "b")
    common = F.size(F.array_intersect("s.x", "s.y"))
    return both.where(common >= F.col("total") * (similarity / (1 + similarity)) - 1e-6).select("a", "b")


def shingle_sets(ids: DataFrame, known: DataFrame) -> DataFrame:
    """id and s (the hashes of its shingles) of those lines; known has id and line."""
    known = known.where(F.length("line") >= SHINGLE).join(small(ids), "id", "left_semi").dropDuplicates(["id"])
    return known.select("id", F.array_distinct(shingles(F.col("line"))).alias("s"))


def families(many: DataFrame, links: DataFrame) -> DataFrame:
    """id, family and root: lines that hot keys tie together, directly or over others, are a family; those that are of one
    component (links has node and root) altogether are left out."""
    hub = many.groupBy("key").agg(F.min("id").alias("to"))
    tied = components(many.join(small(hub), "key").select("id", "to"), "id", "to").select(F.col("node").alias("id"), F.col("root").alias("family"))
    own = cut(tied.join(links.withColumnRenamed("node", "id"), "id", "left").select("id", "family", F.coalesce("root", "id").alias("root")))
    mixed = own.groupBy("family").agg((F.min("root") < F.max("root")).alias("mixed")).where("mixed").select("family")
    return cut(own.join(small(mixed), "family", "left_semi").select("id", "family", "root"))


def unsettled(many: DataFrame, links: DataFrame, sets_of: Callable[[DataFrame], DataFrame], similarity: float = SIMILARITY, drawn: DataFrame | None = None) -> DataFrame:
    """All pairs a < b of ids under one hot key that may be similar and aren't in one component of links (node, root) yet.
    With drawn (sketches) those only that the sketches leave possible, with their `total`.

    A line's prefix is the (1 - similarity) share of its shingles, and one more, that come first in an order common to
    its family; two lines without a common shingle in their prefixes are below `similarity` for certain. The order is by
    rarity in the family, so lines of one template meet by what differs in them; what more than half of a family has needs no row of its own. What comes before the first shingle that
    two lines have in common, either of them has alone; if that leaves too few, the pair is below too. Under a shingle,
    the largest component isn't paired within itself, so a group of near copies costs as many rows as lines lie outside
    of it."""
    own = families(many, links)
    sets = cut(sets_of(own.select("id")))
    rows = sets.join(small(own), "id")
    flat = rows.select("id", "family", F.explode("s").alias("s"))
    counts = cut(flat.groupBy("family", "s").agg(F.count("*").alias("f")).join(small(own.groupBy("family").agg(F.count("*").alias("m"))), "family"))
    # what most lines of a family have comes last, and is one list for the family: no line's shingles meet it one by one
    order = F.sort_array(F.collect_list(F.struct("f", "s")))["s"]
    common = counts.where("2 * f > m").groupBy("family").agg(order.alias("common"))
    # f and half of s in one long are sorted many times faster than pairs of them; shingles that agree in both (one pair in
    # 2^32) are taken for one another, which can only add pairs to be checked
    code = F.call_function("shiftleft", F.col("f"), F.lit(32)).bitwiseOR(F.col("s").bitwiseAND(0xFFFFFFFF))
    rare = flat.join(counts.where("2 * f <= m").drop("m"), ["family", "s"]).groupBy("id").agg(F.sort_array(F.collect_list(code)).alias("rare"))
    none = F.array().cast("array<bigint>")
    ranked = rows.join(small(common), "family", "left").join(rare, "id", "left")
    ranked = ranked.select("id", F.size("s").alias("n"), "family", "root", F.concat(F.coalesce("rare", none), F.array_intersect(F.coalesce("common", none), "s")).alias("all"))
    size = (F.floor(F.col("n") * (1 - similarity) + 1e-6) + 1).cast("int")
    lead = ranked.select("id", "n", "family", "root", F.slice("all", 1, size).alias("lead"))
    lead = cut(lead if drawn is None else lead.join(drawn.drop("size"), "id"))  # a sketch meets a line once, not each of its shingles
    prefix = lead.select(*(c for c in lead.columns if c != "lead"), F.posexplode("lead").alias("at", "s"))
    sizes = prefix.groupBy("family", "s", "root").agg(F.count("*").alias("n")).groupBy("family", "s")
    main = sizes.agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.count("*").alias("roots")).where("roots > 1")
    rows = cut(prefix.join(small(main), ["family", "s"]))
    x, y = rows.where("root != main").alias("x"), rows.alias("y")
    most = F.least(F.col("x.n") - F.col("x.at"), F.col("y.n") - F.col("y.at"))  # shingles in common
    near = (most * (1 + similarity) >= (F.col("x.n") + F.col("y.n")) * similarity - 1e-6) & (F.col("x.root") != F.col("y.root"))
    once = (F.col("y.root") == F.col("y.main")) | (F.col("x.id") < F.col("y.id"))
    if drawn is not None:
        near &= possible("x.", "y.", similarity, "n")
    pairs = x.join(y, (F.col("x.family") == F.col("y.family")) & (F.col("x.s") == F.col("y.s")) & near & once)
    total = [] if drawn is None else [(F.col("x.n") + F.col("y.n")).alias("total")]
    return pairs.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b"), *total).distinct()


def linked(signs: DataFrame, each: DataFrame, hot: int = HOT, similarity: float = SIMILARITY) -> DataFrame:
    """node and root of every line that is in a component with another: of all pairs at `similarity` that share a key."""
    groups = grouped(signs, hot)
    two, few, many = groups
    ids = two.select(F.explode(F.array("a", "b")).alias("id")).union(few.select("id")).union(many.select("id")).distinct()
    known = cut(texts_of(ids, each))
    drawn = cut(sketches(known))
    return joined(groups, lambda pairs: verified(pairs, known, similarity), lambda ids: shingle_sets(ids, known), similarity, drawn=drawn)


def joined(groups: tuple[DataFrame, DataFrame, DataFrame], check: Callable[[DataFrame], DataFrame], sets_of: Callable[[DataFrame], DataFrame], similarity: float = SIMILARITY, links: DataFrame | None = None, drawn: DataFrame | None = None) -> DataFrame:
    """node and root of the components of all pairs under the groups' keys that pass the check; links (node, root), if
    given, are known already; with drawn (the ids' sketches) the check gets possible pairs only. A turn's components are edges of the next one's, so none is worked out anew."""
    two, few, many = groups
    tried = stars(two, few, many)
    tried = cut(tried if links is None else apart(tried, links))
    links = added(links, cut(check(tried if drawn is None else likely(tried, drawn, similarity))))
    links = added(links, cut(check(paired(few, links, drawn, similarity).join(tried, ["a", "b"], "left_anti"))))
    if not many.limit(1).count():
        return links
    return added(links, cut(check(unsettled(many, links, sets_of, similarity, drawn).join(tried, ["a", "b"], "left_anti"))))


def apart(pairs: DataFrame, links: DataFrame) -> DataFrame:
    """The pairs whose ends aren't in one component of links."""
    x, y = (links.select(F.col("node").alias(i), F.col("root").alias(r)) for i, r in (("a", "x"), ("b", "y")))
    rows = pairs.join(small(x), "a", "left").join(small(y), "b", "left")
    return rows.where(~F.coalesce(F.col("x") == F.col("y"), F.lit(False))).select("a", "b")


def added(links: DataFrame | None, edges: DataFrame) -> DataFrame:
    """The components of links (node, root) and edges together."""
    if links is None:
        return cut(components(edges))
    if not edges.limit(1).count():
        return links
    return cut(components(links.select(F.col("node").alias("a"), F.col("root").alias("b")).union(edges)))


def removed(docs: DataFrame, hot: int = HOT, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id and gone (sorted places of the lines that go) for each doc_id that loses lines; null doc_id as one."""
    signs = cut(signed(docs))
    links = linked(signs, lines(docs), hot, similarity)
    spot = signs.select("doc_id", "pos", "id", place(F.col("doc_id"), F.col("pos")).alias("place"))
    first = spot.groupBy("id").agg(F.min("place").alias("first"), F.max("place").alias("final"))
    named = first.join(links.withColumnRenamed("node", "id"), "id", "left").where((F.col("first") < F.col("final")) | F.col("root").isNotNull())
    named = cut(named.select("id", "first", F.coalesce("root", "id").alias("root")))
    # a root with one line alone is its own best: the others are few, and no root gathers its lines in one task
    best = named.groupBy("root").agg(F.min("first").alias("best"), F.count("*").alias("n")).where("n > 1").select("root", "best")
    goes = named.join(small(best), "root", "left").select("id", F.coalesce("best", "first").alias("best"))
    out = spot.join(small(goes), "id").where(F.col("place") != F.col("best"))
    return out.groupBy("doc_id").agg(F.array_sort(F.collect_set("pos")).alias("gone"))


def report(docs: DataFrame, hot: int = HOT, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, n_lines (blank ones not counted), n_removed and removed (places, comma-joined) for each row of docs."""
    gone = cut(removed(docs, hot, similarity)).alias("g")
    n = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.ltrim(x, F.lit(BLANKS)) != ""))
    rows = docs.select("doc_id", n.cast("long").alias("n_lines")).alias("d")
    joined = rows.join(gone, F.col("d.doc_id").eqNullSafe(F.col("g.doc_id")), "left")
    return joined.select("d.doc_id", "n_lines", F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"), F.coalesce(F.array_join("gone", ","), F.lit("")).alias("removed"))


def dedup(docs: DataFrame, hot: int = HOT, similarity: float = SIMILARITY) -> DataFrame:
    """docs with the lines that go cut out of text; all rows and columns stay."""
    gone = cut(removed(docs, hot, similarity)).alias("g")
    left = F.filter(F.split("d.text", "\n"), lambda x, i: ~F.array_contains("g.gone", i))
    text = F.when(F.col("g.gone").isNull(), F.col("d.text")).otherwise(F.array_join(left, "\n"))
    joined = docs.alias("d").join(gone, F.col("d.doc_id").eqNullSafe(F.col("g.doc_id")), "left")
    return joined.select(*(text.alias("text") if c == "text" else F.col(f"d.`{c}`") for c in docs.columns))
