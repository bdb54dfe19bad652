"""Read-only profiles: duplicates, nulls, words for nothing, kinds of columns, order and spread. Each is one aggregate
query over all rows; only the samples are limited, as that is their purpose."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veridra.functions.text import let, number, strip, text, true, zfill
from veridra.operators.dates import spelling, value_of
from veridra.rules import PROCESSING_CODES

# Texts that mean "nothing", fillers, keys by which the same purchase is found again, and sample size.
PLACEHOLDERS = (
    "", "-", "--", "?", "#N/A", "N/A", "NA", "NAN", "NONE", "NULL", "MISSING", "UNKNOWN",
    "0000-00-00", "0000-00-00 00:00:00", "1970-01-01", "1970-01-01 00:00:00",
)
SENTINEL = r"(?i)^(?:0+|X+|9+|-+)$"
DUPLICATE_KEYS = (
    ("ACCOUNT_ID", "TXN_DATE_TIME", "TXN_AMOUNT", "MERCHANT_NAME"),
    ("ACCOUNT_ID", "TXN_DATE_TIME", "TXN_AMOUNT"),
    ("ACCOUNT_ID", "TXN_AMOUNT", "MERCHANT_NAME", "AUTH_CODE"),
)
SAMPLE = 10


def raw_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if not c.startswith("_")]


def by_column(df: DataFrame, values: dict[str, dict[str, Column]]) -> DataFrame:
    """A row for each column of df, with the aggregates given for it, from one pass."""
    names = list(next(iter(values.values())))
    flat = [v.alias(f"{i}_{j}") for i, own in enumerate(values.values()) for j, v in enumerate(own.values())]
    row = df.agg(*flat)
    cells = [F.struct(F.lit(c).alias("column"), *(F.col(f"{i}_{j}").alias(n) for j, n in enumerate(names))) for i, c in enumerate(values)]
    return row.select(F.inline(F.array(*cells)))


def pct(n: Column, total: Column) -> Column:
    return F.when(total > 0, F.round(100.0 * n / total, 2)).otherwise(F.lit(0.0))


def absent(c: Column) -> Column:
    """Whether a text cell holds a word or filler for nothing."""
    v = strip(c)
    return true(F.upper(v).isin(*PLACEHOLDERS) | v.rlike(SENTINEL))


def duplicates(df: DataFrame, id_col: str = "TXN_ID") -> DataFrame:
    """metric and value: repeated rows and ids, and business keys repeated outside whole repeats."""
    cols = raw_columns(df)
    rows = df.groupBy(*cols).agg(F.count("*").alias("_n"))  # whole repeats fold before anything else is counted
    n = F.col("_n")
    parts = [rows.agg(
        F.coalesce(F.sum(F.when(n > 1, n)), F.lit(0)).alias("full_row_rows"), F.coalesce(F.sum(n - 1), F.lit(0)).alias("full_row_removable"), F.count_distinct(id_col).alias("n_unique_ids"),
    ).select(F.expr("stack(3, 'full_row_rows', full_row_rows, 'full_row_removable', full_row_removable, 'n_unique_ids', n_unique_ids) AS (metric, value)"))]
    for name, keys in [("id_collision_rows", (id_col,)), *((" + ".join(k), k) for k in DUPLICATE_KEYS)]:
        if set(keys) <= set(cols):
            own = rows.groupBy(*keys).agg(F.sum("_n").alias("all"), F.sum(F.when(n == 1, 1).otherwise(0)).alias("single"))
            parts.append(own.agg(F.coalesce(F.sum(F.when(F.col("all") > 1, F.col("single"))), F.lit(0)).alias("value")).select(F.lit(name).alias("metric"), "value"))
    return reduce(DataFrame.union, parts)


def samples(df: DataFrame, flagged: Column, columns: list[str], order: str, size: int = SAMPLE) -> DataFrame:
    """The first rows that are flagged: a top-k, not a sort of them all."""
    return df.where(flagged).orderBy(order).select(*columns).limit(size)


def nulls(df: DataFrame) -> DataFrame:
    """column, n and pct of the columns with nulls, and the same of rows with any (column '*')."""
    cols = raw_columns(df)
    some = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in cols])
    values = {c: {"n": F.count_if(F.col(c).isNull()), "total": F.count("*")} for c in cols} | {"*": {"n": F.count_if(some), "total": F.count("*")}}
    return by_column(df, values).where("n > 0").select("column", "n", pct(F.col("n"), F.col("total")).alias("pct"))


def missing(df: DataFrame) -> DataFrame:
    """column, n, pct and tokens (up to five seen) of the columns with words for nothing; rows with any as '*'."""
    cols = raw_columns(df)
    some = reduce(lambda a, b: a | b, [absent(F.col(c)) for c in cols])
    seen = lambda c: F.array_join(F.slice(F.array_sort(F.collect_set(F.when(absent(F.col(c)), F.col(c)))), 1, 5), "|")
    values = {c: {"n": F.count_if(absent(F.col(c))), "total": F.count("*"), "tokens": seen(c)} for c in cols}
    values["*"] = {"n": F.count_if(some), "total": F.count("*"), "tokens": F.max(F.lit(""))}
    return by_column(df, values).where("n > 0").select("column", "n", pct(F.col("n"), F.col("total")).alias("pct"), "tokens")


def lenient(v: Column) -> Column:
    """For looking only: epoch seconds as UTC, then any spelling of step 1; null beyond the year 2261, as nanoseconds end."""
    seconds = F.expr("timestamp_ntz'1970-01-01 00:00:00'") + F.make_dt_interval(secs=v.try_cast("long").cast("decimal(18,6)"))
    return let(F.when(v.rlike(r"^\d{9,10}$"), seconds).otherwise(value_of(v, spelling(v))), lambda x: F.when(F.year(x) <= 2261, x))


def column_kinds(df: DataFrame) -> DataFrame:
    """column, filled, numeric_pct, date_pct and reads_as, over all rows."""
    cols = raw_columns(df)
    filled = lambda c: text(F.col(c)) != ""
    share = lambda c, p: F.coalesce(F.avg(F.when(filled(c), F.when(p, 1.0).otherwise(0.0))), F.lit(0.0))
    values = {c: {"filled": F.count_if(filled(c)), "numeric": share(c, number(F.col(c)).isNotNull()), "date": share(c, spelling(text(F.col(c))).isNotNull())} for c in cols}
    kind = F.when(F.col("filled") == 0, "empty").when(F.col("numeric") > 0.99, "numeric").when(F.col("date") > 0.99, "date").otherwise("mixed/text")
    return by_column(df, values).select("column", "filled", F.round(F.col("numeric") * 100, 1).alias("numeric_pct"), F.round(F.col("date") * 100, 1).alias("date_pct"), kind.alias("reads_as"))


def gaps(df: DataFrame) -> DataFrame:
    """column, blank, placeholder, sentinel, total_absent and pct."""
    values = {}
    for c in raw_columns(df):
        v = text(F.col(c))
        word, filler = (v != "") & F.upper(v).isin(*PLACEHOLDERS), (v != "") & v.rlike(SENTINEL)
        values[c] = {"blank": F.count_if(v == ""), "placeholder": F.count_if(word), "sentinel": F.count_if(filler), "total_absent": F.count_if((v == "") | word | filler), "rows": F.count("*")}
    return by_column(df, values).select("column", "blank", "placeholder", "sentinel", "total_absent", pct(F.col("total_absent"), F.col("rows")).alias("pct"))


def patterns(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """pattern (columns blank together, comma-joined) and rows."""
    blank = [F.when(text(F.col(c)) == "", F.lit(c)) for c in columns or raw_columns(df)]
    return df.groupBy(F.concat_ws(",", *blank).alias("pattern")).agg(F.count("*").alias("rows"))


def repeated(df: DataFrame, keys: dict[str, tuple[str, ...]]) -> DataFrame:
    """name and extra: rows beyond the first of each key."""
    parts = [df.groupBy(*k).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("extra")).select(F.lit(name).alias("name"), "extra") for name, k in keys.items()]
    return reduce(DataFrame.union, parts)


def cardinality(df: DataFrame) -> DataFrame:
    """column, distinct and least (the least value that isn't blank, as an example)."""
    return by_column(df, {c: {"distinct": F.count_distinct(c), "least": F.min(F.when(text(F.col(c)) != "", F.col(c)))} for c in raw_columns(df)})


def value_counts(df: DataFrame, columns: list[str], most: int = 30) -> DataFrame:
    """column, value and rows of the columns that hold up to `most` values."""
    few = cardinality(df.select(*columns)).where(F.col("distinct") <= most).select("column")
    parts = [df.groupBy(F.col(c).alias("value")).agg(F.count("*").alias("rows")).select(F.lit(c).alias("column"), "value", "rows") for c in columns]
    return reduce(DataFrame.union, parts).join(few, "column", "left_semi")


def code_pairs(df: DataFrame) -> DataFrame:
    """code (padded), label, rows, and standing: known, or new to the rule file; codes not met come as unused."""
    code = zfill(text(F.col("PROCESSING_CODE")), 2)
    pairs = df.groupBy(code.alias("code"), F.col("PROCESSING_TYPE").alias("label")).agg(F.count("*").alias("rows"))
    known = df.sparkSession.createDataFrame([(c,) for c in PROCESSING_CODES], "code string")
    unused = known.join(pairs, "code", "left_anti").select("code", F.lit(None).cast("string").alias("label"), F.lit(0).cast("long").alias("rows"), F.lit("unused").alias("standing"))
    return pairs.withColumn("standing", F.when(F.col("code").isin(*PROCESSING_CODES), "known").otherwise("new")).union(unused)


def blocks(df: DataFrame, group: str, order: str) -> DataFrame:
    """groups, blocks (runs of one group in order) and interleaved.

    Runs are counted within ranges of the order, then at their seams, so no task sorts the whole table.
    """
    rows = df.select(F.col(group).alias("g"), F.col(order).alias("o"))
    spread = rows.repartitionByRange("o").sortWithinPartitions("o").withColumn("p", F.spark_partition_id())
    own = Window.partitionBy("p").orderBy("o")
    inner = spread.withColumn("new", ~F.col("g").eqNullSafe(F.lag("g").over(own))).withColumn("first", F.row_number().over(own) == 1)
    parts = inner.groupBy("p").agg(F.count_if(F.col("new") & ~F.col("first")).alias("turns"), F.min_by("g", "o").alias("head"), F.max_by("g", "o").alias("tail"), F.min("o").alias("o"))
    seams = parts.withColumn("before", F.lag("tail").over(Window.orderBy("o"))).withColumn("k", F.row_number().over(Window.orderBy("o")))  # a row for each range
    total = seams.agg(F.sum(F.col("turns") + F.when((F.col("k") > 1) & F.col("head").eqNullSafe(F.col("before")), 0).otherwise(1)).alias("blocks"))
    return rows.agg(F.count_distinct("g").alias("groups")).crossJoin(total).select("groups", "blocks", (F.col("blocks") != F.col("groups")).alias("interleaved"))


def monotonic(df: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """n_groups and n_monotonic: groups whose value never falls in order."""
    own = Window.partitionBy(group).orderBy(order)
    steps = df.where(F.col(value).isNotNull()).select(group, (F.col(value) >= F.lag(value).over(own)).alias("up"))
    by = steps.groupBy(group).agg(F.bool_and(F.coalesce("up", F.lit(True))).alias("ok"))
    return by.agg(F.count("*").alias("n_groups"), F.count_if("ok").alias("n_monotonic"))


def shape(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"\d", "9"), "[A-Za-z]", "A")


def backwards(df: DataFrame, group: str, order: str, time: str, raw: str, top: int | None = 10) -> DataFrame:
    """shape and rows_out_of_order: the spellings of rows that go back in time; the commonest `top`."""
    own = Window.partitionBy(group).orderBy(order)
    rows = df.where(F.col(time).isNotNull()).select(shape(F.col(raw)).alias("shape"), (F.col(time) < F.lag(time).over(own)).alias("back"))
    out = rows.where("back").groupBy("shape").agg(F.count("*").alias("rows_out_of_order"))
    return out.orderBy(F.desc("rows_out_of_order"), "shape").limit(top) if top else out


def months(df: DataFrame, group: str, time: str) -> DataFrame:
    return df.where(F.col(time).isNotNull()).groupBy(group, F.date_format(time, "yyyy-MM").alias("month")).agg(F.count("*").alias("rows"))


def spread(df: DataFrame, group: str, value: str) -> DataFrame:
    """group, size, min, median and max of the values that are plain numbers."""
    v = number(F.col(value))
    return df.groupBy(group).agg(F.count("*").alias("size"), F.min(v).alias("min"), F.median(v).alias("median"), F.max(v).alias("max"))


def spearman(df: DataFrame, group: str, a: str, b: str, least: int = 3) -> DataFrame:
    """group, n and rho: rank correlation of two columns within each group of `least` rows or more."""
    both = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())

    def rank(c: str) -> Column:  # ties share the mean of their ranks
        own = Window.partitionBy(group)
        return F.rank().over(own.orderBy(c)) + (F.count("*").over(Window.partitionBy(group, c)) - 1) / 2.0

    ranked = both.select(group, rank(a).alias("ra"), rank(b).alias("rb"))
    return ranked.groupBy(group).agg(F.count("*").alias("n"), F.round(F.corr("ra", "rb"), 9).alias("rho")).where(F.col("n") >= least)
