"""Steps on known awkward values: each case is a raw value and what must come out."""

import collections
import datetime

import pytest
from pyspark.sql import functions as F

from veridra.functions.text import fold, number, text, zfill
from veridra.operators import amounts, dates, duplicates, geo, macro, mcc, merchant, missing, timestamps
from veridra.operators.codes import CodeNormalizer
from veridra.operators.consistency import ConsistencyValidator
from veridra.plans.pipeline import TransactionCleaner, build_sheets
from veridra.rules import alias_table


def column(spark, values, expr):
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v string")
    return [r[0] for r in rows.orderBy("k").select(expr(F.col("v"))).collect()]


def test_text_functions(spark):
    assert column(spark, [" a\t", None, "  b "], text) == ["a", "", "b"]
    assert column(spark, ["5", "", "-5", "1234"], lambda v: zfill(v, 3)) == ["005", "000", "-05", "1234"]
    assert column(spark, ["1.5", "12d", "nan", "", None, "-.5", "1e3"], number) == [1.5, None, None, None, None, -0.5, 1000.0]
    assert column(spark, ["café ñandú São", "ab́"], fold) == ["CAFE NANDU SAO", "AB"]


def test_dates(spark):
    cases = {
        "2022-03-10 00:51:36": "2022-03-10 00:51:36", "2022-03-13": "2022-03-13 00:00:00", "09/07/2022 17:49": "2022-07-09 17:49:00", "15/06/2022 09:40": "2022-06-15 09:40:00",
        "04-22-2022 22:52": "2022-04-22 22:52:00", "23-Apr-22": "2022-04-23 00:00:00", "1660775652000": "2022-08-17 22:34:12", "23-APR-75 10:11": "1975-04-23 10:11:00",
        "March 3rd 2022": None, "2022-03-10T00:51:36": None, "31/02/2022": None, "22-04-2022": None, "0000-00-00": None, "": None, "23-Xyz-22": None, "2022-13-01": None,
    }
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(cases)], "k int, TXN_DATE_TIME string")
    got = dates.DateNormalizer()(rows).orderBy("k").select(F.date_format("TXN_DATE_TIME_CLEANED", "yyyy-MM-dd HH:mm:ss")).collect()
    assert [r[0] for r in got] == list(cases.values())


AMOUNTS = [
    ("-104.39", "USD", -104.39), ("(808.41)", "USD", -808.41), ("(2326526.00)", "USD", -2326526.0), ("1,193.50", "USD", 1193.5), ("172,22", "EUR", 172.22), ("5.727.580,00", "LBP", 5727580.0),
    ("291,75", "EUR", 291.75), ("10037714", "LBP", 10037714.0), ("-1968163", "LBP", -1968163.0), ("1,500", "LBP", 1500.0), ("1,500", "USD", 1.5), ("1500.000", "LBP", 1500000.0), ("n/a", "USD", None), ("", "USD", None),
    ("1e5", "USD", 15.0), ("-(5)", "USD", None), ("(-5)", "USD", -5.0), ("5-", "USD", None), ("1.2.3,4,5", "USD", None), (None, "USD", None), ("1,234,567", None, 1234567.0), (".5", "USD", 0.5), ("--5", "USD", 5.0),
]


def test_amounts(spark):
    rows = spark.createDataFrame([(k, a, c) for k, (a, c, _) in enumerate(AMOUNTS)], "k int, v string, c string")
    got = rows.orderBy("k").select(amounts.parse(F.col("v"), F.col("c"))).collect()
    assert [r[0] for r in got] == [x for *_, x in AMOUNTS]


def test_signs(spark):
    rows = spark.createDataFrame([("409.34", "Purchase"), ("-5", "Purchase"), ("-7", "Purchase Return/Refund"), ("3", None)], "TXN_AMOUNT string, PROCESSING_TYPE_CLEANED string")
    got = {r.TXN_AMOUNT: (r.TXN_AMOUNT_CLEANED, r.VALIDATION_FLAGS) for r in amounts.AmountNormalizer()(rows).collect()}
    assert got == {"409.34": (-409.34, "AMOUNT_SIGN_RESTORED"), "-5": (-5.0, ""), "-7": (7.0, "AMOUNT_SIGN_RESTORED"), "3": (-3.0, "AMOUNT_SIGN_RESTORED")}


NAMES = [
    ("SQ *TAKEALOT", "TAKEALOT", "SQ"), ("WPY*SAUDIA  AIRLINES", "SAUDIA AIRLINES", "WPY"), ("COURSERA.COM *W2PA", "COURSERA", ""), ("XOOMTRANSFER.COM *1467", "XOOMTRANSFER", ""),
    ("WPY*DEUTSCHE  BAHN *TNAS", "DEUTSCHE BAHN", "WPY"), ("AMERICAN UNIVERSITY BR", "AMERICAN UNIVERSITY", ""), ("CREPAWAY BR 306", "CREPAWAY", ""), ("7 ELEVEN", "7 ELEVEN", ""), ("REPSOL #70 *4GK9", "REPSOL", ""),
    ("DUBAI MN /ufw", "DUBAI MN", ""), ("ECOM/LULU HYPERMARKET", "LULU HYPERMARKET", ""), ("TRM:31659ZAATARWZEIT", "ZAATARWZEIT", ""), ("H AND M/REF162491", "H AND M", ""), (None, "", ""), ("  ", "", ""), ("12 34", "12 34", ""),
]


def test_merchants(spark):
    rows = spark.createDataFrame([(k, v) for k, (v, *_) in enumerate(NAMES)], "k int, m string")
    got = merchant.cleaned(rows, "m").orderBy("k").select("_name", "_prefix").collect()
    assert [tuple(r) for r in got] == [(n, p) for _, n, p in NAMES]
    with pytest.raises(ValueError):
        alias_table({"A": {"aliases": ["X"]}, "B": {"aliases": ["X"]}})


def test_traps_are_found(spark):
    rows = spark.createDataFrame([("WAITROSE",), ("WATERSTONES",)], "MERCHANT_NAME string")
    merged = merchant.MerchantCleaner(master={"WAITROSE": {"aliases": ["WATERSTONES"]}})(rows)
    found = {r.id: (r.members_seen, r.merged) for r in merchant.trap_violations(merged, (("w", ("WAITROSE", "WATERSTONES")),)).collect()}
    assert found == {"w": (2, True)}


def test_duplicates(spark):
    rows = spark.createDataFrame([(0, "1", "2022-01-02"), (1, "1", "2022-01-01"), (2, "2", "2022-01-03"), (3, "2", "2022-01-03")], "_row_ix long, TXN_ID string, TXN_DATE_TIME_CLEANED string")
    out = duplicates.DuplicateCleaner()(rows)
    assert sorted((r._row_ix, r.TXN_ID_CLEANED) for r in out.collect()) == [(0, "1_2"), (1, "1_1"), (2, "2")]


def test_missing(spark):
    codes = spark.createDataFrame([("ZZ0011",), ("ZZ0011",), ("UNIQ01",), ("000000",), (None,)], "AUTH_CODE string")
    assert sorted((r.AUTH_CODE or "", r.AUTH_CODE_VALID) for r in missing.MissingValueHandler()(codes).collect()) == [("", False), ("000000", False), ("UNIQ01", True), ("ZZ0011", False), ("ZZ0011", False)]
    days = spark.createDataFrame([("2022-03-10 00:51:36", s) for s in ("2022-03-12", "0000-00-00", "2022-03-09")], "TXN_DATE_TIME string, SETTLE_DATE string")
    got = missing.MissingValueHandler()(dates.DateNormalizer()(days)).collect()
    assert {r.SETTLE_DATE: r.SETTLE_DATE_STATUS for r in got} == {"2022-03-12": "OBSERVED", "0000-00-00": "UNKNOWN", "2022-03-09": "ANOMALOUS"}


def test_geo(spark):
    rows = spark.createDataFrame([("BEIRUT", "TR"), ("", "LB"), (None, None), ("Ecom", "us"), ("INTERNAL", "LB"), ("Nowhere", "fr")], "MERCHANT_CITY string, MERCHANT_COUNTRY string")
    got = [(r.MERCHANT_CITY_CLEANED, r.LOCATION_TYPE, r.IS_ECOMMERCE, r.MERCHANT_COUNTRY_EXPECTED, r.MERCHANT_COUNTRY_CLEANED) for r in geo.CityNormalizer()(rows).collect()]
    assert got == [("BEIRUT", "PHYSICAL", False, "LB", "LB"), ("UNKNOWN", "UNKNOWN", False, "", "LB"), ("UNKNOWN", "UNKNOWN", False, "", "UNKNOWN"), ("INTERNET", "ECOMMERCE", True, "", "US"), ("INTERNAL", "INTERNAL", False, "", "LB"), ("NOWHERE", "PHYSICAL", False, "", "FR")]


def test_mcc_decisions(spark):
    cases = {
        "a": ({"5999": 7, "8220": 3}, "8220", "catch_all_override", "MEDIUM"), "b": ({"5812": 2, "5651": 2}, "5651", "suspect_tiebreak", "MEDIUM"), "c": ({"5411": 2, "5732": 2}, None, "unresolved_tie", "PENDING"),
        "d": ({"4511": 7, "5651": 1}, "4511", "majority", "HIGH"), "e": ({"4511": 2, "5651": 1}, None, "weak_majority", "PENDING"), "f": ({"5411": 9}, None, "consistent", "HIGH"), "g": ({"5812": 4, "5999": 4}, "5812", "catch_all_override", "MEDIUM"),
        "PRET A MANGER": ({"5814": 3, "5812": 1}, "5812", "curated", "HIGH"),
    }
    rows = [(m, c, n, k) for m, (counts, *_) in cases.items() for k, (c, n) in enumerate(counts.items())]
    got = {r.merchant: (r.mcc, r.signal, r.confidence) for r in mcc.decisions(spark.createDataFrame(rows, "merchant string, code string, n long, first long")).collect()}
    assert got == {m: tuple(x) for m, (_, *x) in cases.items()}


def test_binomial_tail(spark):
    from math import comb

    cases = [(8, 2, 7), (3, 2, 2), (11, 2, 8), (500, 3, 200), (1, 2, 1)]
    rows = spark.createDataFrame(cases, "n long, k long, h long")
    got = [r[0] for r in rows.select(mcc.binomial_tail(F.col("n"), F.col("k"), F.col("h"))).collect()]
    for (n, k, h), p in zip(cases, got, strict=True):
        want = sum(comb(n, i) * (k - 1) ** (n - i) for i in range(h, n + 1)) / k**n
        assert p == pytest.approx(want, rel=1e-9)
    huge = spark.createDataFrame([(10**9, 2, 5 * 10**8 + 10**5)], "n long, k long, h long").select(mcc.binomial_tail(F.col("n"), F.col("k"), F.col("h"))).first()[0]
    assert 0 < huge < 1e-9


def test_consistency(spark):
    rows = spark.createDataFrame([("-1193.50", "0.268572", "-320.54"), ("-16545.0", "0.268572", "-4400.0"), ("-154.77", "1", "-1.55")], "a string, FX_RATE string, BILLING_AMOUNT string").withColumn("TXN_AMOUNT_CLEANED", F.col("a").cast("double"))
    assert [r.VALIDATION_FLAGS for r in ConsistencyValidator()(rows).collect()] == ["", "", "FX_RECONCILE_MISMATCH"]
    rates = spark.createDataFrame([("LBP", str(1 / 1507.5)), ("EUR", "1.08"), ("XXX", "5"), (None, "1")], "TXN_CCY string, FX_RATE string")
    got = {r.TXN_CCY: r.VALIDATION_FLAGS for r in ConsistencyValidator()(rates).collect()}
    assert got == {"LBP": "FX_RATE_OFF_REFERENCE", "EUR": "", "XXX": "", None: "REQUIRED_NULL[TXN_CCY]"}


def stamps(spark, rows, columns="TXN_DATE_TIME string, ACCOUNT_ID string, TXN_SEQ string, INTEREST_RATE_INDEX string"):
    df = spark.createDataFrame(rows, columns)
    out = timestamps.TimestampNormalizer()(df).select(*df.columns, F.date_format("TXN_TS", "yyyy-MM-dd HH:mm").alias("t"), "TXN_TS_AMBIGUOUS", "TXN_TS_STATUS", "TXN_TS_UTC_OFFSET", "TXN_TS_PRECISION")
    return {r.TXN_SEQ: r for r in out.collect()}


def test_timestamps(spark):
    got = stamps(spark, [("1640988000", "a", "1", None), ("2022/06/01 10:00", "a", "2", None), ("Jan 5, 2022", "a", "3", None), ("0", "a", "4", None), ("soon", "a", "5", None)])
    assert (got["1"].t, got["1"].TXN_TS_PRECISION, got["1"].TXN_TS_UTC_OFFSET) == ("2022-01-01 00:00", "DAY", "UTC+2")
    assert (got["2"].TXN_TS_UTC_OFFSET, got["2"].TXN_TS_STATUS) == ("UTC+3", "OBSERVED")
    assert (got["3"].t, got["3"].TXN_TS_STATUS) == ("2022-01-05 00:00", "TIME_UNKNOWN")
    assert got["4"].TXN_TS_STATUS == got["5"].TXN_TS_STATUS == "UNKNOWN"


def test_slash_passes(spark):
    macro_case = stamps(spark, [("01/31/2022 10:00", "a", "1", "4.519"), ("01/09/2022 10:00", "b", "2", "4.519"), ("09/30/2022 10:00", "c", "3", "4.879"), ("01/09/2022 10:00", "d", "4", "4.879")])
    assert (macro_case["2"].t, macro_case["4"].t) == ("2022-01-09 10:00", "2022-09-01 10:00")
    bracket = stamps(spark, [("03/20/2022 10:00", "a", "1", "x"), ("04/05/2022 10:00", "a", "2", "y"), ("25/04/2022 10:00", "a", "3", "z")])
    assert (bracket["2"].t, bracket["2"].TXN_TS_AMBIGUOUS) == ("2022-04-05 10:00", False)
    other = stamps(spark, [("04/20/2022 10:00", "a", "1", "x"), ("04/05/2022 10:00", "a", "2", "y"), ("25/05/2022 10:00", "a", "3", "z")])
    assert other["2"].t == "2022-05-04 10:00"
    rest = stamps(spark, [("02/03/2022 01:49", "a", "1", "p"), ("01/01/2022 01:49", "b", "2", "q")])
    assert (rest["1"].t, rest["1"].TXN_TS_AMBIGUOUS, rest["2"].TXN_TS_AMBIGUOUS) == ("2022-02-03 01:49", True, False)


def test_macro(spark):
    rows = spark.createDataFrame([("2022-01-05 10:00:00", "LB", None, None, None), ("2022-06-05 10:00:00", "GB", "1.5", None, "TRUE"), ("2030-01-01 00:00:00", "LB", None, "x", "0"), ("2022-06-05 10:00:00", "LB", None, None, None)], "TXN_DATE_TIME string, MERCHANT_COUNTRY string, INTEREST_RATE_INDEX string, INFLATION_INDEX string, IS_HOLIDAY_MONTH string")
    series = {"INTEREST_RATE_INDEX": {"2022-01": 4.519}, "INFLATION_INDEX": {"2022-06|LB": 19.49}, "IS_HOLIDAY_MONTH": {"2022-01|LB": True}}
    out = macro.MacroCleaner(series=series)(timestamps.TimestampNormalizer()(rows)).collect()
    assert [(r.INTEREST_RATE_INDEX_CLEANED, r.INTEREST_RATE_INDEX_COVERAGE) for r in out] == [(4.519, "RECOVERED"), (1.5, "OBSERVED"), (None, "UNRECOVERABLE"), (None, "UNRECOVERABLE")]
    assert [(r.INFLATION_INDEX_CLEANED, r.INFLATION_INDEX_COVERAGE) for r in out] == [(None, "UNRECOVERABLE"), (None, "OUT_OF_PANEL"), (None, "OBSERVED"), (19.49, "RECOVERED")]
    assert [r.IS_HOLIDAY_MONTH_CLEANED for r in out] == [True, True, False, None]
    with pytest.raises(Exception, match="not constant"):
        macro.extract(timestamps.TimestampNormalizer()(spark.createDataFrame([("2022-01-05 10:00:00", "1"), ("2022-01-06 10:00:00", "2")], "TXN_DATE_TIME string, INTEREST_RATE_INDEX string")), "INTEREST_RATE_INDEX").collect()


def test_codes_and_subsets(spark):
    rows = spark.createDataFrame([("0", "Purchase", "742"), ("20", "x", None), (None, "Purchase", ""), ("9", "Purchase", "12345")], "PROCESSING_CODE string, PROCESSING_TYPE string, MCC_CODE string")
    got = [(r.PROCESSING_CODE_CLEANED, r.PROCESSING_TYPE_CLEANED, r.MCC_CODE_CLEANED, r.MCC_CATEGORY) for r in CodeNormalizer(mcc_reference={"0742": "Vets"})(rows).collect()]
    assert got == [("00", "Purchase", "0742", "Vets"), ("20", "Purchase Return/Refund", "0000", ""), ("00", "Purchase", "0000", ""), ("09", None, "12345", "")]
    odd = spark.createDataFrame([("1",)], "SOMETHING string")  # no step has what it needs
    assert "SOMETHING" in TransactionCleaner().run(odd).columns
    empty = spark.createDataFrame([], "TXN_ID string, MERCHANT_NAME string, MCC_CODE string, TXN_AMOUNT string, MERCHANT_CITY string")
    cleaner = TransactionCleaner()
    assert cleaner.run(empty).count() == 0
    assert {r.metric: r.value for r in cleaner.report().collect()}["input_rows"] == "0"


def test_sheets(spark, tmp_path):
    from veridra.plans import dirty
    from veridra.sources.sinks import write_sheets

    raw = dirty.transactions(spark, "/root/testdata/sf0.001").limit(50)
    cleaner = TransactionCleaner()
    sheets = build_sheets(raw, cleaner.run(raw), cleaner)
    assert {"raw_transactions", "cleaned_transactions", "processing_codes", "pending_settlement", "anomaly_settlement", "merchant_review", "mcc_review", "cleaning_report"} == set(sheets)
    paths = write_sheets({"processing_codes": sheets["processing_codes"], "x" * 40: sheets["pending_settlement"]}, str(tmp_path), "csv")
    assert paths[1].endswith("/" + "x" * 31) and spark.read.csv(paths[0], header=True).count() == 3


def test_rows_without_an_account_stay_open(spark):
    """Dates of rows that name no account aren't settled by each other's; those of an account are."""
    from veridra.operators.timestamps import TimestampNormalizer

    rows = [(a, str(k), t) for a in (None, "7") for k, t in enumerate(("13/01/2022 10:00", "02/01/2022 10:00" if a else "02/03/2022 10:00", "01/28/2022 10:00"), 1)]
    rows += [("8", "1", "01/20/2022 10:00"), ("8", "2", "02/01/2022 10:00"), ("8", "3", "20/02/2022 10:00")]
    df = spark.createDataFrame(rows, "ACCOUNT_ID string, TXN_SEQ string, TXN_DATE_TIME string")
    got = {(r.ACCOUNT_ID, r.TXN_SEQ): (str(r.TXN_TS)[:10], r.TXN_TS_AMBIGUOUS) for r in TimestampNormalizer()(df).collect()}
    assert got[(None, "2")] == ("2022-02-03", True) and got[("8", "2")] == ("2022-02-01", False)


def test_one_call_writes_sheets_and_prints_the_report(spark, tmp_path, capsys):
    from veridra.__main__ import main

    spark.createDataFrame([("1", "2022-03-10 00:51:36", "-104.39", "USD"), ("2", "soon", "(808.41)", "USD")], "TXN_ID string, TXN_DATE_TIME string, TXN_AMOUNT string, TXN_CCY string").write.parquet(f"{tmp_path}/raw")
    paths = main([f"{tmp_path}/raw", f"{tmp_path}/out"], spark)
    assert {"raw_transactions", "cleaned_transactions", "cleaning_report"} <= {p.rsplit("/", 1)[1] for p in paths}
    assert spark.read.parquet(f"{tmp_path}/out/cleaned_transactions").count() == 2 and "input_rows\t2" in capsys.readouterr().out


def test_brackets_of_a_large_group(spark):
    """One account of 200,000 rows, each read against the placed rows next to it; no frame is worked out anew for each row."""
    n = 200_000
    day = F.expr("timestamp_ntz'2024-01-13 00:00:00' + make_dt_interval(0, 0, int(id))")
    text = F.when(F.col("id") % 500 == 0, F.date_format(day, "MM/dd/yyyy HH:mm")).otherwise("01/02/2024 00:00")
    df = spark.range(n).select(F.lit("a").alias("ACCOUNT_ID"), F.col("id").cast("string").alias("TXN_SEQ"), text.alias("TXN_DATE_TIME"), "id")
    out = timestamps.TimestampNormalizer(macro_oracles=(), keep_how=True)(df)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "currentrow$(), unboundedfollowing$()" not in plan
    placed, want = [], collections.Counter()
    start = datetime.datetime(2024, 1, 13)
    for k in range(0, n, 500):
        t = (start + datetime.timedelta(minutes=k)).replace(second=0)
        placed.append((k, t if t.day > 12 else None))
    known = [(k, t) for k, t in placed if t]
    readings = {"bracket_month_first": datetime.datetime(2024, 1, 2), "bracket_day_first": datetime.datetime(2024, 2, 1)}
    for (a, x), (b, y) in zip(known, known[1:]):
        fits = [how for how, t in readings.items() if x <= t <= y]
        if len(fits) == 1:
            want[fits[0]] += sum(k % 500 > 0 for k in range(a, b))
    got = collections.Counter({r["_how"]: r["n"] for r in out.where("id % 500 > 0").groupBy("_how").agg(F.count("*").alias("n")).collect() if r["_how"]})
    assert want and got == want
