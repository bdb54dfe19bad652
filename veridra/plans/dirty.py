"""A dirty view of orders for queries and tests: one transaction for each order, its fields spelled in mixed ways.

The rendering is one text for two dialects of SQL, so that the oracle's tables hold the same strings. What is
expected of the cleaned columns follows from the clean ones (o_orderdate, o_totalprice) and the residues of the key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Spellings that the residues pick.
NAMES = (
    "SQ *TAKEALOT", "COURSERA.COM *W2PA", "ECOM/LULU HYPERMARKET", "TRM:31659ZAATARWZEIT", "H AND M/REF162491", "CREPAWAY BR 306",
    "7 ELEVEN", "Café Ñandú SARL", "WTRS", "DUBAI MN /ufw", "POS PRET A MANGER", "",
)
CITIES = ("BEYROUTH", "ECOM", "", "INTERNAL", "dubai", "Paris ", "TARABLUS", "NOWHERE", "LONDON")
COUNTRIES = ("LB", "ae", "", "FR", "GB", "LB", "AE", "TR")
CURRENCIES = ("USD", "EUR", "GBP", "LBP", "AED", "JPY", "SAR")
RATES = ("1.0", "1.084", "1.2658", "0.000663", "0.2723", "0.0075", "0.2667")


def pick(expr: str, items: tuple[str, ...]) -> str:
    cases = " ".join(f"WHEN {k} THEN '{x}'" for k, x in enumerate(items))
    return f"(CASE {expr} % {len(items)} {cases} END)"


def dialect(name: str) -> dict[str, str]:
    """Functions that the dialects spell apart, as templates."""
    if name == "spark":
        return {
            "seconds": "make_dt_interval(0, 0, 0, {0})", "days": "make_dt_interval({0}, 0, 0, 0)", "fixed": "format_number({0}, {1})",
            "iso": "date_format({0}, 'yyyy-MM-dd HH:mm:ss')", "isot": "date_format({0}, \"yyyy-MM-dd'T'HH:mm:ss\")", "date": "date_format({0}, 'yyyy-MM-dd')",
            "slash": "date_format({0}, 'dd/MM/yyyy HH:mm')", "slashd": "date_format({0}, 'dd/MM/yyyy')", "dash": "date_format({0}, 'MM-dd-yyyy HH:mm')",
            "dashd": "date_format({0}, 'MM-dd-yyyy')", "abbrev": "date_format({0}, 'dd-MMM-yy HH:mm')", "month": "date_format({0}, 'MMM d, yyyy')",
            "mslash": "date_format({0}, 'MM/dd/yyyy HH:mm')", "yslash": "date_format({0}, 'yyyy/MM/dd HH:mm')",
            "epoch": "timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', {0})", "text": "cast({0} AS string)", "whole": "cast({0} AS bigint)",
        }
    return {
        "seconds": "to_seconds({0})", "days": "to_days(cast({0} AS integer))", "fixed": "format('{{:,.{1}f}}', cast({0} AS double))",
        "iso": "strftime({0}, '%Y-%m-%d %H:%M:%S')", "isot": "strftime({0}, '%Y-%m-%dT%H:%M:%S')", "date": "strftime({0}, '%Y-%m-%d')",
        "slash": "strftime({0}, '%d/%m/%Y %H:%M')", "slashd": "strftime({0}, '%d/%m/%Y')", "dash": "strftime({0}, '%m-%d-%Y %H:%M')",
        "dashd": "strftime({0}, '%m-%d-%Y')", "abbrev": "strftime({0}, '%d-%b-%y %H:%M')", "month": "strftime({0}, '%b %-d, %Y')",
        "mslash": "strftime({0}, '%m/%d/%Y %H:%M')", "yslash": "strftime({0}, '%Y/%m/%d %H:%M')",
        "epoch": "cast(epoch({0}) AS bigint)", "text": "cast({0} AS varchar)", "whole": "cast({0} AS bigint)",
    }


def base_sql(name: str, orders: str) -> str:
    """k, account, ts, settle, amount, refund, code and rate of each transaction: what the dirty columns are written from."""
    d = dialect(name)
    f = lambda fn, *a: d[fn].format(*a)
    return f"""
SELECT o_orderkey AS k, o_custkey AS account,
       o_orderdate + {f('seconds', 'cast((o_orderkey * 7919) % 72000 AS int)')} + {f('days', 'CASE WHEN o_orderkey % 5 = 4 THEN 10957 ELSE 0 END')} AS ts,
       o_orderdate + {f('days', 'cast(o_orderkey % 4 - (CASE WHEN o_orderkey % 13 = 0 THEN 9 ELSE 0 END) AS int)')} AS settle,
       CASE WHEN o_orderkey % 7 IN (3, 5) THEN round(o_totalprice) ELSE o_totalprice END AS amount,
       {pick('o_orderkey', CURRENCIES)} AS ccy,
       CASE WHEN o_orderkey % 53 = 0 THEN '9.99' ELSE {pick('o_orderkey', RATES)} END AS rate,
       CASE WHEN o_orderkey % 10 = 0 THEN '20' WHEN o_orderkey % 10 = 1 THEN '1' WHEN o_orderkey % 70 = 2 THEN '77' ELSE '0' END AS code,
       cast((o_orderkey - o_orderkey % 12) / 12 AS bigint) AS j
FROM {orders}"""


def dirty_sql(name: str, orders: str, repeats: bool = False) -> str:
    """The dirty transactions; with repeats also exact copies and re-exports under a new id."""
    d = dialect(name)
    f = lambda fn, *a: d[fn].format(*a)
    number = f"CASE WHEN k % 7 IN (3, 5) THEN {f('fixed', 'amount', 0)} ELSE {f('fixed', 'amount', 2)} END"
    billed = f"replace({f('fixed', '(CASE WHEN (k % 10 = 0) <> (k % 47 = 0) THEN 1.0 ELSE -1.0 END) * amount * cast(rate AS double) * (CASE WHEN k % 31 = 0 THEN 1.05 ELSE 1.0 END)', 2)}, ',', '')"
    columns = f"""
       {f('text', 'k - (CASE WHEN k % 29 = 0 AND k > 0 THEN 1 ELSE 0 END)')} AS TXN_ID,
       {f('text', 'account')} AS ACCOUNT_ID, {f('text', 'k')} AS TXN_SEQ,
       CASE WHEN k % 97 = 0 THEN '0000-00-00' WHEN k % 101 = 0 THEN 'March 3rd 2022' WHEN k % 103 = 0 THEN {f('isot', 'ts')}
            WHEN k % 5 = 0 THEN {f('iso', 'ts')} WHEN k % 5 = 1 THEN {f('slash', 'ts')} WHEN k % 5 = 2 THEN {f('dash', 'ts')}
            WHEN k % 5 = 3 THEN {f('abbrev', 'ts')} ELSE {f('text', f('epoch', 'ts') + ' * 1000')} END AS TXN_DATE_TIME,
       CASE WHEN k % 11 = 0 THEN '' WHEN k % 29 = 0 THEN '1970-01-01' WHEN k % 3 = 0 THEN {f('date', 'settle')}
            WHEN k % 3 = 1 THEN {f('slashd', 'settle')} ELSE {f('dashd', 'settle')} END AS SETTLE_DATE,
       CASE WHEN k % 37 = 0 THEN 'n/a' WHEN k % 41 = 0 THEN '' WHEN k % 8 = 0 THEN concat('-', replace({number}, ',', '')) WHEN k % 4 = 0 THEN replace({number}, ',', '')
            WHEN k % 4 = 1 THEN concat('(', replace({number}, ',', ''), ')') WHEN k % 4 = 2 THEN {number} ELSE translate({number}, ',.', '.,') END AS TXN_AMOUNT,
       CASE WHEN k % 89 = 0 THEN NULL ELSE ccy END AS TXN_CCY, rate AS FX_RATE, {billed} AS BILLING_AMOUNT, 'USD' AS BILLING_CURRENCY,
       code AS PROCESSING_CODE,
       CASE WHEN k % 83 = 0 THEN 'ATM Cash Withdrawal' WHEN code = '20' THEN 'Purchase Return/Refund' WHEN code = '1' THEN 'ATM Cash Withdrawal' ELSE 'Purchase' END AS PROCESSING_TYPE,
       {pick('k', NAMES)} AS MERCHANT_NAME, {pick('k', CITIES)} AS MERCHANT_CITY, {pick('k', COUNTRIES)} AS MERCHANT_COUNTRY,
       CASE k % 12 WHEN 0 THEN (CASE WHEN j % 2 = 0 THEN '5411' ELSE '5999' END) WHEN 1 THEN (CASE WHEN j % 4 = 0 THEN '5732' ELSE '8220' END)
            WHEN 2 THEN (CASE WHEN j % 2 = 0 THEN '5812' ELSE '5411' END) WHEN 3 THEN '5812' WHEN 4 THEN (CASE WHEN j % 10 = 0 THEN '5999' ELSE '5651' END)
            WHEN 5 THEN '5812' WHEN 6 THEN (CASE WHEN j % 3 = 0 THEN '5499' WHEN j % 3 = 1 THEN '5411' ELSE '5812' END) WHEN 7 THEN '742'
            WHEN 8 THEN '5411' WHEN 9 THEN '4111' WHEN 10 THEN '5814' ELSE '5999' END AS MCC_CODE,
       CASE WHEN k % 3 = 0 THEN '00000000' ELSE concat('T', {f('text', 'k % 9973')}) END AS TERMINAL_ID,
       CASE WHEN k % 17 = 0 THEN '000000' WHEN k % 19 = 0 THEN '' WHEN k % 23 = 0 THEN concat('R', {f('text', 'k % 46')}) ELSE concat('A', {f('text', 'k')}) END AS AUTH_CODE,
       'Pending' AS MATCHES_STATUS"""
    one = f"SELECT {columns}, k AS _row_ix FROM base"
    if not repeats:
        return f"WITH base AS ({base_sql(name, orders)}) {one}"
    again = f"SELECT {columns}, k + 1000000000000 AS _row_ix FROM base WHERE k % 71 = 0"
    fresh = f"SELECT concat('N', TXN_ID) AS TXN_ID, * EXCEPT (TXN_ID, _row_ix), _row_ix + 2000000000000 AS _row_ix FROM one WHERE _row_ix % 73 = 0"
    if name != "spark":
        fresh = fresh.replace("* EXCEPT (TXN_ID, _row_ix)", "* EXCLUDE (TXN_ID, _row_ix)")
    return f"WITH base AS ({base_sql(name, orders)}), one AS ({one}) SELECT * FROM one UNION ALL {again} UNION ALL {fresh}"


def forecast_sql(name: str, orders: str) -> str:
    """The dirty rows of the forecast source: six spellings, sequence numbers and macro figures with gaps."""
    d = dialect(name)
    f = lambda fn, *a: d[fn].format(*a)
    rate = f("text", "year(ts) * 12 + month(ts)")
    return f"""WITH base AS ({base_sql(name, orders)})
SELECT {f('text', 'account')} AS ACCOUNT_ID, {f('text', 'k')} AS TXN_SEQ, {f('text', 'account % 50')} AS USER_ID,
       CASE WHEN k % 97 = 0 THEN '9999-12-31' WHEN k % 101 = 0 THEN 'soon' WHEN k % 6 = 0 THEN {f('text', f('epoch', 'ts'))}
            WHEN k % 6 = 1 THEN {f('iso', 'ts')} WHEN k % 6 = 2 THEN {f('yslash', 'ts')} WHEN k % 6 = 3 THEN {f('abbrev', 'ts')}
            WHEN k % 6 = 4 THEN {f('month', 'ts')} WHEN k % 12 = 5 THEN {f('mslash', 'ts')} ELSE {f('slash', 'ts')} END AS TXN_DATE_TIME,
       CASE WHEN k % 11 = 0 THEN '0' WHEN k % 3 = 0 THEN {f('date', 'settle')} WHEN k % 3 = 1 THEN {f('slashd', 'settle')} ELSE substr({f('abbrev', 'settle')}, 1, 9) END AS SETTLE_DATE,
       CASE WHEN k % 9 = 0 THEN NULL ELSE {rate} END AS INTEREST_RATE_INDEX,
       CASE WHEN k % 4 = 0 OR {pick('k', COUNTRIES)} = 'TR' THEN NULL ELSE concat({rate}, '.5') END AS INFLATION_INDEX,
       CASE WHEN k % 5 = 0 THEN NULL WHEN month(ts) IN (4, 12) THEN 'TRUE' ELSE 'False' END AS IS_HOLIDAY_MONTH,
       {pick('k', COUNTRIES)} AS MERCHANT_COUNTRY, k AS _row_ix
FROM base"""


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")


def transactions(spark: SparkSession, sf_dir: str, repeats: bool = False) -> DataFrame:
    return spark.sql(dirty_sql("spark", "{orders}", repeats), orders=_orders(spark, sf_dir))


def forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(forecast_sql("spark", "{orders}"), orders=_orders(spark, sf_dir))
