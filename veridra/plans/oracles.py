"""DuckDB SQL with the rows that each query must give.

What the cleaned columns must hold is worked out from the clean orders and the residues that spelled them (table e),
not by parsing the dirty text again; profiles count the dirty text itself (table t, with repeats r).
"""

from __future__ import annotations

from veridra import rules
from veridra.plans import dirty
from veridra.plans.registry import REFERENCE

# What the spellings in `dirty` stand for.
CLEAN_NAMES = ("TAKEALOT", "COURSERA", "LULU HYPERMARKET", "ZAATARWZEIT", "H AND M", "CREPAWAY", "7 ELEVEN", "CAFE NANDU", "WTRS", "DUBAI MN", "PRET A MANGER", "")
MASTER_NAMES = tuple("WAITROSE" if n == "WTRS" else n for n in CLEAN_NAMES)
CLEAN_CITIES = ("BEIRUT", "INTERNET", "UNKNOWN", "INTERNAL", "DUBAI", "PARIS", "TRIPOLI", "NOWHERE", "LONDON")
CITY_COUNTRY = ("LB", "", "", "", "AE", "FR", "LB", "", "GB")

_zero = "k % 7 IN (3, 5)"
EXPECTED = f"""
SELECT k, account, settle, amount, ccy, rate, code, j,
  CASE WHEN k % 97 = 0 OR k % 101 = 0 OR k % 103 = 0 THEN NULL WHEN k % 5 IN (0, 4) THEN ts ELSE date_trunc('minute', ts) END AS txn,
  CASE WHEN k % 11 = 0 OR k % 29 = 0 THEN NULL ELSE settle END AS settled,
  CASE WHEN k % 37 = 0 OR k % 41 = 0 THEN NULL ELSE (CASE WHEN k % 8 = 0 OR k % 4 = 1 THEN -1 ELSE 1 END) * (CASE WHEN {_zero} AND k % 89 = 0 AND k % 4 IN (2, 3) THEN amount / 1000 ELSE amount END) END AS parsed,
  CASE code WHEN '20' THEN 'Purchase Return/Refund' WHEN '1' THEN 'ATM Cash Withdrawal' WHEN '0' THEN 'Purchase' END AS label,
  {dirty.pick('k', CLEAN_NAMES)} AS name, {dirty.pick('k', MASTER_NAMES)} AS canonical, {dirty.pick('k', CLEAN_CITIES)} AS city, {dirty.pick('k', CITY_COUNTRY)} AS expected,
  k % 12 IN (4, 8, 10) AS recognised
FROM b"""
#: The amount after its sign was restored, and whether that changed it.
SIGNED = "SELECT *, CASE WHEN code = '20' THEN abs(parsed) ELSE -abs(parsed) END AS signed, coalesce((CASE WHEN code = '20' THEN abs(parsed) ELSE -abs(parsed) END) <> parsed, false) AS restored FROM e0"
_b, _t, _r, _f = (dirty.base_sql("duckdb", "orders"), dirty.dirty_sql("duckdb", "orders"), dirty.dirty_sql("duckdb", "orders", True), dirty.forecast_sql("duckdb", "orders"))
WITH = f"WITH b AS ({_b}), t AS ({_t}), e0 AS ({EXPECTED}), e AS ({SIGNED})"
_values = ", ".join(f"('{c}', '{n}', {k})" for k, (c, n) in enumerate(REFERENCE))
REF = f"ref AS (SELECT lpad(code, 4, '0') AS code, arg_max(category, ix) AS category FROM (VALUES {_values}) v(code, category, ix) GROUP BY 1)"


def counts(source: str, *rows: tuple[str, str, bool]) -> str:
    """metric and value of conditions over a table; some only where above zero."""
    parts = [f"SELECT '{m}' AS metric, cast({v} AS bigint) AS value FROM {source}" + ("" if always else f" HAVING {v} > 0") for m, v, always in rows]
    return " UNION ALL ".join(parts)


def n_if(p: str) -> str:
    return f"count(*) FILTER (WHERE {p})"


def stamp(c: str) -> str:
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S')"


ORACLES: dict[str, str] = {}


def oracle(name: str, sql: str, head: str = WITH) -> None:
    ORACLES[name] = f"{head} {sql}" if head else sql


oracle("src_scan", "SELECT cast(c_custkey AS varchar) AS c_custkey, c_name, cast(c_nationkey AS varchar) AS c_nationkey, c_mktsegment, c_custkey AS row_ix FROM customer", "")
oracle("src_csv", "SELECT cast(n_nationkey AS varchar) AS n_nationkey, CASE WHEN n_nationkey % 5 <> 0 THEN n_name END AS n_name, 'NA' AS note FROM nation", "")
oracle("dates_parse", f"SELECT k, {stamp('txn')} AS txn_date_time, {stamp('settled')} AS settle_date FROM e")
_odd = "(k % 97 <> 0 AND (k % 101 = 0 OR k % 103 = 0))"
_spelled = "CASE k % 5 WHEN 0 THEN 'iso_datetime' WHEN 1 THEN 'slash_day_first_datetime' WHEN 2 THEN 'dash_month_first_datetime' WHEN 3 THEN 'day_month_abbrev_datetime' ELSE 'epoch_millis' END"
oracle(
    "dates_formats",
    counts("e", ("TXN_DATE_TIME.unparseable", n_if(_odd), True), ("TXN_DATE_TIME.missing_or_placeholder", n_if("k % 97 = 0"), True), ("SETTLE_DATE.unparseable", "0 * count(*)", True), ("SETTLE_DATE.missing_or_placeholder", n_if("k % 11 = 0 OR k % 29 = 0"), True))
    + f" UNION ALL SELECT 'TXN_DATE_TIME.format[' || {_spelled} || ']', count(*) FROM e WHERE txn IS NOT NULL GROUP BY 1"
    + " UNION ALL SELECT 'SETTLE_DATE.format[' || (CASE k % 3 WHEN 0 THEN 'iso_date' WHEN 1 THEN 'slash_day_first' ELSE 'dash_month_first' END) || ']', count(*) FROM e WHERE settled IS NOT NULL GROUP BY 1",
)
oracle("code_pad", "SELECT e.k, CASE WHEN length(e.code) < 2 THEN '0' || e.code ELSE e.code END AS processing_code, CASE WHEN k % 12 = 7 THEN '0742' ELSE MCC_CODE END AS mcc_code FROM e JOIN t ON k = _row_ix")
oracle("code_label", "SELECT k, label AS processing_type FROM e")
_codes = "(SELECT e.*, PROCESSING_TYPE, lpad(MCC_CODE, 4, '0') AS mcc FROM e JOIN t ON k = _row_ix)"
oracle(
    "code_disagree",
    counts(_codes, ("processing_code.unknown", n_if("code = '77'"), True), ("processing_type.disagrees_with_code", n_if("label <> PROCESSING_TYPE"), True), ("mcc.not_in_reference", n_if("mcc NOT IN ('5411', '5812', '0742', '8220', '5999')"), True), ("mcc.distinct", "count(DISTINCT mcc)", True)),
)
oracle("mcc_category", f", {REF} SELECT _row_ix AS k, coalesce(category, '') AS category FROM t LEFT JOIN ref ON lpad(MCC_CODE, 4, '0') = code")
oracle("mcc_reference", "SELECT lpad(cast(p_size AS varchar), 4, '0') AS code, arg_max(p_type, p_partkey) AS category FROM part GROUP BY 1", "")
oracle("amount_parse", "SELECT k, round(parsed + 0.0, 2) AS amount FROM e")
oracle(
    "amount_separator",
    "SELECT p_partkey AS k, (p_size + 1) + (p_partkey % 1000) / 1000.0::double AS usd, (p_size + 1) * 1000.0::double + p_partkey % 1000 AS lbp FROM part",
    "",
)
oracle("amount_sign", "SELECT k, round(signed + 0.0, 2) AS amount, CASE WHEN restored THEN 'AMOUNT_SIGN_RESTORED' ELSE '' END AS flags FROM e")
oracle(
    "amount_metrics",
    counts("e JOIN t ON k = _row_ix", ("TXN_AMOUNT.unparseable", n_if("k % 37 = 0"), True), ("TXN_AMOUNT.reformatted", n_if("k % 37 <> 0 AND k % 41 <> 0 AND (TXN_AMOUNT LIKE '%(%' OR TXN_AMOUNT LIKE '%,%' OR length(TXN_AMOUNT) - length(replace(TXN_AMOUNT, '.', '')) > 1)"), True), ("TXN_AMOUNT_CLEANED.sign_restored", n_if("restored"), True)),
)
oracle("terminal_flag", "SELECT k, k % 3 <> 0 AS has_terminal FROM e")
oracle("auth_valid", "SELECT _row_ix AS k, AUTH_CODE <> '' AND AUTH_CODE <> '000000' AND count(*) OVER (PARTITION BY AUTH_CODE) < 2 AS auth_code_valid FROM t")
_status = "CASE WHEN settled IS NULL THEN 'UNKNOWN' WHEN cast(settled AS date) < cast(txn AS date) THEN 'ANOMALOUS' ELSE 'OBSERVED' END"
oracle("settle_status", f"SELECT k, {_status} AS status FROM e")
_auth = "(SELECT e.*, t.AUTH_CODE, count(*) OVER (PARTITION BY AUTH_CODE) AS n FROM e JOIN t ON k = _row_ix)"
oracle(
    "blank_counts",
    counts(
        _auth, ("terminal_id.sentinel_rows", n_if("k % 3 = 0"), True), ("auth_code.invalid_rows", n_if("AUTH_CODE IN ('', '000000') OR n > 1"), True), ("auth_code.repeated_values", "count(DISTINCT CASE WHEN n > 1 AND AUTH_CODE <> '' THEN AUTH_CODE END)", True),
        ("settle_date.anomalous", n_if(f"({_status}) = 'ANOMALOUS'"), True), ("settle_date.unknown", n_if("settled IS NULL"), True), ("merchant_city.blank", n_if("k % 9 = 2"), False), ("merchant_country.blank", n_if("k % 8 = 2"), False),
    ),
)
_raw = "TXN_ID, ACCOUNT_ID, TXN_SEQ, TXN_DATE_TIME, SETTLE_DATE, TXN_AMOUNT, TXN_CCY, FX_RATE, BILLING_AMOUNT, BILLING_CURRENCY, PROCESSING_CODE, PROCESSING_TYPE, MERCHANT_NAME, MERCHANT_CITY, MERCHANT_COUNTRY, MCC_CODE, TERMINAL_ID, AUTH_CODE, MATCHES_STATUS"
_u = f"WITH r AS ({_r}), u AS (SELECT {_raw}, min(_row_ix) AS _row_ix, count(*) AS copies FROM r GROUP BY {_raw})"
oracle("dup_exact", "SELECT TXN_ID AS txn_id, count(*) AS n, min(_row_ix) AS first FROM u GROUP BY TXN_ID", _u)
_k1, _k2 = "ACCOUNT_ID, TXN_DATE_TIME, TXN_AMOUNT, MERCHANT_NAME", "ACCOUNT_ID, TXN_DATE_TIME, TXN_AMOUNT"
_groups = lambda keys, source="u": f"(SELECT coalesce(sum(n) FILTER (WHERE n > 1), 0) AS v FROM (SELECT count(*) AS n FROM {source} GROUP BY {keys}))"
oracle(
    "dup_business_key",
    "SELECT 'exact_duplicate_rows_dropped' AS metric, cast(coalesce(sum(copies - 1), 0) AS bigint) AS value FROM u"
    + f" UNION ALL SELECT 'business_key_repeats[{_k1.replace(', ', '+')}]', cast(v AS bigint) FROM {_groups(_k1)} UNION ALL SELECT 'business_key_repeats[{_k2.replace(', ', '+')}]', cast(v AS bigint) FROM {_groups(_k2)}"
    + f" UNION ALL SELECT 'txn_id_collisions', cast(v AS bigint) FROM {_groups('TXN_ID')}",
    _u,
)
oracle(
    "dup_id_seq",
    "SELECT k, CASE WHEN count(*) OVER w0 > 1 THEN TXN_ID || '_' || row_number() OVER (PARTITION BY TXN_ID ORDER BY txn ASC NULLS LAST, k) ELSE TXN_ID END AS txn_id FROM e JOIN t ON k = _row_ix WINDOW w0 AS (PARTITION BY TXN_ID)",
)
_kind = "CASE city WHEN 'UNKNOWN' THEN 'UNKNOWN' WHEN 'INTERNET' THEN 'ECOMMERCE' WHEN 'INTERNAL' THEN 'INTERNAL' ELSE 'PHYSICAL' END"
_country = f"coalesce(nullif(expected, ''), nullif(upper({dirty.pick('k', dirty.COUNTRIES)}), ''), 'UNKNOWN')"
oracle("geo_city", "SELECT k, city AS value FROM e")
oracle("geo_location_type", f"SELECT k, {_kind} AS value FROM e")
oracle("geo_ecommerce", "SELECT k, city = 'INTERNET' OR k % 3 = 0 AS value FROM e")
oracle("geo_expected", "SELECT k, expected AS value FROM e")
oracle("geo_country", f"SELECT k, {_country} AS value FROM e")
oracle(
    "geo_metrics",
    counts(
        "e", ("cities_distinct_before", f"count(DISTINCT upper(trim({dirty.pick('k', dirty.CITIES)})))", True), ("cities_distinct_after", "count(DISTINCT city)", True), ("city.unknown", n_if("city = 'UNKNOWN'"), True), ("ecommerce_rows", n_if("city = 'INTERNET' OR k % 3 = 0"), True),
        *((f"location_type.{x.lower()}", n_if(f"({_kind}) = '{x}'"), False) for x in ("PHYSICAL", "ECOMMERCE", "INTERNAL", "UNKNOWN")), ("city.not_in_country_reference", n_if("city = 'NOWHERE'"), True), ("country.unknown", n_if(f"{_country} = 'UNKNOWN'"), True),
    ),
)
oracle("merchant_clean", "SELECT k, name FROM e")
oracle("merchant_processor", "SELECT k, CASE WHEN k % 12 = 0 THEN 'SQ' ELSE 'Unknown' END AS processor FROM e")
oracle("merchant_master", "SELECT k, canonical AS name, recognised, CASE WHEN recognised THEN 'Confirmed' ELSE 'Pending' END AS status FROM e")
oracle(
    "merchant_review",
    """, m AS (SELECT e.*, t.*, lpad(MCC_CODE, 4, '0') AS mcc FROM e JOIN t ON k = _row_ix WHERE NOT recognised AND canonical <> ''),
h AS (SELECT canonical, string_agg(mcc || ': ' || n, ', ' ORDER BY n DESC, mcc) AS seen FROM (SELECT canonical, mcc, count(*) AS n FROM m GROUP BY ALL) GROUP BY 1)
SELECT canonical AS merchant_name_cleaned, count(*) AS row_count, any_value(MERCHANT_NAME) AS raw_spellings,
       array_to_string(list_sort(list(DISTINCT MERCHANT_COUNTRY)), '; ') AS countries, any_value(seen) AS mcc_observed
FROM m JOIN h USING (canonical) GROUP BY canonical""",
)
oracle(
    "merchant_metrics",
    counts("e", ("matches_status.pending", n_if("NOT recognised"), True), ("merchants_distinct", "count(DISTINCT canonical)", True), ("merchant.unrecognised_rows", n_if("NOT recognised"), True), ("merchant.unrecognised_names", "count(DISTINCT CASE WHEN NOT recognised THEN canonical END)", True), ("processor_prefix_stripped", n_if("k % 12 = 0"), True), ("empty_after_clean", n_if("canonical = ''"), True)),
)
oracle("trap_pairs", "SELECT * FROM (VALUES ('waitrose_waterstones', 0::bigint, false), ('mezyan_mezyane', 0::bigint, false), ('careem_crepaway', (SELECT count(DISTINCT name) FROM e WHERE name = 'CREPAWAY'), false), ('total_family', 0::bigint, false)) AS t(id, members_seen, merged)")

# -- codes of merchants: decisions by counting, tails by the formula
WITH_REPEATS = f"""WITH b AS ({_b}), r AS ({_r}), t AS (SELECT {_raw}, min(_row_ix) AS _row_ix FROM r GROUP BY {_raw}), e0 AS ({EXPECTED}), e1 AS ({SIGNED}),
e AS (SELECT e1.* REPLACE (_row_ix AS k) FROM e1 JOIN t ON e1.k = _row_ix % 1000000000000)"""
MCC_STEPS = """, m AS (SELECT e.*, lpad(MCC_CODE, 4, '0') AS mcc, PROCESSING_TYPE FROM e JOIN t ON k = _row_ix),
h AS (SELECT canonical AS merchant, mcc AS code, count(*) AS n, min(k) AS first FROM m WHERE canonical <> '' GROUP BY ALL),
g AS (SELECT merchant, sum(n)::bigint AS rows, count(*) AS kinds, max(n) AS top_n, arg_min(code, (-n, first)) AS top, list(code ORDER BY n DESC, first) AS codes,
             count(*) FILTER (WHERE code <> '5999') AS specifics, max(n) FILTER (WHERE code <> '5999') AS best_n, coalesce(max(n) FILTER (WHERE code = '5999'), 0) AS catch_n FROM h GROUP BY merchant),
g2 AS (SELECT g.*, (SELECT arg_min(code, (-n, first)) FROM h WHERE h.merchant = g.merchant AND code <> '5999') AS best, (SELECT count(*) FROM h WHERE h.merchant = g.merchant AND n = top_n) AS tied,
              (SELECT list(code) FROM h WHERE h.merchant = g.merchant AND n = top_n AND code NOT IN ('5999', '5812', '5817')) AS clear,
              (SELECT sum(exp(lgamma(rows + 1) - lgamma(i + 1) - lgamma(rows - i + 1) - i * ln(kinds) + (rows - i) * ln(1 - 1.0 / kinds))) FROM range(top_n, rows + 1) s(i)) AS tail FROM g),
d AS (SELECT *, CASE WHEN merchant = 'PRET A MANGER' OR merchant = 'WAITROSE' THEN 'curated' WHEN kinds = 1 THEN 'consistent' WHEN specifics > 0 AND catch_n >= best_n THEN 'catch_all_override'
        WHEN tied > 1 AND len(clear) = 1 THEN 'suspect_tiebreak' WHEN tied > 1 THEN 'unresolved_tie' WHEN tail <= 0.2 THEN 'majority' ELSE 'weak_majority' END AS signal FROM g2),
d2 AS (SELECT *, CASE signal WHEN 'curated' THEN CASE merchant WHEN 'WAITROSE' THEN '5411' ELSE '5812' END WHEN 'catch_all_override' THEN best WHEN 'suspect_tiebreak' THEN clear[1] WHEN 'majority' THEN top END AS mcc,
        CASE WHEN signal IN ('curated', 'consistent') OR (signal = 'majority' AND tail <= 0.05) THEN 'HIGH' WHEN signal IN ('unresolved_tie', 'weak_majority') THEN 'PENDING' ELSE 'MEDIUM' END AS confidence,
        CASE WHEN signal NOT IN ('curated', 'consistent') THEN least(tail, 1.0) END AS p FROM d),
s AS (SELECT m.*, coalesce(CASE WHEN d2.mcc <> m.mcc THEN d2.mcc END, '') AS suggested0, d2.confidence AS confidence0, coalesce(d2.signal, '') AS signal0, PROCESSING_TYPE = 'ATM Cash Withdrawal' AND m.mcc <> '6011' AS atm FROM m LEFT JOIN d2 ON canonical = merchant),
s2 AS (SELECT *, CASE WHEN atm THEN '6011' ELSE suggested0 END AS suggested, CASE WHEN atm THEN 'HIGH' ELSE confidence0 END AS confidence, CASE WHEN atm THEN 'deterministic' ELSE signal0 END AS signal,
        concat_ws(';', CASE WHEN restored THEN 'AMOUNT_SIGN_RESTORED' END, CASE WHEN atm THEN 'MCC_ATM_MISMATCH' END) AS flags FROM s)"""
MCC = WITH + MCC_STEPS
oracle("mcc_histogram", "SELECT merchant, code, n, first FROM h", MCC)
oracle("mcc_decide", "SELECT merchant, mcc, confidence, signal, rows, round(p, 9) AS p_value FROM d2", MCC)
oracle(
    "mcc_binomial",
    """WITH o AS (SELECT o_custkey, count(*) AS n, greatest(count(*) FILTER (WHERE o_orderkey % 2 = 0), count(*) FILTER (WHERE o_orderkey % 2 <> 0)) AS hits FROM orders GROUP BY 1)
SELECT o_custkey, n, hits, round(1e-11 + least(1.0, (SELECT sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + n * ln(0.5))) FROM range(hits, n + 1) s(i))), 9) AS p FROM o""",
    "",
)
oracle("mcc_suggest", "SELECT k, suggested0 AS suggested, confidence0 AS confidence, signal0 AS signal FROM s2", MCC)
oracle("mcc_atm", "SELECT k, suggested, flags FROM s2 WHERE atm", MCC)
oracle("mcc_adopt", "SELECT k, CASE WHEN suggested <> '' THEN suggested ELSE mcc END AS mcc_code FROM s2", MCC)
oracle(
    "mcc_metrics",
    counts("s2", ("MCC_ATM_MISMATCH", n_if("atm"), True), *((f"confidence[{x}]", n_if(f"confidence = '{x}'"), False) for x in ("HIGH", "MEDIUM", "PENDING")), ("rows_with_suggestion", n_if("suggested <> ''"), True), ("mcc_code.reassigned", n_if("suggested <> ''"), True))
    + " UNION ALL SELECT 'signal[' || signal || ']', count(*) FROM s2 WHERE signal <> '' GROUP BY signal",
    MCC,
)
oracle(
    "mcc_review",
    "SELECT merchant AS merchant_name_cleaned, (SELECT string_agg(code || ': ' || n, ', ' ORDER BY n DESC, first) FROM h WHERE h.merchant = d2.merchant) AS mcc_observed, coalesce(mcc, '') AS mcc_code_suggested, confidence AS mcc_confidence, round(p, 4) AS binomial_p, signal, rows AS row_count FROM d2 WHERE confidence = 'PENDING'",
    MCC,
)

# -- contradictions
_units = " ".join(f"WHEN '{c}' THEN {v}" for c, v in rules.UNITS_PER_USD.items())
CON_STEPS = f""", x AS (SELECT s2.*, t.TXN_CCY, cast(t.BILLING_AMOUNT AS double) AS billed, cast(t.FX_RATE AS double) AS fx, 1.0 / (CASE t.TXN_CCY {_units} END)::double AS ref, t.MERCHANT_COUNTRY FROM s2 JOIN t ON k = _row_ix),
y AS (SELECT *, txn IS NULL AS no_time, signed IS NULL AS no_amount, TXN_CCY IS NULL AS no_ccy, coalesce(cast(settled AS date) < cast(txn AS date), false) AS early,
        coalesce(abs(abs(signed) * fx - abs(billed)) / nullif(abs(signed) * fx, 0) > 0.01, false) AS fx_off, coalesce(abs(fx - ref) / ref > 0.15, false) AS ref_off,
        coalesce(label = 'Purchase Return/Refund', false) AND billed < 0 AS neg, NOT coalesce(label = 'Purchase Return/Refund', false) AND billed > 0 AS pos,
        expected <> '' AND MERCHANT_COUNTRY <> expected AS geo, PROCESSING_TYPE IS DISTINCT FROM label AS typ FROM x),
z AS (SELECT *, concat_ws(';', nullif(flags, ''), CASE WHEN no_time THEN 'REQUIRED_NULL[TXN_DATE_TIME_CLEANED]' END, CASE WHEN no_amount THEN 'REQUIRED_NULL[TXN_AMOUNT_CLEANED]' END, CASE WHEN no_ccy THEN 'REQUIRED_NULL[TXN_CCY]' END,
        CASE WHEN early THEN 'SETTLE_BEFORE_TXN' END, CASE WHEN fx_off THEN 'FX_RECONCILE_MISMATCH' END, CASE WHEN ref_off THEN 'FX_RATE_OFF_REFERENCE' END, CASE WHEN neg THEN 'REFUND_NEGATIVE' END, CASE WHEN pos THEN 'PURCHASE_POSITIVE' END,
        CASE WHEN geo THEN 'GEO_CITY_COUNTRY_MISMATCH' END, CASE WHEN typ THEN 'CODE_TYPE_MISMATCH' END) AS all_flags FROM y)"""
CON = MCC + CON_STEPS
oracle("con_required", "SELECT k, false AS required_null_txn_id, false AS required_null_account_id, no_time AS required_null_txn_date_time_cleaned, no_amount AS required_null_txn_amount_cleaned, no_ccy AS required_null_txn_ccy FROM z", CON)
for _name, _cols in {
    "con_settle": "early AS settle_before_txn", "con_fx_reconcile": "fx_off AS fx_reconcile_mismatch", "con_fx_reference": "ref_off AS fx_rate_off_reference",
    "con_sign": "neg AS refund_negative, pos AS purchase_positive", "con_geo": "geo AS geo_city_country_mismatch", "con_code_type": "typ AS code_type_mismatch",
}.items():
    oracle(_name, f"SELECT k, {_cols} FROM z", CON)
oracle(
    "con_flags",
    counts(
        "z", ("REQUIRED_NULL[TXN_ID]", "0 * count(*)", True), ("REQUIRED_NULL[ACCOUNT_ID]", "0 * count(*)", True), ("REQUIRED_NULL[TXN_DATE_TIME_CLEANED]", n_if("no_time"), True), ("REQUIRED_NULL[TXN_AMOUNT_CLEANED]", n_if("no_amount"), True), ("REQUIRED_NULL[TXN_CCY]", n_if("no_ccy"), True),
        ("SETTLE_BEFORE_TXN", n_if("early"), True), ("FX_RECONCILE_MISMATCH", n_if("fx_off"), True), ("FX_RATE_OFF_REFERENCE", n_if("ref_off"), True), ("REFUND_NEGATIVE", n_if("neg"), True), ("PURCHASE_POSITIVE", n_if("pos"), True),
        ("GEO_CITY_COUNTRY_MISMATCH", n_if("geo"), True), ("CODE_TYPE_MISMATCH", n_if("typ"), True), ("rows_with_any_flag", n_if("all_flags <> ''"), True),
    ),
    CON,
)
oracle("pipeline_full", "SELECT all_flags AS flags, confidence, count(*) AS n, round(coalesce(sum(signed), NULL) + 0.0, 2) AS amount, count(*) AS ids FROM z GROUP BY ALL", WITH_REPEATS + MCC_STEPS + CON_STEPS)

# -- presentation
_view = (
    "TXN_ID_CLEANED", "ACCOUNT_ID", "TXN_DATE_TIME_CLEANED", "SETTLE_DATE_CLEANED", "SETTLE_DATE_STATUS", "TXN_AMOUNT_CLEANED", "TXN_CCY", "BILLING_AMOUNT", "BILLING_CURRENCY", "FX_RATE", "MERCHANT_NAME_CLEANED", "MCC_CONFIDENCE",
    "MERCHANT_PROCESSOR", "MERCHANT_CITY_CLEANED", "MERCHANT_COUNTRY_CLEANED", "PROCESSING_CODE_CLEANED", "MCC_CODE_CLEANED", "TERMINAL_ID", "HAS_TERMINAL", "AUTH_CODE", "AUTH_CODE_VALID", "IS_ECOMMERCE", "MATCHES_STATUS_CLEANED", "TXN_SEQ", "LOCATION_TYPE",
)
_listed = ", ".join(f"({k}, '{n}')" for k, n in enumerate(_view))
oracle("present_view", f"SELECT place, name FROM (VALUES {_listed}) v(place, name)", "")
oracle("present_names", f"SELECT place, CASE name WHEN 'MATCHES_STATUS_CLEANED' THEN 'matches_status' ELSE lower(name) END AS name FROM (VALUES {_listed}) v(place, name)", "")
oracle("present_dates", "SELECT k, strftime(txn, '%d-%m-%Y %H:%M:%S') AS txn_date_time_cleaned, strftime(settled, '%d-%m-%Y') AS settle_date_cleaned FROM e")
_ids = "(SELECT e.*, CASE WHEN count(*) OVER (PARTITION BY TXN_ID) > 1 THEN TXN_ID || '_' || row_number() OVER (PARTITION BY TXN_ID ORDER BY txn ASC NULLS LAST, k) ELSE TXN_ID END AS id FROM e JOIN t ON k = _row_ix)"
oracle("sheet_pending", f"SELECT id AS txn_id_cleaned, cast(account AS varchar) AS account_id, 'UNKNOWN' AS settle_date_status FROM {_ids} WHERE settled IS NULL")
oracle("sheet_anomaly", f"SELECT id AS txn_id_cleaned, cast(account AS varchar) AS account_id, {stamp('settled')} AS settle_date FROM {_ids} WHERE ({_status}) = 'ANOMALOUS'")
oracle("sheet_processing_codes", "SELECT * FROM (VALUES ('00', 'Purchase'), ('01', 'ATM Cash Withdrawal'), ('20', 'Purchase Return/Refund')) v(processing_code_cleaned, processing_type)", "")

# -- profiles
_columns = _raw.split(", ")
_words = "'', '-', '--', '?', '#N/A', 'N/A', 'NA', 'NAN', 'NONE', 'NULL', 'MISSING', 'UNKNOWN', '0000-00-00', '0000-00-00 00:00:00', '1970-01-01', '1970-01-01 00:00:00'"
_T, _R = f"WITH t AS ({_t})", _u
_long = "l AS (" + " UNION ALL ".join(f"SELECT '{c}' AS col, {c} AS v, _row_ix FROM t" for c in _columns) + ")"
_is_word, _is_filler = f"upper(trim(v)) IN ({_words})", "regexp_matches(trim(v), '^(?:0+|X+|9+|-+)$', 'i')"
oracle("prof_nulls", f", {_long} SELECT col AS column, {n_if('v IS NULL')} AS n, round(100.0 * {n_if('v IS NULL')} / count(*), 2) AS pct FROM l GROUP BY col HAVING n > 0 UNION ALL SELECT '*', count(DISTINCT _row_ix) FILTER (WHERE v IS NULL) AS n, round(100.0 * n / count(DISTINCT _row_ix), 2) FROM l HAVING n > 0", _T)
oracle(
    "prof_missing",
    f", {_long}, q AS (SELECT *, coalesce({_is_word} OR {_is_filler}, false) AS hit FROM l) SELECT col AS column, {n_if('hit')} AS n, round(100.0 * {n_if('hit')} / count(*), 2) AS pct, array_to_string(list_sort(list(DISTINCT v) FILTER (WHERE hit))[1:5], '|') AS tokens FROM q GROUP BY col HAVING n > 0"
    " UNION ALL SELECT '*', count(DISTINCT _row_ix) FILTER (WHERE hit) AS n, round(100.0 * n / count(DISTINCT _row_ix), 2), '' FROM q",
    _T,
)
oracle(
    "eda_missing",
    f", {_long} SELECT col AS column, {n_if(chr(39)*2 + ' = trim(coalesce(v, ' + chr(39)*2 + '))')} AS blank, {n_if('trim(v) <> ' + chr(39)*2 + ' AND ' + _is_word)} AS placeholder, {n_if('trim(v) <> ' + chr(39)*2 + ' AND ' + _is_filler)} AS sentinel,"
    f" {n_if('v IS NULL OR ' + _is_word + ' OR ' + _is_filler)} AS total_absent, round(100.0 * {n_if('v IS NULL OR ' + _is_word + ' OR ' + _is_filler)} / count(*), 2) AS pct FROM l GROUP BY col",
    _T,
)
oracle("eda_cardinality", f", {_long} SELECT col AS column, count(DISTINCT v) AS distinct, min(v) FILTER (WHERE trim(v) <> '') AS least FROM l GROUP BY col", _T)
oracle("eda_values", f", {_long} SELECT col AS column, v AS value, count(*) AS rows FROM l WHERE col IN ('TXN_CCY', 'PROCESSING_CODE', 'MERCHANT_CITY') GROUP BY ALL", _T)
oracle(
    "eda_column_kinds",
    f""", {_long}, q AS (SELECT col, v, regexp_matches(v, '^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)$') AS num,
  regexp_matches(v, '^(\\d{{4}}-\\d{{2}}-\\d{{2}}([ T]\\d{{2}}:\\d{{2}}:\\d{{2}})?|\\d{{13}}|\\d{{2}}-[A-Za-z]{{3}}-\\d{{2}}( \\d{{2}}:\\d{{2}})?|\\d{{2}}[/-]\\d{{2}}[/-]\\d{{4}}( \\d{{2}}:\\d{{2}})?)$') AND v NOT IN ({_words}) AS dat
  FROM l WHERE col IN ('TXN_ID', 'TXN_DATE_TIME', 'SETTLE_DATE', 'MERCHANT_NAME', 'FX_RATE', 'PROCESSING_CODE') AND trim(v) <> '')
SELECT col AS column, count(*) AS filled, round(100 * avg(num::int), 1) AS numeric_pct, round(100 * avg(dat::int), 1) AS date_pct, CASE WHEN avg(num::int) > 0.99 THEN 'numeric' WHEN avg(dat::int) > 0.99 THEN 'date' ELSE 'mixed/text' END AS reads_as FROM q GROUP BY col""",
    _T,
)
oracle(
    "eda_patterns",
    "SELECT concat_ws(',', CASE WHEN SETTLE_DATE = '' THEN 'SETTLE_DATE' END, CASE WHEN TXN_AMOUNT = '' THEN 'TXN_AMOUNT' END, CASE WHEN MERCHANT_CITY = '' THEN 'MERCHANT_CITY' END, CASE WHEN MERCHANT_COUNTRY = '' THEN 'MERCHANT_COUNTRY' END, CASE WHEN AUTH_CODE = '' THEN 'AUTH_CODE' END) AS pattern, count(*) AS rows FROM t GROUP BY 1",
    _T,
)
_extra = lambda name, keys: f"SELECT '{name}' AS name, cast(sum(n - 1) AS bigint) AS extra FROM (SELECT count(*) AS n FROM r GROUP BY {keys})"
oracle("eda_dups", " UNION ALL ".join(_extra(n, k) for n, k in (("rows", _raw), ("TXN_ID", "TXN_ID"), ("TXN_SEQ", "TXN_SEQ"), (_k1.replace(", ", "+"), _k1), (_k2.replace(", ", "+"), _k2))), _R)
_key = lambda name, keys: f"SELECT '{name}' AS metric, cast(coalesce(sum(single) FILTER (WHERE total > 1), 0) AS bigint) AS value FROM (SELECT sum(copies) AS total, count(*) FILTER (WHERE copies = 1) AS single FROM u GROUP BY {keys})"
oracle(
    "prof_duplicates",
    "SELECT 'full_row_rows' AS metric, cast(coalesce(sum(copies) FILTER (WHERE copies > 1), 0) AS bigint) AS value FROM u UNION ALL SELECT 'full_row_removable', cast(sum(copies - 1) AS bigint) FROM u UNION ALL SELECT 'n_unique_ids', count(DISTINCT TXN_ID) FROM u UNION ALL "
    + " UNION ALL ".join(_key(n, k) for n, k in (("id_collision_rows", "TXN_ID"), (_k1.replace(", ", " + "), _k1), (_k2.replace(", ", " + "), _k2), ("ACCOUNT_ID + TXN_AMOUNT + MERCHANT_NAME + AUTH_CODE", "ACCOUNT_ID, TXN_AMOUNT, MERCHANT_NAME, AUTH_CODE"))),
    _R,
)
oracle("eda_code_pairs", "SELECT lpad(PROCESSING_CODE, 2, '0') AS code, PROCESSING_TYPE AS label, count(*) AS rows, CASE WHEN PROCESSING_CODE = '77' THEN 'new' ELSE 'known' END AS standing FROM t GROUP BY ALL", _T)
oracle("eda_blocks", "SELECT count(DISTINCT user_id) AS groups, count(*) FILTER (WHERE new) AS blocks, count(*) FILTER (WHERE new) <> count(DISTINCT user_id) AS interleaved FROM (SELECT user_id, user_id IS DISTINCT FROM lag(user_id) OVER (ORDER BY event_id) OR row_number() OVER (ORDER BY event_id) = 1 AS new FROM events)", "")
_mono = lambda name, table, g, o, v: f"SELECT '{name}' AS name, count(*) AS n_groups, count(*) FILTER (WHERE ok) AS n_monotonic FROM (SELECT {g}, bool_and(up) AS ok FROM (SELECT {g}, coalesce({v} >= lag({v}) OVER (PARTITION BY {g} ORDER BY {o}), true) AS up FROM {table}) GROUP BY 1)"
oracle("eda_monotonic", _mono("orders", "orders", "o_custkey", "o_orderkey", "o_orderdate") + " UNION ALL " + _mono("events", "events", "user_id", "event_id", "ts"), "")
oracle(
    "eda_backwards",
    ", q AS (SELECT TXN_DATE_TIME AS raw, txn < lag(txn) OVER (PARTITION BY account ORDER BY k) AS back FROM e JOIN t ON k = _row_ix WHERE txn IS NOT NULL) SELECT regexp_replace(regexp_replace(raw, '[0-9]', '9', 'g'), '[A-Za-z]', 'A', 'g') AS shape, count(*) AS rows_out_of_order FROM q WHERE back GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
)
oracle("eda_months", "SELECT user_id, strftime(ts, '%Y-%m') AS month, count(*) AS rows FROM events GROUP BY ALL", "")
oracle("eda_spread", "SELECT PROCESSING_TYPE AS processing_type, count(*) AS size, min(v) AS min, median(v) AS median, max(v) AS max FROM (SELECT *, CASE WHEN regexp_matches(TXN_AMOUNT, '^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)$') THEN try_cast(TXN_AMOUNT AS double) END AS v FROM t) GROUP BY 1", _T)
oracle(
    "seq_spearman",
    "WITH q AS (SELECT user_id, rank() OVER (PARTITION BY user_id ORDER BY event_id) + (count(*) OVER (PARTITION BY user_id, event_id) - 1) / 2.0 AS ra, rank() OVER (PARTITION BY user_id ORDER BY value) + (count(*) OVER (PARTITION BY user_id, value) - 1) / 2.0 AS rb FROM events WHERE value IS NOT NULL) SELECT user_id, count(*) AS n, round(corr(ra, rb), 9) AS rho FROM q GROUP BY 1 HAVING count(*) >= 3",
    "",
)
oracle("stream_stateless", f"SELECT k, {stamp('txn')} AS txn_date_time, canonical AS name, city FROM e")

# -- timestamps of the forecast source: the spellings are read by DuckDB's own parser, the clock follows Lebanon's rules
_last_sunday = lambda y, m: f"(make_date({y}, {m}, 31) - cast(dayofweek(make_date({y}, {m}, 31)) AS integer))" if m != 9 else f"(make_date({y}, 9, 30) - cast(dayofweek(make_date({y}, 9, 30)) AS integer))"
_ends = lambda c: f"(CASE WHEN year({c}) <= 1998 THEN {_last_sunday(f'year({c})', 9)} ELSE {_last_sunday(f'year({c})', 10)} END)"


def summer(utc: str) -> str:
    """Whether the clock is three hours ahead at a UTC time: from midnight of the last Sunday of March to that of the last month."""
    return f"({utc} >= cast({_last_sunday(f'year({utc})', 3)} AS timestamp) - to_hours(2) AND {utc} < cast({_ends(utc)} AS timestamp) - to_hours(3))"


def summer_local(c: str) -> str:
    """The same for a reading of the clock itself; of the hour that comes twice, the first."""
    return f"({c} >= cast({_last_sunday(f'year({c})', 3)} AS timestamp) + to_hours(1) AND {c} < cast({_ends(c)} AS timestamp))"


_nothing = "(k % 97 = 0 OR k % 101 = 0)"
STAMPS = f"""WITH b AS ({_b}), f AS ({_f}),
p AS (SELECT k, account, ts, f.*, NOT {_nothing} AND k % 6 = 5 AS slash, coalesce(INTEREST_RATE_INDEX, '') AS key1, coalesce(INFLATION_INDEX, '') || '|' || MERCHANT_COUNTRY AS key2,
  CASE WHEN {_nothing} THEN NULL WHEN k % 6 = 0 THEN ts + to_hours(CASE WHEN {summer('ts')} THEN 3 ELSE 2 END) WHEN k % 6 = 1 THEN ts WHEN k % 6 IN (2, 3) THEN date_trunc('minute', ts) WHEN k % 6 = 4 THEN date_trunc('day', ts) END AS plain
  FROM b JOIN f ON k = _row_ix),
q AS (SELECT *, CASE WHEN slash THEN try_strptime(TXN_DATE_TIME, '%m/%d/%Y %H:%M') END AS mf, CASE WHEN slash THEN try_strptime(TXN_DATE_TIME, '%d/%m/%Y %H:%M') END AS df FROM p),
q0 AS (SELECT *, CASE WHEN mf IS NULL THEN df WHEN df IS NULL THEN mf END AS o0, CASE WHEN slash AND mf IS NULL THEN 'forced_day_first' WHEN slash AND df IS NULL THEN 'forced_month_first' END AS h0 FROM q),
m1 AS (SELECT key1, list(DISTINCT strftime(o0, '%Y-%m')) AS months FROM q0 WHERE o0 IS NOT NULL GROUP BY 1),
q1 AS (SELECT q0.*, slash AND o0 IS NULL AND coalesce(list_contains(months, strftime(mf, '%Y-%m')), false) <> coalesce(list_contains(months, strftime(df, '%Y-%m')), false) AS hit1, list_contains(months, strftime(mf, '%Y-%m')) AS fit1 FROM q0 LEFT JOIN m1 USING (key1)),
q2 AS (SELECT *, CASE WHEN hit1 THEN CASE WHEN fit1 THEN mf ELSE df END ELSE o0 END AS o1, CASE WHEN hit1 THEN 'macro[INTEREST_RATE_INDEX]' ELSE h0 END AS h1 FROM q1),
m2 AS (SELECT key2, list(DISTINCT strftime(o1, '%Y-%m')) AS months2 FROM q2 WHERE o1 IS NOT NULL GROUP BY 1),
q3 AS (SELECT q2.*, slash AND o1 IS NULL AND coalesce(list_contains(months2, strftime(mf, '%Y-%m')), false) <> coalesce(list_contains(months2, strftime(df, '%Y-%m')), false) AS hit2, list_contains(months2, strftime(mf, '%Y-%m')) AS fit2 FROM q2 LEFT JOIN m2 USING (key2)),
q4 AS (SELECT *, CASE WHEN hit2 THEN CASE WHEN fit2 THEN mf ELSE df END ELSE o1 END AS o2, CASE WHEN hit2 THEN 'macro[INFLATION_INDEX]' ELSE h1 END AS h2 FROM q3),
q5 AS (SELECT *, last_value(o2 IGNORE NULLS) OVER (PARTITION BY account ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS low, first_value(o2 IGNORE NULLS) OVER (PARTITION BY account ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS high FROM q4),
q6 AS (SELECT *, slash AND o2 IS NULL AS open, coalesce(mf BETWEEN low AND high, false) AS inm, coalesce(df BETWEEN low AND high, false) AS ind FROM q5),
q7 AS (SELECT *, CASE WHEN open AND inm AND NOT ind THEN mf WHEN open AND ind AND NOT inm THEN df ELSE o2 END AS o3, CASE WHEN open AND inm AND NOT ind THEN 'bracket_month_first' WHEN open AND ind AND NOT inm THEN 'bracket_day_first' ELSE h2 END AS how FROM q6),
v0 AS (SELECT *, CASE WHEN slash THEN coalesce(o3, mf) ELSE plain END AS txn_ts, slash AND o3 IS NULL AND mf IS DISTINCT FROM df AS amb,
  CASE WHEN {_nothing} THEN NULL WHEN k % 6 = 0 THEN CASE WHEN strftime(plain, '%H:%M:%S') = '00:00:00' THEN 'DAY' ELSE 'SECOND' END WHEN k % 6 = 1 THEN 'SECOND' WHEN k % 6 = 4 THEN 'DAY' ELSE 'MINUTE' END AS precision FROM q7),
v AS (SELECT *, CASE WHEN txn_ts IS NULL THEN 'UNKNOWN' WHEN amb THEN 'DATE_AMBIGUOUS' WHEN precision = 'DAY' THEN 'TIME_UNKNOWN' ELSE 'OBSERVED' END AS status,
  CASE WHEN k % 11 = 0 THEN NULL WHEN k % 3 = 1 THEN coalesce(try_strptime(SETTLE_DATE, '%m/%d/%Y'), try_strptime(SETTLE_DATE, '%d/%m/%Y')) ELSE b_settle END AS settled FROM (SELECT v0.*, b.settle AS b_settle FROM v0 JOIN b USING (k)))"""
oracle("ts_parse", f"SELECT k, {stamp('txn_ts')} AS txn_ts FROM v", STAMPS)
oracle("ts_epoch", f"SELECT k, {stamp('txn_ts')} AS txn_ts, precision AS txn_ts_precision FROM v WHERE k % 6 = 0 AND NOT {_nothing}", STAMPS)
oracle("ts_precision", "SELECT k, precision AS txn_ts_precision FROM v", STAMPS)
oracle("ts_ambiguous", "SELECT k, amb AS txn_ts_ambiguous FROM v", STAMPS)
oracle("ts_status", "SELECT k, status AS txn_ts_status FROM v", STAMPS)
oracle("ts_settle", f"SELECT k, {stamp('settled')} AS settle_date_cleaned FROM v", STAMPS)
oracle("ts_offset", f"SELECT k, CASE WHEN txn_ts IS NULL THEN '' WHEN {summer_local('txn_ts')} THEN 'UTC+3' ELSE 'UTC+2' END AS txn_ts_utc_offset FROM v", STAMPS)
_no_figures = STAMPS.replace("slash AND o0 IS NULL AND coalesce", "false AND coalesce").replace("slash AND o1 IS NULL AND coalesce", "false AND coalesce").replace("PARTITION BY account ORDER BY k ROWS", "PARTITION BY USER_ID ORDER BY k ROWS")
for _name, _prefix in {"ts_slash_forced": "forced", "ts_slash_macro": "macro", "ts_slash_bracket": "bracket"}.items():
    oracle(_name, f"SELECT k, how, {stamp('txn_ts')} AS txn_ts FROM v WHERE starts_with(how, '{_prefix}')", _no_figures if _prefix == "bracket" else STAMPS)
oracle(
    "ts_metrics",
    counts(
        "v", *((f"txn_ts.slash_{x}", n_if(f"how = '{x}'"), True) for x in ("forced_month_first", "forced_day_first", "bracket_month_first", "bracket_day_first")), *((f"txn_ts.slash_resolved_by[{x}]", n_if(f"how = 'macro[{x}]'"), True) for x in ("INTEREST_RATE_INDEX", "INFLATION_INDEX")),
        ("txn_ts.unrecognised_format", n_if("k % 101 = 0 AND k % 97 <> 0"), True), *((f"txn_ts.status[{x}]", n_if(f"status = '{x}'"), True) for x in ("OBSERVED", "TIME_UNKNOWN", "DATE_AMBIGUOUS", "UNKNOWN")), ("txn_ts.unparseable", n_if("txn_ts IS NULL"), True),
        ("txn_ts.offset_applied", n_if(f"k % 6 = 0 AND NOT {_nothing}"), True), ("txn_ts.ambiguous_day_month", n_if("amb"), True), *((f"txn_ts.precision[{x}]", n_if(f"precision = '{x}'"), True) for x in ("SECOND", "MINUTE", "DAY")),
        ("settle_date.null_token", n_if("k % 11 = 0"), True), ("settle_date.unparseable", n_if("settled IS NULL AND k % 11 <> 0"), True),
    ),
    STAMPS,
)
oracle("eda_lenient", f"SELECT k, CASE WHEN {_nothing} OR slash AND df IS NULL OR k % 6 IN (2, 4) THEN NULL WHEN slash THEN {stamp('df')} WHEN k % 6 = 0 THEN {stamp('ts')} ELSE {stamp('plain')} END AS seen FROM q", STAMPS)
MACRO = f"""{STAMPS}, g AS (SELECT k, txn_ts AS plain, NOT amb AND (how IS NULL OR starts_with(how, 'forced')) AS sure, strftime(txn_ts, '%Y-%m') AS month, strftime(txn_ts, '%Y-%m') || '|' || MERCHANT_COUNTRY AS pair, MERCHANT_COUNTRY AS country, INTEREST_RATE_INDEX AS rate, INFLATION_INDEX AS inflation, IS_HOLIDAY_MONTH AS holiday FROM v),
s1 AS (SELECT month AS key, any_value(rate) AS value FROM g WHERE rate IS NOT NULL AND plain IS NOT NULL AND sure GROUP BY 1),
s2 AS (SELECT pair AS key, any_value(inflation) AS value FROM g WHERE inflation IS NOT NULL AND plain IS NOT NULL AND sure GROUP BY 1),
s3 AS (SELECT pair AS key, any_value(holiday) AS value FROM g WHERE holiday IS NOT NULL AND plain IS NOT NULL AND sure GROUP BY 1),
j AS (SELECT g.*, s1.value AS v1, s2.value AS v2, s3.value AS v3 FROM g LEFT JOIN s1 ON month = s1.key LEFT JOIN s2 ON pair = s2.key LEFT JOIN s3 ON pair = s3.key)"""
oracle("macro_extract", "SELECT 'INTEREST_RATE_INDEX' AS series, key, value FROM s1 UNION ALL SELECT 'INFLATION_INDEX', key, value FROM s2 UNION ALL SELECT 'IS_HOLIDAY_MONTH', key, value FROM s3", MACRO)
oracle("macro_recover", "SELECT k, cast(coalesce(rate, v1) AS double) AS rate, cast(coalesce(inflation, v2) AS double) AS inflation FROM j", MACRO)
_covered = lambda seen, found, outside="false": f"CASE WHEN {seen} IS NOT NULL THEN 'OBSERVED' WHEN {outside} THEN 'OUT_OF_PANEL' WHEN {found} IS NOT NULL THEN 'RECOVERED' ELSE 'UNRECOVERABLE' END"
oracle("macro_coverage", f"SELECT k, {_covered('rate', 'v1')} AS interest_rate_index, {_covered('inflation', 'v2', chr(40) + 'country IN (' + ', '.join(repr(c) for c in rules.OUT_OF_PANEL) + '))')} AS inflation_index, {_covered('holiday', 'v3')} AS is_holiday_month FROM j", MACRO)
oracle("macro_coerce", "SELECT k, upper(coalesce(holiday, v3)) = 'TRUE' AS holiday FROM j", MACRO)
oracle(
    "macro_metrics",
    counts(
        f"(SELECT {_covered('rate', 'v1')} AS c1, {_covered('inflation', 'v2', chr(40) + 'country IN (' + ', '.join(repr(c) for c in rules.OUT_OF_PANEL) + '))')} AS c2, {_covered('holiday', 'v3')} AS c3 FROM j)",
        *((f"{name}.{x.lower()}", n_if(f"{c} = '{x}'"), False) for name, c in (("INTEREST_RATE_INDEX", "c1"), ("INFLATION_INDEX", "c2"), ("IS_HOLIDAY_MONTH", "c3")) for x in ("OBSERVED", "RECOVERED", "UNRECOVERABLE", "OUT_OF_PANEL")),
    ),
    MACRO,
)

# -- the report: every step's metrics over the view without repeats, one after another
_no_repeats = (
    f"{_T} SELECT 'exact_duplicate_rows_dropped' AS metric, 0::bigint AS value UNION ALL SELECT 'business_key_repeats[{_k1.replace(', ', '+')}]', cast(v AS bigint) FROM {_groups(_k1, 't')}"
    f" UNION ALL SELECT 'business_key_repeats[{_k2.replace(', ', '+')}]', cast(v AS bigint) FROM {_groups(_k2, 't')} UNION ALL SELECT 'txn_id_collisions', cast(v AS bigint) FROM {_groups('TXN_ID', 't')}"
)
_sections = {
    "dates": ORACLES["dates_formats"], "duplicates": _no_repeats, "codes": ORACLES["code_disagree"], "amounts": ORACLES["amount_metrics"], "missing": ORACLES["blank_counts"],
    "merchant": ORACLES["merchant_metrics"], "geo": ORACLES["geo_metrics"], "mcc": ORACLES["mcc_metrics"], "consistency": ORACLES["con_flags"],
    "pipeline": "SELECT 'input_rows' AS metric, count(*) AS value FROM orders UNION ALL SELECT 'output_rows', count(*) FROM orders",
}
oracle("report", " UNION ALL ".join(f"SELECT '{step}' AS step, metric, cast(value AS varchar) AS value FROM ({sql})" for step, sql in _sections.items()), "")
