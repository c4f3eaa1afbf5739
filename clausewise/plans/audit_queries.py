"""Queries on the contract audit, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import audit as A
from . import fixtures


def _audited(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.audit(fixtures.contracts(spark, sf_dir), fixtures.AS_OF)


def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.violations(_audited(spark, sf_dir)).withColumn("ord", F.col("ord").cast("bigint"))


def audit_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _audited(spark, sf_dir).select("doc_id", "status", F.size("violations").cast("bigint").alias("n_violations"))


def audit_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, sf_dir)


def audit_category_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.category_counts(_found(spark, sf_dir))


def audit_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _audited(spark, sf_dir).groupBy("status").agg(F.count("*").alias("n"))


RULES = {
    "audit_term_clause": ["L2b", "L2c", "L2d", "L2e", "L2f"],
    "audit_payment_term": ["L3a", "L3b", "L3c"],
    "audit_prepayment": ["L4"],
    "audit_acceptance": ["L5"],
    "audit_pay_day": ["L6"],
    "audit_form_protocol_changes": ["L1", "L7", "L8"],
    "audit_spec_framework": ["L10", "L11"],
}


def _rules(names: list[str]):
    return lambda spark, sf_dir: _found(spark, sf_dir).filter(F.col("rule_id").isin(names)).select("doc_id", "rule_id", "description", "found_text")


def _any(column: str, parts: list[str]) -> str:
    return "(" + " OR ".join(f"contains({column}, '{p}')" for p in parts) + ")"


def _sentence(phrase: str, reach: int) -> str:
    at = f"(strpos(lo, '{phrase}') - 1)"
    back = f"strpos(reverse(left(text, {at})), '.')"
    start = f"(CASE WHEN {back} > 0 THEN {at} - {back} + 1 ELSE 0 END)"
    ahead = f"strpos(substr(text, {at} + 1), '.')"
    end = f"(CASE WHEN {ahead} > 0 THEN {at} + {ahead} - 1 ELSE least({at} + {reach}, length(text)) END)"
    return f"substr(text, {start} + 1, {end} - {start})"


def _strip(x: str) -> str:
    return rf"regexp_replace({x}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"


_form = " ".join(f"WHEN contains(lo, '{p}') THEN {_strip(_sentence(p, 100))}" for p in A.FORM_PHRASES)
_changes = " ".join(f"WHEN contains(lo, '{p}') AND NOT {_any('lower(' + _sentence(p, 150) + ')', A.ALLOWED_CHANGES)} THEN {_strip(_sentence(p, 150))}" for p in A.CHANGES)
_months = ", ".join(f"'{m}'" for m in A.MONTHS)
_label = " ".join(f"WHEN contains(lower(x), '{p}') THEN '{d}'" for p, d in A.SPELLED_DAYS)
_missing = "array_to_string([p FOR p IN [" + ", ".join(f"'{p}'" for p in A.SPECIFICATION_PARTS) + "] IF NOT contains(lo, p)], ', ')"
_lines = r"string_split_regex(text, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]')"
_pay = r"(?i)(?:течение|срок|в)\s+(\d+)\s+(календарн[\p{L}\p{N}_]*|рабочих?)\s+дн[\p{L}\p{N}_]*"
_acc = r"(?i)(?:прием|акт)[^.\n]*?(\d+)\s*рабочих?\s*дн"
_end = A.P_END

RULES_SQL = f"""
c AS (SELECT doc_id, text, lower(text) AS lo, string_split_regex(text, '[.\\n]') AS pieces, {_lines} AS lines FROM c0 WHERE text IS NOT NULL AND length(text) >= 50 AND {_strip('text')} <> ''),
term AS (
  SELECT doc_id, CASE WHEN contains(lo, 'срок действия') OR contains(lo, 'договор действует') THEN
    {_strip("string_split_regex(substr(text, strpos(lo, CASE WHEN contains(lo, 'срок действия') THEN 'срок действия' ELSE 'договор действует' END)), '[.\\n]')[1]")} END AS clause FROM c
), term2 AS (
  SELECT doc_id, clause, lower(clause) AS cl, TRY_CAST(regexp_extract(lower(clause), '{A.P_DURATION}', 1) AS BIGINT) AS num, regexp_extract(lower(clause), '{A.P_DURATION}', 0) AS unit,
    TRY_CAST(printf('%04d-%02d-%02d', coalesce(TRY_CAST(regexp_extract(lower(clause), '{_end}', 3) AS INT), 0), coalesce(list_position([{_months}], regexp_extract(lower(clause), '{_end}', 2)), 0),
      coalesce(TRY_CAST(regexp_extract(lower(clause), '{_end}', 1) AS INT), 0)) AS DATE) AS until FROM term
), pay AS (SELECT doc_id, text, lo, lines, regexp_extract(text, '{_pay}', 0) AS m, TRY_CAST(regexp_extract(text, '{_pay}', 1) AS BIGINT) AS days FROM c),
pay2 AS (SELECT *, strpos(text, m) AS m_at, [x FOR x IN lines IF {_any('lower(x)', ['оплат', 'платеж', 'расчет'])} AND {_any('lower(x)', ['дней', 'дня'])} AND NOT regexp_matches(x, '\\p{{Nd}}') AND {_any('lower(x)', ['шестидесяти', *A.SPELLED])}] AS spelled FROM pay),
v AS (
  SELECT doc_id, 1 AS k, 0 AS j, 'L1' AS rule_id, '{A.D_FORM}' AS description, CASE {_form} END AS found_text FROM c WHERE {_any('lo', A.FORM_PHRASES)}
  UNION ALL SELECT doc_id, 2, 0, r, d, coalesce(clause, '') FROM (SELECT doc_id, clause, CASE WHEN clause IS NULL THEN 'L2f' WHEN {_any('cl', A.UNLIMITED)} THEN 'L2b' WHEN num IS NOT NULL THEN 'L2c' WHEN until IS NULL THEN 'L2e' ELSE 'L2d' END AS r,
      CASE WHEN clause IS NULL THEN '{A.D_NO_TERM}' WHEN {_any('cl', A.UNLIMITED)} THEN '{A.D_UNLIMITED}'
           WHEN num IS NOT NULL AND contains(unit, 'месяц') THEN CASE WHEN num > 36 THEN '{A.D_OVER}' || num || ' мес.)' END
           WHEN num IS NOT NULL THEN CASE WHEN num > 3 THEN '{A.D_OVER}' || num || ' года)' END WHEN until IS NULL THEN '{A.D_NO_END}'
           WHEN until - DATE '2025-01-01' > 1095 THEN '{A.D_OVER}' || printf('%.1f', (until - DATE '2025-01-01') / 365.0) || ' года до ' || strftime(until, '%d.%m.%Y') || ')' END AS d FROM term2) WHERE d IS NOT NULL
  UNION ALL SELECT doc_id, 3, 0, 'L3a', '{A.D_PAYMENT}' || days || CASE WHEN contains(lower(m), 'рабочих') THEN ' рабочих дн.)' ELSE ' дн.)' END, m FROM pay2
    WHERE m <> '' AND CASE WHEN contains(lower(m), 'рабочих') THEN days < 43 ELSE days < 60 AND NOT {_any("substr(lo, greatest(m_at - 50, 1), m_at + length(m) + 50 - greatest(m_at - 50, 1))", ['закона', ' фз'])} END
  UNION ALL SELECT doc_id, 3, j, 'L3b', '{A.D_PAYMENT}' || CASE {_label} END || ')', {_strip('x')} FROM (SELECT doc_id, unnest(spelled) AS x, generate_subscripts(spelled, 1) AS j FROM pay2 WHERE m = '') WHERE NOT contains(lower(x), 'шестидесяти')
  UNION ALL SELECT doc_id, 3, 0, 'L3c', '{A.D_NO_PAYMENT}', '' FROM pay2 WHERE m = '' AND len(spelled) = 0
  UNION ALL SELECT doc_id, 4, 0, 'L4', CASE WHEN {_any('lo', A.APPROVALS)} THEN '{A.D_PREPAID_CHECK}' ELSE '{A.D_PREPAID}' END, {_strip('p[1]')}
    FROM (SELECT doc_id, lo, [x FOR x IN pieces IF {_any('lower(x)', ['предоплат', 'аванс'])} AND NOT {_any('lower(x)', ['без предоплат', 'без аванс', 'не '])}] AS p FROM c) WHERE len(p) > 0
  UNION ALL SELECT doc_id, 5, 0, 'L5', CASE WHEN m = '' THEN '{A.D_NO_ACCEPT}' ELSE '{A.D_ACCEPT}' || days || ' дн.)' END, m
    FROM (SELECT doc_id, regexp_extract(text, '{_acc}', 0) AS m, TRY_CAST(regexp_extract(text, '{_acc}', 1) AS BIGINT) AS days FROM c WHERE {_any('lo', ['услуг', 'работ'])}) WHERE m = '' OR days < 5
  UNION ALL SELECT doc_id, 6, 0, 'L6', CASE WHEN x IS NULL THEN '{A.D_NO_PAY_DAY}' ELSE '{A.D_PAY_DAY}' END, coalesce({_strip('x')}, '')
    FROM (SELECT doc_id, [x FOR x IN lines IF contains(lower(x), 'платеж') AND contains(lower(x), 'недел')][1] AS x FROM c) WHERE x IS NULL OR NOT {_any('lower(x)', ['1 раз в неделю', 'один раз в неделю', 'один платежный день'])}
  UNION ALL SELECT doc_id, 7, 0, 'L7', '{A.D_PROTOCOL}', {_strip("[x FOR x IN pieces IF contains(lower(x), 'протокол разноглас')][1]")} FROM c WHERE contains(lo, 'протокол разноглас')
  UNION ALL SELECT doc_id, 8, 0, 'L8', '{A.D_CHANGES}', f FROM (SELECT doc_id, CASE {_changes} END AS f FROM c) WHERE f IS NOT NULL
  UNION ALL SELECT doc_id, 10, 0, 'L10', '{A.D_SPECIFICATION}' || {_missing}, '{A.F_SPECIFICATION}' FROM c WHERE {_any('lo', A.SPECIFICATION)} AND len([p FOR p IN ['{"', '".join(A.SPECIFICATION_PARTS)}'] IF NOT contains(lo, p)]) > 2
  UNION ALL SELECT doc_id, 11, 0, 'L11', '{A.D_FRAMEWORK}', '{A.F_FRAMEWORK}' FROM c WHERE {_any('lo', A.FRAMEWORK)} AND NOT {_any('lo', ['лимит', 'объем'])}
)"""
VIOLATIONS_SQL = f"c0 AS ({fixtures.contracts_sql()}),{RULES_SQL}"
_status = f"""SELECT c0.doc_id, CASE WHEN c.doc_id IS NULL THEN '{A.UNKNOWN}' WHEN count(v.doc_id) > 0 THEN '{A.NONSTANDARD}' ELSE '{A.STANDARD}' END AS status, count(v.doc_id) AS n_violations
FROM c0 LEFT JOIN c ON c.doc_id = c0.doc_id LEFT JOIN v ON v.doc_id = c0.doc_id GROUP BY c0.doc_id, c.doc_id"""
_category = "CASE " + " ".join(f"WHEN {_any('lower(description)', ps)} THEN '{name}'" for name, ps in A.CATEGORIES) + f" ELSE '{A.OTHER}' END"

QUERIES = {f.__name__: f for f in (audit_status, audit_violations, audit_category_counts, audit_status_counts)} | {k: _rules(r) for k, r in RULES.items()}
ORACLES = {
    "audit_status": f"WITH {VIOLATIONS_SQL} {_status}",
    "audit_violations": f"WITH {VIOLATIONS_SQL} SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k, j) AS ord, rule_id, description, found_text FROM v",
    "audit_category_counts": f"WITH {VIOLATIONS_SQL} SELECT {_category} AS category, count(*) AS n FROM v GROUP BY 1",
    "audit_status_counts": f"WITH {VIOLATIONS_SQL} SELECT status, count(*) AS n FROM ({_status}) GROUP BY 1",
} | {k: f"WITH {VIOLATIONS_SQL} SELECT doc_id, rule_id, description, found_text FROM v WHERE rule_id IN ({', '.join(repr(x) for x in r)})" for k, r in RULES.items()}
