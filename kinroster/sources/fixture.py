"""Staff tables derived from the driver's order tables.

The six texts below run unchanged in Spark and DuckDB, so the SQL that checks the engine starts
from the same rows. Every customer is a person; the first, third and fifth order start a spell of
employment that ends with the next order. Names, addresses and links drift by simple remainders,
such that every pass, every topology and every reason for review occurs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_FIRST = ("Robert", "Elizabeth", "Édouard", "Rajesh", "María", "William", "Łukasz", "Jennifer", "张伟", "Nicole", "Jean Paul", "Margaret", "Anaïs")
_SHORT = ("Bob", "Liz", "Édouard", "Raj", "Mária", "Bill", "Lukasz", "Jenny", "张伟", "Nikki", "JeanPaul", "Peggy", "Anais")
_LAST = ("O'Brien", "Núñez", "Kim-Patel", "Smith", "Wałęsa", "García", "Nguyen", "محمد", "Lopez", "François", "Singh")


def _pick(names: tuple[str, ...], by: str) -> str:
    cases = " ".join(f"WHEN {i} THEN '{n.replace(chr(39), chr(39) * 2)}'" for i, n in enumerate(names))
    return f"CASE {by} % {len(names)} {cases} END"


_STAMP = "CAST('2002-01-01 06:00:00' AS TIMESTAMP)"
_ID = "lpad(CAST(k AS STRING), 6, '0')"

#: name -> SQL over the driver's tables and the entries before it.
SQL: dict[str, str] = {
    "spells": f"""
SELECT k, n, spell_order, hired, ended, status, dept, place,
  {_pick(_FIRST, "k")} AS first_name, {_pick(_SHORT, "k")} AS short_name,
  {_pick(_LAST, "k")} || CASE WHEN n > 1 AND k % 9 = 0 THEN '-Ray' ELSE '' END AS last_name,
  {_pick(tuple(f"{a}.{b}" for a, b in zip(("rob", "liz", "ed", "raj", "maria", "bill", "luk", "jen", "wei", "nic", "jp", "meg", "ana"), ("ob", "nu", "kp", "sm", "wa", "ga", "ng", "mo", "lo", "fr", "si", "ob", "nu"), strict=True)), "k")} || CAST(k AS STRING) AS handle
FROM (
  SELECT o_custkey AS k, o_orderkey AS spell_order, CAST(o_orderdate AS DATE) AS hired, o_orderstatus AS status,
    c_mktsegment AS dept, r_name AS place,
    CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS INT) AS n,
    lead(CAST(o_orderdate AS DATE)) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS ended
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
) ranked
WHERE n IN (1, 3, 5) AND (ended IS NULL OR ended > hired)""",
    "hris_employees": f"""
SELECT 'HR_' || {_ID} || CASE WHEN n = 1 THEN '' ELSE '_R' || CAST(n AS STRING) END AS hris_employee_id,
  '  ' || first_name AS legal_first_name, last_name AS legal_last_name,
  CASE WHEN k % 5 = 0 THEN ' ' WHEN k % 5 < 3 THEN short_name END AS preferred_name,
  CASE WHEN k % 97 <> 0 THEN CAST(CAST('1945-01-01' AS DATE) + CAST((k * 37) % 14600 AS INT) AS DATE) END AS date_of_birth,
  CASE WHEN k % 89 <> 0 THEN 'P.' || handle || '@Gmail.com' END AS personal_email,
  CASE WHEN k % 13 = 0 THEN 'broken-address' ELSE handle || '@northwind.example' END AS work_email,
  hired AS hire_date, ended AS termination_date,
  CASE WHEN ended IS NULL THEN 'active' ELSE 'terminated' END AS employment_status,
  CASE status WHEN 'O' THEN 'fte' WHEN 'F' THEN 'contractor' ELSE 'part_time' END AS employment_type,
  dept AS department, CASE WHEN n = 1 THEN 'Associate' ELSE 'Senior' END AS job_title,
  CASE WHEN k > 10 THEN 'HR_' || lpad(CAST(k % 10 + 1 AS STRING), 6, '0') END AS manager_hris_id,
  CASE WHEN k % 31 <> 0 THEN place END AS location, {_STAMP} AS loaded_at
FROM spells""",
    "ats_candidates": f"""
SELECT 'ats_' || CAST(k AS STRING) || '_' || CAST(n AS STRING) AS ats_candidate_id, short_name AS preferred_first_name, last_name,
  CASE WHEN k % 4 = 0 THEN 'old.' || handle || '@mail.example' WHEN k % 23 = 0 THEN NULL ELSE 'p.' || handle || '@gmail.com' END AS email,
  '555-' || CAST(1000 + k % 9000 AS STRING) AS phone, CAST(hired + CAST(0 - 30 AS INT) AS DATE) AS application_date,
  CAST(hired + CAST(k % 5 AS INT) AS DATE) AS offer_accepted_date, CASE k % 3 WHEN 0 THEN 'LinkedIn' WHEN 1 THEN 'Referral' ELSE 'Indeed' END AS sourced_from,
  dept AS requisition_department, 'Associate' AS requisition_job_title, {_STAMP} AS loaded_at
FROM spells WHERE k % 11 <> 0""",
    "payroll_records": f"""
SELECT 'PAY-' || CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) || '-' || CAST(l_partkey AS STRING) || '-' || CAST(l_suppkey AS STRING) || '-' || CAST(CAST(l_quantity AS INT) AS STRING) || '-' || CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS STRING) AS payroll_record_id,
  'PAY' || CAST(k AS STRING) || '-' || CAST(n AS STRING) AS employee_payroll_id, first_name AS legal_first_name,
  last_name || CASE WHEN k % 21 = 0 AND l_linenumber % 2 = 0 THEN '-New' ELSE '' END AS legal_last_name, lpad(CAST(l_partkey % 10000 AS STRING), 4, '0') AS sin_last_4,
  CAST(l_shipdate AS DATE) AS pay_period_start, CAST(CAST(l_shipdate AS DATE) + 13 AS DATE) AS pay_period_end,
  CAST(l_extendedprice AS DECIMAL(12, 2)) AS gross_amount_cad, CAST(l_quantity AS DECIMAL(8, 2)) AS hours_worked,
  l_returnflag AS job_code, l_linestatus AS cost_center, {_STAMP} AS loaded_at
FROM spells JOIN lineitem ON l_orderkey = spell_order""",
    "crm_sales_reps": f"""
SELECT 'crm_user_' || CAST(k AS STRING) || '_' || CAST(n AS STRING) AS crm_user_id, short_name AS preferred_first_name, last_name,
  short_name || ' ' || last_name AS display_name,
  CASE WHEN k % 15 = 0 THEN NULL WHEN k % 2 = 0 THEN handle || '@northwind.example' ELSE 'sales.' || CASE WHEN k % 7 = 0 THEN 'x' ELSE '' END || substr(handle, strpos_dot) || '@northwind.example' END AS crm_email,
  place AS location_id, CASE k % 2 WHEN 0 THEN 'sales_rep' ELSE 'support_agent' END AS role, ended IS NULL AS active,
  CAST(CAST(hired + CAST(k % 9 AS INT) AS DATE) AS TIMESTAMP) AS created_at, CAST(ended AS TIMESTAMP) AS deactivated_at, {_STAMP} AS loaded_at
FROM (SELECT *, CAST(instr(handle, '.') + 1 AS INT) AS strpos_dot FROM spells) s WHERE k % 3 = 0""",
    "dms_users": f"""
SELECT 'DMS' || {_ID} || '_' || CAST(n AS STRING) AS dms_user_id, short_name AS short_first_name, last_name, handle AS dms_username,
  place AS location_code, dept AS department_code, CAST(hired + CAST(k % 6 - 2 AS INT) AS DATE) AS hire_date_dms, ended AS terminated_date_dms, {_STAMP} AS loaded_at
FROM spells WHERE k % 2 = 0""",
    "erp_users": f"""
SELECT 'erp.' || CAST(k AS STRING) || '_' || CAST(n AS STRING) AS erp_user_id,
  CASE WHEN k % 10 = 0 THEN NULL WHEN k % 10 = 1 THEN 'DMS-GONE-' || CAST(k AS STRING) || '_' || CAST(n AS STRING) ELSE 'DMS' || {_ID} || '_' || CAST(n AS STRING) END AS linked_dms_user_id,
  short_name AS short_first_name, last_name,
  CASE WHEN k % 3 = 0 THEN handle || '@northwind.example' WHEN k % 3 = 1 THEN 'erp.' || handle || '@northwind.example' END AS erp_email,
  'R' || CAST(k % 7 AS STRING) AS role_code, 'G' || CAST(k % 4 AS STRING) AS permissions_group,
  CAST(CAST(hired + CAST(k % 12 AS INT) AS DATE) AS TIMESTAMP) AS created_at, CAST(ended AS TIMESTAMP) AS last_login_at, {_STAMP} AS loaded_at
FROM spells WHERE k % 2 = 0 OR k % 10 = 1""",
}

DRIVER_TABLES = ("orders", "customer", "nation", "region", "lineitem")


def sources(spark: SparkSession, sf_dir: str, keep: Callable[[str, DataFrame], DataFrame] | None = None) -> dict[str, DataFrame]:
    """The six raw tables, lazily; ``keep`` writes the spells, from which all six are derived, and reads them back."""
    known = {name: spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in DRIVER_TABLES}
    for name, text in SQL.items():
        used = {t: df for t, df in known.items() if f" {t} " in text + " " or f" {t})" in text or f" {t}\n" in text}
        for t in used:
            text = text.replace(f"FROM {t}", f"FROM {{{t}}}").replace(f"JOIN {t}", f"JOIN {{{t}}}")
        df = spark.sql(text, **used)
        df = df.withColumns({c: F.col(c).cast("timestamp_ntz") for c, kind in df.dtypes if kind == "timestamp"})
        known[name] = keep(name, df) if keep and name == "spells" else df
    return {name: known[name] for name in SQL if name != "spells"}
