"""The engine's queries over the driver's tables, and the SQL that says the same."""

from __future__ import annotations

import atexit
import contextlib
import datetime as dt
import uuid
from collections.abc import Callable
from functools import reduce

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import matching, names
from ..functions import privacy as k_anonymity
from ..operators import checks, gates, identity, metrics, privacy, residual, workforce
from ..sources import fixture, raw
from . import build, oracle
from .engine import Engine

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def engine(spark: SparkSession, sf_dir: str) -> Engine:
    """An engine over the derived tables. Its run's tables outlive the query, whose result reads them, and go when the process ends."""
    made = Engine(spark, {})
    made.sources = fixture.sources(spark, sf_dir, made.store.table)
    atexit.register(_dropped, made)
    return made


def _dropped(made: Engine) -> None:
    with contextlib.suppress(Py4JError, OSError):  # the session may have ended before
        made.drop()


def flat(df: DataFrame) -> DataFrame:
    """Arrays as joined text, decimals as doubles, times as text: what both engines print alike."""
    out = {}
    for name, kind in df.dtypes:
        if kind.startswith("array"):
            out[name] = F.array_join(name, "|")
        elif kind.startswith("decimal"):
            out[name] = F.col(name).cast("double")
        elif kind.startswith("timestamp"):
            out[name] = F.date_format(name, "yyyy-MM-dd HH:mm:ss")
    return df.withColumns(out) if out else df


def query(name: str, build: Callable[[Engine], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = lambda spark, sf_dir: flat(build(engine(spark, sf_dir)))
    if sql:
        ORACLES[name] = sql if sql.startswith("WITH ") else oracle.sql(sql)


TIMES = ("loaded_at", "created_at", "deactivated_at", "last_login_at", "erp_created_at", "erp_last_login_at", "generated_at")
_ARRAYS = ("hris_employee_ids", "ats_candidate_ids", "employee_payroll_ids", "payroll_spell_keys", "crm_user_ids", "dms_user_ids", "erp_user_ids")


def shown(model: str) -> str:
    """The model's columns as ``flat`` shows them."""
    text = oracle.MODELS[model]
    body = oracle.sql(f"SELECT * FROM {model}")
    stars = []
    for c in TIMES:
        if c in text and (model != "canonical_person" or c == "loaded_at") and not (model.startswith(("identity", "stewardship", "dim", "payroll", "hris", "canonical")) and c != "loaded_at") and not (model == "dms_erp_unified" and c in ("created_at", "last_login_at")):
            stars.append(f"strftime({c}, '%Y-%m-%d %H:%M:%S') AS {c}")
    if model in ("hris_persons", "canonical_person"):
        stars += [f"array_to_string({c}, '|') AS {c}" for c in _ARRAYS if model == "canonical_person" or c == "hris_employee_ids"]
    if model in ("stg_payroll", "payroll_spells"):
        stars += [f"{c}::DOUBLE AS {c}" for c in (("gross_amount_cad", "hours_worked") if model == "stg_payroll" else ("gross_amount_cad_total", "hours_worked_total"))]
    return body.replace(f"\nSELECT * FROM {model}", f"\nSELECT * {'REPLACE (' + ', '.join(stars) + ')' if stars else ''} FROM {model}")


for _name in Engine.MODELS:
    if _name != "workforce_daily":
        query(_name, lambda e, n=_name: getattr(e, n), shown(_name))

query("payroll_spells", lambda e: e.payroll_spells.withColumn("gross_amount_cad_avg_per_period", F.col("gross_amount_cad_total").cast("double") / F.col("pay_period_count")), ORACLES["payroll_spells"])
# A row for each spell, from all of its days; ``content`` adds up a hash of every column of every day.
_DAY = ("daily_workforce_key", "snapshot_date", "employee_sk", "canonical_person_id", "department", "location", "employment_type", "is_active_on_date", "is_hire_date", "is_termination_date", "tenure_days")


def _by_spell(e: Engine) -> DataFrame:
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in _DAY])
    content = F.sum(F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")).alias("content")
    return e.workforce_daily.groupBy("employee_sk").agg(F.count("*").alias("days"), F.min("snapshot_date").alias("first_day"), F.max("snapshot_date").alias("last_day"), content)


query(
    "workforce_daily",
    _by_spell,
    "SELECT employee_sk, count(*) AS days, min(snapshot_date) AS first_day, max(snapshot_date) AS last_day, sum(CAST('0x' || substr(md5(concat_ws('|', "
    + ", ".join(f"coalesce({c}::VARCHAR, '~')" for c in _DAY) + ")), 1, 8) AS BIGINT))::BIGINT AS content FROM workforce_daily GROUP BY 1",
)

# Metric queries and what the dashboard shows.
_FIRST_QUARTER = metrics.Filters(dt.date(1998, 1, 1), dt.date(1998, 3, 31), "BUILDING", None, "FTE", 5000)
_WHERE = "department = 'BUILDING' AND employment_type = 'FTE'"


def surface_sql(name: str, table: str, where: str) -> str:
    known = metrics.SURFACES[name]
    columns = [f"strftime({c}, '%Y-%m-%d %H:%M:%S') AS {c}" if c == "generated_at" else c for c in known.columns]
    return f"SELECT {', '.join(columns)} FROM {table} WHERE {where} ORDER BY {', '.join(known.order)} LIMIT 5000"


def written(e: Engine, model: str) -> DataFrame:
    """A mart as a build writes it, with a folder for each month."""
    build.run(e, f"{e.store.path}/built", model, rules=[])
    return getattr(e, model)


def by_name(e: Engine, surface: str, model: str, filters: metrics.Filters) -> DataFrame:
    """The same rows by SQL with bound values over the published table."""
    written(e, model)
    database = f"run_{uuid.uuid4().hex}"
    build.publish(e.spark, f"{e.store.path}/built", database, (model,))
    return metrics.statement(surface, filters, database, model).run(e.spark)


query("metric_headcount_filtered", lambda e: metrics.metric_query(written(e, "headcount_daily"), "headcount", _FIRST_QUARTER), surface_sql("headcount", "headcount_daily", f"snapshot_date BETWEEN DATE '1998-01-01' AND DATE '1998-03-31' AND {_WHERE}"))
query("metric_attrition_filtered", lambda e: metrics.metric_query(written(e, "attrition_monthly"), "attrition", _FIRST_QUARTER), surface_sql("attrition", "attrition_monthly", f"month_start_date BETWEEN DATE '1998-01-01' AND DATE '1998-03-31' AND {_WHERE}"))
query("metric_headcount_sql", lambda e: by_name(e, "headcount", "headcount_daily", _FIRST_QUARTER), ORACLES["metric_headcount_filtered"])
query("metric_attrition_sql", lambda e: by_name(e, "attrition", "attrition_monthly", _FIRST_QUARTER), ORACLES["metric_attrition_filtered"])
query("metric_suppression", lambda e: metrics.metric_query(e.suppression_summary, "suppression", metrics.Filters(limit=100)), surface_sql("suppression", "suppression_summary", "true"))
query("metric_suppression_of_one", lambda e: metrics.metric_query(e.suppression_summary, "suppression", metrics.Filters(privacy_surface="workforce_headcount_daily")), surface_sql("suppression", "suppression_summary", "privacy_surface = 'workforce_headcount_daily'"))
query("metric_metadata", lambda e: metrics.metadata(e.suppression_summary), "SELECT string_agg(privacy_surface, '||' ORDER BY privacy_surface) AS surfaces, count(*) AS surface_count, sum(row_count)::BIGINT AS row_count, count(*) FILTER (suppressed_row_count > 0) AS surfaces_with_suppression, min(k_anonymity_threshold) AS k_anonymity_threshold FROM suppression_summary")
query("dashboard_headcount_trend", lambda e: metrics.headcount_trend(e.headcount_daily), "SELECT snapshot_date, sum(headcount)::BIGINT AS headcount FROM headcount_daily WHERE is_reportable GROUP BY 1")
query("dashboard_attrition_trend", lambda e: metrics.attrition_trend(e.attrition_monthly).withColumn("attrition_rate", F.round("attrition_rate", 9)), "SELECT month_start_date, round(avg(attrition_rate), 9) AS attrition_rate FROM attrition_monthly WHERE attrition_rate IS NOT NULL GROUP BY 1")
query("dashboard_latest_headcount", lambda e: metrics.latest_headcount(e.headcount_daily), "SELECT sum(headcount)::BIGINT AS headcount, snapshot_date FROM headcount_daily WHERE is_reportable GROUP BY 2 ORDER BY 2 DESC LIMIT 1")
query("dashboard_latest_attrition", lambda e: metrics.latest_attrition(e.attrition_monthly).withColumn("attrition_rate", F.round("attrition_rate", 9)), "SELECT round(avg(attrition_rate), 9) AS attrition_rate, month_start_date FROM attrition_monthly WHERE is_reportable AND attrition_rate IS NOT NULL GROUP BY 2 ORDER BY 2 DESC LIMIT 1")
query("dashboard_suppression", lambda e: metrics.suppression_kpis(e.suppression_summary), "SELECT sum(reportable_row_count)::BIGINT AS reportable_rows, sum(suppressed_row_count)::DOUBLE / sum(row_count)::DOUBLE AS suppression_rate FROM suppression_summary")
query("dashboard_window", lambda e: metrics.default_window(e.headcount_daily), "SELECT greatest(min(snapshot_date), max(snapshot_date) - 6) AS start_date, max(snapshot_date) AS end_date FROM headcount_daily")

_ASKED = metrics.Filters(dt.date(1998, 1, 1), dt.date(1998, 1, 31), None, None, "FTE", 50)


def _audited(e: Engine) -> DataFrame:
    """Two answers, and what the log then holds; event ids are random."""
    log = f"{e.store.path}/audit"
    for surface, mart in (("headcount", e.headcount_daily), ("suppression", e.suppression_summary)):
        metrics.respond(e.spark, mart, surface, _ASKED, e.cfg, "review", log, "analyst" if surface == "headcount" else None)
    return privacy.audit_log(e.spark, log).drop("audit_event_id")


def _logged(actor: str, surface: str, rows: str, hidden: str) -> str:
    return f"""SELECT '2001-12-31 00:00:00' AS audited_at, '{actor}' AS actor, '{surface}' AS query_surface, 'review' AS purpose,
 '{{"employment_type": "FTE", "end_date": "1998-01-31", "limit": 50, "start_date": "1998-01-01"}}' AS filters_json, 5 AS k_anonymity_threshold, ({rows})::BIGINT AS result_row_count, ({hidden})::BIGINT AS suppressed_row_count,
 'k-anonymity-v1' AS privacy_policy_version, NULL::VARCHAR AS dbt_invocation_id"""


_SHOWN = "SELECT is_reportable FROM headcount_daily WHERE snapshot_date BETWEEN DATE '1998-01-01' AND DATE '1998-01-31' AND employment_type = 'FTE' ORDER BY snapshot_date, department, location, employment_type LIMIT 50"
query("privacy_audit_log", _audited, _logged("analyst", "workforce_headcount_daily", f"SELECT count(*) FROM ({_SHOWN})", f"SELECT count(*) FROM ({_SHOWN}) WHERE NOT is_reportable") + " UNION ALL " + _logged("anonymous", "privacy_suppression_summary", "SELECT count(*) FROM suppression_summary", "0"))

# Golden cases of the scalar functions.
NAME_CASES = ("Robert", "  Robert  ", "Édouard", "Anaïs", "Mary-Jane", "O'Brien", "Jean Paul", "Núñez", "François", "", None, "Robert3", "张伟", "محمد", "Łukasz")
ROOT_CASES = ("Robert", "Bob", "Bobby", "Rob", "Liz", "Beth", "Raj", "Paco", "Aiden", "Steve", "  BoB  ", "Mária", "", None)


def _values(cases: tuple[str | None, ...]) -> str:
    return "(VALUES " + ", ".join(f"({i}, " + ("CAST(NULL AS VARCHAR)" if c is None else "'" + c.replace("'", "''") + "'") + ")" for i, c in enumerate(cases)) + ") v(case_id, name)"


def _cases(e: Engine, cases: tuple[str | None, ...]) -> DataFrame:
    return e.spark.createDataFrame(list(enumerate(cases)), "case_id int, name string")


query("normalize_name_cases", lambda e: _cases(e, NAME_CASES).withColumn("normalized", names.normalize_name(F.col("name"))), f"SELECT case_id, name, {oracle.norm('name')} AS normalized FROM {_values(NAME_CASES)}")
query("first_name_root_cases", lambda e: names.with_root(_cases(e, ROOT_CASES), F.col("name"), e.nicknames, "root"), f"SELECT case_id, name, {oracle.root('name')} AS root FROM {_values(ROOT_CASES)}")
query("k_anonymity_cases", lambda e: e.spark.range(3, 8).select(F.col("id").alias("n")).withColumns({"metric": k_anonymity.masked(F.lit(100), F.col("n"), e.cfg.k, "long")} | k_anonymity.privacy_columns(F.col("n"), e.cfg.k)), f"SELECT n, {oracle.masked('100::BIGINT', 'n')} AS metric, {oracle.shown('n')} FROM range(3, 8) r(n)")

_BITS = {a: 1 << i for i, a in enumerate((*matching.ANCHORS, *matching.HIRE_STEPS, "structural_fk_match"))}
_HELD = {a: f"(id & {b}) <> 0" for a, b in _BITS.items()}
_SUM = " + ".join(f"CASE WHEN {_HELD[a]} THEN {int(w * 100)} ELSE 0 END" for a, w in matching.ANCHORS.items())
_HIRE = "CASE " + " ".join(f"WHEN {_HELD[a]} THEN {int(w * 100)}" for a, w in matching.HIRE_STEPS.items()) + " ELSE 0 END"


def _confidence(e: Engine) -> DataFrame:
    """All combinations of anchors."""
    held = {a: F.expr(c) for a, c in _HELD.items()}
    score = F.round(matching.match_score(**held), 2)
    count = matching.match_anchor_count(**{a: c for a, c in held.items() if a != "structural_fk_match"})
    return e.spark.range(1 << len(_BITS)).select("id", score.alias("score"), count.alias("anchors"), matching.auto_merge_qualified(score, count, held["structural_fk_match"]).alias("qualified"))


query(
    "match_confidence_cases",
    _confidence,
    f"SELECT id, score, anchors, {_HELD['structural_fk_match']} OR (score >= 0.95 AND anchors >= 2) AS qualified FROM (SELECT id, CASE WHEN {_HELD['structural_fk_match']} THEN 1.0 ELSE least(100, {_SUM} + {_HIRE}) / 100.0 END::DOUBLE AS score, "
    + " + ".join(f"({_HELD[a]})::INT" for a in matching.ANCHORS) + f" + ({_HELD['hire_date_exact']} OR {_HELD['hire_date_within_7d']})::INT AS anchors FROM range({1 << len(_BITS)}) r(id))",
)

# Review candidates of the whole queue.
def _identities(e: Engine, mode: str = "parity") -> tuple[DataFrame, DataFrame]:
    """All queued identities, and those that they are compared with."""
    return residual.source_identities(e.stewardship_queue), residual.canonical_identities(e.canonical_person, mode)


def _scores(e: Engine, mode: str = "parity") -> tuple[DataFrame, DataFrame]:
    """All queued identities, and their scored pairs."""
    sources, people = _identities(e, mode)
    return sources, residual.scored(residual.candidate_pairs(sources, people))


def _ranked(e: Engine, mode: str = "parity") -> DataFrame:
    return residual.best(*_identities(e, mode), e.store.table)


def _reviewed(e: Engine, evaluate: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    ranked = e.store.table("residual_candidates", _ranked(e))
    return evaluate(_identities(e)[0], ranked).withColumn("value", F.round("value", 9))


query("residual_scores", lambda e: residual.exported(residual.suggested(_scores(e)[1])), f"SELECT {oracle.REVIEW_FILE} FROM review_suggested")
query("residual_ranked", lambda e: residual.exported(_ranked(e)), f"SELECT {oracle.REVIEW_FILE} FROM review_ranked")
query("residual_ranked_normalized", lambda e: residual.exported(_ranked(e, "normalized")), f"SELECT {oracle.REVIEW_FILE} FROM review_ranked_folded")
query("residual_summary", lambda e: _reviewed(e, residual.summary), oracle.REVIEW_SUMMARY)
query("proxy_evaluation", lambda e: _reviewed(e, residual.proxy_evaluation), oracle.REVIEW_PROXY)


# Data checks, with the number of rows that break each rule.
def _counted(e: Engine, rules: list[gates.Rule]) -> DataFrame:
    return gates.counts(lambda model: getattr(e, model), gates.rules_of(e.cfg, rules), lambda rule: _repeats(e, rule))


def _repeats(e: Engine, rule: gates.Rule) -> DataFrame | None:
    """Days are derived from spells. A day's key can occur twice only if its spell's does, and a person is active twice on a day only in spells that meet; so no other days are dealt by key or person."""
    if rule.model != "workforce_daily" or "workforce_daily" in e.built:
        return None
    if rule.key == ("daily_workforce_key",):
        return workforce.workforce_daily(checks.repeated(e.dim_employee, "employee_sk"), e.cfg.as_of)
    return workforce.workforce_daily(checks.meeting_spells(e.dim_employee), e.cfg.as_of) if rule.name == "check_daily_one_active_row" else None


_BREAKS = {
    "hris_persons_no_orphan_spells": "SELECT 1 FROM (SELECT (SELECT count(*) FROM stg_hris WHERE date_of_birth IS NOT NULL AND personal_email_local_part IS NOT NULL) a, (SELECT sum(len(hris_employee_ids)) FROM hris_persons) b) WHERE a <> b",
    "hris_persons_unique_key": "SELECT 1 FROM hris_persons GROUP BY hris_person_key HAVING count(*) > 1",
    "payroll_no_orphan_periods": "SELECT 1 FROM (SELECT (SELECT count(*) FROM stg_payroll WHERE employee_payroll_id IS NOT NULL) a, (SELECT sum(pay_period_count) FROM payroll_spells) b) WHERE a <> b",
    "payroll_period_range": "SELECT 1 FROM payroll_spells WHERE first_pay_period_start > most_recent_pay_period_end",
    "dms_user_once": "SELECT 1 FROM dms_erp_unified WHERE dms_user_id IS NOT NULL GROUP BY dms_user_id HAVING count(*) > 1",
    "erp_user_once": "SELECT 1 FROM dms_erp_unified WHERE erp_user_id IS NOT NULL GROUP BY erp_user_id HAVING count(*) > 1",
    "broken_link_implies_erp": "SELECT 1 FROM dms_erp_unified WHERE has_broken_link AND NOT has_erp",
    "dms_erp_has_a_source": "SELECT 1 FROM dms_erp_unified WHERE NOT (has_dms OR has_erp)",
    "work_email_stable": "SELECT 1 FROM stg_hris JOIN hris_persons p USING (date_of_birth, personal_email_local_part) GROUP BY p.hris_person_key HAVING count(DISTINCT stg_hris.work_email_local_part) > 1",
    **{f"nodes_{s}": f"SELECT 1 FROM (SELECT (SELECT count(*) FROM {t}) a, (SELECT count(*) FROM identity_source_nodes WHERE source_system = '{s.upper()}') b) WHERE a <> b" for s, t in {"ats": "stg_ats", "crm": "stg_crm", "dms_erp": "dms_erp_unified", "hris": "hris_persons", "payroll": "payroll_spells"}.items()},
    "source_merged_once": "SELECT 1 FROM evidence WHERE auto_merge_qualified GROUP BY source_record_key HAVING count(DISTINCT hris_person_key) > 1",
    "no_orphan_nodes": "SELECT 1 FROM identity_source_nodes WHERE source_system <> 'HRIS' AND source_record_key NOT IN (SELECT source_record_key FROM evidence WHERE auto_merge_qualified UNION ALL SELECT source_record_key FROM stewardship_queue)",
    "queue_has_no_merged": "SELECT 1 FROM stewardship_queue WHERE source_record_key IN (SELECT source_record_key FROM evidence WHERE auto_merge_qualified)",
    "dim_covers_spells": "SELECT 1 FROM (SELECT (SELECT count(*) FROM stg_hris WHERE date_of_birth IS NOT NULL AND personal_email_local_part IS NOT NULL) a, (SELECT count(*) FROM dim_employee) b) WHERE a <> b",
    "dim_no_overlap": "SELECT 1 FROM (SELECT effective_end_date, lead(effective_start_date) OVER (PARTITION BY canonical_person_id ORDER BY effective_start_date, hris_employee_id) AS following FROM dim_employee) WHERE effective_end_date >= following",
    "daily_one_active_row": "SELECT 1 FROM workforce_daily WHERE is_active_on_date GROUP BY canonical_person_id, snapshot_date HAVING count(*) > 1",
    "daily_bounds": "SELECT 1 FROM workforce_daily w JOIN dim_employee d USING (employee_sk) WHERE w.snapshot_date < d.effective_start_date OR w.snapshot_date > d.termination_date OR w.snapshot_date > DATE '2001-12-31'",
    "headcount_suppressed_null": "SELECT 1 FROM headcount_daily WHERE NOT is_reportable AND (headcount IS NOT NULL OR reportable_cohort_employee_count IS NOT NULL)",
    "headcount_small_suppressed": "SELECT 1 FROM headcount_daily WHERE is_reportable AND headcount < 5",
    "attrition_suppressed_null": "SELECT 1 FROM attrition_monthly WHERE NOT is_reportable AND (start_headcount IS NOT NULL OR terminations IS NOT NULL OR attrition_rate IS NOT NULL)",
    "attrition_small_suppressed": "SELECT 1 FROM attrition_monthly WHERE is_reportable AND start_headcount < 5",
    "summary_adds_up": "SELECT 1 FROM suppression_summary WHERE row_count <> reportable_row_count + suppressed_row_count",
}


_STAGED = {
    **{f"{t}.{c}.not_null": f"SELECT 1 FROM {t} WHERE {c} IS NULL" for t, (needed, *_) in checks.STAGED.items() for c in needed},
    **{f"{t}.{key}.unique": f"SELECT 1 FROM {t} WHERE {key} IS NOT NULL GROUP BY {key} HAVING count(*) > 1" for t, (_, key, *_) in checks.STAGED.items()},
    **{f"{t}.{c}.accepted_values": f"SELECT 1 FROM {t} WHERE {c} NOT IN ({', '.join(repr(v) for v in values)})" for t, (_, _, codes, _) in checks.STAGED.items() for c, values in codes.items()},
    **{f"{t}.{c}.relationship": f"SELECT 1 FROM {t} WHERE {c} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {to} o WHERE o.{at} = {t}.{c})" for t, (*_, links) in checks.STAGED.items() for c, (to, at) in links.items()},
    "stg_payroll.period.in_order": "SELECT 1 FROM stg_payroll WHERE pay_period_start > pay_period_end",
    "identity_source_nodes.system_and_key.unique": "SELECT 1 FROM identity_source_nodes GROUP BY source_system, source_record_key HAVING count(*) > 1",
}


query("checks_staged", lambda e: _counted(e, gates.STAGED), " UNION ALL ".join(f"SELECT '{n}' AS check_name, (SELECT count(*) FROM ({text})) AS violations" for n, text in _STAGED.items()))
_FRESH = "SELECT max(loaded_at) AS loaded FROM {0}"
query(
    "source_freshness",
    lambda e: reduce(DataFrame.unionByName, [checks.freshness(getattr(e, t), "loaded_at", e.cfg.as_of).select(F.lit(t).alias("source"), F.date_format("loaded", "yyyy-MM-dd HH:mm:ss").alias("loaded"), "state") for t in checks.STAGED]),
    " UNION ALL ".join(f"SELECT '{t}' AS source, strftime(loaded, '%Y-%m-%d %H:%M:%S') AS loaded, CASE WHEN loaded IS NULL OR date_diff('day', loaded::DATE, {oracle.AS_OF}) > 30 THEN 'ERROR' WHEN date_diff('day', loaded::DATE, {oracle.AS_OF}) > 7 THEN 'WARN' ELSE 'PASS' END AS state FROM ({_FRESH.format(t)})" for t in checks.STAGED),
)


def _checks(name: str, *parts: str) -> None:
    wanted = sorted(n for n in _BREAKS if any(p in f"check_{n}" for p in parts))
    rules = [r for r in gates.SINGULAR if r.name.removeprefix("check_") in wanted]
    query(name, lambda e: _counted(e, rules), " UNION ALL ".join(f"SELECT 'check_{n}' AS check_name, (SELECT count(*) FROM ({_BREAKS[n]})) AS violations" for n in wanted))


_checks("checks_persons", "check_hris", "check_payroll", "check_dms", "check_erp", "check_broken", "check_work")
_checks("checks_identity", "check_nodes", "check_source", "check_no_orphan", "check_queue")
_checks("checks_workforce", "check_dim", "check_daily")
_checks("checks_privacy", "check_headcount", "check_attrition", "check_summary")

# The rules of built models, and the summary against the marts that it sums up.
_FROM = {"workforce_daily": "(SELECT w.*, d.hris_employee_id, 1 AS employee_day_count FROM workforce_daily w JOIN dim_employee d USING (employee_sk))"}
_MADE = {
    **{f"{t}.{c}.not_null": f"SELECT 1 FROM {_FROM.get(t, t)} WHERE {c} IS NULL" for t, columns in gates.REQUIRED.items() for c in columns},
    **{f"{t}.{'_and_'.join(k)}.unique": f"SELECT 1 FROM {t} WHERE {' AND '.join(f'{c} IS NOT NULL' for c in k)} GROUP BY {', '.join(k)} HAVING count(*) > 1" for t, keys in gates.KEYS.items() for k in keys},
    **{f"{t}.{c}.accepted_values": f"SELECT 1 FROM {_FROM.get(t, t)} WHERE {c} NOT IN ({', '.join(repr(v) for v in values)})" for t, codes in gates.CODES.items() for c, values in codes.items()},
    **{f"{t}.{c}.at_least_one": f"SELECT 1 FROM {t} WHERE {c} < 1" for t, c in (("hris_persons", "spell_count"), ("payroll_spells", "pay_period_count"))},
}
query("checks_models", lambda e: _counted(e, gates.BUILT), " UNION ALL ".join(f"SELECT '{n}' AS check_name, (SELECT count(*) FROM ({text})) AS violations" for n, text in _MADE.items()))
_PAIRS = [(m, t, s) for m, t, s in (("headcount", "headcount_daily", "workforce_headcount_daily"), ("attrition", "attrition_monthly", "workforce_attrition_monthly"))]
_SIZES = (("rows", "row_count", "true"), ("reportable", "reportable_row_count", "is_reportable"), ("suppressed", "suppressed_row_count", "NOT is_reportable"))
query(
    "checks_summary_matches_marts",
    lambda e: _counted(e, [r for r in gates.SINGULAR if r.name.startswith("check_summary_matches")]),
    " UNION ALL ".join(f"SELECT 'check_summary_matches_{m}_{n}' AS check_name, ((SELECT count(*) FROM {t} WHERE {c}) <> (SELECT {column} FROM suppression_summary WHERE privacy_surface = '{s}'))::BIGINT AS violations" for m, t, s in _PAIRS for n, column, c in _SIZES),
)


# What the catalog says of published tables: the public marts name no person, the dimension does.
def _columns(e: Engine) -> DataFrame:
    shown = ("headcount_daily", "attrition_monthly", "suppression_summary", "dim_employee")
    build.run(e, f"{e.store.path}/built", " ".join(shown), rules=[])
    database = f"run_{uuid.uuid4().hex}"
    build.publish(e.spark, f"{e.store.path}/built", database, shown)
    return checks.catalog_columns(e.spark, database).filter(F.col("column_name") != privacy.MONTH)


_DENIED = ", ".join(f"'{c}'" for c in checks.IDENTIFIERS)
query(
    "catalog_identifier_columns",
    _columns,
    " UNION ALL ".join(f"SELECT '{t}' AS table_name, column_name, column_name IN ({_DENIED}) AS is_denied FROM (SELECT unnest(json_keys(to_json(t))) AS column_name FROM (SELECT * FROM {t} LIMIT 1) t)" for t in ("headcount_daily", "attrition_monthly", "suppression_summary", "dim_employee")),
)

# An access log that grows by deliveries, of which the second repeats and corrects part of the first and has a column more.
_FIRST_DELIVERY, _SECOND_DELIVERY = dt.date(1995, 7, 1), dt.date(1995, 1, 1)


def order_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log of all orders after two deliveries that overlap in half a year."""
    e = engine(spark, sf_dir)
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").withColumn("o_orderdate", F.to_date("o_orderdate"))
    log = f"{e.store.path}/order_log"
    privacy.keep_audit_log(spark, log)
    privacy.append_audit(privacy.order_events(orders.filter(F.col("o_orderdate") < F.lit(_FIRST_DELIVERY)), "o_orderdate", e.cfg), log)
    again = privacy.order_events(orders.filter(F.col("o_orderdate") >= F.lit(_SECOND_DELIVERY)), "o_orderdate", e.cfg)
    privacy.append_audit(again.withColumns({"purpose": F.concat("purpose", F.lit(" (corrected)")), "channel": F.lit("second")}), log)
    return flat(privacy.audit_log(spark, log))


QUERIES["audit_log_of_orders"] = order_log
ORACLES["audit_log_of_orders"] = f"""
SELECT md5('order-' || o_orderkey) AS audit_event_id, strftime(o_orderdate::DATE, '%Y-%m-%d %H:%M:%S') AS audited_at, 'actor-' || (o_custkey % 10) AS actor,
  CASE WHEN o_orderstatus = 'O' THEN 'workforce_headcount_daily' ELSE 'workforce_attrition_monthly' END AS query_surface,
  o_orderpriority || CASE WHEN o_orderdate::DATE >= DATE '{_SECOND_DELIVERY}' THEN ' (corrected)' ELSE '' END AS purpose, '{{"status":"' || o_orderstatus || '"}}' AS filters_json, 5 AS k_anonymity_threshold,
  (o_custkey % 100)::BIGINT AS result_row_count, CASE WHEN o_orderstatus = 'F' THEN o_custkey % 100 ELSE 0 END::BIGINT AS suppressed_row_count, 'k-anonymity-v1' AS privacy_policy_version, NULL::VARCHAR AS dbt_invocation_id,
  CASE WHEN o_orderdate::DATE >= DATE '{_SECOND_DELIVERY}' THEN 'second' END AS channel
FROM orders"""


# The additive confidence of every pair of pass 2, from the anchors that the pass has found.
def _pair_confidence(e: Engine) -> DataFrame:
    days, born = F.col("hire_date_diff_days"), F.coalesce("dob_match", F.lit(False))
    anchors = {"dob_match": born, "name_match": F.col("name_match"), "hire_date_exact": days == 0, "hire_date_within_7d": days <= 7, "hire_date_within_30d": days <= 30}
    linked = F.coalesce(F.col("merge_topology") == "DMS_AND_ERP", F.lit(False))
    score, count = F.round(matching.match_score(**anchors, structural_fk_match=linked), 2), matching.match_anchor_count(**anchors)
    shown = ("source_record_key", "hris_person_key", days, score.alias("score"), count.alias("anchors"), matching.auto_merge_qualified(score, count, linked).alias("qualified"))
    return identity.pass_2_once(e.identity_source_nodes, e.hris_spell_names, e.identity_pass_1, lambda pairs: pairs.select(*shown))


query(
    "match_confidence_pairs",
    _pair_confidence,
    """SELECT DISTINCT source_record_key, hris_person_key, hire_date_diff_days, score, anchors, linked OR (score >= 0.95 AND anchors >= 2) AS qualified FROM (
 SELECT *, CASE WHEN linked THEN 1.0 ELSE least(100, CASE WHEN born THEN 30 ELSE 0 END + 20 + CASE WHEN hire_date_diff_days = 0 THEN 20 WHEN hire_date_diff_days <= 7 THEN 10 WHEN hire_date_diff_days <= 30 THEN 5 ELSE 0 END) / 100.0 END::DOUBLE AS score,
  born::INT + 1 + (hire_date_diff_days <= 7)::INT AS anchors
 FROM (SELECT *, coalesce(merge_topology = 'DMS_AND_ERP', false) AS linked, coalesce(dob_match, false) AS born FROM identity_pass_2))""",
)


# Raw tables through CSV files and back, with cells that are not of their type.
def raw_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All six tables as CSV, loaded with rejects: what came in, and what was rejected and why."""
    e = engine(spark, sf_dir)
    for name, df in e.sources.items():
        df = raw.shaped(df, name)
        if name == "payroll_records":
            df = df.withColumn("hours_worked", F.when(F.col("payroll_record_id").endswith("7"), "n/a").otherwise(F.col("hours_worked").cast("string")))
        df.write.option("header", True).csv(f"{e.store.path}/files/{name}.csv")
    raw.bulk_load(spark, f"{e.store.path}/files", f"{e.store.path}/raw")
    loaded = raw.read(spark, f"{e.store.path}/raw")
    own = lambda name: f"sum(CAST(CONV(SUBSTRING(md5(CONCAT_WS('|', {', '.join(_TRIP[name])})), 1, 8), 16, 10) AS BIGINT))"
    rows = [df.agg(F.count("*").alias("loaded"), F.expr(own(n)).alias("content")).select(F.lit(n).alias("table_name"), "*") for n, df in loaded.items()]
    rejected = [build.Table(spark, f"{e.store.path}/raw/rejects/{n}").read() for n in loaded]
    bad = reduce(DataFrame.union, rejected).groupBy("table_name").agg(F.count("*").alias("rejected"), F.max("reason").alias("reason"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set("columns")))), ",").alias("columns"))
    return reduce(DataFrame.union, rows).join(bad, "table_name", "left").select("table_name", "loaded", "content", F.coalesce("rejected", F.lit(0)).alias("rejected"), "reason", "columns")


#: Columns whose text both engines print alike.
_TRIP = {
    "hris_employees": ("hris_employee_id", "trim(legal_first_name)", "legal_last_name", "CAST(hire_date AS STRING)"), "ats_candidates": ("ats_candidate_id", "last_name", "CAST(application_date AS STRING)"),
    "payroll_records": ("payroll_record_id", "legal_last_name", "CAST(gross_amount_cad AS STRING)", "CAST(pay_period_end AS STRING)"), "crm_sales_reps": ("crm_user_id", "display_name", "CAST(active AS STRING)"),
    "dms_users": ("dms_user_id", "dms_username", "CAST(hire_date_dms AS STRING)"), "erp_users": ("erp_user_id", "erp_email", "role_code"),
}
QUERIES["raw_csv_round_trip"] = raw_round_trip
ORACLES["raw_csv_round_trip"] = oracle.sql(
    " UNION ALL ".join(
        f"SELECT '{n}' AS table_name, count(*) FILTER (NOT bad) AS loaded, (sum(CAST('0x' || substr(md5(concat_ws('|', {', '.join(c.replace('STRING', 'VARCHAR') for c in columns)})), 1, 8) AS BIGINT)) FILTER (NOT bad))::BIGINT AS content, count(*) FILTER (bad) AS rejected, "
        f"CASE WHEN count(*) FILTER (bad) > 0 THEN '{raw.BAD_TYPE}' END AS reason, CASE WHEN count(*) FILTER (bad) > 0 THEN 'hours_worked' END AS columns FROM (SELECT *, {'payroll_record_id LIKE ' + repr('%7') if n == 'payroll_records' else 'false'} AS bad FROM {n})"
        for n, columns in _TRIP.items()
    )
)
