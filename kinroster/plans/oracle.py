"""The models in DuckDB's SQL, written on their own over the shared fixture."""

from __future__ import annotations

from ..functions.names import FOLDED, PLAIN
from ..sources.fixture import SQL as FIXTURE
from ..sources.nicknames import NICKNAMES

AS_OF, K = "DATE '2001-12-31'", 5


def key(*columns: str) -> str:
    return "md5(" + " || '-' || ".join(f"coalesce(CAST({c} AS VARCHAR), '_dbt_utils_surrogate_key_null_')" for c in columns) + ")"


def norm(name: str) -> str:
    return f"regexp_replace(lower(translate(trim({name}), '{FOLDED}', '{PLAIN}')), '[^a-z]', '', 'g')"


_LONG = "MAP {" + ", ".join(f"'{s}': '{long}'" for s, long in NICKNAMES.items()) + "}"


def root(name: str) -> str:
    return f"coalesce({_LONG}[{norm(name)}], {norm(name)})"


def local(email: str) -> str:
    return f"CASE WHEN instr({email}, '@') > 0 THEN lower(trim(split_part({email}, '@', 1))) END"


def domain(email: str) -> str:
    return f"CASE WHEN instr({email}, '@') > 0 THEN split_part({email}, '@', 2) END"


def token(part: str) -> str:
    return f"nullif(regexp_extract({part}, '[^.]+$'), '')"


def both(*names: str) -> str:
    return ", ".join(f"trim({n}) AS {n}_original, lower(trim({n})) AS {n}" for n in names)


def pick(side: str, order: str, **columns: str) -> str:
    """Columns of a group's first or last row; lists keep nulls, unlike first()."""
    way = "ASC" if side == "first" else "DESC"
    by = ", ".join(f"{c} {way}" for c in order.split(", "))
    return ", ".join(f"list({c} ORDER BY {by})[1] AS {n}" for n, c in columns.items())


def masked(metric: str, n: str) -> str:
    return f"CASE WHEN {n} >= {K} THEN {metric} END"


def shown(n: str) -> str:
    return f"CASE WHEN {n} >= {K} THEN CAST({n} AS VARCHAR) ELSE '<{K}' END AS cohort_size_bucket, {n} >= {K} AS is_reportable, CASE WHEN {n} < {K} THEN 'K_ANONYMITY_THRESHOLD' END AS suppression_reason, {K} AS k_anonymity_threshold"


_IDS = ("ats_candidate_id", "payroll_spell_key", "employee_payroll_id", "crm_user_id", "dms_erp_person_key", "dms_user_id", "erp_user_id")
_NODE = ("source_system", "source_record_key", "source_primary_id", "hris_person_key", "source_first_name", "source_last_name", "source_first_name_original", "source_last_name_original", "source_first_name_root", "source_last_name_norm", "date_of_birth", "source_hire_date", "source_end_date", "personal_email_local_part", "personal_email_domain", "work_email_local_part", "work_email_domain", "source_email_local_part", "source_email_domain", *_IDS, "merge_topology", "has_dms", "has_erp", "has_broken_link", "loaded_at")


def node(table: str, **given: str) -> str:
    kinds = {"date_of_birth": "DATE", "source_hire_date": "DATE", "source_end_date": "DATE", "has_dms": "BOOLEAN", "has_erp": "BOOLEAN", "has_broken_link": "BOOLEAN", "loaded_at": "TIMESTAMP"}
    return "SELECT " + ", ".join(f"CAST({given.get(c, 'NULL')} AS {kinds.get(c, 'VARCHAR')}) AS {c}" for c in _NODE) + f" FROM {table}"


def branch(table: str, system: str, prefix: str, id_: str, first: str, last: str, **given: str) -> str:
    given = {"source_system": f"'{system}'", "source_record_key": f"'{prefix}::' || {id_}", "source_primary_id": id_, "source_first_name": first, "source_last_name": last, "source_first_name_original": f"{first}_original", "source_last_name_original": f"{last}_original", "source_first_name_root": root(first), "source_last_name_norm": norm(last), "loaded_at": "loaded_at"} | given
    return node(table, **given)


_SAME = ", ".join(f"s.{c}" for c in ("source_system", "source_record_key", "source_primary_id", *_IDS, "merge_topology"))
_SOURCE = ", ".join(f"s.{c}" for c in ("source_first_name", "source_last_name", "source_first_name_root", "source_last_name_norm", "source_hire_date", "source_email_local_part", "source_email_domain"))
_COUNT = "(SELECT count(DISTINCT o.hris_person_key) FROM {0} o WHERE o.source_record_key = c.source_record_key)::BIGINT AS candidate_hris_person_count"
_DAYS = "abs(date_diff('day', s.source_hire_date, h.hired))"
_HRIS = "h.first_name AS hris_first_name, h.last_name AS hris_last_name, h.legal_root AS hris_first_name_root, h.last_norm AS hris_last_name_norm, h.hired AS hris_hire_date, s.loaded_at"


def counted(table: str) -> str:
    return f"SELECT c.*, n.persons AS candidate_hris_person_count FROM {table} c JOIN (SELECT source_record_key, count(DISTINCT hris_person_key)::BIGINT AS persons FROM {table} GROUP BY 1) n USING (source_record_key)"


def summed(surface: str, grain: str, table: str) -> str:
    return f"SELECT md5('{surface}-{grain}') AS privacy_suppression_summary_key, '{surface}' AS privacy_surface, '{grain}' AS date_grain, count(*) AS row_count, count(*) FILTER (is_reportable) AS reportable_row_count, count(*) FILTER (NOT is_reportable) AS suppressed_row_count, (count(*) FILTER (NOT is_reportable))::DOUBLE / nullif(count(*), 0) AS suppressed_row_rate, min(k_anonymity_threshold) AS k_anonymity_threshold, {AS_OF}::TIMESTAMP AS generated_at FROM {table}"


_CANON = ", ".join(f"h.{c}" for c in ("hris_employee_ids", "current_hris_employee_id", "date_of_birth", "personal_email_local_part", "work_email_local_part", "canonical_hire_date", "latest_hire_date", "latest_termination_date", "canonical_legal_first_name", "canonical_legal_last_name", "canonical_legal_first_name_original", "canonical_legal_last_name_original", "current_legal_first_name", "current_legal_last_name", "current_preferred_name", "current_employment_status", "current_employment_type", "current_department", "current_job_title", "current_location", "current_manager_hris_id"))


def rolled(column: str, to: str, count: str | None = None) -> str:
    inner = f"(SELECT list(DISTINCT {column} ORDER BY {column}) FROM best b WHERE b.hris_person_key = h.hris_person_key AND {column} IS NOT NULL)"
    return f"coalesce({inner}, []) AS {to}" + (f", len(coalesce({inner}, [])) AS {count}" if count else "")


_ORIG = ", ".join(f"s.{n}{x}" for x in ("_original", "") for n in ("legal_first_name", "legal_last_name", "preferred_name"))
_DIM = "canonical_person_id, hris_person_key, has_rehires, has_name_change_marriage, ats_candidate_count, payroll_spell_count, crm_user_count, dms_user_count, erp_user_count, matched_external_source_system_count, match_passes_used"

def optional(column: str) -> str:
    return f"nullif(lower(trim({column})), '')"


def common(a: str, b: str) -> str:
    """Length of the longest common subsequence, one bit for each character of ``a``: a bit that is lost is a character taken."""
    where = f"list_sum(list_transform(string_split({a}, ''), lambda x, i: CASE WHEN x = ch THEN (1::BIGINT << (i - 1)::INT) ELSE 0::BIGINT END))::BIGINT"
    step = f"lambda open, ch: ((open + (open & {where})) | (open - (open & {where}))) & ((1::BIGINT << length({a})::INT) - 1)"
    return f"(length({a}) - bit_count(list_reduce(string_split({b}, ''), {step}, (1::BIGINT << length({a})::INT) - 1)))"


_WEIGHTS = {"f": 20, "l": 30, "e": 20, "h": 20, "d": 10}


def weighed(**known: str) -> tuple[str, str, str]:
    """Sum of the known features by weight, weight of the known, anchors."""
    names = {n: known.get(n, n) for n in _WEIGHTS}
    total = " + ".join(f"coalesce({names[n]} * {w}, 0)" for n, w in _WEIGHTS.items())
    return total, " + ".join(f"CASE WHEN {names[n]} IS NOT NULL THEN {w} ELSE 0 END" for n, w in _WEIGHTS.items()), " + ".join(f"CASE WHEN {names[n]} >= 0.85::DOUBLE THEN 1 ELSE 0 END" for n in _WEIGHTS)


def review(to: str, first: str, last: str) -> dict[str, str]:
    """The review models, with names that end with ``to``: every pair of each pool, but letter by letter only where that can matter."""
    could = weighed(l="CASE WHEN s_last IS NOT NULL AND c_last IS NOT NULL THEN 1 END", e="CASE WHEN s_local IS NOT NULL AND coalesce(c_work, c_personal) IS NOT NULL THEN 1 END")
    total, known, anchors = weighed()
    text = "printf('%.2f', {0})"
    return {
        f"review_sources{to}": f"SELECT source_record_key, source_system, {optional('source_first_name_root')} AS s_first, {optional('source_last_name_norm')} AS s_last, source_hire_date AS s_hired, {optional('source_email_local_part')} AS s_local, {optional('suggested_canonical_person_id')} AS s_hint FROM stewardship_queue",
        f"review_people{to}": f"SELECT canonical_person_id, nullif({first}, '') AS c_first, nullif({last}, '') AS c_last, canonical_hire_date AS c_hired, {optional('work_email_local_part')} AS c_work, {optional('personal_email_local_part')} AS c_personal FROM canonical_person",
        f"review_pool{to}": f"""
SELECT * FROM review_sources{to} s JOIN review_people{to} c ON s.s_hint = c.canonical_person_id
UNION ALL SELECT * FROM review_sources{to} s JOIN review_people{to} c ON s.s_last = c.c_last AND coalesce(s.s_hint <> c.canonical_person_id, true)
UNION ALL SELECT * FROM review_sources{to} s, review_people{to} c WHERE coalesce(s.s_hint NOT IN (SELECT canonical_person_id FROM review_people{to}), true) AND coalesce(s.s_last NOT IN (SELECT c_last FROM review_people{to} WHERE c_last IS NOT NULL), true)""",
        f"review_pairs{to}": f"""
SELECT * FROM (SELECT *, CASE WHEN s_first = c_first THEN 1::DOUBLE WHEN s_first <> c_first THEN 0::DOUBLE END AS f, abs(date_diff('day', s_hired, c_hired)) AS days,
 CASE WHEN days <= 7 THEN 1::DOUBLE WHEN days <= 30 THEN 0.9::DOUBLE WHEN days <= 90 THEN 0.6::DOUBLE WHEN days <= 365 THEN 0.25::DOUBLE WHEN days IS NOT NULL THEN 0::DOUBLE END AS h,
 CASE WHEN s_hint = canonical_person_id THEN 1::DOUBLE WHEN s_hint IS NOT NULL THEN 0::DOUBLE END AS d FROM review_pool{to})
WHERE ({could[0]}) >= 0.7499::DOUBLE * ({could[1]}) AND ({could[1]}) >= 50 AND ({could[2]}) >= 2""",
        f"review_words{to}": f"""
SELECT a, b, CASE WHEN a = b THEN 1::DOUBLE ELSE 2.0::DOUBLE * {common('a', 'b')} / (length(a) + length(b)) END AS similar FROM (
 SELECT s_last AS a, c_last AS b FROM review_pairs{to} UNION SELECT s_local, c_work FROM review_pairs{to} UNION SELECT s_local, c_personal FROM review_pairs{to}) WHERE a IS NOT NULL AND b IS NOT NULL""",
        f"review_scores{to}": f"""
SELECT *, CASE WHEN residual_score >= 0.92::DOUBLE AND evidence_weight >= 0.7::DOUBLE AND anchors >= 3 THEN 'high_confidence_review' WHEN residual_score >= 0.75::DOUBLE AND evidence_weight >= 0.5::DOUBLE AND anchors >= 2 THEN 'possible_review' ELSE 'do_not_suggest' END AS recommendation FROM (
 SELECT *, ({total}) / ({known}) AS residual_score, ({known}) / 100.0::DOUBLE AS evidence_weight, {anchors} AS anchors FROM (
  SELECT p.*, wl.similar AS l, CASE WHEN ww.similar IS NULL OR wp.similar > ww.similar THEN wp.similar ELSE ww.similar END AS e FROM review_pairs{to} p
  LEFT JOIN review_words{to} wl ON wl.a = s_last AND wl.b = c_last LEFT JOIN review_words{to} ww ON ww.a = s_local AND ww.b = c_work LEFT JOIN review_words{to} wp ON wp.a = s_local AND wp.b = c_personal))""",
        f"review_suggested{to}": f"""
SELECT source_record_key, source_system, canonical_person_id, s_hint, residual_score, recommendation, anchors, evidence_weight, f, l, e, h, d,
 concat_ws('; ', 'recommendation=' || recommendation, 'last_name_similarity=' || {text.format('l')}, CASE WHEN f = 1 THEN 'first_name_root_exact' END, CASE WHEN e >= 0.85::DOUBLE THEN 'email_local_similarity=' || {text.format('e')} END,
  CASE WHEN h >= 0.9::DOUBLE THEN 'hire_date_within_30_days' END, CASE WHEN d = 1 THEN 'deterministic_candidate_hint' END) AS reasons
FROM review_scores{to} WHERE recommendation <> 'do_not_suggest'""",
        f"review_ranked{to}": f"SELECT *, row_number() OVER (PARTITION BY source_record_key ORDER BY residual_score DESC, anchors DESC, evidence_weight DESC, canonical_person_id DESC) AS place FROM review_suggested{to} QUALIFY place <= 3",
    }


REVIEW_FILE = "source_record_key, source_system, canonical_person_id AS candidate_canonical_person_id, round(residual_score, 4) AS residual_score, recommendation, anchors AS positive_anchor_count, round(evidence_weight, 4) AS evidence_weight, reasons, f AS first_name_root_score, l AS last_name_score, e AS email_local_score, h AS hire_date_score, d AS deterministic_hint_score"
_COVER = " UNION ALL ".join(f"SELECT 'feature_coverage', '{n}', coalesce(avg(({c} IS NOT NULL)::INT), 0) FROM review_ranked" for n, c in {"first_name_root": "f", "last_name": "l", "email_local": "e", "hire_date": "h", "deterministic_hint": "d"}.items())
REVIEW_SUMMARY = f"""
SELECT metric, name, round(value, 9) AS value FROM (
SELECT 'source_record_count' AS metric, '' AS name, count(*)::DOUBLE AS value FROM review_sources UNION ALL SELECT 'candidate_count', '', count(*) FROM review_ranked
UNION ALL SELECT 'source_records_with_candidates', '', count(DISTINCT source_record_key) FROM review_ranked
UNION ALL SELECT 'review_yield_rate', '', (SELECT count(DISTINCT source_record_key) FROM review_ranked)::DOUBLE / (SELECT count(*) FROM review_sources)
UNION ALL {_COVER}
UNION ALL SELECT 'recommendation_count', recommendation, count(*) FROM review_ranked GROUP BY 2 UNION ALL SELECT 'mean_score', recommendation, avg(residual_score) FROM review_ranked GROUP BY 2
UNION ALL SELECT 'mean_evidence', recommendation, avg(evidence_weight) FROM review_ranked GROUP BY 2 UNION ALL SELECT 'source_system_count', source_system, count(*) FROM review_ranked GROUP BY 2)"""
_SHARES = {"source_records_with_candidates": ("n > 0", "candidate_coverage_rate"), "top_1_alignment_count": ("rank = 1", "top_1_alignment_rate"), "top_k_alignment_count": ("rank IS NOT NULL", "top_k_alignment_rate"), "missing_candidate_count": ("n = 0", "missing_candidate_rate")}
REVIEW_PROXY = """
SELECT metric, name, round(value, 9) AS value FROM (
SELECT 'evaluated_source_count' AS metric, '' AS name, count(*)::DOUBLE AS value FROM review_hints UNION ALL SELECT 'mean_proxy_label_rank', '', coalesce(avg(rank), 0) FROM review_hints
""" + "".join(f" UNION ALL SELECT '{n}', '', count(*) FILTER ({c}) FROM review_hints UNION ALL SELECT '{r}', '', count(*) FILTER ({c}) / count(*)::DOUBLE FROM review_hints" for n, (c, r) in _SHARES.items()) + """
UNION ALL SELECT 'candidate_count', recommendation, count(*) FROM review_ranked WHERE s_hint IS NOT NULL GROUP BY 2
UNION ALL SELECT 'alignment_rate', recommendation, avg((canonical_person_id = s_hint)::INT) FROM review_ranked WHERE s_hint IS NOT NULL GROUP BY 2)"""

#: In the order in which they build on each other.
MODELS: dict[str, str] = {
    **FIXTURE,
    "stg_hris": f"SELECT trim(hris_employee_id) AS hris_employee_id, {both('legal_first_name', 'legal_last_name')}, nullif(trim(preferred_name), '') AS preferred_name_original, lower(nullif(trim(preferred_name), '')) AS preferred_name, date_of_birth, hire_date, termination_date, lower(trim(personal_email)) AS personal_email, {local('personal_email')} AS personal_email_local_part, lower(trim(work_email)) AS work_email, {local('work_email')} AS work_email_local_part, upper(trim(employment_status)) AS employment_status, upper(trim(employment_type)) AS employment_type, trim(department) AS department, trim(job_title) AS job_title, trim(manager_hris_id) AS manager_hris_id, trim(location) AS location, loaded_at FROM hris_employees",
    "stg_ats": f"SELECT trim(ats_candidate_id) AS ats_candidate_id, {both('preferred_first_name', 'last_name')}, lower(trim(email)) AS email, {local('email')} AS email_local_part, trim(phone) AS phone, application_date, offer_accepted_date, trim(sourced_from) AS sourced_from, trim(requisition_department) AS requisition_department, trim(requisition_job_title) AS requisition_job_title, loaded_at FROM ats_candidates",
    "stg_payroll": f"SELECT trim(payroll_record_id) AS payroll_record_id, trim(employee_payroll_id) AS employee_payroll_id, {both('legal_first_name', 'legal_last_name')}, sin_last_4, pay_period_start, pay_period_end, gross_amount_cad, hours_worked, trim(job_code) AS job_code, trim(cost_center) AS cost_center, loaded_at FROM payroll_records",
    "stg_crm": f"SELECT trim(crm_user_id) AS crm_user_id, trim(display_name) AS display_name_original, {both('preferred_first_name', 'last_name')}, lower(trim(crm_email)) AS crm_email, {local('crm_email')} AS crm_email_local_part, trim(location_id) AS location_id, upper(trim(role)) AS role, active, created_at, deactivated_at, loaded_at FROM crm_sales_reps",
    "stg_dms": f"SELECT trim(dms_user_id) AS dms_user_id, {both('short_first_name', 'last_name')}, lower(trim(dms_username)) AS dms_username, trim(location_code) AS location_code, trim(department_code) AS department_code, hire_date_dms, terminated_date_dms, loaded_at FROM dms_users",
    "stg_erp": f"SELECT trim(erp_user_id) AS erp_user_id, trim(linked_dms_user_id) AS linked_dms_user_id, {both('short_first_name', 'last_name')}, lower(trim(erp_email)) AS erp_email, {local('erp_email')} AS erp_email_local_part, trim(role_code) AS role_code, trim(permissions_group) AS permissions_group, created_at, last_login_at, linked_dms_user_id IS NULL AS has_broken_dms_link, loaded_at FROM erp_users",
    "hris_persons": f"""
SELECT {key('date_of_birth', 'personal_email_local_part')} AS hris_person_key, *, spell_count > 1 AS has_rehires, coalesce(canonical_legal_last_name <> current_legal_last_name, false) AS has_name_change_marriage FROM (
 SELECT date_of_birth, personal_email_local_part, {pick('first', 'hire_date, hris_employee_id', canonical_hire_date='hire_date', canonical_legal_first_name='legal_first_name', canonical_legal_last_name='legal_last_name', canonical_legal_first_name_original='legal_first_name_original', canonical_legal_last_name_original='legal_last_name_original', canonical_preferred_name='preferred_name')},
 {pick('last', 'hire_date, hris_employee_id', current_hris_employee_id='hris_employee_id', latest_hire_date='hire_date', latest_termination_date='termination_date', **{f'current_{c}': c for c in ('legal_first_name', 'legal_last_name', 'preferred_name', 'employment_status', 'employment_type', 'department', 'job_title', 'location', 'manager_hris_id')})},
 max(personal_email) AS personal_email, max(work_email) AS work_email, max(work_email_local_part) AS work_email_local_part, count(*) AS spell_count, list(DISTINCT hris_employee_id ORDER BY hris_employee_id) AS hris_employee_ids, max(loaded_at) AS loaded_at
 FROM stg_hris WHERE date_of_birth IS NOT NULL AND personal_email_local_part IS NOT NULL GROUP BY 1, 2)""",
    "payroll_spells": f"""
SELECT {key('employee_payroll_id')} AS payroll_spell_key, *, coalesce(most_recent_legal_last_name <> first_observed_legal_last_name, false) AS has_intra_spell_last_name_change FROM (
 SELECT employee_payroll_id, {pick('first', 'pay_period_start, payroll_record_id', first_payroll_record_id='payroll_record_id', **{f'first_observed_{c}': c for c in ('legal_first_name', 'legal_last_name', 'legal_first_name_original', 'legal_last_name_original')})},
 {pick('last', 'pay_period_start, payroll_record_id', most_recent_payroll_record_id='payroll_record_id', **{f'most_recent_{c}': c for c in ('legal_first_name', 'legal_last_name', 'job_code', 'cost_center')})},
 min(pay_period_start) AS first_pay_period_start, max(pay_period_end) AS most_recent_pay_period_end, count(*) AS pay_period_count, sum(gross_amount_cad) AS gross_amount_cad_total, sum(hours_worked) AS hours_worked_total,
 sum(gross_amount_cad)::DOUBLE / count(gross_amount_cad) AS gross_amount_cad_avg_per_period, count(DISTINCT sin_last_4) AS sin_last_4_distinct_count, max(loaded_at) AS loaded_at
 FROM stg_payroll WHERE employee_payroll_id IS NOT NULL GROUP BY 1)""",
    "dms_erp_unified": f"""
SELECT {key('d.dms_user_id', 'e.erp_user_id')} AS dms_erp_person_key, d.dms_user_id, e.erp_user_id, e.linked_dms_user_id AS erp_linked_dms_user_id,
 CASE WHEN e.erp_user_id IS NULL THEN 'DMS_ONLY' WHEN d.dms_user_id IS NULL THEN 'ERP_ONLY_BROKEN_LINK' ELSE 'DMS_AND_ERP' END AS merge_topology,
 d.dms_user_id IS NOT NULL AS has_dms, e.erp_user_id IS NOT NULL AS has_erp, e.erp_user_id IS NOT NULL AND e.linked_dms_user_id IS NULL AS has_broken_link,
 {', '.join(f'coalesce(d.{c}, e.{c}) AS {c}' for c in ('short_first_name', 'last_name', 'short_first_name_original', 'last_name_original'))},
 d.dms_username, d.location_code AS dms_location_code, d.department_code AS dms_department_code, d.hire_date_dms, d.terminated_date_dms, e.erp_email, e.erp_email_local_part,
 e.role_code AS erp_role_code, e.permissions_group AS erp_permissions_group, e.created_at AS erp_created_at, e.last_login_at AS erp_last_login_at, greatest(d.loaded_at, e.loaded_at) AS loaded_at
FROM stg_dms d FULL JOIN stg_erp e ON d.dms_user_id = e.linked_dms_user_id""",
    "identity_source_nodes": " UNION ALL ".join([
        branch("hris_persons", "HRIS", "HRIS_PERSON", "hris_person_key", "canonical_legal_first_name", "canonical_legal_last_name", hris_person_key="hris_person_key", date_of_birth="date_of_birth", source_hire_date="canonical_hire_date", source_end_date="latest_termination_date", personal_email_local_part="personal_email_local_part", personal_email_domain=domain("personal_email"), work_email_local_part="work_email_local_part", work_email_domain=domain("work_email"), source_email_local_part="work_email_local_part", source_email_domain=domain("work_email")),
        branch("stg_ats", "ATS", "ATS", "ats_candidate_id", "preferred_first_name", "last_name", source_hire_date="offer_accepted_date", personal_email_local_part="email_local_part", personal_email_domain=domain("email"), source_email_local_part="email_local_part", source_email_domain=domain("email"), ats_candidate_id="ats_candidate_id"),
        branch("payroll_spells", "PAYROLL", "PAYROLL", "payroll_spell_key", "first_observed_legal_first_name", "first_observed_legal_last_name", source_primary_id="employee_payroll_id", source_hire_date="first_pay_period_start", source_end_date="most_recent_pay_period_end", payroll_spell_key="payroll_spell_key", employee_payroll_id="employee_payroll_id"),
        branch("stg_crm", "CRM", "CRM", "crm_user_id", "preferred_first_name", "last_name", source_hire_date="created_at", source_end_date="deactivated_at", work_email_local_part="crm_email_local_part", work_email_domain=domain("crm_email"), source_email_local_part="crm_email_local_part", source_email_domain=domain("crm_email"), crm_user_id="crm_user_id"),
        branch("dms_erp_unified", "DMS_ERP", "DMS_ERP", "dms_erp_person_key", "short_first_name", "last_name", source_hire_date="coalesce(hire_date_dms, CAST(erp_created_at AS DATE))", source_end_date="terminated_date_dms", work_email_local_part="erp_email_local_part", work_email_domain=domain("erp_email"), source_email_local_part="erp_email_local_part", source_email_domain=domain("erp_email"), **{c: c for c in ("dms_erp_person_key", "dms_user_id", "erp_user_id", "merge_topology", "has_dms", "has_erp", "has_broken_link")}),
    ]),
    "hris_spell_names": f"SELECT p.hris_person_key, s.date_of_birth AS dob, s.hire_date AS hired, {root('s.legal_first_name')} AS legal_root, {root('coalesce(s.preferred_name, s.legal_first_name)')} AS preferred_root, {norm('s.legal_last_name')} AS last_norm, s.legal_first_name AS first_name, s.legal_last_name AS last_name, {domain('s.work_email')} AS mail_domain, {token('s.work_email_local_part')} AS mail_token FROM stg_hris s JOIN hris_persons p USING (date_of_birth, personal_email_local_part)",
    "found_1": " UNION ALL ".join(f"""
SELECT {_SAME}, h.hris_person_key, 1 AS match_pass, '{rule}' AS match_rule, CAST(NULL AS INT) AS hire_date_diff_days, {_SOURCE},
 h.source_first_name AS hris_first_name, h.source_last_name AS hris_last_name, h.source_first_name_root AS hris_first_name_root, h.source_last_name_norm AS hris_last_name_norm, h.source_hire_date AS hris_hire_date, s.loaded_at
FROM identity_source_nodes s JOIN identity_source_nodes h ON s.{of}_email_local_part = h.{to}_email_local_part AND coalesce(s.{of}_email_domain, '') = coalesce(h.{to}_email_domain, '')
WHERE h.source_system = 'HRIS' AND s.source_system IN ({systems})""" for rule, of, to, systems in (("personal_email_exact", "personal", "personal", "'ATS'"), ("work_email_local_part_exact", "source", "work", "'CRM', 'DMS_ERP'"))),
    "identity_pass_1": f"SELECT *, CAST(1.0 AS DOUBLE) AS match_score, 2 AS match_anchor_count, candidate_hris_person_count = 1 AS auto_merge_qualified FROM ({counted('found_1')})",
    "found_2": f"""
SELECT {_SAME}, h.hris_person_key, 2 AS match_pass, 'normalized_name_dob_hire_proximity' AS match_rule, CAST({_DAYS} AS INT) AS hire_date_diff_days, s.date_of_birth IS NOT NULL AS source_has_dob, s.date_of_birth = h.dob AS dob_match, true AS name_match, {_SOURCE}, {_HRIS}
FROM identity_source_nodes s JOIN hris_spell_names h ON s.source_last_name_norm = h.last_norm AND s.source_first_name_root IN (h.legal_root, h.preferred_root) AND {_DAYS} <= 30
WHERE s.source_system <> 'HRIS' AND NOT EXISTS (SELECT 1 FROM identity_pass_1 m WHERE m.auto_merge_qualified AND m.source_record_key = s.source_record_key)""",
    "identity_pass_2": f"""
SELECT *, coalesce(candidate_hris_person_count = 1 AND dob_match AND match_score >= 0.95, false) AS auto_merge_qualified FROM (
 SELECT *, CAST(CASE WHEN dob_match THEN CASE WHEN hire_date_diff_days = 0 THEN 0.98 WHEN hire_date_diff_days < 8 THEN 0.97 ELSE 0.96 END ELSE CASE WHEN hire_date_diff_days = 0 THEN 0.70 WHEN hire_date_diff_days < 8 THEN 0.65 ELSE 0.60 END END AS DOUBLE) AS match_score,
 CASE WHEN dob_match THEN 3 ELSE 2 END AS match_anchor_count FROM ({counted('found_2')}))""",
    "found_3": f"""
SELECT {_SAME}, h.hris_person_key, 3 AS match_pass, 'company_email_domain_last_token_hire_unique' AS match_rule, CAST({_DAYS} AS INT) AS hire_date_diff_days, {_SOURCE}, {_HRIS}
FROM identity_source_nodes s JOIN hris_spell_names h ON s.source_email_domain = h.mail_domain AND {token('s.source_email_local_part')} = h.mail_token AND {_DAYS} <= 30
WHERE s.source_system IN ('CRM', 'DMS_ERP') AND NOT EXISTS (SELECT 1 FROM identity_pass_1 m WHERE m.auto_merge_qualified AND m.source_record_key = s.source_record_key)
 AND NOT EXISTS (SELECT 1 FROM identity_pass_2 m WHERE m.auto_merge_qualified AND m.source_record_key = s.source_record_key)""",
    "identity_pass_3": f"SELECT *, match_score >= 0.95 AND candidate_hris_person_count = 1 AS auto_merge_qualified FROM (SELECT *, CAST(CASE WHEN hire_date_diff_days = 0 THEN 0.97 WHEN hire_date_diff_days < 8 THEN 0.96 ELSE 0.95 END AS DOUBLE) AS match_score, 2 AS match_anchor_count FROM ({counted('found_3')}))",
    "evidence": " UNION ALL ".join(f"SELECT source_system, source_record_key, hris_person_key, match_pass, match_rule, match_score, match_anchor_count, candidate_hris_person_count, hire_date_diff_days, hris_first_name, hris_last_name, hris_hire_date, {', '.join(_IDS)}, loaded_at, auto_merge_qualified FROM identity_pass_{n}" for n in (1, 2, 3)),
    "best": "SELECT * FROM evidence WHERE auto_merge_qualified QUALIFY row_number() OVER (PARTITION BY source_record_key ORDER BY match_pass, match_score DESC, hris_person_key, hire_date_diff_days NULLS FIRST, hris_hire_date NULLS FIRST) = 1",
    "canonical_person": f"""
SELECT 'cp_' || h.hris_person_key AS canonical_person_id, h.hris_person_key, {_CANON}, h.spell_count AS hris_spell_count, h.has_rehires, h.has_name_change_marriage,
 {rolled('ats_candidate_id', 'ats_candidate_ids', 'ats_candidate_count')}, {rolled('employee_payroll_id', 'employee_payroll_ids', 'payroll_spell_count')}, {rolled('payroll_spell_key', 'payroll_spell_keys')}, {rolled('crm_user_id', 'crm_user_ids', 'crm_user_count')}, {rolled('dms_user_id', 'dms_user_ids', 'dms_user_count')}, {rolled('erp_user_id', 'erp_user_ids', 'erp_user_count')},
 (SELECT count(*) FROM best b WHERE b.hris_person_key = h.hris_person_key) AS matched_external_source_node_count, (SELECT count(DISTINCT source_system) FROM best b WHERE b.hris_person_key = h.hris_person_key) AS matched_external_source_system_count,
 coalesce((SELECT string_agg(DISTINCT match_pass::VARCHAR, ',' ORDER BY match_pass::VARCHAR) FROM best b WHERE b.hris_person_key = h.hris_person_key), '') AS match_passes_used,
 greatest(h.loaded_at, (SELECT max(loaded_at) FROM best b WHERE b.hris_person_key = h.hris_person_key)) AS loaded_at
FROM hris_persons h""",
    "suggested": "SELECT * FROM evidence QUALIFY row_number() OVER (PARTITION BY source_record_key ORDER BY match_score DESC, match_pass, candidate_hris_person_count, hris_person_key, hire_date_diff_days NULLS FIRST, hris_hire_date NULLS FIRST) = 1",
    "stewardship_queue": f"""
SELECT {key('s.source_record_key')} AS stewardship_queue_id, {_SAME}, s.source_first_name, s.source_last_name, s.source_first_name_root, s.source_last_name_norm, s.source_hire_date, s.source_end_date, s.source_email_local_part, s.source_email_domain,
 e.hris_person_key AS suggested_hris_person_key, 'cp_' || e.hris_person_key AS suggested_canonical_person_id, e.hris_first_name AS suggested_hris_first_name, e.hris_last_name AS suggested_hris_last_name, e.hris_hire_date AS suggested_hris_hire_date,
 e.match_pass AS suggested_match_pass, e.match_rule AS suggested_match_rule, e.match_score AS suggested_match_score, e.match_anchor_count AS suggested_match_anchor_count, e.candidate_hris_person_count, e.hire_date_diff_days AS suggested_hire_date_diff_days,
 CASE WHEN e.source_record_key IS NULL THEN 'NO_DETERMINISTIC_CANDIDATE' WHEN e.candidate_hris_person_count >= 2 THEN 'AMBIGUOUS_CANDIDATES' WHEN e.match_score < 0.95 THEN 'BELOW_AUTO_MATCH_THRESHOLD' ELSE 'MANUAL_REVIEW_REQUIRED' END AS stewardship_reason, s.loaded_at
FROM identity_source_nodes s LEFT JOIN suggested e USING (source_record_key) WHERE s.source_system <> 'HRIS' AND NOT EXISTS (SELECT 1 FROM best b WHERE b.source_record_key = s.source_record_key)""",
    "dim_employee": f"""
SELECT {key('canonical_person_id', 's.hris_employee_id', 's.hire_date')} AS employee_sk, c.canonical_person_id, c.hris_person_key, s.hris_employee_id, s.hire_date AS effective_start_date, CASE WHEN s.termination_date IS NULL THEN DATE '9999-12-31' ELSE s.termination_date - 1 END AS effective_end_date, s.termination_date,
 lead(s.hire_date) OVER spell IS NULL AS is_current_record, CAST(count(*) OVER (spell ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS INT) AS employment_spell_number, {_ORIG}, s.employment_status AS source_employment_status, s.employment_type, s.department, s.job_title, s.manager_hris_id, s.location,
 c.has_rehires, c.has_name_change_marriage, c.ats_candidate_count, c.payroll_spell_count, c.crm_user_count, c.dms_user_count, c.erp_user_count, c.matched_external_source_system_count, c.match_passes_used, greatest(s.loaded_at, c.loaded_at) AS loaded_at, s.termination_date IS NULL AS is_open_ended_spell
FROM stg_hris s JOIN canonical_person c USING (date_of_birth, personal_email_local_part) WINDOW spell AS (PARTITION BY c.canonical_person_id ORDER BY s.hire_date, s.hris_employee_id)""",
    "calendar": f"SELECT CAST(unnest(generate_series((SELECT min(effective_start_date) FROM dim_employee)::TIMESTAMP, {AS_OF}::TIMESTAMP, INTERVAL 1 DAY)) AS DATE) AS snapshot_date",
    "workforce_daily": f"""
SELECT {key('c.snapshot_date', 'd.employee_sk')} AS daily_workforce_key, c.snapshot_date, d.employee_sk, d.canonical_person_id, d.department, d.location, d.employment_type, d.termination_date IS NULL OR c.snapshot_date < d.termination_date AS is_active_on_date,
 c.snapshot_date = d.effective_start_date AS is_hire_date, coalesce(c.snapshot_date = d.termination_date, false) AS is_termination_date, date_diff('day', d.effective_start_date, c.snapshot_date) AS tenure_days
FROM dim_employee d JOIN calendar c ON c.snapshot_date BETWEEN d.effective_start_date AND coalesce(d.termination_date, {AS_OF})""",
    "cohort_days": "SELECT *, date_trunc('month', snapshot_date)::DATE AS month_start_date, coalesce(department, 'UNKNOWN') AS dep, coalesce(location, 'UNKNOWN') AS loc, coalesce(employment_type, 'UNKNOWN') AS kind FROM workforce_daily",
    "headcount_daily": f"SELECT {key('snapshot_date', 'dep', 'loc', 'kind')} AS headcount_daily_key, snapshot_date, dep AS department, loc AS location, kind AS employment_type, {masked('n', 'n')} AS headcount, {masked('n', 'n')} AS reportable_cohort_employee_count, {shown('n')} FROM (SELECT snapshot_date, dep, loc, kind, count(DISTINCT canonical_person_id) AS n FROM cohort_days WHERE is_active_on_date GROUP BY ALL)",
    "attrition_monthly": f"""
SELECT {key('month_start_date', 'dep', 'loc', 'kind')} AS attrition_monthly_key, month_start_date, last_day(month_start_date) AS month_end_date, dep AS department, loc AS location, kind AS employment_type, {masked('n', 'n')} AS start_headcount, {masked('t', 'n')} AS terminations, {masked('t::DOUBLE / n', 'n')} AS attrition_rate, {shown('n')} FROM (
 SELECT c.month_start_date, dep, loc, kind, count(DISTINCT canonical_person_id) FILTER (is_active_on_date AND snapshot_date = f.first_day) AS n, count(DISTINCT canonical_person_id) FILTER (is_termination_date) AS t
 FROM cohort_days c JOIN (SELECT month_start_date, min(snapshot_date) AS first_day FROM cohort_days GROUP BY 1) f ON f.month_start_date = c.month_start_date GROUP BY ALL)""",
    **review("", "lower(trim(canonical_legal_first_name))", "lower(trim(canonical_legal_last_name))"),
    "review_hints": "SELECT s.source_record_key, count(r.place) AS n, min(CASE WHEN r.canonical_person_id = s.s_hint THEN r.place END) AS rank FROM review_sources s LEFT JOIN review_ranked r USING (source_record_key) WHERE s.s_hint IS NOT NULL GROUP BY 1",
    **review("_folded", norm("lower(trim(canonical_legal_first_name))"), norm("lower(trim(canonical_legal_last_name))")),
    "suppression_summary": summed("workforce_headcount_daily", "daily", "headcount_daily") + " UNION ALL " + summed("workforce_attrition_monthly", "monthly", "attrition_monthly"),
}


def sql(body: str) -> str:
    """``body`` over the models that it needs, as common table expressions."""
    import re

    needed: set[str] = set()

    def need(text: str) -> None:
        for word in set(re.findall(r"\w+", text)) & MODELS.keys() - needed:
            needed.add(word)
            need(MODELS[word])

    need(body)
    ctes = ",\n".join(f"{n} AS {'MATERIALIZED ' if n.startswith(('identity_', 'review_', 'canonical', 'stewardship', 'hris_spell', 'found')) or n in ('identity_source_nodes', 'evidence', 'workforce_daily', 'dim_employee', 'stg_hris', 'hris_persons', 'best') else ''}({q})" for n, q in MODELS.items() if n in needed)
    return f"WITH {ctes}\n{body}" if ctes else body
