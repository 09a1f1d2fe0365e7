"""The rules that a model has to keep before others build on it, counted in as few scans as they need.

All row rules of a table, and its side of every balance, are one aggregation over it; a unique key is
one aggregation by that key; a link is one anti join. What is counted is the number of rows (keys,
for unique ones) that break a rule, and 1 for a balance whose sides differ.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import checks

Get = Callable[[str], DataFrame]


@dataclass(frozen=True)
class Rule:
    """A rule of ``model``; one of the forms below. ``severity`` is "error" or "warn".

    * ``broken``: SQL condition that broken rows fulfil; unknown is not broken;
    * ``key``: columns whose values occur once; with one column, nulls are no value;
    * ``sides``: (model, SQL aggregate) pairs that give the same number;
    * ``link``: (column, model, column): known values of the first are among those of the second;
    * ``rows``: the broken rows, from the models in ``needs``.
    """

    name: str
    model: str
    broken: str = ""
    key: tuple[str, ...] = ()
    sides: tuple[tuple[str, str], ...] = ()
    link: tuple[str, str, str] | None = None
    rows: Callable[[Get], DataFrame] | None = None
    needs: tuple[str, ...] = ()
    severity: str = "error"

    @property
    def models(self) -> set[str]:
        return {self.model, *self.needs, *(m for m, _ in self.sides), *((self.link[1],) if self.link else ())}


def counts(get: Get, rules: Iterable[Rule], repeats: Callable[[Rule], DataFrame | None] = lambda rule: None) -> DataFrame:
    """``check_name, violations`` of each rule; ``get`` gives a model by name.

    ``repeats`` may name the rows among which those that break a rule on keys or rows are; without, these are all of the model.
    """
    measures: dict[str, dict[str, str]] = {}
    parts = []
    row = lambda label, value: F.struct(F.lit(label).alias("label"), value.cast("long").alias("value"))
    for rule in rules:
        if rule.broken:
            measures.setdefault(rule.model, {})[f"{rule.name}#"] = f"count_if({rule.broken})"
        for i, (model, aggregate) in enumerate(rule.sides):
            measures.setdefault(model, {})[f"{rule.name}#{i}"] = aggregate
        found = None
        among = repeats(rule) if rule.key or rule.rows else None
        of = get if among is None else lambda model, rule=rule, among=among: among if model == rule.model else get(model)
        if rule.key:
            found = checks.unique(of(rule.model), *rule.key)
        elif rule.link:
            column, other, at = rule.link
            found = checks.relationship(get(rule.model), column, get(other), at)
        elif rule.rows:
            found = rule.rows(of)
        if found is not None:
            parts.append(found.agg(F.count("*").alias("n")).select(row(f"{rule.name}#", F.col("n")).alias("r")))
    for model, aggregates in measures.items():
        one = get(model).agg(*[F.coalesce(F.expr(sql).cast("long"), F.lit(0)).alias(f"v{i}") for i, sql in enumerate(aggregates.values())])
        parts.append(one.select(F.explode(F.array(*[row(label, F.col(f"v{i}")) for i, label in enumerate(aggregates)])).alias("r")))
    every = reduce(DataFrame.union, parts).select(F.split_part("r.label", F.lit("#"), F.lit(1)).alias("check_name"), F.split_part("r.label", F.lit("#"), F.lit(2)).alias("side"), "r.value")
    differ = (F.min("value") != F.max("value")).cast("long")
    return every.groupBy("check_name").agg(F.when(F.max("side") == "", F.max("value")).otherwise(differ).alias("violations"))


def of_models(rules: Iterable[Rule], models: Iterable[str]) -> list[Rule]:
    models = set(models)
    return [r for r in rules if r.model in models]


# --- the rules ---------------------------------------------------------------------------------

#: Columns that are never null, unique keys, and the values of codes, by model.
REQUIRED = {
    "dms_erp_unified": ("dms_erp_person_key", "merge_topology", "has_dms", "has_erp", "has_broken_link"),
    "hris_persons": ("hris_person_key", "date_of_birth", "personal_email_local_part", "canonical_legal_first_name", "canonical_legal_last_name", "canonical_hire_date", "spell_count", "hris_employee_ids", "has_rehires", "has_name_change_marriage"),
    "payroll_spells": ("payroll_spell_key", "employee_payroll_id", "first_observed_legal_first_name", "first_observed_legal_last_name", "first_pay_period_start", "most_recent_pay_period_end", "pay_period_count", "gross_amount_cad_total", "hours_worked_total", "has_intra_spell_last_name_change"),
    "identity_source_nodes": ("source_record_key", "source_system", "source_primary_id"),
    **{f"identity_pass_{i}": ("source_record_key", "hris_person_key", "match_pass", "match_score", "candidate_hris_person_count", "auto_merge_qualified") for i in (1, 2, 3)},
    "canonical_person": ("canonical_person_id", "hris_person_key", "hris_employee_ids", "current_hris_employee_id", "date_of_birth", "canonical_hire_date", "matched_external_source_node_count", "matched_external_source_system_count", "payroll_spell_count"),
    "stewardship_queue": ("stewardship_queue_id", "source_record_key", "source_system", "stewardship_reason"),
    "dim_employee": ("employee_sk", "canonical_person_id", "hris_person_key", "hris_employee_id", "effective_start_date", "effective_end_date", "is_current_record", "employment_spell_number", "source_employment_status", "is_open_ended_spell"),
    "workforce_daily": ("daily_workforce_key", "snapshot_date", "employee_sk", "canonical_person_id", "hris_employee_id", "is_active_on_date", "is_hire_date", "is_termination_date", "tenure_days", "employee_day_count"),
    "headcount_daily": ("headcount_daily_key", "snapshot_date", "department", "location", "employment_type", "cohort_size_bucket", "is_reportable", "k_anonymity_threshold"),
    "attrition_monthly": ("attrition_monthly_key", "month_start_date", "month_end_date", "department", "location", "employment_type", "cohort_size_bucket", "is_reportable", "k_anonymity_threshold"),
    "suppression_summary": ("privacy_suppression_summary_key", "privacy_surface", "date_grain", "row_count", "reportable_row_count", "suppressed_row_count", "k_anonymity_threshold"),
}
KEYS = {
    "dms_erp_unified": (("dms_erp_person_key",),), "hris_persons": (("date_of_birth", "personal_email_local_part"),), "payroll_spells": (("payroll_spell_key",), ("employee_payroll_id",)), "identity_source_nodes": (("source_record_key",),),
    "canonical_person": (("canonical_person_id",), ("hris_person_key",)), "stewardship_queue": (("stewardship_queue_id",), ("source_record_key",)), "dim_employee": (("employee_sk",), ("hris_employee_id",)),
    "workforce_daily": (("daily_workforce_key",),), "headcount_daily": (("headcount_daily_key",),), "attrition_monthly": (("attrition_monthly_key",),), "suppression_summary": (("privacy_suppression_summary_key",),),
}
CODES = {
    "dms_erp_unified": {"merge_topology": ("DMS_AND_ERP", "DMS_ONLY", "ERP_ONLY_BROKEN_LINK")}, "identity_source_nodes": {"source_system": ("HRIS", "ATS", "PAYROLL", "CRM", "DMS_ERP")},
    **{f"identity_pass_{i}": {"match_pass": (i,)} for i in (1, 2, 3)},
    "stewardship_queue": {"source_system": ("ATS", "PAYROLL", "CRM", "DMS_ERP"), "stewardship_reason": ("NO_DETERMINISTIC_CANDIDATE", "AMBIGUOUS_CANDIDATES", "BELOW_AUTO_MATCH_THRESHOLD", "MANUAL_REVIEW_REQUIRED")},
    "dim_employee": {"source_employment_status": ("ACTIVE", "TERMINATED", "ON_LEAVE"), "employment_type": ("FTE", "CONTRACTOR", "PART_TIME")}, "workforce_daily": {"employee_day_count": (1,)},
    "suppression_summary": {"privacy_surface": ("workforce_headcount_daily", "workforce_attrition_monthly"), "date_grain": ("daily", "monthly")},
}


def _generic(model: str, required: tuple[str, ...], keys: tuple[tuple[str, ...], ...], codes: dict) -> list[Rule]:
    listed = lambda values: ", ".join(repr(v) for v in values)
    return [
        *[Rule(f"{model}.{c}.not_null", model, broken=f"{c} IS NULL") for c in required],
        *[Rule(f"{model}.{'_and_'.join(k)}.unique", model, key=k) for k in keys],
        *[Rule(f"{model}.{c}.accepted_values", model, broken=f"{c} NOT IN ({listed(values)})") for c, values in codes.items()],
    ]


def _staged() -> list[Rule]:
    out = []
    for model, (required, key, codes, links) in checks.STAGED.items():
        out += _generic(model, required, ((key,),), codes)
        out += [Rule(f"{model}.{c}.relationship", model, link=(c, *to)) for c, to in links.items()]
    out.append(Rule("stg_payroll.period.in_order", "stg_payroll", broken="pay_period_start > pay_period_end"))
    out.append(Rule("identity_source_nodes.system_and_key.unique", "identity_source_nodes", key=("source_system", "source_record_key")))
    return out


def _built() -> list[Rule]:
    out = []
    for model, required in REQUIRED.items():
        out += _generic(model, required, KEYS.get(model, ()), CODES.get(model, {}))
    out += [Rule(f"{m}.{c}.at_least_one", m, broken=f"{c} < 1") for m, c in (("hris_persons", "spell_count"), ("payroll_spells", "pay_period_count"))]
    return out


def _matched(get: Get) -> DataFrame:
    passes = [get(f"identity_pass_{i}").filter("auto_merge_qualified").select("source_record_key", "hris_person_key") for i in (1, 2, 3)]
    return reduce(DataFrame.union, passes)


def _accounted(get: Get) -> DataFrame:
    return _matched(get).select("source_record_key").distinct().union(get("stewardship_queue").select("source_record_key"))


def _unstable(get: Get) -> DataFrame:
    keys = ["date_of_birth", "personal_email_local_part"]
    spells = get("stg_hris").filter("work_email_local_part IS NOT NULL").join(get("hris_persons").select(*keys, "hris_person_key"), keys)
    return spells.groupBy("hris_person_key").agg(F.countDistinct("work_email_local_part").alias("n")).filter("n > 1")


PASSES = tuple(f"identity_pass_{i}" for i in (1, 2, 3))
#: SQL aggregate of the HR rows that can be a person's spell.
USABLE = "count_if(date_of_birth IS NOT NULL AND personal_email_local_part IS NOT NULL)"
SYSTEMS = {"ats": "stg_ats", "crm": "stg_crm", "dms_erp": "dms_erp_unified", "hris": "hris_persons", "payroll": "payroll_spells"}


def _summary_of(surface: str, column: str) -> str:
    return f"sum(CASE WHEN privacy_surface = '{surface}' THEN {column} END)"


def _singular() -> list[Rule]:
    """The checks that name their own model and rule."""
    count = "count(1)"
    own = [
        Rule("hris_persons_no_orphan_spells", "hris_persons", sides=(("stg_hris", USABLE), ("hris_persons", "sum(size(hris_employee_ids))"))),
        Rule("hris_persons_unique_key", "hris_persons", key=("hris_person_key",)),
        Rule("payroll_no_orphan_periods", "payroll_spells", sides=(("stg_payroll", "count(employee_payroll_id)"), ("payroll_spells", "sum(pay_period_count)"))),
        Rule("payroll_period_range", "payroll_spells", broken="first_pay_period_start > most_recent_pay_period_end"),
        Rule("dms_user_once", "dms_erp_unified", key=("dms_user_id",)),
        Rule("erp_user_once", "dms_erp_unified", key=("erp_user_id",)),
        Rule("broken_link_implies_erp", "dms_erp_unified", broken="has_broken_link AND NOT has_erp"),
        Rule("dms_erp_has_a_source", "dms_erp_unified", broken="NOT has_dms AND NOT has_erp"),
        Rule("work_email_stable", "hris_persons", rows=_unstable, needs=("stg_hris",)),
        *[Rule(f"nodes_{s}", "identity_source_nodes", sides=((m, count), ("identity_source_nodes", f"count_if(source_system = '{s.upper()}')"))) for s, m in SYSTEMS.items()],
        Rule("source_merged_once", "stewardship_queue", rows=lambda get: _matched(get).groupBy("source_record_key").agg(F.countDistinct("hris_person_key").alias("n")).filter("n > 1"), needs=PASSES),
        Rule("no_orphan_nodes", "stewardship_queue", rows=lambda get: get("identity_source_nodes").filter("source_system <> 'HRIS'").join(_accounted(get), "source_record_key", "left_anti"), needs=(*PASSES, "identity_source_nodes")),
        Rule("queue_has_no_merged", "stewardship_queue", rows=lambda get: get("stewardship_queue").join(_matched(get), "source_record_key", "left_semi"), needs=PASSES),
        Rule("dim_covers_spells", "dim_employee", sides=(("stg_hris", USABLE), ("dim_employee", count))),
        Rule("dim_no_overlap", "dim_employee", rows=lambda get: checks.overlapping_spells(get("dim_employee"))),
        Rule("daily_one_active_row", "workforce_daily", rows=lambda get: checks.several_active_a_day(get("workforce_daily"))),
        Rule("daily_bounds", "workforce_daily", broken="snapshot_date IS NULL OR snapshot_date < effective_start_date OR snapshot_date > termination_date OR snapshot_date > DATE '{as_of}'"),
        Rule("headcount_suppressed_null", "headcount_daily", broken="NOT is_reportable AND (headcount IS NOT NULL OR reportable_cohort_employee_count IS NOT NULL)"),
        Rule("headcount_small_suppressed", "headcount_daily", broken="is_reportable AND headcount < {k}"),
        Rule("attrition_suppressed_null", "attrition_monthly", broken="NOT is_reportable AND (start_headcount IS NOT NULL OR terminations IS NOT NULL OR attrition_rate IS NOT NULL)"),
        Rule("attrition_small_suppressed", "attrition_monthly", broken="is_reportable AND start_headcount < {k}"),
        Rule("summary_adds_up", "suppression_summary", broken="row_count <> reportable_row_count + suppressed_row_count"),
    ]
    marts = (("headcount", "headcount_daily", "workforce_headcount_daily"), ("attrition", "attrition_monthly", "workforce_attrition_monthly"))
    sizes = (("rows", "row_count", count), ("reportable", "reportable_row_count", "count_if(is_reportable)"), ("suppressed", "suppressed_row_count", "count_if(NOT is_reportable)"))
    own += [Rule(f"summary_matches_{m}_{n}", "suppression_summary", sides=((model, of_mart), ("suppression_summary", _summary_of(surface, column)))) for m, model, surface in marts for n, column, of_mart in sizes]
    return [Rule(**(vars(r) | {"name": f"check_{r.name}"})) for r in own]


STAGED, BUILT, SINGULAR = _staged(), _built(), _singular()
#: Every rule; ``{as_of}`` and ``{k}`` are filled in by ``rules_of``.
RULES = [*STAGED, *BUILT, *SINGULAR]


def rules_of(cfg, rules: Iterable[Rule] = RULES) -> list[Rule]:
    """The rules for a run's day and threshold."""
    fill = lambda r: r.broken.replace("{as_of}", cfg.as_of.isoformat()).replace("{k}", str(cfg.k))
    return [Rule(**(vars(r) | {"broken": fill(r)})) for r in rules]


def softened(rules: Iterable[Rule], *names: str) -> list[Rule]:
    """The rules with those named only warning: what they find is reported, and stops nothing."""
    rules = list(rules)
    if unknown := set(names) - {r.name for r in rules}:
        raise ValueError(f"no such rule: {sorted(unknown)}")
    return [Rule(**(vars(r) | {"severity": "warn"})) if r.name in names else r for r in rules]
