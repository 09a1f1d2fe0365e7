"""A daily build: models in their order, each written, checked, and only then read by others."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import gates, privacy, workforce
from .engine import Engine
from .tables import SEGMENT, Table

LOG = "privacy_audit_log"
#: What each model reads. The order of the keys is one in which they can be built.
PARENTS: dict[str, tuple[str, ...]] = {
    "stg_hris": (), "stg_ats": (), "stg_payroll": (), "stg_crm": (), "stg_dms": (), "stg_erp": (),
    "hris_persons": ("stg_hris",), "payroll_spells": ("stg_payroll",), "dms_erp_unified": ("stg_dms", "stg_erp"),
    "identity_source_nodes": ("hris_persons", "stg_ats", "payroll_spells", "stg_crm", "dms_erp_unified"),
    "identity_pass_1": ("identity_source_nodes",), "identity_pass_2": ("identity_source_nodes", "stg_hris", "hris_persons", "identity_pass_1"),
    "identity_pass_3": ("identity_source_nodes", "stg_hris", "hris_persons", "identity_pass_1", "identity_pass_2"),
    "canonical_person": ("hris_persons", "identity_pass_1", "identity_pass_2", "identity_pass_3"),
    "stewardship_queue": ("identity_source_nodes", "identity_pass_1", "identity_pass_2", "identity_pass_3"),
    "dim_employee": ("stg_hris", "canonical_person"), "workforce_daily": ("dim_employee",),
    "headcount_daily": ("stg_hris", "hris_persons"), "attrition_monthly": ("stg_hris", "hris_persons"),
    "suppression_summary": ("headcount_daily", "attrition_monthly"), LOG: (),
}
#: Models that are clean mirrors of a raw table: checked where they are, not written.
VIEWS = tuple(m for m in PARENTS if m.startswith("stg_"))
#: Marts with a folder for each month of this column, and how their rows from a day on are made.
MONTHLY: dict[str, tuple[str, Callable[[Engine, dt.date | None], DataFrame]]] = {
    "workforce_daily": ("snapshot_date", lambda e, since: workforce.workforce_daily(e.dim_employee, e.cfg.as_of, since)),
    "headcount_daily": ("snapshot_date", lambda e, since: privacy.headcount_from_spells(e.cohort_spells, e.cfg.as_of, e.cfg.k, since)),
    "attrition_monthly": ("month_start_date", lambda e, since: privacy.attrition_from_spells(e.cohort_spells, e.cfg.as_of, e.cfg.k, since)),
}
#: Marts that people outside may read.
PUBLIC = ("headcount_daily", "attrition_monthly", "suppression_summary", LOG)


class BuildFailed(RuntimeError):
    """``results`` say what failed and what was left out because of it."""

    def __init__(self, results: list[Result]):
        super().__init__("; ".join(f"{r.model} {r.state}: {r.broken}" if r.broken else f"{r.model} {r.state}" for r in results if r.state in ("failed", "skipped")))
        self.results = results


@dataclass
class Result:
    """``state``: "built", "checked" (a view), "failed" (a rule of severity error is broken) or "skipped" (something it reads is not there)."""

    model: str
    state: str
    checks: dict[str, int] = field(default_factory=dict)
    since: dt.date | None = None

    @property
    def broken(self) -> dict[str, int]:
        return {n: v for n, v in self.checks.items() if v}


def ancestors(model: str) -> set[str]:
    return set().union(*[{p} | ancestors(p) for p in PARENTS[model]]) if PARENTS[model] else set()


def descendants(model: str) -> set[str]:
    return {m for m in PARENTS if model in ancestors(m)}


def selected(select: str = "") -> list[str]:
    """Models in the order of a build. ``select`` names them, apart by blanks: ``+m`` takes what m reads too, ``m+`` what reads m; nothing takes all."""
    chosen: set[str] = set()
    for word in select.split():
        model = word.strip("+")
        if model not in PARENTS:
            raise ValueError(f"no model {model!r}; there are {', '.join(PARENTS)}")
        chosen |= {model} | (ancestors(model) if word.startswith("+") else set()) | (descendants(model) if word.endswith("+") else set())
    return [m for m in PARENTS if m in chosen or not select.split()]


def table_of(spark: SparkSession, path: str, model: str) -> Table:
    if model == LOG:
        return privacy.audit_table(spark, f"{path}/{model}")
    return Table(spark, f"{path}/{model}", partition=privacy.MONTH if model in MONTHLY else None)


def run(engine: Engine, path: str, select: str = "", incremental: bool = False, rules: list[gates.Rule] | None = None) -> list[Result]:
    """Build the selected models as tables under ``path``.

    A model is written in one step, read back, and checked by its rules. If a rule of severity "error"
    is broken, what reads the model is skipped and keeps its old table; the other models are built, and
    ``BuildFailed`` is raised at the end. Models that are not selected are read from ``path`` if they
    are there. The audit log is made if there is none, and never rewritten.

    With ``incremental``, marts by month whose last build was up to an earlier day get the months from
    that day on anew, and no other; this suits a day's run over spells that have not changed before it.
    """
    rules = gates.rules_of(engine.cfg) if rules is None else rules
    results: dict[str, Result] = {}
    chosen = selected(select)
    use_built(engine, path, [m for m in PARENTS if m not in chosen])
    for model in chosen:
        lost = [p for p in PARENTS[model] if p in results and results[p].state in ("failed", "skipped")]
        results[model] = Result(model, "skipped") if lost else _built(engine, path, model, incremental, rules)
    if any(r.state in ("failed", "skipped") for r in results.values()):
        raise BuildFailed(list(results.values()))
    return list(results.values())


def use_built(engine: Engine, path: str, models: list[str] | None = None) -> None:
    """The engine reads these models from ``path`` where they are there, instead of making them."""
    for model in PARENTS if models is None else models:
        if model != LOG and model not in VIEWS and (there := table_of(engine.spark, path, model)).exists:
            engine.__dict__[model] = there.read()
            engine.built.add(model)


def _built(engine: Engine, path: str, model: str, incremental: bool, rules: list[gates.Rule]) -> Result:
    since = None
    if model == LOG:
        privacy.keep_audit_log(engine.spark, f"{path}/{model}")
        return Result(model, "built")
    if model not in VIEWS:
        table, note = table_of(engine.spark, path, model), {"as_of": engine.cfg.as_of.isoformat(), "run_id": engine.cfg.run_id}
        if model in MONTHLY:
            before = dt.date.fromisoformat(table.note()["as_of"]) if incremental and table.exists else None
            since = before.replace(day=1) if before and before <= engine.cfg.as_of else None
            date, make = MONTHLY[model]
            rows = privacy.by_month(make(engine, since), date)
            table.overwrite_partitions(_stamped(engine, rows), covers=lambda month: since is None or month >= since.isoformat(), **note)
        else:
            table.replace(_stamped(engine, getattr(engine, model)), **note)
        engine.__dict__[model] = table.read()
        engine.built.add(model)
    own = gates.of_models(rules, [model])
    found = {r["check_name"]: r["violations"] for r in gates.counts(lambda m: getattr(engine, m), own).collect()} if own else {}
    bad = any(found[r.name] and r.severity == "error" for r in own)
    return Result(model, "failed" if bad else "checked" if model in VIEWS else "built", found, since)


def _stamped(engine: Engine, rows: DataFrame) -> DataFrame:
    return rows.withColumn("_invocation_id", F.lit(engine.cfg.run_id)) if engine.cfg.run_id else rows


def publish(spark: SparkSession, path: str, database: str, models: tuple[str, ...] | None = None) -> list[str]:
    """Tables under ``path`` as ``database.<model>``, for SQL and for the catalog; the names.

    The catalog gets the folders of the version that is there now as partitions of an external table,
    and a view that shows its columns; nothing is copied, and filters on the month reach the folders.
    """
    names = []
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{database}`")
    for model in models or tuple(m for m in PARENTS if m not in VIEWS):
        table = table_of(spark, path, model)
        if not table.exists:
            continue
        schema, units = table.read().schema, table.units()
        month = [f for f in schema if f.name == table.partition]
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in [*[f for f in schema if f not in month], *month])
        files = f"`{database}`.`{model}_files`"
        spark.sql(f"DROP TABLE IF EXISTS {files}")
        parts = ", ".join(f"`{n}`" for n in [*[f.name for f in month], SEGMENT])
        spark.sql(f"CREATE TABLE {files} ({columns}, `{SEGMENT}` string) USING parquet PARTITIONED BY ({parts}) LOCATION '{table.path}'")
        added = []
        for seg, part in units:
            value = f"`{part.split('=', 1)[0]}` = '{part.split('=', 1)[1]}', " if part else ""
            added.append(f"PARTITION ({value}`{SEGMENT}` = '{seg}') LOCATION '{table.path}/{SEGMENT}={seg}/{part}'")
        if added:
            spark.sql(f"ALTER TABLE {files} ADD " + " ".join(added))
        spark.sql(f"CREATE OR REPLACE VIEW `{database}`.`{model}` AS SELECT {', '.join(f'`{f.name}`' for f in schema)} FROM {files}")
        names.append(f"{database}.{model}")
    return names


def unpublish(spark: SparkSession, database: str) -> None:
    """Forget the database; the tables' files stay."""
    spark.sql(f"DROP DATABASE IF EXISTS `{database}` CASCADE")
