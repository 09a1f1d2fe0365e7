"""The models: each is a DataFrame over those it needs, and those that others read are tables."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from ..config import DEFAULT, EngineConfig
from ..operators import identity, persons, privacy, staging, workforce
from ..sources.nicknames import nickname_map
from .store import Store


def view(build) -> cached_property:
    """A lazy model."""
    return cached_property(build)


def table(build) -> cached_property:
    """A model that several others read: written to the run's store under its name, and read back."""
    name = build.__name__
    return cached_property(lambda self: self.store.table(name, build(self)))


class Engine:
    """Models over the six raw tables. A model is built when it is first asked for, with what it needs.

    ``path`` is the folder of the run's tables; by default a new one in the shared folder. ``drop``
    deletes them.
    """

    def __init__(self, spark: SparkSession, sources: dict[str, DataFrame], cfg: EngineConfig = DEFAULT, nicknames: DataFrame | None = None, path: str | None = None):
        self.spark, self.sources, self.cfg = spark, sources, cfg
        self.nicknames = nicknames if nicknames is not None else nickname_map(spark)
        self.store = Store(spark, path)
        self.built: set[str] = set()  # models that are read from a build's tables

    def drop(self) -> None:
        self.store.drop()

    def staged(self, raw: str) -> DataFrame:
        return staging.STAGING[raw][1](self.sources[raw])

    stg_hris = view(lambda self: self.staged("hris_employees"))
    stg_ats = view(lambda self: self.staged("ats_candidates"))
    stg_payroll = view(lambda self: self.staged("payroll_records"))
    stg_crm = view(lambda self: self.staged("crm_sales_reps"))
    stg_dms = view(lambda self: self.staged("dms_users"))
    stg_erp = view(lambda self: self.staged("erp_users"))
    payroll_spells = view(lambda self: persons.payroll_spells(self.stg_payroll))
    dms_erp_unified = view(lambda self: persons.dms_erp_unified(self.stg_dms, self.stg_erp))

    @table
    def hris_persons(self) -> DataFrame:
        return persons.hris_persons(self.stg_hris)

    @table
    def identity_source_nodes(self) -> DataFrame:
        return identity.source_nodes(self.hris_persons, self.stg_ats, self.payroll_spells, self.stg_crm, self.dms_erp_unified, self.nicknames)

    @table
    def hris_spell_names(self) -> DataFrame:
        return identity.hris_spell_names(self.stg_hris, self.hris_persons, self.nicknames)

    @table
    def identity_pass_1(self) -> DataFrame:
        return identity.pass_1(self.identity_source_nodes)

    # Not a table: its rows grow with the square of a name's frequency, and what reads it needs its best rows only.
    identity_pass_2 = view(lambda self: identity.pass_2(self.identity_source_nodes, self.hris_spell_names, self.identity_pass_1))

    @table
    def identity_pass_2_best(self) -> DataFrame:
        if "identity_pass_2" in self.built:
            return identity.best_by_score(self.identity_pass_2.select(*identity.EVIDENCE))
        return identity.pass_2_best(self.identity_source_nodes, self.hris_spell_names, self.identity_pass_1)

    @table
    def identity_pass_3(self) -> DataFrame:
        return identity.pass_3(self.identity_source_nodes, self.hris_spell_names, self.identity_pass_1, self.identity_pass_2_best)

    @property
    def passes(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        return self.identity_pass_1, self.identity_pass_2, self.identity_pass_3

    @property
    def best_of_passes(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """The passes, of the second only the best row of each source."""
        return self.identity_pass_1, self.identity_pass_2_best, self.identity_pass_3

    @table
    def canonical_person(self) -> DataFrame:
        return identity.canonical_person(self.hris_persons, *self.best_of_passes)

    @table
    def stewardship_queue(self) -> DataFrame:
        return identity.stewardship_queue(self.identity_source_nodes, *self.best_of_passes)

    @table
    def dim_employee(self) -> DataFrame:
        return workforce.dim_employee(self.stg_hris, self.canonical_person)

    workforce_daily = view(lambda self: workforce.workforce_daily(self.dim_employee, self.cfg.as_of))
    cohort_spells = view(lambda self: workforce.cohort_spells(self.stg_hris, self.hris_persons))
    headcount_daily = view(lambda self: privacy.headcount_from_spells(self.cohort_spells, self.cfg.as_of, self.cfg.k))
    attrition_monthly = view(lambda self: privacy.attrition_from_spells(self.cohort_spells, self.cfg.as_of, self.cfg.k))
    suppression_summary = view(lambda self: privacy.suppression_summary(self.headcount_daily, self.attrition_monthly, self.cfg))

    MODELS = (
        "stg_hris", "stg_ats", "stg_payroll", "stg_crm", "stg_dms", "stg_erp", "hris_persons", "payroll_spells", "dms_erp_unified", "identity_source_nodes", "identity_pass_1",
        "identity_pass_2", "identity_pass_3", "canonical_person", "stewardship_queue", "dim_employee", "workforce_daily", "headcount_daily", "attrition_monthly", "suppression_summary",
    )
