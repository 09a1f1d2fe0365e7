import datetime as dt
import json
import random
import time
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kinroster.__main__ import main
from kinroster.config import EngineConfig
from kinroster.functions import similarity
from kinroster.functions.similarity import indel
from kinroster.operators import checks, gates, metrics, privacy, residual, staging, workforce
from kinroster.operators.persons import dms_erp_unified, hris_persons
from kinroster.plans import oracle, queries, store
from kinroster.plans.engine import Engine
from kinroster.sources import fixture, generator, raw

SF = "/root/testdata/sf0.001"
AS_OF = dt.date(2024, 12, 31)
HRIS = "hris_employee_id string, legal_first_name string, legal_last_name string, preferred_name string, date_of_birth date, personal_email string, work_email string, hire_date date, termination_date date, employment_status string, employment_type string, department string, job_title string, manager_hris_id string, location string, loaded_at timestamp_ntz"


@pytest.fixture(scope="module")
def engine(spark):
    return Engine(spark, fixture.sources(spark, SF))


def hris(spark, *rows):
    """Rows of (id, last name, birth, personal address, hired, ended)."""
    stamp = dt.datetime(2024, 1, 1)
    full = [(i, " Ann ", last, "", born, mail, "ann@x.example", hired, ended, "active", "fte", "Eng", "Dev", None, "Oslo", stamp) for i, last, born, mail, hired, ended in rows]
    return staging.stg_hris(spark.createDataFrame(full, HRIS))


def test_all_checks_pass(engine):
    broken = {n: df.count() for n, df in checks.all_checks(engine).items()}
    assert {n: c for n, c in broken.items() if c} == {}
    assert checks.identifying_columns({"headcount": engine.headcount_daily, "attrition": engine.attrition_monthly, "summary": engine.suppression_summary}) == []


def test_every_reason_pass_and_topology_occurs(spark):
    e = Engine(spark, fixture.sources(spark, "/root/testdata/sf0.01"))
    assert all(p.filter("auto_merge_qualified").limit(1).count() for p in (e.identity_pass_1, e.identity_pass_3))
    assert e.identity_pass_2.limit(1).count()
    assert {r[0] for r in e.stewardship_queue.select("stewardship_reason").distinct().collect()} >= {"NO_DETERMINISTIC_CANDIDATE", "AMBIGUOUS_CANDIDATES", "BELOW_AUTO_MATCH_THRESHOLD"}
    assert e.dms_erp_unified.select("merge_topology").distinct().count() == 3


def test_oracle_agrees(spark):
    """A few models against DuckDB; the driver compares all of them."""
    duckdb = pytest.importorskip("duckdb")
    db = duckdb.connect()
    for t in fixture.DRIVER_TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    for name in ("hris_persons", "dms_erp_unified", "headcount_daily", "attrition_monthly"):
        mine = queries.QUERIES[name](spark, SF)
        cols = sorted(mine.columns)
        as_text = lambda rows: sorted(tuple("" if v is None else str(v) for v in r) for r in rows)
        theirs = db.sql(f"SELECT {', '.join(cols)} FROM ({queries.ORACLES[name]})").fetchall()
        assert as_text(mine.select(*cols).collect()) == as_text(theirs), name


def test_marts_from_days_and_from_spells_are_equal(engine):
    days = engine.workforce_daily
    for one, other in ((privacy.headcount_daily(days, 2), privacy.headcount_from_spells(engine.cohort_spells, engine.cfg.as_of, 2)), (privacy.attrition_monthly(days, 2), privacy.attrition_from_spells(engine.cohort_spells, engine.cfg.as_of, 2))):
        assert one.exceptAll(other).count() == 0 and other.exceptAll(one).count() == 0


def test_overlapping_spells_count_a_person_once(spark):
    d = dt.date
    rows = [("cp", d(2024, 1, 1), d(2024, 1, 10), "Eng", None, "FTE"), ("cp", d(2024, 1, 5), None, "Eng", None, "FTE"), ("cq", d(2024, 1, 8), d(2024, 1, 9), "Eng", None, "FTE")]
    spells = spark.createDataFrame(rows, "canonical_person_id string, effective_start_date date, termination_date date, department string, location string, employment_type string")
    sizes = {r["snapshot_date"].day: r["headcount"] for r in privacy.headcount_from_spells(spells, d(2024, 1, 12), 1).collect()}
    assert sizes == {day: 2 if day == 8 else 1 for day in range(1, 13)}


def test_persons_and_spells(spark):
    d = dt.date
    stg = hris(spark, ("a", "Old", d(1990, 1, 1), "A@x.y", d(2020, 1, 1), d(2021, 1, 1)), ("b", "New", d(1990, 1, 1), "a@x.y", d(2022, 1, 1), None), ("c", "Gone", None, "c@x.y", d(2020, 1, 1), None), ("late", "Late", d(1980, 1, 1), "l@x.y", d(2030, 1, 1), None))
    people = {r["personal_email_local_part"]: r for r in hris_persons(stg).collect()}
    assert people.keys() == {"a", "l"}
    assert people["a"]["spell_count"] == 2 and people["a"]["has_rehires"] and people["a"]["has_name_change_marriage"]
    assert (people["a"]["canonical_legal_last_name"], people["a"]["current_legal_last_name"], people["a"]["hris_employee_ids"]) == ("old", "new", ["a", "b"])
    dim = workforce.dim_employee(stg, _canonical(hris_persons(stg)))
    rows = {r["hris_employee_id"]: r for r in dim.collect()}
    assert rows["a"]["effective_end_date"] == d(2020, 12, 31) and not rows["a"]["is_current_record"] and rows["b"]["employment_spell_number"] == 2
    days = workforce.workforce_daily(dim, d(2020, 1, 3))
    assert days.count() == 3 and days.filter("is_hire_date").count() == 1  # those hired after as_of have no days
    ended = workforce.workforce_daily(dim, d(2021, 6, 1)).filter("is_termination_date")
    assert [(r["snapshot_date"], r["is_active_on_date"]) for r in ended.collect()] == [(d(2021, 1, 1), False)]


def _canonical(people):
    from kinroster.operators import identity

    nodes = people.sparkSession.createDataFrame([], ", ".join(f"{c} {k}" for c, k in identity.NODE.items()))
    names = people.sparkSession.createDataFrame([], "h_key string, h_dob date, h_hired date, legal_root string, preferred_root string, h_last string, h_first_name string, h_last_name string, h_domain string, h_token string")
    one = identity.pass_1(nodes)
    two = identity.pass_2(nodes, names, one)
    return identity.canonical_person(people, one, two, identity.pass_3(nodes, names, one, two))


def test_topology(spark):
    stamp = dt.datetime(2024, 1, 1)
    dms = spark.createDataFrame([("d1", "A", "B", "u", "L", "D", None, None, stamp), ("d2", "A", "B", "u", "L", "D", None, None, stamp)], "dms_user_id string, short_first_name string, last_name string, dms_username string, location_code string, department_code string, hire_date_dms date, terminated_date_dms date, loaded_at timestamp_ntz")
    erp = spark.createDataFrame([("e1", "d1", "A", "B", None, "r", "g", None, None, stamp), ("e2", None, "A", "B", None, "r", "g", None, None, stamp), ("e3", "gone", "A", "B", None, "r", "g", None, None, stamp)], "erp_user_id string, linked_dms_user_id string, short_first_name string, last_name string, erp_email string, role_code string, permissions_group string, created_at timestamp_ntz, last_login_at timestamp_ntz, loaded_at timestamp_ntz")
    rows = {(r["dms_user_id"], r["erp_user_id"]): (r["merge_topology"], r["has_broken_link"]) for r in dms_erp_unified(staging.stg_dms(dms), staging.stg_erp(erp)).collect()}
    assert rows == {("d1", "e1"): ("DMS_AND_ERP", False), ("d2", None): ("DMS_ONLY", False), (None, "e2"): ("ERP_ONLY_BROKEN_LINK", True), (None, "e3"): ("ERP_ONLY_BROKEN_LINK", False)}


QUEUE = "source_system string, source_record_key string, source_first_name_root string, source_last_name_norm string, source_hire_date date, source_email_local_part string, suggested_canonical_person_id string, stewardship_reason string"
PEOPLE = "canonical_person_id string, canonical_legal_first_name string, canonical_legal_last_name string, canonical_hire_date date, work_email_local_part string, personal_email_local_part string"


def review(spark, sources, people, mode="parity", **options):
    s = residual.source_identities(spark.createDataFrame(sources, QUEUE))
    p = residual.canonical_identities(spark.createDataFrame(people, PEOPLE), mode)
    return s, residual.ranked(residual.scored(residual.candidate_pairs(s, p)), **options)


def metrics_of(df):
    return {(r["metric"], r["name"]): r["value"] for r in df.collect()}


def test_residual(spark):
    d = dt.date
    strong = ("ATS", "ATS::1", "robert", "smith", d(2024, 1, 8), "rsmith", "cp_abc", "AMBIGUOUS_CANDIDATES")
    nobody = ("CRM", "CRM::2", "ana", "lopez", d(2020, 1, 1), "ana", None, "NO_DETERMINISTIC_CANDIDATE")
    people = [("cp_abc", "Robert", "Smith", d(2024, 1, 1), "robert.smith", "rsmith"), ("cp_xyz", "Charles", "Nguyen", d(2010, 5, 5), "cn", None)]
    sources, ranked = review(spark, [strong, nobody], people)
    rows = ranked.collect()
    assert [(r["source_record_key"], r["canonical_person_id"], r["recommendation"], r["candidate_rank"]) for r in rows] == [("ATS::1", "cp_abc", "high_confidence_review", 1)]
    assert rows[0]["residual_score"] >= 0.92 and rows[0]["feature_scores"]["hire_date"] == 1.0
    said = ["recommendation=high_confidence_review", "last_name_similarity=1.00", "first_name_root_exact", "email_local_similarity=1.00", "hire_date_within_30_days", "deterministic_candidate_hint"]
    assert rows[0]["reasons"] == said and residual.exported(ranked).first()["reasons"] == "; ".join(said)
    found = metrics_of(residual.summary(sources, ranked))
    assert (found["source_record_count", ""], found["source_records_with_candidates", ""], found["review_yield_rate", ""]) == (2, 1, 0.5)
    assert found["recommendation_count", "high_confidence_review"] == found["source_system_count", "ATS"] == found["feature_coverage", "last_name"] == 1
    page = residual.report("Review", [tuple(r) for r in residual.summary(sources, ranked).collect()], [r.asDict() for r in residual.exported(residual.global_top(ranked, 5)).collect()])
    assert "| source_record_count |  | 2 |" in page and "| ATS::1 |" in page
    none = metrics_of(residual.summary(sources.limit(0), ranked.limit(0)))
    assert none["review_yield_rate", ""] == 0 and none["feature_coverage", "email_local"] == 0


def test_only_the_best_is_kept(spark):
    source = ("ATS", "ATS::1", "patrick", "obrien", dt.date(2024, 1, 8), "pobrien", None, "NO_DETERMINISTIC_CANDIDATE")
    people = [("cp_good", "patrick", "obrien", dt.date(2024, 1, 8), "pobrien", None), ("cp_bad", "maria", "obrien", dt.date(2020, 1, 1), "mobrien", None)]
    assert [r["canonical_person_id"] for r in review(spark, [source], people, top_n=1)[1].collect()] == ["cp_good"]


def test_proxy_evaluation(spark):
    """A hint that is first, one that is second, one without any candidate."""
    day = dt.date(2024, 1, 8)
    sources = [("ATS", f"ATS::{i}", "ann", last, day, None, hint, "AMBIGUOUS_CANDIDATES") for i, (last, hint) in enumerate([("one", "cp_1"), ("two", "cp_2"), ("three", "cp_9"), ("one", None)])]
    people = [("cp_1", "ann", "one", day, None, None), ("cp_2", "ann", "twi", dt.date(2024, 3, 1), None, None), ("cp_3", "ann", "two", day, None, None), ("cp_4", "bob", "four", dt.date(1990, 1, 1), None, None)]
    s, ranked = review(spark, sources, people)
    got = [(r["source_record_key"], r["canonical_person_id"], r["candidate_rank"]) for r in ranked.orderBy("source_record_key", "candidate_rank").collect()]
    assert got == [("ATS::0", "cp_1", 1), ("ATS::1", "cp_3", 1), ("ATS::1", "cp_2", 2), ("ATS::3", "cp_1", 1)] or got[0] == ("ATS::0", "cp_1", 1)
    found = metrics_of(residual.proxy_evaluation(s, ranked))
    assert found["evaluated_source_count", ""] == 3 and found["top_1_alignment_count", ""] == 1
    assert found["missing_candidate_count", ""] == sum(k not in {g[0] for g in got} for k in ("ATS::0", "ATS::1", "ATS::2"))
    hits = [g for g in got if {"ATS::0": "cp_1", "ATS::1": "cp_2"}.get(g[0]) == g[1]]
    assert found["top_k_alignment_count", ""] == len(hits) and found["mean_proxy_label_rank", ""] == sum(g[2] for g in hits) / len(hits)


def brute_review(sources, people):
    """All pairs of each pool, by the definitions."""
    same = lambda a, b: None if not a or not b else float(a == b)
    steps = lambda n: next((s for most, s in ((7, 1.0), (30, 0.9), (90, 0.6), (365, 0.25)) if n <= most), 0.0)
    out = set()
    for system, key, first, last, hired, local, hint, _ in sources:
        pool = [p for p in people if p[0] == hint or (last and p[2] == last)] or people
        found = []
        for pid, c_first, c_last, c_hired, work, personal in pool:
            mails = [x for x in (indel(local, work), indel(local, personal)) if x is not None]
            f = [same(first, c_first), indel(last, c_last), max(mails, default=None), None if not hired or not c_hired else steps(abs((hired - c_hired).days)), same(hint, pid)]
            w = [(s, n) for s, n in zip(f, residual.WEIGHTS.values(), strict=True) if s is not None]
            known = sum(n for _, n in w)
            score, anchors = sum(s * n for s, n in w) / known if known else 0.0, sum(s >= 0.85 for s, _ in w)
            if score >= 0.75 - 1e-12 and known >= 50 and anchors >= 2:
                found.append((round(score, 9), anchors, known, pid))
        out |= {(key, pid, score, place) for place, (score, _, _, pid) in enumerate(sorted(found, reverse=True)[:3], 1)}
    return out


def test_no_candidate_is_lost(spark):
    """Every pair that can be suggested is built, whatever is missing, with and without a pool of its own."""
    rng = random.Random(5)
    pick = lambda *xs: rng.choice(xs)
    day = lambda: pick(None, dt.date(2020, 1, 1) + dt.timedelta(days=rng.randrange(200)))
    mail = lambda: pick(None, "rob.smith", "rob.smyth", "ann.lee", "a.lee", f"u{rng.randrange(9)}")
    people = [(f"cp_{i}", pick(None, "rob", "ann"), pick(None, "smith", "smyth", "lee", "leigh"), day(), mail(), mail()) for i in range(60)]
    sources = [("ATS", f"ATS::{i}", pick(None, "rob", "ann", "eve"), pick(None, "smith", "smithe", "lee", "leeh", "leig"), day(), mail(), pick(None, None, f"cp_{rng.randrange(70)}"), "x") for i in range(150)]
    got = {(r["source_record_key"], r["canonical_person_id"], round(r["residual_score"], 9), r["candidate_rank"]) for r in review(spark, sources, people)[1].collect()}
    assert got == brute_review(sources, people) and len(got) > 100


def test_review_takes_the_whole_queue(spark):
    queue = [("ATS", f"ATS::{i:04}", "ana", "lopez", None, None, None, "NO_DETERMINISTIC_CANDIDATE") for i in range(600)]
    queue.append(("PAYROLL", "PAYROLL::1", "robert", "smith", dt.date(2024, 1, 8), "rsmith", "cp_abc", "AMBIGUOUS_CANDIDATES"))
    people = [("cp_abc", "Robert", "Smith", dt.date(2024, 1, 1), "robert.smith", "rsmith")]
    e = SimpleNamespace(stewardship_queue=spark.createDataFrame(queue, QUEUE), canonical_person=spark.createDataFrame(people, PEOPLE))
    sources, scores = queries._scores(e)
    assert sources.count() == 601
    assert [r["source_record_key"] for r in residual.ranked(scores).collect()] == ["PAYROLL::1"]


def test_metrics_are_filtered_and_logged(spark, engine, tmp_path):
    cfg = EngineConfig(as_of=AS_OF, run_id="r1")
    filters = metrics.Filters(dt.date(1998, 1, 1), dt.date(1998, 1, 31), "", None, "FTE", 50)
    answer = metrics.respond(spark, engine.headcount_daily, "headcount", filters, cfg, "review", str(tmp_path / "log"))
    assert answer["row_count"] == len(answer["data"]) <= 50 and answer["audit_logged"]
    assert {r["employment_type"] for r in answer["data"]} == {"FTE"} and answer["suppressed_row_count"] == sum(not r["is_reportable"] for r in answer["data"])
    log = spark.read.parquet(str(tmp_path / "log")).first()
    assert (log["actor"], log["query_surface"], log["result_row_count"], log["dbt_invocation_id"]) == ("anonymous", "workforce_headcount_daily", answer["row_count"], "r1")
    assert not metrics.respond(spark, engine.suppression_summary, "suppression", metrics.Filters(), cfg, "x", "/proc/none/log")["audit_logged"]
    assert json.loads(log["filters_json"]) == {"start_date": "1998-01-01", "end_date": "1998-01-31", "department": "", "employment_type": "FTE", "limit": 50}
    assert privacy.audit_log(spark, str(tmp_path / "log")).count() == 1 and privacy.audit_log(spark, str(tmp_path / "none")).count() == 0
    gone = spark.createDataFrame([(1,)], "snapshot_date int").withColumns({c: F.raise_error(F.lit("gone")) for c in metrics.SURFACES["headcount"].columns[1:]})
    with pytest.raises(metrics.SourceUnavailable):
        metrics.respond(spark, gone, "headcount", metrics.Filters(), cfg, "x", str(tmp_path / "log"))
    with pytest.raises(metrics.UnknownSurface):
        metrics.metric_query(engine.headcount_daily, "salaries")


def test_raw_tables_and_commands(spark, tmp_path):
    """Raw tables are loaded, read in both formats, and give the same candidates, report and evaluation by command."""
    derived = fixture.sources(spark, SF)
    for name, df in derived.items():
        raw.load(df, str(tmp_path / "raw"), name)
        raw.shaped(df, name).write.option("header", True).csv(str(tmp_path / "csv" / f"{name}.csv"))
    for kind, folder in (("parquet", "raw"), ("csv", "csv")):
        tables = raw.read(spark, str(tmp_path / folder), kind)
        assert tables.keys() == derived.keys() and all(df.count() == derived[n].count() for n, df in tables.items())
    assert tables["payroll_records"].exceptAll(raw.shaped(derived["payroll_records"], "payroll_records")).count() == 0
    with pytest.raises(ValueError, match="termination_date"):
        raw.shaped(derived["hris_employees"].drop("termination_date"), "hris_employees")
    given = ["--raw", str(tmp_path / "raw")]
    main(["residual-candidates", *given, "--out", str(tmp_path / "csv_out"), "--limit", "200"], spark)
    rows = spark.read.option("header", True).csv(str(tmp_path / "csv_out"))
    assert rows.columns[:3] == ["source_record_key", "source_system", "candidate_canonical_person_id"] and rows.count() > 0
    main(["residual-evaluate", *given, "--out", str(tmp_path / "eval"), "--limit", "200"], spark)
    found = json.loads("\n".join(r[0] for r in spark.read.text(str(tmp_path / "eval" / "metrics.json")).collect()))
    assert found["evaluated_source_count"] >= found["top_k_alignment_count"] >= found["top_1_alignment_count"]
    assert spark.read.text(str(tmp_path / "eval" / "report.md")).first()[0] == "# Alignment with hints"


def test_generated_staff(spark):
    """Shares and links are as declared, the same arguments give the same rows, and the engine's checks hold on them."""
    made, again = (generator.generate(spark, 400) for _ in range(2))
    assert all(df.exceptAll(again[n]).count() == 0 for n, df in made.items())
    assert generator.generate(spark, 50, seed=1)["dms_users"].exceptAll(made["dms_users"]).count() > 0
    n = {name: df.count() for name, df in made.items()}
    spells = n["dms_users"]
    assert 400 <= spells <= 440 and n["ats_candidates"] == n["erp_users"] == spells <= n["hris_employees"]
    assert 0.15 < n["crm_sales_reps"] / spells < 0.4 and n["payroll_records"] > 5 * spells
    e = Engine(spark, made, EngineConfig(as_of=dt.date(2026, 5, 5)))
    assert e.hris_persons.count() == 400
    broken = e.dms_erp_unified.filter("has_broken_link").count()
    assert 0.05 < broken / spells < 0.16 and e.identity_source_nodes.count() == 400 + 3 * spells + broken + n["crm_sales_reps"]
    bad = {name: df.count() for name, df in checks.staged_checks(e).items()}
    assert not any(bad.values())
    queued = {r[0]: r[1] for r in e.stewardship_queue.groupBy("source_system").count().collect()}
    assert queued["PAYROLL"] == spells and 0 < queued["ATS"] < 0.2 * spells and 0 < queued["DMS_ERP"] < spells
    e.drop()


def test_generic_checks(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, None)], "k int, v string")
    assert checks.not_null(df, "v").count() == 1 and checks.unique(df, "k").count() == 1 and checks.unique(df, "k", "v").count() == 0
    assert checks.accepted_values(df, "v", ["a"]).count() == 1  # null passes
    assert checks.relationship(df, "k", spark.createDataFrame([(1,)], "id int"), "id").count() == 1
    assert checks.holds(df, F.col("k") >= 2).count() == 2
    loads = spark.createDataFrame([(dt.datetime(2024, 1, 1),)], "loaded_at timestamp_ntz")
    assert [checks.freshness(loads, "loaded_at", dt.date(2024, 1, day)).first()["state"] for day in (5, 20)] == ["PASS", "WARN"]


def test_oracle_names_only_what_it_needs():
    assert "attrition" not in oracle.sql("SELECT * FROM stg_hris")


def test_review_does_not_shuffle_pairs(spark):
    """The pairs of a name are scored where the join makes them, and leave a batch as the best of each source."""
    queue = [("PAYROLL", f"PAYROLL::{i}", "ann", "li", dt.date(2020, 1, 1 + i % 9), None, None, "x") for i in range(40)]
    people = [(f"cp_{i:03}", "Ann", "Li", dt.date(2020, 1, 1 + i % 28), None, None) for i in range(60)]
    s = residual.source_identities(spark.createDataFrame(queue, QUEUE))
    pairs = residual.candidate_pairs(s, residual.canonical_identities(spark.createDataFrame(people, PEOPLE)))
    scores = residual.scored(pairs)
    plan = scores._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan[: plan.index("SortMergeJoin")]
    batch = pa.RecordBatch.from_pylist([r.asDict(recursive=True) for r in residual.suggested(scores).collect()])
    left = next(residual.best_of_batch(iter([batch]), 3))
    assert batch.num_rows == 2400 and left.num_rows == 120
    kept = sorted((r["source_record_key"], r["canonical_person_id"]) for r in left.to_pylist())
    assert kept == sorted((r["source_record_key"], r["canonical_person_id"]) for r in residual.ranked(scores).collect())
    assert not list(residual.best_of_batch(iter([batch.slice(0, 0)]), 3))[0].num_rows


def test_days_are_not_dealt_by_key(spark, engine):
    """The keys of days are sought among spells that are there twice, and what is found is the same."""
    dim = engine.dim_employee.limit(40).union(engine.dim_employee.limit(40).limit(2))
    rules = gates.of_models(gates.BUILT, ["workforce_daily"])
    unique = next(r for r in rules if r.key)
    for spells, some in ((engine.dim_employee, False), (spark.createDataFrame(dim.collect(), dim.schema), True)):
        e = SimpleNamespace(dim_employee=spells, workforce_daily=workforce.workforce_daily(spells, engine.cfg.as_of), cfg=engine.cfg, built=set())
        found = {tuple(r) for r in queries._counted(e, rules).collect()}
        assert found == {tuple(r) for r in gates.counts(lambda m, e=e: getattr(e, m), gates.rules_of(e.cfg, rules)).collect()}
        assert (dict(found)[unique.name] > 0) == some
        dealt = queries._repeats(e, unique)
        assert dealt.count() < e.workforce_daily.count() and (dealt.count() > 0) == some
    e.built.add("workforce_daily")
    assert queries._repeats(e, unique) is None


def test_first_candidates_are_those_of_all_pairs(spark):
    """What is sought near a source's date, and elsewhere only if need be, is what all pairs give, whatever is missing."""
    rng = random.Random(11)
    pick = lambda *xs: rng.choice(xs)
    day = lambda often: pick(*[dt.date(2020, 1, 1) + dt.timedelta(days=rng.randrange(500))] * often, None)
    mail = lambda: pick(None, "rob.smith", "ann.lee", "a.lee", f"u{rng.randrange(9)}")
    for undated, unnamed in ((9, "rob"), (2, None)):
        people = [(f"cp_{i:03}", pick("rob", "ann", unnamed), pick("smith", "lee", "leigh", unnamed), day(undated), mail(), mail()) for i in range(240)]
        sources = [("ATS", f"ATS::{i // 2 if i < 40 else i}", pick(None, "rob", "ann", "ann", "eve"), pick(None, "smith", "lee", "smith", "leeh", "leigh"), day(undated), pick(None, mail()), pick(None, f"cp_{rng.randrange(250):03}"), "x") for i in range(300)]
        s = residual.source_identities(spark.createDataFrame(sources, QUEUE))
        p = residual.canonical_identities(spark.createDataFrame(people, PEOPLE))
        made, every = residual.best(s, p), residual.ranked(residual.scored(residual.candidate_pairs(s, p)))
        made, every = ([r.asDict(recursive=True) for r in df.drop("s_hint").orderBy("source_record_key", "candidate_rank", "source_system").collect()] for df in (made, every.select(*made.columns)))
        assert made == every and len(every) > 200


def test_persons_far_away_are_not_compared(spark):
    """Sources that are alike are compared once, and with persons hired near; only one that finds too few there meets the others."""
    queue = [("PAYROLL", f"PAYROLL::{i}", "ann", "li", dt.date(2020, 1, 1 + i % 5), None, None, "x") for i in range(100)]
    queue.append(("ATS", "ATS::1", "ann", "li", dt.date(2029, 1, 1), "ann.li", None, "x"))
    people = [(f"cp_{i:04}", "Ann", "Li", dt.date(2020, 1, 1) + dt.timedelta(days=10 * (i % 200)), "ann.li", None) for i in range(2000)]
    s, p = (f(spark.createDataFrame(rows, kind)) for f, rows, kind in ((residual.source_identities, queue, QUEUE), (residual.canonical_identities, people, PEOPLE)))
    held = {}

    def keep(name, df):
        held[name] = spark.createDataFrame(df.collect(), df.schema)
        return held[name]

    found = residual.best(s, p, keep)
    key = ["source_record_key", "candidate_rank", "canonical_person_id"]
    assert sorted(map(tuple, found.select(*key).collect())) == sorted(map(tuple, residual.ranked(residual.scored(residual.candidate_pairs(s, p))).select(*key).collect()))
    assert [r["s_local"] for r in held["review_beyond_30"].collect()] == ["ann.li"] and held["review_within_30"].count() == 5 * 4
    profiles = held["review_sources"].dropDuplicates(["profile"]).withColumn("source_record_key", F.col("profile"))
    assert profiles.count() == 6 and residual.candidate_pairs(profiles, p, 30).count() < 5 * 10 * 8 < residual.candidate_pairs(s, p).count() / 90


def test_pairs_that_occur_again_are_compared_once():
    a, b = pd.Series(["smith", None, "smith", "lee"] * 5), pd.Series(["smyth", "x", None, "lee"] * 5)
    assert [None if np.isnan(x) else x for x in similarity.indels(a, b)] == [similarity.indel(x, y) for x, y in zip(a, b, strict=True)]
    nothing = pd.Series([None] * 4, dtype=object)
    assert np.isnan(similarity.indels(a[:4], nothing)).all() and len(similarity.indels(a[:0], b[:0])) == 0


def test_days_are_not_dealt_by_person(spark, engine):
    """Days on which a person is active twice are sought in spells that meet, and what is found is the same."""
    rng = random.Random(3)
    start = lambda: dt.date(2024, 1, 1) + dt.timedelta(days=rng.randrange(60))
    spells = []
    for i in range(60):
        began = start()
        spells.append((f"sk{i}", f"cp_{i % 17}", began, rng.choice([None, began, began + dt.timedelta(days=rng.randrange(1, 25)), began - dt.timedelta(days=3), began + dt.timedelta(days=1)])))
    spells += [("n1", "cp_next", dt.date(2024, 1, 1), dt.date(2024, 2, 1)), ("n2", "cp_next", dt.date(2024, 2, 1), dt.date(2024, 3, 1))]
    dim = engine.dim_employee.limit(1).drop("employee_sk", "canonical_person_id", "effective_start_date", "termination_date")
    dim = spark.createDataFrame(spells, "employee_sk string, canonical_person_id string, effective_start_date date, termination_date date").join(dim, F.lit(True)).select(*engine.dim_employee.columns)
    rule = next(r for r in gates.SINGULAR if r.name == "check_daily_one_active_row")
    for spells, some in ((engine.dim_employee, False), (spark.createDataFrame(dim.collect(), dim.schema), True)):
        e = SimpleNamespace(dim_employee=spells, workforce_daily=workforce.workforce_daily(spells, dt.date(2024, 6, 1)), cfg=EngineConfig(as_of=dt.date(2024, 6, 1)), built=set())
        found = queries._counted(e, [rule]).first()["violations"]
        assert found == checks.several_active_a_day(e.workforce_daily).count() and (found > 0) == some
        dealt = queries._repeats(e, rule)
        assert dealt.count() < e.workforce_daily.count() and not dealt.filter("canonical_person_id = 'cp_next'").count()


def test_shuffle_files_go_when_a_table_is_written(spark):
    files = lambda: spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles().size()
    before, kept = files(), spark.conf.get(store.SHORT_LIVED, None)
    made = store.Store(spark)
    made.table("dealt", spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
    for _ in range(50):
        if files() <= before:
            break
        time.sleep(0.1)
    assert files() <= before and spark.conf.get(store.SHORT_LIVED, None) == kept
    made.drop()


def test_names_without_common_letters_are_not_compared(spark):
    """A source that is compared with all meets those whose last name has letters enough of its own."""
    day = dt.date(2020, 1, 1)
    s = residual.source_identities(spark.createDataFrame([("PAYROLL", "PAYROLL::1", None, "smithx", day, None, None, "x")], QUEUE))
    people = [(f"cp_{i}", "Ann", last, day, None, None) for i, last in enumerate(("Smith", "Garc\u00eda", "Lopez", "Wenhtims"))]
    pairs = residual.candidate_pairs(s, residual.canonical_identities(spark.createDataFrame(people, PEOPLE)))
    assert sorted(r["c_last"] for r in pairs.collect()) == ["smith", "wenhtims"]
    assert [r["canonical_person_id"] for r in residual.ranked(residual.scored(pairs)).collect()] == ["cp_0"]
