import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from kinroster.__main__ import main
from kinroster.config import DEFAULT, EngineConfig, settings
from kinroster.operators import checks, gates, metrics, privacy, staging, workforce
from kinroster.plans import build
from kinroster.plans.engine import Engine
from kinroster.plans.tables import Table
from kinroster.sources import fixture, raw

SF = "/root/testdata/sf0.001"
Q1 = metrics.Filters(dt.date(1998, 1, 1), dt.date(1998, 3, 31), None, None, "FTE", 5000)


#: The derived accounts have links to users that are not there.
DANGLING = "stg_erp.linked_dms_user_id.relationship"


def lenient(cfg):
    return gates.softened(gates.rules_of(cfg), DANGLING)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture(scope="module")
def sources(spark, tmp_path_factory):
    where = str(tmp_path_factory.mktemp("spells"))
    return fixture.sources(spark, SF, lambda name, df: (df.write.parquet(f"{where}/{name}"), spark.read.parquet(f"{where}/{name}"))[1])


@pytest.fixture(scope="module")
def built(spark, sources, tmp_path_factory):
    """A build up to the middle of a month."""
    path = str(tmp_path_factory.mktemp("built"))
    engine = Engine(spark, sources, EngineConfig(dt.date(1998, 5, 20), run_id="run-1"))
    return path, engine, build.run(engine, path, rules=lenient(engine.cfg))


def test_models_can_be_selected():
    assert build.selected("canonical_person+") == ["canonical_person", "dim_employee", "workforce_daily"]
    assert build.selected("+payroll_spells stg_ats") == ["stg_ats", "stg_payroll", "payroll_spells"]
    assert build.selected("+suppression_summary+") == ["stg_hris", "hris_persons", "headcount_daily", "attrition_monthly", "suppression_summary"]
    assert build.selected() == list(build.PARENTS) and all(list(build.PARENTS).index(p) < list(build.PARENTS).index(m) for m, ps in build.PARENTS.items() for p in ps)
    with pytest.raises(ValueError, match="no model"):
        build.selected("salaries+")


def test_a_build_checks_every_model(built):
    _, _, results = built
    assert [r.model for r in results] == list(build.PARENTS) and {n for r in results for n in r.broken} == {DANGLING}
    assert {r.state for r in results if r.model in build.VIEWS} == {"checked"} and {r.state for r in results if r.model not in build.VIEWS} == {"built"}
    assert sum(len(r.checks) for r in results) == len(gates.RULES) == len({r.name for r in gates.RULES})


def test_a_broken_table_stops_what_reads_it(spark, sources, built, tmp_path):
    """Children keep their old tables; other branches are built."""
    path = str(tmp_path / "b")
    with pytest.raises(build.BuildFailed, match=DANGLING):
        build.run(Engine(spark, sources), str(tmp_path / "strict"), "+dms_erp_unified")
    build.run(Engine(spark, sources), path, "+canonical_person headcount_daily", rules=lenient(DEFAULT))
    old = rows(Table(spark, f"{path}/canonical_person").read().select("canonical_person_id"))
    twice = sources | {"dms_users": sources["dms_users"].union(sources["dms_users"].limit(3))}
    with pytest.raises(build.BuildFailed, match="dms_user_id.unique") as failed:
        build.run(Engine(spark, twice), path, rules=lenient(DEFAULT))
    state = {r.model: r.state for r in failed.value.results}
    assert {m for m, s in state.items() if s == "failed"} == {"stg_dms"}
    assert {m for m, s in state.items() if s == "skipped"} == build.descendants("stg_dms") >= {"canonical_person", "dim_employee"}
    assert state["headcount_daily"] == state["payroll_spells"] == "built"
    assert rows(Table(spark, f"{path}/canonical_person").read().select("canonical_person_id")) == old
    warned = [gates.Rule("none", "stg_hris", broken="true", severity="warn"), gates.Rule("all", "stg_hris", broken="false")]
    [result] = build.run(Engine(spark, sources), str(tmp_path / "w"), "stg_hris", rules=warned)
    assert result.state == "checked" and result.broken.keys() == {"none"} and result.checks["all"] == 0


def test_rules_count_like_their_frames(spark):
    """Each form of a rule, with broken rows."""
    tables = {
        "a": spark.createDataFrame([(1, "x", 2), (1, "y", None), (2, None, 5), (None, "x", 7), (None, "x", 1)], "k int, v string, n int"),
        "b": spark.createDataFrame([(1, 3), (9, 4)], "id int, m int"),
    }
    rules = [
        gates.Rule("not_null", "a", broken="v IS NULL"), gates.Rule("accepted", "a", broken="v NOT IN ('x')"), gates.Rule("range", "a", broken="n < 2"), gates.Rule("one key", "a", key=("k",)),
        gates.Rule("two keys", "a", key=("k", "v")), gates.Rule("link", "a", link=("k", "b", "id")), gates.Rule("equal", "a", sides=(("a", "count(k)"), ("b", "max(m) - 1"))), gates.Rule("unequal", "a", sides=(("a", "sum(n)"), ("b", "sum(m)"))),
        gates.Rule("frame", "b", rows=lambda get: get("b").filter("m > 3")), gates.Rule("three sides", "b", sides=(("a", "1"), ("b", "1"), ("a", "2"))),
    ]
    found = {r["check_name"]: r["violations"] for r in gates.counts(tables.get, rules).collect()}
    assert found == {"not_null": 1, "accepted": 1, "range": 1, "one key": 1, "two keys": 1, "link": 1, "equal": 0, "unequal": 1, "frame": 1, "three sides": 1}
    empty = {n: df.limit(0) for n, df in tables.items()}
    assert {r["check_name"]: r["violations"] for r in gates.counts(empty.get, [r for r in rules if not r.sides]).collect()} == dict.fromkeys(["not_null", "accepted", "range", "one key", "two keys", "link", "frame"], 0)


def test_row_rules_take_one_scan(spark, sources):
    """All row rules and balances of a table are one aggregation over it, each key is one more."""
    where = "stg_payroll"
    engine = Engine(spark, sources)
    scans = []
    gates.counts(lambda m: scans.append(m) or getattr(engine, m), gates.of_models(gates.STAGED, [where]))
    assert scans == [where] * 2  # one key, one aggregation
    plan = gates.counts(lambda m: getattr(engine, m), [r for r in gates.of_models(gates.STAGED, [where]) if r.broken])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [l_orderkey") <= 1 and plan.count("count_if") + plan.count("count(") >= 1


def test_one_more_day_rewrites_its_month_only(spark, sources, built, tmp_path):
    path, _, _ = built
    units = lambda m: set(build.table_of(spark, path, m).units())
    before = {m: units(m) for m in build.MONTHLY}
    later = Engine(spark, sources, EngineConfig(dt.date(1998, 5, 21), run_id="run-1"))
    results = build.run(later, path, " ".join(build.MONTHLY), incremental=True)
    assert {r.since for r in results} == {dt.date(1998, 5, 1)}
    for model in build.MONTHLY:
        gone, new = before[model] - units(model), units(model) - before[model]
        assert {p for _, p in gone} == {p for _, p in new} == {"month=1998-05-01"}, model
    whole = Engine(spark, sources, later.cfg)
    for model, (_, make) in build.MONTHLY.items():
        other = make(whole, None)
        assert rows(build.table_of(spark, path, model).read().select(*other.columns)) == rows(other), model
    # Over the turn of a month, and back to a whole build.
    june = Engine(spark, sources, EngineConfig(dt.date(1998, 6, 2), run_id="run-1"))
    build.run(june, path, "headcount_daily", incremental=True)
    assert rows(build.table_of(spark, path, "headcount_daily").read().select("snapshot_date", "cohort_size_bucket")) == rows(Engine(spark, sources, june.cfg).headcount_daily.select("snapshot_date", "cohort_size_bucket"))
    [early] = build.run(Engine(spark, sources, EngineConfig(dt.date(1998, 5, 20), run_id="run-1")), path, "headcount_daily", incremental=True)
    assert early.since is None and build.table_of(spark, path, "headcount_daily").read().agg(F.max("snapshot_date")).first()[0] == dt.date(1998, 5, 20)


def test_marts_since_a_day_are_the_marts_from_then_on(spark, sources):
    engine, day = Engine(spark, sources), dt.date(1997, 3, 1)
    for make, column in ((lambda s: privacy.headcount_from_spells(engine.cohort_spells, engine.cfg.as_of, 5, s), "snapshot_date"), (lambda s: privacy.attrition_from_spells(engine.cohort_spells, engine.cfg.as_of, 5, s), "month_start_date"), (lambda s: workforce.workforce_daily(engine.dim_employee, dt.date(1997, 6, 1), s), "snapshot_date")):
        assert rows(make(day)) == rows(make(None).filter(F.col(column) >= F.lit(day)))


def test_filters_reach_the_folders_of_months(spark, built):
    path, engine, _ = built
    by_frame = metrics.metric_query(build.table_of(spark, path, "headcount_daily").read(), "headcount", Q1)
    plan = by_frame._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(month" in plan and "month#" in plan.split("PartitionFilters")[1]
    assert rows(by_frame) == rows(metrics.metric_query(engine.headcount_daily, "headcount", Q1)) != []
    names = build.publish(spark, path, "people_test")
    assert set(names) == {f"people_test.{m}" for m in build.PARENTS if m not in build.VIEWS}
    by_name = metrics.statement("headcount", Q1, "people_test", "headcount_daily").run(spark)
    plan = by_name._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(month" in plan
    assert rows(by_name) == rows(by_frame) and [r["snapshot_date"] for r in by_name.collect()] == sorted(r["snapshot_date"] for r in by_frame.collect())
    assert spark.table("people_test.privacy_audit_log").count() == 0
    found = checks.catalog_columns(spark, "people_test")
    denied = {r["table_name"] for r in found.filter("is_denied").collect()}
    assert denied.isdisjoint(build.PUBLIC) and "dim_employee" in denied
    spark.sql("CREATE VIEW people_test.planted AS SELECT SIN_Last_4 FROM VALUES ('1') AS v(SIN_Last_4)")
    assert rows(checks.catalog_columns(spark, "people_test").filter("is_denied AND table_name = 'planted'")) == [("planted", "SIN_Last_4", True)]
    build.unpublish(spark, "people_test")
    assert not spark.catalog.databaseExists("people_test") and build.table_of(spark, path, "headcount_daily").read().count()


def test_values_are_bound_and_names_are_guarded(spark, built):
    path, _, _ = built
    build.publish(spark, path, "bound_test", ("headcount_daily", "suppression_summary"))
    evil = "x' OR '1' = '1"
    st = metrics.statement("headcount", metrics.Filters(department=evil, limit=10**9), "bound_test", "headcount_daily")
    assert evil not in st.sql and st.args["department"] == evil and st.args["most"] == metrics.MOST_ROWS
    assert st.run(spark).count() == 0
    with_text = spark.createDataFrame([(evil,)], "department string").crossJoin(spark.table("bound_test.headcount_daily").limit(1).drop("department"))
    with_text.createOrReplaceTempView("evil_rows")
    assert spark.sql("SELECT department FROM evil_rows WHERE department = :department", args={"department": evil}).first()[0] == evil
    for name in ("a.b", "x; DROP TABLE y", "", "1a", "a-b", None):
        with pytest.raises((ValueError, TypeError)):
            metrics.table_name("bound_test", name)
    with pytest.raises(ValueError):
        metrics.statement("headcount", Q1, "bad name")
    assert metrics.fetch(metrics.statement("suppression", metrics.Filters(privacy_surface="workforce_headcount_daily"), "bound_test", "suppression_summary", by_month=False).run(spark))[0]["date_grain"] == "daily"
    build.unpublish(spark, "bound_test")


def test_settings(spark, sources, tmp_path):
    assert settings({}) == type(settings({}))("people_analytics", DEFAULT)
    file = tmp_path / "s.toml"
    file.write_text('k = 7\nas_of = "1998-05-20"\ndatabase = "from_file"\n')
    known = settings({"KINROSTER_K": "9", "KINROSTER_DATABASE": ""}, str(file))
    assert (known.engine.k, known.engine.as_of, known.database) == (9, dt.date(1998, 5, 20), "from_file")
    assert settings({"KINROSTER_CONFIG": str(file)}).engine.k == 7
    file.write_text("salt = 1")
    with pytest.raises(ValueError, match="salt"):
        settings({}, str(file))
    with pytest.raises(ValueError):
        settings({"KINROSTER_K": "many"})
    shown = Engine(spark, sources, known.engine).headcount_daily
    assert {r[0] for r in shown.select("k_anonymity_threshold").distinct().collect()} == {9} and shown.filter("headcount < 9").count() == 0


def test_the_audit_log_is_kept_by_builds(spark, sources, built):
    path, engine, _ = built
    log = f"{path}/{build.LOG}"
    event = privacy.audit_event(spark, engine.cfg, "ann", "workforce_headcount_daily", "why", "{}", 3, 1, "e-1")
    privacy.append_audit(event, log)
    privacy.append_audit(event, log)
    build.run(engine, path, build.LOG)
    assert [(r["audit_event_id"], r["actor"]) for r in privacy.audit_log(spark, log).collect()] == [("e-1", "ann")]
    privacy.append_audit(event.withColumns({"audit_event_id": F.lit("e-2"), "ticket": F.lit("T1")}), log)
    assert rows(privacy.audit_log(spark, log).select("audit_event_id", "ticket")) == [("e-1", None), ("e-2", "T1")]
    privacy.append_audit(event.withColumn("audit_event_id", F.lit("e-3")), log)  # writers of before know nothing of the column
    assert rows(privacy.audit_log(spark, log).select("audit_event_id", "ticket")) == [("e-1", None), ("e-2", "T1"), ("e-3", None)]


def test_bulk_load_with_rejects(spark, tmp_path):
    files, folder = tmp_path / "files", str(tmp_path / "raw")
    files.mkdir()
    head = ",".join(c for c, _ in raw.declared("dms_users"))
    good = ["D1,Ann,Lee,alee,L1,C1,2020-01-02,,2024-01-01 06:00:00", "D2,Bo,,,,,,,"]
    bad = ["D3,Cy,Lee,x,L1,C1,someday,2020-13-01,2024-01-01 06:00:00", "D4,too,few", "D5,Di,Lee,x,L1,C1,2020-01-02,,2024-01-01 06:00:00,too,many"]
    (files / "dms_users.csv").write_text("\n".join([head, *good, *bad]) + "\n")
    assert raw.bulk_load(spark, str(files), folder, ("dms_users",)) == {"dms_users": (2, 3)}
    table = Table(spark, f"{folder}/dms_users.parquet")
    assert rows(table.read().select("dms_user_id", "hire_date_dms")) == [("D1", dt.date(2020, 1, 2)), ("D2", None)]
    assert table.read().schema["loaded_at"].dataType.simpleString() == "timestamp_ntz" and table.note() == {"rejected": 3}
    rejected = Table(spark, f"{folder}/rejects/dms_users").read()
    assert rows(rejected.select("reason", F.array_join("columns", ","))) == [(raw.MALFORMED, ""), (raw.MALFORMED, "terminated_date_dms"), (raw.BAD_TYPE, "hire_date_dms,terminated_date_dms")] or rejected.count() == 3
    assert json.loads(rejected.filter(F.col("reason") == raw.BAD_TYPE).first()["row"])["hire_date_dms"] == "someday"
    (files / "dms_users.csv").write_text("\n".join([head, *bad, good[0]]) + "\n")
    with pytest.raises(raw.TooManyRejects):
        raw.bulk_load(spark, str(files), folder, ("dms_users",), most_rejected=0.5)
    assert table.read().count() == 2
    (files / "dms_users.csv").write_text(head.replace("last_name", "surname") + "\n")
    with pytest.raises(ValueError, match="last_name"):
        raw.bulk_load(spark, str(files), folder, ("dms_users",))
    assert table.read().count() == 2


def test_commands(spark, sources, tmp_path, capsys, monkeypatch):
    for name, df in sources.items():
        raw.shaped(df, name).coalesce(1).write.option("header", True).csv(str(tmp_path / "csv" / f"{name}.csv"))
    given, out = ["--raw", str(tmp_path / "raw")], ["--out", str(tmp_path / "out")]
    assert main(["load", *given, "--files", str(tmp_path / "csv")], spark) == 0
    assert "payroll_records" in capsys.readouterr().out
    monkeypatch.setenv("KINROSTER_DATABASE", "command_test")
    monkeypatch.setenv("KINROSTER_K", "3")
    assert main(["build", *given, *out, "--select", "+headcount_daily", "--as-of", "1998-05-20", "--publish"], spark) == 0
    assert "headcount_daily: built" in capsys.readouterr().out
    assert spark.table("command_test.headcount_daily").agg(F.max("snapshot_date"), F.max("k_anonymity_threshold")).first() == (dt.date(1998, 5, 20), 3)
    build.unpublish(spark, "command_test")
    assert main(["test", *given, *out, "--select", "+headcount_daily", "--as-of", "1998-05-20"], spark) == 0
    assert main(["test", *given, *out, "--select", "headcount_daily", "--as-of", "1998-05-20"], spark) == 0
    monkeypatch.setenv("KINROSTER_K", "5")  # what was built shows cells of 3 and 4
    assert main(["test", *given, *out, "--select", "headcount_daily", "--as-of", "1998-05-20"], spark) == 1
    assert "check_headcount_small_suppressed" in capsys.readouterr().out
    assert main(["residual-report", *given, "--limit", "100", "--top-candidates", "2"], spark) == 0
    assert capsys.readouterr().out.startswith("# Residual review")
    assert main(["residual-candidates", *given, "--limit", "100"], spark) == 0
    lines = capsys.readouterr().out.splitlines()
    assert lines and all("source_record_key" in json.loads(x) for x in lines)
    with pytest.raises(SystemExit):
        main(["build", *given], spark)
    assert staging.STAGING.keys() == raw.SCHEMAS.keys()
