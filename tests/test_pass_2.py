import datetime as dt
import random

from pyspark.sql import functions as F

from kinroster.operators import identity
from kinroster.plans import queries
from kinroster.plans.engine import Engine

SPELL = "h_key string, h_dob date, h_hired date, legal_root string, preferred_root string, h_last string, h_first_name string, h_last_name string, h_domain string, h_token string"
NODE = ", ".join(f"{c} {k}" for c, k in identity.NODE.items())


def day(i):
    return dt.date(2020, 1, 1) + dt.timedelta(days=i)


def tables(spark, repeated):
    """Two names, persons with many near spells of one or both roots, births known to some sources, keys of several sources."""
    rng = random.Random(7)
    spells = [(f"p{k:02d}", day(-9000 - k) if k % 5 else None, None if i == 8 else day(rng.randrange(140)), rng.choice(["rob", "liz", ""]), rng.choice(["rob", "liz", None]), rng.choice(["smith", "smith", "", None]), f"F{k}", f"L{k}", None, None) for k in range(24) for i in range(9)]
    spells += [("twin", day(0), d, "rob", "rob", "smith", "T", "W", None, None) for d in (day(20), day(20), day(30), day(40))]
    spells += [("only", day(1), d, "ana", "ana", "lopez", "A", "L", None, None) for d in (day(20), day(80))]
    nodes = []
    for i in range(120):
        given = dict.fromkeys(identity.NODE) | {"source_system": rng.choice(["ATS", "PAYROLL"]), "source_record_key": f"k{i // 2 if repeated and i < 30 else i}", "source_first_name_root": rng.choice(["rob", "liz", ""]), "source_last_name_norm": rng.choice(["smith", "smith", ""])}
        given |= {"source_hire_date": None if i % 40 == 0 else day(30 if i % 17 == 0 else rng.randrange(-20, 170)), "date_of_birth": day(-9000 - rng.randrange(24)) if i % 3 else None, "merge_topology": rng.choice([None, "DMS_AND_ERP"])}
        nodes.append(tuple(given.values()))
    rare = dict.fromkeys(identity.NODE) | {"source_system": "ATS", "source_first_name_root": "ana", "source_last_name_norm": "lopez"}
    nodes += [tuple((rare | {"source_record_key": f"r{i}", "source_hire_date": day(10 * i), "date_of_birth": day(i % 2)}).values()) for i in range(12)]
    if repeated:
        nodes += [nodes[40], nodes[41]]
    first = spark.createDataFrame([("k50", True), ("k51", False)], "source_record_key string, auto_merge_qualified boolean")
    return spark.createDataFrame(nodes, NODE), spark.createDataFrame(spells, SPELL), first


def plain(nodes, spells, first):
    """All pairs of pass 2, the persons counted over them."""
    sources = identity._sources_2(nodes, first)
    return identity._rated_2(identity.near_hires(sources, identity._rooted(spells), identity.NAMED))


def same(one, other):
    assert one.columns == other.columns and one.count() > 20
    assert one.exceptAll(other).count() == 0 and other.exceptAll(one).count() == 0


def test_pass_2_and_its_best_rows_are_those_of_all_pairs(spark):
    for repeated in (False, True):
        made = [spark.createDataFrame(t.collect(), t.schema) for t in tables(spark, repeated)]
        every = plain(*made)
        assert every.filter("dob_match").count() > 5 and (repeated or every.filter("auto_merge_qualified").count() > 0)
        two = identity.pass_2(*made)
        same(two, every.select(*two.columns))
        best = ["source_record_key", "hris_person_key", "match_score", "match_anchor_count", "candidate_hris_person_count", "hire_date_diff_days", "hris_hire_date", "auto_merge_qualified"]
        same(identity.pass_2_best(*made).select(*best), identity.best_by_score(every.select(*identity.EVIDENCE)).select(*best))
        shown = lambda pairs: pairs.select("source_record_key", "hris_person_key", "hire_date_diff_days", "dob_match", "merge_topology")
        assert shown(every).count() > shown(every).distinct().count()
        same(identity.pass_2_once(*made, shown), shown(every).distinct())


def staff(spark, n):
    """``n`` persons of one name, hired in one month, and as many applicants, whom no address links."""
    stamp, hr, ats = dt.datetime(2020, 6, 1), [], []
    for i in range(n):
        hr.append((f"h{i}", "Robert", "Smith", None, dt.date(1950, 1, 1) + dt.timedelta(days=i), f"p{i}@x.y", f"w{i}@z.q", day(i % 28), None, "active", "fte", "D", "J", None, "L", stamp))
        ats.append((f"a{i}", "Bob", "Smith", f"other{i}@x.y", "1", day(i % 28 - 5), day(i % 28), "s", "D", "J", stamp))
    raw = {
        "hris_employees": (hr, "hris_employee_id string, legal_first_name string, legal_last_name string, preferred_name string, date_of_birth date, personal_email string, work_email string, hire_date date, termination_date date, employment_status string, employment_type string, department string, job_title string, manager_hris_id string, location string, loaded_at timestamp_ntz"),
        "ats_candidates": (ats, "ats_candidate_id string, preferred_first_name string, last_name string, email string, phone string, application_date date, offer_accepted_date date, sourced_from string, requisition_department string, requisition_job_title string, loaded_at timestamp_ntz"),
        "payroll_records": ([], "payroll_record_id string, employee_payroll_id string, legal_first_name string, legal_last_name string, sin_last_4 string, pay_period_start date, pay_period_end date, gross_amount_cad decimal(12,2), hours_worked decimal(8,2), job_code string, cost_center string, loaded_at timestamp_ntz"),
        "crm_sales_reps": ([], "crm_user_id string, preferred_first_name string, last_name string, display_name string, crm_email string, location_id string, role string, active boolean, created_at timestamp_ntz, deactivated_at timestamp_ntz, loaded_at timestamp_ntz"),
        "dms_users": ([], "dms_user_id string, short_first_name string, last_name string, dms_username string, location_code string, department_code string, hire_date_dms date, terminated_date_dms date, loaded_at timestamp_ntz"),
        "erp_users": ([], "erp_user_id string, linked_dms_user_id string, short_first_name string, last_name string, erp_email string, role_code string, permissions_group string, created_at timestamp_ntz, last_login_at timestamp_ntz, loaded_at timestamp_ntz"),
    }
    return {name: spark.createDataFrame(rows, schema) for name, (rows, schema) in raw.items()}


def test_no_model_holds_the_pairs_of_a_frequent_name(spark, tmp_path):
    n = 150
    e = Engine(spark, staff(spark, n), path=f"file://{tmp_path}/run")
    queue = e.stewardship_queue
    assert queue.filter(F.col("candidate_hris_person_count") == n).count() == n and e.canonical_person.count() == e.dim_employee.count() == n
    held = {p.name: spark.read.parquet(str(p)).count() for p in (tmp_path / "run").iterdir()}
    assert max(held.values()) <= 2 * n, held
    assert e.identity_pass_2.count() == n * n


def test_pairs_are_shown_without_a_shuffle_of_them(spark, tmp_path):
    e = Engine(spark, staff(spark, 40), path=f"file://{tmp_path}/run")
    pairs = queries._pair_confidence(e)
    assert pairs.count() == 1600 and pairs.distinct().count() == 1600
    for df in (pairs, e.identity_pass_2):
        plan = df._jdf.queryExecution().optimizedPlan().toString().split("\n")
        assert "Join Inner" in next(line for line in plan if "Project" not in line and "Filter" not in line), plan[:4]


def test_persons_of_repeated_keys_are_counted_without_their_pairs(spark):
    """Identities of one key share persons by name, by a second name of a person, and by near dates; each pair of them is told once, and no pair of a name is shuffled."""
    rng = random.Random(9)
    spells = [(f"p{k:03}", day(-9000 - k), day(rng.randrange(200)), rng.choice(["rob", "liz"]), rng.choice(["rob", "rob", "ann", None]), rng.choice(["smith", "smithray"]), f"F{k}", f"L{k}", None, None) for k in range(60) for _ in range(1 + k % 4)]
    nodes, given = [], dict.fromkeys(identity.NODE) | {"source_system": "DMS_ERP", "merge_topology": "DMS_AND_ERP"}
    for key in range(50):
        for _ in range(1 + key % 5 + (20 if key == 7 else 0)):
            nodes.append(given | {"source_record_key": None if key == 3 else f"k{key}", "source_first_name_root": rng.choice(["rob", "liz", "ann"]), "source_last_name_norm": rng.choice(["smith", "smithray"]), "source_hire_date": day(rng.randrange(220)), "merge_topology": rng.choice(["DMS_ONLY", "DMS_AND_ERP"]) if key % 9 == 4 else "DMS_AND_ERP"})
    first = spark.createDataFrame([], "source_record_key string, auto_merge_qualified boolean")
    made = [spark.createDataFrame([tuple(n.values()) for n in nodes], NODE), spark.createDataFrame(spells, SPELL), first]
    every = plain(*made)
    two = identity.pass_2(*made)
    same(two, every.select(*two.columns))
    shown = lambda pairs: pairs.select("source_record_key", "hris_person_key", "hire_date_diff_days", "dob_match", "merge_topology")
    once = identity.pass_2_once(*made, shown)
    assert shown(every).count() > shown(every).distinct().count() and once.count() == once.distinct().count()
    same(once, shown(every).distinct())
    best = ["source_record_key", "hris_person_key", "match_score", "candidate_hris_person_count", "hire_date_diff_days", "hris_hire_date"]
    same(identity.pass_2_best(*made).select(*best), identity.best_by_score(every.select(*identity.EVIDENCE)).select(*best))
    plan = two._jdf.queryExecution().optimizedPlan().toString().split("\n")
    assert "Join Inner" in next(line for line in plan if "Project" not in line and "Filter" not in line), plan[:4]
