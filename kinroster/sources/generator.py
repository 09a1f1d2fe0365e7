"""Synthetic staff histories: the six raw tables of a company, with the drift that real systems have.

Everything is derived from ``spark.range`` and hashes of (person, seed, purpose), so any number of
people is made in parallel, and the same arguments give the same rows.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import FOLDED, PLAIN
from .nicknames import NICKNAMES
from .raw import shaped

FIRST = ("Robert", "Elizabeth", "William", "Margaret", "Rajesh", "Jennifer", "Édouard", "María", "Łukasz", "Anaïs", "Thomas", "Nicole", "Joseph", "Susan", "Michael", "Patricia", "François", "Jaspreet", "José", "Chloé", "Ingrid", "Hugo")
#: Last names are put together: start, middle, end.
LAST = (
    ("Al", "Ber", "Car", "Dan", "El", "Fer", "Gar", "Hol", "Iv", "Jan", "Kov", "Lind", "Mor", "Nú", "Ol", "Pet", "Ri", "Sol", "Tre", "Wa"),
    ("a", "ber", "chi", "de", "en", "fi", "gre", "in", "ker", "lo", "man", "ni", "or", "par", "qui", "ro", "sa", "tel", "ñe", "va"),
    ("", "son", "sen", "ez", "ić", "ton", "-Ray", "er"),
)
DEPARTMENTS = ("Sales", "Support", "Marketing", "Engineering", "Finance", "Legal", "Operations", "People", "Product", "Service", "Parts")
#: Departments whose people have an account in the sales system.
SELLING = DEPARTMENTS[:3]
LOCATIONS = ("Toronto", "Montréal", "Vancouver", "Calgary", "Halifax", "Ottawa", "Remote")
#: FTE, contractor and part-time, 4 : 1 : 1.
TYPES = ("FTE", "FTE", "FTE", "FTE", "CONTRACTOR", "PART_TIME")
DOMAIN = "northwind.example"
#: Shares: people who leave, leavers who come back, people who change their last name, new names that keep the old one,
#: contractors who become employees, those of them with a new id, accounts without their link.
LEAVE, RETURN, RENAME, HYPHEN, CONVERT, NEW_ID, UNLINKED = 0.15, 0.30, 0.05, 0.30, 0.40, 0.70, 0.10


def generate(spark: SparkSession, people: int = 1500, years: int = 5, seed: int = 42, today: dt.date = dt.date(2026, 5, 5)) -> dict[str, DataFrame]:
    """The raw tables. Histories begin at most ``years`` before ``today``, the day of the extracts."""
    u = lambda tag, *by: F.pmod(F.xxhash64("id", F.lit(seed), F.lit(tag), *by), F.lit(1 << 30)) / float(1 << 30)
    between = lambda tag, low, high: (F.lit(low) + u(tag) * (F.lit(high) - F.lit(low) + 1)).cast("int")
    pick = lambda tag, values: F.element_at(F.array(*[F.lit(v) for v in values]), (u(tag) * len(values)).cast("int") + 1)
    end, window = F.lit(today), years * 365
    short = F.create_map(*[F.lit(x) for pair in {long: nick for nick, long in reversed(NICKNAMES.items())}.items() for x in pair])
    person = spark.range(1, people + 1).select(
        "id", pick("first", FIRST).alias("first"), F.concat(*[pick(f"last{i}", part) for i, part in enumerate(LAST)]).alias("last"), F.concat(*[pick(f"new{i}", part) for i, part in enumerate(LAST)]).alias("other"),
        F.date_sub(end, between("age", 22 * 365, 64 * 365)).alias("born"), F.date_sub(end, between("hired", 1, window)).alias("hired"), pick("department", DEPARTMENTS).alias("department"),
        pick("location", LOCATIONS).alias("location"), pick("type", TYPES).alias("type"), (u("rename") < RENAME).alias("renamed"),
    )
    person = person.withColumn("nick", F.when(u("nick") < 0.6, F.element_at(short, F.lower("first")))).withColumn("preferred", F.coalesce(F.initcap("nick"), "first"))
    # A spell ends 180 days after its start or later, and the next begins 90 days after that or later.
    left = F.when(u("leave") < LEAVE, F.date_add("hired", between("left", 180, window))).alias("left")
    person = person.select("*", left).withColumn("left", F.when(F.col("left") <= end, F.col("left")))
    back = F.when(F.col("left").isNotNull() & (u("return") < RETURN), F.date_add("left", between("back", 90, 500)))
    converted = F.when((F.col("type") == "CONTRACTOR") & F.col("left").isNull() & (u("convert") < CONVERT) & (u("id") < NEW_ID), F.date_add("hired", between("converted", 120, 700)))
    person = person.withColumns({"back": back, "converted": converted}).withColumns({n: F.when(F.col(n) <= end, F.col(n)) for n in ("back", "converted")})
    spell = lambda suffix, kind, hired, ended, again: F.struct(F.lit(suffix).alias("suffix"), kind.alias("kind"), hired.alias("hired"), ended.alias("ended"), F.lit(again).alias("again"))
    c, never = F.col, F.lit(None).cast("date")
    spells = F.array_compact(F.array(
        spell("", c("type"), c("hired"), F.coalesce("left", "converted"), False),
        F.when(c("back").isNotNull(), spell("_R1", c("type"), c("back"), never, True)),
        F.when(c("converted").isNotNull(), spell("_FTE", F.lit("FTE"), c("converted"), never, False)),
    ))
    person = person.withColumn("s", F.explode(spells)).select(*[n for n in person.columns if n not in ("hired", "type", "left", "back", "converted")], "s.*")
    changed = F.when(c("renamed") & (u("hyphen") < HYPHEN), F.concat_ws("-", "last", "other")).when(c("renamed"), c("other")).otherwise(c("last"))
    number = F.lpad(c("id").cast("string"), 6, "0")
    now = F.lit(dt.datetime.combine(today, dt.time(6))).cast("timestamp_ntz")
    ascii_ = lambda x: F.regexp_replace(F.lower(F.translate(x, FOLDED, PLAIN)), "[^a-z.]", "")
    dotted = lambda a, b: F.concat_ws(".", a, b)
    legal = F.when(c("suffix") == "", c("last")).otherwise(changed)
    base = person.withColumns({"legal": legal, "number": number, "tail": F.when(c("again"), "_2").otherwise(""), "loaded_at": now, "active": c("ended").isNull()})
    once = base.filter("suffix != '_FTE'")  # a new id is no new application, account or payroll
    at_noon = lambda day: day.cast("timestamp_ntz")
    hris = base.select(
        F.concat(F.lit("HR_"), "number", "suffix").alias("hris_employee_id"), c("first").alias("legal_first_name"), c("legal").alias("legal_last_name"), F.initcap("nick").alias("preferred_name"), c("born").alias("date_of_birth"),
        F.concat(ascii_(dotted(c("preferred"), c("last"))), "id", F.lit("@gmail.com")).alias("personal_email"), F.concat(ascii_(dotted(c("first"), c("last"))), "id", F.lit(f"@{DOMAIN}")).alias("work_email"),
        c("hired").alias("hire_date"), c("ended").alias("termination_date"), F.when(c("active"), "ACTIVE").otherwise("TERMINATED").alias("employment_status"), c("kind").alias("employment_type"), "department",
        F.concat(F.when(c("suffix") == "", "Associate").otherwise("Senior"), F.lit(", "), "department").alias("job_title"), F.concat(F.lit("HR_"), F.lpad((u("boss") * people / 20 + 1).cast("int").cast("string"), 6, "0")).alias("manager_hris_id"),
        "location", "loaded_at",
    )
    ats = once.select(
        F.concat(F.lit("ats_"), "id", "tail").alias("ats_candidate_id"), c("preferred").alias("preferred_first_name"), c("last").alias("last_name"),
        F.concat(F.when(u("old mail") < 0.04, "old.").otherwise(""), ascii_(dotted(c("preferred"), c("last"))), "id", F.lit("@gmail.com")).alias("email"), F.concat(F.lit("555-"), between("phone", 1000, 9999)).alias("phone"),
        F.date_sub("hired", between("applied", 20, 90)).alias("application_date"), F.date_sub("hired", between("offer", 5, 25)).alias("offer_accepted_date"),
        pick("from", ("LinkedIn", "Referral", "Career Site", "Indeed", "Recruiter")).alias("sourced_from"), c("department").alias("requisition_department"), F.lit("Associate").alias("requisition_job_title"), "loaded_at",
    )
    months = F.sequence(F.trunc("hired", "MM"), F.trunc(F.coalesce("ended", end), "MM"), F.expr("INTERVAL 1 MONTH"))
    paid = once.withColumn("month", F.explode(months))
    payroll = paid.select(
        F.concat(F.lit("PAY-"), "number", "tail", F.lit("_"), F.date_format("month", "yyyyMM")).alias("payroll_record_id"), F.concat(F.lit("PAY"), F.date_format("hired", "yyyyMM"), F.lit("-"), "id").alias("employee_payroll_id"),
        c("first").alias("legal_first_name"), c("legal").alias("legal_last_name"), F.lpad((u("sin", c("month")) * 10000).cast("int").cast("string"), 4, "0").alias("sin_last_4"), F.greatest("month", "hired").alias("pay_period_start"),
        F.last_day("month").alias("pay_period_end"), (3000 + u("pay", c("month")) * 5000).cast("decimal(12,2)").alias("gross_amount_cad"), F.lit(160).cast("decimal(8,2)").alias("hours_worked"), c("kind").alias("job_code"),
        c("department").alias("cost_center"), "loaded_at",
    )
    # The sales, dealer and resource systems keep accents in addresses, and their own hire dates.
    raw_mail = lambda a: F.concat(F.lower(dotted(a, c("last"))), "id", F.lit(f"@{DOMAIN}"))
    crm = once.filter(c("department").isin(*SELLING)).select(
        F.concat(F.lit("crm_user_"), "id", "tail").alias("crm_user_id"), c("preferred").alias("preferred_first_name"), c("last").alias("last_name"), F.concat_ws(" ", "preferred", "last").alias("display_name"), raw_mail(c("first")).alias("crm_email"),
        c("location").alias("location_id"), F.when(c("department") == "Sales", "SALES_REP").when(c("department") == "Support", "SUPPORT_AGENT").otherwise("MARKETING").alias("role"), "active",
        at_noon(F.date_add("hired", between("crm", 0, 9))).alias("created_at"), at_noon(c("ended")).alias("deactivated_at"), "loaded_at",
    )
    drift, dms_id = F.date_add("hired", between("dms", -2, 3)), F.concat(F.lit("DMS"), F.lpad(c("id").cast("string"), 5, "0"), c("tail"))
    dms = once.select(
        dms_id.alias("dms_user_id"), F.substring("preferred", 1, 5).alias("short_first_name"), c("last").alias("last_name"), F.lower(F.concat(F.substring("first", 1, 1), "last")).alias("dms_username"), c("location").alias("location_code"),
        c("department").alias("department_code"), drift.alias("hire_date_dms"), c("ended").alias("terminated_date_dms"), "loaded_at",
    )
    erp = once.select(
        F.concat(F.lit("erp."), "id", "tail").alias("erp_user_id"), F.when(u("link", c("tail")) >= UNLINKED, dms_id).alias("linked_dms_user_id"), F.substring("preferred", 1, 5).alias("short_first_name"), c("last").alias("last_name"),
        raw_mail(c("first")).alias("erp_email"), F.concat(F.lit("R"), between("role", 1, 9)).alias("role_code"), F.concat(F.lit("G"), between("group", 1, 4)).alias("permissions_group"), at_noon(drift).alias("created_at"),
        F.when(c("active"), now).otherwise(at_noon(c("ended"))).alias("last_login_at"), "loaded_at",
    )
    made = {"hris_employees": hris, "ats_candidates": ats, "payroll_records": payroll, "crm_sales_reps": crm, "dms_users": dms, "erp_users": erp}
    return {name: shaped(df, name) for name, df in made.items()}
