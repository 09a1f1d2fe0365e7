"""Deterministic identity resolution: source nodes, three passes, canonical persons, stewardship queue."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.keys import surrogate_key
from ..functions.names import email_part, last_token, normalize_name, with_root

#: The common shape of source nodes.
NODE = {
    "source_system": "string", "source_record_key": "string", "source_primary_id": "string", "hris_person_key": "string", "source_first_name": "string", "source_last_name": "string",
    "source_first_name_original": "string", "source_last_name_original": "string", "source_first_name_root": "string", "source_last_name_norm": "string", "date_of_birth": "date",
    "source_hire_date": "date", "source_end_date": "date", "personal_email_local_part": "string", "personal_email_domain": "string", "work_email_local_part": "string",
    "work_email_domain": "string", "source_email_local_part": "string", "source_email_domain": "string", "ats_candidate_id": "string", "payroll_spell_key": "string",
    "employee_payroll_id": "string", "crm_user_id": "string", "dms_erp_person_key": "string", "dms_user_id": "string", "erp_user_id": "string", "merge_topology": "string",
    "has_dms": "boolean", "has_erp": "boolean", "has_broken_link": "boolean", "loaded_at": "timestamp_ntz",
}
DERIVED = ("source_first_name_root", "source_last_name_norm")
IDS = ("ats_candidate_id", "payroll_spell_key", "employee_payroll_id", "crm_user_id", "dms_erp_person_key", "dms_user_id", "erp_user_id")


def _nodes(df: DataFrame, system: str, record: str, key: str, first: str, last: str, hired: Column, ended: Column | None = None, original: tuple[str, str] | None = None, personal: tuple[Column, Column] | None = None, work: tuple[Column, Column] | None = None, own: dict[str, str] | None = None) -> DataFrame:
    """Rows of one system in the common shape, without what is derived from names; what is not given is null."""
    originals = original or (f"{first}_original", f"{last}_original")
    local, domain = work or personal or (None, None)
    known = {
        "source_system": F.lit(system), "source_record_key": F.concat(F.lit(f"{record}::"), key), "source_primary_id": F.col(key), "source_first_name": F.col(first), "source_last_name": F.col(last),
        "source_first_name_original": F.col(originals[0]), "source_last_name_original": F.col(originals[1]),
        "source_hire_date": hired, "source_end_date": ended, "source_email_local_part": local, "source_email_domain": domain, "loaded_at": F.col("loaded_at"),
    }
    known |= {f"{kind}_email_{part}": c for kind, pair in (("personal", personal), ("work", work)) if pair for part, c in zip(("local_part", "domain"), pair, strict=True)}
    known |= {to: F.col(c) for to, c in (own or {}).items()}
    return df.select(*[(F.lit(None) if known.get(n) is None else known[n]).cast(kind).alias(n) for n, kind in NODE.items() if n not in DERIVED])


def source_nodes(hris_persons: DataFrame, stg_ats: DataFrame, payroll_spells: DataFrame, stg_crm: DataFrame, dms_erp_unified: DataFrame, nicknames: DataFrame) -> DataFrame:
    """All systems' identities in one shape."""
    same = lambda *names: {n: n for n in names}
    mail = lambda local, address: (F.col(local), email_part(F.col(address), 2))
    name = "canonical_legal_first_name", "canonical_legal_last_name"
    branches = [
        _nodes(hris_persons, "HRIS", "HRIS_PERSON", "hris_person_key", *name, F.col("canonical_hire_date"), F.col("latest_termination_date"), personal=mail("personal_email_local_part", "personal_email"), work=mail("work_email_local_part", "work_email"), own=same("hris_person_key", "date_of_birth")),
        _nodes(stg_ats, "ATS", "ATS", "ats_candidate_id", "preferred_first_name", "last_name", F.col("offer_accepted_date"), personal=mail("email_local_part", "email"), own=same("ats_candidate_id")),
        _nodes(payroll_spells, "PAYROLL", "PAYROLL", "payroll_spell_key", "first_observed_legal_first_name", "first_observed_legal_last_name", F.col("first_pay_period_start"), F.col("most_recent_pay_period_end"), own=same("payroll_spell_key", "employee_payroll_id") | {"source_primary_id": "employee_payroll_id"}),
        _nodes(stg_crm, "CRM", "CRM", "crm_user_id", "preferred_first_name", "last_name", F.to_date("created_at"), F.to_date("deactivated_at"), work=mail("crm_email_local_part", "crm_email"), own=same("crm_user_id")),
        _nodes(dms_erp_unified, "DMS_ERP", "DMS_ERP", "dms_erp_person_key", "short_first_name", "last_name", F.coalesce("hire_date_dms", F.to_date("erp_created_at")), F.col("terminated_date_dms"), work=mail("erp_email_local_part", "erp_email"), own=same("dms_erp_person_key", "dms_user_id", "erp_user_id", "merge_topology", "has_dms", "has_erp", "has_broken_link")),
    ]
    nodes = with_root(reduce(DataFrame.unionByName, branches), F.col("source_first_name"), nicknames, "source_first_name_root")
    return nodes.withColumn("source_last_name_norm", normalize_name(F.col("source_last_name"))).select(*NODE)


def hris_spell_names(stg_hris: DataFrame, hris_persons: DataFrame, nicknames: DataFrame) -> DataFrame:
    """Spells of persons with what the passes compare."""
    keys = ["date_of_birth", "personal_email_local_part"]
    spells = stg_hris.join(hris_persons.select("hris_person_key", *keys), keys)
    spells = with_root(spells, F.col("legal_first_name"), nicknames, "legal_root")
    spells = with_root(spells, F.coalesce("preferred_name", "legal_first_name"), nicknames, "preferred_root")
    return spells.select(
        F.col("hris_person_key").alias("h_key"), F.col("date_of_birth").alias("h_dob"), F.col("hire_date").alias("h_hired"), "legal_root", "preferred_root",
        normalize_name(F.col("legal_last_name")).alias("h_last"), F.col("legal_first_name").alias("h_first_name"), F.col("legal_last_name").alias("h_last_name"),
        email_part(F.col("work_email"), 2).alias("h_domain"), last_token(F.col("work_email_local_part")).alias("h_token"),
    )


#: Days that hire dates may be apart, and so the width of the buckets that are joined on.
NEAR = 30


def _bucket(day: str) -> Column:
    return F.floor(F.datediff(day, F.lit("1970-01-01").cast("date")) / (NEAR + 1))


def near_hires(sources: DataFrame, spells: DataFrame, on: dict[str, str]) -> DataFrame:
    """Pairs with equal keys and hire dates at most ``NEAR`` days apart.

    A source lies in one bucket of dates, a spell is sent to its own and both neighbours, so a pair
    meets once, and a frequent name or domain is spread over time instead of meeting itself.
    """
    spread = spells.withColumn("_bucket", F.explode(F.transform(F.array(*[F.lit(i) for i in (-1, 0, 1)]), lambda i: _bucket("h_hired") + i)))
    equal = [F.col(a) == F.col(b) for a, b in on.items()]
    return sources.withColumn("_own", _bucket("source_hire_date")).join(spread, reduce(lambda a, b: a & b, [*equal, F.col("_own") == F.col("_bucket"), _off() <= NEAR])).drop("_own", "_bucket")


def _off(days_of: str = "h_hired") -> Column:
    return F.abs(F.datediff("source_hire_date", days_of))


def _candidates(pairs: DataFrame, number: int, rule: Column, hris: dict[str, str], extra: dict[str, Column] | None = None, off: Column | None = None) -> DataFrame:
    """The common columns of a pass, and how many persons each source could be (``_persons``, if the pairs have it)."""
    known = [F.col("_persons").alias("candidate_hris_person_count")] if "_persons" in pairs.columns else []
    out = pairs.select(
        "source_system", "source_record_key", "source_primary_id", *IDS, "merge_topology", F.col("h_key").alias("hris_person_key"), F.lit(number).alias("match_pass"), rule.alias("match_rule"),
        (F.lit(None).cast("int") if off is None else off).alias("hire_date_diff_days"), *[c.alias(n) for n, c in (extra or {}).items()],
        "source_first_name", "source_last_name", "source_first_name_root", "source_last_name_norm", "source_hire_date", "source_email_local_part", "source_email_domain",
        *[F.col(c).alias(f"hris_{n}") for n, c in hris.items()], "loaded_at", *known,
    )
    if known:
        return out
    persons = F.size(F.collect_set("hris_person_key").over(Window.partitionBy("source_record_key"))).cast("long")
    return out.withColumn("candidate_hris_person_count", persons)


def without_merged(nodes: DataFrame, *passes: DataFrame) -> DataFrame:
    for p in passes:
        nodes = nodes.join(p.filter("auto_merge_qualified").select("source_record_key").distinct(), "source_record_key", "left_anti")
    return nodes


def pass_1(nodes: DataFrame) -> DataFrame:
    """Equal e-mail addresses: the private one of an applicant, the work address of an account.

    The two conditions are joins of their own, since a join on either would compare all with all.
    """
    hris = nodes.filter("source_system = 'HRIS'").select(F.col("hris_person_key").alias("h_key"), F.col("personal_email_local_part").alias("p_local"), F.coalesce("personal_email_domain", F.lit("")).alias("p_domain"), F.col("work_email_local_part").alias("w_local"), F.coalesce("work_email_domain", F.lit("")).alias("w_domain"), F.col("source_first_name").alias("h_first_name"), F.col("source_last_name").alias("h_last_name"), F.col("source_first_name_root").alias("h_root"), F.col("source_last_name_norm").alias("h_last"), F.col("source_hire_date").alias("h_hired"))
    ats, accounts = nodes.filter("source_system = 'ATS'"), nodes.filter("source_system IN ('CRM', 'DMS_ERP')")
    by_person = ats.join(hris, (F.col("personal_email_local_part") == F.col("p_local")) & (F.coalesce("personal_email_domain", F.lit("")) == F.col("p_domain")))
    by_work = accounts.join(hris, (F.col("source_email_local_part") == F.col("w_local")) & (F.coalesce("source_email_domain", F.lit("")) == F.col("w_domain")))
    rule = F.when(F.col("source_system") == "ATS", "personal_email_exact").otherwise("work_email_local_part_exact")
    found = _candidates(by_person.unionByName(by_work), 1, rule, {"first_name": "h_first_name", "last_name": "h_last_name", "first_name_root": "h_root", "last_name_norm": "h_last", "hire_date": "h_hired"})
    return found.withColumns({"match_score": F.lit(1.0), "match_anchor_count": F.lit(2), "auto_merge_qualified": F.col("candidate_hris_person_count") == 1})


HRIS_NAMES = {"first_name": "h_first_name", "last_name": "h_last_name", "first_name_root": "legal_root", "last_name_norm": "h_last", "hire_date": "h_hired"}


def _sources_2(nodes: DataFrame, first: DataFrame) -> DataFrame:
    """What pass 2 looks for: identities with names and a hire date that pass 1 did not merge."""
    named = F.col("source_first_name_root").isNotNull() & F.col("source_last_name_norm").isNotNull() & F.col("source_hire_date").isNotNull()
    return without_merged(nodes.filter((F.col("source_system") != "HRIS") & named), first)


def _repeated(nodes: DataFrame) -> DataFrame | None:
    """Keys that several identities have; None without any."""
    keys = nodes.filter("source_system != 'HRIS'").groupBy("source_record_key").agg(F.count("*").alias("n")).filter("n > 1").select("source_record_key")
    return None if keys.isEmpty() else keys


def _apart(sources: DataFrame, repeated: DataFrame | None) -> tuple[DataFrame, DataFrame | None]:
    """Sources that are alone with their key, and the others."""
    if repeated is None:
        return sources, None
    own = F.col("source_record_key").eqNullSafe(F.col("_key"))
    keys = repeated.select(F.col("source_record_key").alias("_key"))
    return sources.join(keys, own, "left_anti"), sources.join(keys, own, "left_semi")


def _rooted(spells: DataFrame) -> DataFrame:
    """Either root of a spell may be meant; the two are rows of their own, so that the root is a key of the join."""
    return spells.withColumn("h_root", F.explode(F.array_distinct(F.array("legal_root", "preferred_root"))))


NAMED = {"source_last_name_norm": "h_last", "source_first_name_root": "h_root"}


def name_days(sources: DataFrame, spells: DataFrame) -> DataFrame:
    """For each name and hire date of ``sources``: ``_persons`` hired at most ``NEAR`` days apart, and ``_best`` of them.

    Candidates of pass 2 depend on nothing else of a source, and their number grows with the square of a
    name's frequency; so days meet days here, not sources spells. A spell counts its person from the
    first day on that an earlier spell of the person does not reach (``since``, in days from the hire),
    so a person counts once. The best has the same date, or one at most 7 days off, or else the least key.
    """
    earlier = F.lag("h_hired").over(Window.partitionBy("h_last", "h_root", "h_key").orderBy("h_hired"))
    named = _rooted(spells).filter("h_last IS NOT NULL AND h_root IS NOT NULL AND h_hired IS NOT NULL")
    since = named.withColumn("since", F.greatest(F.lit(-NEAR), F.datediff(earlier, "h_hired") + NEAR + 1))
    person = F.struct("h_key", "h_first_name", "h_last_name")
    counts = since.groupBy("h_last", "h_root", "h_hired", "since").agg(F.count("*").alias("n"), F.min(person).alias("person"))
    days = counts.groupBy("h_last", "h_root", "h_hired").agg(F.collect_list(F.struct("since", "n")).alias("starts"), F.min("person").alias("person"))
    pairs = near_hires(sources.select(*NAMED, "source_hire_date").distinct(), days, NAMED)
    here = F.datediff("source_hire_date", "h_hired")
    reached = F.aggregate("starts", F.lit(0).cast("long"), lambda total, s: total + F.when(s["since"] <= here, s["n"]).otherwise(0))
    place = F.struct(F.when(_off() == 0, 0).when(_off() <= 7, 1).otherwise(2).alias("step"), F.col("person.h_key").alias("h_key"), _off().alias("off"), F.col("h_hired"), F.col("person"))
    return pairs.groupBy(*NAMED, "source_hire_date").agg(F.sum(reached).alias("_persons"), F.min(place).alias("_best"))


#: Identities of one key of which two and two are compared; of a key with more, all persons are listed.
FEW = 16
#: Pairs of names that are sent to all tasks.
BROADCAST_NAMES = 50_000


def _key() -> Column:
    """The key as text that tells null apart."""
    return F.to_json(F.struct("source_record_key"))


def shared_persons(profiles: DataFrame, spells: DataFrame) -> DataFrame:
    """Persons that two identities of one key could be: ``_key``, the later identity ``b``, ``h_key``, and the days from a spell to the earlier and to the later one.

    ``profiles`` has the names and dates of each key (``_key, ps``). Two that no person's names link
    share nobody; the others meet the pairs of spells that persons have, not all spells of a name.
    """
    later = F.expr("explode(slice(ps, i + 2, size(ps)))").alias("b")
    pairs = profiles.select("_key", "ps", F.posexplode("ps").alias("i", "a")).select("_key", "a", later)
    points = _rooted(spells).filter("h_last IS NOT NULL AND h_root IS NOT NULL AND h_hired IS NOT NULL")
    name = lambda of: F.struct(F.col(f"{of}.source_last_name_norm"), F.col(f"{of}.source_first_name_root"))
    both = lambda rows: rows.select("*", F.explode("all").alias("x")).select("*", F.explode("all").alias("y")).drop("all")
    names = points.groupBy("h_key").agg(F.array_sort(F.collect_set(F.struct("h_last", "h_root"))).alias("all")).select("all").distinct()
    linked = both(names).distinct()
    linked = F.broadcast(linked) if linked.limit(BROADCAST_NAMES + 1).count() <= BROADCAST_NAMES else linked
    met = pairs.join(linked, (name("a") == F.col("x")) & (name("b") == F.col("y")), "left_semi")
    around = lambda day: F.explode(F.transform(F.array(*[F.lit(i) for i in (-1, 0, 1)]), lambda i: _bucket(day) + i))
    met = met.select("*", around("a.source_hire_date").alias("m")).select("*", around("b.source_hire_date").alias("n"))
    twice = both(points.groupBy("h_key").agg(F.collect_set(F.struct("h_last", "h_root", "h_hired")).alias("all")))
    same = [F.col(f"{p}.{s}") == F.col(f"{q}.{h}") for p, q in (("a", "x"), ("b", "y")) for s, h in NAMED.items()]
    off = {n: F.abs(F.datediff(f"{p}.source_hire_date", f"{q}.h_hired")) for n, p, q in (("a_off", "a", "x"), ("b_off", "b", "y"))}
    found = met.join(twice, reduce(lambda p, q: p & q, [*same, F.col("m") == _bucket("x.h_hired"), F.col("n") == _bucket("y.h_hired"), *[c <= NEAR for c in off.values()]]))
    return found.select("_key", "b", "h_key", *[c.alias(n) for n, c in off.items()])


def _of_keys(profiles: DataFrame, spells: DataFrame) -> DataFrame:
    """How many persons the identities of a key could be together, ``_key, _persons``: those of each, less those that an earlier one could be too."""
    sums = profiles.select("_key", F.size("ps").alias("n"), F.aggregate("ps", F.lit(0).cast("long"), lambda t, p: t + p["_own"]).alias("_sum"))
    few = profiles.filter(F.size("ps").between(2, FEW))
    again = shared_persons(few, spells).groupBy("_key").agg(F.count_distinct("b", "h_key").alias("_again"))
    summed = sums.filter(F.col("n") <= FEW).join(again, "_key", "left").select("_key", (F.col("_sum") - F.coalesce("_again", F.lit(0))).alias("_persons"))
    many = profiles.filter(F.size("ps") > FEW).select("_key", F.explode("ps").alias("p")).select("_key", "p.*")
    return summed.unionByName(near_hires(many, _rooted(spells), NAMED).groupBy("_key").agg(F.count_distinct("h_key").alias("_persons")))


def _known(nodes: DataFrame, spells: DataFrame, first: DataFrame) -> DataFrame:
    """Sources of pass 2 that could be someone, with ``_persons`` of their key, and the ``_best`` of their name and date."""
    sources = _sources_2(nodes, first)
    repeated = _repeated(nodes)
    days = name_days(sources, spells)
    dated = [*NAMED, "source_hire_date"]
    if repeated is None:
        return sources.join(days, dated)
    alone, others = (df.join(days, dated) for df in _apart(sources, repeated))
    others = others.withColumn("_key", _key()).withColumnRenamed("_persons", "_own")
    profiles = others.groupBy("_key").agg(F.array_sort(F.collect_set(F.struct(*dated, "_own"))).alias("ps"))
    return alone.unionByName(others.join(_of_keys(profiles, spells), "_key").drop("_key", "_own"))


def _rated_2(pairs: DataFrame) -> DataFrame:
    """The rows of pass 2 from sources and spells that agree in name and nearly in hire date."""
    extra = {"source_has_dob": F.col("date_of_birth").isNotNull(), "dob_match": F.col("date_of_birth") == F.col("h_dob"), "name_match": F.lit(True)}
    found = _candidates(pairs, 2, F.lit("normalized_name_dob_hire_proximity"), HRIS_NAMES, extra, _off())
    days, born = F.col("hire_date_diff_days"), F.coalesce("dob_match", F.lit(False))
    by_days = lambda exact, week, month: F.when(days == 0, exact).when(days <= 7, week).otherwise(month)
    score = F.when(born, by_days(0.98, 0.97, 0.96)).otherwise(by_days(0.70, 0.65, 0.60)).cast("double")
    return found.withColumns({"match_score": score, "match_anchor_count": F.when(born, 3).otherwise(2)}).withColumn("auto_merge_qualified", (F.col("candidate_hris_person_count") == 1) & born & (F.col("match_score") >= 0.95))


def pass_2(nodes: DataFrame, spells: DataFrame, first: DataFrame) -> DataFrame:
    """Equal names and a hire date at most 30 days off; only an equal date of birth merges.

    Its rows grow with the square of a name's frequency. They come straight from the join: how many
    persons a source could be is known before, so rows are not shuffled, and those that merge are
    sought only among sources with one candidate.
    """
    return _rated_2(near_hires(_known(nodes, spells, first).drop("_best"), _rooted(spells), NAMED))


def pass_2_once(nodes: DataFrame, spells: DataFrame, first: DataFrame, shown: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``shown`` of the pairs of pass 2, each source and person once for each number of days between them.

    A person has a number of days twice for two spells of one day, or of days as long before as after
    the source's; the later of these is left out as it is joined, so that pairs are not shuffled. So is
    what an earlier identity of the same key tells alike. A ``shown`` that tells no more than days, birth
    and the source's own columns has distinct rows then. Only keys whose identities differ in birth or
    topology, or are more than ``FEW``, are made distinct afterwards.
    """
    alone, others = _apart(_sources_2(nodes, first), _repeated(nodes))
    day = F.datediff("h_hired", F.lit("1970-01-01").cast("date"))
    before = Window.partitionBy("h_last", "h_root", "h_key").orderBy(day).rangeBetween(-2 * NEAR, -1)
    rooted = _rooted(spells).select("h_last", "h_root", "h_key", "h_dob", "h_hired").distinct().withColumn("earlier", F.collect_set("h_hired").over(before))
    mirrored = F.date_sub("source_hire_date", F.datediff("h_hired", "source_hire_date"))

    def pairs(sources: DataFrame, told: Column | None = None) -> DataFrame:
        met = near_hires(sources, rooted, NAMED).filter((F.col("source_hire_date") >= F.col("h_hired")) | ~F.array_contains("earlier", mirrored))
        met = met if told is None else met.filter(~told)
        return shown(met.select("source_record_key", "merge_topology", F.col("h_key").alias("hris_person_key"), _off().alias("hire_date_diff_days"), (F.col("date_of_birth") == F.col("h_dob")).alias("dob_match"), F.lit(True).alias("name_match")))

    if others is None:
        return pairs(alone)
    others = others.select("source_record_key", *NAMED, "source_hire_date", "date_of_birth", "merge_topology").distinct().withColumn("_key", _key())
    of_key = Window.partitionBy("_key")
    others = others.withColumns({"_n": F.count("*").over(of_key), "_kinds": F.size(F.collect_set(F.struct("date_of_birth", "merge_topology")).over(of_key))})
    alike = (F.col("_kinds") == 1) & (F.col("_n") <= FEW)
    profiles = others.filter(alike).groupBy("_key").agg(F.array_sort(F.collect_list(F.struct(*NAMED, "source_hire_date"))).alias("ps")).filter(F.size("ps") > 1)
    again = shared_persons(profiles, spells).filter("a_off = b_off").groupBy("_key", *[F.col(f"b.{n}").alias(n) for n in (*NAMED, "source_hire_date")]).agg(F.collect_set(F.struct("h_key", F.col("b_off").alias("off"))).alias("_told"))
    whole = others.filter(alike).join(again, ["_key", *NAMED, "source_hire_date"], "left")
    told = F.coalesce(F.array_contains("_told", F.struct("h_key", _off().alias("off"))), F.lit(False))
    return pairs(alone).unionByName(pairs(whole, told)).unionByName(pairs(others.filter(~alike)).distinct())


def pass_2_best(nodes: DataFrame, spells: DataFrame, first: DataFrame) -> DataFrame:
    """Of each source's rows in pass 2 the first by score, person, days and hire date, without making the others.

    An equal date of birth comes before all else; only such rows are joined one by one. A source that
    pass 2 merges is one whose row here is.
    """
    known = _known(nodes, spells, first)
    unborn = known.select("*", F.col("_best.h_key").alias("h_key"), F.col("_best.h_hired").alias("h_hired"), F.col("_best.person.h_first_name").alias("h_first_name"), F.col("_best.person.h_last_name").alias("h_last_name"))
    unborn = _rated_2(unborn.withColumns({"h_dob": F.lit(None).cast("date"), "legal_root": F.lit(None).cast("string"), "h_last": F.lit(None).cast("string")}).drop("_best"))
    born = _rated_2(near_hires(known.filter("date_of_birth IS NOT NULL").drop("_best"), _rooted(spells), NAMED | {"date_of_birth": "h_dob"}))
    rows = reduce(DataFrame.unionByName, [p.select(*EVIDENCE) for p in (born, unborn)])
    return best_by_score(rows)


def pass_3(nodes: DataFrame, spells: DataFrame, first: DataFrame, second: DataFrame) -> DataFrame:
    """Accounts with a person's domain and last part of the address, hired at most 30 days off."""
    addressed = F.col("source_email_local_part").isNotNull() & F.col("source_email_domain").isNotNull() & F.col("source_hire_date").isNotNull()
    sources = without_merged(nodes.filter(F.col("source_system").isin("CRM", "DMS_ERP") & addressed), first, second).withColumn("token", last_token(F.col("source_email_local_part")))
    pairs = near_hires(sources, spells, {"source_email_domain": "h_domain", "token": "h_token"})
    found = _candidates(pairs, 3, F.lit("company_email_domain_last_token_hire_unique"), HRIS_NAMES, off=_off())
    days = F.col("hire_date_diff_days")
    score = F.when(days == 0, 0.97).when(days <= 7, 0.96).otherwise(0.95).cast("double")
    return found.withColumns({"match_score": score, "match_anchor_count": F.lit(2)}).withColumn("auto_merge_qualified", (F.col("candidate_hris_person_count") == 1) & (F.col("match_score") >= 0.95))


EVIDENCE = ("source_system", "source_record_key", "hris_person_key", "match_pass", "match_rule", "match_score", "match_anchor_count", "candidate_hris_person_count", "hire_date_diff_days", "hris_first_name", "hris_last_name", "hris_hire_date", *IDS, "loaded_at", "auto_merge_qualified")


def evidence(*passes: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, [p.select(*EVIDENCE) for p in passes])


def _best(rows: DataFrame, *order: Column) -> DataFrame:
    """The least row of each source by ``order``, in one aggregation without a sort; nulls come first."""
    place = F.struct(*[c.alias(f"o{i}") for i, c in enumerate((*order, F.col("hire_date_diff_days"), F.col("hris_hire_date")))])
    return rows.groupBy("source_record_key").agg(F.min_by(F.struct(*[c for c in rows.columns if c != "source_record_key"]), place).alias("best")).select("source_record_key", "best.*")


def best_by_score(rows: DataFrame) -> DataFrame:
    """The best row of each source, whatever pass it is from."""
    return _best(rows, -F.col("match_score"), F.col("match_pass"), F.col("candidate_hris_person_count"), F.col("hris_person_key"))


#: id column -> (system, array of ids, their number)
ROLLUPS = {
    "ats_candidate_id": ("ATS", "ats_candidate_ids", "ats_candidate_count"),
    "employee_payroll_id": ("PAYROLL", "employee_payroll_ids", "payroll_spell_count"),
    "payroll_spell_key": ("PAYROLL", "payroll_spell_keys", None),
    "crm_user_id": ("CRM", "crm_user_ids", "crm_user_count"),
    "dms_user_id": ("DMS_ERP", "dms_user_ids", "dms_user_count"),
    "erp_user_id": ("DMS_ERP", "erp_user_ids", "erp_user_count"),
}
LONG_AGO = "1900-01-01 00:00:00"


def canonical_person(hris_persons: DataFrame, *passes: DataFrame) -> DataFrame:
    """Every HRIS person with the accounts that were merged into it: one aggregation of the best matches, one join.

    Of pass 2 the best rows of each source will do.
    """
    merged = _best(evidence(*passes).filter("auto_merge_qualified"), F.col("match_pass"), -F.col("match_score"), F.col("hris_person_key"))
    ids = [F.array_sort(F.collect_set(F.when(F.col("source_system") == system, F.col(c)))).alias(to) for c, (system, to, _) in ROLLUPS.items()]
    summary = merged.groupBy("hris_person_key").agg(
        *ids, F.count("*").alias("matched_external_source_node_count"), F.countDistinct("source_system").alias("matched_external_source_system_count"),
        F.array_join(F.array_sort(F.collect_set(F.col("match_pass").cast("string"))), ",").alias("match_passes_used"), F.max("loaded_at").alias("_loaded"),
    )
    h = hris_persons
    anchors = ["hris_person_key", "hris_employee_ids", "current_hris_employee_id", "date_of_birth", "personal_email_local_part", "work_email_local_part", "canonical_hire_date", "latest_hire_date", "latest_termination_date", *[f"canonical_legal_{n}" for n in ("first_name", "last_name", "first_name_original", "last_name_original")], *[f"current_{n}" for n in ("legal_first_name", "legal_last_name", "preferred_name", "employment_status", "employment_type", "department", "job_title", "location", "manager_hris_id")]]
    none, never = F.array().cast("array<string>"), F.lit(LONG_AGO).cast("timestamp_ntz")
    columns = [c for _, to, n in ROLLUPS.values() for c in ([F.coalesce(to, none).alias(to)] + ([F.size(F.coalesce(to, none)).cast("long").alias(n)] if n else []))]
    return h.join(summary, "hris_person_key", "left").select(
        F.concat(F.lit("cp_"), "hris_person_key").alias("canonical_person_id"), *anchors, F.col("spell_count").alias("hris_spell_count"), "has_rehires", "has_name_change_marriage", *columns,
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("matched_external_source_node_count", "matched_external_source_system_count")], F.coalesce("match_passes_used", F.lit("")).alias("match_passes_used"),
        F.greatest(F.coalesce(h["loaded_at"], never), F.coalesce("_loaded", never)).alias("loaded_at"),
    )


def stewardship_queue(nodes: DataFrame, *passes: DataFrame) -> DataFrame:
    """Every identity that no pass merged, with its best candidate and the reason why it waits; of pass 2 the best rows will do."""
    every = evidence(*passes)
    best = best_by_score(every)
    renamed = {"hris_person_key": "suggested_hris_person_key", "hris_first_name": "suggested_hris_first_name", "hris_last_name": "suggested_hris_last_name", "hris_hire_date": "suggested_hris_hire_date", "match_pass": "suggested_match_pass", "match_rule": "suggested_match_rule", "match_score": "suggested_match_score", "match_anchor_count": "suggested_match_anchor_count", "candidate_hris_person_count": "candidate_hris_person_count", "hire_date_diff_days": "suggested_hire_date_diff_days"}
    suggested = best.select(F.col("source_record_key"), *[F.col(c).alias(n) for c, n in renamed.items()])
    waiting = without_merged(nodes.filter("source_system != 'HRIS'"), every)
    score, count = F.col("suggested_match_score"), F.col("candidate_hris_person_count")
    reason = F.when(F.col("suggested_hris_person_key").isNull(), "NO_DETERMINISTIC_CANDIDATE").when(count > 1, "AMBIGUOUS_CANDIDATES").when(score < 0.95, "BELOW_AUTO_MATCH_THRESHOLD").otherwise("MANUAL_REVIEW_REQUIRED")
    own = ["source_system", "source_record_key", "source_primary_id", *IDS, "merge_topology", "source_first_name", "source_last_name", "source_first_name_root", "source_last_name_norm", "source_hire_date", "source_end_date", "source_email_local_part", "source_email_domain"]
    return waiting.join(suggested, "source_record_key", "left").select(
        surrogate_key("source_record_key").alias("stewardship_queue_id"), *own, "suggested_hris_person_key", F.concat(F.lit("cp_"), "suggested_hris_person_key").alias("suggested_canonical_person_id"),
        *[n for n in renamed.values() if n != "suggested_hris_person_key"], reason.alias("stewardship_reason"), "loaded_at",
    )
