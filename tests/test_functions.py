import pandas as pd
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kinroster.functions import matching, names, privacy
from kinroster.functions.similarity import common_subsequence, indel, indels
from kinroster.operators import metrics
from kinroster.sources.nicknames import nickname_map


def column(spark, values, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, name string")
    return [r[0] for r in df.select(expression(F.col("name")).alias("x"), "i").orderBy("i").select("x").collect()]


def test_normalize_name(spark):
    given_ = ["Robert", "  Robert  ", "Édouard", "Mary-Jane", "O'Brien", "Núñez", "", None, "Robert3", "张伟", "Łukasz", "Wałęsa"]
    assert column(spark, given_, names.normalize_name) == ["robert", "robert", "edouard", "maryjane", "obrien", "nunez", "", None, "robert", "", "lukasz", "walsa"]


def test_first_name_root(spark):
    df = spark.createDataFrame([("Bob",), ("  BoB  ",), ("Liz",), ("Aiden",), ("Steve",), ("",), (None,)], "name string")
    found = names.with_root(df, F.col("name"), nickname_map(spark), "root").collect()
    assert {r["name"]: r["root"] for r in found} == {"Bob": "robert", "  BoB  ": "robert", "Liz": "elizabeth", "Aiden": "aiden", "Steve": "steve", "": "", None: None}


def test_email_parts(spark):
    assert column(spark, ["A@b.c", "no address", None, "a@b@c"], names.local_part) == ["a", None, None, "a"]
    assert column(spark, ["A@b.c", "a@b@c"], lambda c: names.email_part(c, 2)) == ["b.c", "b"]
    assert column(spark, ["rob.smith", "a.", None], names.last_token) == ["smith", None, None]


@pytest.mark.parametrize("n, shown, bucket", [(4, None, "<5"), (5, 100, "5"), (6, 100, "6")])
def test_k_anonymity(spark, n, shown, bucket):
    row = spark.range(1).select(privacy.masked(F.lit(100), F.lit(n), 5, "long").alias("m"), privacy.size_bucket(F.lit(n), 5).alias("b"), privacy.suppression_reason(F.lit(n), 5).alias("r")).first()
    assert (row["m"], row["b"], row["r"]) == (shown, bucket, None if shown else "K_ANONYMITY_THRESHOLD")


def test_match_confidence(spark):
    yes, no = F.lit(True), F.lit(False)
    row = spark.range(1).select(
        matching.match_score(work_email_match=yes, dob_match=yes, hire_date_exact=no, hire_date_within_7d=yes).alias("s"),
        matching.match_score(work_email_match=yes, personal_email_match=yes, dob_match=yes).alias("capped"),
        matching.match_score(structural_fk_match=yes).alias("fk"),
        matching.match_anchor_count(name_match=yes, hire_date_within_30d=yes).alias("n"),
    ).first()
    assert (round(row["s"], 2), row["capped"], row["fk"], row["n"]) == (0.8, 1.0, 1.0, 1)
    with pytest.raises(ValueError):
        matching.match_score(shoe_size=yes)


@given(st.text("abcd", max_size=12), st.text("abcd", max_size=12))
def test_common_subsequence(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    assert common_subsequence(a, b) == table[-1][-1]


@given(st.lists(st.tuples(st.none() | st.text("abÉ張", max_size=9), st.none() | st.text("abÉ張", max_size=9)), max_size=20))
def test_indels(pairs):
    pairs = [*pairs, ("ab" * 50, "ba" * 50), ("a" * 63, "a" * 62)]
    found = indels(pd.Series([a for a, _ in pairs], dtype=object), pd.Series([b for _, b in pairs], dtype=object))
    assert [None if x != x else x for x in found] == [indel(a, b) for a, b in pairs]


def test_indel():
    assert indel("abcd", "abd") == pytest.approx(6 / 7)
    assert indel("", "a") is None and indel(None, "a") is None


def test_rows_as_json(spark):
    df = spark.sql("SELECT DATE '2020-01-02' AS Day, TIMESTAMP_NTZ '2020-01-02 03:04:05' AS at, CAST(7 AS DECIMAL(9, 0)) AS n, CAST(1.25 AS DECIMAL(9, 2)) AS x, 'a' AS s, CAST(NULL AS DATE) AS none")
    assert metrics.fetch(df) == [{"day": "2020-01-02", "at": "2020-01-02T03:04:05", "n": 7, "x": 1.25, "s": "a", "none": None}]


def test_metric_helpers():
    assert metrics.identifier("abc_1") == "ABC_1"
    with pytest.raises(ValueError):
        metrics.identifier("a; drop")
    assert [metrics.bounded(n) for n in (0, 7, 9999)] == [1, 7, 5000]
