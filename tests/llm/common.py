"""Small tables with everything that goes wrong in real ones."""

import re

import pandas as pd

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def table(spark, tmp_path, name, rows, schema):
    """One Parquet folder ``name.parquet``, as the queries expect it."""
    spark.createDataFrame(rows, schema).coalesce(2).write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def odd_documents():
    """Nulls everywhere, empty and blank texts, repeated rows, copies, a very long text, equal ids."""
    long_text = " ".join(f"w{i % 977}x{i}" for i in range(60_000))
    rows = [
        (1, "one two three four five six", "en", "b", 1), (1, "one two three four five six", "en", "b", 1), (2, "one two three four five six", "en", "a", 1), (3, None, None, None, None), (None, "alone without an id", "en", None, 2),
        (None, None, None, None, None), (4, "", "en", "a", 0), (5, "  \n\t ", "en", "a", 4), (6, long_text, "de", "c", len(long_text)), (7, "Ärger über ſtrange 张伟 words", "de", "c", 5), (8, "hi", "en", "b", 2), (9, "hi", "en", "b", 2),
    ]
    return rows


def words(text):
    return WORD.findall(text or "")


def frame(df):
    rows = df.collect()
    return pd.DataFrame([r.asDict() for r in rows], columns=df.columns)
