"""Names and e-mail addresses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The folded characters and what they fold to.
FOLDED = "ÀÁÂÃÄÅàáâãäåÈÉÊËèéêëÌÍÎÏìíîïÒÓÔÕÖØòóôõöøÙÚÛÜùúûüÝýÿÇçÑñŁłŚśŠšŹźŻżŽžĐđŘřŤť"
PLAIN = "AAAAAAaaaaaaEEEEeeeeIIIIiiiiOOOOOOooooooUUUUuuuuYyyCcNnLlSsSsZzZzZzDdRrTt"


def normalize_name(name: Column) -> Column:
    """Folded, lower-cased, and without all that is not a-z then; other scripts become ''."""
    return F.regexp_replace(F.lower(F.translate(F.trim(name), FOLDED, PLAIN)), "[^a-z]", "")


def with_root(df: DataFrame, name: Column, nicknames: DataFrame, to: str) -> DataFrame:
    """``df`` with the canonical first name of ``name``: of a nickname its long form, else the normalised name.

    ``nicknames`` is the seed table, which is tiny by definition.
    """
    pairs = F.broadcast(nicknames.select(F.col("nickname").alias("_nickname"), F.col("canonical_first_name").alias("_long")))
    short = df.withColumn("_short", normalize_name(name))
    return short.join(pairs, F.col("_short") == F.col("_nickname"), "left").withColumn(to, F.coalesce("_long", "_short")).drop("_short", "_nickname", "_long")


def email_part(email: Column, part: int) -> Column:
    """What stands before (1) or after (2) the first @, or null without one."""
    return F.when(F.instr(email, "@") > 0, F.split_part(email, F.lit("@"), F.lit(part)))


def local_part(email: Column) -> Column:
    return F.lower(F.trim(email_part(email, 1)))


def last_token(local: Column) -> Column:
    """What stands after the last dot; null if nothing does."""
    return F.regexp_substr(local, F.lit("[^.]+$"))
