"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every source gets a token budget: its weight's part of the whole, at most ``cap`` times its own
size, the excess shared out again by weight. Complete epochs of a source come first. What is then
left of its budget is drawn without replacement: each document gets the key -ln(u) / quality, u
being a hash of its id and text, and the documents with the smallest keys are taken until their
prefix sum reaches the rest of the budget.

The prefix sum never sorts a source as a whole. Keys fall into ordered buckets; sizes are summed
by source and bucket before any shuffle; the single bucket in which a budget ends is cut into
buckets again until it has few rows, and only these are sorted. Rows with equal keys are told apart
by a hash of their position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import support

WEIGHTS = (5, 2, 1)
#: Bits of a key's code, and of the hash of a position; bits of a bucket at each level; rows that one task sorts.
CODE_BITS, PLACE_BITS, LEVEL_BITS, EDGE_ROWS = 40, 20, 12, 200_000
#: Plans of so many sources are broadcast; beyond, they are joined by a shuffle.
BROADCAST_SOURCES = 50_000


def quality(text: Column, words: Column) -> Column:
    """Weight of a text in (0, 1]: falls with the share of digits and with words that are oddly short or long."""
    size = F.octet_length(text).cast("double")
    digits = size - F.octet_length(F.regexp_replace(text, "[0-9]+", "")).cast("double")
    odd = F.abs(size / words.cast("double") - 7.0) / 7.0
    return F.when(words > 0, 1.0 / (1.0 + 4.0 * (digits / size) + odd)).otherwise(1.0)


def exponential_key(identity: Column, text: Column, weight: Column) -> Column:
    """-ln(u) / weight with u in (0, 1) from the MD5 of id and text."""
    digest = F.md5(F.encode(F.concat(F.coalesce(identity.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit(""))), "UTF-8"))
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    return -F.log(u) / weight


def budgets(totals: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: tuple[int, int] = (3, 2), cap: int = 2) -> DataFrame:
    """``_mix_source, source_size`` with ``target``: ``share`` of all sizes by weight, at most ``cap`` times a source's own.

    One row for each source, so the windows over all of them stay small.
    """
    number = F.row_number().over(Window.orderBy(F.col("_mix_source").asc_nulls_last())) - 1
    listed = F.array(*[F.lit(w) for w in weights])
    ranked = totals.withColumn("w", F.element_at(listed, (F.pmod(number, F.lit(len(weights))) + 1).cast("int")).cast("long"))
    order = Window.orderBy((F.col("source_size") / F.col("w")).asc(), F.col("_mix_source").asc_nulls_last())
    upto, everything = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    over, under = share
    ranked = (
        ranked.withColumn("full", F.coalesce(F.sum(F.col("source_size") * cap).over(upto), F.lit(0)))
        .withColumn("rest", F.sum("w").over(everything) - F.coalesce(F.sum("w").over(upto), F.lit(0)))
        .withColumn("left", F.sum("source_size").over(everything) * over - F.col("full") * under)
        .withColumn("at", F.row_number().over(order))
        .withColumn("short", F.col("source_size") * cap * under * F.col("rest") > F.col("w") * F.col("left"))
    )
    first = F.min(F.when(F.col("short"), F.struct("at", "left", "rest"))).over(everything)
    level = (F.col("w") * first["left"]).cast("double") / (first["rest"] * under).cast("double")
    bounded = (F.col("source_size") * cap).cast("double")
    return ranked.select("_mix_source", "source_size", F.when(first.isNull() | (F.col("at") < first["at"]), bounded).otherwise(level).alias("target"))


def mix(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source", **options) -> DataFrame:
    """``df`` with ``size`` (words), ``source_size``, ``target`` and ``taken`` (words the mix takes, repeats counted).

    ``taken / size`` is the number of times a document is used: the complete epochs of its source,
    and one more if it is drawn. A source's words differ from its target by half a document at most.
    The options are ``weights``, ``share``, ``cap`` (see ``budgets``) and ``edge_rows``.

    The rows with their keys are written once to the shared folder, since they are read several times.

    Null texts and texts without words have size 0 and are never taken; null sources form a source,
    which comes last; null ids are hashed like empty ones; very long texts count as a whole; equal
    rows have equal keys and are taken one by one; a source without words has target 0; an empty
    table gives an empty table. Columns of the input that are named like the new ones are replaced;
    others are kept.
    """
    own = F.struct(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in ("size", "source_size", "target", "taken")])
    keyed = support.written(prepared(df, own, id_column, text_column, source_column), "mix-rows")
    return mixed(keyed, **options).select("row.*", "size", "source_size", "target", "taken")


def prepared(df: DataFrame, row: Column, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source") -> DataFrame:
    """``row`` with what the mix needs of it: ``size, _mix_source``, ``_mix_key`` and its place in the order of keys, ``_mix_at``."""
    text, words = F.col(text_column), support.word_count(F.col(text_column))
    slim = df.select(row.alias("row"), words.alias("size"), F.col(source_column).alias("_mix_source"), text.alias("text"), F.col(id_column).alias("id"))
    keyed = slim.withColumn("_mix_key", exponential_key(F.col("id"), F.col("text"), quality(F.col("text"), F.col("size"))))
    code = F.floor(F.col("_mix_key") / (1.0 + F.col("_mix_key")) * float(1 << CODE_BITS)).cast("long")
    place = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1 << PLACE_BITS))
    return keyed.select("row", "size", "_mix_source", "_mix_key", F.shiftleft(code, PLACE_BITS).bitwiseOR(place).alias("_mix_at"))


def bucket(level: int) -> Column:
    """The bucket of a row at a level: leading bits of its place in the order."""
    return F.shiftright("_mix_at", CODE_BITS + PLACE_BITS - level * LEVEL_BITS)


def narrowed(keyed: DataFrame, plan: DataFrame, level: int) -> DataFrame:
    """``plan`` with the bucket of ``level`` in which each source's budget ends (``_edge``), the words before it and its rows.

    ``plan`` has the same of the level before, whose edge buckets are cut here.
    """
    if level > 1:
        keyed = keyed.join(bounded(plan.select("_s", "_edge")), F.col("_mix_source").eqNullSafe(F.col("_s")) & (bucket(level - 1) == F.col("_edge")))
    sums = support.written(keyed.groupBy("_mix_source", bucket(level).alias("_b")).agg(F.sum("size").alias("words"), F.count("*").alias("rows")), "mix")
    run = Window.partitionBy("_mix_source").orderBy("_b")
    edges = sums.select("_mix_source", "_b", "rows", (F.sum("words").over(run) - F.col("words")).alias("inside"))
    before = F.col("_before") + F.col("inside")
    joined = plan.join(edges, F.col("_s").eqNullSafe(F.col("_mix_source")) & (before <= F.col("_rest")), "left")
    # The last bucket that begins below the rest of the budget is the one in which it ends.
    last = joined.groupBy("_s", "source_size", "target", "_epochs", "_rest").agg(F.max(F.struct("_b", before.alias("before"), "rows")).alias("last"))
    own = [F.col("last._b").alias("_edge"), F.col("last.before").alias("_before"), F.col("last.rows").alias("_rows")]
    return support.written(last.select("_s", "source_size", "target", "_epochs", "_rest", *own), "mix-plan")


def bounded(plan: DataFrame) -> DataFrame:
    return F.broadcast(plan) if plan.count() <= BROADCAST_SOURCES else plan


def mixed(keyed: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: tuple[int, int] = (3, 2), cap: int = 2, edge_rows: int = EDGE_ROWS) -> DataFrame:
    """The mix of rows that ``prepared`` made: ``row, size, source_size, target, taken``."""
    plan = budgets(keyed.groupBy("_mix_source").agg(F.sum("size").alias("source_size")), weights, share, cap)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    plan = plan.withColumn("_epochs", F.least(epochs, F.lit(cap)).cast("long")).withColumn("_rest", F.col("target") - F.col("_epochs") * F.col("source_size"))
    plan = plan.withColumnRenamed("_mix_source", "_s").withColumns({"_edge": F.lit(0).cast("long"), "_before": F.lit(0).cast("long")})
    for level in range(1, (CODE_BITS + PLACE_BITS) // LEVEL_BITS + 1):
        plan = narrowed(keyed, plan, level)
        if (plan.agg(F.max("_rows")).first()[0] or 0) <= edge_rows:
            break
    joined = keyed.join(bounded(plan), F.col("_mix_source").eqNullSafe(F.col("_s"))).withColumn("_b", bucket(level))
    ends = F.col("_b") == F.col("_edge")
    # Where the buckets part rows with one code, their places decide, as they do between buckets.
    order = ["_mix_key", "size", "_mix_at"] if level * LEVEL_BITS <= CODE_BITS else ["_mix_at"]
    inside = Window.partitionBy("_mix_source").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    middle = F.col("_before") + F.sum("size").over(inside) - F.col("size") / 2
    edge = joined.filter(ends).withColumn("_drawn", middle <= F.col("_rest"))
    others = joined.filter(~ends).withColumn("_drawn", F.col("_b") < F.col("_edge"))
    taken = F.col("size") * F.least(F.col("_epochs") + F.col("_drawn").cast("long"), F.lit(cap).cast("long"))
    return others.unionByName(edge).select("row", "size", "source_size", "target", taken.alias("taken"))


def mixture(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source", **options) -> DataFrame:
    """The mix itself: every row of ``df``, as it is, as many times as the mix takes it. See ``mix`` for odd rows."""
    keyed = support.written(prepared(df, F.struct("*"), id_column, text_column, source_column), "mix-rows")
    times = F.when(F.col("size") > 0, (F.col("taken") / F.col("size")).cast("int")).otherwise(0)
    return mixed(keyed, **options).select("row", F.explode(F.array_repeat(F.lit(0), times))).select("row.*")


def op2(spark, sf_dir: str) -> DataFrame:
    """The mix of all documents."""
    docs = support.table(spark, sf_dir, "documents")
    keyed = support.written(prepared(docs, F.struct("doc_id")), "mix-keys")
    return mixed(keyed).select("row.*", "size", "source_size", "target", "taken")


OP2_SQL = """
WITH counted AS (
  SELECT doc_id, source, coalesce(text, '') AS body, strlen(coalesce(text, ''))::DOUBLE AS bytes,
         len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size
  FROM documents
), keyed AS (
  SELECT doc_id, source, size,
         -ln((CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || body), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE)
         / CASE WHEN size > 0 THEN 1.0::DOUBLE / (1.0::DOUBLE
              + 4.0::DOUBLE * ((bytes - strlen(regexp_replace(body, '[0-9]+', '', 'g'))::DOUBLE) / bytes)
              + abs(bytes / size::DOUBLE - 7.0::DOUBLE) / 7.0::DOUBLE) ELSE 1.0::DOUBLE END AS k
  FROM counted
), totals AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS w
  FROM keyed GROUP BY source
), ranked AS (
  SELECT *, row_number() OVER r AS pos,
         coalesce(sum(2 * source_size) OVER (r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS full_before,
         (sum(w) OVER () - coalesce(sum(w) OVER (r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS rest,
         (sum(source_size) OVER ())::BIGINT AS everything
  FROM totals WINDOW r AS (ORDER BY source_size / w, source NULLS LAST)
), first_short AS (
  SELECT pos, rest, 3 * everything - 2 * full_before AS left_over FROM ranked
  WHERE 4 * source_size * rest > w * (3 * everything - 2 * full_before) ORDER BY pos LIMIT 1
), plan AS (
  SELECT source, source_size,
         CASE WHEN f.pos IS NULL OR r.pos < f.pos THEN (2 * source_size)::DOUBLE ELSE (w * left_over)::DOUBLE / (2 * f.rest)::DOUBLE END AS target
  FROM ranked r LEFT JOIN first_short f ON true
), budget AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 2) ELSE 0 END::BIGINT AS epochs FROM plan
), summed AS (
  SELECT k.doc_id, k.size, b.source_size, b.target, b.epochs, b.target - b.epochs * b.source_size AS rest,
         sum(k.size) OVER (PARTITION BY k.source ORDER BY k.k, k.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::DOUBLE AS upto
  FROM keyed k JOIN budget b ON k.source IS NOT DISTINCT FROM b.source
)
SELECT doc_id, size, source_size, target,
       (size * least(epochs + CASE WHEN upto - size / 2.0::DOUBLE <= rest THEN 1 ELSE 0 END, 2))::BIGINT AS taken
FROM summed
"""
