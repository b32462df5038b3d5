"""Mixing sources to target weights by Efraimidis-Spirakis sampling, without Python on the rows.

Each source gets a target number of words.  It is met by complete epochs of the source first and
by a weighted sample without replacement for the rest: every document has the key -ln(u) / w for a
uniform u hashed from its id and its quality weight w; documents are taken by ascending key until
the words taken reach what is left of the target.

No source is ever sorted as a whole: keys fall into BUCKETS ranges by their distribution function,
words are summed per source and range (combined before the shuffle), and only the documents of the
one range in which a source's budget ends are put in order.  What is decided is one row per source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronoweave.llm.storage import held, light, own, written

#: Weights of the sources in the order of their names, repeating.
WEIGHTS = (3, 1, 2)
SHARE, CAP = 1.5, 2  # of all words; of a source's words
BUCKETS, SEED = 1 << 16, "mix-1"


def n_words(text: Column) -> Column:
    r"""Number of ``[^\x20\x09-\x0D]+``; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def quality_weight(text: Column, size: Column) -> Column:
    """1 for texts whose mean word has 3 to 12 characters, spaces included; 0.5 for others."""
    return F.when(F.length(text).between(3 * size, 12 * size) & (size > 0), 1.0).otherwise(0.5)


def _uniform(doc_id: Column) -> Column:
    digits = F.substring(F.md5(F.concat(F.lit(SEED + ":"), F.coalesce(doc_id.cast("string"), F.lit("-")))), 1, 12)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(float(1 << 48))


def _keyed(docs: DataFrame, weight: str | None) -> DataFrame:
    """The columns of the decision: _id, _source, _size, _key, _bucket, beside those of ``docs``."""
    size = n_words(F.col("text"))
    out = docs.withColumn("_size", size)
    w = quality_weight(F.col("text"), F.col("_size")) if weight is None else F.greatest(F.coalesce(F.col(weight).cast("double"), F.lit(1.0)), F.lit(1e-6))
    out = out.withColumn("_key", -F.ln(_uniform(F.col("doc_id"))) / w)
    bucket = F.least(F.floor((1 - F.exp(-F.col("_key"))) * BUCKETS), F.lit(BUCKETS - 1)).cast("int")
    return out.withColumns({"_bucket": bucket, "_id": F.coalesce(F.col("doc_id"), F.lit(-1)), "_source": F.col("source")})


def targets(sizes: DataFrame) -> DataFrame:
    """``_source, source_size, target`` from one row per source with its size.

    target = least(CAP * size, level * weight), with the one level at which targets sum to SHARE of
    all words: the same as sharing by weight, stopping at caps and resharing until none is above.
    """
    everything = W.partitionBy(F.lit(0))  # of sources, one row each
    named = sizes.withColumn("_rank", F.row_number().over(W.partitionBy(F.lit(0)).orderBy(F.col("_source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (F.col("_rank") % len(WEIGHTS) + 1).cast("int"))
    t = named.withColumn("_w", weight).withColumn("_cap", CAP * F.col("source_size"))
    filled = W.partitionBy(F.lit(0)).orderBy(F.col("_cap") / F.col("_w"), "_rank").rowsBetween(W.unboundedPreceding, -1)
    left = SHARE * F.sum("source_size").over(everything) - F.coalesce(F.sum("_cap").over(filled), F.lit(0))
    weights = F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(filled), F.lit(0.0))
    t = t.withColumn("_level", left / weights).withColumn("_capped", F.col("_cap") / F.col("_w") <= F.col("_level"))
    capped = lambda c: F.coalesce(F.sum(F.when(F.col("_capped"), F.col(c))).over(everything), F.lit(0))
    level = F.try_divide(SHARE * F.sum("source_size").over(everything) - capped("_cap"), F.sum("_w").over(everything) - capped("_w"))
    t = t.withColumn("_final", level)
    return t.select("_source", "source_size", F.when(F.col("_capped"), F.col("_cap").cast("double")).otherwise(F.col("_final") * F.col("_w")).alias("target"))


def _decided(rows: DataFrame) -> DataFrame:
    """One row per source: epochs, and where in the order of keys its sample ends."""
    goal = targets(rows.groupBy("_source").agg(F.sum("_size").alias("source_size")))
    goal = goal.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int"))
    goal = goal.withColumn("_budget", F.col("target") - F.col("epochs") * F.col("source_size"))
    ranges = rows.groupBy("_source", "_bucket").agg(F.sum("_size").alias("_words"))
    run = W.partitionBy("_source").orderBy("_bucket").rowsBetween(W.unboundedPreceding, 0)  # at most BUCKETS rows each
    ranges = ranges.withColumn("_to", F.sum("_words").over(run)).withColumnRenamed("_source", "_s")
    crossed = ranges.join(goal, F.col("_s").eqNullSafe(F.col("_source"))).where("_to > _budget")
    crossed = crossed.groupBy("_source").agg(F.min(F.struct("_bucket", (F.col("_to") - F.col("_words")).alias("_before"))).alias("_c"))
    goal = goal.join(crossed.withColumnRenamed("_source", "_s"), F.col("_s").eqNullSafe(F.col("_source")), "left").drop("_s")
    # Without a range that crosses the budget all of the source is in the sample (and has size 0).
    goal = goal.withColumns({"_last": F.coalesce("_c._bucket", F.lit(BUCKETS)), "_before": F.coalesce("_c._before", F.lit(0))}).drop("_c")
    goal = written(goal, "mix-goal")
    edge = rows.join(goal.select(F.col("_source").alias("_s"), "_last", "_before", "_budget"), F.col("_s").eqNullSafe(F.col("_source")) & (F.col("_bucket") == F.col("_last")))
    upto = W.partitionBy("_s").orderBy("_key", "_id", "_size").rowsBetween(W.unboundedPreceding, -1)
    edge = edge.withColumn("_prefix", F.coalesce(F.sum("_size").over(upto), F.lit(0)))
    taken = edge.where(F.col("_before") + F.col("_prefix") + F.col("_size") / 2 <= F.col("_budget"))
    cut = taken.groupBy("_s").agg(F.max(F.struct("_key", "_id")).alias("_cut"))
    return goal.join(cut, F.col("_s").eqNullSafe(F.col("_source")), "left").drop("_s")


def mixed(docs: DataFrame, weight: str | None = None) -> DataFrame:
    """``docs`` with ``size, source_size, target, copies, taken`` (of those names, its own columns go).

    ``docs`` has doc_id, text and source; ``weight`` may name a column of quality weights (null: 1).
    copies = complete epochs, and one more for documents in the source's sample; taken = size *
    copies.  A null source is a source, in order after all others.  Null and empty texts have size 0
    and cost nothing.  Rows of equal doc_id, text and source fare alike.  Ties of keys go by doc_id.
    An empty table gives an empty one.
    """
    docs = docs.drop(*ADDED)
    used = ["doc_id", "text", "source", *([weight] if weight else [])]
    return _mixed(docs, weight).select(*own(docs.columns, *used), *ADDED)


ADDED = ("size", "source_size", "target", "copies", "taken")


def _mixed(docs: DataFrame, weight: str | None) -> DataFrame:
    """``docs``, its other columns put away in ``_own``, with the columns ADDED."""
    used = ["doc_id", "text", "source", *([weight] if weight else [])]
    rows = written(_keyed(docs.select(*used), weight).select("_id", "_source", "_size", "_key", "_bucket"), "mix-rows")
    plan = light(written(_decided(rows), "mix-plan")).withColumnRenamed("_source", "_s")
    sampled = (F.col("_bucket") < F.col("_last")) | ((F.col("_bucket") == F.col("_last")) & (F.struct("_key", "_id") <= F.col("_cut")))
    out = _keyed(held(docs, *used), weight).join(plan, F.col("_source").eqNullSafe(F.col("_s")))
    out = out.withColumn("copies", F.col("epochs") + F.coalesce(sampled, F.lit(False)).cast("int"))
    return out.select(*used, "_own", F.col("_size").alias("size"), "source_size", "target", "copies", (F.col("_size") * F.col("copies")).alias("taken"))


def mix(docs: DataFrame, weight: str | None = None) -> DataFrame:
    """The mixture itself: the rows of ``docs``, each as often as it is taken, with its own columns of any name."""
    used = ["doc_id", "text", "source", *([weight] if weight else [])]
    out = _mixed(docs, weight).select(*used, "_own", F.explode(F.expr("array_repeat(0, copies)")).alias("_i"))
    return out.select(*own(docs.columns, *used))


SQL = rf"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, length(text) AS n,
         (('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, '-')), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0 AS u
  FROM documents),
k AS (SELECT *, -ln(u) / CASE WHEN size > 0 AND n BETWEEN 3 * size AND 12 * size THEN 1.0 ELSE 0.5 END AS key FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM k GROUP BY source),
w AS (SELECT *, {CAP} * source_size AS cap, (list_value({', '.join(f'{w}.0::DOUBLE' for w in WEIGHTS)}))[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} + 1)::INT] AS w,
        row_number() OVER (ORDER BY source NULLS LAST) AS r FROM s),
l AS (SELECT *, ({SHARE} * sum(source_size) OVER () - coalesce(sum(cap) OVER f, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER f, 0)) AS level
      FROM w WINDOW f AS (ORDER BY cap / w, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT *, cap / w <= level AS capped FROM l),
g AS (SELECT source, source_size, CASE WHEN capped THEN cap::DOUBLE ELSE
        ({SHARE} * sum(source_size) OVER () - coalesce(sum(CASE WHEN capped THEN cap END) OVER (), 0)) / (sum(w) OVER () - coalesce(sum(CASE WHEN capped THEN w END) OVER (), 0)) * w END AS target FROM t),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::INT ELSE 0 END AS epochs FROM g),
p AS (SELECT k.doc_id, k.size, k.source, coalesce(sum(size) OVER (PARTITION BY k.source ORDER BY key, k.doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prefix FROM k)
SELECT p.doc_id, p.size::BIGINT AS size, e.source_size, e.target,
       (epochs + (CASE WHEN prefix + size / 2.0 <= target - epochs * source_size THEN 1 ELSE 0 END))::INT AS copies,
       (size * (epochs + (CASE WHEN prefix + size / 2.0 <= target - epochs * source_size THEN 1 ELSE 0 END)))::BIGINT AS taken
FROM p JOIN e ON p.source IS NOT DISTINCT FROM e.source
"""
