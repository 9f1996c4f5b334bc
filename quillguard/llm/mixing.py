"""Mixing sources to target weights, with DataFrame functions only.

Every document gets a hash-random key (an md5 of a seed and its id, of its text where that is null). Within each source the documents are ordered by that
key over ranges of it, a distributed prefix sum of their sizes is taken, and the mix takes them up to the source's exact
budget: whole epochs first, then the documents before the cut, the last one in part.

Defined results: null text has size 0; null source is a source of its own, the last; a source of size 0 gets 0; repeated
rows are rows of their own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, boxed, hot_safe_rank, materialize, sql_text, table, unboxed, word_count

#: Weights of the sources in the order of their names, over and over.
WEIGHTS = (5, 2, 1)
#: A source is repeated at most so many times.
MAX_EPOCHS = 3
#: Documents in one range of keys of a source, all in one window.
PER_BUCKET = 50_000
SEED = "mix-1:"


def targets(sources: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """sources: source, source_size, _n (one row a source). Adds target: the total shared by weight, no source above max_epochs times its size.

    Resharing the excess until none is above is water filling: with the sources in ascending order of cap / weight, those
    capped are the first ones, and the level is what remains over the weights that remain.
    """
    everywhere = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    s = sources.withColumn("_w", w).withColumn("_cap", F.col("source_size") * F.lit(float(max_epochs))).withColumn("_total", F.sum("source_size").over(everywhere).cast("double"))
    order = Window.orderBy((F.col("_cap") / F.col("_w")).asc(), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    left = order.rowsBetween(0, Window.unboundedFollowing)
    s = s.withColumn("_level", (F.col("_total") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_w").over(left))
    # the first source whose cap is not below its share ends the capped ones; the level is its own
    s = s.withColumn("_open", F.col("_cap") >= F.col("_level") * F.col("_w"))
    first = F.min(F.when(F.col("_open"), F.struct((F.col("_cap") / F.col("_w")).alias("r"), F.col("source").isNull().alias("z"), F.col("source").alias("s"), F.col("_level").alias("level")))).over(everywhere)
    s = s.withColumn("_at", first["level"])
    return s.withColumn("target", F.least(F.col("_cap"), F.coalesce(F.col("_at") * F.col("_w"), F.col("_cap")))).drop("_w", "_cap", "_total", "_level", "_open", "_at")


def mix(docs: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, per_bucket: int = PER_BUCKET, seed: str = SEED, carried: tuple = ()) -> DataFrame:
    """doc_id, size, source_size, target, taken and carried columns of every row of docs (doc_id, text, source)."""
    key = F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null"), F.md5(sql_text("text").cast("binary"))))).cast("binary"))
    sized = docs.select("doc_id", "source", word_count("text").alias("size"), key.alias("_key"), *carried)
    sized = materialize(sized)  # the texts are read once
    sources = sized.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"), F.count(F.lit(1)).alias("_n"))
    t = targets(sources, weights, max_epochs)
    rows = sized.withColumn("_h", F.conv(F.substring("_key", 1, 8), 16, 10).cast("long"))
    rows = hot_safe_rank(rows, ["source"], [F.col("_key"), F.col("doc_id"), F.col("size"), *[F.col(c) for c in sized.columns[4:]]], per_bucket, t.select("source", "_n"), "_before", "size")
    t = t.withColumnRenamed("source", "_source")
    budget = F.floor(F.col("target") + F.lit(0.5)).cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    rest = budget - epochs * F.col("source_size")
    partly = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), rest - F.col("_before")))
    joined = rows.join(t, rows["source"].eqNullSafe(t["_source"]), "inner")
    return joined.select("doc_id", "size", "source_size", "target", (epochs * F.col("size") + partly).cast("long").alias("taken"), *sized.columns[4:])


def mixed(docs: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """The mix itself: rows of docs (doc_id, text, source, n_chars and others), a document as often as the mix takes it whole.

    The document at a source's cut comes once more with its first words only, parted by single spaces.
    """
    own = boxed(docs, "doc_id", "text", "n_chars", "source").withColumn("_d", F.md5(F.col("text").cast("binary")))
    m = mix(docs, weights, max_epochs, carried=(F.md5(F.col("text").cast("binary")).alias("_m"), F.col("source").alias("_src"))).where("taken > 0")
    # equal rows of a source are one row here, taken as often as all of them
    m = m.groupBy(F.col("doc_id").alias("_id"), "_m", "_src").agg(F.sum("taken").alias("_taken"), F.max("size").alias("_size"))
    both = own.join(m, own["doc_id"].eqNullSafe(m["_id"]) & (own["_d"] == m["_m"]) & own["source"].eqNullSafe(m["_src"])).dropDuplicates(["doc_id", "_d", "source"])
    whole = F.floor(F.col("_taken") / F.col("_size")).cast("int")
    rest = (F.col("_taken") % F.col("_size")).cast("int")
    first = F.array_join(F.slice(F.regexp_extract_all(F.col("text"), F.lit(WORD), F.lit(0)), 1, F.greatest(rest, F.lit(1))), " ")
    texts = F.concat(F.array_repeat(F.col("text"), whole), F.when(rest > 0, F.array(first)).otherwise(F.array().cast("array<string>")))
    copies = both.withColumn("text", F.explode(texts))
    return unboxed(copies.withColumn("n_chars", F.length("text").cast("long")), docs.columns, "doc_id", "text", "n_chars", "source")


def query(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


_TARGETS = f"""
sized AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '{WORD}')), 0) AS BIGINT) AS size,
  md5('{SEED}' || coalesce(CAST(doc_id AS VARCHAR), 'null' || md5(coalesce(text, '')))) AS k FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
s1 AS (SELECT *, [{", ".join(f"{float(w)}::DOUBLE" for w in WEIGHTS)}][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} + 1 AS BIGINT)] AS w,
  source_size * {float(MAX_EPOCHS)}::DOUBLE AS cap, CAST(sum(source_size) OVER () AS DOUBLE) AS total FROM s0),
s2 AS (SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
  / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM s1),
lv AS (SELECT level AS chosen FROM s2 WHERE cap >= level * w ORDER BY cap / w, source NULLS LAST LIMIT 1),
tg AS (SELECT source, source_size, least(cap, coalesce((SELECT chosen FROM lv) * w, cap)) AS target FROM s2)
"""

ORACLE = f"""
WITH {_TARGETS},
r AS (SELECT d.doc_id, d.size, t.source_size, t.target, CAST(floor(t.target + 0.5) AS BIGINT) AS budget,
  CAST(coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS b
  FROM sized d JOIN tg t ON d.source IS NOT DISTINCT FROM t.source),
e AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS ep FROM r)
SELECT doc_id, size, source_size, target,
  CAST(ep * size + greatest(0, least(size, budget - ep * source_size - b)) AS BIGINT) AS taken FROM e
"""
