"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.storage import fs_of  # noqa: F401

#: A word: a run of characters other than the space and the ASCII controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows in an Arrow batch; Spark's own byte limit on batches holds besides.
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Keep Arrow batches small: texts of 100 kB and more are common."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows:
        spark.conf.set(key, rows)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "16m")


def shared_dir(spark: SparkSession) -> str:
    """A new folder under the one that the cluster names in spark.checkpoint.dir.

    Only where that is unset and all tasks run on this machine, as in tests, one under the local temporary folder is made.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = getattr(shared_dir, "_own", None) or "file://" + tempfile.mkdtemp(prefix="quillguard-")
        shared_dir._own = root
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def materialize(df: DataFrame, *partitioned: str) -> DataFrame:
    """Cut the lineage: write to the shared folder as Parquet and read that. A lost executor costs no recomputation."""
    path = shared_dir(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored = path
    return out


def drop(*stored: DataFrame) -> None:
    """Deletes tables of materialize() that no later step reads."""
    for df in stored:
        sc = df.sparkSession.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(df._stored)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def discard(spark: SparkSession, *stored: DataFrame) -> None:
    """drop(), and lets Spark drop the shuffle files of finished steps.

    Spark drops those when the driver's garbage is collected, which can be long after; large steps ask for it.
    """
    drop(*stored)
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def spread(rows: DataFrame, table: DataFrame, key: str, other: str, per_task: int) -> DataFrame:
    """rows joined with table (one row a key), where one key may be that of very many rows.

    Rows of a key with more than per_task of them are cut by a hash of the column `other`, and its row of the table is repeated for each part.
    """
    hot = rows.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / F.lit(per_task)).cast("int").alias("_parts")).where("_parts > 1")
    left = rows.join(hot, key, "left").withColumn("_part", F.pmod(F.xxhash64(F.col(other)), F.coalesce("_parts", F.lit(1))).cast("int")).drop("_parts")
    right = table.join(hot, key, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
    return left.join(right, [key, "_part"]).drop("_part")


def boxed(docs: DataFrame, *apart: str) -> DataFrame:
    """The columns apart, and all others in one struct __row, whose names then can't clash with those an operator makes."""
    return docs.select(*[F.col(f"`{c}`") for c in apart], F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in apart]).alias("__row"))


def unboxed(docs: DataFrame, columns: list[str], *apart: str) -> DataFrame:
    """The inverse, in the order of columns."""
    return docs.select(*[F.col(f"`{c}`") if c in apart else F.col(f"__row.`{c}`").alias(c) for c in columns])


def sql_text(column: str | Column) -> Column:
    """A text column with null as the empty string."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def word_count(column: str | Column) -> Column:
    """Number of words, null for none: 0."""
    c = F.col(column) if isinstance(column, str) else column
    return F.coalesce(F.regexp_count(c, F.lit(WORD)), F.lit(0)).cast("long")


def hot_safe_rank(df: DataFrame, keys: list[str], order: list[Column], per_bucket: int, counts: DataFrame, out: str, weight: str | None = None) -> DataFrame:
    """Rank (or exclusive prefix sum of `weight`) within `keys`, where one key may hold a third of all rows.

    `counts` has `keys` and `_n`, the rows of each key. Each key is cut by the range of a 32-bit hash column `_h` into
    ceil(_n / per_bucket) buckets, which follow the order of `_h`; a window runs over one bucket only, and the sums of
    the buckets before it come from a table of one row a bucket.
    """
    from pyspark.sql import Window

    on = lambda a, b: [a[k].eqNullSafe(b[k]) for k in keys]
    joined = df.join(counts, on(df, counts), "inner").select(*[df[c] for c in df.columns], counts["_n"])
    cut = F.ceil(F.col("_n") / F.lit(per_bucket)).cast("long")
    b = joined.withColumn("_b", F.floor(F.col("_h") * cut / F.lit(2**32)).cast("long")).drop("_n")
    value = F.col(weight) if weight else F.lit(1)
    per = b.groupBy(*keys, "_b").agg(F.sum(value).cast("long").alias("_s"))
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("_before", F.coalesce(F.sum("_s").over(before), F.lit(0)).cast("long")).drop("_s")
    inner = Window.partitionBy(*keys, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    ranked = b.withColumn("_in", F.coalesce(F.sum(value).over(inner), F.lit(0)).cast("long"))
    cond = [*on(ranked, per), ranked["_b"] == per["_b"]]
    return ranked.join(per, cond, "inner").select(*[ranked[c] for c in df.columns if c != "_h"], (ranked["_in"] + per["_before"]).alias(out))
