"""Small files and settled tables in any file system that Spark can reach: what all executors and a restarted driver must see alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _at(spark: SparkSession, path: str):
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(conf), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _at(spark, path)
    return fs.exists(p)


def make_folder(spark: SparkSession, path: str) -> None:
    fs, p = _at(spark, path)
    fs.mkdirs(p)


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _at(spark, path)
    fs.delete(p, True)


def read_text(spark: SparkSession, path: str) -> str:
    fs, p = _at(spark, path)
    stream = fs.open(p)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """In one step: readers see the old text or the new."""
    sc = spark.sparkContext
    fs, temp = _at(spark, path + ".new")
    stream = fs.create(temp, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    option = sc._jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename")
    how = sc._gateway.new_array(sc._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    how[0] = option.getEnumConstants()[1]  # NONE, OVERWRITE
    context = sc._jvm.org.apache.hadoop.fs.FileContext.getFileContext(temp.toUri() if temp.toUri().getScheme() else fs.getUri(), sc._jsc.hadoopConfiguration())
    context.rename(temp, _at(spark, path)[1], how)


def scratch(spark: SparkSession) -> str:
    """A new folder that all tasks can write to and read: under that of spark.checkpoint.dir, or under the local temporary one where all tasks run in this process."""
    import tempfile
    import uuid

    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="quillguard-")
    path = f"{root.rstrip('/')}/{uuid.uuid4().hex}"
    make_folder(spark, path)
    return path


def settled(df: DataFrame) -> DataFrame:
    """The rows as they are now, for good: computed again they could differ. Into the folder of spark.checkpoint.dir, in memory where all tasks run in this process."""
    spark = df.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(root)
        return df.checkpoint()
    if spark.sparkContext.master.partition("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    df = df.cache()
    df.count()
    return df


def fs_of(uri: str):
    """pyarrow's file system and path of a URI: executors write shard files where all can read them."""
    import os

    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        uri = "file://" + os.path.abspath(uri)
    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return fs.FileSystem.from_uri(uri)
