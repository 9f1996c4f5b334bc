"""A tamper-evident audit table: each entry's checksum covers its content and the checksum before it."""

from __future__ import annotations

import hashlib
import hmac
import json
import os
import re
import uuid
from dataclasses import dataclass, field
from datetime import datetime, timezone
from itertools import accumulate
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import crypto
from ..sources import storage

OPERATIONS = ("scan", "protect", "batch", "discover", "encrypt", "decrypt", "tokenize", "detokenize", "hash", "policy", "export")
SCHEMA = (
    "seq long, id string, timestamp string, operation string, parameters struct<input:string,output:string,policy:string,metadata:map<string,string>>, "
    "outcome struct<success:boolean,error:string,findings:struct<total:long,by_category:map<string,long>>,redactions:struct<total:long,by_category:map<string,long>>>, "
    "checksum string, previous_checksum string"
)


def summary(findings: DataFrame) -> dict:
    """total and by_category of a table of findings or redactions."""
    by = {r["category"]: r["count"] for r in findings.groupBy("category").count().collect()}  # one row a category
    return {"total": sum(by.values()), "by_category": by}


def sanitize(text: Column) -> Column:
    """Addresses, user folders, cards and social security numbers out of an error message."""
    for pattern, new in ((r"[\w.%+-]+@[\w.-]+\.[A-Za-z]{2,}", "[EMAIL]"), (r"(/(?:home|Users)/)[^/\s]+", "$1[USER]"), (r"\b(?:\d[ -]?){13,16}\b", "[CARD]"), (r"\b\d{3}-\d\d-\d{4}\b", "[SSN]")):
        text = F.regexp_replace(text, pattern, new)
    return text


def _content() -> Column:
    """What a checksum covers besides the one before."""
    return F.concat_ws("|", "id", "timestamp", "operation", F.to_json("parameters"), F.to_json("outcome"))


def checksum(key: bytes | None = None) -> Column:
    whole = F.concat(_content(), F.lit("|"), F.coalesce("previous_checksum", F.lit("")))
    return crypto.hmac_sha256(whole, key) if key else F.sha2(whole, 256)


def verify_chain(log: DataFrame, key: bytes | None = None) -> DataFrame:
    """seq, id, problem of each entry whose checksum or link doesn't hold; the first is the place of the break.

    Checksums are computed in parallel. Links need the order: entries are cut into ranges of seq, each with its own window, and a
    range's first entry is held against the last one of the range before.
    """
    size = 100_000
    rows = log.withColumn("_ok", F.col("checksum") == checksum(key)).select("seq", "id", "checksum", "previous_checksum", "_ok", F.floor(F.col("seq") / size).alias("_r"))
    w = Window.partitionBy("_r").orderBy("seq")
    inner = rows.withColumn("_before", F.lag("checksum").over(w)).withColumn("_first", F.row_number().over(w) == 1)
    ends = rows.groupBy("_r").agg(F.max_by("checksum", "seq").alias("_last")).withColumn("_next", F.lead("_r").over(Window.orderBy("_r")))
    linked = inner.join(ends.select(F.col("_next").alias("_r"), "_last"), "_r", "left")
    before = F.when(F.col("_first"), F.col("_last")).otherwise(F.col("_before"))
    bad = F.when(~F.coalesce("_ok", F.lit(False)), "checksum").when(~F.col("previous_checksum").eqNullSafe(before), "link")
    return linked.select("seq", "id", bad.alias("problem")).where(F.col("problem").isNotNull()).orderBy("seq")


#: Entries that one task sorts.
RANGE = 250_000


def _ranged(rows: DataFrame, by: str, path: str) -> DataFrame:
    """The rows in the order of a column, one sorted file a range of it, with _r and _i: the range and the place in it, from 0."""
    spark, n = rows.sparkSession, rows.count()
    ranges = max(-(-n // RANGE), min(spark.sparkContext.defaultParallelism, -(-n // 10_000)), 1)
    placed = rows.repartitionByRange(ranges, by).sortWithinPartitions(by).withColumn("_id", F.monotonically_increasing_id())
    out = placed.select(*rows.columns, F.shiftright("_id", 33).cast("int").alias("_r"), F.col("_id").bitwiseAND((1 << 33) - 1).alias("_i"))
    out.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(out.schema).parquet(path)


def numbered(rows: DataFrame, by: str, into: str = "seq") -> DataFrame:
    """Adds each row's place in the order of a column, from 1. Ranges are sorted apart and moved by the rows before them."""
    spark = rows.sparkSession
    own = _ranged(rows, by, storage.scratch(spark) + "/ranges")
    sizes = sorted(tuple(r) for r in own.groupBy("_r").agg((F.max("_i") + 1).alias("n")).collect())  # one row a range
    starts = spark.createDataFrame([(r, s) for (r, _), s in zip(sizes, accumulate((n for _, n in sizes), initial=0))], "_r int, _start long")
    return own.join(F.broadcast(starts), "_r").select(*rows.columns, (F.col("_start") + F.col("_i") + 1).alias(into))


def chain(entries: DataFrame, key: bytes | None = None) -> DataFrame:
    """Adds checksum and previous_checksum to entries (SCHEMA without them) in the order of seq.

    Each checksum needs the one before, so one task goes through all contents. It sorts and holds nothing: ranges of seq lie sorted in
    files, it reads them one after the other and writes a file of checksums for each. All else is done by ranges in parallel. Runs when called.
    """
    import pyarrow as pa

    spark, names = entries.sparkSession, list(entries.columns)
    root = storage.scratch(spark)
    own = _ranged(entries.withColumn("_c", _content()), "seq", root + "/entries")
    place = lambda r: f"sums-{r:05}.parquet"

    def link(batches):
        from pyarrow import fs
        from pyarrow import parquet as pq

        yield from batches
        at, path = storage.fs_of(root)
        parts = {int(m[1]): f.path for f in at.get_file_info(fs.FileSelector(path + "/entries")) if (m := re.match(r"part-(\d+)", f.base_name))}
        last = None
        for r in sorted(parts):
            sums = [last]  # what is before the first entry
            with at.open_input_file(parts[r]) as f:
                for b in pq.ParquetFile(f).iter_batches(10_000, columns=["_c"]):
                    for c in b.column(0).to_pylist():
                        data = f"{c}|{last or ''}".encode()
                        last = hmac.digest(key, data, "sha256").hex() if key else hashlib.sha256(data).hexdigest()
                        sums.append(last)
            pq.write_table(pa.table({"s": pa.array(sums, pa.string())}), f"{path}/{place(r)}", filesystem=at, compression="zstd")

    def linked(batches):
        from pyarrow import parquet as pq

        at, path = storage.fs_of(root)
        held, sums = None, None
        for b in batches:
            of = b.column(b.schema.get_field_index("_r")).to_pylist()
            cuts = [0, *(k for k in range(1, len(of)) if of[k] != of[k - 1]), len(of)]
            for start, end in zip(cuts, cuts[1:]):
                if start == end:
                    continue
                if of[start] != held:
                    held = of[start]
                    sums = pq.read_table(f"{path}/{place(held)}", filesystem=at)["s"].combine_chunks()
                x = b.slice(start, end - start)
                i = x.column(x.schema.get_field_index("_i")).to_numpy()
                yield pa.RecordBatch.from_arrays([x.column(x.schema.get_field_index(n)) for n in names] + [sums.take(pa.array(i + 1)), sums.take(pa.array(i))], [*names, "checksum", "previous_checksum"])

    spark.range(0, 1, numPartitions=1).mapInArrow(link, "id long").count()
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in entries.schema)
    return own.drop("_c").mapInArrow(linked, f"{kinds}, checksum string, previous_checksum string")


@dataclass(frozen=True)
class Filter:
    operations: tuple[str, ...] = ()
    start: str | None = None
    end: str | None = None
    paths: tuple[str, ...] = ()

    def on(self, log: DataFrame) -> DataFrame:
        if self.operations:
            log = log.where(F.col("operation").isin(*self.operations))
        if self.start:
            log = log.where(F.col("timestamp") >= self.start)
        if self.end:
            log = log.where(F.col("timestamp") <= self.end)
        if self.paths:
            log = log.where(F.col("parameters.input").isin(*self.paths) | F.col("parameters.output").isin(*self.paths))
        return log


@dataclass
class AuditLog:
    """JSON lines in a file a day, 0600; with a data key each line is encrypted. One writer."""

    spark: SparkSession
    folder: str
    key: bytes | None = None
    data_key: bytes | None = None
    last: tuple[int, str | None] = field(default=(0, None), init=False)

    def __post_init__(self):
        Path(self.folder).mkdir(parents=True, exist_ok=True)
        if self.files():
            row = self.read().orderBy(F.desc("seq")).select("seq", "checksum").first()
            self.last = (row["seq"], row["checksum"]) if row else (0, None)

    def files(self, start: str | None = None, end: str | None = None) -> list[str]:
        """Of the days from start to end: a day's file is left out without a look into it."""
        own = sorted(str(p) for p in Path(self.folder).glob("audit-*.jsonl"))
        day = lambda p: re.search(r"audit-(\d{4}-\d\d-\d\d)", p)[1]
        return [p for p in own if (not start or day(p) >= start[:10]) and (not end or day(p) <= end[:10])]

    def log(self, operation: str, parameters: dict | None = None, outcome: dict | None = None, now: datetime | None = None) -> str:
        """Appends an entry; gives its id."""
        if operation not in OPERATIONS:
            raise ValueError(f"unknown operation {operation}")
        now = now or datetime.now(timezone.utc)
        entry = {"seq": self.last[0] + 1, "id": str(uuid.uuid4()), "timestamp": now.isoformat(), "operation": operation, "parameters": parameters or {}, "outcome": outcome or {"success": True}}
        row = self.spark.createDataFrame([json.dumps(entry | {"previous_checksum": self.last[1]})], "string").select(F.from_json("value", SCHEMA).alias("e")).select("e.*")
        row = row.withColumn("checksum", checksum(self.key))
        line = F.to_json(F.struct("*"))
        if self.data_key:
            line = crypto.encrypt(line, self.data_key)
        done = row.select(line.alias("line"), "seq", "checksum").first()
        p = Path(self.folder, f"audit-{now:%Y-%m-%d}{'.enc' if self.data_key else ''}.jsonl")
        fd = os.open(p, os.O_WRONLY | os.O_APPEND | os.O_CREAT, 0o600)
        with os.fdopen(fd, "w") as f:
            f.write(done["line"] + "\n")
        self.last = (done["seq"], done["checksum"])
        return entry["id"]

    def read(self, start: str | None = None, end: str | None = None) -> DataFrame:
        if not (files := self.files(start, end)):
            return self.spark.createDataFrame([], SCHEMA)
        line = F.col("value") if not self.data_key else crypto.decrypt(F.col("value"), self.data_key)
        return self.spark.read.text(files).select(F.from_json(line, SCHEMA).alias("e")).select("e.*")

    def query(self, f: Filter) -> DataFrame:
        return f.on(self.read(f.start, f.end))

    def verify(self) -> DataFrame:
        return verify_chain(self.read(), self.key)
