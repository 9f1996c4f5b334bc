"""Length-delimited binary records of token ids, with an offset index beside them.

A shard file is a row of frames: payload length (u64), masked checksum of that length (u32), payload, masked checksum of
the payload (u32), all little endian. A payload is a flag byte (1: ids of two bytes, 2: no doc_id), doc_id (i64) and ids.
The index file has the offset (u64) of each frame, so a reader can take records in any order. Shards follow the order of
doc_id; each is written under another name and moved when whole, so a task that runs again replaces its own file only.

Defined results: null text is the empty text (one end id); null doc_id comes first; rows with the same doc_id follow each
other in the order of their texts; an empty table gives no records; other columns are ignored.
"""

from __future__ import annotations

import random
import struct
import zlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_batches, fs_of, materialize, shared_dir, sql_text, table

END_ID = 2
_HEAD = struct.Struct("<QI")
_OWN = struct.Struct("<Bq")


def mask(crc: int) -> int:
    """A checksum that may be checksummed again: rotated by 15 bits, plus a constant."""
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: bytes) -> bytes:
    """ids: little-endian unsigned 32-bit integers."""
    import numpy as np

    a = np.frombuffer(ids, "<u4")
    small = not a.size or int(a.max()) < 65536
    body = _OWN.pack(small | (doc_id is None) << 1, doc_id or 0) + (a.astype("<u2").tobytes() if small else ids)
    n = struct.pack("<Q", len(body))
    return n + struct.pack("<I", mask(zlib.crc32(n))) + body + struct.pack("<I", mask(zlib.crc32(body)))


def unframe(read, at: str = "") -> tuple[int | None, bytes] | None:
    """The next record; read(n) gives n bytes. None at the end of the file; ValueError if a checksum doesn't hold."""
    import numpy as np

    head = read(_HEAD.size)
    if not head:
        return None
    if len(head) < _HEAD.size or mask(zlib.crc32(head[:8])) != (pair := _HEAD.unpack(head))[1]:
        raise ValueError(f"damaged length {at}")
    body, tail = read(pair[0]), read(4)
    if len(body) < pair[0] or len(tail) < 4 or mask(zlib.crc32(body)) != struct.unpack("<I", tail)[0]:
        raise ValueError(f"damaged record {at}")
    flags, doc_id = _OWN.unpack_from(body)
    ids = np.frombuffer(body, "<u2" if flags & 1 else "<u4", offset=_OWN.size)
    return (None if flags & 2 else doc_id), ids.astype("<u4").tobytes()


class Shard:
    """Random access to one shard by its index."""

    def __init__(self, uri: str):
        import numpy as np

        fs, path = fs_of(uri)
        self.f = fs.open_input_file(path)
        with fs.open_input_stream(path + ".idx") as f:
            self.offsets = np.frombuffer(f.read(), "<u8")

    def __len__(self) -> int:
        return len(self.offsets)

    def __getitem__(self, i: int) -> tuple[int | None, bytes]:
        self.f.seek(int(self.offsets[i]))
        return unframe(self.f.read)

    def shuffled(self, seed: int):
        order = list(range(len(self)))
        random.Random(seed).shuffle(order)
        return (self[i] for i in order)


def write_records(docs: DataFrame, encode, to: str, end_id: int = END_ID) -> DataFrame:
    """Writes docs (doc_id, text) under the folder `to`; encode: a function without arguments that gives texts -> the bytes of ids of each.

    Returns the manifest: shard, path, n_records, n_ids, in the order of the shards.
    """
    import pyarrow as pa

    spark = docs.sparkSession
    bound_batches(spark)
    own = docs.select("doc_id", sql_text("text").alias("text"))
    # the hash spreads rows of one doc_id, should it be that of very many rows
    ordered = own.repartitionByRange(F.col("doc_id"), F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
    end = struct.pack("<I", end_id)

    def write(batches):
        from pyspark import TaskContext

        task, enc = TaskContext.get(), encode()
        shard = task.partitionId()
        fs, root = fs_of(to)
        fs.create_dir(root, recursive=True)
        path, temp = f"{root}/{shard:06d}.rec", f"{root}/.{shard:06d}-{task.taskAttemptId()}"
        offsets, at, n_ids = [], 0, 0
        with fs.open_output_stream(temp) as f:
            for b in batches:
                for doc_id, ids in zip(b.column(0).to_pylist(), enc(b.column(1).to_pylist())):
                    ids += end
                    x = frame(doc_id, ids)
                    f.write(x)
                    offsets.append(at)
                    at += len(x)
                    n_ids += len(ids) // 4
        if not offsets:
            fs.delete_file(temp)
            return
        with fs.open_output_stream(temp + ".idx") as f:
            f.write(struct.pack(f"<{len(offsets)}Q", *offsets))
        fs.move(temp + ".idx", path + ".idx")
        fs.move(temp, path)
        yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "path": [f"{to}/{shard:06d}.rec"], "n_records": pa.array([len(offsets)], pa.int64()), "n_ids": pa.array([n_ids], pa.int64())})

    return materialize(ordered.mapInArrow(write, "shard int, path string, n_records long, n_ids long"))


def read_records(manifest: DataFrame) -> DataFrame:
    """Per record, from the files: doc_id, start (ids of all records before it), n_tokens, ids_crc32."""
    import pyarrow as pa

    # one row a shard: some thousands at most, so one window over all is small
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).cast("long"))
    n = max(1, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def read(batches):
        for b in batches:
            for path, records, base in zip(*(b.column(k).to_pylist() for k in range(3))):
                fs, p = fs_of(path)
                rows, seen = [], 0
                with fs.open_input_stream(p, buffer_size=1 << 20) as f:
                    while (x := unframe(f.read, path)) is not None:
                        k = len(x[1]) // 4
                        rows.append((x[0], base, k, zlib.crc32(x[1])))
                        base += k
                        seen += 1
                        if len(rows) == 10_000:
                            yield _rows(pa, rows)
                            rows = []
                if seen != records:
                    raise ValueError(f"{path}: {seen} records, the manifest has {records}")
                if rows:
                    yield _rows(pa, rows)

    return shards.select("path", "n_records", "base").repartition(n).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _rows(pa, rows: list[tuple]):
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["doc_id", "start", "n_tokens", "ids_crc32"])


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")

    def encode():
        from quillguard.llm.encoding import BYTE_PIECES, CachedEncoder

        return CachedEncoder.of(path, BYTE_PIECES).encode_many

    return read_records(write_records(table(spark, sf_dir, "documents"), encode, shared_dir(spark)))
