"""Scanning streams with the same expressions as tables: line by line without state, or by chunks with a carry-over."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.detectors import Registry, with_findings

CHUNK, MAX_BUFFER, SMALL = 8192, 65536, 100


def read_lines(spark: SparkSession, path: str, max_files: int = 100) -> DataFrame:
    """Lines of text files as they come: value."""
    return spark.readStream.format("text").option("maxFilesPerTrigger", max_files).load(path)


def scan_lines(lines: DataFrame, registry: Registry | None = None, categories: tuple[str, ...] = (), include_content: bool = False, text: str = "value") -> DataFrame:
    """Adds findings; categories: those that are kept, all if none. Works on streams and tables alike; content only where asked for."""
    reg = registry or Registry()
    if categories:
        reg = reg.for_categories(categories)
    out = with_findings(lines, reg, text)
    return out if include_content else out.drop(text)


def totals(scanned: DataFrame) -> DataFrame:
    """Running counts by category, most first in complete mode."""
    return scanned.select(F.explode_outer("findings").alias("f")).where(F.col("f").isNotNull()).groupBy(F.col("f.category").alias("category")).count()


def rate_by_window(scanned: DataFrame, time: str = "ts", size: str = "1 hour", late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Findings by window of event time and category; rows later than the watermark are left out on a stream."""
    rows = scanned.withWatermark(time, late).select(F.col(time), F.explode_outer("findings").alias("f")).where(F.col("f").isNotNull())
    w = F.window(time, size, slide) if slide else F.window(time, size)
    return rows.groupBy(w.alias("w"), F.col("f.category").alias("category")).count().select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "category", "count")


def run(df: DataFrame, name: str, mode: str = "append", checkpoint: str | None = None) -> StreamingQuery:
    """Into a memory table, all that there is."""
    w = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True)
    return (w.option("checkpointLocation", checkpoint) if checkpoint else w).start()


def run_batches(df: DataFrame, each, checkpoint: str | None = None) -> StreamingQuery:
    """each(batch, id) for every micro-batch."""
    w = df.writeStream.foreachBatch(each).trigger(availableNow=True)
    return (w.option("checkpointLocation", checkpoint) if checkpoint else w).start()


_BLANKS = (b"\n", b"\r", b" ", b"\t")


def split_at(held: bytes) -> int:
    """Where bytes are cut: after the last white space, else at the end if they are few, else at three quarters; not inside a character."""
    at = max(held.rfind(c) for c in _BLANKS) + 1
    if at:
        return at
    at = len(held) if len(held) < SMALL else len(held) * 3 // 4
    # a character that has begun in the last three bytes and isn't whole stays for the next chunk
    for back in range(1, min(4, at) + 1):
        c = held[at - back]
        if c & 0xC0 != 0x80:
            need = 4 if c >= 0xF0 else 3 if c >= 0xE0 else 2 if c >= 0xC0 else 1
            return at - back if need > back else at
    return at


def carry(held: bytes, at: int, chunk: bytes | None, max_buffer: int = MAX_BUFFER) -> tuple[list[tuple[int, str | None, str | None]], bytes, int]:
    """(byte offset, text, error) that one more chunk settles, and the bytes and the offset that wait. A chunk of None ends the stream.

    Bytes are joined before they are cut and decoded, so a character may lie in two chunks. Bad UTF-8 is an error event; the bytes of the event
    are left out, and offsets go on behind them. More than max_buffer bytes that must wait are an OverflowError.
    """
    held += chunk or b""
    cut = split_at(held) if chunk is not None else len(held)
    if len(held) - cut > max_buffer:
        raise OverflowError(f"more than {max_buffer} bytes without a place to cut")
    out: list[tuple[int, str | None, str | None]] = []
    if cut:
        try:
            out.append((at, held[:cut].decode(), None))
        except UnicodeDecodeError as e:
            out.append((at, None, f"invalid UTF-8: {e.reason}"))
    return out, held[cut:], at + cut


def chunk_texts(chunks: Iterator[bytes], max_buffer: int = MAX_BUFFER) -> Iterator[tuple[int, str | None, str | None]]:
    """carry() over all chunks of one stream."""
    held, at = b"", 0
    for c in chunks:
        out, held, at = carry(held, at, c, max_buffer)
        yield from out
    yield from carry(held, at, None, max_buffer)[0]


#: Streams are held by so many parts of a hash: a group of its own for each costs milliseconds. It is part of the state; a checkpoint holds for one number.
BUCKETS = 4096


def scan_chunks(stream: DataFrame, key: str = "stream_id", data: str = "chunk", order: str = "seq", max_buffer: int = MAX_BUFFER) -> DataFrame:
    """stream_id, byte_offset, content, error of a stream of byte chunks, with the carry-over of each stream as state.

    Add findings with scan_lines(..., text="content"). The last rest of a stream comes when a chunk is null (its end).
    """
    from pyspark.sql.streaming.state import GroupStateTimeout

    def step(k, frames, state):
        import pandas as pd

        waits = {i: (bytes(h), at) for i, h, at in zip(*state.get)} if state.exists else {}
        own: dict = {}
        for f in frames:
            for i, n, c in zip(f[key].tolist(), f[order].tolist(), f[data].tolist()):
                own.setdefault(i, []).append(((n != n, n), c))  # without a number: last
        out = []
        for i, chunks in own.items():
            held, at = waits.get(i, (b"", 0))
            for _, c in sorted(chunks, key=lambda x: x[0]):
                try:
                    done, held, at = carry(held, at, None if c is None else bytes(c), max_buffer)
                except OverflowError as e:  # what waits is given up, the stream goes on
                    size = len(held) + len(c)
                    done, held, at = [(at, None, str(e))], b"", at + size
                out += [(i, *x) for x in done]
            waits[i] = held, at
        state.update((list(waits), [h for h, _ in waits.values()], [at for _, at in waits.values()]))
        yield pd.DataFrame(out, columns=[key, "byte_offset", "content", "error"])

    parted = stream.withColumn("_bucket", F.pmod(F.xxhash64(key), F.lit(BUCKETS)))
    return parted.groupBy("_bucket").applyInPandasWithState(step, f"{key} string, byte_offset long, content string, error string", "ids array<string>, held array<binary>, at array<long>", "append", GroupStateTimeout.NoTimeout)
