"""Packing by minimum bin slack.

Documents are cut into full windows and one remainder each. What is left to pack depends on the lengths alone, and there
are fewer lengths than the capacity; so the plan is made from the histogram of the lengths, on the driver, at any size of
the corpus. Each pattern starts from the longest remaining piece; a bitset of reachable sums (a Python integer) over the
remaining lengths with their counts gives the fill closest to capacity, the counts are read back from the sums that were
reachable before each item, and the pattern is used as often as the counts allow, which uses up a length. Pieces then take
the places of their length by their rank, computed in ranges of a hash so that a common length isn't one task.

Defined results: null text is the empty text (one end id); repeated rows are documents of their own, told apart by the
order of their pieces; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, hot_safe_rank, materialize, sql_text, table

CAPACITY = 2048
END_ID = 1
PER_BUCKET = 50_000


def best_fill(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """Length -> count, at most counts, with the largest sum up to capacity."""
    full, reach, steps = (1 << (capacity + 1)) - 1, 1, []
    for length in sorted((x for x in counts if x <= capacity and counts[x]), reverse=True):
        left, k = min(counts[length], capacity // length), 1
        while left and not reach >> capacity & 1:
            k = min(k, left)
            steps.append((reach, length, k))
            reach |= reach << (length * k) & full
            left -= k
            k *= 2
        if reach >> capacity & 1:
            break
    at, used = reach.bit_length() - 1, {}
    for before, length, k in reversed(steps):
        if not before >> at & 1:
            used[length] = used.get(length, 0) + k
            at -= length * k
    return used


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, dict[int, int]]]:
    """(times, length -> count) of each pattern, until no piece is left."""
    counts, patterns = {k: v for k, v in histogram.items() if v > 0}, []
    while counts:
        seed = max(counts)
        rest = counts | {seed: counts[seed] - 1}
        p = best_fill(rest, capacity - seed)
        p[seed] = p.get(seed, 0) + 1
        times = min(counts[x] // n for x, n in p.items())
        patterns.append((times, p))
        for x, n in p.items():
            counts[x] -= n * times
            if not counts[x]:
                del counts[x]
    return patterns


def places(patterns: list[tuple[int, dict[int, int]]]) -> dict[int, list[tuple[int, int, int, int, int]]]:
    """By length: (first rank, pieces a sequence, first sequence, offset of the first piece there, ...), in order of rank."""
    out: dict[int, list[tuple[int, int, int, int]]] = {}
    ranks: dict[int, int] = {}
    sequence = 0
    for times, p in patterns:
        offset = 0
        for length in sorted(p, reverse=True):
            out.setdefault(length, []).append((ranks.get(length, 0), p[length], sequence, offset))
            ranks[length] = ranks.get(length, 0) + p[length] * times
            offset += length * p[length]
        sequence += times
    return out


def cut(docs: DataFrame, encode, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens of every piece of docs (doc_id, text)."""
    import pyarrow as pa

    bound_batches(docs.sparkSession)
    end = end_id.to_bytes(4, "little")
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]

    def pieces(batches):
        enc = encode()
        for b in batches:
            rows = []
            for doc_id, ids in zip(b.column(0).to_pylist(), enc(b.column(1).to_pylist())):
                ids += end
                n = len(ids) // 4
                rows += [(doc_id, s, min(capacity, n - s), zlib.crc32(ids[4 * s : 4 * (s + capacity)]), n) for s in range(0, n, capacity)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names)

    return docs.select("doc_id", sql_text("text").alias("text")).mapInArrow(pieces, ", ".join(f"{n} long" for n in names))


def pack(docs: DataFrame, encode, capacity: int = CAPACITY, end_id: int = END_ID, per_bucket: int = PER_BUCKET) -> DataFrame:
    """Each piece with its sequence_id and offset. encode: as for write_records."""
    import pyarrow as pa

    parts = materialize(cut(docs, encode, capacity, end_id))
    counts = parts.groupBy("length").agg(F.count(F.lit(1)).alias("_n"))
    # at most `capacity` rows
    where = places(plan({r["length"]: r["_n"] for r in counts.collect()}, capacity))
    hashed = parts.withColumn("_h", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(2**32)))
    ranked = hot_safe_rank(hashed, ["length"], [F.col("doc_id"), F.col("start"), F.col("ids_crc32"), F.col("doc_tokens")], per_bucket, counts, "_rank")
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]

    def assign(batches):
        import numpy as np

        tables = {k: np.array(v, "i8").T for k, v in where.items()}
        for b in batches:
            lengths, rank = (b.column(b.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in ("length", "_rank"))
            seq, off = np.empty(len(rank), "i8"), np.empty(len(rank), "i8")
            order = np.argsort(lengths, kind="stable")
            edges = np.flatnonzero(np.diff(lengths[order], prepend=-1))
            for lo, hi in zip(edges, [*edges[1:], len(order)]):
                own = order[lo:hi]
                length = int(lengths[own[0]])
                first, each, sequence, offset = tables[length]
                k = np.searchsorted(first, rank[own], "right") - 1
                d = rank[own] - first[k]
                seq[own] = sequence[k] + d // each[k]
                off[own] = offset[k] + d % each[k] * length
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index(n)) for n in names] + [pa.array(seq), pa.array(off)], [*names, "sequence_id", "offset"])

    return ranked.mapInArrow(assign, ", ".join(f"{n} long" for n in [*names, "sequence_id", "offset"]))


def default_encoder(part: float = 1):
    """part: of the memory for kept pieces."""
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")

    def encode():
        from quillguard.llm.encoding import WORD_PIECES, CachedEncoder

        return CachedEncoder.of(path, WORD_PIECES, part).encode_many

    return encode


def query(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), default_encoder())
