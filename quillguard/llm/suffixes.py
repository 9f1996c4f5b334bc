"""Removal of repeated byte strings with suffix arrays by the difference-cover algorithm.

A whole suffix array of the corpus would shuffle each byte's suffix several times over. Two steps keep to what can repeat:

1. Each window of `LENGTH` bytes has an anchor: the least hash among its grams of `GRAM` bytes. Equal windows have equal anchors,
   so a window repeats only if its anchor is found in two different texts (copies of a text are told by its hash). Anchors (one for about 15 bytes) are sorted by ranges of
   their hash; which of them repeat goes back to the documents.
2. A run of windows with one repeated anchor is a context, the bytes of those windows. All windows with one anchor meet, in
   blocks of contexts. A block is suffix-sorted by the difference cover of 3: triples at positions 1 and 2 mod 3 are sorted
   and named, their names' string is sorted by recursion, the remaining suffixes are sorted by one symbol and a rank, both
   are merged. Adjacent suffixes with a common prefix of at least `LENGTH` are one string; the smallest document of each goes back to the
   places of its context, which travel with it.

Recursion ends when names cover more than `LENGTH` bytes, as longer prefixes decide nothing here. An anchor with very many
contexts, or very long ones, is split by the windows themselves. Equal contexts are one row a task before they are shuffled.

Defined results: null text is empty; texts shorter than `LENGTH` lose nothing; a null doc_id takes no part; rows with the same doc_id lose what
smaller ones have, not each other's; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, boxed, drop, materialize, table, unboxed

LENGTH = 50
#: Shorter grams repeat by chance, the more the larger the corpus: at 0.51 GB 28 % of all windows had a repeated anchor with 16 bytes, 21 % with 24; 18 % repeat.
GRAM = 24
#: Anchors sorted at once in a task of the first step; bytes of a block (its arrays stay in the cache); contexts of one anchor, and their bytes, from which on it is split;
#: bytes of contexts that a task holds before it looks for such anchors.
FLUSH = 3_000_000
BLOCK = 50_000
LARGE_ANCHOR = 20_000
LARGE_BYTES = 2_000_000
HELD = 60_000_000
#: What difference_cover packs a symbol or a rank in; BLOCK + LARGE_BYTES stays below.
_LIMIT = 1 << 21
_P = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def grams(b: np.ndarray, k: int = GRAM) -> np.ndarray:
    """A mixed polynomial hash of each k-gram, by doubling."""
    cur, size, p, res, have = b.astype(np.uint64) + np.uint64(1), 1, _P, None, 0
    while True:
        if k & 1:
            if res is None:
                res, have = cur, size
            else:
                n = len(b) - have - size + 1
                res = res[:n] * np.uint64(p) + cur[have : have + n]
                have += size
        k >>= 1
        if not k:
            break
        n = len(cur) - size
        cur = cur[:n] * np.uint64(p) + cur[size : size + n]
        size *= 2
        p = p * p & _MASK
    x = (res ^ (res >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def anchors(text: bytes, length: int = LENGTH, k: int = GRAM) -> np.ndarray:
    """Of each window: the least hash of its grams."""
    if len(text) < length:
        return np.zeros(0, np.uint64)
    m, size, w = grams(np.frombuffer(text, np.uint8), k), 1, length - k + 1
    n = len(text) - length + 1
    while size * 2 <= w:
        m = np.minimum(m[:-size], m[size:])
        size *= 2
    r = w - size
    return np.minimum(m[: len(m) - r], m[r:])[:n] if r else m[:n]


def runs(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of runs of equal anchors."""
    edge = np.flatnonzero(a[1:] != a[:-1]) + 1
    return np.concatenate(([0], edge)).astype(np.int64), np.append(edge, len(a)).astype(np.int64)


def _keys(h: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket and 32 bits of the hash: two hashes with one key only make more candidates. Within a document the 32 bits do."""
    return ((h % np.uint64(buckets)) << np.uint64(32) | (h // np.uint64(buckets)) & np.uint64(0xFFFFFFFF)).view(np.int64)


def difference_cover(s: np.ndarray, cover: int, length: int) -> np.ndarray:
    """Suffix array of s (values from 1 below 2**21; shorter than 2**21); suffixes that agree in more than `length` bytes come in any order.

    cover: bytes that a symbol stands for.
    """
    n = len(s)
    if n >= _LIMIT or n and s.max() >= _LIMIT:
        raise ValueError(f"{n} symbols up to {s.max()}: both must be below {_LIMIT}")
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), np.int64)
    t = np.concatenate((s.astype(np.uint64), np.zeros(4, np.uint64)))
    # a dummy triple ends the first half if n is 1 mod 3
    p1, p2 = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)
    p = np.concatenate((p1, p2))
    triple = t[p] << np.uint64(42) | t[p + 1] << np.uint64(21) | t[p + 2]
    order = np.argsort(triple)
    ranked = triple[order]
    name = np.empty(len(p), np.int64)
    name[order] = np.cumsum(np.concatenate(([True], ranked[1:] != ranked[:-1])))
    if name.max() < len(p) and cover * 3 <= length:
        order = difference_cover(name, cover * 3, length)
    rank = np.zeros(n + 4, np.uint64)
    rank[p[order]] = np.arange(1, len(p) + 1)
    sa12 = p[order]
    sa12 = sa12[sa12 < n]
    p0 = np.arange(0, n, 3)
    key0 = t[p0] << np.uint64(32) | rank[p0 + 1]
    o0 = np.argsort(key0)
    sa0, key0 = p0[o0], key0[o0]
    one = sa12[sa12 % 3 == 1]
    two = sa12[sa12 % 3 == 2]
    c1 = np.searchsorted(t[one] << np.uint64(32) | rank[one + 1], key0)
    pair = lambda i: t[i] << np.uint64(42) | t[i + 1] << np.uint64(21) | rank[i + 2]
    k2 = pair(two)
    # equal beyond the length, names may be in any order; running maxima keep the merge one
    c2 = np.maximum.accumulate(np.searchsorted(np.maximum.accumulate(k2) if len(k2) else k2, pair(sa0)))
    at = np.arange(len(sa0)) + np.maximum.accumulate(c1) + c2
    out = np.empty(n, np.int64)
    free = np.ones(n, bool)
    free[at] = False
    out[at] = sa0
    out[free] = sa12
    return out


def smallest(contexts: list[bytes], docs: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one smallest document that has them in any of the contexts: context, first window, windows, document."""
    sizes = np.array([len(c) for c in contexts])
    text = np.frombuffer(b"".join(contexts), np.uint8)
    n, starts = len(text), np.concatenate(([0], np.cumsum(sizes)))
    sa = difference_cover(text.astype(np.int64) + 1, 1, length)
    padded = np.concatenate((text, np.zeros(length + 8, np.uint8)))
    eight = np.lib.stride_tricks.as_strided(padded, (n + length, 8), (1, 1)).copy().view(np.uint64).ravel()
    same = np.ones(n - 1, bool)
    a, b = sa[:-1], sa[1:]
    for k in [*range(0, length - 8, 8), length - 8]:
        same &= eight[a + k] == eight[b + k]
    owner = np.repeat(np.arange(len(contexts)), sizes)
    whole = np.arange(n) + length <= starts[owner + 1]
    doc = np.where(whole, docs[owner], np.iinfo(np.int64).max)
    group = np.flatnonzero(np.concatenate(([True], ~same)))
    least = np.empty(n, np.int64)
    least[sa] = np.repeat(np.minimum.reduceat(doc[sa], group), np.diff(np.append(group, n)))
    at = np.flatnonzero(whole)
    c, m = owner[at], least[at]
    edge = np.flatnonzero(np.concatenate(([True], (c[1:] != c[:-1]) | (m[1:] != m[:-1]))))
    return c[edge], at[edge] - starts[c[edge]], np.diff(np.append(edge, len(at))), m[edge]


def _planes(x: np.ndarray) -> bytes:
    """All first bytes, then all second ones and so on: small numbers leave long runs of zeros, which Spark's compression of shuffles takes out."""
    return x.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _unplanes(x: bytes, n: int, at: int) -> np.ndarray:
    return np.frombuffer(x, np.uint8, 4 * n, at).reshape(4, n).T.copy().view("<u4").ravel()


def _blob(docs: np.ndarray, keys: np.ndarray, known: np.ndarray) -> bytes:
    """Documents by ordinal; 32 bits of each key, ascending, as differences; ordinal, and in its lowest bit if the anchor is known to repeat."""
    own, at = np.unique(docs, return_inverse=True)
    low = keys & 0xFFFFFFFF
    return struct.pack("<II", len(own), len(keys)) + own.astype("<i8").tobytes() + _planes(np.diff(low, prepend=0)) + _planes(at << 1 | known)


def _unblob(x: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    d, n = struct.unpack_from("<II", x)
    at = _unplanes(x, n, 8 + 8 * d + 4 * n)
    return np.frombuffer(x, "<i8", d, 8)[at >> np.uint32(1)], np.cumsum(_unplanes(x, n, 8 + 8 * d), dtype=np.uint32), at & np.uint32(1) == 1


def slots(spark) -> np.ndarray:
    """For each partition of a shuffle a number that is sent there: of plain numbers of buckets, some partitions get several and others none."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tried = spark.range(20 * n + 100).select(F.col("id").cast("int").alias("v"))
    own = {r["p"]: r["v"] for r in tried.select("v", F.pmod(F.hash("v"), F.lit(n)).alias("p")).collect()}  # some 60 000 small rows at 30 GB
    return np.array([own[p] for p in range(n) if p in own])


def repeated_anchors(docs: DataFrame, slots: np.ndarray, length: int) -> DataFrame:
    """tid, key (32 bits; more than once at times) of the anchors that two different texts have. docs: tid (a hash of the text), b (bytes)."""
    import pyarrow as pa

    buckets = len(slots)

    def gather(batches):
        from pyspark import TaskContext

        # answers go to any bucket
        ds, ks, n, turn = [], [], 0, 7919 * TaskContext.get().partitionId()

        def out():
            d, k = np.concatenate(ds), np.concatenate(ks)
            order = np.lexsort((d, k))
            d, k = d[order], k[order]
            new = np.concatenate(([True], (k[1:] != k[:-1]) | (d[1:] != d[:-1])))  # copies of a text count once
            d, k = d[new], k[new]
            first = np.concatenate(([True], k[1:] != k[:-1]))
            group = np.flatnonzero(first)
            ends = np.append(group[1:], len(k))
            many = d[group] != d[ends - 1]
            # an anchor of several documents here is known to repeat: it is answered here, and one entry goes on
            known = np.repeat(many, ends - group)
            rows = [(int(slots[turn % buckets]), b"L" + d[known].astype("<i8").tobytes() + k[known].astype("<u4").tobytes())] if known.any() else []
            d, k, many = d[group], k[group], many
            bucket = k >> 32
            edge = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
            for lo, hi in zip(edge, np.append(edge[1:], len(k))):
                rows.append((int(slots[bucket[lo]]), b"A" + _blob(d[lo:hi], k[lo:hi], many[lo:hi])))
            for i in range(0, len(rows), 200):
                b, x = zip(*rows[i : i + 200])
                yield pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array(x, pa.binary())], ["bucket", "blob"])

        for b in batches:
            for doc_id, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                a = anchors(x, length)
                if len(a):
                    k = np.unique(_keys(a[np.concatenate(([True], a[1:] != a[:-1]))], buckets))
                    ks.append(k)
                    ds.append(np.full(len(k), doc_id, np.int64))
                    n += len(k)
            if n > FLUSH:
                yield from out()
                ds, ks, n, turn = [], [], 0, turn + 1
        if n:
            yield from out()

    def reduce(batches):
        bucket, held = None, []

        def out():
            d, h, known = (np.concatenate(x) for x in zip(*held))
            order = np.argsort(h, kind="stable")
            d, h, known = d[order], h[order], known[order]
            group = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
            ends = np.append(group[1:], len(h))
            dup = (np.minimum.reduceat(d, group) != np.maximum.reduceat(d, group)) | np.logical_or.reduceat(known, group)
            on = np.repeat(dup, ends - group)
            if on.any():
                yield answer(d[on], h[on])

        def answer(d, k):
            return pa.RecordBatch.from_arrays([pa.array(d.astype(np.int64)), pa.array(k.view(np.int32))], ["tid", "key"])

        for b in batches:
            for own, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if x[:1] == b"L":
                    n = len(x) // 12
                    yield answer(np.frombuffer(x, "<i8", n, 1), np.frombuffer(x, "<u4", n, 1 + 8 * n))
                    continue
                if own != bucket and held:
                    yield from out()
                    held = []
                bucket = own
                held.append(_unblob(x[1:]))
        if held:
            yield from out()

    sent = docs.select("tid", "b").mapInArrow(gather, "bucket int, blob binary")
    return sent.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(reduce, "tid long, key int")


class Contexts:
    """Different contexts with their anchors, and the places of each: document, a name, start."""

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}
        #: of the different contexts
        self.bytes = 0
        self._parts: list[tuple[np.ndarray, ...]] = []

    def add(self, contexts: list[bytes], h: np.ndarray, counts: np.ndarray, *places: np.ndarray) -> None:
        """Places follow the contexts, counts of them each."""
        before, known = len(self.known), self.known
        at = np.array([known.setdefault(x, len(known)) for x in contexts], np.int64)
        if len(known) > before:
            self.bytes += int(np.array([len(x) for x in contexts])[at >= before].sum())
        self._parts.append((at, h, np.repeat(at, counts), *places))

    def columns(self) -> tuple[list[bytes], np.ndarray, np.ndarray, list[np.ndarray]]:
        """By anchor: contexts, anchors, places of each, the places."""
        at, h, own, *places = (np.concatenate(x) for x in zip(*self._parts))
        anchor = np.empty(len(self.known), np.uint64)
        anchor[at] = h
        order = np.argsort(anchor, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        own = rank[own]
        by = np.argsort(own, kind="stable")
        every = [*self.known]
        return [every[i] for i in order.tolist()], anchor[order], np.bincount(own, minlength=len(order)), [x[by] for x in places]

    def packed(self, slots: np.ndarray):
        """Slot of the anchor, bytes for unpacked()."""
        import pyarrow as pa

        if not self.known:
            return
        contexts, h, counts, (doc, name, start) = self.columns()
        bucket = slots[(h % np.uint64(len(slots))).astype(np.int64)]
        order = np.argsort(bucket, kind="stable")
        at = np.concatenate(([0], np.cumsum(counts)))
        for i in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
            n, own = counts[i], [contexts[k] for k in i.tolist()]
            p = np.repeat(at[i] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
            x = b"".join([struct.pack("<II", len(i), len(p)), h[i].tobytes(), np.array([len(c) for c in own], "<u4").tobytes(), n.astype("<u4").tobytes(), doc[p].astype("<i8").tobytes(), name[p].astype("<i8").tobytes(), start[p].astype("<i4").tobytes(), *own])
            yield int(bucket[i[0]]), struct.pack("<Q", len(x)) + pa.compress(x, "zstd", asbytes=True)


def unpacked(x: bytes) -> tuple:
    """Arguments of Contexts.add."""
    import pyarrow as pa

    x = pa.decompress(x[8:], struct.unpack_from("<Q", x)[0], "zstd", asbytes=True)
    n, p = struct.unpack_from("<II", x)
    at, out = 8, []
    for kind, k in (("<u8", n), ("<u4", n), ("<u4", n), ("<i8", p), ("<i8", p), ("<i4", p)):
        out.append(np.frombuffer(x, kind, k, at))
        at += out[-1].nbytes
    h, sizes, counts, *places = out
    ends = at + np.cumsum(sizes, dtype=np.int64)
    return [x[s:e] for s, e in zip((ends - sizes).tolist(), ends.tolist())], h, counts.astype(np.int64), *places


def _rows(packed):
    import pyarrow as pa

    for bucket, x in packed:
        yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([x], pa.binary())], ["bucket", "blob"])


def contexts(docs: DataFrame, keys: DataFrame, slots: np.ndarray, length: int) -> DataFrame:
    """bucket, blob: the contexts of repeated anchors, once a task, with their places (doc_id, t, start).

    Of tid, which only tells texts of one doc_id apart, 32 bits go on as t.
    docs: doc_id, tid, b; keys: doc_id, tid, keys, of each text its smallest document.
    """
    joined = docs.join(keys, ["doc_id", "tid"]).select("doc_id", "b", "keys", _short("tid").alias("t"))
    most = HELD

    def run(batches):
        held, rows = Contexts(), 0
        for b in batches:
            for doc_id, x, wanted, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3).to_pylist()):
                a = anchors(x, length)
                if not len(a):
                    continue
                lo, hi = runs(a)
                on = np.isin((_keys(a[lo], len(slots)) & 0xFFFFFFFF).astype(np.uint32).view(np.int32), wanted.values.to_numpy())
                lo, hi, n = lo[on], hi[on], int(on.sum())
                if n:
                    held.add([x[s:e] for s, e in zip(lo.tolist(), (hi + length - 1).tolist())], a[lo], np.ones(n, np.int64), np.full(n, doc_id, np.int64), np.full(n, t, np.int64), lo.astype(np.int32))
                    rows += n
                if held.bytes + 150 * rows > 2 * most:
                    yield from _rows(held.packed(slots))
                    held, rows = Contexts(), 0
        yield from _rows(held.packed(slots))

    return joined.mapInArrow(run, "bucket int, blob binary")


def _short(tid: str) -> F.Column:
    return F.col(tid).bitwiseAND(F.lit((1 << 31) - 1)).cast("int")


def owners(found: DataFrame, length: int) -> DataFrame:
    """c, c2, s, n, m: the windows s .. s + n - 1 of context c, c2 of some document are first found in the smaller document m. found: h, c0, c02, context, doc."""
    own = slots(found.sparkSession)

    def run(batches):
        held = Contexts()
        for b in batches:
            h, c, c2, x, d = (np.array(k.to_pylist(), kind) for k, kind in zip(b.columns, ("i8", "i8", "i4", object, "i8")))
            held.add(x.tolist(), h.view(np.uint64), np.ones(len(h), np.int64), d, c, c2)
        yield from _rows(held.packed(own))

    packed = found.select("h", "c0", "c02", "context", "doc").mapInArrow(run, "bucket int, blob binary")
    return settled(packed, length)[0].select(F.col("name").alias("c"), F.col("start").alias("c2"), "s", "n", "m")


def settled(packed: DataFrame, length: int) -> tuple[DataFrame, list[DataFrame]]:
    """doc, name, start, s, n, m: windows s .. s + n - 1 of the context at that place are first found in the smaller document m; and the tables it is read from."""
    import pyarrow as pa

    schema = pa.schema([("doc", pa.int64()), ("name", pa.int64()), ("start", pa.int32()), ("s", pa.int32()), ("n", pa.int32()), ("m", pa.int64()), ("context", pa.binary()), ("places", pa.binary())])
    large_anchor, large_bytes, most = LARGE_ANCHOR, LARGE_BYTES, HELD

    def emit(columns):
        for i in range(0, len(columns[0]), 50_000):
            own = [pa.array(x[i : i + 50_000], f.type) for x, f in zip(columns, schema)]
            yield pa.RecordBatch.from_arrays(own + [pa.nulls(len(own[0]), f.type) for f in [*schema][6:]], schema=schema)

    def settle(held: Contexts, hot: set[int], last: bool):
        """Rows of what is settled; what waits for more."""
        texts, h, counts, places = held.columns()
        doc, name, start = places
        at = np.concatenate(([0], np.cumsum(counts)))
        least, greatest = np.minimum.reduceat(doc, at[:-1]), np.maximum.reduceat(doc, at[:-1])
        sizes = np.array([len(x) for x in texts])
        group = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
        ends = np.append(group[1:], len(h))
        # a context that is alone with its anchor is settled, however long it is
        large = (ends - group > 1) & ((ends - group > large_anchor) | (np.add.reduceat(sizes, group) > large_bytes))
        large |= np.isin(h[group], np.array([*hot], np.uint64))
        hot.update(h[group[large]].tolist())
        for lo, hi in zip(group[large].tolist(), ends[large].tolist()):
            for i in range(lo, hi, 100):
                part = range(i, min(hi, i + 100))
                own = [doc[at[k] : at[k + 1]].tobytes() + name[at[k] : at[k + 1]].tobytes() + start[at[k] : at[k + 1]].tobytes() for k in part]
                yield pa.RecordBatch.from_arrays([pa.array(least[part.start : part.stop]), *[pa.nulls(len(part), f.type) for f in [*schema][1:6]], pa.array([texts[k] for k in part], pa.binary()), pa.array(own, pa.binary())], schema=schema)
        if not last:
            kept = Contexts()
            for lo, hi in zip(group[~large].tolist(), ends[~large].tolist()):
                kept.add(texts[lo:hi], h[lo:hi], counts[lo:hi], *[x[at[lo] : at[hi]] for x in places])
            return kept

        def hits(c, s, n, m):
            on = m < greatest[c]
            c, s, n, m = c[on], s[on], n[on], m[on]
            k = counts[c]
            p = np.repeat(at[c] - np.concatenate(([0], np.cumsum(k)[:-1])), k) + np.arange(k.sum()) if len(c) else np.zeros(0, np.int64)
            s, n, m = np.repeat(s, k), np.repeat(n, k), np.repeat(m, k)
            on = doc[p] > m
            p = p[on]
            yield from emit((doc[p], name[p], start[p], s[on], n[on], m[on]))

        alone = group[(ends - group == 1) & ~large]
        yield from hits(alone, np.zeros(len(alone), np.int64), sizes[alone] - length + 1, least[alone])
        block: list[int] = []
        size = 0
        several = (ends - group > 1) & ~large
        done: list[tuple[np.ndarray, ...]] = []
        for lo, hi in [*zip(group[several].tolist(), ends[several].tolist()), (0, 0)]:
            if block and (size > BLOCK or not hi):
                own = np.array(block)
                c, s, n, m = smallest([texts[k] for k in block], least[own], length)
                done.append((own[c], s, n, m))
                block, size = [], 0
            block += range(lo, hi)
            size += int(sizes[lo:hi].sum())
        if done:
            yield from hits(*(np.concatenate(x) for x in zip(*done)))
        return None

    def run(batches):
        now, held, hot, wait = None, Contexts(), set(), most
        for b in batches:
            for bucket, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if bucket != now:
                    if held.known:
                        yield from settle(held, hot, True)
                    now, held, hot, wait = bucket, Contexts(), set(), most
                held.add(*unpacked(x))
                if held.bytes > wait:  # contexts of large anchors go on, so that they don't gather here
                    held = yield from settle(held, hot, False)
                    wait = held.bytes + most
        if held.known:
            yield from settle(held, hot, True)

    kinds = "doc long, name long, start int, s int, n int, m long, context binary, places binary"
    found = _step(packed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, kinds))
    normal = found.where("context is null").drop("context", "places")
    large = found.where("context is not null").select(F.md5("context").alias("c"), "context", "doc", "places")
    if large.isEmpty():
        return normal, [found]

    def cut(batches):
        for b in batches:
            for c, x, d in zip(*(k.to_pylist() for k in b.columns)):
                every = np.lib.stride_tricks.sliding_window_view(np.frombuffer(x, np.uint8), length)
                for i in range(0, len(every), 20_000):
                    w = np.ascontiguousarray(every[i : i + 20_000])
                    n = len(w)
                    rows = pa.FixedSizeBinaryArray.from_buffers(pa.binary(length), n, [None, pa.py_buffer(w)]).cast(pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array([c] * n), pa.array(np.arange(i, i + n, dtype=np.int32)), pa.array(np.full(n, d, np.int64)), rows], ["c", "s", "doc", "w"])

    def spread_places(batches):
        for b in batches:
            for c, x in zip(*(k.to_pylist() for k in b.columns)):
                n = len(x) // 20
                own = [np.frombuffer(x, "<i8", n), np.frombuffer(x, "<i8", n, 8 * n), np.frombuffer(x, "<i4", n, 16 * n)]
                for i in range(0, n, 50_000):
                    part = [pa.array(k[i : i + 50_000]) for k in own]
                    yield pa.RecordBatch.from_arrays([pa.array([c] * len(part[0])), *part], ["c", "doc", "name", "start"])

    # one row a window, its bytes themselves, for the few anchors with very many contexts or very long ones
    split = large.groupBy("c").agg(F.first("context").alias("context"), F.min("doc").alias("doc"))
    windows = split.mapInArrow(cut, "c string, s int, doc long, w binary")
    least = windows.groupBy("w").agg(F.min("doc").alias("m"))
    first = windows.join(least, "w").select("c", "s", F.lit(1).alias("n"), "m")
    places = large.select("c", "places").mapInArrow(spread_places, "c string, doc long, name long, start int")
    rest = places.join(first, "c").where("doc > m").select("doc", "name", "start", "s", "n", "m")
    return normal.unionByName(rest), [found]


def _step(df: DataFrame) -> DataFrame:
    """materialize(); the step's shuffle files go with its end, not when the driver's garbage is collected."""
    conf, key = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(key, "false")
    conf.set(key, "true")
    try:
        return materialize(df)
    finally:
        conf.set(key, before)


def removals(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, t (32 bits of tid), windows (start and number of successive windows that a smaller document has, 32 bits each). docs: doc_id, tid, b (bytes).

    A copy of a smaller document loses all; so only the smallest document of each text takes part in the search.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    own = slots(spark)
    slim = _step(docs.where(F.length("b") >= length).select("doc_id", "tid", F.md5("b").alias("digest"), F.length("b").alias("size")).distinct())
    texts = slim.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.first("tid").alias("tid"))
    copies = slim.join(texts.select("digest", F.col("doc_id").alias("first")), "digest").where("doc_id > first")
    by_text = repeated_anchors(docs, own, length).groupBy("tid").agg(F.collect_list("key").alias("keys"))  # no more than the text has windows
    keys = _step(by_text.join(texts.select("doc_id", "tid"), "tid"))
    hits, stored = settled(contexts(docs, keys, own, length), length)
    drop(keys)
    found = hits.select(F.col("doc").alias("doc_id"), F.col("name").cast("int").alias("t"), (F.shiftleft((F.col("start") + F.col("s")).cast("long"), 32) + F.col("n")).alias("w"))
    whole = copies.select("doc_id", _short("tid").alias("t"), F.array((F.col("size") - (length - 1)).cast("long")).alias("windows"))
    out = _step(found.groupBy("doc_id", "t").agg(F.collect_list("w").alias("windows")).unionByName(whole))
    drop(slim, *stored)
    return out


def spans(windows: np.ndarray, length: int = LENGTH) -> list[tuple[int, int]]:
    """Maximal runs of bytes covered by windows (start in the upper, number in the lower 32 bits)."""
    if not len(windows):
        return []
    w = np.sort(windows)
    s = w >> 32
    e = np.maximum.accumulate(s + (w & 0xFFFFFFFF) + length - 1)
    first = np.flatnonzero(np.concatenate(([True], s[1:] > e[:-1])))
    return [*zip(s[first].tolist(), e[np.append(first[1:], len(w)) - 1].tolist())]


def remove(docs: DataFrame, columns: dict[str, str], make, length: int = LENGTH, carried: tuple[str, ...] = ()) -> DataFrame:
    """doc_id and the carried columns of docs (doc_id, text), and make(bytes, spans, kept bytes) -> tuple in columns of those kinds."""
    import pyarrow as pa

    own = docs.select("doc_id", F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("b"), *carried).withColumn("tid", F.xxhash64("b"))
    found = removals(own.where(F.col("doc_id").isNotNull()).select("doc_id", "tid", "b"), length)
    kinds = {"long": pa.int64(), "string": pa.string(), "array<struct<s:int,e:int>>": pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))}

    def run(batches):
        for b in batches:
            rows = []
            for x, windows in zip(b.column(1).to_pylist(), b.column(2)):
                cut = spans(windows.values.to_numpy(), length) if windows.is_valid else []
                kept, at = [], 0
                for s, e in cut:
                    kept.append(x[at:s])
                    at = e
                kept.append(x[at:])
                rows.append(make(x, cut, b"".join(kept)))
            yield pa.RecordBatch.from_arrays([b.column(0), *b.columns[3:], *[pa.array([r[i] for r in rows], kinds[k]) for i, k in enumerate(columns.values())]], ["doc_id", *carried, *columns])

    rest = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*carried).schema]
    return own.withColumn("t", _short("tid")).join(found, ["doc_id", "t"], "left").select("doc_id", "b", "windows", *carried).mapInArrow(run, ", ".join(["doc_id long", *rest, *[f"{n} {k}" for n, k in columns.items()]]))


def without_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """docs (doc_id, text, n_chars and others) with the rest of each text; a character of which a byte goes, goes whole."""

    def make(x, cut, kept):
        text = kept.decode("utf-8", "ignore")
        return text, len(text)

    apart = ("doc_id", "text", "n_chars")
    cut = remove(boxed(docs, *apart), {"text": "string", "n_chars": "long"}, make, length, ("__row",))
    return unboxed(cut, docs.columns, *apart)


def digest(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    def make(x, cut, kept):
        return len(x), sum(e - s for s, e in cut), len(cut), hashlib.sha256(kept).hexdigest()

    return remove(docs, {"n_bytes": "long", "n_removed": "long", "n_spans": "long", "kept_sha256": "string"}, make, length)


def query(spark, sf_dir: str) -> DataFrame:
    return digest(table(spark, sf_dir, "documents"))
