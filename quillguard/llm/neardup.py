"""Near-duplicate documents by order MinHash and banded alignment.

A text is its sequence of words. Its k-mers are shingles of five words, equal ones told apart by their occurrence; a sketch takes
the `ORDER` smallest under one hash and keeps them in the order of the text, so it agrees for texts with much the same shingles
in much the same order. Texts with an equal sketch are candidates, and are verified by the best alignment of their words:
similarity is aligned / (all - aligned), where aligned is a longest common subsequence within the band of diagonals that the
threshold allows, by rows of bits. One changed word in nine leaves 0.8.

Equal texts are one class before anything else. In each group of equal sketches all are held against the smallest document
of the group. Where the components so far leave a group in pieces, pairs of different pieces are compared: all of them in a group of up to
`SMALL_GROUP` members; in others those that share one of their rarest words, which every pair of the similarity does (the prefixes that
two sets must share, in a common order of words by their counts). So no link between documents of one group is lost, and no large group is
written out as all its pairs. Before texts are read, counts of words in 256 classes bound the alignment of a pair from above.

Defined results: null, empty and wordless texts are alone; a text of fewer than five words has one shingle, the whole text; equal
documents and repeated rows are one class; class_id is the smallest doc_id of the class, kept tells whether a row is that
document; a null doc_id is alone; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, discard, drop, materialize, spread, table
from .graph import components

SHINGLE = 5
SIMILARITY = 0.8
#: With one word in nine changed at random (similarity 0.8) one sketch agrees with a chance of about 0.15, none of 24 with 0.02; at 0.85 none with 0.0015.
SKETCHES = 24
ORDER = 2
#: Members of a group in pieces up to which all pairs of different pieces are compared.
SMALL_GROUP = 32
#: Classes of words in which pairs are compared by counts first.
BAG = 256
#: Classes of words whose counts order them: an array of 2 MB, collected and broadcast.
COUNTED = 1 << 18
#: Pairs of one document that meet its text in one task.
PER_TASK = 2000
_P = np.uint64(0x9E3779B97F4A7C15)
_Q = np.uint64(0xC2B2AE3D27D4EB4F)
_SLICE = 1 << 16
_LONG = 1 << 13
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_POWERS: list[np.ndarray] = []


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)


def word_hashes(texts) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts, one after the other, and the number of words of each. texts: an Arrow array of binary."""
    from xxhash import xxh64_intdigest

    if not _POWERS:
        _POWERS.extend(np.concatenate((np.ones(1, np.uint64), np.cumprod(np.full(2 * _SLICE, p, np.uint64)))) for p in (_P, np.uint64(pow(int(_P), -1, 1 << 64))))
    power, inverse = _POWERS
    n = len(texts)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    filled = (texts.fill_null(b"") if texts.null_count else texts).cast("binary")
    _, offsets, data = filled.buffers()
    at = np.frombuffer(offsets, np.int32, n + 1, filled.offset * 4)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    out, counts = [], np.zeros(n, np.int64)
    i = 0
    while i < n:
        # as many whole texts as a slice holds, or one long text slice by slice
        j = max(i + 1, int(np.searchsorted(at, at[i] + _SLICE, "right")) - 1)
        lo, end = int(at[i]), int(at[j])
        while lo < end:
            hi = min(end, lo + _SLICE)
            if hi < end:  # only with one text
                blank = np.flatnonzero(_SPACE[raw[lo:hi]])
                if len(blank):
                    hi = lo + int(blank[-1]) + 1
                else:  # a word longer than a slice
                    k = hi
                    while k < end and not len(blank := np.flatnonzero(_SPACE[raw[k : k + _SLICE]])):
                        k += _SLICE
                    hi = min(end, k + int(blank[0])) if k < end else end
                    out.append(np.array([xxh64_intdigest(raw[lo:hi].tobytes())], np.uint64))
                    counts[i] += 1
                    lo = hi
                    continue
            b = raw[lo:hi]
            blank = _SPACE[b]
            cut = np.zeros(len(b) + 1, bool)  # a text begins
            cut[at[i:j] - lo if j > i + 1 else 0] = True
            before = np.concatenate(([True], blank[:-1])) | cut[:-1]
            after = np.append(blank[1:], True) | np.append(cut[1:-1], True)
            starts, ends = np.flatnonzero(~blank & before), np.flatnonzero(~blank & after) + 1
            total = np.concatenate((np.zeros(1, np.uint64), np.cumsum((b.astype(np.uint64) + np.uint64(1)) * power[: len(b)], dtype=np.uint64)))
            h = _mix((total[ends] - total[starts]) * inverse[starts])
            for w in np.flatnonzero(ends - starts > _LONG).tolist():
                h[w] = xxh64_intdigest(b[starts[w] : ends[w]].tobytes())
            out.append(h)
            if j > i + 1:
                counts[i:j] += np.diff(np.searchsorted(starts, at[i : j + 1] - lo))
            else:
                counts[i] += len(h)
            lo = hi
        i = j
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), counts


def words_of(text: str | None) -> np.ndarray:
    import pyarrow as pa

    return word_hashes(pa.array([None if text is None else text.encode()], pa.binary()))[0]


def shingles(w: np.ndarray, counts: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles of each text in order, one of the whole text if that has fewer words; and how many each has."""
    n = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    text = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(len(w)) - np.repeat(np.cumsum(counts) - counts, counts)
    s = w.copy()
    left = counts[text] - place
    for j in range(1, k):
        s *= _P
        if j < len(w):
            s[: len(w) - j] += np.where(left[: len(w) - j] > j, w[j:], np.uint64(0))
    return _mix(s[place < n[text]]), n


def occurrences(s: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Of each value: how many equal ones its text has before it."""
    key = _mix(s + text.astype(np.uint64) * _Q)
    by = np.argsort(key)
    new = np.concatenate(([True], key[by][1:] != key[by][:-1]))
    size = np.diff(np.append(np.flatnonzero(new), len(s)))
    out = np.zeros(len(s), np.int64)
    if (size > 1).any():
        many = np.repeat(size > 1, size)
        at, group = by[many], np.repeat(np.arange(len(size)), size)[many]
        order = np.lexsort((at, group))
        at, group = at[order], group[order]
        first = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
        out[at] = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))
    return out


def sketches(s: np.ndarray, n: np.ndarray, m: int = SKETCHES) -> np.ndarray:
    """Order MinHash of texts with n shingles each (all above 0): m hashes a text of its two smallest occurrence-labelled shingles in text order."""
    text = np.repeat(np.arange(len(n)), n)
    labelled = _mix(s + occurrences(s, text).astype(np.uint64) * _Q)
    starts = np.cumsum(n) - n
    rng = np.random.default_rng(2019)
    mul, add = rng.integers(1, 2**63, m, np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, m, np.uint64)
    out = np.empty((len(n), m), np.uint64)
    most, place = np.uint64(2**64 - 1), np.arange(m, dtype=np.uint64) * _Q

    def smallest(x):
        least = np.minimum.reduceat(x, starts)
        at = np.flatnonzero(x == np.repeat(least, n))
        return at if len(at) == len(n) else at[np.searchsorted(at, starts)]

    for j in range(m):
        x = (labelled ^ add[j]) * mul[j]
        one = smallest(x)
        x[one] = most
        two = smallest(x)
        first, second = np.minimum(one, two), np.maximum(one, two)
        z = _mix(np.minimum(n, ORDER).astype(np.uint64) * _P + s[first])
        z = np.where(n > 1, _mix(z * _P + s[second]), z)
        out[:, j] = _mix(z + place[j])
    return out


def bags(w: np.ndarray, counts: np.ndarray) -> list[bytes]:
    """Counts of the words of each text in classes."""
    text = np.repeat(np.arange(len(counts)), counts)
    b = np.bincount(text * BAG + (w >> np.uint64(56)).astype(np.int64), minlength=len(counts) * BAG).reshape(-1, BAG)
    kinds = np.where(b.max(1, initial=0) < 256, 1, 4)
    return [x.astype("u1" if k == 1 else "<u4").tobytes() for x, k in zip(b, kinds.tolist())]


def _bag(x: bytes) -> np.ndarray:
    return np.frombuffer(x, "u1" if len(x) == BAG else "<u4").astype(np.int64)


def needed(n: int, m: int, threshold: float) -> int:
    """Aligned words that two texts of n and m words need."""
    return int(np.ceil(threshold / (1 + threshold) * (n + m) - 1e-9))


def aligned(a: list[int], b: list[int], band: int) -> int:
    """Length of the longest common subsequence over diagonals within the band; exact if one lies within it."""
    n, m, done, band = len(a), len(b), 0, int(band)
    lo = 0
    while lo < min(n, m) and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < min(n, m) - lo and a[n - 1 - hi] == b[m - 1 - hi]:
        hi += 1
    a, b = a[lo : n - hi], b[lo : m - hi]
    if not a or not b:
        return lo + hi
    step, width, v, base = max(64, band), 0, 0, 0
    for r in range(0, len(a), step):
        c0, c1 = max(0, r - band), min(len(b), r + step + band)
        if c0 >= len(b):
            break
        if c0 > base:  # columns that leave the band keep what they have
            k = c0 - base
            done += min(k, width) - (v & ((1 << min(k, width)) - 1)).bit_count()
            v >>= k
            width = max(0, width - k)
            base = c0
        if c1 - base > width:
            v |= ((1 << (c1 - base - width)) - 1) << width
            width = c1 - base
        full = (1 << width) - 1
        rows = a[r : r + step]
        masks = _masks(rows, b[base:c1])
        for x in rows:
            u = v & masks[x]
            if u:
                v = ((v + u) | (v - u)) & full
    return lo + hi + done + width - v.bit_count()


def _masks(rows: list[int], columns: list[int]) -> dict[int, int]:
    """Of each value of the rows: the bits of its columns."""
    places: dict[int, list[int]] = {x: [] for x in rows}
    for j, x in enumerate(columns):
        if x in places:
            places[x].append(j)
    out = {}
    for x, at in places.items():
        if len(at) < 16:
            bits = 0
            for j in at:
                bits |= 1 << j
        else:
            flags = np.zeros(len(columns), np.uint8)
            flags[at] = 1
            bits = int.from_bytes(np.packbits(flags, bitorder="little").tobytes(), "little")
        out[x] = bits
    return out


def similarity(s: np.ndarray, t: np.ndarray, threshold: float = SIMILARITY) -> float:
    """Of the best alignment of two sequences of words if that is at least the threshold, else 0."""
    n, m = len(s), len(t)
    if not n or not m:
        return 0.0
    need = needed(n, m, threshold)
    if min(n, m) < need:
        return 0.0
    _, ids = np.unique(np.concatenate((s, t)), return_inverse=True)
    a, b = ids[:n], ids[n:]
    k = int(ids.max()) + 1
    if np.minimum(np.bincount(a, minlength=k), np.bincount(b, minlength=k)).sum() < need:
        return 0.0
    got = aligned(a.tolist(), b.tolist(), n + m - 2 * need)
    return got / (n + m - got) if got >= need else 0.0


def prepare(docs: DataFrame) -> DataFrame:
    """doc_id, digest (of the text), n (words), bag, sketches. digest is null where there are no words."""
    import pyarrow as pa

    bound_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            w, counts = word_hashes(b.column(2))
            rows = len(counts)
            bag, sk = [None] * rows, [None] * rows
            ends = np.cumsum(counts)
            i = 0
            while i < rows:  # some texts at a time, so that their arrays stay in the cache
                j = max(i + 1, int(np.searchsorted(ends, ends[i] - counts[i] + 20_000, "right")))
                on = i + np.flatnonzero(counts[i:j])
                if len(on):
                    own, c = w[ends[i] - counts[i] : ends[j - 1]], counts[on]
                    for at, x, y in zip(on.tolist(), bags(own, c), sketches(*shingles(own, c)).view(np.int64)):
                        bag[at], sk[at] = x, y
                i = j
            digest = pa.array([d if k else None for d, k in zip(b.column(1).to_pylist(), counts.tolist())], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), digest, pa.array(counts, pa.int64()), pa.array(bag, pa.binary()), pa.array(sk, pa.list_(pa.int64()))], ["doc_id", "digest", "n", "bag", "sketches"])

    own = docs.where(F.col("doc_id").isNotNull()).select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"), F.col("text").cast("binary").alias("text"))
    return own.mapInArrow(run, "doc_id long, digest string, n long, bag binary, sketches array<long>")


def possible(pairs: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose words could be aligned that far, by their counts in classes."""
    import pyarrow as pa

    one = spread(pairs, classes.select(F.col("rep").alias("a"), F.col("bag").alias("x")), "a", "b", PER_TASK)
    both = spread(one, classes.select(F.col("rep").alias("b"), F.col("bag").alias("y")), "b", "a", PER_TASK)

    def run(batches):
        for batch in batches:
            on = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                p, q = _bag(x), _bag(y)
                on[i] = np.minimum(p, q).sum() >= needed(int(p.sum()), int(q.sum()), threshold)
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(on)) for c in batch.columns[:2]], ["a", "b"])

    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def verify(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """a, b of the pairs (a, b) of documents that are similar. texts: rep, text (binary)."""
    import pyarrow as pa

    one = spread(pairs, texts.select(F.col("rep").alias("b"), F.col("text").alias("tb")), "b", "a", PER_TASK)
    both = spread(one, texts.select(F.col("rep").alias("a"), F.col("text").alias("ta")), "a", "b", PER_TASK)

    def run(batches):
        last, s = None, None
        for batch in batches:
            rows = []
            w, counts = word_hashes(batch.column(3))
            ends = np.cumsum(counts)
            for i, (x, y) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                if last != x:  # pairs of one document mostly follow each other
                    last, s = x, word_hashes(batch.column(2).slice(i, 1))[0]
                if similarity(s, w[ends[i] - counts[i] : ends[i]], threshold):
                    rows.append((x, y))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in (0, 1)], ["a", "b"])

    return both.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def prefixes(texts: DataFrame, threshold: float) -> DataFrame:
    """rep, token: the words of each text of texts (rep, text) of which two similar texts share one.

    Equal words are told apart by their occurrence. In one order of all of them, two texts of which at least a share
    `threshold` of the words is common must share one among the first n - ceil(threshold * n) + 1. Any order is right; by rising counts
    of classes of words over these texts, the first ones are rare.
    """
    import pyarrow as pa

    spark = texts.sparkSession

    def tokens(column):
        w, counts = word_hashes(column)
        text = np.repeat(np.arange(len(counts)), counts)
        return _mix(w + occurrences(w, text).astype(np.uint64) * _Q) if len(w) else w, counts

    def count(batches):
        total = np.zeros(COUNTED, np.int64)
        for b in batches:
            total += np.bincount((tokens(b.column(0))[0] % np.uint64(COUNTED)).astype(np.int64), minlength=COUNTED)
        on = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(on.astype(np.int32)), pa.array(total[on])], ["k", "n"])

    often = np.zeros(COUNTED, np.int64)
    for r in texts.select("text").mapInArrow(count, "k int, n long").groupBy("k").agg(F.sum("n").alias("n")).toLocalIterator():  # COUNTED rows at most
        often[r["k"]] = r["n"]
    sent = spark.sparkContext.broadcast(often)

    def first(batches):
        for b in batches:
            t, counts = tokens(b.column(1))
            ends, kept = np.cumsum(counts), []
            for c, e in zip(counts.tolist(), ends.tolist()):
                x = t[e - c : e]
                order = np.lexsort((x, sent.value[(x % np.uint64(COUNTED)).astype(np.int64)]))
                kept.append(x[order[: c - int(np.ceil(threshold * c - 1e-9)) + 1]].view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(kept, pa.list_(pa.int64()))], ["rep", "tokens"])

    return texts.select("rep", "text").mapInArrow(first, "rep long, tokens array<long>").select("rep", F.explode("tokens").alias("token"))


def _near_length(x: str, y: str, threshold: float) -> F.Column:
    return F.least(x, y) >= F.greatest(x, y) * F.lit(threshold)


def classify(docs: DataFrame, threshold: float = SIMILARITY, small: int = SMALL_GROUP) -> DataFrame:
    """doc_id, class_id, kept of each row of docs (doc_id, text)."""
    spark = docs.sparkSession
    prepared = materialize(prepare(docs))
    parts = ("n", "bag", "sketches")
    classes = materialize(prepared.where(F.col("digest").isNotNull()).groupBy("digest").agg(F.min(F.struct("doc_id", *parts)).alias("m")).select("digest", F.col("m.doc_id").alias("rep"), *[f"m.{c}" for c in parts]))
    slim = classes.select(F.explode("sketches").alias("g"), "rep", "n")
    heads = slim.groupBy("g").agg(F.min(F.struct("rep", "n")).alias("h"), F.count(F.lit(1)).alias("k")).where("k > 1").select("g", F.col("h.rep").alias("a"), F.col("h.n").alias("na"))
    near = _near_length("na", "n", threshold)
    star = materialize(slim.join(heads, "g").where(near & (F.col("rep") != F.col("a"))).select("a", F.col("rep").alias("b")).distinct())
    own = docs.select("doc_id", F.col("text").cast("binary").alias("text"), F.md5(F.col("text").cast("binary")).alias("digest"))
    likely = materialize(possible(star, classes, threshold))
    discard(spark)
    texts = _texts(own, classes, likely)
    first = materialize(verify(likely, texts, threshold))
    discard(spark, texts, likely)
    comps = materialize(components(first, "a", "b"))
    # groups that the components leave in pieces
    named = slim.join(comps.withColumnRenamed("node", "rep"), "rep", "left").withColumn("c", F.coalesce("component", "rep")).select("g", "rep", "n", "c")
    pieces = materialize(named.join(named.groupBy("g").agg(F.min("c").alias("c0"), F.max("c").alias("c1"), F.count(F.lit(1)).alias("k")).where("c0 < c1").select("g", "k"), "g"))
    across = lambda groups, *on: _across(groups, on, near)
    crossing = across(pieces.where(F.col("k") <= small), "g")
    large = pieces.where(F.col("k") > small)
    members = materialize(large.select(F.col("rep").alias("a"), F.col("rep").alias("b")).distinct())
    if not members.isEmpty():
        texts = _texts(own, classes, members)
        rare = large.join(prefixes(texts, threshold), "rep").select(F.xxhash64("g", "token").alias("g"), "rep", "n", "c")
        crossing = crossing.unionByName(across(rare, "g"))
    # a pair with its documents in one component already isn't here; one that was held against each other before is neither
    cross = materialize(crossing.distinct().join(star, ["a", "b"], "left_anti"))
    likely = materialize(possible(cross, classes, threshold))
    discard(spark, cross, pieces, members)
    texts = _texts(own, classes, likely)
    links = materialize(first.unionByName(verify(likely, texts, threshold)))
    discard(spark, texts, likely, star, first, comps)
    comps = components(links, "a", "b")
    named = classes.select("digest", "rep").join(comps.withColumnRenamed("node", "rep"), "rep", "left").select("digest", F.coalesce("component", "rep").alias("class_id"))
    every = docs.where(F.col("doc_id").isNull()).select("doc_id", F.lit(None).cast("string").alias("digest")).unionByName(prepared.select("doc_id", "digest"))
    return every.join(named, "digest", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("class_id")))


def _across(groups: DataFrame, on: tuple[str, ...], near) -> DataFrame:
    """Pairs (a, b) of different pieces in the groups (g, rep, n, c)."""
    left = groups.select(*on, F.col("rep").alias("a"), F.col("n").alias("na"), F.col("c").alias("ca"))
    return left.join(groups.select(*on, "rep", "n", "c"), [*on]).where((F.col("a") < F.col("rep")) & (F.col("ca") != F.col("c")) & near).select("a", F.col("rep").alias("b"))


def _texts(own: DataFrame, classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """rep, text of the documents in pairs, one row each."""
    ids = pairs.select(F.col("a").alias("rep")).unionByName(pairs.select(F.col("b").alias("rep"))).distinct()
    wanted = classes.select("rep", "digest").join(ids, "rep", "left_semi").withColumnRenamed("rep", "doc_id")
    got = own.join(wanted, ["doc_id", "digest"], "left_semi")
    return materialize(got.groupBy("doc_id", "digest").agg(F.first("text").alias("text")).select(F.col("doc_id").alias("rep"), "text"))


def deduplicate(docs: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """Rows of docs (doc_id, text): one document of each class, once; documents without doc_id stay."""
    kept = classify(docs, threshold).where(F.col("kept") & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    return docs.join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]).unionByName(docs.where(F.col("doc_id").isNull()))


def query(spark, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"))
