"""Quality rules and line labelling with a linear-chain conditional random field.

The lines of a text that hold a word are a chain; each is content or boilerplate. The field has weights for features of a
line (length, shares of symbols, capitals, digits and marks, repetition, its end) and for pairs of neighbouring labels.

It is trained by maximum likelihood (forward-backward) on a bounded sample of the documents of `labels`. A document's quality says
little about a single line, so lines have weak labels: lines of good documents are content unless they repeat; lines of bad documents are
boilerplate if they show it themselves (symbols, capitals, repetition, stutter, menu-like shortness); all others stay open, and the likelihood sums
over their labels. Chains are spliced from runs of lines of good and bad documents, so labels change within them. Viterbi
decoding labels the lines of every text; the share of its characters in content lines decides.

The sample: about `max_docs` labelled documents by a hash of their ids (a documented bound), whole texts.

Defined results: null and empty texts have 0 words and fail the base rules; a text without a word has no lines to label and a content
share of 0; without labels, fixed weights are used; repeated rows get the same answer; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, bound_batches, table

MIN_WORDS = 20
#: Percent of the words that may lie in repeated windows.
MAX_REPEATED = 30
WINDOW = 8
MIN_CONTENT = 0.5
MAX_DOCS = 2500
_WORDS = re.compile(WORD)
SYMBOLS = "#*$%&|<>"
FEATURES = ("one", "words", "short", "symbols", "capitals", "digits", "marks", "word_length", "ends", "repeats", "stutter", "last")


def _classes() -> np.ndarray:
    """Bits by code point below 65536: 1 space, 2 symbol, 4 capital, 8 digit, 16 letter, 32 mark."""
    t = np.zeros(65536, np.uint8)
    for c in range(65536):
        x = chr(c)
        k = unicodedata.category(x)
        t[c] = (c == 32 or 9 <= c <= 13) | (x in SYMBOLS) << 1 | (k == "Lu") << 2 | (k == "Nd") << 3 | k.startswith("L") << 4 | (k[0] in "PS") << 5
    return t


_TABLE: np.ndarray | None = None


@dataclass
class Measures:
    n_words: int = 0
    word_chars: int = 0
    n_symbols: int = 0
    n_dup_lines: int = 0
    n_repeat_words: int = 0
    #: Characters in words of each line with a word, and its features.
    chars: np.ndarray | None = None
    x: np.ndarray | None = None

    @property
    def base_failed(self) -> bool:
        return self.n_words < MIN_WORDS or 100 * self.n_repeat_words > MAX_REPEATED * self.n_words


def _hashes(words: list[str]) -> np.ndarray:
    return np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)


def repeated_words(words: list[str], window: int = WINDOW, h: np.ndarray | None = None) -> int:
    """Words that lie in windows found twice or more."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    h = _hashes(words) if h is None else h
    w = h[:n].copy()
    for k in range(1, window):
        w *= np.uint64(0x9E3779B97F4A7C15)
        w += h[k : n + k]
    order = np.argsort(w, kind="stable")
    s = w[order]
    same = s[1:] == s[:-1]
    if not same.any():
        return 0
    hit = np.zeros(n, bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    at = np.flatnonzero(hit)
    seen: dict[tuple, int] = {}
    keys = [tuple(words[i : i + window]) for i in at.tolist()]  # equal hashes are held against the words themselves
    for k in keys:
        seen[k] = seen.get(k, 0) + 1
    cover = np.zeros(len(words) + 1, np.int64)
    for i, k in zip(at.tolist(), keys):
        if seen[k] > 1:
            cover[i] += 1
            cover[i + window] -= 1
    return int((np.cumsum(cover) > 0).sum())


def measure(text: str | None) -> Measures:
    global _TABLE
    if not text:
        return Measures()
    if _TABLE is None:
        _TABLE = _classes()
    words = _WORDS.findall(text)
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    k = _TABLE[np.minimum(c, 65535)]
    space = (k & 1).astype(bool)
    newline = np.flatnonzero(c == 10)
    starts = np.concatenate(([0], newline + 1))
    ends = np.concatenate((newline, [len(c)]))

    def per_line(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(mask, dtype=np.int64)))
        return total[ends] - total[starts]

    begins = ~space
    begins[1:] &= space[:-1]
    line_words = per_line(begins)
    full = line_words > 0
    m = Measures(len(words), int((~space).sum()), int(((k & 2) > 0).sum()))
    h = _hashes(words)
    m.n_repeat_words = repeated_words(words, h=h)
    lines = text.split("\n")
    seen: set[str] = set()
    repeats = np.zeros(len(lines), bool)
    for i in np.flatnonzero(full).tolist():
        if lines[i] in seen:
            repeats[i] = True
        else:
            seen.add(lines[i])
    m.n_dup_lines = int(repeats.sum())
    if not full.any():
        return m
    chars = per_line(~space)[full]
    n = line_words[full]
    letters = np.maximum(per_line((k & 16) > 0)[full], 1)
    x = np.zeros((len(n), len(FEATURES)), np.float32)
    last = c[np.maximum(ends[full] - 1, 0)]
    x[:, 0] = 1
    x[:, 1] = np.minimum(n, 12) / 12
    x[:, 2] = n < 4
    x[:, 3] = np.minimum(per_line((k & 2) > 0)[full] / chars * 5, 3)
    x[:, 4] = per_line((k & 4) > 0)[full] / letters
    x[:, 5] = per_line((k & 8) > 0)[full] / chars
    x[:, 6] = np.minimum(per_line((k & 32) > 0)[full] / chars * 5, 3)
    x[:, 7] = np.minimum(chars / n / 10, 3)
    x[:, 8] = np.isin(last, [46, 33, 63, 58])
    x[:, 9] = repeats[full]
    same = np.flatnonzero(h[1:] == h[:-1]) + 1  # words equal to the one before
    x[:, 10] = np.bincount(np.searchsorted(np.cumsum(n), same, "right"), minlength=len(n)) / n * 3
    x[-1, 11] = 1
    m.chars, m.x = chars, x
    return m


@dataclass
class Field:
    """w: for the label content, of each feature; t: of each pair of labels (boilerplate 0, content 1)."""

    w: np.ndarray
    t: np.ndarray

    def decode(self, x: np.ndarray) -> np.ndarray:
        """Viterbi: the most probable labels."""
        emit = (x @ self.w).tolist()
        (t00, t01), (t10, t11) = self.t.tolist()
        a, b, back = 0.0, emit[0], []
        for e in emit[1:]:
            p, q = a + t00 >= b + t10, a + t01 >= b + t11
            back.append((p, q))
            a, b = (a + t00 if p else b + t10), (a + t01 if q else b + t11) + e
        y = [int(b >= a)]
        for p, q in reversed(back):
            y.append(0 if (q if y[-1] else p) else 1)
        return np.array(y[::-1], bool)

    def share(self, m: Measures) -> float:
        """Of a text's characters in words, those in content lines."""
        return float(m.chars[self.decode(m.x)].sum() / m.chars.sum()) if m.x is not None else 0.0


#: Without labelled documents: content unless symbols or capitals prevail or a line repeats.
DEFAULT = Field(np.array([2.0, 1, -1, -2, -4, -2, -0.5, 0, 0.5, -2, 0, 0], np.float32), np.array([[0.5, -0.5], [-0.5, 0.5]], np.float32))


def weak_labels(x: np.ndarray, quality: int) -> np.ndarray:
    """Of each line of a document: 1 content, 0 boilerplate, -1 open."""
    if quality:
        return np.where(x[:, 9] > 0, -1, 1)
    shows = (x[:, 3] > 0.1) | (x[:, 4] > 0.5) | (x[:, 9] > 0) | (x[:, 10] > 0.3) | ((x[:, 2] > 0) & (x[:, 8] == 0))
    return np.where(shows, 0, -1)


def splice(docs: list[tuple[np.ndarray, int]], longest: int = 16, runs: int = 6) -> list[tuple[np.ndarray, np.ndarray]]:
    """Chains of `runs` runs, in turn of good and bad documents: features and weak labels. Runs of the fewer ones come again."""
    rng = np.random.default_rng(5)
    kinds: tuple[list, list] = [], []
    for x, q in docs:
        y, at = weak_labels(x, q), 0
        while at < len(x):
            n = int(rng.integers(1, longest + 1))
            kinds[q].append((x[at : at + n], y[at : at + n]))
            at += n
    if not (kinds[0] and kinds[1]):
        return []
    n = max(map(len, kinds))
    order = [[k[i % len(k)] for i in rng.permutation(-(-n // len(k)) * len(k))[:n]] for k in kinds]
    mixed = [r for pair in zip(*order) for r in pair]
    return [tuple(np.concatenate(z) for z in zip(*mixed[i + i // runs % 2 : i + i // runs % 2 + runs])) for i in range(0, len(mixed) - 1, runs)]


def _marginals(e: np.ndarray, t: np.ndarray, on: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each line: the chance of content; of each two neighbours: the chances of their labels. e: scores of the labels, on: lines that exist."""
    n, long, _ = e.shape
    t = np.exp(t - t.max())
    # the labels apart, places first: each step is on whole rows
    e = np.ascontiguousarray(np.exp(e - e.max(2, keepdims=True)).transpose(2, 1, 0))
    on = np.ascontiguousarray(on.T)
    f, b = np.empty((2, long, n)), np.ones((2, long, n))
    f[:, 0] = e[:, 0] / (e[0, 0] + e[1, 0])
    for i in range(1, long):  # scaled to a sum of 1 each time
        x, y = f[:, i - 1]
        u, v = (x * t[0, 0] + y * t[1, 0]) * e[0, i], (x * t[0, 1] + y * t[1, 1]) * e[1, i]
        z = u + v
        f[0, i], f[1, i] = np.where(on[i], u / z, x), np.where(on[i], v / z, y)
    for i in range(long - 2, -1, -1):
        x, y = b[:, i + 1] * e[:, i + 1]
        u, v = x * t[0, 0] + y * t[0, 1], x * t[1, 0] + y * t[1, 1]
        z = u + v
        b[0, i], b[1, i] = np.where(on[i + 1], u / z, 1), np.where(on[i + 1], v / z, 1)
    x, y = f * b
    one = (y / (x + y) * on).T
    b *= e
    pair = np.stack([[f[j, :-1] * t[j, k] * b[k, 1:] for k in (0, 1)] for j in (0, 1)])
    pair = (pair * (on[1:] / pair.sum((0, 1)))).transpose(3, 2, 0, 1)
    return one, pair


def train(chains: list[tuple[np.ndarray, np.ndarray]], steps: int = 150, ridge: float = 1e-3) -> Field:
    """chains: features of the lines and their labels, -1 where open. Adam on the likelihood of the labels that are known."""
    if len({int(v) for _, y in chains for v in np.unique(y)} & {0, 1}) < 2:
        return DEFAULT
    n, long = len(chains), max(len(x) for x, _ in chains)
    x = np.concatenate([p for p, _ in chains]).astype(np.float64)
    on, barred, e = np.zeros((n, long), bool), np.zeros((n, long, 2)), np.zeros((n, long, 2))
    for i, (p, y) in enumerate(chains):
        on[i, : len(p)] = True
        for k in (0, 1):
            barred[i, : len(p), k][y == 1 - k] = -1e4
    size = len(x)
    w, t = np.zeros(len(FEATURES)), np.zeros((2, 2))
    m1, m2 = np.zeros(len(w) + 4), np.zeros(len(w) + 4)
    for step in range(1, steps + 1):
        e[on, 1] = x @ w
        free, known = _marginals(e, t, on), _marginals(e + barred, t, on)
        gw = (known[0] - free[0])[on] @ x / size
        gt = (known[1] - free[1]).sum((0, 1)) / size
        g = np.concatenate([gw - ridge * w, (gt - ridge * t).ravel()])
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.99 * m2 + 0.01 * g * g
        d = 0.15 * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-8)
        w, t = w + d[:-4], t + d[-4:].reshape(2, 2)
    return Field(w.astype(np.float32), t.astype(np.float32))


def fit(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS) -> Field:
    """Trains on docs (doc_id, text) with labels (doc_id, quality 0 or 1)."""
    import pyarrow as pa

    bound_batches(docs.sparkSession)
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    counts = known.groupBy("quality").count().collect()  # two rows
    h = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(3)), F.lit(1 << 30))
    pick = F.lit(False)
    for r in counts:
        pick = pick | ((F.col("quality") == r["quality"]) & (h < int(min(1.0, max_docs / 2 / r["count"]) * (1 << 30))))
    # about max_docs rows of two numbers
    sample = F.broadcast(known.where(pick))

    def run(batches):
        for b in batches:
            rows = [(int(y), m.x.tobytes()) for y, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if (m := measure(t)).x is not None]
            yield pa.RecordBatch.from_arrays([pa.array([y for y, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.binary())], ["quality", "x"])

    got = docs.select("doc_id", "text").join(sample, "doc_id").select("quality", "text").mapInArrow(run, "quality int, x binary").collect()  # bounded by the sample
    return train(splice([(np.frombuffer(r["x"], np.float32).reshape(-1, len(FEATURES)), r["quality"]) for r in sorted(got, key=lambda r: (r["quality"], bytes(r["x"])))]))


def judge(docs: DataFrame, field: Field, min_content: float = MIN_CONTENT) -> DataFrame:
    """Per row of docs (doc_id, text): its measures, base_failed, content_share, kept."""
    import pyarrow as pa

    bound_batches(docs.sparkSession)
    numbers = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches):
        for b in batches:
            ms = [measure(t) for t in b.column(1).to_pylist()]
            share = [field.share(m) for m in ms]
            failed = [m.base_failed for m in ms]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *[pa.array([getattr(m, n) for m in ms], pa.int64()) for n in numbers], pa.array(failed, pa.bool_()), pa.array(share, pa.float64()), pa.array([not f and s >= min_content for f, s in zip(failed, share)], pa.bool_())],
                ["doc_id", *numbers, "base_failed", "content_share", "kept"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, " + ", ".join(f"{n} long" for n in numbers) + ", base_failed boolean, content_share double, kept boolean")


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return judge(docs, fit(docs, table(spark, sf_dir, "labels")))
