"""Language identification with error-correcting output codes.

Each language has a codeword; for each bit of it a binary logistic classifier over hashed byte n-grams (1 to 3 bytes of the
lower-case text, other than letters as spaces) is trained on a bounded sample of the documents with a language. A text gets
the codeword with the least loss, the bits weighted by how well their classifiers do on a held-back fifth of the sample;
the loss of the second best says whether the choice is ambiguous.

The sample: at most about `per_language` documents of each language, by a hash of the id (a documented bound; all texts are
read whole). Prediction sees the text alone.

Defined results: `und` with score 0 for null, empty and letterless texts, and for all texts where no document has a
language; repeated rows get the same answer; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, boxed, table, unboxed

DIMS = 1 << 13
PER_LANGUAGE = 1200
#: A best posterior below this is ambiguous.
CERTAIN = 0.55
UNDETERMINED = "und"
_LETTER = re.compile(r"[^\W\d_]")
_FOLD = np.array([b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], np.uint8)


def features(text: str) -> np.ndarray:
    """Square roots of the n-gram counts, of norm 1."""
    b = _FOLD[np.frombuffer(text.lower().encode(), np.uint8)].astype(np.uint32)
    x = np.bincount(b, minlength=DIMS).astype(np.float32)
    if len(b) > 1:
        two = b[:-1] * np.uint32(257) + b[1:]
        x += np.bincount((two * np.uint32(2654435761)) >> np.uint32(19), minlength=DIMS)
        if len(b) > 2:
            three = two[:-1] * np.uint32(257) + b[2:] + np.uint32(1 << 24)
            x += np.bincount((three * np.uint32(2246822519)) >> np.uint32(19), minlength=DIMS)
    np.sqrt(x, out=x)
    return x / np.float32(max(1e-9, np.sqrt(float(x @ x))))


def codewords(k: int) -> np.ndarray:
    """k rows of +-1: all columns that differ up to k = 5, else the best of some random codes by least distance."""
    if k <= 5:
        bits = max(1, 2 ** (k - 1) - 1)
        return np.array([[1 if r == 0 or not (c + 1) >> (r - 1) & 1 else -1 for c in range(bits)] for r in range(k)], np.float32)
    rng, bits, best, far = np.random.default_rng(7), int(np.ceil(10 * np.log2(k))), None, -1
    for _ in range(60):
        c = rng.choice(np.array([-1, 1], np.float32), (k, bits))
        d = (bits - c @ c.T) / 2 + np.eye(k) * bits
        ok = np.abs(c.sum(0)).max() < k
        if ok and d.min() > far:
            best, far = c, d.min()
    return best


@dataclass
class Model:
    languages: list[str]
    codes: np.ndarray
    w: np.ndarray
    b: np.ndarray
    weights: np.ndarray

    def losses(self, x: np.ndarray) -> np.ndarray:
        """Of each codeword."""
        margins = (x @ self.w + self.b)[..., None, :] * self.codes
        return np.logaddexp(0, -margins) @ self.weights

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score, ambiguous."""
        if not text or not self.languages or not _LETTER.search(text):
            return UNDETERMINED, 0.0, True
        d = self.losses(features(text))
        p = np.exp(d.min() - d)
        i = int(d.argmin())
        score = float(1 / p.sum())
        return self.languages[i], score, score < CERTAIN


def train(examples: list[tuple[str, np.ndarray]], epochs: int = 12) -> Model:
    """examples: language and features, in any order."""
    languages = sorted({k for k, _ in examples})
    if not languages:
        return Model([], np.zeros((0, 0)), np.zeros((DIMS, 0)), np.zeros(0), np.zeros(0))
    codes = codewords(len(languages))
    at = {k: i for i, k in enumerate(languages)}
    y = codes[[at[k] for k, _ in examples]]
    rng = np.random.default_rng(11)
    order = rng.permutation(len(examples))
    back, fit = (order[: len(order) // 5], order[len(order) // 5 :]) if len(order) >= 50 else (order, order)
    w, b = np.zeros((DIMS, codes.shape[1]), np.float32), np.zeros(codes.shape[1], np.float32)
    # languages with few examples count as much as others
    n_of = {k: sum(x == k for x, _ in examples) for k in languages}
    share = np.array([len(examples) / (len(languages) * n_of[k]) for k, _ in examples], np.float32)
    for epoch in range(epochs):
        rate = 30.0 / (1 + epoch)
        fit = rng.permutation(fit)
        for lo in range(0, len(fit), 64):
            own = fit[lo : lo + 64]
            x = np.stack([examples[i][1] for i in own])
            g = -y[own] / (1 + np.exp(np.clip(y[own] * (x @ w + b), -30, 30))) * np.minimum(share[own], 20)[:, None]
            w -= rate * (x.T @ g / len(own) + 1e-5 * w)
            b -= 0.05 * rate * g.mean(0)
    x = np.stack([examples[i][1] for i in back])
    wrong = ((x @ w + b) * y[back] <= 0).mean(0)
    weights = np.log((1 - np.clip(wrong, 0.005, 0.45)) / np.clip(wrong, 0.005, 0.45))
    return Model(languages, codes, w, b, (weights / weights.sum() * len(weights)).astype(np.float32))


def held_out() -> F.Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """Trains on docs (doc_id, text, lang) that are not held out."""
    import pyarrow as pa

    bound_batches(docs.sparkSession)
    own = docs.where(~F.coalesce(held_out(), F.lit(False)) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = own.groupBy("lang").count().collect()  # one row a language
    if not counts:
        return train([])
    h = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(5)), F.lit(1 << 30))
    pick = F.lit(False)
    for r in counts:
        pick = pick | ((F.col("lang") == r["lang"]) & (h < int(min(1.0, per_language / r["count"]) * (1 << 30))))

    def run(batches):
        for b in batches:
            rows = [(k, x) for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if _LETTER.search(t) for x in [features(t)]]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.string()), pa.array([np.flatnonzero(x).astype("<u2").tobytes() for _, x in rows], pa.binary()), pa.array([x[x > 0].tobytes() for _, x in rows], pa.binary())], ["lang", "at", "x"])

    got = own.where(pick).select("lang", "text").mapInArrow(run, "lang string, at binary, x binary").collect()  # bounded by the sample
    examples = []
    for r in sorted(got, key=lambda r: (r["lang"], bytes(r["at"]), bytes(r["x"]))):
        x = np.zeros(DIMS, np.float32)
        x[np.frombuffer(r["at"], "<u2")] = np.frombuffer(r["x"], np.float32)
        examples.append((r["lang"], x))
    return train(examples)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score, ambiguous of each row of docs (doc_id, text)."""
    return predict_with(docs.select("doc_id", "text"), model)


def predict_with(docs: DataFrame, model: Model, keep_text: bool = False) -> DataFrame:
    """docs, of which a column is text, with the prediction (lang_pred, score, ambiguous); without text unless it is kept."""
    import pyarrow as pa

    spark = docs.sparkSession
    bound_batches(spark)
    # 7 bits for 4 languages: a quarter of a megabyte; some hundred languages: a few megabytes
    sent = spark.sparkContext.broadcast(model)

    def run(batches):
        m = sent.value
        for b in batches:
            got = [m.predict(t) for t in b.column(b.schema.get_field_index("text")).to_pylist()]
            names = [n for n in b.schema.names if keep_text or n != "text"]
            cols = [b.column(b.schema.get_field_index(n)) for n in names]
            a, s, f = zip(*got) if got else ((), (), ())
            yield pa.RecordBatch.from_arrays([*cols, pa.array(a, pa.string()), pa.array(s, pa.float64()), pa.array(f, pa.bool_())], [*names, "lang_pred", "score", "ambiguous"])

    rest = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if keep_text or f.name != "text"]
    return docs.mapInArrow(run, ", ".join([*rest, "lang_pred string, score double, ambiguous boolean"]))


def known(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """Rows of docs (doc_id, text, lang) whose language is told without ambiguity, by a model of these documents."""
    told = predict_with(boxed(docs, "text"), fit(docs, per_language), True).where((F.col("lang_pred") != UNDETERMINED) & ~F.col("ambiguous"))
    return unboxed(told, docs.columns, "text")


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs)
    own = docs.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "text")
    return predict_with(own, model).select("doc_id", "held_out", "lang_pred", "score", "ambiguous")
