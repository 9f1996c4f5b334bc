"""Names and places by dictionary: exact by an equi-join on normalized words, else fuzzy by trigrams and Jaro-Winkler.

Words are looked up once each, however often they occur: distinct words go through the lookup, and the result joins back.
A dictionary up to BROADCAST_TERMS terms is sent to the workers; a larger one is joined, exact by its terms and fuzzy by its trigrams, and
words that share no trigrams with any of its terms are held against all of them in blocks.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable
from dataclasses import dataclass, field, replace
from math import ceil
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..data import shipped

BROADCAST_TERMS = 500_000
#: Words and terms that are compared at once where no trigram leads from one to the other.
WORD_BLOCK, TERM_BLOCK = 500, 5_000
#: Terms of all dictionaries up to which words are held against them by arrays.
MATRIX_TERMS = 5_000
#: Rows of matches of distinct words up to which they are sent to the texts, else joined; words that a task remembers.
SENT_HITS, SEEN = 100_000, 500_000
WORD = r"[\p{L}\p{M}\p{N}_]+(?:['’.][\p{L}\p{M}\p{N}_]+)*"
HONORIFIC = r"(?i)(?:herr|frau|hr\.|fr\.|dr\.|prof\.) $"
LOCALES = ("at", "de", "ch", "generic")


def normalize(word: str) -> str:
    """Decomposed lower case; accents stay as combining marks."""
    return unicodedata.normalize("NFD", word).lower()


def jaro_winkler(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(len(a), len(b)) // 2 - 1
    used = [False] * len(b)
    hits = []
    for i, x in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == x:
                used[j] = True
                hits.append(x)
                break
    if not hits:
        return 0.0
    other = [c for c, u in zip(b, used) if u]
    swapped = sum(x != y for x, y in zip(hits, other)) // 2
    m = len(hits)
    j = (m / len(a) + m / len(b) + (m - swapped) / m) / 3
    prefix = 0
    for x, y in zip(a[:4], b[:4]):
        if x != y:
            break
        prefix += 1
    return j + prefix * 0.1 * (1 - j) if j > 0.7 else j


def can_reach(a: str, b: str, threshold: float) -> bool:
    """Whether the lengths, the common prefix and the common letters allow a similarity of the threshold; cheaper than the similarity."""
    prefix = 0
    for x, y in zip(a[:4], b[:4]):
        if x != y:
            break
        prefix += 1
    need = (threshold - 0.1 * prefix) / (1 - 0.1 * prefix)
    per = 1 / len(a) + 1 / len(b) if a and b else 0
    if (min(len(a), len(b)) * per + 1) / 3 < need:
        return False
    return (sum(min(a.count(c), b.count(c)) for c in set(a)) * per + 1) / 3 >= need - 1e-12


def _shape(words: list[str]):
    """Of words: length, first four characters (-1 beyond the end), numbers of letters by their code modulo 32."""
    import numpy as np

    first, letters = np.full((len(words), 4), -1, np.int32), np.zeros((len(words), 32), np.int16)
    for i, w in enumerate(words):
        codes = np.fromiter(map(ord, w), np.int32, len(w))
        first[i, : min(4, len(w))] = codes[:4]
        letters[i] = np.bincount(codes & 31, minlength=32)
    return np.array([len(w) for w in words], np.float64), first, letters


def similar(words: list[str], terms: list[str], threshold: float) -> list[tuple[int, int, float]]:
    """All pairs (word, term, similarity) from the threshold on, none of them empty. Letters that fall together in _shape only make the bound of can_reach looser."""
    import numpy as np

    out = []
    size, first, letters = _shape(terms)
    for i, (n, f, c) in enumerate(zip(*_shape(words))):
        prefix = 0.1 * np.logical_and.accumulate((first == f) & (f >= 0), axis=1).sum(axis=1)
        bound = (np.minimum(letters, c).sum(axis=1) * (1 / n + 1 / size) + 1) / 3
        for j in np.flatnonzero(bound >= (threshold - prefix) / (1 - prefix) - 1e-9).tolist():
            if can_reach(words[i], terms[j], threshold) and (s := jaro_winkler(words[i], terms[j])) >= threshold:
                out.append((i, j, s))
    return out


def trigrams(word: str) -> set[str]:
    return {word[i : i + 3] for i in range(len(word) - 2)} if len(word) >= 3 else {word} if word else set()


@dataclass
class Entry:
    term: str
    frequency: float = 0.7
    original_forms: list[str] = field(default_factory=list)
    metadata: dict[str, str] = field(default_factory=dict)

    @property
    def valid(self) -> bool:
        return bool(self.term.strip()) and 0 <= self.frequency <= 1


class Dictionary:
    """Terms by their normalized form (the first of equal ones counts), with an index of trigrams."""

    def __init__(self, id: str, category: str, locale: str, entries: Iterable[Entry], name: str = "", builtin: bool = False):
        self.id, self.category, self.locale, self.name, self.builtin = id, category, locale, name or id, builtin
        self.entries: dict[str, Entry] = {}
        self.index: dict[str, list[str]] = {}
        for e in entries:
            if not e.valid:
                raise ValueError(f"{id}: invalid entry {e.term!r}")
            key = normalize(e.term)
            if key not in self.entries:
                self.entries[key] = e
                for g in trigrams(key):
                    self.index.setdefault(g, []).append(key)

    def __len__(self) -> int:
        return len(self.entries)

    def __contains__(self, word: str) -> bool:
        return normalize(word) in self.entries

    def get(self, normalized: str) -> Entry | None:
        return self.entries.get(normalized)

    def candidates(self, normalized: str, ratio: float = 0.2) -> list[str]:
        """Terms that share at least a ratio of the word's trigrams (one at least)."""
        own = trigrams(normalized)
        counts: dict[str, int] = {}
        for g in own:
            for t in self.index.get(g, ()):
                counts[t] = counts.get(t, 0) + 1
        need = max(1, ceil(ratio * len(own)))
        return [t for t, n in counts.items() if n >= need]

    def find_fuzzy(self, normalized: str, threshold: float = 0.85) -> list[tuple[Entry, float]]:
        """Candidates by trigrams; without any, all terms."""
        found = [(self.entries[t], s) for t in self.candidates(normalized) or self.entries if can_reach(normalized, t, threshold) and (s := jaro_winkler(normalized, t)) >= threshold]
        return sorted(found, key=lambda x: (-x[1], x[0].term))


def load_dictionary(text: str, id: str, category: str, locale: str = "generic") -> Dictionary:
    """Lines of a term and, after a tab, a frequency; # begins a comment."""
    entries = []
    for n, line in enumerate(text.splitlines(), 1):
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        term, _, freq = line.partition("\t")
        try:
            entries.append(Entry(term.strip(), float(freq) if freq.strip() else 0.7))
        except ValueError:
            raise ValueError(f"{id}, line {n}: {freq!r} is no frequency") from None
    return Dictionary(id, category, locale, entries)


def load_dictionary_file(path: str, category: str, locale: str = "generic") -> Dictionary:
    return load_dictionary(Path(path).read_text(), Path(path).stem, category, locale)


class DictionaryRegistry:
    def __init__(self, *dictionaries: Dictionary):
        self.by_id: dict[str, Dictionary] = {}
        for d in dictionaries:
            self.register(d)

    def register(self, d: Dictionary) -> None:
        if d.id in self.by_id:
            raise ValueError(f"there is a dictionary {d.id}")
        self.by_id[d.id] = d

    def unload(self, id: str) -> Dictionary:
        return self.by_id.pop(id)

    def reload(self, d: Dictionary) -> None:
        if d.id not in self.by_id:
            raise KeyError(d.id)
        self.by_id[d.id] = d

    def get(self, id: str) -> Dictionary | None:
        return self.by_id.get(id)

    def by_category(self, category: str) -> list[Dictionary]:
        return [d for d in self.by_id.values() if d.category == category]

    def by_locale(self, locale: str) -> list[Dictionary]:
        return [d for d in self.by_id.values() if d.locale == locale]

    def by_category_and_locale(self, category: str, locale: str) -> list[Dictionary]:
        return [d for d in self.by_category(category) if d.locale == locale]


def builtin_registry() -> DictionaryRegistry:
    return DictionaryRegistry(*[Dictionary(i, c, loc, [Entry(t, f) for t, f in terms], builtin=True) for i, c, loc, terms in shipped()])


@dataclass(frozen=True)
class Config:
    categories: tuple[str, ...] = ("first_name", "last_name")
    locales: tuple[str, ...] = ("at", "de", "ch")
    min_confidence: float = 0.5
    fuzzy: bool = True
    threshold: float = 0.85
    require_word_boundaries: bool = True

    @classmethod
    def all_categories(cls) -> "Config":
        return cls(("first_name", "last_name", "city"))

    @classmethod
    def names_only(cls) -> "Config":
        return cls()

    @classmethod
    def locations_only(cls) -> "Config":
        return cls(("city",))

    def without_fuzzy(self) -> "Config":
        return replace(self, fuzzy=False)

    def enables(self, d: Dictionary) -> bool:
        return d.category in self.categories and (d.locale in self.locales or d.locale == "generic")


def words_of(text: Column) -> Column:
    """Words with their places and the 20 characters before. A text has very many; adding them to an array one by one in an expression would be quadratic."""

    @F.udf("array<struct<start:int,end:int,text:string,before:string>>", useArrow=True)
    def run(t):
        import regex

        return [(m.start(), m.end(), m[0], t[max(0, m.start() - 20) : m.start()]) for m in regex.finditer(WORD, t or "")]

    return run(text)


def distinct_words(segments: DataFrame, text: str = "content") -> DataFrame:
    """word: each word of the texts once. A task passes on those that it hasn't seen, so little is shuffled."""
    import pyarrow as pa

    def run(batches):
        import regex

        find, seen = regex.compile(WORD).findall, set()
        for b in batches:
            new = {w for t in b.column(0).to_pylist() if t for w in find(t)}
            new -= seen
            seen |= new
            if len(seen) > SEEN:
                seen = set()
            yield pa.RecordBatch.from_arrays([pa.array(list(new), pa.string())], ["word"])

    return segments.select(text).mapInArrow(run, "word string").distinct()


def confidence(frequency: Column, similarity: Column, prefix: Column, word: Column) -> Column:
    """Of the entry, the match and the signs around it: an honorific before, a capital first."""
    bonus = F.lit(1.0) + F.when(prefix.rlike(HONORIFIC), 0.15).otherwise(0.0) + F.when(word.rlike(r"^\p{Lu}"), 0.05).otherwise(0.0)
    return F.least(F.lit(1.0), frequency * similarity * F.least(bonus, F.lit(1.2))).cast("float")


def lookup(words: DataFrame, registry: DictionaryRegistry, config: Config) -> DataFrame:
    """Of distinct words (word): word, dictionary_id, category, locale, term, frequency, similarity. Exact, else fuzzy, by dictionary."""
    import pyarrow as pa

    own = [d for d in registry.by_id.values() if config.enables(d)]
    if sum(map(len, own)) > BROADCAST_TERMS:
        return _lookup_joined(words, own, config)
    sent = words.sparkSession.sparkContext.broadcast(own)
    by_arrays = config.fuzzy and sum(map(len, own)) <= MATRIX_TERMS
    names = ["word", "dictionary_id", "category", "locale", "term", "frequency", "similarity"]

    def run(batches):
        for b in batches:
            rows = []
            words = b.column(0).to_pylist()
            keys = [*map(normalize, words)]
            near = _near(keys, sent.value, config.threshold) if by_arrays else None
            for i, (w, key) in enumerate(zip(words, keys)):
                for k, d in enumerate(sent.value):
                    e = d.get(key)
                    if e:
                        found = [(e, 1.0)]
                    elif near is None:
                        found = d.find_fuzzy(key, config.threshold) if config.fuzzy else []
                    else:
                        found = near.get((i, k), ())
                    rows += [(w, d.id, d.category, d.locale, e.term, e.frequency, s) for e, s in found]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string() if i < 5 else pa.float64()) for i in range(7)], names)

    # words alone are little data, which would be put into one task
    n = max(words.sparkSession.sparkContext.defaultParallelism, int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return words.select("word").repartition(n, "word").mapInArrow(run, "word string, dictionary_id string, category string, locale string, term string, frequency double, similarity double")


def _near(keys: list[str], own: list[Dictionary], threshold: float) -> dict[tuple[int, int], list[tuple[Entry, float]]]:
    """find_fuzzy of all keys in all dictionaries, by the numbers of key and dictionary: first the pairs that are similar, then which of them may be."""
    on = [i for i, k in enumerate(keys) if k]
    terms = [(k, t) for k, d in enumerate(own) for t in d.entries if t]
    out: dict[tuple[int, int], list[tuple[Entry, float]]] = {}
    for i, j, s in similar([keys[i] for i in on], [t for _, t in terms], threshold):
        k, t = terms[j]
        out.setdefault((on[i], k), []).append((own[k].entries[t], s))
    for (i, k), found in out.items():
        if may := own[k].candidates(keys[i]):
            forms = {id(own[k].entries[t]) for t in may}
            out[i, k] = [x for x in found if id(x[0]) in forms]
    return out


def _lookup_joined(words: DataFrame, own: list[Dictionary], config: Config) -> DataFrame:
    """The same by joins."""
    spark = words.sparkSession
    terms = spark.createDataFrame([(d.id, d.category, d.locale, k, e.term, e.frequency) for d in own for k, e in d.entries.items()], "dictionary_id string, category string, locale string, key string, term string, frequency double")
    norm = F.udf(normalize, "string", useArrow=True)
    grams = lambda c: F.array_distinct(F.when(F.length(c) < 3, F.array(c)).otherwise(F.transform(F.sequence(F.lit(1), F.length(c) - 2), lambda i: F.substring(c, i, 3))))
    w = words.select("word").distinct().withColumn("key", norm("word"))
    rest = ["dictionary_id", "category", "locale", "term", "frequency"]
    exact = w.join(terms, "key").select("word", *rest, F.lit(1.0).alias("similarity"))
    if not config.fuzzy:
        return exact
    g = w.withColumn("n", F.size(grams(F.col("key")))).select("word", F.col("key").alias("wkey"), "n", F.explode(grams(F.col("key"))).alias("gram"))
    near = g.join(terms.select("*", F.explode(grams(F.col("key"))).alias("gram")), "gram").groupBy("word", "wkey", "n", "key", *rest).count().where("count >= greatest(1, ceil(0.2 * n))")
    jw = F.udf(jaro_winkler, "double", useArrow=True)
    fuzzy = near.withColumn("similarity", jw("wkey", "key")).where(F.col("similarity") >= config.threshold).select("word", *rest, "similarity")
    fuzzy = fuzzy.unionByName(_lookup_lone(w, near.select("word", "dictionary_id"), exact.select("word", "dictionary_id"), terms, [d.id for d in own if len(d)], config))
    return exact.unionByName(fuzzy.join(exact.select("word", "dictionary_id"), ["word", "dictionary_id"], "left_anti"))


def _lookup_lone(w: DataFrame, near: DataFrame, exact: DataFrame, terms: DataFrame, ids: list[str], config: Config) -> DataFrame:
    """Words (word, key) without a candidate or an exact match in a dictionary against all its terms, in blocks of both."""
    import pyarrow as pa

    rest = ["dictionary_id", "category", "locale", "term", "frequency"]
    pairs = w.select("word", F.col("key").alias("wkey"), F.explode(F.array(*map(F.lit, ids))).alias("dictionary_id"))
    lone = pairs.join(near.unionByName(exact), ["word", "dictionary_id"], "left_anti").where("wkey != ''")
    of = lambda c, n: F.pmod(F.xxhash64(c), F.greatest(F.lit(1), F.ceil(F.col("_n") / n)).cast("int")).alias("_b")

    def blocks(df, key, size, column, *columns):
        counts = df.groupBy("dictionary_id").agg(F.count(F.lit(1)).alias("_n"))
        return df.join(F.broadcast(counts), "dictionary_id").groupBy("dictionary_id", of(key, size)).agg(F.collect_list(F.struct(*columns)).alias(column))

    some = blocks(lone, "word", WORD_BLOCK, "words", "word", "wkey").withColumnRenamed("_b", "_w")
    against = blocks(terms, "key", TERM_BLOCK, "terms", "key", *rest)
    many = against.select("dictionary_id", "_b").distinct()
    # blocks of words go to each block of terms
    sent = some.join(F.broadcast(many), "dictionary_id").join(against, ["dictionary_id", "_b"]).select("words", "terms")

    def run(batches):
        for b in batches:
            rows = []
            for ws, ts in ((x.as_py(), y.as_py()) for x, y in zip(*b.columns)):  # one pair of blocks at a time
                for i, j, s in similar([x["wkey"] for x in ws], [t["key"] for t in ts], config.threshold):
                    rows.append((ws[i]["word"], *[ts[j][c] for c in rest], s))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string() if i < 5 else pa.float64()) for i in range(7)], ["word", *rest, "similarity"])

    return sent.mapInArrow(run, "word string, dictionary_id string, category string, locale string, term string, frequency double, similarity double")


def detect_names(segments: DataFrame, registry: DictionaryRegistry | None = None, config: Config | None = None, text: str = "content") -> DataFrame:
    """One row a match, with the segment's other columns. In each segment matches don't overlap: by start, surer first.

    The texts are read twice and never shuffled: distinct words go through the lookup first (a job of its own), and up to SENT_HITS matches of
    them are sent back to the texts; more are joined to the words.
    """
    registry, config = registry or builtin_registry(), config or Config()
    rest = [c for c in segments.columns if c != text]
    if not config.require_word_boundaries:
        return _substrings(segments, registry, config, text, rest)
    found = lookup(distinct_words(segments, text), registry, config).persist()
    if found.count() > SENT_HITS:
        return _joined_names(segments, found, config, text, rest)
    hits: dict[str, list[tuple]] = {}
    for r in found.collect():
        hits.setdefault(r["word"], []).append((r["category"], r["dictionary_id"], r["locale"], r["term"], r["frequency"], r["similarity"]))
    found.unpersist()
    return _sent_names(segments, hits, config, text, rest)


def _sent_names(segments: DataFrame, hits: dict[str, list[tuple]], config: Config, text: str, rest: list[str]) -> DataFrame:
    import pyarrow as pa

    sent = segments.sparkSession.sparkContext.broadcast(hits)
    kinds = {"category": pa.string(), "start": pa.int32(), "end": pa.int32(), "matched_text": pa.string(), "confidence": pa.float32(), "dictionary_id": pa.string(), "locale": pa.string(), "term": pa.string(), "match_type": pa.string(), "similarity": pa.float64()}

    def run(batches):
        import re

        import numpy as np
        import regex

        find, honor = regex.compile(WORD).finditer, re.compile(HONORIFIC[:-1] + "(?:\r\n|[\n\r\x85\u2028\u2029])?\\Z")
        upper, least, known = regex.compile(r"\p{Lu}").match, np.float32(config.min_confidence), sent.value

        def surest(t, m):
            bonus = 1.0
            if honor.search(t[max(0, m.start() - 20) : m.start()]):
                bonus += 0.15
            if upper(m[0]):
                bonus += 0.05
            own = [(np.float32(min(1.0, f * s * min(bonus, 1.2))), d, term, c, loc, s) for c, d, loc, term, f, s in known[m[0]]]
            return min((x for x in own if x[0] >= least), key=lambda x: (-x[0], x[1], x[2]), default=None)

        for b in batches:
            at, rows = [], []
            for i, t in enumerate(b.column(0).to_pylist()):
                for m in find(t or ""):
                    if m[0] in known and (x := surest(t, m)):
                        at.append(i)
                        rows.append((x[3], m.start(), m.end(), m[0], x[0], x[1], x[4], x[2], "exact" if x[5] == 1.0 else "fuzzy", x[5]))
            own = [c.take(pa.array(at, pa.int64())) for c in b.columns[1:]]
            made = [pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * len(kinds), kinds.values())]
            yield pa.RecordBatch.from_arrays(own + made, [*rest, *kinds])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in segments.select(*[F.col(f"`{c}`") for c in rest]).schema]
    made = "category string, start int, end int, matched_text string, confidence float, dictionary_id string, locale string, term string, match_type string, similarity double"
    return segments.select(text, *[F.col(f"`{c}`") for c in rest]).mapInArrow(run, ", ".join([*fields, made]))


def _joined_names(segments: DataFrame, found: DataFrame, config: Config, text: str, rest: list[str]) -> DataFrame:
    """The same by joins on the words."""
    placed = segments.withColumn("_id", F.monotonically_increasing_id()).select(*rest, "_id", F.explode_outer(words_of(F.col(text))).alias("w")).where(F.col("w").isNotNull())
    at = placed.select(*rest, "_id", F.col("w.text").alias("matched_text"), F.col("w.start").alias("start"), F.col("w.end").alias("end"), F.col("w.before").alias("_prefix"))
    both = at.join(found.withColumnRenamed("word", "matched_text"), "matched_text")
    sure = both.withColumn("confidence", confidence(F.col("frequency"), F.col("similarity"), F.col("_prefix"), F.col("matched_text"))).where(F.col("confidence") >= F.lit(config.min_confidence).cast("float"))
    # words don't overlap each other, so of a word's matches the surest stays
    from pyspark.sql import Window

    best = Window.partitionBy("_id", "start").orderBy(F.desc("confidence"), "dictionary_id", "term")
    kind = F.when(F.col("similarity") == 1.0, "exact").otherwise("fuzzy")
    return sure.withColumn("_k", F.row_number().over(best)).where("_k = 1").select(*rest, "category", "start", "end", "matched_text", "confidence", "dictionary_id", "locale", "term", kind.alias("match_type"), "similarity")


def _substrings(segments: DataFrame, registry: DictionaryRegistry, config: Config, text: str, rest: list[str]) -> DataFrame:
    """Terms anywhere, in any case. Of overlapping matches the first stays, and of those with one start the surest; what isn't sure enough counts for nothing."""
    import re

    own = [(d.id, d.category, d.locale, e.term, e.frequency) for d in registry.by_id.values() if config.enables(d) for e in d.entries.values()]
    own.sort(key=lambda x: -x[4])  # signs around a place are the same for all terms that start there
    by_term: dict[str, tuple] = {}
    for x in own:
        by_term.setdefault(x[3].lower(), x)
    pattern = re.compile("|".join(map(re.escape, by_term)) or r"(?!)", re.I)
    honor = re.compile(HONORIFIC)

    @F.udf("array<struct<category:string,start:int,end:int,matched_text:string,confidence:float,dictionary_id:string,locale:string,term:string>>", useArrow=True)
    def find(t):
        out, at, t = [], 0, t or ""
        while m := pattern.search(t, at):
            i, c, loc, term, f = by_term.get(m[0].lower(), (None, None, None, None, 0.0))
            bonus = 1.0 + (0.15 if honor.search(t[max(0, m.start() - 20) : m.start()]) else 0.0) + (0.05 if m[0][0].isupper() else 0.0)
            sure = min(1.0, f * min(bonus, 1.2))
            if i and sure >= config.min_confidence:
                out.append((c, m.start(), m.end(), m[0], sure, i, loc, term))
                at = m.end()
            else:
                at = m.start() + 1
        return out

    return segments.select(*rest, F.explode(find(F.col(text))).alias("m")).select(*rest, "m.*", F.lit("substring").alias("match_type"), F.lit(1.0).alias("similarity"))
