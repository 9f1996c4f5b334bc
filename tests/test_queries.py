"""Every registered query of the engine against its SQL, and contexts, addresses, tables and dictionaries by example."""

import math
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from quillguard.operators import address, context, dictionary, tables
from quillguard.operators.detectors import Registry, with_findings
from quillguard.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(v):
    return None if isinstance(v, float) and math.isnan(v) else round(v, 4) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(repr([plain(r[c]) for c in columns]) for r in df.collect())
    if name in catalog.ORACLES:
        r = duck.execute(catalog.ORACLES[name])
        names = [d[0] for d in r.description]
        want = sorted(repr([plain(dict(zip(names, row))[c]) for c in columns]) for row in r.fetchall())
        assert sorted(names) == columns and got == want
    else:
        assert columns


def test_audit_chains_all_orders(spark, duck, tmp_path):
    """Against the SQL, and with keys that are all large: the chain leaves no order out."""
    plans = [catalog.QUERIES["audit_chain_verify"](spark, SF)]
    spark.read.parquet(f"{SF}/orders.parquet").withColumn("o_orderkey", F.col("o_orderkey") + 1_000_000).write.parquet(f"{tmp_path}/orders.parquet")
    plans.append(catalog.QUERIES["audit_chain_verify"](spark, str(tmp_path)))
    want = duck.execute(catalog.ORACLES["audit_chain_verify"]).fetchall()
    for df in plans:
        assert [(r["seq"], r["problem"]) for r in df.collect()] == want


def test_context(spark):
    assert [len(context.builtin_rules(k)) for k in ("en", "de", "fr", "xx")] == [13, 9, 9, 0] and all(r.compiles for r in context.all_rules())
    assert not any(context.Rule(p).compiles for p in ("(a+)+", r"(\w+)", "(?:a*)*", "[", "a" * 1001))
    df = with_findings(spark.createDataFrame([("order # 4111111111111111",), ("Mr. X 4111111111111111",), ("nothing",)], "content string"), Registry().only(["credit_card"]))
    got = [[(round(f["confidence"], 3), len(f["context_reasoning"])) for f in r["findings"]] for r in context.analyze(df, context.all_rules()).collect()]
    assert got == [[(0.3, 2)], [(1.0, 1)], []]  # "rd" of a road is in "order" too
    far = with_findings(spark.createDataFrame([("isbn " + "x " * 150 + "a@b.de",)], "content string"), Registry().only(["email"]))
    conf = lambda scoped: round(context.analyze(far, context.builtin_rules("en"), scoped=scoped).first()["findings"][0]["confidence"], 3)
    assert conf(False) == 0.2 and conf(True) == 1.0
    assert context.parse_rules(context.sample_rules())[0].category == "PersonName"
    for bad in ("version: '2'", "version: '1.0'\nrules: [{pattern: '(', action: boost, weight: 0.1}]", "version: '1.0'\nrules: [{pattern: a, action: boost, weight: 2}]"):
        with pytest.raises(ValueError):
            context.parse_rules(bad)


def test_addresses(spark):
    rows = ["123 Main Street\nNew York, NY 10001\nUnited States", "Send to: San Francisco, CA 94102", "Hauptstr. 42\r\n80331 Muenchen\r\nGermany", "Hello\n123 Main Street", None, "12 rue Victor Hugo\n75001 Paris", ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "id long, content string")
    found = {(r["id"], b["format"]): {c["type"]: c["text"] for c in b["components"]} for r in address.detect_addresses(df).collect() for b in r["addresses"]}
    assert found[0, "en"] == {"street": "123 Main Street", "city": "New York", "state": "NY", "postal_code": "10001", "country": "United States"}
    assert found[2, "de"]["street"] == "Hauptstr. 42" and found[5, "fr"]["city"] == "Paris" and found[1, "en"]["city"] == "San Francisco"
    assert not [k for k in found if k[0] in (3, 4, 6)]
    for r in address.detect_addresses(df, "en").collect():
        assert all(r["content"][c["start"] : c["end"]] == c["text"] for b in r["addresses"] for c in b["components"])
    with pytest.raises(ValueError):
        address.detect_addresses(df, "xx")



def test_town_in_one_pass(spark):
    """Places are those of the first match by another engine, and a town costs few passes of its patterns."""
    rng = random.Random(3)
    bits = ["New York", "NY", "10001", "80331", "Muenchen", "Bad", ", ", " ", "\n", "\x01", "x1", "94102-1234", "12"]
    rows = [(i, "".join(rng.choice(bits) + rng.choice(["", " "]) for _ in range(rng.randrange(1, 12)))) for i in range(400)]
    df, found = spark.createDataFrame(rows, "id long, t string"), 0
    for form, (pattern, kinds) in address.TOWN.items():
        got = df.select("id", address._town(F.col("t"), form, F.lit(7)).alias("c"))
        for r in got.collect():
            m = re.search(pattern, rows[r["id"]][1], re.ASCII)
            want = [(k, m[i], 7 + m.start(i), 7 + m.end(i)) for i, k in enumerate(kinds, 1) if k] if m else []
            assert [tuple(c) for c in r["c"]] == want
            found += bool(m)
        made = address.detect_addresses(df.withColumnRenamed("t", "content"), form)
        assert made._jdf.queryExecution().optimizedPlan().toString().count(pattern[-12:]) <= 8
    assert found > 50


def test_tables(spark):
    df = spark.createDataFrame([("Name,Email,Phone\nJohn,j@e.com,555",), ("123,456\n1,2",), ("a;b",), ("Name\tSSN\nx\t1",), ("one",)], "content string")
    got = [r["table"] for r in tables.detect_table(df).collect()]
    assert [(h["category"], round(h["boost"], 2)) for h in got[0]["headers"]] == [("PersonName", 0.35), ("email", 0.4), ("phone", 0.4)]
    assert got[1] is None or got[1]["column_count"] == 2
    assert got[2]["delimiter"] == ";" and got[3]["headers"][1]["category"] == "SSN" and got[4] is None
    own = tables.detect_table(df.limit(1), extra={"Phone": ("custom", 0.9)}).first()["table"]["headers"][2]
    assert own["category"] == "custom"


def test_dictionaries(spark, monkeypatch):
    d = dictionary.load_dictionary("# names\nAnna\t0.9\n\nBernd\n", "x", "first_name", "de")
    assert len(d) == 2 and "ANNA" in d and d.get("bernd").frequency == 0.7
    with pytest.raises(ValueError, match="line 1"):
        dictionary.load_dictionary("a\tb", "x", "c")
    reg = dictionary.DictionaryRegistry(d)
    with pytest.raises(ValueError):
        reg.register(d)
    assert reg.by_category("first_name") == [d] and reg.by_locale("at") == [] and reg.unload("x") is d and reg.get("x") is None
    assert dictionary.normalize("MÜLLER") != dictionary.normalize("MULLER") and dictionary.jaro_winkler("martha", "marhta") == pytest.approx(0.961111, abs=1e-6)
    df = spark.createDataFrame([(1, "Herr Peter und Annna"), (2, None), (3, "peter")], "id long, content string")
    rows = {(r["id"], r["matched_text"]): r for r in dictionary.detect_names(df).collect()}
    often = dictionary.builtin_registry().get("firstnames_de").get("peter").frequency
    assert rows[1, "Peter"]["confidence"] == pytest.approx(min(1.0, often * 1.2)) and rows[1, "Annna"]["match_type"] == "fuzzy" and rows[3, "peter"]["confidence"] == pytest.approx(often)
    fast = {(r["id"], r["matched_text"], r["term"]) for r in dictionary.detect_names(df).collect()}
    for limit, value in (("SENT_HITS", 0), ("MATRIX_TERMS", 0), ("BROADCAST_TERMS", 1)):  # each way gives the same
        monkeypatch.setattr(dictionary, limit, value)
        assert {(r["id"], r["matched_text"], r["term"]) for r in dictionary.detect_names(df).collect()} == fast
    loose = dictionary.Config(require_word_boundaries=False)
    assert "Anna" in [r["matched_text"] for r in dictionary.detect_names(spark.createDataFrame([("xAnnax",)], "content string"), config=loose).collect()]
    assert dictionary.Config.names_only().categories == ("first_name", "last_name")


def test_fuzzy_without_candidates(spark, monkeypatch):
    """Words that share no trigram with a dictionary's terms, on both sides of the switch."""
    rng = random.Random(1)
    terms = ["john", "Ann", "Zoë", "Straße", "bo"] + ["".join(rng.choice("aeiklmn") for _ in range(rng.randrange(2, 7))) for _ in range(80)]
    registry = dictionary.DictionaryRegistry(*[dictionary.Dictionary(f"d{k}", "first_name", "de", map(dictionary.Entry, terms[k::3])) for k in range(3)])
    words = ["jon", "ANN", "Zoé", "Straxse", "b", "xq", "jhon"] + ["".join(rng.choice("aeiklmn") for _ in range(rng.randrange(1, 7))) for _ in range(150)]
    df = spark.createDataFrame([(w,) for w in sorted(set(words))], "word string")
    found = lambda: sorted((r["word"], r["dictionary_id"], r["term"], round(r["similarity"], 9)) for r in dictionary.lookup(df, registry, dictionary.Config(("first_name",))).collect())
    sent = found()
    lone = {(r[0], r[1]) for r in sent if r[3] < 1 and not registry.get(r[1]).candidates(dictionary.normalize(r[0]))}
    assert ("jon", "d0") in lone and len(lone) > 10
    monkeypatch.setattr(dictionary, "BROADCAST_TERMS", 1)
    monkeypatch.setattr(dictionary, "WORD_BLOCK", 7, raising=False)
    monkeypatch.setattr(dictionary, "TERM_BLOCK", 9, raising=False)
    assert found() == sent
    own = [dictionary.normalize(x) for x in {*terms, *words}]
    assert {(i, j) for i, j, _ in dictionary.similar(own, own, 0.8)} == {(i, j) for i, a in enumerate(own) for j, b in enumerate(own) if dictionary.jaro_winkler(a, b) >= 0.8}


def test_names_against_brute_force(spark):
    texts = ["Herr Peter und Annna trafen Frau Muller in Berlin", "markuss, Petra; Schmitt aus Hamburgg", "nothing here", "Sarrah Xq Wienn Jon Dr. Weber"]
    config, registry = dictionary.Config.all_categories(), dictionary.builtin_registry()
    want = set()
    for k, text in enumerate(texts):
        for m in re.finditer(r"\w+", text):
            key, found = dictionary.normalize(m[0]), []
            own = {key[i : i + 3] for i in range(max(1, len(key) - 2))}
            for d in registry.by_id.values():
                if not config.enables(d):
                    continue
                near = {t for t in d.entries if len(own & {t[i : i + 3] for i in range(max(1, len(t) - 2))}) >= max(1, -(-len(own) // 5))}
                for t in [key] if key in d.entries else near or d.entries:
                    if (s := dictionary.jaro_winkler(key, t)) >= 0.85:
                        bonus = 1 + 0.15 * bool(re.search(r"(?i)(?:herr|frau|hr\.|fr\.|dr\.|prof\.) $", text[: m.start()])) + 0.05 * m[0][0].isupper()
                        e = d.entries[t]
                        found.append((-round(min(1.0, e.frequency * s * bonus), 5), d.id, e.term))
            if found and min(found)[0] <= -0.5:
                want.add((k, m.start(), m[0], *min(found)[1:], -round(min(found)[0], 3)))
    df = spark.createDataFrame(list(enumerate(texts)), "id long, content string")
    got = {(r["id"], r["start"], r["matched_text"], r["dictionary_id"], r["term"], round(r["confidence"], 3)) for r in dictionary.detect_names(df, registry, config).collect()}
    assert len(want) > 5 and {x[:5] for x in got} == {x[:5] for x in want}
    assert all(abs(a[5] - abs(b[5])) < 0.002 for a, b in zip(sorted(got), sorted(want)))
