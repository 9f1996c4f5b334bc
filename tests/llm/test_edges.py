"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing names, for every operator and stage."""

import pytest

import corpus_pipeline
from quillguard.llm import chat, html, langid, mixing, neardup, packing, quality, records, suffixes, vectors
from quillguard.llm.common import shared_dir

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, _h long, b string, score string, __row string"
LONG = " ".join(f"word{i % 977} t{i}" for i in range(20_000))
SAME = "the quick brown fox jumps over the lazy dog and runs away from all of the hounds that follow it through the wood"
ROWS = [
    (1, SAME, "en", "a", 0), (2, SAME, "en", "a", 0), (2, SAME, "en", "a", 0), (3, None, None, None, None), (4, "", "en", "b", 0), (5, " \n\t ", "de", "b", 0), (6, LONG, "en", "a", 0),
    (7, "ein kurzer satz", "de", None, 0), (None, "a text without a number that stays alone here", "en", "c", 0), (None, None, None, "c", 0), (8, "12345 !!! ###", "en", "c", 0), (9, "x" * 100_000, "en", "a", 0),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, 1, 2, "x", "y", "z") for r in ROWS], DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def encode():
    return packing.default_encoder()


def test_quality(spark, docs, none):
    got = {r["doc_id"]: r for r in quality.judge(docs, quality.DEFAULT).collect()}
    assert got[3]["n_words"] == got[4]["n_words"] == 0 and not got[3]["kept"] and got[3]["base_failed"]
    assert got[6]["n_words"] == 40_000 and quality.judge(docs, quality.DEFAULT).count() == len(ROWS)
    labels = spark.createDataFrame([(1, 1), (None, 0), (3, None)], "doc_id long, quality int")
    assert quality.fit(docs, labels) is quality.DEFAULT and quality.fit(none, labels.limit(0)) is quality.DEFAULT
    assert quality.judge(none, quality.DEFAULT).count() == 0


def test_mixing(docs, none):
    rows = mixing.mix(docs).collect()
    assert len(rows) == len(ROWS) and all(0 <= r["taken"] <= 3 * r["size"] for r in rows)
    assert sum(r["taken"] for r in rows) <= 3 * sum(r["size"] for r in rows)
    assert mixing.mix(none).count() == 0
    m = mixing.mixed(docs)
    assert m.columns == docs.columns and mixing.mixed(none).count() == 0


def test_neardup(docs, none):
    rows = neardup.classify(docs).collect()
    by = {r["doc_id"]: r["class_id"] for r in rows}
    assert len(rows) == len(ROWS) and by[1] == by[2] == 1 and all(by[i] == i for i in (3, 4, 5, 6, 7, 8, 9))
    assert neardup.classify(none).count() == 0
    d = neardup.deduplicate(docs)
    assert d.columns == docs.columns and sorted(str(r["doc_id"]) for r in d.collect()) == sorted(["1", "3", "4", "5", "6", "7", "8", "9", "None", "None"])


def test_vectors(spark):
    e = [1.0, 0.0, 0.5]
    rows = [
        (1, e, 0), (2, e, 0), (2, e, 0), (3, e, 1), (4, None, 0), (5, [0.0, 0.0, 0.0], 0), (6, [1.0, None, 0.0], 0), (7, [float("nan"), 1.0, 0.0], 0), (8, [float("inf"), 1.0, 0.0], 0),
        (9, e, None), (None, e, 0), (10, [1.0, 0.0], 0), (11, [], 0), (12, [2.0, 0.0, 1.0], 0), (13, [3e38, 0.0, 1.5e38], 0),
    ]
    df = spark.createDataFrame([(*r, 1.0) for r in rows], "vec_id long, embedding array<float>, label int, tile double")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in vectors.near_duplicates(df).collect()}
    assert got[1] == (3, 1, True) and got[2] == (3, 1, False) and got[12] == (3, 1, False) and got[13] == (3, 1, False)
    assert all(got[i] == (0, i, True) for i in (3, 4, 5, 6, 7, 8, 9, 10, 11)) and got[None] == (0, None, True) and len(got) == 14
    assert vectors.near_duplicates(df.limit(0)).count() == 0


def test_records(spark, docs, none):
    def enc():
        return lambda texts: [bytes(4 * len(t)) for t in texts]

    got = records.read_records(records.write_records(docs, enc, shared_dir(spark))).orderBy("start").collect()
    assert len(got) == len(ROWS) and [r["doc_id"] for r in got][:2] == [None, None] and got[-1]["doc_id"] == 9
    assert all(b["start"] == a["start"] + a["n_tokens"] for a, b in zip(got, got[1:])) and {r["doc_id"]: r["n_tokens"] for r in got}[4] == 1
    assert records.read_records(records.write_records(none, enc, shared_dir(spark))).count() == 0


def test_packing(docs, none):
    rows = packing.pack(docs, encode()).collect()
    assert sum(r["length"] for r in rows if r["start"] == 0) <= sum(r["length"] for r in rows)
    assert sum(r["doc_tokens"] for r in rows if r["start"] == 0) == sum(r["length"] for r in rows) and sum(r["start"] == 0 for r in rows) == len(ROWS)
    assert packing.pack(none, encode()).count() == 0


def test_suffixes(docs, none):
    got = {r["doc_id"]: r for r in suffixes.digest(docs).collect()}
    assert got[2]["n_removed"] == len(SAME) and got[1]["n_removed"] == 0 and got[3]["n_bytes"] == 0 and got[9]["n_removed"] == 0
    assert suffixes.digest(docs).count() == len(ROWS) and suffixes.digest(none).count() == 0
    assert suffixes.without_repeats(docs).columns == docs.columns


def test_chat(spark):
    df = spark.createDataFrame([(1, 0, "user", None, "x"), (1, 0, "user", "a", "x"), (1, 0, "user", "a", "x"), (None, None, None, "b", "x"), (2, 1, "assistant", "</s>" * 1000, "x")], "conv_id long, turn long, role string, text string, turns string")
    got = {r["conv_id"]: r for r in chat.digest(chat.format_table(df)).collect()}
    assert got[1]["n_turns"] == 3 and got[None]["n_turns"] == 1 and got[2]["loss_chars"] == 4000
    assert chat.format_table(df.limit(0)).count() == 0


def test_chat_parts_that_make_no_sense(spark):
    parts = ['[{"type": "text", "text": "a"}, null, {"type": "image", "ref": "i.png", "width": 600, "height": 100}, {"type": "video"}, {"type": "audio", "seconds": "long"}, 5]', "no json <|", "7", '"str</s>"', None, "[]", '{"type": "document", "ref": "d"}']
    df = spark.createDataFrame([(i, 0, "assistant", x) for i, x in enumerate(parts)], "conv_id long, turn long, role string, parts string")
    got = {r["conv_id"]: r for r in chat.format_table(df, "parts").collect()}
    read = {i: chat.read_chat(r["formatted"])[0][1] for i, r in got.items()}
    assert read == {0: "a<|image:0|><|unknown:0|><|unknown:1|><|unknown:2|>", 1: "no json <|", 2: "7", 3: "str</s>", 4: "", 5: "", 6: "<|document:0|>"}
    assert [(a["kind"], a["ref"], a["tokens"]) for a in got[0]["attachments"]] == [("image", "i.png", 512), ("unknown", "", 0), ("unknown", "", 0), ("unknown", "", 0)] and got[6]["attachments"][0]["tokens"] == 768


def test_mixed_sources_of_one_document(spark):
    rows = [(1, "one two three", "a", 0), (1, "one two three", "b", 0), (None, "x y", "a", 0), (None, "z", "a", 0), (2, "four five", "b", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    taken = {r["_s"]: r["t"] for r in mixing.mix(df, carried=(df["source"].alias("_s"),)).groupBy("_s").agg({"taken": "sum"}).withColumnRenamed("sum(taken)", "t").collect()}
    got: dict = {}
    for r in mixing.mixed(df).collect():
        got[r["source"]] = got.get(r["source"], 0) + len(r["text"].split())
    assert got == taken and len(got) == 2


def test_langid(docs, none):
    m = langid.fit(docs)
    got = {r["doc_id"]: r for r in langid.predict(docs, m).collect()}
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (3, 4, 5, 8)) and langid.predict(docs, m).count() == len(ROWS)
    assert langid.fit(none).languages == [] and langid.predict(none, langid.fit(none)).count() == 0
    assert langid.known(docs).columns == docs.columns


def test_html(spark):
    df = spark.createDataFrame([(1, "http://a/x", None, "t"), (2, None, "<p>one", "t"), (3, "", "", "t"), (2, None, "<p>one", "t"), (4, "http://a/y", "<p>" + "z " * 50_000, "t"), (5, "::bad", "<<<>>&#xZZ;<a", "t")], "page_id long, url string, html string, text string")
    got = {r["page_id"]: r for r in html.extract(df).collect()}
    assert got[1]["text"] == got[3]["text"] == "" and got[2]["text"] == "one" and got[4]["n_chars"] == 99_999
    assert html.extract(df).count() == 6 and html.extract(df.limit(0)).count() == 0


def test_stages(spark, docs, none):
    for d in (docs, none):
        out = d
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, out, "")
            if k < len(corpus_pipeline.STAGES) - 1:
                assert out.columns == d.columns
        out.count()
