"""Formats, parsers, archives, folders, discovery, batches, streams, the API and the command line."""

import io
import json
import struct
import zipfile

import pytest

from quillguard import api, cli
from quillguard.operators import discovery
from quillguard.operators.progress import Progress, Tracker
from quillguard.sources import files, formats, parsers, rewrite
from quillguard.streaming import scan as stream



def spaces(**names: str) -> str:
    """Namespace declarations by prefix; plain is the default one."""
    return " ".join(f'xmlns{"" if k == "plain" else ":" + k}="{v.strip("{}")}"' for k, v in names.items())


W = spaces(w=parsers._W)
S = spaces(plain=parsers._S, r=parsers._R)
P = spaces(p=parsers._P, a=parsers._A)


def zipped(parts: dict) -> bytes:
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w", zipfile.ZIP_DEFLATED) as z:
        for k, v in parts.items():
            z.writestr(k, v)
    return b.getvalue()


def tag(names: str, inner: str) -> str:
    """inner in elements, the outermost first."""
    for n in reversed(names.split()):
        inner = f"<{n}>{inner}</{n.split()[0]}>"
    return inner


def docx() -> bytes:
    text = lambda t: tag("w:p w:r w:t", t)
    root = lambda name, inner: f"<w:{name} {W}>{inner}</w:{name}>"
    body = root("document", tag("w:body", text("Mail a@b.de") + tag("w:tbl w:tr w:tc", text("cell"))))
    core = '<cp:coreProperties xmlns:cp="c" xmlns:dc="d"><dc:title>T</dc:title><dc:creator>Ann</dc:creator></cp:coreProperties>'
    return zipped({"word/document.xml": body, "word/header1.xml": root("hdr", text("Head")), "docProps/core.xml": core})


def xlsx() -> bytes:
    book = f'<workbook {S}><sheets><sheet name="One" r:id="r1"/><sheet name="Two" state="hidden" r:id="r2"/></sheets></workbook>'
    rels = '<Relationships xmlns="x">' + "".join(f'<Relationship Target="worksheets/sheet{i}.xml" Id="r{i}"/>' for i in (1, 2)) + "</Relationships>"
    one = f'<worksheet {S}><sheetData><row r="2"><c r="B2" t="s"><v>0</v></c><c r="AA2"><v>3.5</v></c><c r="AB2" t="b"><v>1</v></c></row><row r="3"><c r="A3" t="e"><v>#REF!</v></c></row></sheetData></worksheet>'
    two = f'<worksheet {S}><sheetData><row r="1"><c r="A1" t="inlineStr"><is><t>x@y.zz</t></is></c></row></sheetData></worksheet>'
    return zipped({"xl/workbook.xml": book, "xl/_rels/workbook.xml.rels": rels, "xl/sharedStrings.xml": f"<sst {S}><si><t>shared</t></si></sst>", "xl/worksheets/sheet1.xml": one, "xl/worksheets/sheet2.xml": two})


def pptx() -> bytes:
    sp = lambda ph, t: f'<p:sp><p:nvSpPr><p:nvPr>{ph}</p:nvPr></p:nvSpPr><p:txBody>{tag("a:p a:r a:t", t)}</p:txBody></p:sp>'
    slide = f'<p:sld {P}>' + sp('<p:ph type="title"/>', "Title") + sp("", "Body") + "</p:sld>"
    return zipped({"ppt/presentation.xml": "<p/>", "ppt/slides/slide1.xml": slide, "ppt/notesSlides/notesSlide1.xml": f"<p:notes {P}>" + sp("", "Note") + "</p:notes>"})


def pdf(*pages: str, encrypted: bool = False) -> bytes:
    out = b"%PDF-1.4\n"
    for i, text in enumerate(pages):
        stream_ = b"BT " + b" T* ".join(b"(" + line.encode("latin-1").replace(b"(", b"\\(").replace(b")", b"\\)") + b") Tj" for line in text.split("\n")) + b" ET"
        out += f"{2 * i + 3} 0 obj <</Type /Page /Contents {2 * i + 4} 0 R>> endobj\n{2 * i + 4} 0 obj <</Length {len(stream_)}>>\nstream\n".encode() + stream_ + b"\nendstream endobj\n"
    return out + (b"/Encrypt" if encrypted else b"") + b"trailer <<>> %%EOF"


def msg(streams: dict[str, bytes]) -> bytes:
    """A compound file with everything in large sectors (a mini cutoff of 0)."""
    names, data, fat, start = ["Root Entry", *streams], b"", [], {}
    for k, v in streams.items():
        n = max(1, -(-len(v) // 512))
        start[k] = len(fat)
        fat += [*range(len(fat) + 1, len(fat) + n), 0xFFFFFFFE]
        data += v.ljust(n * 512, b"\0")
    directory = b""
    for i, k in enumerate(names):
        raw = k.encode("utf-16-le") + b"\0\0"
        right = i + 1 if 0 < i < len(names) - 1 else 0xFFFFFFFF
        directory += raw.ljust(64, b"\0") + struct.pack("<HBBIII", len(raw), 5 if i == 0 else 2, 1, 0xFFFFFFFF, right, 1 if i == 0 else 0xFFFFFFFF) + bytes(36) + struct.pack("<IQ", start.get(k, 0xFFFFFFFE), len(streams.get(k, b"")))
    dir_start, n = len(fat), -(-len(directory) // 512)
    fat += [*range(len(fat) + 1, len(fat) + n), 0xFFFFFFFE]
    data += directory.ljust(n * 512, b"\0")
    fat_at = len(fat)
    fat.append(0xFFFFFFFD)
    data += struct.pack("<128I", *fat, *[0xFFFFFFFF] * (128 - len(fat)))
    head = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1" + bytes(16) + struct.pack("<HHHHH", 62, 3, 0xFFFE, 9, 6) + bytes(10) + struct.pack("<IIIIIIIII", 1, dir_start, 0, 0, 0xFFFFFFFE, 0, 0xFFFFFFFE, 0, fat_at)
    return (head + b"\xff" * (512 - len(head)))[:512] + data


EML = b"From: Ann <ann@b.de>\r\nTo: x@y.zz, q@r.st\r\nSubject: =?utf-8?q?H=C3=A9?=\r\nMIME-Version: 1.0\r\nContent-Type: multipart/mixed; boundary=B\r\n\r\n--B\r\nContent-Type: text/plain; charset=utf-8\r\nContent-Transfer-Encoding: base64\r\n\r\nw6kgYm9keQ==\r\n--B\r\nContent-Type: text/html\r\n\r\n<p>html <b>part</b></p>\r\n--B\r\nContent-Disposition: attachment; filename=f.txt\r\n\r\nx\r\n--B--\r\n"


def contents(raw, format, **o):
    return [s["content"] for s in parsers.parse_bytes(raw, format, **o)[0]]


def test_parsers():
    s, w = parsers.parse_text(b"a\r\n\xc3\xa9\n\xff\n")
    assert [(x["content"], x["position"]["line"], x["position"]["byte_offset"]) for x in s] == [("a", 1, 0), ("é", 2, 3), ("�", 3, 6)] and w[0]["code"] == "lossy_encoding"
    assert contents("é".encode("utf-16"), "text") == ["é"] and contents(b"\x80", "text", encoding="iso-8859-1") == ["€"]
    s, w = parsers.parse_csv(b"n,m\na,b\nc\n")
    assert [(x["content"], x["position"]["row"], x["position"]["column"], x["position"].get("header")) for x in s] == [("a", 2, 0, "n"), ("b", 2, 1, "m"), ("c", 3, 0, "n")] and w[0]["code"] == "inconsistent_columns"
    assert [(x["content"], x["position"]["path"]) for x in parsers.parse_json(b'{"a": [1, "x", {"b": "y"}]}')[0]] == [("x", "$.a[1]"), ("y", "$.a[2].b")]
    assert contents(b"<html><head><title>t</title></head><body>a<script>x</script><p> b &amp; c </p></body></html>", "html") == ["a", "b & c"]
    assert contents(b"<p>no body", "html") == ["no body"]
    assert contents(docx(), "docx") == ["Mail a@b.de", "cell", "Head", "T", "Ann"]
    s, _ = parsers.parse_xlsx(xlsx())
    assert [(x["content"], x["position"]["cell_ref"], x["position"]["hidden_sheet"]) for x in s] == [("shared", "One!B2", False), ("3.5", "One!AA2", False), ("TRUE", "One!AB2", False), ("#ERROR: #REF!", "One!A3", False), ("x@y.zz", "Two!A1", True)]
    assert parsers.parse_xlsx(xlsx(), max_rows=1)[1][0]["code"] == "truncated"
    assert [(x["content"], x["position"]["element"]) for x in parsers.parse_pptx(pptx())[0]] == [("Title", "title"), ("Body", "body"), ("Note", "notes")]
    assert contents(pdf("one\n\ntwo (x)", "three"), "pdf") == ["one", "two (x)", "three"] or contents(pdf("one two (x)", "three"), "pdf") == ["one two (x)", "three"]
    assert contents(EML, "eml") == ["Ann <ann@b.de>", "x@y.zz", "q@r.st", "Hé", "é body", "html\npart", "f.txt"]
    m = msg({"__substg1.0_0037001F": "Hi".encode("utf-16-le"), "__substg1.0_0C1F001F": "a@b.de".encode("utf-16-le"), "__substg1.0_1000001E": b"> q\n> r\nx"})
    s, _ = parsers.parse_msg(m)
    assert [x["content"] for x in s] == ["a@b.de", "Hi", "> q\n> r\nx"] and s[-1]["position"]["is_quoted"]


@pytest.mark.parametrize("raw, format, kind", [(b"x", "pdf", "corrupted"), (pdf("a", encrypted=True), "pdf", "encrypted"), (b"{", "json", "parse_error"), (b"PK", "docx", "corrupted"), (zipped({"../x": "y"}), "docx", "unsafe"), (zipped({"a": "0" * 10**6}), "docx", "unsafe"), (b"x", "nope", "unsupported_format"), (b"junk", "msg", "corrupted")])
def test_errors(raw, format, kind):
    with pytest.raises(parsers.ParseError) as e:
        parsers.parse_bytes(raw, format)
    assert e.value.kind == kind


def test_quotes_and_names():
    text = "hello\nOn Monday Ann wrote:\n> old\n>> older\nbye\n----- Original Message -----\nrest"
    assert [(t.split("\n")[0], q) for t, q in parsers.detect_quotes(text)] == [("hello", False), ("On Monday Ann wrote:", True), ("bye", False), ("----- Original Message -----", True)]
    assert parsers.strip_quote_prefix(">> | x") == "x" and [formats.column_letter(i) for i in (0, 25, 26, 701, 702)] == ["A", "Z", "AA", "ZZ", "AAA"]
    assert rewrite.replaced('{"a": "x"}', "json", ["y"]) == '{\n  "a": "y"\n}' and formats.is_supported("a.EML") and not formats.is_supported("a.exe")


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("in")
    (d / "sub").mkdir()
    own = {"a.txt": b"mail a@b.de\n", "b.csv": b"n,m\nAnn,c@d.ef\n", "sub/c.json": b'{"k": "4111111111111111"}', "d.docx": docx(), "e.pdf": b"%PDF-broken", "f.eml": EML, "g.zip": zipped({"in.txt": "z@z.zz", "n.zip": zipped({"deep.txt": "y@y.yy"})}), "h.md": b"#", "i.html": b"<p>u@v.wx</p>"}
    for k, v in own.items():
        (d / k).write_bytes(v)
    return str(d)


def test_folders(spark, folder):
    parsed = files.parse_files(spark, folder).cache()
    by = {r["path"].rpartition("/")[2]: r for r in parsed.collect()}
    assert {k: r["format"] for k, r in by.items()} == {"a.txt": "text", "b.csv": "csv", "c.json": "json", "d.docx": "docx", "e.pdf": "pdf", "f.eml": "eml", "g.zip": "xlsx", "h.md": "text", "i.html": "html"}
    assert by["e.pdf"]["error_kind"] == "corrupted" and by["g.zip"]["error_kind"] and len(by["h.md"]["segments"]) == 1
    assert files.read_files(spark, folder, max_depth=1).count() == 8 and files.read_files(spark, folder, include=["*.txt"], exclude=["a*"]).count() == 0
    assert sorted(r["path"].rpartition("!/")[2] for r in files.archive_entries(files.read_files(spark, folder, include=["*.zip"])).collect()) == ["deep.txt", "in.txt"]
    s = discovery.batch_summary(parsed).first()
    assert s["successful"] + s["failed"] + s["skipped"] == 9 and s["failed"] >= 1
    scanned = discovery.scan(spark, folder).cache()
    assert {r["category"]: (r["findings"], r["files"]) for r in discovery.inventory(scanned).collect()}["credit_card"] == (1, 1)
    assert discovery.locations(scanned).where("snippet is not null").count() == 0 and discovery.locations(scanned, True).where("snippet = 'a@b.de'").count() == 2
    assert json.loads(discovery.report(scanned, "json"))["statistics"]["files"] == 9 and "path,category,count" in discovery.report(scanned, "csv") and "email" in discovery.report(scanned)
    hidden = [json.loads(r["value"]) for r in discovery.scan_output(scanned).collect()]
    assert not any("text" in f for r in hidden for f in r["findings"])
    with pytest.raises(PermissionError):
        discovery.scan_output(scanned, include_values=True)
    o = discovery.Options(max_file_size=4, sample_size=4)
    assert discovery.inventory(discovery.scan(spark, folder + "/a.txt", options=o)).count() == 0


def test_streams(spark, tmp_path):
    d = tmp_path / "in"
    d.mkdir()
    (d / "1.txt").write_text("a@b.de\nnone\n")
    (d / "2.txt").write_text("c@d.ef 123-45-6789\n")
    s = stream.scan_lines(stream.read_lines(spark, str(d)), include_content=True)
    stream.run(s, "lines").awaitTermination()
    assert spark.table("lines").where("size(findings) > 0").count() == 2
    stream.run(stream.totals(stream.scan_lines(stream.read_lines(spark, str(d)))), "sums", "complete").awaitTermination()
    assert {r["category"]: r["count"] for r in spark.table("sums").collect()} == {"email": 2, "ssn": 1}
    seen = []
    stream.run_batches(s, lambda b, i: seen.append(b.count())).awaitTermination()
    assert sum(seen) == 3
    parts = list(stream.chunk_texts(iter([b"hello wor", b"ld x@y", b".zz and", b"\xff", b" end"])))
    # the bad byte takes the white space behind it along, not the word before
    assert [t for _, t, _ in parts] == ["hello ", "world ", "x@y.zz ", "and", None, "end"] and [at for at, *_ in parts] == [0, 6, 12, 19, 22, 24]
    # a character in two chunks is no bad one
    assert list(stream.chunk_texts(iter([b"mail x@y.de caf\xc3", b"\xa9 a@b.de ", b"\xf0\x9f", b"\x99\x82"]))) == [(0, "mail x@y.de ", None), (12, "café a@b.de ", None), (25, "🙂", None)]
    whole = "héllo wörld ünd 🙂 " * 40
    for n in (1, 2, 3, 7, 64):
        assert "".join(t for _, t, _ in stream.chunk_texts(whole.encode()[i : i + n] for i in range(0, len(whole.encode()), n))) == whole
    with pytest.raises(OverflowError):
        list(stream.chunk_texts(iter([b"x" * 1000]), max_buffer=50))
    assert stream.split_at(b"ab") == 2 and stream.split_at(b"x" * 200) == 150 and stream.split_at(b"ab\xc3") == 2 and stream.split_at(b"") == 0


def test_chunks_with_state(spark, tmp_path):
    rows = [("s", 1, b"mail a@"), ("s", 2, b"b.de caf\xc3"), ("s", 3, b"\xa9"), ("s", 4, None), ("t", 1, b"\xff"), ("t", 2, None), ("u", 1, b"x" * 99_000), ("u", 2, b" y"), ("u", 3, None)]
    kind = "stream_id string, seq long, chunk binary"
    spark.createDataFrame(rows, kind).coalesce(1).write.parquet(f"{tmp_path}/c")
    q = stream.run(stream.scan_chunks(spark.readStream.schema(kind).parquet(f"{tmp_path}/c")), "chunks")
    q.awaitTermination()
    got = [(r["stream_id"], r["byte_offset"], r["content"], bool(r["error"])) for r in spark.table("chunks").orderBy("stream_id", "byte_offset").collect()]
    assert got[:4] == [("s", 0, "mail ", False), ("s", 5, "a@b.de ", False), ("s", 12, "café", False), ("t", 0, None, True)]
    assert [(k, at, e) for k, at, _, e in got[4:]] == [("u", 0, False), ("u", 74_250, False), ("u", 99_001, False)]


def test_large_files_by_spark(spark, tmp_path):
    lines = [f"row {i} é,\"a,{i}\"" for i in range(3000)]
    (tmp_path / "a.csv").write_text("name,value\n" + "\n".join(lines) + "\n", "utf-8")
    (tmp_path / "b.csv").write_text("name,value\r\nx,\r\n", "utf-8")
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")  # many splits
    try:
        got = files.text_stream(spark, str(tmp_path))
        by = {(r["path"].rpartition("/")[2], r["line"]): r["content"] for r in got.collect()}
        cells = {(r["path"].rpartition("/")[2], r["row"], r["column"]): (r["header"], r["content"]) for r in files.csv_stream(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)
    assert by == {("a.csv", 1): "name,value", **{("a.csv", i + 2): x for i, x in enumerate(lines)}, ("b.csv", 1): "name,value", ("b.csv", 2): "x,"}
    assert len(cells) == 6002 and all(cells["a.csv", i + 2, 0] == ("name", f"row {i} é") and cells["a.csv", i + 2, 1] == ("value", f"a,{i}") for i in range(3000)) and cells["b.csv", 2, 1] == ("value", "")


def test_damaged_archive_entries(spark):
    raw = bytearray(zipped({"a.txt": "a" * 50 + "bcd" * 9, "b.txt": "fine"}))
    at = raw.index(b"a.txt") + 8
    raw[at] ^= 0xFF
    df = spark.createDataFrame([("z", bytes(raw))], "path string, content binary")
    got = {r["path"]: (r["content"] and bytes(r["content"]), bool(r["warning"])) for r in files.archive_entries(df).collect()}
    assert got == {"z!/a.txt": (None, True), "z!/b.txt": (b"fine", False)}


def test_api(spark):
    r = api.scan(spark, "a@b.de and 4111111111111111", categories=("email",))
    assert r["stats"] == {"total": 1, "segments": 1, "category_counts": {"email": 1}} and "matched_text" not in r["findings"][0]
    assert api.scan(spark, b'{"a": "x@y.zz"}', "json", include_values=True, acknowledge_exposure=True)["findings"][0]["matched_text"] == "x@y.zz"
    assert api.protect(spark, "to a@b.de")["text"] == "to [EMAIL]" and "pdf" in api.supported_formats() and "email" in api.available_categories()
    for bad in (lambda: api.scan(spark, ""), lambda: api.scan(spark, b"{", "json")):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(PermissionError):
        api.scan(spark, "x", include_values=True)


def test_progress(spark):
    with Tracker(spark, "g") as t:
        spark.range(10).repartition(3).count()
    p = t.snapshot()
    assert p.total and p.percentage <= 100 and Progress(1, 0, 4, 2.0).eta == 6.0 and Progress(0, 0, 0, 1.0).eta is None and Progress(4, 0, 4, 1.0).complete


def test_command_line(spark, folder, tmp_path, capsys):
    assert cli.main(["policy", "init"]) == 0
    p = tmp_path / "p.yaml"
    p.write_text(capsys.readouterr().out)
    assert cli.main(["policy", "validate", str(p)]) == 0
    capsys.readouterr()
    assert cli.main(["scan", folder + "/a.txt", "--fail-on-findings", "--policy", str(p)]) == 2 and "a@b.de" not in capsys.readouterr().out
    assert cli.main(["scan", folder + "/a.txt", "--include-values", "--yes"]) == 0 and "a@b.de" in capsys.readouterr().out
    assert cli.main(["protect", folder + "/a.txt"]) == 0 and capsys.readouterr().out == "mail [EMAIL]\n\n"
    assert cli.main(["batch", folder]) == 0 and "successful" in capsys.readouterr().out
    assert cli.main(["discover", folder, "--report", "json"]) == 0 and json.loads(capsys.readouterr().out)
    assert cli.main(["crypto", "hash", "x"]) == 0 and len(capsys.readouterr().out.strip()) == 64
    with pytest.raises(SystemExit):
        cli.main(["nope"])


def test_parsed_once_and_in_portions(spark):
    """Parsers run once, after the rows are dealt out; portions end inside a batch; a text that no column holds is its file's error alone."""
    lines = "\n".join(f"line {i}" for i in range(30_000))
    raw = [("text", f"{n} {lines}".encode()) for n in range(3)] + [("json", b'["\\ud800"]'), ("json", b'["ok"]'), ("nope", b""), ("text", None)]
    df = spark.createDataFrame([(i, f, bytearray(b) if b is not None else None, 10 if i != 5 else 10**9) for i, (f, b) in enumerate(raw)], "id int, format string, content binary, size_bytes long").coalesce(1)
    p = files.parsed(df)
    s = files.segments(p, keep=("id",))
    plan = s._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 0 and plan.count("MapInArrow") == 1
    got = {r["id"]: r for r in p.collect()}
    assert [[x["content"] for x in got[n]["segments"]] == f"{n} {lines}".split("\n") for n in range(3)] == [True] * 3
    assert got[2]["segments"][-1]["position"]["line"] == 30_000 and got[2]["segments"][-1]["position"]["page"] is None
    assert [got[i]["error_kind"] for i in range(7)] == [None, None, None, "parse_error", None, "file_too_large", None]
    assert [x["content"] for x in got[4]["segments"]] == ["ok"] and p.columns == ["id", "format", "size_bytes", "segments", "warnings", "error_kind", "error"]
    assert s.count() == 3 * 30_000 + 1


def test_small_files_share_tasks(spark, tmp_path):
    """Hundreds of small files in a folder are a few tasks a core; each is read, and filters reach the reader."""
    for i in range(700):
        (tmp_path / f"k{i}.txt").write_text(f"no. {i}")
    df = files.read_files(spark, str(tmp_path), max_size=6)
    n = 4 * spark.sparkContext.defaultParallelism
    assert files.read_files(spark, str(tmp_path)).rdd.getNumPartitions() <= n < 700 // 32
    assert sorted(bytes(r["content"]).decode() for r in df.collect()) == sorted(f"no. {i}" for i in range(100))
    plan = df.select("path")._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(length,6)" in plan and "content" not in plan.split("ReadSchema")[-1]
    assert df.where("path like '%k1.txt'").count() == 1
    assert discovery.scan(spark, str(tmp_path)).count() == 700


def test_chunks_of_many_streams(spark, tmp_path, monkeypatch):
    """Streams that share a part of the state don't mix, over two batches; groups are parts, not streams."""
    monkeypatch.setattr(stream, "BUCKETS", 3, raising=False)
    kind = "stream_id string, seq long, chunk binary"
    texts = {f"s{i}": f"stream {i} é a{i}@b.de\nend" for i in range(40)}
    for half in range(2):
        rows = [(k, n, bytearray(t.encode()[n * 5 : n * 5 + 5])) for k, t in texts.items() for n in range(3 * half, 3 if not half else 9)] + ([(k, 9, None) for k in texts] if half else [])
        spark.createDataFrame(rows[::-1], kind).write.mode("append").parquet(f"{tmp_path}/c")
        cut = stream.scan_chunks(spark.readStream.schema(kind).parquet(f"{tmp_path}/c"))
        assert "_bucket" in cut._jdf.queryExecution().analyzed().toString()
        stream.run_batches(cut, lambda b, i: b.write.mode("overwrite").parquet(f"{tmp_path}/out/{i}"), f"{tmp_path}/check").awaitTermination()
    got: dict = {}
    for r in sorted(spark.read.parquet(f"{tmp_path}/out/*").collect(), key=lambda r: r["byte_offset"]):
        assert r["error"] is None and r["byte_offset"] == len(got.get(r["stream_id"], "").encode())
        got[r["stream_id"]] = got.get(r["stream_id"], "") + r["content"]
    assert got == texts
