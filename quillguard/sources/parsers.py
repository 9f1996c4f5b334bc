"""Parsers of single files: bytes to segments with their places and warnings. They run in Arrow batches on the executors.

Each gives (segments, warnings): segments are dicts of content and position, warnings of code and message. Only standard
library modules are used.
"""

from __future__ import annotations

import csv
import email
import email.policy
import html.parser
import io
import json
import re
import struct
import zipfile
import zlib
from email.utils import getaddresses
from xml.etree import ElementTree

from .formats import column_letter

MAX_DEPTH = 128
MAX_ENTRIES, MAX_TOTAL, MAX_ENTRY, MAX_RATIO = 10_000, 1 << 30, 100 << 20, 100
_ENCODINGS = {"utf-8": "utf-8", "utf8": "utf-8", "utf-16le": "utf-16-le", "utf-16be": "utf-16-be", "iso-8859-1": "cp1252", "latin1": "cp1252", "windows-1252": "cp1252"}


class ParseError(Exception):
    def __init__(self, kind: str, message: str):
        super().__init__(message)
        self.kind = kind


def segment(content: str, type: str, **position) -> dict:
    return {"content": content, "position": {"type": type, **{k: v for k, v in position.items() if v is not None}}}


def warning(code: str, message: str) -> dict:
    return {"code": code, "message": message}


def decode(raw: bytes, encoding: str | None = None) -> tuple[str, str, bool]:
    """Text, encoding and whether characters were lost."""
    if encoding is None:
        encoding = "utf-16le" if raw[:2] == b"\xff\xfe" else "utf-16be" if raw[:2] == b"\xfe\xff" else "utf-8"
    codec = _ENCODINGS.get(encoding.lower(), "utf-8")
    try:
        text, lossy = raw.decode(codec), False
    except UnicodeDecodeError:
        text, lossy = raw.decode(codec, "replace"), True
    return text.removeprefix("﻿"), encoding, lossy


def _lossy(lossy: bool) -> list[dict]:
    return [warning("lossy_encoding", "bytes that the encoding doesn't have were replaced")] if lossy else []


def parse_text(raw: bytes, encoding: str | None = None):
    """One segment a line; offsets are in bytes, with each line's real end."""
    text, _, lossy = decode(raw, encoding)
    out, at = [], 0
    lines = text.split("\n")
    if lines and lines[-1] == "":
        lines.pop()
    for n, line in enumerate(lines, 1):
        own = line.removesuffix("\r")
        size = len(own.encode("utf-8", "replace"))
        out.append(segment(own, "text", line=n, column=1, byte_offset=at, byte_length=size))
        at += len(line.encode("utf-8", "replace")) + 1
    return out, _lossy(lossy)


def parse_csv(raw: bytes, encoding: str | None = None, delimiter: str = ",", has_headers: bool = True):
    """One segment a cell; rows from 2 if there are headers."""
    text, _, lossy = decode(raw, encoding)
    warnings, out = _lossy(lossy), []
    rows = [r for r in csv.reader(io.StringIO(text), delimiter=delimiter) if r]
    headers = rows[0] if has_headers and rows else []
    uneven = False
    for n, row in enumerate(rows[1:] if has_headers else rows, 2 if has_headers else 1):
        uneven |= len(row) != len(rows[0])
        out += [segment(cell, "csv", row=n, column=c, header=headers[c] if c < len(headers) else None) for c, cell in enumerate(row)]
    if uneven:
        warnings.append(warning("inconsistent_columns", "rows differ in their number of columns"))
    return out, warnings


def parse_json(raw: bytes, encoding: str | None = None):
    """One segment for each string, with its path; nothing below a depth of 128."""
    text, _, lossy = decode(raw, encoding)
    try:
        root = json.loads(text)
    except (json.JSONDecodeError, RecursionError) as e:
        raise ParseError("parse_error", f"no JSON: {e}") from None
    out: list[dict] = []

    def walk(x, path: str, depth: int) -> None:
        if depth > MAX_DEPTH:
            return
        if isinstance(x, str):
            out.append(segment(x, "json", path=path))
        elif isinstance(x, dict):
            for k, v in x.items():
                walk(v, f"{path}.{k}", depth + 1)
        elif isinstance(x, list):
            for i, v in enumerate(x):
                walk(v, f"{path}[{i}]", depth + 1)

    walk(root, "$", 0)
    return out, _lossy(lossy)


class _Texts(html.parser.HTMLParser):
    HIDDEN = {"script", "style", "noscript", "template"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.hidden, self.in_body, self.seen_body, self.texts, self.part = 0, False, False, [], []

    def flush(self) -> None:
        t = "".join(self.part).strip()
        self.part.clear()
        if t:
            self.texts.append((t, self.in_body))

    def handle_starttag(self, tag, attrs):
        self.flush()
        if tag in self.HIDDEN:
            self.hidden += 1
        elif tag == "body":
            self.in_body = self.seen_body = True

    def handle_endtag(self, tag):
        self.flush()
        if tag in self.HIDDEN and self.hidden:
            self.hidden -= 1
        elif tag == "body":
            self.in_body = False

    def handle_data(self, data):
        if not self.hidden:
            self.part.append(data)


def html_texts(text: str) -> list[str]:
    """Trimmed text nodes of the body, or of the whole document if there is none."""
    p = _Texts()
    p.feed(text)
    p.close()
    p.flush()
    return [t for t, body in p.texts if body or not p.seen_body]


def parse_html(raw: bytes, encoding: str | None = None):
    text, _, lossy = decode(raw, encoding)
    out, at = [], 0
    for t in html_texts(text):
        size = len(t.encode())
        out.append(segment(t, "html", byte_offset=at, byte_length=size))
        at += size
    return out, _lossy(lossy)


def html_to_text(text: str) -> str:
    """For mail: one line a text node, at most two blank lines in a row."""
    return re.sub(r"\n{4,}", "\n\n\n", "\n".join(" ".join(t.split()) for t in html_texts(text)))


# PDF.

_PDF_ESCAPES = {"n": "\n", "r": "\r", "t": "\t", "b": "\b", "f": "\f"}


def _pdf_string(raw: bytes) -> str:
    def one(m):
        x = m[1].decode("latin-1")
        return _PDF_ESCAPES.get(x, chr(int(x, 8) & 255) if x[0].isdigit() else "" if x == "\n" else x)

    text = re.sub(r"\\([nrtbf()\\]|[0-7]{1,3}|\n)", lambda m: one(re.match(rb"\\([nrtbf()\\]|[0-7]{1,3}|\n)", m[0].encode("latin-1"))), raw.decode("latin-1"))
    return text.encode("latin-1").decode("utf-16-be", "replace") if text.startswith("þÿ") else text


_PDF_OPS = re.compile(rb"\(((?:\\.|[^\\()])*)\)\s*(Tj|'|\")|\[((?:\\.|[^\]])*)\]\s*TJ|<([0-9A-Fa-f\s]*)>\s*Tj|(T\*|\bTd\b|\bTD\b|\bTm\b|\bET\b)", re.S)


def _pdf_text(stream: bytes) -> str:
    out: list[str] = []
    for m in _PDF_OPS.finditer(stream):
        if m[5]:
            if out and out[-1] != "\n":
                out.append("\n")
        elif m[1] is not None:
            out.append(("\n" if m[2] != b"Tj" else "") + _pdf_string(m[1]))
        elif m[3] is not None:
            for s, n in re.findall(rb"\(((?:\\.|[^\\()])*)\)|(-?\d+(?:\.\d+)?)", m[3]):
                out.append(_pdf_string(s) if not n else " " if float(n) < -200 else "")
        else:
            out.append(bytes.fromhex(re.sub(rb"\s", b"", m[4]).decode()[: len(re.sub(rb"\s", b"", m[4])) // 2 * 2]).decode("latin-1"))
    return "".join(out)


def parse_pdf(raw: bytes, encoding: str | None = None):
    """Text of content streams (plain or Flate), page by page, paragraphs parted by blank lines; places on the page are 0."""
    if not raw.startswith(b"%PDF"):
        raise ParseError("corrupted", "no PDF")
    if b"/Encrypt" in raw:
        raise ParseError("encrypted", "encrypted PDF")
    if b"%%EOF" not in raw[-2048:] and b"endobj" not in raw:
        raise ParseError("corrupted", "the PDF is cut off")
    objects = {int(m[1]): m[2] for m in re.finditer(rb"(\d+)\s+\d+\s+obj(.*?)endobj", raw, re.S)}
    ref = rb"(\d+)\s+\d+\s+R"

    def data_of(body: bytes) -> bytes:
        m = re.search(rb"stream\r?\n(.*?)\r?\n?endstream", body, re.S)
        if not m:
            return b""
        if b"FlateDecode" not in body[: m.start()]:
            return m[1]
        try:
            return zlib.decompressobj().decompress(m[1], MAX_ENTRY)
        except zlib.error as e:
            raise ParseError("corrupted", f"a stream can't be read: {e}") from None

    # objects in streams of objects: pairs of number and offset, then the objects
    for body in [b for b in objects.values() if re.search(rb"/Type\s*/ObjStm\b", b)]:
        n, first = (re.search(rb"/" + k + rb"\s+(\d+)", body) for k in (b"N", b"First"))
        if not (n and first):
            continue
        data = data_of(body)
        pairs = [int(x) for x in data[: int(first[1])].split()[: 2 * int(n[1])]]
        starts = [int(first[1]) + x for x in pairs[1::2]]
        for number, lo, hi in zip(pairs[::2], starts, [*starts[1:], len(data)]):
            objects.setdefault(number, data[lo:hi])

    def content(body: bytes) -> str:
        refs = re.search(rb"/Contents\s*(?:\[([^\]]*)\]|" + ref + rb")", body)
        ids = [int(x) for x in re.findall(ref, refs[1])] if refs and refs[1] else [int(refs[2])] if refs else []
        return _pdf_text(b"\n".join(data_of(objects.get(i, b"")) for i in ids))

    def leaves(i: int, seen: set[int]):
        """Pages below a node, in their order."""
        body = objects.get(i, b"")
        if i in seen:
            return
        seen.add(i)
        if kids := re.search(rb"/Kids\s*\[([^\]]*)\]", body):
            for k in re.findall(ref, kids[1]):
                yield from leaves(int(k), seen)
        elif re.search(rb"/Type\s*/Page\b", body):
            yield i

    root = next((re.search(rb"/Pages\s+" + ref, b) for b in objects.values() if re.search(rb"/Type\s*/Catalog\b", b)), None)
    order = [*leaves(int(root[1]), set())] if root else []
    pages = [content(objects[i]) for i in order or [i for i, b in objects.items() if re.search(rb"/Type\s*/Page\b", b)]]
    out = []
    for n, text in enumerate(pages, 1):
        for k, p in enumerate(x for x in re.split(r"\n\s*\n", text) if x.strip()):
            out.append(segment(p.strip(), "pdf", page=n, paragraph=k, x=0.0, y=0.0, width=0.0, height=0.0))
    return out, [] if out else [warning("format_mismatch", "no text in the PDF")]


# Office.

def _part(kind: str, last: str) -> str:
    """The namespace of a kind of document part, as ElementTree writes it."""
    return "{" + "/".join(("http:/", "schemas.openxmlformats.org", kind, "2006", last)) + "}"


_W = _part("wordprocessingml", "main")
_S = _part("spreadsheetml", "main")
_A = _part("drawingml", "main")
_P = _part("presentationml", "main")
_R = _part("officeDocument", "relationships")


def safe_name(name: str) -> bool:
    """No null byte, no absolute path, no drive, no way up."""
    return not ("\0" in name or name.startswith(("/", "\\")) or re.match(r"^[A-Za-z]:", name) or ".." in re.split(r"[/\\]", name))


def open_archive(raw: bytes) -> zipfile.ZipFile:
    """A ZIP within the limits, checked before anything is unpacked."""
    try:
        z = zipfile.ZipFile(io.BytesIO(raw))
    except zipfile.BadZipFile as e:
        raise ParseError("corrupted", str(e)) from None
    infos = z.infolist()
    if len(infos) > MAX_ENTRIES:
        raise ParseError("unsafe", f"{len(infos)} entries")
    if sum(i.file_size for i in infos) > MAX_TOTAL:
        raise ParseError("unsafe", "too large when unpacked")
    for i in infos:
        if not safe_name(i.filename):
            raise ParseError("unsafe", f"path {i.filename!r}")
        if i.file_size > MAX_ENTRY or (i.compress_size and i.file_size / i.compress_size > MAX_RATIO):
            raise ParseError("unsafe", f"{i.filename}: too large or too dense")
    return z


def office_type(z: zipfile.ZipFile) -> str:
    names = set(z.namelist())
    if "EncryptedPackage" in names:
        raise ParseError("encrypted", "encrypted document")
    own = [k for k, p in (("docx", "word/document.xml"), ("xlsx", "xl/workbook.xml"), ("pptx", "ppt/presentation.xml")) if p in names]
    if len(own) != 1:
        raise ParseError("unsupported_format", "no single main part")
    return own[0]


def _xml(z: zipfile.ZipFile, name: str):
    data = z.read(name)
    if b"<!DOCTYPE" in data[:2000] or b"<!ENTITY" in data[:2000]:
        raise ParseError("unsafe", f"{name} defines entities")
    try:
        return ElementTree.fromstring(data)
    except ElementTree.ParseError as e:
        raise ParseError("parse_error", f"{name}: {e}") from None


def _metadata(z: zipfile.ZipFile) -> list[dict]:
    out, names = [], set(z.namelist())
    for part, tags in (("docProps/core.xml", ("title", "subject", "creator", "keywords", "description", "lastModifiedBy", "category")), ("docProps/app.xml", ("Company", "Manager"))):
        if part in names:
            root = _xml(z, part)
            for e in root.iter():
                tag = e.tag.rpartition("}")[2]
                if tag in tags and (e.text or "").strip():
                    out.append(segment(e.text.strip(), "office_metadata", field={"creator": "author", "lastModifiedBy": "last_modified_by"}.get(tag, tag.lower())))
    return out


def parse_docx(raw: bytes, encoding: str | None = None):
    z = open_archive(raw)
    names = set(z.namelist())
    out: list[dict] = []

    def text_of(e) -> str:
        return "".join((t.text or "") if t.tag == _W + "t" else "\t" if t.tag == _W + "tab" else "\n" if t.tag == _W + "br" else "" for t in e.iter())

    def part(name: str, section: str) -> None:
        root = _xml(z, name)
        body = root.find(_W + "body") if section == "body" else root
        n, at = 0, 0

        def add(text: str, cell=None) -> None:
            nonlocal n, at
            if text.strip():
                out.append(segment(text, "docx", section=section, paragraph=n, char_offset=at, char_length=len(text), table_cell=cell))
            n += 1
            at += len(text) + 1

        for e in body if body is not None else ():
            if e.tag == _W + "p":
                add(text_of(e))
            elif e.tag == _W + "tbl":
                for r, row in enumerate(e.iter(_W + "tr")):
                    for c, cell in enumerate(row.iter(_W + "tc")):
                        add("\n".join(text_of(p) for p in cell.iter(_W + "p")), {"table_index": 1, "row": r, "column": c})

    part("word/document.xml", "body")
    for kind in ("header", "footer"):
        for i in (1, 2, 3):
            if f"word/{kind}{i}.xml" in names:
                part(f"word/{kind}{i}.xml", kind)
    return out + _metadata(z), []


def xlsx_rows(raw: bytes):
    """(sheet, hidden, row from 1, column from 0, text) of each cell that isn't empty, row by row."""
    z = open_archive(raw)
    names = set(z.namelist())
    shared = ["".join(t.text or "" for t in si.iter(_S + "t")) for si in _xml(z, "xl/sharedStrings.xml").iter(_S + "si")] if "xl/sharedStrings.xml" in names else []
    targets = {}
    if "xl/_rels/workbook.xml.rels" in names:
        targets = {r.get("Id"): "xl/" + r.get("Target").lstrip("/").removeprefix("xl/") for r in _xml(z, "xl/_rels/workbook.xml.rels")}
    for k, sheet in enumerate(_xml(z, "xl/workbook.xml").iter(_S + "sheet"), 1):
        path = targets.get(sheet.get(_R + "id"), f"xl/worksheets/sheet{k}.xml")
        hidden = sheet.get("state") in ("hidden", "veryHidden")
        if path not in names:
            continue
        with z.open(path) as f:
            row_n = 0
            for _, e in ElementTree.iterparse(f):
                if e.tag != _S + "row":
                    continue
                row_n = int(e.get("r") or row_n + 1)
                for c, cell in enumerate(e.iter(_S + "c")):
                    ref = re.match(r"([A-Z]+)", cell.get("r") or "")
                    col = (sum((ord(x) - 64) * 26**i for i, x in enumerate(reversed(ref[1]))) - 1) if ref else c
                    kind, v = cell.get("t"), cell.findtext(_S + "v")
                    if kind == "s" and v is not None:
                        text = shared[int(v)]
                    elif kind == "inlineStr":
                        text = "".join(t.text or "" for t in cell.iter(_S + "t"))
                    elif kind == "b":
                        text = "TRUE" if v == "1" else "FALSE"
                    elif kind == "e":
                        text = f"#ERROR: {v}"
                    else:
                        text = v or ""
                    if text:
                        yield sheet.get("name"), hidden, row_n, col, text
                e.clear()


def parse_xlsx(raw: bytes, encoding: str | None = None, max_rows: int = 0):
    """max_rows: of each sheet, 0 for all; then a warning tells of the cut."""
    out, cut, seen = [], False, {}
    for sheet, hidden, row, col, text in xlsx_rows(raw):
        rows = seen.setdefault(sheet, set())
        rows.add(row)
        if max_rows and len(rows) > max_rows:
            cut = True
            continue
        letter = column_letter(col)
        out.append(segment(text, "xlsx", sheet=sheet, row=row, column=col, column_letter=letter, cell_ref=f"{sheet}!{letter}{row}", hidden_sheet=hidden))
    return out + _metadata(open_archive(raw)), [warning("truncated", f"only {max_rows} rows of a sheet")] if cut else []


def parse_pptx(raw: bytes, encoding: str | None = None):
    z = open_archive(raw)
    names, out = set(z.namelist()), []
    for n in range(1, 1001):
        if f"ppt/slides/slide{n}.xml" not in names:
            break
        for kind, part in ((None, f"ppt/slides/slide{n}.xml"), ("notes", f"ppt/notesSlides/notesSlide{n}.xml")):
            if part not in names:
                continue
            i = 0
            for shape in _xml(z, part).iter(_P + "sp"):
                ph = shape.find(f".//{_P}ph")
                element = kind or ("title" if ph is not None and ph.get("type") in ("title", "ctrTitle") else "body")
                for p in shape.iter(_A + "p"):
                    text = "".join(t.text or "" for t in p.iter(_A + "t"))
                    if text.strip():
                        out.append(segment(text, "pptx", slide=n, element=element, text_index=i))
                        i += 1
    return out + _metadata(z), []


# Mail.

_ATTRIBUTION = re.compile(r"(?:wrote|schrieb|a écrit|écrit|escribió)\s*:\s*$", re.I)
_SEPARATOR = re.compile(r"^(?:-{2,}\s*(?:original message|ursprüngliche nachricht|message d'origine|mensaje original|forwarded message).*|_{10,}|-{10,})\s*$", re.I)
_QUOTE = re.compile(r"^\s*(?:>|\|)")


def detect_quotes(text: str) -> list[tuple[str, bool]]:
    """Runs of lines, quoted or not: by prefix, after an attribution, after a separator."""
    out: list[tuple[list[str], bool]] = []
    after = False
    for line in text.split("\n"):
        if _SEPARATOR.match(line.strip()):
            after = True
        quoted = after or bool(_QUOTE.match(line)) or bool(_ATTRIBUTION.search(line))
        if not out or out[-1][1] != quoted:
            out.append(([], quoted))
        out[-1][0].append(line)
    return [("\n".join(lines), q) for lines, q in out]


def strip_quote_prefix(line: str) -> str:
    return re.sub(r"^\s*(?:[>|]\s?)+", "", line)


_HEADERS = ("from", "sender", "reply-to", "to", "cc", "bcc", "date", "subject", "message-id", "in-reply-to", "references")


def parse_eml(raw: bytes, encoding: str | None = None):
    m = email.message_from_bytes(raw, policy=email.policy.default)
    if not m.keys():
        raise ParseError("parse_error", "no header")
    out, warnings, parts = [], [], 0
    for h in _HEADERS:
        for value in m.get_all(h, []):
            if h in ("from", "sender", "reply-to", "to", "cc", "bcc"):
                for k, (name, addr) in enumerate(getaddresses([str(value)])):
                    text = f"{name} <{addr}>" if name and addr else addr or name
                    if text:
                        out.append(segment(text, "email", field=h, field_index=k))
            elif str(value).strip():
                out.append(segment(str(value).strip(), "email", field=h))
    for p in m.walk():
        if p.is_multipart():
            continue
        name = p.get_filename()
        if name or p.get_content_disposition() == "attachment":
            if name:
                out.append(segment(name, "email", field="attachment", part_index=parts))
            if len(p.get_payload(decode=True) or b"") > MAX_ENTRY:
                warnings.append(warning("truncated", f"attachment {name} is too large"))
        elif p.get_content_type() in ("text/plain", "text/html"):
            try:
                body = p.get_content()
            except (LookupError, UnicodeError):
                body = (p.get_payload(decode=True) or b"").decode("utf-8", "replace")
                warnings.append(warning("lossy_encoding", "unknown character set of a part"))
            if p.get_content_type() == "text/html":
                body = html_to_text(body)
            if body.strip():
                out.append(segment(body, "email", field="body", part_index=parts, is_quoted=False))
        parts += 1
    return out, warnings


class CompoundFile:
    """Streams of an OLE2 compound file by path."""

    def __init__(self, raw: bytes):
        if raw[:8] != b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1" or len(raw) < 512:
            raise ParseError("corrupted", "no compound file")
        self.raw = raw
        self.size, self.mini = 1 << struct.unpack_from("<H", raw, 30)[0], 1 << struct.unpack_from("<H", raw, 32)[0]
        n_fat, first_dir = struct.unpack_from("<I", raw, 44)[0], struct.unpack_from("<I", raw, 48)[0]
        self.cutoff, first_mini, _, difat, n_difat = struct.unpack_from("<IIIII", raw, 56)
        sectors = list(struct.unpack_from("<109I", raw, 76))
        for _ in range(n_difat):
            if difat >= 0xFFFFFFFA:
                break
            more = struct.unpack(f"<{self.size // 4}I", self.sector(difat))
            sectors += more[:-1]
            difat = more[-1]
        self.fat = [x for s in sectors[:n_fat] if s < 0xFFFFFFFA for x in struct.unpack(f"<{self.size // 4}I", self.sector(s))]
        entries = self.chain(first_dir)
        self.entries = [self._entry(entries[i : i + 128]) for i in range(0, len(entries) - 127, 128)]
        if not self.entries:
            raise ParseError("corrupted", "no directory")
        mini = self.chain(first_mini) if first_mini < 0xFFFFFFFA else b""
        self.mini_fat = struct.unpack(f"<{len(mini) // 4}I", mini)
        self.mini_data = self.chain(self.entries[0]["start"]) if self.entries[0]["start"] < 0xFFFFFFFA else b""
        self.paths: dict[str, dict] = {}
        self._walk(self.entries[0]["child"], "", set())

    def sector(self, n: int) -> bytes:
        return self.raw[(n + 1) * self.size : (n + 2) * self.size]

    def chain(self, n: int) -> bytes:
        out, seen = [], set()
        while n < 0xFFFFFFFA and n not in seen and n < len(self.fat):
            seen.add(n)
            out.append(self.sector(n))
            n = self.fat[n]
        return b"".join(out)

    @staticmethod
    def _entry(e: bytes) -> dict:
        n = struct.unpack_from("<H", e, 64)[0]
        left, right, child = struct.unpack_from("<III", e, 68)
        return {"name": e[: max(0, n - 2)].decode("utf-16-le", "replace"), "type": e[66], "left": left, "right": right, "child": child, "start": struct.unpack_from("<I", e, 116)[0], "size": struct.unpack_from("<Q", e, 120)[0] & 0xFFFFFFFF}

    def _walk(self, i: int, path: str, seen: set) -> None:
        todo = [(i, path)]
        while todo:
            i, path = todo.pop()
            if i >= len(self.entries) or i in seen:
                continue
            seen.add(i)
            e = self.entries[i]
            todo += [(e["left"], path), (e["right"], path)]
            self.paths[f"{path}{e['name']}"] = e
            if e["type"] == 1:
                todo.append((e["child"], f"{path}{e['name']}/"))

    def read(self, path: str) -> bytes | None:
        e = self.paths.get(path)
        if e is None or e["type"] != 2:
            return None
        if e["size"] >= self.cutoff:
            return self.chain(e["start"])[: e["size"]]
        out, n, seen = [], e["start"], set()
        while n < 0xFFFFFFFA and n not in seen and n < len(self.mini_fat):
            seen.add(n)
            out.append(self.mini_data[n * self.mini : (n + 1) * self.mini])
            n = self.mini_fat[n]
        return b"".join(out)[: e["size"]]


_MSG = {"subject": "0037", "from_name": "0C1A", "from": "0C1F", "to": "0E04", "cc": "0E03", "bcc": "0E02", "message-id": "1035", "in-reply-to": "1042", "body": "1000"}


def parse_msg(raw: bytes, encoding: str | None = None):
    f = CompoundFile(raw)

    def text(tag: str, folder: str = "") -> str | None:
        if (x := f.read(f"{folder}__substg1.0_{tag}001F")) is not None:
            return x.decode("utf-16-le", "replace").rstrip("\0")
        if (x := f.read(f"{folder}__substg1.0_{tag}001E")) is not None:
            return x.decode("cp1252", "replace").rstrip("\0")
        return None

    out = []
    name, addr = text(_MSG["from_name"]), text(_MSG["from"])
    if name or addr:
        out.append(segment(f"{name} <{addr}>" if name and addr else name or addr, "email", field="from", field_index=0))
    for h in ("to", "cc", "bcc"):
        for k, x in enumerate(v for v in (text(_MSG[h]) or "").split(";") if v.strip()):
            out.append(segment(x.strip(), "email", field=h, field_index=k))
    out += [segment(v, "email", field=h) for h in ("subject", "message-id", "in-reply-to") if (v := text(_MSG[h]))]
    if body := text(_MSG["body"]):
        runs = detect_quotes(body)
        quoted = sum(len(t) for t, q in runs if q) * 2 > len(body)
        out.append(segment(body, "email", field="body", part_index=0, is_quoted=quoted))
    for p in sorted({x.split("/")[0] for x in f.paths if x.startswith("__attach_version1.0_")}):
        if n := text("3707", p + "/") or text("3704", p + "/"):
            out.append(segment(n, "email", field="attachment"))
    return out, []


PARSERS = {"text": parse_text, "csv": parse_csv, "json": parse_json, "html": parse_html, "pdf": parse_pdf, "docx": parse_docx, "xlsx": parse_xlsx, "pptx": parse_pptx, "eml": parse_eml, "msg": parse_msg}


def parse_bytes(raw: bytes, format: str, **options):
    if format not in PARSERS:
        raise ParseError("unsupported_format", f"format {format}")
    return PARSERS[format](raw, **options)
