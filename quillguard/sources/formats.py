"""Which format bytes have: by content first, by name only where the content says text. Column expressions over a file's first bytes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import SNIFF_BYTES

EXTENSIONS = {
    "txt": "text", "log": "text", "md": "text", "text": "text", "csv": "csv", "tsv": "csv", "json": "json", "html": "html", "htm": "html",
    "pdf": "pdf", "docx": "docx", "xlsx": "xlsx", "pptx": "pptx", "eml": "eml", "msg": "msg",
}
#: Parsed by this library from bytes.
SUPPORTED = tuple(dict.fromkeys(EXTENSIONS.values()))
_TAGS = ("html", "head", "body", "div", "span", "p", "table", "!doctype", "title", "meta", "script", "ul", "ol", "h1", "h2", "h3", "a ", "br")
_PARTS = {"docx": "word/document.xml", "xlsx": "xl/workbook.xml", "pptx": "ppt/presentation.xml"}


def is_supported(name: str) -> bool:
    return name.rpartition(".")[2].lower() in EXTENSIONS


def latin(content: Column) -> Column:
    """Bytes as characters, one to one."""
    return F.decode(content, "ISO-8859-1")


def encoding_of(content: Column) -> Column:
    """By a byte order mark, else UTF-8."""
    start = F.hex(F.substring(content, 1, 2))
    return F.when(start == "FFFE", "UTF-16LE").when(start == "FEFF", "UTF-16BE").otherwise("UTF-8")


def office_part(content: Column) -> Column:
    """Of a ZIP: the format whose main part's name is in the bytes; a workbook without one."""
    t = latin(content)
    return F.when(t.contains(_PARTS["docx"]), "docx").when(t.contains(_PARTS["pptx"]), "pptx").otherwise("xlsx")


def _looks_csv(text: Column) -> Column:
    """Of the first five lines at least two aren't blank, and they have a delimiter each on average."""
    lines = F.slice(F.filter(F.slice(F.split(text, "\r?\n"), 1, 5), lambda x: F.trim(x) != ""), 1, 5)
    count = lambda d: F.floor(F.aggregate(lines, F.lit(0), lambda a, x: a + F.length(x) - F.length(F.replace(x, F.lit(d)))) / F.size(lines))
    some = F.lit(False)
    for d in (",", ";", "\t", "|"):
        some = some | (count(d) >= 1)
    return (F.size(lines) >= 2) & some


def detect_format(content: Column, name: Column | None = None) -> Column:
    head = F.substring(content, 1, SNIFF_BYTES)
    mark = F.hex(F.substring(content, 1, 4))
    text = F.ltrim(F.regexp_replace(latin(head), "^\u00ef\u00bb\u00bf", ""))  # what is looked for is ASCII; a head can end inside a character
    lower = F.lower(text)
    html = F.lit(False)
    for t in _TAGS:
        html = html | lower.contains("<" + t)
    own = (
        F.when(mark == "25504446", "pdf").when(mark == "D0CF11E0", "msg").when(mark == "504B0304", office_part(content))
        .when(text.rlike(r"^[{\[]") & text.rlike("[:,]"), "json").when(text.startswith("<") & html, "html").when(_looks_csv(text), "csv").otherwise("text")
    )
    if name is None:
        return own
    by_name = F.element_at(F.create_map(*[F.lit(x) for kv in EXTENSIONS.items() for x in kv]), F.lower(F.element_at(F.split(name, r"\."), -1)))
    return F.when(own == "text", F.coalesce(by_name, own)).otherwise(own)


def column_letter(column: int) -> str:
    """0 is A, 26 is AA."""
    out = ""
    column += 1
    while column:
        column, r = divmod(column - 1, 26)
        out = chr(65 + r) + out
    return out
