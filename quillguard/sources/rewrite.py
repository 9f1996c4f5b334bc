"""The strings of a document in order, and the document with others in their place."""

from __future__ import annotations

import csv
import io
import json


def _walk(x, change):
    if isinstance(x, str):
        return change(x)
    if isinstance(x, dict):
        return {k: _walk(v, change) for k, v in x.items()}
    return [_walk(v, change) for v in x] if isinstance(x, list) else x


def strings(content: str, format: str) -> list[str]:
    """CSV: cells, the header's too; JSON: strings; others: the whole."""
    if format == "csv":
        return [c for row in csv.reader(io.StringIO(content)) for c in row]
    if format == "json":
        out: list[str] = []
        _walk(json.loads(content), lambda s: out.append(s) or s)
        return out
    return [content]


def replaced(content: str, format: str, values: list[str]) -> str:
    it = iter(values)
    if format == "csv":
        out = io.StringIO()
        w = csv.writer(out, lineterminator="\n")
        for row in csv.reader(io.StringIO(content)):
            w.writerow([next(it) for _ in row])
        return out.getvalue()
    if format == "json":
        return json.dumps(_walk(json.loads(content), lambda _: next(it)), indent=2, ensure_ascii=False)
    return next(it, content)
