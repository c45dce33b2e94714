"""Small per-file readers that rows come from: masked text, balanced brackets and top-level splits."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from attestry.durable import in_batches

_QUIET = {
    "sql": re.compile(r"--[^\n]*|/\*.*?\*/|\$(\w*)\$.*?\$\1\$|'(?:[^']|'')*'", re.S),
    "c": re.compile(r"//[^\n]*|/\*.*?\*/|'(?:\\.|[^'\\\n])*'|\"(?:\\.|[^\"\\\n])*\"|`(?:\\.|[^`\\])*`", re.S),
}
_PAIRS = {"(": re.compile(r"[()]"), "[": re.compile(r"[\[\]]"), "{": re.compile(r"[{}]")}
_OPEN, _CLOSE = re.compile(r"[(\[{]"), re.compile(r"[)\]}]")

#: Paths that are sensitive, and those of a caller's own session.
SENSITIVE_PATH = r"(?i)(?:^|/)(?:admin|internal|manage|users?|permissions?|roles?|projects?|documents?|reports?|chapters?|templates?|knowledge|signatures?|chat|generate|review|uploads?|downloads?|tokens?|sessions?|billing|payments?)(?:/|$)"
SESSION_PATH = r"(?i)(?:^|/)(?:login|logout|token|session/current|me|profile)(?:/|$)"


def _blank(text: str) -> str:
    return "\n".join(" " * len(line) for line in text.split("\n"))


def masked(text: str, kind: str, strings: bool = True) -> str:
    """text with comments, and strings if asked, as blanks; every other character stays in its place."""
    return _QUIET[kind].sub(lambda m: _blank(m[0]) if strings or m[0][:2] in ("--", "//", "/*") else m[0], text)


def closing(text: str, at: int) -> int | None:
    """Where the bracket at a place closes."""
    depth, left = 0, text[at]
    for m in _PAIRS[left].finditer(text, at):
        depth += 1 if m[0] == left else -1
        if depth == 0:
            return m.start()
    return None


def split_top(text: str, separator: str, shape: str) -> list[str]:
    """text cut at matches of separator outside brackets; shape is the masked text of the same length."""
    opened, closed = ([m.start() for m in p.finditer(shape)] for p in (_OPEN, _CLOSE))
    cuts = [m for m in re.finditer(separator, shape) if bisect_right(opened, m.start()) == bisect_left(closed, m.start())]
    bounds = [0, *(x for m in cuts for x in m.span()), len(text)]
    return [text[a:b] for a, b in zip(bounds[::2], bounds[1::2], strict=True)]


def line_at(text: str, at: int) -> int:
    return text.count("\n", 0, at) + 1


def row_batches(files: Iterable[tuple[pa.Scalar, pa.Scalar]], read: Callable[[str, str], Iterator[dict]], kinds: list[tuple[str, pa.DataType]], most: int = 4096) -> Iterator[pa.RecordBatch]:
    """What a reader yields for files, the rows of many files in a batch, of `most` rows at most."""
    schema, found = pa.schema([("relative_path", pa.string()), *kinds]), []
    for path, content in ((p.as_py(), c.as_py()) for p, c in files):
        for row in read(path, content or ""):
            found.append({"relative_path": path, **row})
            if len(found) == most:
                yield pa.RecordBatch.from_pylist(found, schema)
                found = []
    if found:
        yield pa.RecordBatch.from_pylist(found, schema)


def rows_of(files: DataFrame, read: Callable[[str, str], Iterator[dict]], ddl: str, kinds: list[tuple[str, pa.DataType]]) -> DataFrame:
    """What a reader yields for each file of (relative_path, content), a batch of files at a time, with the path in front."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from row_batches(zip(batch.column(0), batch.column(1), strict=True), read, kinds)

    return in_batches(files.select("relative_path", "content"), run, f"relative_path string, {ddl}")
