"""Fill-in-middle: texts cut at two token ranks and put into prefix-suffix-middle or suffix-prefix-middle order.

Two passes over a text, each with a lazy match iterator: the first counts the tokens, the second advances to the smaller
and then to the larger rank and takes the offsets there. No tokens are stored, so beside the text and its output a task
holds one match. Ranks and form come from a digest of seed and doc_id, so they are the same in every run and on every
partitioning. Texts are read in batches and never shuffled; the original is put together again by string functions.

Edge cases: a null text is the empty one, and empty texts are plain; a text that holds one of the markers is plain, so the
markers of an output are those put there; a very long text is one row, worked on alone; a null doc_id is hashed as
nothing after the colon; repeated rows get equal results; an empty table gives no rows; other columns are not read by
`transformed` and carried as they are, whatever their names, by `rewritten`.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import islice
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.llm.common import in_batches, table, texts

SEED = 42
#: Per cent of the texts that are cut, and of these the ones that are told suffix first.
CUT, SUFFIX_FIRST = 50, 80
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


class Told(NamedTuple):
    """A text as it is told: its number of tokens, form, sizes of prefix and middle in code points, and output."""

    n: int
    form: str
    prefix_chars: int | None
    middle_chars: int | None
    output: str


def cut_places(text: str, ranks: tuple[int, int]) -> Iterator[int]:
    """Where the first `rank` tokens of a text end, for ascending ranks."""
    matches, at, done = TOKEN.finditer(text), 0, 0
    for rank in ranks:
        if rank > done:
            at, done = next(islice(matches, rank - done - 1, None)).end(), rank
        yield at


def told(doc_id: int | None, text: str, seed: int = SEED, cut: int = CUT, suffix_first: int = SUFFIX_FIRST) -> Told:
    n = sum(1 for _ in TOKEN.finditer(text))
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[k : k + 8], 16) for k in range(0, 32, 8))
    if not text or h3 % 100 >= cut or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)):
        return Told(n, "plain", None, None, text)
    lo, hi = cut_places(text, tuple(sorted((h1 % (n + 1), h2 % (n + 1)))))
    prefix, middle, suffix = text[:lo], text[lo:hi], text[hi:]
    if h4 % 100 < suffix_first:
        return Told(n, "spm", lo, hi - lo, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}")
    return Told(n, "psm", lo, hi - lo, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}")


_TOLD = "n long, form string, prefix_chars long, middle_chars long, output string"
_COLUMNS = [("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.large_string())]


def _told(ids: pa.Array, column: pa.Array, **options: int) -> list[pa.Array]:
    rows = [told(i.as_py(), t.as_py() or "", **options) for i, t in zip(ids, column, strict=True)]
    return [pa.array([getattr(r, name) for r in rows], kind) for name, kind in _COLUMNS]


def transformed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options: int) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars (null if plain) and output of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = _told(batch.column(0), batch.column(1), **options)
            out[-1] = out[-1].cast(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *out], names=["doc_id", *(n for n, _ in _COLUMNS)])

    return in_batches(texts(docs, id_col, text_col), run, f"doc_id long, {_TOLD}")


def rewritten(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options: int) -> DataFrame:
    """The rows of docs, all columns, with the text as it is told; a null text stays null."""
    names = docs.columns
    at, number = names.index(text_col), names.index(id_col)
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fields = batch.column(0).flatten()
            out = [None if t.as_py() is None else told(i.as_py(), t.as_py(), **options).output for i, t in zip(fields[number], fields[at], strict=True)]
            fields[at] = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays(fields, names=names)

    return in_batches(rows, run, docs.schema)


def restored(output: Column, form: Column) -> Column:
    """The text that was told, from output and form alone; each marker of a cut text stands in it once."""

    def after(a: str) -> Column:
        return F.split_part(output, F.lit(a), F.lit(2))

    def until(x: Column, a: str) -> Column:
        return F.split_part(x, F.lit(a), F.lit(1))

    spm = F.concat(until(after(PREFIX), MIDDLE), after(MIDDLE), until(after(SUFFIX), PREFIX))
    psm = F.concat(until(after(PREFIX), SUFFIX), after(MIDDLE), until(after(SUFFIX), MIDDLE))
    return F.when(form == "spm", spm).when(form == "psm", psm).otherwise(output)


def op13_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = transformed(table(spark, sf_dir, "documents"))
    digests = F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256")
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


QUERIES = {"op13_middle": op13_middle}
SQL = {
    "op13_middle": r"""
WITH hashed AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u, sha256('42:' || doc_id) AS h FROM documents
), numbered AS (
  SELECT doc_id, t, u, len(u) AS n, cast('0x' || substr(h, 1, 8) AS BIGINT) AS h1, cast('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
    cast('0x' || substr(h, 17, 8) AS BIGINT) AS h3, cast('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM hashed
), ranked AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS lo, greatest(h1 % (n + 1), h2 % (n + 1)) AS hi,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM numbered
), parts AS (
  SELECT doc_id, n, form, t, coalesce(array_to_string(u[1:lo], ''), '') AS p, coalesce(array_to_string(u[lo + 1:hi], ''), '') AS m, coalesce(array_to_string(u[hi + 1:n], ''), '') AS s FROM ranked
)
SELECT doc_id, cast(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN cast(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN cast(length(m) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE '<P>' || p || '<S>' || s || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256
FROM parts
"""
}
