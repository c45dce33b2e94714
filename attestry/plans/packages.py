"""Property lists made of pages and read back by joins, with the lines that SQL takes from the pages themselves."""

from __future__ import annotations

import plistlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.durable import in_batches
from attestry.plans.common import table
from attestry.sources import property_lists as pl

#: Bytes of text that are taken of a list, and the pages whose list lacks its last bytes.
TEXT_BYTES, BROKEN = 2_000, "page_id % 10 = 3"


def lists_of(pages: DataFrame) -> DataFrame:
    """artifact and bytes: a binary property list of each page (page_id, url, html), whose integers, reals, strings, data, arrays and dictionaries come from its columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for r in batch.to_pylist():
                n, url, html = r["page_id"], r["url"] or "", r["html"] or ""
                value = {"page": n, "url": url, "even": n % 2 == 0, "share": n / 8, "parts": url.split("/"), "data": url.encode(), "nested": {"url": url, "deep": {"html": html}}}
                made.append(plistlib.dumps(value, fmt=plistlib.FMT_BINARY, sort_keys=False))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), pa.array(made, pa.binary())], names=["page_id", "bytes"])

    packed = in_batches(pages.select("page_id", "url", "html"), run, "page_id long, bytes binary")
    return packed.select(F.col("page_id").cast("string").alias("artifact"), F.expr(f"CASE WHEN {BROKEN} THEN substr(bytes, 1, length(bytes) - 5) ELSE bytes END").alias("bytes"))


def property_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the property list of each page says, up to TEXT_BYTES, or why it can't be read."""
    return pl.decoded(lists_of(table(spark, sf_dir, "pages")), TEXT_BYTES).select(F.col("artifact").cast("bigint").alias("page_id"), "text", "truncated", "reason")


QUERIES = {f.__name__: f for f in (property_lists,)}
SQL = {
    "property_lists": f"""WITH p AS (SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html FROM pages), every AS (SELECT page_id, ['page', CAST(page_id AS VARCHAR), 'url', url, 'even', CASE WHEN page_id % 2 = 0 THEN '<true/>' ELSE '<false/>' END,
  'share', CASE WHEN page_id % 8 = 0 THEN CAST(page_id // 8 AS VARCHAR) ELSE CAST(CAST(page_id AS DOUBLE) / 8 AS VARCHAR) END, 'parts'] || string_split(url, '/') || ['data', '<data:' || strlen(url) || '>', 'nested', 'url', url, 'deep', 'html', html] AS lines FROM p),
each AS (SELECT page_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM every), run AS (SELECT *, sum(strlen(line) + 1) OVER (PARTITION BY page_id ORDER BY i) AS upto FROM each)
SELECT page_id, CASE WHEN NOT ({BROKEN}) THEN coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (upto <= {TEXT_BYTES}), '') END AS text, NOT ({BROKEN}) AND max(upto) > {TEXT_BYTES} AS truncated,
  CASE WHEN {BROKEN} THEN 'integer widths are invalid' END AS reason FROM run GROUP BY page_id""",
}
