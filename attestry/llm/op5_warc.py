"""Content-addressed WARC archive.

Each distinct payload is stored once, under the SHA-256 of its bytes (and compressed as such); every record's exact
header bytes are stored apart, with that key. Joining headers and payloads on the key gives the original records byte
for byte: each stored payload's digest is computed anew and refused if it differs from its key, and what the query
returns is read from the rebuilt records, not from what the writer knew.

Of records with equal payloads of at least MIN_REVISIT bytes the one with the largest page_id is the response and the
others are revisits of it; smaller payloads are responses each, though stored once as well. Payloads are packed before
they are shuffled, once to merge copies and once to meet their headers. A payload with many records is split: the keys
of more than one in MOST_HOT rows are MOST_HOT at most, so their owners are broadcast, and their headers are dealt over
several copies of the payload when records are rebuilt.

Edge cases: a null html is the empty payload; a null url gives a record without target; control characters, spaces and
line separators of any script in a url are percent-encoded, so that no url makes a header line; a very long payload is
one row; equal page_ids with equal payloads are responses alike; a record with a null page_id revisits the largest
page_id of its payload, if there is one; empty tables give empty archives; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.llm.common import in_batches, table, written

MIN_REVISIT = 1000
#: Keys that are held to be hot are as many at most, and have SPLIT records at least; a part of one has about SPLIT.
MOST_HOT, SPLIT = 1000, 512
#: Control characters, spaces and what any reader may take for a line end.
_UNSAFE = re.compile(r"[\x00-\x20\x7f-\xa0\u1680\u2000-\u200f\u2028-\u202f\u205f-\u206f\u3000\ufeff]")


class Archive(NamedTuple):
    headers: DataFrame  # page_id, payload_key, part, header
    payloads: DataFrame  # payload_key, parts, packed


def safe_url(url: str | None) -> str | None:
    return None if url is None else _UNSAFE.sub(lambda m: quote(m[0], safe=""), url)


def _captured(rows: DataFrame) -> DataFrame:
    """page_id, url, payload_key, n, digest and the packed payload of every row of page_id, url, payload."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            plain = batch.column(2).to_pylist()
            yield pa.RecordBatch.from_pydict({
                "page_id": batch.column(0),
                "url": pa.array(map(safe_url, batch.column(1).to_pylist()), pa.string()),
                "payload_key": pa.array([hashlib.sha256(x).hexdigest() for x in plain], pa.string()),
                "n": pa.array([len(x) for x in plain], pa.int64()),
                "digest": pa.array([hashlib.sha1(x).hexdigest() for x in plain], pa.string()),
                "packed": pa.array([packer.compress(x) for x in plain], pa.binary()),
            })

    return in_batches(rows, run, "page_id long, url string, payload_key string, n long, digest string, packed binary")


def _record_id(page: F.Column, key: F.Column) -> F.Column:
    """A version-8 style URN of the page and its payload's key, the same each time."""
    h = F.sha2(F.concat_ws(":", F.coalesce(page.cast("string"), F.lit("")), key), 256)
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", h.substr(1, 8), h.substr(9, 4), F.concat(F.lit("8"), h.substr(14, 3)), F.concat(F.lit("a"), h.substr(18, 3)), h.substr(21, 12)), F.lit(">"))


def _header(revisit: F.Column) -> F.Column:
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    profile = line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
    refers = F.concat(profile, line("WARC-Refers-To", _record_id(F.col("owner"), F.col("payload_key"))), line("WARC-Refers-To-Page", F.col("owner").cast("string")))
    return F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", _record_id(F.col("page_id"), F.col("payload_key"))),
        F.coalesce(line("WARC-Target-URI", F.col("url")), F.lit("")),
        line("WARC-Date", F.lit("1970-01-01T00:00:00Z")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(revisit, refers).otherwise(""),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(revisit, F.lit(0)).otherwise(F.col("n")).cast("string")),
        F.lit("\r\n"),
    )


def write(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_revisit: int = MIN_REVISIT, split: int = SPLIT) -> Archive:
    """The archive of pages, as two tables in the shared folder."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary").alias("payload"))
    captured = written(_captured(rows), "warc-capture")
    least = max(split, captured.count() // MOST_HOT)
    parts = F.when(F.col("records") > least, F.ceil(F.col("records") / split)).otherwise(1).cast("int")
    store = captured.groupBy("payload_key").agg(F.max("page_id").alias("owner"), F.count("*").alias("records"), F.any_value("packed").alias("packed"))
    payloads = written(store.select("payload_key", "owner", parts.alias("parts"), "packed"), "warc-payloads")
    owners = payloads.select("payload_key", "owner", "parts")
    hot = owners.where("parts > 1")  # MOST_HOT rows at most
    meta = captured.drop("packed").join(F.broadcast(hot), "payload_key", "left")
    few = meta.where("parts IS NULL").drop("owner", "parts").join(owners, "payload_key")
    joined = meta.where("parts IS NOT NULL").unionByName(few)
    revisit = (F.col("n") >= min_revisit) & ~F.col("page_id").eqNullSafe(F.col("owner"))
    part = F.pmod(F.xxhash64("page_id", "url"), F.col("parts")).cast("int")
    headers = written(joined.select("page_id", "payload_key", part.alias("part"), _header(revisit).cast("binary").alias("header")), "warc-headers")
    return Archive(headers, payloads.select("payload_key", "parts", "packed"))


class Record(NamedTuple):
    """A rebuilt record and, for a revisit too, the payload that it stands for."""

    page_id: int | None
    record: bytes
    payload: bytes
    digest: str  # SHA-1 of the payload, computed from its bytes

    def fields(self) -> dict[str, str]:
        """The header's fields, and that the block is as long as they say. Lines end in CR LF and nowhere else."""
        head, _, rest = self.record.partition(b"\r\n\r\n")
        found = {k.decode(): v.decode() for k, _, v in (x.partition(b": ") for x in head.split(b"\r\n")[1:])}
        if rest[int(found["Content-Length"]) :] != b"\r\n\r\n":
            raise ValueError(f"record of page {self.page_id} is not as long as its header says")
        return found


def _rebuilt(batch: pa.RecordBatch) -> Iterator[Record]:
    """Records of page_id, payload_key, header and packed; equal keys are adjacent mostly, and verified once in a row."""
    unpacker, last, payload, digest = zstandard.ZstdDecompressor(), None, b"", ""
    for page, key, header, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
        if key != last:
            payload = unpacker.decompress(packed)
            if hashlib.sha256(payload).hexdigest() != key:
                raise ValueError(f"stored payload differs from its key {key}")
            last, digest = key, hashlib.sha1(payload).hexdigest()
        block = b"" if b"\r\nWARC-Type: revisit\r\n" in header else payload
        yield Record(page, b"".join([header, block, b"\r\n\r\n"]), payload, digest)


def _met(archive: Archive) -> DataFrame:
    """Each header with its payload; the headers of a hot payload meet several copies of it."""
    copies = archive.payloads.select("payload_key", F.explode(F.expr("sequence(0, parts - 1)")).alias("part"), "packed")
    return archive.headers.join(copies, ["payload_key", "part"]).select("page_id", "payload_key", "header", "packed")


def records(archive: Archive) -> DataFrame:
    """page_id, the record's bytes (header, the payload if it is a response, and the two line ends) and the full payload, for revisits that of the record they refer to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in _rebuilt(batch):
                yield pa.RecordBatch.from_pydict({"page_id": pa.array([r.page_id], pa.int64()), "record": [r.record], "payload": [r.payload]})

    return in_batches(_met(archive), run, "page_id long, record binary, payload binary")


def described(archive: Archive) -> DataFrame:
    """What each rebuilt record says of itself: page_id, payload_bytes, payload_digest, record_type, refers_to. A record whose payload isn't what its header names is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in _rebuilt(batch):
                said = r.fields()
                if said["WARC-Payload-Digest"] != f"sha1:{r.digest}":
                    raise ValueError(f"record of page {r.page_id} and its payload differ")
                refers = said.get("WARC-Refers-To-Page")
                out.append({"page_id": r.page_id, "payload_bytes": len(r.payload), "payload_digest": r.digest, "record_type": said["WARC-Type"], "refers_to": int(refers) if refers else None})
            yield pa.RecordBatch.from_pylist(out, _DESCRIBED)

    return in_batches(_met(archive), run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


_DESCRIBED = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return described(write(table(spark, sf_dir, "pages")))


QUERIES = {"op5_warc": op5_warc}
SQL = {
    "op5_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS digest, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
o AS (SELECT html, max(page_id) AS owner FROM p GROUP BY html)
SELECT page_id, cast(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
  CASE WHEN n >= 1000 AND page_id <> owner THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND page_id <> owner THEN owner END AS refers_to
FROM p JOIN o ON p.html = o.html
"""
}
