"""Packaged applications: entries of APK and IPA files, the few that are read, and the text that can be recovered."""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.durable import apart, in_batches, kept, numbered
from attestry.functions import text as T
from attestry.sources import property_lists

MAX_ENTRIES, SELECTED, ENTRY_BYTES, INPUT_BYTES = 200_000, 25, 8 << 20, 16 << 20
UNSAFE = r"^/|^[A-Za-z]:/|(?:^|/)\.\.(?:/|$)|\\|\x00"
#: Which entries are read, whether they are binary, and in which order.
KINDS = (
    (r"(?i)^(?:AndroidManifest\.xml)$", True, 0),
    (r"(?i)^(?:Info\.plist|Payload/[^/]+\.app/Info\.plist)$|network_security_config\.xml$", False, 0),
    (r"(?i)(?:^|/)(?:classes\d*\.dex|resources\.arsc)$|^Payload/([^/]+)\.app/\1$", True, 1),
    (r"(?i)(?:main\.jsbundle|index\.android\.bundle|resources\.arsc)$", True, 2),
    (r"(?i)(?:(?:assets|res/raw)/.*|Payload/[^/]+\.app/.*)\.(?:html|js|json|xml|txt)$", False, 3),
    (r"(?i)(?:(?:assets|res/raw)/.*|Payload/[^/]+\.app/.*)\.plist$", False, 4),
)


def is_archive(content: Column, size: Column) -> Column:
    """One of the three starts of a ZIP file, and a size from one byte to 2 GiB."""
    return F.hex(content.substr(1, 4)).isin("504B0304", "504B0506", "504B0708") & size.between(1, 2 << 30)


def entry_kind(name: Column) -> Column:
    """binary and priority of an entry that is read, else null."""
    out = F.when(F.lit(False), F.struct(F.lit(True).alias("binary"), F.lit(0).alias("priority")))
    for pattern, binary, priority in KINDS:
        out = out.when(name.rlike(pattern), F.struct(F.lit(binary).alias("binary"), F.lit(priority).alias("priority")))
    return out


def _wanted(names: list[str]) -> tuple[list[tuple[int, str, bool, int]], list[str]]:
    """Place, name, binary and priority of the entries of an archive that are read, from its directory alone, and why some may be lacking."""
    if any(re.search(UNSAFE, n) for n in names):
        return [], ["unsafe entry name"]
    reasons = [f"more than {MAX_ENTRIES} entries"] if len(names) > MAX_ENTRIES else []
    found = []
    for i, n in enumerate(names[:MAX_ENTRIES]):
        kind = next(((binary, priority) for pattern, binary, priority in KINDS if re.search(pattern, n)), None)
        if kind:
            found.append((kind[1], i, n, kind[0]))
    if len(found) > SELECTED:
        reasons.append(f"only {SELECTED} of {len(found)} entries were read")
    return [(i, n, binary, priority) for priority, i, n, binary in sorted(found)[:SELECTED]], reasons


def entries(archives: DataFrame) -> DataFrame:
    """artifact, idx, name, binary, priority and bytes of the entries that are read, and for each archive a row without idx whose reason, if any, says what is lacking.

    archives: artifact string, content binary; an archive is one row, read where it is. Which entries are read is told
    by the directory; only these are inflated, at most ENTRY_BYTES of each and INPUT_BYTES of all.
    """
    schema = pa.schema([("artifact", pa.string()), ("idx", pa.int32()), ("name", pa.string()), ("binary", pa.bool_()), ("priority", pa.int32()), ("bytes", pa.binary()), ("reason", pa.string())])

    def read(content: bytes) -> tuple[list[dict], list[str]]:
        out, size = [], 0
        try:
            archive = zipfile.ZipFile(io.BytesIO(content))
            infos = archive.infolist()
            wanted, reasons = _wanted([x.filename for x in infos])
        except (zipfile.BadZipFile, NotImplementedError, RuntimeError, OSError, ValueError):
            return [], ["archive cannot be read"]
        for i, name, binary, priority in wanted:
            if size >= INPUT_BYTES:
                reasons.append(f"entries after {INPUT_BYTES} bytes were not read")
                break
            try:
                with archive.open(infos[i]) as f:
                    data = f.read(ENTRY_BYTES + 1)
            except (zipfile.BadZipFile, zlib.error, NotImplementedError, RuntimeError, OSError, EOFError):
                reasons.append(f"entry {i} cannot be read")
                continue
            if len(data) > ENTRY_BYTES:
                data = data[:ENTRY_BYTES]
                reasons.append(f"entry {i} was cut at {ENTRY_BYTES} bytes")
            size += len(data)
            out.append({"idx": i, "name": name, "binary": binary, "priority": priority, "bytes": data})
        return out, reasons

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                artifact = batch.column(0)[k].as_py()
                found, reasons = read(batch.column(1)[k].as_py())
                for row in found:
                    yield pa.RecordBatch.from_pylist([{"artifact": artifact, "reason": None, **row}], schema)
                yield pa.RecordBatch.from_pylist([{"artifact": artifact, "reason": "; ".join(reasons) or None}], schema)

    return in_batches(archives.select("artifact", "content"), run, "artifact string, idx int, name string, binary boolean, priority int, bytes binary, reason string")


def entry_text(data: Column, binary: Column) -> Column:
    """Printable runs of binary entries, in one byte or two a character; other entries as UTF-8."""
    wide = F.decode(data, "ISO-8859-1")
    runs = F.concat(
        F.regexp_extract_all(wide, F.lit("[ -~]{4,}"), F.lit(0)),
        F.transform(F.concat(F.regexp_extract_all(wide, F.lit(r"(?:[ -~]\x00){4,}"), F.lit(0)), F.regexp_extract_all(wide, F.lit(r"(?:\x00[ -~]){4,}"), F.lit(0))), lambda x: F.replace(x, F.lit("\0"), F.lit(""))),
    )
    printable = F.array_join(F.array_distinct(F.filter(F.transform(runs, F.trim), lambda x: F.length(x) >= 4)), "\n")
    return F.when(binary | (F.instr(wide, "\0") > 0), printable).otherwise(data.cast("string"))


def opened(archives: DataFrame) -> DataFrame:
    """entries(), with the text of binary property lists as list_text. Where one can't be read, its entry has a reason, and its printable runs are its text."""
    rows = kept(entries(archives), "entries")
    key = F.concat_ws("!", F.col("idx").cast("string"), "artifact")
    lists = rows.where("idx IS NOT NULL").where(property_lists.is_binary(F.col("bytes"))).select(key.alias("artifact"), "bytes")
    if lists.isEmpty():
        return rows.withColumn("list_text", F.lit(None).cast("string"))
    cut = F.when(F.col("truncated"), F.lit(f"text was cut at {INPUT_BYTES} bytes"))
    got = property_lists.decoded(lists, INPUT_BYTES).select(F.col("artifact").alias("key"), F.col("text").alias("list_text"), F.coalesce("reason", cut).alias("why"))
    told = F.coalesce("reason", F.when(F.col("why").isNotNull(), F.concat(F.lit("property list in entry "), F.col("idx").cast("string"), F.lit(": "), F.col("why"))))
    return rows.join(apart(got), key == F.col("key"), "left").withColumn("reason", told).drop("key", "why")


def corpus(archives: DataFrame) -> DataFrame:
    """Entries' text as files, named by archive and entry, for the rules over packaged applications; archives in the order of their names."""
    return corpus_of(opened(archives))


def corpus_of(rows: DataFrame) -> DataFrame:
    listed = property_lists.is_binary(F.col("bytes"))
    text = F.when(listed, F.coalesce("list_text", entry_text(F.col("bytes"), F.lit(True)))).otherwise(entry_text(F.col("bytes"), F.col("binary")))
    got = rows.where("idx IS NOT NULL").join(apart(numbered(rows.select("artifact").distinct(), ["artifact"])), "artifact")
    return got.select(F.concat_ws("!", "artifact", "name").alias("relative_path"), F.length("bytes").cast("long").alias("size"), text.alias("content"), (F.col("n") * F.lit(1_000_000_000).cast("long") + F.col("priority") * 1_000_000 + F.col("idx")).cast("long").alias("walk_pos"))


def coverage(rows: DataFrame) -> DataFrame:
    """One row of opened(): partial with the reasons of the first 50 archives that lack something, complete, or not_run without any archive."""
    said = F.concat_ws(": ", "artifact", "reason")
    got = rows.agg(F.count("*").alias("n"), F.array_sort(F.collect_set(F.when(F.col("reason").isNotNull(), said))).alias("reasons"))
    return got.select(
        F.lit("mobile-artifact-static").alias("domain"), F.lit("artifact").alias("engine"), F.when(F.col("n") == 0, "not_run").when(F.size("reasons") > 0, "partial").otherwise("complete").alias("status"),
        (F.col("n") > 0).alias("required"), F.lit(None).cast("string").alias("version"), F.when(F.col("n") == 0, "No APK or IPA was given").otherwise(F.nullif(T.first_reasons(F.col("reasons")), F.lit(""))).alias("reason"),
    )
