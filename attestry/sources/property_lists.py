"""Binary property lists as relations: objects, the edges between them, and the text that they hold.

A list is one row; its objects are taken out of it by column functions, so that only objects, not bytes, are shuffled.
Objects of one list meet by joins on (list, object), level by level: down to find what the root reaches, up for the size
of what each object says, and down again to place it. An object that many others name is read once, and a place is
followed only if its text starts before the limit, so that lists that name themselves many times over stay small.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestry.durable import apart, kept

#: Objects of a list, members of a collection, bytes of a string, and levels below the root.
MAX_OBJECTS, MAX_ITEMS, MAX_STRING, MAX_DEPTH = 100_000, 10_000, 1 << 20, 32
SAFE = (1 << 53) - 1
KEY = ["artifact", "object"]
_OBJECT = "struct<kind:string,text:string,edges:array<struct<place:int,name:bigint,child:bigint>>,reason:string>"


def is_binary(data: Column) -> Column:
    return F.hex(data.substr(1, 8)) == "62706C6973743030"


def _hex(data: Column, at: Column, n: Column) -> Column:
    """Bytes from a place, counted from 0, in hex."""
    return F.hex(F.substring(data, (at + 1).cast("int"), n.cast("int")))


def _unsigned(data: Column, at: Column, n: Column) -> Column:
    """An integer of 1 to 8 bytes, or null beyond 2^53 - 1 or outside the list."""
    value = F.conv(_hex(data, at, n), 16, 10).cast("decimal(20,0)")
    return F.when((n >= 1) & (n <= 8) & (at >= 0) & (at + n <= F.length(data)) & (value <= SAFE), value.cast("bigint"))


def _real(data: Column, at: Column, n: Column) -> Column:
    """An IEEE number of 4 or 8 bytes as text, whole ones without a point."""
    bits = lambda m: F.conv(_hex(data, at + m, n - m), 16, 10).cast("bigint")
    first = F.conv(_hex(data, at, F.lit(2)), 16, 10).cast("int")
    wide = n == 8
    exponent = F.when(wide, first.bitwiseAND(0x7FF0) / 16).otherwise(first.bitwiseAND(0x7F80) / 128).cast("int")
    low = F.when(wide, F.lit(4503599627370496)).otherwise(F.lit(8388608))
    rest = F.when(wide, bits(1).bitwiseAND((1 << 52) - 1)).otherwise(bits(1).bitwiseAND((1 << 23) - 1))
    bias, top = F.when(wide, 1023).otherwise(127), F.when(wide, 2047).otherwise(255)
    plain = F.when(exponent == 0, rest.cast("double") / low * F.pow(F.lit(2.0), 1 - bias)).otherwise((1 + rest.cast("double") / low) * F.pow(F.lit(2.0), exponent - bias))
    value = F.when(first >= 0x8000, -plain).otherwise(plain)
    whole = (value == F.floor(value)) & (F.abs(value) < 1e15)
    shown = F.when(whole, value.cast("bigint").cast("string")).otherwise(value.cast("string"))
    return F.when(exponent < top, shown).when(rest > 0, "NaN").when(first >= 0x8000, "-Infinity").otherwise("Infinity")


def _wide_text(data: Column, at: Column, n: Column) -> Column:
    """UTF-16, big end first; null where surrogates don't pair."""
    raw = F.substring(data, (at + 1).cast("int"), n.cast("int"))
    paired = r"(?s)\G(?:[^\xD8-\xDF].|[\xD8-\xDB].[\xDC-\xDF].)"
    return F.when(F.regexp_replace(F.decode(raw, "ISO-8859-1"), paired, "") == "", F.decode(raw, "UTF-16BE"))


def headers(lists: DataFrame) -> DataFrame:
    """artifact, bytes, n, root, offset_bytes, ref_bytes, table_at and why a list can't be read, of lists (artifact string, bytes binary)."""
    b, trailer = F.col("bytes"), F.length("bytes") - 32
    byte = lambda at: F.conv(_hex(b, trailer + at, F.lit(1)), 16, 10).cast("int")
    eight = lambda at: _unsigned(b, trailer + at, F.lit(8))
    got = lists.select("artifact", "bytes", byte(6).alias("offset_bytes"), byte(7).alias("ref_bytes"), eight(8).alias("n"), eight(16).alias("root"), eight(24).alias("table_at"))
    bad = (
        F.when(b.isNull() | (F.length(b) < 40) | ~is_binary(b), "header is invalid")
        .when(~F.col("offset_bytes").between(1, 8) | ~F.col("ref_bytes").between(1, 8), "integer widths are invalid")
        .when(~F.coalesce(F.col("n").between(1, MAX_OBJECTS), F.lit(False)), "object count exceeds the limit")
        .when(~F.coalesce(F.col("root") < F.col("n"), F.lit(False)), "root object is invalid")
        .when(~F.coalesce(F.col("table_at").between(8, trailer) & (F.col("n") * F.col("offset_bytes") <= trailer - F.col("table_at")), F.lit(False)), "offset table is invalid")
    )
    return got.withColumn("reason", bad)


def _object(data: Column, at: Column, end: Column, refs: Column) -> Column:
    """One object, read where its offset points: kind, own text, edges to others, and why it can't be read."""
    marker = F.conv(_hex(data, at, F.lit(1)), 16, 10).cast("int")
    kind, info = F.shiftright(marker, 4), marker.bitwiseAND(15)
    beside = F.conv(_hex(data, at + 1, F.lit(1)), 16, 10).cast("int")
    width = F.pow(F.lit(2), beside.bitwiseAND(15)).cast("bigint")
    fits = (F.shiftright(beside, 4) == 1) & (width <= 8) & (at + 2 + width <= end)
    extended = info == 15
    length = F.when(~extended, info.cast("bigint")).when(fits, _unsigned(data, at + 2, width))
    start = at + 1 + F.when(extended, 1 + width).otherwise(0)
    made = lambda k, text=None, edges=None, reason=None: F.struct(
        F.lit(k).alias("kind"), (F.lit(None).cast("string") if text is None else text).alias("text"),
        (F.lit(None) if edges is None else edges).cast("array<struct<place:int,name:bigint,child:bigint>>").alias("edges"), (F.lit(None) if reason is None else reason).cast("string").alias("reason"),
    ).cast(_OBJECT)
    bad = lambda why: made("bad", reason=F.lit(why))
    number = F.when(kind == 1, F.pow(F.lit(2), info)).otherwise(info + 1).cast("bigint")
    value = F.when(number <= 8, _unsigned(data, at + 1, number))
    real = F.pow(F.lit(2), info).cast("bigint")
    size = F.when(kind == 6, length * 2).otherwise(length)
    raw = F.substring(data, (start + 1).cast("int"), size.cast("int"))
    text = F.when(kind == 5, F.decode(raw, "ISO-8859-1")).when(kind == 6, _wide_text(data, start, size)).otherwise(F.make_valid_utf8(raw.cast("string")))
    ref = lambda i: _unsigned(data, start + i * refs, refs)
    places = F.when(length > 0, F.sequence(F.lit(0), (length - 1).cast("int"))).otherwise(F.array().cast("array<int>"))
    edge = lambda place, name, child: F.struct(place.alias("place"), name.cast("bigint").alias("name"), child.alias("child"))
    members = F.transform(places, lambda i: edge(i, F.lit(None), ref(i)))
    entries = F.transform(places, lambda i: edge(i, ref(i), ref(length + i)))
    return (
        F.when((kind == 0) & (info == 0), made("null", F.lit("<null/>")))
        .when((kind == 0) & (info == 8), made("boolean", F.lit("<false/>")))
        .when((kind == 0) & (info == 9), made("boolean", F.lit("<true/>")))
        .when(kind.isin(1, 8), F.when((at + 1 + number <= end) & value.isNotNull(), made("number", value.cast("string"))).otherwise(bad("an integer is outside its range")))
        .when(kind == 2, F.when(real.isin(4, 8) & (at + 1 + real <= end), made("number", _real(data, at + 1, real))).otherwise(bad("a real number is invalid")))
        .when(kind == 3, F.when((info == 3) & (at + 9 <= end), made("number", _real(data, at + 1, F.lit(8)))).otherwise(bad("a date is invalid")))
        .when(kind.isin(4, 5, 6, 7), F.when(F.coalesce((size <= MAX_STRING) & (start + size <= end), F.lit(False)),
            F.when(kind == 4, made("string", F.concat(F.lit("<data:"), length.cast("string"), F.lit(">")))).when(text.isNull(), bad("a string is not UTF-16")).otherwise(made("string", text))).otherwise(bad("a string exceeds the limit")))
        .when(kind.isin(10, 12, 13), F.when(F.coalesce((length <= MAX_ITEMS) & (start + length * refs * F.when(kind == 13, 2).otherwise(1) <= end), F.lit(False)),
            F.when(kind == 13, made("dictionary", edges=entries)).otherwise(made("array", edges=members))).otherwise(bad("a collection exceeds the limit")))
        .otherwise(bad("an object's type is unknown"))
    )


def objects(heads: DataFrame) -> DataFrame:
    """artifact, object, kind, text, edges and reason of all objects of the readable lists of headers()."""
    b = F.col("bytes")
    good = heads.where("reason IS NULL")
    at = F.transform(F.sequence(F.lit(0), (F.col("n") - 1).cast("int")), lambda i: _unsigned(b, F.col("table_at") + i * F.col("offset_bytes"), F.col("offset_bytes")))
    wrong = F.exists("at", lambda x: x.isNull() | (x < 8) | (x >= F.col("table_at")))
    placed = good.withColumn("at", at).withColumn("wrong", wrong)
    read = F.when(F.col("wrong"), F.array(F.struct(F.lit("bad").alias("kind"), F.lit(None).cast("string").alias("text"), F.lit(None).alias("edges"), F.lit("an object's offset is invalid").alias("reason")).cast(_OBJECT)))
    read = read.otherwise(F.transform("at", lambda x: _object(b, x, F.col("table_at"), F.col("ref_bytes"))))
    got = placed.select("artifact", "n", F.when(F.col("wrong"), 0).otherwise(F.col("root")).alias("root"), F.posexplode(read).alias("object", "it"))
    return got.select("artifact", F.col("object").cast("bigint").alias("object"), (F.col("object") == F.col("root")).alias("is_root"), "n", "it.*")


def _levels(edges: DataFrame, roots: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Objects by their distance from the root, a set for each distance, and the lists that still go on below MAX_DEPTH: too deep, or in a cycle."""
    out = [roots.select(*KEY)]
    for _ in range(MAX_DEPTH + 1):
        down = apart(out[-1]).join(edges.select("artifact", F.col("parent").alias("object"), F.explode(F.array("name", "child")).alias("below")), KEY).where("below IS NOT NULL")
        out.append(kept(down.select("artifact", F.col("below").alias("object")).distinct(), "plist-level"))
        if out[-1].isEmpty():
            return out[:-1], out[-1].select("artifact")
    return out[:-1], out[-1].select("artifact").distinct()


def decoded(lists: DataFrame, most: int) -> DataFrame:
    """artifact, text, truncated and reason of binary property lists (artifact string, unique; bytes binary).

    text has a line for each value and each key before its value, in the order of the file: strings as they are,
    integers and reals in decimal, data as its length, null and booleans as empty elements. Lines are taken while they
    and their ends fit in most bytes; truncated tells that some didn't. A list that breaks a limit, names an object
    outside itself, has a key twice or one that is no string, nests deeper than MAX_DEPTH or holds itself, has no text
    but a reason. Only what the root reaches is judged, beside the table of offsets. Dates are seconds since 2001.
    Null bytes and ones that are no list have a reason too; other columns are left out; an empty table gives no rows.
    """
    heads = headers(lists)
    found = kept(objects(heads), "plist-objects")
    edges = found.where("edges IS NOT NULL").select("artifact", F.col("object").alias("parent"), "n", "kind", F.explode("edges").alias("e")).select("artifact", "parent", "n", "kind", "e.*")
    edges = kept(edges, "plist-edges")
    levels, deep = _levels(edges.where("child < n AND (name IS NULL OR name < n)"), found.where("is_root"))
    reached = kept(reduce(DataFrame.unionByName, [x.withColumn("level", F.lit(i)) for i, x in enumerate(levels)]).groupBy(*KEY).agg(F.max("level").alias("level")), "plist-reached")
    here = edges.join(apart(reached).select("artifact", F.col("object").alias("parent"), "level"), ["artifact", "parent"])
    named = here.join(apart(found).select("artifact", F.col("object").alias("name"), F.col("kind").alias("name_kind"), F.col("text").alias("key")), ["artifact", "name"], "left")
    named = named.withColumn("twice", F.count("*").over(Window.partitionBy("artifact", "parent", "name_kind", "key")) > 1)
    wrong_edge = (
        F.when(F.coalesce(F.col("child") >= F.col("n"), F.lit(True)) | ((F.col("kind") == "dictionary") & F.coalesce(F.col("name") >= F.col("n"), F.lit(True))), "a reference is invalid")
        .when((F.col("kind") == "dictionary") & ((F.col("name_kind") != "string") | F.col("twice")), "a key is invalid")
    )
    bad = found.join(apart(reached), KEY).where("reason IS NOT NULL").select("artifact", "reason").unionByName(named.select("artifact", wrong_edge.alias("reason")).where("reason IS NOT NULL"))
    bad = bad.unionByName(deep.select("artifact", F.lit("nesting exceeds the limit or holds itself").alias("reason")))
    bad = heads.where("reason IS NOT NULL").select("artifact", "reason").unionByName(bad).groupBy("artifact").agg(F.min("reason").alias("reason"))
    bad = kept(bad, "plist-bad")
    size = lambda text: F.when(text.isNotNull(), F.octet_length(text) + 1).otherwise(0).cast("bigint")
    tidy = kept(named.join(apart(bad), "artifact", "left_anti").select("artifact", "parent", "level", "place", "key", size(F.col("key")).alias("key_size"), "child"), "plist-named")
    sizes = kept(found.join(apart(reached), KEY).join(apart(bad), "artifact", "left_anti").where("edges IS NULL").select(*KEY, size(F.col("text")).alias("size")), "plist-sizes")
    limit = most + 1
    for level in range(len(levels) - 1, -1, -1):
        inner = apart(tidy).where(F.col("level") == level).join(sizes.withColumnRenamed("object", "child"), ["artifact", "child"], "left")
        each = F.least(F.col("key_size") + F.coalesce("size", F.lit(0)), F.lit(limit))
        sums = inner.groupBy("artifact", F.col("parent").alias("object")).agg(F.least(F.sum(each), F.lit(limit)).alias("size"))
        sizes = kept(sizes.unionByName(sums), "plist-sizes")
    members = apart(tidy).join(sizes.withColumnRenamed("object", "child"), ["artifact", "child"], "left").withColumn("size", F.coalesce("size", F.lit(0)))
    before = F.coalesce(F.sum(F.least(F.col("key_size") + F.col("size"), F.lit(limit))).over(Window.partitionBy("artifact", "parent").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    members = kept(members.withColumn("before", before), "plist-members")
    front = found.where("is_root").join(apart(bad), "artifact", "left_anti").join(apart(sizes), KEY, "left").select(*KEY, F.lit(0).cast("bigint").alias("start"), F.coalesce("size", F.lit(0)).alias("size"))
    whole = front.select("artifact", (F.col("size") > most).alias("truncated"))
    said = []
    own = found.where("edges IS NULL").select(*KEY, "text")
    for _ in levels:
        said.append(front.join(apart(own), KEY).select("artifact", "start", "text"))
        below = front.select("artifact", F.col("object").alias("parent"), "start").join(apart(members), ["artifact", "parent"])
        below = kept(below.select("artifact", "key", "key_size", F.col("child").alias("object"), (F.col("start") + F.col("before")).alias("at"), "size").where(F.col("at") < most), "plist-places")
        said.append(below.where("key IS NOT NULL").select("artifact", F.col("at").alias("start"), F.col("key").alias("text")))
        front = below.where("size > 0").select(*KEY, (F.col("at") + F.col("key_size")).alias("start"), "size").where(F.col("start") < most)
    lines = reduce(DataFrame.unionByName, said).where(F.col("start") + F.octet_length("text") + 1 <= most)
    text = lines.groupBy("artifact").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "text"))), lambda x: x["text"]), "\n").alias("text"))
    good = whole.join(apart(text), "artifact", "left").select("artifact", F.coalesce("text", F.lit("")).alias("text"), "truncated", F.lit(None).cast("string").alias("reason"))
    return good.unionByName(bad.select("artifact", F.lit(None).cast("string").alias("text"), F.lit(False).alias("truncated"), "reason"))
