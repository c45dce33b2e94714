"""Column functions over arrays that grow in proportion to them: bindings, running totals and pieces of long texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements of a block of a running total, and characters of a segment of a text.
BLOCK, SEGMENT = 128, 1024


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def running(values: Column, combine: Callable[[Column, Column], Column] = lambda a, b: a + b, zero: int = 0) -> Column:
    """For each int of an array what all before it combine to, such as their sum.

    An array grows by an element in a step that copies it, so totals are built in blocks, and from the blocks' totals.
    """

    def before(xs: Column, start: Column) -> Column:
        begin = F.struct(start.alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(xs, begin, lambda s, x: F.struct(combine(s["at"], x).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")), lambda s: s["out"])

    def of_blocks(blocks: Column) -> Column:
        totals = F.transform(blocks, lambda b: F.aggregate(b, F.lit(zero), combine))
        return F.flatten(F.zip_with(blocks, before(totals, F.lit(zero)), before))

    def all_of(xs: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / BLOCK).cast("int")), lambda b: F.slice(xs, b * BLOCK + 1, BLOCK))
        return F.when(F.size(xs) <= BLOCK, before(xs, F.lit(zero))).otherwise(let(blocks, of_blocks))

    return let(values, all_of)


def found(text: Column, pattern: Column, lines: bool = False) -> Column:
    """array<struct<start, value>> of all matches of a pattern, with lines also their line.

    What lies between matches is as long as split says, so sums of lengths are places.
    """
    length = lambda x: F.coalesce(F.length(x), F.lit(0))
    ends = lambda x: length(x) - length(F.replace(x, F.lit("\n"), F.lit("")))
    more = lambda gap, value: [ends(gap).alias("above"), ends(value).alias("within")] if lines else []
    both = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, pattern, F.lit(0)), lambda gap, value: F.struct(F.length(gap).alias("gap"), value.alias("value"), *more(gap, value)))

    def placed(xs: Column) -> Column:
        at = running(F.transform(xs, lambda x: x["gap"] + length(x["value"])))
        spans = F.zip_with(xs, at, lambda x, before: F.struct((before + x["gap"]).alias("start"), x["value"].alias("value")))
        if lines:
            above = running(F.transform(xs, lambda x: x["above"] + x["within"]))
            number = F.zip_with(xs, above, lambda x, before: before + x["above"] + 1)
            spans = F.zip_with(spans, number, lambda s, n: F.struct(s["start"].alias("start"), s["value"].alias("value"), n.alias("line")))
        return F.filter(spans, lambda s: s["value"].isNotNull())

    return let(both, placed)


def segments(text: Column) -> Column:
    """A text as segments of SEGMENT characters, so that a piece of it is found without a walk from its start."""
    return F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{SEGMENT}}}"), F.lit(0))


def piece(parts: Column, start: Column, end: Column) -> Column:
    """The characters from start to end (exclusive) of a text in segments."""
    i, j = F.floor(start / SEGMENT).cast("int"), F.floor(end / SEGMENT).cast("int")
    part = lambda k: F.coalesce(F.get(parts, k), F.lit(""))
    first = part(i).substr(start - i * SEGMENT + 1, F.when(i == j, end - start).otherwise(F.lit(SEGMENT)))
    between = F.array_join(F.slice(parts, i + 2, F.greatest(j - i - 1, F.lit(0))), "")
    return F.when(end <= start, "").when(i == j, first).otherwise(F.concat(first, between, part(j).substr(F.lit(1), end - j * SEGMENT)))
