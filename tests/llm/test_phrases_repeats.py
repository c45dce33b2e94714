"""Repeated passages, collocations and fill-in-middle, each against a plain version over the same rows."""

import hashlib
import random
import re
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from attestry.llm import op11_repeats, op12_collocations, op13_middle
from attestry.llm.catalog import QUERIES, SQL
from tests.conftest import same
from tests.llm.conftest import DDL, PROSE, rows

NAMES = ("op11_repeats", "op12_collocations", "op13_middle")


@pytest.mark.parametrize("name", NAMES)
def test_same_as_sql(spark, sf_dir, duck, name):
    assert same(QUERIES[name](spark, sf_dir), duck, SQL[name])


# -- repeats


def plain_repeats(data, window=13):
    """Words kept of each (doc_id, text), in order of the rows."""
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in data]
    ids = [float("inf") if i is None else i for i, _ in data]
    first = {}
    for i, ws in zip(ids, words, strict=True):
        for p in range(len(ws) - window + 1):
            w = tuple(ws[p : p + window])
            first[w] = min(first.get(w, i), i)
    out = []
    for i, ws in zip(ids, words, strict=True):
        gone = {q for p in range(len(ws) - window + 1) if first[tuple(ws[p : p + window])] < i for q in range(p, p + window)}
        out.append((len(ws), len(gone), " ".join(w for q, w in enumerate(ws) if q not in gone)))
    return out


def same_repeats(spark, data, **options):
    df = spark.createDataFrame([(i, t, "en", "s", 0, *"khrbfso") for i, t in data], DDL)
    found = op11_repeats.repeated(df.repartition(3), **options).collect()
    plain = plain_repeats(data, options.get("window", 13))
    assert sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], r["kept"]) for r in found) == sorted((str(i), *p) for (i, _), p in zip(data, plain, strict=True))
    return found


@pytest.mark.parametrize("period", range(1, 14))
def test_cover_has_every_difference(period):
    d = op11_repeats.cover(period)
    assert {(a - b) % period for a in d for b in d} == set(range(period))
    assert period != 7 or len(d) == 3


def test_repeats_at_every_alignment(spark):
    """Passages of 12 to 15 words at all offsets; 12 words never repeat, 13 always do."""
    rng = random.Random(3)
    new = lambda n: " ".join(str(rng.randrange(10**9)) for _ in range(n))
    passages = {n: new(n) for n in (12, 13, 14, 15)}
    data = [(k, f"{new(k % 9)} {passages[12 + k % 4]} {new(k % 5)} {passages[12 + (k + 1) % 4]}") for k in range(120)]
    found = same_repeats(spark, data)
    assert sum(r["n_removed"] for r in found) > 1000
    same_repeats(spark, data, unit_bytes=200)
    same_repeats(spark, data, window=5, period=3)


def test_repeats_of_few_words_and_copies(spark):
    """Small vocabularies make overlapping matches in one document, and a large group of copies has no hot task."""
    rng = random.Random(5)
    data = [(k, " ".join(rng.choice("ab") for _ in range(rng.randrange(60)))) for k in range(80)]
    data += [(1000 + k, PROSE) for k in range(60)] + [(1000, PROSE), (None, PROSE), (None, PROSE), (-5, PROSE + " \t once\x0bmore")]
    same_repeats(spark, data, unit_bytes=500)


def test_repeats_of_odd_rows(spark, odd, none):
    data = [(r["doc_id"], r["text"]) for r in odd.collect()]
    found = same_repeats(spark, data)
    assert {r["n_words"] for r in found if r["doc_id"] in (0, 1, 2)} == {0}
    assert op11_repeats.repeated(none).collect() == []


def test_a_unit_fits_beside_idle_workers():
    """An executor keeps several workers of Python, each with what its largest unit took."""
    rng = random.Random(5)
    text = " ".join(f"w{rng.randrange(50_000)}" for _ in range(2_000))
    group = pa.table({"doc_id": pa.array(range(op11_repeats.UNIT_BYTES // len(text)), pa.int64()), "text": [text] * (op11_repeats.UNIT_BYTES // len(text))})
    tracemalloc.start()
    try:
        unit = op11_repeats.Unit(group)
        names = np.unique(unit.anchors(13, 7)[1])
        op11_repeats._told(unit, unit.shared(np.ones(len(names), bool), 13, 7), 13)
        assert tracemalloc.get_traced_memory()[1] < 160e6
    finally:
        tracemalloc.stop()


def test_repeats_spans(spark):
    found = {r["doc_id"]: r for r in op11_repeats.repeated(spark.createDataFrame(rows([PROSE, f"first {PROSE} last"]), DDL)).collect()}
    assert found[1]["spans"] == [(1, 1 + len(PROSE.split()))] and found[1]["kept"] == "first last" and found[0]["spans"] == []


# -- collocations


def plain_phrases(data, max_n=3, least=10, share=50, top=2000):
    f, n = defaultdict(Counter), Counter()
    for lang, text in data:
        lang = "und" if lang is None else lang
        folded = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", folded):
            ws = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(ws)
            for k in range(1, max_n + 1):
                f[lang].update(tuple(ws[i : i + k]) for i in range(len(ws) - k + 1))
    out = []
    for lang, counts in f.items():
        candidates = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        found = []
        for p, a in candidates.items():
            if any(100 * b >= share * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in candidates.items() if len(q) > len(p)):
                continue
            score, k = min((1_000_000 * a * a // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out += [(lang, r, p.decode(), -a, left, right, n[lang], -s) for r, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


def same_phrases(spark, data, top=2000, **options):
    df = spark.createDataFrame([(k, t, lang, "s", 0, *"khrbfso") for k, (lang, t) in enumerate(data)], DDL).repartition(3)
    found = sorted(tuple(r) for r in op12_collocations.ranked(op12_collocations.collocations(df, **options), top).collect())
    assert found == plain_phrases(data, top=top, **options)
    return found


def test_phrases_of_few_words(spark):
    rng = random.Random(7)
    text = lambda: "".join(rng.choice(("a", "b ", "C ", "d\t", "é ", "\x01x ", "\x00 ", ". ", "\n")) for _ in range(200))
    data = [(rng.choice(("en", "de", None, "und", "e\tn", "e\nIn", "")), text()) for _ in range(60)]
    assert len(same_phrases(spark, data)) > 50
    same_phrases(spark, data, max_n=2, least=3, share=90)
    same_phrases(spark, data, max_n=5, least=4, top=7)


def test_phrases_in_small_flushes_and_batches(spark, monkeypatch):
    """The stack holds its prefixes across Arrow batches, and tasks tell what they counted in parts."""
    monkeypatch.setattr(op12_collocations, "FLUSH", 50)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "7")
    try:
        rng = random.Random(9)
        same_phrases(spark, [("en", " ".join(rng.choice("aabc") for _ in range(40))) for _ in range(40)])
    finally:
        spark.conf.set(key, before)


def test_stack_across_batches():
    """Ranges cut anywhere give counts that add up to those of one range."""
    data = sorted(("\t".join(("en", *ws)), n) for ws, n in ((("a",), 1), (("a", "b"), 2), (("a", "b", "c"), 3), (("a", "b", "d"), 4), (("b",), 5), (("b", "a"), 1)))[::-1]
    batch = lambda part: pa.RecordBatch.from_arrays([pa.array([k for k, _ in part], pa.string()), pa.array([n for _, n in part], pa.int64())], names=["key", "n"])
    run = op12_collocations._prefix_counts(3, 3)
    for cut in range(1, len(data)):
        for size in (1, 2, 9):
            total = Counter()
            for part in (data[:cut], data[cut:]):
                for out in run(batch(part[i : i + size]) for i in range(0, len(part), size)):
                    for r in out.to_pylist():
                        total[r["key"], r["k"]] += r["f"]
            assert total["en", 0] == 16 and total["en\ta", 1] == 10 and total["en\ta\tb", 2] == 9 and total["en\ta\tb\td", 3] == 4 and total["en\tb", 1] == 6


def test_products_past_64_bits(spark):
    counts = 3 * 10**11
    big = F.lit(counts).cast("decimal(20,0)")
    found = spark.range(1).select((F.lit(1_000_000).cast("decimal(7,0)") * (big * big)).alias("dividend"), (big * F.lit(7 * 10**11).cast("decimal(20,0)")).alias("divisor")).selectExpr("dividend div divisor AS s")
    assert found.first()["s"] == 1_000_000 * counts * counts // (counts * 7 * 10**11)


def test_phrases_of_odd_rows(spark, odd, none):
    data = [(r["lang"], r["text"]) for r in odd.collect()]
    same_phrases(spark, [*data, (None, "x y " * 30)])
    assert op12_collocations.ranked(op12_collocations.collocations(none)).collect() == []


# -- fill in the middle


def plain_middle(i, text):
    text = text or ""
    u = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    h = hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    lo, hi = sorted((h1 % (len(u) + 1), h2 % (len(u) + 1)))
    p, m, s = "".join(u[:lo]), "".join(u[lo:hi]), "".join(u[hi:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return len(u), "plain", None, None, text
    return (len(u), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 80 else (len(u), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def same_middle(df):
    found = op13_middle.transformed(df).withColumn("back", op13_middle.restored(F.col("output"), F.col("form"))).collect()
    texts = sorted((str(r["doc_id"]), r["text"] or "") for r in df.collect())
    assert sorted((str(r["doc_id"]), r["back"]) for r in found) == texts
    plain = sorted((str(r["doc_id"]), *plain_middle(r["doc_id"], r["text"])) for r in df.collect())
    assert sorted(((str(r["doc_id"]), r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in found), key=str) == sorted(plain, key=str)
    return found


def test_middle_of_odd_rows(odd, none):
    same_middle(odd)
    assert op13_middle.transformed(none).collect() == [] and op13_middle.rewritten(none).collect() == []


def test_middle_of_strange_texts(spark):
    strange = ["<P", "S><P", "a<S>b", "<M>", "<<S", " ", "  　", "<S <P <M", "é漢😀 é漢😀\x0b", "\n\n\nx"]
    found = same_middle(spark.createDataFrame(rows([x + y for x in strange for y in strange] * 2), DDL))
    assert {r["form"] for r in found} == {"plain", "spm", "psm"}


def test_middle_keeps_rows(odd):
    found = op13_middle.rewritten(odd)
    assert found.columns == odd.columns and found.count() == odd.count()
    assert {r["doc_id"] for r in found.where("text IS NULL").collect()} == {0}


def test_passes_hold_no_tokens():
    """Both passes take matches one at a time."""
    assert list(op13_middle.cut_places("a b c", (0, 2))) == [0, 3] and list(op13_middle.cut_places("a b c ", (1, 1))) == [1, 1]
    assert op13_middle.told(7, "a b c ").n == 4
