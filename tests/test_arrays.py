"""Running totals, matches and pieces against plain Python."""

import random
import re

from pyspark.sql import functions as F

from attestry.functions import arrays as A


def test_running_totals(spark):
    rng = random.Random(3)
    data = [(i, [rng.randrange(9) for _ in range(n)]) for i, n in enumerate((0, 1, 127, 128, 129, 300, 1000))]
    rows = spark.createDataFrame(data, "i int, x array<int>").select("x", A.running(F.col("x")).alias("s"), A.running(F.col("x"), lambda a, b: F.greatest(a, b)).alias("m"))
    for r in rows.collect():
        assert r["s"] == [sum(r["x"][:k]) for k in range(len(r["x"]))]
        assert r["m"] == [max([0, *r["x"][:k]]) for k in range(len(r["x"]))]


def test_matches_and_pieces(spark):
    texts = ["", "a", "é" * 1024, "x😀" * 3000, "ab1 cd22\n " * 700]
    bounds = [(0, 0), (0, 5), (3, 1024), (1000, 1030), (1023, 1024), (1024, 4096), (10, 2048), (0, 6000), (5000, 6000)]
    rows = spark.createDataFrame([(t, a, b) for t in texts for a, b in bounds], "t string, a int, b int")
    for r in rows.select("*", A.piece(A.segments(F.col("t")), F.col("a"), F.col("b")).alias("p"), A.found(F.col("t"), F.lit("[0-9]+")).alias("f")).collect():
        assert r["p"] == r["t"][r["a"] : r["b"]]
        assert [(x["start"], x["value"]) for x in r["f"]] == [(m.start(), m[0]) for m in re.finditer("[0-9]+", r["t"])]
