"""Alignment of many texts at once against the table of each."""

import random

from folioscope.operators import glyphs as Gl


def test_straight_pairs_are_those_that_align_place_by_place():
    rng = random.Random(3)
    pairs = [("", ""), ("abc", "abc"), ("abcdefgh", "bcdefgha"), ("xabcdefghijk", "abcdefghijky"), ("ab", "abc")]
    for n in (3, 9, 30, 77, 200):
        for _ in range(60):
            x = "".join(rng.choices("abeo", k=n)) if rng.random() < 0.7 else "".join(rng.choices("abcdefghijklmnop", k=n))
            y = x.translate(str.maketrans("eo", "oe")) if rng.random() < 0.5 else x
            if rng.random() < 0.6:
                i, j = rng.randrange(n), rng.randrange(n)
                y = y[:i] + y[i + 1 :]
                y = y[:j] + rng.choice("abz") + y[j:]
            pairs.append((x, y))
    got = Gl.straight(pairs)
    want = [len(x) == len(y) and Gl.align(x, y) == list(y) for x, y in pairs]
    assert got == want and 20 < sum(got) < len(got) - 20


def test_counts_are_those_of_the_pairs(spark):
    from pyspark.sql import functions as F

    from folioscope.plans.evidence import _swapped

    native, ocr = _swapped(spark, "/root/testdata/sf0.001")
    some = lambda df: df.where("page_id < 30")
    a = Gl.letter_pairs(some(native), some(ocr)).groupBy("page_id", "font", "letter", "read").agg(F.count("*").alias("n"))
    b = Gl.letter_counts(some(native), some(ocr)).groupBy("page_id", "font", "letter", "read").agg(F.sum("n").alias("n"))
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect())) != []
