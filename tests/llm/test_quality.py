import random
import re

from pyspark.sql import types as T

from folioscope.llm import quality as Q

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("quality", T.StringType())])
SPACE = r"[\x20\x09-\x0D]+"


def slow(text):
    text = text or ""
    words = [w for w in re.split(SPACE, text) if w]
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    seen, hit = {}, set()
    for g in grams:
        seen[g] = seen.get(g, 0) + 1
    for i, g in enumerate(grams):
        if seen[g] > 1:
            hit |= set(range(i, i + 5))
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit))


def make(rng):
    vocab = ["the", "of", "a", "b#", "C", "é", "x|y", "<z>", "$$", "中文", "d."]
    n = rng.choice([0, 3, 4, 5, 6, 9, 12, 40, 300])
    return "".join(rng.choice(vocab[: rng.choice([2, 11])]) + rng.choice([" ", " ", "\n", "\t", " ", "\x0b", "\r\n"]) for _ in range(n))


def test_counts_equal_brute_force(spark):
    rng = random.Random(2)
    rows = [(i, make(rng), "x") for i in range(300)] + [(None, None, None), (5, "", "q"), (6, "\n\n \n", "q"), (7, "a b c d e " * 9000, "q"), (7, "a b c d e " * 9000, "q")]
    got = Q.score_quality(spark.createDataFrame(rows, SCHEMA)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept").collect()
    want = sorted(((i, *slow(t)) for i, t, _ in rows), key=str)
    assert sorted((tuple(r[:6]) for r in got), key=str) == want
    for r in got:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_rules_find_junk_and_keep_prose(spark):
    rng = random.Random(4)
    prose = lambda: " ".join(rng.choice(["The", "garden", "of", "and", "river", "is", "in", "stone", "walked", f"w{rng.randrange(500)}", "that.", "house"]) for _ in range(120))
    junk = lambda: " ".join(rng.choice(["QXR!!", "ZZT###", "|", "PLM$$$"]) + str(rng.randrange(999)) for _ in range(120))
    rows = [(i, prose(), None) for i in range(80)] + [(100 + i, junk(), None) for i in range(20)]
    kept = {r.doc_id for r in Q.score_quality(spark.createDataFrame(rows, SCHEMA)).where("kept").collect()}
    assert kept == set(range(80))


def test_empty(spark):
    assert Q.score_quality(spark.createDataFrame([], SCHEMA)).count() == 0


def test_slow_votes_are_fitted_to_convergence(spark):
    from folioscope.llm import quality

    rules = ["a", "b", "c"]
    rows = [(1, 1, 0, 900), (1, 0, -1, 40), (-1, 1, 0, 35), (0, -1, 1, 60), (-1, -1, 0, 30), (0, 0, -1, 200), (1, -1, -1, 9)]
    df = spark.createDataFrame(rows, "a int, b int, c int, n long")
    share, right = quality.fit_votes(df, rules)
    again, more = quality.fit_votes(df, rules, rounds=100_000, tolerance=1e-13)
    assert abs(share - again) < 1e-6 and all(abs(x - y) < 1e-6 for r in rules for x, y in zip(right[r], more[r]))
    early, _ = quality.fit_votes(df, rules, rounds=20, tolerance=1e-3)
    assert abs(early - again) > 1e-6


def test_posterior_equals_brute_force(spark):
    """Expectation-maximisation document by document, without patterns, and the verdict from it."""
    import math

    from pyspark.sql import functions as F

    rng = random.Random(9)
    prose = lambda: " ".join(rng.choice(["The", "garden", "of", "and", "river", "is", "in", "stone", "walked", f"w{rng.randrange(500)}", "that.", "house"]) for _ in range(rng.choice([8, 30, 120])))
    rows = [(i, prose() if rng.random() < 0.7 else make(rng), None) for i in range(150)]
    df = spark.createDataFrame(rows, SCHEMA)
    votes = Q.rule_votes()
    seen = [tuple(r) for r in Q.text_counts(df).select("doc_id", *votes.values()).collect()]
    share, right = 0.8, [(0.97, 0.3)] * len(votes)
    clip = lambda x: min(0.999, max(0.001, x))

    def good(row):
        odds = math.log(share / (1 - share))
        for v, (g, b) in zip(row[1:], right):
            odds += {1: math.log(g / (1 - b)), -1: math.log((1 - g) / b), 0: 0.0}[v]
        return 1 / (1 + math.exp(-odds))

    for _ in range(3000):
        p = [good(r) for r in seen]
        new = []
        for k in range(1, len(votes) + 1):
            g, b = 0.97, 0.3
            ng = nb = 1.0
            for r, x in zip(seen, p):
                if r[k]:
                    ng, nb = ng + x, nb + 1 - x
                    g, b = g + x * (r[k] == 1), b + (1 - x) * (r[k] == -1)
            new.append((clip(g / ng), clip(b / nb)))
        moved = max(abs(x - y) for a, c in zip(new, right) for x, y in zip(a, c))
        share, right = clip(sum(p) / len(p)), new
        if moved < 1e-10:
            break
    want = {r[0]: good(r) for r in seen}
    got = {r.doc_id: r for r in Q.score_quality(df).select("doc_id", "quality", "kept", "base_failed").collect()}
    assert all(abs(got[i].quality - want[i]) < 1e-4 for i in want)
    assert all(r.kept == (not r.base_failed and r.quality >= 0.5) for r in got.values())


def test_clashing_column_names(spark):
    df = spark.createDataFrame([(1, "the a b c d", "t", "w", 7, 8.0, "s", "own")], "doc_id long, text string, _t string, _w string, _l int, _h double, _s string, _own string")
    row = Q.score_quality(df).first()
    assert (row._t, row._w, row._l, row._h, row._s, row._own, row.n_words) == ("t", "w", 7, 8.0, "s", "own", 5)
