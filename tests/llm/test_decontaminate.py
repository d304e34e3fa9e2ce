import random

import pytest
from pyspark.sql import types as T

from folioscope.llm import decontaminate as D

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("item_id", T.LongType())])
BENCH = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("id", T.StringType())])
QUESTION = "Yesterday the farmer Alice sold 12 kg of apples to Bob and later Alice kept 7 apples for her own kitchen table."


def prose(rng, n):
    return " ".join("".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randrange(1, 5))) for _ in range(n))


@pytest.fixture(scope="module")
def bench(spark):
    rng = random.Random(1)
    rows = [(0, QUESTION, "x"), (1, prose(rng, 40), "x"), (2, prose(rng, 4), "x"), (3, None, "x"), (4, "so", "x"), (5, "", None), (None, prose(rng, 20), "x"), (1, prose(random.Random(1), 40), "x")]
    return rows, spark.createDataFrame(rows, BENCH)


def found(spark, bench, texts):
    df = spark.createDataFrame([(i, t, 77) for i, t in enumerate(texts)], SCHEMA)
    return {(r.doc_id, r.item_id): r for r in D.leaks(df, bench[1]).collect()}


def test_verbatim_and_changed_surface(spark, bench):
    rng = random.Random(2)
    texts = [prose(rng, 60) + " " + bench[0][1][1] + " " + prose(rng, 60), bench[0][1][1].upper().replace(" ", "\n"), prose(rng, 200), None, "", prose(rng, 30) + " " + bench[0][2][1] + " " + prose(rng, 9), " ".join(bench[0][1][1].split()[:25]) + " " + prose(rng, 50), prose(rng, 60_000) + " " + bench[0][1][1]]
    got = found(spark, bench, texts)
    assert {k for k in got} == {(0, 1), (1, 1), (5, 2), (6, 1), (7, 1)}
    assert got[0, 1].coverage > 0.9 and not got[0, 1].renamed


def test_reparameterised_only_if_consistent(spark, bench):
    same = QUESTION.replace("Alice", "Carol").replace("Bob", "Dave").replace("12 kg", "31 lb").replace(" 7 ", " 9 ")
    broken = QUESTION.replace("Alice sold", "Carol sold").replace("Bob", "Eve")  # one name became two
    merged = QUESTION.replace("Bob", "Alice")  # two names became one
    got = found(spark, bench, ["Note. " + same, "Note. " + broken, "Note. " + merged, QUESTION])
    assert set(got) == {(0, 0), (3, 0)} and got[0, 0].renamed and not got[3, 0].renamed and got[0, 0].n_slots >= 4


def test_edges(spark, bench):
    none = spark.createDataFrame([], SCHEMA)
    assert D.leaks(none, bench[1]).count() == 0
    docs = spark.createDataFrame([(1, QUESTION, 7), (1, QUESTION, 7), (None, QUESTION, 7), (2, "clean text of no one", 7), (None, "clean", 7)], SCHEMA)
    assert D.leaks(docs, spark.createDataFrame([], BENCH)).count() == 0
    assert sorted((r.doc_id, r.item_id) for r in D.leaks(docs, bench[1]).collect() if r.doc_id) == [(1, 0)]
    kept = D.drop_leaking(docs, bench[1])
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["2", "None", "None"]


def test_number_heavy_items(spark):
    items = ["12 + 5 x 3 - 7 / 2 = 9 + 41 - 6", "Add 12 34 56 78 91 11 45 67 89 then stop", "The Treaty Of Westphalia Ended The Thirty Years War", "31 41 59 26 53 58 97 93", "日本語の質問です", "so it"]
    b = spark.createDataFrame([(i, t, None) for i, t in enumerate(items)], BENCH)
    changed = ["Quiz: 14 + 6 x 4 - 8 / 1 = 3 + 52 - 9", "Please add 13 35 57 79 92 12 46 68 90 then stop now"]
    texts = [*items[:5], *changed, "31 41 59 26 and so it goes", "add 12 34 then stop", "前日本語の質問です。後"]
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], SCHEMA)
    got = {(r.doc_id, r.item_id): r.renamed for r in D.leaks(df, b).collect()}
    assert got == {**{(i, i): False for i in range(5)}, (5, 0): True, (6, 1): True, (9, 4): False}


def test_names_that_begin_sentences(spark):
    item = "Alice has 3 apples. Bob has 5 apples. Carol gives Bob 2 apples. Dave eats 1 apple. How many apples are left?"
    same = item.replace("Alice", "Erin").replace("Bob", "Frank").replace("Carol", "Gina").replace("Dave", "Hank").replace("3", "8").replace("5", "9").replace(" 2 ", " 4 ").replace(" 1 ", " 6 ")
    df = spark.createDataFrame([(0, item.upper(), 0), (1, same, 0), (2, item.lower(), 0), (3, "Alice has apples. How many are left?", 0)], SCHEMA)
    got = {r.doc_id: r.renamed for r in D.leaks(df, spark.createDataFrame([(0, item, None)], BENCH)).collect()}
    assert got == {0: False, 1: True, 2: False}


def slow_words(text):
    import regex

    words = [regex.sub("[" + regex.escape(D.MARKS) + "]", "", w) for w in regex.split(r"[\x20\x09-\x0D]+", text or "")]
    words = [w for w in words if w]
    kinds = []
    for i, w in enumerate(words):
        low = w.lower()
        if regex.search(r"(?:^|[^\p{L}\p{N}])\p{Lu}\p{Ll}", w):
            kinds.append("@n")
        elif regex.fullmatch(r"[+-]?[0-9]+[/-]?[0-9]*[a-z]{0,2}", low):
            kinds.append("#")
        elif i and low in D.UNITS and regex.search("[0-9]", words[i - 1]):
            kinds.append("@u")
        else:
            kinds.append(None)
    return [w.lower() for w in words], kinds


def slow_leaks(texts, items):
    out = set()
    for item_id, item in items:
        for reading in (item, item.lower()):
            iw, ik = slow_words(reading)
            lit = [i for i, k in enumerate(ik) if k is None]
            if len(lit) < 3:
                if reading is not item and reading != item:
                    continue
                k = min(5, len(iw))
                windows = [(i, i + k) for i in range(len(iw) - k + 1)] if len(iw) >= 3 else []
                fits = lambda dw, dk, p, a, b: dw[p : p + b - a] == iw[a:b]
            else:
                k = min(5, len(lit))
                windows = [(lit[j], lit[j + k - 1] + 1) for j in range(len(lit) - k + 1)]
                fits = lambda dw, dk, p, a, b: len(dw) >= p + b - a and all(dk[p + o] == ik[a + o] and (ik[a + o] or dw[p + o] == iw[a + o]) for o in range(b - a))
            for doc_id, text in texts:
                dw, dk = slow_words(text)
                for diagonal in range(-len(iw), len(dw)):
                    hit = [(a, b) for a, b in windows if a + diagonal >= 0 and fits(dw, dk, a + diagonal, a, b)]
                    slots = {(iw[x], dw[x + diagonal]) for a, b in hit for x in range(a, b) if ik[x]}
                    consistent = all(x == y for x, y in slots) or len(slots) == len({x for x, _ in slots}) == len({y for _, y in slots})
                    if hit and (len(hit) >= 0.5 * len(windows) or len(hit) >= 9) and consistent:
                        out.add((doc_id, item_id))
    return out


def test_equals_brute_force(spark):
    rng = random.Random(8)
    word = lambda: rng.choice(["the", "cost", "of", "a", "is", "Anna", "Bert", "Cleo", "12", "7", "7", "40", "kg", "km", "+", "=", "and", "how", "many?", "left."])
    items = [(i, " ".join(word() for _ in range(rng.choice([3, 4, 6, 9, 14, 25])))) for i in range(25)]
    texts = []
    for i in range(60):
        own = rng.choice(items)[1].split()
        if rng.random() < 0.5:
            swap = {"Anna": "Dora", "12": "31", "7": rng.choice(["8", "40"]), "kg": "lb", "Bert": "Emil"}
            own = [swap.get(w, w) for w in own]
        if rng.random() < 0.3:
            own = own[rng.randrange(3) : len(own) - rng.randrange(3)]
        texts.append((i, " ".join([word() for _ in range(rng.randrange(9))] + own + [word() for _ in range(rng.randrange(9))])))
    got = D.leaks(spark.createDataFrame([(i, t, 1) for i, t in texts], SCHEMA), spark.createDataFrame([(i, t, "x") for i, t in items], BENCH))
    found, want = {(r.doc_id, r.item_id) for r in got.collect()}, slow_leaks(texts, items)
    assert found == want and len(want) > 30


def test_clashing_column_names(spark):
    rows = [(1, QUESTION, "a", 2, "b", 3, "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _m string, _c int, _p string, hash int, id string")
    b = spark.createDataFrame([(0, QUESTION, "k", 1, "p")], "item_id long, text string, _t string, k int, _p string")
    assert D.leaks(df, b).count() == 1 and D.drop_leaking(df, b).count() == 0
