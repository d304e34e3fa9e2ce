from pyspark.sql import types as T

from folioscope.llm import urls as U

SCHEMA = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("host", T.StringType())])


def slow(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
        tail = rest[end:]
        path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
    fits = [(len(h + p), h + p, a) for a, h, p in U.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, None, None))
    return host, path, best[1], best[2]


def test_urls(spark):
    urls = [None, "", "no scheme", "http://Example.ORG", "http://example.org/es/1", "http://a.example.org/en/12?x=/de/", "http://notexample.org/es/", "https://x.com/fr/a#b", "https://x.COM/de/", "https://com/de", "a://b://c.org/d", "http://u@x.net:80/en\n/1", "http://É.org/É", "://org/", "http://xn.com?/fr/", "http://cheap-pills.net/en/1" * 3000]
    urls += [f"http://www.library{i}.net/fr/{i}" for i in range(20)] + [f"http://h{i}.com/de/{i}" for i in range(40)] + [f"http://k{i}.org/fr/{i}" for i in range(40)]
    rows = [(i, u, "clash") for i, u in enumerate(urls)] + [(None, "http://a.org/", None), (3, urls[3], "x")]
    got = U.judge_urls(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.page_id is not None:
            host, path, rule, verdict = slow(urls[r.page_id])
            assert (r.host, r.path, r.rule) == (host, path, rule)
            assert r.verdict == (verdict or ("allow" if r.score >= 0.5 else "block")) and 0 <= r.score <= 1
    assert U.judge_urls(spark.createDataFrame([], SCHEMA)).count() == 0


def test_model_is_a_distribution_and_separates():
    m = U.MarkovModel([b"abab", b"abc", b"\xff"], 3)
    for h in (b"", b"a", b"ab", b"zzz", b"\x02"):
        assert abs(sum(m.chance(h, c) for c in range(256)) - 1) < 1e-9
    good = [f"http://www.journal-{i}.net/en/{i}" for i in range(200)]
    bad = [f"http://cheap-bets-{i}.net/xx/{i}" for i in range(200)]
    f = U.RatioFilter(good, bad)
    assert all(f.score(u.replace(".net", ".info")) >= 0.5 for u in good) and all(f.score(u.replace(".net", ".info")) < 0.5 for u in bad)


def slow_log_likelihood(texts, order, url):
    """Witten-Bell interpolation written out over plain lists of contexts."""
    import math

    marked = [b"\x02" + t + b"\x03" for t in texts]
    after = lambda h: [t[i] for t in marked for i in range(max(1, len(h)), len(t)) if t[i - len(h) : i] == h]

    def chance(h, c):
        below = chance(h[1:], c) if h else 1 / 256
        seen = after(h)
        return below if not seen else (seen.count(c) + len(set(seen)) * below) / (len(seen) + len(set(seen)))

    t = b"\x02" + url + b"\x03"
    return sum(math.log(chance(t[max(0, i - order) : i], t[i])) for i in range(1, len(t)))


def test_verdict_equals_brute_force():
    good, bad = [f"http://lib{i}.org/a{i}" for i in range(8)], [f"http://x.com/de/{i * 7}" for i in range(8)]
    f = U.RatioFilter(good, bad, 3)
    texts = lambda own, words: [u.encode() for i, u in enumerate(own) if i % 4 != 3] + [w.encode() for w in words for _ in range(8)]
    for url in ("http://lib3.org/a9", "http://y.com/de/5", "", "wiki", "é"):
        raw = url.encode()
        want = (slow_log_likelihood(texts(good, U.ACCEPTED_WORDS), 3, raw) - slow_log_likelihood(texts(bad, U.REJECTED_WORDS), 3, raw)) / (len(raw) + 1)
        assert abs(f.difference(raw) - want) < 1e-9
        assert (f.score(url) >= 0.5) == (f.slope * (want - f.cut) >= 0)


def test_repeated_urls_are_learnt_once(spark):
    from pyspark.sql import functions as F

    rows = [("allow", "http://a.org/same")] * 300 + [("allow", f"http://b{i}.org/{i}") for i in range(50)] + [("block", "http://x.com/de/" + "z" * 9000)]
    got = U._sample(spark.createDataFrame(rows, "action string, url string").withColumn("host", F.lit("clash")), 100)
    assert len(got["allow"]) == len(set(got["allow"])) == 51 and [len(u) for u in got["block"]] == [U.STRETCH]


def expected_scores(urls, folds, order, difference):
    """Scores by whole models of all different labelled URLs; the cut from differences without a URL's own fold."""
    import math

    labels = {u: slow(u)[3] for u in urls if u and slow(u)[3]}
    words = {"allow": U.ACCEPTED_WORDS, "block": U.REJECTED_WORDS}
    texts = lambda own, but: [u.encode() for u in labels if labels[u] == own and folds[u] != but] + [w.encode() for w in words[own] for _ in range(8)]
    without = {but: [difference(texts(own, but), order) for own in ("allow", "block")] for but in (0, 1, 2, 3, None)}
    x = lambda u, but: (without[but][0](u.encode()) - without[but][1](u.encode())) / (len(u.encode()) + 1)
    cut, slope = U.RatioFilter._calibrate([(x(u, folds[u]), int(a == "allow")) for u, a in labels.items()])
    return {u: 1 / (1 + math.exp(-max(-30, min(30, slope * (x(u or "", None) - cut))))) for u in urls}


def folds_of(spark, urls):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(u,) for u in urls], "url string")
    return {r.url: r.fold for r in rows.select("url", F.pmod(F.xxhash64("url"), F.lit(U.FOLDS)).alias("fold")).collect()}


def test_byte_strings_do_not_depend_on_pieces(monkeypatch):
    import pyarrow as pa

    urls = [None, "", "http://a.org/é", "x" * 40, "", "http://b.com/" + "y" * 9, None]
    for piece in (1, 7, 16, 1 << 19):
        monkeypatch.setattr(U, "PIECE", piece)
        for order in (0, 4, 6):
            got, want = [], []
            for keys, rows in U._cuts(pa.array(urls).slice(1), order):
                got += zip(rows.tolist(), keys.tolist())
            for row, u in enumerate(urls[1:]):
                t = b"\x02" + (u or "").encode() + b"\x03"
                for i in range(1, len(t)):
                    own = t[max(0, i - order) : i + 1]
                    want.append((row, (len(own) << 8 * (order + 1)) + int.from_bytes(own)))
            assert got == want
    assert list(U._cuts(pa.array([], pa.string()), 4)) == []


def test_scores_equal_brute_force(spark):
    urls = [None, "", "x", "a://é\x02\x00\x03/", "http://new.net/wiki/1", "http://lib0.org/" + "ab" * 150]
    urls += [f"http://lib{i}.org/a{i}" for i in range(9)] + [f"http://x.com/de/{i * 7}" for i in range(9)] + ["http://x.com/de/7"] * 5
    for order in (0, 3):
        difference = lambda texts, order: lambda raw: slow_log_likelihood(texts, order, raw)
        want = expected_scores(urls, folds_of(spark, urls), order, difference)
        got = U.judge_urls(spark.createDataFrame([(i, u, None) for i, u in enumerate(urls)], SCHEMA), order=order).collect()
        assert len(got) == len(urls) and all(abs(r.score - want[urls[r.page_id]]) < 1e-6 for r in got)


def test_models_learn_from_all_labelled_urls(spark):
    urls = [f"http://a{i * 7919 % 100003}.org/{i}" for i in range(5600)] + [f"http://b{i * 104729 % 99991}.com/de/{i}" for i in range(5600)] + [f"http://a{i}.net/b" for i in range(40)]
    want = expected_scores(urls, folds_of(spark, urls), 2, lambda texts, order: U.MarkovModel(texts, order).log_likelihood)
    got = U.judge_urls(spark.createDataFrame([(i, u, None) for i, u in enumerate(urls)], SCHEMA), order=2).collect()
    assert len(got) == len(urls) and all(abs(r.score - want[urls[r.page_id]]) < 1e-6 for r in got)
