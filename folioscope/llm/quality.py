"""Quality rules as weak supervision, with DataFrame functions only.

Nine rules look at counts of a text and vote good (1), bad (-1) or abstain (0). They are
not conjoined: expectation-maximisation over all documents' votes estimates how often each
rule is right when it votes, and a document's posterior probability of being good decides.
The votes of all documents are first counted by pattern (a partial sum; there are at most
3^9 patterns), so an iteration touches that small table only, and what reaches the driver
is one row of estimates.
"""

from __future__ import annotations

from math import log

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import materialize

_SPACES = r"[\x20\x09-\x0D]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Frequent function words of the corpus's languages.
STOP_WORDS = "the of and to in is that it with by le la les de des et que un une pour der die das und von mit ist el los en y para con".split()
WINDOW = 5
COUNTS = ("n_words", "word_chars", "n_symbols", "n_upper", "n_marks", "n_stops", "n_lines", "n_dup_lines", "n_repeat_words")


def text_counts(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """The input's columns and the counts that the rules look at.

    The input's columns of the counts' names give way; no other name clashes.
    ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``, ``n_repeat_words`` (words in
    windows of five that occur twice or more), ``n_lines``, ``n_upper``,
    ``n_stops`` (different words of the stop list), ``n_marks`` (characters ``.!?``).
    Everything is computed inside a row: no shuffle. A null text has no words. Long texts
    are sorted by window hash only if they hold a repeated window.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    less = lambda chars: (F.length("_t") - F.length(F.translate("_t", chars, ""))).cast("long")
    # the input's columns travel as one, so that none can have a name that is used here
    kept = [c for c in docs.columns if c not in COUNTS]
    df = docs.select(F.struct(*kept).alias("_own"), text.alias("_t"))
    df = df.withColumn("_w", F.array_remove(F.split("_t", _SPACES), ""))
    df = df.withColumns(
        {
            "n_words": F.size("_w").cast("long"),
            "word_chars": (F.length("_t") - less(" \t\n\x0b\x0c\r")).cast("long"),
            "n_symbols": less("#*$%&|<>"),
            "n_upper": less(_UPPER),
            "n_marks": less(".!?"),
            "n_stops": F.size(F.array_intersect("_w", F.array(*map(F.lit, STOP_WORDS)))).cast("long"),
            "_l": F.filter(F.split("_t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
        }
    )
    row = ", ".join(f"_w[i + {k}]" for k in range(WINDOW))
    df = df.withColumns(
        {
            "n_lines": F.size("_l").cast("long"),
            "n_dup_lines": (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"),
            "_h": F.expr(f"CASE WHEN size(_w) >= {WINDOW} THEN transform(sequence(0, size(_w) - {WINDOW}), i -> xxhash64({row})) ELSE array() END"),
        }
    )
    df = df.withColumn("_s", F.expr("CASE WHEN size(array_distinct(_h)) < size(_h) THEN sort_array(transform(_h, (h, i) -> struct(h, i))) END"))
    same = "(k > 0 AND _s[k - 1].h = _s[k].h) OR (k + 1 < size(_s) AND _s[k + 1].h = _s[k].h)"
    df = df.withColumn("_p", F.expr(f"CASE WHEN _s IS NOT NULL THEN sort_array(filter(transform(sequence(0, size(_s) - 1), k -> CASE WHEN {same} THEN _s[k].i END), x -> x IS NOT NULL)) END"))
    repeated = F.expr(f"CASE WHEN _p IS NULL THEN 0L ELSE aggregate(sequence(1, size(_p) - 1), {WINDOW}L, (n, k) -> n + least({WINDOW}, _p[k] - _p[k - 1])) END")
    return df.withColumn("n_repeat_words", repeated).select("_own.*", *COUNTS)


def rule_votes() -> dict[str, Column]:
    """Vote of every rule over the columns of ``text_counts``."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    rate = lambda c: F.col(c) / n

    def vote(good: Column, bad: Column) -> Column:
        return F.when(bad, -1).when(good, 1).otherwise(0)

    lines = F.greatest(F.col("n_lines"), F.lit(1))
    chars = F.greatest(F.col("word_chars"), F.lit(1))
    return {
        "length": vote(F.col("n_words") >= 50, F.col("n_words") < 10),
        "word_length": vote(rate("word_chars").between(3, 10), ~rate("word_chars").between(2, 15)),
        "symbols": vote(rate("n_symbols") < 0.05, rate("n_symbols") > 0.3),
        "symbol_share": vote(F.col("n_symbols") / chars < 0.01, F.col("n_symbols") / chars > 0.05),
        "repeats": vote(rate("n_repeat_words") < 0.05, 100 * F.col("n_repeat_words") > 20 * F.col("n_words")),
        "lines": vote(F.col("n_dup_lines") == 0, F.col("n_dup_lines") / lines > 0.3),
        "capitals": vote(F.col("n_upper") / chars < 0.15, F.col("n_upper") / chars > 0.4),
        "function_words": vote(F.col("n_stops") >= 2, (F.col("n_stops") == 0) & (F.col("n_words") >= 30)),
        "sentences": vote(rate("n_marks").between(0.01, 0.5), (rate("n_marks") < 0.004) & (F.col("n_words") >= 50) | (rate("n_marks") > 0.8)),
    }


def fit_votes(patterns: DataFrame, rules: list[str], *, rounds: int = 10_000, tolerance: float = 1e-9) -> tuple[float, dict[str, tuple[float, float]]]:
    """Share of good documents and the two accuracies of each rule, by expectation-maximisation.

    ``patterns`` holds the rules' votes and ``n``, how many documents vote so. A rule's
    accuracies are the share of its votes that are right on good and on bad documents, each
    with one vote's worth of the start added; a rule that calls everything good thus carries
    no weight. Nothing else holds the estimates (a thousandth from 0 and 1 keeps logarithms
    finite). No rows: the start is returned.
    """
    share, right = 0.8, dict.fromkeys(rules, (0.97, 0.3))
    clip = lambda x: min(0.999, max(0.001, x))
    # one row a pattern, so at most 3 to the power of the rules: the rounds run on the driver
    rows = patterns.groupBy(*rules).agg(F.sum("n").alias("n")).collect()
    votes, n = np.array([[r[x] for x in rules] for r in rows]).reshape(len(rows), len(rules)), np.array([r["n"] for r in rows], float)
    if not n.sum():
        return share, right
    for _ in range(rounds):
        odds = log(share / (1 - share)) + sum(np.where(v == 1, log(g / (1 - b)), np.where(v == -1, log((1 - g) / b), 0.0)) for v, (g, b) in zip(votes.T, right.values()))
        p = 1 / (1 + np.exp(-odds))
        good, bad = n * p, n * (1 - p)
        new_share, new_right = clip(float(good.sum() / n.sum())), {}
        for r, v in zip(rules, votes.T):
            on_good = clip(float((good[v == 1].sum() + 0.97) / (good[v != 0].sum() + 1)))
            on_bad = clip(float((bad[v == -1].sum() + 0.3) / (bad[v != 0].sum() + 1)))
            new_right[r] = (on_good, on_bad)
        moved = max(abs(new_share - share), *(abs(x - y) for r in rules for x, y in zip(new_right[r], right[r])))
        share, right = new_share, new_right
        if moved < tolerance:
            break
    return share, right


def posterior(share: float, right: dict[str, tuple[float, float]]) -> Column:
    """Probability that a document is good, given its votes."""
    odds = F.lit(log(share / (1 - share)))
    for r, (on_good, on_bad) in right.items():
        odds = odds + F.when(F.col(r) == 1, log(on_good / (1 - on_bad))).when(F.col(r) == -1, log((1 - on_good) / on_bad)).otherwise(0.0)
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-odds))


def score_quality(docs: DataFrame, *, text_col: str = "text", keep_from: float = 0.5) -> DataFrame:
    """Counts, the rules' verdict and the posterior of every row of ``docs`` (column ``text``).

    Returns the input's columns but the text, the columns of ``text_counts``,
    ``base_failed``, ``quality`` and ``kept``; the input's columns of these names give way. Null and blank texts
    have no words and fail the base rule. Repeated rows are judged alike; an empty table
    gives none.
    """
    votes = rule_votes()
    own = [c for c in docs.columns if c not in (text_col, *COUNTS, "base_failed", "quality", "kept")]
    counted = materialize(text_counts(docs.select(*own, text_col), text_col=text_col).drop(text_col), "counts")
    voted = counted.select("*", *[v.alias(f"vote_{k}") for k, v in votes.items()])
    names = [f"vote_{k}" for k in votes]
    patterns = materialize(voted.groupBy(*names).agg(F.count("*").alias("n")).coalesce(1), "patterns")
    share, right = fit_votes(patterns, names)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    judged = voted.withColumn("base_failed", failed).withColumn("quality", posterior(share, right))
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= keep_from)).drop(*names)


def op10_quality(spark, sf_dir: str) -> DataFrame:
    """Quality counts and verdict of all ``documents``."""
    from folioscope.llm.common import table

    scored = score_quality(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return scored.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("quality", 6).alias("quality"))
