"""Text functions over columns.

Everything but Unicode compatibility folding is native; folding (``nfkc``) is an Arrow UDF,
and a text that is plain ASCII does not need it, so callers that know so may skip it.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from folioscope.cluster import ship

# Character classes.
DASHES = "‐‑‒–—−"
SPACES = "\\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
GROUP_SPACES = "\u00a0\u2007\u2008\u2009\u202f"
# Token patterns.
WORD = r"[\p{L}\p{N}%£€$+.,:/-]+"
CORE = r"[+-]?\d(?:[\d.,:/-]*\d)?"
CRITICAL = r"(?:[+-] ?)?(?:\p{Sc} ?)?(?:[+-] ?)?\d(?:[\d.,:/-]*\d)?(?: ?[%‰‱])?(?: ?\p{Sc})?(?: ?(\p{L}+)(?! ?[+-]?\p{Sc}?[+-]?\d))?"
YEAR = r"(?:19|20)\d{2}"
EVALUATION_TOKEN = r"[£€$¥]?\(?[+\-−–—]?\d+(?:[.,]\d+)*(?:%|ppt|bp|[xkmbn\u212a])?\)?"
EVALUATION_DASHES = "−–—"
# Rewriting of readings into their comparable form, as (pattern, replacement) in order.
SIGN_AFTER_CURRENCY = rf"([$£€])[{SPACES}]*([+-])[{SPACES}]*", "$2$1"
SIGN_BEFORE_CURRENCY = rf"([+-])[{SPACES}]*([$£€])[{SPACES}]*", "$1$2"
SPACED_PERCENT = rf"(\d[\d,.]*(?:\.\d+)?)[{SPACES}]+%", "$1%"
NOT_EVIDENCE = r"[^\p{L}\p{N}%£€$+.-]+", " "
GROUPED_DIGITS = rf"(?<=\d)[{GROUP_SPACES}](?=\d{{3}}(?!\d))", ""
INVISIBLE = r"\p{Cf}", ""
WIDE_SPACES = "[\u00a0\u1680\u2000-\u200a\u202f\u205f\u3000]", " "
ACCOUNTING = r"\(\s*((?:\p{Sc}|[+-])?\s?\d[\d.,:/-]*\d?\s?[%‰‱]?)\s*\)", "-$1"
# What may not stand next to a part that is looked for.
GUARD = r"[\p{N}\p{Lu}\p{Ll}]"


def nfkc(c: Column) -> Column:
    """Unicode compatibility composition; null stays null."""
    ship()
    return _nfkc(c)


@F.pandas_udf(StringType())
def _nfkc(values: pd.Series) -> pd.Series:
    return values.map(lambda v: v if v is None or v.isascii() else unicodedata.normalize("NFKC", v))


def _any(c: Column, pattern: str, to: str) -> Column:
    return F.regexp_replace(c, pattern, to)


def evidence_text(c: Column, *, fold: bool = True) -> Column:
    """Comparable form of a reading (TXT1): lower case, one space between runs, signs before currency."""
    c = F.coalesce(c, F.lit(""))
    c = F.lower(nfkc(c) if fold else c)
    c = F.translate(c, DASHES, "-" * len(DASHES))
    for rule in (SIGN_AFTER_CURRENCY, SIGN_BEFORE_CURRENCY, SPACED_PERCENT, NOT_EVIDENCE):
        c = _any(c, *rule)
    return F.trim(c)


def canonical_critical(c: Column, *, fold: bool = True) -> Column:
    """Form in which critical tokens are found (TXT2)."""
    c = _any(F.coalesce(c, F.lit("")), *GROUPED_DIGITS)
    c = F.lower(nfkc(c) if fold else c)
    c = _any(_any(c, *INVISIBLE), *WIDE_SPACES)
    c = F.translate(c, DASHES, "-" * len(DASHES))
    c = F.replace(c, F.lit("\u2044"), F.lit("/"))
    return _any(c, *ACCOUNTING)


def critical_tokens(c: Column, *, fold: bool = True) -> Column:
    """Ordered array of ``struct(core, tail)``; the tail is null where the number has no unit word (TXT3)."""
    text = canonical_critical(c, fold=fold)
    whole, tails = F.regexp_extract_all(text, F.lit(CRITICAL), F.lit(0)), F.regexp_extract_all(text, F.lit(CRITICAL), F.lit(1))
    return F.zip_with(
        whole,
        tails,
        lambda w, t: F.struct(F.replace(F.substring(w, F.lit(1), F.length(w) - F.length(t)), F.lit(" "), F.lit("")).alias("core"), F.nullif(t, F.lit("")).alias("tail")),
    )


def token_text(t: Column) -> Column:
    """``core`` or ``core|tail`` for display (TXT4 backwards)."""
    return F.concat_ws("|", t["core"], t["tail"])


def split_token(c: Column) -> Column:
    """``struct(core, tail)`` of an encoded token (TXT4)."""
    at = F.instr(c, "|")
    return F.struct(F.when(at == 0, c).otherwise(F.substring(c, F.lit(1), at - 1)).alias("core"), F.when(at > 0, F.substring(c, at + 1, F.length(c))).alias("tail"))


def tokens_compatible(a: Column, b: Column) -> Column:
    """Equal cores, and tails that are equal or missing on one side (TXT5)."""
    return (a["core"] == b["core"]) & (a["tail"].isNull() | b["tail"].isNull() | (a["tail"] == b["tail"]))


def _count(tokens: Column, core: Column, tail: Column) -> Column:
    return F.size(F.filter(tokens, lambda t: (t["core"] == core) & t["tail"].eqNullSafe(tail)))


def tokens_agree(a: Column, b: Column) -> Column:
    """Multiset agreement with optional tails (TXT6).

    For each core the totals are equal, and after exact pairs cancel, what has a tail on one
    side is at most what has none on the other.
    """

    def fits(core: Column) -> Column:
        left, right = (F.filter(x, lambda t: t["core"] == core) for x in (a, b))
        tails = F.array_distinct(F.transform(F.concat(left, right), lambda t: t["tail"]))
        over = lambda x, y, absent: F.aggregate(
            F.filter(tails, lambda t: t.isNull() if absent else t.isNotNull()),
            F.lit(0),
            lambda n, t: n + F.greatest(F.lit(0), _count(x, core, t) - _count(y, core, t)),
        )
        return (F.size(left) == F.size(right)) & (over(left, right, False) <= over(right, left, True)) & (over(right, left, False) <= over(left, right, True))

    cores = F.array_distinct(F.transform(F.concat(a, b), lambda t: t["core"]))
    return F.when(a == b, True).otherwise((F.size(a) == F.size(b)) & F.forall(cores, fits))


def same_multiset(a: Column, b: Column) -> Column:
    """Equal as multisets (TXT7)."""
    return F.sort_array(a) == F.sort_array(b)


def word_tokens(c: Column, *, normalized: bool = False) -> Column:
    """Words of the evidence form (TXT9)."""
    return F.regexp_extract_all(c if normalized else evidence_text(c), F.lit(WORD), F.lit(0))


def similarity_forms(form: Column) -> dict[str, Column]:
    """What a comparison needs of an evidence form, made once a row: ``compact`` (without spaces) and
    ``bag`` (each word with its count among its equals, so sets stand for multisets)."""
    words = F.sort_array(word_tokens(form, normalized=True))
    return {"compact": F.replace(form, F.lit(" "), F.lit("")), "bag": F.transform(words, lambda w, i: F.concat(w, F.lit(" "), (i - F.array_position(words, w) + 1).cast("string")))}


def similarity_of(compact_a: Column, compact_b: Column, bag_a: Column, bag_b: Column) -> Column:
    """0 to 1 (TXT8) from what ``similarity_forms`` makes of two evidence forms: 0 if one is empty, 1 if
    they are equal (spaces aside), the ratio of lengths if one holds the other, else the Dice
    coefficient of the bags."""
    la, lb = F.length(compact_a).cast("double"), F.length(compact_b).cast("double")
    n = F.size(bag_a) + F.size(bag_b)
    return (
        F.when((compact_a == "") | (compact_b == ""), 0.0)
        .when(compact_a == compact_b, 1.0)
        .when(F.contains(compact_a, compact_b) | F.contains(compact_b, compact_a), F.least(la, lb) / F.greatest(la, lb))
        .when((F.size(bag_a) == 0) | (F.size(bag_b) == 0), 0.0)
        .otherwise(2.0 * F.size(F.array_intersect(bag_a, bag_b)) / n)
    )


def similarity(a: Column, b: Column) -> Column:
    """The same (TXT8) for two evidence forms that are columns of their own."""
    fa, fb = similarity_forms(a), similarity_forms(b)
    return similarity_of(fa["compact"], fb["compact"], fa["bag"], fb["bag"])


def has_letter(c: Column) -> Column:
    return c.rlike(r"\p{L}")


def numeric_only(c: Column, tokens: Column) -> Column:
    """Holds a critical token and no letter (FLT4)."""
    return (F.size(tokens) > 0) & ~has_letter(c)


def is_blank(c: Column) -> Column:
    """Nothing but white space in the wide sense (FLT1)."""
    return ~F.coalesce(c, F.lit("")).rlike(rf"[^{SPACES}]")


def evaluation_tokens(c: Column) -> Column:
    """Numbers as scoring sees them, normalised (TXT12, TXT13)."""
    found = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(f"(?i){EVALUATION_TOKEN}"), F.lit(0))
    return F.transform(found, evaluation_token_normal)


def evaluation_token_normal(c: Column) -> Column:
    """Lower case, plain dash, accounting negative, no commas (TXT13).

    Of what a token can hold only the Kelvin sign has another compatibility form, so folding
    is that one replacement and stays native.
    """
    c = F.translate(F.lower(F.replace(c, F.lit("\u212a"), F.lit("k"))), EVALUATION_DASHES, "-" * len(EVALUATION_DASHES))
    bracketed = c.startswith("(") & c.endswith(")")
    inner = F.when(bracketed, F.substring(c, F.lit(2), F.length(c) - 2)).otherwise(c)
    return F.concat(F.when(bracketed, F.lit("-")).otherwise(F.lit("")), F.replace(inner, F.lit(","), F.lit("")))


def strip_currency(c: Column) -> Column:
    """Without currency signs (TXT14)."""
    return _any(c, r"\p{Sc}", "")


def currency_compatible(a: Column, b: Column) -> Column:
    """All currency signs are equal, or missing on one side (TXT14)."""
    signs = lambda x: F.regexp_replace(x, r"[^\p{Sc}]", "")
    return (signs(a) == "") | (signs(b) == "") | (signs(a) == signs(b))


def retrieval_normal(c: Column) -> Column:
    """Without currency signs, lower case, one space between words (TXT15)."""
    c = F.lower(strip_currency(F.coalesce(c, F.lit(""))))
    return F.trim(_any(c, rf"[{SPACES}]+", " "))


def retrieval_terms(c: Column) -> Column:
    """Runs of letters and digits of the retrieval form (TXT15)."""
    return F.regexp_extract_all(retrieval_normal(c), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def answer_form(c: Column) -> Column:
    """The retrieval form without commas, in which answers are compared (TXT15)."""
    return F.replace(retrieval_normal(c), F.lit(","), F.lit(""))


def answer_parts(c: Column) -> Column:
    """Lower-case words of an answer that hold a letter or digit (TXT15)."""
    return F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), rf"[{SPACES}]+"), lambda x: x.rlike(r"[\p{L}\p{N}]"))


def guarded_pattern(part: str) -> str:
    """The part with nothing glued on: no digit or cased letter, no number going on (TXT16)."""
    import re

    return rf"(?<!{GUARD})(?<!\p{{N}}[,.]){re.escape(part)}(?!{GUARD})(?![,.]\p{{N}})"


def guarded_contains(text: Column, part: str) -> Column:
    """The part stands in the text by itself (TXT16)."""
    return text.rlike(guarded_pattern(part))


def holds_answer(chunk: Column, answer: str) -> Column:
    """Every part of an answer stands in a chunk by itself, next to no other currency (TXT16)."""
    import re

    ok = F.lit(True)
    lower = F.lower(chunk)
    for part in re.split(rf"[{SPACES}]+", answer.lower()):
        bare = "".join(c for c in part if unicodedata.category(c) != "Sc")
        if any(unicodedata.category(c)[0] in "LN" for c in bare):
            seen = F.regexp_extract_all(lower, F.lit(rf"\p{{Sc}}*{guarded_pattern(bare)}\p{{Sc}}*"), F.lit(0))
            ok = ok & F.exists(seen, lambda x: currency_compatible(x, F.lit(part)))  # noqa: B023
    return ok


def text_key(c: Column) -> Column:
    """Compatibility form without white space (TXT24)."""
    return _any(nfkc(c), rf"[{SPACES}]+", "")


def xml_escape(c: Column) -> Column:
    """Markup characters as entities, control characters visible (TXT20)."""
    for raw, to in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(raw), F.lit(to))
    for code in [*range(9), 11, 12, *range(14, 32)]:
        c = F.replace(c, F.lit(chr(code)), F.lit(f"\\x{code:02x}"))
    return c


def script_of(ch: Column) -> Column:
    """Script of one character (TXT17)."""
    out = F.lit("Other")
    for name in ("Devanagari", "Thai", "Hebrew", "Arabic", "Hangul", "Katakana", "Hiragana", "Han", "Cyrillic", "Greek", "Latin"):
        out = F.when(ch.rlike(rf"\p{{Is{name}}}"), name).otherwise(out)
    return out


def is_suspicious(c: Column) -> Column:
    """Holds a control, private-use or unassigned character or U+FFFD (TXT23)."""
    return c.rlike("[\\p{Cc}\\p{Co}\\p{Cn}\ufffd&&[^\\t\\n\\r]]")


#: Characters that stand for a number but are letters by category (Han numerals and the like).
_LETTER_NUMERALS = "".join(chr(i) for i in range(0x250, 0x10000) if unicodedata.category(chr(i))[0] == "L" and unicodedata.numeric(chr(i), None) is not None)


def is_numeric(c: Column) -> Column:
    """Holds a numeral of any script (TXT23)."""
    return c.rlike(rf"[\p{{N}}{_LETTER_NUMERALS}]")


def table_rows(markdown: Column) -> Column:
    """Cells of the pipe-table rows of a Markdown text, without rules (TXT19)."""
    lines = F.filter(F.split(markdown, "\n"), lambda x: F.trim(x).startswith("|") & ~x.rlike(r"^[\s|:\-]+$"))
    return F.transform(lines, lambda x: F.transform(F.split(F.regexp_replace(F.trim(x), r"^\||\|$", ""), r"\|"), lambda y: F.trim(y)))


def html_tables(markdown: Column) -> Column:
    """The text with each run of pipe-table lines as an HTML table, its first row as the head (TXT22)."""
    cell = lambda x, tag: F.concat(F.lit(f"<{tag}>"), F.replace(F.replace(F.replace(x, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit(f"</{tag}>"))
    cells = lambda x: F.transform(F.split(F.regexp_replace(F.trim(x), r"^\||\|$", ""), r"\|"), lambda y: F.trim(y))
    row = lambda x, tag: F.concat(F.lit("<tr>"), F.array_join(F.transform(cells(x), lambda y: cell(y, tag)), ""), F.lit("</tr>"))
    is_row, is_rule = (lambda x: F.trim(x).startswith("|")), (lambda x: x.rlike(r"^[\s|:\-]+$"))
    lines = F.split(F.coalesce(markdown, F.lit("")), "\n")
    before = lambda i: F.coalesce(F.when(i > 0, is_row(F.get(lines, i - 1))), F.lit(False))
    after = lambda i: F.coalesce(is_row(F.get(lines, i + 1)), F.lit(False))
    one = lambda x, i: F.when(~is_row(x), x).otherwise(
        F.concat(F.when(before(i), F.lit("")).otherwise(F.lit("<table>")), F.when(is_rule(x), F.lit("")).when(before(i), row(x, "td")).otherwise(row(x, "th")), F.when(after(i), F.lit("")).otherwise(F.lit("</table>")))
    )
    return F.array_join(F.filter(F.transform(lines, one), lambda x: x != ""), "\n")


def word_bag(c: Column) -> Column:
    """Lower-case words of letters, digits and underscores (TXT27)."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def token_contained(text: Column, token: Column, *, without_currency: bool = False) -> Column:
    """A token stands in a text, strictly or with currency signs aside (TXT27); an empty one never does."""
    text, token = (strip_currency(text), strip_currency(token)) if without_currency else (text, token)
    return (token != "") & F.contains(text, token)
