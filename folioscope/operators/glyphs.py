"""Glyph audit: letters of a font that the reading systematically shows as other letters."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope import constants as K
from folioscope.cluster import ship
from folioscope.functions import text as T
from folioscope.operators.associate import coverage

_BLANK = re.compile(r"\s+")
GAP = 2


def letters_of(text: str, fold: bool = True) -> str:
    """Folded text without white space."""
    return _BLANK.sub("", unicodedata.normalize("NFKC", text or "") if fold else text or "")


def align(native: str, read: str) -> list[str | None]:
    """The read character that stands where each native one does, or None (TXT18).

    Edit distance with gaps at 2 and substitutions at 1. If the reading is clearly longer its
    ends are free, and of equal ends the one nearest the native length is taken. Rows of the
    table are filled as vectors: a running minimum stands for the gaps along the row.
    """
    n, m = len(native), len(read)
    if not n:
        return []
    free = m > 1.25 * n + 2
    other = np.array([ord(c) for c in read], np.int64)
    along = GAP * np.arange(m + 1, dtype=np.int64)
    table = np.zeros((n + 1, m + 1), np.int64)
    table[0] = 0 if free else along
    for i, c in enumerate(native, 1):
        row = np.empty(m + 1, np.int64)
        row[0] = i * GAP
        row[1:] = np.minimum(table[i - 1, :-1] + (other != ord(c)), table[i - 1, 1:] + GAP)
        table[i] = np.minimum.accumulate(row - along) + along
    j = min(range(m + 1), key=lambda k: (table[n, k], abs(k - n), k)) if free else m
    out: list[str | None] = [None] * n
    i = n
    while i and j:
        if table[i, j] == table[i - 1, j - 1] + (native[i - 1] != read[j - 1]):
            i, j = i - 1, j - 1
            out[i] = read[j]
        elif table[i, j] == table[i - 1, j] + GAP:
            i -= 1
        else:
            j -= 1
    return out


def straight(pairs: list[tuple[str, str]]) -> list[bool]:
    """Which pairs ``align`` would align place by place, decided for many at once.

    That is so for texts of one length unless a path off the diagonal is cheaper than their ``d``
    differences. A path that goes ``k`` places off pays ``2 * GAP * k`` for gaps, so only a band of
    ``(d - 1) // (2 * GAP)`` places can hold one; a tie goes to the diagonal.
    """
    out, bands = [False] * len(pairs), defaultdict(list)
    for at, (x, y) in enumerate(pairs):
        if len(x) == len(y):
            a, b = (np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in (x, y))
            d = 0 if x == y else int((a != b).sum())
            if d <= 2 * GAP:
                out[at] = True
            else:
                bands[1 << ((d - 1) // (2 * GAP) - 1).bit_length()].append((len(x), at, a, b, d))
    for k, rows in bands.items():
        rows.sort(key=lambda r: -r[0])
        for part in (rows[i : i + 1024] for i in range(0, len(rows), 1024)):
            longest, lengths = part[0][0], np.array([r[0] for r in part])
            own, read = np.zeros((longest, len(part)), np.uint32), np.full((longest + 2 * k + 1, len(part)), 0xFFFFFFFF, np.uint32)
            for j, (n, _, a, b, _) in enumerate(part):
                own[:n, j], read[k : k + n, j] = a, b
            off = np.arange(-k, k + 1, dtype=np.int32)[:, None] * GAP
            cost = np.where(off < 0, np.int32(1 << 20), off) + np.zeros((1, len(part)), np.int32)
            for i in range(longest):
                m = int(np.searchsorted(-lengths, -i, "left"))  # those longer than i
                cost = cost[:, :m]
                step = cost + (read[i : i + 2 * k + 1, :m] != own[i, :m])
                np.minimum(step[:-1], cost[1:] + GAP, out=step[:-1])
                cost = np.minimum.accumulate(step - off, axis=0) + off
                for j in range(m - 1, -1, -1):
                    if lengths[j] != i + 1:
                        break
                    out[part[j][1]] = bool(cost[k, j] == part[j][4])
    return out


def _aligned(b: pa.RecordBatch, fold: bool, places: bool) -> Iterator[tuple[int, str, list[str | None] | str]]:
    """Row, letters and what is read for each, for the texts of a batch."""
    both = [(letters_of(x, fold), letters_of(y, fold)) for x, y in zip(b.column("text").to_pylist(), b.column("read").to_pylist())]
    plain = [len(x) == len(y) for x, y in both] if places else straight(both)
    for i, (own, read) in enumerate(both):
        yield i, own, read if plain[i] else align(own, read)


def _covered(native: DataFrame, ocr: DataFrame) -> DataFrame:
    """Observations that readings cover to 0.6, with what is read there."""
    over = coverage(native, ocr).where(F.col("covered") >= K.GLYPH_COVERAGE)
    return native.where("font is not null").join(over, ["page_id", "id"]).select("page_id", "id", "font", "text", "read")


def _testified(pairs: DataFrame, native: DataFrame, ocr: DataFrame) -> DataFrame:
    """Pairs whose letter is of a script that can testify on its page."""

    def scripts(df: DataFrame, name: str) -> DataFrame:
        ch = F.explode(F.array_distinct(F.split(F.regexp_replace("text", r"[^\p{L}]+", ""), "")))
        return df.select("page_id", ch.alias("ch")).where("ch <> ''").distinct().select("page_id", T.script_of(F.col("ch")).alias("script")).groupBy("page_id").agg(F.collect_set("script").alias(name))

    kana = F.array(F.lit("Hiragana"), F.lit("Katakana"))
    seen = scripts(ocr.where("recovery_method is null"), "shown").join(scripts(native, "written"), "page_id", "left")
    blind = F.arrays_overlap("written", kana) & ~F.arrays_overlap("shown", kana)
    seen = seen.select("page_id", F.when(blind, F.array_remove("shown", "Han")).otherwise(F.col("shown")).alias("shown"))
    return pairs.join(seen, "page_id").where(F.array_contains("shown", T.script_of(F.col("letter")))).drop("shown")


def letter_pairs(native: DataFrame, ocr: DataFrame, *, fold: bool = True, places: bool = False) -> DataFrame:
    """``page_id``, ``id``, ``font``, ``letter``, ``read`` for every aligned letter.

    Only observations that readings cover to 0.6 are aligned (the filter comes before the
    costly part). A script that the reading never shows on a page can't testify, and Han
    can't where the page has kana that the reading lacks. With ``places`` texts of one length
    are read place by place, as a font shows them whose map swaps letters one for one; gaps,
    which on words that repeat can be cheaper than many swaps, are for other lengths only.
    """
    ship(native.sparkSession)
    kind = native.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[] for _ in range(5)]
            pages, ids, fonts = (b.column(c).to_pylist() for c in ("page_id", "id", "font"))
            for i, own, read in _aligned(b, fold, places):
                for c, got in zip(own, read):
                    if got is not None and c.isalpha():
                        for col, v in zip(cols, (pages[i], ids[i], fonts[i], c, got)):
                            col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], b.schema.field("page_id").type), *[pa.array(c, pa.string()) for c in cols[1:]]], ["page_id", "id", "font", "letter", "read"])

    return _testified(_covered(native, ocr).mapInArrow(run, f"page_id {kind}, id string, font string, letter string, read string"), native, ocr)


def letter_counts(native: DataFrame, ocr: DataFrame, *, fold: bool = True, places: bool = False) -> DataFrame:
    """``letter_pairs`` counted: ``page_id``, ``font``, ``letter``, ``read``, ``n``. Counts are made where texts are
    aligned, so no row a letter leaves Python; rows of one pair add up."""
    ship(native.sparkSession)
    kind = native.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own_counts: dict[tuple, Counter] = defaultdict(Counter)
            keys = list(zip(b.column("page_id").to_pylist(), b.column("font").to_pylist()))
            for i, own, read in _aligned(b, fold, places):
                own_counts[keys[i]].update(zip(own, read))
            rows = [(*key, c, got, n) for key, counts in own_counts.items() for (c, got), n in counts.items() if got is not None and c.isalpha()]
            cols = list(zip(*rows)) if rows else [()] * 5
            kinds = [b.schema.field("page_id").type, pa.string(), pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["page_id", "font", "letter", "read", "n"])

    return _testified(_covered(native, ocr).mapInArrow(run, f"page_id {kind}, font string, letter string, read string, n long"), native, ocr)


def _letters(pairs: DataFrame) -> DataFrame:
    """Each letter of a font of a page: ``occurrences``, the commonest other letter as ``top``, and whether it is
    ``contradicted``. ``pairs`` come from ``letter_pairs`` or ``letter_counts``."""
    counts = pairs.groupBy("page_id", "font", "letter", "read").agg((F.sum("n") if "n" in pairs.columns else F.count("*")).alias("n"))
    other = F.lower("read") != F.lower("letter")
    totals = counts.groupBy("page_id", "font", "letter").agg(F.sum("n").alias("occurrences"), F.min_by(F.when(other, F.struct("read", "n")), F.when(other, F.struct(-F.col("n"), F.col("read")))).alias("top"))
    return totals.withColumn("contradicted", F.coalesce((F.col("top.n") >= K.GLYPH_SUBSTITUTIONS) & (F.col("top.n") / F.col("occurrences") >= K.GLYPH_RATE), F.lit(False)))


def glyph_mismatches(pairs: DataFrame) -> DataFrame:
    """Contradicted letters of each font of a page (AGG9, WIN4): the commonest other letter, if it
    is read twice or more and in half of the cases."""
    return _letters(pairs).where("contradicted").select("page_id", "font", "letter", F.col("top.read").alias("read"), F.col("top.n").alias("substitutions"), "occurrences")


def font_audit(pairs: DataFrame) -> DataFrame:
    """Fonts with contradicted letters: share, letters compared, and whether to withhold the text; the pairs are read once."""
    bad = F.struct("letter", F.col("top.read").alias("read"), F.col("top.n").alias("substitutions"), "occurrences")
    df = _letters(pairs).groupBy("page_id", "font").agg(F.sum(F.when(F.col("contradicted"), F.col("top.n"))).alias("substitutions"), F.array_sort(F.collect_list(F.when(F.col("contradicted"), bad))).alias("letters"), F.sum("occurrences").alias("letter_count"))
    df = df.where("substitutions is not null").withColumn("share", F.col("substitutions") / F.col("letter_count"))
    return df.withColumn("withhold", (F.col("share") >= K.WITHHOLD_SHARE) & (F.col("letter_count") >= K.WITHHOLD_LETTERS)).drop("substitutions")


def contradicted_observations(pairs: DataFrame) -> DataFrame:
    """Observations that hold a contradicted letter: ``page_id``, ``id``."""
    return pairs.join(glyph_mismatches(pairs).select("page_id", "font", "letter"), ["page_id", "font", "letter"], "left_semi").select("page_id", "id").distinct()


def latest_samples(df: DataFrame, keys: list[str], order: list[str], most: int = 5000, chunks: int = 64) -> DataFrame:
    """The newest rows of a key (WIN10).

    First the newest of each of ``chunks`` slices of a key, then of what is left, so a key that
    holds a great part of all rows is no single task: the second step sees ``most`` rows a slice.
    """
    newest = lambda *by: F.row_number().over(Window.partitionBy(*keys, *by).orderBy(*[F.desc(c) for c in order]))
    cut = df.withColumn("_slice", F.pmod(F.xxhash64(*order), F.lit(chunks))).withColumn("_n", newest("_slice")).where(F.col("_n") <= most)
    return cut.withColumn("_n", newest()).where(F.col("_n") <= most).drop("_n", "_slice")
