"""Benchmark decontamination by template canonicalisation, with DataFrame functions only.

Texts become sequences of template words: lower case, without punctuation, and with typed
placeholders for numbers, the units after them and names (words that begin with a capital and
a small letter, at the start of a sentence too). A window is a run of ``WORDS`` *literal* words
(those that stand for themselves) with the placeholders between them, so it is as long as it
takes and never says nothing. Windows are hashed and joined with those of the benchmark;
matches of a document with an item on one diagonal (the document's position less the item's)
are one aligned passage. A passage counts if it is long enough and its slots are consistent:
what the item's slot values became in the document must be a one-to-one renaming, so a
re-parameterised question is caught and two texts that merely share a frame are not.

Each item is read twice, with names and as if it had no capitals, so copies in small or
capital letters count. An item with under ``LEAST_LITERAL`` literal words (a list of numbers, a
title) has no template to speak of: its windows are of raw words, so a verbatim copy counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import materialize

#: Literal words of a window; share of an item's windows, or windows, that make a passage a leak.
WORDS, SHARE, RUN = 5, 0.5, 9
#: Literal words from which an item is matched by template; letters and digits that an item of one or two words must have.
LEAST_LITERAL, LEAST_SIGNS = 3, 12
#: Benchmark windows up to which they are broadcast (24 bytes each and the slots: below 100 MB).
BROADCAST_WINDOWS = 500_000
#: Units, as they stand after a number.
UNITS = "mm cm dm m km mi ft in yd g kg mg t lb oz l ml cl s sec min h hr hrs hour hours minute minutes second seconds day days week weeks month months year years percent dollar dollars euro euros usd eur cent cents meter meters metre metres mile miles inch inches foot feet gram grams kilogram kilograms liter liters litre litres degree degrees mph kmh watt watts volt volts".split()
#: Marks that a template word does not hold.
MARKS = ".,;:!?\"()[]{}<>*_~`|&$%€£“”„«»…–—"
#: Characters of scripts written without spaces; each is a word.
UNSPACED = r"[฀-໿က-႟ក-៿぀-ヿ㐀-鿿豈-﫿]"
#: What begins a placeholder, and a name in the marked text.
_MARK = "\u0001"
_SPACES = r"[\x20\x09-\x0D]+"


def canonical(df: DataFrame, text: Column) -> DataFrame:
    """Adds ``_m`` (words without punctuation, names marked) and ``_c`` (template words), position by position.

    A null text has no words.
    """
    text = F.coalesce(text, F.lit(""))
    spaced = F.when(text.rlike(UNSPACED), F.regexp_replace(text, f"({UNSPACED})", " $1 ")).otherwise(text)
    marked = F.regexp_replace(spaced, r"(^|[^\p{L}\p{N}])(?=\p{Lu}\p{Ll})", f"$1{_MARK}")
    words = F.array_remove(F.split(F.translate(F.lower(marked), MARKS, ""), _SPACES), "")
    units = ", ".join(f"'{u}'" for u in UNITS)
    # a text without digits has neither numbers nor units, so the tests for them are made once a text
    word = f"""CASE WHEN _digits THEN transform(_m, (w, i) -> CASE
            WHEN contains(w, '{_MARK}') THEN '{_MARK}n'
            WHEN w rlike '[0-9]' AND w rlike '^[+-]?[0-9]+[/-]?[0-9]*[a-z]{{0,2}}$' THEN '{_MARK}#'
            WHEN i > 0 AND w IN ({units}) AND _m[i - 1] rlike '[0-9]' THEN '{_MARK}u'
            ELSE w END)
        ELSE transform(_m, w -> CASE WHEN contains(w, '{_MARK}') THEN '{_MARK}n' ELSE w END) END"""
    return df.withColumns({"_m": words, "_digits": text.rlike("[0-9]")}).withColumn("_c", F.expr(word)).drop("_digits")


def _template_windows(k: int) -> Column:
    """``struct(pos, hash)`` of each run of ``k`` literal words, from ``_c`` and the literal positions ``_p``."""
    return F.expr(f"CASE WHEN size(_p) >= {k} THEN transform(sequence(0, size(_p) - {k}), j -> struct(_p[j] AS pos, xxhash64(slice(_c, _p[j] + 1, _p[j + {k - 1}] - _p[j] + 1)) AS hash)) END")


def _raw_windows(k: int) -> Column:
    """The same of each run of ``k`` words of ``_m`` as they are, whatever their kind."""
    return F.expr(f"CASE WHEN size(_m) >= {k} THEN transform(sequence(0, size(_m) - {k}), j -> struct(j AS pos, xxhash64(transform(slice(_m, j + 1, {k}), w -> replace(w, '{_MARK}', ''))) AS hash)) END")


def _literals() -> Column:
    return F.expr(f"CASE WHEN size(_c) > 0 THEN filter(sequence(0, size(_c) - 1), i -> NOT startswith(_c[i], '{_MARK}')) ELSE cast(array() AS array<int>) END")


def _slots(start: str, stop: str) -> Column:
    """Offsets and words of the placeholders between two positions of an item."""
    return F.expr(f"filter(transform(sequence(0, {stop} - {start}), o -> struct(o AS off, startswith(_c[{start} + o], '{_MARK}') AS slot, _m[{start} + o] AS item)), x -> x.slot)")


def item_windows(benchmark: DataFrame, words: int = WORDS) -> DataFrame:
    """A row per window of every item: ``k`` and ``raw`` (what kind of window), ``hash``, ``item_id``,
    ``reading``, ``ipos``, ``of`` (windows of this reading) and ``islots``.

    Items without a word, and items of one or two words with under twelve letters and digits,
    which stand in texts by chance, have none. ``benchmark``: item_id and _t.
    """
    readings = benchmark.select("item_id", F.explode(F.array(F.struct(F.lit(1).alias("reading"), F.col("_t").alias("t")), F.struct(F.lit(0).alias("reading"), F.lower("_t").alias("t")))).alias("r")).select("item_id", "r.reading", "r.t")
    # written, since a filter on a column made here would be evaluated below it, word by word
    items = materialize(canonical(readings, F.col("t")).withColumn("_p", _literals()), "items").withColumns({"_n": F.size("_m"), "_l": F.size("_p")})
    signs = F.length(F.regexp_replace(F.coalesce("t", F.lit("")), r"[^\p{L}\p{N}]", ""))
    items = items.where((F.col("_n") >= 3) | ((F.col("_n") > 0) & (signs >= LEAST_SIGNS)))
    weak = F.col("_l") < LEAST_LITERAL
    raw = items.where(weak & (F.col("reading") == 1)).withColumns({"raw": F.lit(True), "k": F.least("_n", F.lit(words))})
    own = items.where(~weak).withColumns({"raw": F.lit(False), "k": F.least("_l", F.lit(words))})
    out = None
    for k in range(1, words + 1):
        parts = [raw.where(F.col("k") == k).withColumn("_w", _raw_windows(k))]
        if k >= LEAST_LITERAL:
            parts.append(own.where(F.col("k") == k).withColumn("_w", _template_windows(k)))
        for p in parts:
            out = p if out is None else out.unionByName(p)
    flat = out.withColumn("of", F.size("_w")).select("item_id", "reading", "raw", "k", "of", "_m", "_c", "_p", F.posexplode("_w").alias("_j", "_x"))
    stop = F.when(F.col("raw"), F.col("_x.pos") + F.col("k") - 1).otherwise(F.get("_p", F.col("_j") + F.col("k") - 1))
    flat = flat.withColumns({"ipos": F.col("_x.pos"), "hash": F.col("_x.hash"), "_stop": stop})
    return flat.select("raw", "k", "hash", "item_id", "reading", "ipos", "of", _slots("ipos", "_stop").alias("islots"))


def leaks(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", words: int = WORDS, share: float = SHARE, run: int = RUN) -> DataFrame:
    """Pairs of a document and a benchmark item that it holds.

    Which items have windows says ``item_windows``. Null texts hold nothing; of repeated rows
    each pair is given once; rows without an id are reported under a null id; other columns
    are ignored, whatever their names; an empty table on either side gives none.

    Returns the id column, ``item_id``, ``n_windows`` (matched on the best diagonal),
    ``coverage`` of the item's windows, ``n_slots`` and ``renamed`` (a slot value differs).
    """
    keys = materialize(item_windows(benchmark.select(benchmark[item_col].alias("item_id"), benchmark[item_text_col].alias("_t")), words), "windows")
    sizes = {(r["raw"], r["k"]): r["n"] for r in keys.groupBy("raw", "k").agg(F.count("*").alias("n")).collect()}
    texts = canonical(docs.select(docs[id_col].alias("id"), docs[text_col].alias("_t")), F.col("_t")).drop("_t").withColumn("_p", _literals())
    found = None
    for (raw, k), n in sorted(sizes.items()):  # one kind, unless there are items of few words
        own = keys.where((F.col("raw") == raw) & (F.col("k") == k)).drop("raw", "k")
        own = F.broadcast(own) if n <= BROADCAST_WINDOWS else own
        # a column before they are exploded, so that only what the join keeps is copied; the outer form,
        # since the other infers a filter on the windows that would be evaluated below them
        flat = texts.withColumn("_w", _raw_windows(k) if raw else _template_windows(k)).select("id", "_m", F.explode_outer("_w").alias("_x"))
        slots = F.expr("transform(islots, s -> struct(ipos + s.off AS at, s.item AS item, _m[pos + s.off] AS doc))")
        hits = flat.select("id", "_m", "_x.pos", "_x.hash").join(own, "hash").select("id", "item_id", "reading", "of", "ipos", "pos", slots.alias("slots"))
        found = hits if found is None else found.unionByName(hits)
    if found is None:
        return texts.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("item_id"), F.lit(0).cast("long").alias("n_windows"), F.lit(0.0).alias("coverage"), F.lit(0).alias("n_slots"), F.lit(False).alias("renamed")).where("false")
    passages = found.groupBy("id", "item_id", "reading", "of", (F.col("pos") - F.col("ipos")).alias("diagonal")).agg(F.count_distinct("ipos").alias("n_windows"), F.array_distinct(F.flatten(F.collect_set("slots"))).alias("slots"))
    edge = lambda c: F.regexp_replace(c, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")
    pairs = F.array_distinct(F.transform("slots", lambda x: F.struct(edge(x["item"]).alias("item"), edge(x["doc"]).alias("doc"))))
    passages = passages.withColumn("pairs", pairs).withColumn("coverage", F.col("n_windows") / F.col("of"))
    one_to_one = (F.size("pairs") == F.size(F.array_distinct("pairs.item"))) & (F.size("pairs") == F.size(F.array_distinct("pairs.doc")))
    same = F.size(F.filter("pairs", lambda p: p["item"] != p["doc"])) == 0
    good = passages.where(((F.col("coverage") >= share) | (F.col("n_windows") >= run)) & (same | one_to_one))
    best = good.groupBy("id", "item_id").agg(F.max(F.struct("n_windows", "coverage", F.size("slots").alias("n_slots"), (~same).alias("renamed"))).alias("b"))
    return best.select(F.col("id").alias(id_col), "item_id", "b.n_windows", F.round("b.coverage", 6).alias("coverage"), "b.n_slots", "b.renamed")


def drop_leaking(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", **options) -> DataFrame:
    """The documents that hold no benchmark item, with their columns.

    Null and empty texts hold none and stay; rows without an id can't be named and stay;
    repeated rows stay or go together; an empty table on either side drops nothing.
    """
    found = leaks(docs, benchmark, id_col=id_col, **options)
    return docs.join(found.select(id_col).distinct(), id_col, "left_anti").select(*docs.columns)


def op4_decontaminate(spark, sf_dir: str) -> DataFrame:
    """Documents of ``documents`` that hold items of ``benchmark``."""
    from folioscope.llm.common import table

    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
