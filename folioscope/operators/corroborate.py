"""Corroboration by consumption: each reading of a pool vouches for one claim at most.

The order of the claims decides, so this is a fold per page, run in input order.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope import constants as K
from folioscope.cluster import ship
from folioscope.functions import text as T
from folioscope.functions.numbers import rate
from folioscope.operators.pages import fold_pages


class Pool:
    """Critical tokens and normalised text of the readings of a page."""

    def __init__(self, tokens: list[dict], blob: str):
        self.left: dict[str, dict[str | None, int]] = {}
        for t in tokens:
            own = self.left.setdefault(t["core"], {})
            own[t["tail"]] = own.get(t["tail"], 0) + 1
        self.blob, self.seen = blob, {}

    def _take(self, token: dict) -> tuple[str, str | None] | None:
        """An equal tail first, else the first compatible one."""
        own = self.left.get(token["core"], {})
        fits = [t for t, n in own.items() if n > 0 and (token["tail"] is None or t is None or t == token["tail"])]
        if not fits:
            return None
        tail = token["tail"] if token["tail"] in fits else fits[0]
        own[tail] -= 1
        return token["core"], tail

    def vouches(self, tokens: list[dict], text: str) -> bool:
        """All of a claim's tokens or none; without tokens, an occurrence of its text of two
        characters or more that no claim has used up."""
        if tokens:
            used = []
            for t in tokens:
                got = self._take(t)
                if got is None:
                    for core, tail in used:
                        self.left[core][tail] += 1
                    return False
                used.append(got)
            return True
        if len(text) < 2:
            return False
        n = self.seen.get(text)
        if n is None:
            n = self.blob.count(text)
        self.seen[text] = max(0, n - 1)
        return n > 0


def _prepared(df: DataFrame, side: int, fold: bool) -> DataFrame:
    return df.select("page_id", F.lit(side).alias("side"), "ord", "id", T.critical_tokens(F.col("text"), fold=fold).alias("tokens"), T.evidence_text(F.col("text"), fold=fold).alias("normal"))


def _vouched(claims: DataFrame, pools: dict[str, DataFrame], fold: bool) -> DataFrame:
    """``page_id``, ``id`` and, for each of ``pools``, whether its readings vouch for the claim: one walk over a
    page serves all pools. Tokens come out of Arrow as flat lists, not as a dictionary each."""
    ship(claims.sparkSession)
    n = len(pools)
    both = reduce(DataFrame.unionByName, [_prepared(r, i, fold).withColumn("id", F.lit(None).cast("string")) for i, r in enumerate(pools.values())] + [_prepared(claims, n, fold)])
    both = both.select("page_id", "side", "ord", F.col("id").cast("string").alias("id"), F.col("tokens.core").alias("cores"), F.col("tokens.tail").alias("tails"), F.when((F.size("tokens") == 0) | (F.col("side") < n), F.col("normal")).alias("normal"))
    ordered = both.repartition(F.xxhash64("page_id")).sortWithinPartitions("page_id", "side", "ord")
    kind = claims.schema["page_id"].dataType.simpleString()
    names = ["page_id", "id", *pools]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, begun, held, ready = None, False, [([], []) for _ in range(n)], None
        for b in batches:
            pages, sides, ids, normals = (b.column(i).to_pylist() for i in (0, 1, 3, 6))
            cores, tails, ends = b.column(4).flatten().to_pylist(), b.column(5).flatten().to_pylist(), b.column(4).value_lengths().fill_null(0).to_pylist()
            out, at = [[] for _ in names], 0
            for page, side, own, normal, m in zip(pages, sides, ids, normals, ends):
                tokens = [{"core": c, "tail": t} for c, t in zip(cores[at : at + m], tails[at : at + m])]
                at += m
                if page != now or not begun:
                    now, begun, held, ready = page, True, [([], []) for _ in range(n)], None
                if side < n:
                    held[side][0].extend(tokens)
                    held[side][1].append(normal)
                    continue
                if ready is None:
                    ready = [Pool(t, " ".join(x for x in texts if x)) if texts else None for t, texts in held]
                for col, v in zip(out, (page, own, *[p is not None and p.vouches(tokens, normal or "") for p in ready])):
                    col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], b.schema.field(0).type), pa.array(out[1], pa.string()), *[pa.array(c, pa.bool_()) for c in out[2:]]], names)

    return ordered.mapInArrow(run, f"page_id {kind}, id string, " + ", ".join(f"{c} boolean" for c in pools))


def corroborated(claims: DataFrame, readings: DataFrame, *, fold: bool = True) -> DataFrame:
    """Claims with ``corroborated`` (JOIN4). Both tables have page_id, ord, id and text; a page
    without readings corroborates nothing."""
    return _vouched(claims, {"corroborated": readings}, fold)


def engaged_by_second_reading(ocr: DataFrame, second: DataFrame, *, floor: float = K.LOW_CONFIDENCE, fold: bool = True) -> DataFrame:
    """First-pass readings that an engine of another family also read (JOIN5). Readings of the
    second engine under the confidence floor are no witnesses; those without a confidence are."""
    witnesses = second.where(F.col("confidence").isNull() | (F.col("confidence") >= floor))
    return corroborated(ocr.where("recovery_method is null"), witnesses, fold=fold).where("corroborated").select("page_id", "id")


def proposal_status(proposals: DataFrame, native: DataFrame, ocr: DataFrame, *, fold: bool = True) -> DataFrame:
    """Which witnesses hold each proposal: both, native, ocr or novel (JOIN6); here all
    readings count, recoveries too."""
    status = F.when(F.col("in_native") & F.col("in_ocr"), "both").when(F.col("in_native"), "native").when(F.col("in_ocr"), "ocr").otherwise("novel")
    return _vouched(proposals, {"in_native": native, "in_ocr": ocr}, fold).withColumn("status", status)


def paired_classes(truth: DataFrame, a: DataFrame, b: DataFrame, *, fold: bool = True) -> DataFrame:
    """For each true token: found by both, by A only, by B only or by neither (JOIN15)."""
    name = F.when(F.col("in_a") & F.col("in_b"), "both").when(F.col("in_a"), "a_only").when(F.col("in_b"), "b_only").otherwise("neither")
    return _vouched(truth, {"in_a": a, "in_b": b}, fold).withColumn("class", name)


def _plain(core: str) -> tuple[str, str]:
    """A token's core without its currency signs, and the signs."""
    signs = "".join(c for c in core if unicodedata.category(c) == "Sc")
    return "".join(c for c in core if c not in signs), signs


def _tails_fit(a: dict, b: dict) -> bool:
    return a["tail"] is None or b["tail"] is None or a["tail"] == b["tail"]


def _consume(left: list[dict], t: dict, tolerant: bool) -> bool:
    """Use up one of ``left`` for a token: an equal one, else the first that fits.

    ``tolerant`` forgives a currency sign that one side lacks, never another sign; a token
    that is equal but for the sign goes before one that has another tail.
    """

    def ways():
        yield lambda x: x["core"] == t["core"] and x["tail"] == t["tail"]
        if not tolerant:
            yield lambda x: x["core"] == t["core"] and _tails_fit(x, t)
            return
        bare, signs = _plain(t["core"])
        alike = lambda x: _plain(x["core"])[0] == bare and (not signs or not _plain(x["core"])[1] or _plain(x["core"])[1] == signs)
        yield lambda x: alike(x) and x["tail"] == t["tail"]
        yield lambda x: alike(x) and _tails_fit(x, t)

    for fits in ways():
        k = next((k for k, x in enumerate(left) if fits(x)), None)
        if k is not None:
            left.pop(k)
            return True
    return False


def consume_matches(gold: DataFrame, found: DataFrame, *, tolerant: bool = False, fold: bool = True) -> DataFrame:
    """How many of a gold text's tokens are found, each found token used once (JOIN16); ``tolerant``
    forgives a detached currency sign, never a contradicting one."""

    def run(rows: list[dict]) -> list[tuple]:
        left = [t for r in rows if r["side"] == 0 for t in r["tokens"]]
        return [(r["page_id"], r["id"], len(r["tokens"]), sum(_consume(left, t, tolerant) for t in r["tokens"])) for r in rows if r["side"]]

    both = _prepared(found, 0, fold).unionByName(_prepared(gold, 1, fold))
    kind = gold.schema["page_id"].dataType.simpleString()
    return fold_pages(both, ["page_id"], ["side", "ord"], run, f"page_id {kind}, id string, tokens int, matched int")


def gold_recall(gold: DataFrame, native: DataFrame, ocr: DataFrame, *, fold: bool = True) -> DataFrame:
    """Recall counters of each page and label tier (AGG16): strict first, then with detached currency
    forgiven over what the strict pass left. ``gold`` has ``tier`` (human, silver or bulk, scored in
    this order)."""
    names = ["tokens", "strict_native", "strict_ocr", "strict_union", "native", "ocr", "union"]

    def run(rows: list[dict]) -> list[tuple]:
        pools = [[t for r in rows if r["side"] == side for t in r["tokens"]] for side in (0, 1)]
        out = []
        for tier in dict.fromkeys(r["tier"] for r in sorted((r for r in rows if r["side"] == 2), key=lambda r: _TIERS.index(r["tier"]))):
            tokens = [t for r in rows if r["side"] == 2 and r["tier"] == tier for t in r["tokens"]]
            strict = [[_consume(pool, t, False) for pool in pools] for t in tokens]
            loose = [[hit or _consume(pool, t, True) for hit, pool in zip(hits, pools)] for hits, t in zip(strict, tokens)]
            count = lambda hits: [sum(h[0] for h in hits), sum(h[1] for h in hits), sum(any(h) for h in hits)]
            out.append((rows[0]["page_id"], tier, len(tokens), *count(strict), *count(loose)))
        return out

    parts = [_prepared(df, side, fold).withColumn("tier", F.lit(None).cast("string")) for side, df in ((0, native), (1, ocr))]
    own = _prepared(gold, 2, fold).join(gold.select("page_id", "id", "tier"), ["page_id", "id"])
    kind = gold.schema["page_id"].dataType.simpleString()
    return fold_pages(parts[0].unionByName(parts[1]).unionByName(own), ["page_id"], ["side", "ord"], run, f"page_id {kind}, tier string, " + ", ".join(f"{n} int" for n in names))


#: Label tiers, in the order in which they are scored.
_TIERS = ["human", "silver", "bulk"]


def located_corroboration(proposals: DataFrame, native: DataFrame, *, fold: bool = True) -> DataFrame:
    """Proposals whose every token an embedded one under their own box vouches for (JOIN17).

    Each embedded token vouches once; a proposal that is not complete gives back what it took;
    one without a token is not corroborated. Both have a box.
    """
    box = ["x0", "y0", "x1", "y1"]

    def run(rows: list[dict]) -> list[tuple]:
        left = [(t, r) for r in rows if r["side"] == 0 for t in r["tokens"]]
        out = []
        for r in (r for r in rows if r["side"]):
            taken = []
            for t in r["tokens"]:
                near = lambda b: min(b["x1"], r["x1"]) > max(b["x0"], r["x0"]) and min(b["y1"], r["y1"]) > max(b["y0"], r["y0"])  # noqa: B023, E731
                k = next((k for k, (x, b) in enumerate(left) if x["core"] == t["core"] and _tails_fit(x, t) and near(b)), None)
                if k is None:
                    break
                taken.append(left.pop(k))
            whole = bool(r["tokens"]) and len(taken) == len(r["tokens"])
            if not whole:
                left += taken
            out.append((r["page_id"], r["id"], whole))
        return out

    prepared = lambda df, side: df.select("page_id", F.lit(side).alias("side"), "ord", "id", T.critical_tokens(F.col("text"), fold=fold).alias("tokens"), *box)
    kind = proposals.schema["page_id"].dataType.simpleString()
    return fold_pages(prepared(native, 0).unionByName(prepared(proposals, 1)), ["page_id"], ["side", "ord"], run, f"page_id {kind}, id string, corroborated boolean")


def pool_recall(gold: DataFrame, readings: DataFrame, *, fold: bool = True) -> DataFrame:
    """Gold tokens of each page that the readings hold, each used once (AGG22): ``page_id``, ``tokens``, ``found``.
    Called with and without enrichment it gives both recalls."""
    got = corroborated(gold, readings, fold=fold)
    return got.groupBy("page_id").agg(F.count("*").alias("tokens"), F.count_if("corroborated").alias("found"))


def cross_family_bounds(ocr: DataFrame, second: DataFrame, gold: DataFrame, starved: DataFrame, *, floor: float = K.LOW_CONFIDENCE, fold: bool = True) -> DataFrame:
    """Precision bounds of what two engine families agree on (AGG23), one row.

    Over starved pages (``page_id``) with gold: first-pass readings that the second engine
    vouches for give agreed tokens, each of which a gold token may confirm once. The lower
    bound takes the rest as shared errors, the upper one as right. Agreement on a text without
    tokens is counted, not scored.
    """

    def run(rows: list[dict]) -> list[tuple]:
        side = lambda n: [r for r in rows if r["side"] == n]
        if not side(0) or not side(1):
            return []
        pools = [Pool([t for r in side(n) for t in r["tokens"]], " ".join(r["normal"] for r in side(n) if r["normal"])) for n in (0, 1)]
        agreed = observations = plain = confirmed = 0
        for r in side(2):
            if not pools[0].vouches(r["tokens"], r["normal"]):
                continue
            plain += not r["tokens"]
            observations += bool(r["tokens"])
            agreed += len(r["tokens"])
            confirmed += sum(pools[1].vouches([t], "") for t in r["tokens"])
        return [(rows[0]["page_id"], observations, agreed, confirmed, plain)] if agreed or plain else []

    witnesses = second.where(F.col("confidence").isNull() | (F.col("confidence") >= floor))
    both = _prepared(witnesses, 0, fold).unionByName(_prepared(gold, 1, fold)).unionByName(_prepared(ocr.where("recovery_method is null"), 2, fold)).join(starved.select("page_id").distinct(), "page_id", "left_semi")
    kind = ocr.schema["page_id"].dataType.simpleString()
    pages = fold_pages(both, ["page_id"], ["side", "ord"], run, f"page_id {kind}, observations int, agreed int, confirmed int, plain int")
    total = pages.agg(F.count("*").alias("pages"), *[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("observations", "agreed", "confirmed", "plain")])
    return total.withColumns({"lower_bound": rate(F.col("confirmed"), F.col("agreed"), 4), "upper_bound": rate(F.col("agreed"), F.col("agreed"), 4)})


def greedy_pairs(pairs: DataFrame, score: Column) -> DataFrame:
    """Pair left and right rows of a page from the best score down, each used once (JOIN18,
    JOIN31); ties go to the smaller left, then right. ``pairs`` has page_id, left, right."""

    def run(rows: list[dict]) -> list[tuple]:
        used_l, used_r, out = set(), set(), []
        for r in rows:
            if r["left"] not in used_l and r["right"] not in used_r:
                used_l.add(r["left"]), used_r.add(r["right"])
                out.append((r["page_id"], r["left"], r["right"], r["score"]))
        return out

    kinds = {n: pairs.schema[n].dataType.simpleString() for n in ("page_id", "left", "right")}
    df = pairs.select("page_id", "left", "right", score.cast("double").alias("score")).withColumn("down", -F.col("score"))
    return fold_pages(df, ["page_id"], ["down", "left", "right"], run, ", ".join(f"{n} {k}" for n, k in kinds.items()) + ", score double")
