"""URL filters: explicit rules first, a character language-model ratio for the rest.

Two smoothed variable-order Markov models over the bytes of a URL, one for accepted and one
for rejected URLs, give a log-likelihood each; their difference by byte, calibrated on
held-out rows, decides. A model interpolates orders 0 to ``order``: each context backs off
to its suffix by the number of different bytes seen after it (Witten and Bell).

The models are tables: byte strings of all different labelled URLs are counted, their chances
follow order by order in joins, and a block of URLs is handed the part of the table that it
holds. No model is gathered on the driver or in one task. The cut is set on all labelled URLs,
each judged by models without its own fold. ``RatioFilter`` is the same idea in one process,
for a sample that the caller asks for.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from math import exp, log

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.llm.common import materialize, ship

#: The rules (action, host, path prefix).
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: Seed words of either class, for hosts that no rule names.
ACCEPTED_WORDS = "archive blog docs encyclopedia forum gazette government journal library museum news research review school science society university wiki".split()
REJECTED_WORDS = "ads banner bets bonus buy casino cheap click clicks deals farm free loan lottery pills poker porn promo replica spam track tracker viagra win".split()
#: A seed word counts as so many URLs; labelled URLs are dealt into so many folds.
SEED_WEIGHT, FOLDS = 8, 4
#: Count columns of a class: one for each fold, one for the seed words.
SLOTS = FOLDS + 1
#: Bytes of URLs that are cut up at once, and of a block.
PIECE = 1 << 19
#: Only for a sample that the caller asks for: of a longer URL a stretch of so many characters.
STRETCH = 2048


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), upper, upper.lower()), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def longest_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits a host (or a domain above it) and a path, and its action; null if none."""
    name, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for act, h, p in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r[1], r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, action = F.when(fits, h + p).otherwise(name), F.when(fits, act).otherwise(action)
    return name, action


class MarkovModel:
    """Byte model of variable order; what it has not seen falls back to shorter contexts, last to 1/256."""

    def __init__(self, texts: list[bytes], order: int = 4):
        self.order = order
        self.seen: dict[bytes, dict[int, int]] = {}
        for t in texts:
            t = b"\x02" + t + b"\x03"
            for i in range(1, len(t)):
                for k in range(min(order, i) + 1):
                    own = self.seen.setdefault(t[i - k : i], {})
                    own[t[i]] = own.get(t[i], 0) + 1
        self._ready()

    def _ready(self) -> None:
        self.total = {h: sum(own.values()) for h, own in self.seen.items()}
        self.chance = lru_cache(1 << 17)(self._chance)

    def __getstate__(self):
        return self.order, self.seen

    def __setstate__(self, state):
        self.order, self.seen = state
        self._ready()

    def _chance(self, h: bytes, c: int) -> float:
        while h and h not in self.seen:
            h = h[1:]
        own = self.seen.get(h)
        if own is None:
            return 1 / 256
        below = self.chance(h[1:], c) if h else 1 / 256
        return (own.get(c, 0) + len(own) * below) / (self.total[h] + len(own))

    def log_likelihood(self, text: bytes) -> float:
        t, k = b"\x02" + text + b"\x03", self.order
        return sum(log(self.chance(t[max(0, i - k) : i], t[i])) for i in range(1, len(t)))


def _newton(sums: Callable[[float, float], list[tuple[float, ...]]]) -> tuple[float, float]:
    """Logistic regression of the label on the difference, by Newton steps; classes weigh the same.

    ``sums(a, b)`` gives for either class the number of rows and, with ``p`` the chance at ``a + b x``,
    ``e`` its error and ``q = p (1 - p)``, the sums of ``e``, ``e x``, ``q``, ``q x``, ``q x x``.
    Returns the cut and the slope.
    """
    a, b = 0.0, 1.0
    for _ in range(50):
        classes = sums(a, b)
        if not all(c[0] for c in classes):
            return 0.0, 1.0
        g0, g1, h00, h01, h11 = (sum(0.5 * c[i] / c[0] for c in classes) for i in range(1, 6))
        g0, g1, h00, h11 = g0 + 1e-3 * a, g1 + 1e-3 * b, h00 + 1e-3, h11 + 1e-3
        det = h00 * h11 - h01 * h01
        da, db = (h11 * g0 - h01 * g1) / det, (h00 * g1 - h01 * g0) / det
        a, b = a - da, b - db
        if abs(da) + abs(db) < 1e-9:
            break
    return (-a / b, b) if b > 1e-6 else (0.0, 1.0)


class RatioFilter:
    """Both models with a threshold and a slope fitted on held-out rows."""

    def __init__(self, accepted: list[str], rejected: list[str], order: int = 4):
        texts = {1: [u.encode() for u in accepted], 0: [u.encode() for u in rejected]}
        train = {y: [u for i, u in enumerate(x) if i % 4 != 3] for y, x in texts.items()}
        self.good = MarkovModel(train[1] + [w.encode() for w in ACCEPTED_WORDS for _ in range(SEED_WEIGHT)], order)
        self.bad = MarkovModel(train[0] + [w.encode() for w in REJECTED_WORDS for _ in range(SEED_WEIGHT)], order)
        held = [(self.difference(u), y) for y, x in texts.items() for u in x[3::4]]
        self.cut, self.slope = self._calibrate(held)

    def difference(self, url: bytes) -> float:
        """Log-likelihood difference by byte."""
        return (self.good.log_likelihood(url) - self.bad.log_likelihood(url)) / (len(url) + 1)

    @staticmethod
    def _calibrate(held: list[tuple[float, int]]) -> tuple[float, float]:
        """Cut and slope from differences with their labels."""

        def sums(a: float, b: float) -> list[tuple[float, ...]]:
            out = []
            for label in (0, 1):
                rows = [(x, 1 / (1 + exp(-max(-30.0, min(30.0, a + b * x)))) - label) for x, y in held if y == label]
                spread = [(x, abs(e) * (1 - abs(e))) for x, e in rows]
                out.append((len(rows), sum(e for _, e in rows), sum(e * x for x, e in rows), sum(q for _, q in spread), sum(q * x for x, q in spread), sum(q * x * x for x, q in spread)))
            return out

        return _newton(sums)

    def score(self, url: str | None) -> float:
        """Calibrated probability that a URL is acceptable; 0.5 is the cut."""
        x = self.difference((url or "").encode()) - self.cut
        return 1 / (1 + exp(-max(-30.0, min(30.0, self.slope * x))))


def _sample(ruled: DataFrame, sample: int) -> dict[str, list[str]]:
    """Up to ``sample`` different URLs of each class, those with the smallest hashes.

    One count of each class sets how small a hash must be to matter (twice what is needed),
    so the distinct rows that meet in a shuffle are few, however often a URL is repeated.
    """
    own = ruled.where("action is not null").select("action", "url", F.shiftrightunsigned(F.xxhash64("url"), 3).alias("h"))
    sizes = {r["action"]: r["n"] for r in own.groupBy("action").agg(F.approx_count_distinct("h", 0.02).alias("n")).collect()}
    out: dict[str, list[str]] = {}
    for action in ("allow", "block"):
        below = min(1.0, 2 * sample / max(1, sizes.get(action, 0)))
        few = own.where((F.col("action") == action) & (F.col("h") <= F.lit(int(below * (1 << 61))))).select("url", "h").distinct()
        start = F.pmod("h", F.greatest(F.length("url") - STRETCH, F.lit(0)) + 1) + 1
        out[action] = [r.url for r in few.orderBy("h", "url").limit(sample).select(F.substring("url", start, F.lit(STRETCH)).alias("url")).collect()]
    return out


def _cuts(urls: pa.Array, order: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Every byte of the URLs and their ends with up to ``order`` bytes before it, as a number (their count above their
    bytes), and the row; in pieces of ``PIECE`` bytes at most. Pieces end with a URL or at multiples of ``PIECE`` within it,
    so sums over a URL do not depend on its neighbours."""
    begin, end, nothing = (pa.scalar(c, pa.large_binary()) for c in (b"\x02", b"\x03", b""))
    texts = pc.binary_join_element_wise(begin, pc.fill_null(urls.cast(pa.large_binary()), nothing), end, nothing)
    if not len(texts):
        return
    ends, data = np.frombuffer(texts.buffers()[1], np.int64)[: len(texts) + 1], np.frombuffer(texts.buffers()[2], np.uint8)
    first, last = 0, 0
    while last < ends[-1]:
        first, last = last, int(ends[np.searchsorted(ends, last + PIECE, "right") - 1])
        last = last if last > first else first + PIECE
        at = np.arange(first, last)
        rows = np.searchsorted(ends, at, "right") - 1
        place = at - ends[rows]
        at, rows, place = at[place > 0], rows[place > 0], place[place > 0]
        keys = (np.minimum(place, order) + 1) << 8 * (order + 1)
        for k in range(order + 1):
            keys |= np.where(place >= k, data[np.maximum(at - k, 0)], 0).astype(np.int64) << 8 * k
        yield keys, rows


def _counts(labelled: DataFrame, order: int) -> DataFrame:
    """How often each byte string stands in the URLs of a class: ``a0`` to ``a3`` (accepted) and ``b0`` to ``b3``
    (rejected) without a fold, ``a4`` and ``b4`` in all. Strings of unlabelled URLs alone have zeros.

    ``labelled`` holds different URLs as ``url``, ``slot`` (of the count column) and ``weight``.
    """
    raw = [f"n{i}" for i in range(2 * SLOTS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slot, weight = batch.column("slot").to_numpy().astype(np.int64), batch.column("weight").to_numpy()
            for keys, rows in _cuts(batch.column("url"), order):
                own, at = np.unique(keys, return_inverse=True)
                n = np.bincount(at * len(raw) + slot[rows], weight[rows], len(own) * len(raw)).astype(np.int64).reshape(-1, len(raw))
                yield pa.RecordBatch.from_arrays([pa.array(own), *(pa.array(np.ascontiguousarray(c)) for c in n.T)], ["g", *raw])

    found = labelled.mapInArrow(run, "g long, " + ", ".join(f"{c} long" for c in raw)).groupBy("g").agg(*(F.sum(c).alias(c) for c in raw))
    models = []
    for name, own in (("a", raw[:SLOTS]), ("b", raw[SLOTS:])):
        every = sum((F.col(c) for c in own[1:]), F.col(own[0]))
        models += [(every - F.col(c)).alias(f"{name}{i}") for i, c in enumerate(own[:FOLDS])] + [every.alias(f"{name}{FOLDS}")]
    return found.select("g", *models)


def _ratios(counts: DataFrame, order: int) -> DataFrame:
    """Log ratio of both classes' chances of each byte string's last byte after the others: ``d0`` to ``d3`` of the
    models without a fold, ``d4`` of the models of all.

    All ends of the strings are counted, and beside each how often its context stands in all and with how many
    different bytes after it; a string then meets its ends from the shortest on. Only the ends of one and two bytes
    are broadcast (65,536 rows at most).
    """
    names = [c for c in counts.columns if c != "g"]
    counts = materialize(counts, "counts").withColumn("longest", (F.shiftright("g", 8 * (order + 1)) - 1).cast("int"))
    end = F.col("g").bitwiseAND(F.expr("shiftleft(1L, 8 * (k + 1)) - 1"))
    ends = counts.withColumn("k", F.explode(F.sequence(F.lit(0), "longest"))).groupBy("k", end.alias("end")).agg(*(F.sum(c).alias(c) for c in names))
    context = Window.partitionBy("k", F.shiftright("end", 8))
    ends = ends.select("k", "end", *names, *(F.sum(c).over(context).alias(f"all_{c}") for c in names), *(F.sum((F.col(c) > 0).cast("long")).over(context).alias(f"kinds_{c}") for c in names))
    ends = materialize(ends, "ends")
    out = counts.select("g", "longest", *(F.lit(1 / 256).alias(f"low_{c}") for c in names))
    for k in range(order + 1):
        own = ends.where(F.col("k") == k).drop("k")
        fits = (F.col("g").bitwiseAND(F.lit((1 << 8 * (k + 1)) - 1)) == F.col("end")) & (F.col("longest") >= k)
        out = out.join(F.broadcast(own) if k < 2 else own, fits, "left").select(
            "g", "longest", *(F.expr(f"if(all_{c} > 0, ({c} + kinds_{c} * low_{c}) / (all_{c} + kinds_{c}), low_{c})").alias(f"low_{c}") for c in names)
        )
    return materialize(out.select("g", *((F.ln(f"low_a{m}") - F.ln(f"low_b{m}")).alias(f"d{m}") for m in range(SLOTS))), "ratios")


def _differences(urls: DataFrame, ratios: DataFrame, order: int) -> DataFrame:
    """The rows with their log-likelihood difference by byte: ``x`` by the models of all, ``held`` by those without ``fold``.

    Rows go in blocks; a block's byte strings are joined with the table once each, so a string
    that stands in every URL is one row a block and no key is large.
    """

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 40
        for b in batches:
            if b.num_rows:
                size = np.cumsum(pc.fill_null(pc.binary_length(b.column("url")), 0).to_numpy().astype(np.int64))
                own = block + size // PIECE
                block = int(own[-1]) + 1
                yield pa.RecordBatch.from_arrays([pa.array(own), *b.columns], ["block", *b.schema.names])

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            blocks = b.column("block").to_numpy()
            edges = np.flatnonzero(np.diff(blocks, prepend=-1, append=-1))
            for lo, hi in zip(edges, edges[1:]):
                for keys, _ in _cuts(b.column("url").slice(lo, hi - lo), order):
                    own = np.unique(keys)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), blocks[lo])), pa.array(own)], ["block", "g"])

    def judged(rows: pa.Table, table: pa.Table) -> pa.Table:
        g = table.column("g").to_numpy()
        by = np.argsort(g, kind="stable")
        g, d = g[by], np.stack([table.column(f"d{m}").to_numpy()[by] for m in range(SLOTS)])
        urls, fold = rows.column("url").combine_chunks(), rows.column("fold").to_numpy()
        x, held = np.zeros(len(fold)), np.zeros(len(fold))
        for keys, row in _cuts(urls, order):
            at = np.searchsorted(g, keys)
            x += np.bincount(row, d[FOLDS, at], len(fold))
            held += np.bincount(row, d[fold[row], at], len(fold))
        size = pc.fill_null(pc.binary_length(urls), 0).to_numpy(zero_copy_only=False) + 1
        return rows.drop_columns(["block"]).append_column("x", pa.array(x / size)).append_column("held", pa.array(held / size))

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in urls.schema)
    rows = materialize(urls.mapInArrow(dealt, f"block long, {schema}"), "blocks")
    table = rows.select("block", "url").mapInArrow(strings, "block long, g long").distinct().join(ratios, "g")
    return rows.groupBy("block").cogroup(table.groupBy("block")).applyInArrow(judged, f"{schema}, x double, held double")


def _cut(labelled: DataFrame) -> tuple[float, float]:
    """Cut and slope from all rows' ``x`` and ``y``. Sums are of decimals, so they do not depend on the rows' order."""

    found = [f"{total} filter (where y = {y})" for y in (0, 1) for total in ("count(*)", *(f"sum(cast({v} as decimal(18, 12)))" for v in ("e", "e * x", "q", "q * x", "q * x * x")))]

    def sums(a: float, b: float) -> list[tuple[float, ...]]:
        rows = labelled.selectExpr("x", "y", f"1 / (1 + exp(-greatest(-30D, least(30D, {a!r}D + {b!r}D * x)))) as p")
        row = [float(v or 0) for v in rows.selectExpr("x", "y", "p - y as e", "p * (1 - p) as q").selectExpr(*found).first()]
        return [tuple(row[:6]), tuple(row[6:])]

    return _newton(sums)


def judge_urls(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", rules=RULES, sample: int | None = None, order: int = 4) -> DataFrame:
    """Verdict on every URL.

    The models learn from all different URLs that a rule decides, whole, and from the seed
    words; the cut is set on the same URLs, each judged without its fold. ``order`` is 0 to 6.
    Only with ``sample`` do the models of one process (of any order) learn from at most so many
    URLs of a class, those with the smallest hashes, of very long ones a stretch. A null URL or one
    without ``://`` has an empty host and path and is judged by the models (null: as empty).
    Repeated rows are judged alike; other columns are ignored; an empty table gives none.

    Returns the id column, ``host``, ``path``, ``rule``, ``verdict``, ``score``.
    """
    ship(pages.sparkSession)
    kind = pages.schema[id_col].dataType.simpleString()
    urls = pages.select(pages[id_col].alias("id"), pages[url_col].alias("url"))
    scored = _scored(urls, rules, order) if sample is None else _scored_by_sample(urls, rules, sample, order, kind)
    verdict = F.coalesce("action", F.when(F.col("score") >= 0.5, "allow").otherwise("block"))
    return scored.select(F.col("id").alias(id_col), "host", "path", "rule", verdict.alias("verdict"), "score")


def _ruled(urls: DataFrame, rules) -> DataFrame:
    parts = urls.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    rule, action = longest_rule(F.col("host"), F.col("path"), rules)
    return parts.withColumns({"rule": rule, "action": action})


def _scored(urls: DataFrame, rules, order: int) -> DataFrame:
    """Rules and scores by the models of all labelled URLs."""
    if not 0 <= order <= 6:
        raise ValueError("order is 0 to 6: a byte string and its length are one long")
    spark, urls = urls.sparkSession, urls.withColumn("url", F.coalesce("url", F.lit("")))
    fold = F.pmod(F.xxhash64("url"), F.lit(FOLDS)).cast("int")
    different = _ruled(urls.select("url").distinct(), rules)
    labelled = different.select("url", F.when(F.col("action") == "block", fold + SLOTS).otherwise(fold).alias("slot"), F.col("action").isNotNull().cast("int").alias("weight"))
    seeds = [(w, FOLDS + SLOTS * y, SEED_WEIGHT) for y, words in enumerate((ACCEPTED_WORDS, REJECTED_WORDS)) for w in words]
    ratios = _ratios(_counts(labelled.unionAll(spark.createDataFrame(seeds, "url string, slot int, weight int")), order), order)
    judged = _ruled(materialize(_differences(urls.withColumn("fold", fold), ratios, order), "differences"), rules)
    once = judged.where("action is not null").groupBy("url").agg(F.max(F.col("action") == "allow").cast("int").alias("y"), F.max("held").alias("x"))
    cut, slope = _cut(materialize(once.select("y", "x"), "held"))
    return judged.withColumn("score", 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), slope * (F.col("x") - cut))))))


def _scored_by_sample(urls: DataFrame, rules, sample: int, order: int, kind: str) -> DataFrame:
    """Rules and scores by a filter that learns from a sample in one process, broadcast once."""
    ruled = _ruled(urls, rules)
    learnt = _sample(ruled, sample)
    shared = urls.sparkSession.sparkContext.broadcast(RatioFilter(learnt["allow"], learnt["block"], order))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            scores = pa.array([model.score(u) for u in b.column("url").to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([*b.columns, scores], [*b.schema.names, "score"])

    return ruled.mapInArrow(run, f"id {kind}, url string, host string, path string, rule string, action string, score double")


def op7_urls(spark, sf_dir: str) -> DataFrame:
    """Verdict on every URL of ``pages``."""
    from folioscope.llm.common import table

    return judge_urls(table(spark, sf_dir, "pages"))
