"""Language identification by averaged hashed subword embeddings and a linear softmax.

A text becomes bytes of lower-case letters and spaces; its subwords are all byte 3-grams and
4-grams that lie in one word (a space may begin or end one), hashed into a table of
embeddings. Their mean goes through a linear softmax. Both are trained by stochastic
gradient descent in numpy on a bounded sample of labelled rows; a subword that the sample
lacks says nothing. A temperature and a rejection threshold are calibrated on held-out pieces
of that sample, short and long ones: one in a thousand of those that are recognised rightly
may be rejected. How many pieces with shuffled letters the threshold catches is kept as well.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import ship

#: Hash buckets of each subword length, embedding width.
BUCKETS, WIDTH = 1 << 15, 12
#: Labelled rows per language that are learnt from, rows of all languages together, characters of each.
PER_LANGUAGE, SAMPLE_ROWS, SAMPLE_CHARS = 700, 200_000, 2000
#: Share of recognised pieces that calibration may reject, and the bytes of the pieces it looks at.
FALSE_REJECTION, PIECES = 0.001, (24, 80, 240)
NONE = "und"
_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def subwords(raw: np.ndarray) -> np.ndarray:
    """Bucket of the 3-gram and of the 4-gram that begin at each byte; 2 * BUCKETS where there is none."""
    t = _FOLD[raw].astype(np.uint32)
    n = len(t)
    out = np.full((2, n), 2 * BUCKETS, np.uint32)
    space = t == 32
    if n >= 3:
        h = (t[:-2] * 961 + t[1:-1] * 31 + t[2:]) * np.uint32(2654435761) >> np.uint32(17)
        out[0, : n - 2] = np.where(space[1:-1], 2 * BUCKETS, h)
    if n >= 4:
        h = (t[:-3] * 29791 + t[1:-2] * 961 + t[2:-1] * 31 + t[3:]) * np.uint32(2246822519) >> np.uint32(17)
        out[1, : n - 3] = np.where(space[1:-2] | space[2:-1], 2 * BUCKETS, h + BUCKETS)
    return out


@dataclass
class LanguageModel:
    """``scores``: what a subword adds to the languages' logits; the last row is that of none."""

    languages: list[str]
    scores: np.ndarray
    bias: np.ndarray
    temperature: float
    reject_below: float
    caught: float = 0.0

    def logits(self, texts: list[str], at_once: int = 1 << 20) -> np.ndarray:
        """Logits of whole texts; long ones are taken in overlapping pieces, so memory is bounded."""
        sums = np.zeros((len(texts), len(self.languages) + 1))
        held, owners, cut, size = [], [], [], 0

        def flush() -> None:
            starts = np.cumsum([0, *map(len, held)])[:-1]
            raw = np.frombuffer(b"".join(held), np.uint8)
            grams = subwords(raw)
            # no gram runs into the next text, and what begins in a piece's last three bytes is the next piece's
            ends = starts + np.array([len(x) for x in held])
            for k in (1, 2, 3):
                grams[1, np.maximum(ends - k, starts)] = 2 * BUCKETS
                three = ends - k if k < 3 else (ends - k)[np.array(cut)]
                grams[0, np.maximum(three, starts if k < 3 else 0)] = 2 * BUCKETS
            for row in grams:
                part = np.add.reduceat(self.scores[row], starts, axis=0)
                np.add.at(sums, np.array(owners), part)

        for i, text in enumerate(texts):
            own = b" " + text.lower().encode() + b" "
            for lo in range(0, max(1, len(own) - 3), at_once):
                piece = own[lo : lo + at_once + 3]
                held.append(piece), owners.append(i), cut.append(lo + at_once + 3 < len(own))
                size += len(piece)
                if size >= at_once:
                    flush()
                    held, owners, cut, size = [], [], [], 0
        if held:
            flush()
        return sums[:, :-1] / np.maximum(sums[:, -1:], 1) + self.bias

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        """Language, calibrated probability, rejected or not."""
        out = [(NONE, 0.0, True)] * len(texts)
        at = [i for i, t in enumerate(texts) if t and self.languages and has_letter(t)]
        if at:
            p = softmax(self.logits([texts[i] for i in at]) / self.temperature)
            best = p.argmax(1)
            for i, k, x in zip(at, best, p[np.arange(len(at)), best]):
                out[i] = (self.languages[k], float(x), bool(x < self.reject_below))
        return out


def has_letter(text: str) -> bool:
    """A character of the Unicode letter categories (numerals are none)."""
    return any(map(str.isalpha, text))


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def train(texts: list[str], labels: list[str], *, epochs: int = 4, piece: int = 240, batch: int = 32, rate: float = 6.0, seed: int = 11) -> LanguageModel:
    """Fit by stochastic gradient descent on pieces of the texts; every fifth text is held out to calibrate."""
    languages = sorted(set(labels))
    if not languages:
        return LanguageModel([], np.zeros((2 * BUCKETS + 1, 1), np.float32), np.zeros(0), 1.0, 0.0)
    rng = np.random.default_rng(seed)
    rows, held, held_texts = [], [], []
    known = {y: i for i, y in enumerate(languages)}
    for k, (t, y) in enumerate(zip(texts, labels)):
        raw = np.frombuffer(b" " + t.lower().encode() + b" ", np.uint8)
        if k % 5 == 4:
            held_texts.append((t, known[y]))
        for lo in range(0, len(raw), piece):
            g = subwords(raw[lo : lo + piece + 3]).ravel()
            g = g[g < 2 * BUCKETS]
            if len(g):
                (held if k % 5 == 4 else rows).append((g, known[y]))
    rows = rows or held
    c = len(languages)
    e = rng.normal(0, 0.1, (2 * BUCKETS, WIDTH)).astype(np.float32)
    w, b = np.zeros((WIDTH, c), np.float32), np.zeros(c, np.float32)
    epochs = max(epochs, -(-400 * batch // max(1, len(rows))) if len(rows) < 100 * batch else epochs)  # small samples need more passes
    steps, step = epochs * -(-len(rows) // batch), 0
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for lo in range(0, len(rows), batch):
            own = [rows[i] for i in order[lo : lo + batch]]
            idx = np.concatenate([g for g, _ in own])
            n = np.array([len(g) for g, _ in own])
            mean = np.add.reduceat(e[idx], np.cumsum(n) - n, axis=0) / n[:, None]
            p = softmax(mean @ w + b)
            p[np.arange(len(own)), [y for _, y in own]] -= 1
            p /= len(own)
            lr = rate * (1 - step / steps)
            step += 1
            back = (p @ w.T / n[:, None]).astype(np.float32)
            w -= lr * (mean.T @ p).astype(np.float32)
            b -= lr * p.sum(0).astype(np.float32)
            np.add.at(e, idx, np.repeat(-lr * back, n, axis=0))
    scores = np.zeros((2 * BUCKETS + 1, c + 1), np.float32)
    scores[:-1, :c] = e @ w
    heard = np.zeros(2 * BUCKETS, bool)
    for g, _ in rows:
        heard[g] = True
    scores[:-1, :c][~heard] = 0
    scores[:-1, c] = 1
    model = LanguageModel(languages, scores, b.astype(np.float64), 1.0, 0.0)
    if held:
        logits = np.stack([scores[g, :c].mean(0) + b for g, _ in held]).astype(np.float64)
        y = np.array([k for _, k in held])
        loss = {t: -np.log(softmax(logits / t)[np.arange(len(y)), y] + 1e-12).mean() for t in np.geomspace(0.1, 10, 41)}
        model.temperature = float(min(loss, key=loss.get))
    if held_texts and c > 1:
        # ends at a space, so that a piece holds whole words; one of each length from every held-out text
        pieces = [(t.encode()[:n].decode("utf-8", "ignore").rsplit(" ", 1)[0], y) for t, y in held_texts for n in PIECES]
        pieces = [(t, y) for t, y in pieces if has_letter(t)]
        top = lambda own: softmax(model.logits(own) / model.temperature) if own else np.zeros((0, c))
        p = top([t for t, _ in pieces])
        sure = p.max(1)[p.argmax(1) == np.array([y for _, y in pieces], int)]
        model.reject_below = float(np.quantile(sure, FALSE_REJECTION)) if len(sure) else 0.0
        mixed = ["".join(rng.permutation(list(t))) for t, _ in pieces]
        model.caught = float((top(mixed).max(1) < model.reject_below).mean()) if mixed else 0.0
    return model


def fold_of(id_col: Column) -> Column:
    """Remainder of crc32 of the id as text; 2 marks the held-out rows."""
    return F.crc32(id_col.cast("string")) % 4


def fit(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE, sample_rows: int = SAMPLE_ROWS) -> LanguageModel:
    """Learn from labelled rows outside the held-out fold, about ``per_language`` rows of each language
    or, if there are very many languages, an even part of ``sample_rows``.

    The rows are chosen by a hash of id and text, and of each a stretch of 2,000 characters
    from a hashed place is used, so the sample is bounded whatever the table holds. No
    language is left out. Rows without a text or a label teach nothing; a null id is not held
    out; repeated rows count as often as they stand; no labelled row gives a model without
    languages, which rejects everything.
    """
    # a null id has no remainder and is not held out
    usable = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & (F.coalesce(fold_of(F.col(id_col)), F.lit(0)) != 2)).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.col(id_col).alias("id"))
    counts = usable.groupBy("lang").count().collect()
    if not counts:
        return train([], [])
    per_language = min(per_language, max(1, sample_rows // len(counts)))
    share = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], int(min(1.0, per_language / r["count"]) * (1 << 30)))])
    dice = F.xxhash64("id", "text")
    start = F.pmod(dice, F.greatest(F.length("text") - SAMPLE_CHARS, F.lit(0)) + 1) + 1
    chosen = usable.where(F.pmod(F.shiftright(dice, 7), F.lit(1 << 30)) < share[F.col("lang")])
    rows = chosen.select("lang", F.substring("text", start, F.lit(SAMPLE_CHARS)).alias("text"), dice.alias("dice")).limit(2 * per_language * len(counts)).collect()
    rows.sort(key=lambda r: (r.dice, r.lang, r.text))
    return train([r.text for r in rows], [r.lang for r in rows])


def identify(docs: DataFrame, model: LanguageModel, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``lang_pred``, ``score``, ``rejected`` of every whole text: a map without a shuffle.

    Texts that are null or without a letter are ``und``, score 0, rejected.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                got = model.predict(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()), pa.array([g[2] for g in got], pa.bool_())], ["id", "lang_pred", "score", "rejected"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(run, f"id {kind}, lang_pred string, score double, rejected boolean")


def drop_rejected(docs: DataFrame, model: LanguageModel, *, text_col: str = "text") -> DataFrame:
    """The rows whose text's language is recognised, with their columns, in one map over whole rows.

    Null and empty texts and those without a letter go, as do those under the calibrated
    threshold; long texts are read whole; repeated rows stay or go together; ids are not
    looked at; a model without languages drops everything; an empty table gives none.
    """
    ship(docs.sparkSession)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                keep = [not g[2] for g in model.predict(part.column(at).to_pylist())]
                yield part.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op8_language(spark, sf_dir: str) -> DataFrame:
    """Language of every whole text of ``documents``, learnt outside the held-out fold."""
    from folioscope.llm.common import table

    docs = table(spark, sf_dir, "documents")
    found = identify(docs, fit(docs))
    return found.select(F.col("id").alias("doc_id"), F.coalesce(fold_of(F.col("id")) == 2, F.lit(False)).alias("held_out"), "lang_pred", F.round("score", 6).alias("score"), "rejected")
