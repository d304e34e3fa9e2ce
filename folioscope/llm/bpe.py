"""Byte-level BPE encoding and decoding by monoid tree reduction.

A text is cut in halves down to short leaves; leaves are encoded alone and joined upwards.
Two joins are needed, and each re-encodes a window around the cut that grows until the
tokens outside provably cannot change:

* between matches of the split pattern: a place where white space follows a character that
  is none is a match boundary in every context (no alternative of the pattern holds a
  non-space followed by a space, and what a match before it looks at ends there). The
  window grows from the cut to the nearest such place on either side.
* inside one long match: a token sequence is the BPE encoding of its bytes exactly if every
  two neighbours are the encoding of their own joined bytes. (The first merge across a
  token border would see only the two tokens beside it, in the state that they have when
  they are merged alone.) The window doubles until both of its edges pass that test.

Decoding concatenates the bytes of halves up the same kind of tree.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from folioscope.llm.common import ship

#: Characters of a leaf of the text tree, bytes of a leaf inside one match.
LEAF_CHARS, LEAF_BYTES = 8192, 256
_SPACE = " \n\t\r"


def parse_ranks(blob: bytes) -> dict[bytes, int]:
    """Ranks of a vocabulary file: a base64 token and its rank on each line."""
    return {base64.b64decode(tok): int(rank) for tok, rank in (line.split() for line in blob.splitlines() if line)}


class TreeCodec:
    """Encoder and decoder for one vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, leaf_chars: int = LEAF_CHARS, leaf_bytes: int = LEAF_BYTES):
        import regex
        import tiktoken

        self.leaf_chars, self.leaf_bytes = max(1, leaf_chars), max(1, leaf_bytes)
        self.base = tiktoken.Encoding("tree", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        # the library's \s is the Unicode property, which holds fewer characters than Python's
        self.split = regex.compile(pattern.replace("\\s", "\\p{White_Space}").replace("\\S", "\\P{White_Space}"))
        self.spaces = regex.compile(rf"\s{{{max(1, self.leaf_bytes // 4)},}}")
        self.token = {rank: tok for tok, rank in ranks.items()}
        self.pair_fits = lru_cache(1 << 16)(self._pair_fits)

    # -- encoding ------------------------------------------------------------------------

    def encode(self, text: str) -> list[int]:
        return self._encode(text, 0, len(text))

    def _encode(self, text: str, lo: int, hi: int) -> list[int]:
        if hi - lo <= self.leaf_chars:
            return self._flat(text[lo:hi])
        mid = (lo + hi) // 2
        return self._join(text, lo, mid, hi, self._encode(text, lo, mid), self._encode(text, mid, hi))

    def _join(self, text: str, lo: int, mid: int, hi: int, left: list[int], right: list[int]) -> list[int]:
        p, q = self._edge_before(text, lo, mid), self._edge_after(text, mid, hi)
        drop, size, want = 0, 0, len(text[p:mid].encode())
        while size < want:
            drop += 1
            size += len(self.token[left[-drop]])
        skip, size, more = 0, 0, len(text[mid:q].encode())
        while size < more:
            size += len(self.token[right[skip]])
            skip += 1
        return left[: len(left) - drop] + self._flat(text[p:q]) + right[skip:]

    @staticmethod
    def _edge_before(text: str, lo: int, mid: int) -> int:
        """The last certain match boundary at or before mid; lo if there is none."""
        for p in range(mid if mid < len(text) else mid - 1, lo, -1):
            if text[p] in _SPACE and not text[p - 1].isspace():
                return p
        return lo

    @staticmethod
    def _edge_after(text: str, mid: int, hi: int) -> int:
        """The first certain match boundary after mid; hi if there is none."""
        for q in range(mid + 1, hi):
            if text[q] in _SPACE and not text[q - 1].isspace():
                return q
        return hi

    def _flat(self, text: str) -> list[int]:
        n = self.leaf_bytes // 4  # no match that is shorter has more bytes than a leaf
        if max(map(len, text.split()), default=0) < n and not self.spaces.search(text):
            return self.base.encode_ordinary(text)
        out: list[int] = []
        for m in self.split.finditer(text):  # long matches have trees of their own
            out += self.encode_match(m.group().encode())
        return out

    def encode_match(self, piece: bytes) -> list[int]:
        """The tokens of one match, which merges never leave."""
        if len(piece) <= self.leaf_bytes:
            return self.base._encode_single_piece(piece)
        half = len(piece) // 2
        left, right, k = self.encode_match(piece[:half]), self.encode_match(piece[half:]), 4
        while True:
            l, r = left[max(0, len(left) - k) :], right[:k]
            window = self.base._encode_single_piece(b"".join(self.token[t] for t in (*l, *r)))
            rest_l, rest_r = left[: len(left) - len(l)], right[len(r) :]
            if (not rest_l or self.pair_fits(rest_l[-1], window[0])) and (not rest_r or self.pair_fits(window[-1], rest_r[0])):
                return rest_l + window + rest_r
            k *= 2

    def _pair_fits(self, a: int, b: int) -> bool:
        return self.base._encode_single_piece(self.token[a] + self.token[b]) == [a, b]

    # -- decoding ------------------------------------------------------------------------

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= 4096:
            return b"".join([self.token[i] for i in ids])
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


_CODECS: dict[tuple[bytes, str], TreeCodec] = {}


def _codec(blob: bytes, pattern: str) -> TreeCodec:
    key = (hashlib.sha256(blob).digest(), pattern)
    if key not in _CODECS:
        _CODECS[key] = TreeCodec(parse_ranks(blob), pattern)
    return _CODECS[key]


def encode_documents(docs: DataFrame, vocabulary: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """Token ids of every text and the bytes that they decode to.

    A map without any shuffle: texts are independent, so no key can be hot. A null text
    counts as empty; an empty text has no tokens; repeated rows give repeated rows; columns
    besides the two named are ignored. The vocabulary file is read once on the driver and
    travels with the task (below 1 MB).

    Returns the id column, ``n_tokens``, ``ids_sha256``, ``decoded_sha256`` and, with
    ``keep_ids``, ``ids``.
    """
    ship(docs.sparkSession)
    with open(vocabulary, "rb") as f:
        blob = f.read()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(blob, pattern)
        for batch in batches:
            for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                counts, sums, decoded, ids_out = [], [], [], []
                for text in part.column(1).to_pylist():
                    ids = codec.encode(text or "")
                    counts.append(len(ids))
                    sums.append(hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
                    decoded.append(hashlib.sha256(codec.decode(ids)).hexdigest())
                    if keep_ids:
                        ids_out.append(ids)
                cols = [part.column(0), pa.array(counts, pa.int64()), pa.array(sums, pa.string()), pa.array(decoded, pa.string())]
                names = ["id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if keep_ids:
                    cols.append(pa.array(ids_out, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names)

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids
    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def op9_byte_bpe(spark, sf_dir: str) -> DataFrame:
    """Encode every whole text of ``documents`` and decode it again."""
    import public_tokenizers

    from folioscope.llm.common import table

    return encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, keep_ids=False)
