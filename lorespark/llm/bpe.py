"""BPE encoding and decoding: a priority queue of merge ranks over a doubly linked symbol list.

A text is split into pieces by the vocabulary's pattern. A piece that is no entry itself starts as single bytes, linked
both ways; the queue holds (rank, place) of neighbours whose concatenation is an entry. The lowest rank, leftmost first,
is merged, its new neighbours are queued, and entries whose neighbours have changed meanwhile are skipped as stale.
Decoding concatenates vocabulary strings. Every worker remembers the ids of recent pieces, in bounded memory.

Cases: null and empty texts give no ids and decode to ''. A piece of any length costs n log n. Repeated rows and null
ids are encoded row by row. Extra columns pass through :func:`add_tokens` unless they are named like its results, which
then replace them; :func:`encode` returns only the id and its results. An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import re
import sys
import unicodedata
from collections.abc import Callable, Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorespark.llm.common import forget, keeps

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
REMEMBERED = 500_000  # pieces in each of two generations
LONGEST_REMEMBERED = 48


def load_ranks(path: str = VOCABULARY) -> dict[bytes, int]:
    """Entry -> id; the id is also the merge rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def _ranges(wanted: str, last_char: int) -> str:
    """All characters of a general category (first letter) up to ``last_char``, as ranges of a character class."""
    out, start, last = [], None, None
    for c in range(last_char + 2):
        if c <= last_char and unicodedata.category(chr(c))[0] == wanted:
            start = c if start is None else start
            last = c
        elif start is not None:
            out.append((start, last))
            start = None
    return "".join(f"\\U{a:08x}" if a == b else f"\\U{a:08x}-\\U{b:08x}" for a, b in out)


_SPLITTERS: dict[int, Callable] = {}


def splitter(last_char: int) -> Callable[[str], list[str]]:
    """The byte-level vocabularies' pre-tokenisation for texts of characters up to ``last_char``.

    The standard library has no \\p{L}, so classes are spelled out; those of Latin-1 are a bitmap, several times as fast.
    """
    if last_char not in _SPLITTERS:
        letter, number = _ranges("L", last_char), _ranges("N", last_char)
        space = "\\t-\\r \\x85\\xa0" + ("\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000" if last_char > 255 else "")
        _SPLITTERS[last_char] = re.compile(f"'(?:[sdmt]|ll|ve|re)| ?[{letter}]+| ?[{number}]+| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+").findall
    return _SPLITTERS[last_char]


def split(text: str) -> list[str]:
    if not text.isascii():
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return splitter(sys.maxunicode)(text)
    return splitter(255)(text)


class Bpe(dict):
    """str piece -> its ids as packed integers; missing pieces are merged and remembered."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks, self.before = ranks, {}
        self.type = np.uint16 if max(ranks.values(), default=0) < 1 << 16 else np.uint32
        self.vocab = {i: b for b, i in ranks.items()}
        self.whole = {i: np.array([i], self.type).tobytes() for i in self.vocab}

    def __missing__(self, piece: str) -> bytes:
        ids = self.before.get(piece)
        if ids is None:
            raw = piece.encode("utf-8", "surrogatepass")
            one = self.ranks.get(raw)
            ids = self.whole[one] if one is not None else np.array(self.merge(raw), self.type).tobytes()
        if len(piece) <= LONGEST_REMEMBERED:
            if len(self) >= REMEMBERED:
                self.before = dict(self)
                self.clear()
            self[piece] = ids
        return ids

    def merge(self, raw: bytes) -> list[int]:
        """Ids of one piece. A queue entry is one integer: rank, then place, then where the merged symbol would end."""
        n, rank = len(raw), self.ranks.get
        bits = n.bit_length()
        end = list(range(1, n + 2))  # the symbol at i covers raw[i:end[i]] and is followed by the one at end[i]; 0: merged away
        prev = list(range(-1, n))
        end[n] = 0
        low, queue = (1 << bits) - 1, []
        for i in range(n - 1):
            r = rank(raw[i : i + 2])
            if r is not None:
                queue.append(((r << bits | i) << bits) | (i + 2))
        heapify(queue)
        while queue:
            key = heappop(queue)
            stop, i = key & low, key >> bits & low
            j = end[i]
            if not j or end[j] != stop:
                continue  # stale: merged away, or one of the two has grown since
            end[j] = 0
            end[i] = stop
            p = prev[i]
            if p >= 0:
                r = rank(raw[p:stop])
                if r is not None:
                    heappush(queue, ((r << bits | p) << bits) | stop)
            if stop < n:
                prev[stop] = i
                after = end[stop]
                r = rank(raw[i:after])
                if r is not None:
                    heappush(queue, ((r << bits | i) << bits) | after)
        out, i, ranks = [], 0, self.ranks
        while i < n:
            out.append(ranks[raw[i : end[i]]])
            i = end[i]
        return out

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.__getitem__, split(text))), self.type)

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.vocab.__getitem__, ids.tolist()))

    def decode(self, ids: np.ndarray) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")


_READY: dict[str, Bpe] = keeps({})


def coder(ranks: dict[bytes, int], key: str) -> Bpe:
    """One encoder per worker process, kept between tasks."""
    forget(_READY)
    if key not in _READY:
        _READY[key] = Bpe(ranks)
    return _READY[key]


def _shipped(docs: DataFrame, path: str):
    """The vocabulary, read on the driver and broadcast: its size is that of the file, whatever the data."""
    ranks = load_ranks(path)
    key = hashlib.sha256(repr(sorted(ranks.items())).encode()).hexdigest()
    return docs.sparkSession.sparkContext.broadcast(ranks), key


def add_tokens(docs: DataFrame, path: str = VOCABULARY, text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """``docs`` with token_ids (array<int>), n_tokens and round_trip (whether decoding gives the text again).

    Without ``keep_text`` the text goes to Python once and does not come back.
    """
    ranks, key = _shipped(docs, path)
    results = ("token_ids", "n_tokens", "round_trip")
    names = [c for c in docs.columns if c not in results and (keep_text or c != text_col)]
    source = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(ranks.value, key)
        for big in batches:
            for at in range(0, big.num_rows, 1024):
                b = big.slice(at, 1024)
                row, texts = b.column(0), b.column(1).to_pylist()
                ids, sizes, same = [], np.zeros(len(texts) + 1, np.int32), []
                for k, t in enumerate(texts):
                    x = bpe.encode(t)
                    ids.append(x)
                    sizes[k + 1] = len(x)
                    same.append(bpe.decode_bytes(x) == t.encode("utf-8", "surrogatepass"))
                flat = np.concatenate(ids).astype(np.int32) if ids else np.zeros(0, np.int32)
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum(sizes, dtype=np.int32)), pa.array(flat))
                yield pa.RecordBatch.from_arrays([row, lists, pa.array(sizes[1:]), pa.array(same)], names=["row", *results])

    from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StructType

    out = StructType().add("row", source.schema["row"].dataType).add("token_ids", ArrayType(IntegerType())).add("n_tokens", IntegerType()).add("round_trip", BooleanType())
    done = source.mapInArrow(run, out)
    return done.select(*[F.col("row")[c].alias(c) for c in names], *results)


def encode(docs: DataFrame, path: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, token_ids, n_tokens, round_trip): only the id and the text are read."""
    return add_tokens(docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")), path, keep_text=False)


def decode(tokens: DataFrame, path: str = VOCABULARY, ids_col: str = "token_ids", out_col: str = "text") -> DataFrame:
    """``tokens`` with the text of their ids in ``out_col``; null ids give ''."""
    ranks, key = _shipped(tokens, path)

    @F.pandas_udf("string")
    def text_of(ids):  # noqa: ANN001, ANN202
        bpe = coder(ranks.value, key)
        return ids.map(lambda x: "" if x is None else bpe.decode(np.asarray(x)))

    return tokens.withColumn(out_col, text_of(F.col(f"`{ids_col}`")))
