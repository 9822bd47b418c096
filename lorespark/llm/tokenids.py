"""Token-id output: frequency-ranked ids in byte-aligned variable-length coding with separate control bytes.

Tokens are renumbered by falling corpus frequency (ties: the lower token id first), so that the commonest take one byte.
Four ids share a control byte of four two-bit lengths; control and data bytes are stored apart. Decoding looks control
bytes up in numpy tables of lengths and sums and gathers all ids of a text at once.

The corpus is tokenised once: packed token ids go to the shared folder and are counted and coded from there. Counts
cover every document; what the driver collects is bounded by the vocabulary.

Cases: null and empty texts give no ids, an empty control and empty data. Texts of any length are one row. Repeated rows
and null ids are coded row by row. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorespark.llm.bpe import VOCABULARY, _shipped
from lorespark.llm.common import cut, id_text, keeps

_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3).astype(np.uint8) + np.uint8(1)  # control byte -> four lengths


def pack(ids: np.ndarray) -> tuple[bytes, bytes]:
    """(control, data) of unsigned 32-bit ids, least significant byte first."""
    n = len(ids)
    if not n:
        return b"", b""
    v = ids.astype("<u4")
    size = 1 + (v > 0xFF) + (v > 0xFFFF) + (v > 0xFFFFFF)
    codes = np.zeros(-(-n // 4) * 4, np.uint8)
    codes[:n] = size - 1
    quad = codes.reshape(-1, 4)
    control = quad[:, 0] | quad[:, 1] << 2 | quad[:, 2] << 4 | quad[:, 3] << 6
    raw = v.view(np.uint8).reshape(-1, 4)
    return control.tobytes(), raw[np.arange(4) < size[:, None]].tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The ids again, by table lookup."""
    if not n:
        return np.zeros(0, np.uint32)
    size = _LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    at = np.cumsum(size, dtype=np.int64) - size
    d = np.concatenate([np.frombuffer(data, np.uint8), np.zeros(3, np.uint8)])
    out = d[at].astype(np.uint32)
    for k in (1, 2, 3):
        more = np.flatnonzero(size > k)
        if not len(more):
            break
        out[more] |= d[at[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


_ENCODERS: dict = keeps({})


def _tokenizer(ranks: dict[bytes, int], key: str):
    if key not in _ENCODERS:
        import tiktoken

        _ENCODERS[key] = tiktoken.Encoding(key, pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[key]


def tokenise(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens, packed): token ids as 16- or 32-bit integers, whichever hold the vocabulary."""
    ranks, key = _shipped(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _tokenizer(ranks.value, key)
        kind = _kind(max(ranks.value.values(), default=0))
        for big in batches:
            for at in range(0, big.num_rows, 1024):
                b = big.slice(at, 1024)
                ids = [enc.encode_to_numpy(t, disallowed_special=()).astype(kind) if t else np.zeros(0, kind) for t in b.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) for x in ids], pa.int32()), pa.array([x.tobytes() for x in ids], pa.binary())], names=["doc_id", "n_tokens", "packed"])

    return docs.mapInArrow(run, "doc_id long, n_tokens int, packed binary")


def _kind(largest: int) -> str:
    return "<u2" if largest < 1 << 16 else "<u4"


def frequencies(tokens: DataFrame, size: int) -> DataFrame:
    """(token, n) over all documents: counted per partition, then added up."""
    kind = _kind(size - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for b in batches:
            for x in b.column(0):
                total += np.bincount(np.frombuffer(x.as_buffer(), kind), minlength=size) if x.is_valid else 0
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some])], names=["token", "n"])

    return tokens.select("packed").mapInArrow(run, "token int, n long").groupBy("token").agg(F.sum("n").alias("n"))


def ranking(counts: list[tuple[int, int]], size: int) -> np.ndarray:
    """token -> id: tokens by falling count, then by token; tokens that never occur follow in order."""
    n = np.zeros(size, np.int64)
    for t, k in counts:
        n[t] = k
    order = np.lexsort((np.arange(size), -n))
    ids = np.empty(size, np.uint32)
    ids[order] = np.arange(size, dtype=np.uint32)
    return ids


def encode(docs: DataFrame, path: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, np.ndarray]:
    """((doc_id, n_tokens, control, data, exact), token -> id). ``exact``: decoding gives the token ids again."""
    from lorespark.llm.bpe import load_ranks

    size = max(load_ranks(path).values(), default=0) + 1
    tokens = cut(tokenise(id_text(docs, id_col, text_col), path), "tokens")
    ids = ranking([(r["token"], r["n"]) for r in frequencies(tokens, size).collect()], size)
    table = tokens.sparkSession.sparkContext.broadcast(ids)
    kind = _kind(size - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = table.value
        back = np.empty_like(rank)
        back[rank] = np.arange(len(rank), dtype=rank.dtype)
        for big in batches:
            for at in range(0, big.num_rows, 1024):
                b = big.slice(at, 1024)
                control, data, exact = [], [], []
                for x in b.column(2):
                    t = np.frombuffer(x.as_buffer(), kind) if x.is_valid else np.zeros(0, kind)
                    c, d = pack(rank[t])
                    control.append(c), data.append(d), exact.append(bool((back[unpack(c, d, len(t))] == t).all()))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(control, pa.binary()), pa.array(data, pa.binary()), pa.array(exact)], names=["doc_id", "n_tokens", "control", "data", "exact"])

    return tokens.mapInArrow(run, "doc_id long, n_tokens int, control binary, data binary, exact boolean"), ids
