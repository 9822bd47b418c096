"""What the operators of this subpackage share: shared-storage cuts and byte-level vectorised text hashing.

A *word* here is a run of ASCII letters, ASCII digits and non-ASCII characters; ASCII letters are case-folded. The
definition is closed over UTF-8 bytes, so that numpy finds and hashes all words of a batch without a loop over words.
"""

from __future__ import annotations

import ctypes
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespark.functions.cuts import delete, shared_folder, spread, track

U64 = np.uint64
CHUNK_BYTES = 1 << 18  # what numpy works on at a time: it stays in the cache of a core

_CUTS: dict[str, list[tuple[str, str]]] = {}


# ----- shared storage
def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: see :func:`lorespark.functions.cuts.shared_folder`."""
    return shared_folder(spark)


_SCOPE = [""]


def cut(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: lineage ends there and lost executors lose nothing."""
    spark = df.sparkSession
    path = track(spark, f"{shared_dir(spark)}/cut-{name}-{uuid.uuid4().hex}")
    df.write.option("compression", "zstd").parquet(path)
    _CUTS.setdefault(spark.sparkContext.applicationId, []).append((_SCOPE[0], path))
    return spark.read.schema(df.schema).parquet(path)


def drop_cut(df: DataFrame) -> None:
    """Deletes the table behind a frame that :func:`cut` returned, once nothing reads it any more."""
    spark = df.sparkSession
    mine = _CUTS.get(spark.sparkContext.applicationId, [])
    files = df.inputFiles()
    for scope, path in [x for x in mine if any(x[1].rsplit("/", 1)[1] in f for f in files)]:
        delete(spark, path)
        mine.remove((scope, path))


def enter_scope(spark: SparkSession, scope: str) -> None:
    """Later cuts belong to ``scope``."""
    _SCOPE[0] = scope


def leave_scopes(spark: SparkSession, prefix: str) -> None:
    """Deletes the cuts of all scopes that begin with ``prefix``; their readers must have been written out."""
    app = spark.sparkContext.applicationId
    for scope, path in [x for x in _CUTS.get(app, []) if x[0].startswith(prefix)]:
        delete(spark, path)
        _CUTS[app].remove((scope, path))


#: What worker processes keep between tasks, by operator; a worker that turns to another operator lets it go.
KEPT: list[dict] = []
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def keeps(cache: dict) -> dict:
    KEPT.append(cache)
    return cache


def forget(*but: dict) -> None:
    """For the start of a task: lets go what other operators keep, and gives the allocators' free memory back to the machine."""
    for cache in KEPT:
        if not any(cache is b for b in but):
            cache.clear()
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def partitions_for(spark: SparkSession, nbytes: int) -> int:
    """Partitions for a shuffle that follows ``nbytes`` of text: as many as the session asks for, one for 32 MB at least."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-nbytes // (32 << 20)))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return spread(df) if table in ("documents", "pages") else df


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only ``doc_id`` and ``text`` (null text as empty), so that no extra column can clash with internal names."""
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))


# ----- byte tables
_FOLD = np.zeros(256, np.uint8)
for _b in range(256):
    _c = chr(_b)
    if _b >= 128 or (_b < 128 and _c.isalnum()):
        _FOLD[_b] = ord(_c.lower()) if _b < 128 else _b
BASE = U64(0x9E3779B97F4A7C15)  # odd: it has an inverse modulo 2**64
BASE_INV = U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POW: dict[str, np.ndarray] = {}


def powers(n: int, which: str = "base") -> np.ndarray:
    """B**0 .. B**n (or of the inverse) modulo 2**64."""
    have = _POW.get(which)
    if have is None or len(have) <= n:
        size = max(n + 1, CHUNK_BYTES + 1)
        out = np.full(size, BASE if which == "base" else BASE_INV, U64)
        out[0] = 1
        have = _POW[which] = np.multiply.accumulate(out)
    return have


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(UTF-8 bytes, offsets) of a string column, without a copy."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("" if not pa.types.is_binary(col.type) else b"")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    off = np.frombuffer(col.buffers()[1], np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = col.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data, off


class Words:
    """All words of some consecutive documents: ``start``/``end`` (bytes in the chunk), ``hash``, ``first`` (word index at which each document begins, one more at the end)."""

    __slots__ = ("data", "start", "end", "hash", "first", "doc_from", "doc_to", "byte_off")


def word_chunks(col: pa.Array, most: int = CHUNK_BYTES) -> Iterator[Words]:
    """Words of a string column, in chunks of about ``most`` bytes; one longer document is a chunk of its own."""
    data, off = buffers(col)
    n, i = len(off) - 1, 0
    while i < n:
        j = int(np.searchsorted(off, off[i] + most, "right")) - 1
        j = min(n, max(i + 1, j))
        yield _words(data[off[i] : off[j]], off[i : j + 1] - off[i], i, j)
        i = j


def _words(raw: np.ndarray, off: np.ndarray, i: int, j: int) -> Words:
    w = Words()
    w.data, w.doc_from, w.doc_to, w.byte_off = raw, i, j, off
    if not len(raw):
        w.start = w.end = np.zeros(0, np.int64)
        w.hash, w.first = np.zeros(0, U64), np.zeros(j - i + 1, np.int64)
        return w
    c = _FOLD[raw]
    is_word = c > 0
    before = np.empty_like(is_word)
    before[0], before[1:] = False, is_word[:-1]
    before[off[:-1][off[:-1] < len(raw)]] = False
    after = np.empty_like(is_word)
    after[-1], after[:-1] = False, is_word[1:]
    ends = off[1:] - 1
    after[ends[ends >= 0]] = False
    w.start = np.flatnonzero(is_word & ~before)
    w.end = np.flatnonzero(is_word & ~after) + 1
    sums = np.zeros(len(raw) + 1, U64)
    np.cumsum(c * powers(len(raw))[: len(raw)], dtype=U64, out=sums[1:])
    w.hash = mix((sums[w.end] - sums[w.start]) * powers(len(raw), "inverse")[w.start])
    w.first = np.searchsorted(w.start, off)
    return w


def grams(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word n-grams and their document (index in the chunk). A document of 1..n-1 words has one gram: all of it."""
    h, first = w.hash, w.first
    size = np.diff(first)
    m = np.where(size >= n, size - n + 1, (size > 0).astype(np.int64))
    doc = np.repeat(np.arange(len(size)), m)
    at = np.arange(len(doc)) - np.repeat(np.cumsum(m) - m, m) + np.repeat(first[:-1], m)
    g = h[at] if len(at) else np.zeros(0, U64)
    last = np.repeat(first[1:], m)
    for k in range(1, n):
        inside = at + k < last
        nxt = np.where(inside, h[np.minimum(at + k, max(len(h) - 1, 0))], U64(0)) if len(at) else g
        g = g * BASE + nxt
    return mix(g), doc


# ----- compact integers
def squeeze(*columns: np.ndarray) -> bytes:
    """Columns of one length, of integers, as byte planes under zstd: small and similar numbers take little room in a shuffle."""
    n, head, planes = len(columns[0]), [], []
    for x in columns:
        v = np.ascontiguousarray(x).astype("<i8").view("<u8")
        head.append(max(1, (int(v.max()).bit_length() + 7) // 8) if n else 1)
        planes.append(np.ascontiguousarray(v.view(np.uint8).reshape(-1, 8)[:, : head[-1]].T).tobytes())
    return struct.pack(f"<I{len(head)}B", n, *head) + pa.compress(b"".join(planes), codec="zstd", asbytes=True)


def stretch(blob, columns: int) -> list[np.ndarray]:
    """What :func:`squeeze` was given, as signed 64-bit integers."""
    view = memoryview(blob)
    n, *head = struct.unpack_from(f"<I{columns}B", view)
    raw, at, out = np.frombuffer(pa.decompress(view[4 + columns :], decompressed_size=n * sum(head), codec="zstd", asbytes=True), np.uint8), 0, []
    for width in head:
        v = np.zeros((n, 8), np.uint8)
        v[:, :width] = raw[at : at + n * width].reshape(width, n).T
        out.append(v.view("<i8").ravel())
        at += n * width
    return out


def runs_of(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(value of each run of equal neighbours, where the runs begin, with the end)."""
    if not len(x):
        return x, np.zeros(1, np.int64)
    first = np.concatenate([[0], np.flatnonzero(x[1:] != x[:-1]) + 1])
    return x[first], np.append(first, len(x))


def deltas(x: np.ndarray) -> np.ndarray:
    """Differences of neighbours, the first number as it is; undone by a cumulative sum."""
    return np.diff(x, prepend=x.dtype.type(0))


# ----- the same, one text at a time
def plain_words(text: str | None) -> list[str]:
    """Reference definition of the words above, for tests and small inputs."""
    import re

    return [m.translate(_ASCII_LOWER) for m in re.findall("[0-9A-Za-z\u0080-\U0010ffff]+", text or "")]


_ASCII_LOWER = {i: i + 32 for i in range(65, 91)}

#: The same definition in SQL that DuckDB runs: a list of words of ``text``.
SQL_WORDS = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+')"
