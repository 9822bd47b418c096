"""N-gram Jaccard join: rare-first prefix filtering with length, positional and suffix filters, verified once per pair.

Texts become sets of word n-grams, ordered rare first. Two sets with Jaccard similarity t or more share a gram among the
first |x| - ceil(t|x|) + 1 of each, and l grams among l - 1 more, so only these prefixes are joined, packed by gram
bucket; l grows with the set, so that one or two grams shared by chance make no candidate. In a bucket numpy pairs the
documents of every gram under the length filter (sizes differ by no more than t allows) and the positional filter (what
follows the shared gram can still reach the needed overlap). Pairs that met l times are brought together with their whole
sets once, by the smallest partner that they share, cut by the suffix filter and verified exactly.

The order needs the document frequency of every gram. Packets of documents send their grams, cut to as many bits as the
corpus needs, to the bucket that counts each gram, and get a byte of rarity for each back: two shuffles of a few bytes a
gram, and no table that grows with the corpus on any worker. Grams that the cut makes equal only share a rank; any order
that all documents share gives the exact result.

Hot groups are split. The documents of a gram that more than ``HOT`` documents hold fall into blocks, and every two blocks
meet on their own; so do the documents of a key that more than ``BLOCK`` documents are verified under. Tasks give their
pairs away as they go; what leaves verification is a count of links for each document and a spanning forest.

Equal texts are one class of which only the least id is joined, so thousands of copies cost as much as one text.

Cases: null and empty texts, and texts without a word, have no grams and no links. Fewer words than n make one gram. Ids
must be integers or cast to them. Rows with a null id cannot be named and have no row; :func:`keep_one` keeps them.
Repeated rows count once; an id with several texts stands for the one with the least digest. Very long texts are whole
sets. Extra columns are ignored, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorespark.llm.common import SQL_WORDS, U64, cut, deltas, drop_cut, forget, grams, mix, partitions_for, runs_of, squeeze, stretch, word_chunks

N = 2
THRESHOLD = 0.6
MOST_BROADCAST = 2_000_000  # ids of which every executor gets a copy; more are joined by a shuffle
PACKET = 1_000_000  # grams of the documents that are ranked together
HOT = 8_192  # documents of one gram that are paired in one group
BLOCK = 256  # documents of one key that are verified in one group
PLACE_BITS = 16  # of the greater id of a pair, that don't tell where it is counted


def gram_sets(col: pa.Array, n: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first document, document of each gram, gram, sizes) by chunk; grams are distinct per document and rise."""
    for w in word_chunks(col):
        g, d = grams(w, n)
        o = np.lexsort((g, d))
        g, d = g[o], d[o]
        new = np.ones(len(g), bool)
        new[1:] = (g[1:] != g[:-1]) | (d[1:] != d[:-1])
        yield w.doc_from, d[new], g[new], np.bincount(d[new], minlength=w.doc_to - w.doc_from)


def key_bits(grams_: int) -> int:
    """Bits of a gram that tell nearly all grams of a corpus apart: 12 more than it takes to number them."""
    return min(56, max(32, math.ceil(math.log2(max(2, grams_))) + 12))


def ask(reps: DataFrame, n: int, bits: int, buckets: int) -> DataFrame:
    """(bucket, packet, head, body): the grams of every packet of documents by the bucket that counts them, and each packet's documents."""
    width = -(-(1 << bits) // buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        forget()
        task, packet = TaskContext.get().partitionId(), 0
        ids, sizes, held, docs, count = [], [], [], 0, 0

        def flush() -> pa.RecordBatch:
            key, doc = np.concatenate([k for k, _ in held]), np.concatenate([d for _, d in held])
            o = np.argsort(key, kind="stable")
            key, doc = key[o], doc[o]
            which, edge = runs_of(key // width)
            name = task << 32 | packet
            body = [squeeze(deltas(key[x:y]), doc[x:y]) for x, y in zip(edge[:-1], edge[1:])]
            body.append(squeeze(np.concatenate(ids), np.concatenate(sizes)))
            bucket = np.append(which, name % buckets)
            return pa.RecordBatch.from_arrays(
                [pa.array(bucket, pa.int32()), pa.array([name] * len(body), pa.int64()), pa.array([False] * len(which) + [True]), pa.array(body, pa.binary())],
                names=["bucket", "packet", "head", "body"],
            )

        for b in batches:
            names = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for at, d, g, size in gram_sets(b.column(1), n):
                held.append(((g >> U64(64 - bits)).astype(np.int64), (d + docs).astype(np.int32)))
                ids.append(names[at : at + len(size)])
                sizes.append(size)
                docs, count = docs + len(size), count + len(g)
                if count >= PACKET:
                    yield flush()
                    packet, ids, sizes, held, docs, count = packet + 1, [], [], [], 0, 0
        if held:
            yield flush()

    return reps.mapInArrow(run, "bucket int, packet long, head boolean, body binary")


def rarity(key: tuple, rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts the grams of a bucket; each request goes back with eight times the logarithm of its grams' counts, in a byte each."""
    got = [(p.as_py(), h.as_py(), x.as_py()) for b in rows for p, h, x in zip(b.column(1), b.column(2), b.column(3))]
    keys = [np.cumsum(stretch(x, 2)[0]) for _, h, x in got if not h]
    every = np.concatenate(keys) if keys else np.zeros(0, np.int64)
    o = np.argsort(every, kind="stable")
    _, edge = runs_of(every[o])
    n = np.diff(edge)
    level = np.empty(len(every), np.uint8)
    level[o] = np.repeat(np.minimum(255, np.round(8 * np.log2(1 + n))).astype(np.uint8), n)
    of = iter(np.split(level, np.cumsum([len(k) for k in keys])[:-1]) if keys else [])
    levels = [None if h else pa.compress(next(of).tobytes(), codec="zstd", asbytes=True) for _, h, _ in got]
    for i in range(0, len(got), 64):
        part = got[i : i + 64]
        yield pa.RecordBatch.from_arrays(
            [pa.array([x[0] for x in part], pa.int64()), pa.array([x[1] for x in part]), pa.array([x[2] for x in part], pa.binary()), pa.array(levels[i : i + 64], pa.binary())],
            names=["packet", "head", "body", "levels"],
        )


def prefixes(t: float, buckets: int):
    """Of a packet whose grams are ranked: the prefix entries of its documents, by gram bucket."""

    def run(key: tuple, rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, docs, levels, ids, size = [], [], [], None, None
        for b in rows:
            for head, body, level in zip(b.column(1), b.column(2), b.column(3)):
                x, y = stretch(body.as_buffer(), 2)
                if head.as_py():
                    ids, size = x, y
                else:
                    keys.append(np.cumsum(x)), docs.append(y)
                    levels.append(np.frombuffer(pa.decompress(level.as_buffer(), decompressed_size=len(x), codec="zstd", asbytes=True), np.uint8))
        if ids is None or not keys:
            return
        k, d, l = np.concatenate(keys), np.concatenate(docs), np.concatenate(levels)
        o = np.lexsort((k, l, d))
        k, d, l = k[o], d[o], l[o]
        pos = np.arange(len(d)) - (np.cumsum(size) - size)[d]
        take = pos < prefix_length(size, t)[d]
        k, d, l, pos = k[take], d[take], l[take], pos[take]
        yield packed_entries(*split_hot(k, ids[d], size[d], pos, np.exp2(l / 8.0)), buckets)

    return run


def split_hot(key: np.ndarray, doc: np.ndarray, size: np.ndarray, pos: np.ndarray, holders: np.ndarray) -> tuple[np.ndarray, ...]:
    """Entries (gram, document, size, place, side); where a gram has many holders, one for every block that the document's block meets.

    Side 2 pairs with all of its group, sides 0 and 1 with each other only, so that every two documents meet once.
    """
    blocks = np.maximum(1, np.ceil(holders / HOT)).astype(np.int64)
    many = np.repeat(np.arange(len(key)), blocks)
    other = np.arange(len(many)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    n = blocks[many]
    own = (mix(doc[many].view(U64)) % n.astype(U64)).astype(np.int64)
    low, high = np.minimum(own, other), np.maximum(own, other)
    apart = (mix(key[many].view(U64) ^ mix((low * n + high + 1).view(U64))) >> U64(8)).astype(np.int64)
    return np.where(n > 1, apart, key[many]), doc[many], size[many], pos[many], np.where(own == other, 2, np.where(own < other, 0, 1)) * (n > 1) + 2 * (n == 1)


def packed_entries(gram: np.ndarray, doc: np.ndarray, size: np.ndarray, pos: np.ndarray, side: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Entries by bucket of their gram."""
    of = gram % buckets
    o = np.lexsort((pos, doc, of))
    cols = [x[o] for x in (doc, size, pos, side, gram // buckets)]
    which, edge = runs_of(of[o])
    body = [squeeze(deltas(cols[0][x:y]), *(c[x:y] for c in cols[1:])) for x, y in zip(edge[:-1], edge[1:])]
    return pa.RecordBatch.from_arrays([pa.array(which, pa.int32()), pa.array(body, pa.binary())], names=["bucket", "packed"])


def meetings(size: np.ndarray) -> np.ndarray:
    """l: how many of their prefix grams two sets must share; that of the smaller set counts."""
    return 1 + size // 25


def prefix_length(size: np.ndarray, t: float) -> np.ndarray:
    return size - np.ceil(t * size - 1e-9).astype(np.int64) + meetings(size)


def need(a: np.ndarray, b: np.ndarray, t: float) -> np.ndarray:
    """Overlap that sets of sizes a and b need for similarity t."""
    return np.ceil(t / (1 + t) * (a + b) - 1e-9).astype(np.int64)


def bucket_pairs(gram: np.ndarray, doc: np.ndarray, size: np.ndarray, pos: np.ndarray, side: np.ndarray, t: float, flush: int = 500_000) -> Iterator[np.ndarray]:
    """Pairs that meet among the prefix entries of some grams: rows of two ids (the lesser first), meetings so far, meetings needed; a pair can come again."""
    o = np.lexsort((size, gram))
    gram, doc, size, pos, side = (x[o].astype(np.int64) for x in (gram, doc, size, pos, side))
    _, edge = runs_of(gram)
    end = np.repeat(edge[1:], np.diff(edge))
    alive, step, held, kept = np.arange(len(gram)), 1, [], 0
    while len(alive):
        alive = alive[alive + step < end[alive]]
        other = alive + step
        near = size[alive] >= np.ceil(t * size[other] - 1e-9)  # in a group sizes rise, so a pair too far apart ends its row
        alive, other = alive[near], other[near]
        rest, l = np.minimum(size[alive] - pos[alive], size[other] - pos[other]), meetings(size[alive])
        ok = (rest > need(size[alive], size[other], t) - l) & (doc[alive] != doc[other]) & ((side[alive] == 2) | (side[alive] != side[other]))
        x, y = doc[alive[ok]], doc[other[ok]]
        if len(x):
            held.append(np.stack([np.minimum(x, y), np.maximum(x, y), np.ones(len(x), np.int64), l[ok]], 1))
            kept += len(x)
            if kept > flush:
                yield add_up(np.concatenate(held))
                held, kept = [], 0
        step += 1
    if held:
        yield add_up(np.concatenate(held))


def meeting_place(a: np.ndarray, b: np.ndarray, buckets: int) -> np.ndarray:
    """Where the meetings of a pair are counted: with those of its lesser id and greater ids nearby, as differences of neighbours take little room."""
    near = mix(np.ascontiguousarray(a).view(U64)) ^ np.ascontiguousarray(b >> PLACE_BITS).view(U64)
    return (mix(near) % U64(buckets)).astype(np.int64)


def add_up(p: np.ndarray) -> np.ndarray:
    """One row a pair, with the sum of its meetings."""
    p = p[np.lexsort((p[:, 1], p[:, 0]))]
    new = np.ones(len(p), bool)
    new[1:] = (p[1:, :2] != p[:-1, :2]).any(1)
    out = p[new]
    if len(p):
        out[:, 2] = np.add.reduceat(p[:, 2], np.flatnonzero(new))
    return out


def suffix_bound(value: np.ndarray, key: np.ndarray, owner: np.ndarray, base: int, a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], depth: int = 2) -> np.ndarray:
    """Lower bounds of the symmetric differences of pairs of sorted sets, all pairs at once.

    ``value`` holds the sets one after another as numbers below ``base``, ``key`` the same with the set's number times
    ``base`` added; a and b are the ranges of each pair's sets. Both are split at the middle element of the longer.
    """
    (a0, a1), (b0, b1) = a, b
    if depth == 0 or not len(a0):
        return np.abs((a1 - a0) - (b1 - b0))
    swap = a1 - a0 < b1 - b0
    x0, x1, y0, y1 = (np.where(swap, p, q) for p, q in ((b0, a0), (b1, a1), (a0, b0), (a1, b1)))
    m = (x0 + x1) // 2
    some = (x1 > x0) & (y1 > y0)
    w = value[np.minimum(m, len(value) - 1)]
    k = np.clip(np.searchsorted(key, owner[np.minimum(y0, len(value) - 1)] * base + w), y0, y1)
    same = (k < y1) & (value[np.minimum(k, len(value) - 1)] == w)
    left = suffix_bound(value, key, owner, base, (x0, m), (y0, k), depth - 1)
    right = suffix_bound(value, key, owner, base, (np.minimum(m + 1, x1), x1), (k + same, y1), depth - 1)
    return np.where(some, left + right + ~same, np.abs((a1 - a0) - (b1 - b0)))


def verify(pairs: np.ndarray, sets: dict[int, np.ndarray], t: float) -> tuple[np.ndarray, np.ndarray]:
    """(pairs that reach t, their similarity): those that the suffix filter leaves are counted by one matrix product over shared grams, in blocks of columns."""
    ids = np.unique(pairs)
    if not len(ids):
        return pairs, np.zeros(0)
    size = np.array([len(sets[int(d)]) for d in ids], np.int64)
    a, b = np.searchsorted(ids, pairs[:, 0]), np.searchsorted(ids, pairs[:, 1])
    _, value, n = np.unique(np.concatenate([sets[int(d)] for d in ids]), return_inverse=True, return_counts=True)
    owner, stop = np.repeat(np.arange(len(ids)), size), np.cumsum(size)
    most = size[a] + size[b] - 2 * need(size[a], size[b], t)  # symmetric difference that t allows
    left = suffix_bound(value, owner * len(n) + value, owner, len(n), (stop[a] - size[a], stop[a]), (stop[b] - size[b], stop[b])) <= most
    pairs, a, b = pairs[left], a[left], b[left]
    shared = n[value] > 1
    local, row, width = (np.cumsum(n > 1) - 1)[value[shared]], owner[shared], int((n > 1).sum())
    order = np.argsort(local, kind="stable")
    local, row = local[order], row[order]
    over, step = np.zeros(len(pairs), np.int64), max(1, min(4096, 4_000_000 // len(ids)))
    for k in range(0, width, step):
        lo, hi = np.searchsorted(local, [k, k + step])
        x = np.zeros((len(ids), step), np.float32)
        x[row[lo:hi], local[lo:hi] - k] = 1
        if len(pairs) * 4 > len(ids):
            over += (x @ x.T)[a, b].astype(np.int64)
        else:
            over += np.einsum("ij,ij->i", x[a], x[b]).astype(np.int64)
    j = over / np.maximum(1, size[a] + size[b] - over)
    ok = j >= t - 1e-12
    return pairs[ok], j[ok]


def forest(pairs: np.ndarray) -> np.ndarray:
    """Edges from the least member to every other of each connected group."""
    ids, at = np.unique(pairs, return_inverse=True)
    a, b = at.reshape(-1, 2).T if len(pairs) else (np.zeros(0, np.int64),) * 2
    root = np.arange(len(ids))
    while True:
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, a, low), np.minimum.at(root, b, low)
        root = root[root]
        if (root == before).all():
            break
    rest = np.flatnonzero(root != np.arange(len(ids)))
    return np.stack([ids[root[rest]], ids[rest]], 1)


def text_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, rep): every id whose text has a word, and the least id with the same text."""
    t = F.col(f"`{text_col}`")
    small = docs.filter(t.rlike(r"[0-9A-Za-z]|[^\x00-\x7F]") & F.col(f"`{id_col}`").isNotNull()).select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.sha2(t, 256).alias("digest"))
    one = cut(small.groupBy("doc_id").agg(F.min("digest").alias("digest"), (F.min("digest") != F.max("digest")).alias("mixed"), (F.count("*") > 1).alias("again")), "digests")
    return cut(one.join(one.groupBy("digest").agg(F.min("doc_id").alias("rep")), "digest").select("doc_id", "rep", "digest", "mixed", "again"), "classes")


def named_texts(docs: DataFrame, classes: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) of the rows with an id and a text; where ids have several texts, only those that stand for them."""
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).filter("doc_id IS NOT NULL AND text IS NOT NULL")
    if classes.filter("mixed").limit(1).count():
        texts = texts.withColumn("digest", F.sha2("text", 256)).join(classes.select("doc_id", "digest"), ["doc_id", "digest"], "left_semi").select("doc_id", "text")
    return texts


def _small(df: DataFrame, n: int) -> DataFrame:
    return F.broadcast(df) if n <= MOST_BROADCAST else df


def verified(docs: DataFrame, n: int, t: float, id_col: str, text_col: str, classes: DataFrame, whole: bool) -> DataFrame:
    """Of the similar pairs of least ids, (doc_a, doc_b, value): all of them with their similarity, or only the edges of a
    spanning forest (value null) and each document's number of pairs (doc_b null)."""
    spark: SparkSession = docs.sparkSession
    texts = named_texts(docs, classes, id_col, text_col)
    other = classes.filter("doc_id <> rep").select("doc_id")
    reps = texts.join(_small(other, other.count()), "doc_id", "left_anti")
    text_bytes = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    total, parts = text_bytes // 6 + 1, partitions_for(spark, text_bytes)
    counting, buckets = max(parts, -(-total // 2_000_000)), max(parts, math.ceil(total * (1 - t) / 500_000))

    asked = ask(reps, n, key_bits(total), counting).repartition(parts, "bucket").groupBy("bucket").applyInArrow(rarity, "packet long, head boolean, body binary, levels binary")
    entries = asked.repartition(parts, "packet").groupBy("packet").applyInArrow(prefixes(t, buckets), "bucket int, packed binary")

    def pair(key: tuple, rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [stretch(x.as_buffer(), 5) for b in rows for x in b.column(1)]
        d, s, p, side, g = (np.concatenate([np.cumsum(x[k]) if k == 0 else x[k] for x in got]) for k in range(5))
        del got
        for m in bucket_pairs(g, d, s, p, side, t):
            of = meeting_place(m[:, 0], m[:, 1], buckets)
            o = np.argsort(of, kind="stable")  # all meetings of a pair go to one place
            which, edge = runs_of(of[o])
            m = m[o]
            yield pa.RecordBatch.from_arrays([pa.array(which, pa.int32()), pa.array([_pack_pairs(m[x:y]) for x, y in zip(edge[:-1], edge[1:])], pa.binary())], names=["bucket", "packed"])

    def enough(table: pa.Table) -> pa.Table:
        m = add_up(np.concatenate([_unpack_pairs(x.as_buffer()) for x in table.column("packed")]))
        m = m[m[:, 2] >= m[:, 3]]
        return pa.table({"doc_a": pa.array(m[:, 0], pa.int64()), "doc_b": pa.array(m[:, 1], pa.int64())})

    met = entries.repartition(parts, "bucket").groupBy("bucket").applyInArrow(pair, "bucket int, packed binary")
    pairs = cut(met.repartition(parts, "bucket").groupBy("bucket").applyInArrow(enough, "doc_a long, doc_b long"), "candidates")

    both = pairs.unionByName(pairs.select(F.col("doc_b").alias("doc_a"), F.col("doc_a").alias("doc_b")))
    least = cut(both.groupBy("doc_a").agg(F.least(F.min("doc_b"), F.first("doc_a")).alias("m")), "least")
    keyed = pairs.join(least, "doc_a").join(least.select(F.col("doc_a").alias("doc_b"), F.col("m").alias("m_")), "doc_b").select("doc_a", "doc_b", F.least("m", "m_").alias("key"))
    keyed = cut(keyed, "keyed")
    # a key with many documents is split: its documents fall into blocks, and pairs meet by their two blocks
    ends = keyed.select("key", F.explode(F.array("doc_a", "doc_b")).alias("doc_id"))
    crowd = cut(ends.distinct().groupBy("key").count().filter(F.col("count") > BLOCK).select("key", F.ceil(F.col("count") / BLOCK).alias("blocks")), "crowds")
    block = lambda c: F.pmod(F.xxhash64(c), F.coalesce("blocks", F.lit(1)))
    place = F.struct("key", F.least(block("doc_a"), block("doc_b")).alias("x"), F.greatest(block("doc_a"), block("doc_b")).alias("y"))
    keyed = cut(keyed.join(_small(crowd, crowd.count()), "key", "left").select("doc_a", "doc_b", place.alias("place")), "placed")
    wanted = cut(keyed.select("place", F.explode(F.array("doc_a", "doc_b")).alias("doc_id")).distinct(), "wanted")
    named = cut(wanted.select("doc_id").distinct(), "named")
    involved = reps.join(_small(named, named.count()), "doc_id", "left_semi").select("doc_id", "text")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for b in (big.slice(at, 1024) for at in range(0, big.num_rows, 1024)):
                out = [b""] * b.num_rows
                for at, d, g, size in gram_sets(b.column(1), n):
                    stop = np.cumsum(size)
                    for i, e in enumerate(stop):
                        out[at + i] = g[e - size[i] : e].tobytes()
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=["doc_id", "grams"])

    known = involved.mapInArrow(sets, "doc_id long, grams binary").dropDuplicates(["doc_id"]) if _repeated(classes) else involved.mapInArrow(sets, "doc_id long, grams binary")
    together = known.join(_small(wanted, wanted.count()), "doc_id").select("place", F.col("doc_id").alias("doc_a"), F.lit(None).cast("long").alias("doc_b"), "grams")
    together = together.unionByName(keyed.select("place", "doc_a", "doc_b", F.lit(None).cast("binary").alias("grams"))).repartition(parts, "place")

    def check(table: pa.Table) -> pa.Table:
        is_pair = np.asarray(table.column("doc_b").is_valid())
        a, b = table.column("doc_a").to_numpy(), table.column("doc_b").filter(pa.array(is_pair)).to_numpy()
        held = {int(d): np.frombuffer(x.as_buffer(), "<u8") for d, x, p in zip(a, table.column("grams"), is_pair) if not p}
        p, j = verify(np.stack([a[is_pair], b], 1).astype(np.int64), held, t)
        if whole:
            return pa.table({"doc_a": pa.array(p[:, 0], pa.int64()), "doc_b": pa.array(p[:, 1], pa.int64()), "value": pa.array(np.round(j, 6))})
        e, (d, k) = forest(p), np.unique(p, return_counts=True)
        return pa.table({
            "doc_a": pa.array(np.concatenate([e[:, 0], d]), pa.int64()), "doc_b": pa.concat_arrays([pa.array(e[:, 1], pa.int64()), pa.nulls(len(d), pa.int64())]),
            "value": pa.concat_arrays([pa.nulls(len(e), pa.float64()), pa.array(k.astype(float))]),
        })

    return together.groupBy("place").applyInArrow(check, "doc_a long, doc_b long, value double")


def _repeated(classes: DataFrame) -> bool:
    return bool(classes.filter("again").limit(1).count())


def jaccard_pairs(docs: DataFrame, n: int = N, t: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_a, doc_b, jaccard): all pairs of different texts with similarity t or more, by their least ids, doc_a < doc_b."""
    return verified(docs, n, t, id_col, text_col, text_classes(docs, id_col, text_col), True).withColumnRenamed("value", "jaccard")


def _pack_pairs(m: np.ndarray) -> bytes:
    """Sorted pairs: differences of the first ids, and of the second ids under one first id."""
    a, b = m[:, 0], m[:, 1]
    step = b - a
    same = np.flatnonzero(a[1:] == a[:-1]) + 1
    step[same] = b[same] - b[same - 1]
    return squeeze(deltas(a), step, m[:, 2], m[:, 3])


def _unpack_pairs(blob) -> np.ndarray:
    da, step, n, l = stretch(blob, 4)
    a, run = np.cumsum(da), np.cumsum(step)
    new = np.ones(len(a), bool)
    new[1:] = a[1:] != a[:-1]
    first = np.flatnonzero(new)
    b = run - np.repeat(run[first] - step[first] - a[first], np.diff(np.append(first, len(a))))
    return np.stack([a, b, n, l], 1)


def similar(docs: DataFrame, n: int = N, t: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, class_id, links), a row for each id: the least id that it is connected with by copies and similar texts, and
    how many other texts are similar to its own."""
    classes = text_classes(docs, id_col, text_col)
    found = cut(verified(docs, n, t, id_col, text_col, classes, False), "links")
    links = found.filter("doc_b IS NULL").groupBy(F.col("doc_a").alias("rep")).agg(F.sum("value").cast("long").alias("links"))
    roots = components(found.filter("doc_b IS NOT NULL").select("doc_a", "doc_b")).select(F.col("doc_id").alias("rep"), "root")
    ids = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id")).filter("doc_id IS NOT NULL").distinct()
    placed = ids.join(classes.select("doc_id", "rep"), "doc_id", "left").join(roots, "rep", "left").join(links, "rep", "left")
    return placed.select("doc_id", F.coalesce("root", "rep", "doc_id").alias("class_id"), F.coalesce("links", F.lit(0)).cast("long").alias("links"))


def components(edges: DataFrame, a: str = "doc_a", b: str = "doc_b") -> DataFrame:
    """(doc_id, root): the least id that each id of an edge is connected with. Labels fall to neighbours' labels and jump to labels of labels until none changes."""
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v"))
    e = cut(e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))), "edges")
    lab = cut(e.groupBy("u").agg(F.least(F.first("u"), F.min("v")).alias("root")), "labels")
    while True:
        near = e.join(lab.select(F.col("u").alias("v"), F.col("root").alias("r")), "v").groupBy("u").agg(F.min("r").alias("r"))
        low = lab.join(near, "u").select("u", "root", F.least("root", "r").alias("r"))
        jump = lab.select(F.col("u").alias("r"), F.col("root").alias("rr"))
        nxt = cut(low.join(jump, "r", "left").select("u", "root", F.least("r", F.coalesce("rr", "r")).alias("new")), "labels")
        changed = nxt.filter("new <> root").limit(1).count()
        drop_cut(lab)
        lab = nxt.select("u", F.col("new").alias("root"))
        if not changed:
            return lab.select(F.col("u").alias("doc_id"), "root")


def keep_one(docs: DataFrame, n: int = N, t: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the documents connected, by similar pairs, to one of lesser id; one row of rows repeated with the same id stays."""
    gone = cut(similar(docs, n, t, id_col, text_col).filter("class_id <> doc_id").select(F.col("doc_id").alias("gone_")), "gone")
    key = F.col(f"`{id_col}`")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), key.cast("long").alias("id_"))
    rows = rows.join(_small(gone, gone.count()), F.col("id_") == F.col("gone_"), "left_anti")
    again = cut(docs.filter(key.isNotNull()).groupBy(key.cast("long").alias("again_")).count().filter("count > 1").select("again_"), "again")
    k = again.count()
    if k:
        first = Window.partitionBy("id_").orderBy(F.sha2(F.col("row")[text_col], 256), F.to_json("row"))
        once = rows.join(_small(again, k), F.col("id_") == F.col("again_"), "left_semi").withColumn("k_", F.row_number().over(first)).filter("k_ = 1").select("row", "id_")
        rows = rows.join(_small(again, k), F.col("id_") == F.col("again_"), "left_anti").unionByName(once)
    return rows.select(*[F.col("row")[c].alias(c) for c in docs.columns])


def oracle(n: int = N, t: float = THRESHOLD) -> str:
    """Classes and links in DuckDB SQL, by joining all grams (n = 2) and closing over the pairs."""
    assert n == 2
    return f"""
WITH RECURSIVE c AS (SELECT min(doc_id) AS doc_id, text FROM documents WHERE text IS NOT NULL GROUP BY text),
w AS (SELECT doc_id, {SQL_WORDS} AS ws FROM c),
g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 1 THEN [ws[1]] ELSE list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) END) AS gram FROM w WHERE len(ws) > 0),
s AS (SELECT doc_id, count(*) AS size FROM g GROUP BY doc_id),
o AS (SELECT a.doc_id AS doc_a, b.doc_id AS doc_b, count(*) AS n FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY 1, 2),
j AS (SELECT doc_a, doc_b FROM o JOIN s x ON x.doc_id = doc_a JOIN s y ON y.doc_id = doc_b WHERE n::DOUBLE / (x.size + y.size - n) >= {t} - 1e-12),
r AS (SELECT doc_id, doc_id AS root FROM c UNION SELECT j.doc_b, r.root FROM r JOIN j ON j.doc_a = r.doc_id),
m AS (SELECT doc_id, min(root) AS root FROM r GROUP BY doc_id),
k AS (SELECT doc_a AS doc_id, count(*) AS links FROM j GROUP BY doc_a)
SELECT d.doc_id, CASE WHEN s.doc_id IS NULL THEN d.doc_id ELSE m.root END AS class_id, coalesce(k.links, 0) AS links
FROM documents d LEFT JOIN c USING (text) LEFT JOIN s ON s.doc_id = c.doc_id LEFT JOIN m ON m.doc_id = c.doc_id LEFT JOIN k ON k.doc_id = c.doc_id"""
