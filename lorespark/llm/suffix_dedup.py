"""Suffix-array dedup: a hash-compared suffix sort finds passages of ``length`` words or more that occur twice or more.

A suffix is compared with another by prefix polynomial hashes: binary search over hashed lengths finds their common
extension in a logarithmic number of steps, the next word decides. Suffixes are merge-sorted that way, and neighbours
with a common extension of ``length`` words are equal; equal neighbours are verified word for word.

The suffixes of a corpus are partitioned by content. Of the k-grams in any window of ``length`` words, the least hash (the
rightmost of equals) is its anchor, so equal windows have equal anchors at equal offsets. First only anchors are
exchanged, about one word in twenty; windows whose anchor occurs once cannot repeat and are dropped. The other suffixes
go, with the words they need, to the partition of their anchor and are sorted there. Windows in a row with one anchor are
a run; of equal runs only the earliest is sorted, the others are known to occur earlier. An anchor that many documents
hold does not stay in one place: each of its windows goes to the place of its own hash, where equal windows still meet.

Result: per document, merged spans of words covered by repeated windows; ``removable_words`` counts those in windows that
occur earlier (by id, then place) and can go while the corpus keeps one copy. Equal texts are one class: its least id is
sorted, the others are wholly removable.

Cases: null, empty and shorter texts have no span. Rows with a null id have none, and do not make others repeat. A
passage repeated inside one document counts. Repeated rows count once; an id with several texts stands for the one with
the least digest. Texts of any length are indexed whole. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorespark.llm.common import _FOLD, SQL_WORDS, U64, Words, cut, forget, mix, partitions_for, powers, runs_of, word_chunks
from lorespark.llm.ngram_join import _small, named_texts, text_classes

LENGTH = 50
GRAM = 10
MOST_BROADCAST = 4_000_000  # repeated anchors of which every executor gets 32 bits each; more are joined by document
HOT = 4_096  # documents that hold an anchor whose windows still go to one place
SLICE_BYTES = 4 << 20  # words of runs whose suffixes are sorted at a time; those of one anchor stay together
BUCKET_BYTES = 1 << 20  # text for which there is one partition of suffixes
_LOW = U64((1 << 28) - 1)


def anchors(w: Words, length: int = LENGTH, k: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window starts, anchor word of each, hash of each anchor) for all windows inside documents."""
    n, span = len(w.hash), length - k + 1
    if n < length:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U64)
    sums = np.zeros(n + 1, U64)
    np.cumsum(w.hash * powers(n)[:n], dtype=U64, out=sums[1:])
    gram = mix((sums[k:] - sums[:-k]) * powers(n, "inverse")[: n - k + 1])
    value = (gram & ~_LOW) | (_LOW - np.arange(len(gram), dtype=U64))
    padded = np.full(-(-len(value) // span) * span, ~U64(0))
    padded[: len(value)] = value
    blocks = padded.reshape(-1, span)
    upto = np.minimum.accumulate(blocks, axis=1).ravel()
    onward = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    count = n - length + 1
    least = np.minimum(onward[:count], upto[span - 1 : span - 1 + count])
    doc_end = np.repeat(w.first[1:], np.diff(w.first))
    starts = np.flatnonzero(np.arange(count) + length <= doc_end[:count])
    at = (_LOW - (least[starts] & _LOW)).astype(np.int64)
    return starts, at, gram[at]


def _lcp(h: np.ndarray, sums: np.ndarray, x: np.ndarray, y: np.ndarray, length: int) -> np.ndarray:
    """Common extension of the suffixes at x and y, ``length`` at most, by binary search over prefix hashes."""
    inv = powers(len(h), "inverse")
    lo, hi = np.zeros(len(x), np.int64), np.full(len(x), length, np.int64)
    while True:
        open_ = np.flatnonzero(lo < hi)
        if not len(open_):
            return lo
        mid = (lo[open_] + hi[open_] + 1) >> 1
        a, b = x[open_], y[open_]
        same = (sums[a + mid] - sums[a]) * inv[a] == (sums[b + mid] - sums[b]) * inv[b]
        lo[open_[same]], hi[open_[~same]] = mid[same], mid[~same] - 1


def sort_suffixes(h: np.ndarray, suffix: np.ndarray, group: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Merge sort of suffixes inside groups (rising in ``group``): (order, equal), where equal[i] says that sorted suffix i agrees with i-1 in ``length`` words.

    All merges of a round run at once: every element finds its rank in the other half by binary search.
    """
    n = len(suffix)
    sums = np.zeros(len(h) + 1, U64)
    np.cumsum(h * powers(len(h))[: len(h)], dtype=U64, out=sums[1:])
    inv = powers(len(h), "inverse")
    window = (sums[suffix + length] - sums[suffix]) * inv[suffix]
    first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if n else np.zeros(0, np.int64)
    count = np.diff(np.append(first, n))
    begin, size = np.repeat(first, count), np.repeat(count, count)
    order, width = np.arange(n), 1

    def less(x: np.ndarray, y: np.ndarray, or_equal: np.ndarray) -> np.ndarray:
        out = or_equal.copy()
        d = np.flatnonzero(window[x] != window[y])
        if len(d):
            a, b = suffix[x[d]], suffix[y[d]]
            c = _lcp(h, sums, a, b, length)
            short = c < length
            out[d[short]] = h[(a + c)[short]] < h[(b + c)[short]]
        return out

    while n and width < count.max():
        some = np.flatnonzero(size > width)
        place = some - begin[some]
        block = place // (2 * width) * (2 * width)
        left = place - block < width
        base = begin[some] + block
        other_lo = base + np.where(left, width, 0)
        other_hi = np.minimum(base + np.where(left, 2 * width, width), begin[some] + size[some])
        other_hi = np.maximum(other_hi, np.minimum(other_lo, begin[some] + size[some]))
        lo, hi = np.minimum(other_lo, other_hi), other_hi.copy()
        floor_, me = lo.copy(), order[some]
        while True:
            open_ = np.flatnonzero(lo < hi)
            if not len(open_):
                break
            mid = (lo[open_] + hi[open_]) >> 1
            ahead = less(order[mid], me[open_], ~left[open_])  # does the other one go before me? equal ones keep their order
            lo[open_[ahead]], hi[open_[~ahead]] = mid[ahead] + 1, mid[~ahead]
        own = place - block - np.where(left, 0, width)
        nxt = order.copy()
        nxt[base + own + lo - floor_] = me
        order, width = nxt, 2 * width
    equal = np.zeros(n, bool)
    if n:
        equal[1:] = (group[1:] == group[:-1]) & (window[order[1:]] == window[order[:-1]])
    return order, equal


def _verified(text: Callable[[int, int], bytes], run: np.ndarray, suffix: np.ndarray, order: np.ndarray, equal: np.ndarray, length: int) -> np.ndarray:
    """``equal`` without hash collisions: every two runs with equal windows at one distance are compared once, word for word.

    ``text`` gives the words from one index to another as canonical bytes.
    """
    i = np.flatnonzero(equal)
    a, b = order[i - 1], order[i]
    key = np.stack([run[a], run[b], suffix[a] - suffix[b]], 1)
    o = np.lexsort((suffix[a], key[:, 2], key[:, 1], key[:, 0]))
    new = np.ones(len(o), bool)
    if len(o):  # a gap between equal windows also begins a new comparison
        new[1:] = (key[o[1:]] != key[o[:-1]]).any(1) | (suffix[a[o[1:]]] > suffix[a[o[:-1]]] + length)
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(o)) - 1
    starts, ends, shift = suffix[a[o[head]]].tolist(), (suffix[a[o[tail]]] + length).tolist(), (suffix[b[o[head]]] - suffix[a[o[head]]]).tolist()
    for q, (x, y, d) in enumerate(zip(starts, ends, shift)):
        if text(x, y) != text(x + d, y + d):
            for k in o[head[q] : tail[q] + 1]:
                u, v = int(suffix[a[k]]), int(suffix[b[k]])
                if text(u, u + length) != text(v, v + length):
                    equal[i[k]] = False
    return equal


def equal_runs(words: list[bytes], doc: np.ndarray, start: np.ndarray, again: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(the earliest of every set of runs with equal words, whether it has equals or was known to, the others).

    A run that comes twice from one place, by rows repeated with the same id, is not its own equal.
    """
    code: dict[bytes, int] = {}
    of = np.array([code.setdefault(x, len(code)) for x in words], np.int64)
    o = np.lexsort((start, doc, of))
    new = np.ones(len(o), bool)
    new[1:] = of[o[1:]] != of[o[:-1]]
    elsewhere = np.zeros(len(o), bool)
    elsewhere[1:] = ~new[1:] & ((doc[o[1:]] != doc[o[:-1]]) | (start[o[1:]] != start[o[:-1]]))
    some = np.zeros(len(code), bool)
    np.logical_or.at(some, of[o], elsewhere | again[o])
    first = o[new]
    return first, some[of[first]], o[elsewhere]


def repeated_windows(words: list[bytes], anchor: np.ndarray, doc: np.ndarray, start: np.ndarray, count: np.ndarray, off: np.ndarray, again: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, start word, whether it occurs earlier) of all windows in some runs that occur twice or more; ``again``: the run has equals that are not among these."""
    h, begin, stop, at_byte = [np.zeros(0, U64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
    for w in word_chunks(pa.array(words, pa.large_binary())):
        h.append(w.hash), begin.append(w.start + at_byte), stop.append(w.end + at_byte)
        at_byte += len(w.data)
    raw, h, begin, stop = b"".join(words), np.concatenate(h), np.concatenate(begin), np.concatenate(stop)
    size = count.astype(np.int64) + length - 1
    first = np.cumsum(size) - size
    run = np.repeat(np.arange(len(anchor)), count)
    at = np.arange(len(run)) - np.repeat(np.cumsum(count) - count, count)
    suffix, offset = first[run] + at, off[run] - at  # offset: from the window's start to its anchor
    o = np.lexsort((start[run] + at, doc[run], offset, anchor[run]))
    run, at, suffix, offset = run[o], at[o], suffix[o], offset[o]
    if len(run):  # rows repeated with the same id
        place = start[run] + at
        once = np.concatenate([[True], (doc[run][1:] != doc[run][:-1]) | (place[1:] != place[:-1]) | (anchor[run][1:] != anchor[run][:-1])])
        run, at, suffix, offset = run[once], at[once], suffix[once], offset[once]
    same = np.concatenate([[False], (anchor[run][1:] == anchor[run][:-1]) & (offset[1:] == offset[:-1])]) if len(run) else np.zeros(0, bool)
    group = np.cumsum(~same)
    order, equal = sort_suffixes(h, suffix, group, length)
    if equal.any():
        equal = _verified(lambda x, y: raw[begin[x] : stop[y - 1]], run, suffix, order, equal, length)
    cls = np.cumsum(~equal)
    many = np.bincount(cls, 1 + again[run[order]], minlength=len(cls) + 1)[cls] > 1 if len(cls) else np.zeros(0, bool)
    # merging keeps the order of equal suffixes, which came by document and place: the first of a class is the earliest
    return doc[run[order]][many], (start[run] + at)[order][many], equal[many]


def _union(d: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words that spans of documents cover, as spans that do not touch."""
    o = np.lexsort((s, d))
    d, s, e = d[o], s[o], e[o]
    if not len(d):
        return d, s, e
    rank = np.cumsum(np.concatenate([[0], d[1:] != d[:-1]])) * (int(e.max()) + 2)
    top = np.maximum.accumulate(e + rank)
    new = np.concatenate([[True], (s + rank)[1:] > top[:-1]])
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(d)) - 1
    return d[head], s[head], top[tail] - rank[tail]


def merge_spans(doc: np.ndarray, start: np.ndarray, stop: np.ndarray, removable: np.ndarray) -> tuple[np.ndarray, ...]:
    """Covered words of each document as spans: (document, first word, words, words in removable windows)."""
    d, s, e = _union(doc, start, stop)
    rd, rs, re_ = _union(doc[removable], start[removable], stop[removable])
    order = np.lexsort((s, d))
    gone = np.zeros(len(d), np.int64)
    if len(rd):
        docs = {x: i for i, x in enumerate(np.unique(d).tolist())}
        big = int(e.max()) + 2
        key = np.array([docs[x] for x in d[order].tolist()], np.int64) * big + s[order]
        where = np.searchsorted(key, np.array([docs[x] for x in rd.tolist()], np.int64) * big + rs, "right") - 1
        np.add.at(gone, order[where], re_ - rs)
    return d, s, e - s, gone


def _among(x: np.ndarray, rising: np.ndarray) -> np.ndarray:
    """Which of x are in ``rising``."""
    return rising[np.minimum(np.searchsorted(rising, x), len(rising) - 1)] == x if len(rising) else np.zeros(len(x), bool)


def _pack_by(bucket: np.ndarray, **cols: np.ndarray) -> tuple[np.ndarray, dict[str, list[bytes]], np.ndarray, np.ndarray]:
    """(buckets that occur, the columns' bytes by bucket, order, edges of the buckets in that order)."""
    o = np.argsort(bucket, kind="stable")
    some, edge = runs_of(bucket[o])
    return some, {n: [x[o[p:q]].tobytes() for p, q in zip(edge[:-1], edge[1:])] for n, x in cols.items()}, o, edge


def repeated_spans(docs: DataFrame, length: int = LENGTH, k: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start_word, n_words, removable_words) of all passages of ``length`` words or more that occur twice or more."""
    spark = docs.sparkSession
    classes = text_classes(docs, id_col, text_col)
    texts = named_texts(docs, classes, id_col, text_col)
    other = classes.filter("doc_id <> rep").select("doc_id")
    n_other = other.count()
    reps = texts.join(_small(other, n_other), "doc_id", "left_anti")
    text_bytes = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = partitions_for(spark, text_bytes)
    buckets = max(parts, math.ceil(text_bytes / BUCKET_BYTES))

    def exchange(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        held, n = [], 0

        def flush() -> pa.RecordBatch:
            g, d = np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held])
            some, cols, _, _ = _pack_by((g % U64(buckets)).astype(np.int64), g=g.astype("<u8"), d=d.astype("<i8"))
            return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(cols["g"], pa.binary()), pa.array(cols["d"], pa.binary())], names=["bucket", "g", "d"])

        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for w in word_chunks(b.column(1)):
                _, at, gram = anchors(w, length, k)
                one = np.unique(at, return_index=True)[1]
                doc = np.searchsorted(w.first, at[one], "right") - 1
                o = np.lexsort((doc, gram[one]))
                one, doc = one[o], doc[o]
                two = np.ones(len(o), bool)  # two of a document say all
                two[2:] = (gram[one[2:]] != gram[one[:-2]]) | (doc[2:] != doc[:-2])
                held.append((gram[one[two]], ids[w.doc_from + doc[two]]))
                n += len(held[-1][0])
            if n > 500_000:
                yield flush()
                held, n = [], 0
        if held:
            yield flush()

    def twice(table: pa.Table) -> pa.Table:
        g, d = (np.concatenate([np.frombuffer(x.as_buffer(), t) for x in table.column(c)]) for c, t in (("g", "<u8"), ("d", "<i8")))
        o = np.lexsort((d, g))
        g, d = g[o], d[o]
        new = np.concatenate([[True], g[1:] != g[:-1]])
        n = np.diff(np.append(np.flatnonzero(new), len(g)))
        many = np.repeat(n, n) > 1
        g, d = g[many], d[many]
        one = np.concatenate([[True], (g[1:] != g[:-1]) | (d[1:] != d[:-1])]) if len(g) else np.zeros(0, bool)
        return pa.table({"g": pa.array(g[one].view(np.int64)), "doc_id": pa.array(d[one], pa.int64())})

    seen = cut(reps.mapInArrow(exchange, "bucket int, g binary, d binary").repartition(parts, "bucket").groupBy("bucket").applyInArrow(twice, "g long, doc_id long"), "anchors")
    holders = cut(seen.groupBy("g").agg(F.count("*").alias("n")), "repeated")

    def gathered(values: DataFrame, kind: type) -> np.ndarray:
        """A column of the driver's, rising as unsigned numbers; by Arrow, as rows of Python objects would fill the driver."""
        return np.sort(values.toArrow().column(0).to_numpy().view(kind))

    hot = spark.sparkContext.broadcast(gathered(holders.filter(F.col("n") > HOT).select("g"), U64))
    if holders.count() <= MOST_BROADCAST:  # windows whose anchor has only the upper bits of a repeated one go along in vain
        known = spark.sparkContext.broadcast(gathered(holders.select(F.shiftright("g", 32).cast("int").alias("g")).distinct(), np.uint32))
        source = reps.select("doc_id", "text", F.lit(None).cast("array<bigint>").alias("own"))
    else:
        known = None
        source = reps.join(seen.groupBy("doc_id").agg(F.collect_list("g").alias("own")), "doc_id").select("doc_id", "text", "own")

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        gap = re.compile(rb"\0+")
        apart, found = hot.value, known.value if known is not None else None
        for b in (big.slice(at, 1024) for big in batches for at in range(0, big.num_rows, 1024)):
            ids = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            rep = found if found is not None else np.unique((b.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(U64) >> U64(32)).astype(np.uint32))
            held = []
            for w in word_chunks(b.column(1)):
                starts, at, gram = anchors(w, length, k)
                if not len(starts) or not len(rep):
                    continue
                hit = np.flatnonzero(_among((gram >> U64(32)).astype(np.uint32), rep))
                if not len(hit):
                    continue
                starts, at, gram = starts[hit], at[hit], gram[hit]
                alone = _among(gram, apart)
                if alone.any():
                    sums = np.zeros(len(w.hash) + 1, U64)
                    np.cumsum(w.hash * powers(len(w.hash))[: len(w.hash)], dtype=U64, out=sums[1:])
                    x = starts[alone]
                    gram[alone] = mix(gram[alone] ^ mix((sums[x + length] - sums[x]) * powers(len(w.hash), "inverse")[x]))
                head = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1)]) | alone)
                tail = np.append(head[1:], len(starts)) - 1
                s0, n = starts[head], tail - head + 1
                doc = np.searchsorted(w.first, s0, "right") - 1
                folded = _FOLD[w.data].tobytes()
                words = [gap.sub(b" ", folded[x:y]) for x, y in zip(w.start[s0].tolist(), w.end[s0 + n + length - 2].tolist())]
                held.append((gram[head], ids[w.doc_from + doc], (s0 - w.first[doc]).astype("<i4"), n.astype("<i4"), (at[head] - s0).astype("<i4"), words))
            if held:
                g, d, s, n, off = (np.concatenate([x[c] for x in held]) for c in range(5))
                words = [t for x in held for t in x[5]]
                first, again, rest = equal_runs(words, d, s, np.zeros(len(d), bool))
                later = np.stack(_union(d[rest], s[rest].astype(np.int64), s[rest].astype(np.int64) + n[rest] + length - 1), 1).astype("<i8")
                g, d, s, n, off, words = g[first], d[first], s[first], n[first], off[first], [words[x] for x in first.tolist()]
                some, cols, o, edge = _pack_by((g % U64(buckets)).astype(np.int64), anchor=g.astype("<u8"), doc=d.astype("<i8"), start=s, count=n, off=off, again=again)
                joined = [b"".join(words[x] + b"\n" for x in o[edge[q] : edge[q + 1]].tolist()) for q in range(len(some))]
                spans = [later[q :: len(some)].tobytes() for q in range(len(some))]  # they are finished: any place will do
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), *[pa.array(cols[c], pa.binary()) for c in cols], pa.array(joined, pa.binary()), pa.array(spans, pa.binary())], names=["bucket", *cols, "words", "later"])

    def sort(table: pa.Table) -> pa.Table:
        get = lambda c, t: np.concatenate([np.frombuffer(x.as_buffer(), t) for x in table.column(c)])
        words = [x for joined in table.column("words") for x in joined.as_py().split(b"\n")[:-1]]
        anchor, doc, start, count, off, again = get("anchor", "<u8"), get("doc", "<i8"), get("start", "<i4").astype(np.int64), get("count", "<i4"), get("off", "<i4"), get("again", "?")
        first, again, rest = equal_runs(words, doc, start, again)
        known_later = np.concatenate([get("later", "<i8").reshape(-1, 3), np.stack([doc[rest], start[rest], start[rest] + count[rest] + length - 1], 1)])
        out = [(*_union(*known_later.T), None)]
        o = first[np.argsort(anchor[first], kind="stable")]
        again = again[np.argsort(anchor[first], kind="stable")]
        _, edge = runs_of(anchor[o])
        upto = np.append(0, np.cumsum([len(words[x]) for x in o.tolist()]))[edge]
        cuts, p = [], 0
        while p < len(edge) - 1:
            cuts.append(p)
            p = max(p + 1, int(np.searchsorted(upto, upto[p] + SLICE_BYTES, "right")) - 1)
        for p, q in zip(cuts, [*cuts[1:], len(edge) - 1]):
            x = o[edge[p] : edge[q]]
            d, s, later = repeated_windows([words[i] for i in x.tolist()], anchor[x], doc[x], start[x], count[x], off[x], again[edge[p] : edge[q]], length)
            r = np.lexsort((s, later, d))
            d, s, later = d[r], s[r], later[r]
            new = np.concatenate([[True], (d[1:] != d[:-1]) | (later[1:] != later[:-1]) | (s[1:] > s[:-1] + 1)]) if len(d) else np.zeros(0, bool)
            head = np.flatnonzero(new)
            tail = np.append(head[1:], len(d))[: len(head)] - 1
            out.append((d[head], s[head], s[tail] + length, later[head]))
        later = np.concatenate([np.ones(len(x[0]), bool) if x[3] is None else x[3] for x in out])
        doc, start, stop = (np.concatenate([x[c] for x in out]) for c in range(3))
        return pa.table({"doc_id": pa.array(doc, pa.int64()), "start": pa.array(start, pa.int64()), "stop": pa.array(stop, pa.int64()), "later": pa.array(later)})

    run_schema = "bucket int, anchor binary, doc binary, start binary, count binary, off binary, again binary, words binary, later binary"
    found_spans = source.mapInArrow(runs, run_schema).repartition(parts, "bucket").groupBy("bucket").applyInArrow(sort, "doc_id long, start long, stop long, later boolean")

    copied = classes.join(classes.groupBy("digest").agg(F.count("*").alias("n")).filter("n > 1").select("digest"), "digest", "left_semi").select("doc_id", (F.col("doc_id") != F.col("rep")).alias("later"))
    copied = cut(copied, "copied")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = np.concatenate([np.diff(w.first) for w in word_chunks(b.column(2))] or [np.zeros(0, np.int64)])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64())], names=["doc_id", "later", "stop"])

    whole = texts.join(_small(copied, copied.count()), "doc_id").select("doc_id", "later", "text").mapInArrow(measure, "doc_id long, later boolean, stop long")
    whole = whole.filter(F.col("stop") >= length).dropDuplicates(["doc_id"]).select("doc_id", F.lit(0).cast("long").alias("start"), "stop", "later")

    def merge(table: pa.Table) -> pa.Table:
        d, s, n, gone = merge_spans(*(table.column(c).to_numpy() for c in ("doc_id", "start", "stop", "later")))
        return pa.table({"doc_id": pa.array(d, pa.int64()), "start_word": pa.array(s, pa.int64()), "n_words": pa.array(n, pa.int64()), "removable_words": pa.array(gone, pa.int64())})

    spans = found_spans.unionByName(whole).withColumn("part", F.pmod(F.hash("doc_id"), F.lit(buckets)))
    return spans.repartition(parts, "part").groupBy("part").applyInArrow(merge, "doc_id long, start_word long, n_words long, removable_words long")


def oracle(length: int = LENGTH) -> str:
    """The spans in DuckDB SQL, by grouping all windows."""
    return f"""
WITH w AS (SELECT doc_id, {SQL_WORDS} AS ws FROM documents WHERE text IS NOT NULL),
x AS (SELECT doc_id, unnest(range(0, len(ws) - {length} + 1)) AS s, ws FROM w WHERE len(ws) >= {length}),
h AS (SELECT doc_id, s, array_to_string(ws[s + 1 : s + {length}], ' ') AS v FROM x),
r AS (SELECT doc_id, s, count(*) OVER (PARTITION BY v) AS n, row_number() OVER (PARTITION BY v ORDER BY doc_id, s) AS k FROM h),
p AS (SELECT doc_id, unnest(range(s, s + {length})) AS p, k > 1 AS later FROM r WHERE n > 1),
q AS (SELECT doc_id, p, max(later::INT) AS later FROM p GROUP BY ALL),
i AS (SELECT doc_id, p, later, p - row_number() OVER (PARTITION BY doc_id ORDER BY p) AS island FROM q)
SELECT doc_id, CAST(min(p) AS BIGINT) AS start_word, count(*) AS n_words, CAST(sum(later) AS BIGINT) AS removable_words FROM i GROUP BY doc_id, island"""
