"""Benchmark decontamination: CGK walks and bit-sampling LSH over item-sized windows, then exact edit verification.

A document is contaminated by an item of m words if a window of m of its words is within floor(RATE * m) word edits of
the item. A CGK walk reads a window word by word and moves on, or not, by a random bit of step and word; walks of two
windows that an edit drove apart meet again, so that edit distance becomes Hamming distance between the words read. An LSH
key is a few neighbouring coordinates of a walk; every other walk reads from the end. The keys of all items are one index,
and each window is looked up in it, which names the items to verify.

How many walks an item takes follows from its length: :func:`walks_for` adds walks until, on windows edited to exactly the
largest distance, at least ``RECALL`` are found, and two more (more walks the longer the item is, as walks drift further apart).

Walking every window of a corpus would cost 3 m steps a word and walk, so windows are chosen first, by what no match can
lack: an item is cut into floor(RATE * m) + 1 pieces of which a match leaves one intact, so only windows around a piece of
some item are walked, and of those only windows of which m - floor(RATE * m) words occur in items.

Verification takes the windows of a document and item by the least distance that their shared words allow, and stops
when no window left can be nearer.

Only the benchmark is sent to the executors, at most ``ITEM_WORDS`` words in one scan of the documents; there is no shuffle.

Cases: null and empty texts and items match nothing, nor do texts shorter than an item. Items shorter than 1 / RATE
words must occur exactly. Repeated items are all reported, repeated rows row by row, null ids with a null id. Ids must be
integers or cast to them. Of equally near windows the first is reported. Texts and items of any length are used whole.
Extra columns pass through :func:`drop_contaminated`. Empty tables give empty results, and an empty benchmark keeps all
documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorespark.llm.common import U64, Words, forget, id_text, keeps, mix, powers, word_chunks

RATE = 0.2
RECALL = 0.998  # of windows at the largest distance, in calibration
SAMPLES, COORDINATES, REACH = 6, 2, 4  # keys of a walk, coordinates of a key, steps from one to the next at most
ITEM_WORDS = 2_000_000  # words of the items that are broadcast together


def allowed(m: int, rate: float = RATE) -> int:
    return int(rate * m + 1e-9)


def cgk_keys(windows: np.ndarray, walks: int, begin: int = 0) -> np.ndarray:
    """LSH keys of walks ``begin`` to ``walks`` (one row a window of word hashes, SAMPLES columns a walk)."""
    n, m = windows.shape
    keys = np.empty((n, (walks - begin) * SAMPLES), U64)
    forth = np.concatenate([windows, np.zeros((n, 1), U64)], 1)
    back = np.concatenate([windows[:, ::-1], np.zeros((n, 1), U64)], 1)
    rows = np.arange(n)
    for walk in range(begin, walks):
        rng = np.random.default_rng([walk, m])
        first = rng.integers(0, max(1, min(m, 1000) - REACH), SAMPLES)
        picked = np.stack([first, *(first + np.cumsum(rng.integers(1, REACH + 1, (COORDINATES - 1, SAMPLES)), 0))], 1)
        salts = rng.integers(0, 1 << 63, int(picked.max()) + 1, dtype=np.int64).view(U64)
        sums, at, text = np.zeros((n, SAMPLES), U64), np.zeros(n, np.int64), back if walk % 2 else forth
        for j, salt in enumerate(salts):
            word = text[rows, at]
            for k in np.flatnonzero((picked == j).any(1)):
                sums[:, k] = mix(sums[:, k] * U64(3) + word)
            at = np.minimum(at + (mix(word ^ salt) & U64(1)).astype(np.int64), m)
        keys[:, (walk - begin) * SAMPLES : (walk - begin + 1) * SAMPLES] = mix(sums + np.arange(1, SAMPLES + 1, dtype=U64) * U64(walk + 1) + mix(np.array([m], U64)))
    return keys


def edited(windows: np.ndarray, edits: int, rng: np.random.Generator) -> np.ndarray:
    """Copies of windows at ``edits`` edits: every other row by substitutions, the rest by as many deletions as insertions (of one edit a window of that size can only take a substitution)."""
    out = windows.copy()
    n, m = windows.shape
    for i in range(n):
        if i % 2 or edits < 2:
            out[i, rng.choice(m, edits, replace=False)] = rng.integers(1, 1 << 62, edits)
        else:
            left = np.delete(windows[i], rng.choice(m, edits // 2, replace=False))
            out[i] = np.insert(left, np.sort(rng.integers(0, len(left) + 1, edits // 2)), rng.integers(1, 1 << 62, edits // 2).astype(U64))
    return out


@lru_cache(maxsize=None)
def walks_for(m: int, rate: float = RATE, recall: float = RECALL, trials: int = 500) -> int:
    """Walks that find ``recall`` of all windows of m words at the largest distance. Seeded, so alike everywhere."""
    rng = np.random.default_rng(m)
    a = rng.integers(1, 1 << 62, (trials, m)).astype(U64)
    b = edited(a, allowed(m, rate), rng)
    met, walks = np.zeros(trials, bool), 0
    while min(met[::2].mean(), met[1::2].mean()) < recall:
        met |= (cgk_keys(a, walks + 2, walks) == cgk_keys(b, walks + 2, walks)).any(1)
        walks += 2
    return walks + 2


def size_class(m: int) -> int:
    """The length on which the walks of items of m words are calibrated: m up to 40 words, then the next of a geometric row; beyond 1,000 words that length stands for all."""
    size = 40
    while 40 < m and size < min(m, 1000):
        size = int(size * 1.25)
    return m if m <= 40 else size


def edit_distance(a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Word edit distance of row i of a to row i of b, same widths; ``most`` + 1 stands for anything larger. Banded."""
    n, m = a.shape
    big, width = most + 1, 2 * most + 1
    k = np.arange(width, dtype=np.int32)  # column k is the place j = i + k - most in b
    row = np.repeat(np.where((k >= most) & (k - most <= m), k - most, big).astype(np.int32)[None], n, 0)
    padded = np.pad(b, ((0, 0), (most, most)))
    for i in range(1, m + 1):
        new = row + (a[:, i - 1 : i] != padded[:, i - 1 : i - 1 + width])
        np.minimum(new[:, :-1], row[:, 1:] + 1, out=new[:, :-1])
        if i <= most:
            new[:, : most - i] = big
            new[:, most - i] = i
        # from the left: the least of new[k'] + k - k' over k' <= k
        row = np.minimum(np.minimum.accumulate(new - k, 1) + k, big).astype(np.int32)
        row[:, m + most - i + 1 :] = big
    return row[:, most]


class Benchmark:
    """Items as word hashes, the seeds of their pieces, and an index of their keys by length."""

    def __init__(self, items: list[tuple[int, str]], rate: float = RATE, walks: dict[int, int] | None = None):
        self.rate = rate
        self.ids, self.words = [], []
        kept = [(i, t) for i, t in items if t]
        for w in word_chunks(pa.array([t for _, t in kept], pa.string())):
            for x in range(w.doc_from, w.doc_to):
                h = w.hash[w.first[x - w.doc_from] : w.first[x - w.doc_from + 1]]
                if len(h):
                    self.ids.append(kept[x][0])
                    self.words.append(h.copy())
        size = np.array([len(h) for h in self.words], np.int64)
        walks = walks or calibrated(size.tolist(), rate)
        seeds: dict[int, list[tuple[int, int, int]]] = {}
        for x, h in enumerate(self.words):
            pieces = allowed(len(h), rate) + 1
            edge = [len(h) * p // pieces for p in range(pieces + 1)]
            for p in range(pieces):
                k = min(edge[p + 1] - edge[p], 4)
                seeds.setdefault(k, []).append((int(_gram(h, edge[p], k)), len(h), edge[p]))
        self.seeds = {}
        for k, rows in seeds.items():
            rows = sorted(set(rows))  # a seed tells lengths and places, the index then tells items
            value = np.array([r[0] for r in rows], U64)
            table = np.zeros(1 << 20, bool)
            table[(value & U64((1 << 20) - 1)).astype(np.int64)] = True
            self.seeds[k] = (value, np.array([r[1] for r in rows]), np.array([r[2] for r in rows]), table)
        self.bags = [np.unique(h) for h in self.words]
        self.index = {}
        for m in np.unique(size).tolist():
            mine = np.flatnonzero(size == m)
            n = walks[size_class(m)]
            key = cgk_keys(np.stack([self.words[i] for i in mine]), n)
            item = np.repeat(mine, key.shape[1])
            o = np.argsort(key.ravel(), kind="stable")
            self.index[m] = (n, key.ravel()[o], item[o], np.unique(np.concatenate([self.bags[i] for i in mine])))

    def windows(self, w: Words) -> dict[int, np.ndarray]:
        """By item length, the first words of the windows around an intact piece that hold enough words of items."""
        n, out = len(w.hash), {}
        sums = np.zeros(n + 1, U64)
        np.cumsum(w.hash * powers(n)[:n], dtype=U64, out=sums[1:])
        inv = powers(n, "inverse")
        for k, (value, size, offset, table) in self.seeds.items():
            if n < k:
                continue
            g = mix((sums[k:] - sums[:-k]) * inv[: n - k + 1])
            hit = np.flatnonzero(table[(g & U64((1 << 20) - 1)).astype(np.int64)])
            lo, hi = np.searchsorted(value, g[hit], "left"), np.searchsorted(value, g[hit], "right")
            many = hi - lo
            q = np.repeat(lo, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            place = np.repeat(hit, many) - offset[q]
            for m in np.unique(size[q]).tolist():
                out.setdefault(m, []).append(place[size[q] == m])
        found = {}
        for m, places in out.items():
            most = allowed(m, self.rate)
            mark = np.zeros(n + 2 * most + m + 2, np.int64)  # windows whose start is within ``most`` of a place
            p = np.unique(np.concatenate(places)) + m
            np.add.at(mark, p[p >= most] - most, 1), np.add.at(mark, p[p >= most] + most + 1, -1)
            s = np.flatnonzero(np.cumsum(mark)) - m
            s = s[(s >= 0) & (s + m <= n)]
            d = np.searchsorted(w.first, s, "right") - 1
            s = s[s + m <= w.first[d + 1]]
            known = np.concatenate([[0], np.cumsum(np.isin(w.hash, self.index[m][3]))])
            s = s[known[s + m] - known[s] >= m - most]
            if len(s):
                found[m] = s
        return found

    def candidates(self, m: int, window: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item): items of m words that share a key with a window."""
        walks, key, item, _ = self.index[m]
        at, who = [], []
        for i in range(0, len(window), step := max(1, 2_000_000 // (m + walks * SAMPLES))):
            mine = cgk_keys(window[i : i + step], walks).ravel()
            lo, hi = np.searchsorted(key, mine, "left"), np.searchsorted(key, mine, "right")
            many = hi - lo
            q = np.repeat(lo, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            pair = np.unique(np.stack([i + np.repeat(np.arange(len(mine)) // (walks * SAMPLES), many), item[q]], 1), axis=0)
            at.append(pair[:, 0]), who.append(pair[:, 1])
        return np.concatenate(at), np.concatenate(who)

    def matches(self, col: pa.Array) -> list[tuple[int, int, int, int]]:
        """(row, item, first word of the nearest window, its distance) for a column of texts."""
        found = []
        for w in word_chunks(col):
            for m, s in self.windows(w).items() if len(w.hash) else ():
                most, step = allowed(m, self.rate), max(1, 4_000_000 // m)
                for i in range(0, len(s), step):
                    part = s[i : i + step]
                    window = w.hash[part[:, None] + np.arange(m)]
                    at, item = self.candidates(m, window)
                    shared = np.zeros(len(at), np.int64)
                    for x in np.unique(item).tolist():
                        mine = np.flatnonzero(item == x)
                        shared[mine] = np.isin(window[at[mine]], self.bags[x]).sum(1)
                    ok = shared >= m - most
                    at, item, least = at[ok], item[ok], m - shared[ok]
                    row = np.searchsorted(w.first, part[at], "right") - 1
                    found += self._nearest(m, most, w.doc_from + row, item, part[at] - w.first[row], least, window[at])
        best: dict[tuple[int, int], tuple[int, int]] = {}
        for r, i, s, e in found:
            best[r, i] = min(best.get((r, i), (e, s)), (e, s))
        return sorted((r, i, s, e) for (r, i), (e, s) in best.items())

    def _nearest(self, m: int, most: int, row: np.ndarray, item: np.ndarray, start: np.ndarray, least: np.ndarray, window: np.ndarray) -> list[tuple[int, int, int, int]]:
        """The nearest window of each (row, item); ``least`` is what its distance is at least. Rounds of 1, 4, 16 ... windows each, most promising first."""
        o = np.lexsort((start, least, item, row))
        pair = np.zeros(len(o), np.int64)
        pair[1:] = np.cumsum((row[o][1:] != row[o][:-1]) | (item[o][1:] != item[o][:-1]))
        best, where = np.full(pair[-1] + 1 if len(o) else 0, most + 1), np.zeros(pair[-1] + 1 if len(o) else 0, np.int64)
        block, width = max(1, 4_000_000 // (m + 2 * most + 1)), 1
        while len(o):
            first = np.searchsorted(pair, pair)
            now = np.arange(len(o)) - first < width
            for i in range(0, int(now.sum()), block):
                x, p = o[now][i : i + block], pair[now][i : i + block]
                dist = edit_distance(window[x], np.stack([self.words[k] for k in item[x].tolist()]), most)
                for q, k, e in zip(p.tolist(), x.tolist(), dist.tolist()):
                    if (e, start[k]) < (best[q], start[where[q]]) and e <= most:
                        best[q], where[q] = e, k
            left = ~now & ((least[o] < best[pair]) | ((least[o] == best[pair]) & (start[o] < start[where[pair]])))
            o, pair, width = o[left], pair[left], 4 * width
        return [(int(row[k]), int(item[k]), int(start[k]), int(e)) for k, e in zip(where, best) if e <= most]


def calibrated(sizes: list[int], rate: float) -> dict[int, int]:
    """Walks by the classes of some lengths."""
    return {c: walks_for(c, rate) for c in sorted({size_class(m) for m in sizes})}


def _gram(h: np.ndarray, at: int, k: int) -> int:
    sums = np.zeros(k + 1, U64)
    np.cumsum(h[at : at + k] * powers(k)[:k], dtype=U64, out=sums[1:])
    return mix(sums[-1:])[0]


_READY: dict[int, Benchmark] = keeps({})


def _batches(benchmark: DataFrame, rate: float) -> list:
    """Broadcasts of (items, walks) with about ITEM_WORDS words each; a larger benchmark takes several scans."""
    spark = benchmark.sparkSession
    rows = benchmark.select(F.col("item_id").cast("long"), "text").filter("text IS NOT NULL")
    out, held, words = [], [], 0
    size = lambda items: [int(w.first[i + 1] - w.first[i]) for w in word_chunks(pa.array([t for _, t in items], pa.string())) for i in range(w.doc_to - w.doc_from)]
    ship = lambda: spark.sparkContext.broadcast((held, calibrated([m for m in size(held) if m], rate)))
    for r in rows.orderBy("item_id", "text").toLocalIterator():
        held.append((r[0], r[1]))
        words += len(r[1]) // 6 + 1
        if words >= ITEM_WORDS:
            out.append(ship())
            held, words = [], 0
    return [*out, ship()] if held or not out else out


def _ready(shipped, rate: float) -> Benchmark:
    items, walks = shipped.value
    key = hash((rate, tuple(items)))
    forget(_READY)
    if key not in _READY:
        _READY.clear()
        _READY[key] = Benchmark(items, rate, walks)
    return _READY[key]


def leaks(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, start_word, n_words, distance): for each document and item that it holds, the nearest window."""

    def scan(shipped):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bench = _ready(shipped, rate)
            for b in batches:
                ids = b.column(0).to_pylist()
                rows = bench.matches(b.column(1))
                cols = [pa.array([ids[r] for r, *_ in rows], pa.int64()), pa.array([bench.ids[i] for _, i, _, _ in rows], pa.int64())]
                cols += [pa.array([r[2] for r in rows], pa.int32()), pa.array([len(bench.words[i]) for _, i, _, _ in rows], pa.int32()), pa.array([r[3] for r in rows], pa.int32())]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "item_id", "start_word", "n_words", "distance"])

        return run

    texts = id_text(docs, id_col, text_col)
    parts = [texts.mapInArrow(scan(s), "doc_id long, item_id long, start_word int, n_words int, distance int") for s in _batches(benchmark, rate)]
    return reduce(DataFrame.unionByName, parts)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, text_col: str = "text") -> DataFrame:
    """The rows that hold no item, with all their columns."""
    def cleaner(shipped):
        @F.arrow_udf("boolean")
        def clean(col: pa.Array) -> pa.Array:
            hit = {r for r, *_ in _ready(shipped, rate).matches(col)}
            return pa.array([i not in hit for i in range(len(col))])

        return clean

    for shipped in _batches(benchmark, rate):
        docs = docs.filter(cleaner(shipped)(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))))
    return docs
