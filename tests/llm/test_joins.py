"""Jaccard join, suffix dedup, decontamination and the pipeline on awkward documents and against brute force."""

import random

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from lorespark.llm import decontaminate, ngram_join, pii, quality, suffix_dedup
from lorespark.llm.common import plain_words, word_chunks
from tests.llm import cases


def test_words_equal_the_plain_definition():
    r = random.Random(0)
    texts = ["", "a", " a", "É-é x_y", "🙂🙂 a🙂", "A1 b2,c3"] + ["".join(r.choice("aB1 ,é🙂\n-") for _ in range(40)) for _ in range(200)]
    seen = {}
    for most in (1, 50, 1 << 20):
        got = []
        for w in word_chunks(pa.array(texts), most):
            got += [w.hash[w.first[i] : w.first[i + 1]].tolist() for i in range(len(w.first) - 1)]
        assert [len(g) for g in got] == [len(plain_words(t)) for t in texts]
        for g, t in zip(got, texts):
            for h, word in zip(g, plain_words(t)):
                assert seen.setdefault(word, h) == h
    assert len(set(seen.values())) == len(seen)


# ----- Jaccard join
def gram_set(text, n=2):
    w = plain_words(text)
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute_pairs(texts, t=0.6):
    sets = {d: gram_set(x) for d, x in texts.items()}
    ids = sorted(d for d in sets if sets[d])
    return {(a, b): round(len(sets[a] & sets[b]) / len(sets[a] | sets[b]), 6) for i, a in enumerate(ids) for b in ids[i + 1 :] if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= t - 1e-12}


def classes_of(texts, t=0.6):
    """(class, links) of each id by brute force; texts without a word stand alone."""
    first, root, links = {}, {d: d for d in texts}, dict.fromkeys(texts, 0)
    for d in sorted(texts):
        if plain_words(texts[d]):
            first.setdefault(texts[d], d)
    pairs = brute_pairs({d: x for x, d in first.items()}, t)
    for a, b in pairs:
        links[a], links[b] = links[a] + 1, links[b] + 1
    for _ in texts:
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    rep = {d: first.get(texts[d], d) for d in texts}
    return {d: (root[rep[d]], links[rep[d]]) for d in texts}


def test_jaccard_cases(spark):
    rows = ngram_join.similar(cases.docs(spark)).collect()
    texts = {d: t for d, t in cases.TEXTS if d is not None}
    assert {r["doc_id"]: (r["class_id"], r["links"]) for r in rows} == classes_of(texts) and len(rows) == len(texts)
    assert ngram_join.similar(cases.docs(spark, [])).count() == 0


@pytest.mark.parametrize("limits", [{"MOST_BROADCAST": 0}, {"HOT": 3, "BLOCK": 4}, {"PACKET": 50}])
def test_jaccard_with_shuffled_sides_split_groups_and_small_packets(spark, monkeypatch, limits):
    for k, v in limits.items():
        monkeypatch.setattr(ngram_join, k, v)
    texts = {k: cases.changed(cases.prose(k % 3, 30 + 40 * (k % 3)), k, 0.05) if k % 9 else cases.prose(k % 3, 20) for k in range(60)}
    d = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r["doc_id"]: (r["class_id"], r["links"]) for r in ngram_join.similar(d).collect()} == classes_of(texts)
    first = {}
    for k in sorted(texts):
        first.setdefault(texts[k], k)
    assert {(x["doc_a"], x["doc_b"]): x["jaccard"] for x in ngram_join.jaccard_pairs(d).collect()} == brute_pairs({v: k for k, v in first.items()})


def test_jaccard_equals_brute_force_on_many_near_copies(spark):
    r = random.Random(8)
    texts = {}
    for base in range(6):
        t = cases.prose(100 + base, r.choice((3, 8, 40, 150)))
        for k in range(25):
            texts[len(texts)] = cases.changed(t, len(texts), r.choice((0.0, 0.03, 0.08, 0.15))) if k else t
    texts |= {1000 + k: cases.prose(500 + k, r.randint(1, 60)) for k in range(60)}
    d = spark.createDataFrame([(k, v) for k, v in texts.items()], "doc_id long, text string")
    first = {}
    for k in sorted(texts):
        first.setdefault(texts[k], k)
    want = brute_pairs({v: k for k, v in first.items()})
    got = {(x["doc_a"], x["doc_b"]): x["jaccard"] for x in ngram_join.jaccard_pairs(d).collect()}
    assert got == want and len(want) > 150


def test_suffix_filter_is_a_lower_bound_and_cuts():
    r = np.random.default_rng(1)
    sets = [np.unique(r.integers(0, 60, r.integers(0, 40))) for _ in range(60)]
    size = np.array([len(x) for x in sets])
    value, owner, stop = np.concatenate(sets), np.repeat(np.arange(60), size), np.cumsum(size)
    a, b = (x.ravel() for x in np.meshgrid(np.arange(60), np.arange(60)))
    got = ngram_join.suffix_bound(value, owner * 60 + value, owner, 60, (stop[a] - size[a], stop[a]), (stop[b] - size[b], stop[b]))
    want = np.array([len(np.setxor1d(sets[i], sets[j])) for i, j in zip(a, b)])
    assert (got <= want).all() and (got > np.abs(size[a] - size[b])).mean() > 0.3 and (got[a == b] == 0).all()


def test_components_are_whole_groups(spark):
    edges = [(1, 9), (9, 5), (5, 7), (20, 21), (3, 21), (30, 31)] + [(100 + i, 101 + i) for i in range(20)]
    got = {r["doc_id"]: r["root"] for r in ngram_join.components(spark.createDataFrame(edges, "doc_a long, doc_b long")).collect()}
    assert got == {1: 1, 9: 1, 5: 1, 7: 1, 20: 3, 21: 3, 3: 3, 30: 30, 31: 30} | {100 + i: 100 for i in range(21)}


def test_keep_one_cases(spark):
    kept = ngram_join.keep_one(cases.docs(spark))
    assert kept.columns == cases.docs(spark).columns
    ids = sorted((r["doc_id"] for r in kept.collect()), key=lambda x: (x is None, x))
    assert ids == [1, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15, 16, 17, 19, 20, None, None]
    assert ngram_join.keep_one(cases.docs(spark, [])).count() == 0


# ----- suffix dedup
def brute_spans(texts, length):
    from collections import defaultdict

    at = defaultdict(list)
    for d in sorted(texts):
        w = plain_words(texts[d])
        for s in range(len(w) - length + 1):
            at[tuple(w[s : s + length])].append((d, s))
    cover = defaultdict(dict)
    for places in at.values():
        if len(places) > 1:
            for k, (d, s) in enumerate(places):
                for p in range(s, s + length):
                    cover[d][p] = cover[d].get(p, False) or k > 0
    out = set()
    for d, c in cover.items():
        ps = sorted(c)
        start = 0
        for i in range(1, len(ps) + 1):
            if i == len(ps) or ps[i] != ps[i - 1] + 1:
                out.add((d, ps[start], i - start, sum(c[p] for p in ps[start:i])))
                start = i
    return out


def test_spans_cases(spark):
    rows = {(r["doc_id"], r["start_word"], r["n_words"], r["removable_words"]) for r in suffix_dedup.repeated_spans(cases.docs(spark)).collect()}
    texts = {d: t for d, t in cases.TEXTS if d is not None and t}
    assert rows == brute_spans(texts, 50)
    assert {r[0] for r in rows} >= {12, 13} and (12, 40, 60, 0) in rows and (13, 30, 60, 60) in rows
    assert suffix_dedup.repeated_spans(cases.docs(spark, [])).count() == 0


def test_spans_equal_brute_force_with_short_windows(spark):
    r = random.Random(2)
    texts = {i: " ".join(r.choice("ab") if r.random() < 0.9 else r.choice("cdef") for _ in range(r.randint(0, 120))) for i in range(60)}
    d = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {tuple(x) for x in suffix_dedup.repeated_spans(d, length=12, k=4).collect()}
    assert got == brute_spans(texts, 12)


def test_spans_of_repeats_split_anchors_and_small_slices(spark, monkeypatch):
    r = random.Random(12)
    junk = lambda: " ".join([r.choice(("the", "of"))] * r.randint(15, 120))
    texts = {i: " ".join([cases.prose(i, r.randint(0, 20)), junk() if i % 3 else cases.PASSAGE, cases.prose(1000 + i, r.randint(0, 20))]) for i in range(40)}
    rows = [*texts.items(), *list(texts.items())[:6]]  # repeated rows are no repeats
    texts[100] = cases.prose(2000, 70)
    rows += [(100, texts[100])] * 3
    want = brute_spans(texts, 50)
    assert 100 not in {d for d, *_ in want}
    for limits in ({}, {"HOT": 2}, {"HOT": 2, "SLICE_BYTES": 1, "MOST_BROADCAST": 0}):
        for k, v in limits.items():
            monkeypatch.setattr(suffix_dedup, k, v)
        assert {tuple(x) for x in suffix_dedup.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()} == want


def test_equal_runs_are_one_and_repeated_rows_are_not_equals():
    words = [b"the " * 60] * 30_000 + [b"a b", b"a b", b"c"]
    doc = np.array([*range(30_000), 7, 7, 8])
    start = np.array([5] * 30_000 + [3, 3, 3])
    first, again, rest = suffix_dedup.equal_runs(words, doc, start, np.zeros(len(doc), bool))
    assert {words[i][:3]: (int(doc[i]), bool(x)) for i, x in zip(first, again)} == {b"the": (0, True), b"a b": (7, False), b"c": (8, False)}
    assert sorted(doc[rest]) == list(range(1, 30_000))  # of which only the spans are left


def test_merge_sort_orders_suffixes():
    r = np.random.default_rng(3)
    h = r.integers(0, 3, 400).astype(np.uint64)
    length = 9
    suffix = r.permutation(400 - length)
    order, equal = suffix_dedup.sort_suffixes(h, suffix, np.zeros(len(suffix), np.int64), length)
    keys = [tuple(h[s : s + length].tolist()) for s in suffix[order]]
    assert keys == sorted(keys)
    assert equal.tolist() == [False] + [a == b for a, b in zip(keys, keys[1:])]


def test_hash_collisions_are_undone():
    words = [b"a", b"b", b"c", b"a", b"x", b"c"]
    equal = suffix_dedup._verified(lambda x, y: b" ".join(words[x:y]), np.array([0, 1]), np.array([0, 3]), np.array([0, 1]), np.array([False, True]), 3)
    assert equal.tolist() == [False, False]


# ----- decontamination
def brute_leak(text, item, rate=decontaminate.RATE):
    w, q = plain_words(text), plain_words(item)
    best, most = None, decontaminate.allowed(len(q), rate)
    for s in range(len(w) - len(q) + 1):
        prev = list(range(len(q) + 1))
        for i, x in enumerate(w[s : s + len(q)], 1):
            cur = [i]
            for j, y in enumerate(q, 1):
                cur.append(min(prev[j - 1] + (x != y), prev[j] + 1, cur[-1] + 1))
            prev = cur
        if prev[-1] <= most and (best is None or prev[-1] < best[0]):
            best = (prev[-1], s)
    return best


def test_leaks_cases(spark):
    rows = decontaminate.leaks(cases.docs(spark), cases.items(spark)).collect()
    assert sorted((r["doc_id"], r["item_id"], r["start_word"], r["n_words"], r["distance"]) for r in rows) == [(14, 1, 20, 30, 0)] * 2 + [(15, 1, 20, 30, 3)] * 2
    kept = decontaminate.drop_contaminated(cases.docs(spark), cases.items(spark))
    assert kept.columns == cases.docs(spark).columns and kept.count() == len(cases.ROWS) - 2
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.leaks(cases.docs(spark), none).count() == 0
    assert decontaminate.drop_contaminated(cases.docs(spark), none).count() == len(cases.ROWS)
    assert decontaminate.leaks(cases.docs(spark, []), cases.items(spark)).count() == 0


def test_recall_against_brute_force():
    r = random.Random(6)
    items = [(k, cases.prose(900 + k, r.randint(5, 60))) for k in range(40)]
    bench = decontaminate.Benchmark(items)
    texts, want = [], {}
    for _ in range(400):
        k = r.randrange(len(items))
        w = items[k][1].split()
        for _ in range(r.randint(0, decontaminate.allowed(len(w)))):
            i = r.randrange(len(w))
            kind = r.random()
            w[i : i + 1] = [f"q{r.random():.6f}".replace(".", "")] if kind < 0.6 else [] if kind < 0.8 else [w[i], "zz"]
        texts.append(f"{cases.prose(r.randrange(10**6), 15)} {' '.join(w)} {cases.prose(r.randrange(10**6), 15)}")
        best = brute_leak(texts[-1], items[k][1])
        if best:
            want[len(texts) - 1, k] = best
    got = {(row, i): (e, s) for row, i, s, e in bench.matches(pa.array(texts))}
    found = [k for k in want if k in got]
    assert len(found) >= 0.99 * len(want) and len(want) > 200
    assert sum(got[k] == want[k] for k in found) >= 0.95 * len(found)
    assert all(brute_leak(texts[row], items[i][1]) is not None for row, i in got)


def test_all_found_at_the_largest_distance():
    r = random.Random(16)
    for m in (100, 150, 200, 300):
        most = decontaminate.allowed(m)
        items = [(k, " ".join(f"w{r.randrange(10**6)}" for _ in range(m))) for k in range(30)]
        texts = []
        for k, text in items:
            w = text.split()
            if k % 2:  # as many words out as in
                for i in sorted(r.sample(range(m), most // 2), reverse=True):
                    del w[i]
                for i in sorted(r.sample(range(len(w)), most // 2), reverse=True):
                    w.insert(i, f"q{r.randrange(10**6)}")
            else:
                for i in r.sample(range(m), most):
                    w[i] = f"q{r.randrange(10**6)}"
            texts.append(f"{cases.prose(r.randrange(10**6), 15)} {' '.join(w)} {cases.prose(r.randrange(10**6), 15)}")
        got = {(row, i): (e, s) for row, i, s, e in decontaminate.Benchmark(items).matches(pa.array(texts))}
        assert len(set(got) & {(k, k) for k in range(30)}) >= 29 and all(r == i for r, i in got)
        if m == 100:
            assert sum(got.get((k, k)) == brute_leak(texts[k], items[k][1]) for k in range(30)) >= 28


def test_edit_distance_is_exact():
    r = random.Random(7)
    for _ in range(200):
        m = r.randint(1, 12)
        a, b = [r.choice("abc") for _ in range(m)], [r.choice("abc") for _ in range(m)]
        prev = list(range(m + 1))
        for i, x in enumerate(a, 1):
            cur = [i]
            for j, y in enumerate(b, 1):
                cur.append(min(prev[j - 1] + (x != y), prev[j] + 1, cur[-1] + 1))
            prev = cur
        most = r.randint(0, m)
        code = lambda s: np.array([[ord(c) for c in s]], np.uint64)
        assert decontaminate.edit_distance(code(a), code(b), most)[0] == min(prev[m], most + 1)


def test_cgk_keys_of_edited_windows_meet_at_the_target():
    r = np.random.default_rng(9)
    for m in (6, 30, 100, 300):
        walks = decontaminate.walks_for(decontaminate.size_class(m))
        a = r.integers(1, 1 << 60, (300, m)).astype(np.uint64)
        near = decontaminate.edited(a, decontaminate.allowed(m), r)
        met = (decontaminate.cgk_keys(a, walks) == decontaminate.cgk_keys(near, walks)).any(1)
        assert met.mean() >= 0.985, (m, walks, met.mean())  # 300 draws of 0.998 lie above it
        far = r.integers(1, 1 << 60, (300, m)).astype(np.uint64)
        assert not (decontaminate.cgk_keys(a, walks) == decontaminate.cgk_keys(far, walks)).any()


def test_a_very_long_item_ends_soon():
    import time

    item = " ".join(f"w{k % 7919}" for k in range(20_000))
    w = item.split()
    w[500], w[9000:9002] = "changed", ["only"]
    bench = decontaminate.Benchmark([(1, item)])
    began = time.time()
    got = bench.matches(pa.array([cases.prose(3, 100) + " " + " ".join(w) + " and more", cases.LONG]))
    assert [(r, i, e) for r, i, _, e in got] == [(0, 0, 4)] and time.time() - began < 60


# ----- pipeline
def test_pipeline_equals_brute_force(spark, tmp_path):
    cases.docs(spark).write.parquet(str(tmp_path / "documents.parquet"))
    cases.items(spark).write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    good = {r["doc_id"] for r in quality.score(cases.docs(spark)).filter("keep").collect()}
    texts = {d: t for d, t in cases.TEXTS if d in good and d is not None}
    root = {d: d for d in texts}
    pairs = brute_pairs(texts)
    for _ in texts:
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    want = {d for d in texts if root[d] == d and not brute_leak(texts[d], cases.ITEM)}
    assert set(got) - {None} == want
    model = pii.model()
    from lorespark.llm import bpe

    coder = bpe.Bpe(bpe.load_ranks())
    for d in want:
        assert coder.decode(np.array(got[d]["token_ids"], int)) == model.redact(texts[d])


def test_pipeline_keeps_columns_and_survives_empty_tables(spark, tmp_path):
    cases.docs(spark, []).write.parquet(str(tmp_path / "documents.parquet"))
    cases.items(spark).write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    d = cases.docs(spark)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, d, str(tmp_path)).columns == d.columns
    assert 4 <= len(corpus_pipeline.STAGES) <= 5


def test_packed_pairs_and_columns_come_back():
    from lorespark.llm.common import squeeze, stretch
    from lorespark.llm.ngram_join import _pack_pairs, _unpack_pairs

    r = np.random.default_rng(3)
    m = np.unique(np.sort(r.integers(-50, 10**12, (500, 2)), 1), axis=0)
    m = np.concatenate([m, [[10**13, 10**13 + k] for k in range(1, 60)]])
    m = np.concatenate([m, r.integers(1, 900, (len(m), 2))], 1).astype(np.int64)
    assert (_unpack_pairs(_pack_pairs(m)) == m).all()
    x, y = np.array([-1, 0, 2**62]), np.array([7, 7, 7])
    assert [list(c) for c in stretch(squeeze(x, y), 2)] == [list(x), list(y)]
    assert [list(c) for c in stretch(squeeze(x[:0], y[:0]), 2)] == [[], []]


def test_meetings_of_a_cluster_take_little_room():
    from lorespark.llm.ngram_join import _pack_pairs, meeting_place

    ids = np.unique(np.random.default_rng(4).integers(0, 250_000, 700))
    a, b = np.triu_indices(len(ids), 1)
    m = np.stack([ids[a], ids[b], np.ones(len(a), np.int64), np.full(len(a), 9)], 1)
    of = meeting_place(m[:, 0], m[:, 1], 100)
    assert (meeting_place(m[::-1, 0], m[::-1, 1], 100)[::-1] == of).all()  # one place a pair
    assert np.bincount(of, minlength=100).max() < 3 * len(m) / 100
    assert sum(len(_pack_pairs(m[of == k])) for k in range(100)) < len(m)  # bytes; 2.9 a pair where pairs are scattered
