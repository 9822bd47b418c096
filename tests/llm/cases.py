"""Awkward documents: nulls anywhere, empty and very long texts, repeated rows, extra columns named like internal ones."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, bucket int, id_ long, gone_ long, shard_ string, n long, `key` string, rep long, token_ids string"


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    word = lambda: "".join(r.choice(("an", "er", "th", "en", "re", "on", "ti", "st", "é")) for _ in range(r.randint(1, 4)))
    return " ".join(r.choice(("the", "of", "and", "to", "in")) if r.random() < 0.3 else word() for _ in range(n))


PASSAGE = prose(99, 60)
LONG = prose(5, 30_000)
ITEM = prose(77, 30)


def changed(text: str, seed: int, share: float) -> str:
    r = random.Random(seed)
    w = text.split()
    for i in r.sample(range(len(w)), int(share * len(w))):
        w[i] = f"zz{seed}x{i}"
    return " ".join(w)


BASE = prose(1, 200)
TEXTS = [
    (1, BASE), (2, changed(BASE, 2, 0.04)), (3, BASE), (4, changed(BASE, 4, 0.04)), (5, prose(6, 150)), (6, None), (7, ""), (8, " \n\t "), (9, "!!! ???"), (10, "one"),
    (11, LONG), (12, prose(12, 40) + " " + PASSAGE + " " + prose(13, 40)), (13, prose(14, 30) + " " + PASSAGE), (14, prose(15, 20) + " " + ITEM + " " + prose(16, 20)),
    (15, prose(17, 20) + " " + changed(ITEM, 3, 0.1) + " " + prose(18, 20)), (16, f"{prose(19, 20)} mail ab.12@mail3.example.com or +1 (212) 555-0147, {prose(20, 10)} 4539578763621486."),
    (17, "the the " * 200), (5, prose(6, 150)), (None, prose(21, 30)), (None, None), (18, "one"), (19, 'x token = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b" y'), (20, "naïve ÉTÉ 🙂 ﬁ ½ x²   end"),
]
ROWS = [(i, t, None if k % 3 == 0 else "en", None if k % 5 == 0 else f"src{k % 4}", None, "r", 1, 2, 3, "s", 4, "k", 5, "t") for k, (i, t) in enumerate(TEXTS)]


def docs(spark, rows=None):
    return spark.createDataFrame(ROWS if rows is None else rows, SCHEMA).repartition(3)


def items(spark):
    return spark.createDataFrame([(1, ITEM), (2, None), (3, ""), (4, "three short words"), (None, prose(123, 20)), (1, ITEM)], "item_id long, text string")
