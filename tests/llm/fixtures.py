"""Small tables with nulls, empty and long texts, ties, repeated rows and clashing column names."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, chunk int, sig string, id long, row int"


def rows():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared, long_ = text(45), text(6000)
    near = [word() for _ in range(120)]
    out = [(0, None), (1, ""), (2, " \t\n"), (3, "one"), (4, "one"), (5, long_), (6, long_ + " tail"), (None, "no id at all"),
           (None, None), (7, shared), (8, text(30) + "\n" + shared + "\n" + text(30)), (9, shared + " " + shared),
           (10, "x\n\ny\nz\n\n"), (11, "a\nx\n\ny\nz"), (12, "  two  spaces▁mark \x0b tab\tend "), (13, "漢字 🙂 and more"),
           (14, " ".join(near)), (15, " ".join(near)), (15, " ".join(near)), (16, " ".join(near[:60] + ["new"] + near[61:])),
           (17, " ".join(near[1:])), (18, "1234 5678 .,;"), (20, "the " * 50)]
    out += [(30 + i, text(rng.randint(1, 60)) + "\n" + text(8)) for i in range(30)]
    out += [(100 + i, out[i][1]) for i in range(20)]
    out.append((19, "Licensed under CC BY-NC 4.0."))
    return [(i, t, None if i in (3, 31) else ("aa", "bb")[(i or 0) % 2], None if i == 5 else f"s{(i or 0) % 3}",
             len(t) if t is not None else None, 1, "s", 7, 2) for i, t in out]


def documents(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return (text or "").encode().split()
