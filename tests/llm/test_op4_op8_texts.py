"""Special tokens in packed texts; toxicity scores and spans against enumerating all label sequences."""

import itertools
import math
import random

import numpy as np

from staysignal.llm import op4_packing as pk
from staysignal.llm import op8_toxicity as tox


def test_ids_of_texts_with_special_tokens():
    from tokenizers import Tokenizer
    whole, ids = Tokenizer.from_file(pk.vocabulary_path()), pk.encoder(pk.vocabulary_path())
    rng = random.Random(1)
    parts = ["<|endoftext|>", "<|endof", "text|>", " ", "é", "word", "漢", "\n", "<|", "1"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 9))) for _ in range(3000)]
    assert any(50256 in ids(t) for t in texts)
    assert all(ids(t) == whole.encode(t, add_special_tokens=False).ids for t in texts)


def score_brute(model, text):
    """(score, spans) by summing over all labelings of every line."""
    ps, spans, at = [], [], 0
    for line in (text or "").split("\n"):
        words = []
        for w in line.split():
            start = line.index(w, words[-1][1] if words else 0)
            words.append((start, start + len(w), w.lower()))
        z, mass = 0.0, [0.0] * len(words)
        for y in itertools.product((0, 1), repeat=len(words)):
            e = sum(yi * model.emission(w[2]) for yi, w in zip(y, words)) + sum(model.trans[a][b] for a, b in zip(y, y[1:]))
            z += math.exp(e)
            for k, yi in enumerate(y):
                mass[k] += yi * math.exp(e)
        for (s, t, _), m in zip(words, mass):
            ps.append(m / z)
            if m / z >= 0.5:
                spans.append((at + s, at + t))
        at += len(line) + 1
    n, expected = max(1, len(ps)), sum(ps)
    x = [1.0, max(ps, default=0.0), math.log1p(expected), math.log1p(100 * expected / n)]
    return 1 / (1 + math.exp(-sum(a * b for a, b in zip(x, model.document)))), spans


def test_scores_and_spans_against_enumeration(spark):
    model = tox.Model({"bad": 3.0, "bad*": 0.7, "wors*": 2.0, "fine": -2.0, "badly": 1.0}, -1.5,
                      np.array([[0.4, -0.6], [-0.3, 0.9]]), np.array([-3.0, 2.0, 1.0, 0.5]))
    rng = random.Random(2)
    texts = [(i, "\n".join(" ".join(rng.choice(["bad", "Badly,", "worst", "fine", "so", "(bad)"]) for _ in range(rng.randint(0, 7)))
                           for _ in range(rng.randint(1, 4))) + rng.choice(["", " ", "\n\n"])) for i in range(60)]
    texts += [(100, None), (101, ""), (102, " \t ")]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r for r in tox.score(docs, model).collect()}
    assert len(got) == len(texts)
    for i, t in texts:
        score, spans = score_brute(model, t)
        assert math.isclose(got[i]["score"], score, rel_tol=1e-9)
        assert [(s["start"], s["end"]) for s in got[i]["spans"]] == spans
    assert any(got[i]["spans"] for i, _ in texts)


def test_training_is_bounded_and_repeatable(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(["nice", "day", "tree", "river", "cloud"]) for _ in range(30))
             + (" vilest vile words" if i % 2 else "")) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)], "doc_id long, toxic int")
    usable = tox.F.lit(True)
    size = sum(len(t) for _, t in rows)
    few = tox._labelled(docs, labels, usable, 1500, size // 4)
    assert 0 < few.count() < 200
    a, b = tox.fit(docs, labels, usable), tox.fit(docs, labels, usable)
    assert a.weights == b.weights and (a.document == b.document).all()
    scored = {r["doc_id"]: r for r in tox.score(docs, a).collect()}
    assert all((scored[i]["score"] >= 0.5) == bool(i % 2) for i in range(400))
    hit = scored[1]["spans"]
    assert {rows[1][1][s["start"]:s["end"]] for s in hit} <= {"vilest", "vile", "words"} and hit
