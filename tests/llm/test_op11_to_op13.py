"""Token counts against the library, negatives and spelling variants against brute force and their SQL."""

import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from staysignal.llm import op11_token_counts as tok
from staysignal.llm import op12_negatives as neg
from staysignal.llm import op13_spelling as sp
from tests.llm.fixtures import documents, empty, rows

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(tok.vocabulary_path())


@pytest.fixture(scope="module")
def own():
    return tok.Coder(tok.vocabulary_path())


# ---- token counts -------------------------------------------------------------------------------------------------
def lengths(library, texts):
    return [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_every_character_counts_as_in_the_library(library, own):
    table = tok.LengthTable(["the", "a"], own.lengths(["the", "a"]))
    points = [i for i in (*range(0x3000), *range(0xFB00, 0xFF00), *range(0x1F600, 0x1F640)) if not 0xD800 <= i < 0xE000]
    texts = [f"a{chr(i)}b {chr(i)}'s1{chr(i)}{chr(i)}'ll" for i in points]
    assert tok.count_texts(texts, table, own).tolist() == lengths(library, texts)


@pytest.mark.parametrize("segment", [1 << 20, 8])
def test_counts_of_mixed_texts(library, own, segment, monkeypatch):
    monkeypatch.setattr(tok, "SEGMENT", segment)
    rng = random.Random(1)
    parts = ["a", "B", "é", "É", "'", "'s", "1", "²", " ", "\n", "\xa0", "́", "<|endoftext|>", "<|ENDOFTEXT|>", "<|",
             "İ", "漢", "字", "ß", "…", "“", "🙂", "ſ", "Σ", "\x85", "\x1f", "_", "-", "Ʀ"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(5000)]
    assert tok.count_texts(texts, tok.LengthTable([], []), own).tolist() == lengths(library, texts)


def test_long_unbroken_text(library, own):
    texts = ["ab" * 100_000, None, "", "x " * 300_000 + "1" * 50_000]
    assert tok.count_texts(texts, tok.LengthTable(["x"], own.lengths(["x"])), own).tolist() == \
        [0 if not t else n for t, n in zip(texts, lengths(library, [t or "" for t in texts]))]


def test_table_finds_exactly_its_words():
    import pyarrow as pa
    rng = random.Random(2)
    words = sorted({"".join(rng.choice("abcé") for _ in range(rng.randint(1, 7))) for _ in range(3000)})
    table = tok.LengthTable(words, list(range(1, len(words) + 1)))
    asked = words + [w + "x" for w in words]
    assert table.look_up(pa.array(asked)).tolist() == list(range(1, len(words) + 1)) + [-1] * len(words)
    assert (table.slots >= 0).sum() == len(words) <= len(table.slots) // 2


def test_worker_cache_is_bounded(own, monkeypatch):
    monkeypatch.setattr(tok, "CACHE_WORDS", 10)
    fresh = tok.Coder(tok.vocabulary_path())
    for i in range(50):
        assert fresh.lengths([f"word{i}", "the"]) == own.lengths([f"word{i}", "the"])
        assert len(fresh.known) <= 12


@pytest.mark.parametrize("words", [1 << 16, 5])
def test_token_counts_of_tables(spark, library, words):
    for docs in (documents(spark), spark.read.parquet(f"{SF}/documents.parquet")):
        got = Counter(map(tuple, tok.token_counts(docs, words=words).collect()))
        want = Counter()
        for r in docs.collect():
            n = len(library.encode(r["text"] or "", add_special_tokens=False).ids)
            want[(r["doc_id"], len((r["text"] or "").encode()), n, n > 2048)] += 1
        assert got == want
    assert tok.digest(empty(spark)).count() == 0


# ---- hard negatives -----------------------------------------------------------------------------------------------
@pytest.mark.parametrize("most", [3, 700, 5_000_000])
def test_residue_products_are_exact(most):
    rng = np.random.default_rng(most)
    a, b = rng.integers(-most, most + 1, (7, 600)), rng.integers(-most, most + 1, (9, 600))
    bound = max(int((x.astype(object) ** 2).sum(axis=1).max()) for x in (a, b))
    primes = neg.moduli(bound)
    assert np.prod([int(p) for p in primes], dtype=object) > 2 * bound
    assert (neg.products(a, b, primes) == (a.astype(object) @ b.T.astype(object))).all()


def test_scores_beyond_a_long_are_an_error():
    with pytest.raises(OverflowError):
        neg.moduli(1 << 62)


def test_first_k_keeps_the_first_of_equal_scores():
    rng = np.random.default_rng(3)
    for k in (1, 3, 50):
        s, usable = rng.integers(0, 4, (20, 30)), rng.random((20, 30)) < 0.6
        i, j = neg.first_k(s, usable, k)
        got = sorted(zip(i.tolist(), j.tolist()))
        want = sorted((r, c) for r in range(20) for c in sorted((c for c in range(30) if usable[r, c]),
                                                               key=lambda c: (-s[r, c], c))[:k])
        assert got == want


def test_score_window_in_integers():
    for bound in range(-40, 41):
        low, high = int(neg._ceil_share(np.array(bound), 30)), -int(neg._ceil_share(np.array(-bound), 90))
        assert [s for s in range(-60, 61) if 30 * bound <= 100 * s <= 90 * bound] == [s for s in range(-60, 61) if low <= s <= high]


VECTORS = "vec_id long, embedding array<float>, label int, score double, c int"


def vectors(n=450, width=6, seed=4):
    rng = random.Random(seed)
    hot = [0.5] * width
    out = [(i, hot if i % 3 == 0 else [rng.gauss(0, 0.6) for _ in range(width)], rng.randint(0, 9), 1.0, 2) for i in range(n)]
    out[5] = (5, None, 1, 1.0, 2)
    out[6] = (6, [0.1] * (width - 1) + [None], 1, 1.0, 2)
    out[8] = (8, [float("nan")] * width, 1, 1.0, 2)
    out[9] = (9, [float("-inf")] * width, 1, 1.0, 2)
    out[10] = (10, hot, None, 1.0, 2)
    out[11] = (11, [0.0] * width, 3, 1.0, 2)
    return out + [(None, hot, 3, 1.0, 2), out[200], out[201], (1, [0.25] * width, 3, 1.0, 2)]


def negatives_brute(data):
    best = {}
    for i, v, lab, *_ in data:
        if i is None or v is None or lab is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        c = [int(np.floor(256 * float(np.float32(x)))) for x in v]
        lab = (lab + 1) % 10 if i % 7 == 0 else lab
        best[i] = min(best.get(i, (lab, c)), (lab, c))
    score = lambda a, b: sum(x * y for x, y in zip(best[a][1], best[b][1]))
    out = []
    for a in (i for i in best if i % 100 == 0):
        ranked = sorted((-score(a, b), b) for b in best if b != a)
        for ps, p in [(-s, b) for s, b in ranked if best[b][0] == best[a][0]][:5]:
            fit = [(b, -s) for s, b in ranked if best[b][0] != best[a][0] and 30 * ps <= -100 * s <= 90 * ps][:10]
            out += [(a, p, k, b, ps, s) for k, (b, s) in enumerate(fit, 1)]
    return sorted(out)


def test_negatives_against_brute_force(spark, monkeypatch):
    data = vectors()
    monkeypatch.setattr(neg, "CELL_ANCHORS", 2)
    monkeypatch.setattr(neg, "CELL_ROWS", 60)
    monkeypatch.setattr(neg, "TILE", 1)
    got = sorted(map(tuple, neg.digest(spark.createDataFrame(data, VECTORS).repartition(3)).collect()))
    assert got == negatives_brute(data) and len(got) > 50


def test_negatives_of_odd_tables(spark):
    assert neg.digest(spark.createDataFrame([], VECTORS)).count() == 0
    alone = [(100, [0.5, 0.5], 1, 1.0, 2), (101, [0.5], 2, 1.0, 2), (200, [], 3, 1.0, 2)]
    assert neg.digest(spark.createDataFrame(alone, VECTORS)).count() == 0
    short = [(100, [0.5, 0.5], 1, 1.0, 2), (101, [0.9], 1, 1.0, 2), (102, [0.5, -0.2], 2, 1.0, 2)]
    assert [tuple(r) for r in neg.digest(spark.createDataFrame(short, VECTORS)).collect()] == negatives_brute(
        [(i, v + [0.0] * (2 - len(v)), *x) for i, v, *x in short])


def test_negatives_equal_the_sql(spark):
    con = duckdb.connect()
    con.sql("create view embeddings as select * from '/root/testdata/sf0.01/embeddings.parquet'")
    got = neg.query(spark, "/root/testdata/sf0.01")
    assert sorted(map(tuple, got.collect())) == sorted(con.sql(neg.ORACLE).fetchall())
    assert got.schema["rank"].dataType.simpleString() == "int"


# ---- spelling variants --------------------------------------------------------------------------------------------
def edits(a, b):
    """Plain edit distance."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def variants_brute(data, ratio=10):
    import re
    count = Counter()
    for key, text in data:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{key}:{run}".encode()) if key is not None else 1
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            count[run] += 1
    count = {w: n for w, n in count.items() if len(w) >= 7 and n >= 2}
    near = {w: [v for v in count if abs(len(v) - len(w)) <= 1 and edits(v, w) == 1] for w in count}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-count[v], v), default=None)
        form[w] = best if best is not None and count[best] >= ratio * count[w] else None
    out = []
    for w in count:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, count[w], len(near[w]), count[form[w]] if form[w] else None))
    return sorted(out)


def spelled(seed=7):
    """Words with misspellings of several grades of frequency, anagrams, accents and a very common word."""
    rng = random.Random(seed)
    letters = "abcdeéÉßÿñ"
    out = []
    for _ in range(12):
        word = "".join(rng.choice(letters) for _ in range(rng.randint(6, 12)))
        pool = {word: 300}
        for n in (25, 25, 2, 2, 3):
            w = list(rng.choice(sorted(pool)))
            k = rng.randrange(len(w))
            w[k:k + 1] = rng.choice([[], [rng.choice(letters)], [w[k], rng.choice(letters)]])
            pool.setdefault("".join(w), n)
        pool.setdefault(word[::-1], 2)
        for w, n in pool.items():
            out += [w.upper() if rng.random() < 0.1 else w] * n
    rng.shuffle(out)
    out += ["x" * 3000, "x" * 3000, "x" * 3001, "x" * 3001]
    return [(i, " ".join(out[i::40]) + ("×÷ 12_" if i % 3 else "")) for i in range(40)] + [(None, "abcdefgh abcdefgh"), (50, None), (51, "")]


@pytest.mark.parametrize("home", [512, 3])
def test_variants_against_brute_force(spark, home, monkeypatch):
    data = spelled()
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in data], "doc_id long, text string, word string, n int").repartition(5)
    monkeypatch.setattr(sp.near_words, "__defaults__", (home,))
    got = sorted(map(tuple, sp.digest(docs).collect()))
    want = variants_brute(data)
    assert got == want
    assert any(r[1] and r[2] != r[1] for r in want) and any(r[4] > 2 for r in want)


def test_blocks_of_near_words_are_adjacent():
    rng = random.Random(8)
    classes = np.arange(256) % 5
    steps = {tuple(s) for s in sp.adjacent(5)}
    for _ in range(300):
        a = "".join(rng.choice("abcdefghé") for _ in range(9))
        b = list(a)
        k = rng.randrange(9)
        b[k:k + 1] = rng.choice([[], [rng.choice("abcdefghé")], [b[k], rng.choice("abcdefghé")]])
        x, y = sp.letter_counts([a, "".join(b)], classes, 5)
        assert tuple(y - x) in steps or tuple(x - y) in steps


def test_one_edit():
    rng = random.Random(9)
    words = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 6))) for _ in range(300)]
    assert all(sp.one_edit(a, b) == (edits(a, b) == 1) for a in words for b in words[:60])


def test_variants_equal_the_sql(spark):
    con = duckdb.connect()
    con.sql("create view documents as select * from '/root/testdata/sf0.001/documents.parquet'")
    assert sorted(map(tuple, sp.query(spark, SF).collect())) == sorted(con.sql(sp.ORACLE).fetchall())


def test_variants_of_odd_tables(spark):
    assert sp.digest(empty(spark)).count() == 0
    got = sorted(map(tuple, sp.digest(documents(spark)).collect()))
    assert got == variants_brute([(r[0], r[1]) for r in rows()])
