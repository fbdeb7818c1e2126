import math
import os
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from staysignal.llm import op1_sentencepiece as sp
from staysignal.llm import op3_langid as lang
from staysignal.llm import op4_packing as pk
from staysignal.llm import op5_license as lic
from staysignal.llm import op8_toxicity as tox
from tests.llm.fixtures import documents, empty, rows

SF = "/root/testdata/sf0.01"


# ---- SentencePiece ------------------------------------------------------------------------------------------------
def varint(n):
    out = b""
    while True:
        out += bytes([n & 127 | (128 if n > 127 else 0)])
        n >>= 7
        if not n:
            return out


def field(number, value):
    if isinstance(value, float):
        import struct
        return varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    return varint(number << 3 | 2) + varint(len(value)) + value


@pytest.fixture(scope="module")
def unigram_file(tmp_path_factory):
    """A small unigram model file with byte fallback, written by hand."""
    rng = random.Random(1)
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + [(f"<0x{i:02X}>", 0.0, 6) for i in range(256)]
    own = {sp.MARK, *"abcdeé", *("".join(rng.choice("abcde") for _ in range(rng.randint(2, 5))) for _ in range(80)),
           *(sp.MARK + "".join(rng.choice("abcde") for _ in range(rng.randint(1, 4))) for _ in range(60)), sp.MARK * 2}
    pieces += [(p, -rng.uniform(2, 12), 1) for p in sorted(own)]
    body = b"".join(field(1, field(1, p.encode()) + field(2, s) + field(3, k)) for p, s, k in pieces)
    body += field(2, field(3, 1) + field(35, 1))  # unigram, byte fallback
    body += field(3, field(1, b"identity") + field(3, 1) + field(4, 0) + field(5, 1))
    path = tmp_path_factory.mktemp("model") / "small.model"
    path.write_bytes(body)
    return str(path)


def test_pieces_equal_the_library(unigram_file):
    import sentencepiece
    library = sentencepiece.SentencePieceProcessor(model_file=unigram_file)
    model = sp.load(unigram_file)
    coder = sp.Encoder(model)
    rng = random.Random(2)
    for _ in range(400):
        text = "".join(rng.choice("abcdeé zß  ") for _ in range(rng.randint(0, 40)))
        ids = np.frombuffer(coder.encode(text), "<u4").tolist()
        want = library.encode(text)
        assert model.decode(ids) == text
        score = lambda x: sum(model.scores[i] for i in x)
        assert ids == want or (len(text) and math.isclose(score(ids), score(want), abs_tol=1e-4))


def test_trie_holds_exactly_its_words():
    rng = random.Random(3)
    words = {bytes(rng.choice(b"abc\xff\x00") for _ in range(rng.randint(1, 6))): i for i in range(300)}
    trie = sp.DoubleArray(words)

    def find(w):
        node = 0
        for c in w:
            t = trie.base[node] + c + 1
            if t >= len(trie.check) or trie.check[t] != node:
                return -1
            node = t
        return trie.value[node]
    assert all(find(w) == i for w, i in words.items())
    assert all(find(w + b"q") == -1 for w in words)


def test_round_trip(spark):
    got = sp.digest(documents(spark)).collect()
    assert len(got) == len(rows())
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[0]["decoded_sha256"] is None and by_id[1]["n_ids"] == 0
    assert not by_id[12]["round_trip"]  # holds the marker itself
    assert all(r["round_trip"] for r in got if r["doc_id"] not in (None, 0, 12, 100, 108, 114) and r["round_trip"] is not None)
    assert sp.digest(empty(spark)).count() == 0


# ---- language -----------------------------------------------------------------------------------------------------
def test_profile_counts_against_brute_force():
    text = "Ab a-b, é1b  "
    padded = " ab a b é b "
    want = Counter(padded[i:i + n] for n in (1, 2, 3) for i in range(len(padded) - n + 1))
    del want[" "]
    keys, counts = lang.ngram_counts(text)
    names = {}
    for k, c in zip(keys.tolist(), counts.tolist()):
        s = ""
        while k:
            s, k = chr(k & ((1 << 21) - 1)).replace("\x01", " ") + s, k >> 21
        names[s] = c
    assert names == dict(want)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = lang.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out")
    assert got.filter("lang = lang_pred").count() >= 0.97 * got.count() > 0


def test_language_of_odd_rows(spark):
    got = {r["doc_id"]: r for r in lang.identify(documents(spark)).collect()}
    assert len(lang.identify(documents(spark)).collect()) == len(rows())
    for i in (0, 1, 2, 18):
        assert (got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0)
    assert all(0 <= r["score"] <= 1 and r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items() if i is not None)
    assert lang.identify(empty(spark)).count() == 0


# ---- packing ------------------------------------------------------------------------------------------------------
def test_pieces_equal_the_tokenizer(spark):
    from tokenizers import Tokenizer
    whole = Tokenizer.from_file(pk.vocabulary_path())
    for docs in (documents(spark), spark.read.parquet("/root/testdata/sf0.001/documents.parquet")):
        docs = docs.dropDuplicates(["doc_id"])
        got = {}
        for r in pk.pieces(docs, with_ids=True).orderBy("doc_id", "piece").collect():
            parts = got.setdefault(r["doc_id"], [])
            assert (r["piece"], r["start"]) == (len(parts), sum(map(len, parts))) and r["length"] == len(r["ids"])
            assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
            parts.append(r["ids"])
        for r in docs.collect():
            parts = got.pop(r["doc_id"])
            assert sum(parts, []) == whole.encode(r["text"] or "", add_special_tokens=False).ids + [0]
            assert all(len(p) == 2048 for p in parts[1:]) and len(parts) == -(-sum(map(len, parts)) // 2048)
        assert not got


def check_placed(placed, capacity):
    rows_ = placed.collect()
    by = {}
    for r in rows_:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= capacity
    return len(rows_), len(by), sum(r["length"] for r in rows_)


def test_places(spark):
    n, sequences, tokens = check_placed(pk.pack_documents(documents(spark)), 2048)
    assert n == pk.pieces(documents(spark)).count() and sequences >= tokens / 2048
    n, sequences, tokens = check_placed(pk.digest(spark.read.parquet(f"{SF}/documents.parquet")), 2048)
    assert sequences <= 1.01 * tokens / 2048 + 1
    assert pk.digest(empty(spark)).count() == 0


def fewest(items, capacity):
    """Least number of bins by search."""
    best = [len(items)]

    def place(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for k, room in enumerate(bins):
            if room >= items[i] and room not in bins[:k]:
                place(i + 1, bins[:k] + [room - items[i]] + bins[k + 1:])
        place(i + 1, bins + [capacity - items[i]])
    place(0, [])
    return best[0]


def test_reduction_never_costs_a_sequence():
    rng = random.Random(7)
    for _ in range(300):
        capacity = rng.randint(8, 40)
        items = sorted((rng.randint(1, capacity) for _ in range(rng.randint(1, 9))), reverse=True)
        fixed, rest = pk.reduce_dominated(Counter(items), capacity)
        left = sorted(Counter(rest).elements(), reverse=True)
        taken = Counter()
        for times, chosen in fixed:
            assert sum(chosen) <= capacity
            for x in chosen:
                taken[x] += times
        assert taken + Counter(rest) == Counter(items)
        assert sum(t for t, _ in fixed) + fewest(left, capacity) == fewest(items, capacity)
        patterns = pk.plan(Counter(items), capacity)
        assert Counter({}) + sum((Counter({x: t * p.count(x) for x in set(p)}) for t, p in patterns), Counter()) == Counter(items)


# ---- licences -----------------------------------------------------------------------------------------------------
def test_headers_files_and_inheritance(spark):
    data = [(1, "a/LICENSE", "Released under the MIT License."), (2, "a/b/x.py", "plain text"), (3, "a/b/c/y.py", None),
            (4, "a/b/c/COPYING", "Licensed under the Apache License, Version 2.0.\nmore text that goes on and on for a while"),
            (5, "a/b/z.py", "Some code.\nLicensed under CC BY-NC 4.0.\nmore words here and there and everywhere so that it is long"),
            (6, "other/x", "nothing here"), (7, None, "MIT"), (8, "a/b/c/d/e/f.txt", ""), (8, "a/b/c/d/e/f.txt", "")]
    files = spark.createDataFrame(data, "k long, p string, t string").withColumn("path", F.lit("clash"))
    got = {(r["k"]): (r["license"], r["origin"]) for r in lic.license_scan(files, "k", F.col("p"), "t").collect()}
    assert got == {1: ("MIT", "file"), 2: ("MIT", "inherited"), 3: ("Apache-2.0", "inherited"), 4: ("Apache-2.0", "file"),
                   5: ("CC-BY-NC-4.0", "header"), 6: (None, "none"), 7: (None, "none"), 8: ("Apache-2.0", "inherited")}


def test_standard_headers_texts_and_tags(spark):
    from staysignal.llm.licenses import whole_texts
    gpl = """ * This file is part of Foo.
 *
 * Foo is free software; you can redistribute it and/or modify
 * it under the terms of the GNU %sGeneral Public License as published by
 * the Free Software Foundation; either version %s of the License, or
 * (at your option) any later version.
 */
"""
    code = "\n".join(f"int f{i}(int x{i}) {{ return y{i} + z{i}; }}" for i in range(200))
    text = dict(whole_texts())
    want = {"a.c": ("GPL-2.0", "header", gpl % ("", 2) + code), "b.c": ("GPL-3.0", "header", gpl % ("", 3) + code),
            "c.c": ("LGPL-2.1", "header", gpl % ("Lesser ", "2.1") + code),
            "d.c": ("AGPL-3.0", "header", gpl % ("Affero ", 3) + code),
            "e.c": ("MIT", "header", "// SPDX-License-Identifier: MIT\n" + code),
            "f.c": ("GPL-2.0", "header", "/* SPDX-License-Identifier: GPL-2.0-or-later WITH Classpath-exception-2.0 */\n" + code),
            "g.md": ("CC-BY-4.0", "header", "This work is licensed under a Creative Commons Attribution 4.0\nInternational "
                     "License.\n\n" + code),
            "h.txt": ("ISC", "file", "Copyright (c) 2021, Jane Roe\n\n" + " ".join(text["ISC"].split()[4:])),
            "i.txt": ("MIT", "file", "The MIT License\n\nCopyright (c) 2020 Jane Roe\n\n" + text["MIT"].split("\n", 2)[2]),
            "j.txt": ("GPL-3.0", "file", text["GPL-3.0"]), "k.txt": ("GPL-2.0", "file", text["GPL-2.0"]),
            "l.txt": ("Unlicense", "file", " ".join(text["Unlicense"].split())),
            "m.c": (None, "none", code + "\nWrite SPDX-License-Identifier: tags, free software of the public")}
    want |= {f"n/{name}": (name, "file", t) for name, t in text.items()}
    rows_ = [(p, t) for p, (_, _, t) in want.items()]
    rows_ += [(f"p/{i}", f"prose {i} is the first of a kind and this is in the public {i}") for i in range(50)]
    files = spark.createDataFrame(rows_, "p string, t string")
    got = {r["p"]: (r["license"], r["origin"]) for r in lic.license_scan(
        files, "p", F.concat(F.lit("x/"), F.translate("p", "./", "__"), F.lit("/"), "p"), "t").collect()}
    assert {p: got[p] for p in want} == {p: (name, origin) for p, (name, origin, _) in want.items()}


def test_license_rows(spark):
    got = lic.digest(documents(spark))
    assert got.count() == len(rows()) and got.filter("doc_id = 19").first()["license"] == "CC-BY-NC-4.0"
    assert lic.digest(empty(spark)).count() == 0


# ---- toxicity -----------------------------------------------------------------------------------------------------
def test_marginals_against_enumeration():
    rng = np.random.default_rng(1)
    e, trans, lengths = rng.normal(0, 2, 9), rng.normal(0, 1, (2, 2)), np.array([4, 1, 4])
    p, pairs = tox.marginals(e, lengths, trans, True)
    want, seen, at = [], np.zeros((2, 2)), 0
    for n in lengths:
        weights = {}
        for code in range(2 ** n):
            y = [code >> k & 1 for k in range(n)]
            weights[tuple(y)] = math.exp(sum(e[at + k] * y[k] for k in range(n)) + sum(trans[a][b] for a, b in zip(y, y[1:])))
        z = sum(weights.values())
        want += [sum(w for y, w in weights.items() if y[k]) / z for k in range(n)]
        for y, w in weights.items():
            for a, b in zip(y, y[1:]):
                seen[a][b] += w / z
        at += n
    assert np.allclose(p, want) and np.allclose(pairs, seen)


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    if not os.path.exists(sf):
        pytest.skip("needs more labels")
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    got = tox.toxicity(docs, labels).join(labels, "doc_id").filter("held_out")
    n = {(r[0], r[1]): r[2] for r in got.groupBy("toxic", "predicted").count().collect()}
    assert n[(1, 1)] >= 0.8 * (n[(1, 1)] + n.get((1, 0), 0)) and n.get((0, 1), 0) <= 0.03 * n[(0, 0)]
    hit = got.filter("predicted = 1 and size(spans) > 0").join(docs.select("doc_id", "text"), "doc_id").first()
    assert all(hit["text"][s["start"]:s["end"]].strip() and " " not in hit["text"][s["start"]:s["end"]] for s in hit["spans"])


def test_toxicity_of_odd_rows(spark):
    docs = documents(spark)
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    got = tox.digest(docs, labels).collect()
    assert len(got) == len(rows()) and all(0 <= r["score"] <= 1 for r in got)
    assert tox.digest(empty(spark), labels).count() == 0
    assert tox.digest(docs, labels.limit(0)).count() == len(rows())
