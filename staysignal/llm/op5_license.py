"""License scans in DataFrame functions only.

Every sentence or line of a file is compared to licence templates by the
cosine of sparse TF-IDF vectors (a term counts once; document frequencies
over all files; a term outside the templates weighs as one that no file has).
Files that hold enough terms of a standard header or of a whole licence text
(``licenses``) are also compared to these by their sentences and paragraphs
across line ends, their beginnings and their whole text; SPDX tags count as
matches of score 1.  A file's own licence is its best match.  A file that consists mostly of its
match is a licence file; files without a match of their own inherit from the
licence file in the nearest ancestor directory, by joins on paths.
"""

from __future__ import annotations

import math
import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written
from .licenses import HEADERS, SPDX, whole_texts

THRESHOLD = 0.75
FILE_SHARE = 0.5  # of a file's words lie in matching units: a licence file
TERM = r"[\p{L}\p{N}]+"
UNIT = r"[.!?]+\s+|\n"
SENTENCE = r"[.!?]+\s+"
PARAGRAPH = r"\n[^\p{L}\p{N}\n]*\n"  # a line without a word, as in comments
COPYRIGHT = r"(?im)^.{0,40}copyright\s+(\(c\)|©|<|\[|\d{4}).{0,100}$"  # the holder's line is no part of a licence
HEADS = [int(30 * 1.7 ** i) for i in range(11)]  # beginnings that are scored, in words
TAG = (r"(?i)SPDX-License-Identifier:[ \t]*(\(*[a-z0-9][a-z0-9.+:-]*\)*"
       r"(?:[ \t]+(?:AND|OR|WITH)[ \t]+\(*[a-z0-9][a-z0-9.+:-]*\)*)*)")

# Notices by which projects declare their licence.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0 Universal."),
]


def terms(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0)))


def template_terms(templates) -> list[tuple[str, list[str]]]:
    import regex
    return [(name, sorted(set(regex.findall(TERM, text.lower())))) for name, text in templates]


def _least_terms(words: list[str], weight: dict[str, float], heavy: float, threshold: float) -> tuple[list[str], int]:
    """The heavy terms of a template, and the fewest of them that a text with a cosine of the threshold can
    hold, should it hold all the light ones; all terms, if the light ones could do."""
    need = threshold ** 2 * sum(weight[w] for w in words) * (1 - 1e-9)
    for least in (heavy, 0.0):
        chosen = sorted((w for w in words if weight[w] >= least), key=lambda w: (-weight[w], w))
        held = sum(weight[w] for w in words if weight[w] < least)
        if held >= need:
            continue
        for n, w in enumerate(chosen, 1):
            held += weight[w]
            if held >= need:
                return chosen, n
    return list(words), 1


def _words(words) -> Column:
    return F.split(F.lit(" ".join(words)), " ")  # one literal


def _may_match(named, weight: dict[str, float], outside: float, threshold: float):
    """A condition on distinct terms that holds wherever they can reach the threshold with some template."""
    least = [_least_terms(words, weight, outside / 2, threshold) for _, words in named]
    vocabulary = sorted({w for words, _ in least for w in words})

    def some(held: Column) -> Column:
        return (F.size(held) >= min(n for _, n in least)) & reduce(
            or_, [F.size(F.array_intersect(held, _words(words))) >= n for words, n in least])

    if not least:
        return lambda found: F.lit(False)
    return lambda found: F.exists(F.array(F.array_intersect(found, _words(vocabulary))), some)


def _tagged(text: Column) -> Column:
    """(-score, license) of each SPDX identifier; "or later" and "only" are no licences of their own."""
    known = F.create_map(*[F.lit(x) for name in SPDX for x in (name.lower(), name)])
    names = F.flatten(F.transform(F.regexp_extract_all(text, F.lit(TAG), F.lit(1)), lambda e: F.regexp_extract_all(
        F.regexp_replace(e, r"(?i)\sWITH\s+\S+", ""), F.lit(r"[A-Za-z0-9][A-Za-z0-9.+:-]*"), F.lit(0))))
    names = F.transform(names, lambda x: F.regexp_replace(x, r"(?i)[.:-]+$|(-only|-or-later|\+)$", ""))
    names = F.transform(names, lambda x: F.coalesce(known[F.lower(x)], F.when(x.rlike("[0-9]|^LicenseRef-"), x)))
    return F.transform(F.filter(names, lambda x: x.isNotNull()),
                       lambda x: F.struct(F.lit(-1.0).alias("less"), x.alias("license")))


def _long_matches(files: DataFrame, named, weight: dict[str, float], outside: float, threshold: float) -> DataFrame:
    """(__id, found, found_words): the best match of each file's ``__long`` text to the templates ``named`` and to its
    SPDX tags, and the words in matching units of the kind that covers most."""
    spark = files.sparkSession
    tokens = lambda t: F.regexp_extract_all(F.lower(t), F.lit(TERM), F.lit(0))
    unit = lambda kind, t: F.struct(F.lit(kind).alias("kind"), t.alias("tokens"))
    split = lambda kind, parts: F.transform(parts, lambda u: unit(kind, tokens(u)))
    bare = F.regexp_replace("__long", COPYRIGHT, "")
    paragraphs = F.split("bare", PARAGRAPH)
    texts = files.filter("__long is not null").select("__id", "__long", bare.alias("bare"), tokens(bare).alias("all"))
    may_match = _may_match(named, weight, outside, threshold)
    units = texts.select("__id", F.posexplode(F.filter(F.concat(
        split(0, F.split("bare", UNIT)), split(1, F.flatten(F.transform(paragraphs, lambda x: F.split(x, SENTENCE)))),
        split(2, paragraphs), F.array(unit(3, F.col("all"))),
        F.array(*[unit(4 + i, F.slice("all", 1, n)) for i, n in enumerate(HEADS)])),
        lambda u: may_match(u["tokens"]))).alias("j", "unit"))
    units = units.select("__id", "j", "unit.kind", F.size("unit.tokens").alias("words"),
                         F.explode(F.array_distinct("unit.tokens")).alias("term"))
    weights = spark.createDataFrame(sorted({(w, weight[w]) for _, ws in named for w in ws}), "term string, w double")
    places = spark.createDataFrame([(w, weight[w], k) for k, (_, ws) in enumerate(named) for w in ws],
                                   "term string, w double, k int")
    totals = spark.createDataFrame([(k, name, sum(weight[w] for w in ws)) for k, (name, ws) in enumerate(named)],
                                   "k int, license string, total double")
    norms = (units.join(F.broadcast(weights), "term", "left").groupBy("__id", "j", "kind", "words")
             .agg(F.sum(F.coalesce("w", F.lit(outside))).alias("norm")))
    scores = (units.join(F.broadcast(places), "term").groupBy("__id", "j", "k").agg(F.sum("w").alias("common"))
              .join(F.broadcast(totals), "k").join(norms, ["__id", "j"])
              .withColumn("less", -F.round(F.col("common") / F.sqrt(F.col("norm") * F.col("total")), 9))
              .filter(F.col("less") <= -threshold))
    by_unit = scores.groupBy("__id", "j", "kind", "words").agg(F.min(F.struct("less", "license")).alias("found"))
    tagged = texts.select("__id", F.lit(-1).alias("kind"), F.array_min(_tagged(F.col("__long"))).alias("found"), F.aggregate(
        F.regexp_extract_all("__long", F.lit(TAG), F.lit(0)), F.lit(0), lambda n, t: n + F.size(tokens(t))).alias("words"))
    return (by_unit.select("__id", "kind", "found", "words").unionByName(tagged.filter("found is not null"))
            .groupBy("__id", "kind").agg(F.min("found").alias("found"), F.sum("words").alias("words"))
            .groupBy("__id").agg(F.min("found").alias("found"), F.max("words").alias("found_words")))


def _weights(files: DataFrame, vocabulary: list[str]) -> tuple[dict[str, float], float]:
    """Squared idf of the templates' terms and of a term that no file has; only the
    vocabulary's counts reach the driver."""
    own = F.array_intersect(terms("__text"), _words(vocabulary))
    counts = files.select(F.explode(F.concat(own, F.array(F.lit("")))).alias("term")).groupBy("term").count()
    df = {r["term"]: r["count"] for r in counts.collect()}
    n = df.pop("", 0)
    idf = lambda k: math.log((n + 1) / (k + 1)) + 1
    return {t: idf(df.get(t, 0)) ** 2 for t in vocabulary}, idf(0) ** 2


def _core(words: list[str], weight: dict[str, float], threshold: float) -> set[str]:
    """Terms of which a unit must hold one: without them the cosine stays below the threshold."""
    total, rest, out = sum(weight[w] for w in words), 0.0, set(words)
    for w in sorted(words, key=lambda w: (weight[w], w)):
        if rest + weight[w] >= threshold ** 2 * total * (1 - 1e-9):
            break
        rest += weight[w]
        out.discard(w)
    return out


def license_scan(files: DataFrame, key: str, path: Column, text: str = "text", templates=None,
                 threshold: float = THRESHOLD, file_share: float = FILE_SHARE, long_templates=None) -> DataFrame:
    """One row per input row: the key, path, license, origin (header, file, inherited, none) and score.

    Null and empty texts match nothing, but inherit; a null path is the top
    directory.  Of equal scores the first licence by name counts.  Rows with
    one path are files of their own.  An empty table gives an empty result.
    ``templates`` are compared to single sentences and lines, ``long_templates``
    (by default those of ``licenses``, none beside own ``templates``) also to
    paragraphs, beginnings and whole files.
    """
    if long_templates is None:
        long_templates = [] if templates else HEADERS + [(n, re.sub(COPYRIGHT, "", t)) for n, t in whole_texts()]
    long_named = template_terms(long_templates)
    named = template_terms(templates or TEMPLATES)
    rows = files.select(F.col(f"`{key}`").alias("__key"), F.col(f"`{text}`").alias("__text"),
                        F.coalesce(path, F.lit("")).alias("__path"))
    vocabulary = sorted({w for _, words in named for w in words})
    weight, outside = _weights(rows, sorted({*vocabulary, *(w for _, words in long_named for w in words)}))
    core = sorted(set().union(*[_core(words, weight, threshold) for _, words in named]))
    lits = lambda words: F.array(*map(F.lit, words))
    weights = F.create_map(*[x for w in vocabulary for x in (F.lit(w), F.lit(weight[w]))])
    total = lambda found: F.aggregate(found, F.lit(0.0), lambda s, w: s + weights[w])

    def best(unit: Column) -> Column:
        """(-score, license) of a unit's best template: the least such pair."""
        distinct = F.array_distinct(unit)
        inside = F.array_intersect(distinct, lits(vocabulary))
        norm = total(inside) + outside * (F.size(distinct) - F.size(inside))
        return F.array_min(F.array(*[F.struct(
            (-F.round(total(F.array_intersect(inside, lits(words))) / F.sqrt(norm * sum(weight[w] for w in words)), 9))
            .alias("less"), F.lit(name).alias("license")) for name, words in named]))

    units = F.transform(F.split(F.coalesce("__text", F.lit("")), UNIT),
                        lambda u: F.regexp_extract_all(F.lower(u), F.lit(TERM), F.lit(0)))
    may_match = _may_match(long_named, weight, outside, threshold)
    long_text = F.when(F.exists(F.array(terms("__text")), lambda t: F.array_contains(t, "spdx") | may_match(t)), F.col("__text"))
    scanned = rows.select("__key", "__path", "__text", units.alias("units"))
    scanned = scanned.select(
        F.monotonically_increasing_id().alias("__id"), "__key", "__path", long_text.alias("__long"), F.aggregate("units", F.lit(0), lambda s, u: s + F.size(u)).alias("words"),
        F.transform(F.filter("units", lambda u: F.arrays_overlap(u, lits(core))),
                    lambda u: F.struct(best(u).alias("best"), F.size(u).alias("words"))).alias("units"))
    scanned = scanned.withColumn("units", F.filter("units", lambda u: u["best"]["less"] <= -threshold))
    name = F.lower(F.regexp_extract("__path", "([^/]*)$", 1))
    scanned = scanned.select(
        "__id", "__key", "__path", "__long", F.regexp_extract("__path", "^(.*)/[^/]*$", 1).alias("dir"), "words",
        F.array_min(F.transform("units", lambda u: u["best"])).alias("own"),
        F.aggregate("units", F.lit(0), lambda s, u: s + u["words"]).cast("long").alias("own_words"),
        name.rlike(r"^(un)?licen[cs]e|^copying|^notice").alias("named"))
    scanned = written(scanned, "licenses")
    found = _long_matches(scanned, long_named, weight, outside, threshold)
    scanned = scanned.drop("__long").join(found, "__id", "left").select(
        "__key", "__path", "dir", F.least("own", "found").alias("own"),
        (F.col("own").isNotNull() | F.col("found").isNotNull()).alias("has"),
        ((F.greatest("own_words", "found_words") >= file_share * F.col("words")) | F.col("named")).alias("whole"))
    scanned = written(scanned, "licensed")
    # licence of each directory with a licence file, then of each directory with files to inherit
    given = scanned.filter("has and whole").groupBy(F.col("dir").alias("above")).agg(F.min("own").alias("given"))
    wanting = scanned.filter("not has").select("dir").distinct()
    parts = F.split("dir", "/")
    wanting = wanting.withColumn("depth", F.explode(F.sequence(F.lit(0), F.size(parts))))
    wanting = wanting.withColumn("above", F.concat_ws("/", F.slice(F.split("dir", "/"), F.lit(1), F.col("depth"))))
    nearest = written(wanting.dropDuplicates(["dir", "above"]).join(given, "above").groupBy("dir")
                      .agg(F.max_by("given", "depth").alias("given")), "directories")
    origin = (F.when(F.col("has") & F.col("whole"), "file").when(F.col("has"), "header")
              .when(F.col("given").isNotNull(), "inherited").otherwise("none"))
    best_of = F.when(F.col("has"), F.col("own")).otherwise(F.col("given"))
    return scanned.join(nearest, "dir", "left").select(
        F.col("__key").alias(key), F.col("__path").alias("path"), best_of["license"].alias("license"),
        origin.alias("origin"), F.round(-best_of["less"], 6).alias("score"))


def path_of() -> Column:
    """Documents lie in a directory for their source, with one for each language in it."""
    return F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string"))


def digest(docs: DataFrame) -> DataFrame:
    return license_scan(docs.select("doc_id", "text", "source", "lang"), "doc_id", path_of())


def _sql_templates() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    return ", ".join(f"({i}, {quote(name)}, [{', '.join(map(quote, words))}])"
                     for i, (name, words) in enumerate(template_terms(TEMPLATES)))


ORACLE = f"""
WITH t(k, license, words) AS (VALUES {_sql_templates()}),
tw AS (SELECT k, license, UNNEST(words) AS w FROM t),
d AS (
  SELECT doc_id, concat_ws('/', source, lang, CAST(doc_id AS VARCHAR)) AS path,
    list_transform(string_split_regex(coalesce(text, ''), '[.!?]+\\s+|\\n'),
      lambda u: regexp_extract_all(lower(u), '[\\p{{L}}\\p{{N}}]+')) AS units FROM documents),
u AS (SELECT doc_id, path, UNNEST(units) AS terms, UNNEST(range(len(units))) AS j FROM d),
ut AS (SELECT DISTINCT doc_id, j, UNNEST(terms) AS w FROM u),
df AS (SELECT w, count(DISTINCT doc_id) AS n FROM ut WHERE w IN (SELECT w FROM tw) GROUP BY w),
n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM documents),
wt AS (
  SELECT w, power(ln((n.n + 1) / (coalesce(df.n, 0) + 1)) + 1, 2) AS q
  FROM (SELECT DISTINCT w FROM tw) LEFT JOIN df USING (w), n),
norm AS (
  SELECT doc_id, j, sum(coalesce(q, power(ln(n.n + 1) + 1, 2))) AS q FROM ut LEFT JOIN wt USING (w), n GROUP BY ALL),
tn AS (SELECT k, license, sum(q) AS q FROM tw JOIN wt USING (w) GROUP BY ALL),
s AS (
  SELECT ut.doc_id, ut.j, tn.license, round(sum(wt.q) / sqrt(any_value(norm.q) * any_value(tn.q)), 9) AS score
  FROM ut JOIN tw USING (w) JOIN wt USING (w) JOIN tn ON tn.k = tw.k
  JOIN norm ON norm.doc_id = ut.doc_id AND norm.j = ut.j GROUP BY ut.doc_id, ut.j, tn.k, tn.license),
b AS (SELECT doc_id, j, min({{'less': -score, 'license': license}}) AS best FROM s WHERE score >= {THRESHOLD} GROUP BY ALL),
o AS (
  SELECT b.doc_id, min(best) AS own, sum(len(u.terms)) AS words FROM b JOIN u ON u.doc_id = b.doc_id AND u.j = b.j GROUP BY ALL),
f AS (
  SELECT d.doc_id, d.path, regexp_extract(d.path, '^(.*)/[^/]*$', 1) AS dir, o.own,
    o.own IS NOT NULL AND (o.words >= {FILE_SHARE} * list_sum(list_transform(d.units, lambda x: len(x)))
      OR regexp_matches(lower(regexp_extract(d.path, '([^/]*)$', 1)), '^(un)?licen[cs]e|^copying|^notice')) AS whole
  FROM d LEFT JOIN o USING (doc_id)),
g AS (SELECT dir AS above, min(own) AS given FROM f WHERE whole GROUP BY dir),
a AS (
  SELECT dir, arg_max(given, length(above)) AS given FROM (SELECT DISTINCT dir FROM f) x
  JOIN g ON g.above = '' OR x.dir = g.above OR starts_with(x.dir, g.above || '/') GROUP BY dir)
SELECT doc_id, path, coalesce(own, given).license AS license,
  CASE WHEN whole THEN 'file' WHEN own IS NOT NULL THEN 'header' WHEN given IS NOT NULL THEN 'inherited' ELSE 'none' END
  AS origin, round(-coalesce(own, given).less, 6) AS score
FROM f LEFT JOIN a USING (dir)
"""
