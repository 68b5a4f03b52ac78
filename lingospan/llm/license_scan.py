"""License statements in texts, by DataFrame functions alone.

Two findings per text. Fixed phrases (base) are counted where their words stand one after the
other. Templates are found by an exact set-similarity join: every line is a block, and a
template is in it if at least CONTAINMENT of the template's distinct words are. Notices are
often wrapped, so around every line break inside a paragraph (lines that hold words) the SPAN
words on each side are a block too; SPAN is the length of the longest template. Texts that
hold too few words of every template as a whole have no such blocks. The words of
templates are ordered by how many blocks of all texts hold them, rarest first; a template is
joined by its first words in that order only (as many as any match must share one of), blocks
that are too small are left out, and a pair is dropped when the words after the shared places
cannot reach the overlap. What is left is verified on the whole sets.

Templates are a constant of this module, so all tables made of them are small whatever the
corpus. Defined results: a null text is empty; every row is scanned by itself.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lingospan.llm.tables import store

# The base phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

TEMPLATES = (
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
)
CONTAINMENT = 0.85
SPAN = max(len(text.split()) for _, text in TEMPLATES)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BETWEEN = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
BLANK = f"\n(?:{BETWEEN})?\n"


def _sets() -> list[tuple[str, list[str], int]]:
    """Label, distinct words and least overlap of each template."""
    out = []
    for label, text in TEMPLATES:
        words = list(dict.fromkeys(text.split()))
        out.append((label, words, math.ceil(CONTAINMENT * len(words))))
    return out


def _spaces(text: Column) -> Column:
    return F.char_length(text) - F.char_length(F.replace(text, F.lit(" ")))


def _base(words: Column) -> dict[str, Column]:
    """Counts and places of the phrases in words joined by single spaces."""
    n_words = F.when(words == "", 0).otherwise(_spaces(words) + 1)
    padded = F.concat(F.lit(" "), words, F.lit(" "))
    counts, firsts, lasts, labels = [], [], [], []
    for phrase, label in PHRASES.items():
        pieces = F.split(padded, f" {phrase}(?= )", -1)
        n = F.size(pieces) - 1
        counts.append(n)
        firsts.append(F.when(n > 0, _spaces(F.get(pieces, F.lit(0)))))
        lasts.append(F.when(n > 0, n_words - (_spaces(F.get(pieces, n)) - 1) - len(phrase.split())))
        labels.append(F.when(n > 0, F.lit(label)))
    total = counts[0]
    for n in counts[1:]:
        total = total + n
    return {
        "n_words": n_words.cast("long"),
        "n_base": total.cast("long"),
        "first_word": F.least(*firsts).cast("long"),
        "last_word": F.greatest(*lasts).cast("long"),
        "base": F.array_compact(F.array(*labels)),
    }


def _wrapped(text: Column, known: Column) -> Column:
    """The known words around every line break of the paragraphs of a text."""

    def around(lines: Column, i: Column) -> Column:
        before = F.slice(lines, F.greatest(i - SPAN + 1, F.lit(1)), F.least(i, F.lit(SPAN)))
        after = F.slice(lines, i + 1, F.lit(SPAN))
        words = [F.filter(F.split(F.array_join(part, " "), BETWEEN), lambda w: w != "") for part in (before, after)]
        padded = F.concat(F.array_repeat(F.lit(""), SPAN), words[0])
        return F.array_intersect(F.concat(F.slice(padded, -SPAN, SPAN), F.slice(words[1], 1, SPAN)), known)

    paragraphs = F.transform(F.split(text, BLANK), lambda p: F.split(p, "\n"))
    paragraphs = F.filter(paragraphs, lambda lines: F.size(lines) > 1)
    return F.flatten(F.transform(paragraphs, lambda lines: F.transform(F.sequence(F.lit(1), F.size(lines) - 1), lambda i: around(lines, i))))


def scan(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: base columns, ``labels`` and the greatest containment."""
    spark = docs.sparkSession
    sets = _sets()
    vocabulary = sorted({w for _, words, _ in sets for w in words})
    known = F.array(*[F.lit(w) for w in vocabulary])
    fewest = min(need for _, _, need in sets)
    text = F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), UPPER, LOWER)
    lines = F.transform(F.split(text, "\n"), lambda line: F.array_intersect(F.split(line, BETWEEN), known))
    read = docs.select(
        F.col("doc_id").cast("long"),
        text.alias("text"),
        F.trim(F.regexp_replace(text, BETWEEN, " ")).alias("words"),
        lines.alias("lines"),
    )
    read = read.withColumn("held", F.array_distinct(F.flatten("lines")))
    enough = F.lit(False)
    for _, words, need in sets:
        enough = enough | (F.size(F.array_intersect("held", F.array(*[F.lit(w) for w in words]))) >= need)
    blocks = F.when(enough & F.contains("text", F.lit("\n")), F.concat("lines", _wrapped(F.col("text"), known))).otherwise(F.col("lines"))
    read = read.select("doc_id", "words", F.filter(blocks, lambda b: F.size(b) >= fewest).alias("blocks"))
    rows = read.select("doc_id", *[c.alias(n) for n, c in _base(F.col("words")).items()], "blocks")
    rows = store(rows.withColumn("row", F.monotonically_increasing_id()), "license-rows")

    blocks = rows.select("row", F.posexplode("blocks").alias("block", "words"))
    seen = blocks.select(F.explode("words").alias("word")).groupBy("word").count()
    frequency = {r[0]: r[1] for r in seen.collect()}  # at most one row per template word
    order = sorted(vocabulary, key=lambda w: (frequency.get(w, 0), w))
    rank = {w: i for i, w in enumerate(order)}
    in_order = F.array_sort(F.transform("words", lambda w: F.array_position(F.array(*[F.lit(x) for x in order]), w).cast("int") - 1))
    values = []
    for t, (label, words, need) in enumerate(sets):
        ranks = sorted(rank[w] for w in words)
        whole = f"array({', '.join(map(str, ranks))})"
        values += [f"({t}, '{label}', {need}, {r}, {i}, {whole})" for i, r in enumerate(ranks[: len(ranks) - need + 1])]
    templates = spark.sql(f"SELECT * FROM VALUES {', '.join(values)} AS t(template, label, need, token, i, whole)")
    blocks = blocks.select("row", "block", in_order.alias("tokens"))
    prefixes = blocks.select("row", "block", "tokens", F.posexplode(F.slice("tokens", F.lit(1), F.size("tokens") - fewest + 1)).alias("j", "token"))
    pairs = prefixes.join(F.broadcast(templates), "token")  # rows bounded by the words of TEMPLATES
    reach = F.least("i", "j") + 1 + F.least(F.size("whole") - 1 - F.col("i"), F.size("tokens") - 1 - F.col("j"))
    pairs = pairs.where((F.size("tokens") >= F.col("need")) & (reach >= F.col("need")))
    common = F.size(F.array_intersect("tokens", "whole"))
    found = pairs.where(common >= F.col("need")).select("row", "label", (common / F.size("whole")).alias("containment"))
    found = found.groupBy("row").agg(F.collect_set("label").alias("found"), F.max("containment").alias("containment"))
    return rows.drop("blocks").join(found, "row", "left").drop("row")


def digest(scanned: DataFrame) -> DataFrame:
    listed = lambda labels: F.array_join(F.array_sort(labels), ",")
    nothing = F.array().cast("array<string>")
    return scanned.select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        listed("base").alias("base_labels"),
        listed(F.array_union("base", F.coalesce("found", nothing))).alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("containment", F.lit(0.0))).alias("score"),
    )


def oracle() -> str:
    """DuckDB statement with the rows of ``digest(scan(documents))``."""
    templates = ", ".join(f"('{label}', [{', '.join(repr(w) for w in words)}], {need})" for label, words, need in _sets())
    phrases = ", ".join(f"([{', '.join(repr(w) for w in p.split())}], '{label}')" for p, label in PHRASES.items())
    return f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS doc, doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents),
w AS (SELECT doc, doc_id, list_filter(string_split_regex(t, '{BETWEEN}'), lambda x: x <> '') AS ws FROM d),
templates AS (SELECT * FROM (VALUES {templates}) AS v(label, words, need)),
phrases AS (SELECT * FROM (VALUES {phrases}) AS v(words, label)),
b AS (SELECT DISTINCT doc, string_split_regex(line, '{BETWEEN}') AS ws FROM (SELECT doc, unnest(string_split(t, chr(10))) AS line FROM d)),
f AS (SELECT doc, label, len(list_intersect(words, ws))::DOUBLE / len(words) AS c FROM b, templates WHERE len(list_intersect(words, ws)) >= need),
p AS (SELECT doc, label, unnest(list_filter(range(0, len(ws) - len(words) + 1), lambda i: ws[i + 1:i + len(words)] = words)) AS place
  FROM w, phrases WHERE len(ws) >= len(words)),
pg AS (SELECT doc, count(*) AS n, min(place) AS first_place, max(place) AS last_place, list_sort(list(DISTINCT label)) AS labels FROM p GROUP BY doc),
fg AS (SELECT doc, list(DISTINCT label) AS labels, max(c) AS c FROM f GROUP BY doc)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, first_place::BIGINT AS first_word, last_place::BIGINT AS last_word,
  coalesce(array_to_string(pg.labels, ','), '') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(pg.labels, []), coalesce(fg.labels, [])))), ',') AS labels,
  CASE WHEN n > 0 THEN 1.0::DOUBLE ELSE coalesce(c, 0.0) END AS score
FROM w LEFT JOIN pg USING (doc) LEFT JOIN fg USING (doc)"""
