"""License scans by diagonal voting. DataFrame functions only.

All rolling k-grams of a document's words are hashed and joined with the places that they have in the templates. A hit at word p
of the document and word t of the template votes for the diagonal p - t; diagonals of one template that lie close together (a few
words inserted or lost) merge to a span; spans are verified word by word against the template.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docweave.llm.common import row_key, settle, spare

#: Phrases that count at every place where they stand, and their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Openings of public license texts and notices, in lower case, and their labels.
TEMPLATES = (
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", "mit"),
    ("the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "mit"),
    ("you may not use this file except in compliance with the license you may obtain a copy of the license at", "apache"),
    ("unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind", "apache"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gpl"),
    ("you should have received a copy of the gnu general public license along with this program", "gpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("this source code form is subject to the terms of the mozilla public license", "mpl"),
)
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
K = 2
#: Diagonals of one template that lie at most this far apart are one span.
DRIFT = 3
#: Part of a template's words that a span has at least, if the template is no phrase.
COVERAGE = 0.6
#: Templates are a parameter and are sent to every task, so their number is bounded.
MOST_WORDS = 200_000


def words(text: Column) -> Column:
    lower = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_extract_all(lower, F.lit(WORD), F.lit(0))


def _grams(of: Column) -> Column:
    """Structs of the K words from each place on, made by shifted copies, so that a gram holds its own words and no others."""
    n = F.greatest(F.size(of) - (K - 1), F.lit(0))
    return F.arrays_zip(*[F.slice(of, step + 1, n) for step in range(K)])


def _places(rows: DataFrame, of: str, place: str) -> DataFrame:
    """A row for each gram of the words in column `of`, with its place, its hash and its words under the place's name."""
    rolled = rows.select(*[c for c in rows.columns if c != of], F.posexplode(_grams(F.col(of))).alias(place, "own"))
    own = [F.col("own")[name] for name in rolled.schema["own"].dataType.names]
    return rolled.select("*", F.xxhash64(*own).alias("gram"), *[w.alias(f"{place}{k}") for k, w in enumerate(own)]).drop("own")


def template_rows(spark: SparkSession, phrases=PHRASES, templates=TEMPLATES) -> DataFrame:
    rows = [(i, label, text.split(" "), i < len(phrases)) for i, (text, label) in enumerate([*phrases, *templates])]
    if any(len(r[2]) < K for r in rows) or sum(len(r[2]) for r in rows) > MOST_WORDS:
        raise ValueError(f"templates have at least {K} words each and {MOST_WORDS} together at most")
    return spark.createDataFrame(rows, "template int, label string, words array<string>, phrase boolean")


def spans(docs: DataFrame, phrases=PHRASES, templates=TEMPLATES) -> DataFrame:
    """(row, label, phrase, start, end, score) of all verified spans, words counted from 0, end exclusive.

    row: hash of doc_id and text. score: the part of the template's words that stand in the span on its diagonals; a phrase needs all.
    """
    own = template_rows(docs.sparkSession, phrases, templates)
    places = _places(own.select("template", "label", "phrase", F.size("words").alias("length"), "words"), "words", "t")
    said = docs.select(row_key().alias("row"), words(F.col("text")).alias("said"))
    same = [F.col(f"p{k}") == F.col(f"t{k}") for k in range(K)]  # the words that a hit vouches for, compared one by one
    hits = _places(said, "said", "p").join(F.broadcast(places), "gram").where(reduce(and_, same))
    hits = settle(hits.select("row", "template", "label", "phrase", "length", "p", "t", (F.col("p") - F.col("t")).alias("diagonal")).distinct())
    votes = hits.groupBy("row", "template", "label", "phrase", "length", "diagonal").agg(F.count("*").alias("votes"), F.min("p").alias("low"), (F.max("p") + K).alias("high"))
    # of a phrase all k-grams stand on one diagonal
    exact = votes.where("phrase and votes = length - 1").select("row", "label", "phrase", F.col("low").alias("start"), F.col("high").alias("end"), F.lit(1.0).alias("score"))
    by = Window.partitionBy("row", "template").orderBy("diagonal")
    near = votes.where("not phrase").withColumn("new", F.coalesce((F.col("diagonal") - F.lag("diagonal").over(by) > DRIFT).cast("int"), F.lit(1))).withColumn("span", F.sum("new").over(by))
    joined = hits.where("not phrase").join(near.select("row", "template", "diagonal", "span"), ["row", "template", "diagonal"])
    covered = joined.groupBy("row", "template", "label", "phrase", "length", "span").agg(F.min("p").alias("start"), (F.max("p") + K).alias("end"), F.size(F.array_distinct(F.flatten(F.collect_set(F.sequence("t", F.col("t") + K - 1))))).alias("covered"))
    loose = covered.withColumn("score", F.col("covered") / F.col("length")).where(F.col("score") >= COVERAGE).select("row", "label", "phrase", "start", "end", "score")
    return exact.unionByName(loose)


def scan(docs: DataFrame, **how) -> DataFrame:
    """docs without text, with n_words, n_base (all phrase places), first_word and last_word (least and greatest start of one), base_labels,
    labels (those of all spans; distinct, sorted, comma-joined), score (highest of all spans, else 0) and the spans as an array of structs.

    Null texts count as empty. Rows equal in doc_id and text get equal results. Columns of these names are replaced, others stay.
    """
    new = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
    row, key = spare(docs, "scan_row", "scan_key")
    joined_labels = lambda only: F.array_join(F.array_sort(F.collect_set(F.when(only, F.col("label")))), ",")
    base = F.col("phrase")
    found = spans(docs.select("doc_id", "text"), **how).groupBy("row").agg(
        F.count(F.when(base, 1)).alias("n_base"), F.min(F.when(base, F.col("start"))).alias("first_word"), F.max(F.when(base, F.col("start"))).alias("last_word"),
        joined_labels(base).alias("base_labels"), joined_labels(F.lit(True)).alias("labels"), F.max("score").alias("score"),
        F.array_sort(F.collect_list(F.struct("start", "end", "label", "score"))).alias("spans"),
    ).withColumnRenamed("row", key)
    left = docs.select(*[c for c in docs.columns if c not in {"text", *new}], F.size(words(F.col("text"))).cast("long").alias("n_words"), row_key().alias(row))
    joined = left.join(found, left[row] == found[key], "left")
    filled = {"n_base": F.coalesce("n_base", F.lit(0)).cast("long"), "first_word": F.col("first_word").cast("long"), "last_word": F.col("last_word").cast("long"), "base_labels": F.coalesce("base_labels", F.lit("")), "labels": F.coalesce("labels", F.lit("")), "score": F.coalesce("score", F.lit(0.0))}
    return joined.select(*left.columns[:-1], *[c.alias(n) for n, c in filled.items()], "spans")
