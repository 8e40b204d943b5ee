"""License scans by diagonal voting.

The words of a document and of the templates are compared by rolling k-grams: a k-gram that both have is a vote for the
diagonal (document place minus template place). Votes are joined in Spark and added up per document, template and
diagonal; occupied diagonals that lie close together are one candidate, so inserted or missing words do not split a
match. A candidate is verified word by word: it is a match if enough of the template's words stand there in order. Short
templates must have enough of their k-grams too, and words that tell a template from another license must be there.
"""

from __future__ import annotations

from array import array
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pairsignal.llm.common import hinted, row_key, settle, text_of, word_places, words_of

# Phrases and their labels as the contract names them.
BASE = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]

# Short passages of public licenses, looked for whole or nearly whole.
TEMPLATES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("apache", "licensed under the apache license version 2 0"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc0", "creative commons zero v1 0 universal"),
    ("boost", "boost software license version 1 0"),
    ("all-rights-reserved", "all rights reserved"),
]

GRAM = 4  # words of a template k-gram; a shorter template is one k-gram
PROBE = 2  # its first words are hashed for the join, the rest is compared
DRIFT = 12  # words that may be put in between two neighbouring words of a match
SHORT = 12  # templates of fewer words must have COVERAGE of their k-grams too
COVERAGE = 0.7


def _grams(spark: SparkSession, templates: list[tuple[str, str]], base: list[tuple[str, str]]) -> DataFrame:
    rows = []
    for kind, listed in (("base", base), ("text", templates)):
        for number, (label, passage) in enumerate((b, a) if kind == "base" else (a, b) for a, b in listed):
            words = passage.split()
            k = len(words) if kind == "base" else min(GRAM, len(words))
            total = len(words) - k + 1
            rows += [(kind, f"{kind}{number}", label, i, total, words[i:i + k]) for i in range(total)]
    table = spark.createDataFrame(rows, "kind string, template string, label string, tpl int, total int, gram array<string>")
    return table.withColumn("h", F.xxhash64(*[F.get("gram", F.lit(i)) for i in range(PROBE)]))


def _chains(words: list[str], passage: list[str], least: float) -> list[tuple[int, int, set[int]]]:
    """Start, end and template places of the chains of template words in order, the longest first, none overlapping; with `least` of the words at least.

    A chain's next word is at most DRIFT words further than in the template, so only the ends within a template's length
    are kept at hand; all others are columns of whole numbers.
    """
    places: dict[str, list[int]] = {}
    for j, word in enumerate(passage):
        places.setdefault(word, []).append(j)
    matched, begin, place, inside, before = (array("i") for _ in range(5))  # per end: words matched, start, place, template place, the end before
    recent: deque[tuple[int, int, int, int, int]] = deque()
    for i, word in enumerate(words):
        if word not in places:
            continue
        while recent and recent[0][3] < i - len(passage) - DRIFT:
            recent.popleft()
        own = []
        for j in places[word]:
            n, start, at, *_ = max((x for x in recent if x[4] < j and i - x[3] <= j - x[4] + DRIFT), default=(0, i, -1))
            own.append((n + 1, start, len(matched), i, j))
            for column, value in zip((matched, begin, place, inside, before), (n + 1, start, i, j, at)):
                column.append(value)
        recent += own
    if not matched:
        return []
    n, start, end = (np.frombuffer(x, np.int32) for x in (matched, begin, place))
    enough = np.flatnonzero(n >= least * len(passage))
    order = enough[np.lexsort((start[enough], (end - start)[enough], -n[enough]))]
    taken = bytearray(len(words))
    found: list[tuple[int, int, set[int]]] = []
    for at in order.tolist():
        a, b = begin[at], place[at] + 1
        if taken.find(1, a, b) < 0:
            taken[a:b] = b"\x01" * (b - a)
            own = set()
            while at >= 0:
                own.add(inside[at])
                at = before[at]
            found.append((a, b, own))
    return found


def _telling(templates: list[tuple[str, str]], coverage: float) -> list[set[int]]:
    """Per template, the places of the words without which another label's template would pass for it."""
    out = []
    for label, passage in templates:
        words, told = passage.split(), set()
        for other, text in templates:
            for _, _, own in _chains(text.split(), words, coverage)[:1] if other != label else ():
                told |= set(range(len(words))) - own
        out.append(told)
    return out


def _verified(candidates: DataFrame, templates: list[tuple[str, str]], coverage: float) -> DataFrame:
    """The matches (key, label, start, end, coverage) in candidates (key, number, start, found)."""
    passages, telling = [passage.split() for _, passage in templates], _telling(templates, coverage)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, out = [], []
            for row, (number, low, words) in enumerate(zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)))):
                passage = passages[number]
                for start, end, own in _chains(words, passage, coverage):
                    if telling[number] <= own:
                        owner.append(row)
                        out.append((templates[number][0], low + start, low + end, 2 * len(own) / (len(passage) + end - start)))
            columns = [pa.array([x[k] for x in out], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner, pa.int64())), *columns], names=["key", "label", "start", "end", "coverage"])

    return candidates.select("key", "number", "start", "found").mapInArrow(work, "key binary, label string, start long, end long, coverage double")


def scan(docs: DataFrame, templates: list[tuple[str, str]] | None = None, base: list[tuple[str, str]] | None = None, coverage: float = COVERAGE) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans for every row of docs.

    spans lists the verified matches (label, start word, end word, coverage); `coverage` of a template's words must stand
    there in order, and the value given is twice their number by the words of template and span. score is the best coverage, 1 with a base
    phrase, 0 without any match. Time grows with the length of a text, also where a phrase is repeated all through it.
    Null and empty texts have no words and no labels; rows equal in doc_id and text get
    the same values; only doc_id and text are read. Templates have two words or more.
    """
    templates, base = TEMPLATES if templates is None else templates, BASE if base is None else base
    grams = _grams(docs.sparkSession, templates, base)  # a few hundred rows: the templates are a parameter, not a table
    rows = docs.select(row_key(F.col("doc_id"), F.col("text")).alias("key"), "doc_id", "text")
    words, pos = F.col("words"), F.col("pos")
    probe = word_places(rows, "key").withColumn("hash", F.xxhash64(*[F.get(words, pos + i) for i in range(PROBE)]))
    size = F.size("gram")
    same = (pos + size <= F.size(words)) & (F.slice(words, pos + 1, size) == F.col("gram"))
    votes = settle(
        probe.join(F.broadcast(grams), (F.col("hash") == F.col("h")) & same)
        .select("key", "kind", "template", "label", "tpl", "total", F.col("pos").cast("long").alias("pos"), size.alias("size")).distinct()
    )
    places = votes.filter("kind = 'base'").groupBy("key").agg(
        F.count("*").alias("n_base"), F.min("pos").alias("first_word"), F.max("pos").alias("last_word"), F.collect_set("label").alias("base_set"),
    )
    lengths = F.create_map(*[F.lit(x) for n, (_, passage) in enumerate(templates) for x in (n, len(passage.split()))])
    apart = Window.partitionBy("key", "number").orderBy("diagonal")
    # One row per diagonal: a document has no more of them for a template than it has words.
    diagonals = (
        votes.filter("kind = 'text'").withColumn("number", F.substring("template", 5, 9).cast("int"))
        .groupBy("key", "number", "total", (F.col("pos") - F.col("tpl")).alias("diagonal")).agg(F.collect_set("tpl").alias("tpls"))
        .withColumn("new", F.coalesce((F.col("diagonal") - F.lag("diagonal").over(apart) > DRIFT).cast("int"), F.lit(1)))
        .withColumn("island", F.sum("new").over(apart))
    )
    islands = (
        diagonals.groupBy("key", "number", "total", "island").agg(
            F.min("diagonal").alias("low"), F.max("diagonal").alias("high"), F.size(F.array_distinct(F.flatten(F.collect_set("tpls")))).alias("n"),
        )
        .withColumn("length", lengths[F.col("number")])
        .filter((F.col("length") >= SHORT) | (F.col("n") >= F.col("total") * coverage))
        .select("key", "number", F.greatest(F.col("low") - DRIFT, F.lit(0)).alias("start"), (F.col("high") + F.col("length") + DRIFT).alias("stop"))
    )
    # A document is split into words once for all its islands; together they are no longer than its words and their drift.
    listed = settle(islands.groupBy("key").agg(F.collect_list(F.struct("number", "start", "stop")).alias("islands")))
    texts = rows.join(hinted(listed), "key").select("key", "islands", words_of(text_of()).alias("words"))
    found = texts.select("key", F.explode(F.transform("islands", lambda x: F.struct(
        x["number"].alias("number"), x["start"].alias("start"),
        F.slice("words", (x["start"] + 1).cast("int"), (x["stop"] - x["start"]).cast("int")).alias("found"),
    ))).alias("one")).select("key", "one.*")
    bands = settle(_verified(found, templates, coverage))
    matched = bands.select("key", "label", "start", "end", "coverage").distinct().groupBy("key").agg(
        F.collect_set("label").alias("text_set"), F.max("coverage").alias("best"), F.sort_array(F.collect_list(F.struct("start", "end", "label", "coverage"))).alias("spans"),
    )  # per document, no longer than its own matches
    marked = settle(places.join(matched, "key", "full"))
    none = F.array().cast("array<string>")
    counted = rows.select("key", "doc_id", F.size(words_of(text_of())).cast("long").alias("n_words"))
    return counted.join(hinted(marked), "key", "left").select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0).cast("long")).alias("n_base"), "first_word", "last_word",
        F.array_join(F.sort_array(F.coalesce("base_set", none)), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.array_union(F.coalesce("base_set", none), F.coalesce("text_set", none))), ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"), "spans",
    )
