"""License scans: an exact set-similarity join of text blocks with license templates.

A block (a line) meets a template when it contains at least the share ``threshold`` of the
template's distinct words, that is ``need = ceil(threshold * size)`` of them. Words are ordered by
how many blocks of the corpus hold them, rarest first, and then

* *prefix*: a block that misses the ``size - need + 1`` rarest words of a template cannot meet it;
* *length*: nor can one with fewer than ``need`` words of the template vocabulary;
* *position*: a common word at place ``p`` of the template and ``q`` of the block leaves at most
  ``1 + min(words after p, words after q)`` common words.

What passes is compared in full, so the result is exact. Words outside the template
vocabulary cannot match, so a block is kept as the set of its vocabulary words. One pass reads
the texts; its result, small rows, is written down, the word frequencies are counted from it (one
row per template word, which bounds what comes to the driver), and the join runs on it.

A notice that wraps has too few words on each of its lines. So at every line break the words
around it, one less than the longest template on each side, are searched for templates that stand in
place: ``need`` distinct words of the template, each at its distance from the others, whatever
stands between. Windows that lack ``need`` words of a template are not searched.

Base phrases are found where their words stand consecutively, over the words of the whole text.

Built-in functions only. Defined cases: a null or empty text has no words, places or labels; an
id may be null or repeated, each row is judged alone; further columns are ignored; an empty
table gives no rows; among equal frequencies words are ordered by code point.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vectorloom.llm.columns import col, positions_to
from vectorloom.session import materialize

#: Fixed values of the base search.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PHRASES = {
    "cc-by": ("cc", "by"),
    "gpl": ("general", "public", "license"),
    "reserved": ("all", "rights", "reserved"),
}
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Templates of the method: label -> notice.
TEMPLATES = {
    "apache-notice": "licensed under the apache license version 2 0",
    "mit-notice": "released under the mit license",
    "gpl-notice": "this work is licensed under the gnu general public license version 3",
    "cc-by-nc-notice": "licensed under cc by nc 4 0",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software",
    "bsd-grant": "redistribution and use in source and binary forms with or without modification are permitted",
    "no-reproduction": "no part of this publication may be reproduced without the prior written permission of the publisher",
}
THRESHOLD = 0.8


def words_of(lowered: Column) -> Column:
    return F.regexp_extract_all(lowered, F.lit(WORD), F.lit(0))


def phrase_places(words: Column, joined: Column, phrase: tuple[str, ...]) -> Column:
    """Positions at which the phrase's words stand; texts without them are not searched."""

    def stands(i):
        hit = words[i] == phrase[0]
        for k, word in enumerate(phrase[1:], 1):
            hit = hit & (words[i + k] == word)
        return hit

    places = F.filter(positions_to(F.size(words) - len(phrase)), stands)
    return F.when(joined.contains(" ".join(phrase)), places).otherwise(F.array().cast("array<int>"))


def wrapped(line_words: Column, words: Column, templates: dict[str, list[str]], need: dict[str, int]) -> Column:
    """``(label, share)`` of the templates that stand in place across line breaks."""
    reach = max(map(len, templates.values())) - 1
    ends = F.aggregate(
        line_words,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")),
        lambda acc, line: F.struct(
            (acc["at"] + F.size(line)).alias("at"), F.array_append(acc["out"], acc["at"] + F.size(line)).alias("out")
        ),
        lambda acc: acc["out"],
    )
    breaks = F.filter(F.array_distinct(ends), lambda at: (at > 0) & (at < F.size(words)))
    windows = F.transform(
        breaks, lambda at: F.slice(words, F.greatest(at - reach, F.lit(0)) + 1, F.least(at, F.lit(reach)) + reach)
    )

    def hits(label, text):
        size = len(set(text))
        template = F.array(*map(F.lit, text))
        enough = F.filter(windows, lambda x: F.size(F.array_intersect(x, template)) >= need[label])

        def common(x, i):
            stands = F.filter(template, lambda word, k: F.get(x, i + k) == word)
            return F.size(F.array_distinct(stands))

        best = F.array_max(
            F.flatten(F.transform(enough, lambda x: F.transform(positions_to(F.size(x) - 1), lambda i: common(x, i))))
        )
        return F.when(best >= need[label], F.struct(F.lit(label).alias("label"), (best / size).alias("share")))

    found = F.array(*[hits(label, text) for label, text in templates.items()])
    return F.filter(found, lambda x: x.isNotNull())


def scan(
    docs: DataFrame,
    templates: dict[str, str] = TEMPLATES,
    threshold: float = THRESHOLD,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score)``.

    ``labels`` and ``base_labels`` are arrays; ``score`` is 1 with a base phrase, else the largest
    containment among the templates met, else 0.
    """
    spark = docs.sparkSession
    sets = {label: sorted(set(text.split())) for label, text in templates.items()}
    need = {label: max(1, math.ceil(threshold * len(s) - 1e-9)) for label, s in sets.items()}
    vocabulary = sorted({w for s in sets.values() for w in s})
    vocabulary_col = F.array(*map(F.lit, vocabulary))

    lowered = F.translate(F.coalesce(col(text_col), F.lit("")), UPPER, LOWER)
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), col(id_col).cast("long").alias("doc_id"), lowered.alias("t")
    )
    rows = rows.select("row", "doc_id", F.transform(F.split("t", "\n", -1), words_of).alias("lines"))
    # No word holds a line break, so the words of the lines are those of the text.
    rows = rows.select("row", "doc_id", "lines", F.flatten("lines").alias("w"))
    rows = rows.select("row", "doc_id", "lines", "w", F.array_join("w", " ").alias("joined"))
    blocks = F.transform("lines", lambda line: F.array_intersect(line, vocabulary_col))
    in_order = {label: text.split() for label, text in templates.items()}
    least = min(need.values())
    places = {label: phrase_places(F.col("w"), F.col("joined"), p) for label, p in PHRASES.items()}
    read = rows.select(
        "row", "doc_id", F.size("w").cast("long").alias("n_words"),
        F.struct(*[p.alias(label) for label, p in places.items()]).alias("places"),
        F.filter(blocks, lambda b: F.size(b) >= least).alias("blocks"),
        wrapped(F.col("lines"), F.col("w"), in_order, need).alias("wrapped"),
    )
    read = materialize(read, "license-blocks")

    counts = read.select(F.explode(F.flatten("blocks")).alias("word")).groupBy("word").count()
    frequency = {r["word"]: r["count"] for r in counts.collect()}
    order = sorted(vocabulary, key=lambda word: (frequency.get(word, 0), word))
    rank = {word: i for i, word in enumerate(order)}
    prefixes = [
        (word, position, label, len(words), need[label], [rank[w] for w in words])
        for label, s in sets.items()
        for words in [sorted(s, key=rank.__getitem__)]
        for position, word in enumerate(words[: len(words) - need[label] + 1])
    ]
    prefix_table = spark.createDataFrame(
        [(rank[p[0]], *p[1:]) for p in prefixes],
        "word int, position int, label string, size int, need int, template array<int>",
    )
    prefix_words = F.array(*map(F.lit, sorted({p[0] for p in prefixes})))
    ranks = F.create_map(*[F.lit(x) for pair in rank.items() for x in pair])
    candidates = read.select(
        "row", F.explode(F.filter("blocks", lambda b: F.arrays_overlap(b, prefix_words))).alias("b")
    ).select("row", F.sort_array(F.transform("b", lambda word: F.element_at(ranks, word))).alias("block"))
    met = candidates.select("row", "block", F.posexplode("block").alias("at", "word")).join(prefix_table, "word")
    common = F.size(F.array_intersect("block", "template"))
    after = F.least(F.col("size") - F.col("position") - 1, F.size("block") - F.col("at") - 1)
    found = (
        met.where((F.size("block") >= F.col("need")) & (1 + after >= F.col("need")))
        .where(common >= F.col("need"))
        .groupBy("row")
        .agg(F.collect_set("label").alias("own"), F.max(common / F.col("size")).alias("best"))
    )
    everywhere = F.concat(*[F.col("places")[label] for label in PHRASES])
    base = F.filter(
        F.array(*[F.when(F.size(F.col("places")[label]) > 0, F.lit(label)) for label in PHRASES]), lambda x: x.isNotNull()
    )
    own = F.array_union(F.coalesce("own", F.array().cast("array<string>")), F.transform("wrapped", lambda x: x["label"]))
    best = F.greatest("best", F.array_max(F.transform("wrapped", lambda x: x["share"])), F.lit(0.0))
    return read.join(found, "row", "left").select(
        "doc_id",
        "n_words",
        F.size(everywhere).cast("long").alias("n_base"),
        F.array_min(everywhere).cast("long").alias("first_word"),
        F.array_max(everywhere).cast("long").alias("last_word"),
        F.sort_array(base).alias("base_labels"),
        F.sort_array(F.array_union(base, own)).alias("labels"),
        F.when(F.size(base) > 0, F.lit(1.0)).otherwise(best).alias("score"),
    )
