"""Tables with the odd cases that every operator has to stand."""

from __future__ import annotations

import random

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, "
    "n_words string, words string, size int, row_key string, `a.b` string, spans string, measures int"
)

LONG = " ".join(random.Random(5).choices(["one", "two", "three", "été", "x1", "Ω!", "\n"], k=30_000))
TEXTS = [
    None,
    "",
    " \t\n ",
    "word",
    "it's we're  double   triple\n \n end ",
    LONG,
    "x" * 5000,
    "tie " * 60,
    "日本語 text with 😀 emoji and <|endoftext|> inside",
    "mail a.b+c@ex-am.ple.org, a@b.c_d@e.f or 10.0.0.1 and 1.2.3.4.5.6.7.8 and 999.1.1.1",
    "card 4111 1111 1111 1111 or 4111-1111-1111-1112, phone +49 (30) 1234-567 and +1 2",
    "IBAN DE89 3704 0044 0532 0130 00 of the account; ssn 123-45-6789; id 987-65-4321",
    "This work is Licensed under the Apache License, version 2.0.\nAll rights reserved. CC BY cc by",
]


def rows():
    out = []
    for i, text in enumerate(TEXTS):
        out.append((i * 3, text, "en" if i % 3 else None, f"s{i % 4}" if i % 5 else None, 1, "c", "d", 5, "e", "f", "g", 7))
    out.append(out[7])  # a repeated row
    out.append((None, "no id here", "en", "", 1, "c", "d", 5, "e", "f", "g", 7))
    out.append((9, "another text of a known id", "en", "s1", 1, "c", "d", 5, "e", "f", "g", 7))
    return out


def odd_docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


def native(df) -> bool:
    plan = df._jdf.queryExecution().executedPlan().toString()
    return not any(word in plan for word in ("Python", "Pandas", "Arrow"))
