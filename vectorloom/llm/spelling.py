"""Spelling variants: words that differ by one letter, found with PartEnum signatures.

Arasu, Ganti, Kaushik, "Efficient Exact Set-Similarity Joins" (VLDB 2006). The letters of a word
are a multiset, written as a binary vector with one dimension per (letter, how often seen before).
One inserted or deleted letter flips one dimension, a replaced one two, so words that are near
have vectors at a Hamming distance of at most :data:`DISTANCE`. The dimensions are dealt into
:data:`PARTS` parts; two such vectors agree on at least ``PARTS - DISTANCE`` of them. Every choice
of that many parts is enumerated as a signature, and words that share one meet in an equi-join.

1. Runs are counted per task and document, with the deletions the counting rule asks for; partial
   counts are summed by word. A text is read in blocks, the table of a task is emptied when it is full.
2. Words get their signatures. Anagram-like words crowd some of them: in buckets of more than
   :data:`CROWD` words the signature is joined with each word formed by leaving out one letter (and
   the word itself). Near words have one of these in common, and a bucket of a word of length L
   then holds at most ``(L + 1) * 117`` words, so no bucket is unbounded and no pair is lost.
3. Pairs of a bucket are verified by their edit distance. Signatures are hashes: a collision adds
   a candidate, never a result.
4. Forms are followed to the root by pointer doubling: counts grow fivefold per step, so chains are
   short, and each round is written down.

Defined cases: null, empty or blank texts have no words; a null id counts as the text ``null`` in
the deletion rule; repeated rows count once each; equal counts go to the smaller word in code-point
order; further columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import itertools
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectorloom.llm.columns import col
from vectorloom.session import materialize

#: Letters of a run, what is lower-cased, and the divisor of the deletion rule.
LETTERS = "A-Za-zÀ-ÿ"
LOWER = {upper: upper + 32 for upper in range(ord("A"), ord("Z") + 1)}
DELETE_EVERY = 199

LEAST_LENGTH = 6
LEAST_COUNT = 5
FORM_RATIO = 5

DISTANCE, PARTS = 2, 4
CROWD = 64

#: Words a task keeps before it sends partial counts, and runs of a text counted at a time.
TABLE_WORDS = 200_000
BLOCK_RUNS = 100_000

#: Odd multipliers of the hashes.
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
MIX = (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * MIX[0]
    x = (x ^ (x >> np.uint64(29))) * MIX[1]
    return x ^ (x >> np.uint64(32))


def run_counts(text: str, pattern: re.Pattern):
    """Counters of the runs of one text, each over a bounded number of them."""
    runs = pattern.finditer(text)
    while block := Counter(m.group() for m in itertools.islice(runs, BLOCK_RUNS)):
        yield block


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(word, n)`` of all words frequent and long enough.

    A run whose crc32 with its document's id is a multiple of :data:`DELETE_EVERY` loses one letter.
    """
    pattern = re.compile(f"[{LETTERS}]{{{LEAST_LENGTH},}}")  # shorter runs never make a word

    def counted(batches):
        whole: dict[str, list] = {}  # run as written -> [word, its bytes, occurrences]
        cut: Counter = Counter()

        def drain():
            found = Counter(cut)
            for word, _, n in whole.values():
                found[word] += n
            whole.clear()
            cut.clear()
            kept = [(w, n) for w, n in found.items() if n and len(w) >= LEAST_LENGTH]
            for at in range(0, len(kept), 50_000):
                words, counts = zip(*kept[at : at + 50_000])
                yield pa.record_batch({"word": pa.array(words), "n": pa.array(counts, pa.int64())})

        for batch in batches:
            for name, text in zip(batch.column(0), batch.column(1)):
                name, text = name.as_py(), text.as_py()
                if not text:
                    continue
                prefix = crc32(f"{'null' if name is None else name}:".encode())
                for block in run_counts(text, pattern):
                    for run, n in block.items():
                        entry = whole.get(run)
                        if entry is None:
                            word = run.translate(LOWER)
                            entry = whole[run] = [word, word.encode(), 0]
                        h = crc32(entry[1], prefix)
                        if h % DELETE_EVERY:
                            entry[2] += n
                        else:
                            at = h % len(run)
                            cut[entry[0][:at] + entry[0][at + 1 :]] += n
                    if len(whole) + len(cut) > TABLE_WORDS:
                        yield from drain()
        yield from drain()

    parts = docs.select(col(id_col), col(text_col)).mapInArrow(counted, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def letters_of(words: pa.Array):
    """All letters one after another: code point, word number, place in the word, word lengths."""
    text = words.to_pylist()
    points = np.frombuffer("".join(text).encode("utf-32-le"), dtype="<u4").astype(np.uint64)
    lengths = np.array([len(w) for w in text], dtype=np.int64)
    owner = np.repeat(np.arange(len(text)), lengths)
    place = np.arange(len(points)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    return points, owner, place, lengths


def signatures(words: pa.Array) -> np.ndarray:
    """``words x choices of parts``: hashes of the letter multisets projected on these parts."""
    points, owner, _, lengths = letters_of(words)
    # How often the letter stood in the word before: with the letter, a dimension of the vector.
    order = np.lexsort((points, owner))
    fresh = np.ones(len(order), dtype=bool)
    fresh[1:] = (np.diff(owner[order]) != 0) | (points[order][1:] != points[order][:-1])
    at = np.arange(len(order))
    seen = np.empty(len(order), dtype=np.uint64)
    seen[order] = at - np.maximum.accumulate(np.where(fresh, at, 0))
    dimension = mixed(points * BASE + seen + np.uint64(1))
    part = ((mixed(points) + seen) % np.uint64(PARTS)).astype(np.int64)
    sums = np.zeros((len(lengths), PARTS), dtype=np.uint64)
    np.add.at(sums, (owner, part), dimension)
    choices = list(itertools.combinations(range(PARTS), PARTS - DISTANCE))
    out = np.empty((len(lengths), len(choices)), dtype=np.uint64)
    for c, parts in enumerate(choices):
        key = np.full(len(lengths), c + 1, dtype=np.uint64)
        for p in parts:
            key = mixed(key * BASE + sums[:, p])
        out[:, c] = key
    return out


def gap_hashes(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every word and of the word without each of its letters, with the word's number.

    A word is a polynomial in :data:`BASE`; leaving out a letter moves the rest down by one power,
    so all hashes of a word take time in proportion to its length.
    """
    points, owner, place, lengths = letters_of(words)
    if not len(points):
        return np.arange(len(lengths)), np.zeros(len(lengths), dtype=np.uint64)
    powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(lengths.max(), BASE)]), dtype=np.uint64)
    terms = (points + np.uint64(1)) * powers[place]
    running = np.concatenate([[np.uint64(0)], np.cumsum(terms, dtype=np.uint64)])
    ends = np.cumsum(lengths)
    first, last = running[ends - lengths], running[ends]
    before = running[:-1] - first[owner]
    after = last[owner] - running[1:]
    owners = np.concatenate([np.arange(len(lengths)), owner])
    return owners, np.concatenate([last - first, before + after * BASE_INVERSE])


def signature_rows(words: DataFrame) -> DataFrame:
    """``(key, word, n)``: a row per signature of every word."""

    def expand(batches):
        for batch in batches:
            keys = signatures(batch.column(0))
            row = np.repeat(np.arange(len(keys)), keys.shape[1])
            yield pa.record_batch(
                {
                    "key": pa.array(keys.ravel().view(np.int64)),
                    "word": batch.column(0).take(row),
                    "n": batch.column(1).take(row),
                }
            )

    return words.select("word", "n").mapInArrow(expand, "key long, word string, n long")


def refined(rows: DataFrame) -> DataFrame:
    """Rows of crowded buckets, their key joined with every word that lacks one letter."""

    def expand(batches):
        for batch in batches:
            owner, gaps = gap_hashes(batch.column(1))
            key = batch.column(0).to_numpy().view(np.uint64)[owner]
            pairs = np.unique(np.rec.fromarrays([owner, mixed(key * BASE + gaps)]))
            at = pa.array(pairs["f0"])
            yield pa.record_batch(
                {
                    "key": pa.array(pairs["f1"].view(np.int64)),
                    "word": batch.column(1).take(at),
                    "n": batch.column(2).take(at),
                }
            )

    return rows.select("key", "word", "n").mapInArrow(expand, "key long, word string, n long")


def near_pairs(words: DataFrame, crowd: int = CROWD) -> DataFrame:
    """``(a, a_n, b, b_n)`` of all pairs of words at edit distance one, ``a < b``."""
    rows = materialize(signature_rows(words), "signatures")
    crowded = rows.groupBy("key").count().where(F.col("count") > crowd).select("key", F.lit(True).alias("crowded"))
    marked = rows.join(crowded, "key", "left")
    calm = marked.where("crowded is null").select("key", "word", "n")
    keyed = calm.unionByName(refined(marked.where("crowded")))
    keyed = materialize(keyed, "keyed")
    left = keyed.select("key", F.col("word").alias("a"), F.col("n").alias("a_n"))
    right = keyed.select("key", F.col("word").alias("b"), F.col("n").alias("b_n"))
    met = left.join(right, "key").where(F.col("a") < F.col("b"))
    lengths = F.abs(F.length("a") - F.length("b")) <= 1
    near = met.where(lengths & (F.levenshtein("a", "b", 1) == 1))
    return near.select("a", "a_n", "b", "b_n").distinct()


def roots(links: DataFrame) -> DataFrame:
    """``(word, root)`` of ``links(word, form)``: forms followed to the last one."""
    state = materialize(links.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = state.select(F.col("word").alias("root"), F.col("root").alias("next"))
        joined = state.join(ahead, "root", "left")
        moved = materialize(
            joined.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")),
            "roots",
        )
        state = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return state


def group_variants(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", crowd: int = CROWD
) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` of every word."""
    words = materialize(word_counts(docs, id_col, text_col), "words")
    pairs = near_pairs(words, crowd)
    ends = F.array(
        F.struct(F.col("a").alias("word"), F.struct((-F.col("b_n")).alias("minus_n"), F.col("b").alias("other")).alias("to")),
        F.struct(F.col("b").alias("word"), F.struct((-F.col("a_n")).alias("minus_n"), F.col("a").alias("other")).alias("to")),
    )
    both = pairs.select(F.inline(ends))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min("to").alias("to"))
    formed = -F.col("to.minus_n") >= FORM_RATIO * F.col("n")
    known = materialize(
        words.join(best, "word", "left").select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(formed, F.col("to.other")).alias("form"),
            F.when(formed, -F.col("to.minus_n")).alias("form_n"),
        ),
        "variants",
    )
    ends_at = roots(known.where("form is not null"))
    return known.join(ends_at, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
