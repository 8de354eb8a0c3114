"""Secrets in texts: fixed patterns, and strings that look random rather than written.

Two character Markov models of order one are trained from labelled samples: one of random strings,
one of ordinary identifiers and words. A run of at least :data:`LEAST_RUN` characters of
:data:`ALPHABET` is a secret of kind ``random`` when the logarithm of its likelihood ratio reaches
:data:`THRESHOLD`; runs that overlap a span of a fixed kind are left to that span.

The samples are labelled by the corpus itself: random are the long hexadecimal runs and access keys
that the patterns confirm, and of every text its SHA-256 digest in hexadecimal and in base 64, so that
both alphabets are known even where no text holds a secret; ordinary is every run outside confirmed
spans, and of every text the start of its digest as a decimal number: plain numbers are no secrets. Further labelled strings may be given. Counts cover all texts: tasks send one row per pair of
characters, so what is gathered is bounded by the square of the alphabet, and only the table of
log-likelihood ratios goes to the tasks. Ratios are whole thousandths: scores do not depend on order.

Texts are read as UTF-8 bytes (all patterns are ASCII), counted in blocks; positions become code points
only in texts with a span. Nothing is shuffled but the counts.

Defined cases: a null or empty text has no spans; rows are handled one by one, so repeated rows and
null ids are kept; further columns are kept; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectorloom.llm.columns import col, fresh

#: Base kinds in their order, their patterns and least lengths.
BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "random")
ASSIGN = rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = rb"AKIA[A-Z0-9]+"
HEX = rb"[0-9a-f]+"
LEAST_VALUE, LEAST_ACCESS, LEAST_HEX = 8, 16, 32
ASSIGN_HINTS = (b"passw", b"secret", b"token", b"apikey", b"api_key")

#: Characters the models know; everything else ends a run.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"
RUN = rb"[A-Za-z0-9+/_-]"
#: Hexadecimal spans lie inside candidates, so this must not exceed LEAST_HEX.
LEAST_RUN = 20
#: Least log-likelihood ratio of a secret, in thousandths (20: odds of about 5e8 to 1).
THRESHOLD = 20_000

#: Hexadecimal digits of a digest that become a number.
NUMBER_DIGITS = 15

#: Bytes counted at a time.
BLOCK = 1 << 20
SIZE = len(ALPHABET) + 1  # class 0: the start of a run

COUNTS = "secret boolean, before int, after int, n long"
SPANS = "array<struct<kind:string,start:long,end:long,score:long>>"


def classes() -> np.ndarray:
    """Class of each byte: its place in the alphabet from 1, else 0."""
    table = np.zeros(256, dtype=np.uint8)
    table[np.frombuffer(ALPHABET.encode(), dtype=np.uint8)] = np.arange(1, SIZE)
    return table


class Patterns:
    """Compiled patterns; made inside a task."""

    def __init__(self):
        self.assign = re.compile(ASSIGN, re.IGNORECASE)
        self.access, self.hex = re.compile(ACCESS), re.compile(HEX)
        self.run = re.compile(RUN + b"{%d}" % LEAST_RUN + RUN + b"*")

    def spans(self, text: bytes):
        """Byte spans of the base kinds as ``(start, kind number, end)``, and candidates ``(start, end)``."""
        found, runs = [], []
        for m in self.run.finditer(text):
            runs.append(m.span())
            for h in self.hex.finditer(text, *m.span()):
                if h.end() - h.start() >= LEAST_HEX:
                    found.append((h.start(), 2, h.end()))
        if b"AKIA" in text:
            found += [
                (m.start(), 1, m.end()) for m in self.access.finditer(text) if m.end() - m.start() >= LEAST_ACCESS
            ]
        lower = text.lower()
        if any(hint in lower for hint in ASSIGN_HINTS):
            found += [
                (m.start(), 0, m.end()) for m in self.assign.finditer(text) if len(m.group(2)) >= LEAST_VALUE
            ]
        found.sort()
        return found, runs


class PairCounts:
    """Counts of neighbouring characters inside runs."""

    def __init__(self):
        self.table = classes()
        self.counts = np.zeros((2, SIZE * SIZE), dtype=np.int64)

    def add(self, secret: int, text: bytes, skip=()) -> None:
        last = 0
        skip = sorted(skip)
        for start in range(0, len(text), BLOCK):
            part = self.table[np.frombuffer(text, np.uint8, min(BLOCK, len(text) - start), start)]
            for a, b in skip:
                if a < start + BLOCK and b > start:
                    part[max(0, a - start) : max(0, b - start)] = 0
            before = np.empty(len(part), dtype=np.int64)
            before[0], before[1:] = last, part[:-1]
            self.counts[secret] += np.bincount(before * SIZE + part, minlength=SIZE * SIZE)
            last = part[-1]

    def batch(self) -> pa.RecordBatch:
        secret, pair = np.nonzero(self.counts)
        keep = pair % SIZE > 0  # what follows the end of a run is not a step of the chain
        secret, pair = secret[keep], pair[keep]
        return pa.record_batch(
            {
                "secret": pa.array(secret == 1),
                "before": pa.array((pair // SIZE).astype(np.int32)),
                "after": pa.array((pair % SIZE).astype(np.int32)),
                "n": pa.array(self.counts[secret, pair]),
            }
        )


def corpus_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``(secret, before, after, n)`` counted by each task over its texts, labelled as above."""

    def count(batches):
        patterns, pairs = Patterns(), PairCounts()
        for batch in batches:
            for value in batch.column(0):
                text = (value.as_py() or "").encode()
                found, _ = patterns.spans(text)
                pairs.add(0, text, [(start, end) for start, _, end in found])
                digest = hashlib.sha256(text).digest()
                pairs.add(0, str(int(digest.hex()[:NUMBER_DIGITS], 16)).encode())
                random = [text[start:end] for start, kind, end in found if kind > 0]
                pairs.add(1, b" ".join([*random, digest.hex().encode(), base64.b64encode(digest)]))
        yield pairs.batch()

    return docs.select(col(text_col)).mapInArrow(count, COUNTS)


def sample_counts(samples: DataFrame) -> DataFrame:
    """The same counts of labelled strings ``(value string, secret boolean)``; nulls are left out."""

    def count(batches):
        pairs = PairCounts()
        for batch in batches:
            for value, secret in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                pairs.add(int(secret), value.encode())
        yield pairs.batch()

    known = samples.where("value is not null and secret is not null")
    return known.select("value", F.col("secret").cast("boolean")).mapInArrow(count, COUNTS)


def likelihood_ratios(counts: DataFrame) -> np.ndarray:
    """``before x after``: log-likelihood ratio of each step in thousandths, random over ordinary.

    Every step is counted once more than seen, so none is impossible.
    """
    totals = counts.groupBy("secret", "before", "after").agg(F.sum("n").alias("n")).toArrow()
    seen = np.zeros((2, SIZE, SIZE))
    at = (totals.column("secret").to_numpy().astype(int), totals.column("before"), totals.column("after"))
    seen[at[0], at[1].to_numpy(), at[2].to_numpy()] = totals.column("n").to_numpy()
    steps = seen[:, :, 1:]
    logs = np.log((steps + 1) / (steps.sum(axis=2, keepdims=True) + SIZE - 1))
    out = np.zeros((SIZE, SIZE), dtype=np.int64)
    out[:, 1:] = (np.round(1000 * logs[1]) - np.round(1000 * logs[0])).astype(np.int64)
    return out


def run_score(ratios: np.ndarray, run: np.ndarray) -> int:
    """Sum over the steps of a run given as classes."""
    return int(ratios[np.concatenate([[0], run[:-1]]), run].sum())


def find(docs: DataFrame, text_col: str = "text", ratios: np.ndarray | None = None) -> tuple[DataFrame, str]:
    """``docs`` with the spans of each text by start, then kind; returns the column's name too.

    ``ratios``: a trained table; by default the texts themselves label the samples.
    """
    if ratios is None:
        ratios = likelihood_ratios(corpus_counts(docs, text_col))
    name = fresh(docs, "spans")
    # Columns travel by place: a name may hold a dot.
    given = docs.select(*[col(c).alias(f"c{i}") for i, c in enumerate(docs.columns)], col(text_col).alias("text"))
    schema = docs.withColumn(name, F.lit(None).cast(SPANS)).schema

    def scan(batches):
        patterns, table = Patterns(), classes()
        kinds = pa.list_(
            pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.int64())])
        )
        for batch in batches:
            rows = []
            for value in batch.column(batch.num_columns - 1):
                text = (value.as_py() or "").encode()
                found, runs = patterns.spans(text)
                all_spans = [(start, kind, end, 0) for start, kind, end in found]
                # Base spans by start; the furthest end so far decides what a candidate overlaps.
                at, reach = 0, 0
                for start, end in runs:
                    while at < len(found) and found[at][0] < end:
                        reach = max(reach, found[at][2])
                        at += 1
                    if reach <= start:
                        score = run_score(ratios, table[np.frombuffer(text, np.uint8, end - start, start)])
                        if score >= THRESHOLD:
                            all_spans.append((start, 3, end, score))
                all_spans.sort()
                place = None if text.isascii() or not all_spans else code_points(text)
                rows.append(
                    [
                        {
                            "kind": KINDS[kind],
                            "start": start if place is None else int(place[start]),
                            "end": end if place is None else int(place[end]),
                            "score": score,
                        }
                        for start, kind, end, score in all_spans
                    ]
                )
            columns = [*batch.columns[:-1], pa.array(rows, kinds)]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return given.mapInArrow(scan, schema), name


def code_points(text: bytes) -> np.ndarray:
    """Code points before each byte offset, the end included."""
    leads = (np.frombuffer(text, np.uint8) & 0xC0) != 0x80
    return np.concatenate([[0], np.cumsum(leads, dtype=np.int64)])


def number_of(spans, kind: str):
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def marked(spans, *kinds: str):
    """Column: ``kind:start:end`` of the spans of these kinds, comma-joined in their order."""
    chosen = F.filter(spans, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(chosen, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
