"""N-gram Jaccard join of documents by MinHash banding.

A document is the set of its word 5-grams (a shorter text: of its whole word sequence). Two
documents are linked when the Jaccard similarity of their sets is at least ``threshold``.

1. Equal texts (by digest) are one text from here on.
2. Every text gets ``bands x rows`` MinHash values; both numbers follow from the threshold and
   the target recall (:func:`choose_bands`). Texts meet when all values of a band are equal:
   the hashes of the bands are shuffled, without the texts.
3. Pairs that meet are compared on their whole signatures. The share of equal values estimates
   the similarity, and the cut lies so low that a pair at the threshold falls below it with
   probability ``MISS``. That removes chance meetings; connected components of the rest are
   families, so that the text of each is shuffled once, not once per band.
4. Inside families all pairs are verified on their full n-gram sets (64-bit fingerprints).
   Verified links are counted per text, and their components are the classes.

Large buckets and large families are cut into blocks of bounded size; each pair of blocks is a
cell of its own, so no group is ever in one task, and a cell gives counts and a spanning
forest, never its pairs.

Defined cases: null, empty or blank texts have no n-grams, are linked to nothing and are
classes of their own; equal texts share class and links, copies are not links; rows with the
same doc_id are documents each; the class id is the smallest doc_id of the class (null only if
all are); further columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vectorloom.llm.columns import col, fresh, row_key
from vectorloom.llm.graph import components
from vectorloom.session import materialize

WORDS_PER_GRAM = 5
THRESHOLD = 0.8
RECALL = 0.9999
MOST_HASHES = 128
#: Chance that a pair at the threshold is lost by the comparison of signatures.
MISS = 1e-9
#: Texts per block of a bucket or family, and n-grams per block of a family.
BLOCK = 512
BLOCK_GRAMS = 2_000_000

#: Odd multipliers of the hash functions.
WORD_BASE, GRAM_BASE = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)
MIX = (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53))


def choose_bands(threshold: float, recall: float, most: int = MOST_HASHES) -> tuple[int, int]:
    """(bands, rows) with the most rows, so the fewest chance meetings, that reach ``recall``
    at ``threshold`` with at most ``most`` hash values."""
    best = None
    for rows in range(1, most + 1):
        bands = math.ceil(math.log(1 - recall) / math.log1p(-(threshold**rows)))
        if bands * rows > most:
            break
        best = bands, rows
    if best is None:
        raise ValueError("the recall cannot be reached with so few hash values")
    return best


def signature_cut(hashes: int, threshold: float, miss: float = MISS) -> int:
    """Largest ``c`` with P(Binomial(hashes, threshold) < c) <= miss."""
    total, c = 0.0, 0
    while c < hashes:
        total += math.comb(hashes, c) * threshold**c * (1 - threshold) ** (hashes - c)
        if total > miss:
            break
        c += 1
    return c


# --- n-grams --------------------------------------------------------------------------------


def mixed(h: np.ndarray) -> np.ndarray:
    for m in MIX:
        h = (h ^ (h >> np.uint64(33))) * m
    return h ^ (h >> np.uint64(33))


def powers(n: int) -> np.ndarray:
    out = np.full(n, WORD_BASE, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def grams(texts: list[str | None], n: int = WORDS_PER_GRAM) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprints of all n-grams, how many each text has), text after text."""
    raw = [(t or "").encode() for t in texts]
    data = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    sizes = np.array([len(r) + 1 for r in raw])
    letters = np.flatnonzero(~space)
    counts = np.zeros(len(texts), np.int64)
    if not len(letters):
        return np.empty(0, np.uint64), counts
    first = np.flatnonzero(np.diff(letters, prepend=-2) > 1)
    length = np.diff(first, append=len(letters))
    place = np.arange(len(letters)) - np.repeat(first, length)
    values = (data[letters].astype(np.uint64) + np.uint64(1)) * powers(int(length.max()))[place]
    words = mixed(np.add.reduceat(values, first))
    owner = np.searchsorted(np.cumsum(sizes), letters[first], "right")
    per_text = np.bincount(owner, minlength=len(texts))
    starts = np.cumsum(per_text) - per_text
    # A shorter text is one n-gram of all its words; words beyond its end count as 0.
    counts = np.where(per_text >= n, per_text - n + 1, (per_text > 0).astype(np.int64))
    begin = np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
    stop = np.repeat(starts + per_text, counts)
    padded = np.append(words, np.zeros(n, np.uint64))
    out = np.zeros(len(begin), np.uint64)
    for k in range(n):
        out = out * GRAM_BASE + np.where(begin + k < stop, padded[begin + k], np.uint64(0))
    return mixed(out), counts


def text_groups(texts: list, size: int = 1 << 20):
    """Slices of ``texts`` of about ``size`` characters."""
    start = total = 0
    for i, text in enumerate(texts):
        total += len(text or "")
        if total >= size:
            yield slice(start, i + 1)
            start, total = i + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))


def signatures(fingerprints: np.ndarray, counts: np.ndarray, multipliers: np.ndarray) -> np.ndarray:
    """MinHash values, one row per text with n-grams."""
    some = counts[counts > 0]
    starts = np.cumsum(some) - some
    out = np.empty((len(some), len(multipliers)), np.uint64)
    for k, m in enumerate(multipliers):
        out[:, k] = np.minimum.reduceat(fingerprints * m, starts)
    return out


def multipliers(hashes: int, seed: int = 7) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 63, hashes, np.uint64) * np.uint64(2) + np.uint64(1)


SIGNED = "doc_id long, digest binary, key binary, n_grams long, bands array<long>, signature binary"


def sign(docs: DataFrame, bands: int, rows: int) -> DataFrame:
    """Digest, band hashes and signature (16 bits per value) of every row of (doc_id, digest, key, text)."""

    def work(batches):
        factors = multipliers(bands * rows)
        for batch in batches:
            texts = batch.column(3).to_pylist()
            for part in text_groups(texts):
                prints, counts = grams(texts[part])
                has = counts > 0
                band_values, short = [None] * len(counts), [None] * len(counts)
                if has.any():
                    values = signatures(prints, counts, factors)
                    keys = np.tile(np.arange(1, bands + 1, dtype=np.uint64), (len(values), 1))
                    for k in range(rows):
                        keys = mixed(keys * GRAM_BASE + values[:, k::rows][:, :bands])
                    low = (values >> np.uint64(48)).astype("<u2")
                    for at, key, sig in zip(np.flatnonzero(has), keys.view(np.int64).tolist(), low):
                        band_values[at], short[at] = key, sig.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [
                        *[batch.column(c)[part.start : part.stop] for c in range(3)],
                        pa.array(counts),
                        pa.array(band_values, pa.list_(pa.int64())),
                        pa.array(short, pa.binary()),
                    ],
                    names=["doc_id", "digest", "key", "n_grams", "bands", "signature"],
                )

    return docs.select("doc_id", "digest", "key", "text").mapInArrow(work, SIGNED)


# --- cells ----------------------------------------------------------------------------------


def cells(members: DataFrame, blocks) -> DataFrame:
    """Copies of each row for the cells ``(i, j)``, ``i <= j``, of its group's blocks."""
    cut = members.withColumn("blocks", blocks.cast("int"))
    cut = cut.withColumn("block", F.pmod(F.xxhash64("digest"), F.col("blocks")).cast("int"))
    spread = cut.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    return spread.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other")).drop(
        "blocks", "other"
    )


def sorted_groups(batches):
    """Rows of Arrow batches sorted by their first three columns, group by group."""
    rows = itertools.chain.from_iterable(zip(*(c.to_pylist() for c in b.columns)) for b in batches)
    for _, group in itertools.groupby(rows, key=lambda row: row[:3]):
        yield list(group)


class Forest:
    """Union-find over the positions of a cell."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.root(x), self.root(y)
        self.up[max(x, y)] = min(x, y)


def allowed_pairs(rows: list[tuple]) -> np.ndarray:
    """Which pairs a cell is to compare: inside a block, or between its two blocks."""
    block = np.array([r[4] for r in rows])
    if rows[0][1] == rows[0][2]:
        return ~np.eye(len(rows), dtype=bool)
    return block[:, None] != block[None, :]


EDGES = "a binary, b binary"


def meet(in_cells: DataFrame, cut: int) -> DataFrame:
    """A spanning forest of the pairs of each cell whose signatures agree on ``cut`` values."""

    def compare(batches):
        out: list[tuple] = []
        for rows in sorted_groups(batches):
            rows = list({r[3]: r for r in rows}.values())
            if len(rows) < 2:
                continue
            sig = np.frombuffer(b"".join(r[5] for r in rows), "<u2").reshape(len(rows), -1)
            forest = Forest(len(rows))
            cross = rows[0][1] != rows[0][2]
            block = np.array([r[4] for r in rows])
            for x in range(len(rows) - 1):
                close = (sig[x + 1 :] == sig[x]).sum(axis=1) >= cut
                if cross:
                    close &= block[x + 1 :] != block[x]
                for y in np.flatnonzero(close).tolist():
                    forest.join(x, x + 1 + y)
            out += [(r[3], rows[root][3]) for k, r in enumerate(rows) if (root := forest.root(k)) != k]
            if len(out) >= 10_000:
                yield edge_batch(out)
                out = []
        yield edge_batch(out)

    return in_cells.mapInArrow(compare, EDGES)


def edge_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in columns], names=["a", "b"])


def common_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections, by products of 0/1 matrices of shared n-grams."""
    n = len(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    values = np.concatenate(sets)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    new = np.diff(values, prepend=values[:1] + np.uint64(1)) != 0
    column = np.cumsum(new) - 1
    shared = np.bincount(column)[column] > 1
    owner, column = owner[shared], column[shared]
    _, column = np.unique(column, return_inverse=True)
    total = np.zeros((n, n), np.int64)
    step = max(64, 4_000_000 // n)
    width = int(column[-1]) + 1 if len(column) else 0
    for start in range(0, width, step):
        a, b = np.searchsorted(column, [start, start + step])
        x = np.zeros((n, min(step, width - start)), np.float32)
        x[owner[a:b], column[a:b] - start] = 1
        total += (x @ x.T).astype(np.int64)
    return total


LINKS = "a binary, b binary, links long"


def verify(in_cells: DataFrame, threshold: float) -> DataFrame:
    """Per cell and text its number of links (``b`` null), and a spanning forest of the links."""

    def compare(batches):
        out: list[tuple] = []
        for rows in sorted_groups(batches):
            rows = list({r[3]: r for r in rows}.values())
            if len(rows) < 2:
                continue
            sets = []
            for part in text_groups([r[5] for r in rows]):
                prints, counts = grams([r[5] for r in rows[part]])
                sets += [np.unique(s) for s in np.split(prints, np.cumsum(counts)[:-1])]
            size = np.array([len(s) for s in sets])
            common = common_counts(sets)
            union = size[:, None] + size[None, :] - common
            linked = (common >= threshold * union - 1e-9) & allowed_pairs(rows)
            forest = Forest(len(rows))
            for x, y in zip(*np.nonzero(np.triu(linked))):
                forest.join(int(x), int(y))
            for k, links in enumerate(linked.sum(axis=1).tolist()):
                if links:
                    out.append((rows[k][3], None, links))
                if (root := forest.root(k)) != k:
                    out.append((rows[k][3], rows[root][3], 0))
            if len(out) >= 10_000:
                yield link_batch(out)
                out = []
        yield link_batch(out)

    return in_cells.mapInArrow(compare, LINKS)


def link_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else ((), (), ())
    kinds = (pa.binary(), pa.binary(), pa.int64())
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(columns, kinds)], names=["a", "b", "links"]
    )


def dealt(in_cells: DataFrame) -> DataFrame:
    """Cells brought together, their rows in a row."""
    return in_cells.repartition("g", "i", "j").sortWithinPartitions("g", "i", "j")


# --- the join -------------------------------------------------------------------------------


def near_duplicates(
    docs: DataFrame,
    threshold: float = THRESHOLD,
    recall: float = RECALL,
    id_col: str = "doc_id",
    text_col: str = "text",
    key_col: str | None = None,
) -> DataFrame:
    """``(doc_id, key, class_id, n_links, n_copies, root)`` of every row: the smallest doc_id of its
    class, the number of different texts linked to its own, of rows with its very text, and the
    digest that names the class (null without n-grams). ``key`` is the binary column ``key_col``.
    """
    bands, rows = choose_bands(threshold, recall)
    text = F.coalesce(col(text_col), F.lit(""))
    named = docs.select(
        col(id_col).cast("long").alias("doc_id"),
        F.unhex(F.md5(text.cast("binary"))).alias("digest"),
        (col(key_col) if key_col else F.lit(None).cast("binary")).alias("key"),
        text.alias("text"),
    )
    signed = materialize(sign(named, bands, rows), "signed")
    texts = materialize(
        signed.where(F.col("n_grams") > 0)
        .groupBy("digest")
        .agg(
            F.min("doc_id").alias("first_id"),
            F.count("*").alias("n_copies"),
            F.first(F.struct("n_grams", "bands", "signature")).alias("s"),
        )
        .select("digest", "first_id", "n_copies", "s.*"),
        "texts",
    )

    # Buckets of two texts or more, then the signatures of their members.
    keyed = texts.select(F.explode("bands").alias("g"), "digest")
    shared = keyed.groupBy("g").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    met = cells(keyed.join(shared, "g"), F.ceil(F.col("n") / BLOCK))
    with_signature = met.join(texts.select("digest", "signature"), "digest")
    in_buckets = with_signature.select("g", "i", "j", "digest", "block", "signature")
    edges = meet(dealt(in_buckets), signature_cut(bands * rows, threshold))
    families = components(edges)

    # One copy of each text of a family per cell; nearly all families are one cell.
    members = families.join(
        texts.select(F.col("digest").alias("node"), "first_id", "n_grams"), "node"
    )
    sizes = members.groupBy(F.col("root").alias("family")).agg(
        F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n_grams") / BLOCK_GRAMS)).alias("blocks")
    )
    placed = members.join(sizes, F.col("root") == F.col("family")).select(
        F.col("family").alias("g"), F.col("node").alias("digest"), "first_id", "blocks"
    )
    whole = placed.join(
        named.select(F.col("digest").alias("d"), F.col("doc_id").alias("id"), "text"),
        (F.col("digest") == F.col("d")) & F.col("first_id").eqNullSafe(F.col("id")),
    )
    in_families = cells(whole.select("g", "digest", "text", "blocks"), F.col("blocks"))
    verified = materialize(
        verify(dealt(in_families.select("g", "i", "j", "digest", "block", "text")), threshold), "links"
    )

    roots = components(verified.where(F.col("b").isNotNull()).select("a", "b"))
    links = verified.where(F.col("b").isNull()).groupBy(F.col("a").alias("linked")).agg(F.sum("links").alias("n_links"))
    about = (
        texts.select("digest", "first_id", "n_copies")
        .join(roots, F.col("digest") == F.col("node"), "left")
        .join(links, F.col("digest") == F.col("linked"), "left")
        .withColumn("root", F.coalesce("root", "digest"))
    )
    first = about.groupBy(F.col("root").alias("of")).agg(F.min("first_id").alias("class_id"))
    classes = about.join(first, F.col("root") == F.col("of")).select(
        F.col("digest").alias("d"), "class_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "n_copies", "root"
    )
    own = F.col("n_grams") == 0
    return signed.join(classes, (F.col("digest") == F.col("d")) & ~own, "left").select(
        "doc_id",
        "key",
        F.when(own, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("n_copies", F.lit(1)).cast("long").alias("n_copies"),
        "root",
    )


def one_per_class(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one row of each class: the one of the smallest id (null last).

    Rows without n-grams all stay. Of rows alike in every column one is taken.
    """
    key = fresh(docs, "row_key")
    keyed = docs.withColumn(key, row_key(docs))
    classes = near_duplicates(keyed, id_col=id_col, text_col=text_col, key_col=key, **options)
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", F.col("key").alias("chosen"))
    first = classes.where(F.col("root").isNotNull()).groupBy("root").agg(F.min(order).alias("first"))
    chosen = first.select("first.chosen", F.lit(False).alias("all_rows"))
    blank = classes.where(F.col("root").isNull()).select(F.col("key").alias("chosen"), F.lit(True).alias("all_rows"))
    kept = keyed.join(chosen.unionByName(blank.distinct()), col(key) == F.col("chosen"))
    number = F.row_number().over(Window.partitionBy(key).orderBy(key))
    return kept.withColumn("chosen", number).where((F.col("chosen") == 1) | F.col("all_rows")).select(*map(col, docs.columns))
