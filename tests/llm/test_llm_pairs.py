"""Pivot search, the n-gram join, the pipeline and the registered queries."""

import random
import re
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import pytest
from llm_cases import no_docs, odd_docs, rows
from oracle import connect, differences

from vectorloom.llm import minhash, mixing, pii, pivots, quality
from vectorloom.llm.graph import components
from vectorloom.llm.queries import LLM_ORACLES, LLM_QUERIES
from vectorloom.session import materialize


@pytest.mark.parametrize("copies", [False, True])
def test_pivot_search(spark, monkeypatch, copies):
    monkeypatch.setattr(pivots, "CELL_QUERIES", 16)
    monkeypatch.setattr(pivots, "CELL_ROWS", 200)
    pick = np.random.default_rng(6)
    data = [(i, pick.normal(size=6).round(2).tolist()) for i in range(900)]
    if copies:
        data = [(i, data[0][1] if i % 3 == 0 else v) for i, v in data]
    data += [(901, None), (920, [1.0, None]), (940, [float("nan")]), (None, [1.0]), (903, []), (904, [1.0, 2.0]), (20, [9.0] * 6)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>").selectExpr("*", "1 AS score", "2 AS r")
    good = [(i, v) for i, v in data if i is not None and v is not None and all(x is not None and x == x for x in v)]
    whole = [(i, np.array([*(np.floor(64 * x) for x in v), *[0.0] * (6 - len(v))])) for i, v in good]
    own = {}
    for (i, v), (_, w) in zip(good, whole):
        if i % 20 == 0 and (i not in own or v < own[i][0]):
            own[i] = (v, w)
    expected = []
    for q, (_, w) in own.items():
        scores = sorted((-int(w @ x), i) for i, x in whole if i != q)[:20]
        expected += [(q, rank, i, -s) for rank, (s, i) in enumerate(scores, 1)]
    got = pivots.top_inner_products(df)
    assert sorted(map(tuple, got.collect())) == sorted(expected)
    assert dict(got.dtypes) == {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "bigint"}
    assert pivots.top_inner_products(df.where("false")).count() == 0
    assert pivots.top_inner_products(df.where("vec_id IN (0, 7)")).count() == 1


def test_large_components_stay_exact(spark):
    data = [(i, [float(1 << 24), float(i)]) for i in range(0, 60, 5)]
    got = pivots.top_inner_products(spark.createDataFrame(data, "vec_id long, embedding array<double>")).collect()
    assert {(r.query_id, r.vec_id, r.score) for r in got} == {
        (q, i, (1 << 60) + 4096 * i * q) for q, _ in data if q % 20 == 0 for i, _ in data if i != q
    }


def test_pruning_visits_little(spark):
    pick = np.random.default_rng(9)
    centers = pick.normal(size=(20, 8)) * 40
    rows_ = np.floor(64 * (centers[np.arange(4000) % 20] + pick.normal(size=(4000, 8))))
    top = float((rows_ * rows_).sum(axis=1).max())
    lifted = pivots.lifted(rows_, top)
    chosen = pivots.farthest_first(lifted, 32)
    flat = np.hstack([rows_[:1], [[0.0]]])
    search = pivots.Search(np.array([0]), rows_[:1], pivots.distances(flat, chosen), np.array([np.iinfo(np.int64).min]), 20, top)
    seen = []
    real, pivots_products = pivots.products, pivots.products
    try:
        pivots.products = lambda rows, query: seen.append(len(rows)) or real(rows, query)
        search.offer(np.arange(4000), rows_, pivots.distances(lifted, chosen))
    finally:
        pivots.products = pivots_products
    assert sum(seen) < 2000


# --- n-gram join ----------------------------------------------------------------------------


def gram_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset()


def joined(docs):
    """{(doc_id, text): (class id, links, copies)} by comparing all pairs."""
    ids = defaultdict(list)
    for doc_id, text in docs:
        ids[text or ""].append(doc_id)
    sets = {t: gram_set(t) for t in ids}
    up = {t: t for t in ids}

    def root(t):
        while up[t] != t:
            t = up[t]
        return t

    links, holders = Counter(), defaultdict(list)
    for t, s in sets.items():
        for g in s:
            holders[g].append(t)
    for t, s in sets.items():
        for other, n in Counter(o for g in s for o in holders[g] if o != t).items():
            if n / (len(s) + len(sets[other]) - n) >= 0.8 - 1e-12:
                links[t] += 1
                up[root(t)] = root(other)
    first = {}
    for t, all_ids in ids.items():
        known = [i for i in [*all_ids, first.get(root(t))] if i is not None]
        first[root(t)] = min(known, default=None)
    return sorted(
        (
            (doc_id, first[root(t)], links[t], len(all_ids)) if sets[t] else (doc_id, doc_id, 0, 1)
            for t, all_ids in ids.items()
            for doc_id in all_ids
        ),
        key=str,
    )


def near_docs(seed=1):
    pick = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(500)]
    passage = pick.choices(vocabulary, k=60)
    docs = []
    for _ in range(40):
        base = pick.choices(vocabulary, k=pick.randint(3, 150))
        for _ in range(pick.choice([1, 1, 2, 12])):
            words = list(base)
            for _ in range(pick.randint(0, 3)):
                words[pick.randrange(len(words))] = pick.choice(vocabulary)
            docs.append(" ".join(words))
        docs.append(" ".join(passage + pick.choices(vocabulary, k=30)))
    return [(i, t) for i, t in enumerate(docs + docs[:30])]


@pytest.mark.parametrize("block", [512, 4])
def test_ngram_join(spark, monkeypatch, block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    docs = near_docs() + [(r[0], r[1]) for r in rows()]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'x' AS digest", "1 AS root")
    got = minhash.near_duplicates(df.repartition(4)).select("doc_id", "class_id", "n_links", "n_copies")
    assert sorted(map(tuple, got.collect()), key=str) == joined(docs)
    assert minhash.near_duplicates(no_docs(spark)).count() == 0


def test_one_per_class(spark):
    docs = odd_docs(spark)
    kept = minhash.one_per_class(docs)
    assert kept.columns == docs.columns
    expected = Counter(r for r in rows())
    expected[rows()[7]] = 1  # the repeated row
    assert Counter(tuple(r) for r in kept.collect()) == expected
    data = near_docs(2)
    keep = [r.doc_id for r in minhash.one_per_class(spark.createDataFrame(data, "doc_id long, text string")).collect()]
    assert sorted(keep) == sorted({c for _, c, _, _ in joined(data)})


def test_bands_reach_the_recall():
    bands, rows_ = minhash.choose_bands(0.8, 0.9999)
    assert 1 - (1 - 0.8**rows_) ** bands >= 0.9999 and bands * rows_ <= minhash.MOST_HASHES
    with pytest.raises(ValueError):
        minhash.choose_bands(0.1, 0.9999, 4)
    assert 0 < minhash.signature_cut(120, 0.8) < 96


def test_components(spark):
    pick = random.Random(3)
    edges = [(pick.randrange(300), pick.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(400, 460)]
    up = {}
    for a, b in edges:
        up.setdefault(a, a)
        up.setdefault(b, b)

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        low, high = sorted((root(a), root(b)))
        up[high] = low
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert sorted((r.node, r.root) for r in got) == sorted((x, root(x)) for x in linked)


# --- pipeline and queries -------------------------------------------------------------------


def test_pipeline_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "ngram_join", "personal_data", "source_mix", "packing"]
    first, second, third, fourth, fifth = [stage for _, stage in corpus_pipeline.STAGES]
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")

    kept = materialize(first(spark, docs, sf_dir), "kept")
    measured, name = quality.measure(docs)
    measured = materialize(measured, "measured")
    cutoffs = quality.joint_cutoffs(measured, labels, name)
    good = measured.where(quality.verdicts(measured, cutoffs, name)).select("doc_id")
    assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == sorted(r.doc_id for r in good.collect())

    single = materialize(second(spark, kept, sf_dir), "single")
    texts = [(r.doc_id, r.text) for r in kept.collect()]
    assert sorted(r.doc_id for r in single.collect()) == sorted({c for _, c, _, _ in joined(texts)})

    clean = materialize(third(spark, single, sf_dir), "clean")
    assert clean.columns == docs.columns and clean.where("n_chars <> length(text)").count() == 0
    assert sum(map(len, (r.spans for r in pii.find(clean)[0].where("size(spans) > 0").collect()))) == 0

    mixed = materialize(fourth(spark, clean, sf_dir), "mixed")
    copies = {r.doc_id: r.copies for r in mixing.mix(clean).collect() if r.copies}
    assert Counter(r.doc_id for r in mixed.collect()) == copies

    packed = materialize(fifth(spark, mixed, sf_dir), "packed")
    tokens = packed.groupBy("doc_id").agg({"length": "sum", "doc_tokens": "max"}).collect()
    assert {r.doc_id: r["sum(length)"] // r["max(doc_tokens)"] for r in tokens} == copies


def test_run(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).where("length > 0").count() > 0
    assert corpus_pipeline.ORACLE_SQL is None


@pytest.mark.parametrize("name", sorted(LLM_QUERIES))
def test_query(spark, sf_dir, name):
    frame = LLM_QUERIES[name](spark, sf_dir)
    if name in LLM_ORACLES:
        assert differences(frame, connect(sf_dir), LLM_ORACLES[name]) == []
    else:
        assert frame.count() > 0


def test_registered():
    import __spark_entry__ as entry

    assert {*LLM_QUERIES, "pipeline"} <= set(entry.queries())
    assert [sum(n.startswith(f"op{k}_") for n in LLM_QUERIES) for k in range(1, 11)] == [1] * 10
