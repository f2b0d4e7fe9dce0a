"""Whitening, lexical search and nearest neighbours: against numpy, plain scoring and all pairs; edges of each."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import hnsw, lexical, queries, whitening
from tidemark.llm.common import shared_dir, table

VECTORS = "vec_id bigint, embedding array<float>, label int"


def reference_whitening(vectors, k):
    x = np.floor(64 * vectors).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(axis=0)
    c = x - s / n
    values, found = np.linalg.eigh(c.T @ c / n)
    values, found = values[::-1], found[:, ::-1]
    return c @ found[:, :k] / np.sqrt(values[:k]), values / values.sum(), ((n * x - s) ** 2).sum(axis=1)


def test_whitening_equals_the_eigenvectors_of_the_covariance(spark, sf):
    rows = queries.op11_embedding_whitening(spark, sf).toPandas().sort_values(["vec_id", "component"])
    source = table(spark, sf, "embeddings").toPandas().sort_values("vec_id")
    vectors = np.array(source["embedding"].tolist(), dtype=np.float64)
    wanted, explained, deviation = reference_whitening(vectors, 32)
    made = rows["whitened"].to_numpy().reshape(len(vectors), 32)
    made = made * np.sign((made * wanted).sum(axis=0))
    assert np.abs(made - wanted).max() < 1e-8
    assert np.allclose(rows["explained"].to_numpy()[:32], explained[:32], rtol=1e-10)
    assert rows["deviation"].tolist() == np.repeat(deviation, 32).tolist()
    assert rows["identity_error"].nunique() == 1 and rows["identity_error"].iloc[0] < 1e-10
    assert set(rows["n"]) == {len(vectors)} and rows["vec_id"].tolist() == np.repeat(source["vec_id"].to_numpy(), 32).tolist()


def bidiagonal(a, wanted):
    return whitening.bidiagonalise(lambda c, cs: ((a @ cs).T @ (a @ c), float((a @ c) @ (a @ c)), a.T @ (a @ c)), a.shape[1], wanted)


@pytest.mark.parametrize("case", ["plain", "repeated", "low rank", "few rows", "early"])
def test_bidiagonalisation_finds_all_components(case):
    rng = np.random.default_rng(3)
    spectrum = {
        "plain": np.arange(20, 0, -1.0), "repeated": np.array([9.0] * 3 + [4.0] * 7 + [1.0] * 10), "low rank": np.array([5.0, 5.0, 2.0] + [0.0] * 17),
        "few rows": np.arange(20, 0, -1.0), "early": np.array([1000.0, 1000.0, 500.0] + [1.0] * 97),
    }[case]
    d = len(spectrum)
    basis = np.linalg.qr(rng.standard_normal((d, d)))[0]
    a = np.linalg.qr(rng.standard_normal((200, d)))[0] * spectrum @ basis.T
    if case == "few rows":
        a = a[:7]
    wanted = 3 if case == "early" else 12
    values, found = bidiagonal(a, wanted)
    truth = np.linalg.svd(a, compute_uv=False)
    rank = int((truth > 1e-8 * truth[0]).sum())
    assert len(values) == min(wanted, rank)
    assert np.allclose(values, truth[: len(values)], rtol=1e-9)
    assert np.abs(found @ found.T - np.eye(len(values))).max() < 1e-10
    assert np.abs(a.T @ (a @ found.T) - found.T * values**2).max() < 1e-7 * truth[0] ** 2


def test_whitening_of_edges(spark):
    nan, inf = float("nan"), float("inf")
    bad = [(1, None, 0), (2, [1.0, None], 0), (3, [nan, 1.0], 0), (4, [inf, 1.0], 0), (5, [], 0), (6, [1.0, 2.0, 3.0], 0)]
    good = [(7, [0.5, 1.0], 0), (7, [0.5, 1.0], 1), (None, [0.25, -1.0], 0), (9, [-3.0, 0.015], None)]
    made = whitening.whitened(spark.createDataFrame(bad + good, VECTORS).withColumn("component", F.lit("clash")).withColumn("packed", F.lit(1)), shared_dir(spark)).toPandas()
    assert len(made) == 8 and set(made["n"]) == {4} and made["vec_id"].isna().sum() == 2
    wanted, _, deviation = reference_whitening(np.array([g[1] for g in good], dtype=np.float32).astype(float), 2)
    assert sorted(made["deviation"].astype(int)) == sorted(np.repeat(deviation, 2).tolist())
    assert made["identity_error"].max() < 1e-9
    for rows in ([], bad[:5], [(1, [1.0, 2.0], 0), (2, [1.0, 2.0], 0)], [(1, [1.0], 0)]):
        assert whitening.whitened(spark.createDataFrame(rows, VECTORS), shared_dir(spark)).count() == 0


def test_deviations_stay_exact_beyond_64_bits():
    centre = whitening.Centre(10**9, [10**15 + 7, 3])
    x = np.array([[1_000_000 + (1 << 30), 5]], dtype=np.int64)
    assert centre.squares(x) == [(10**9 * int(x[0, 0]) - 10**15 - 7) ** 2 + (5 * 10**9 - 3) ** 2]


def plain_ranking(docs, items, k=10):
    """All scores, term by term, as the formula has them."""
    said = {r: lexical.terms((t or "").encode()) for r, (_, t) in enumerate(docs)}
    said = {r: t for r, t in said.items() if t}
    n, total = len(said), sum(map(len, said.values()))
    df, out = Counter(t for own in said.values() for t in set(own)), {}
    counts = {r: Counter(own) for r, own in said.items()}
    asked = {}
    for item, text in items:
        if item is not None:
            asked.setdefault(item, set()).update(lexical.terms((text or "").encode()))
    for item, own in asked.items():
        scored = []
        for r, tf in counts.items():
            m = 10 + 90 * len(said[r]) * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * tf[t]) // (1000 * tf[t] + 8 * m)) for t in own if t in tf)
            if score:
                scored.append((-score, docs[r][0] is None, docs[r][0] or 0))
        out[item] = [(i + 1, None if null else d, -s) for i, (s, null, d) in enumerate(sorted(scored)[:k])]
    return {item: found for item, found in out.items() if found}


def ranked(frame):
    out = {}
    for r in frame.collect():
        out.setdefault(r["item_id"], []).append((r["rank"], r["doc_id"], r["score"]))
    return {item: sorted(found) for item, found in out.items()}


def test_lexical_search_equals_plain_scoring(spark, sf):
    docs = [tuple(r) for r in table(spark, sf, "documents").select("doc_id", "text").collect()]
    items = [tuple(r) for r in table(spark, sf, "benchmark").select("item_id", "text").collect()]
    assert ranked(queries.op12_lexical_search(spark, sf)) == plain_ranking(docs, items)


def test_lexical_search_over_small_shards_windows_and_blocks(spark, monkeypatch):
    rng = random.Random(5)
    words = [f"w{int(rng.paretovariate(0.6))}" for _ in range(3000)]
    docs = [(i, " ".join(rng.choices(words, k=rng.randint(1, 60)))) for i in range(900)]
    docs += [(7, docs[3][1]), (5, docs[3][1]), (None, docs[3][1]), (1000, None), (1001, ""), (1002, " .,;"), (1003, "Ünïcode ÜNÏCODE word-WORD \u0000x" * 500)]
    items = [(1, "w1 w2 w3 w40"), (2, docs[3][1]), (3, ""), (4, None), (None, "w1"), (5, "nothing here"), (6, "WORD ünïcode"), (1, "w5"), (7, "w1")]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("term", F.lit("clash")).repartition(5)
    asked = spark.createDataFrame(items, "item_id bigint, text string").withColumn("rank", F.lit(0))
    index, n, total = lexical.index(frame, folder := shared_dir(spark), shard_bytes=4000)
    assert index.select("shard").distinct().count() > 5
    found = ranked(lexical.search(index, n, asked, folder, item_bytes=300))
    assert found == plain_ranking(docs, items)


def test_a_shard_skips_blocks_and_agrees_with_all_scores(monkeypatch):
    monkeypatch.setattr(lexical, "WINDOW", 256)
    rng = random.Random(8)
    docs = [" ".join(["common"] * rng.randint(1, 3) + [f"r{rng.randint(1, 400)}" for _ in range(rng.randint(3, 30))]).encode() for _ in range(3000)]
    docs[5] = docs[17] = b"common r1 r2"
    total = sum(len(lexical.terms(t)) for t in docs)
    first, rest = lexical._shard("a", list(range(3000)), docs, 3000, total)
    lists = {t: (np.frombuffer(h, lexical.HEAD), d) for t, h, d in zip(*[rest.column(c).to_pylist() for c in (1, 3, 4)], strict=True)}
    shard = lexical.Shard(np.frombuffer(first.column(3)[0].as_py(), "<i8"), lists)
    asked = [(t, lexical.weight(3000, int(lists[t][0]["size"].sum()))) for t in (b"common", b"r1", b"r2")]
    places, scores = shard.best(asked, 10)
    wanted = plain_ranking([(i, t.decode()) for i, t in enumerate(docs)], [(0, "common r1 r2")])[0]
    assert list(zip(range(1, 11), places.tolist(), scores.tolist(), strict=True)) == wanted
    assert shard.decoded < sum(len(lists[t][0]) for t, _ in asked)  # some blocks of the common term were never decoded


def test_lists_survive_packing():
    rng = np.random.default_rng(2)
    sizes = [1, 128, 129, 700, 3]
    places = [np.sort(rng.choice(1 << 20 if i % 2 else 800, size, replace=False)) for i, size in enumerate(sizes)]
    tfs = [rng.integers(1, (3, 300, 70_000)[i % 3], size) for i, size in enumerate(sizes)]
    heads, blocks = lexical.pack(np.cumsum([0, *sizes[:-1]]), np.concatenate(places), np.concatenate(tfs), np.concatenate(tfs))
    for i, (h, d) in enumerate(zip(heads.to_pylist(), blocks.to_pylist(), strict=True)):
        h = np.frombuffer(h, lexical.HEAD)
        got = [lexical.unpack(h, d, b) for b in range(len(h))]
        assert np.concatenate([g[0] for g in got]).tolist() == places[i].tolist() and np.concatenate([g[1] for g in got]).tolist() == tfs[i].tolist()
        assert all(h["most"][b] == g[1].max() for b, g in enumerate(got))


def test_lexical_search_of_empty_tables(spark):
    none, some = spark.createDataFrame([], "doc_id bigint, text string"), spark.createDataFrame([(1, "a b")], "doc_id bigint, text string")
    asked, nothing = spark.createDataFrame([(1, "a")], "item_id bigint, text string"), spark.createDataFrame([], "item_id bigint, text string")
    for docs, items in ((none, asked), (some, nothing), (none, nothing)):
        index, n, _ = lexical.index(docs, folder := shared_dir(spark))
        assert lexical.search(index, n, items, folder).count() == 0


def all_pairs(rows, k):
    """The exact ``k`` nearest of each query, as sets of (id, score)."""
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], dtype=np.float64)
    out = {}
    for i in np.flatnonzero(ids % 20 == 0):
        s = (x * x[i]).sum(axis=1)
        others = np.flatnonzero(ids != ids[i])
        order = others[np.lexsort((ids[others], -s[others]))][:k]
        out[int(ids[i])] = [(int(ids[j]), float(s[j])) for j in order]
    return out


def test_recall_of_nearest_vectors(spark):
    for sf_dir in ("/root/testdata/sf0.001", "/root/testdata/sf0.1"):
        rows = [(r[0], r[1]) for r in table(spark, sf_dir, "embeddings").select("vec_id", "embedding").collect()]
        exact = all_pairs(rows, 20)
        found = {}
        for r in queries.op13_nearest_vectors(spark, sf_dir).collect():
            found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
        assert set(found) == set(exact)
        hits = 0
        for q, own in found.items():
            own.sort()
            assert [r[0] for r in own] == list(range(1, 21)) and [(-s, i) for _, i, s in own] == sorted((-s, i) for _, i, s in own)
            hits += len({i for _, i, _ in own} & {i for i, _ in exact[q]})
        assert hits >= 0.97 * 20 * len(exact)  # 0.9 is asked for


def test_lengths_copies_and_bad_vectors(spark):
    rng = np.random.default_rng(4)
    rows = [(i, (rng.standard_normal(8) * rng.choice([0.1, 1, 30])).astype(np.float32).tolist()) for i in range(300)]
    same = [1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0]
    rows += [(1000 + i, same) for i in range(60)]
    nan = float("nan")
    odd = [(2000, None), (2020, [nan] * 8), (2040, [0.0] * 8), (2060, [1.0, None] + [0.0] * 6), (2080, []), (None, same), (2100, [1.0, 2.0]), (2120, [2.0, 1.0]), (20, rows[20][1])]
    frame = spark.createDataFrame([(*r, 0) for r in rows + odd], VECTORS).withColumn("packed", F.lit("clash")).repartition(4)
    vectors = hnsw.vectors_of(frame, folder := shared_dir(spark))
    graphs = hnsw.index(vectors, folder, 20, shard=64)
    found = {}
    for r in hnsw.nearest(graphs, vectors.where("vec % 20 = 0"), folder, 20, block_bytes=500).orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    exact = all_pairs(rows, 20)
    assert found.pop(2100) == [(2120, 4.0)] and found.pop(2120) == [(2100, 4.0)]
    assert set(found) == set(exact)
    assert sum(len(set(found[q]) & set(exact[q])) for q in exact) >= 0.98 * 20 * len(exact)
    assert found[1000] == exact[1000]  # ties between copies go by id
    assert hnsw.nearest(hnsw.index(none := hnsw.vectors_of(frame.where("vec_id < 0"), folder := shared_dir(spark)), folder, 20), none, folder, 20).count() == 0


def test_a_graph_of_one_common_vector_with_small_changes():
    """A cluster that holds most vectors: its members and the rest are still reached."""
    rng = np.random.default_rng(6)
    centre = rng.standard_normal(32)
    x = np.concatenate([centre + 0.01 * rng.standard_normal((1500, 32)), rng.standard_normal((500, 32))])
    x = x[rng.permutation(len(x))] / 10
    vectors = hnsw.lifted(x)
    layers = hnsw.build(vectors)
    assert len(layers) > 1 and all(links.max() < len(links) for links in layers)
    q = x[:100]
    places = hnsw.search(vectors, layers, np.column_stack([q, np.zeros(100)]).astype(np.float32), hnsw.SEARCH_WIDTH)
    exact = np.argsort(-(q @ x.T), axis=1)[:, :20]
    found = np.array([np.array(p)[np.argsort(-(x[p] @ v))][:20] for p, v in zip(places, q, strict=True)])
    assert np.mean([len(set(a) & set(b)) for a, b in zip(exact, found, strict=True)]) >= 18
