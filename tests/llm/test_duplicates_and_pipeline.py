"""Near-duplicates of texts and vectors, components, the classifier and the pipeline."""

import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import corpus_pipeline
from tidemark.llm import components as components_module
from tidemark.llm import neardup, quality, vectordup
from tidemark.llm.common import shared_dir
from tidemark.llm.components import components
from tidemark.llm.words import WordHashes, words


def closed(nodes, links):
    """Least reachable node by node."""
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed, monkeypatch):
    monkeypatch.setattr(components_module, "CHUNK", 7)  # many chunks: several rounds
    rnd = random.Random(seed)
    links = [(rnd.randrange(60), rnd.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 140)] + [(500, k) for k in range(501, 560)] + [(9, 9)]
    found = {r.node: r.label for r in components(spark.createDataFrame(links, "u long, v long"), shared_dir(spark)).collect()}
    ends = {x for a, b in links if a != b for x in (a, b)}
    assert found == closed(ends, [x for x in links if x[0] != x[1]])
    assert components(spark.createDataFrame([], "u long, v long"), shared_dir(spark)).count() == 0


def longest(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_alignment_is_the_full_one():
    rnd = random.Random(5)
    for _ in range(1500):
        size = rnd.choice([3, 10, 1000])
        a = [rnd.randrange(size) for _ in range(rnd.randint(1, 40))]
        b = list(a)
        for _ in range(rnd.randint(0, 8)):
            i = rnd.randrange(len(b) + 1)
            b[i : i + rnd.randrange(2)] = [rnd.randrange(size)] * rnd.randrange(2)
        want = bool(b) and 18 * longest(a, b) >= 8 * (len(a) + len(b))
        assert neardup.aligned(np.array(a, dtype=np.uint64), np.array(b, dtype=np.uint64)) == want


def test_text_classes(spark):
    rnd = random.Random(6)
    base = [f"w{rnd.randrange(500)}" for _ in range(200)]
    near = list(base)
    near[50] = "changed"
    far = [f"v{rnd.randrange(500)}" for _ in range(200)]
    rows = [
        (5, " ".join(base)), (3, " ".join(base).upper().replace(" ", ", ")), (8, " ".join(near)), (9, " ".join(far)), (1, None), (2, None), (10, ""), (11, ""),
        (12, "!!!"), (13, "one two"), (14, "One, two."), (14, "One, two."), (15, "two one"), (16, " ".join(base * 30)), (17, " ".join(base * 30) + " end"), (None, "one two"),
    ]
    frame = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, class_id string")
    found = neardup.classes(frame, shared_dir(spark)).collect()
    by = {r.doc_id: r.class_id for r in found}
    assert len(found) == len(rows)
    assert by == {5: 3, 3: 3, 8: 3, 9: 9, 1: 1, 2: 2, 10: 10, 11: 10, 12: 12, 13: 13, 14: 13, 15: 15, 16: 16, 17: 16, None: 13}
    assert {r.doc_id for r in found if r.kept} >= {3, 9, 1, 2, 10, 12, 13, 15, 16}
    assert neardup.classes(spark.createDataFrame([], "doc_id long, text string"), shared_dir(spark)).count() == 0


def test_repeated_run_leaves_other_marks():
    """A copy that gains or loses the only repeated run of a text shares most sketches with it."""
    rnd = np.random.default_rng(12)
    for _ in range(20):
        once = rnd.integers(0, 1 << 32, 300, dtype=np.uint32)
        twice = np.concatenate((once, once[:6]))
        a, b = (neardup.shingles(x) for x in (once, twice))
        assert neardup.aligned(a, b)
        assert (neardup.sketches(a) == neardup.sketches(b)).sum() >= 12


def test_copies_with_a_repeated_sentence(spark):
    """Pairs of which one repeats a sentence, by addition to the copy or by removal from it, against all verified pairs."""
    rnd, texts = random.Random(13), {}
    for k in range(40):
        base = [f"r{rnd.randrange(10**6)}" for _ in range(300)]
        more = base[:200] + base[20:32] + base[200:]
        texts[2 * k], texts[2 * k + 1] = (base, more) if k % 2 else (more, base)
    frame = spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "doc_id long, text string")
    found = {r.doc_id: r.class_id for r in neardup.classes(frame, shared_dir(spark)).collect()}
    assert found == {i: i - i % 2 for i in texts}


def test_no_link_is_lost(spark):
    """All pairs that share a run of words, verified one by one, against the classes; among them a large group around one text."""
    table = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["doc_id", "text"]).to_pydict()
    texts = dict(zip(table["doc_id"], table["text"], strict=True))
    rnd, passage = random.Random(7), " ".join(f"p{k}" for k in range(45))
    base = [f"b{rnd.randrange(900)}" for _ in range(120)]
    for k in range(150):
        copy = list(base)
        copy[rnd.randrange(120)] = f"c{k}"
        texts[100_000 + k] = " ".join(copy)
        texts[200_000 + k] = passage + " " + " ".join(f"q{rnd.randrange(10**6)}" for _ in range(rnd.randint(3, 30)))
    hashes, holders = WordHashes(), defaultdict(list)
    runs = {i: neardup.shingles(hashes.array(words(t.encode()))) for i, t in texts.items()}
    for i, r in runs.items():
        for x in set(r.tolist()):
            holders[x].append(i)
    sets = {i: set(r.tolist()) for i, r in runs.items()}
    pairs = {(a, b) for ids in holders.values() for a in ids for b in ids if a < b}
    links = [(a, b) for a, b in pairs if min(len(sets[a]), len(sets[b])) >= 0.6 * max(len(sets[a]), len(sets[b])) and neardup.aligned(runs[a], runs[b])]
    frame = spark.createDataFrame(pa.table({"doc_id": list(texts), "text": list(texts.values())}))
    found = {r.doc_id: r.class_id for r in neardup.classes(frame, shared_dir(spark)).collect()}
    assert found == closed(texts, links)
    assert len({found[100_000 + k] for k in range(150)}) == 1


def verified_classes(texts):
    """Classes by all pairs within the length bounds, verified one by one."""
    hashes = WordHashes()
    runs = {i: neardup.shingles(hashes.array(words(t.encode()))) for i, t in texts.items()}
    ids = sorted(texts)
    return closed(texts, [(a, b) for a in ids for b in ids if a < b and neardup.aligned(runs[a], runs[b])])


def test_links_of_linked_members(spark):
    """Texts of one repeated word: the longer ones are linked to members of the leader's class only."""
    texts = {k: " ".join(["spam"] * (104 + 10 * k)) for k in range(25)}
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = {r.doc_id: r.class_id for r in neardup.classes(frame, shared_dir(spark)).collect()}
    assert found == verified_classes(texts) == dict.fromkeys(texts, 0)


@pytest.mark.parametrize("block", [neardup.BLOCK, 32])
def test_twins_in_a_family(spark, monkeypatch, block):
    """Pairs just above the similarity among 200 texts around one form, whose own links stay below it."""
    monkeypatch.setattr(neardup, "BLOCK", block)
    rnd, texts = random.Random(14), {}
    form = [f"f{k}" for k in range(241)]
    for k in range(100):
        own = [f"o{rnd.randrange(10**6)}" for _ in range(5)]
        cut = rnd.randrange(5, 235)
        for twin in (0, 1):
            last = [f"o{rnd.randrange(10**6)}" for _ in range(28)]
            texts[2 * k + twin] = " ".join(form[:cut] + own + form[cut:] + last)
    want = verified_classes(texts)
    assert sum(i != c for i, c in want.items()) >= 90 and len(set(want.values())) >= 90
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in neardup.classes(frame, shared_dir(spark)).collect()} == want


def test_quantisation_bounds_hold():
    rnd = np.random.default_rng(8)
    x = rnd.normal(size=(300, 48))
    y = x[:200] + rnd.normal(size=(200, 48)) * rnd.choice([0.02, 0.14, 0.2, 1.0], size=(200, 1))
    cosine = (x @ y.T) / np.linalg.norm(x, axis=1)[:, None] / np.linalg.norm(y, axis=1)[None]
    i, j = vectordup.linked(x, y)
    assert set(zip(i.tolist(), j.tolist())) == set(zip(*[k.tolist() for k in np.nonzero(cosine >= 0.98)], strict=True))


def test_vector_classes(spark):
    rnd = np.random.default_rng(9)
    rows, base = [], rnd.normal(size=(12, 16))
    for k in range(260):
        v = base[k % 12] + rnd.normal(size=16) * rnd.choice([0.0, 0.05, 0.2])
        rows.append((k, [float(np.float32(a)) for a in v], None if k % 31 == 0 else k % 3))
    rows += [(300, None, 1), (301, [], 1), (302, [0.0] * 16, 1), (303, [float("nan")] * 16, 1), (304, [None, 1.0], 1), (305, [1.0, 2.0], 1), (306, [2.0, 4.0], 1), (307, [2.0, 4.0], 1)]
    frame = spark.createDataFrame([(i, v, g, 0) for i, v, g in rows], "vec_id long, embedding array<float>, label int, n_links int")
    links = []
    for a, x, g in rows:
        for b, y, h in rows:
            if a < b and g is not None and g == h and x and y and len(x) == len(y) and None not in x and None not in y:
                p, q = np.array(x, dtype=np.float64), np.array(y, dtype=np.float64)
                if p.any() and q.any() and np.isfinite(p).all() and np.isfinite(q).all() and p @ q / (np.linalg.norm(p) * np.linalg.norm(q)) >= 0.98:
                    links.append((a, b))
    want = closed([r[0] for r in rows], links)
    for tile in (16, 1024):
        found = vectordup.classes(frame, shared_dir(spark), tile=tile).collect()
        assert {r.vec_id: r.component_id for r in found} == want
        assert {r.vec_id: r.n_links for r in found} == {i: sum(i in p for p in links) for i in want}
        assert all(r.kept == (r.vec_id == r.component_id) for r in found)
    assert vectordup.classes(frame.limit(0), shared_dir(spark)).count() == 0


def test_quality_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.fit(docs, labels.where("doc_id % 3 <> 0"), shared_dir(spark))
    rest = quality.score(docs, model).join(labels.where("doc_id % 3 = 0"), "doc_id").collect()
    assert sum((r.score >= 0.5) == (r.quality == 1) for r in rest) / len(rest) > 0.95
    kept = [r for r in rest if r.score >= quality.REJECT_BELOW]
    assert sum(r.quality == 0 for r in kept) <= 0.5 * sum(r.quality == 0 for r in rest)
    assert sum(r.quality for r in kept) >= 0.99 * sum(r.quality for r in rest)


def test_co_training_shares_labels():
    """The second view has few labels of its own kind of document, and learns them from the first."""
    rnd = np.random.default_rng(10)
    y = rnd.integers(0, 2, 3000).astype(float)
    a, b = y[:, None] * 4 + rnd.normal(size=(3000, 3)), y[:, None] * 3 + rnd.normal(size=(3000, 2))
    held = np.arange(60) % 3 == 0
    model = quality.co_train(a[:60], b[:60], y[:60], held, lambda views: quality.slopes(a, b, views))
    assert all(quality.slopes(a, b, {"text": v, "meta": w})["meta"][-1] > 100 for v, w in [(quality.View.fit(a[:60], y[:60], held), quality.View.fit(b[:60], y[:60], held))])
    scores = model(a, b)
    assert all(((s >= 0.5) == (y == 1)).mean() > 0.95 for s in scores)


def test_quality_edges(spark):
    frame = spark.createDataFrame([(1, None, None, None, None, "mine"), (2, "", "en", "s", 0, "x"), (3, "a b " * 50_000, "en", "s", 9, "x")], "doc_id long, text string, lang string, source string, n_chars long, score string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.score for r in quality.score(frame, quality.fit(frame, none, shared_dir(spark))).collect()] == [1.0] * 3
    one = spark.createDataFrame([(1, 0, None), (1, 1, 0), (2, None, 1), (3, 0, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    assert {r.score for r in quality.score(frame, quality.fit(frame, one, shared_dir(spark))).collect()} == {0.5}
    assert quality.score(frame.limit(0), quality.fit(frame.limit(0), none, shared_dir(spark))).count() == 0


def test_pipeline_stages(spark, tmp_path):
    rnd = random.Random(11)
    prose = lambda n: " ".join("".join(rnd.choice("abcdeilnorst") for _ in range(rnd.randint(2, 9))) for _ in range(n)) + "."
    junk = lambda n: " ".join(rnd.choice(["$$$", "###", "BUY!!"]) + "&&&" for _ in range(n))
    texts = {i: prose(80) for i in range(60)} | {i: junk(80) for i in range(60, 100)}
    item = prose(40)
    texts |= {200: texts[3], 201: texts[4] + " more", 202: item, 203: prose(100) + " token = 'abcdef123456'", 204: None, 205: "", 206: prose(3000)}
    ids = list(texts) + [5, 5]  # rows that repeat
    columns = {
        "doc_id": pa.array(ids, pa.int64()), "text": pa.array([texts[i] for i in ids]), "lang": pa.array([None if i % 7 == 0 else "en" for i in ids]),
        "source": pa.array(["hot"] * len(ids)), "n_chars": pa.array([len(texts[i] or "") for i in ids], pa.int64()), "score": pa.array(["mine"] * len(ids)),
    }
    pq.write_table(pa.table(columns), tmp_path / "documents.parquet")
    pq.write_table(pa.table({"doc_id": pa.array(range(100), pa.int64()), "quality": pa.array([int(i < 60) for i in range(100)], pa.int32())}), tmp_path / "labels.parquet")
    pq.write_table(pa.table({"item_id": pa.array([1], pa.int64()), "text": [item]}), tmp_path / "benchmark.parquet")
    at, seen, order = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}, list(columns)
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, at, str(tmp_path))
        path = f"{tmp_path}/out-{name}"
        made.write.parquet(path)
        at = spark.read.parquet(path)
        seen[name] = {r.doc_id: r for r in at.collect()}
        if name != "tokens":
            assert at.columns == order and {r.score for r in seen[name].values()} == {"mine"}
    assert not set(range(60, 100)) & set(seen["quality"]) and set(range(60)) | {204, 205, 206} <= set(seen["quality"])
    assert {200, 201} & set(seen["near_duplicates"]) == set() and {3, 4, 5, 202, 204, 205} <= set(seen["near_duplicates"])
    assert set(seen["near_duplicates"]) - set(seen["decontamination"]) == {202}
    assert "[SECRET]" in seen["secrets"][203].text and seen["secrets"][203].n_chars == len(seen["secrets"][203].text)
    assert seen["secrets"][7].text == texts[7] and seen["secrets"][204].text is None
    assert all(r.round_trip for r in seen["tokens"].values()) and seen["tokens"][205].n_tokens == 0
    assert spark.read.parquet(f"{tmp_path}/out-near_duplicates").where("doc_id = 5").count() == 1
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(seen["tokens"])


def test_vectors_of_any_size_link(spark):
    from tidemark.llm import vectordup

    rows = [(1, [1e-200, 2e-200], 0), (2, [2e-200, 4e-200], 0), (3, [1.0, 2.0], 0), (4, [1e200, 2e200], 0), (5, [2e200, -1e200], 0), (6, [5e-324, 1e-323], 0)]
    found = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in vectordup.classes(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int"), shared_dir(spark)).collect()}
    assert found == {1: (4, 1), 2: (4, 1), 3: (4, 1), 4: (4, 1), 5: (0, 5), 6: (4, 1)}


def test_a_hot_repeated_id_teaches_once(spark):
    from tidemark.llm import quality

    docs = spark.createDataFrame([(i % 20 if i < 400 else 7, f"good words here {i % 20}" if i % 2 else "bad x x x", "s", "en", 10) for i in range(2000)], "doc_id bigint, text string, source string, lang string, n_chars bigint")
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id bigint, quality int")
    sent = []
    whole = type(docs).toArrow
    try:
        type(docs).toArrow = lambda self: sent.append(whole(self)) or sent[-1]
        quality.fit(docs, labels, shared_dir(spark))
    finally:
        type(docs).toArrow = whole
    assert [t.num_rows for t in sent] == [20]
