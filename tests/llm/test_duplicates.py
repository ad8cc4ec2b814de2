"""Near duplicates of texts and vectors, and components, against comparison of all pairs."""

import itertools
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from factorloom.llm import dart_minhash, nn_descent
from factorloom.llm.common import Texts, mix
from factorloom.llm.graph import components

WORD = re.compile("[^\x20\x09-\x0d]+")


def smallest(nodes, links):
    """The smallest node that each node reaches."""
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


# --- components ---------------------------------------------------------------------------------


def test_components(spark):
    rng = np.random.default_rng(9)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))]
    links += [(1000 + i, 1001 + i) for i in range(120)] + [(5000, 5000 + i) for i in range(1, 200)] + [(7, 7), (-3, -9)]
    rng.shuffle(links)
    df = spark.createDataFrame([tuple(map(int, x)) for x in links], "a long, b long").repartition(9)
    got = {r.node: r.root for r in components(df).collect()}
    proper = [(a, b) for a, b in links if a != b]
    assert got == smallest({n for x in proper for n in x}, proper)
    assert components(df.limit(0)).count() == 0


# --- DartMinHash --------------------------------------------------------------------------------


def test_agreement_estimates_weighted_similarity():
    rng = np.random.default_rng(6)
    elements = mix(np.arange(1, 301, dtype=np.uint64))
    n, weights = 6, np.zeros((6, 300))
    weights[0] = rng.choice([0.3, 1, 1, 2, 5, 17.5], 300)
    for k in range(1, n):
        weights[k] = np.where(rng.random(300) < 0.15 * k, rng.choice([0, 0.5, 4], 300), weights[0])
    doc, at = np.nonzero(weights)
    table = dart_minhash.signatures(doc, elements[at], weights[doc, at], n, coordinates=4096)
    for a, b in itertools.combinations(range(n), 2):
        similarity = np.minimum(weights[a], weights[b]).sum() / np.maximum(weights[a], weights[b]).sum()
        assert abs((table[a] == table[b]).mean() - similarity) < 4 * np.sqrt(0.25 / 4096)


def test_signature_does_not_depend_on_the_batch():
    texts = ["a b c d e f g", "", "x y", "a b c d e f g", "one two three four five six " * 50]
    parts = [dart_minhash.shingles(Texts(pa.array([t]))) for t in texts]
    doc, s, w, _ = dart_minhash.shingles(Texts(pa.array(texts)))
    table = dart_minhash.signatures(doc, s, w, len(texts))
    for k, (d, e, v, _) in enumerate(parts):
        assert (dart_minhash.signatures(d, e, v, 1)[0] == table[k]).all()
    assert (table[1] == dart_minhash.NEVER).all() and (table[0] == table[3]).all()


def similarity(a, b):
    sets = []
    for text in (a, b):
        w = WORD.findall(text)
        sets.append(Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))))
    both = sum((sets[0] & sets[1]).values())
    return both / (sum(sets[0].values()) + sum(sets[1].values()) - both)


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(8)
    words = [f"w{i}" for i in range(3000)]
    rows, n = [], 0
    for group in range(40):
        base = list(rng.choice(words, rng.integers(30, 300)))
        for _ in range(int(rng.integers(1, 6))):
            copy = list(base)
            for _ in range(int(rng.integers(0, 6))):
                copy[rng.integers(0, len(copy))] = "edit" + str(rng.integers(0, 99))
            rows.append((n, " ".join(copy)))
            n += 1
    base = list(rng.choice(words, 200))  # one large group, chained by single edits
    for k in range(120):
        base[rng.integers(0, 200)] = f"chain{k}"
        rows.append((n + k, " ".join(base)))
    rows += [(900, "few words"), (901, "few  words"), (902, "few others"), (903, "r " * 4000), (904, "r " * 3900)]
    rows += [(905, None), (906, ""), (907, " \n"), (908, ""), (3, rows[3][1]), (None, rows[3][1]), (None, rows[3][1])]
    return rows


def expected_classes(rows):
    named = {i: t for i, t in rows if i is not None and t and WORD.search(t)}
    links = [(a, b) for a, b in itertools.combinations(sorted(named), 2) if similarity(named[a], named[b]) >= 0.8 - 1e-9]
    return smallest(named, links)


def test_common_elements_of_all_pairs(monkeypatch):
    monkeypatch.setattr(dart_minhash, "DENSE", 6)
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 60 if k % 2 else 500, rng.integers(1, 90)).astype(np.uint64)) for k in range(30)]
    left, right = np.arange(0, 12), np.arange(12, 30)
    got = dart_minhash.shared_counts(sets, left, right)
    assert got.tolist() == [[len(np.intersect1d(sets[a], sets[b])) for b in right] for a in left]


@pytest.mark.parametrize("tile", [dart_minhash.TILE, 3000])
def test_classes_equal_all_pairs(spark, texts, tile, monkeypatch):
    monkeypatch.setattr(dart_minhash, "TILE", tile)
    df = spark.createDataFrame(texts, "doc_id long, text string").withColumns({"class_id": F.lit("x"), "content": F.lit(1)})
    rows = dart_minhash.duplicate_classes(df.repartition(5)).collect()
    assert len(rows) == len(texts)
    want = expected_classes(texts)
    for r in rows:
        assert r.class_id == want.get(r.doc_id, r.doc_id)
        assert r.kept == (r.doc_id is None or r.doc_id == r.class_id)


def test_one_document_of_each_class_stays(spark, texts, monkeypatch):
    df = spark.createDataFrame(texts, "doc_id long, text string").withColumn("kept", F.lit("clash"))
    want = expected_classes(texts)
    ids = sorted({want.get(i, i) for i, _ in texts if i is not None})
    for limit in (dart_minhash.BROADCAST_IDS, 0):
        monkeypatch.setattr(dart_minhash, "BROADCAST_IDS", limit)
        left = dart_minhash.without_duplicates(df)
        assert left.columns == df.columns
        assert sorted(r.doc_id for r in left.collect() if r.doc_id is not None) == ids
        assert left.filter("doc_id IS NULL").count() == 2
    assert dart_minhash.duplicate_classes(df.limit(0)).count() == 0


# --- NN-descent ---------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(3)
    rows, n = [], 0

    def add(x, label):
        nonlocal n
        rows.append((n, None if x is None else [float(v) for v in np.float32(x)], label))
        n += 1

    for label in (0, 1):
        for _ in range(150):
            add(rng.standard_normal(16), label)
        for size in (2, 3, 5, 60):  # the last saturates its lists
            centre = rng.standard_normal(16)
            for _ in range(size):
                add((centre + 0.06 * rng.standard_normal(16)) * rng.uniform(0.1, 50), label)
    same = rng.standard_normal(16)
    for label in (0, 0, 0, 1, None, None):
        add(same, label)
    for odd in (None, [], [0.0] * 16, [float("nan")] * 16, [float("inf")] + [1.0] * 15, [1.0, 2.0], [1.0, 2.0]):
        add(odd, 0)
    rows.append((n, [None] + [1.0] * 15, 0))
    rows.append((None, rows[0][1], 0))
    return rows


def expected_links(rows):
    usable = {}
    for i, v, label in rows:
        if i is not None and v and label is not None and None not in v and np.isfinite(v).all() and np.any(v):
            usable[i] = (np.array(np.float32(v), float), label)
    links = []
    for a, b in itertools.combinations(sorted(usable), 2):
        (x, k), (y, m) = usable[a], usable[b]
        if k == m and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.98:
            links.append((a, b))
    return usable, links


def test_vectors_equal_all_pairs(spark, vectors):
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int")
    rows = nn_descent.near_duplicates(df.withColumns({"node": F.lit("x"), "copies": F.lit(0)}).repartition(5)).collect()
    assert len(rows) == len(vectors)
    usable, links = expected_links(vectors)
    roots, degree = smallest(usable, links), Counter(n for x in links for n in x)
    for r in rows:
        assert r.component_id == roots.get(r.vec_id, r.vec_id)
        assert r.n_links == degree[r.vec_id]
        assert r.kept == (r.vec_id == r.component_id or r.vec_id is None)
    assert max(degree.values()) >= 3 * nn_descent.LIST


def two_tight_groups(rng, dim, size):
    """Vectors of two groups whose members are all linked across, but never among the nearest ten."""
    a, b = np.linalg.qr(rng.standard_normal((dim, 2)))[0].T
    centres = a, np.cos(0.17) * a + np.sin(0.17) * b
    return [c + 0.001 * rng.standard_normal(dim) for c in centres for _ in range(size)]


def test_close_saturated_groups_are_one(spark):
    rng = np.random.default_rng(11)
    rows = [(i, [float(v) for v in np.float32(x)], 0) for i, x in enumerate(two_tight_groups(rng, 32, 20))]
    rows += [(100 + i, [float(v) for v in np.float32(rng.standard_normal(32))], 0) for i in range(60)]
    usable, links = expected_links(rows)
    assert sum(a < 20 <= b for a, b in links) == 400
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: r for r in nn_descent.near_duplicates(df).collect()}
    degree = Counter(n for x in links for n in x)
    for i, root in smallest(usable, links).items():
        assert (got[i].component_id, got[i].n_links) == (root, degree[i])


def test_links_across_components_equal_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(nn_descent, "CHUNK", 16)
    monkeypatch.setattr(nn_descent, "BLOCK", 7)
    rng = np.random.default_rng(12)
    # Chains: only some members of neighbouring components are linked.
    walk = np.cumsum(0.15 * rng.standard_normal((120, 6)), axis=0) + 3
    rows = [(i, [float(v) for v in np.float32(x)], i % 2) for i, x in enumerate(walk)]
    usable, links = expected_links(rows)
    component = {i: i % 2 * 1000 + i // 8 for i, _, _ in rows}
    across = [(component[a], component[b]) for a, b in links if component[a] != component[b]]
    nodes = spark.createDataFrame(rows, "node long, vector array<float>, label int").withColumn("dim", F.lit(6))
    members = spark.createDataFrame(sorted(component.items()), "node long, root long")
    found = {tuple(r) for r in nn_descent._across(nodes, members, 0.98).select("a", "b").collect()}
    got = [(component[a], component[b]) for a, b in found]
    assert across and smallest(set(component.values()), got) == smallest(set(component.values()), across)


def test_audit_finds_missing_links(spark, vectors):
    df = spark.createDataFrame(vectors[:220], "vec_id long, vector array<float>, label int")
    nodes = df.select(
        F.col("vec_id").alias("node"), "label", F.size("vector").alias("dim"), "vector", F.lit(1).cast("long").alias("copies")
    )
    usable, links = expected_links(vectors[:220])
    degree = Counter(n for x in links for n in x)
    full = spark.createDataFrame(sorted(degree.items()), "node long, links long")
    assert nn_descent.audit(nodes, full, 0.98) == 1.0
    assert nn_descent.audit(nodes, full.filter("node < 0"), 0.98) == 0.0


def test_audit_is_not_read_from_one_group_of_copies(spark):
    rng = np.random.default_rng(13)
    base = rng.standard_normal((201, 16))
    # 100 pairs of which none is known, beside a pair whose two vectors occur 100,000 times each.
    rows = [(2 * i + k, [float(v) for v in base[i] * (1 + k) + 1e-3 * k], 0) for i in range(101) for k in range(2)]
    nodes = spark.createDataFrame(rows, "node long, vector array<double>, label int").select(
        "node", "label", F.lit(16).alias("dim"), "vector", F.expr("if(node < 2, 100000L, 1L)").alias("copies")
    )
    known = spark.createDataFrame([(0, 100000), (1, 100000)], "node long, links long")
    assert nn_descent.audit(nodes, known, 0.98) == 0.0


def test_lone_pairs_are_found_without_orders(spark, monkeypatch):
    monkeypatch.setattr(nn_descent, "AUDIT", 2)
    monkeypatch.setattr(nn_descent, "MOST_REPEATS", 1)
    monkeypatch.setattr(nn_descent, "ROUNDS", 0)
    monkeypatch.setattr(nn_descent, "ORDERS", 1)
    monkeypatch.setattr(nn_descent, "REACH", 1)
    rng = np.random.default_rng(14)
    base = rng.standard_normal((300, 24))
    rows = [(i, [float(v) for v in np.float32(x)], 0) for i, x in enumerate(base)]
    rows += [(300 + i, [float(v) for v in np.float32(x + 0.18 * rng.standard_normal(24))], 0) for i, x in enumerate(base[:80])]
    rows += [(400 + i, [float(v) for v in np.float32(x)], 0) for i, x in enumerate(two_tight_groups(rng, 24, 15))]
    usable, links = expected_links(rows)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: r for r in nn_descent.near_duplicates(df).collect()}
    degree = Counter(n for x in links for n in x)
    for i, root in smallest(usable, links).items():
        assert (got[i].component_id, got[i].n_links) == (root, degree[i])


def test_no_vectors(spark, vectors):
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int")
    assert nn_descent.near_duplicates(df.limit(0)).count() == 0
    alone = nn_descent.near_duplicates(df.filter("label IS NULL"))
    assert alone.count() == 2 and alone.filter("n_links <> 0 OR NOT kept").count() == 0


def test_rare_pairs_are_found_without_comparing_all(spark, monkeypatch):
    rng = np.random.default_rng(21)
    base = np.float32(rng.standard_normal((1500, 32)))
    rows = [(i, [float(v) for v in x], 0) for i, x in enumerate(base)]
    rows += [(2000 + i, [float(v) for v in np.float32(x + 0.19 * rng.standard_normal(32))], 0) for i, x in enumerate(base[:60])]
    usable, links = expected_links(rows)
    assert len(links) > 20
    asked, plain = [], nn_descent._all_links
    monkeypatch.setattr(nn_descent, "AUDIT", 100)

    def counted(nodes, some, threshold):
        asked.append(some.count())
        return plain(nodes, some, threshold)

    monkeypatch.setattr(nn_descent, "_all_links", counted)
    got = {r.vec_id: r for r in nn_descent.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    degree = Counter(n for x in links for n in x)
    for i, root in smallest(usable, links).items():
        assert (got[i].component_id, got[i].n_links) == (root, degree[i])
    assert got[0].recall >= nn_descent.RECALL and max(asked) < 400


def test_planted_partners_are_just_above_the_threshold(spark):
    rng = np.random.default_rng(22)
    rows = [(i, [float(v) for v in rng.standard_normal(12)], i % 3) for i in range(50)] + [(60, [2.0], 0)]
    nodes = spark.createDataFrame(rows, "node long, vector array<double>, label int").withColumn("dim", F.size("vector"))
    partners = {r.node: r for r in nn_descent.planted(nodes, 0.98).collect()}
    assert set(partners) == {-i - 1 for i in range(50)}
    for i, vector, label in rows[:50]:
        x, y = np.array(vector), np.array(partners[-i - 1].vector)
        assert 0.98 < x @ y / np.sqrt((x @ x) * (y @ y)) < 0.981 and partners[-i - 1].label == label
    lists = spark.createDataFrame([(-1, 0, 0.98, 0.0), (-2, 5, 0.99, 0.0)], "u long, v long, sim double, least double")
    known = nodes.filter("node < 2").select((-F.col("node") - 1).alias("node"))
    assert nn_descent.planted_recall(known, lists, 0.98) == 0.5
