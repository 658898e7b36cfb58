"""Embeddings and shingle joins against all pairs; components against a plain search."""

from __future__ import annotations

import numpy as np
import pytest

from featherline.llm import components, ngram_join, similarity

SCHEMA = "doc_id long, text string, lang string, rep string, class_id string"


def classes(nodes, links):
    root = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(root[a], root[b])
            if root[a] != low or root[b] != low:
                root[a] = root[b] = low
                changed = True
    return root


def test_components_of_chains_stars_and_loops(spark):
    links = [(i, i + 1) for i in range(60)] + [(200, i) for i in range(100, 130)] + [(7, 7), (61, 60), (61, 60)] + [(301, 300)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = {n: r for n, r in classes({x for p in links for x in p}, links).items() if n != r}
    assert got == want
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_error_bounds_hold():
    rng = np.random.default_rng(0)
    x = similarity.exact(rng.normal(size=(300, 48)) ** 3)
    q, s, e = similarity.quantise(x)
    found = (q.astype(int) @ q.T.astype(int)) * s[:, None] * s[None, :]
    assert (np.abs(found - x @ x.T) <= e[:, None] + e[None, :] + e[:, None] * e[None, :]).all()


@pytest.mark.parametrize("rows", [4096, 16])
def test_vectors_against_all_pairs(spark, monkeypatch, rows):
    monkeypatch.setattr(similarity, "TILE_ROWS", rows)
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(6, 12))
    x = (centres[rng.integers(0, 6, 120)] + rng.normal(size=(120, 12)) * rng.uniform(0.05, 0.6, (120, 1))).astype(np.float32)
    vectors = [(i, [float(v) for v in row]) for i, row in enumerate(x)]
    vectors += [(200 + i, vectors[3][1]) for i in range(40)]
    vectors += [(300, None), (301, [0.0] * 12), (302, [float("nan")] + [1.0] * 11), (303, [None] + [1.0] * 11), (304, []), (305, [1.0] * 3), (306, [2.0] * 3), (307, [float("inf")] * 12)]
    df = spark.createDataFrame([(i, v, 1, "c") for i, v in vectors], "vec_id long, embedding array<float>, tile int, q string")
    good = {i: np.array(v, float) for i, v in vectors if v and None not in v and np.isfinite(v).all() and any(v)}
    links = []
    for a in good:
        for b in good:
            if a < b and len(good[a]) == len(good[b]):
                if good[a] @ good[b] / np.sqrt((good[a] @ good[a]) * (good[b] @ good[b])) >= 0.9:
                    links.append((a, b))
    root = classes([i for i, _ in vectors], links)
    got = {r.vec_id: r for r in similarity.near_vectors(df, 0.9).collect()}
    assert len(got) == len(vectors)
    for i, _ in vectors:
        want = (sum(i in p for p in links), root[i], root[i] == i)
        assert (got[i].n_links, got[i].component_id, got[i].kept) == want
    assert similarity.near_vectors(df.limit(0), 0.9).count() == 0


def test_different_vectors_of_one_id_are_counted_apart(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.01]), (3, [0.01, 1.0]), (4, [-1.0, 0.0]), (3, [0.01, 1.0])]
    got = sorted(tuple(r) for r in similarity.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), 0.9).collect())
    assert got == sorted([(1, 1, 1, True), (1, 2, 1, True), (2, 1, 1, False), (3, 2, 1, False), (3, 2, 1, False), (4, 0, 4, True)])


def test_doubles_keep_their_precision(spark):
    a, b = [1.0, 0.0], [0.9, float(np.sqrt(1 - 0.9**2))]
    low, high = [0.9 - 1e-12, b[1]], [0.9 + 1e-12, b[1]]
    for other, links in ((low, 0), (high, 1)):
        rows = [(1, a), (2, other)]
        got = similarity.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 0.9)
        assert [r.n_links for r in got.collect()] == [links, links]


def shingles(text):
    words = [w for w in (text or "").lower().replace("\t", " ").replace("\n", " ").split(" ") if w]
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


@pytest.mark.parametrize("small", [False, True])
def test_documents_against_all_pairs(spark, monkeypatch, small):
    if small:
        monkeypatch.setattr(ngram_join, "BLOCK_SHINGLES", 600)
        monkeypatch.setattr(ngram_join, "MATRIX_CELLS", 100)
    rng = np.random.default_rng(2)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for base in range(8):
        words = list(rng.choice(vocabulary, int(rng.integers(8, 150))))
        for _ in range(14):
            changed = list(words)
            for _ in range(int(rng.integers(0, 4))):
                changed[int(rng.integers(len(changed)))] = str(rng.choice(vocabulary))
            rows.append(" ".join(changed))
    rows += ["one two", "One  TWO", "one", None, "", " \n", "a b c d e", "a b c d e"]
    rows += [rows[0]] * 5
    texts = dict(enumerate(rows))
    df = spark.createDataFrame([(i, t, "en", "x", "y") for i, t in texts.items()] + [(None, rows[0], "en", "x", "y")], SCHEMA)
    sets = {i: shingles(t) for i, t in texts.items()}
    links = [(a, b) for a in texts for b in texts if a < b and sets[a] and sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    root = classes(texts, links)
    got = {r.doc_id: r for r in ngram_join.near_duplicates(df).collect()}
    assert len(got) == len(texts) + 1 and got[None].kept and got[None].n_links == 0
    want = {i: (root[i], sum(i in p for p in links), root[i] == i) for i in texts}
    assert {i: (got[i].class_id, got[i].n_links, got[i].kept) for i in texts} == want
    assert ngram_join.near_duplicates(df.limit(0)).count() == 0


def test_prefixes_shorten_until_the_recall():
    length = ngram_join.prefix_length(0.8, 20, 5, 0.9999)
    assert ngram_join.expected_recall(0.8, length, 20) >= 0.9999 > ngram_join.expected_recall(0.8, length + 1, 20)


def test_levels_depend_on_what_a_document_can_share():
    levels = ngram_join.shortest_prefixes(0.8, 20, 6, 0.9999)
    assert [ngram_join.least_similarity(n, 0.8) for n in (1, 3, 4, 6, 7, 8)] == [1, 1, 4 / 5, 5 / 6, 6 / 7, 4 / 5]
    assert list(levels[[1, 3, 4, 5, 6, 7, 8, ngram_join.SMALL_SET + 1]]) == [6, 6, 4, 4, 5, 6, 4, 4]
    for n in range(1, ngram_join.SMALL_SET + 1):
        all_similarities = [i / (n + m - i) for m in range(1, 2 * n + 2) for i in range(1, min(n, m) + 1) if 5 * i >= 4 * (n + m - i)]
        assert ngram_join.least_similarity(n, 0.8) == min(all_similarities)


@pytest.mark.parametrize("parts", [1, 7])
def test_tries_link_what_shares_a_node(spark, parts):
    rng = np.random.default_rng(5)
    depth = 3
    rows = [(int(t), rng.integers(0, 3, depth), int(r), int(rng.integers(1, depth + 1))) for t in range(2) for r in range(60)]
    rows += [(5, np.array([1, 1, 1]), r, 3) for r in range(100, 140)]  # one leaf of many documents, cut over tasks
    data = [(t, bytearray(p.astype(">u4").tobytes()), r, s) for t, p, r, s in rows]
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        df = spark.createDataFrame(data, "tree int, path binary, rep long, shortest int")
        links = [tuple(r) for r in ngram_join.trie_links(df, depth).collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    allowed = set()
    for t, p, r, s in rows:
        for u, q, v, w in rows:
            if t == u and r != v and (p[: max(s, w)] == q[: max(s, w)]).all():
                allowed.add((r, v))
    nodes = {r for _, _, r, _ in rows}
    assert set(links) <= allowed
    assert classes(nodes, links) == classes(nodes, allowed)
