import math

import numpy as np
import pytest


def brute(rows, least):
    """rows: (id, vector, label) -> {id: (n_links, component)}"""
    ok = [r for r in rows if r[1] is not None and r[2] is not None and all(e is not None and math.isfinite(e) for e in r[1]) and any(r[1])]
    up = {r[0]: r[0] for r in rows}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    n = {r[0]: 0 for r in rows}
    for label in {r[2] for r in ok}:
        own = [r for r in ok if r[2] == label]
        x = np.array([r[1] for r in own], float)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        for a, b in zip(*np.nonzero(np.triu(x @ x.T >= least, 1))):
            p, q = own[a][0], own[b][0]
            n[p] += 1
            n[q] += 1
            lo, hi = sorted((top(p), top(q)))
            up[hi] = lo
    return {i: (n[i], top(i)) for i in up}


def found(df):
    return {r["vec_id"]: (r["n_links"], r["component_id"]) for r in df.collect()}


def test_against_brute_force(spark):
    from tidemark.llm.embedding_dedup import link_vectors, recall

    v = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, r.embedding, r.label) for r in v.collect()]
    out = link_vectors(v)
    got, want = found(out), brute(rows, 0.93)
    assert got.keys() == want.keys()
    all_links = sum(n for n, _ in want.values())
    assert sum(n for n, _ in got.values()) >= 0.98 * all_links and all(got[i][0] <= want[i][0] for i in want)
    r = recall(v, out).first()
    assert r["found_links"] >= 0.9 * r["true_links"]


def test_groups_blocks_and_awkward_rows(spark):
    """Equal vectors, a large group of near copies over several blocks and clusters, and vectors that link with nothing."""
    from tidemark.llm.embedding_dedup import link_vectors

    rng = np.random.default_rng(4)
    base = rng.normal(size=16)
    rows = [(i, (base + rng.normal(scale=0.05, size=16)).tolist(), 1) for i in range(150)]
    rows += [(150 + i, rng.normal(size=16).tolist(), 1) for i in range(300)] + [(500 + i, base.tolist(), 2) for i in range(40)] + [(560, (2 * base).tolist(), 2)]
    rows += [(600, None, 1), (601, [0.0] * 16, 1), (602, [1.0, None] + [0.0] * 14, 1), (603, [float("nan")] * 16, 1), (604, base.tolist(), None), (605, [float("inf")] * 16, 1), (606, [1.0, 2.0], 1), (607, [2.0, 4.0], 1)]
    df = spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<double>, label int, m int")
    same = [r for r in rows if r[0] not in (606, 607)]
    want = brute(same, 0.93) | {606: (1, 606), 607: (1, 606)}
    for block in (4096, 60):
        out = link_vectors(df, block_rows=block)
        got = found(out)
        assert len(got) == len(rows)
        if block == 4096:
            assert got == want
        else:
            assert sum(n for n, _ in got.values()) >= 0.9 * sum(n for n, _ in want.values())
            assert {i: c for i, (_, c) in got.items()} == {i: c for i, (_, c) in want.items()}
        assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in out.collect())


def test_empty(spark):
    from tidemark.llm.embedding_dedup import link_vectors

    assert link_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


@pytest.mark.parametrize("n", [1, 2, 900])
def test_graph_search_reaches_what_is_in_range(n):
    from tidemark.llm.embedding_dedup import FlatGraph

    rng = np.random.default_rng(n)
    x = rng.normal(size=(n, 32))
    x[n // 2 :] = x[0] + rng.normal(scale=0.1, size=(n - n // 2, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    g = FlatGraph(x, shard=200)
    hits = true = 0
    for q in x[::7]:
        hits += len(g.in_range(q, g.x[g.medoids] @ q, 0.9)[0])
        true += int((x @ q >= 0.9).sum())
    assert hits >= 0.98 * true


def test_pairs_across_clusters_are_all_found(spark):
    """Vectors in all directions, each with one partner at the edge of the range: none is lost between centroids."""
    from tidemark.llm.embedding_dedup import home_and_visits, link_vectors, nearest_centroids

    rng = np.random.default_rng(8)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    a = unit(rng.normal(size=(1500, 64)))
    side = rng.normal(size=a.shape)
    b = 0.935 * a + np.sqrt(1 - 0.935**2) * unit(side - (side * a).sum(axis=1, keepdims=True) * a)
    x = np.concatenate((a, b))
    at = home_and_visits(x, nearest_centroids(x, 30), 0.93)
    assert all((set(at[i]) & {at[i + 1500][0]}) or (set(at[i + 1500]) & {at[i][0]}) for i in range(1500))
    df = spark.createDataFrame([(i, v, 1) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>, label int")
    want = brute([(i, v, 1) for i, v in enumerate(x.tolist())], 0.93)
    assert found(link_vectors(df, block_rows=100)) == want
