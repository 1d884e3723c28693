import numpy as np
from pyspark.sql import functions as F

from tracewright.llm.embedding_dedup import embedding_dedup
from tracewright.llm.hnsw import Hnsw, neighbours_above


def brute(rows, threshold):
    links = {i: set() for i, _, _ in rows}
    for a, (i, v, lab) in enumerate(rows):
        for j, w, other in rows[a + 1 :]:
            if lab is None or lab != other or v is None or w is None or len(v) != len(w):
                continue
            x, y = (np.array([np.nan if c is None else c for c in u], dtype=float) for u in (v, w))
            if not (np.isfinite(x).all() and np.isfinite(y).all() and x.any() and y.any()):
                continue
            if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= threshold:
                links[i].add(j)
                links[j].add(i)
    return links


def test_graph_finds_neighbours():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(1500, 16))
    x[700:1000] = x[5] + 0.05 * rng.normal(size=(300, 16))  # a tight group larger than the beam
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    graph = Hnsw.load(Hnsw(x).save(), x)
    ids, _ = graph.search(x[:200], 64)
    best = np.argsort(-(x[:200] @ x.T), axis=1)[:, :5]
    assert np.mean([len(set(a[:5]) & set(b)) / 5 for a, b in zip(ids, best, strict=True)]) > 0.9
    a, b = neighbours_above(graph, x, x, 0.93, 16)
    want = x @ x.T >= 0.93
    assert len(set(zip(a.tolist(), b.tolist(), strict=True))) == len(a) and want[a, b].all() and len(a) >= 0.98 * want.sum()
    assert neighbours_above(Hnsw(x[:1]), x[:1], x[:3], 0.9, 8)[0].tolist() == [0]


def test_dedup_against_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = []
    for k in range(260):
        base = rng.normal(size=8)
        for _ in range(1 if k % 4 else rng.integers(1, 6)):
            rows.append((len(rows), [float(v) for v in np.float32(base + 0.08 * rng.normal(size=8))], int(k % 3)))
    same = rows[3][1]
    odd = [None, [], [0.0] * 8, [float("nan")] * 8, [float("inf")] * 8, [None] + [1.0] * 7, [1.0, 2.0], same, same]
    rows += [(len(rows) + k, v, 0) for k, v in enumerate(odd)]
    rows += [(len(rows), same, None), (len(rows) + 1, same, 2)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    for name in ("id", "shard", "copies", "dim", "chunk"):
        table = table.withColumn(name, F.lit(1))
    links = brute(rows, 0.93)
    got = {r["vec_id"]: r for r in embedding_dedup(table, shards=2, chunk=64).collect()}
    assert {k: r["n_links"] for k, r in got.items()} == {k: len(v) for k, v in links.items()}
    for k in links:
        seen, stack = {k}, [k]
        while stack:
            for n in links[stack.pop()] - seen:
                seen.add(n)
                stack.append(n)
        assert got[k]["component_id"] == min(seen) and got[k]["kept"] == (k == min(seen))
    assert embedding_dedup(table.limit(0)).count() == 0
