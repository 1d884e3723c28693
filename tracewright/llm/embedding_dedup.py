"""Embedding near-dedup: one small-world graph per shard, every shard queried, links verified, components united.

Vectors are compared within a label only. Equal vectors form a class and one representative goes on. Each
label is dealt into shards (at least SHARDS, more beyond SHARD_ROWS each), one graph each; queries go in
chunks of bounded size to every shard of their label. A beam widens per query while its worst hit is still a
link, and for a whole task while its audit finds less than the wanted recall: AUDIT queries and one in AUDIT_SHARE
are compared with all rows of the shard, and their own vectors don't count. Tasks return counts and component edges,
never the pairs. Vectors travel as they are stored; unit vectors in double precision are made where they are used.

Defined results: vectors that are null, zero, empty or hold null or non-finite components, and those with a
null label or id, link with nothing; vectors of different length are not compared; repeated rows are copies.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, split_join
from .components import connected_components
from .hnsw import Hnsw, neighbours_above

THRESHOLD, RECALL = 0.93, 0.98
SHARDS, SHARD_ROWS, CHUNK = 2, 50_000, 16_384
BEAM, AUDIT, AUDIT_SHARE = 32, 24, 50


def unit(vectors) -> np.ndarray:
    x = np.stack([np.asarray(v, dtype=np.float64) for v in vectors])
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _build(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame.sort_values("id")
    return pd.DataFrame({
        "label": [frame["label"].iloc[0]], "dim": [frame["dim"].iloc[0]], "shard": [frame["shard"].iloc[0]], "chunks": [frame["chunks"].iloc[0]],
        "ids": [frame["id"].to_numpy(np.int64).tobytes()], "copies": [frame["copies"].to_numpy(np.int64).tobytes()],
        "vectors": [np.stack(frame["v"]).tobytes()], "graph": [Hnsw(unit(frame["v"])).save()],
    })


def _roots(a: np.ndarray, b: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Smallest id in each node's component of the edges (a, b)."""
    root = ids.copy()
    while True:
        least = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        if (new == root).all():
            return root
        root = new


def _query(threshold: float, recall: float, beam: int, audit: int, stored: str):
    def run(index: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"id": np.empty(0, np.int64), "links": np.empty(0, np.int64), "root": np.empty(0, np.int64)})
        if not len(index) or not len(queries):
            return none
        row, queries = index.iloc[0], queries.sort_values("id")
        ids, copies = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["copies"], np.int64)
        exact = unit(np.frombuffer(row["vectors"], stored).reshape(len(ids), -1))
        graph, own, q = Hnsw.load(row["graph"], exact), queries["id"].to_numpy(np.int64), unit(queries["v"])
        tried = np.linspace(0, len(q) - 1, min(audit + len(q) // AUDIT_SHARE, len(q))).astype(int)
        want = 0
        for s in range(0, len(tried), 64):
            part = tried[s : s + 64]
            want += int(((q[part] @ exact.T >= threshold) & (own[part][:, None] != ids[None, :])).sum())
        wide = beam
        while True:
            a, b = neighbours_above(graph, exact, q[tried], threshold, wide)
            if (own[tried][a] != ids[b]).sum() >= recall * want or wide >= len(ids):
                break
            wide *= 2
        a, b = neighbours_above(graph, exact, q, threshold, wide)
        other = own[a] != ids[b]
        a, b = a[other], b[other]
        if not len(a):
            return none
        links = np.bincount(a, weights=copies[b], minlength=len(own)).astype(np.int64)
        names = np.concatenate([own, ids])
        root = _roots(a, b + len(own), names)
        # a node may stand on both sides; equal ids are joined by later union
        used = np.unique(np.concatenate([a, b + len(own)]))
        return pd.DataFrame({"id": names[used], "links": np.where(used < len(own), np.concatenate([links, np.zeros(len(ids), np.int64)])[used], 0), "root": root[used]})

    return run


def embedding_dedup(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD, recall: float = RECALL,
                    shards: int = SHARDS, shard_rows: int = SHARD_ROWS, chunk: int = CHUNK, beam: int = BEAM, audit: int = AUDIT) -> DataFrame:
    """One row per input row: the id, n_links, component_id, kept (and class_id, the smallest id of an equal vector)."""
    kind = vectors.schema[vector_col].dataType.simpleString()
    stored = {"array<float>": "<f4"}.get(kind, "<f8")
    source = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast(kind if stored == "<f4" else "array<double>").alias("v"))
    good = F.expr("id is not null and label is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('Infinity')) and exists(v, x -> x <> 0)")
    keyed = source.withColumn("ok", F.coalesce(good, F.lit(False))).withColumn("dim", F.size("v"))
    keyed = keyed.withColumn("h1", F.xxhash64("v")).withColumn("h2", F.xxhash64(F.lit(1), "v"))
    # vectors of one label with equal hashes are equal, so any row of a class gives its vector
    reps = keyed.where("ok").groupBy("label", "dim", "h1", "h2").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"), F.first("v").alias("v"))
    reps, _ = materialize(reps, "vectors")
    sizes = reps.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("n")).select(
        F.col("label").alias("_l"), F.col("dim").alias("_d"),
        F.greatest(F.lit(shards), F.ceil(F.col("n") / shard_rows)).cast("int").alias("shards"), F.greatest(F.lit(1), F.ceil(F.col("n") / chunk)).cast("int").alias("chunks"),
    )
    # sizes has a row for each label: broadcast up to the session's own limit, which is checked by Spark
    dealt = reps.drop("h1", "h2").join(sizes, (F.col("label") == F.col("_l")) & (F.col("dim") == F.col("_d"))).drop("_l", "_d")
    dealt = dealt.withColumn("shard", F.pmod(F.xxhash64("id"), F.col("shards")).cast("int")).withColumn("chunk", F.pmod(F.xxhash64(F.lit(3), "id"), F.col("chunks")).cast("int"))
    label = vectors.schema[label_col].dataType.simpleString()
    index = dealt.select("id", "label", "dim", "copies", "v", "shard", "chunks").groupBy("label", "dim", "shard").applyInPandas(
        _build, f"label {label}, dim int, shard int, chunks int, ids binary, copies binary, vectors binary, graph binary"
    )
    index, _ = materialize(index, "graphs")
    spread = index.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    queries = dealt.select("id", "label", "dim", "v", "chunk", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"))
    keys = ["label", "dim", "shard", "chunk"]
    found = spread.groupBy(*keys).cogroup(queries.groupBy(*keys)).applyInPandas(_query(threshold, recall, beam, audit, stored), "id long, links long, root long")
    found, _ = materialize(found, "links")
    links = found.groupBy("id").agg(F.sum("links").alias("links")).withColumnRenamed("id", "_id")
    unions = connected_components(found, "id", "root").select(F.col("id").alias("_node"), "component")
    classes = reps.select(F.col("label").alias("_label"), F.col("dim").alias("_dim"), F.col("h1").alias("_h1"), F.col("h2").alias("_h2"), F.col("id").alias("class_id"), "copies")
    classes = classes.join(links, F.col("class_id") == F.col("_id"), "left").join(unions, F.col("class_id") == F.col("_node"), "left").drop("_id", "_node")
    classes, _ = materialize(classes, "classes")
    rows = keyed.select("id", "label", "ok", "dim", "h1", "h2")
    keys = {"label": "_label", "dim": "_dim", "h1": "_h1", "h2": "_h2"}
    out = split_join(rows.where("ok"), classes, keys, "copies", vectors.count())
    out = out.unionByName(rows.where("not ok"), allowMissingColumns=True)
    class_id = F.coalesce("class_id", "id")
    component = F.coalesce("component", class_id)
    n_links = F.coalesce(F.col("copies") - 1, F.lit(0)) + F.coalesce("links", F.lit(0))
    return out.select(F.col("id").alias(id_col), n_links.alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"), class_id.alias("class_id"))
