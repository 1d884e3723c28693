"""N-gram Jaccard join: MinHash buckets, Bayesian candidate pruning, exact verification.

1. Texts with the same words form a class; one representative goes on (grouped minimum by a 128-bit key). Rows get
   their class's results by a join that broadcasts the few classes with very many copies.
2. MinHash bands of the representatives give buckets. A bucket only yields links to its smallest member,
   so it is never expanded into pairs; connected buckets form candidate groups that hold every pair that
   shares a band. At the default 32 bands of 5 a pair at the threshold is missed with probability 3e-6.
3. A group is cut into cells by shingle count (a pair at the threshold lies in the same or neighbouring
   cells) and cells into blocks of bounded size; each pair of blocks is one small task. Inside it MinHash
   values are compared step by step, a pair is dropped once the posterior probability of reaching the
   threshold is below the tolerance, and what is left is verified on exact shingle sets. A task returns a
   count and one component edge per document, never the pairs.

Defined results: null and empty texts have no words and link with nothing; texts below `size` words link
only with equal texts; repeated rows are copies of each other; rows with a null id are returned unlinked. Texts are
compared, not ids: several texts under one id are each compared. Inside, a class goes by 64 bits of its key.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, need, split_join
from .components import connected_components
from .textstats import mix, window_hashes

SIZE, THRESHOLD, TOLERANCE = 5, 0.8, 1e-6
BANDS, ROWS, STEP = 32, 5, 32
BLOCK = 128
FILTER = 1 << 20

_rng = np.random.default_rng(71993)
_TURN = _rng.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)[:, None]
_TIMES = (_rng.integers(0, 1 << 31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1))[:, None]


def shingles(words: list[bytes], size: int = SIZE) -> np.ndarray:
    """Sorted distinct hashes of the word windows."""
    return np.unique(window_hashes(words, size))


def minhash(hashes: np.ndarray) -> np.ndarray:
    """BANDS x ROWS minima of 32-bit permutations of the shingle hashes."""
    low = (hashes >> np.uint64(32)).astype(np.uint32)
    out = np.full(len(_TURN), 0xFFFFFFFF, dtype=np.uint32)
    for s in range(0, len(low), 512):
        np.minimum(out, ((low[None, s : s + 512] ^ _TURN) * _TIMES).min(axis=1), out=out)
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    parts = signature.reshape(BANDS, ROWS).astype(np.uint64)
    key = np.arange(1, BANDS + 1, dtype=np.uint64) << np.uint64(32)
    for r in range(ROWS):
        key = mix(key ^ parts[:, r])
    return key.view(np.int64)


def least_matches(steps: int, threshold: float, tolerance: float) -> list[int]:
    """For n = STEP, 2 STEP, ...: the fewest equal values of n that keep a pair.

    With a uniform prior the similarity after m of n matches is Beta(m + 1, n - m + 1), and the chance that
    it exceeds t is that of at most m successes of n + 1 at t.
    """
    out = []
    for n in range(STEP, steps + 1, STEP):
        total, m = 0.0, -1
        while total < tolerance:
            m += 1
            total += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append(m)
    return out


def similar(a: list[np.ndarray], b: list[np.ndarray], sig_a: np.ndarray, sig_b: np.ndarray, same: bool, threshold: float, tolerance: float) -> np.ndarray:
    """Boolean matrix of the pairs with Jaccard >= threshold (only above the diagonal if same)."""
    na, nb = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    alive = np.minimum(na[:, None], nb[None, :]) >= threshold * np.maximum(na[:, None], nb[None, :]) - 1e-9
    if same:
        alive &= np.triu(np.ones(alive.shape, dtype=bool), 1)
    matches = np.zeros(alive.shape, dtype=np.int16)
    for k, least in enumerate(least_matches(sig_a.shape[1], threshold, tolerance)):
        if not alive.any():
            return alive
        for h in range(k * STEP, (k + 1) * STEP):
            matches += sig_a[:, h, None] == sig_b[None, :, h]
        alive &= matches >= least
    rows, columns = np.nonzero(alive)
    if not len(rows):
        return alive
    if len(rows) <= 4 * (len(a) + len(b)):
        common = np.array([len(np.intersect1d(a[i], b[j], assume_unique=True)) for i, j in zip(rows, columns, strict=True)])
    else:
        use_a, use_b = np.unique(rows), np.unique(columns)
        flat_a, flat_b = np.concatenate([a[i] for i in use_a]), np.concatenate([b[j] for j in use_b])
        row_a, row_b = np.repeat(np.arange(len(use_a)), na[use_a]), np.repeat(np.arange(len(use_b)), nb[use_b])
        known = np.unique(flat_a)
        at_a, at_b = np.searchsorted(known, flat_a), np.minimum(np.searchsorted(known, flat_b), len(known) - 1)
        shared = known[at_b] == flat_b
        at_b, row_b = at_b[shared], row_b[shared]
        table = np.zeros((len(use_a), len(use_b)), dtype=np.float32)
        for s in range(0, len(known), 4096):
            left, right = np.zeros((len(use_a), 4096), dtype=np.float32), np.zeros((len(use_b), 4096), dtype=np.float32)
            in_a, in_b = (at_a >= s) & (at_a < s + 4096), (at_b >= s) & (at_b < s + 4096)
            left[row_a[in_a], at_a[in_a] - s] = 1
            right[row_b[in_b], at_b[in_b] - s] = 1
            table += left @ right.T
        common = table[np.searchsorted(use_a, rows), np.searchsorted(use_b, columns)]
    alive[rows, columns] = common >= threshold * (na[rows] + nb[columns] - common) - 1e-6
    return alive


def local_roots(linked: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Smallest id reachable inside a symmetric link matrix."""
    root = ids.copy()
    while True:
        new = np.minimum(root, np.where(linked, root[None, :], np.iinfo(np.int64).max).min(axis=1))
        if (new == root).all():
            return root
        root = new


def fingerprints(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """doc_id, text_key (of the words), n_words, n_shingles, bands array<long>."""
    schema = pa.schema([("doc_id", pa.int64()), ("text_key", pa.binary()), ("n_words", pa.int64()), ("n_shingles", pa.int64()), ("bands", pa.list_(pa.int64()))])

    def run(batches):
        for batch in batches:
            keys, words_in, counts, bands = [], [], [], []
            for text in batch.column(1):
                words = (text.as_py() or "").encode().split()
                found = shingles(words, size)
                keys.append(hashlib.md5(b" ".join(words)).digest())
                words_in.append(len(words))
                counts.append(len(found))
                bands.append(band_keys(minhash(found)) if len(found) else np.empty(0, dtype=np.int64))
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in bands])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(bands) if bands else np.empty(0, dtype=np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), pa.array(words_in, pa.int64()), pa.array(counts, pa.int64()), lists], schema=schema)

    source = need(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return source.mapInArrow(run, "doc_id long, text_key binary, n_words long, n_shingles long, bands array<long>")


def text_key(text):
    """The text_key of fingerprints() as a column expression."""
    return F.unhex(F.md5(F.trim(F.regexp_replace(text, "[ \\t\\n\\r\\x0B\\f]+", " "))))


def _tasks(members: DataFrame, block: int, threshold: float) -> DataFrame:
    """(id, doc, copies, parts) of candidate members (id, doc, n_shingles, copies, component)."""
    sizes = members.groupBy("component").agg(F.count(F.lit(1)).alias("group_size")).withColumnRenamed("component", "_g")
    cell = F.when(F.col("group_size") <= block, F.lit(0)).otherwise(F.floor(F.log(F.col("n_shingles").cast("double")) / F.lit(-math.log(threshold)) + 1e-9)).cast("int")
    members = members.join(sizes, F.col("component") == F.col("_g")).withColumn("cell", cell)
    blocks = members.groupBy("component", "cell").agg(F.ceil(F.count(F.lit(1)) / F.lit(block)).cast("int").alias("n"))
    near = blocks.select(F.col("component").alias("_c"), F.explode(F.array(*[F.struct((F.col("cell") + d).alias("cell"), F.lit(-d).alias("d"), F.col("n").alias("n")) for d in (-1, 0, 1)])).alias("b"))
    near = near.groupBy("_c", F.col("b.cell").alias("_cell")).agg(*[F.coalesce(F.max(F.when(F.col("b.d") == d, F.col("b.n"))), F.lit(0)).alias(n) for d, n in ((-1, "below"), (0, "own"), (1, "above"))])
    joined = members.join(near, (F.col("component") == F.col("_c")) & (F.col("cell") == F.col("_cell"))).withColumn("i", F.pmod(F.xxhash64("id"), F.col("own")).cast("int"))
    made = F.expr("""concat(
        transform(sequence(0, own - 1), j -> struct(struct(component as g, cell as c, cell as d, least(i, j) as i, greatest(i, j) as j) as task, cast(i > j as int) as side)),
        if(above > 0, transform(sequence(0, greatest(above, 1) - 1), j -> struct(struct(component as g, cell as c, cell + 1 as d, i as i, j as j) as task, 0 as side)), array()),
        if(below > 0, transform(sequence(0, greatest(below, 1) - 1), j -> struct(struct(component as g, cell - 1 as c, cell as d, j as i, i as j) as task, 1 as side)), array()))""")
    return joined.select("id", "doc", "copies", made.alias("parts"))


def _verify(texts: DataFrame, size: int, threshold: float, tolerance: float) -> DataFrame:
    """(id, links, root) from (id, copies, parts, text): links weigh partners by their copies."""

    def prepare(batches):
        for batch in batches:
            found = [shingles((x.as_py() or "").encode().split(), size) for x in batch.column(3)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array([x.tobytes() for x in found], pa.binary()), pa.array([minhash(x).tobytes() for x in found], pa.binary())],
                names=["id", "copies", "parts", "shingles", "signature"],
            )

    part = "struct<task:struct<g:long,c:int,d:int,i:int,j:int>,side:int>"
    ready = texts.select("id", "copies", "parts", "text").mapInArrow(prepare, f"id long, copies long, parts array<{part}>, shingles binary, signature binary")
    rows = ready.select("id", "copies", "shingles", "signature", F.explode("parts").alias("p")).select("id", "copies", "shingles", "signature", "p.task", "p.side")

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["side", "id"])
        ids, copies, side = frame["id"].to_numpy(), frame["copies"].to_numpy(), frame["side"].to_numpy()
        sets = [np.frombuffer(x, dtype=np.uint64) for x in frame["shingles"]]
        signs = np.stack([np.frombuffer(x, dtype=np.uint32) for x in frame["signature"]])
        k, n = int((side == 0).sum()), len(ids)
        linked = np.zeros((n, n), dtype=bool)
        same = k in (0, n)
        task = frame["task"].iloc[0]
        if same and task["c"] == task["d"] and task["i"] == task["j"]:
            linked = similar(sets, sets, signs, signs, True, threshold, tolerance)
        elif not same:
            linked[:k, k:] = similar(sets[:k], sets[k:], signs[:k], signs[k:], False, threshold, tolerance)
        linked |= linked.T
        touched = linked.any(axis=1)
        links = linked @ copies
        return pd.DataFrame({"id": ids, "links": links, "root": local_roots(linked, ids)})[touched]

    return rows.groupBy("task").applyInPandas(compare, "id long, links long, root long")


def jaccard_join(docs: DataFrame, size: int = SIZE, threshold: float = THRESHOLD, tolerance: float = TOLERANCE, block: int = BLOCK, keyed: bool = False) -> DataFrame:
    """One row per input row: doc_id, class_id, n_copies, n_links, component_id, kept (and text_key if keyed).

    class_id is the smallest id with the same words, n_links counts the other rows (copies included) at or
    above the threshold, component_id is the smallest id reachable by links, kept marks one row of that id in each component.
    """
    found, _ = materialize(fingerprints(docs, size).withColumn("row_id", F.monotonically_increasing_id()), "shingles")
    total = found.count()
    # equal texts have equal shingles, so any row of a class gives them; partial results leave each task
    classes = found.where("doc_id is not null and n_words > 0").groupBy("text_key").agg(
        F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("n_copies"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"),
    )
    classes, _ = materialize(classes.withColumn("node", F.xxhash64("text_key")), "classes")
    reps = classes.where("n_shingles > 0").select(F.col("node").alias("id"), F.col("class_id").alias("doc"), "n_shingles", F.col("n_copies").alias("copies"), "bands")
    banded = reps.select("id", F.explode("bands").alias("band"))
    buckets = banded.groupBy("band").agg(F.min("id").alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("band").alias("b"), "hub")
    stars = banded.join(buckets, F.col("band") == F.col("b")).where("id <> hub").select("id", "hub").distinct()
    groups = connected_components(stars, "id", "hub").select(F.col("id").alias("_id"), "component")
    members = reps.select("id", "doc", "n_shingles", "copies").join(groups, F.col("id") == F.col("_id")).drop("_id")
    members, _ = materialize(members, "members")
    tasks = _tasks(members, block, threshold)
    texts = need(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("_doc"), F.col("text").cast("string").alias("text"))
    # only documents in a bucket of some candidate id are shuffled; at most FILTER rows are broadcast
    bucket = lambda c: F.pmod(F.xxhash64(c), F.lit(FILTER))
    wanted = members.select(bucket("doc").alias("_bucket")).distinct()
    texts = texts.join(F.broadcast(wanted), bucket("_doc") == F.col("_bucket"), "left_semi").withColumn("_node", F.xxhash64(text_key(F.col("text"))))
    texts = texts.groupBy("_node", "_doc").agg(F.first("text").alias("text"))  # one row of equal ones
    verified, _ = materialize(_verify(tasks.join(texts, (F.col("id") == F.col("_node")) & (F.col("doc") == F.col("_doc"))), size, threshold, tolerance), "links")
    links = verified.groupBy("id").agg(F.sum("links").alias("links"))
    unions = connected_components(verified.where("id <> root"), "id", "root").select(F.col("id").alias("_id"), "component")
    least = unions.join(members.select(F.col("id").alias("_m"), "doc"), F.col("_id") == F.col("_m")).groupBy("component").agg(F.min("doc").alias("least")).withColumnRenamed("component", "_c")
    by_class = links.join(unions, F.col("id") == F.col("_id"), "left").join(least, F.col("component") == F.col("_c"), "left").select(F.col("id").alias("_class"), "links", "component", "least")
    verdicts, _ = materialize(
        classes.select(F.col("text_key").alias("_key"), "class_id", "n_copies", "node").join(by_class, F.col("node") == F.col("_class"), "left").drop("_class"), "verdicts"
    )
    own = F.concat(F.lit("row "), F.col("row_id").cast("string")).cast("binary")  # rows without a class meet nothing
    rows = found.select("row_id", "doc_id", "text_key", "n_words", F.when(F.col("doc_id").isNotNull() & (F.col("n_words") > 0), F.col("text_key")).otherwise(own).alias("_class"))
    member = split_join(rows, verdicts, {"_class": "_key"}, "n_copies", total)
    class_id = F.coalesce("class_id", "doc_id")
    component = F.coalesce("least", class_id)
    member, _ = materialize(member.withColumn("group", F.coalesce("component", "node")).withColumn("first_id", F.coalesce(F.col("doc_id") == component, F.lit(True))), "members")
    # of several rows of a component's smallest id, one is kept
    firsts = member.where("first_id and group is not null").groupBy(F.col("group").alias("_g")).agg(F.min("row_id").alias("_row"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    member = member.withColumn("_own", F.when(F.col("first_id") & F.col("group").isNotNull(), F.col("group")).otherwise(F.col("row_id")))
    member = split_join(member, firsts, {"_own": "_g"}, "_n", total)
    return member.select(
        "doc_id", class_id.alias("class_id"), F.coalesce("n_copies", F.lit(1)).alias("n_copies"),
        (F.coalesce("n_copies", F.lit(1)) - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
        component.alias("component_id"), (F.col("first_id") & F.coalesce(F.col("group").isNull() | (F.col("row_id") == F.col("_row")), F.lit(True))).alias("kept"), *(["text_key"] if keyed else []),
    )
