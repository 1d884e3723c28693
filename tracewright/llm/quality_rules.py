"""Quality rules: fixed base rules, then gradient-boosted trees over document statistics.

The trees are fitted on a bounded sample of labelled rows (parameter `most`), with monotonic constraints:
repeats, duplicate lines and symbols can only lower a score. They are flattened into numpy node arrays and
score whole Arrow batches. Statistics are computed once over all texts and kept in the shared folder.

Defined results: null and empty texts have no words, so they fail the base rule; repeated rows give repeated
results; a score at the threshold is kept; texts of any length are read whole; an empty table gives an empty result;
without usable labels the trees are a constant (keep).
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boosting import Forest, fit, sigmoid
from .common import materialize
from .textstats import COLUMNS, FEATURES, document_statistics, features, labelled_sample

MONOTONE = {"symbols": -1, "dup_lines": -1, "repeats": -1}
MOST = 20_000


def train(stats: DataFrame, labels: DataFrame, most: int = MOST, **how) -> Forest:
    names = list(FEATURES)
    x, y = labelled_sample(features(stats, "doc_id"), labels, "quality", names, most)
    return fit(x, y, {names.index(k): v for k, v in MONOTONE.items()}, **how)


def score(stats: DataFrame, forest: Forest) -> DataFrame:
    """stats with quality_score (0 to 1) added."""
    import numpy as np

    names = list(FEATURES)
    wide = features(stats, *stats.columns)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in stats.schema.fields] + ["quality_score double"])
    given = stats.columns

    def run(batches):
        for batch in batches:
            x = np.stack([batch.column(len(given) + k).to_numpy(zero_copy_only=False) for k in range(len(names))], axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(given)], pa.array(sigmoid(forest.logits(x)))], names=[*given, "quality_score"])

    return wide.mapInArrow(run, schema)


def quality_rules(docs: DataFrame, labels: DataFrame, most: int = MOST, threshold: float = 0.5) -> DataFrame:
    """doc_id, all statistics, base_failed, quality_score and kept."""
    stats, _ = materialize(document_statistics(docs), "stats")
    scored = score(stats, train(stats, labels, most))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return scored.select(
        "doc_id", *COLUMNS, failed.alias("base_failed"), "quality_score", (~failed & (F.col("quality_score") >= threshold)).alias("kept")
    )
