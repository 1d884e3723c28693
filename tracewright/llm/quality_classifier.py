"""Quality classifier: hierarchical empirical Bayes over document, path and host.

A logistic classifier turns document statistics into log-odds of good quality. Hosts and paths (by default
source, and source with language) get Beta posteriors from the documents' probabilities by grouped
aggregation: a path is shrunk to its host, a host to the global prior, with strengths estimated by the
method of moments over all groups. A document's posterior replaces the classifier's implied prior by its
path's posterior. Sums are partial before they are shuffled, so a hot host is one row per task.

Defined results: a text without words is rejected (score 0); null hosts or paths form their own group;
ties at the threshold are kept; repeated rows are scored one by one and each counts in its site's sums; texts of any
length are read whole; an empty table gives an empty result; without labels all text is kept.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .boosting import fit_logistic
from .common import materialize
from .textstats import FEATURES, document_statistics, features, labelled_sample

MOST = 20_000
_EDGE = 1e-4


def _logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(_EDGE)), F.lit(1 - _EDGE))
    return F.log(p / (1 - p))


def _strength(groups: DataFrame, mean: str, toward: Column) -> float:
    """Method-of-moments strength (pseudo-count) of a Beta prior from group means: one aggregate row."""
    row = groups.agg(
        F.sum(F.col("n") * F.pow(F.col(mean) - toward, 2)).alias("between"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("groups"),
        F.sum(F.col("spread")).alias("within"), F.sum(F.col("n") * toward * (1 - toward)).alias("most"),
    ).first()
    if not row["n"] or row["groups"] < 2:
        return 100.0
    variance = max(row["most"] / row["n"], 1e-9)
    excess = row["between"] - row["within"] / row["n"] * row["groups"]
    share = min(max(excess / row["n"] / variance, 1e-3), 0.5)
    return (1 - share) / share


def evidence(stats: DataFrame, labels: DataFrame, most: int = MOST) -> DataFrame:
    """stats with doc_logit: the classifier's log-odds, fitted on at most `most` labelled training rows."""
    names = list(FEATURES)
    x, y = labelled_sample(features(stats, "doc_id"), labels, "quality", names, most)
    centre, scale, weights, bias = fit_logistic(np.concatenate([x, x**2], axis=1), y)
    logit = F.lit(bias)
    for k, name in enumerate(names):
        value = F.expr(f"cast({FEATURES[name]} as double)")
        for j, v in ((k, value), (k + len(names), value * value)):
            z = F.least(F.greatest((v - F.lit(float(centre[j]))) / F.lit(float(scale[j])), F.lit(-8.0)), F.lit(8.0))
            logit = logit + F.lit(float(weights[j])) * z
    return stats.withColumn("doc_logit", logit)


def classify(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", most: int = MOST, threshold: float = 0.5) -> DataFrame:
    """doc_id, n_words, doc_logit, host_posterior, path_posterior, score, kept: one row per input row."""
    stats, _ = materialize(document_statistics(docs, keep=(host, path)), "quality")
    scored = evidence(stats, labels, most).select("doc_id", "n_words", "doc_logit", F.col(host).alias("host"), F.col(path).alias("path"))
    scored = scored.withColumn("p", 1 / (1 + F.exp(-F.col("doc_logit"))))
    paths = (
        scored.where("n_words > 0").groupBy("host", "path")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("p").alias("good"), F.sum(F.col("p") * (1 - F.col("p"))).alias("spread"))
    )
    paths, _ = materialize(paths, "paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("good").alias("good"), F.sum("spread").alias("spread"))
    total = hosts.agg(F.sum("n").alias("n"), F.sum("good").alias("good")).first()
    prior = (total["good"] + 1) / (total["n"] + 2) if total["n"] else 0.5
    a = _strength(hosts.withColumn("mean", F.col("good") / F.col("n")), "mean", F.lit(prior))
    hosts = hosts.select(F.col("host").alias("h"), ((F.col("good") + a * prior) / (F.col("n") + a)).alias("host_posterior"))
    joined = paths.join(hosts, F.col("host").eqNullSafe(F.col("h"))).withColumn("mean", F.col("good") / F.col("n"))
    b = _strength(joined, "mean", F.col("host_posterior"))
    sites = joined.select(
        F.col("h"), F.col("path").alias("q"), "host_posterior", ((F.col("good") + b * F.col("host_posterior")) / (F.col("n") + b)).alias("path_posterior")
    )
    out = scored.join(sites, F.col("host").eqNullSafe(F.col("h")) & F.col("path").eqNullSafe(F.col("q")), "left")
    site = F.coalesce("path_posterior", F.lit(prior))
    posterior = 1 / (1 + F.exp(-(F.col("doc_logit") + _logit(site) - _logit(F.lit(prior)))))
    score = F.when(F.col("n_words") == 0, 0.0).otherwise(posterior)
    return out.select("doc_id", "n_words", "doc_logit", "host_posterior", "path_posterior", score.alias("score"), (score >= threshold).alias("kept"))
