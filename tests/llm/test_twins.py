"""Plain NumPy and Python twins of the trained operators, and the stages of the pipeline against brute force."""

import os
import random
import re
import time

import numpy as np
import pytest
from test_text_operators import ODD, brute_line_dedup, brute_links, docs, licences, quality_data, smallest_reachable, toxic_data, words  # noqa: F401

from tracewright.llm import byte_bpe, embedding_dedup, license_scan, packing, quality_classifier, quality_rules, secrets, textstats, toxicity
from tracewright.llm.boosting import fit_logistic

SF = "/root/testdata/sf0.001"


def feature_rows(texts):
    """The features by hand, from the statistics of each text."""
    out = []
    for t in texts:
        s = dict(zip(textstats.COLUMNS, textstats.statistics(t), strict=True))
        w, lines, chars = max(s["n_words"], 1), max(s["n_lines"], 1), max(s["word_chars"], 1)
        out.append([
            np.log(1 + s["n_words"]), s["word_chars"] / w, s["n_symbols"] / w, s["n_dup_lines"] / lines, s["n_repeat_words"] / w, s["n_distinct"] / w**0.75, s["n_upper"] / chars, s["n_digits"] / chars,
            s["n_punct"] / w, np.log(1 + s["n_words"] / lines), np.log(1 + s["longest_word"]),
        ])
    return np.array(out)


def trained(k):
    import zlib

    return zlib.crc32(str(k).encode()) % 5 != 0


def test_quality_posteriors_by_hand(spark):
    texts, good, labels = quality_data(spark)
    texts = [*texts, *ODD]
    got = {r["doc_id"]: r for r in quality_classifier.classify(docs(spark, texts), labels).collect()}
    x = feature_rows(texts)
    rows = [k for k in range(len(good)) if trained(k)]
    both = np.concatenate([x, x**2], axis=1)
    centre, scale, weights, bias = fit_logistic(both[rows], np.array([good[k] for k in rows], dtype=float))
    logit = np.clip((both - centre) / scale, -8, 8) @ weights + bias
    assert np.allclose([got[k]["doc_logit"] for k in range(len(texts))], logit, atol=1e-6)
    p, site = 1 / (1 + np.exp(-logit)), [f"s{k % 3}" for k in range(len(texts))]
    use = [k for k in range(len(texts)) if got[k]["n_words"] > 0]
    prior = (p[use].sum() + 1) / (len(use) + 2)

    def strength(groups, toward):
        """Pseudo-count by the method of moments; groups: members of each."""
        n = np.array([len(g) for g in groups])
        mean, spread = np.array([p[g].mean() for g in groups]), sum((p[g] * (1 - p[g])).sum() for g in groups)
        toward = np.broadcast_to(toward, n.shape)
        variance = max((n * toward * (1 - toward)).sum() / n.sum(), 1e-9)
        share = ((n * (mean - toward) ** 2).sum() - spread / n.sum() * len(n)) / n.sum() / variance
        share = min(max(share, 1e-3), 0.5)
        return (1 - share) / share

    groups = [[k for k in use if site[k] == s] for s in ("s0", "s1", "s2")]
    a = strength(groups, prior)
    host = np.array([(p[g].sum() + a * prior) / (len(g) + a) for g in groups])
    b = strength(groups, host)  # one language, so a path is its host's documents
    path = np.array([(p[g].sum() + b * h) / (len(g) + b) for g, h in zip(groups, host, strict=True)])
    odds = lambda q: np.log(np.clip(q, 1e-4, 1 - 1e-4) / (1 - np.clip(q, 1e-4, 1 - 1e-4)))
    for k in use:
        at = int(site[k][1])
        assert got[k]["host_posterior"] == pytest.approx(host[at], abs=1e-6) and got[k]["path_posterior"] == pytest.approx(path[at], abs=1e-6)
        score = 1 / (1 + np.exp(-(logit[k] + odds(path[at]) - odds(prior))))
        assert got[k]["score"] == pytest.approx(score, abs=1e-6) and got[k]["kept"] == (score >= 0.5)
    assert all(got[k]["score"] == 0 for k in range(len(texts)) if k not in use)


def test_tree_scores_by_hand(spark):
    texts, _, labels = quality_data(spark)
    texts = [*texts, *ODD]
    stats = textstats.document_statistics(docs(spark, texts))
    forest = quality_rules.train(stats, labels)
    x = feature_rows(texts)

    def walk(row, node):
        while forest.feature[node] >= 0:
            node = forest.left[node] if row[forest.feature[node]] <= forest.threshold[node] else forest.right[node]
        return forest.value[node]

    got = {r["doc_id"]: r for r in quality_rules.quality_rules(docs(spark, texts), labels).collect()}
    for k in range(len(texts)):
        logit = forest.base + sum(walk(x[k], root) for root in forest.roots)
        score, s = 1 / (1 + np.exp(-logit)), textstats.statistics(texts[k])
        failed = s[0] < 20 or 100 * s[4] > 30 * s[0]
        assert got[k]["quality_score"] == pytest.approx(score, abs=1e-9)
        assert got[k]["base_failed"] == failed and got[k]["kept"] == (not failed and score >= 0.5)


def test_label_samples_are_bounded_and_repeatable(spark):
    labels = spark.range(30_000).selectExpr("id as doc_id", "cast(id % 2 as int) as quality", "cast(id % 7 = 0 as int) as toxic")
    labels = labels.unionByName(labels.where("doc_id < 2000"))  # repeated rows
    values = labels.selectExpr("doc_id", "cast(doc_id as double) as x")
    some = textstats.label_sample(labels, "quality", 500).count()
    assert 500 <= some <= 500 + 14 * 500**0.5
    x, y = textstats.labelled_sample(values, labels, "quality", ["x"], 500)
    again, _ = textstats.labelled_sample(values.repartition(7), labels, "quality", ["x"], 500)
    assert len(x) == len(y) == 500 and sorted(x[:, 0]) == sorted(again[:, 0]) and all(trained(int(v)) for v in x[:, 0])


def test_toxic_fit_is_at_its_minimum():
    rng = np.random.default_rng(3)
    size, n = 12, 200
    rows = [sorted(rng.choice(size, rng.integers(1, 5), replace=False).tolist()) for _ in range(n)]
    y = np.array([float(0 in r or (1 in r and rng.random() < 0.5)) for r in rows])
    twins, times = [([1], [2]), ([3, 1], [4]), ([5], [])], [4, 1, 2]

    def objective(w, bias):
        z = np.array([w[r].sum() for r in rows]) + bias
        weight = np.where(y == 1, 0.5 / y.sum(), 0.5 / (n - y.sum()))
        loss = (weight * (np.logaddexp(0, z) - y * z)).sum()
        change = np.array([w[a].sum() - w[b].sum() for a, b in twins])
        return loss + 5.0 * (np.array(times) * change**2).sum() / sum(times)

    w, bias = toxicity.fit_weights(rows, y, twins, size, ridge=1e-9, counterfactual=5.0, rounds=4000, times=times)
    best = objective(w, bias)
    for _ in range(200):
        assert objective(w + 0.05 * rng.normal(size=size), bias + 0.05 * rng.normal()) >= best - 1e-6


def test_toxic_scores_by_hand(spark):
    texts, _, labels = toxic_data(spark, 200)
    model = toxicity.train(docs(spark, texts), labels)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs(spark, [*texts, *ODD]), model).collect()}
    for k, t in enumerate([*texts, *ODD]):
        heads = {f for w in re.findall(r"[^\W\d_]+", (t or "").lower()) for f in ("=" + w, *(w[:n] for n in (4, 5, 6) if len(w) >= n))}
        z = model.bias + sum(model.weights.get(f, 0.0) for f in heads)
        assert got[k] == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-12)


def plain_license(text, model):
    """Passed passages by lines and windows of words, in plain Python: families only."""
    words_of = lambda s: re.findall(license_scan.WORD, s)
    pairs_of = lambda w: [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]
    lines = [words_of(x) for x in (text or "").lower().split("\n")]
    flat, passages = [w for x in lines for w in x], [(x, False, None) for x in lines]
    pairs = pairs_of(flat)
    for t in (t for ts in license_scan.TEMPLATES.values() for t in ts):
        own = license_scan.template_pairs(t)
        n, long = license_scan.fewest(own, license_scan.CONFIRM), len(words_of(t.lower()))
        hits = [i for i, x in enumerate(pairs) if x in own]
        for i in hits:
            counts = []
            for k, size in enumerate((long, 2 * long + 4)):
                span = [j for j in hits if i <= j <= i + size - 2]
                counts.append(len({pairs[j] for j in span}))
                if counts[-1] >= n and (k == 0 or counts[1] > counts[0]):
                    passages.append((flat[i : span[-1] + 2], k == 0, (i, span[-1] + 1)))
    out = []
    for w, exact, place in passages:
        g = set(w) | set(pairs_of(w))
        z = np.round(model.bias, 6) + sum((np.round(model.weights[model.names.index(x)], 6) for x in g if x in model.names), np.zeros(len(model.classes)))
        p = np.exp((z - z.max()) / model.temperature)
        family = model.classes[int(z.argmax())]
        overlap = max((len(g & set(license_scan.template_pairs(t))) / len(license_scan.template_pairs(t)) for t in license_scan.TEMPLATES.get(family, ())), default=0.0)
        if family != license_scan.UNKNOWN and 1 / p.sum() >= model.threshold and overlap >= license_scan.CONFIRM:
            out.append((family, overlap, exact, place))
    strong = [x for x in out if x[2]]
    hidden = lambda s: s[3] and s[1] < 1 and any(y[0] != s[0] and y[1] > s[1] and 2 * (min(s[3][1], y[3][1]) - max(s[3][0], y[3][0]) + 1) > s[3][1] - s[3][0] + 1 for y in strong)
    return sorted({s[0] for s in out if not hidden(s)})


def test_license_scan_against_a_plain_scan(spark, licences):  # noqa: F811
    rng = random.Random(6)
    every = [t for ts in license_scan.TEMPLATES.values() for t in ts]
    texts = ["Available under CC BY 4.0.", "text is under CC BY-SA 4.0.", "This Source Code Form is subject to\nthe terms of the Mozilla Public\nLicense, v. 2.0.", *ODD]
    for _ in range(60):
        w = rng.choice(every).split()
        w = [x for x in w if rng.random() > 0.15] or w
        for _ in range(rng.randint(0, 5)):
            w.insert(rng.randrange(len(w) + 1), rng.choice(("alpha", "\n", "* ", "license", "the")))
        texts.append(" ".join(words(rng, rng.randint(0, 6))) + " " + " ".join(w) + "\n" + " ".join(rng.choice(every).split()[: rng.randint(1, 9)]))
    got = {r["doc_id"]: r["families"] for r in license_scan.license_scan(docs(spark, texts), licences).collect()}
    assert got == {k: plain_license(t, licences) for k, t in enumerate(texts)}
    assert [got[k] for k in range(3)] == [["CC-BY"], ["CC-BY-SA"], ["MPL-2.0"]]


def test_long_and_repeated_secrets_take_linear_time():
    scanner = secrets.Scanner()
    jwt = "eyJ" + "a" * 9 + ".eyJ" + "b" * 9 + "." + "c" * 9
    pem = "-----BEGIN PRIVATE KEY-----\nx\n-----END CERTIFICATE-----\n-----END PRIVATE KEY-----"
    for t in (jwt, pem, f"({jwt})", "eyJeyJ" + jwt, jwt[:-2], jwt.replace(".eyJ", ".eyK"), pem + pem, "-----BEGIN PRIVATE KEY-----\n" + pem, pem[:-5], f"{jwt}.{jwt}", "eyJ" + "a" * 8 + "." + jwt):
        want = [("jwt", *m.span()) for m in re.finditer(r"eyJ[\w-]{8,}\.eyJ[\w-]{8,}\.[\w-]{8,}", t, re.ASCII)]
        want += [("pem", *m.span()) for m in re.finditer(r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----.*?-----END (?:[A-Z]+ )?PRIVATE KEY-----", t, re.DOTALL)]
        assert [s for s in scanner.spans(t) if s[0] in ("jwt", "pem")] == want, t
    began = time.process_time()
    for t in ("-----BEGIN PRIVATE KEY-----\n" * 40_000, "eyJ" * 300_000, "eyJaaaaaaaaaa." * 100_000, "password" * 100_000, "token=" * 100_000):
        scanner.spans(t)
    assert time.process_time() - began < 20


def test_packing_ids_are_the_library_s():
    P, tokenizers = pytest.importorskip("public_tokenizers"), pytest.importorskip("tokenizers")
    plain = tokenizers.Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    encoder = packing.Encoder(P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"))
    rng = random.Random(15)
    parts = ["<|endoftext|>", "<|", "|>", "endoftext", " ", "  ", "\n", "it's", "Straße", "x", "12", "!?", "“q”", "日本", " ", "\u0085", "é", "'ll", "\t"]
    texts = [t or "" for t in ODD] + ["<|endoftext|>", "a <|endoftext|> b"] + ["".join(rng.choice(parts) for _ in range(rng.randint(1, 25))) for _ in range(400)]
    for t in texts:
        assert encoder.ids(t).tolist() == plain.encode(t, add_special_tokens=False).ids, t
    assert encoder.ids("<|endoftext|>").tolist() == [50256]


def test_bpe_of_long_words(spark):
    P, tiktoken = pytest.importorskip("public_tokenizers"), pytest.importorskip("tiktoken")
    ranks = byte_bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    library = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(4)
    letters = "".join(rng.choice("etaoinshrdlu") for _ in range(20_000))
    texts = [letters, "a" * 5_000, "日本語漢字" * 500, "".join(chr(rng.randrange(0x4E00, 0x9FFF)) for _ in range(1500)), *[letters[: byte_bpe.LONG + d] for d in (-1, 0, 1)], *[letters[: byte_bpe.PART + d] for d in (-2, -1, 0, 1)]]
    got = {r["doc_id"]: r["ids"] for r in byte_bpe.encode(docs(spark, texts), ranks, P.PATTERN).collect()}
    for k, t in enumerate(texts):
        assert np.frombuffer(bytes(got[k]), "<u4").tolist() == library.encode_ordinary(t), t[:40]


def test_embedding_links_with_production_parameters(spark):
    rng = np.random.default_rng(8)
    rows = []
    for k in range(500):
        base = rng.normal(size=64)
        for _ in range(rng.choice((1, 1, 2, 5, 9))):
            rows.append((len(rows), [float(v) for v in np.float32(base + 0.2 * rng.normal(size=64))], k % 2))
    rows += [(len(rows) + j, rows[7][1], rows[7][2]) for j in range(40)]  # a hot vector
    x = np.array([r[1] for r in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([r[2] for r in rows])
    want = ((x @ x.T >= 0.93) & (label[:, None] == label[None, :])).sum(axis=1) - 1
    got = {r["vec_id"]: r["n_links"] for r in embedding_dedup.embedding_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    found = np.array([got[r[0]] for r in rows])
    assert (found <= want).all() and found.sum() >= 0.98 * want.sum()


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables absent")
def test_pipeline_stages_against_brute_force(spark):
    import corpus_pipeline
    from tracewright.llm.common import materialize

    stages = dict(corpus_pipeline.STAGES)
    table = spark.read.parquet(f"{SF}/documents.parquet")
    seen = [{r["doc_id"]: r["text"] for r in table.collect()}]
    rows = table
    for name in list(stages)[:-1]:
        rows, _ = materialize(stages[name](spark, rows, SF), name)
        seen.append({r["doc_id"]: r["text"] for r in rows.collect()})
    start, good, lines, near, clean = seen
    kept = {r["doc_id"] for r in quality_classifier.classify(table, spark.read.parquet(f"{SF}/labels.parquet")).collect() if r["kept"]}
    assert good == {k: t for k, t in start.items() if k in kept}
    ids = sorted(good)
    assert lines == dict(zip(ids, (t for t, _ in brute_line_dedup([good[k] for k in ids])), strict=True))
    roots = smallest_reachable(brute_links([lines[k] for k in ids]))
    assert near == {k: lines[k] for n, k in enumerate(ids) if roots[n] == n}
    scanner = secrets.Scanner()
    assert clean == {k: secrets.redact_text(t, scanner.spans(t)) for k, t in near.items()}
    out = stages["best_fit_packing"](spark, rows, SF).collect()
    room = {}
    for r in out:
        room.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in room.values():
        ends = np.cumsum([n for _, n in sorted(parts)])
        assert ends[-1] <= 1024 and [o for o, _ in sorted(parts)] == [0, *ends[:-1]]
    assert {r["doc_id"] for r in out} == set(clean)


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables absent")
def test_pipeline_stages_of_odd_tables(spark):
    import corpus_pipeline
    from pyspark.sql import functions as F

    stages = dict(corpus_pipeline.STAGES)
    del stages["best_fit_packing"]
    texts = [*ODD, None, "one two three four five six seven\n" * 4]
    table = docs(spark, texts).withColumn("doc_id", F.when(F.col("doc_id") != 3, F.col("doc_id"))).withColumn("kept", F.lit("x")).withColumn("score", F.lit(None).cast("double"))
    table = table.unionByName(table.where("doc_id = 4"))
    for name, stage in stages.items():
        for rows in (table, table.limit(0)):
            out = stage(spark, rows, SF)
            assert out.columns == rows.columns, name
            got = out.collect()
            assert len(got) <= rows.count()


