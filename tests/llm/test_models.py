"""The classifier, the language model and the pipeline."""

import math
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.llm import brown, quality

SF = "/root/testdata/sf0.001"


def corpus():
    r = random.Random(12)
    good = "the of and to in house river walks with under morning light small green".split()
    docs, labels = [], []
    for i in range(400):
        n = r.randint(30, 120)
        if i % 5:
            t = " ".join(r.choice(good) + r.choice(["", "", ",", "."]) for _ in range(n)).capitalize() + "."
        else:
            t = " ".join(r.choice(good).upper() + r.choice(["!!", "###", " |", "$$$"]) for _ in range(n))
        docs.append((i, t, "x", 1.0))
        if i % 2 == 0:
            labels.append((i, int(i % 5 != 0)))
    return docs, labels


def test_classifier_on_held_out_rows(spark):
    docs, labels = corpus()
    extra = [(None, None, None, None), (5000, "", "x", 0.0), (7, docs[7][1], "x", 0.0)]
    frame = spark.createDataFrame(docs + extra, "doc_id long, text string, lang string, score double")
    marks = spark.createDataFrame(labels, "doc_id long, quality int")
    out = quality.score(frame, quality.train(frame, marks)).collect()
    assert len(out) == len(docs) + 3 and all(0 <= r["score"] <= 1 for r in out)
    held = {i: q for i, q in labels if zlib.crc32(str(i).encode()) % 4 == 2}
    got = {r["doc_id"]: r["predicted"] for r in out}
    assert sum(got[i] == q for i, q in held.items()) / len(held) > 0.97
    kept = quality.keep_good(frame.withColumn("predicted", F.lit("p")).withColumn("row", F.lit(3)), marks)
    assert kept.columns == [*frame.columns, "predicted", "row"]
    given = {(r["doc_id"], r["text"], r["lang"], r["score"]) for r in frame.collect()}
    assert {(r["doc_id"], r["text"], r["lang"], r["score"]) for r in kept.collect()} <= given and kept.where("predicted <> 'p' or row <> 3").count() == 0
    letters = random.Random(3)
    odd = spark.createDataFrame([(1, " ".join("".join(letters.choice("qxzjkvwyph") for _ in range(6)) for _ in range(200)) + "."), (2, docs[1][1]), (3, docs[1][1] * 300)], "doc_id long, text string")
    low, high, long = (r["score"] for r in quality.score(odd, quality.train(frame, marks)).orderBy("doc_id").collect())
    assert low < 0.3 < 0.7 < high and 0 <= long <= 1
    assert quality.keep_good(frame.limit(0), marks).count() == 0
    assert quality.keep_good(frame, marks.limit(0)).count() == len(docs) + 3  # nothing to learn from: all stay


def test_prior_and_risk():
    r = np.random.default_rng(0)
    pos = r.normal(1, 1, (3000, quality.FEATURES))
    unl = np.concatenate([r.normal(1, 1, (2100, quality.FEATURES)), r.normal(-1, 1, (900, quality.FEATURES))])
    model = quality.fit(pos, unl)
    assert abs(model.prior - 0.7) < 0.08
    assert (model.score(r.normal(1, 1, (500, quality.FEATURES))) > 0.5).mean() > 0.95
    assert (model.score(r.normal(-1, 1, (500, quality.FEATURES))) < 0.5).mean() > 0.95


def test_scores_against_plain_counts(spark):
    docs, _ = corpus()
    docs = [(i, t) for i, t, *_ in docs] + [(None, "Alone Words here"), (7, None), (8, ""), (3, "the the"), (3, "the the"), (9, "Ünseen \x0b\x0c thing"), (11, "long " * 20_000)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    blocks, model = brown.blocks_and_model(frame, n_classes=6, core_words=5, block_bytes=2000)
    got = sorted((tuple(x)[:7] for x in brown.scores(blocks, model).collect()), key=str)
    split = [(i, [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)})), "\n"]) for i, t in docs]
    held = [zlib.crc32((str(i) if i is not None else "").encode()) % 10 == 0 for i, _ in split]
    c = Counter(w for (_, ws), h in zip(split, held) if not h for w in ws)
    n, v = sum(c.values()), len(c)
    known = {bytes(r["word"]).decode(): (r["c"], r["class"]) for r in brown.word_classes(blocks, model).collect()}
    assert {w: k for w, (k, _) in known.items()} == {w: k for w, k in c.items() if w != "\n"}
    # The score by its definition: transition of the classes times emission of the word, counted again from the classes.
    end, unseen = 6, 7
    cls = {w: k for w, (_, k) in known.items()} | {"\n": end}
    pairs, lone_left, lone_right, total = Counter(), Counter(), Counter(), Counter()
    for (_, ws), h in zip(split, held):
        if not h:
            total.update(cls[w] for w in ws)
            for a, b in zip(["\n", *ws], ws):
                pairs[cls[a], cls[b]] += 1
                lone_left[cls[a]] += c[b] == 1
                lone_right[cls[b]] += c[a] == 1 and a != "\n"
    new = (sum(lone_left.values()) + 0.5) / (n + 1)

    def step(a, b):
        row = sum(lone_right.values()) if a == unseen else total[a]
        lone = new * row if a == unseen else lone_left[a]
        share = (lone + 50 * new) / (row + 50)
        seen = lone_right[b] if a == unseen else pairs[a, b]
        return share if b == unseen else (seen + 50 * total[b] / n) / (row + 50) * (1 - share)

    def plain(ws):
        at = [cls.get(w, unseen) for w in ws]
        return sum(math.log10(step(a, b)) + (math.log10(c[w] / total[b]) if b != unseen else 0) for a, b, w in zip([end, *at], at, ws))

    want = [(i, h, len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), plain(ws)) for (i, ws), h in zip(split, held)]
    for a, b in zip(got, sorted(want, key=str), strict=True):
        assert a[:5] == b[:5] and abs(a[5] - b[5]) < 1e-6 * abs(b[5]) and abs(a[6] - b[6]) < 1e-6 * abs(b[6])
    assert sum(x[6] for x in got if x[1]) > sum(x[5] for x in got if x[1])
    assert model.likelihoods == sorted(model.likelihoods) or model.likelihoods[:-1] == sorted(model.likelihoods[:-1])
    assert abs(brown.likelihood(model.counts[:8, :8].astype(float)) - max(model.likelihoods)) < 1e-6
    assert model.likelihoods == sorted(model.likelihoods)  # no round that is kept lowers it
    assert len(model.likelihoods) < 2 or model.likelihoods[-1] - model.likelihoods[-2] <= 3e-4 * abs(model.likelihoods[-1])
    assert brown.score(frame.limit(0)).count() == 0
    assert all(r["n_known"] == 0 for r in brown.score(spark.createDataFrame([(2, "a b"), (2, "c")], "doc_id long, text string"), folds=1).collect())  # nothing to learn from


def test_transitions_are_probabilities():
    r = np.random.default_rng(3)
    counts = r.integers(0, 30, (6, 6)).astype(float)
    counts[:, 4] = counts[4] = 0  # the unseen class never stands in training texts
    p = 10 ** brown.log_transitions(counts, np.array([30.0, 20, 10, 40, 0]), 4)
    assert np.allclose(p.sum(1), 1)
    assert np.allclose((10 ** brown.log_transitions(np.zeros((6, 6)), np.zeros(5), 4)).sum(1), 1)


def test_exchange_finds_the_classes():
    # Words 0-3 stand before words 4-7 and the other way round: two classes.
    n = np.random.default_rng(1).integers(0, 4, (8, 8)).astype(float)
    n[:4, 4:] += 50
    n[4:, :4] += 50

    def gain(classes):
        one = np.eye(2)[classes]
        table = one.T @ n @ one
        f = lambda x: (x * np.log(np.maximum(x, 1e-9))).sum()
        return f(table) - f(table.sum(0)) - f(table.sum(1))

    classes = np.array([0, 0, 0, 1, 1, 1, 1, 0])
    before, none = gain(classes), np.zeros((8, 4))
    for _ in range(6):
        one = np.eye(4)[classes]
        classes, table, _ = brown.exchange(classes, n.astype(int), none, none, one.T @ n.astype(int) @ one, 2)
        one = np.eye(4)[classes]
        assert np.allclose(table, one.T @ n.astype(int) @ one)
    assert gain(classes) > before and len(set(classes[:4])) == len(set(classes[4:])) == 1 and classes[0] != classes[4]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_pipeline(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == columns, name
        assert 0 < docs.count() <= before
        before = docs.count()
    out = corpus_pipeline.run(spark, SF).toPandas()
    assert set(out["doc_id"]) == {r["doc_id"] for r in docs.select("doc_id").collect()}
    assert out.groupby("sequence_id")["length"].sum().max() <= 2048


def test_risk_gradient_by_differences():
    r = np.random.default_rng(4)
    w = [r.normal(size=(quality.FEATURES, 5)), r.normal(size=5), r.normal(size=5), r.normal(size=1)]
    xp, xu = r.normal(1, 1, (40, quality.FEATURES)), r.normal(0, 1, (60, quality.FEATURES))

    def plain(weights, x, sign):
        out = np.maximum(x @ weights[0] + weights[1], 0) @ weights[2] + weights[3][0]
        return (1 / (1 + np.exp(sign * out))).mean()

    def risk(weights, prior):
        return prior * plain(weights, xp, 1), plain(weights, xu, -1) - prior * plain(weights, xp, -1)

    for prior in (0.1, 0.97):
        good, bad = risk(w, prior)
        value, grad = quality.risk_gradient(w, xp, xu, prior)
        assert abs(value - (good + max(0.0, bad))) < 1e-12
        # Where the second part is below zero the step goes up its slope, else down that of the whole.
        target = (lambda v: sum(risk(v, prior))) if bad >= 0 else (lambda v: -risk(v, prior)[1])
        for i, part in enumerate(w):
            for at in list(np.ndindex(part.shape))[:12]:
                up, down = [x.copy() for x in w], [x.copy() for x in w]
                up[i][at] += 1e-6
                down[i][at] -= 1e-6
                assert abs((target(up) - target(down)) / 2e-6 - grad[i][at]) < 1e-5


def test_prior_over_bins():
    r = np.random.default_rng(5)
    pos, unl = r.beta(8, 2, 3000), np.concatenate([r.beta(8, 2, 3000), r.beta(2, 8, 7000)])
    bins = np.bincount(quality.bin_of(unl), minlength=quality.BINS)
    assert abs(quality.estimate_prior(pos, bins, bins=True) - quality.estimate_prior(pos, unl)) < 0.01
    want = min((np.mean(unl >= c) / np.mean(pos >= c) + np.sqrt(1 / 3000 + 1 / 10_000) / np.mean(pos >= c)) for c in np.quantile(pos, np.linspace(0, 0.5, 101), method="lower"))
    assert abs(quality.estimate_prior(pos, unl) - want) < 1e-12 and 0.3 <= want < 0.36


def test_cells_hold_all_documents(spark):
    r = np.random.default_rng(6)
    x = r.normal(size=(500, quality.FEATURES)).astype(np.float32)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<float>")
    mean, scale = x.mean(0), x.std(0)
    means, n = quality.cells(rows.repartition(7), mean, scale)
    again, m = quality.cells(rows.repartition(2), mean, scale)
    assert n.sum() == 500 and np.array_equal(n, m) and np.array_equal(means, again)
    cell = quality.cells_of((x - mean) / scale)
    want = [x[cell == c].mean(0) for c in np.unique(cell)]
    assert np.allclose(means, want, atol=1e-4)
