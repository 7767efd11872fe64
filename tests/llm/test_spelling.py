"""Spelling variants against plain Python."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.llm import spelling
from corvane.llm.wavelet import WaveletMatrix

PATTERN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def near_words(vocabulary):
    """Words by what is left of them without one code point, and with a blank in its place."""
    gaps, out = {}, {w: set() for w in vocabulary}
    for w in vocabulary:
        for i in range(len(w)):
            gaps.setdefault(w[:i] + "\0" + w[i + 1 :], set()).add(w)
    for group in gaps.values():
        for w in group:
            out[w] |= group - {w}
    for w in vocabulary:
        for v in {w[:i] + w[i + 1 :] for i in range(len(w))} & set(vocabulary):
            out[w].add(v)
            out[v].add(w)
    return out


def expected(counts, factor=5):
    near = near_words(list(counts))
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= factor * counts[w] else None
    out = {}
    for w, f in form.items():
        root = w
        while form[root]:
            root = form[root]
        out[w] = (counts[w], len(near[w]), f, counts[f] if f else None, root)
    return out


def as_map(frame):
    return {r["word"]: (r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in frame.collect()}


def test_rectangles():
    r = np.random.default_rng(1)
    for n in (1, 2, 7, 64, 500):
        values = r.permutation(n)
        first, last, low, high = (r.integers(0, n + 1, 200) for _ in range(4))
        which, value = WaveletMatrix(values).report(first, last, low, high)
        want = sorted((q, v) for q in range(200) for v in values[first[q] : last[q]] if low[q] <= v < high[q])
        assert sorted(zip(which.tolist(), value.tolist())) == [(q, int(v)) for q, v in want]
    assert len(WaveletMatrix(np.zeros(0, int)).report(*[np.zeros(0, int)] * 4)[0]) == 0


@pytest.mark.parametrize("most, letters", [(100_000, "ab"), (40, "ab"), (100_000, "aé一\U0001f600z")])
def test_near_words(spark, most, letters):
    r = random.Random(len(letters) + most)
    made = {"".join(r.choice(letters) for _ in range(r.choice([1, 2, 3, 6, 6, 7, 7, 8]))) for _ in range(400)}
    counts = {w: r.choice([5, 6, 30, 200, 1500, 9000]) for w in made}
    frame = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert as_map(spelling.variants(frame, most=most)) == expected(counts)


def test_words_of_texts(spark):
    r = random.Random(5)
    parts = ["Garten", "garden", "GARDENS", "été-là", "Überall", "naïveté", "straße", "xĀtunnel", "×times÷", "abcdefghij" * 30, "short"]
    docs = [(i, " ".join(r.choice(parts) + r.choice(["", "s", ",", "\n", "1"]) for _ in range(40))) for i in range(-40, 160)]
    docs += [(7, docs[47][1]), (None, "garden garden"), (999, None), (998, ""), (997, " ".join(parts * 3000))]
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"word": F.lit("x"), "n": F.lit(1)}).repartition(3)
    counts = Counter()
    for i, text in docs:
        for run in PATTERN.findall(text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 6:
                counts[run] += 1
    counts = {w: n for w, n in counts.items() if n >= 5}
    words = spelling.words(frame)
    assert {r["word"]: r["n"] for r in words.collect()} == counts
    got = as_map(spelling.variants(words))
    assert got == expected(counts) and any(v[2] for v in got.values())


def test_no_words(spark):
    assert spelling.variants(spelling.words(spark.createDataFrame([(1, None)], "doc_id long, text string"))).count() == 0
