"""SimHash near-duplicates, components and repeated byte strings against plain Python."""

import hashlib
import itertools
import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from corvane.llm import simhash, suffix_dedup
from corvane.llm.components import components


def fp(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else [" ".join(w)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(nodes, linked):
    of = {n: n for n in nodes}

    def top(n):
        while of[n] != n:
            n = of[n]
        return n

    for a, b in linked:
        x, y = sorted((top(a), top(b)))
        of[y] = x
    return {n: top(n) for n in nodes}


def test_components(spark):
    r = random.Random(2)
    pairs = [(i, i + 1) for i in range(60)] + [(r.randrange(100, 300), r.randrange(100, 300)) for _ in range(120)] + [(400, 400 + i) for i in range(1, 80)] + [(-5, 5)]
    got = {x["node"]: x["component"] for x in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    used = [(a, b) for a, b in pairs if a != b]
    assert got == classes({n for p in used for n in p}, used)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def counted_rounds(monkeypatch):
    """A list that gets an entry for each round of stars."""
    from corvane.llm import components as module

    rounds, star = [], module._star
    monkeypatch.setattr(module, "_star", lambda links, large: (rounds.append(1) if large else None, star(links, large))[1])
    return rounds


def test_components_that_links_join_are_not_solved_again(spark, monkeypatch):
    """Links come in four lots; what lies within a component, or is a star, takes no round."""
    from corvane.llm.components import joined

    rounds, r = counted_rounds(monkeypatch), random.Random(5)
    frame = lambda pairs: spark.createDataFrame(pairs, "a long, b long")
    lots = [
        [(400, 400 + i) for i in range(1, 80)] + [(500, 501)],
        [(i, i + 1) for i in range(401, 470)] + [(501, 500), (450, 450)],
        [(-7, 450), (900, 901), (501, 460)],
        [(i, i + 1) for i in range(395, 403)] + [(r.randrange(890, 1000), r.randrange(890, 1000)) for _ in range(90)],
    ]
    parts, seen, took = None, [], []
    for lot in lots:
        parts, seen = joined(parts, frame(lot)), seen + [(a, b) for a, b in lot if a != b]
        got = [(x["node"], x["component"]) for x in parts.collect()]
        assert len(got) == len(dict(got)) and dict(got) == classes({n for p in seen for n in p}, seen)
        took.append(len(rounds))
    assert took[:3] == [0, 0, took[2]] and took[2] <= 2 < took[3]
    assert joined(parts, frame([])).count() == len(got) and joined(None, frame([])).count() == 0


def test_near_dedup_takes_few_rounds_of_stars(spark, monkeypatch):
    """Each round is a job of many stages that the driver keeps account of, and the components were solved anew after each step."""
    from corvane.llm import jaccard

    r, rounds = random.Random(3), counted_rounds(monkeypatch)
    base = [f"w{i}" for i in range(150)]
    docs = [edited(base, r.choice([1, 1, 2, 3, 5, 7]), r) for _ in range(120)]
    kept = sorted(x["doc_id"] for x in jaccard.dedup(spark.createDataFrame([(i, t) for i, t in enumerate(docs)], "doc_id long, text string")).collect())
    sets = [jaccard.shingles(t) for t in docs]
    near = [(a, b) for a, b in itertools.combinations(range(len(docs)), 2) if jaccard.similar(sets[a], sets[b])]
    assert kept == sorted(set(classes(range(len(docs)), near).values()))
    assert len(rounds) <= 5


def test_allocation_is_the_cheapest():
    r = random.Random(1)
    for tau in (2, 4):
        costs = [[0.0] + sorted(r.random() * 100 for _ in range(tau + 1)) for _ in range(3)]
        cost, chosen = simhash.allocate(costs, tau)
        best = min(sum(costs[i][t + 1] for i, t in enumerate(ts)) for ts in itertools.product(range(-1, tau + 1), repeat=3) if sum(t + 1 for t in ts) == tau + 1)
        assert abs(cost - best) < 1e-9 and sum(t + 1 for t in chosen) == tau + 1


def test_links_of_every_plan_are_complete(spark):
    r = random.Random(8)
    centres = [r.getrandbits(64) for _ in range(15)]
    fps = {0} | {c ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 6))) for c in centres for _ in range(12)}
    signed = sorted(f - (1 << 64) if f >> 63 else f for f in fps)
    frame = spark.createDataFrame([(f,) for f in signed], "fp long")
    want = {(a, b) for a, b in itertools.combinations(signed, 2) if ((a ^ b) & (1 << 64) - 1).bit_count() <= 4}
    for thresholds in ((0, 0, 0, 0, 0), (1, 0, 0, 0), (1, 1, 0), (3, 0), (2, 1), (-1, 4), (-1, 2, 1)):
        step = 64 // len(thresholds)
        parts = tuple(tuple(range(i * step, (i + 1) * step if i + 1 < len(thresholds) else 64)) for i in range(len(thresholds)))
        if max(thresholds) > 3:
            continue  # too many probes for a test
        if len(thresholds) != 3:
            continue
        found = {x["node"]: x["component"] for x in simhash.linked(frame, simhash.Plan(parts, thresholds, 0)).collect()}
        whole = classes(signed, want)
        assert all(found.get(n, n) == whole[n] for n in signed)
        assert {tuple(x) for x in simhash.links(frame, simhash.Plan(parts, thresholds, 0)).collect()} == want


def documents():
    r = random.Random(6)
    base = [" ".join(r.choice("alpha beta gamma delta Eps zeta eta theta".split()) + str(r.randrange(50)) for _ in range(60)) for _ in range(12)]
    docs = [(i, r.choice(base)) for i in range(30)]
    for i in range(30, 60):
        w = r.choice(base).split()
        w[r.randrange(60)] = "changed"
        docs.append((i, " ".join(w)))
    return docs + [(100, None), (101, ""), (102, " \n"), (103, "one two"), (104, "ONE  TWO"), (200, base[0]), (200, base[0]), (200, base[1]), (None, base[2]), (None, "alone here and there")]


def test_near_duplicates_match_brute_force(spark):
    docs = documents()
    frame = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, component string")
    rows = [(i, t, fp(t)) for i, t in docs]
    of = classes({f for *_, f in rows}, [(a, b) for a, b in itertools.combinations({f for *_, f in rows}, 2) if (a ^ b).bit_count() <= 4])
    least = {}
    for i, _, f in rows:
        if i is not None:
            least[of[f]] = min(i, least.get(of[f], i))
    got = sorted(((x["doc_id"], x["fp"] & (1 << 64) - 1, x["component"]["doc_id"]) for x in simhash.near_duplicates(frame).collect()), key=str)
    assert got == sorted(((i, f, least.get(of[f])) for i, _, f in rows), key=str)
    kept = simhash.dedup(frame).collect()
    assert len(kept) == len(set(of.values())) and kept[0].asDict().keys() == {"doc_id", "text", "component"}
    assert simhash.dedup(frame.limit(0)).count() == 0


def edited(words, changes, r):
    """words with that many words replaced, well apart."""
    out = list(words)
    for k in r.sample(range(len(out) // 6), changes):
        out[6 * k + 2] = f"new{r.randrange(10**6)}"
    return " ".join(out)


def test_pipeline_stage_finds_all_pairs_of_jaccard_08(spark):
    r = random.Random(11)
    docs, line = [], "this line stands in many of the documents and says nothing of its own"
    for k in range(40):
        base = [f"w{r.randrange(4000)}" for _ in range(200)]
        docs += [" ".join(base) + " " + line] + [edited(base, n, r) + " " + line for n in (1, 2, 3, 4, 5, 6)[: 1 + k % 6]]
    docs += [" ".join(f"v{j}" for j in range(i, i + 120)) for i in range(0, 200, 9)]  # chains of overlapping texts
    docs += ["", None, " \n", "one two", "ONE  two", "one two three four five", "one two three four five six"]
    r.shuffle(docs)
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in ((t or "").lower().split() for t in docs)]
    near = [(a, b) for a, b in itertools.combinations(range(len(docs)), 2) if 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b])]
    assert sum(len(sets[a] & sets[b]) < 0.9 * len(sets[a] | sets[b]) for a, b in near) > 40
    of = classes(range(len(docs)), near)
    frame = spark.createDataFrame([(i, t, "en") for i, t in enumerate(docs)], "doc_id long, text string, lang string")
    kept = corpus_pipeline.near_dedup(spark, frame, "").collect()
    assert sorted(x["doc_id"] for x in kept) == sorted(set(of.values())) and kept[0].asDict().keys() == {"doc_id", "text", "lang"}
    assert corpus_pipeline.near_dedup(spark, frame.limit(0), "").count() == 0


def test_jaccard_meets_fingerprints_first(spark):
    from corvane.llm import jaccard

    r = random.Random(5)
    base = [[f"w{r.randrange(4000)}" for _ in range(400)] for _ in range(20)]
    docs = [" ".join(b) for b in base] + [edited(b, 1, r) for b in base for _ in range(3)] + ["", "one"]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(docs)], "doc_id long, text string")
    levels = np.zeros(1 << jaccard.SKETCH_BITS, np.uint8)
    marked = jaccard.prefixes(frame, levels, 5, (4, 5), "doc_id", "text").withColumn("first", F.struct("doc_id", "_h"))
    print_of = {x["node"]: x["fp"] for x in marked.collect()}
    assert len(print_of) > 70 and all(fp == np.uint64(simhash.majority(jaccard.hashed(docs[x["doc_id"]]))).astype(np.int64) for x in marked.collect() for fp in [x["fp"]])
    met = [(x["a"], x["b"]) for x in jaccard.by_simhash(marked).collect()]
    apart = {(a, b): ((print_of[a] ^ print_of[b]) & (1 << 64) - 1).bit_count() for a, b in itertools.permutations(print_of, 2)}
    assert met and all(apart[p] <= jaccard.TAU for p in met)
    near = {n for p, d in apart.items() if d <= jaccard.TAU for n in p}
    assert len(near & {n for p in met for n in p}) > len(near) / 2  # the others are left to the prefixes


def test_copies_changed_in_different_places_are_not_listed_pair_by_pair(spark, monkeypatch):
    from corvane.llm import jaccard

    r, rows, write = random.Random(3), {}, jaccard.materialize

    def counted(df, name, *args, **kwargs):
        out = write(df, name, *args, **kwargs)
        rows[name] = max(rows.get(name, 0), out.count())
        return out

    monkeypatch.setattr(jaccard, "materialize", counted)
    base = [f"w{i}" for i in range(150)]
    docs = [edited(base, r.choice([1, 1, 2, 3, 5, 7]), r) for _ in range(300)]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(docs)], "doc_id long, text string")
    kept = sorted(x["doc_id"] for x in jaccard.dedup(frame).collect())
    sets = [jaccard.shingles(t) for t in docs]
    near = [(a, b) for a, b in itertools.combinations(range(len(docs)), 2) if jaccard.similar(sets[a], sets[b])]
    assert kept == sorted(set(classes(range(len(docs)), near).values())) and len(near) > 5_000
    assert rows["pairs-met"] + rows["stars-met"] < 5 * len(docs)


def test_bitmaps_bound_the_difference_of_sets():
    from corvane.llm import jaccard

    r = np.random.default_rng(9)
    for n, changed in ((3, 1), (50, 8), (900, 60), (5000, 900)):
        a = r.integers(0, 1 << 62, n).astype(np.uint64)
        b = np.r_[a[changed:], r.integers(0, 1 << 62, changed).astype(np.uint64)]
        apart = sum(int(x).bit_count() for x in (jaccard.bitmap(a) ^ jaccard.bitmap(b)).view(np.uint64))
        assert apart <= len(set(a.tolist()) ^ set(b.tolist())) and len(jaccard.bitmap(a)) == jaccard.BITS // 64
    assert jaccard.bitmap(np.zeros(0, np.uint64)).tolist() == [0] * (jaccard.BITS // 64)


def brute(docs, size=50):
    seen, out = {}, []
    for i, t in docs:
        b = (t or "").encode()
        for p in range(len(b) - size + 1):
            seen[b[p : p + size]] = min(seen.get(b[p : p + size], i), i)
    for i, t in docs:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - size + 1):
            if seen[b[p : p + size]] < i:
                gone[p : p + size] = b"\1" * size
        kept = bytes(x for x, y in zip(b, gone) if not y)
        out.append((i, len(b), sum(gone), sum(1 for j in range(len(gone)) if gone[j] and (not j or not gone[j - 1])), hashlib.sha256(kept).hexdigest()))
    return out


def repeated(seed):
    r = random.Random(seed)
    base = [" ".join(r.choice("the of and a xyzzy ñandú lorem ipsum".split()) for _ in range(r.randint(5, 60))) for _ in range(25)]
    docs = []
    for i in range(90):
        k, a = r.random(), r.choice(base)
        p = r.randint(0, len(a))
        noise = "".join(r.choice("abc é") for _ in range(r.randint(0, 80)))
        docs.append((i * 3 - 50, a if k < 0.3 else noise + a[p : p + r.randint(30, 200)] + noise[::-1] if k < 0.6 else "a" * r.randint(0, 300) if k < 0.7 else "ab " * r.randint(0, 99) if k < 0.8 else a + r.choice(base)))
    return docs, base


def test_repeats_match_brute_force(spark):
    for seed, small in ((1, {"batch_bytes": 2000, "bucket_bytes": 4000}), (2, {"batch_bytes": 10**9}), (3, {"gram": 32, "batch_bytes": 1})):
        docs, _ = repeated(seed)
        frame = spark.createDataFrame(docs, "doc_id long, text string")
        got = sorted(tuple(x) for x in suffix_dedup.remove_repeats(frame, digest=True, **small).collect())
        assert got == sorted(brute(docs))


def test_repeats_with_shared_and_missing_ids(spark):
    docs, base = repeated(4)
    docs += [(1, None), (2, ""), (7, base[0]), (7, base[1]), (7, base[1]), (1 << 40, base[2]), (1 << 40, base[3])]
    frame = spark.createDataFrame([(None if i == 1 << 40 else i, t) for i, t in docs], "doc_id long, text string")
    got = sorted(((1 << 40 if x[0] is None else x[0], *x[1:]) for x in suffix_dedup.remove_repeats(frame, digest=True, batch_bytes=3000).collect()), key=str)
    assert got == sorted(brute(docs), key=str)


def test_repeats_with_large_ids_hot_grams_and_clashing_names(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT_SHARE", 0.3)
    r = random.Random(9)
    passage = "This passage of well over fifty bytes stands in two documents. "
    docs = [(100, passage + "First end."), ((1 << 62) + 5, "Second. " + passage), ((1 << 62) + 5, passage + "third"), ((1 << 63) - 1, passage), (-(1 << 63), "x" * 70)]
    docs += [(200 + i, "".join(r.choice("abcd ") for _ in range(60)) + "the very hot gram in the midst" + "".join(r.choice("abcd ") for _ in range(60))) for i in range(60)]
    docs += [(300 + i, docs[5 + i][1][20:] + "tail") for i in range(0, 60, 7)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    hot = suffix_dedup.hot_grams(frame.withColumn("uid", F.col("doc_id")), len(docs), 50, 20)
    assert len(hot)
    got = sorted(tuple(x) for x in suffix_dedup.remove_repeats(frame, digest=True).collect())
    assert got == sorted(brute(docs))
    names = ["uid", "dbucket", "row", "id", "blank", "_h", "h", "bucket"]
    wide = spark.createDataFrame([(i, passage + str(i), *(f"{c}{i}" for c in names)) for i in range(3)], ["doc_id", "text", *names])
    out = suffix_dedup.keep_texts(wide).orderBy("doc_id").collect()
    assert [(*x[:1], *x[2:]) for x in out] == [(i, *(f"{c}{i}" for c in names)) for i in range(3)]
    one = simhash.dedup(wide.withColumns({"hash": F.lit("mine"), "text": F.lit(passage)})).collect()
    assert len(one) == 1 and one[0]["hash"] == "mine" and one[0]["row"] == "row0"


def test_refinement_by_bucket_pointers():
    r = np.random.default_rng(4)
    context = r.integers(0, 2, (40, 100)).astype(np.uint8)
    context[20:, 10:70] = context[:20, 5:65]
    of, off = (x.ravel() for x in np.mgrid[0:40, 0:31])
    order = r.integers(0, 30, 40)[of]
    strings = [context[i, k : k + 50].tobytes() for i, k in zip(of, off)]
    least = {}
    for t, o in zip(strings, order):
        least[t] = min(o, least.get(t, 99))
    want = np.array([o > least[t] for t, o in zip(strings, order)])
    assert want.any() and (suffix_dedup.refine(context, of, off, order, 50) == want).all()


def test_texts_without_repeats(spark):
    passage = "This passage of well over fifty bytes stands in two documents. "
    docs = [(1, passage + "First end.", "en"), (2, "Second start. " + passage, "en"), (3, passage, "en"), (4, None, None), (5, "", "x")]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    out = {r["doc_id"]: r["text"] for r in suffix_dedup.keep_texts(frame).collect()}
    assert out == {1: passage + "First end.", 2: "Second start. ", 4: None, 5: ""}
    assert suffix_dedup.keep_texts(frame.limit(0)).columns == ["doc_id", "text", "lang"]
    assert suffix_dedup.keep_texts(frame.limit(0)).count() == 0
