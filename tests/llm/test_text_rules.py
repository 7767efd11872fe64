"""Decontamination and line rules against plain Python."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from corvane.llm import decontaminate, line_rules

LOWER = {i: i + 32 for i in range(65, 91)}


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def hits(text, items, n=10):
    words, covered, found = words_of(text), set(), set()
    for item, t in items:
        w = words_of(t)
        size = min(n, len(w))
        for i in range(len(w) - size + 1) if w else ():
            for p in range(len(words) - size + 1):
                if words[p : p + size] == w[i : i + size]:
                    covered |= set(range(p, p + size))
                    found.add(str(item))
    return len(words), len(covered), sorted(found)


def test_decontamination_matches_brute_force(spark):
    r = random.Random(3)
    vocabulary = ["Alpha", "beta", "gamma,", "É", "ñandú", "x1", "--", "delta\n", "de.lta"]
    items = [(i, " ".join(r.choice(vocabulary) for _ in range(r.randint(0, 25)))) for i in range(12)] + [(98, None), (99, "...")]
    docs = []
    for i in range(60):
        t = " ".join(r.choice(vocabulary) for _ in range(r.randint(0, 40)))
        docs.append((i, t + " " + r.choice(items[:12])[1] if i % 3 == 0 else t))
    docs += [(1, None), (1, ""), (None, items[0][1]), (None, items[0][1]), (7, "word " * 3000 + (items[1][1] or ""))]
    docs = [(i, t, 5) for i, t in docs]
    frame = spark.createDataFrame(docs, "doc_id long, text string, n_hit int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(((r["doc_id"], r["text"], r["n_words"], r["n_hit"], sorted(r["items"])) for r in decontaminate.decontaminate(frame, bench).collect()), key=str)
    want = sorted(((i, t, *hits(t, items)) for i, t, _ in docs), key=str)
    assert [(a, b, c, d, sorted(e)) for a, b, c, d, e in want] == got


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.decontaminate(docs, none).first()["n_hit"] == 0
    assert decontaminate.decontaminate(docs.limit(0), docs.select(F.col("doc_id").alias("item_id"), "text")).count() == 0


def test_spans_are_cut(spark):
    docs = spark.createDataFrame([(1, "Keep this. One two three four five six seven eight nine ten eleven! And this", "en"), (2, "clean text", "en"), (3, None, None)], "doc_id long, text string, lang string")
    bench = spark.createDataFrame([("b", "one two three four five six seven eight nine ten eleven")], "item_id string, text string")
    out = {r["doc_id"]: r["text"] for r in decontaminate.clean(docs, bench, drop_share=0.9).collect()}
    assert out == {1: "Keep this. And this", 2: "clean text", 3: None}
    assert [r["doc_id"] for r in decontaminate.clean(docs, bench, drop_share=0.5).orderBy("doc_id").collect()] == [2, 3]


def test_base_counts_match_brute_force(spark):
    r = random.Random(4)
    docs = []
    for i in range(80):
        lines = [" ".join(r.choice(["aa", "b#", "ç", "dd|", "e"]) for _ in range(r.randint(0, 14))) for _ in range(r.randint(0, 7))]
        docs.append((i, r.choice(["\n", "\n\n", "\t\n"]).join(lines + lines[:1])))
    docs += [(1, None), (2, ""), (3, " \n\t "), (4, "w " * 500), (5, "w x y " * 200 + "\x0b z")]

    def want(t):
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
        cover = {p for i, x in enumerate(windows) if windows.count(x) > 1 for p in range(i, i + 8)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(cover), len(w) < 20 or 100 * len(cover) > 30 * len(w))

    frame = spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id long, text string, n_words int")
    got = line_rules.base_counts(frame.drop("n_words")).select("doc_id", "text", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()
    assert sorted((tuple(x) for x in got), key=str) == sorted(((i, t, *want(t)) for i, t in docs), key=str)


def test_lines_go_and_documents_that_lose_too_much(spark):
    prose = "This is a plain sentence of quite ordinary words, and nothing is wrong with it."
    docs = spark.createDataFrame(
        [(1, f"{prose}\nAll rights reserved.\n{prose}"), (2, "a### b### c### d###\n" + "home | news | about | shop | contact | more"), (3, prose), (4, None), (5, ""), (6, "YES!! NO!! BUY!! NOW!!")],
        "doc_id long, text string",
    )
    out = {r["doc_id"]: r["text"] for r in line_rules.clean(docs).collect()}
    assert out == {1: f"{prose}\n{prose}", 3: prose, 4: None, 5: ""}
    assert hashlib.sha256(out[3].encode()).hexdigest()


def test_clashing_names_come_out_as_they_went_in(spark):
    prose = "This is a plain sentence of quite ordinary words, and nothing is wrong with it."
    names = ["items", "spans", "n_words", "n_hit", "found", "_words", "_spans", "row", "id", "number", "h", "lines_removed", "clean_text", "lost_share", "_facts", "_kept", "a.b"]
    rows = [(i, prose if i else None, *(f"{c}{i}" for c in names)) for i in range(4)]
    frame = spark.createDataFrame(rows, ["doc_id", "text", *names])
    bench = spark.createDataFrame([("b", "one two three four five six seven eight nine ten eleven")], "item_id string, text string")
    for out in (decontaminate.clean(frame, bench), line_rules.clean(frame)):
        assert out.columns == frame.columns
        assert sorted(tuple(r) for r in out.collect()) == rows


def test_line_rules_on_empty_tables_and_very_long_texts(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert line_rules.clean(empty).count() == 0 and line_rules.base_counts(empty).count() == 0
    long = "A sentence of some words that is repeated. " * 5000
    out = line_rules.base_counts(spark.createDataFrame([(1, long), (1, long), (2, "x" * 2_000_000)], "doc_id long, text string")).orderBy("doc_id").collect()
    assert [(r["n_words"], r["n_repeat_words"]) for r in out] == [(40_000, 40_000), (40_000, 40_000), (1, 0)]
    assert line_rules.clean(spark.createDataFrame([(1, long)], "doc_id long, text string")).first()["text"] == long


def test_lines_without_a_sentence_go(spark):
    docs = spark.createDataFrame([(1, "Ein ganzer Satz steht hier.\nStart Kontakt Karte Suche\nUnd noch ein Satz steht da!\nAlle Rechte vorbehalten."), (2, "Titel\nWas soll das sein?")], "doc_id long, text string")
    assert [r["text"] for r in line_rules.clean(docs).orderBy("doc_id").collect()] == ["Ein ganzer Satz steht hier.\nUnd noch ein Satz steht da!", "Titel\nWas soll das sein?"]


def test_decontamination_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", 0)
    test_decontamination_matches_brute_force(spark)
