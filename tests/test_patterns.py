"""Patterns, trigrams and places in an order against plain scans and sorts."""

import random
import re

import pytest
from pyspark.sql import functions as F

from corvane.functions import text
from corvane.operators import patterns, places, search


@pytest.mark.parametrize("pattern, want", [
    ("/src1/.*en", ["/src1/"]), ("(^|/)DE/", ["de/"]), (r"9\.txt$", ["9.txt"]), ("abc|de", None), ("(abc|def)", ["abc", "def"]), ("(abc|def)x?", None), ("abcd*", ["abc"]), ("abcd+ef", ["abcd"]),
    ("ab{2}cdef", ["cdef"]), ("[abc]def(ghij)?", ["def"]), (r"a\d+bcd", ["bcd"]), (r"\x41bcdef", None), ("(?x) a b c d", None), ("", None), ("((ABCD))", ["abcd"]), ("(abc)(defg)", None), ("abc)", None), ("[]abc]defg", ["defg"]),
])
def test_required_literals(pattern, want):
    assert patterns.required(pattern) == want


def test_whole_names():
    assert patterns.whole_name(r"(^a[\s\-_\.]+b\.c$)|(^x\+$)") == ["a b.c", "x+"]
    for other in ("^a$", "(^a)", "(^a.b$)", "(^a$)|b", r"(^\d$)", ""):
        assert patterns.whole_name(other) is None


def test_patterns_against_a_scan(spark):
    r = random.Random(6)
    words = ["red", "Blue", "car", "v1.5", "C++", "a", "Émile", "long-word", "x_y", "(odd)"]
    labels = sorted({" ".join(r.choice(words) for _ in range(r.choice([1, 2, 3]))) for _ in range(60)})
    tags = spark.createDataFrame([(f"t{i}", x) for i, x in enumerate(labels)], "tag_id string, label string")
    own = tags.select("tag_id", text.tag_pattern(F.col("label"), F.array(F.concat("label", F.lit(" too")))).alias("pattern"))
    free = [("f1", "red.*car"), ("f2", "(blue|émile)"), ("f3", "^.$"), ("f4", "a"), ("f5", r"v1\.5[ _]c"), ("f6", "long-?word"), ("f7", None), ("f8", "É")]
    names = [re.sub("[ -]", lambda m: r.choice([" ", "_", "-", ".", " - "]), x + r.choice(["", " too", " more"])) for x in labels for _ in range(3)]
    names = [x.upper() if r.random() < 0.3 else x for x in names] + ["first line\nred", "", None, "a", "x" * 5000 + "red big car"]
    frame = spark.createDataFrame([(n,) for n in names * 2], "name string")
    asked = own.unionByName(spark.createDataFrame(free, "tag_id string, pattern string"))
    want = frame.distinct().join(asked, F.expr("name rlike concat('(?im)', pattern)")).select("name", "tag_id").distinct().collect()
    got = patterns.tags_by_pattern(frame, asked).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) > 200
    plan = patterns.tags_by_pattern(frame.where("name not like '%line%'"), own)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan
    assert patterns.tags_by_pattern(frame, asked.limit(0)).count() == 0


def test_trigrams_against_a_scan(spark):
    r = random.Random(3)
    rows = [(i, "/".join(r.choice(["Lib", "photo", "über", "a", "IMG_20", "Straße"]) + str(r.randrange(30)) for _ in range(4))) for i in range(500)] + [(1000, None), (1001, ""), (1002, "ab")]
    frame = spark.createDataFrame(rows, "id long, path string")
    index = patterns.trigram_index(frame, "id", "path", block=50)
    assert index.postings.agg(F.max(F.size("ids"))).first()[0] < 150
    for p in ("photo1.*img", "LIB2", "(über1|straße2)/", "a.", "lib1/photo2$", "nothing here", "^ab$", "Über"):
        assert sorted(x["id"] for x in patterns.search(index, p).collect()) == sorted(x["id"] for x in frame.where(F.col("path").rlike(f"(?i){p}")).collect())


@pytest.mark.parametrize("n", [0, 1, 700])
def test_places(spark, n):
    r = random.Random(n)
    rows = [(i, r.choice([None, 1, 2, r.randrange(50)])) for i in range(n)]
    frame = spark.createDataFrame(rows, "id long, k int")
    index = places.order_index(frame, "k", "id", ranges=9)
    assert index.size == n
    for descending in (False, True):
        order = [x["id"] for x in search.ordered(frame, "k", descending, "id").collect()]
        for number, size in ((1, 10), (13, 20), (70, 10), (71, 10), (1, 2000)):
            got = index.page(number, size, descending).orderBy("place").collect()
            assert [x["id"] for x in got] == order[(number - 1) * size : number * size]
            assert [x["place"] for x in got] == list(range((number - 1) * size, (number - 1) * size + len(got)))
        assert [x["id"] for x in index.neighbours(5, 100, descending, 30).orderBy("place").collect()] == order[370:431]
        asked = spark.createDataFrame([(i,) for i in (0, 3, 3, 650, 9999)], "id long")
        assert {x["id"]: x["rank"] for x in index.ranks(asked, descending).collect()} == {i: order.index(i) for i in (0, 3, 650) if i < n}
