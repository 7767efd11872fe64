"""Steps whose cost must not grow faster than their tables: what moves, what one task holds, and that results stay whole."""

import random

import pyarrow as pa
import pytest

from corvane import session
from corvane.operators import collections, graph, imports, patterns, rollups, upkeep
from corvane.plans import catalog, formulas  # noqa: F401 - registers the queries
from corvane.sources import adapters

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def pairs(df) -> list:
    return sorted(map(tuple, df.collect()), key=str)


TAGS = [("a", "a", 0), ("b", "b", 0), ("c", "c", 0), ("d", "d", 0), ("a", "b", 1), ("b", "c", 1), ("a", "c", 2), ("d", "c", 1), ("bare", "c", 1)]


@pytest.mark.parametrize("few", [100_000, 4, 0])
def test_tags_move_and_not_their_ancestors(spark, monkeypatch, few):
    """All three ways of lined(): few tags, few lists in common, many of both."""
    monkeypatch.setattr(graph, "BROADCAST_ROWS", few)
    closed = spark.createDataFrame(TAGS, "tag string, ancestor string, depth int")
    members = spark.createDataFrame([(1, "a"), (1, "d"), (2, "bare"), (3, "none"), (None, "b")], "file_id long, tag_id string")
    assert pairs(graph.propagate(members, closed, "file_id")) == sorted([(1, "a"), (1, "b"), (1, "c"), (1, "d"), (2, "c"), (None, "b"), (None, "c")], key=str)
    if few == 4:
        text = plan(graph.propagate(members, closed, "file_id"))
        assert text.index("Generate explode(_line") < text.index("RepartitionByExpression")  # lists are opened above the shuffle


@pytest.mark.parametrize("few", [100_000, 0])
def test_drop_ancestors_keeps_repeats_and_nulls(spark, monkeypatch, few):
    monkeypatch.setattr(graph, "BROADCAST_ROWS", few)
    closed = spark.createDataFrame(TAGS + [("x", "y", 1), ("y", "x", 1)], "tag string, ancestor string, depth int")
    rows = [(1, "a"), (1, "c"), (1, "d"), (2, "c"), (2, "c"), (3, None), (None, "a"), (None, "b"), (4, "x"), (4, "y"), (5, "none")]
    out = graph.drop_ancestors(spark.createDataFrame(rows, "file_id long, tag_id string"), closed, "file_id")
    assert pairs(out) == sorted([(1, "a"), (1, "d"), (2, "c"), (2, "c"), (3, None), (None, "a"), (None, "b"), (5, "none")], key=str)
    assert "Join LeftAnti" not in plan(out)


def test_collection_tags_move_to_their_collection_once(spark):
    members = spark.createDataFrame([(1, 10, 0), (1, 11, 1), (2, 12, 0)], "collection_id long, file_id long, idx int")
    tags = spark.createDataFrame([(10, "d"), (11, "a"), (11, "d"), (12, "none")], "file_id long, tag_id string")
    out = rollups.collection_tags(members, tags, spark.createDataFrame(TAGS, "tag string, ancestor string, depth int"))
    assert pairs(out) == [(1, ["d", "a"], ["a", "b", "c", "d"]), (2, ["none"], None)]
    assert plan(out).count("RepartitionByExpression") == 1


def test_rollup_of_pairs_without_their_file(spark):
    files = spark.createDataFrame([(1, 5, "2000"), (2, 7, "1999")], "file_id long, size long, date_created string")
    wide = spark.createDataFrame([(1, "a"), (2, "a"), (9, "a"), (9, "b")], "file_id long, tag_id string")
    out = rollups.tag_rollup(spark.createDataFrame([("a",), ("b",), ("c",)], "tag_id string"), wide, files, once=True)
    assert pairs(out) == [("a", 2, 12, 2), ("b", 0, 0, None), ("c", 0, 0, None)]
    assert plan(out).count("Join LeftOuter") == 2 and "Join Inner" not in plan(out)


def test_subsets_against_plain_sets(spark):
    rng = random.Random(5)
    sets = {i: set(rng.choices(range(12), k=rng.randint(1, 7))) for i in range(150)} | {900: set(range(200)), 901: set(range(199)), 902: {500}, 903: {500}}
    rows = [(i, f, at) for i, s in sets.items() for at, f in enumerate(s)] + [(902, None, 9)]
    out = collections.proper_subsets(spark.createDataFrame(rows, "collection_id long, file_id long, idx int"))
    assert pairs(out) == sorted(((i,) for i, s in sets.items() if any(s < t for t in sets.values())), key=str)
    assert "~_bits" in plan(out) or "~bits" in plan(out)  # pairs whose bits differ are not compared file by file


def test_postings_of_long_texts_in_parts(monkeypatch):
    monkeypatch.setattr(patterns, "CHARS", 20)
    texts = {5: "ABCabc", 1: "xabcx" * 9, 3: "é\U0001f600zabc", 2: "abc"}
    got = patterns._postings(pa.table({"block": pa.array([7] * 4, pa.int64()), "id": pa.array(list(texts), pa.int64()), "text": list(texts.values())}))
    want: dict = {}
    for i, text in sorted(texts.items()):
        low = "".join(c.lower() if c.isascii() else c for c in text)
        for g in sorted({low[k : k + 3] for k in range(len(low) - 2)}):
            want.setdefault(g, []).append(i)
    assert dict(zip(got["gram"].to_pylist(), got["ids"].to_pylist())) == want and set(got["block"].to_pylist()) == {7}


def test_parameters_are_parsed_in_many_tasks(spark):
    """The table may be one file of one row group, which is one task."""
    assert catalog.queries()["settings_parse"](spark, SF).rdd.getNumPartitions() == 16


def test_wide_views_are_dealt_by_what_follows_asks_for(spark):
    for name in ("file_tags", "coll_parts_raw", "batch_files"):
        assert adapters.view(spark, SF, name).rdd.getNumPartitions() == 16
    assert "RepartitionByExpression [file_id" in plan(adapters.view(spark, SF, "file_tags"))


def test_effective_tags_and_merged_members_are_dealt_by_owner(spark):
    rows = spark.createDataFrame([(1, 0), (1, 1), (2, 0)], "batch_id long, pos int")
    tags = spark.createDataFrame([(1, "t"), (1, "t")], "batch_id long, tag_id string")
    out = imports.effective_tags(rows, tags, rows.where("pos = 0").withColumn("tag_id", rows["pos"].cast("string")))
    assert pairs(out) == [(1, 0, "0"), (1, 0, "t"), (1, 1, "t"), (2, 0, "0")]
    assert "RepartitionByExpression [batch_id" in plan(out)
    merged = graph.merged_members(spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "file_id long, tag_id string"), spark.createDataFrame([("a", "b")], "gone string, kept string"), "file_id")
    assert pairs(merged) == [(1, "b"), (2, "c")] and "RepartitionByExpression [file_id" in plan(merged)


def test_deleted_tags_are_the_hashed_side(spark, monkeypatch):
    monkeypatch.setattr(session, "BROADCAST_ROWS", 0)
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    t = upkeep.TagTables(frame([("a", "A"), ("b", "B")], "tag_id string, label string"), frame([("a", "b")], "child string, parent string"), frame([(1, "a"), (2, "b")], "file_id long, tag_id string"), frame([(1, "a")], "collection_id long, tag_id string"), frame([(1, "b")], "batch_id long, tag_id string"))
    out = upkeep.deleted(t, t.tags.where("tag_id = 'a'"))
    assert pairs(out.file_tags) == [(2, "b")] and pairs(out.collection_tags) == [] and pairs(out.edges) == [] and pairs(out.batch_tags) == [(1, "b")]
    assert "strategy=shuffle_hash" in plan(out.file_tags)
