"""What is derived from a library, kept up to date, against deriving it anew."""

import random

from corvane import session
from corvane.operators import graph, reach, rollups, upkeep


def derived(lib):
    closed = graph.closure(lib.tags.edges, lib.tags.tags).select("tag", "ancestor")
    wide = graph.propagate(lib.tags.file_tags, closed, "file_id").join(lib.files.select("file_id"), "file_id", "left_semi")
    tags = {tuple(r) for r in rollups.tag_rollup(lib.tags.tags, wide, lib.files, once=True).collect()}
    colls = {(r["collection_id"], r["n_files"], r["total_size"], round(r["rating"], 6)) for r in rollups.collection_rollup(lib.members, lib.files).collect()}
    return {tuple(r) for r in closed.collect()}, {(r["file_id"], r["tag_id"]) for r in wide.collect()}, tags, colls


def kept(lib):
    colls = {(r["collection_id"], r["n_files"], r["total_size"], round(r["rating"], 6)) for r in rollups.collection_rollup_of(lib.collection_state).collect()}
    return {(r["tag"], r["ancestor"]) for r in lib.closed.collect()}, {(r["file_id"], r["tag_id"]) for r in lib.wide.collect()}, {tuple(r) for r in rollups.rollup_of(lib.tag_state).collect()}, colls


def test_library_follows_random_changes(spark):
    r = random.Random(2)
    tags = [f"t{i}" for i in range(12)]
    files = spark.createDataFrame([(i, f"h{i}", r.randrange(100), r.randrange(6), r.randrange(40)) for i in range(120)], "file_id long, hash string, size long, rating int, date_created int")
    own = {(f, r.choice(tags)) for f in range(120) for _ in range(2)}
    members = {(f % 9, f) for f in range(120)}
    frame = lambda rows, schema: spark.createDataFrame(sorted(rows), schema)
    t = upkeep.TagTables(
        frame([(x, x.upper()) for x in tags], "tag_id string, label string"), frame({("t1", "t0"), ("t2", "t0"), ("t3", "t1"), ("t3", "t2"), ("t4", "t3"), ("t5", "t3")}, "child string, parent string"),
        frame(own, "file_id long, tag_id string"), frame({(f % 9, x) for f, x in own}, "collection_id long, tag_id string"), frame({(1, "t1")}, "batch_id long, tag_id string"),
    )
    lib = upkeep.library(files, frame(members, "collection_id long, file_id long"), frame([("old",)], "hash string"), t)
    assert kept(lib) == derived(lib)
    # The oldest files go, so lists of runners-up run out and are filled again.
    lib = upkeep.files_deleted(lib, files.where("date_created < 22 or file_id % 9 = 4"))
    assert kept(lib) == derived(lib) and lib.collection_state.where("collection_id = 4").count() == 0
    assert lib.tombstones.count() == 1 + files.where("date_created < 22 or file_id % 9 = 4").count()
    lib = upkeep.files_retagged(lib, lib.files.where("file_id % 3 = 0"), ["t4", "t9"], ["t5", "t1"])
    assert kept(lib) == derived(lib)
    lib = upkeep.tags_changed(lib, upkeep.edited(lib.tags, "t3", parents=("t6",)))
    assert kept(lib) == derived(lib)
    lib = upkeep.tags_changed(lib, upkeep.merged(lib.tags, spark.createDataFrame([("t4", "t5"), ("t5", "t7")], "gone string, kept string")))
    assert kept(lib) == derived(lib) and lib.tag_state.where("tag_id in ('t4', 't5')").count() == 0
    lib = upkeep.tags_changed(lib, upkeep.created(lib.tags, "new", "NEW", parents=("t0",), children=("t6",)))
    assert kept(lib) == derived(lib)
    lib = upkeep.files_deleted(lib, lib.files)
    assert kept(lib) == derived(lib) and lib.tag_state.where("n_files <> 0 or total_size <> 0").count() == 0


def test_runners_up(spark):
    tags = spark.createDataFrame([("a",)], "tag_id string")
    files = spark.createDataFrame([(i, 1, i) for i in range(10)], "file_id long, size long, date_created int")
    pairs = lambda ids: spark.createDataFrame([(i, "a") for i in ids], "file_id long, tag_id string")
    state = rollups.rollup_state(tags, pairs([3, 4, 5, 6, 7, 9]), files, runners=2)
    # 8 is younger than the last runner-up, so it may not enter the list before the ones that are missing from it.
    state = rollups.rolled(state, graph.Delta(pairs([8]), pairs([3])), files, files, pairs([4, 5, 6, 7, 8, 9]), runners=2)
    assert [x["file_id"] for x in state.first()["oldest"]] == [4]
    state = rollups.rolled(state, graph.Delta(pairs([2]), pairs([4])), files, files, pairs([2, 5, 6, 7, 8, 9]), runners=2)
    assert [x["file_id"] for x in state.first()["oldest"]] == [2]
    state = rollups.rolled(state, graph.Delta(pairs([]), pairs([2])), files, files, pairs([5, 6, 7, 8, 9]), runners=2)
    assert [x["file_id"] for x in state.first()["oldest"]] == [5, 6] and state.first()["n_files"] == 5


def small(spark, n=60):
    r = random.Random(7)
    frame = lambda rows, schema: spark.createDataFrame(sorted(rows, key=str), schema)
    files = spark.createDataFrame([(i, f"h{i}", i % 13, i % 6, i % 17) for i in range(n)], "file_id long, hash string, size long, rating int, date_created int")
    own = {(f, f"t{r.randrange(8)}") for f in range(n) for _ in range(2)} | {(3, "loose"), (3, "t3"), (n + 5, "t3"), (None, "t2")}
    t = upkeep.TagTables(
        frame([(f"t{i}", f"T{i}") for i in range(8)], "tag_id string, label string"), frame({("t1", "t0"), ("t2", "t0"), ("t3", "t1"), ("t4", "t3"), ("t5", "t3")}, "child string, parent string"),
        frame(own, "file_id long, tag_id string").unionByName(frame([(3, "t3"), (3, "t3")], "file_id long, tag_id string")), frame({(1, "t1")}, "collection_id long, tag_id string"), frame({(1, "t1")}, "batch_id long, tag_id string"),
    )
    return own, upkeep.library(files, frame({(f % 5, f) for f in range(n)}, "collection_id long, file_id long"), frame([("old",)], "hash string"), t)


def test_stored_pairs_stay_where_they_lie(spark, monkeypatch):
    """Sets of files, however large, go to the pairs; all pairs or all own tags are neither moved nor written again by a change."""
    own, lib = small(spark)
    assert {tuple(x) for x in lib.tags.file_tags.collect()} == {(f, t) for f, t in own if f in range(60)}  # own tags that no closure names too, without files there are not
    assert lib.wide.groupBy("file_id", "tag_id").count().where("count > 1").isEmpty()
    monkeypatch.setattr(session, "BROADCAST_ROWS", 0)
    gone = upkeep.files_deleted(lib, lib.files.where("file_id % 4 = 0"))
    for frame in (gone.wide, gone.tags.file_tags):
        text = frame._jdf.queryExecution().executedPlan().toString()
        assert "Bucketed: true" in text and text.count("Exchange") == 1  # that of the files
    assert kept(gone) == derived(gone)
    written, write = [], session.cut
    for module in (upkeep, rollups, reach):
        monkeypatch.setattr(module, "cut", lambda df: [written.append(x.count()) for x in [write(df)]] and write(df))
    monkeypatch.setattr(upkeep, "bucketed", lambda *_: 1 / 0)
    lib = upkeep.files_retagged(lib, lib.files.where("file_id in (2, 3)"), ["t4"], ["t1"])
    assert max(written) < 60 < lib.tags.file_tags.count() < lib.wide.count()


def test_parts_are_written_together_when_they_become_many(spark, monkeypatch):
    """By the ways of large changes: nothing is broadcast by its count."""
    _, lib = small(spark)
    for module in (session, rollups, reach, upkeep):
        monkeypatch.setattr(module, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(upkeep, "PARTS", 2)
    lib = upkeep.files_retagged(lib, lib.files.where("file_id % 3 = 0"), ["t4", "loose"], ["t1", "t2"])
    assert len(lib.parts) == 1 and kept(lib) == derived(lib)
    lib = upkeep.tags_changed(lib, upkeep.edited(lib.tags, "t3", parents=("t6",)))
    assert kept(lib) == derived(lib)
