"""Small tables with the edge cases of each operator."""

import functools
import hashlib
import html
import math
import os
import random

import pytest
from pyspark.sql import functions as F

from corvane.functions import media, text
from corvane.operators import collections, graph, imports, joins, mutate, predicates, rollups, search
from corvane.plans import catalog
from corvane.streaming import events

SF = "/root/testdata/sf0.001"


def pairs(df):
    return sorted(tuple(r) for r in df.collect())


def edges(spark, *rows):
    return spark.createDataFrame(list(rows), "child string, parent string")


def test_diamond_has_each_ancestor_once(spark):
    c = graph.closure(edges(spark, ("A", "B"), ("A", "C"), ("B", "D"), ("C", "D")))
    assert sorted(r["ancestor"] for r in c.where("tag = 'A'").collect()) == ["A", "B", "C", "D"]


def test_cycle_ends(spark):
    c = graph.closure(edges(spark, ("A", "B"), ("B", "A")))
    assert pairs(c.select("tag", "ancestor")) == [("A", "A"), ("A", "B"), ("B", "A"), ("B", "B")]


def test_lone_tag_is_its_own_ancestor(spark):
    nodes = spark.createDataFrame([("X",)], "tag_id string")
    assert pairs(graph.closure(edges(spark).limit(0), nodes).select("tag", "ancestor")) == [("X", "X")]


def test_closure_of_random_graphs_is_transitive(spark):
    import random

    r = random.Random(5)
    links = {(f"t{a}", f"t{b}") for a, b in ((r.randrange(12), r.randrange(12)) for _ in range(25)) if a < b}
    got = {tuple(x) for x in graph.closure(edges(spark, *links)).select("tag", "ancestor").collect()}
    assert all((t, t) in got for pair in links for t in pair)
    assert all((a, d) in got for a, b in got for c, d in got if b == c)


def test_missing_values_pass_an_exclusion(spark):
    df = spark.createDataFrame([(None,), ("aac",), ("mp3",)], "codec string")
    assert [r[0] for r in df.where(predicates.not_in(F.col("codec"), ["mp3"])).collect()] == [None, "aac"]
    assert df.where(predicates.not_in(F.col("codec"), [])).count() == 3


def test_missing_flag_counts_as_false(spark):
    df = spark.createDataFrame([(1, True), (2, False), (3, None)], "id int, f boolean")
    assert [r["id"] for r in df.where(predicates.truth(F.col("f"), False)).collect()] == [2, 3]


def test_modified_needs_an_original(spark):
    df = spark.createDataFrame([(1, "h", None), (2, "h", ""), (3, "h", "h"), (4, "h", "x")], "id int, hash string, orig string")
    for wanted, ids in ((True, [4]), (False, [3])):
        assert [r["id"] for r in df.where(predicates.modified(F.col("hash"), F.col("orig"), wanted)).collect()] == ids


def test_filter_language(spark):
    df = spark.createDataFrame([(1, "Ab", ["x"]), (2, None, []), (3, "b", ["x", "y"])], "id int, s string, a array<string>")

    def ids(spec):
        return [r["id"] for r in df.where(predicates.compile_filter(spec)).collect()]

    assert ids({"s": {"$regex": "^a"}}) == [1]
    assert ids({"s": {"$nin": ["b"]}}) == [1, 2]
    assert ids({"a": {"$all": ["x", "y"]}}) == [3]
    assert ids({"a": {"$size": 0}}) == [2]
    assert ids({"s": {"$exists": False}}) == [2]
    assert ids({"$or": [{"id": 1}, {"s": "b"}]}) == [1, 3]
    assert ids({"$nor": [{"s": "b"}]}) == [1, 2]
    assert ids({"s": {"$ne": "b"}}) == [1, 2]
    for bad in ({"$where": "1"}, {"$text": {}}, {"s": {"$near": 1}}):
        with pytest.raises(ValueError):
            predicates.compile_filter(bad)


def test_active_filters_and_units():
    assert predicates.FileQuery().active() == 0
    assert predicates.FileQuery(has_params=True, ids=(1,)).active() == 2
    assert predicates.from_units("size", 2) == 2000 and predicates.from_units("duration", "1:02:03") == 3723


def test_capped_count(spark):
    df = spark.range(250)
    assert tuple(search.count_capped(df, 10, 2, 5).first()) == (50, 5)
    assert tuple(search.count_capped(df, 10, 5, 5).first()) == (250, 25)


def test_ids_mode_keeps_the_order_of_the_list(spark):
    df = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    assert [r["id"] for r in search.by_ids(df, ["c", "a", "zz"], "id").collect()] == ["c", "a"]


@pytest.mark.parametrize(
    ("selected", "clicked", "select", "deselect"),
    [
        ([3], 6, [4, 5, 6], []),
        ([5, 8], 2, [2, 3, 4, 6, 7], []),
        ([], 4, [4], []),
        ([4], 4, [], [4]),
        ([4, 7], 4, [], [4]),
        ([2, 9], 5, [3, 4, 5], [9]),
        ([1, 77], 3, [2, 3], [77]),
        ([77], 3, [3], []),
    ],
)
def test_shift_select(spark, selected, clicked, select, deselect):
    df = spark.createDataFrame([(i, None if i < 2 else i * 10) for i in range(10)], "id long, k long")
    got = pairs(search.shift_select(df, "k", "id", clicked, selected))
    assert got == sorted([(i, "select") for i in select] + [(i, "deselect") for i in deselect])


def test_ranks_count_what_stands_before(spark):
    df = spark.createDataFrame([(1, None), (2, 5), (3, 5), (4, 1)], "id long, k long")
    assert pairs(search.ranks(df, "k", "id", [1, 3, 9])) == [(1, 0), (3, 3)]


def test_rollups(spark):
    members = spark.createDataFrame([(1, 1), (1, 2), (1, 3), (2, 1)], "collection_id int, file_id int")
    files = spark.createDataFrame([(1, 10, 0, 5), (2, 20, 4, 4), (3, 30, 5, 3)], "file_id int, size long, rating int, date_created int")
    assert pairs(rollups.collection_rollup(members, files)) == [(1, 3, 60, 4.5), (2, 1, 10, 0.0)]
    tags = spark.createDataFrame([("a",), ("b",)], "tag_id string")
    held = spark.createDataFrame([(1, "a"), (1, "a"), (2, "a")], "file_id int, tag_id string")
    assert pairs(rollups.tag_rollup(tags, held, files)) == [("a", 2, 30, 2), ("b", 0, 0, None)]


def test_reindex(spark):
    df = spark.createDataFrame([(1, "f1", 5), (1, "f2", 1), (1, "f1", 0), (1, None, 2)], "collection_id int, file_id string, idx int")
    assert pairs(collections.cleaned(df)) == [(1, "f1", 0), (1, "f2", 1)]


def test_subsets(spark):
    rows = [(1, "1", 0), (2, "1", 0), (2, "2", 1), (3, "2", 0), (3, "1", 1), (4, "3", 0)]
    df = spark.createDataFrame(rows, "collection_id int, file_id string, idx int")
    assert pairs(collections.repaired(df).select("collection_id", "file_id")) == [(2, "1"), (2, "2"), (4, "3")]


def test_prepended(spark):
    df = spark.createDataFrame([(1, "a", 0), (1, "b", 1)], "collection_id int, file_id string, idx int")
    new = spark.createDataFrame([(1, "b", 0), (1, "c", 1)], df.schema)
    assert pairs(collections.prepended(df, new)) == [(1, "a", 1), (1, "b", 2), (1, "c", 0)]


def test_guard_spoils_the_whole_tag(spark):
    c = graph.closure(edges(spark, ("n", "w")))
    got = graph.guard(spark.createDataFrame([("n", "w"), ("n", "x"), ("w", "x")], "tag string, child string"), c)
    assert pairs(got) == [("n", "w", False), ("n", "x", False), ("w", "x", True)]


def test_merge_tags_once(spark):
    merges = spark.createDataFrame([("g", "k")], "gone string, kept string")
    members = spark.createDataFrame([(1, "g"), (1, "k"), (2, "g")], "file_id int, tag_id string")
    assert pairs(graph.merged_members(members, merges, "file_id")) == [(1, "k"), (2, "k")]
    assert pairs(graph.merged_edges(edges(spark, ("g", "k"), ("a", "g"), ("a", "k")), merges)) == [("a", "k")]


@pytest.mark.parametrize(("has_rank", "want"), [(False, ("red", None)), (True, ("blue", 5.0))])
def test_category_ranks(spark, has_rank, want):
    tags = spark.createDataFrame([("x", None, None, None, False, has_rank), ("a", "red", None, 3.0, True, True), ("b", "blue", None, 5.0, True, True)], "tag_id string, color string, icon string, sort_rank double, inheritable boolean, has_rank boolean")
    got = graph.inherit_category(tags, graph.closure(edges(spark, ("x", "a"), ("x", "b")))).where("tag_id = 'x'").first()
    assert (got["color"], got["sort_rank"]) == want


def test_pull_keeps_other_repeats(spark):
    df = spark.createDataFrame([(["a", "b", "b"],)], "x array<string>")
    assert df.select(mutate.pull(F.col("x"), ["a"])).first()[0] == ["b", "b"]
    assert df.select(mutate.same_set(F.col("x"), F.array(F.lit("b"), F.lit("a")))).first()[0]
    assert df.select(mutate.replaced(F.col("x"), "a", "b", F.array(F.lit("z")))).first()[0] == ["b"]
    assert df.select(mutate.replaced(F.col("x"), "a", "q", F.array(F.lit("q")))).first()[0] == ["b"]


def test_rows_changed_in_place(spark):
    df = spark.createDataFrame([([("p", "PENDING"), ("q", "PENDING")],)], "imports array<struct<path:string,status:string>>")
    got = df.select(mutate.with_row_status(F.col("imports"), "q", "ERROR")).first()[0]
    assert [tuple(x) for x in got] == [("p", "PENDING"), ("q", "ERROR")]


@pytest.mark.parametrize(("label", "aliases", "score"), [("Foo", [], 100), ("Foobar", [], 50), ("a foo b", [], 25), ("zz", ["foo"], 100)])
def test_search_tiers(spark, label, aliases, score):
    df = spark.createDataFrame([(label, aliases)], "l string, a array<string>")
    assert df.select(text.relevance("foo", F.col("l"), F.col("a"))).first()[0] == score


def test_empty_term_matches_all(spark):
    df = spark.createDataFrame([("xaxb", []), ("a", [])], "l string, a array<string>")
    assert [r["l"] for r in df.where(text.matches_all_terms("a  b", F.col("l"), F.col("a"))).collect()] == ["xaxb"]


def test_tag_pattern(spark):
    df = spark.createDataFrame([("A b-c", ["x.y"])], "l string, a array<string>")
    assert df.select(text.tag_pattern(F.col("l"), F.col("a"))).first()[0] == r"(^A[\s\-_\.]+b[\s\-_\.]+c$)|(^x\.y$)"


def test_entities(spark):
    df = spark.createDataFrame([("&lt;b&gt; &amp;lt; &#233;&#128512;&#39; & &x;",)], "t string")
    assert df.select(text.decode_entities(F.col("t"))).first()[0] == "<b> &lt; é😀' & &x;"


def test_broken_extensions(spark):
    df = spark.createDataFrame([(".jpg",), ("JPG",), ("png",), ("jpg",)], "e string")
    assert {r[0] for r in df.select(text.fixed_extension(F.col("e"), F.lit("/a/x.jpg"))).collect()} == {"jpg"}


def test_parameters(spark):
    df = spark.createDataFrame([("a cat\nSteps: 20, Sampler: X, Seed: abc, Model: m",), ("p\nNegative prompt: bad\nSteps: 3, Size: 64x32, Hires upscaler: L",)], "b string")
    a, b = (r[0] for r in df.select(text.parameters(F.col("b"))).collect())
    assert (a["prompt"], a["steps"], a["seed"], a["width"], a["is_upscaled"], a["negative_prompt"]) == ("a cat", 20.0, None, None, False, None)
    assert (b["prompt"], b["negative_prompt"], b["width"], b["height"], b["is_upscaled"]) == ("p", "bad", 64, 32, True)


def test_media(spark):
    df = spark.createDataFrame([([(5.0, 3.0)],), ([(-1.0, 2.0)],), ([(0.0, 999.0)],), ([(1.0, 2.0)],)], "p array<struct<start:double,end:double>>")
    assert [r[0] for r in df.select(media.splice_is_valid(F.col("p"), F.lit(10.0))).collect()] == [False, False, False, True]
    assert spark.range(1).select(text.seconds(F.lit("1:00:01.5")), text.fraction(F.lit("30000/1001"))).first()[0] == 3601.5
    assert len(spark.range(1).select(media.frame_times(F.lit(100.0))).first()[0]) == 9


def test_import_statuses(spark):
    rows = spark.createDataFrame([(1, 0, "new"), (1, 1, "stored"), (1, 2, "dead"), (1, 3, "new"), (2, 0, "dead")], "batch_id int, pos int, hash string")
    files, dead = (spark.createDataFrame([(h,)], "hash string") for h in ("stored", "dead"))
    got = {(r["batch_id"], r["pos"]): r["result"] for r in imports.statuses(rows, files, dead, F.col("batch_id") == 1).collect()}
    assert got == {(1, 0): "COMPLETE", (1, 1): "DUPLICATE", (1, 2): "DELETED", (1, 3): "DUPLICATE", (2, 0): "COMPLETE"}
    unread = spark.createDataFrame([(3, 0, None), (3, 1, None), (3, 2, "x")], rows.schema)
    assert [r["result"] for r in imports.statuses(unread, files, dead).orderBy("pos").collect()] == ["ERROR", "ERROR", "COMPLETE"]


def test_folder_modes(spark):
    df = spark.createDataFrame([("/r/a/b",)], "folder string")

    def got(**how):
        return sorted((r["label"], r["parent_label"], r["collection_title"]) for r in imports.folder_tags(df, 1, **how).collect())

    assert got(mode="hierarchical", collection="withTag") == [("a", None, "b"), ("b", "a", "b")]
    assert got(mode="hierarchical", collection="withoutTag") == [("a", None, "b")]
    assert got(mode="cascading", collection="none") == [("a", None, None), ("b", None, None)]


def test_relink(spark):
    files = spark.createDataFrame([(1, "/a/X.jpg"), (2, "/b/y.jpg")], "file_id int, original_path string")
    found = spark.createDataFrame([("/b/x.JPG",), ("/b/y.jpg",)], "path string")
    assert pairs(joins.relink(files, found)) == [(1, "/a/X.jpg", "/b/x.JPG")]


def test_sources(spark, tmp_path):
    from corvane.sources import files

    (tmp_path / "a.jpg").write_bytes(b"1")
    (tmp_path / "a.txt").write_text("Steps: 3")
    (tmp_path / "a.jpg.json").write_text('{"tags": [{"label": "t"}]}')
    rows = files.listing(spark, str(tmp_path), ["JPG"])
    out = files.with_json_sidecars(files.with_text_sidecars(rows, str(tmp_path)), str(tmp_path)).first()
    assert (out["name"], out["size"], out["side_text"]) == ("a.jpg", 1, "Steps: 3")
    held = spark.createDataFrame([(1, 4), (2, 4), (3, 4)], "key int, size long")
    assert [r["storage"] for r in files.choose_storage(held, [("x", 5), ("y", 5)]).orderBy("key").collect()] == ["x", "y", None]


def test_nearest_face_is_searched_among_all_rows(spark, tmp_path):
    spark.createDataFrame([(0, [0.0, 0.0]), (7, [0.1, 0.0]), (20, [5.0, 5.0]), (33, [5.0, 5.2]), (40, [9.0, 0.0])], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r["face_id"]: (r["tag_id"], round(r["distance"], 4)) for r in catalog.queries()["nearest_face"](spark, str(tmp_path)).collect()}
    assert got == {0: ("7", 0.1), 20: ("33", 0.2)}


def test_nearest_other_meets_blocks_by_products(spark):
    r = random.Random(2)
    vectors = {i: [r.uniform(-1, 1) for _ in range(6)] for i in range(300)} | {300 + i: [r.uniform(-1, 1) for _ in range(3)] for i in range(60)}
    vectors |= {400: vectors[5], 401: vectors[5], 402: [], 403: [], 404: None, 405: [1.0, None, 0.0], 406: [float("nan")] * 3, 407: [1e6 + 1] * 3, 408: [1e6] * 3}
    rows = [(i, v) for i, v in vectors.items()] + [(None, [0.0] * 3)]
    frame = spark.createDataFrame(rows, "id long, v array<double>").repartition(3)
    faces, known = frame.select(F.col("id").alias("face_id"), F.col("v").alias("vector")), frame.select(F.col("id").cast("string").alias("tag_id"), F.col("v").alias("known_vector"))
    sure = {i: v for i, v in vectors.items() if v is not None and all(x is not None and x == x for x in v)}
    want, squares = {}, lambda v, w: functools.reduce(lambda s, x: s + x, ((a - b) * (a - b) for a, b in zip(v, w)), 0.0)  # noqa: E731 - sum() rounds otherwise
    for i, v in sure.items():
        near = min(((math.sqrt(squares(v, w)), str(j)) for j, w in sure.items() if j != i and len(w) == len(v)), default=(9, ""))
        if near[0] <= 1.8:
            want[i] = (near[1], near[0])
    out = joins.nearest_other(faces, known, 1.8)
    assert {x["face_id"]: (x["tag_id"], x["distance"]) for x in out.collect()} == want and {want[5][1], want[407][0]} == {0.0, "408"}
    plan = out._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "zip_with" not in plan  # pairs are not worked out one by one


def test_entity_decode_keeps_all_pages(spark, tmp_path):
    pages = [(1, "a &lt; b"), (2, "&#169; &#8364; &#128512;"), (3, "it&#39;s"), (4, "x")]
    spark.createDataFrame(pages, "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r["page_id"]: r["decoded"] for r in catalog.queries()["entity_decode"](spark, str(tmp_path)).collect()}
    assert got == {i: hashlib.md5(html.unescape(t).encode()).hexdigest() for i, t in pages}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_whole_orders_and_patterns(spark):
    q = catalog.queries()
    paths = [(r["depth"], r["path"]) for r in q["path_depth_sort"](spark, SF).collect()]
    assert len(paths) == catalog.view(spark, SF, "files").count() > 200 and paths == sorted(paths)
    n = catalog.view(spark, SF, "tags").count()
    assert len({r["tag_id"] for r in q["chip_order"](spark, SF).collect()}) == n > 40
    assert q["tag_to_regex"](spark, SF).count() == n


def test_fold_over_several_runs(spark, tmp_path):
    schema = "event_id long, user_id long, event_type string"
    for part in ([(1, 1, "a"), (2, 1, "b"), (3, 2, "c")], [(4, 1, "d"), (5, 3, "e"), (0, 2, "z")]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        out = events.fold(spark, events.read_events(spark, f"{tmp_path}/in", schema), "user_id", ["event_id"], ["event_id", "event_type"], f"{tmp_path}/state")
    assert sorted(tuple(r) for r in out.collect()) == [(1, 4, "d", 3), (2, 3, "c", 2), (3, 5, "e", 1)]


def test_import_batch_run_again_keeps_its_rows(spark, tmp_path):
    schema = "id long, hash string"
    for part in ([(1, "a"), (2, "b")], [(3, "b"), (4, "c")]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        events.import_stream(events.read_events(spark, f"{tmp_path}/in", schema), f"{tmp_path}/store", f"{tmp_path}/state")
    for f in [*(tmp_path / "state/commits").glob("1"), *(tmp_path / "state/commits").glob(".1.crc")]:
        f.unlink()  # as if the run had ended between write and commit
    events.import_stream(events.read_events(spark, f"{tmp_path}/in", schema), f"{tmp_path}/store", f"{tmp_path}/state")
    stored = spark.read.option("recursiveFileLookup", "true").parquet(f"{tmp_path}/store").collect()
    assert sorted(r["hash"] for r in stored) == ["a", "b", "c"]


def test_import_into_a_store_that_holds_rows(spark, tmp_path):
    schema = "id long, hash string"
    spark.createDataFrame([(1, "a"), (2, "b")], schema).write.parquet(f"{tmp_path}/store/old")
    spark.createDataFrame([(3, "b"), (4, "c"), (5, "c")], schema).write.parquet(f"{tmp_path}/in")
    events.import_stream(events.read_events(spark, f"{tmp_path}/in", schema), f"{tmp_path}/store", f"{tmp_path}/state")
    stored = spark.read.option("recursiveFileLookup", "true").parquet(f"{tmp_path}/store").collect()
    assert sorted(r["hash"] for r in stored) == ["a", "b", "c"]


def test_import_keeps_rows_without_a_hash(spark, tmp_path):
    schema = "id long, hash string"
    for part in ([(1, None), (2, "a"), (3, None), (4, "a"), (5, None)], [(6, None), (7, "a"), (8, "b")]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        events.import_stream(events.read_events(spark, f"{tmp_path}/in", schema), f"{tmp_path}/store", f"{tmp_path}/state")
    stored = spark.read.option("recursiveFileLookup", "true").parquet(f"{tmp_path}/store").collect()
    assert sorted(r["id"] for r in stored) == [1, 2, 3, 5, 6, 8]


def test_null_keys_are_upserted_once(spark):
    rows = mutate.upsert(spark.createDataFrame([("a",)], "hash string"), spark.createDataFrame([(None,), (None,), ("a",), ("b",)], "hash string"), "hash")
    again = mutate.upsert(rows, spark.createDataFrame([(None,)], "hash string"), "hash")
    assert sorted(str(r["hash"]) for r in again.collect()) == ["None", "a", "b"]


def test_throttled_import(spark, tmp_path):
    schema = "id long, hash string"
    spark.createDataFrame([(3, "b"), (4, "c")], schema).write.parquet(f"{tmp_path}/in")
    query = events.import_stream(events.read_events(spark, f"{tmp_path}/in", schema), f"{tmp_path}/store", f"{tmp_path}/state", every="1 second")
    query.processAllAvailable()
    query.stop()
    assert spark.read.option("recursiveFileLookup", "true").parquet(f"{tmp_path}/store").count() == 2


def test_descending_ranks_and_selections(spark):
    df = spark.createDataFrame([(i, None if i == 4 else i % 3) for i in range(10)], "id int, k int")
    order = [r["id"] for r in search.ordered(df, "k", True, "id").collect()]
    assert {r["id"]: r["rank"] for r in search.ranks(df, "k", "id", list(range(10)), True).collect()} == {i: n for n, i in enumerate(order)}
    got = search.shift_select(df, "k", "id", order[6], [order[2], 99], True).collect()
    assert {(r["id"], r["action"]) for r in got} == {*((i, "select") for i in order[3:7]), (99, "deselect")}


def test_settings_over_defaults():
    from corvane import config

    got = config.load('{"file": {"search": {"pageSize": "250"}}, "imports": {"folderDelimiter": "::"}, "mine": 1}')
    assert (config.page_size(got, "file"), config.page_size(got, "batch"), got["imports"]["folderDelimiter"], got["mine"]) == (250, 20, "::", 1)
    assert config.load("not json") == config.load(None) == config.DEFAULTS


def test_storage_of_places_with_one_name(spark):
    from corvane.sources import files

    held = spark.createDataFrame([(i, 1) for i in range(40)], "key int, size long").repartition(7)
    got = [r["storage"] for r in files.choose_storage(held, [("x", 11), ("y", 10), ("x", 10)]).orderBy("key").collect()]
    assert got == ["x"] * 10 + ["y"] * 9 + ["x"] * 9 + [None] * 12  # a place must have more room than a file needs


@pytest.mark.parametrize("seed", range(4))
def test_storage_fills_the_first_place_with_room(spark, seed):
    from corvane.sources import files

    r = random.Random(seed)
    sizes = [r.choice([1, 3, 700, 700, 40, r.randrange(2_000)]) for _ in range(400)]
    places = [("a", 1_000), ("b", r.randrange(100_000)), ("c", 5_000), ("d", 60_000)]
    free, want = [f for _, f in places], []
    for size in sizes:
        k = next((k for k, room in enumerate(free) if room > size), None)
        if k is not None:
            free[k] -= size
        want.append(None if k is None else places[k][0])
    held = spark.createDataFrame(list(enumerate(sizes)), "key int, size long").repartition(5)
    got = [x["storage"] for x in files.choose_storage(held, places, ranges=40).orderBy("key").collect()]
    assert got == want and min(free) >= 0
    assert [x["storage"] for x in files.choose_storage(spark.createDataFrame([(1, None)], "key int, size long"), places).collect()] == [None]


def test_folder_sidecars(spark, tmp_path):
    from corvane.sources import files

    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "a.jpg").write_bytes(b"1")
    (tmp_path / "s" / "[[Collection]].json").write_text('{"tags": [{"label": "whole"}]}')
    rows = files.listing(spark, str(tmp_path), ["jpg"])
    assert files.with_folder_sidecars(rows, str(tmp_path)).first()["folder_tags"] == ["whole"]


def test_sort_keys():
    from corvane.operators import entities

    assert entities.checked_key("tag", "label") == "label"
    with pytest.raises(ValueError):
        entities.checked_key("batch", "rating")
    assert entities.EntityQuery().active() == 0 and entities.TagQuery(has_regex=True, compares={"count": (">", 1)}).active() == 2


def test_parameters_are_read_from_the_settings_only(spark):
    blob = 'Seed: of life, Model: T Ford\nNegative prompt: Steps of stone\nSteps: 20, Seed: 7, Model: m, Hires scale: 2, Clip skip: , Hashes: {"vae": "v1"}, Template: red cat, Negative Template: dog\r'
    p = spark.createDataFrame([(blob,), (None,), ("",), ("no settings",)], "b string").select(text.parameters(F.col("b")).alias("p"))
    a, b, c, d = (r[0] for r in p.collect())
    assert (a["prompt"], a["negative_prompt"], a["seed"], a["model"], a["hires_scale"], a["clip_skip"], a["vae_hash"]) == ("Seed: of life, Model: T Ford", "Steps of stone", 7.0, "m", 2.0, 0.0, "v1")
    assert (a["template"], a["negative_template"]) == ("red cat,", "dog")
    assert b["prompt"] is None and c["prompt"] == "" and d["prompt"] == "" and d["seed"] is None


def test_long_lists_of_ids_are_joined(spark):
    from corvane.session import INLINE_IDS, among

    rows = spark.createDataFrame([(i if i % 50 else None, i % 7) for i in range(3_000)], "file_id long, k int").withColumn("is_archived", F.lit(False))
    for ids in ([5, 6, 6, None, 99_999], list(range(0, 2 * INLINE_IDS + 10, 2))):
        asked = set(ids) - {None}
        want = [r["file_id"] for r in rows.collect() if r["file_id"] in asked]
        assert sorted(r["file_id"] for r in among(rows, "file_id", ids).collect()) == sorted(want)
        assert among(rows, "file_id", ids, keep=False).count() == 3_000 - len(want)
        assert predicates.FileQuery(ids=tuple(ids)).chosen(rows).count() == len(want)
        assert predicates.FileQuery(excluded_ids=tuple(ids)).chosen(rows).count() == 3_000 - len(want)
        plain = among(rows, "file_id", ids)._jdf.queryExecution().optimizedPlan().toString()
        assert ("Join" in plain) == (len(asked) > INLINE_IDS)


def test_fields_are_unset(spark):
    df = spark.createDataFrame([(1, (2, (3, 4)))], "a int, thumb struct<path:int,old:struct<x:int,y:int>>")
    assert mutate.unset(df, "a").columns == ["thumb"]
    assert mutate.unset(df, "thumb.old.x").select("thumb.old.*").columns == ["y"]
    assert mutate.unset(df, "thumb.old").select("thumb.*").columns == ["path"]
    assert all(mutate.unset(df, p).schema == df.schema for p in ("b", "thumb.new", "thumb.path.z", "a.b"))


def test_lists_of_collection_files_have_a_default_key(spark):
    from corvane.operators import entities

    rows = spark.createDataFrame([(1, 5), (2, 9)], "id int, date_created int")
    assert [r["id"] for r in entities.listed(rows, "collection_file").collect()] == [2, 1]


def test_tags_are_put_on_and_taken_off_without_a_join_of_pairs(spark):
    from corvane.operators import upkeep

    own = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (2, "b"), (None, "b")], "file_id long, tag_id string")
    out = upkeep.retagged(own, spark.createDataFrame([(1,), (1,), (None,)], "file_id long"), ["n", "m"], ["b", "m"])
    assert sorted(map(str, map(tuple, out.collect()))) == ["(1, 'a')", "(1, 'n')", "(2, 'b')", "(None, 'b')", "(None, 'm')", "(None, 'n')"]
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
