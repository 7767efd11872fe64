"""Closures, their upkeep under edits, components and merges, against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from corvane.operators import graph, reach, rollups, upkeep


def edges(spark, links):
    return spark.createDataFrame(list(links), "child string, parent string")


def above(links, nodes=()):
    """{(tag, ancestor): least depth} by walking up from every tag."""
    up, out = {}, {}
    for c, p in links:
        if c != p:
            up.setdefault(c, set()).add(p)
    for start in {x for link in links for x in link} | set(nodes):
        line, depth, seen = {start}, 0, {}
        while line:
            seen |= dict.fromkeys(line, depth)
            line, depth = {p for x in line for p in up.get(x, ())} - set(seen), depth + 1
        out |= {(start, x): d for x, d in seen.items()}
    return out


def layered(r, n, acyclic):
    links = set()
    for _ in range(int(n * 1.6)):
        a, b = r.randrange(n), r.randrange(n)
        if a != b:
            links.add((f"t{min(a, b)}", f"t{max(a, b)}") if acyclic else (f"t{a}", f"t{b}"))
    return links


@pytest.mark.parametrize("acyclic", [True, False])
def test_closure_of_random_graphs(spark, acyclic):
    links = layered(random.Random(3), 40, acyclic)
    got = {(r["tag"], r["ancestor"]): r["depth"] for r in reach.closure(edges(spark, links), spark.createDataFrame([("alone",)], "tag_id string")).collect()}
    assert got == above(links, ["alone"])


def test_closure_of_a_long_chain_and_a_ring(spark):
    chain = [(f"c{i}", f"c{i + 1}") for i in range(400)]
    ring = [(f"r{i}", f"r{(i + 1) % 37}") for i in range(37)]
    c = reach.closure(edges(spark, chain + ring))
    assert c.where("tag like 'c%'").count() == 401 * 402 // 2 and c.where("tag = 'c0'").agg(F.max("depth")).first()[0] == 400
    assert c.where("tag like 'r%'").count() == 37 * 37 and c.where("tag like 'r%'").agg(F.max("depth")).first()[0] == 36


def test_below_a_chain_of_ten_thousand(spark):
    links = [(f"c{i}", f"c{i + 1}") for i in range(10_000)] + [("c3", "x"), ("x", "c3")]
    got = graph.below(edges(spark, links), ["c10000", "c5", "nobody"])
    assert {r["root"]: r["count"] for r in got.groupBy("root").count().collect()} == {"c10000": 10_002, "c5": 7, "nobody": 1}


@pytest.mark.parametrize("seed, acyclic", [(1, True), (2, True), (3, False)])
def test_closure_follows_batches_of_edits(spark, seed, acyclic):
    r = random.Random(seed)
    links = layered(r, 30, acyclic)
    closed = spark.createDataFrame(list(above(links)), "tag string, ancestor string")
    tags = {x for p in above(links) for x in p}
    for _ in range(2):
        gone = set(r.sample(sorted(links), 6))
        new = {x for x in layered(r, 36, acyclic) if r.random() < 0.2} | {("new", "t1")}
        delta = graph.closure_delta(closed, edges(spark, links), edges(spark, new | {(a, a) for a, _ in list(new)[:1]}), edges(spark, gone | {("t0", "absent")}))
        links = (links | new) - gone
        tags |= {x for link in new - gone for x in link}
        before, want = {tuple(x) for x in closed.collect()}, set(above(links, tags))
        assert {tuple(x) for x in delta.added.collect()} == want - before
        assert {tuple(x) for x in delta.removed.collect()} == before - want
        assert {tuple(x) for x in graph.with_delta(closed, delta).collect()} == want
        closed = spark.createDataFrame(sorted(want), "tag string, ancestor string")


def test_owners_follow_the_closure(spark):
    r = random.Random(8)
    links = layered(r, 25, True)
    own = {(f, f"t{r.randrange(25)}") for f in range(60) for _ in range(2)}
    gone = set(r.sample(sorted(links), 8))
    new = {("t1", "t20"), ("t2", "t24")}
    after = (links | new) - gone
    tags = {x for link in links | new for x in link} | {t for _, t in own}
    frame = lambda x: spark.createDataFrame(sorted(set(above(x, tags))), "tag string, ancestor string")
    before, now = frame(links), frame(after)
    delta = graph.closure_delta(before, edges(spark, links), edges(spark, new), edges(spark, gone))
    wide = lambda x: {(f, a) for f, t in own for (b, a) in above(x, tags) if b == t}
    got = graph.held_delta(spark.createDataFrame(sorted(own), "file_id long, tag_id string"), before, now, delta, "file_id")
    assert {tuple(x) for x in got.added.collect()} == wide(after) - wide(links)
    assert {tuple(x) for x in got.removed.collect()} == wide(links) - wide(after)


def test_components(spark):
    r = random.Random(4)
    ids = [f"n{i}" for i in r.sample(range(10_000), 700)]
    links = list(zip(ids[:400], ids[1:400])) + [(ids[400], x) for x in ids[401:600]] + list(zip(ids[600:650], ids[650:700])) + [("self", "self")]
    got = {x["node"]: x["root"] for x in reach.components(spark.createDataFrame(links, "a string, b string")).collect()}
    want = {x: min(ids[:400]) for x in ids[:400]} | {x: min(ids[400:600]) for x in ids[400:600]} | {x: min(a, b) for a, b in links[-51:-1] for x in (a, b)} | {"self": "self"}
    assert got == want
    assert reach.components(spark.createDataFrame([], "a string, b string")).count() == 0


def test_chains_of_merges(spark):
    t = upkeep.TagTables(
        spark.createDataFrame([(x, x.upper(), n) for x, n in (("a", 1), ("b", 2), ("c", 3), ("d", 4), ("e", 9), ("f", 9), ("g", 0))], "tag_id string, label string, count long"),
        edges(spark, [("a", "g"), ("b", "c"), ("g", "b"), ("d", "f")]),
        spark.createDataFrame([(1, "a"), (1, "b"), (2, "d"), (3, "c")], "file_id long, tag_id string"),
        spark.createDataFrame([(1, "b")], "collection_id long, tag_id string"),
        spark.createDataFrame([(1, "d")], "batch_id long, tag_id string"),
    )
    # a to b to c is a chain; d goes to both e and f, of which e has the least id at equal counts, so f goes too.
    out = upkeep.merged(t, spark.createDataFrame([("a", "b", "?"), ("b", "c", "Kept"), ("d", "e", "E2"), ("d", "f", "F2")], "gone string, kept string, label string"))
    assert {tuple(x) for x in out.tags.collect()} == {("c", "Kept", 3), ("e", "E2", 9), ("g", "G", 0)}
    assert {tuple(x) for x in out.edges.collect()} == {("c", "g"), ("g", "c")}
    assert {tuple(x) for x in out.file_tags.collect()} == {(1, "c"), (2, "e"), (3, "c")}
    assert [tuple(x) for x in out.collection_tags.collect()] == [(1, "c")] and [tuple(x) for x in out.batch_tags.collect()] == [(1, "e")]
    with pytest.raises(ValueError):
        upkeep.merged(t, spark.createDataFrame([("a", "b"), ("b", "a")], "gone string, kept string"))


def test_closure_after_a_change_of_tags(spark):
    t = upkeep.TagTables(spark.createDataFrame([("a", "A"), ("b", "B"), ("c", "C"), ("alone", "X")], "tag_id string, label string"), edges(spark, [("a", "b"), ("b", "c")]), *(spark.createDataFrame([], f"{o}_id long, tag_id string") for o in ("file", "collection", "batch")))
    closed = graph.closure(t.edges, t.tags)
    for after in (upkeep.created(t, "n", "N", parents=("b",), children=("c",)), upkeep.deleted(t, t.tags.where("tag_id in ('b', 'alone')")), upkeep.edited(t, "a", parents=("c",))):
        got, _ = upkeep.closure_after(t, closed, after)
        assert {tuple(x) for x in got.collect()} == {tuple(x) for x in graph.closure(after.edges, after.tags).select("tag", "ancestor").collect()}


def test_trees_end_at_cycles(spark):
    rows = spark.createDataFrame([("Root", None), ("a", "root"), ("b", "A"), ("A", "B"), ("x", "y"), ("Y", "x")], "label string, parent_label string")
    assert {tuple(r) for r in graph.tree(rows).collect()} == {("Root", "Root", 0), ("A", "Root/A", 1), ("b", "Root/A/b", 2)}


def test_propagated_tags_are_dealt_once_by_owner(spark):
    members = spark.createDataFrame([(1, "a"), (1, "b"), (2, "b")], "file_id long, tag_id string")
    closed = spark.createDataFrame([("a", "a"), ("b", "b"), ("a", "t"), ("b", "t")], "tag string, ancestor string")
    wide = graph.propagate(members, closed, "file_id")
    plan = wide.groupBy("file_id").count()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(file_id") == 1 and "hashpartitioning(file_id#" in plan and "tag_id" not in plan.split("hashpartitioning(file_id")[1].split(")")[0]
    assert sorted(map(tuple, wide.collect())) == [(1, "a"), (1, "b"), (1, "t"), (2, "b"), (2, "t")]


def test_owners_whose_ancestors_changed_are_found_from_the_changed_pairs(spark):
    own = spark.createDataFrame([(1, "a"), (1, "c"), (2, "b"), (3, "c"), (4, "a")], "file_id long, tag_id string")
    pairs = lambda rows: spark.createDataFrame(rows, "tag string, ancestor string")
    selves = [(x, x) for x in "abct"]
    before, after = pairs([*selves, ("a", "t"), ("c", "t")]), pairs([*selves, ("c", "t"), ("b", "t")])
    got = upkeep.closure_changed(own, before, after, "file_id")
    want = upkeep.changed(graph.propagate(own, before, "file_id"), graph.propagate(own, after, "file_id"), "file_id")
    assert sorted(r[0] for r in got.collect()) == sorted(r[0] for r in want.collect()) == [2, 4]


def test_files_keep_an_ancestor_that_another_of_their_tags_has(spark):
    own = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (3, "a"), (3, "d")], "file_id long, tag_id string")
    pairs = lambda rows: spark.createDataFrame(rows, "tag string, ancestor string")
    before = pairs([("a", "x"), ("b", "x"), ("a", "a"), ("b", "b"), ("d", "d")])
    delta = graph.Delta(pairs([("a", "y"), ("d", "x")]), pairs([("a", "x")]))
    got = graph.held_delta(own, before, graph.with_delta(before, delta), delta, "file_id")
    assert {tuple(r) for r in got.added.collect()} == {(1, "y"), (2, "y"), (3, "y")} and {tuple(r) for r in got.removed.collect()} == {(2, "x")}


def test_only_pairs_with_a_removed_tag_meet_the_removed_ones(spark):
    pairs = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a")], "file_id long, tag_id string")
    delta = graph.Delta(pairs.limit(0), spark.createDataFrame([(1, "a"), (9, "a")], "file_id long, tag_id string"))
    out = graph.with_delta(pairs, delta)
    assert sorted(map(tuple, out.collect())) == [(1, "b"), (2, "a")]
    assert "LeftSemi" in out._jdf.queryExecution().optimizedPlan().toString()


def test_counts_follow_without_a_look_at_all_pairs_unless_a_list_runs_empty(spark):
    files = spark.createDataFrame([(1, 10, 1), (2, 20, 2)], "file_id long, size long, date_created int")
    wide = spark.createDataFrame([(1, "a"), (2, "a")], "file_id long, tag_id string")
    state = rollups.rollup_state(spark.createDataFrame([("a",)], "tag_id string"), wide, files)
    never = wide.where(F.raise_error(F.lit("all pairs were read")).isNull())
    out = rollups.rolled(state, graph.Delta(wide.limit(0), wide.where("file_id = 1")), files, files, never)
    assert [tuple(r) for r in rollups.rollup_of(out).collect()] == [("a", 1, 20, 2)]


def test_counts_for_some_tags_ancestors_need_their_pairs_only(spark):
    closed = spark.createDataFrame([("a", "a", 0), ("a", "t", 1), ("b", "t", 1), ("b", "u", 1), ("t", "t", 0)], "tag string, ancestor string, depth int")
    assert {tuple(r)[:2] for r in graph.leading_where(closed, ["a"]).collect()} == {("a", "t"), ("b", "t"), ("t", "t")}
