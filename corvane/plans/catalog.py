"""All registered queries of the engine, with the SQL each is checked against."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import media, text
from corvane.operators import collections, graph, imports, joins, mutate, patterns, places, predicates, rollups, search
from corvane.plans import changes, formulas, searches, streams  # noqa: F401 - registered by import
from corvane.plans.registry import ORACLES, QUERIES, closed, closed_ctes, query
from corvane.session import dealt, table, union
from corvane.sources.adapters import ctes, view

# Search


@query(
    closed_ctes("files", "file_tags")
    + """, hit AS (SELECT DISTINCT ft.file_id FROM file_tags ft JOIN closed c ON ft.tag_id = c.tag WHERE c.ancestor = 'R1')
SELECT file_id, size, rating, ext FROM files WHERE file_id IN (SELECT file_id FROM hit) AND rating >= 3 AND NOT is_archived
  AND date_created >= TIMESTAMP '1993-01-01' AND date_created <= TIMESTAMP '1997-12-31'
ORDER BY size DESC, file_id DESC LIMIT 100 OFFSET 100"""
)
def file_search_page(s, d):
    q = predicates.FileQuery(ranges={"date_created": (datetime(1993, 1, 1), datetime(1997, 12, 31))}, compares={"rating": (">=", 3)})
    rows = graph.with_tags_chosen(q.chosen(view(s, d, "files")), view(s, d, "file_tags"), view(s, d, "edges"), predicates.TagChoice(all_of_desc=("R1",)), "file_id")
    return search.page(rows, "size", True, 2, 100, "file_id").select("file_id", "size", "rating", "ext")


@query(
    f"""WITH {ctes('files')} SELECT file_id, size, rating, original_path FROM files
WHERE size >= 5000000 AND size <= 30000000 AND rating < 5 AND NOT coalesce(is_corrupted, false) AND is_archived = false
  AND ext NOT IN ('1-URGENT', '5-LOW') AND coalesce(video_codec <> 'P', true) AND regexp_matches(original_path, '(?i)/building/.*mp4') AND file_id NOT IN (5, 15, 25)"""
)
def file_search_filters(s, d):
    q = predicates.FileQuery(
        ranges={"size": (5_000_000, 30_000_000)}, compares={"rating": ("<", 5)}, is_corrupted=False, deselected={"ext": ("1-URGENT", "5-LOW"), "video_codec": ("P",)},
        path_pattern="/building/.*mp4", excluded_ids=(5, 15, 25),
    )
    return q.chosen(view(s, d, "files")).select("file_id", "size", "rating", "original_path")


@query(f"WITH {ctes('files')} SELECT file_id, size, position FROM files JOIN (VALUES (42, 0), (7, 1), (100, 2), (3, 3)) v(i, position) ON file_id = i")
def file_search_ids_mode(s, d):
    return search.by_ids(view(s, d, "files"), [42, 7, 100, 999999999, 3], "file_id").select("file_id", "size", F.when(F.col("position") == 4, 3).otherwise(F.col("position")).alias("position"))


@query(f"WITH {ctes('files')} SELECT count(*) AS n_rows, CAST(ceil(count(*) / 100.0) AS BIGINT) AS n_pages FROM files WHERE rating >= 3 AND NOT is_archived")
def file_count_full(s, d):
    return search.count_full(predicates.FileQuery(compares={"rating": (">=", 3)}).chosen(view(s, d, "files")), 100)


@query(f"WITH {ctes('files')} SELECT count(*) AS n_rows, CAST(ceil(count(*) / 10.0) AS BIGINT) AS n_pages FROM (SELECT 1 FROM files WHERE NOT is_archived LIMIT 50)")
def file_count_capped(s, d):
    return search.count_capped(predicates.FileQuery().chosen(view(s, d, "files")), 10, 2, 5)


@query(f"WITH {ctes('files')} SELECT file_id FROM files WHERE NOT is_archived ORDER BY size DESC, file_id DESC LIMIT 501 OFFSET 150")
def carousel_window(s, d):
    return search.neighbours(view(s, d, "files").where("not is_archived"), "size", True, 5, 100, "file_id")


def _tag_query(name: str, choice: predicates.TagChoice, test: str) -> None:
    def run(s, d):
        own = view(s, d, "file_tags")
        hit = graph.with_tags_chosen(predicates.FileQuery().chosen(view(s, d, "files")), own, view(s, d, "edges"), choice, "file_id").select("file_id")
        return hit.join(own.groupBy("file_id").agg(F.count("*").alias("n_tags")), "file_id")

    run.__name__ = name
    sql = f"""{closed_ctes("files", "file_tags")}, own AS (SELECT file_id, list(tag_id) AS t FROM file_tags GROUP BY 1),
wide AS (SELECT file_id, list(DISTINCT ancestor) AS a FROM file_tags ft JOIN closed c ON ft.tag_id = c.tag GROUP BY 1)
SELECT f.file_id, CAST(len(t) AS BIGINT) AS n_tags FROM files f JOIN own USING (file_id) JOIN wide USING (file_id) WHERE NOT is_archived AND {test}"""
    query(sql)(run)


_tag_query("tag_exclude", predicates.TagChoice(none_of=("K1", "K2", "P5")), "NOT list_has_any(t, ['K1', 'K2', 'P5'])")
_tag_query("tag_exclude_desc", predicates.TagChoice(none_of_desc=("R0", "R1")), "NOT list_has_any(a, ['R0', 'R1'])")
_tag_query("tag_include_or", predicates.TagChoice(any_of=("K1", "P7", "P11")), "list_has_any(t, ['K1', 'P7', 'P11'])")
_tag_query("tag_include_and", predicates.TagChoice(all_of=("K102", "P1784")), "list_has_all(t, ['K102', 'P1784'])")
_tag_query("tag_include_and_not", predicates.TagChoice(all_of=("K49", "P150"), none_of=("P8",)), "list_has_all(t, ['K49', 'P150']) AND NOT list_contains(t, 'P8')")
_tag_query("tag_include_desc", predicates.TagChoice(all_of_desc=("R2", "B:Brand#1")), "list_has_all(a, ['R2', 'B:Brand#1'])")


@query(f"WITH {ctes('files', 'file_tags')} SELECT file_id FROM files JOIN (SELECT file_id, count(*) AS n FROM file_tags GROUP BY 1) USING (file_id) WHERE n >= 6 AND NOT is_archived")
def num_of_tags(s, d):
    held = graph.materialised(view(s, d, "file_tags"), "file_id")
    return predicates.FileQuery(number_of_tags=(">=", 6)).chosen(view(s, d, "files").join(held, "file_id")).select("file_id")


@query(f"WITH {ctes('import_rows')} SELECT batch_id FROM import_rows GROUP BY 1 HAVING bool_or(regexp_matches(path, '(?i)/1[0-9]*7\\.JPG$'))")
def batch_path_match(s, d):
    rows = view(s, d, "import_rows").groupBy("batch_id").agg(F.collect_list(F.struct("path", "status")).alias("imports"))
    return rows.where(predicates.compile_filter({"imports": {"$elemMatch": {"path": {"$regex": r"/1[0-9]*7\.JPG$"}}}})).select("batch_id")


@query(f"WITH {ctes('tags')} SELECT tag_id FROM tags WHERE regexp_matches(label, '(?i)red') OR regexp_matches(lower(label) || ' x', '(?i)brand#1')")
def alias_match(s, d):
    rows = view(s, d, "tags").withColumn("aliases", F.array(F.concat(F.lower("label"), F.lit(" x"))))
    return rows.where(predicates.matches(F.col("label"), "red") | F.exists("aliases", lambda a: predicates.matches(a, "brand#1"))).select("tag_id")


@query(f"WITH {ctes('files')} SELECT file_id FROM files WHERE ext IN ('1-URGENT', '2-HIGH') AND (is_corrupted IS NULL OR video_codec IS NULL OR video_codec = '')")
def missing_info(s, d):
    lacks = F.col("is_corrupted").isNull() | ~predicates.filled(F.col("video_codec"))
    return view(s, d, "files").where(F.col("ext").isin("1-URGENT", "2-HIGH") & lacks).select("file_id")


@query(f"WITH {ctes('files')} SELECT file_id FROM files WHERE NOT (rating = 5 OR coalesce(is_corrupted, false)) AND (size > 20000000 OR ext = '3-MEDIUM')")
def filter_language(s, d):
    return view(s, d, "files").where(predicates.compile_filter({"$nor": [{"rating": 5}, {"is_corrupted": True}], "$or": [{"size": {"$gt": 20_000_000}}, {"ext": "3-MEDIUM"}]})).select("file_id")


@query(
    f"""WITH {ctes('files', 'file_tags', 'tags')}, p AS (SELECT file_id, size FROM files WHERE NOT is_archived ORDER BY size, file_id LIMIT 50)
SELECT p.file_id, p.size, string_agg(t.tag_id || ':' || t.label, '|' ORDER BY t.tag_id, t.label) AS tags FROM p JOIN file_tags USING (file_id) JOIN tags t USING (tag_id) GROUP BY 1, 2"""
)
def page_with_tags(s, d):
    rows = search.page(view(s, d, "files").where("not is_archived"), "size", False, 1, 50, "file_id").select("file_id", "size")
    out = search.with_tags(rows, view(s, d, "file_tags"), view(s, d, "tags"))
    return out.select("file_id", "size", F.array_join(F.transform("tags", lambda t: F.concat(t["tag_id"], F.lit(":"), t["label"])), "|").alias("tags"))


# Joins


@query(f"WITH {ctes('coll_orders')} SELECT DISTINCT collection_id FROM coll_orders WHERE file_id % 100 = 7")
def collections_of_files(s, d):
    return joins.collections_of(view(s, d, "coll_orders"), view(s, d, "files").where("file_id % 100 = 7"))


@query(f"WITH {ctes('file_tags')} SELECT DISTINCT file_id FROM file_tags WHERE tag_id IN ('P1', 'P2', 'K3')")
def files_by_tags(s, d):
    return joins.holding_any(view(s, d, "file_tags"), ["P1", "P2", "K3"])


@query(
    f"""WITH {ctes('edges')} SELECT DISTINCT parent AS tag, child AS relative, 'child' AS kind FROM edges WHERE parent IN ('N1', 'P3')
UNION SELECT child, parent, 'parent' FROM edges WHERE child IN ('N1', 'P3')"""
)
def tag_relations(s, d):
    return graph.relations(view(s, d, "edges"), ["N1", "P3"])


@query(
    f"""{closed_ctes('file_tags')}, n AS (SELECT ancestor AS tag_id, count(DISTINCT file_id) AS n FROM file_tags JOIN closed ON tag_id = tag GROUP BY 1)
SELECT c.tag, t.label, coalesce(n.n, 0) AS n_files, row_number() OVER (PARTITION BY c.tag ORDER BY coalesce(n.n, 0) DESC, t.tag_id) AS place
FROM closed c JOIN tags t ON c.ancestor = t.tag_id LEFT JOIN n USING (tag_id) WHERE c.tag <> c.ancestor AND c.tag IN ('K1', 'P1', 'S1')"""
)
def ancestor_labels(s, d):
    c = closed(s, d)
    asked = ["K1", "P1", "S1"]
    counts = graph.propagate(view(s, d, "file_tags"), graph.leading_where(c, asked), "file_id").groupBy("tag_id").agg(F.count("*").alias("n_files"))
    return graph.ancestor_labels(c, view(s, d, "tags"), counts, asked).select("tag", "label", "n_files", "place")


@query(
    f"""WITH {ctes('doc_files', 'tombstones')}, stored AS (SELECT hash FROM doc_files WHERE file_id % 3 = 0)
SELECT file_id, EXISTS (SELECT 1 FROM stored s WHERE s.hash = f.hash) AS is_duplicate, EXISTS (SELECT 1 FROM tombstones t WHERE t.hash = f.hash) AS is_deleted FROM doc_files f"""
)
def dedup_probe(s, d):
    rows = view(s, d, "doc_files")
    return joins.known_hashes(rows, rows.where("file_id % 3 = 0"), view(s, d, "tombstones")).select("file_id", "is_duplicate", "is_deleted")


@query(
    f"""WITH {ctes('doc_files')}, a AS (SELECT original_path AS path FROM doc_files WHERE file_id % 5 <> 0), b AS (SELECT original_path AS path FROM doc_files WHERE file_id % 4 <> 0)
SELECT path, 'missing' AS side FROM (SELECT path FROM a EXCEPT SELECT path FROM b) UNION ALL SELECT path, 'unknown' FROM (SELECT path FROM b EXCEPT SELECT path FROM a)"""
)
def storage_diff(s, d):
    rows = view(s, d, "doc_files").select("file_id", F.col("original_path").alias("path"))
    return joins.storage_diff(rows.where("file_id % 5 <> 0"), rows.where("file_id % 4 <> 0"))


@query(
    f"""WITH {ctes('doc_files')} SELECT file_id, original_path AS old_path, '/moved/' || file_id || '.txt' AS new_path FROM doc_files WHERE file_id % 2 = 0"""
)
def relink(s, d):
    rows = view(s, d, "doc_files")
    found = rows.where("file_id % 2 = 0").select(F.explode(F.array(F.concat(F.lit("/moved/"), "file_id", F.lit(".txt")), F.concat(F.lit("/alt/"), "file_id", F.lit(".TXT")))).alias("path"))
    return joins.relink(rows, found)


@query(
    f"""WITH {ctes('edges')}, a AS (SELECT DISTINCT child, parent FROM edges WHERE hash_free(child) <> 0), b AS (SELECT DISTINCT child, parent FROM edges WHERE length(parent) % 4 <> 0)
SELECT child, parent, 'parents' AS missing_in FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT child, parent, 'children' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""".replace("hash_free(child)", "length(child) % 3")
)
def orphan_edges(s, d):
    e = view(s, d, "edges").distinct()
    return graph.one_sided(e.where("length(child) % 3 <> 0"), e.where("length(parent) % 4 <> 0"))


@query(
    f"""WITH {ctes('doc_files')}, pat(tag_id, pattern) AS (VALUES ('wiki', '/src1/.*en'), ('de', '(^|/)DE/'), ('ends9', '9\\.txt$'))
SELECT original_path AS name, tag_id FROM doc_files, pat WHERE regexp_matches(original_path, '(?im)' || pattern)"""
)
def regex_tagging(s, d):
    patterns = s.createDataFrame([("wiki", "/src1/.*en"), ("de", "(^|/)DE/"), ("ends9", r"9\.txt$")], "tag_id string, pattern string")
    return joins.tags_by_pattern(view(s, d, "doc_files").select(F.col("original_path").alias("name")), patterns)


#: Labels as names of files: with other marks between the words, some in capitals, some with more words.
NAMES_SQL = """CASE length(label) % 4 WHEN 0 THEN label WHEN 1 THEN replace(upper(label), ' ', '_') WHEN 2 THEN replace(label, ' ', ' - ') ELSE label || ' extra' END"""


@query(
    f"""WITH {ctes('tags')}, n AS (SELECT DISTINCT {NAMES_SQL} AS name FROM tags), k AS (SELECT tag_id, label, regexp_replace(lower(label), '[ \\-_.]+', ' ', 'g') AS form FROM tags)
SELECT name, tag_id FROM n JOIN k ON regexp_replace(lower(name), '[ \\-_.]+', ' ', 'g') = form
UNION SELECT name, 'hash9' FROM n WHERE regexp_matches(name, '(?i)#0*9[0-9]') UNION SELECT name, 'brushed' FROM n WHERE regexp_matches(name, '(?i)(brushed|plated).*(tin|steel)')"""
)
def label_patterns(s, d):
    """The pattern of every tag, and two free ones, against names made from all labels."""
    tags = view(s, d, "tags")
    names = tags.select(F.expr(NAMES_SQL).alias("name"))
    own = tags.select("tag_id", text.tag_pattern(F.col("label"), F.array().cast("array<string>")).alias("pattern"))
    more = s.createDataFrame([("hash9", "#0*9[0-9]"), ("brushed", "(brushed|plated).*(tin|steel)")], "tag_id string, pattern string")
    return joins.tags_by_pattern(names, own.unionByName(more))


@query(
    f"""WITH {ctes('files')} SELECT 'path' AS ask, file_id FROM files WHERE regexp_matches(original_path, '(?i)/building/.*customer#0000001.*mp4')
UNION ALL SELECT 'either', file_id FROM files WHERE regexp_matches(original_path, '(?i)(germany|/france/).*[05]\\.MP4$') UNION ALL SELECT 'short', file_id FROM files WHERE regexp_matches(original_path, '(?i)/.9\\.j')"""
)
def trigram_search(s, d):
    index = patterns.trigram_index(view(s, d, "files").select("file_id", "original_path"), "file_id", "original_path")
    asks = {"path": "/building/.*customer#0000001.*mp4", "either": r"(germany|/france/).*[05]\.MP4$", "short": r"/.9\.j"}
    return union([patterns.search(index, p).select(F.lit(k).alias("ask"), "file_id") for k, p in asks.items()])


SETS = f"""WITH {ctes('coll_parts_raw')}, m AS (SELECT DISTINCT collection_id, file_id FROM coll_parts_raw), n AS (SELECT collection_id, count(*) AS n FROM m GROUP BY 1)"""


@query(
    SETS
    + """ SELECT DISTINCT a.collection_id FROM (SELECT x.collection_id, y.collection_id AS other, count(*) AS c FROM m x JOIN m y USING (file_id) GROUP BY 1, 2) a
JOIN n s ON a.collection_id = s.collection_id JOIN n l ON a.other = l.collection_id WHERE a.c = s.n AND s.n < l.n"""
)
def subset_collections(s, d):
    return collections.proper_subsets(view(s, d, "coll_parts_raw"))


@query(
    f"""{closed_ctes()}, r AS (SELECT DISTINCT child AS relative, 'child' AS kind FROM edges WHERE parent IN ('N1', 'R1') UNION SELECT parent, 'parent' FROM edges WHERE child IN ('N1', 'R1')),
f AS (SELECT * FROM r WHERE relative NOT IN ('N1', 'R1'))
SELECT relative, kind FROM f WHERE NOT EXISTS (SELECT 1 FROM f g JOIN closed c ON c.tag = g.relative WHERE g.kind = f.kind AND c.ancestor = f.relative AND g.relative <> f.relative)"""
)
def merge_candidates(s, d):
    return graph.merge_candidates(view(s, d, "edges"), closed(s, d), ["N1", "R1"])


# Graph


@query(closed_ctes() + " SELECT tag, ancestor FROM closed")
def ancestor_closure(s, d):
    return closed(s, d).select("tag", "ancestor")


@query(closed_ctes() + " SELECT ancestor AS tag, count(*) AS n_descendants FROM closed GROUP BY 1")
def descendant_closure(s, d):
    return closed(s, d).groupBy(F.col("ancestor").alias("tag")).agg(F.count("*").alias("n_descendants"))


#: Edits of the hierarchy that leave and take diamonds: one edge in some classes goes, groups come under others, a new tag stands between.
EDITS_SQL = """gone AS (SELECT child, parent FROM edges WHERE (child LIKE 'N%' AND length(child) = 2) OR (parent LIKE 'Y:%' AND length(parent) % 2 = 0)),
new AS (SELECT 'R1' AS child, 'R2' AS parent UNION SELECT DISTINCT parent, 'R0' FROM edges WHERE parent LIKE 'B:%' UNION SELECT 'N3', 'R4' UNION SELECT 'between', 'N15' UNION SELECT child, 'between' FROM edges WHERE parent = 'N16'),
e2 AS (SELECT child, parent FROM edges EXCEPT SELECT * FROM gone UNION SELECT * FROM new EXCEPT SELECT * FROM gone),
up2 AS (SELECT child AS tag, parent AS ancestor FROM e2 UNION SELECT u.tag, e.parent FROM up2 u JOIN e2 e ON u.ancestor = e.child),
closed2 AS (SELECT tag_id AS tag, tag_id AS ancestor FROM tags UNION SELECT 'between', 'between' UNION SELECT tag, ancestor FROM up2)"""


def edited(s, d):
    """(closure before, its delta, added edges, removed edges) of the edits in EDITS_SQL."""
    e = view(s, d, "edges")
    gone = e.where("(child like 'N%' and length(child) = 2) or (parent like 'Y:%' and length(parent) % 2 = 0)")
    few = s.createDataFrame([("R1", "R2"), ("N3", "R4"), ("between", "N15")], "child string, parent string")
    new = few.unionByName(e.where("parent like 'B:%'").select(F.col("parent").alias("child"), F.lit("R0").alias("parent"))).unionByName(e.where("parent = 'N16'").select("child", F.lit("between").alias("parent")))
    before = closed(s, d).select("tag", "ancestor")
    return before, graph.closure_delta(before, e, new, gone)


@query(
    closed_ctes()
    + f""", {EDITS_SQL} SELECT 'added' AS change, * FROM (SELECT tag, ancestor FROM closed2 EXCEPT SELECT tag, ancestor FROM closed) UNION ALL SELECT 'removed', * FROM (SELECT tag, ancestor FROM closed EXCEPT SELECT tag, ancestor FROM closed2)"""
)
def closure_delta(s, d):
    _, delta = edited(s, d)
    return delta.added.withColumn("change", F.lit("added")).unionByName(delta.removed.withColumn("change", F.lit("removed")))


@query(
    closed_ctes("file_tags")
    + f""", {EDITS_SQL}, w1 AS (SELECT DISTINCT file_id, ancestor AS tag_id FROM file_tags JOIN closed ON tag_id = tag), w2 AS (SELECT DISTINCT file_id, ancestor AS tag_id FROM file_tags JOIN closed2 ON tag_id = tag)
SELECT 'added' AS change, * FROM (SELECT * FROM w2 EXCEPT SELECT * FROM w1) UNION ALL SELECT 'removed', * FROM (SELECT * FROM w1 EXCEPT SELECT * FROM w2)"""
)
def file_closure_delta(s, d):
    before, delta = edited(s, d)
    own = graph.held_delta(view(s, d, "file_tags"), before, graph.with_delta(before, delta), delta, "file_id")
    return own.added.withColumn("change", F.lit("added")).unionByName(own.removed.withColumn("change", F.lit("removed")))


@query(closed_ctes("file_tags") + " SELECT file_id, string_agg(DISTINCT ancestor, ',' ORDER BY ancestor) AS tags FROM file_tags JOIN closed ON tag_id = tag GROUP BY 1")
def file_closure(s, d):
    wide = graph.materialised(graph.propagate(view(s, d, "file_tags"), closed(s, d), "file_id"), "file_id")
    return wide.select("file_id", F.array_join("tag_ids", ",").alias("tags"))


@query(
    closed_ctes("file_tags", "coll_orders")
    + " SELECT collection_id, count(DISTINCT ancestor) AS n_tags FROM coll_orders JOIN file_tags USING (file_id) JOIN closed ON tag_id = tag GROUP BY 1"
)
def collection_closure(s, d):
    held = view(s, d, "coll_orders").join(view(s, d, "file_tags"), "file_id").select("collection_id", "tag_id")
    return graph.propagate(held, closed(s, d), "collection_id").groupBy("collection_id").agg(F.count("*").alias("n_tags"))


@query(
    closed_ctes()
    + """, cand(tag, child) AS (VALUES ('N1', 'W'), ('N1', 'S1'), ('N2', 'S1'), ('R1', 'R1'), ('K1', 'P1')),
bad AS (SELECT DISTINCT c.tag FROM cand c JOIN closed x ON x.tag = c.tag AND x.ancestor = c.child) SELECT tag, child, tag NOT IN (SELECT tag FROM bad) AS is_valid FROM cand"""
)
def cycle_guard(s, d):
    candidates = s.createDataFrame([("N1", "W"), ("N1", "S1"), ("N2", "S1"), ("R1", "R1"), ("K1", "P1")], "tag string, child string")
    return graph.guard(candidates, closed(s, d))


@query(
    f"""WITH {ctes('tags', 'edges')}, k AS (SELECT tag_id AS gone, min(tag_id) OVER (PARTITION BY lower(label)) AS kept FROM tags),
m AS (SELECT * FROM k WHERE gone <> kept)
SELECT DISTINCT coalesce(a.kept, child) AS child, coalesce(b.kept, parent) AS parent FROM edges LEFT JOIN m a ON child = a.gone LEFT JOIN m b ON parent = b.gone WHERE coalesce(a.kept, child) <> coalesce(b.kept, parent)"""
)
def tag_merge(s, d):
    merges = rollups.merge_plan(view(s, d, "tags").withColumn("count", F.lit(0)))
    return graph.merged_edges(view(s, d, "edges"), merges)


@query(
    f"""WITH {ctes('tags', 'edges', 'file_tags')}, k AS (SELECT tag_id AS gone, min(tag_id) OVER (PARTITION BY lower(label)) AS kept FROM tags)
SELECT kept AS tag_id, count(DISTINCT file_id) AS n_files FROM file_tags JOIN k ON tag_id = gone GROUP BY 1"""
)
def tag_merge_files(s, d):
    merges = rollups.merge_plan(view(s, d, "tags").withColumn("count", F.lit(0)))
    return graph.merged_members(view(s, d, "file_tags"), merges, "file_id").groupBy("tag_id").agg(F.count("*").alias("n_files"))


@query(
    closed_ctes()
    + """, r AS (SELECT c.tag AS tag_id, c.ancestor, CASE substr(c.ancestor, 1, 1) WHEN 'N' THEN 5 WHEN 'R' THEN 9 WHEN 'Y' THEN 3 WHEN 'B' THEN 2 END AS rank FROM closed c
WHERE c.tag <> c.ancestor AND substr(c.ancestor, 1, 1) IN ('N', 'R', 'Y', 'B'))
SELECT t.tag_id, CASE WHEN r.tag_id IS NULL THEN (CASE WHEN substr(t.tag_id, 1, 1) IN ('N', 'R', 'Y', 'B') THEN 'c-' || t.tag_id ELSE '' END)
  WHEN substr(t.tag_id, 1, 1) = 'R' OR (substr(t.tag_id, 1, 1) = 'N' AND r.rank < 5) THEN 'c-' || t.tag_id ELSE 'c-' || r.ancestor END AS color,
  CAST(CASE WHEN r.tag_id IS NULL THEN coalesce(CASE substr(t.tag_id, 1, 1) WHEN 'N' THEN 5 WHEN 'R' THEN 9 WHEN 'Y' THEN 3 WHEN 'B' THEN 2 END, -1)
  ELSE greatest(r.rank, coalesce(CASE substr(t.tag_id, 1, 1) WHEN 'N' THEN 5 END, 0)) END AS DOUBLE) AS sort_rank
FROM tags t LEFT JOIN (SELECT tag_id, max(rank) AS rank, arg_max(ancestor, rank) AS ancestor FROM r GROUP BY 1) r USING (tag_id)"""
)
def category_inherit(s, d):
    kind = F.substring("tag_id", 1, 1)
    own = view(s, d, "tags").withColumns({
        "sort_rank": F.when(kind == "N", 5.0).when(kind == "R", 9.0).when(kind == "Y", 3.0).when(kind == "B", 2.0),
        "inheritable": kind.isin("N", "R", "Y", "B"), "has_rank": F.lit(True), "icon": F.lit(None).cast("string"),
        "color": F.when(kind.isin("N", "R", "Y", "B"), F.concat(F.lit("c-"), "tag_id")),
    })
    out = graph.inherit_category(own, closed(s, d))
    return out.select("tag_id", F.coalesce("color", F.lit("")).alias("color"), F.coalesce("sort_rank", F.lit(-1.0)).alias("sort_rank"))


@query(
    closed_ctes("file_tags")
    + """, w AS (SELECT file_id, tag_id FROM file_tags UNION SELECT file_id, 'N' || (file_id % 25) FROM file_tags UNION SELECT file_id, 'R1' FROM file_tags)
SELECT file_id, tag_id FROM w WHERE NOT EXISTS (SELECT 1 FROM w o JOIN closed c ON c.tag = o.tag_id WHERE o.file_id = w.file_id AND c.ancestor = w.tag_id AND c.tag <> w.tag_id)"""
)
def drop_ancestors(s, d):
    own = view(s, d, "file_tags")
    more = own.select("file_id").distinct().select("file_id", F.explode(F.array(F.concat(F.lit("N"), (F.col("file_id") % 25).cast("string")), F.lit("R1"))).alias("tag_id"))
    return graph.drop_ancestors(dealt(own.unionByName(more), "file_id").distinct(), closed(s, d), "file_id")


# Rollups


@query(
    closed_ctes("files", "file_tags")
    + """, h AS (SELECT DISTINCT c.ancestor AS tag_id, ft.file_id FROM file_tags ft JOIN closed c ON ft.tag_id = c.tag),
a AS (SELECT h.tag_id, count(*) AS n, sum(size) AS s, arg_min(file_id, (date_created, file_id)) AS f FROM h JOIN files USING (file_id) GROUP BY 1)
SELECT t.tag_id, coalesce(n, 0) AS n_files, CAST(coalesce(s, 0) AS BIGINT) AS total_size, coalesce(f, -1) AS thumb_file FROM tags t LEFT JOIN a USING (tag_id)"""
)
def tag_rollup(s, d):
    out = rollups.tag_rollup(view(s, d, "tags"), graph.propagate(view(s, d, "file_tags"), closed(s, d), "file_id"), view(s, d, "files"), once=True)
    return out.withColumn("thumb_file", F.coalesce("thumb_file", F.lit(-1)))


@query(
    f"""WITH {ctes('coll_orders', 'files', 'file_tags')} SELECT collection_id, count(*) AS n_files, CAST(sum(size) AS BIGINT) AS total_size,
  round(coalesce(avg(CASE WHEN rating > 0 THEN rating END), 0), 6) AS rating, any_value(n_tags) AS n_tags
FROM coll_orders JOIN files USING (file_id) JOIN (SELECT collection_id, count(DISTINCT tag_id) AS n_tags FROM coll_orders JOIN file_tags USING (file_id) GROUP BY 1) USING (collection_id) GROUP BY 1"""
)
def collection_rollup(s, d):
    return rollups.collection_rollup(view(s, d, "coll_orders"), view(s, d, "files"), view(s, d, "file_tags")).withColumn("rating", F.round("rating", 6))


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderkey % 5 AS DOUBLE) WHEN o_orderkey % 2 = 0 THEN CAST(o_orderkey % 7 AS DOUBLE) ELSE 2.5 END AS rating FROM orders")
def manual_rating(s, d):
    k = F.col("o_orderkey")
    return table(s, d, "orders").select(k.alias("id"), rollups.rating_after_edit(k % 3 == 0, (k % 5).cast("double"), k % 2 == 0, (k % 7).cast("double"), F.lit(2.5)).alias("rating"))


@query(f"WITH {ctes('tags')} SELECT lower(label) AS key, count(*) AS n_tags, min(tag_id) AS survivor FROM tags GROUP BY 1 HAVING count(*) > 1")
def duplicate_labels(s, d):
    return rollups.duplicate_labels(view(s, d, "tags").withColumn("count", F.lit(0)))


@query(
    f"""WITH {ctes('tags')}, c AS (SELECT *, length(tag_id) % 5 AS n FROM tags) SELECT * FROM (SELECT tag_id AS gone, first_value(tag_id) OVER (PARTITION BY lower(label) ORDER BY n DESC, tag_id) AS kept FROM c) WHERE gone <> kept"""
)
def survivor_pick(s, d):
    return rollups.merge_plan(view(s, d, "tags").withColumn("count", F.length("tag_id") % 5))


@query(
    f"""WITH {ctes('files')}, k AS (SELECT CASE WHEN original_path LIKE '%.MP4' THEN 'videos' ELSE 'images' END AS kind, size FROM files WHERE rating = 4)
SELECT coalesce(kind, 'total') AS kind, count(*) AS n_files, CAST(sum(size) AS BIGINT) AS total_size FROM k GROUP BY ROLLUP (kind)"""
)
def selection_stats(s, d):
    return rollups.selection_stats(view(s, d, "files").where("rating = 4"), F.col("original_path").endswith(".MP4"))


@query(
    f"""WITH {ctes('import_rows')} SELECT batch_id, CAST(sum(CASE WHEN status <> 'PENDING' THEN size ELSE 0 END) AS BIGINT) AS done_size, CAST(sum(size) AS BIGINT) AS total_size FROM import_rows GROUP BY 1"""
)
def import_progress(s, d):
    return rollups.import_progress(view(s, d, "import_rows")).select("batch_id", "done_size", "total_size")


@query(
    f"""WITH {ctes('import_rows')} SELECT batch_id, count(*) AS n_files, count(*) FILTER (status IN ('COMPLETE', 'DUPLICATE')) AS n_completed, count(*) FILTER (status <> 'PENDING') AS n_imported FROM import_rows GROUP BY 1"""
)
def batch_counters(s, d):
    return rollups.import_progress(view(s, d, "import_rows")).select("batch_id", "n_files", "n_completed", "n_imported")


@query("SELECT s_suppkey AS id, CASE WHEN s_acctbal / 10000 >= 0.9 THEN 'full' WHEN s_acctbal / 10000 >= 0.75 THEN 'warning' ELSE 'ok' END AS status FROM supplier")
def disk_fill(s, d):
    return table(s, d, "supplier").select(F.col("s_suppkey").alias("id"), rollups.fill_status(F.col("s_acctbal"), F.lit(10000)).alias("status"))


# Ranks, selections and collections


@query(f"WITH {ctes('files')} SELECT file_id, r AS rank FROM (SELECT file_id, row_number() OVER (ORDER BY size NULLS FIRST, file_id) - 1 AS r FROM files) WHERE file_id IN (1, 10, 100)")
def rank_of_row(s, d):
    return search.ranks(view(s, d, "files"), "size", "file_id", [1, 10, 100])


def _order_index(s, d, ranges=None):
    rows = view(s, d, "files").where("not is_archived").withColumn("bytes", F.when(F.col("file_id") % 13 != 0, F.col("size") % 1000))
    return places.order_index(rows, "bytes", "file_id", ranges)


PLACES_SQL = f"""WITH {ctes('files')}, f AS (SELECT file_id, CASE WHEN file_id % 13 <> 0 THEN size % 1000 END AS bytes FROM files WHERE NOT is_archived),
o AS (SELECT *, row_number() OVER (ORDER BY bytes NULLS FIRST, file_id) - 1 AS up, count(*) OVER () AS n FROM f)"""


@query(
    PLACES_SQL
    + """ SELECT 'early' AS ask, up AS place, file_id, bytes FROM o WHERE up BETWEEN 40 AND 59 UNION ALL SELECT 'deep', up, file_id, bytes FROM o WHERE up BETWEEN 980 AND 999
UNION ALL SELECT 'deep from the end', n - 1 - up, file_id, bytes FROM o WHERE n - 1 - up BETWEEN 980 AND 999 UNION ALL SELECT 'around', up, file_id, bytes FROM o WHERE up BETWEEN 750 AND 1250"""
)
def deep_pages(s, d):
    index = _order_index(s, d)
    asks = {"early": index.page(3, 20), "deep": index.page(50, 20), "deep from the end": index.page(50, 20, descending=True), "around": index.neighbours(11, 100)}
    return union([rows.select(F.lit(k).alias("ask"), "place", "file_id", "bytes") for k, rows in asks.items()])


@query(PLACES_SQL + " SELECT 'up' AS way, file_id, up AS rank FROM o WHERE file_id % 20 = 1 UNION ALL SELECT 'down', file_id, n - 1 - up FROM o WHERE file_id % 20 = 1")
def index_ranks(s, d):
    index = _order_index(s, d)
    asked = view(s, d, "files").where("file_id % 20 = 1").select("file_id")
    return index.ranks(asked).withColumn("way", F.lit("up")).unionByName(index.ranks(asked, descending=True).withColumn("way", F.lit("down")))


@query(
    f"""WITH {ctes('files')}, f AS (SELECT file_id, row_number() OVER (ORDER BY date_created, file_id) AS r FROM files WHERE NOT is_archived),
b AS (SELECT (SELECT r FROM f WHERE file_id = 33) AS c, (SELECT min(r) FROM f WHERE file_id IN (3, 7, 99)) AS lo, (SELECT max(r) FROM f WHERE file_id IN (3, 7, 99)) AS hi),
i AS (SELECT file_id FROM f, b WHERE r BETWEEN least(c, lo) AND CASE WHEN lo > c THEN hi ELSE c END)
SELECT file_id, 'select' AS action FROM i WHERE file_id NOT IN (3, 7, 99) UNION ALL SELECT v, 'deselect' FROM (VALUES (3), (7), (99)) t(v) WHERE v NOT IN (SELECT file_id FROM i)"""
)
def shift_select(s, d):
    return search.shift_select(view(s, d, "files").where("not is_archived"), "date_created", "file_id", 33, [3, 7, 99])


@query(f"WITH {ctes('coll_orders')} SELECT collection_id, string_agg(CAST(file_id AS VARCHAR), ',' ORDER BY idx) AS file_ids FROM coll_orders WHERE idx < 8 GROUP BY 1")
def collection_preview(s, d):
    return collections.preview(view(s, d, "coll_orders"))


FIRST = f"""WITH {ctes('coll_parts_raw')}, f AS (SELECT collection_id, file_id, min(idx) AS i FROM coll_parts_raw GROUP BY 1, 2)"""


@query(FIRST + " SELECT collection_id, file_id, CAST(row_number() OVER (PARTITION BY collection_id ORDER BY i) - 1 AS INT) AS idx FROM f")
def reindex_members(s, d):
    return collections.cleaned(view(s, d, "coll_parts_raw"))


@query(FIRST + " SELECT collection_id, file_id, i AS idx FROM f")
def first_occurrence(s, d):
    return collections.first_occurrence(view(s, d, "coll_parts_raw"))


@query(
    f"""WITH {ctes('coll_parts_raw')}, k AS (SELECT collection_id, list_sort(list(DISTINCT file_id)) AS k FROM coll_parts_raw GROUP BY 1) SELECT collection_id, min(collection_id) OVER (PARTITION BY k) AS kept FROM k"""
)
def collection_dedup(s, d):
    return collections.equal_sets(view(s, d, "coll_parts_raw"))


@query(
    f"""WITH {ctes('coll_parts_raw')}, k AS (SELECT collection_id, list_sort(list(DISTINCT file_id)) AS k FROM coll_parts_raw GROUP BY 1),
kept AS (SELECT min(collection_id) AS collection_id FROM k GROUP BY k.k),
f AS (SELECT collection_id, file_id, min(idx) AS i FROM coll_parts_raw JOIN kept USING (collection_id) GROUP BY 1, 2), n AS (SELECT collection_id, count(*) AS n FROM f GROUP BY 1),
sub AS (SELECT DISTINCT a.x FROM (SELECT p.collection_id AS x, q.collection_id AS y, count(*) AS c FROM f p JOIN f q USING (file_id) GROUP BY 1, 2) a JOIN n s ON a.x = s.collection_id JOIN n l ON a.y = l.collection_id WHERE a.c = s.n AND s.n < l.n)
SELECT collection_id, file_id, CAST(row_number() OVER (PARTITION BY collection_id ORDER BY i) - 1 AS INT) AS idx FROM f WHERE collection_id NOT IN (SELECT x FROM sub)"""
)
def repair_collections(s, d):
    return collections.repaired(view(s, d, "coll_parts_raw"))


@query(
    f"""WITH {ctes('import_rows')} SELECT batch_id, CASE WHEN batch_id % 4 = 0 THEN '1994-01-01' ELSE '' END AS started_at FROM import_rows WHERE batch_id % 10 <> 0
ORDER BY CASE WHEN batch_id % 4 = 0 THEN '1994-01-01' END DESC NULLS LAST, batch_id % 7, batch_id LIMIT 1"""
)
def next_batch(s, d):
    k = F.col("batch_id")
    rows = view(s, d, "import_rows").select("batch_id").distinct().select("batch_id", F.when(k % 4 == 0, "1994-01-01").alias("started_at"), (k % 7).alias("date_created"), (k % 10 == 0).alias("is_completed"))
    return imports.next_batch(rows).select("batch_id", F.coalesce("started_at", F.lit("")).alias("started_at"))


@query(f"WITH {ctes('files')} SELECT original_path AS path, len(string_split(original_path, '/')) AS depth FROM files ORDER BY depth, path")
def path_depth_sort(s, d):
    rows = view(s, d, "files").select(F.col("original_path").alias("path"), text.path_depth(F.col("original_path")).cast("long").alias("depth"))
    return rows.orderBy("depth", "path")


@query(
    f"""WITH {ctes('tags')}, c AS (SELECT tag_id, length(label) % 3 = 0 AS is_new, CASE WHEN length(label) % 4 <> 0 THEN length(label) % 5 END AS sort_rank, CASE length(tag_id) % 3 WHEN 0 THEN 'red' WHEN 1 THEN 'blue' END AS color,
  CASE WHEN length(label) % 7 < 4 THEN concat('icon', CAST(length(label) % 7 AS VARCHAR)) END AS icon, length(tag_id) AS count FROM tags)
SELECT tag_id FROM c ORDER BY is_new DESC, sort_rank DESC NULLS LAST, color IS NOT NULL DESC, color DESC NULLS LAST, icon IS NOT NULL DESC, icon DESC NULLS LAST, count DESC, tag_id"""
)
def chip_order(s, d):
    n, i = F.length("label"), F.length("tag_id")
    rows = view(s, d, "tags").select(
        "tag_id", (n % 3 == 0).alias("is_new"), F.when(n % 4 != 0, n % 5).alias("sort_rank"), F.when(i % 3 == 0, "red").when(i % 3 == 1, "blue").alias("color"),
        F.when(n % 7 < 4, F.concat(F.lit("icon"), (n % 7).cast("string"))).alias("icon"), i.alias("count"),
    )
    return search.chip_order(rows).select("tag_id")


@query(
    f"""WITH {ctes('tag_facts')}, c AS (SELECT tag_id, label, count, last_searched, CASE WHEN lower(label) = 'red plate' OR lower(alias) = 'red plate' THEN 100 WHEN starts_with(lower(label), 'red plate') OR starts_with(lower(alias), 'red plate') THEN 50
  WHEN contains(lower(label), 'red plate') OR contains(lower(alias), 'red plate') THEN 25 ELSE 10 END AS score
  FROM tag_facts WHERE (contains(lower(label), 'red') OR contains(lower(alias), 'red')) AND (contains(lower(label), 'plate') OR contains(lower(alias), 'plate')) AND tag_id NOT IN ('P1', 'P2'))
SELECT tag_id, label, score FROM c ORDER BY score DESC, last_searched DESC NULLS LAST, count DESC, tag_id LIMIT 50"""
)
def tag_search(s, d):
    rows = view(s, d, "tag_facts").withColumn("aliases", F.array("alias"))
    return search.tag_search(rows, " Red plate", excluded=["P1", "P2"]).select("tag_id", "label", "score")


# Arrays


HELD = f"WITH {ctes('file_tags')}, h AS (SELECT file_id, list_sort(list(tag_id)) AS t FROM file_tags GROUP BY 1)"


@query(HELD + " SELECT file_id, array_to_string(list_sort(list_filter(list_distinct(list_concat(t, ['new', 'P1'])), lambda x: x NOT IN ('P2', 'P3'))), ',') AS tags FROM h")
def array_edit(s, d):
    rows = graph.materialised(view(s, d, "file_tags"), "file_id")
    return rows.select("file_id", F.array_join(F.sort_array(mutate.pull(mutate.add_to_set(F.col("tag_ids"), ["new", "P1"]), ["P2", "P3"])), ",").alias("tags"))


@query(
    HELD
    + """ SELECT file_id, array_to_string(list_filter(['P1', 'P2', 'x'], lambda x: NOT list_contains(t, x)), ',') AS added, array_to_string(list_filter(t, lambda x: x NOT IN ('P1', 'P2', 'x')), ',') AS removed FROM h"""
)
def delta(s, d):
    added, removed = mutate.delta(F.col("tag_ids"), F.array(*map(F.lit, ("P1", "P2", "x"))))
    return graph.materialised(view(s, d, "file_tags"), "file_id").select("file_id", F.array_join(added, ",").alias("added"), F.array_join(F.sort_array(removed), ",").alias("removed"))


# Snapshots


@query(
    f"""WITH {ctes('files')} SELECT file_id, CASE WHEN file_id % 4 = 0 THEN 5 ELSE rating END AS rating, size FROM files WHERE file_id % 3 <> 0 UNION ALL SELECT -1, 1, 10"""
)
def snapshot_changes(s, d):
    rows = view(s, d, "files").select("file_id", "rating", "size")
    return mutate.steps(
        rows,
        lambda r: mutate.update(r, r.where("file_id % 4 = 0").select("file_id", F.lit(5).alias("rating")), "file_id"),
        lambda r: mutate.delete(r, r.where("file_id % 3 = 0"), "file_id"),
        lambda r: mutate.insert(r, s.createDataFrame([(-1, 10)], "file_id long, size long"), {"rating": 1}),
    )


@query(f"WITH {ctes('doc_files', 'tombstones')} SELECT DISTINCT hash FROM (SELECT hash FROM tombstones UNION ALL SELECT hash FROM doc_files WHERE file_id % 11 = 0)")
def tombstone_upsert(s, d):
    return mutate.upsert(view(s, d, "tombstones"), view(s, d, "doc_files").where("file_id % 11 = 0").select("hash"), "hash")


@query(
    f"""WITH {ctes('files', 'coll_orders', 'tombstones')} SELECT 'members' AS kind, CAST(collection_id AS VARCHAR) AS id, count(*) AS n FROM coll_orders WHERE file_id % 4 <> 0 GROUP BY 2
UNION ALL SELECT 'files', CAST(file_id AS VARCHAR), 1 FROM files WHERE file_id % 4 <> 0
UNION ALL SELECT DISTINCT 'tombstones', hash, 1 FROM (SELECT hash FROM tombstones UNION ALL SELECT md5(CAST(file_id AS VARCHAR)) FROM files WHERE file_id % 4 = 0)"""
)
def delete_files(s, d):
    files = view(s, d, "files").withColumn("hash", F.md5(F.col("file_id").cast("string")))
    left, members, tombs = mutate.delete_files(files, view(s, d, "coll_orders"), view(s, d, "tombstones"), files.where("file_id % 4 = 0"))
    one = F.lit(1).cast("long").alias("n")
    out = members.groupBy("collection_id").agg(F.count("*").alias("n")).select(F.lit("members").alias("kind"), F.col("collection_id").cast("string").alias("id"), "n")
    out = out.unionByName(left.select(F.lit("files").alias("kind"), F.col("file_id").cast("string").alias("id"), one))
    return out.unionByName(tombs.select(F.lit("tombstones").alias("kind"), F.col("hash").alias("id"), one))


@query(f"WITH {ctes('files')} SELECT file_id, CASE WHEN is_archived THEN 'delete' ELSE 'archive' END AS action FROM files WHERE file_id % 5 = 0")
def delete_or_archive(s, d):
    rows = view(s, d, "files")
    return mutate.delete_or_archive(rows, rows.where("file_id % 5 = 0"))


# Text and media


@query(
    f"""WITH {ctes('doc_files')}, e AS (SELECT file_id, original_path, CASE file_id % 4 WHEN 0 THEN '.txt' WHEN 1 THEN 'TXT' WHEN 2 THEN 'png' ELSE 'txt' END AS ext FROM doc_files)
SELECT file_id, ext AS was, CASE WHEN ext = 'txt' THEN ext ELSE lower(regexp_extract(original_path, '\\.(\\w+)$', 1)) END AS ext FROM e"""
)
def broken_ext(s, d):
    k = F.col("file_id") % 4
    rows = view(s, d, "doc_files").withColumn("was", F.when(k == 0, ".txt").when(k == 1, "TXT").when(k == 2, "png").otherwise("txt"))
    return rows.select("file_id", "was", text.fixed_extension(F.col("was"), F.col("original_path")).alias("ext"))


@query(
    f"""WITH {ctes('tags')} SELECT tag_id, '(^' || regexp_replace(regexp_replace(label, '([.*+?^${{}}()|\\[\\]\\\\])', '\\\\\\1', 'g'), '[\\s\\-_]+', '[\\\\s\\\\-_\\\\.]+', 'g') || '$)|(^' || tag_id || '$)' AS pattern FROM tags"""
)
def tag_to_regex(s, d):
    return view(s, d, "tags").select("tag_id", text.tag_pattern(F.col("label"), F.array("tag_id")).alias("pattern"))


@query(
    """SELECT page_id, md5(replace(replace(replace(replace(replace(replace(replace(html, '&#39;', ''''), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&apos;', ''''), '&nbsp;', ' '), '&amp;', '&')) AS decoded FROM pages"""
)
def entity_decode(s, d):
    return table(s, d, "pages").select("page_id", F.md5(text.decode_entities(F.col("html"))).alias("decoded"))


@query(
    f"""WITH {ctes('param_blobs')} SELECT file_id, p_name AS prompt, p_brand AS negative_prompt, CAST(p_size AS DOUBLE) AS steps, 'Euler a' AS sampler, CAST(p_partkey AS DOUBLE) AS seed, 512 AS width, 768 AS height,
  p_type AS model, p_partkey % 2 = 0 AS is_upscaled FROM param_blobs JOIN part ON file_id = p_partkey"""
)
def param_parse(s, d):
    rows = view(s, d, "param_blobs").select("file_id", text.parameters(F.col("diffusion_params")).alias("p"))
    return rows.select("file_id", *(f"p.{c}" for c in ("prompt", "negative_prompt", "steps", "sampler", "seed", "width", "height", "model", "is_upscaled")))


@query("SELECT p_partkey AS id, CAST(floor(w * least(300.0 / w, 200.0 / h)) AS INT) AS width, CAST(floor(h * least(300.0 / w, 200.0 / h)) AS INT) AS height FROM (SELECT p_partkey, CAST(p_size * 64 AS DOUBLE) AS w, CAST(p_partkey % 900 + 100 AS DOUBLE) AS h FROM part)")
def thumb_fit(s, d):
    rows = table(s, d, "part").select(F.col("p_partkey").alias("id"), media.fit_within((F.col("p_size") * 64).cast("double"), (F.col("p_partkey") % 900 + 100).cast("double"), 300, 200).alias("x"))
    return rows.select("id", "x.width", "x.height")


@query(
    """SELECT o_orderkey AS id, least(CAST(o_totalprice AS BIGINT), 200000) AS bitrate, o_orderstatus = 'F' AND o_orderkey % 60 <= 30 AND CAST(o_totalprice AS BIGINT) <= 200000 AS skip FROM (SELECT o_orderkey, o_orderstatus, floor(o_totalprice) AS o_totalprice FROM orders)"""
)
def reencode_decision(s, d):
    rows = table(s, d, "orders").select(F.col("o_orderkey").alias("id"), media.reencode(F.col("o_orderstatus"), F.floor("o_totalprice").cast("long"), (F.col("o_orderkey") % 60).cast("double"), "F", 200_000, 30.0).alias("x"))
    return rows.select("id", "x.bitrate", "x.skip")


@query(
    """SELECT l_orderkey AS id, bool_and(l_tax * 100 >= 0 AND l_quantity > l_tax * 100 AND l_quantity <= 45) AS is_valid FROM lineitem GROUP BY 1"""
)
def splice_check(s, d):
    pairs = table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_list(F.struct((F.col("l_tax") * 100).alias("start"), F.col("l_quantity").cast("double").alias("end"))).alias("pairs"))
    return pairs.select("id", media.splice_is_valid(F.col("pairs"), F.lit(45.0)).alias("is_valid"))


# Imports


@query(
    f"""WITH {ctes('import_rows')}, stored AS (SELECT DISTINCT hash FROM import_rows WHERE batch_id % 9 = 0), dead AS (SELECT DISTINCT hash FROM import_rows WHERE batch_id % 8 = 0),
r AS (SELECT batch_id, pos, hash, CASE WHEN hash IS NULL THEN 'ERROR' WHEN hash IN (SELECT hash FROM stored WHERE hash IS NOT NULL) THEN 'DUPLICATE' WHEN hash IN (SELECT hash FROM dead WHERE hash IS NOT NULL) AND batch_id % 2 = 0 THEN 'DELETED' END AS early FROM import_rows)
SELECT batch_id, pos, coalesce(early, CASE WHEN row_number() OVER (PARTITION BY hash, early IS NULL ORDER BY batch_id, pos) = 1 THEN 'COMPLETE' ELSE 'DUPLICATE' END) AS result FROM r"""
)
def import_ladder(s, d):
    rows = view(s, d, "import_rows")
    out = imports.statuses(rows, rows.where("batch_id % 9 = 0"), rows.where("batch_id % 8 = 0"), F.col("batch_id") % 2 == 0)
    return out.select("batch_id", "pos", "result")


@query(
    f"""WITH {ctes('files')}, p AS (SELECT DISTINCT regexp_replace(original_path, '/[^/]*$', '') AS folder FROM files), l AS (SELECT folder, list_distinct(list_filter(string_split(folder, '/'), lambda x: x <> '')) AS x FROM p),
s AS (SELECT folder, string_split(folder, '/')[2:] AS x FROM p)
SELECT folder, x[i] AS label, CASE WHEN i > 2 THEN x[i - 1] ELSE '' END AS parent_label, CAST(i - 2 AS INT) AS depth, x[len(x)] AS collection_title FROM s, (SELECT unnest(range(2, 5)) AS i) WHERE i <= len(x)"""
)
def batch_build(s, d):
    folders = view(s, d, "files").select(text.dirname(F.col("original_path")).alias("folder"))
    out = imports.folder_tags(folders, root_index=1, mode="hierarchical", collection="withTag")
    return out.select("folder", "label", F.coalesce("parent_label", F.lit("")).alias("parent_label"), "depth", "collection_title")


@query(
    """WITH p AS (SELECT f.vec_id AS face_id, k.vec_id AS tag_id, list_distance(f.embedding::DOUBLE[], k.embedding::DOUBLE[]) AS distance FROM embeddings f JOIN embeddings k ON f.vec_id % 20 = 0 AND f.vec_id <> k.vec_id)
SELECT face_id, CAST(tag_id AS VARCHAR) AS tag_id, round(distance, 5) AS distance FROM p WHERE distance <= 1.2 QUALIFY row_number() OVER (PARTITION BY face_id ORDER BY distance, CAST(tag_id AS VARCHAR)) = 1"""
)
def nearest_face(s, d):
    rows = table(s, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    faces = rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("face_id"), F.col("v").alias("vector"))
    known = rows.select(F.col("vec_id").cast("string").alias("tag_id"), F.col("v").alias("known_vector"))
    return joins.nearest_other(faces, known, 1.2).withColumn("distance", F.round("distance", 5))


QUERIES |= streams.QUERIES
ORACLES |= streams.ORACLES


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
