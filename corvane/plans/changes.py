"""Queries: changes of tags, files, collections and imports, and what follows from them."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.functions import text
from corvane.operators import graph, imports, joins, mutate, rollups, upkeep
from corvane.plans.registry import closed, closed_ctes, query
from corvane.session import bucketed, dealt, shared_folder, table
from corvane.sources import batches
from corvane.sources.adapters import ctes, view


def tag_tables(s, d) -> upkeep.TagTables:
    held = dealt(view(s, d, "coll_orders").join(view(s, d, "file_tags"), "file_id").select("collection_id", "tag_id"), "collection_id").distinct()
    return upkeep.TagTables(view(s, d, "tags"), view(s, d, "edges"), view(s, d, "file_tags"), held, view(s, d, "batch_tags"))


def counted(**frames: DataFrame) -> DataFrame:
    """(kind, id, n): how many rows each frame has by its first column."""
    parts = [f.groupBy(F.col(f.columns[0]).cast("string").alias("id")).agg(F.count("*").alias("n")).select(F.lit(k).alias("kind"), "id", "n") for k, f in frames.items()]
    return reduce(DataFrame.unionByName, parts)


def counted_sql(**frames: tuple[str, str]) -> str:
    return " UNION ALL ".join(f"SELECT '{k}' AS kind, CAST({c} AS VARCHAR) AS id, count(*) AS n FROM {t} GROUP BY 2" for k, (t, c) in frames.items())


HOLDERS = "coll_tags AS (SELECT DISTINCT collection_id, tag_id FROM coll_orders JOIN file_tags USING (file_id))"
ALL = ("coll_orders", "file_tags", "batch_tags")


@query(
    closed_ctes(*ALL, "files")
    + f""", {HOLDERS}, fc AS (SELECT DISTINCT file_id, ancestor AS tag_id FROM file_tags JOIN closed ON tag_id = tag), cc AS (SELECT DISTINCT collection_id, ancestor AS tag_id FROM coll_tags JOIN closed ON tag_id = tag),
"""
    + "all_rows AS ("
    + counted_sql(closure=("closed", "tag"), files=("fc", "file_id"), collections=("cc", "collection_id"), rollup=("fc", "tag_id"))
    + ") SELECT kind, id, n FROM all_rows"
)
def regen_cascade(s, d):
    t = tag_tables(s, d)
    out = upkeep.regenerated(t, view(s, d, "files"))
    rollup = out.rollup.where("n_files > 0").select(F.lit("rollup").alias("kind"), F.col("tag_id").alias("id"), F.col("n_files").alias("n"))
    return counted(closure=out.closure, files=out.file_closure, collections=out.collection_closure).unionByName(rollup)


@query(
    f"""WITH {ctes('tags', 'edges')} SELECT child, parent FROM edges UNION SELECT 'new', 'N1' UNION SELECT 'S1', 'new' UNION ALL SELECT tag_id, label FROM tags WHERE tag_id IN ('N1', 'S1') UNION ALL SELECT 'new', 'Fresh'"""
)
def tag_create(s, d):
    out = upkeep.created(tag_tables(s, d), "new", "Fresh", parents=("N1",), children=("S1",))
    return out.edges.unionByName(out.tags.where("tag_id in ('new', 'N1', 'S1')").select(F.col("tag_id").alias("child"), F.col("label").alias("parent")))


@query(
    f"""WITH {ctes('tags', 'edges')} SELECT child, parent FROM edges WHERE child <> 'N1' AND parent <> 'N1' UNION SELECT 'N1', 'R4' UNION SELECT 'S1', 'N1' UNION SELECT 'S2', 'N1' UNION ALL SELECT tag_id, 'Renamed' FROM tags WHERE tag_id = 'N1'"""
)
def tag_edit(s, d):
    out = upkeep.edited(tag_tables(s, d), "N1", parents=("R4",), children=("S1", "S2"), label="Renamed")
    return out.edges.unionByName(out.tags.where("label = 'Renamed'").select(F.col("tag_id").alias("child"), F.col("label").alias("parent")))


@query(
    f"""WITH {ctes('tags', 'edges', *ALL)}, {HOLDERS}, gone AS (SELECT tag_id FROM tags WHERE tag_id LIKE 'P1%' OR tag_id = 'N1'), t AS (SELECT * FROM tags WHERE tag_id NOT IN (SELECT tag_id FROM gone)),
e AS (SELECT * FROM edges WHERE child NOT IN (SELECT tag_id FROM gone) AND parent NOT IN (SELECT tag_id FROM gone)), f AS (SELECT * FROM file_tags WHERE tag_id NOT IN (SELECT tag_id FROM gone)),
c AS (SELECT * FROM coll_tags WHERE tag_id NOT IN (SELECT tag_id FROM gone)), b AS (SELECT * FROM batch_tags WHERE tag_id NOT IN (SELECT tag_id FROM gone)) """
    + counted_sql(tags=("t", "tag_id"), edges=("e", "child"), files=("f", "file_id"), collections=("c", "collection_id"), batches=("b", "batch_id"))
)
def tag_delete(s, d):
    t = tag_tables(s, d)
    out = upkeep.deleted(t, t.tags.where("tag_id like 'P1%' or tag_id = 'N1'"))
    return counted(tags=out.tags, edges=out.edges, files=out.file_tags, collections=out.collection_tags, batches=out.batch_tags)


MERGED = f"""WITH {ctes('tags', 'edges', *ALL)}, {HOLDERS}, k AS (SELECT tag_id AS gone, min(tag_id) OVER (PARTITION BY lower(label)) AS kept FROM tags), m AS (SELECT * FROM k WHERE gone <> kept),
t AS (SELECT tag_id, label FROM tags WHERE tag_id NOT IN (SELECT gone FROM m)),
e AS (SELECT DISTINCT coalesce(a.kept, child) AS child, coalesce(b.kept, parent) AS parent FROM edges LEFT JOIN m a ON child = a.gone LEFT JOIN m b ON parent = b.gone WHERE coalesce(a.kept, child) <> coalesce(b.kept, parent)),
f AS (SELECT DISTINCT file_id, kept AS tag_id FROM file_tags JOIN k ON tag_id = gone), c AS (SELECT DISTINCT collection_id, kept AS tag_id FROM coll_tags JOIN k ON tag_id = gone), b AS (SELECT DISTINCT batch_id, kept AS tag_id FROM batch_tags JOIN k ON tag_id = gone) """


@query(MERGED + counted_sql(tags=("t", "tag_id"), edges=("e", "child"), files=("f", "file_id"), collections=("c", "collection_id"), batches=("b", "batch_id")))
def repair_tags(s, d):
    t = tag_tables(s, d)
    rows = t.tags.select("tag_id", F.replace("label", F.lit("red"), F.lit("r&#101;d")).alias("label"), F.lit(0).alias("count"))
    out = upkeep.repaired(replace(t, tags=rows))
    return counted(tags=out.tags, edges=out.edges, files=out.file_tags, collections=out.collection_tags, batches=out.batch_tags)


@query(
    f"""WITH {ctes('tags', 'edges', 'file_tags')}, m(gone, kept) AS (VALUES ('P1', 'P2'), ('P3', 'P2'), ('S1', 'S2')), e AS (SELECT DISTINCT coalesce(a.kept, child) AS child, coalesce(b.kept, parent) AS parent FROM edges LEFT JOIN m a ON child = a.gone LEFT JOIN m b ON parent = b.gone),
f AS (SELECT DISTINCT coalesce(kept, tag_id) AS tag_id, file_id FROM file_tags LEFT JOIN m ON tag_id = gone)
SELECT 'tag' AS kind, tag_id AS a, CASE tag_id WHEN 'P2' THEN 'Merged' WHEN 'S2' THEN 'Other' ELSE label END AS b FROM tags WHERE tag_id NOT IN ('P1', 'P3', 'S1') UNION ALL SELECT 'edge', child, parent FROM e WHERE child <> parent
UNION ALL SELECT 'files', tag_id, CAST(count(*) AS VARCHAR) FROM f WHERE tag_id IN ('P1', 'P2', 'P3') GROUP BY 1, 2"""
)
def tag_merge_kept(s, d):
    merges = s.createDataFrame([("P1", "P2", "Merged"), ("P3", "P2", "Merged"), ("S1", "S2", "Other")], "gone string, kept string, label string")
    out = upkeep.merged(tag_tables(s, d), merges)
    files = out.file_tags.where("tag_id in ('P1', 'P2', 'P3')").groupBy("tag_id").agg(F.count("*").cast("string").alias("b"))
    return out.tags.select(F.lit("tag").alias("kind"), F.col("tag_id").alias("a"), F.col("label").alias("b")).union(out.edges.select(F.lit("edge"), "child", "parent")).union(files.select(F.lit("files"), "tag_id", "b"))


@query(
    f"""WITH {ctes('tags', 'edges', *ALL)}, {HOLDERS}, m AS (SELECT 'P' || p_partkey AS gone, 'P' || (p_partkey - p_partkey % 50 + 4) AS kept FROM part WHERE p_partkey % 50 BETWEEN 1 AND 3),
t AS (SELECT tag_id FROM tags WHERE tag_id NOT IN (SELECT gone FROM m)), e AS (SELECT DISTINCT coalesce(a.kept, child) AS child, coalesce(b.kept, parent) AS parent FROM edges LEFT JOIN m a ON child = a.gone LEFT JOIN m b ON parent = b.gone),
f AS (SELECT DISTINCT file_id, coalesce(kept, tag_id) AS tag_id FROM file_tags LEFT JOIN m ON tag_id = gone), c AS (SELECT DISTINCT collection_id, coalesce(kept, tag_id) AS tag_id FROM coll_tags LEFT JOIN m ON tag_id = gone), b AS (SELECT DISTINCT batch_id, coalesce(kept, tag_id) AS tag_id FROM batch_tags LEFT JOIN m ON tag_id = gone) """
    + counted_sql(tags=("t", "tag_id"), edges=("e", "child"), files=("f", "tag_id"), collections=("c", "tag_id"), batches=("b", "tag_id"))
)
def tag_merge_chain(s, d):
    """Every first, second and third of fifty tags is merged into the next one, so the fourth is left of four."""
    k = F.col("p_partkey")
    name = lambda x: F.concat(F.lit("P"), x.cast("string"))
    merges = table(s, d, "part").where((k % 50).between(1, 3)).select(name(k).alias("gone"), name(k + 1).alias("kept"))
    out = upkeep.merged(tag_tables(s, d), merges)
    held = {n: getattr(out, f"{t}_tags").select("tag_id") for n, t in (("files", "file"), ("collections", "collection"), ("batches", "batch"))}
    return counted(tags=out.tags, edges=out.edges, **held)


@query(
    closed_ctes()
    + """, ed(tag, other, kind, action) AS (VALUES ('N1', 'W', 'child', 'add'), ('N1', 'S1', 'child', 'add'), ('N2', 'S1', 'child', 'add'), ('R2', 'N3', 'parent', 'add'), ('P5', 'Y:STANDARD', 'parent', 'add'), ('K1', 'N1', 'parent', 'remove'), ('R1', 'R1', 'parent', 'add'), ('S2', 'S3', 'parent', 'add')),
bad AS (SELECT tag, other, kind FROM ed WHERE action = 'add' AND ((kind = 'child' AND EXISTS (SELECT 1 FROM closed c WHERE c.tag = ed.tag AND c.ancestor = ed.other)) OR (kind = 'parent' AND EXISTS (SELECT 1 FROM closed c WHERE c.tag = ed.other AND c.ancestor = ed.tag)))),
good AS (SELECT CASE kind WHEN 'child' THEN other ELSE tag END AS child, CASE kind WHEN 'child' THEN tag ELSE other END AS parent, action FROM ed WHERE tag NOT IN (SELECT tag FROM bad)),
e AS (SELECT child, parent FROM edges UNION SELECT child, parent FROM good WHERE action = 'add')
SELECT 'error' AS kind, tag AS a, other AS b FROM bad UNION ALL SELECT 'edge', child, parent FROM e WHERE NOT EXISTS (SELECT 1 FROM good g WHERE g.child = e.child AND g.parent = e.parent AND g.action = 'remove')"""
)
def multi_relation_edit(s, d):
    edits = s.createDataFrame(
        [("N1", "W", "child", "add"), ("N1", "S1", "child", "add"), ("N2", "S1", "child", "add"), ("R2", "N3", "parent", "add"), ("P5", "Y:STANDARD", "parent", "add"), ("K1", "N1", "parent", "remove"), ("R1", "R1", "parent", "add"), ("S2", "S3", "parent", "add")],
        "tag string, other string, kind string, action string",
    )
    errors, edges = upkeep.related(view(s, d, "edges"), closed(s, d), edits)
    return errors.select(F.lit("error").alias("kind"), F.col("tag").alias("a"), F.col("other").alias("b")).union(edges.select(F.lit("edge"), "child", "parent"))


@query(
    f"""WITH RECURSIVE {ctes('edges')}, e AS (SELECT child, parent FROM edges WHERE length(child) % 3 <> 0 UNION SELECT child, parent FROM edges WHERE length(parent) % 4 <> 0),
up AS (SELECT child AS tag, parent AS ancestor FROM e UNION SELECT u.tag, e.parent FROM up u JOIN e ON u.ancestor = e.child) SELECT tag, count(*) AS n_ancestors FROM up GROUP BY 1"""
)
def tag_refresh(s, d):
    e = view(s, d, "edges")
    _, closed_again = upkeep.refreshed(e.where("length(child) % 3 <> 0"), e.where("length(parent) % 4 <> 0"), view(s, d, "tags"))
    return closed_again.where("depth > 0").groupBy("tag").agg(F.count("*").alias("n_ancestors"))


WANTED = [("World", None), ("Brand new", "Parent new"), ("Brand new", "World"), ("Parent new", None), ("AFRICA", "Continents"), ("ASIA", None)]


@query(
    f"""WITH {ctes('tags', 'edges')}, w(label, parent_label) AS (VALUES ('World', NULL), ('Brand new', 'Parent new'), ('Brand new', 'World'), ('Parent new', NULL), ('AFRICA', 'Continents'), ('ASIA', NULL)),
n AS (SELECT label FROM w UNION SELECT parent_label FROM w WHERE parent_label IS NOT NULL), i AS (SELECT n.label, coalesce(min(tag_id), 'T' || md5(n.label)) AS tag_id, min(tag_id) IS NULL AS is_new FROM n LEFT JOIN tags t ON t.label = n.label GROUP BY 1),
l AS (SELECT DISTINCT a.tag_id AS child, b.tag_id AS parent FROM w JOIN i a ON a.label = w.label JOIN i b ON b.label = w.parent_label)
SELECT 'tag' AS kind, tag_id AS a, label AS b FROM i WHERE is_new UNION ALL SELECT 'edge', child, parent FROM (SELECT child, parent FROM edges WHERE child NOT IN (SELECT child FROM l) UNION SELECT child, parent FROM l)"""
)
def upsert_labels(s, d):
    tags = view(s, d, "tags")
    new, edges = upkeep.upserted(tags, view(s, d, "edges"), s.createDataFrame(WANTED, "label string, parent_label string"))
    return new.join(tags, "tag_id", "left_anti").select(F.lit("tag").alias("kind"), F.col("tag_id").alias("a"), F.col("label").alias("b")).union(edges.select(F.lit("edge"), "child", "parent"))


@query(f"WITH {ctes('tags')}, w(label) AS (VALUES ('World'), ('nobody'), ('ASIA'), ('asia')) SELECT w.label, coalesce(min(tag_id), '') AS tag_id FROM w LEFT JOIN tags USING (label) GROUP BY 1")
def label_existence(s, d):
    wanted = s.createDataFrame([("World",), ("nobody",), ("ASIA",), ("asia",)], "label string")
    return joins.by_label(wanted, view(s, d, "tags"), "label").select("label", F.coalesce("tag_id", F.lit("")).alias("tag_id"))


@query(
    f"""WITH RECURSIVE {ctes('tags', 'edges')}, r AS (SELECT lower(a.label) AS key, lower(b.label) AS up FROM edges JOIN tags a ON a.tag_id = child JOIN tags b ON b.tag_id = parent
  UNION SELECT lower(label), NULL FROM tags WHERE tag_id NOT IN (SELECT child FROM edges)), l AS (SELECT * FROM r WHERE up IS NOT NULL AND up <> key), sp AS (SELECT lower(label) AS key, min(label) AS label FROM tags GROUP BY 1),
t AS (SELECT key, label, label AS path, [key] AS keys, 0 AS depth FROM sp WHERE key NOT IN (SELECT key FROM r WHERE up IS NOT NULL)
  UNION ALL SELECT l.key, sp.label, t.path || '/' || sp.label, list_append(t.keys, l.key), t.depth + 1 FROM t JOIN l ON l.up = t.key JOIN sp ON sp.key = l.key WHERE NOT list_contains(t.keys, l.key)) SELECT label, path, depth FROM t"""
)
def label_tree(s, d):
    tags, e = view(s, d, "tags"), view(s, d, "edges")
    under = e.join(tags.select(F.col("tag_id").alias("child"), "label"), "child").join(tags.select(F.col("tag_id").alias("parent"), F.upper("label").alias("parent_label")), "parent")
    tops = tags.join(e.select(F.col("child").alias("tag_id")), "tag_id", "left_anti").select("label", F.lit(None).cast("string").alias("parent_label"))
    return graph.tree(under.select("label", "parent_label").unionByName(tops))


# Rollups


@query(
    closed_ctes("coll_orders", "file_tags")
    + """, own AS (SELECT collection_id, tag_id, min(idx) AS i FROM coll_orders JOIN file_tags USING (file_id) GROUP BY 1, 2), wide AS (SELECT collection_id, string_agg(DISTINCT ancestor, ',' ORDER BY ancestor) AS tag_ids_with_ancestors FROM own JOIN closed ON tag_id = tag GROUP BY 1)
SELECT collection_id, string_agg(tag_id, ',' ORDER BY i, tag_id) AS tag_ids, any_value(tag_ids_with_ancestors) AS tag_ids_with_ancestors FROM own JOIN wide USING (collection_id) GROUP BY 1"""
)
def collection_tag_lists(s, d):
    out = rollups.collection_tags(view(s, d, "coll_orders"), view(s, d, "file_tags"), closed(s, d))
    return out.select("collection_id", F.array_join("tag_ids", ",").alias("tag_ids"), F.array_join("tag_ids_with_ancestors", ",").alias("tag_ids_with_ancestors"))


@query(f"WITH {ctes('tags')} SELECT lower(label) AS key, tag_id, label, count(*) OVER (PARTITION BY lower(label)) AS n_tags FROM tags QUALIFY n_tags > 1")
def duplicate_label_groups(s, d):
    return rollups.duplicate_groups(view(s, d, "tags")).select("key", "tag_id", "label", "n_tags")


#: A library after retagging, deletion of the oldest files and of others, and a change of the hierarchy.
LIBRARY_SQL = """f2 AS (SELECT * FROM files WHERE file_id % 11 <> 0 AND date_created >= TIMESTAMP '1992-06-01'),
ft2 AS (SELECT file_id, tag_id FROM file_tags WHERE NOT (file_id % 7 = 0 AND (tag_id = 'P2' OR tag_id = 'K7')) UNION SELECT file_id, 'P1' FROM files WHERE file_id % 7 = 0),
e2 AS (SELECT child, parent FROM edges WHERE NOT (child LIKE 'N1%' AND parent LIKE 'R%') UNION SELECT child, 'between' FROM edges WHERE child LIKE 'N1%' UNION SELECT 'between', 'R3'),
up2 AS (SELECT child AS tag, parent AS ancestor FROM e2 UNION SELECT u.tag, e.parent FROM up2 u JOIN e2 e ON u.ancestor = e.child),
t2 AS (SELECT tag_id FROM tags UNION ALL SELECT 'between'), closed2 AS (SELECT tag_id AS tag, tag_id AS ancestor FROM t2 UNION SELECT tag, ancestor FROM up2)"""


def changed_library(s, d) -> upkeep.Library:
    files = bucketed(view(s, d, "files").select("file_id", "size", "rating", "date_created"), "file_id").withColumn("hash", F.md5(F.col("file_id").cast("string")))
    lib = upkeep.library(files, view(s, d, "coll_orders"), view(s, d, "tombstones"), replace(tag_tables(s, d), file_tags=view(s, d, "file_tags_raw")))
    lib = upkeep.files_retagged(lib, files.where("file_id % 7 = 0"), ["P1"], ["P2", "K7"])
    lib = upkeep.files_deleted(lib, files.where("file_id % 11 = 0 or date_created < timestamp '1992-06-01'"))
    t = lib.tags
    moved = t.edges.where("child like 'N1%' and parent like 'R%'")
    edges = t.edges.join(moved, ["child", "parent"], "left_anti").unionByName(moved.select("child", F.lit("between").alias("parent"))).unionByName(s.createDataFrame([("between", "R3")], "child string, parent string"))
    return upkeep.tags_changed(lib, replace(t, edges=edges, tags=t.tags.unionByName(s.createDataFrame([("between", "Between")], "tag_id string, label string"))))


@query(
    closed_ctes("files", "file_tags")
    + f""", {LIBRARY_SQL}, h AS (SELECT DISTINCT c.ancestor AS tag_id, ft.file_id FROM ft2 ft JOIN closed2 c ON ft.tag_id = c.tag),
a AS (SELECT h.tag_id, count(*) AS n, sum(size) AS s, arg_min(file_id, (date_created, file_id)) AS f FROM h JOIN f2 USING (file_id) GROUP BY 1)
SELECT t2.tag_id, coalesce(n, 0) AS n_files, CAST(coalesce(s, 0) AS BIGINT) AS total_size, coalesce(f, -1) AS thumb_file FROM t2 LEFT JOIN a USING (tag_id)"""
)
def tag_rollup_delta(s, d):
    return rollups.rollup_of(changed_library(s, d).tag_state).withColumn("thumb_file", F.coalesce("thumb_file", F.lit(-1)))


@query(
    f"""WITH {ctes('files', 'coll_orders')} SELECT collection_id, count(*) AS n_files, CAST(sum(size) AS BIGINT) AS total_size, round(coalesce(avg(CASE WHEN rating > 0 THEN rating END), 0), 6) AS rating
FROM coll_orders JOIN files USING (file_id) WHERE file_id % 11 <> 0 GROUP BY 1"""
)
def collection_rollup_delta(s, d):
    files, members = view(s, d, "files"), view(s, d, "coll_orders")
    gone = members.where("file_id % 11 = 0").select("collection_id", "file_id")
    out = rollups.collections_rolled(rollups.collection_state(members, files), graph.Delta(gone.limit(0), gone), files, files)
    return rollups.collection_rollup_of(out).withColumn("rating", F.round("rating", 6))


# Files


@query(
    f"""WITH {ctes('file_tags', 'batch_tags')}, f AS (SELECT file_id, tag_id FROM file_tags UNION SELECT file_id, 'new' FROM file_tags WHERE file_id % 3 = 0), b AS (SELECT batch_id, tag_id FROM batch_tags UNION SELECT batch_id, 'new' FROM batch_tags WHERE batch_id = 7)
SELECT 'file' AS kind, file_id AS id, tag_id FROM f WHERE NOT (file_id % 3 = 0 AND tag_id IN ('P1', 'P2')) UNION ALL SELECT 'batch', batch_id, tag_id FROM b WHERE NOT (batch_id = 7 AND tag_id IN ('P1', 'P2'))"""
)
def edit_file_tags(s, d):
    own = view(s, d, "file_tags")
    out = upkeep.retagged(own, own.where("file_id % 3 = 0"), ["new"], ["P1", "P2"])
    batches = upkeep.retagged_batch(view(s, d, "batch_tags"), 7, ["new"], ["P1", "P2"])
    return out.select(F.lit("file").alias("kind"), F.col("file_id").alias("id"), "tag_id").unionByName(batches.select(F.lit("batch").alias("kind"), F.col("batch_id").alias("id"), "tag_id"))


@query(
    closed_ctes("file_tags")
    + """, e AS (SELECT * FROM edges WHERE NOT (child = 'N1' OR parent = 'N1')), up2 AS (SELECT child AS tag, parent AS ancestor FROM e UNION SELECT u.tag, e.parent FROM up2 u JOIN e ON u.ancestor = e.child),
closed2 AS (SELECT tag_id AS tag, tag_id AS ancestor FROM tags UNION SELECT tag, ancestor FROM up2), a AS (SELECT DISTINCT file_id, ancestor FROM file_tags JOIN closed ON tag_id = tag), b AS (SELECT DISTINCT file_id, ancestor FROM file_tags JOIN closed2 ON tag_id = tag)
SELECT DISTINCT file_id FROM (SELECT * FROM a EXCEPT SELECT * FROM b UNION ALL (SELECT * FROM b EXCEPT SELECT * FROM a))"""
)
def closure_changes(s, d):
    own, e = view(s, d, "file_tags"), view(s, d, "edges")
    before, after = closed(s, d), graph.closure(e.where("child <> 'N1' and parent <> 'N1'"), view(s, d, "tags"))
    return upkeep.closure_changed(own, before, after, "file_id")


@query(
    f"""WITH {ctes('media')}, p AS (SELECT file_id, '/x/' || file_id || '.' || CASE WHEN file_id % 2 = 0 THEN lower(ext) ELSE 'png' END AS path, CASE WHEN file_id % 9 = 0 THEN '.' || ext ELSE ext END AS ext FROM media)
SELECT count(*) FILTER (starts_with(ext, '.')) AS n_dotted, count(*) FILTER (lower(ext) <> regexp_extract(path, '\\.(\\w+)$', 1) OR ext <> lower(ext)) AS n_differing FROM p"""
)
def broken_ext_counts(s, d):
    k = F.col("file_id")
    path = F.concat(F.lit("/x/"), k.cast("string"), F.lit("."), F.when(k % 2 == 0, F.lower("ext")).otherwise("png"))
    ext = F.when(k % 9 == 0, F.concat(F.lit("."), "ext")).otherwise(F.col("ext"))
    return text.extension_faults(view(s, d, "media").select(ext.alias("ext"), path.alias("path")))


@query(
    f"""WITH {ctes('media')} SELECT file_id, CASE WHEN lower(ext) IN ('mp4', 'webm', 'ts') THEN coalesce(original_bitrate, bitrate) ELSE original_bitrate END AS original_bitrate,
  CASE WHEN lower(ext) IN ('mp4', 'webm', 'ts') AND video_codec IS NOT NULL AND coalesce(original_video_codec, '') = '' THEN video_codec ELSE original_video_codec END AS original_video_codec FROM media"""
)
def fill_originals(s, d):
    return mutate.originals_filled(view(s, d, "media"), F.lower("ext").isin("mp4", "webm", "ts"), {"bitrate": "original_bitrate", "video_codec": "original_video_codec"}).select("file_id", "original_bitrate", "original_video_codec")


@query(f"WITH {ctes('tombstones')} SELECT DISTINCT hash FROM (SELECT hash FROM tombstones UNION ALL SELECT md5(text) FROM documents WHERE doc_id % 3 = 0)")
def delete_external(s, d):
    found = table(s, d, "documents").where("doc_id % 3 = 0").select(F.concat(F.lit("/x/"), "doc_id").alias("path"), F.md5("text").alias("hash"))
    return mutate.delete_external(view(s, d, "tombstones"), found)


@query(f"WITH {ctes('media')} SELECT file_id, CASE WHEN file_id % 4 = 0 THEN NULL ELSE bitrate END AS bitrate, CASE WHEN file_id % 4 = 0 THEN 'x' ELSE ext END AS ext FROM media")
def update_to_null(s, d):
    rows = view(s, d, "media").select("file_id", "bitrate", "ext")
    return mutate.update(rows, rows.where("file_id % 4 = 0").select("file_id", F.lit(None).cast("long").alias("bitrate"), F.lit("x").alias("ext")), "file_id", nulls=("bitrate",))


@query(
    f"""WITH {ctes('import_rows')} SELECT batch_id, pos, CASE WHEN pos = 0 AND batch_id % 2 = 0 THEN '/new/' || batch_id || '.PNG' ELSE path END AS path, CASE WHEN pos = 0 AND batch_id % 2 = 0 THEN '/new/' || batch_id || '-thumb.jpg' ELSE 'old' END AS thumb_path FROM import_rows"""
)
def relink_imports(s, d):
    rows = view(s, d, "import_rows").select("batch_id", "pos", F.concat_ws("-", "batch_id", "pos").alias("file_id"), "path", F.lit("old").alias("thumb_path"))
    moves = rows.where("pos = 0 and batch_id % 2 = 0").select("file_id", F.concat(F.lit("/new/"), "batch_id", F.lit(".PNG")).alias("new_path"))
    return joins.relinked_imports(rows, moves).select("batch_id", "pos", "path", "thumb_path")


# Imports


@query(
    f"""WITH {ctes('batches', 'batch_files', 'batch_tags')}, open AS (SELECT DISTINCT batch_id FROM batch_files WHERE status = 'PENDING'), done AS (SELECT batch_id, collection_title FROM batches WHERE NOT is_completed AND batch_id NOT IN (SELECT batch_id FROM open)),
m AS (SELECT batch_id, collection_title, file_id, min(pos) AS pos FROM batch_files JOIN done USING (batch_id) WHERE status IN ('COMPLETE', 'DUPLICATE') AND coalesce(collection_title, '') <> '' GROUP BY 1, 2, 3),
r AS (SELECT DISTINCT file_id, tag_id FROM batch_files JOIN done USING (batch_id) JOIN batch_tags USING (batch_id) WHERE status = 'DUPLICATE')
SELECT 'batch' AS kind, CAST(batch_id AS VARCHAR) AS a, CASE WHEN batch_id IN (SELECT batch_id FROM m) THEN 'C' || batch_id ELSE '' END AS b FROM done UNION ALL SELECT 'collection', 'C' || batch_id, any_value(collection_title) || ':' || count(*) FROM m GROUP BY batch_id
UNION ALL SELECT 'member', 'C' || batch_id, file_id || ':' || (row_number() OVER (PARTITION BY batch_id ORDER BY pos) - 1) FROM m UNION ALL SELECT 'tag', CAST(file_id AS VARCHAR), tag_id FROM r"""
)
def complete_batches(s, d):
    was = view(s, d, "batches")
    none = s.createDataFrame([], "file_id long, tag_id string")
    batches, made, members, tagged = imports.completed_batches(was, view(s, d, "batch_files"), view(s, d, "batch_tags"), none, F.lit("2031-01-01").cast("timestamp"))
    closed_now = batches.where("is_completed and completed_at = timestamp '2031-01-01'")
    out = closed_now.select(F.lit("batch").alias("kind"), F.col("batch_id").cast("string").alias("a"), F.coalesce("collection_id", F.lit("")).alias("b"))
    out = out.union(made.select(F.lit("collection"), "collection_id", F.concat_ws(":", "title", "n_files"))).union(members.select(F.lit("member"), "collection_id", F.concat_ws(":", "file_id", "idx")))
    return out.union(tagged.select(F.lit("tag"), F.col("file_id").cast("string"), "tag_id"))


@query(
    f"""WITH {ctes('file_tags')} SELECT file_id, tag_id FROM file_tags UNION SELECT file_id, 'again' FROM file_tags WHERE file_id % 5 = 0 UNION SELECT file_id, 'P1' FROM file_tags WHERE file_id % 5 = 0
UNION ALL SELECT DISTINCT file_id, 'member' || (dense_rank() OVER (ORDER BY file_id) - 1) FROM file_tags WHERE file_id % 5 = 0"""
)
def reingest(s, d):
    own = view(s, d, "file_tags")
    found = own.where("file_id % 5 = 0").select("file_id").distinct().select("file_id", F.col("file_id").alias("pos"), F.array(F.lit("again"), F.lit("P1")).alias("tag_ids"))
    tags, members = imports.reingested(own, found, "c1")
    return tags.unionByName(members.select("file_id", F.concat(F.lit("member"), "idx").alias("tag_id")))


#: Folders of files whose names hold character references, several tags in one part, and labels written otherwise.
FOLDERS_SQL = """SELECT DISTINCT '/lib/' || c_mktsegment || ' &amp; co/' || replace(lower(n_name), ' ', '_') || ';;' || r_name || '/' || replace(c_name, '#', '&#35;') AS folder
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""


@query(
    closed_ctes()
    + """, f AS (SELECT DISTINCT c_mktsegment || ' & co' AS a, replace(lower(n_name), ' ', '_') AS b, r_name AS r, n_name, c_name, '/lib/' || c_mktsegment || ' &amp; co/' || replace(lower(n_name), ' ', '_') || ';;' || r_name || '/' || replace(c_name, '#', '&#35;') AS folder
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
SELECT folder, 'lib' AS label, NULL AS parent_label FROM f UNION SELECT folder, a, 'lib' FROM f UNION SELECT folder, c_name, b FROM f UNION SELECT folder, c_name, r FROM f UNION SELECT folder, c_name, n_name FROM f
UNION SELECT folder, n_name, a FROM f WHERE n_name <> r AND NOT EXISTS (SELECT 1 FROM tags t JOIN closed c ON c.ancestor = t.tag_id JOIN tags l ON l.tag_id = c.tag WHERE t.label = f.b AND l.label = c_name)"""
)
def batch_plan(s, d):
    """What a scan of all customers' folders makes of them: references read, parts with several tags, labels replaced by the tags they mean."""
    folders = s.sql(FOLDERS_SQL.replace("FROM customer JOIN nation", "FROM {customer} JOIN {nation}").replace("JOIN region", "JOIN {region}"), **{t: table(s, d, t) for t in ("customer", "nation", "region")})
    found = imports.folder_tags(folders, mode="hierarchical", collection="withTag", delimiter=";;", decode=True)
    tags = view(s, d, "tags").where("tag_id rlike '^[RNK]'")
    patterns = tags.select("tag_id", text.tag_pattern(F.col("label"), F.array().cast("array<string>")).alias("pattern"))
    titles = found.select("folder", F.col("collection_title").alias("name")).distinct()
    return imports.planned_tags(found, titles, tags, patterns, closed(s, d))


#: A batch over the largest files: some go, some change, some are new.
@query(
    f"""WITH {ctes('files')}, m AS (SELECT max(file_id) AS m FROM files) SELECT file_id, size, ext FROM files, m WHERE file_id <= m * 0.9
UNION ALL SELECT file_id, size + 1, 'changed' FROM files, m WHERE file_id > m * 0.9 AND file_id % 3 = 0 UNION ALL SELECT file_id, size, ext FROM files, m WHERE file_id > m * 0.9 AND file_id % 3 = 1
UNION ALL SELECT file_id + 100000000, size, 'new' FROM files, m WHERE file_id > m * 0.9 AND file_id % 3 = 2"""
)
def batch_rewrite(s, d):
    """An ordered batch on the last tenth of the files: deletions, updates and inserts, some ids twice. Files without a hit stay as they are."""
    rows = view(s, d, "files").select("file_id", "size", "ext")
    stored = batches.create(rows, shared_folder(s), "file_id", 8)
    k, late = F.col("file_id"), rows.where(F.col("file_id") > rows.agg(F.max("file_id")).first()[0] * 0.9)
    op = lambda seq, name, part: part.select(F.lit(seq).alias("seq"), F.lit(name).alias("op"), "file_id", "size", "ext")
    changes = op(1, "delete", late.where(k % 3 == 0)).unionByName(op(2, "insert", late.where(k % 3 == 0).withColumns({"size": F.col("size") + 1, "ext": F.lit("changed")})))
    changes = changes.unionByName(op(3, "update", late.where(k % 3 == 2).withColumn("ext", F.lit("?")))).unionByName(op(4, "delete", late.where(k % 3 == 2)))
    changes = changes.unionByName(op(5, "insert", late.where(k % 3 == 2).withColumns({"file_id": k + 100_000_000, "ext": F.lit("new")})))
    after = batches.apply_batch(stored, changes)
    return after.rows()


@query(
    f"""WITH {ctes('batch_files', 'batch_tags')}, f AS (SELECT batch_id, pos, 'own' AS tag_id FROM batch_files WHERE pos = 0) SELECT batch_id, pos, tag_id FROM batch_files JOIN batch_tags USING (batch_id) UNION SELECT * FROM f"""
)
def effective_tags(s, d):
    rows = view(s, d, "batch_files")
    return imports.effective_tags(rows, view(s, d, "batch_tags"), rows.where("pos = 0").select("batch_id", "pos", F.lit("own").alias("tag_id")))


@query(
    f"""WITH {ctes('import_rows')} SELECT batch_id, string_agg(CASE WHEN path LIKE '%1.jpg' THEN 'ERROR' ELSE status END, ',' ORDER BY pos) AS statuses FROM import_rows GROUP BY 1"""
)
def import_row_update(s, d):
    rows = view(s, d, "import_rows").groupBy("batch_id").agg(F.array_sort(F.collect_list(F.struct("pos", F.when(F.col("path").endswith("1.jpg"), "hit").otherwise("no").alias("path"), "status"))).alias("imports"))
    return rows.select("batch_id", F.array_join(F.transform(mutate.with_row_status(F.col("imports"), "hit", "ERROR"), lambda x: x["status"]), ",").alias("statuses"))
