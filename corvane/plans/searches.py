"""Queries: searches over media files, collections, import batches and tags; lists, lookups, ranks and selections."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import functions as F

from corvane.operators import collections, entities, graph, joins, predicates, search
from corvane.operators.predicates import TagChoice
from corvane.plans.registry import closed_ctes, query
from corvane.session import table
from corvane.sources.adapters import ctes, view


@query(
    f"""WITH {ctes('media')} SELECT file_id, CAST(date_modified AS VARCHAR) AS date_modified, height, bitrate FROM media WHERE NOT is_archived AND media.date_modified >= DATE '1993-06-01' AND media.date_modified <= DATE '1998-01-31' AND date_imported >= DATE '1993-01-01'
  AND height >= 300 AND height <= 900 AND width <= 1200 AND bitrate > 400000 AND duration >= 10 AND frame_rate <> 30 AND coalesce(diffusion_params, '') <> '' AND coalesce(audio_codec NOT IN ('mp3', 'opus'), true) AND coalesce(video_codec NOT IN ('VP9'), true)"""
)
def media_search(s, d):
    q = predicates.FileQuery(
        ranges={"date_modified": (date(1993, 6, 1), date(1998, 1, 31)), "date_imported": (date(1993, 1, 1), None), "height": (300, 900), "width": (None, 1200)},
        compares={"bitrate": (">", 400_000), "duration": (">=", 10), "frame_rate": ("!=", 30)}, has_params=True, deselected={"audio_codec": ("mp3", "opus"), "video_codec": ("VP9",)},
    )
    return q.chosen(view(s, d, "media")).select("file_id", F.col("date_modified").cast("string").alias("date_modified"), "height", "bitrate")


@query(
    f"""WITH {ctes('media')} SELECT file_id, 'modified' AS kind FROM media WHERE NOT is_archived AND coalesce(original_hash, '') <> '' AND hash <> original_hash
UNION ALL SELECT file_id, 'unmodified' FROM media WHERE NOT is_archived AND coalesce(original_hash, '') <> '' AND hash = original_hash"""
)
def is_modified(s, d):
    rows = view(s, d, "media")
    ask = lambda wanted, kind: predicates.FileQuery(is_modified=wanted).chosen(rows).select("file_id", F.lit(kind).alias("kind"))
    return ask(True, "modified").unionByName(ask(False, "unmodified"))


@query(f"WITH {ctes('media')} SELECT file_id FROM media WHERE is_archived AND file_id IN (10, 20, 25, 30)")
def ids_in(s, d):
    return predicates.FileQuery(ids=(10, 20, 25, 30), is_archived=True).chosen(view(s, d, "media")).select("file_id")


COLLECTION_TAGS = "coll_tags AS (SELECT DISTINCT collection_id, tag_id FROM coll_orders JOIN file_tags USING (file_id))"


def collection_tags(s, d):
    return view(s, d, "coll_orders").join(view(s, d, "file_tags"), "file_id").select("collection_id", "tag_id").distinct()


@query(
    f"""{closed_ctes("collections", "coll_orders", "file_tags")}, {COLLECTION_TAGS},
wide AS (SELECT DISTINCT collection_id, ancestor FROM coll_tags JOIN closed ON tag_id = tag)
SELECT collection_id, title, file_count, size FROM collections WHERE date_created >= TIMESTAMP '1992-02-01' AND date_modified <= TIMESTAMP '1998-12-31' AND size >= 1000000 AND size <= 900000000 AND rating >= 2 AND file_count > 3
  AND regexp_matches(title, '(?i)customer#0.*[1-5]$') AND collection_id IN (SELECT collection_id FROM wide WHERE ancestor = 'B:Brand#2') AND collection_id NOT IN (SELECT collection_id FROM wide WHERE ancestor = 'R3')
ORDER BY size DESC, collection_id DESC LIMIT 30"""
)
def collection_search(s, d):
    q = entities.EntityQuery(
        ranges={"date_created": (datetime(1992, 2, 1), None), "date_modified": (None, datetime(1998, 12, 31)), "size": (1_000_000, 900_000_000)}, compares={"rating": (">=", 2), "file_count": (">", 3)},
        patterns={"title": "customer#0.*[1-5]$"}, tags=TagChoice(all_of_desc=("B:Brand#2",), none_of_desc=("R3",)),
    )
    rows = entities.collections(view(s, d, "collections"), collection_tags(s, d), view(s, d, "edges"), q)
    return search.page(rows, entities.checked_key("collection", "size"), True, 1, 30, "collection_id").select("collection_id", "title", "file_count", "size")


@query(
    f"""WITH {ctes('batches', 'batch_tags', 'import_rows', 'tags', 'edges')} SELECT batch_id, file_count, collection_title FROM batches WHERE is_completed AND completed_at >= TIMESTAMP '1993-01-01' AND started_at <= TIMESTAMP '1998-06-01' AND date_created >= TIMESTAMP '1992-06-01'
  AND file_count >= 2 AND regexp_matches(collection_title, '(?i)^SET [1-8]') AND batch_id IN (SELECT batch_id FROM import_rows WHERE regexp_matches(path, '(?i)[1-6]\\.jpg$')) AND batch_id NOT IN (SELECT batch_id FROM batch_tags WHERE tag_id IN ('P1', 'P2', 'P9'))
  AND batch_id IN (SELECT batch_id FROM batch_tags JOIN edges ON tag_id = child WHERE parent = 'Y:STANDARD')"""
)
def batch_search(s, d):
    q = entities.BatchQuery(
        ranges={"completed_at": (datetime(1993, 1, 1), None), "started_at": (None, datetime(1998, 6, 1)), "date_created": (datetime(1992, 6, 1), None)}, compares={"file_count": (">=", 2)},
        patterns={"collection_title": "^SET [1-8]"}, is_completed=True, import_path=r"[1-6]\.jpg$", tags=TagChoice(none_of=("P1", "P2", "P9"), all_of_desc=("Y:STANDARD",)),
    )
    return entities.batches(view(s, d, "batches"), view(s, d, "batch_tags"), view(s, d, "import_rows"), view(s, d, "edges"), q).select("batch_id", "file_count", "collection_title")


@query(f"WITH {ctes('batches')} SELECT batch_id, CAST(CAST(date_created AS DATE) AS VARCHAR) AS day FROM batches WHERE NOT is_completed ORDER BY batches.date_created DESC, batch_id DESC LIMIT 20")
def batch_page(s, d):
    rows = entities.BatchQuery().chosen(view(s, d, "batches"), "batch_id")
    return search.page(rows, entities.checked_key("batch", "date_created"), True, 1, 20, "batch_id").select("batch_id", F.to_date("date_created").cast("string").alias("day"))


@query(
    f"""WITH {ctes('tag_facts', 'edges')} SELECT tag_id, label, count FROM tag_facts t WHERE date_of_inception >= '1970' AND date_of_inception <= '1995-01-01' AND date_created >= DATE '2020-01-10' AND count >= 5 AND size > 90000 AND rating <> 3
  AND regexp_matches(label, '(?i)(RED|hot|old)') AND regexp_matches(alias, '(?i)brand#[1-3]') AND coalesce(regex, '') <> '' AND tag_id NOT IN ('P5', 'P8') AND tag_id IN (SELECT child FROM edges WHERE parent = 'Y:STANDARD')"""
)
def tag_query(s, d):
    q = entities.TagQuery(
        ranges={"date_of_inception": ("1970", "1995-01-01"), "date_created": (date(2020, 1, 10), None)}, compares={"count": (">=", 5), "size": (">", 90_000), "rating": ("!=", 3)}, patterns={"label": "(RED|hot|old)"},
        alias_pattern="brand#[1-3]", has_regex=True, tags=TagChoice(none_of=("P5", "P8"), all_of_desc=("Y:STANDARD",)),
    )
    return entities.tags(view(s, d, "tag_facts").withColumn("aliases", F.array("alias")), view(s, d, "edges"), q).select("tag_id", "label", "count")


@query(f"WITH {ctes('tag_facts')} SELECT tag_id FROM tag_facts WHERE coalesce(regex, '') = '' AND tag_id IN ('P1', 'P3', 'P4', 'P6', 'P7')")
def tag_query_without_regex(s, d):
    return entities.tags(view(s, d, "tag_facts"), view(s, d, "edges"), entities.TagQuery(has_regex=False, tags=TagChoice(any_of=("P1", "P3", "P4", "P6", "P7")))).select("tag_id")


@query(
    f"""WITH {ctes('media')} SELECT file_id, concat_ws(',', CASE WHEN bitrate IS NOT NULL AND original_bitrate IS NULL THEN 'bitrate' END, CASE WHEN video_codec IS NOT NULL AND coalesce(original_video_codec, '') = '' THEN 'video_codec' END) AS missing
FROM media WHERE lower(ext) IN ('mp4', 'webm', 'ts') AND ((bitrate IS NOT NULL AND original_bitrate IS NULL) OR (video_codec IS NOT NULL AND coalesce(original_video_codec, '') = ''))"""
)
def missing_original(s, d):
    a, b = predicates.missing_original("bitrate", "original_bitrate"), predicates.missing_original("video_codec", "original_video_codec")
    rows = view(s, d, "media").where(F.lower("ext").isin("mp4", "webm", "ts") & (a | b))
    return rows.select("file_id", F.concat_ws(",", F.when(a, "bitrate"), F.when(b, "video_codec")).alias("missing"))


@query(f"WITH {ctes('media')} SELECT file_id FROM media WHERE lower(ext) IN ('mp4', 'webm', 'ts') AND (bitrate IS NULL OR coalesce(audio_codec, '') = '' OR duration IS NULL OR coalesce(video_codec, '') = '')")
def missing_any_info(s, d):
    return view(s, d, "media").where(F.lower("ext").isin("mp4", "webm", "ts") & predicates.missing_info(["bitrate", "audio_codec", "duration", "video_codec"])).select("file_id")


@query(
    closed_ctes("files", "file_tags")
    + """, wide AS (SELECT DISTINCT file_id, ancestor FROM file_tags JOIN closed ON tag_id = tag)
SELECT file_id FROM files WHERE NOT is_archived AND file_id IN (SELECT file_id FROM wide WHERE ancestor = 'R1') AND file_id NOT IN (SELECT file_id FROM wide WHERE ancestor = 'B:Brand#1')
  AND file_id IN (SELECT file_id FROM file_tags WHERE tag_id IN ('K1', 'K2', 'K3', 'K4', 'K5', 'K6', 'K7', 'K8', 'K9', 'K10', 'K11', 'K12')) AND file_id NOT IN (SELECT file_id FROM file_tags WHERE tag_id = 'P3')"""
)
def picked_tags(s, d):
    picked = [("R1", "includeDesc"), ("B:Brand#1", "excludeDesc"), *((f"K{i}", "includeOr") for i in range(1, 13)), ("P3", "exclude")]
    rows = predicates.FileQuery().chosen(view(s, d, "files"))
    return graph.with_tags_chosen(rows, view(s, d, "file_tags"), view(s, d, "edges"), entities.choice_of(picked), "file_id").select("file_id")


@query(f"WITH {ctes('media')} SELECT file_id, 'id' AS by_what FROM media WHERE file_id = 42 UNION ALL SELECT file_id, 'hash' FROM media WHERE hash = md5('77')")
def point_lookup(s, d):
    rows = view(s, d, "media")
    return entities.found(rows, "file_id", 42).select("file_id", F.lit("id").alias("by_what")).unionByName(entities.found(rows.where("true"), "hash", "28dd2c7955ce926456240b2ff0100bde").select("file_id", F.lit("hash").alias("by_what")))


@query(f"WITH {ctes('media')} SELECT file_id FROM media WHERE ext IN ('mp4', 'ts') AND rating_free >= 300 ORDER BY date_created DESC, file_id DESC LIMIT 50 OFFSET 50".replace("rating_free", "height"))
def generic_list(s, d):
    return entities.listed(view(s, d, "media"), "file", {"ext": ["mp4", "ts"], "height": {"$gte": 300}}, "file_id", number=2, size=50).select("file_id")


@query(f"WITH {ctes('tombstones')} SELECT hash FROM tombstones ORDER BY hash DESC LIMIT 25")
def deleted_list(s, d):
    return entities.listed(view(s, d, "tombstones"), "deleted_file", id_col="hash", number=1, size=25)


@query(f"WITH {ctes('files')} SELECT file_id, r AS rank FROM (SELECT file_id, row_number() OVER (ORDER BY size DESC NULLS LAST, file_id DESC) - 1 AS r FROM files) WHERE file_id IN (1, 10, 100)")
def rank_of_row_desc(s, d):
    return search.ranks(view(s, d, "files"), "size", "file_id", [1, 10, 100], True)


@query(
    f"""WITH {ctes('media')} SELECT file_id, r AS rank FROM (SELECT file_id, row_number() OVER (ORDER BY bitrate DESC NULLS LAST, file_id DESC) - 1 AS r FROM media) WHERE file_id IN (4, 9, 104)
UNION ALL SELECT -file_id, r FROM (SELECT file_id, row_number() OVER (ORDER BY bitrate NULLS FIRST, file_id) - 1 AS r FROM media) WHERE file_id IN (4, 9, 104)"""
)
def rank_with_nulls(s, d):
    rows = view(s, d, "media")
    up = search.ranks(rows, "bitrate", "file_id", [4, 9, 104]).withColumn("file_id", -F.col("file_id"))
    return search.ranks(rows, "bitrate", "file_id", [4, 9, 104], True).unionByName(up)


def _shift_sql(order: str) -> str:
    return f"""WITH {ctes('files')}, f AS (SELECT file_id, row_number() OVER (ORDER BY {order}) AS r FROM files WHERE NOT is_archived),
b AS (SELECT (SELECT r FROM f WHERE file_id = 33) AS c, (SELECT min(r) FROM f WHERE file_id IN (3, 7, 99)) AS lo, (SELECT max(r) FROM f WHERE file_id IN (3, 7, 99)) AS hi),
i AS (SELECT file_id FROM f, b WHERE r BETWEEN least(c, lo) AND CASE WHEN lo > c THEN hi ELSE c END)
SELECT file_id, 'select' AS action FROM i WHERE file_id NOT IN (3, 7, 99) UNION ALL SELECT v, 'deselect' FROM (VALUES (3), (7), (99)) t(v) WHERE v NOT IN (SELECT file_id FROM i)"""


@query(_shift_sql("date_created DESC, file_id DESC"))
def shift_select_desc(s, d):
    return search.shift_select(view(s, d, "files").where("not is_archived"), "date_created", "file_id", 33, [3, 7, 99], True)


@query(
    f"""WITH {ctes('coll_orders', 'collections', 'file_tags', 'tags')}, {COLLECTION_TAGS}
SELECT collection_id, string_agg(t.tag_id || ':' || t.label, '|' ORDER BY t.tag_id, t.label) AS tags FROM coll_tags JOIN tags t USING (tag_id) WHERE collection_id IN (SELECT collection_id FROM coll_orders WHERE file_id % 100 = 7) GROUP BY 1"""
)
def collections_with_tags(s, d):
    out = joins.collections_with_tags(view(s, d, "collections").select("collection_id"), view(s, d, "coll_orders"), view(s, d, "files").where("file_id % 100 = 7"), collection_tags(s, d), view(s, d, "tags"))
    return out.select("collection_id", F.array_join(F.transform("tags", lambda t: F.concat(t["tag_id"], F.lit(":"), t["label"])), "|").alias("tags"))


@query("SELECT conv_id AS id, CASE WHEN turn % 2 = 0 THEN '[5]' WHEN turn % 3 = 0 THEN '[1, 2]' ELSE '[1, 2, 5]' END AS clicked, CASE WHEN turn % 3 = 0 THEN '[2, 9]' ELSE '[1, 2, 9]' END AS toggled FROM conversations")
def selection_algebra(s, d):
    k, many = F.col("turn"), lambda *x: F.array(*map(F.lit, x))
    own = F.when(k % 3 == 0, many(1, 2, 5)).otherwise(many(1, 2))
    clicked = entities.clicked(own, F.lit(5), k % 2 != 0)
    toggled = entities.toggled(many(1, 2), many(9, 2), F.when(k % 3 == 0, many(1)).otherwise(many(7)))
    as_text = lambda a: F.concat(F.lit("["), F.array_join(F.transform(a, lambda x: x.cast("string")), ", "), F.lit("]"))
    return table(s, d, "conversations").select(F.col("conv_id").alias("id"), as_text(clicked).alias("clicked"), as_text(toggled).alias("toggled"))


@query(f"WITH {ctes('coll_orders')} SELECT collection_id, file_id, idx FROM coll_orders ORDER BY collection_id, idx DESC")
def custom_order_desc(s, d):
    return collections.in_order(view(s, d, "coll_orders"), True).select("collection_id", "file_id", "idx")


@query(
    f"""WITH {ctes('files')}, p AS (SELECT file_id AS pos, original_path AS path, regexp_replace(original_path, '/[^/]*$', '') AS folder FROM files)
SELECT folder, min(pos) OVER (PARTITION BY folder) AS first_pos, pos, path FROM p"""
)
def paths_by_folder(s, d):
    return collections.by_folder(view(s, d, "files").select(F.col("file_id").alias("pos"), F.col("original_path").alias("path")))
