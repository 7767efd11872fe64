"""Queries: functions of one row each."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.functions import media, text
from corvane.operators import mutate
from corvane.plans.registry import query
from corvane.session import dealt, table
from corvane.sources import files
from corvane.sources.adapters import ctes, view


@query(
    f"""WITH {ctes('settings_blobs')} SELECT file_id, 'A Seed: of life, Model: T ' || p_name AS prompt, p_brand || ', Size: small' AS negative_prompt, CAST(p_size AS DOUBLE) AS steps, 'Euler a' AS sampler, 7.5 AS cfg_scale, CAST(p_partkey AS DOUBLE) AS seed,
  512 AS width, 768 AS height, substring(md5(p_type), 1, 8) AS model_hash, p_type AS model, p_partkey % 2 = 0 AS is_upscaled, CASE WHEN p_partkey % 2 = 0 THEN 'Latent' END AS hires_upscaler, CASE WHEN p_partkey % 2 = 0 THEN 2.0 END AS hires_scale,
  CASE WHEN p_partkey % 2 = 0 THEN 15.0 END AS hires_steps, CASE WHEN p_partkey % 2 = 0 THEN 0.4 END AS hires_denoising_strength, CASE WHEN p_partkey % 3 = 0 THEN 9.0 END AS subseed, CASE WHEN p_partkey % 3 = 0 THEN 0.25 END AS subseed_strength,
  CASE WHEN p_partkey % 3 = 0 THEN 'CodeFormer' END AS face_restoration, CASE WHEN p_partkey % 7 <> 0 THEN 2.0 END AS clip_skip, CASE WHEN p_partkey % 5 = 0 THEN 'abc123' ELSE 'None' END AS vae_hash,
  CASE WHEN p_partkey % 3 = 0 THEN 'face.pt' END AS detail_model, CASE WHEN p_partkey % 3 = 0 THEN 0.3 END AS confidence, p_partkey % 3 <> 0 AS inpaint_only_masked FROM settings_blobs JOIN part ON file_id = p_partkey"""
)
def settings_parse(s, d):
    # The table may be one small file, that is one task; a row takes long, so rows are dealt first.
    p = dealt(view(s, d, "settings_blobs"), "file_id").select("file_id", text.parameters(F.col("diffusion_params")).alias("p"))
    names = "prompt negative_prompt steps sampler cfg_scale seed width height model_hash model is_upscaled hires_upscaler hires_scale hires_steps hires_denoising_strength subseed subseed_strength face_restoration clip_skip vae_hash".split()
    return p.select("file_id", *(f"p.{c}" for c in names), F.col("p.adetailer.model").alias("detail_model"), "p.adetailer.confidence", "p.adetailer.inpaint_only_masked")


@query(
    f"""WITH {ctes('settings_blobs')} SELECT file_id, 'Diff Model: ' || p_type AS label, 'Model Hash: ' || substring(md5(p_type), 1, 8) AS alias, 'Diffusion Model' AS parent_label,
  CASE WHEN p_partkey % 2 = 0 THEN 'up' ELSE 'orig' END AS kind_tag FROM settings_blobs JOIN part ON file_id = p_partkey"""
)
def model_tags(s, d):
    # The table may be one small file, that is one task; a row takes long, so rows are dealt first.
    p = dealt(view(s, d, "settings_blobs"), "file_id").select("file_id", text.model_tags(text.parameters(F.col("diffusion_params")), "orig", "up", "Diffusion Model").alias("t"))
    return p.select("file_id", "t.*")


@query(
    f"""WITH {ctes('media')} SELECT file_id, lower(ext) IN ('jpg', 'gif') AS is_image, lower(ext) IN ('mp4', 'webm', 'ts') AS is_video, lower(ext) IN ('gif', 'mp4', 'webm', 'ts') AS is_animated, lower(ext) = 'ts' AS is_remuxable,
  coalesce(lower(video_codec) IN ('h264', 'vp9') AND lower(ext) IN ('mp4', 'webm'), false) AS is_web_playable, frame_rate * duration AS total_frames FROM media"""
)
def extension_classes(s, d):
    rows = view(s, d, "media").withColumn("c", text.extension_class(F.col("ext")))
    return rows.select("file_id", "c.*", text.web_playable(F.col("ext"), F.col("video_codec")).alias("is_web_playable"), media.total_frames(F.col("frame_rate"), F.col("duration")).alias("total_frames"))


@query(
    f"""WITH {ctes('media')} SELECT file_id, CAST(greatest(date_modified, date_imported) AS VARCHAR) AS latest, CAST(least(date_created, date_modified, date_imported) AS VARCHAR) AS earliest,
  strftime(CAST(date_modified AS TIMESTAMP), '%Y-%m-%dT%H:%M:%S.000Z') AS iso FROM media"""
)
def file_dates(s, d):
    a, b, c = F.col("date_created"), F.col("date_modified"), F.col("date_imported")
    return view(s, d, "media").select("file_id", text.latest(b, c).cast("string").alias("latest"), text.earliest(a, b, c).cast("string").alias("earliest"), text.iso(b.cast("timestamp")).alias("iso"))


@query(f"WITH {ctes('media')} SELECT file_id, CAST(file_id % 7 * 3600 + file_id % 60 * 60 + file_id % 59 AS DOUBLE) AS seconds, (file_id % 50 + 1) / 1001.0 * 1000 AS rate FROM media")
def clock_values(s, d):
    k = F.col("file_id")
    clock = F.format_string("%d:%02d:%02d", k % 7, k % 60, k % 59)
    return view(s, d, "media").select("file_id", text.seconds(clock).alias("seconds"), text.fraction(F.concat(((k % 50 + 1) * 1000).cast("string"), F.lit("/1001"))).alias("rate"))


@query("SELECT vec_id AS id, len(embedding) AS n, round(CAST(embedding[1] AS DOUBLE), 4) AS first_value FROM embeddings")
def vector_parse(s, d):
    rows = table(s, d, "embeddings").select("vec_id", text.float_array(F.to_json("embedding")).alias("v"))
    return rows.select(F.col("vec_id").alias("id"), F.size("v").cast("long").alias("n"), F.round(F.col("v")[0], 4).alias("first_value"))


@query(f"WITH {ctes('media')} SELECT file_id, CASE WHEN file_id % 2 = 0 THEN '/t/' || file_id || '-thumb.jpg' ELSE '/t/' || file_id || '.jpg' END AS path FROM media")
def picture_path_fix(s, d):
    k = F.col("file_id").cast("string")
    was = F.when(F.col("file_id") % 2 == 0, F.concat(F.lit("/t/"), k, F.lit("-thumb\\.jpg"))).otherwise(F.concat(F.lit("/t/"), k, F.lit(".jpg")))
    return view(s, d, "media").select("file_id", text.fixed_picture_path(was).alias("path"))


@query("SELECT p_partkey AS id, p_name || '|' || p_brand || '|x' AS parts FROM part")
def delimiter_split(s, d):
    blob = F.concat(F.lit(" "), "p_name", F.lit(" ;; "), "p_brand", F.lit(";;x "))
    return table(s, d, "part").select(F.col("p_partkey").alias("id"), F.array_join(text.split_list(blob), "|").alias("parts"))


@query(
    """SELECT l_orderkey AS id, sum(l_quantity - l_tax) AS duration, count(*) AS n FROM lineitem GROUP BY 1"""
)
def splice_duration(s, d):
    pairs = table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_list(F.struct(F.col("l_tax").alias("start"), F.col("l_quantity").cast("double").alias("end"))).alias("pairs"))
    return pairs.select("id", media.splice_duration(F.col("pairs")).alias("duration"), F.size("pairs").cast("long").alias("n"))


@query(
    """WITH p AS (SELECT l_orderkey AS id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS o, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem)
SELECT id, string_agg(CAST(o AS VARCHAR), ',' ORDER BY CASE WHEN n > 2 AND o = 1 THEN 3 WHEN n > 2 AND o = 3 THEN 1 ELSE o END) AS swapped, coalesce(string_agg(CAST(o AS VARCHAR), ',' ORDER BY o) FILTER (o <> 2), '') AS without_second FROM p GROUP BY 1"""
)
def pair_order(s, d):
    rows = table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))).alias("x"))
    pairs = media.numbered(F.transform("x", lambda p, i: F.struct((i + 1).alias("id"), (i + 1).alias("order"))))
    rows = rows.select("id", pairs.alias("pairs"))
    moved = F.when(F.size("pairs") > 2, media.swapped(F.col("pairs"), F.lit(1), F.lit(3))).otherwise(F.col("pairs"))
    ids = lambda a: F.array_join(F.transform(a, lambda p: p["id"].cast("string")), ",")
    return rows.select("id", ids(moved).alias("swapped"), ids(media.without_pair(F.col("pairs"), F.lit(2))).alias("without_second"))


@query(
    f"""WITH {ctes('file_tags')}, h AS (SELECT file_id, list_sort(list(tag_id)) AS t FROM file_tags GROUP BY 1)
SELECT file_id, list_sort(list_distinct(t)) = ['K1', 'P1'] AS same, array_to_string(list_filter(list_concat(['a', 'P1'], t), lambda x: x NOT IN ('P1', 'P2'))[2:4], ',') AS part,
  array_to_string(list_sort(list_distinct(list_transform(t, lambda x: CASE WHEN x = 'P3' THEN 'P4' ELSE x END))), ',') AS replaced FROM h"""
)
def array_algebra(s, d):
    rows = view(s, d, "file_tags").groupBy("file_id").agg(F.sort_array(F.collect_set("tag_id")).alias("t"))
    many = lambda *x: F.array(*map(F.lit, x))
    return rows.select(
        "file_id", mutate.same_set(F.col("t"), many("P1", "K1")).alias("same"), F.array_join(mutate.concat_without([many("a", "P1"), F.col("t")], many("P1", "P2"), 1, 3), ",").alias("part"),
        F.array_join(F.sort_array(mutate.replaced(F.col("t"), "P3", "P4", F.array().cast("array<string>"))), ",").alias("replaced"),
    )


@query(f"WITH {ctes('media')} SELECT 'http' AS side, count(*) AS n FROM media WHERE video_codec = 'h264' UNION ALL SELECT 'other', count(*) FROM media WHERE NOT coalesce(video_codec = 'h264', false)")
def divided_rows(s, d):
    yes, no = mutate.divided(view(s, d, "media"), F.col("video_codec") == "h264")
    return yes.agg(F.lit("http").alias("side"), F.count("*").alias("n")).unionByName(no.agg(F.lit("other").alias("side"), F.count("*").alias("n")))


@query(f"WITH {ctes('media')} SELECT file_id, '/store/' || substring(hash, 1, 2) || '/' || substring(hash, 3, 2) || '/' || hash || '.' || lower(ext) AS path FROM media")
def storage_paths(s, d):
    return view(s, d, "media").select("file_id", files.storage_path(F.lit("/store"), F.col("hash"), F.lower("ext")).alias("path"))


@query(
    f"""WITH RECURSIVE {ctes('media')}, u AS MATERIALIZED (SELECT file_id, size, row_number() OVER (ORDER BY file_id) AS k FROM media),
f AS (SELECT CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS file_id, CAST(NULL AS VARCHAR) AS storage, CAST(1000000000 AS BIGINT) AS a, CAST(2000000000 AS BIGINT) AS b, CAST(500000000 AS BIGINT) AS a2
  UNION ALL SELECT u.k, u.file_id, CASE WHEN a > size THEN 'a' WHEN b > size THEN 'b' WHEN a2 > size THEN 'a2' END, CASE WHEN a > size THEN a - size ELSE a END,
    CASE WHEN a <= size AND b > size THEN b - size ELSE b END, CASE WHEN a <= size AND b <= size AND a2 > size THEN a2 - size ELSE a2 END FROM f JOIN u ON u.k = f.k + 1)
SELECT file_id, storage FROM f WHERE k > 0"""
)
def storage_choice(s, d):
    rows = view(s, d, "media").select(F.col("file_id").alias("key"), "size")
    return files.choose_storage(rows, [("a", 1_000_000_000), ("b", 2_000_000_000), ("a2", 500_000_000)]).select(F.col("key").alias("file_id"), "storage")


@query(f"WITH {ctes('files')} SELECT row_number() OVER (ORDER BY -file_id) - 1 AS position, original_path AS line FROM files WHERE file_id <= 40 AND file_id > 10".replace("AND file_id > 10", "AND file_id >= 11"))
def playlist(s, d):
    rows = view(s, d, "files").select("file_id", F.col("original_path").alias("path"))
    return files.playlist(rows, list(range(50, 0, -1)), 10, 40).select(F.col("position").cast("long").alias("position"), "line")
