"""The engine's entities as views over the test tables, in SQL that Spark and DuckDB both run."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from corvane.session import dealt, table

VIEWS = {
    "tags": """
        SELECT 'W' AS tag_id, 'World' AS label
        UNION ALL SELECT concat('R', CAST(r_regionkey AS STRING)), r_name FROM {region}
        UNION ALL SELECT concat('N', CAST(n_nationkey AS STRING)), n_name FROM {nation}
        UNION ALL SELECT concat('K', CAST(c_custkey AS STRING)), c_name FROM {customer}
        UNION ALL SELECT concat('S', CAST(s_suppkey AS STRING)), s_name FROM {supplier}
        UNION ALL SELECT DISTINCT concat('B:', p_brand), p_brand FROM {part}
        UNION ALL SELECT DISTINCT concat('Y:', p_type), p_type FROM {part}
        UNION ALL SELECT concat('P', CAST(p_partkey AS STRING)), p_name FROM {part}""",
    "edges": """
        SELECT concat('R', CAST(r_regionkey AS STRING)) AS child, 'W' AS parent FROM {region}
        UNION ALL SELECT concat('N', CAST(n_nationkey AS STRING)), concat('R', CAST(n_regionkey AS STRING)) FROM {nation}
        UNION ALL SELECT concat('K', CAST(c_custkey AS STRING)), concat('N', CAST(c_nationkey AS STRING)) FROM {customer}
        UNION ALL SELECT concat('S', CAST(s_suppkey AS STRING)), concat('N', CAST(s_nationkey AS STRING)) FROM {supplier}
        UNION ALL SELECT concat('P', CAST(p_partkey AS STRING)), concat('B:', p_brand) FROM {part}
        UNION ALL SELECT concat('P', CAST(p_partkey AS STRING)), concat('Y:', p_type) FROM {part}""",
    "files": """
        SELECT o.o_orderkey AS file_id, o.o_orderdate AS date_created, CAST(round(o.o_totalprice * 100) AS BIGINT) AS size,
               CAST(o.o_orderkey % 6 AS INT) AS rating, o.o_orderpriority AS ext, o.o_orderstatus AS video_codec,
               (o.o_orderkey % 10 = 0) AS is_archived, CASE WHEN o.o_orderkey % 7 = 0 THEN NULL ELSE o.o_orderkey % 3 = 0 END AS is_corrupted,
               concat('/lib/', c.c_mktsegment, '/', n.n_name, '/', c.c_name, '/', CAST(o.o_orderkey AS STRING), CASE WHEN o.o_orderkey % 5 = 0 THEN '.MP4' ELSE '.jpg' END) AS original_path
        FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey JOIN {nation} n ON c.c_nationkey = n.n_nationkey""",
    "file_tags": """
        SELECT o_orderkey AS file_id, concat('K', CAST(o_custkey AS STRING)) AS tag_id FROM {orders}
        UNION SELECT o.o_orderkey, concat('P', CAST(l.l_partkey AS STRING)) FROM {orders} o JOIN {lineitem} l ON l.l_orderkey = o.o_orderkey""",
    # The same pairs as they come: some several times, and those of lines without an order, for what takes each once and asks for the files itself.
    "file_tags_raw": """
        SELECT o_orderkey AS file_id, concat('K', CAST(o_custkey AS STRING)) AS tag_id FROM {orders}
        UNION ALL SELECT l_orderkey, concat('P', CAST(l_partkey AS STRING)) FROM {lineitem}""",
    "coll_orders": """
        SELECT o_custkey AS collection_id, o_orderkey AS file_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS INT) AS idx FROM {orders}""",
    "coll_parts_raw": """
        SELECT l_orderkey AS collection_id, l_partkey AS file_id,
               CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity, l_discount, l_tax) - 1 AS INT) AS idx FROM {lineitem}""",
    "import_rows": """
        SELECT l_orderkey AS batch_id,
               CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity, l_discount, l_tax) - 1 AS INT) AS pos,
               concat('/in/', CAST(l_orderkey AS STRING), '/', CAST(l_partkey AS STRING), '.jpg') AS path, CAST(round(l_extendedprice * 100) AS BIGINT) AS size,
               CASE WHEN l_partkey % 19 <> 4 THEN md5(concat(CAST(l_partkey AS STRING), '-', CAST(l_suppkey AS STRING))) END AS hash,
               CASE l_returnflag WHEN 'A' THEN 'PENDING' WHEN 'R' THEN 'DUPLICATE' ELSE 'COMPLETE' END AS status FROM {lineitem}""",
    "doc_files": """
        SELECT doc_id AS file_id, CASE WHEN doc_id % 13 <> 9 THEN md5(text) END AS hash, n_chars AS size, lang AS ext, concat('/data/', source, '/', lang, '/', CAST(doc_id AS STRING), '.TXT') AS original_path FROM {documents}""",
    "media": """
        SELECT o_orderkey AS file_id, CAST(o_orderdate AS DATE) AS date_created, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 50 AS INT) AS date_modified, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 9 AS INT) AS date_imported,
               CAST(200 + o_orderkey % 900 AS INT) AS height, CAST(300 + o_orderkey % 1100 AS INT) AS width, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE CAST(o_orderkey % 5000 AS BIGINT) * 1000 END AS bitrate,
               CAST(o_orderkey % 600 AS DOUBLE) AS duration, CAST(20 + o_orderkey % 41 AS DOUBLE) AS frame_rate, CAST(round(o_totalprice * 100) AS BIGINT) AS size,
               CASE o_orderkey % 3 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 'Steps: 20' END AS diffusion_params, CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'aac' WHEN 2 THEN 'mp3' ELSE 'opus' END AS audio_codec,
               CASE o_orderkey % 6 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'VP9' ELSE 'h264' END AS video_codec, CASE o_orderkey % 5 WHEN 0 THEN 'mp4' WHEN 1 THEN 'JPG' WHEN 2 THEN 'webm' WHEN 3 THEN 'gif' ELSE 'ts' END AS ext,
               md5(CAST(o_orderkey AS STRING)) AS hash, CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN md5(CAST(o_orderkey AS STRING)) ELSE 'was' END AS original_hash,
               CASE WHEN o_orderkey % 7 < 3 THEN NULL ELSE CAST(o_orderkey % 5000 AS BIGINT) * 1000 END AS original_bitrate, CASE o_orderkey % 8 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 'h264' END AS original_video_codec,
               o_orderkey % 10 = 0 AS is_archived FROM {orders}""",
    "collections": """
        SELECT c_custkey AS collection_id, c_name AS title, min(o_orderdate) AS date_created, max(o_orderdate) AS date_modified, count(o_orderkey) AS file_count,
               CAST(coalesce(sum(round(o_totalprice * 100)), 0) AS BIGINT) AS size, CAST(c_custkey % 6 AS DOUBLE) AS rating FROM {customer} LEFT JOIN {orders} ON o_custkey = c_custkey GROUP BY c_custkey, c_name""",
    "batches": """
        SELECT l_orderkey AS batch_id, min(l_shipdate) AS date_created, CASE WHEN l_orderkey % 3 = 0 THEN max(l_shipdate) END AS completed_at, CASE WHEN l_orderkey % 4 <> 3 THEN min(l_shipdate) END AS started_at,
               count(*) AS file_count, CAST(sum(round(l_extendedprice * 100)) AS BIGINT) AS size, l_orderkey % 3 = 0 AS is_completed, CASE WHEN l_orderkey % 5 = 0 THEN NULL ELSE concat('Set ', CAST(l_orderkey % 100 AS STRING)) END AS collection_title FROM {lineitem} GROUP BY l_orderkey""",
    "batch_tags": "SELECT DISTINCT l_orderkey AS batch_id, concat('P', CAST(l_partkey AS STRING)) AS tag_id FROM {lineitem} WHERE l_linenumber = 1",
    "batch_files": """
        SELECT l_orderkey AS batch_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity, l_discount, l_tax) - 1 AS INT) AS pos,
               l_partkey AS file_id, CASE WHEN l_orderkey % 3 = 0 AND l_returnflag = 'A' THEN 'DUPLICATE' WHEN l_returnflag = 'A' THEN 'PENDING' WHEN l_returnflag = 'R' THEN 'DUPLICATE' ELSE 'COMPLETE' END AS status FROM {lineitem}""",
    "tag_facts": """
        SELECT concat('P', CAST(p_partkey AS STRING)) AS tag_id, p_name AS label, concat(p_brand, ' ', p_type) AS alias, CASE p_partkey % 3 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE p_name END AS regex,
               CAST(p_size AS BIGINT) AS count, CAST(round(p_retailprice * 100) AS BIGINT) AS size, CAST(p_partkey % 6 AS DOUBLE) AS rating, concat('19', CAST(60 + p_partkey % 40 AS STRING), '-05-01') AS date_of_inception,
               DATE '2020-01-01' + CAST(p_partkey % 900 AS INT) AS date_created, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE DATE '2021-01-01' + CAST(p_partkey % 30 AS INT) END AS last_searched FROM {part}""",
    "settings_blobs": """
        SELECT p_partkey AS file_id, concat('A Seed: of life, Model: T ', p_name, chr(10), 'Negative prompt: ', p_brand, ', Size: small', chr(10), 'Steps: ', CAST(p_size AS STRING), ', Sampler: Euler a, CFG scale: 7.5, Seed: ',
               CAST(p_partkey AS STRING), ', Size: 512x768, Model hash: ', substring(md5(p_type), 1, 8), ', Model: ', p_type, CASE WHEN p_partkey % 2 = 0 THEN ', Hires upscaler: Latent, Hires scale: 2, Hires steps: 15, Hires denoising strength: 0.4' ELSE '' END,
               CASE WHEN p_partkey % 3 = 0 THEN ', Variation seed: 9, Variation seed strength: 0.25, Face restoration: CodeFormer, ADetailer model: face.pt, ADetailer confidence: 0.3, ADetailer inpaint only masked: False' ELSE '' END,
               CASE WHEN p_partkey % 5 = 0 THEN ', Hashes: ["vae": "abc123", "model": "x"]' ELSE '' END, CASE WHEN p_partkey % 7 = 0 THEN ', Clip skip: two' ELSE ', Clip skip: 2' END) AS diffusion_params FROM {part}""",
    "tombstones": "SELECT DISTINCT md5(text) AS hash FROM {documents} WHERE doc_id % 7 = 0",
    "param_blobs": """
        SELECT p_partkey AS file_id, concat(p_name, chr(10), 'Negative prompt: ', p_brand, chr(10), 'Steps: ', CAST(p_size AS STRING),
               ', Sampler: Euler a, CFG scale: 7, Seed: ', CAST(p_partkey AS STRING), ', Size: 512x768, Model hash: ', substring(md5(p_type), 1, 8), ', Model: ', p_type,
               CASE WHEN p_partkey % 2 = 0 THEN ', Hires upscaler: Latent' ELSE '' END) AS diffusion_params FROM {part}""",
}


def _tables(name: str) -> list[str]:
    return sorted(set(re.findall(r"\{(\w+)\}", VIEWS[name])))


#: Views whose window goes by an order of lineitem: its rows are dealt by that key into small tasks first.
BY_ORDER = ("coll_parts_raw", "batch_files")


def view(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The view of a name. Wide views are dealt by the key that what follows asks for, so that no task sorts or holds much and rows move once."""
    tables = {t: table(spark, folder, t) for t in _tables(name)}
    if name in BY_ORDER:
        tables["lineitem"] = dealt(tables["lineitem"], "l_orderkey")
    if name == "file_tags":
        # UNION as UNION ALL and a distinct within each file: the same rows, dealt by file instead of by pair.
        return dealt(spark.sql(VIEWS[name].replace("UNION SELECT", "UNION ALL SELECT"), **tables), "file_id").distinct()
    return spark.sql(VIEWS[name], **tables)


def ctes(*names: str) -> str:
    """The views as common table expressions for DuckDB, without WITH."""
    return ",\n".join(f"{n} AS ({VIEWS[n].format(**{t: t for t in _tables(n)}).replace('AS STRING', 'AS VARCHAR')})" for n in names)
