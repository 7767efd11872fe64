"""Folders as a source, and batches of changes to tables of many files."""

import hashlib
import os
import random
from datetime import UTC, datetime

import pytest

from corvane.session import cut
from corvane.sources import batches, folders


def test_media_folders(spark, tmp_path):
    (tmp_path / "in/deep").mkdir(parents=True)
    for name, data in (("a.JPG", "xx"), ("a.txt", "Steps: 3"), ("a.JPG.json", '{"tags": [{"label": "t"}, {"no": 1}]}'), ("b.mp4", ""), ("b.mp4.json", "not json"), ("deep/c.jpg", "c"), ("deep/[[Collection]].json", '{"tags": [{"label": "all"}]}')):
        (tmp_path / "in" / name).write_text(data)
    os.utime(tmp_path / "in/a.JPG", (1_000_000_000, 1_000_000_000))
    rows = {r["name"]: r for r in folders.media_folders(spark, str(tmp_path / "in"), ["jpg", "MP4"]).collect()}
    assert {n: (r["extension"], r["size"], r["side_text"], r["side_tags"], r["folder_tags"]) for n, r in rows.items()} == {
        "a": ("jpg", 2, "Steps: 3", ["t"], None), "b": ("mp4", 0, None, None, None), "c": ("jpg", 1, None, None, ["all"]),
    }
    assert rows["a"]["date_created"].astimezone(UTC) == datetime.fromtimestamp(1_000_000_000, UTC) and rows["a"]["status"] == "PENDING"
    # Filters on the extension are pushed, and a narrow schema reads no side file.
    one = folders.media_folders(spark, str(tmp_path / "in"), columns=["path", "extension"]).where("extension = 'mp4'")
    assert [tuple(r) for r in one.collect()] == [(str(tmp_path / "in/b.mp4"), "mp4")]
    everything = folders.media_folders(spark, str(tmp_path / "in"))
    assert everything.count() == 7 and everything.rdd.getNumPartitions() == 2
    with pytest.raises(Exception, match="no columns"):
        spark.read.format("media_folders").option("path", str(tmp_path)).schema("other string").load().collect()


def files_of(folder):
    return {str(p): hashlib.md5(p.read_bytes()).hexdigest() for p in folder.rglob("*.parquet") if "manifests" not in str(p)}


def test_batches_rewrite_files_with_hits(spark, tmp_path):
    r = random.Random(1)
    want = {i: f"v{i}" for i in range(0, 2000, 2)}
    table = batches.create(spark.createDataFrame(list(want.items()), "id long, name string"), str(tmp_path / "t"), "id", 20)
    assert table.manifest.count() == 20 and table.rows().count() == 1000
    for turn in range(3):
        seen = files_of(tmp_path / "t")
        ids = r.sample(range(100 * turn, 100 * turn + 160), 12)
        changes = [(n, r.choice(["upsert", "delete", "insert", "update"]), i, f"new{turn}-{n}") for n, i in enumerate(ids + ids[:4])]
        for _, op, i, name in changes:
            want.pop(i, None)
            if op != "delete":
                want[i] = name
        before = {x["file"] for x in table.manifest.collect()}
        table = batches.apply_batch(table, spark.createDataFrame(changes, "seq long, op string, id long, name string"))
        assert {x["id"]: x["name"] for x in table.rows().collect()} == want
        after = {x["file"] for x in table.manifest.collect()}
        assert len(before - after) <= 3 and len(before & after) >= 16  # files without a hit stay
        now = files_of(tmp_path / "t")
        assert all(now[f] == h for f, h in seen.items())
    few = table.rows_of(spark.createDataFrame([(4,), (1998,), (-5,)], "id long"))
    assert {x["id"]: x["name"] for x in few.collect()} == {i: want[i] for i in (4, 1998, -5) if i in want}


def test_batch_that_fails_half_way(spark, tmp_path):
    table = batches.create(spark.createDataFrame([(i, "a") for i in range(10)], "id long, name string"), str(tmp_path / "t"), "id", 2)
    schema = "seq long, op string, id long, name string"
    # The data of the next version is there, but its manifest was never finished.
    cut(spark.range(1)).write.parquet(f"{tmp_path}/t/manifests/v1")
    (tmp_path / "t/manifests/v1/_SUCCESS").unlink()
    assert batches.open_table(spark, str(tmp_path / "t"), "id", table.schema).version == 0
    after = batches.apply_batch(table, spark.createDataFrame([(1, "update", 3, "b"), (2, "delete", 4, None), (3, "insert", 50, "c")], schema))
    assert after.version == 1 and {r["id"]: r["name"] for r in after.rows().collect()} == {**{i: "a" for i in range(10) if i != 4}, 3: "b", 50: "c"}
    gone = batches.apply_batch(after, spark.createDataFrame([(i, "delete", i, None) for i in range(60)], schema))
    assert gone.rows().count() == 0
