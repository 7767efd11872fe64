"""Tokens, packing, sorted-string tables, resharding and revisits."""

import io
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.llm import packing, reshard, revisits, sstable
from corvane.llm.queries import tokenizer
from corvane.llm.tokens import WordEncoder

ODD = ["It's DON'T we'll'll a'S !!'s ''s don't. É.É É! ÑÁ. á.  b. x<|endoftext|>, <|ENDOFTEXT|>. a\x01b \x01 \x01. 12. a1. 1a, ...''' ﬁ. ǅ. İ. ΑΣ. ß. w\u0085x. ", "<|endoftext|> a.\x1c b", "a.b.c. -- --a-- (x) [y]. $5.00!", "", " \n", "é ö."]


def encode(text, end):
    from tokenizers import Tokenizer

    ids = Tokenizer.from_file(tokenizer()).encode(text or "", add_special_tokens=False).ids
    return np.array([*ids, end], "<u4")


def test_words_encode_like_whole_texts():
    got = WordEncoder(tokenizer(), memo=3).encode_all([*ODD, None])
    assert [g for g in got] == [encode(t, 0)[:-1].tobytes() for t in [*ODD, None]]


def texts():
    r = random.Random(9)
    docs = [(i, " ".join(r.choice(["alpha", "beta", "gamma", "x1,"]) for _ in range(r.choice([0, 3, 40, 700, 2500])))) for i in range(-10, 50)]
    return docs + [(99, None), (3, "a repeated id"), (3, "a repeated id"), (None, "no id"), *((100 + i, t) for i, t in enumerate(ODD))]


def test_packing(spark):
    docs = texts()
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    out = packing.pack_documents(frame, tokenizer(), 512).collect()
    whole = sorted(((i, encode(t, 0)) for i, t in docs), key=lambda x: str(x[0]))
    want = sorted((str(i), k, at, len(ids[at : at + 512]), zlib.crc32(ids[at : at + 512].tobytes())) for i, ids in whole for k, at in enumerate(range(0, len(ids), 512)))
    assert sorted((str(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out) == want
    by = {}
    for r in out:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 512
    assert len(by) <= -(-sum(len(i) for _, i in whole) // 512) + 3
    joined = packing.sequences(frame, tokenizer(), 512).collect()
    assert sum(len(r["ids"]) for r in joined) == sum(len(i) for _, i in whole) and max(r["n_tokens"] for r in joined) <= 512
    assert packing.pack_documents(frame.limit(0), tokenizer()).count() == 0


def test_sum_of_squares_fills_sequences():
    r = np.random.default_rng(0)
    lengths = r.integers(1, 400, 20_000)
    seq = packing.place(lengths, 2048)
    loads = np.bincount(seq, lengths)
    assert loads.max() <= 2048 and len(loads) <= lengths.sum() / 2048 * 1.01 + 1
    assert packing.place(np.array([], int), 8).tolist() == []


def test_table_round_trip(spark, tmp_path):
    docs = texts()
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    manifest = sstable.write_shards(frame, str(tmp_path / "t"), tokenizer(), shard_bytes=4000)
    rows = sorted(sstable.read_shards(manifest).collect(), key=lambda r: r["start"])
    at = 0
    for r in rows:
        assert r["start"] == at and len(r["ids"]) == 4 * r["n_tokens"]
        at += r["n_tokens"]
    assert [r["doc_id"] for r in rows] == sorted((i for i, _ in docs), key=lambda i: (i is not None, i or 0))
    assert sorted((str(r["doc_id"]), bytes(r["ids"])) for r in rows) == sorted((str(i), encode(t, 2).tobytes()) for i, t in docs)
    assert manifest.count() > 1
    asked = spark.createDataFrame([(i,) for i in (-10, 3, 3, 99, None, 12345, 104)], "doc_id long")
    found = sorted((str(r["doc_id"]), bytes(r["ids"])) for r in sstable.lookup(manifest, asked).collect())
    assert found == sorted((str(i), encode(t, 2).tobytes()) for i, t in docs if i in (-10, 3, 99, None, 104))
    assert sstable.read_shards(sstable.write_shards(frame.limit(0), str(tmp_path / "u"), tokenizer())).count() == 0


def test_lookup():
    writer = sstable.ShardWriter(block_bytes=200)
    held = {i: np.array([i % 7, i + 100, 70_000 if i % 5 == 0 else 1], "<u4").tobytes() for i in range(-40, 400, 3)}
    writer.add(sstable.key_of(None), b"")
    for i, ids in sorted(held.items()):
        for k in range(60 if i == 80 else 1):
            writer.add(sstable.key_of(i, k), ids)
    data = writer.finish()
    reader = sstable.ShardReader(io.BytesIO(data))
    assert reader.get(None) == [b""] and len(reader.blocks) > 5
    assert all(reader.get(i) == [ids] * (60 if i == 80 else 1) for i, ids in held.items())
    assert all(reader.get(i) == [] for i in range(-40, 400) if i not in held)
    assert sum(reader.may_hold(i) for i in range(1000, 3000)) < 60
    with pytest.raises(ValueError):
        list(sstable.ShardReader(io.BytesIO(data[:9] + bytes([data[9] ^ 1]) + data[10:])).scan())


def test_transfers_move_the_fewest_bytes():
    r = random.Random(0)
    for _ in range(30):
        old = [r.randrange(0, 1000) for _ in range(r.randint(1, 6))]
        cap = reshard.even_capacities(sum(old), r.randint(1, 7))
        flow = reshard.transfers(old, cap)
        assert [sum(f) for f in flow] == old and [sum(c) for c in zip(*flow)] == cap
        stay = sum(min(a, b) for a, b in zip(old, cap))
        assert sum(f[i] for i, f in enumerate(flow) if i < len(cap)) == stay
    with pytest.raises(ValueError):
        reshard.transfers([5], [4])


def test_reshard(spark):
    r = random.Random(5)
    docs = [(i, "é" * r.randrange(200), 1) for i in range(2000)] + [(5, None, 0), (None, "x", 2), (5, "", 0), (5, "", 0)]
    frame = spark.createDataFrame([(i, t, s, 7) for i, t, s in docs], "doc_id long, text string, source int, slot int")
    layout = reshard.reshard(frame, F.col("source"), 3, 16, rows_per_block=100)
    out = layout.plan.join(layout.rows.select("number", F.col("row.doc_id").alias("doc_id")), "number").collect()
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in out), key=str) == sorted(((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _ in docs), key=str)
    loads, slots = {}, {}
    for x in out:
        loads[x["shard"]] = loads.get(x["shard"], 0) + x["size"]
        slots.setdefault(x["shard"], []).append(x["slot"])
    assert set(loads) == set(range(16)) and max(loads.values()) - min(loads.values()) <= 800
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert reshard.reshard(frame.limit(0), F.col("source"), 3).plan.count() == 0


def test_rewrite(spark, tmp_path):
    rows = [(i, "t" * (i % 9), 0, 7) for i in range(100)] + [(5, "same", 1, 0)] * 8 + [(5, "same", 2, 0)] * 8 + [(None, None, 1, 0)] * 3
    frame = spark.createDataFrame(rows, "doc_id long, text string, source int, shard int")
    layout = reshard.reshard(frame, F.col("source"), 4, 4)
    folder = str(tmp_path / "o")
    changed = reshard.rewrite(layout, folder)
    assert changed == [0, 1, 2, 3]
    plan = sorted(((r["shard"], r["slot"], r["size"], r["old_shard"]) for r in layout.plan.collect()))
    got = reshard.files(layout, folder, changed).collect()
    assert sorted((r["shard"], r["slot"], len(r["row"]["text"] or "") + 1, r["old_shard"]) for r in got) == plan
    assert sorted((tuple(r["row"]) for r in got), key=str) == sorted(rows, key=str)
    still = reshard.reshard(frame.where("source = 1"), F.col("source") * 0, 1, 1)
    assert reshard.rewrite(still, str(tmp_path / "p")) == [] and reshard.files(still, "", []).count() == 11
    partly = reshard.reshard(spark.createDataFrame([(i, "x" * 9, i % 3) for i in range(90)], "doc_id long, text string, source int"), F.col("source"), 3, 3)
    assert reshard.rewrite(partly, str(tmp_path / "q")) == [] and reshard.files(partly, "", []).count() == 90


def test_canonical_urls(spark):
    same = ["http://www.Example.com:80/a/?utm_source=x&b=2&a=1#f", "https://example.com/a?a=1&b=2&ref=z", "example.com/a/?a=1&b=2"]
    df = spark.createDataFrame([(u,) for u in same], "u string")
    assert {r[0] for r in df.select(revisits.canonical_url(F.col("u"))).collect()} == {"example.com/a?a=1&b=2"}


def test_revisits(spark):
    rows = [
        ("r1", "response", "http://a/x", 10, 200, {"ETag": '"1"', "Content-Type": "t", "Date": "d1", "etag": '"1"'}, "one"),
        ("r2", "response", "http://a/x/", 20, 200, {"Last-Modified": "m"}, "two"),
        ("r3", "response", "http://a/x", 25, 404, {}, "gone"),
        ("r3", "response", "http://a/x", 25, 404, {}, "gone"),
        ("v1", "revisit", "https://www.a/x", 15, 304, {"etag": 'W/"1"', "DATE": "d2", "Content-Length": "0"}, None),
        ("v2", "revisit", "http://a/x", 30, 304, {"Last-Modified": "m", "etag": '"1"'}, None),
        ("v3", "revisit", "http://a/x", 10, 304, {"etag": '"1"'}, None),
        ("v4", "revisit", "http://a/x", 16, 304, {"etag": '"2"'}, None),
        ("v5", "revisit", "http://a/x", 17, 304, None, None),
        ("v6", "revisit", None, 17, 304, {}, None),
        ("v1", "revisit", "https://www.a/x", 15, 304, {"etag": 'W/"1"', "DATE": "d2", "Content-Length": "0"}, None),
    ]
    df = spark.createDataFrame(rows, "record_id string, kind string, url string, date long, status int, headers map<string,string>, body string")
    out = revisits.resolve(df).collect()
    got = {r["record_id"]: (r["outcome"], r["target_id"], r["body"]) for r in out}
    assert len(out) == 7
    assert got == {"v1": ("resolved", "r1", "one"), "v2": ("resolved", "r2", "two"), "v3": ("no response", None, None), "v4": ("mismatch", "r1", None), "v5": ("no validator", "r1", None), "v6": ("no response", None, None)}
    first = next(r for r in out if r["record_id"] == "v1")
    assert first["headers"] == {"etag": 'W/"1"', "date": "d2", "content-type": "t"} and first["status"] == 200
    assert revisits.resolve(df.limit(0)).count() == 0


def test_revisits_match_brute_force(spark):
    r = random.Random(11)
    rows = [(i, r.choice(["response", "response", "revisit"]), f"http://h/{r.randrange(6) * (r.random() < 0.6)}", r.randrange(2000), 200, {"etag": str(r.randrange(2))}, "b") for i in range(600)]
    df = spark.createDataFrame(rows, "record_id long, kind string, url string, date long, status int, headers map<string,string>, body string")
    want = {}
    for i, kind, url, at, *_ in rows:
        if kind == "revisit":
            seen = [(d, j) for j, k, u, d, *_ in rows if k == "response" and u == url and d < at]
            want[i] = max(seen)[1] if seen else None
    assert {x["record_id"]: x["target_id"] for x in revisits.resolve(df).collect()} == want


def test_responses_that_share_an_id(spark):
    head = {"ETag": '"a"'}
    rows = [(1, "response", "http://e.com/x", 9, 200, head, "late"), (1, "response", "http://e.com/x", 3, 200, head, "early"), (1, "response", "http://e.com/x", 3, 200, head, "other"), (2, "revisit", "http://e.com/x", 12, 304, head, None), (3, "revisit", "http://e.com/x", 2, 304, head, None)]
    frame = spark.createDataFrame(rows, "record_id long, kind string, url string, date long, status int, headers map<string,string>, body string")
    got = {tuple((r["record_id"], r["outcome"], r["body"]) for r in revisits.resolve(frame.repartition(k)).orderBy("record_id").collect()) for k in (1, 3, 5)}
    assert len(got) == 1
    ((two, three),) = got
    assert two[:2] == (2, "resolved") and two[2] in ("early", "other") and three == (3, "no response", None)
