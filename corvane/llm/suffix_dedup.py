"""Removal of byte strings that already stand in an earlier document.

Bucket-pointer refinement over the suffixes that matter. Every string of
`length` bytes holds exactly one anchor: the gram of `gram` bytes with the least
hash in it. Suffixes are first put into buckets by the gram at their anchor:

1. Map: anchors of each batch of documents, with the identifier of all bytes of
   the strings they stand for. Inside a batch all but the first document with
   equal bytes are settled at once, so a passage found everywhere sends one
   entry a batch.
2. Buckets: entries meet by gram. Equal identifiers are whole matches; buckets
   of one document are final; what is left asks for its bytes.
3. Refinement: every offset of those bytes gets a bucket pointer by its first
   eight bytes. Each round sorts by the pairs of an offset's pointer and the
   pointer at a later offset, which gives new pointers for twice as many bytes,
   and the next round sorts by these. Buckets of one document drop out.

Grams that stand in very many documents with different bytes around them are
found in a sample of documents; their strings are then entries of their own, by
the identifier of their bytes, so that no bucket grows with the corpus. Which
way a gram goes changes nothing in the result.

Identifiers in step 2 have 112 bits; step 3 compares the bytes themselves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import materialize, packed, shuffle_width, trim
from corvane.llm.tokens import batches

M1, M2, M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
#: The identifier of a gram keeps so many bits.
GRAM_BITS = np.uint64(48)
#: Bytes of text whose anchors are worked out at a time; the arrays for them stay in the cache.
CHUNK = 512 << 10
ENTRY = np.dtype([("h", "<u8"), ("c", "<u8"), ("uid", "<i8"), ("pos", "<i4"), ("lo", "u1"), ("n", "u1")])
SPAN = np.dtype([("uid", "<i8"), ("start", "<i4"), ("end", "<i4")])
ASK = np.dtype([("uid", "<i8"), ("h", "<u8"), ("pos", "<i4"), ("lo", "u1"), ("n", "u1")])


def pack(rows: np.ndarray) -> bytes:
    """Columns byte plane by byte plane, deflated: sorted and small numbers shrink to little."""
    import zstandard

    planes = [np.ascontiguousarray(rows[f]).view(np.uint8).reshape(len(rows), -1).T.tobytes() for f in rows.dtype.names]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def unpack(data: bytes, dtype: np.dtype) -> np.ndarray:
    import zstandard

    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    out = np.empty(len(raw) // dtype.itemsize, dtype)
    at = 0
    for f in dtype.names:
        width = dtype[f].itemsize
        size = width * len(out)
        out[f] = np.ascontiguousarray(raw[at : at + size].reshape(width, len(out)).T).reshape(-1).view(dtype[f])
        at += size
    return out


def unpack_all(blobs: list[bytes], dtype: np.dtype) -> np.ndarray:
    return np.concatenate([np.empty(0, dtype), *(unpack(b, dtype) for b in blobs)])


def eights(data: bytes) -> np.ndarray:
    """The eight bytes at each offset as one number (zero bytes past the end)."""
    padded = np.frombuffer(data + bytes(8), np.uint8)
    return np.ndarray((len(data) + 1,), "<u8", padded.tobytes(), 0, (1,))


def _mix(acc: np.ndarray, word: np.ndarray) -> np.ndarray:
    acc = (acc ^ word * M2) * M1
    return acc ^ acc >> np.uint64(31)


def _ident(words: np.ndarray, at: np.ndarray | slice, size: int, seed: np.ndarray) -> np.ndarray:
    """Identifiers of the `size` >= 8 bytes at each place: steps of eight bytes, the last one overlapping."""
    acc = seed
    for off in [*range(0, size - 8, 8), size - 8]:
        acc = _mix(acc, words[at + off])
    return acc


def anchors(data: bytes, sizes: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(document, start, n, pos, h, c, start in data, words of data) of every anchor of the documents laid end to end in data.

    The anchor at byte pos stands for the n strings that start at `start` and on; h identifies its gram and c all the
    bytes of its strings and where it stands in them.
    """
    total, width = len(data), length - gram + 1
    empty = np.empty(0, np.int64)
    if total < length:
        return (empty,) * 8
    words = eights(data)
    n = total - gram + 1
    seed = np.uint64(gram)
    h = _mix(words[:n] * M3, seed)
    for off in [*range(8, gram - 8, 8), gram - 8]:
        h = _mix(h, words[off : off + n])
    least, place, have = h, np.zeros(n, np.uint8), 1
    while have < width:  # the leftmost least gram of each string, by doubling
        step = min(have, width - have)
        later = least[step:] < least[:-step]
        place = np.where(later, place[step:] + np.uint8(step), place[:-step])
        least = np.where(later, least[step:], least[:-step])
        have += step
    ends = np.cumsum(sizes)
    starts = np.repeat(np.arange(len(sizes)), np.maximum(sizes - length + 1, 0))  # the document of each valid string
    first = ends - sizes
    counts = np.maximum(sizes - length + 1, 0)
    base = np.cumsum(counts) - counts
    at = np.arange(len(starts)) - np.repeat(base - first, counts)
    if not len(at):
        return (empty,) * 8
    pos = at + place[at]
    new = np.flatnonzero(np.r_[True, (pos[1:] != pos[:-1]) | (starts[1:] != starts[:-1])])
    lo, run = at[new], np.diff(np.r_[new, len(at)])
    pos, doc = pos[new], starts[new]
    shape = ((pos - lo).astype(np.uint64) << np.uint64(8)) + run.astype(np.uint64)
    c = _ident(words, lo, length, shape * M3 + np.uint64(1))
    c = _ident(words, lo + run - 1, length, c)
    return doc, lo - first[doc], run, pos - first[doc], h[pos] >> (np.uint64(64) - GRAM_BITS), c, lo, words


def _groups(*keys: np.ndarray) -> np.ndarray:
    """Whether each row of sorted keys begins a new group."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return new


def _merged(spans: np.ndarray) -> np.ndarray:
    """Overlapping and touching spans of the same document become one."""
    if not len(spans):
        return spans
    spans = spans[np.lexsort((spans["end"], spans["start"], spans["uid"]))]
    reach = spans["end"].astype(np.int64)
    new_doc = _groups(spans["uid"])
    number = np.cumsum(new_doc)
    upto = np.maximum.accumulate(reach + number * (1 << 33)) - number * (1 << 33)
    new = new_doc.copy()
    new[1:] |= spans["start"][1:] > upto[:-1]
    at = np.flatnonzero(new)
    out = spans[at].copy()
    out["end"] = upto[np.r_[at[1:], len(spans)] - 1]
    return out


def _ranks(values: np.ndarray) -> np.ndarray:
    """Bucket numbers of values: equal ones share a number."""
    return np.unique(values, return_inverse=True)[1].reshape(values.shape)


def refine(context: np.ndarray, of: np.ndarray, off: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """Which strings also stand in a document of smaller order; string i is the `length` bytes of context[of[i]] from off[i] on."""
    hit, live = np.zeros(len(of), bool), np.arange(len(of))
    if not len(of):
        return hit
    padded = np.zeros((len(context), context.shape[1] + 7), np.uint8)
    padded[:, : context.shape[1]] = context
    first = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, 8, axis=1)).view("<u8")[..., 0]
    pointer, row, have = _ranks(first), of, 8
    while have < length:
        step = min(have, length - have)  # the pointer there tells the bytes up to have + step
        width = pointer.shape[1] - step
        pointer = _ranks(pointer[:, :width].astype(np.uint64) << np.uint64(32) | pointer[:, step:].astype(np.uint64))
        have += step
        bucket = pointer[row, off[live]]
        by = np.lexsort((order[live], bucket))
        new = _groups(bucket[by])
        number = np.empty(len(live), np.int64)
        number[by] = np.cumsum(new) - 1
        ordered = order[live][by]
        least, most = ordered[new], ordered[np.r_[np.flatnonzero(new)[1:], len(by)] - 1]
        if have == length:
            hit[live] = order[live] > least[number]
            break
        open_ = (most > least)[number]
        live = live[open_]
        kept, row = np.unique(row[open_], return_inverse=True)
        pointer = pointer[kept]
        if not len(live):
            break
    return hit


def numbered(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, int]:
    """(row, id, text, uid) of docs, row holding all columns but the text; and the shift: documents compare by uid >> shift.

    Without a shift uid is the id. Where rows share an id but not the text, or have none, ids are ranked and an ordinal
    by text is added; rows without an id come after all others, and rows of equal id never remove from each other.
    """
    others = [c for c in docs.columns if c != text_col]
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in others)).alias("row"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    ids = rows.select("id", F.xxhash64("text").alias("h"))
    ties, nulls = ids.groupBy("id").agg(F.count_distinct("h").alias("n")).agg(F.max("n"), F.max(F.col("id").isNull().cast("int"))).first()
    if not nulls and (ties or 1) == 1:
        return rows.withColumn("uid", F.col("id")), 0
    order = [F.col("id").asc_nulls_last(), F.col("h")]
    ranged = ids.distinct().repartitionByRange(shuffle_width(docs.sparkSession), *order).sortWithinPartitions(*order)
    ranged = materialize(ranged.select("id", "h", F.monotonically_increasing_id().alias("place")), "ids")
    part, inside = F.shiftright("place", 33), F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    sizes, base, total = [(r["part"], r["n"]) for r in ranged.groupBy(part.alias("part")).count().withColumnRenamed("count", "n").orderBy("part").collect()], [], 0  # one row a partition
    for number, n in sizes:
        base.append((number, total))
        total += n
    bases = docs.sparkSession.createDataFrame(base, "part long, base long")
    ranked = ranged.withColumn("part", part).join(F.broadcast(bases), "part").select("id", "h", (F.col("base") + inside).alias("rank"))
    shift = int(ties).bit_length()
    if total << shift >= 1 << 63:
        raise ValueError("too many rows without an id of their own")
    first = ranked.where("id is not null").groupBy("id").agg(F.min("rank").alias("first"))
    lone = ranked.where("id is null").agg(F.min("rank")).first()[0] or 0
    placed = ranked.where("id is not null").join(first, "id").unionByName(ranked.where("id is null").withColumn("first", F.lit(lone).cast("long")))
    placed = placed.select(F.col("id").alias("_id"), "h", F.shiftleft("first", shift).bitwiseOR(F.col("rank") - F.col("first")).alias("uid"))
    keyed = rows.withColumn("_h", F.xxhash64("text"))
    return keyed.join(placed, keyed["id"].eqNullSafe(placed["_id"]) & (keyed["_h"] == placed["h"])).select("row", "id", "text", "uid"), shift


#: A gram that stands in at least this share of the documents, or in so many of them, with different bytes around it is hot.
HOT_SHARE, HOT_DOCUMENTS = 0.01, 2_000_000


def hot_grams(docs: DataFrame, documents: int, length: int, gram: int) -> np.ndarray:
    """Identifiers of hot grams, ascending, from a sample in which one at the bound is expected 50 times (all documents, if they are few)."""
    import pyarrow as pa

    share = min(HOT_SHARE, HOT_DOCUMENTS / max(documents, 1))
    part = min(1.0, 50 / share / max(documents, 1))
    some = docs.where(F.pmod(F.xxhash64("uid"), F.lit(1 << 30)) < int(part * (1 << 30)))

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows, CHUNK):
            texts = [(t or "").encode() for t in batch.column("text").to_pylist()]
            *_, h, c, _, _ = anchors(b"".join(texts), np.array([len(t) for t in texts], np.int64), length, gram)
            yield pa.RecordBatch.from_arrays([pa.array(h.astype(np.uint64).view(np.int64)), pa.array(c.astype(np.uint64).view(np.int64))], ["h", "c"])

    seen = some.select("text").mapInArrow(run, "h long, c long").groupBy("h").agg(F.count_distinct("c").alias("n")).where("n >= 25").select("h").toArrow()  # a 25th of the sample's anchors at most
    return np.sort(seen.column("h").to_numpy().astype(np.uint64))


def find_repeats(docs: DataFrame, shift: int, hot: np.ndarray, buckets: int, doc_buckets: int, length: int, gram: int, batch_bytes: int) -> DataFrame:
    """Steps 1 and 2: rows (kind, dbucket, data) from docs (uid, text); kind 0: spans to remove, kind 1: what asks for its bytes."""
    import pyarrow as pa

    mask_bucket = np.uint64(buckets)

    def out_rows(kind: int, rows: np.ndarray, key: np.ndarray) -> tuple[list, list, list]:
        by = np.argsort(key, kind="stable")
        rows, key = rows[by], key[by]
        edges = np.flatnonzero(np.diff(key, prepend=key[:1] - 1)) if len(key) else []
        parts = np.split(rows, edges[1:]) if len(edges) else []
        return [kind] * len(parts), [int(key[e]) for e in edges], [pack(p) for p in parts]

    def scan(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Anchors are worked out over CHUNK bytes at a time, and settled among batch_bytes of text.
        chunk: list[tuple[int, bytes]] = []
        entries: list[np.ndarray] = []
        chunk_size = size = 0

        def work_out() -> None:
            uids = np.array([u for u, _ in chunk], np.int64)
            sizes = np.array([len(t) for _, t in chunk], np.int64)
            doc, start, n, pos, h, c, at, words = anchors(b"".join(t for _, t in chunk), sizes, length, gram)
            is_hot = np.isin(h, hot) if len(hot) else np.zeros(len(doc), bool)
            if is_hot.any():  # each string on its own
                of = np.repeat(np.flatnonzero(is_hot), n[is_hot])
                k = np.arange(len(of)) - np.repeat(np.cumsum(n[is_hot]) - n[is_hot], n[is_hot])
                e = np.empty(len(of), ENTRY)
                e["h"] = _ident(words, at[of] + k, length, np.full(len(of), M3)) >> (np.uint64(64) - GRAM_BITS)
                e["c"] = _ident(words, at[of] + k, length, np.full(len(of), M2))
                e["uid"], e["pos"], e["lo"], e["n"] = uids[doc[of]], pos[of], pos[of] - start[of] - k, 1
                entries.append(e)
            cool = ~is_hot
            e = np.empty(int(cool.sum()), ENTRY)
            e["h"], e["c"], e["pos"], e["lo"], e["n"] = h[cool], c[cool], pos[cool], (pos - start)[cool], n[cool]
            e["uid"] = uids[doc[cool]] if len(e) else doc
            entries.append(e)
            chunk.clear()

        def settle() -> pa.RecordBatch:
            e = np.concatenate(entries)
            entries.clear()
            e = e[np.lexsort((e["uid"], e["c"], e["h"]))]
            new = _groups(e["h"], e["c"])
            if len(e):
                order = e["uid"] >> shift
                repeated = order > order[new][np.cumsum(new) - 1]
            else:
                repeated = np.empty(0, bool)
            gone, e = e[repeated], e[~repeated]
            spans = np.empty(len(gone), SPAN)
            spans["uid"], spans["start"] = gone["uid"], gone["pos"] - gone["lo"]
            spans["end"] = spans["start"] + gone["n"] - 1 + length
            spans = _merged(spans)
            a = out_rows(2, e, (e["h"] % mask_bucket).astype(np.int64))
            b = out_rows(0, spans, np.mod(spans["uid"], doc_buckets))
            kinds, keys, data = ([*x, *y] for x, y in zip(a, b))
            return pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array(keys, pa.int64()), pa.array([k % buckets for k in keys], pa.int64()), pa.array(data, pa.binary())], ["kind", "dbucket", "bucket", "data"])

        for batch in rows:
            for uid, text in zip(batch.column("uid").to_pylist(), batch.column("text").to_pylist()):
                chunk.append((uid, (text or "").encode()))
                chunk_size += len(chunk[-1][1])
                size += len(chunk[-1][1])
                if chunk_size >= CHUNK or size >= batch_bytes:
                    work_out()
                    chunk_size = 0
                if size >= batch_bytes:
                    yield settle()
                    size = 0
        if chunk:
            work_out()
        if entries:
            yield settle()
        trim()

    def meet(table: pa.Table) -> pa.Table:
        kinds = table.column("kind").to_numpy()
        through = table.filter(pa.array(kinds == 0)).select(["kind", "dbucket", "data"])
        e = unpack_all(table.filter(pa.array(kinds == 2)).column("data").to_pylist(), ENTRY)
        e = e[np.lexsort((e["uid"], e["c"], e["h"]))]
        order = e["uid"] >> shift
        by_gram, by_bytes = _groups(e["h"]), _groups(e["h"], e["c"])
        if not len(e):
            return through
        gram_no, bytes_no = np.cumsum(by_gram) - 1, np.cumsum(by_bytes) - 1
        whole = order > order[by_bytes][bytes_no]
        at = np.flatnonzero(by_gram)
        several = (np.add.reduceat(by_bytes.astype(np.int64), at) > 1) & (np.maximum.reduceat(order, at) > np.minimum.reduceat(order, at))
        ask = e[~whole & several[gram_no]]
        gone = e[whole]
        spans = np.empty(len(gone), SPAN)
        spans["uid"], spans["start"] = gone["uid"], gone["pos"] - gone["lo"]
        spans["end"] = spans["start"] + gone["n"] - 1 + length
        spans = _merged(spans)
        asks = np.empty(len(ask), ASK)
        for f in ASK.names:
            asks[f] = ask[f]
        a = out_rows(0, spans, np.mod(spans["uid"], doc_buckets))
        b = out_rows(1, asks, np.mod(asks["uid"], doc_buckets))
        kinds, keys, data = ([*x, *y] for x, y in zip(a, b))
        trim()
        found = pa.table({"kind": pa.array(kinds, pa.int32()), "dbucket": pa.array(keys, pa.int64()), "data": pa.array(data, pa.binary())})
        return pa.concat_tables([through.cast(found.schema), found])

    scanned = docs.mapInArrow(scan, "kind int, dbucket long, bucket long, data binary")
    return scanned.repartition(max(1, buckets // 4), "bucket").groupBy("bucket").applyInArrow(meet, "kind int, dbucket long, data binary")


def repeated_spans(rows: DataFrame, shift: int, length: int = 50, gram: int = 20, batch_bytes: int = 8 << 20, bucket_bytes: int = 3 << 20):
    """(texts, spans) for remove_repeats(): rows (uid, text and others) with dbucket, and spans to remove (dbucket, data)."""
    import pyarrow as pa

    spark = rows.sparkSession
    total, documents = rows.agg(F.sum(F.octet_length("text")), F.count("*")).first()
    total = total or 0
    # Buckets by bytes, so that a task holds as much whatever the corpus.
    buckets = max(1, total // bucket_bytes, shuffle_width(spark))
    doc_buckets = buckets | 1
    plain = rows.select("uid", "text")
    hot = hot_grams(plain, documents, length, gram)
    found = materialize(find_repeats(plain, shift, hot, buckets, doc_buckets, length, gram, batch_bytes), "repeats")
    texts = rows.withColumn("dbucket", F.pmod("uid", F.lit(doc_buckets))).repartition(max(1, doc_buckets // 4), "dbucket")

    def answer(texts: pa.Table, asked: pa.Table) -> pa.Table:
        asks = unpack_all(asked.column("data").to_pylist(), ASK)
        asks = asks[np.argsort(asks["h"], kind="stable")]
        where = {u: i for i, u in enumerate(texts.column("uid").to_pylist())}
        column = texts.column("text")
        encoded: dict[int, bytes] = {}
        keys, data = [], []
        out = []
        for uid, pos, lo, n in zip(asks["uid"].tolist(), asks["pos"].tolist(), asks["lo"].tolist(), asks["n"].tolist()):
            if uid not in encoded:
                encoded[uid] = (column[where[uid]].as_py() or "").encode()
            out.append(encoded[uid][pos - lo : pos - lo + n - 1 + length].ljust(2 * length, b"\0"))
        if len(asks):
            key = (asks["h"] % np.uint64(buckets)).astype(np.int64)
            by = np.argsort(key, kind="stable")
            asks, key = asks[by], key[by]
            bytes_of = np.frombuffer(b"".join(out), np.uint8).reshape(len(out), 2 * length)[by]
            rows = np.empty(len(asks), np.dtype([*ASK.descr, ("bytes", f"V{2 * length}")]))
            for f in ASK.names:
                rows[f] = asks[f]
            rows["bytes"] = np.ascontiguousarray(bytes_of).view(f"V{2 * length}").ravel()
            edges = np.flatnonzero(np.diff(key, prepend=key[:1] - 1))
            for e, part in zip(edges, np.split(rows, edges[1:])):
                keys.append(int(key[e]))
                data.append(_deflate(part))
        trim()
        return pa.table({"bucket": pa.array(keys, pa.int64()), "data": pa.array(data, pa.binary())})

    def settle(table: pa.Table) -> pa.Table:
        rows = np.concatenate([_inflate(b, length) for b in table.column("data").to_pylist()])
        rows = rows[np.argsort(rows["h"], kind="stable")]
        held = np.ascontiguousarray(rows["bytes"]).view(np.uint8).reshape(len(rows), 2 * length)
        gone = []
        edges = np.flatnonzero(_groups(rows["h"]))
        at = 0
        while at < len(edges):  # whole grams together, about 4,000 contexts a turn
            to = max(at + 1, int(np.searchsorted(edges, edges[at] + 4_000)))
            a, b = edges[at], edges[to] if to < len(edges) else len(rows)
            part, context = rows[a:b], held[a:b]
            counts = part["n"].astype(np.int64)
            of = np.repeat(np.arange(len(part)), counts)
            off = np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)
            hit = refine(context, of, off, part["uid"][of] >> shift, length)
            spans = np.empty(int(hit.sum()), SPAN)
            spans["uid"] = part["uid"][of[hit]]
            spans["start"] = part["pos"][of[hit]] - part["lo"][of[hit]] + off[hit]
            spans["end"] = spans["start"] + length
            gone.append(_merged(spans))
            at = to
        spans = _merged(np.concatenate(gone)) if gone else np.empty(0, SPAN)
        key = np.mod(spans["uid"], doc_buckets)
        by = np.argsort(key, kind="stable")
        spans, key = spans[by], key[by]
        edges = np.flatnonzero(np.diff(key, prepend=key[:1] - 1)) if len(key) else np.empty(0, np.int64)
        parts = np.split(spans, edges[1:]) if len(edges) else []
        trim()
        return pa.table({"dbucket": pa.array([int(key[e]) for e in edges], pa.int64()), "data": pa.array([pack(p) for p in parts], pa.binary())})

    asked = found.where("kind = 1").groupBy("dbucket")
    answers = texts.select("uid", "text", "dbucket").groupBy("dbucket").cogroup(asked).applyInArrow(answer, "bucket long, data binary")
    refined = answers.repartition(max(1, buckets // 4), "bucket").groupBy("bucket").applyInArrow(settle, "dbucket long, data binary")
    return texts, found.where("kind = 0").select("dbucket", "data").unionByName(refined)


def _deflate(rows: np.ndarray) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(rows.tobytes())


def _inflate(data: bytes, length: int) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.dtype([*ASK.descr, ("bytes", f"V{2 * length}")]))


def remove_repeats(docs: DataFrame, length: int = 50, gram: int = 20, id_col: str = "doc_id", text_col: str = "text", digest: bool = False, **sizes) -> DataFrame:
    """Every row of docs without the bytes of its text that a string of `length` bytes covers which starts in a document of smaller id.

    Strings are judged on the input and never cross documents. With digest the rows are doc_id, n_bytes, n_removed,
    n_spans and kept_sha256 instead; otherwise the columns of docs, where the kept bytes are read as UTF-8 and halves
    of a character cut through are left out. Texts shorter than `length`, null and empty ones come out as they went in;
    rows without an id lose to all others and not to each other, nor do rows that share an id.
    """
    import pyarrow as pa

    if not 8 <= gram <= length - 8 or length > 120:
        raise ValueError("gram must be 8 to length - 8, length at most 120")
    slim = docs.select(id_col, text_col) if digest else docs
    rows, shift = numbered(slim, id_col, text_col)
    texts, spans = repeated_spans(rows, shift, length, gram, **sizes)
    if digest:
        texts = texts.select("id", "text", "uid", "dbucket")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" if digest else texts.select("row", "text").schema

    def cut(texts: pa.Table, spans: pa.Table) -> pa.Table:
        gone = _merged(unpack_all(spans.column("data").to_pylist(), SPAN))
        edges = np.flatnonzero(_groups(gone["uid"])) if len(gone) else np.empty(0, np.int64)
        mine = {int(gone["uid"][e]): p for e, p in zip(edges, np.split(gone, edges[1:]))} if len(edges) else {}
        rows, kept_texts = [], []
        for doc, uid, text in zip(texts.column("id").to_pylist(), texts.column("uid").to_pylist(), texts.column("text").to_pylist()):
            data, removed, own = (text or "").encode(), 0, mine.get(uid, ())
            parts, at = [], 0
            for start, end in zip(own["start"].tolist(), own["end"].tolist()) if len(own) else ():
                parts.append(data[at:start])
                removed += end - start
                at = end
            parts.append(data[at:])
            if digest:
                rows.append((doc, len(data), removed, len(own), hashlib.sha256(b"".join(parts)).hexdigest()))
            else:
                kept_texts.append(b"".join(parts).decode("utf-8", "ignore") if len(own) else text)
        if digest:
            cols = list(zip(*rows)) or [[]] * 5
            return pa.table({k: pa.array(c, t) for (k, t), c in zip((("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())), cols)})
        return pa.table({"row": texts.column("row"), "text": pa.array(kept_texts, pa.string())})

    out = texts.groupBy("dbucket").cogroup(spans.groupBy("dbucket")).applyInArrow(cut, schema)
    return out if digest else out.select(*(F.col("text").alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns))


def keep_texts(docs: DataFrame, length: int = 50, gram: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """remove_repeats() without the rows whose whole text went; null, empty and blank texts stay as they are."""
    rows = packed(docs, id_col, text_col).withColumn("blank", F.trim(F.coalesce("text", F.lit(""))) == "")
    rows = rows.select(F.struct(*(F.col("row")[c].alias(c) for c in docs.columns if c != text_col)).alias("row"), "id", "text", "blank")
    out = remove_repeats(rows, length, gram, "id", "text").where(F.col("blank") | (F.trim("text") != ""))
    return out.select(*(F.col("text").alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns))
