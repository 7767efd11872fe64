"""Sorted-string-table shards of token ids, keyed by document id.

A shard: magic, data blocks, index block, Bloom filter, footer. Keys are 13
bytes in byte order (null flag, id, ordinal among rows that share an id) and are
prefix-compressed inside a block; blocks are deflated and carry a CRC. The
sparse index has the first key of each block, so a lookup asks the Bloom filter,
searches the index and opens one block.
"""

from __future__ import annotations

import bisect
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.common import materialize, shared_dir, shuffle_width
from corvane.llm.tokens import batches, encoder_for

#: Fixed values of the file format.
MAGIC = b"CVSSTAB1"
FOOTER = struct.Struct("<QQQQQQ8s")  # offsets of index and Bloom filter, documents, tokens, blocks, Bloom bits, magic
BLOOM_BITS_A_KEY = 10
BLOOM_HASHES = 7


def key_of(doc_id: int | None, ordinal: int = 0) -> bytes:
    """Null sorts first; ids by value, negative ones before positive."""
    return struct.pack(">BQI", doc_id is not None, ((doc_id or 0) + (1 << 63)) & ((1 << 64) - 1), ordinal)


def id_of(key: bytes) -> int | None:
    flag, value, _ = struct.unpack(">BQI", key)
    return value - (1 << 63) if flag else None


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def _bloom_places(key: bytes, bits: int) -> list[int]:
    """Of a document's key without its ordinal."""
    import xxhash

    h = xxhash.xxh128_intdigest(key[:9])
    a, b = h & (1 << 64) - 1, h >> 64 | 1
    return [(a + i * b) % bits for i in range(BLOOM_HASHES)]


class ShardWriter:
    """Takes keys in ascending order and yields the bytes of a shard."""

    def __init__(self, block_bytes: int = 64 << 10):
        self.block_bytes, self.out, self.size = block_bytes, [MAGIC], len(MAGIC)
        self.block, self.block_size, self.last, self.first = [], 0, b"", b""
        self.index: list[tuple[bytes, int, int]] = []
        self.keys: list[bytes] = []
        self.tokens = 0

    def add(self, key: bytes, ids: bytes) -> None:
        """ids: packed little-endian unsigned 32-bit integers; stored in 16 bits each where all fit."""
        wide = np.frombuffer(ids, "<u4")
        value = b"\x04" + ids if len(wide) and wide.max() > 0xFFFF else b"\x02" + wide.astype("<u2").tobytes()
        shared = 0
        while self.block and shared < len(key) and key[shared] == self.last[shared]:
            shared += 1
        self.first = self.first if self.block else key
        entry = _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        self.block.append(entry)
        self.block_size += len(entry)
        self.last = key
        self.keys.append(key)
        self.tokens += len(wide)
        if self.block_size >= self.block_bytes:
            self._close_block()

    def _put(self, data: bytes) -> int:
        at = self.size
        self.out.append(data)
        self.size += len(data)
        return at

    def _close_block(self) -> None:
        if self.block:
            data = zlib.compress(b"".join(self.block), 1)
            data += struct.pack("<I", zlib.crc32(data))
            self.index.append((self.first, self._put(data), len(data)))
            self.block, self.block_size = [], 0

    def finish(self) -> bytes:
        self._close_block()
        bits = max(64, BLOOM_BITS_A_KEY * len(self.keys))
        bloom = np.zeros(bits, bool)
        for key in self.keys:
            bloom[_bloom_places(key, bits)] = True
        index_at = self._put(b"".join(struct.pack("<QI", at, size) + key for key, at, size in self.index))
        bloom_at = self._put(np.packbits(bloom, bitorder="little").tobytes())
        self._put(FOOTER.pack(index_at, bloom_at, len(self.keys), self.tokens, len(self.index), bits, MAGIC))
        return b"".join(self.out)


class ShardReader:
    """Reads a shard by ranges of a file: anything with seek() and read()."""

    def __init__(self, file):
        self.file = file
        self.end = file.seek(0, 2)
        index_at, bloom_at, self.documents, self.tokens, blocks, self.bits, magic = FOOTER.unpack(self._range(self.end - FOOTER.size, FOOTER.size))
        if magic != MAGIC or self._range(0, len(MAGIC)) != MAGIC:
            raise ValueError("not a shard of this format")
        index = self._range(index_at, bloom_at - index_at)
        width = 12 + 13
        self.blocks = [struct.unpack_from("<QI", index, i * width) for i in range(blocks)]
        self.firsts = [index[i * width + 12 : (i + 1) * width] for i in range(blocks)]
        self.bloom = self._range(bloom_at, self.end - FOOTER.size - bloom_at)

    def _range(self, at: int, size: int) -> bytes:
        self.file.seek(at)
        return self.file.read(size)

    def _entries(self, i: int) -> Iterator[tuple[bytes, bytes]]:
        data = self._range(*self.blocks[i])
        if struct.unpack("<I", data[-4:])[0] != zlib.crc32(data[:-4]):
            raise ValueError(f"block {i} is damaged")
        data, at, key = zlib.decompress(data[:-4]), 0, b""
        while at < len(data):
            shared, at = _read_varint(data, at)
            rest, at = _read_varint(data, at)
            size, at = _read_varint(data, at)
            key = key[:shared] + data[at : at + rest]
            at += rest
            value = data[at : at + size]
            at += size
            yield key, value[1:] if value[:1] == b"\x04" else np.frombuffer(value, "<u2", offset=1).astype("<u4").tobytes()

    def scan(self) -> Iterator[tuple[bytes, bytes]]:
        """(key, packed ids) in ascending order of keys."""
        for i in range(len(self.blocks)):
            yield from self._entries(i)

    def may_hold(self, doc_id: int | None) -> bool:
        return all(self.bloom[p >> 3] >> (p & 7) & 1 for p in _bloom_places(key_of(doc_id), self.bits))

    def get(self, doc_id: int | None) -> list[bytes]:
        """Packed ids of each row with that id; [] where there is none."""
        found: list[bytes] = []
        if not self.may_hold(doc_id):
            return found
        i = max(0, bisect.bisect_right(self.firsts, key_of(doc_id)) - 1)
        while i < len(self.blocks) and self.firsts[i] <= key_of(doc_id, 0xFFFFFFFF):
            found += [ids for key, ids in self._entries(i) if id_of(key) == doc_id and key[0] == (doc_id is not None)]
            i += 1
        return found


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def write_shards(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = 2, shard_bytes: int = 32 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode all texts and write them in ascending order of ids; returns the manifest of the shards.

    folder is a URI that executors share (file, s3, gs or hdfs). Manifest: part, seq (order of shards), path,
    n_docs, n_tokens, first_key, last_key. Files get names of their own and only those in the manifest count, so a task that runs again
    does no harm. Null and empty texts hold end_id alone; rows that share an id stay apart, by ordinal; an empty
    table makes an empty manifest.
    """
    import pyarrow as pa

    spark = docs.sparkSession
    schema = "part int, seq int, path string, n_docs long, n_tokens long, first_key binary, last_key binary"
    width = shuffle_width(spark)

    def write(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq, writer = TaskContext.get().partitionId(), 0, None
        encoder, end = None, np.array([end_id], "<u4").tobytes()
        fs, root = _filesystem(folder)
        last, ordinal = object(), 0

        def flush(writer: ShardWriter, seq: int) -> pa.RecordBatch:
            path = f"{root}/part-{part:06d}-{seq:06d}-{uuid.uuid4().hex[:12]}.sst"
            fs.create_dir(root, recursive=True)
            with fs.open_output_stream(path) as f:
                f.write(writer.finish())
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()), "path": [f"{folder}/{path.rsplit('/', 1)[1]}"], "n_docs": [len(writer.keys)], "n_tokens": [writer.tokens], "first_key": [writer.keys[0]], "last_key": [writer.keys[-1]]})

        for batch in batches(rows):
            encoder = encoder or encoder_for(tokenizer_path)
            for doc, ids in zip(batch.column("doc_id").to_pylist(), encoder.encode_all(batch.column("text").to_pylist())):
                ordinal = ordinal + 1 if doc == last else 0
                last = doc
                writer = writer or ShardWriter()
                writer.add(key_of(doc, ordinal), ids + end)
                if writer.size >= shard_bytes:
                    yield flush(writer, seq)
                    writer, seq = None, seq + 1
        if writer:
            yield flush(writer, seq)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    # Rows that share an id, or have none, may be dealt to several partitions, by a hash of the text.
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    ordered = rows.repartitionByRange(width, *order).sortWithinPartitions(*order, "text")
    return materialize(ordered.mapInArrow(write, schema), "manifest")


def read_shards(manifest: DataFrame) -> DataFrame:
    """Every document of the shards: doc_id, start (ids of all documents before it), n_tokens, ids (packed).

    Rows that share an id or have none come out each on its own; an empty manifest gives no rows.
    """
    import pyarrow as pa

    order = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)  # one row a shard
    placed = manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(order), F.lit(0)))
    width = shuffle_width(manifest.sparkSession)

    def read(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist()):
                fs, at = _filesystem(path)
                with fs.open_input_file(at) as file:
                    out, held = [], 0
                    for key, ids in ShardReader(file).scan():
                        out.append((id_of(key), start, len(ids) // 4, ids))
                        start += len(ids) // 4
                        held += len(ids)
                        if held > 4 << 20:
                            yield _rows(out)
                            out, held = [], 0
                    if out:
                        yield _rows(out)

    def _rows(out: list[tuple]) -> pa.RecordBatch:
        ids, starts, sizes, data = zip(*out)
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()), pa.array(data, pa.binary())], ["doc_id", "start", "n_tokens", "ids"])

    return placed.repartition(width, "path").mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")


def lookup(manifest: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, ids): the packed ids of every row whose id is among ids, by the shards' key ranges, Bloom filters and indexes.

    Only shards whose range holds an id are opened, and of those only the blocks a key may stand in. Repeated ids are
    asked once; null finds the rows without an id; ids nobody has find nothing.
    """
    import pyarrow as pa

    ranges = sorted((bytes(r["first_key"]), bytes(r["last_key"]), r["path"]) for r in manifest.select("first_key", "last_key", "path").collect())  # one row a shard
    paths = [path for *_, path in ranges]

    def ask(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        firsts, lasts = [a for a, *_ in ranges], [b for _, b, _ in ranges]
        for batch in rows:
            shard, asked = [], []
            for doc in batch.column(0).to_pylist():
                at = bisect.bisect_left(lasts, key_of(doc))
                while at < len(firsts) and firsts[at] <= key_of(doc, 0xFFFFFFFF):
                    shard.append(at)
                    asked.append(doc)
                    at += 1
            yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), pa.array(asked, pa.int64())], ["shard", "doc_id"])

    def answer(group: pa.Table) -> pa.Table:
        fs, at = _filesystem(paths[group.column("shard")[0].as_py()])
        with fs.open_input_file(at) as file:
            reader = ShardReader(file)
            found = [(doc, ids) for doc in group.column("doc_id").to_pylist() for ids in reader.get(doc)]
        return pa.table({"doc_id": pa.array([d for d, _ in found], pa.int64()), "ids": pa.array([i for _, i in found], pa.binary())})

    wanted = ids.select(F.col(id_col).cast("long").alias("doc_id")).distinct()
    return wanted.mapInArrow(ask, "shard int, doc_id long").groupBy("shard").applyInArrow(answer, "doc_id long, ids binary")


def new_folder(spark) -> str:
    """A folder for shards beside the checkpoints."""
    return f"{shared_dir(spark)}-sst"
