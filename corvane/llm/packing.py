"""Sum-of-squares packing of token pieces into sequences.

Each piece goes where the sum over all residual gaps of (open sequences with
that gap) squared becomes smallest: into an open sequence or a new one. Pieces
are dealt by hash into groups of bounded size that pack independently, so no
task holds more than one group and only the last open sequences of each group
can stay short.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import materialize, trim
from corvane.llm.tokens import batches, encoder_for, forget_encoders

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def place(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """The sequence, from 0, of each piece; pieces are taken from the longest to the shortest (ties as given)."""
    open_by_gap = np.zeros(capacity + 1, np.int64)
    holders: list[list[int]] = [[] for _ in range(capacity + 1)]
    out, made = np.empty(len(lengths), np.int64), 0
    worst = np.iinfo(np.int64).max
    for i in np.argsort(-lengths, kind="stable"):
        n = int(lengths[i])
        if n < capacity:
            now = open_by_gap[n:capacity]  # by gap before
            change = 2 * (open_by_gap[: capacity - n] - now) + 2  # by gap after; a filled sequence counts no more
            change[0] -= 1
            change[now == 0] = worst
            at = int(change.argmin())
            fresh = 2 * int(open_by_gap[capacity - n]) + 1
        else:
            change, at, fresh = None, 0, 0
        if change is not None and change[at] <= fresh:
            before = at + n
            seq = holders[before].pop()
            open_by_gap[before] -= 1
        else:
            before, seq = capacity, made
            made += 1
        out[i] = seq
        after = before - n
        if after:
            holders[after].append(seq)
            open_by_gap[after] += 1
    return out


def pieces(docs: DataFrame, tokenizer_path: str, max_tokens: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, memo: int = 1_000_000, keep: bool = True) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, and with_ids the packed ids.

    memo: words an encoder remembers; keep: whether it outlives the task, for those that follow in the same worker.

    A document is its ids and then end_id, so null and empty texts make one piece of one token. Rows that share an id
    or are repeated make pieces of their own.
    """
    import zlib

    import pyarrow as pa

    schema = PIECES + (", ids binary" if with_ids else "")
    step = 4 * max_tokens

    def cut(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim()
        encoder = encoder_for(tokenizer_path, memo)
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches(rows):
            out: list[tuple] = []
            for doc, ids in zip(batch.column("doc_id").to_pylist(), encoder.encode_all(batch.column("text").to_pylist())):
                ids += end
                for k, at in enumerate(range(0, len(ids), step)):
                    part = ids[at : at + step]
                    out.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part)) + ((part,) if with_ids else ()))
            cols = list(zip(*out))
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], [f.strip().split()[0] for f in schema.split(",")])
        if not keep:
            del encoder
            forget_encoders()
            trim()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(cut, schema)


def pack(parts: DataFrame, max_tokens: int = 2048, group_size: int = 50_000) -> DataFrame:
    """parts (as from pieces()) with sequence_id and offset added; sequences hold max_tokens at most.

    group_size is about what one task packs, whatever repeats, as rows are dealt one by one; nothing is dropped or cut.
    Repeated rows are placed each on its own. An empty table stays empty.
    """
    groups = max(1, -(-parts.count() // group_size))
    keyed = parts.select("doc_id", "piece", "start", "length", "ids_crc32", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)).alias("_group"))

    def packed(pdf):
        pdf = pdf.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True], kind="stable").reset_index(drop=True)
        seq = place(pdf["length"].to_numpy(), max_tokens)
        order = np.argsort(seq, kind="stable")
        lengths, of = pdf["length"].to_numpy()[order], seq[order]
        ends = np.cumsum(lengths)
        first = np.r_[True, of[1:] != of[:-1]]
        base = np.repeat((ends - lengths)[first], np.diff(np.r_[np.flatnonzero(first), len(of)]))
        offset = np.empty(len(of), np.int64)
        offset[order] = ends - lengths - base
        return pdf.assign(sequence_id=seq * groups + pdf["_group"].to_numpy(), offset=offset).drop(columns="_group")

    return keyed.groupBy("_group").applyInPandas(packed, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer_path: str, max_tokens: int = 2048, id_col: str = "doc_id", text_col: str = "text", memo: int = 1_000_000, keep: bool = True) -> DataFrame:
    """Where each piece of each document goes: PIECES, sequence_id, offset. The pieces are tokenised once and kept in the shared folder.

    Null and empty texts are one piece of the end id; rows that share an id, have none or are repeated keep pieces of their
    own; no rows give none. Other columns of docs aren't read. memo and keep: as in pieces().
    """
    return pack(materialize(pieces(docs, tokenizer_path, max_tokens, 0, id_col, text_col, memo=memo, keep=keep), "pieces"), max_tokens)


def sequences(docs: DataFrame, tokenizer_path: str, max_tokens: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The packed sequences themselves: sequence_id, n_tokens, n_pieces and ids (array, at most max_tokens); nulls, ties,
    repeats and empty tables as in pack_documents()."""
    parts = materialize(pieces(docs, tokenizer_path, max_tokens, 0, id_col, text_col, with_ids=True), "pieces")
    placed = pack(parts, max_tokens)
    key = ["doc_id", "piece", "ids_crc32", "length", "start"]
    # Equal keys hold equal ids, so one copy serves repeated rows.
    held = parts.dropDuplicates(key).select(*(F.col(k).alias(f"_{k}") for k in key), "ids")
    same = placed["doc_id"].eqNullSafe(held["_doc_id"])
    for k in key[1:]:
        same &= placed[k] == held[f"_{k}"]
    rows = placed.join(held, same).select("sequence_id", "offset", "length", "ids")

    def joined(pdf):
        import pandas as pd

        pdf = pdf.sort_values("offset")
        return pd.DataFrame({"sequence_id": [pdf["sequence_id"].iloc[0]], "n_tokens": [int(pdf["length"].sum())], "n_pieces": [len(pdf)], "ids": [np.frombuffer(b"".join(pdf["ids"]), "<u4").astype(np.int64)]})

    return rows.groupBy("sequence_id").applyInPandas(joined, "sequence_id long, n_tokens long, n_pieces long, ids array<long>")
