"""SimHash near-duplicates, searched with the generalised pigeonhole principle.

Bits that go together are grouped into partitions. Two fingerprints that differ
in at most tau bits must, for thresholds t with sum(t + 1) = tau + 1, differ in
at most t bits inside some partition. A dynamic program allocates the thresholds
that cost least by estimated candidates and probes; every fingerprint is entered
once per partition, probes all keys within its threshold, and candidates are
verified on all 64 bits inside the join.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations
from math import comb

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import LOWER_TABLE, hot_bound, join_by_key, materialize, packed, unpacked
from corvane.llm.components import joined

BITS = 64
#: Row b holds the bits of byte b, lowest first.
BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
#: What a probe costs, in verified candidates.
PROBE_COST = 8.0


def fingerprint(text: str | None, shingle: int = 4, seed: int = 42) -> int:
    """64 bits: each is set if more than half of the shingles' XXH64 have it; 0 for texts without words."""
    import xxhash

    words = (text or "").encode().translate(LOWER_TABLE).split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(line, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1][: len(words) - shingle + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return majority(np.array([digest(line[a:b], seed) for a, b in zip(starts, ends[shingle - 1 :].tolist())], np.uint64))


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in more than half of the hashes."""
    places = hashes.view(np.uint8).reshape(-1, 8).astype(np.int64) + np.arange(8) * 256
    counts = np.bincount(places.ravel(), minlength=2048).reshape(8, 256) @ BYTE_BITS
    return int.from_bytes(np.packbits((2 * counts > len(hashes)).ravel(), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, _h (hash of the text, null for null) and fp (the fingerprint as a signed long) of every row."""
    import pyarrow as pa

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            fps = np.array([fingerprint(t, shingle) for t in batch.column("text").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("_h"), pa.array(fps)], ["doc_id", "_h", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("_h"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, _h long, fp long")


@dataclass(frozen=True)
class Plan:
    """partitions: the bits of each; thresholds: the largest difference probed in each (-1: not probed)."""

    partitions: tuple[tuple[int, ...], ...]
    thresholds: tuple[int, ...]
    cost: float


def group_bits(together: np.ndarray, n: int, parts: int) -> list[tuple[int, ...]]:
    """Equal groups of bits, the most correlated together; together: how often two bits are both set among n."""
    p = np.diag(together) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    tie = np.abs(together / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread)
    np.fill_diagonal(tie, 0)
    free, out = set(range(BITS)), []
    for k in range(parts):
        size = BITS // parts + (k < BITS % parts)
        group = [max(free, key=lambda b: (tie[b, sorted(free)].sum(), -b))]
        free -= set(group)
        while len(group) < size:
            best = max(free, key=lambda b: (tie[b, group].sum(), -b))
            group.append(best)
            free.discard(best)
        out.append(tuple(sorted(group)))
    return out


def growth(bits: tuple[int, ...], together: np.ndarray, n: int, most: int) -> list[float]:
    """By radius, how many times more pairs agree within it on these bits than agree on all of them (bits taken as independent)."""
    p = np.diag(together)[list(bits)] / max(n, 1)
    differ = 2 * p * (1 - p)
    chance = np.zeros(most + 1)
    chance[0] = 1
    for d in differ:
        chance = chance * (1 - d) + np.r_[0, chance[:-1]] * d
    return list(np.cumsum(chance) / max(chance[0], 1e-300))


def allocate(costs: list[list[float]], tau: int) -> tuple[float, tuple[int, ...]]:
    """Thresholds of least cost with sum(t + 1) = tau + 1; costs[i][t + 1]: of partition i at threshold t, -1 first."""
    best: dict[int, tuple[float, tuple[int, ...]]] = {0: (0.0, ())}
    for row in costs:
        after: dict[int, tuple[float, tuple[int, ...]]] = {}
        for used, (cost, chosen) in best.items():
            for k, more in enumerate(row):
                if used + k <= tau + 1 and (used + k not in after or cost + more < after[used + k][0]):
                    after[used + k] = (cost + more, (*chosen, k - 1))
        best = after
    return best[tau + 1]


def key(fp: Column, bits: tuple[int, ...]) -> Column:
    out = F.lit(0).cast("long")
    for k, b in enumerate(bits):
        out = out.bitwiseOR(F.shiftleft(F.shiftrightunsigned(fp, b).bitwiseAND(F.lit(1)), k))
    return out


def bits_together(fps: DataFrame) -> tuple[np.ndarray, int]:
    """How often each two bits are set together over all fingerprints, and how many there are."""
    import pyarrow as pa

    def count(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((BITS, BITS)), 0
        for batch in rows:
            for at in range(0, batch.num_rows, 65_536):
                part = batch.column("fp").to_numpy(zero_copy_only=False)[at : at + 65_536].view(np.uint64)
                bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
                total += bits.T @ bits
                n += len(part)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(BITS * BITS + 1), pa.int32()), pa.array([*total.ravel().astype(np.int64).tolist(), n], pa.int64())], ["i", "n"])

    got = {r["i"]: r["n"] for r in fps.select("fp").mapInArrow(count, "i int, n long").groupBy("i").agg(F.sum("n").alias("n")).collect()}  # 4,097 rows
    return np.array([got.get(i, 0) for i in range(BITS * BITS)], float).reshape(BITS, BITS), got.get(BITS * BITS, 0)


def make_plan(fps: DataFrame, tau: int = 4) -> Plan:
    """The partitioning and thresholds of least estimated cost for the distinct fingerprints fps (column fp).

    How many pairs agree on all bits of a partition is counted over all fingerprints; wider radii are estimated from it.
    """
    together, n = bits_together(fps)
    options = {m: group_bits(together, n, m) for m in range(2, tau + 2)}
    keys = [(f"{m}:{i}", bits) for m, groups in options.items() for i, bits in enumerate(groups)]
    coded = fps.select(F.explode(F.array(*(F.struct(F.lit(name).alias("part"), key(F.col("fp"), bits).alias("key")) for name, bits in keys))).alias("x")).select("x.*")
    pairs = {r["part"]: float(r["pairs"]) for r in coded.groupBy("part", "key").count().groupBy("part").agg(F.sum(F.col("count").cast("double") * F.col("count")).alias("pairs")).collect()}  # one row a partition
    plans = []
    for m, groups in options.items():
        costs = []
        for i, bits in enumerate(groups):
            wider = growth(bits, together, n, tau)
            costs.append([0.0] + [pairs.get(f"{m}:{i}", 0.0) * wider[t] + PROBE_COST * n * sum(comb(len(bits), d) for d in range(t + 1)) for t in range(tau + 1)])
        cost, thresholds = allocate(costs, tau)
        plans.append(Plan(tuple(groups), thresholds, cost))
    return min(plans, key=lambda p: p.cost)


def _probes(code: Column, place: Column, masks: list[int]) -> Column:
    return F.transform(F.array(*(F.lit(m).cast("long") for m in masks)), lambda m: code.bitwiseXOR(m).bitwiseOR(place))


def keyed(fps: DataFrame, plan: Plan) -> tuple[DataFrame, DataFrame]:
    """(entered, probes): fingerprints (a) by their keys, and (b) by all keys within the thresholds."""
    enter, probe = [], []
    for i, (bits, t) in enumerate(zip(plan.partitions, plan.thresholds)):
        if t < 0:
            continue
        place = F.shiftleft(F.lit(i).cast("long"), 40)
        masks = [sum(1 << b for b in chosen) for d in range(t + 1) for chosen in combinations(range(len(bits)), d)]
        code = key(F.col("fp"), bits)
        enter.append(code.bitwiseOR(place))
        probe.append(_probes(code, place, masks))
    return fps.select(F.col("fp").alias("a"), F.explode(F.array(*enter)).alias("code")), fps.select(F.col("fp").alias("b"), F.explode(F.concat(*probe)).alias("code"))


def _near(a: str, b: str, tau: int) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= tau


def links(fps: DataFrame, plan: Plan, tau: int = 4) -> DataFrame:
    """(a, b), a < b: distinct fingerprints that differ in at most tau bits."""
    entered, probes = keyed(fps, plan)
    return entered.join(probes, "code").where((F.col("a") < F.col("b")) & _near("a", "b", tau)).select("a", "b").distinct()


def to_least(fps: DataFrame, plan: Plan, tau: int = 4) -> DataFrame:
    """(a, b): fingerprints b that differ in at most tau bits from the least fingerprint a of a bucket that they probe."""
    entered, probes = keyed(fps, plan)
    first = entered.groupBy("code").agg(F.min("a").alias("a"))
    return first.join(probes, "code").where((F.col("a") != F.col("b")) & _near("a", "b", tau)).select("a", "b").distinct()


def linked(fps: DataFrame, plan: Plan, tau: int = 4) -> DataFrame:
    """(node, component) over the links of links(), without listing all of them.

    Every bucket is linked to its least member where that is near enough; pairs are then met only in buckets that still
    hold several components, and only between those. A group of near copies is one component by then.
    """
    stars = materialize(to_least(fps, plan, tau), "stars-met")
    parts = joined(None, stars)
    owned = fps.select("fp").join(parts, fps["fp"] == parts["node"], "left").select("fp", F.coalesce("component", "fp").alias("part"))
    owned = materialize(owned, "owned")
    entered, probes = keyed(owned, plan)
    left = entered.join(owned.select(F.col("fp").alias("a"), F.col("part").alias("pa")), "a")
    right = probes.join(owned.select(F.col("fp").alias("b"), F.col("part").alias("pb")), "b")
    spans = left.groupBy("code").agg(F.min("pa").alias("x"), F.max("pa").alias("y"))
    mixed = right.groupBy("code").agg(F.min("pb").alias("u"), F.max("pb").alias("v")).join(spans, "code").where("x <> y or u <> v or x <> u").select("code")
    met = left.join(mixed, "code", "left_semi").join(right, "code").where((F.col("pa") < F.col("pb")) & _near("a", "b", tau)).select("pa", "pb").distinct()
    return joined(parts, materialize(met.select(F.col("pa").alias("a"), F.col("pb").alias("b")), "pairs-met"))


def near_duplicates(docs: DataFrame, tau: int = 4, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, _h, fp and component of every row of docs.

    component: the representative of all fingerprints reachable by links, struct(no_id, doc_id, _h): the smallest
    doc_id (rows without one come last), then the least hash of a text. Texts without words have fingerprint zero and
    link like any other; repeated rows fall together; an empty table gives no rows.
    """
    marked = materialize(fingerprints(docs, shingle, id_col, text_col), "fingerprints")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "_h"))
    fps = materialize(marked.groupBy("fp").agg(least.alias("first")), "distinct")
    parts = linked(fps, make_plan(fps, tau), tau)
    owned = materialize(fps.join(parts, fps["fp"] == parts["node"], "left").select("fp", "first", F.coalesce("component", "fp").alias("part")), "parts")
    least_of = owned.groupBy("part").agg(F.min("first").alias("component"), F.count("*").alias("n"))
    owned = join_by_key(owned, least_of, ["part"], F.col("fp"), least=hot_bound(owned.count()))
    return marked.join(owned.select("fp", "component"), "fp").select("doc_id", "_h", "fp", "component")


def one_of_each(docs: DataFrame, grouped: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The row of docs that each component of grouped names, once; columns stay.

    Of rows that share id and text but not the other columns, the one with the least hash of these stays (maps take no
    part in it), so the choice doesn't hang on how rows lie in partitions.
    """
    # The join and the grouping have the same plain keys, so whole rows are shuffled once.
    kept = grouped.select(F.coalesce("component.doc_id", F.lit(0)).alias("key"), F.col("component.doc_id").isNull().alias("none"), F.col("component._h").alias("hash")).distinct()
    number = F.col("id").cast("long")
    rows = packed(docs, id_col, text_col).select("row", F.coalesce(number, F.lit(0)).alias("key"), number.isNull().alias("none"), F.xxhash64("text").alias("hash"))
    out = rows.join(kept, ["key", "none", "hash"], "left_semi").groupBy("key", "none", "hash").agg(F.min_by("row", F.xxhash64(*(F.col("row")[c] for c, kind in docs.dtypes if "map<" not in kind))).alias("row"))
    return unpacked(out, docs.columns)


def dedup(docs: DataFrame, tau: int = 4, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of docs for each group of near-duplicates, the one that near_duplicates() names; columns stay.

    Texts without words, null ones among them, are one group; of rows that share id and text the one that one_of_each()
    picks stays. An empty table stays empty, and no name of a column can clash.
    """
    return one_of_each(docs, near_duplicates(docs, tau, shingle, id_col, text_col), id_col, text_col)
