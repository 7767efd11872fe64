"""Benchmark decontamination, with DataFrame functions only.

The benchmark's normalised word windows form a hash set that is broadcast while
its counted size stays under a bound (a shuffled join takes over beyond it).
Every window of every training document probes the set by hash; a hit counts
only when the words themselves are equal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import ascii_lower, materialize, packed, unpacked, with_window_hashes

#: What separates words, after lower-casing A-Z.
SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Runs of word characters and of others in a text whose case is unchanged.
RUNS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+|[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Windows of the benchmark up to which they are broadcast (about 200 bytes each).
BROADCAST_WINDOWS, BROADCAST_BYTES = 500_000, 64 << 20


def words_of(text: Column) -> Column:
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATOR), lambda w: w != "")


def benchmark_windows(benchmark: DataFrame, window: int = 10, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(h, w, len, items): the distinct windows of all items; an item of fewer words, but not none, is one window."""
    items = benchmark.select(F.col(item_col).cast("string").alias("_item"), words_of(F.col(text_col)).alias("_words")).where(F.size("_words") > 0)
    out = None
    for length in range(1, window + 1):
        fitting = items.where(F.size("_words") >= window) if length == window else items.where(F.size("_words") == length)
        # The outer explode: for a plain one Spark infers a filter that it pushes below, with every step written out again.
        rows = with_window_hashes(fitting, "_words", length, "_hashes").select("_item", "_words", F.posexplode_outer("_hashes").alias("pos", "h"))
        rows = rows.select("_item", "h", F.lit(length).alias("len"), F.slice("_words", F.col("pos") + 1, length).alias("w"))
        out = rows if out is None else out.unionByName(rows)
    return out.groupBy("h", "len", "w").agg(F.collect_set("_item").alias("items"))


def find_candidates(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """docs (number, text) with candidates: number, n_words, found, for those that have any.

    found: array<struct<start, len, w, items>> of the windows whose hashes are in the set, not verified yet.
    """
    hit_set = materialize(benchmark_windows(benchmark, window), "windows")
    sizes = {r["len"]: r["n"] for r in hit_set.groupBy("len").agg(F.count("*").alias("n")).collect()}  # at most `window` rows
    bytes_ = hit_set.agg(F.sum(F.octet_length(F.array_join("w", " ")) + 16 * F.size("items"))).first()[0] or 0
    small = sum(sizes.values()) <= BROADCAST_WINDOWS and bytes_ <= BROADCAST_BYTES
    words = docs.select("number", words_of(F.col("text")).alias("_words"))
    out = None
    for length in sorted(sizes) or [window]:
        probes = with_window_hashes(words, "_words", length, "_hashes").select("number", F.posexplode_outer("_hashes").alias("_pos", "h"))
        own = hit_set.where(F.col("len") == length).select("h", "w", "items")
        joined = probes.join(F.broadcast(own) if small else own, "h")
        rows = joined.select("number", F.struct(F.col("_pos").alias("start"), F.lit(length).alias("len"), "w", "items").alias("found"))
        out = rows if out is None else out.unionByName(rows)
    return out.groupBy("number").agg(F.collect_list("found").alias("found"))


def covered(spans: Column) -> Column:
    """Words inside at least one of the spans, which are sorted by start."""
    state = F.struct(F.lit(0).alias("upto"), F.lit(0).alias("n"))
    return F.aggregate(
        spans,
        state,
        lambda s, x: F.struct(F.greatest(s["upto"], x["end"]).alias("upto"), (s["n"] + F.greatest(F.lit(0), x["end"] - F.greatest(x["start"], s["upto"]))).alias("n")),
        lambda s: s["n"],
    )


NO_CANDIDATES = "array<struct<start:int,len:int,w:array<string>,items:array<string>>>"


def _judged(docs: DataFrame, benchmark: DataFrame, window: int, id_col: str, text_col: str) -> DataFrame:
    """(row, text, n_words, n_hit, items, spans) of every row of docs."""
    rows = materialize(packed(docs, id_col, text_col).select("row", F.monotonically_increasing_id().alias("number")), "rows").withColumn("text", F.col("row")[text_col])
    found = find_candidates(rows.select("number", "text"), benchmark, window)
    joined = rows.select("row", "text", "number").join(found, "number", "left").withColumn("found", F.coalesce("found", F.array().cast(NO_CANDIDATES)))
    # Verified word by word.
    joined = joined.withColumn("_words", words_of(F.col("text")))
    joined = joined.withColumn("_true", F.filter("found", lambda c: F.slice("_words", c["start"] + 1, c["len"]) == c["w"]))
    return joined.select(
        "row",
        "text",
        F.size("_words").cast("long").alias("n_words"),
        F.array_sort(F.array_distinct(F.transform("_true", lambda c: F.struct(c["start"].alias("start"), (c["start"] + c["len"]).alias("end"))))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.transform("_true", lambda c: c["items"])))).alias("items"),
    ).withColumn("n_hit", covered(F.col("spans")).cast("long"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row of docs with n_words, n_hit, items and spans added (columns of those names are replaced).

    Null and empty texts have no words and no hits. Rows that share an id, or are repeated, are judged one by one.
    An empty benchmark hits nothing, and no rows give none.
    """
    names = [c for c in docs.columns if c not in ("n_words", "n_hit", "items", "spans")]
    return _judged(docs, benchmark, window, id_col, text_col).select(*(F.col("row")[c].alias(c) for c in names), "n_words", "n_hit", "items", "spans")


def merged(spans: Column) -> Column:
    """Overlapping and touching spans, sorted by start, as one."""
    none = F.array().cast("array<struct<start:int,end:int>>")
    last = lambda acc: F.element_at(acc, -1)
    return F.aggregate(
        spans,
        none,
        lambda acc, x: F.when((F.size(acc) > 0) & (F.get(acc, F.size(acc) - 1)["end"] >= x["start"]), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last(acc)["start"].alias("start"), F.greatest(last(acc)["end"], x["end"]).alias("end"))))).otherwise(F.concat(acc, F.array(x))),
    )


def remove_spans(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs (with spans) whose texts lack the words of the spans and what follows each of them up to the next word.

    Null and empty texts, and those without spans, stay as they are. Columns _spans, _runs, _first and _kept are not kept.
    """
    text = F.col(text_col)
    # Columns of their own, so that no step is worked out again for each run of a text.
    docs = docs.withColumn("_spans", merged(F.col("spans")))
    docs = docs.withColumn("_runs", F.when(F.size("_spans") > 0, F.regexp_extract_all(text, F.lit(RUNS), F.lit(0))))
    docs = docs.withColumn("_first", F.when(F.get("_runs", F.lit(0)).rlike(f"^(?:{RUNS.split('|')[0]})"), 0).otherwise(1))  # index of the first word's run
    word = lambda i: F.floor((i - F.col("_first")) / 2)
    kept = F.filter("_runs", lambda r, i: (i < F.col("_first")) | ~F.exists("_spans", lambda s: (word(i) >= s["start"]) & (word(i) < s["end"])))
    docs = docs.withColumn("_kept", kept)
    return docs.withColumn(text_col, F.when(F.size("_spans") > 0, F.array_join("_kept", "")).otherwise(text)).drop("_spans", "_runs", "_first", "_kept")


def clean(docs: DataFrame, benchmark: DataFrame, window: int = 10, drop_share: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without benchmark passages: spans are cut; a document with more than drop_share of its words hit goes.

    Columns, whatever their names, stay those of docs with their values; documents without a hit, null and empty texts
    come out as they went in, repeated rows each on its own. An empty benchmark changes nothing.
    """
    judged = _judged(docs, benchmark, window, id_col, text_col).where(F.col("n_hit") <= F.col("n_words") * drop_share)
    return unpacked(remove_spans(judged), docs.columns, **{text_col: F.col("text")})
