"""Decisions about pictures and videos, as arithmetic over Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fit_within(width: Column, height: Column, most_width: int, most_height: int) -> Column:
    """(width, height) that fit the box, sides in proportion."""
    scale = F.least(F.lit(float(most_width)) / width, F.lit(float(most_height)) / height)
    return F.struct(F.floor(width * scale).cast("int").alias("width"), F.floor(height * scale).cast("int").alias("height"))


def frame_times(duration: Column, frames: int = 9, skip: float = 0.03) -> Column:
    """Where to take the frames of a thumbnail, without the first seconds."""
    start = duration * skip
    return F.transform(F.sequence(F.lit(0), F.lit(frames - 1)), lambda i: i * (duration - start) / frames + start)


def total_frames(rate: Column, duration: Column) -> Column:
    return rate * duration


def reencode(codec: Column, bitrate: Column, rate: Column, to_codec: str, most_bitrate: int, most_rate: float) -> Column:
    """Targets for a new encoding and whether the old one will do."""
    enough = (codec == to_codec) & (rate <= most_rate) & (bitrate <= most_bitrate)
    return F.struct(F.least(bitrate, F.lit(most_bitrate)).alias("bitrate"), F.least(rate, F.lit(most_rate)).alias("rate"), enough.alias("skip"))


def worth_keeping(new_size: Column, old_size: Column, share: float = 0.9) -> Column:
    return new_size < old_size * share


def splice_is_valid(pairs: Column, duration: Column) -> Column:
    """All (start, end) are numbers, not negative, in order and inside the duration."""
    return F.forall(pairs, lambda p: p["start"].isNotNull() & p["end"].isNotNull() & ~F.isnan(p["start"]) & ~F.isnan(p["end"]) & (p["start"] >= 0) & (p["end"] > p["start"]) & (p["end"] <= duration))


def numbered(pairs: Column) -> Column:
    """Pairs with their order from 1, as they stand."""
    return F.transform(pairs, lambda p, i: p.withField("order", i + 1))


def without_pair(pairs: Column, pair_id: Column) -> Column:
    return numbered(F.filter(pairs, lambda p: p["id"] != pair_id))


def swapped(pairs: Column, pair_id: Column, order: Column) -> Column:
    """Pairs after one takes a place and the one that had it takes its own."""
    old = F.filter(pairs, lambda p: p["id"] == pair_id)[0]["order"]
    moved = F.transform(pairs, lambda p: p.withField("order", F.when(p["id"] == pair_id, order).when(p["order"] == order, old).otherwise(p["order"])))
    return F.array_sort(moved, lambda a, b: a["order"] - b["order"])


def splice_duration(pairs: Column) -> Column:
    return F.aggregate(pairs, F.lit(0.0), lambda s, p: s + p["end"] - p["start"])
