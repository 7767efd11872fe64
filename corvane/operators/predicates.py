"""Search predicates: each argument that differs from its default is one AND term."""

from __future__ import annotations

from dataclasses import dataclass, field, fields
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.session import among

COMPARISONS = {"=": "__eq__", "!=": "__ne__", ">": "__gt__", ">=": "__ge__", "<": "__lt__", "<=": "__le__"}


def compare(col: Column, op: str, value: Any) -> Column:
    if op not in COMPARISONS:
        raise ValueError(f"no such comparison: {op}")
    return getattr(col, COMPARISONS[op])(value)


def between(col: Column, low: Any = None, high: Any = None) -> list[Column]:
    return [*([col >= low] if low is not None else []), *([col <= high] if high is not None else [])]


def not_in(col: Column, values: list) -> Column:
    """Missing values pass, as nothing forbids them."""
    return F.coalesce(~col.isin(*values), F.lit(True)) if values else F.lit(True)


def matches(col: Column, pattern: str) -> Column:
    return col.rlike(f"(?i){pattern}")


def filled(col: Column) -> Column:
    return F.coalesce(col, F.lit("")) != ""


def missing_info(columns: list[str]) -> Column:
    """Any of the columns is missing or empty."""
    return reduce(Column.__or__, (~filled(F.col(c).cast("string")) for c in columns))


def missing_original(column: str, original: str) -> Column:
    """There is a value but no original of it."""
    return F.col(column).isNotNull() & ~filled(F.col(original).cast("string"))


def truth(col: Column, wanted: bool) -> Column:
    """A missing flag counts as false."""
    return F.coalesce(col, F.lit(False)) == wanted


def modified(now: Column, original: Column, wanted: bool) -> Column:
    """Rows without an original hash are in neither answer."""
    return filled(original) & ((now != original) if wanted else (now == original))


def has_any(array: Column, ids: list) -> Column:
    return F.coalesce(F.arrays_overlap(array, F.array(*map(F.lit, ids))), F.lit(False))


def has_all(array: Column, ids: list) -> Column:
    return reduce(Column.__and__, (F.coalesce(F.array_contains(array, i), F.lit(False)) for i in ids))


@dataclass(frozen=True)
class TagChoice:
    """Ids by how they are asked for; the *_desc lists are judged on ancestors, self included. See graph.with_tags_chosen()."""

    any_of: tuple = ()
    all_of: tuple = ()
    all_of_desc: tuple = ()
    none_of: tuple = ()
    none_of_desc: tuple = ()


@dataclass(frozen=True)
class FileQuery:
    """What a file search asks; columns are named as in the file view, and ones a frame lacks may not be asked for."""

    ranges: dict = field(default_factory=dict)  # column -> (low, high), each None for open
    compares: dict = field(default_factory=dict)  # column -> (operator, value)
    number_of_tags: tuple | None = None  # (operator, value)
    ids: tuple = ()
    excluded_ids: tuple = ()
    tags: TagChoice = TagChoice()
    has_params: bool = False
    is_corrupted: bool | None = None
    is_modified: bool | None = None
    is_archived: bool = False
    deselected: dict = field(default_factory=dict)  # column -> values that must not stand there
    path_pattern: str = ""

    def chosen(self, rows: DataFrame, id_col: str = "file_id") -> DataFrame:
        """Rows that pass all terms but those on tags."""
        rows = among(rows, id_col, self.ids) if self.ids else rows
        rows = among(rows, id_col, self.excluded_ids, keep=False) if self.excluded_ids else rows
        return apply(rows, self.terms())

    def terms(self) -> list[Column]:
        """The terms on columns; ids and tags are chosen by joins."""
        out = [t for c, (low, high) in self.ranges.items() for t in between(F.col(c), low, high)]
        out += [compare(F.col(c), op, v) for c, (op, v) in self.compares.items()]
        if self.number_of_tags:
            out.append(compare(F.size("tag_ids"), *self.number_of_tags))
        if self.has_params:
            out.append(filled(F.col("diffusion_params")))
        if self.is_corrupted is not None:
            out.append(truth(F.col("is_corrupted"), self.is_corrupted))
        if self.is_modified is not None:
            out.append(modified(F.col("hash"), F.col("original_hash"), self.is_modified))
        out.append(F.col("is_archived") == self.is_archived)
        out += [not_in(F.col(c), list(v)) for c, v in self.deselected.items() if v]
        if self.path_pattern:
            out.append(matches(F.col("original_path"), self.path_pattern))
        return out

    def active(self) -> int:
        """How many arguments differ from their defaults."""
        return sum(getattr(self, f.name) != getattr(FileQuery(), f.name) for f in fields(self))


def apply(df, terms: list[Column]):
    for t in terms:
        df = df.where(t)
    return df


UNIT = {"size": 1000, "bitrate": 1000}


def from_units(column: str, value: float | str) -> float:
    """Kilo units to units; h:mm:ss to seconds."""
    if isinstance(value, str):
        return float(sum(float(p) * 60**i for i, p in enumerate(reversed(value.split(":")))))
    return value * UNIT.get(column, 1)


_OPS = {"$eq": "=", "$ne": "!=", "$gt": ">", "$gte": ">=", "$lt": "<", "$lte": "<="}


def compile_filter(spec: dict, root: Column | None = None) -> Column:
    """A filter document as one Column: field: value, field: {operator: value}, $and, $or, $nor."""

    def at(name: str) -> Column:
        return F.col(name) if root is None else root[name]

    terms: list[Column] = []
    for name, wanted in spec.items():
        if name in ("$and", "$or", "$nor"):
            parts = [compile_filter(s, root) for s in wanted]
            joined = reduce(Column.__and__ if name == "$and" else Column.__or__, parts)
            terms.append(~F.coalesce(joined, F.lit(False)) if name == "$nor" else joined)
        elif name.startswith("$"):
            raise ValueError(f"not supported: {name}")
        elif isinstance(wanted, dict):
            terms += [_selector(at(name), op, v) for op, v in wanted.items() if op != "$options"]
        elif isinstance(wanted, (list, tuple)):
            terms.append(at(name).isin(*wanted))
        else:
            terms.append(at(name).eqNullSafe(wanted) if wanted is None else at(name) == wanted)
    return reduce(Column.__and__, terms) if terms else F.lit(True)


def _selector(col: Column, op: str, value: Any) -> Column:
    if op == "$ne":
        return ~col.eqNullSafe(F.lit(value))
    if op in _OPS:
        return compare(col, _OPS[op], value)
    if op == "$in":
        return col.isin(*value)
    if op == "$nin":
        return not_in(col, list(value))
    if op == "$all":
        return has_all(col, value)
    if op == "$size":
        return F.size(col) == value
    if op == "$exists":
        return col.isNotNull() if value else col.isNull()
    if op == "$regex":
        return matches(col, value)
    if op == "$elemMatch":
        return F.exists(col, lambda x: compile_filter(value, x))
    raise ValueError(f"not supported: {op}")
