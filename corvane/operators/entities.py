"""Searches over collections, import batches and tags, generic lists, and the keys each entity may be sorted by."""

from __future__ import annotations

from dataclasses import dataclass, field, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.operators import graph, predicates, search
from corvane.operators.predicates import TagChoice
from corvane.session import among

#: The keys each entity may be sorted by.
SORT_KEYS = {
    "collection": ("date_created", "date_modified", "file_count", "rating", "size", "title"),
    "batch": ("completed_at", "date_created", "file_count", "size", "started_at"),
    "file": ("bitrate", "date_created", "date_imported", "date_modified", "duration", "height", "rating", "size", "width"),
    "tag": ("count", "date_created", "date_modified", "date_of_inception", "label", "rating", "size"),
    "collection_file": ("custom", "original_name", "bitrate", "date_created", "date_imported", "date_modified", "duration", "height", "rating", "size", "width"),
    "deleted_file": (),
}
#: What a list is sorted by where nothing is asked, always descending.
DEFAULT_KEY = {"collection": "date_created", "batch": "date_created", "file": "date_created", "tag": "date_created", "collection_file": "date_created", "deleted_file": "hash"}


def checked_key(entity: str, key: str) -> str:
    if key not in SORT_KEYS[entity]:
        raise ValueError(f"{entity} can't be sorted by {key}")
    return key


@dataclass(frozen=True)
class EntityQuery:
    """Terms common to the searches; each argument that differs from its default is one AND term."""

    ranges: dict = field(default_factory=dict)  # column -> (low, high), each None for open
    compares: dict = field(default_factory=dict)  # column -> (operator, value)
    patterns: dict = field(default_factory=dict)  # column -> regular expression, case aside
    ids: tuple = ()
    tags: TagChoice = TagChoice()

    def chosen(self, rows: DataFrame, id_col: str) -> DataFrame:
        """Rows that pass all terms but those on tags."""
        return predicates.apply(among(rows, id_col, self.ids) if self.ids else rows, self.terms())

    def terms(self) -> list[Column]:
        """The terms on columns; ids and tags are chosen by joins."""
        out = [t for c, (low, high) in self.ranges.items() for t in predicates.between(F.col(c), low, high)]
        out += [predicates.compare(F.col(c), op, v) for c, (op, v) in self.compares.items()]
        out += [predicates.matches(F.col(c), p) for c, p in self.patterns.items() if p]
        return out

    def active(self) -> int:
        """How many arguments differ from their defaults."""
        return sum(getattr(self, f.name) != f.default if f.default_factory is not dict else bool(getattr(self, f.name)) for f in fields(self))


@dataclass(frozen=True)
class BatchQuery(EntityQuery):
    is_completed: bool = False  # always asked
    import_path: str = ""  # occurs in the path of some import of the batch

    def terms(self) -> list[Column]:
        return [*super().terms(), F.col("is_completed") == self.is_completed]


@dataclass(frozen=True)
class TagQuery(EntityQuery):
    alias_pattern: str = ""
    has_regex: bool | None = None

    def terms(self) -> list[Column]:
        out = super().terms()
        if self.alias_pattern:
            out.append(F.exists("aliases", lambda a: predicates.matches(a, self.alias_pattern)))
        if self.has_regex is not None:
            out.append(predicates.filled(F.col("regex")) == self.has_regex)
        return out


def collections(rows: DataFrame, member_tags: DataFrame, edges: DataFrame, query: EntityQuery) -> DataFrame:
    """Collections; member_tags: (collection_id, tag_id)."""
    return graph.with_tags_chosen(query.chosen(rows, "collection_id"), member_tags, edges, query.tags, "collection_id")


def batches(rows: DataFrame, batch_tags: DataFrame, imports: DataFrame, edges: DataFrame, query: BatchQuery) -> DataFrame:
    """Import batches; imports: (batch_id, path)."""
    out = query.chosen(rows, "batch_id")
    if query.import_path:
        out = out.join(imports.where(predicates.matches(F.col("path"), query.import_path)).select("batch_id"), "batch_id", "left_semi")
    return graph.with_tags_chosen(out, batch_tags, edges, query.tags, "batch_id")


def tags(rows: DataFrame, edges: DataFrame, query: TagQuery) -> DataFrame:
    """Tags; a choice of tags is judged on the tag itself and on its ancestors."""
    own = rows.select("tag_id", F.col("tag_id").alias("own"))
    return graph.with_tags_chosen(query.chosen(rows, "tag_id"), own, edges, query.tags, "tag_id", "own")


def listed(rows: DataFrame, entity: str, spec: dict | None = None, id_col: str = "id", key: str | None = None, descending: bool = True, number: int | None = None, size: int | None = None) -> DataFrame:
    """Rows that pass a filter document, in a total order, whole or one page; `id` in the document stands for id_col, and a list for any of it."""
    spec = {id_col if k == "id" else k: v for k, v in (spec or {}).items()}
    out = rows.where(predicates.compile_filter(spec)) if spec else rows
    key = checked_key(entity, key) if key else DEFAULT_KEY[entity]
    if number and size:
        return search.page(out, key, descending, number, size, id_col)
    return search.ordered(out, key, descending, id_col)


def found(rows: DataFrame, column: str, value) -> DataFrame:
    """The row with that id or hash, or none."""
    return rows.where(F.col(column) == value).limit(1)


def choice_of(options: list[tuple[str, str]]) -> TagChoice:
    """A tag choice from (tag id, search type) as picked: includeAnd, includeOr, includeDesc, exclude or excludeDesc."""
    lists: dict[str, list] = {"includeAnd": [], "includeOr": [], "includeDesc": [], "exclude": [], "excludeDesc": []}
    for tag, kind in options:
        lists[kind].append(tag)
    return TagChoice(any_of=tuple(lists["includeOr"]), all_of=tuple(lists["includeAnd"]), all_of_desc=tuple(lists["includeDesc"]), none_of=tuple(lists["exclude"]), none_of_desc=tuple(lists["excludeDesc"]))


def toggled(selected: Column, added: Column, removed: Column) -> Column:
    """A selection after a change: the old one and the added ids, once each, without the removed ones."""
    return F.filter(F.array_union(selected, added), lambda x: ~F.coalesce(F.array_contains(removed, x), F.lit(False)))


def clicked(selected: Column, item: Column, control: Column) -> Column:
    """A selection after a click: the item alone, or with the control key the item put in or taken out."""
    inside = F.coalesce(F.array_contains(selected, item), F.lit(False))
    return F.when(~control, F.array(item)).when(inside, F.filter(selected, lambda x: x != item)).otherwise(F.array_append(selected, item))
