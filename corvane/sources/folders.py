"""Folders of media as a Spark data source: one listing of each folder gives its files, their three times and their side files."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.types import StructType

#: The side file that stands for a whole folder. A fixed value.
FOLDER_NOTES = "[[Collection]].json"
COLUMNS = {
    "path": "string", "folder": "string", "name": "string", "extension": "string", "size": "long", "date_created": "timestamp", "date_modified": "timestamp", "status": "string",
    "side_text": "string", "side_tags": "array<string>", "folder_tags": "array<string>",
}


class Folder(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


class FolderReader(DataSourceReader):
    """One partition a folder. Filters on extension are taken over, and only columns of the schema are worked out, so a
    schema without side files reads no file's content."""

    def __init__(self, root: str, extensions: set[str] | None, schema: StructType):
        self.root, self.extensions, self.columns = root, extensions, schema.names

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("extension",):
                asked = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.extensions = asked if self.extensions is None else self.extensions & asked
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        return [Folder(folder) for folder, _, _ in os.walk(self.root)]  # names of folders only

    def read(self, part: Folder) -> Iterator[tuple]:
        entries = sorted((e for e in os.scandir(part.path) if e.is_file()), key=lambda e: e.name)
        by_name = {e.name: e for e in entries}
        of_folder = _labels(by_name[FOLDER_NOTES].path) if "folder_tags" in self.columns and FOLDER_NOTES in by_name else None
        for e in entries:
            stem, ext = os.path.splitext(e.name)
            ext = ext[1:].lower()
            if self.extensions is not None and ext not in self.extensions:
                continue
            at = e.stat()
            text, notes = by_name.get(f"{stem}.txt"), by_name.get(f"{e.name}.json")
            row = {
                "path": lambda: e.path, "folder": lambda: part.path, "name": lambda: stem, "extension": lambda: ext, "size": lambda: at.st_size, "status": lambda: "PENDING",
                "date_created": lambda: _time(min(at.st_ctime, at.st_mtime, getattr(at, "st_birthtime", at.st_mtime))), "date_modified": lambda: _time(at.st_mtime),
                "side_text": lambda: _text(text.path) if text else None, "side_tags": lambda: _labels(notes.path) if notes else None, "folder_tags": lambda: of_folder,
            }
            yield tuple(row[c]() for c in self.columns)


def _time(seconds: float) -> datetime:
    return datetime.fromtimestamp(seconds, UTC)


def _text(path: str) -> str:
    with open(path, encoding="utf-8", errors="replace") as f:
        return f.read()


def _labels(path: str) -> list[str] | None:
    """The labels of a side file's tags; none where it can't be read as one."""
    try:
        tags = json.loads(_text(path)).get("tags") or []
        return [t["label"] for t in tags if isinstance(t, dict) and t.get("label")]
    except (ValueError, AttributeError):
        return None


class FolderSource(DataSource):
    """format("media_folders"), with the options path and extensions (comma-separated). Columns may be chosen by the reader's schema."""

    @classmethod
    def name(cls) -> str:
        return "media_folders"

    def schema(self) -> str:
        return ", ".join(f"{c} {t}" for c, t in COLUMNS.items())

    def reader(self, schema: StructType) -> DataSourceReader:
        unknown = set(schema.names) - set(COLUMNS)
        if unknown:
            raise ValueError(f"media folders have no columns {sorted(unknown)}")
        asked = self.options.get("extensions")
        return FolderReader(self.options["path"], {x.strip().lower() for x in asked.split(",")} if asked else None, schema)


def media_folders(spark: SparkSession, path: str, extensions: list[str] | None = None, columns: list[str] | None = None) -> DataFrame:
    """Files below a folder that all executors see (a mounted library), one row each, as files.listing() with side files.

    date_created is the least of the times of birth (where the system knows it), change and modification. With columns only
    those are worked out. Side texts and side files of tags are in the same folder: <name>.txt, <name>.<ext>.json and one
    for the whole folder; what can't be read as such gives null.
    """
    spark.dataSource.register(FolderSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    reader = spark.read.format("media_folders").option("path", path)
    if extensions:
        reader = reader.option("extensions", ",".join(extensions))
    if columns:
        reader = reader.schema(", ".join(f"{c} {COLUMNS[c]}" for c in columns))
    return reader.load()
