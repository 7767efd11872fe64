"""Many patterns against many names, and patterns against an index of trigrams, so that few pairs meet an expression."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.session import cut, shared_folder, union

#: Literals shorter than this are in too many names to be looked for.
SHORTEST = 3
#: Patterns whose literals one automaton holds.
BLOCK = 50_000
LINE_ENDS = r"[\n\r\u0085\u2028\u2029]"
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _alternatives(pattern: str) -> list[str] | None:
    """The parts between bars outside brackets; None where the brackets don't match up."""
    parts, depth, start, i = [], 0, 0, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            i += 1
        elif c == "[":
            i = _class_end(pattern, i)
            if i < 0:
                return None
        elif c in "()":
            depth += 1 if c == "(" else -1
            if depth < 0:
                return None
        elif c == "|" and depth == 0:
            parts.append(pattern[start:i])
            start = i + 1
        i += 1
    return [*parts, pattern[start:]] if depth == 0 else None


def _class_end(pattern: str, i: int) -> int:
    """Where the character class that opens at i is closed; -1 for nested ones and those without an end."""
    j = i + 1 + (pattern[i + 1 : i + 2] == "^")
    j += pattern[j : j + 1] == "]"
    while j < len(pattern) and pattern[j] != "]":
        if pattern[j] == "[" or pattern[j] == "&":
            return -1
        j += 2 if pattern[j] == "\\" else 1
    return j if j < len(pattern) else -1


def required(pattern: str) -> list[str] | None:
    """Literals, A-Z in lower case, of which every match holds one: the longest of each alternative. None where there is no telling."""
    parts = _alternatives(pattern)
    if parts is None:
        return None
    out = []
    for part in parts:
        if len(part) > 1 and part[0] == "(" and part[-1] == ")" and part[1] != "?" and len(_alternatives(part[1:-1]) or []) >= 1:
            inner = required(part[1:-1])
            if inner is None:
                return None
            out += inner
            continue
        runs = _runs(part)
        best = max(runs, key=len, default="") if runs is not None else ""
        if len(best) < SHORTEST:
            return None
        out.append(best)
    return out


def _runs(part: str) -> list[str] | None:
    """Runs of characters that stand in every match of an expression without bars at its top."""
    runs, now, i = [], "", 0

    def end() -> None:
        nonlocal now
        runs.append(now.translate(_LOWER))
        now = ""

    while i < len(part):
        c = part[i]
        if c == "\\":
            following = part[i + 1 : i + 2]
            if following in "wWdDsSbB" and following:
                end()
            elif following and not following.isalnum():
                now += following
            else:
                return None  # an escape with a meaning of its own
            i += 2
            continue
        if c == "(":
            if part[i + 1 : i + 2] == "?" and part[i + 1 : i + 3] not in ("?:", "?=", "?!"):
                return None
            depth, i = 1, i + 1
            while i < len(part) and depth:
                if part[i] == "[":
                    i = _class_end(part, i)
                    if i < 0:
                        return None
                depth += (part[i] == "(") - (part[i] == ")")
                i += 2 if part[i] == "\\" else 1
            end()
            continue
        if c == "[":
            i = _class_end(part, i)
            if i < 0:
                return None
            end()
        elif c in "*?{":  # what stands before need not be there
            now = now[:-1]
            end()
            if c == "{":
                i = part.find("}", i)
                if i < 0:
                    return None
        elif c in ".^$+":
            end()
        else:
            now += c
        i += 1
    end()
    return runs


def whole_name(pattern: str) -> list[str] | None:
    """Normal forms of the names that (^a$)|(^b$)... matches: lower case, with runs of blanks, dashes, underscores and dots as one blank.

    None for other patterns. The form is shared by a few names too many, so matches are still verified.
    """
    out = []
    for part in _alternatives(pattern) or [""]:
        if not (part.startswith("(^") and part.endswith("$)")):
            return None
        text, i, inner = "", 0, part[2:-2]
        while i < len(inner):
            if inner.startswith(r"[\s\-_\.]+", i):
                text, i = text + " ", i + len(r"[\s\-_\.]+")
            elif inner[i] == "\\":
                if inner[i + 1 : i + 2].isalnum() or i + 1 >= len(inner):
                    return None
                text, i = text + inner[i + 1], i + 2
            elif inner[i] in "[](){}*+?|^$.":
                return None
            else:
                text, i = text + inner[i], i + 1
        out.append(text)
    return out


def normal(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), r"[\s\-_.]+", " ")


def _sorted_out(patterns: DataFrame) -> DataFrame:
    """(tag_id, pattern, kind, key): names of whole patterns, literals of others, and null for patterns that give neither."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for tag, pattern in zip(frame["tag_id"], frame["pattern"]):
                if (names := whole_name(pattern)) is not None:
                    rows += [(tag, pattern, "name", n) for n in set(names)]
                elif (literals := required(pattern)) is not None:
                    rows += [(tag, pattern, "literal", x) for x in set(literals)]
                else:
                    rows.append((tag, pattern, "open", None))
            yield pd.DataFrame(rows, columns=["tag_id", "pattern", "kind", "key"])

    kinds = dict(patterns.dtypes)
    return patterns.where("pattern is not null").select("tag_id", "pattern").mapInPandas(run, f"tag_id {kinds['tag_id']}, pattern string, kind string, key string")


def tags_by_pattern(names: DataFrame, patterns: DataFrame) -> DataFrame:
    """(name, tag_id) wherever a tag's pattern (Java syntax) occurs in a name, case aside; each distinct name is looked at once.

    Patterns for whole names, (^label$), meet the names by a hash join on a normal form. Of others the literals that each
    match must hold are put into automata of bounded size, which a task builds once and runs over its names. What meets that way is
    verified by the expression itself. Only patterns without such literals, and names of several lines, are tried against
    all, in blocks. Null names and null patterns meet nothing.
    """
    own = cut(names.select("name").where("name is not null").distinct())
    sorted_out = cut(_sorted_out(patterns))
    counts = {r["kind"]: r["count"] for r in sorted_out.groupBy("kind").count().collect()}
    found = []
    if counts.get("name"):
        keys = sorted_out.where("kind = 'name'").select("tag_id", "pattern", normal(F.col("key")).alias("_key"))
        found.append(own.withColumn("_key", normal(F.col("name"))).join(keys, "_key").select("name", "tag_id", "pattern"))
    for part in range(-(-counts.get("literal", 0) // BLOCK)):
        block = sorted_out.where("kind = 'literal'").where(F.pmod(F.xxhash64("tag_id", "pattern", "key"), F.lit(-(-counts["literal"] // BLOCK))) == part)
        found.append(_by_literals(own, block))
    if counts.get("open"):
        found.append(_by_scan(own, sorted_out.where("kind = 'open'"), counts["open"]))
    if found and (counts.get("name") or 0) and not (lines := own.where(F.col("name").rlike(LINE_ENDS))).isEmpty():
        found.append(_by_scan(lines, sorted_out.where("kind = 'name'"), counts["name"]))
    if not found:
        return own.join(patterns.select("tag_id").limit(0), F.lit(True)).select("name", "tag_id")
    return union(found).where(F.expr("name rlike concat('(?im)', pattern)")).select("name", "tag_id").distinct()


def _by_scan(names: DataFrame, patterns: DataFrame, n: int) -> DataFrame:
    parts = -(-n // 1_000)
    blocks = [patterns.where(F.pmod(F.xxhash64("tag_id", "pattern"), F.lit(parts)) == i) for i in range(parts)]
    return union([names.join(F.broadcast(b), F.expr("name rlike concat('(?im)', pattern)")).select("name", "tag_id", "pattern") for b in blocks])


def _by_literals(names: DataFrame, block: DataFrame) -> DataFrame:
    """(name, tag_id, pattern) where a literal of the pattern stands in the name; the block is bounded, so each task has it."""
    rows = block.select("tag_id", "pattern", "key").toArrow()  # BLOCK rows or so
    shared = names.sparkSession.sparkContext.broadcast(rows)
    kinds = dict(block.dtypes)

    def run(batches):
        import ahocorasick
        import pyarrow as pa

        table = shared.value
        of: dict[str, list[int]] = {}
        for i, key in enumerate(table.column("key").to_pylist()):
            of.setdefault(key, []).append(i)
        automaton = ahocorasick.Automaton()
        for key, held in of.items():
            automaton.add_word(key, held)
        automaton.make_automaton()
        for batch in batches:
            who, what = [], []
            for at, name in enumerate(batch.column(0).to_pylist()):
                hit = {i for _, held in automaton.iter(name.translate(_LOWER)) for i in held}
                who += [at] * len(hit)
                what += hit
            if who:
                met = table.take(pa.array(what))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(who)), *(met.column(c).combine_chunks() for c in ("tag_id", "pattern"))], ["name", "tag_id", "pattern"])

    return names.select("name").mapInArrow(run, f"name string, tag_id {kinds['tag_id']}, pattern string")


# Trigrams


@dataclass(frozen=True)
class TrigramIndex:
    """Postings of all trigrams of a text column: (gram, block, ids), in files sorted by gram; and the rows by id."""

    rows: DataFrame
    postings: DataFrame
    id_col: str
    text_col: str


#: Characters of texts whose runs of three are sorted at once.
CHARS = 2_000_000


def _runs_of_three(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(run, place of its text) of the distinct runs of three code points of each text, A-Z lowered, by run and then by text."""
    points = np.frombuffer("".join(texts).translate(_LOWER).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    at = np.repeat(np.arange(len(texts)), np.fromiter(map(len, texts), np.int64, len(texts)))
    starts = np.flatnonzero(at[:-2] == at[2:])
    runs, at = (points[starts] << 42) | (points[starts + 1] << 21) | points[starts + 2], at[starts]
    order = np.argsort(runs, kind="stable")
    runs, at = runs[order], at[order]
    once = np.r_[True, (runs[1:] != runs[:-1]) | (at[1:] != at[:-1])]
    return runs[once], at[once]


def _postings(table: pa.Table) -> pa.Table:
    """(gram, block, ids) of one block's rows (block, id, text), ids sorted. Long texts are gone through in parts."""
    table = table.sort_by("id")
    texts = table.column("text").to_pylist()
    part = np.cumsum([len(x) for x in texts]) // CHARS
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(texts)]
    found = [(runs, at + a) for a, b in zip(cuts, cuts[1:]) for runs, at in [_runs_of_three(texts[a:b])]]
    runs, at = np.concatenate([r for r, _ in found]), np.concatenate([a for _, a in found])
    if len(found) > 1:
        order = np.argsort(runs, kind="stable")  # texts stay in order within a run
        runs, at = runs[order], at[order]
    first = np.flatnonzero(np.r_[True, runs[1:] != runs[:-1]])
    names = [chr(g >> 42) + chr(g >> 21 & 0x1FFFFF) + chr(g & 0x1FFFFF) for g in runs[first].tolist()]
    ids = pa.ListArray.from_arrays(pa.array(np.r_[first, len(at)].astype(np.int32)), table.column("id").combine_chunks().take(pa.array(at)))
    return pa.table({"gram": pa.array(names, pa.string()), "block": table.column("block").take(pa.array(np.zeros(len(names), np.int64))), "ids": ids})


def trigram_index(rows: DataFrame, id_col: str, text_col: str, block: int = 10_000) -> TrigramIndex:
    """An index of rows by the trigrams of a text; ids are unique. A common gram is cut into blocks of about so many ids, so no list grows with the table."""
    spark = rows.sparkSession
    blocks = max(1, -(-rows.count() // block))
    kind = dict(rows.dtypes)[id_col]
    # A block's rows lie together, so that its lists are made whole by one pass over its texts.
    each = rows.where((F.length(text_col) >= 3) & F.col(id_col).isNotNull()).select(F.pmod(F.xxhash64(id_col), F.lit(blocks)).alias("block"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    lists = each.groupBy("block").applyInArrow(_postings, f"gram string, block {dict(each.dtypes)['block']}, ids array<{kind}>")
    path = shared_folder(spark)
    width = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    lists.repartitionByRange(width, "gram", "block").sortWithinPartitions("gram", "block").write.option("parquet.block.size", 4 << 20).parquet(path)
    return TrigramIndex(rows, spark.read.schema(lists.schema).parquet(path), id_col, text_col)


def search(index: TrigramIndex, pattern: str) -> DataFrame:
    """Rows whose text a pattern (Java syntax) matches, case aside: the lists of the grams it requires are met, and what stands in all is verified.

    Parquet's ranges of gram leave only the files and row groups that hold an asked gram to be read. A pattern without
    literals of three characters is tried against all rows.
    """
    literals = required(pattern)
    text = F.col(index.text_col)
    rows = index.rows
    if literals is not None:
        sets = [sorted({x[i : i + 3] for i in range(len(x) - 2)}) for x in literals]
        asked = index.postings.where(F.col("gram").isin(*sorted({g for s in sets for g in s}))).select(F.explode("ids").alias("id"), "gram")
        held = asked.groupBy("id").agg(*(F.count_if(F.col("gram").isin(*s)).alias(f"n{k}") for k, s in enumerate(sets)))
        some = held.where(" or ".join(f"n{k} = {len(s)}" for k, s in enumerate(sets))).select(F.col("id").alias(index.id_col))
        rows = rows.join(some, index.id_col, "left_semi")
    return rows.where(text.rlike(f"(?i){pattern}"))
