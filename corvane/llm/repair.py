"""Repair of conversations: the cheapest edits that make the roles alternate, by a DP over the turns that are retained."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import crc32_mod, materialize, shuffle_width
from corvane.llm.turns import crossings, in_pieces, placed

#: What precedes a retained turn: nothing, or a turn of one of these roles.
START, SYSTEM, USER, ASSISTANT = range(4)
INITIALS = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
NAMES = {USER: "user", ASSISTANT: "assistant"}
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
NEVER = 1 << 60
#: Turns to be inserted between a role and the next one retained (user, assistant); a system turn stands at the start only.
BETWEEN = {(START, SYSTEM): 0, (START, USER): 0, (START, ASSISTANT): 1, (SYSTEM, USER): 0, (SYSTEM, ASSISTANT): 1, (USER, ASSISTANT): 0, (USER, USER): 1, (ASSISTANT, USER): 0, (ASSISTANT, ASSISTANT): 1}
#: Turns to be inserted at the end, after each role.
AT_END = [0, 2, 1, 0]
ENDS = [INSERT * n for n in AT_END]

BLANK, DUPLICATE, SHORT = "blank", "duplicate", "truncated"
CHARACTER = r"[^\x20\x09-\x0D]"


def options(initial: str, fault: str | None) -> list[tuple[int, int, int, str]]:
    """(role before, role after, price, letters) of every way to retain a turn, those with the least letters first."""
    if fault in (BLANK, DUPLICATE):
        return []
    own, extra = INITIALS.get(initial, -1), TRUNCATED if fault == SHORT else 0
    ways = []
    for (before, after), inserts in BETWEEN.items():
        if after == own:
            ways.append((before, after, INSERT * inserts + extra, "I" * inserts + "K"))
        elif after != SYSTEM:
            ways.append((before, after, INSERT * inserts + REROLE + extra, "I" * inserts + "R"))
    return sorted(ways, key=lambda w: w[3])


_OPTIONS = {(i, f): options(i, f) for i in (*INITIALS, "") for f in (None, BLANK, DUPLICATE, SHORT)}


def solve(turns: list[tuple[str, str | None]], ends: list[int]) -> tuple[list[int], list[list]]:
    """(costs, choices) for turns (initial, fault), by the role that stands before them; ends: what each role costs after them.

    From the last turn to the first, each role before a gap keeps the cheapest next retained turn: a running minimum of the
    price of retaining it and all that follows, plus the deletions before it as a prefix sum. The role pair says what is
    inserted. Audits of equal price are told apart by their first letters, as the ways to go on from a turn begin
    differently: deleting it (D) comes before inserting (IK, IR), keeping (K) and reroling (R), so a later turn is only
    replaced by a cheaper one. choices[i][role] is (next retained turn, role after it, letters), or None for none.
    """
    n = len(turns)
    deleted = DELETE * n  # prefix sum of deletions up to the end
    least = [deleted + e for e in ends]
    best: list = [None] * 4
    choices = [None] * n
    for i in range(n - 1, -1, -1):
        deleted = DELETE * i
        after = [x - deleted - DELETE for x in least]  # the cheapest rest behind turn i, by the role before it
        for before, role, price, letters in _OPTIONS[turns[i][0] if turns[i][0] in INITIALS else "", turns[i][1]]:
            value = deleted + price + after[role]
            # Of the ways at this very turn the first, which has the least letters, stays at equal price.
            if value < least[before]:
                least[before], best[before] = value, (i, role, letters)
        choices[i] = tuple(best)
    return least, choices


def walk(choices: list, n: int, role: int) -> tuple[list[tuple[str, int, int]], int]:
    """Edits (letter, turn or -1, role) from a role before the first turn on, and the role at the end."""
    edits, i = [], 0
    while i < n:
        chosen = choices[i][role]
        at = chosen[0] if chosen else n
        edits += [("D", j, 0) for j in range(i, at)]
        if chosen:
            _, after, letters = chosen
            if letters[0] == "I":
                edits.append(("I", -1, USER if after == ASSISTANT else ASSISTANT))
            edits.append((letters[-1], at, after))
            role = after
        i = at + 1
    return edits, role


def faults(turns: DataFrame) -> DataFrame:
    """placed() turns with fault: blank, duplicate (role and text stood before in the conversation), truncated or null; role and text without nulls."""
    rows = placed(turns.withColumns({c: F.coalesce(c, F.lit(" ")) for c in ("role", "text")}))
    # The first row of each text, found by an aggregate with partial sums; rows meet it by their own place, so no text is a hot key.
    firsts = rows.groupBy("conv_id", "role", "text").agg(F.min("place").alias("place")).select("place", F.lit(True).alias("_first"))
    last = F.regexp_extract("text", rf"({CHARACTER})[\x20\x09-\x0D]*\z", 1)
    fault = F.when(~F.col("text").rlike(CHARACTER), BLANK).when(F.col("_first").isNull(), DUPLICATE).when(~last.isin(".", "!", "?"), SHORT)
    return rows.join(firsts, "place", "left").withColumn("fault", fault).drop("_first")



def _ways() -> tuple[str, dict]:
    """How a piece is entered, what each role costs behind it, and whether the conversation ends there: types and defaults."""
    return "entry int, ends array<long>, last boolean", {"entry": F.lit(START), "ends": F.array(*map(F.lit, ENDS)).cast("array<long>"), "last": F.lit(True)}


EDITS = "turn {turn}, edit string, role string, text string, was string, fault string"


def edits(turns: DataFrame, most: int = 1 << 24) -> DataFrame:
    """The cheapest edits of each conversation of (conv_id, turn, role, text), in order, after which it reads system?, then user and assistant in turns.

    (conv_id, piece, seq, turn, edit, role, text, was, fault): K keeps a turn, R gives it another role, D deletes it, I
    inserts an empty one; was is the role before. Keep costs 0, rerole 3, delete 4 (blank and repeated turns must go), insert
    3, and each truncated turn that stays 3 more. Of equally cheap edits those whose letters are least in ASCII order count.

    Null roles and texts count as one space; null turns come first, rows of one turn by role and text. Rows that are alike
    are duplicates. A null conv_id is a conversation too; other columns are left aside. Empty tables give no rows.

    A conversation of more than `most` characters over several blocks is solved block by block: the price of each block
    from any role to any other makes a table of 4 x 4, the tables are folded from the end, and each block then walks from
    the role it is entered with.
    """
    spark = turns.sparkSession
    kinds = dict(turns.dtypes)
    rows = materialize(faults(turns), "faults")
    crossing = crossings(rows, chars=F.length("text"))
    long = [c for c in crossing if c.total("chars") > most]
    cuts = [(c.conv_id, p["block"], 0, START, ENDS, True) for c in crossing if c.total("chars") <= most for p in c.parts]
    if long:
        ways = _folded(rows, long)
        cuts += [(c.conv_id, p["block"], k, *ways[c.conv_id, k], k == len(c.parts) - 1) for c in long for k, p in enumerate(c.parts)]
    dealt = in_pieces(rows, cuts, *_ways())
    names = ["conv_id", "piece", "seq", "turn", "edit", "role", "text", "was", "fault"]

    def run(batches):
        import pyarrow as pa

        for part, types in _pieces(batches):
            (conv, piece), entry, ends, last, got = part
            _, choices = solve([(r[:1], f) for _, r, _, f in got], ends)
            found, role = walk(choices, len(got), entry)
            if last:
                found += [("I", -1, r) for r in (USER, ASSISTANT)[2 - AT_END[role] :]]
            out = []
            for k, (letter, at, role) in enumerate(found):
                turn, was, text, fault = got[at] if at >= 0 else (None, None, "", None)
                out.append((conv, piece, k, turn, letter, NAMES[role] if letter in "RI" else was, text, was, fault))
            for start in range(0, len(out), 20_000):
                cols = list(zip(*out[start : start + 20_000]))
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types)], names)

    return dealt.mapInArrow(run, f"conv_id {kinds['conv_id']}, piece long, seq long, {EDITS.format(turn=kinds['turn'])}")


def _pieces(batches):
    """((conv_id, piece), entry, ends, last, [(turn, role, text, fault)]) of each piece in sorted batches, with the Arrow types of edits."""
    import pyarrow as pa

    key, own, got, types = None, None, [], None
    for batch in batches:
        kept = batch.schema.field
        types = [kept("conv_id").type, pa.int64(), pa.int64(), kept("turn").type, *[pa.string()] * 5]
        for conv, piece, entry, ends, last, *row in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "piece", "entry", "ends", "last", "turn", "role", "text", "fault"))):
            if key != (conv, piece):
                if key:
                    yield (key, *own, got), types
                key, own, got = (conv, piece), (entry, ends, last), []
            got.append(tuple(row))
    if key:
        yield (key, *own, got), types


def _folded(rows: DataFrame, long: list) -> dict:
    """(entry role, prices at the end) of each piece of long conversations, from the price tables of their blocks."""
    spark, kind = rows.sparkSession, dict(rows.dtypes)["conv_id"]
    ids = F.broadcast(spark.createDataFrame([(c.conv_id,) for c in long], f"_conv {kind}"))
    own = rows.join(ids, rows["conv_id"].eqNullSafe(ids["_conv"]), "left_semi").select("conv_id", "block", "place", "turn", F.substring("role", 1, 1).alias("role"), F.lit("").alias("text"), "fault")

    def tables(ends_of: dict, shape: str):
        cuts = [(c.conv_id, p["block"], k, START, ends_of[c.conv_id, k], False) for c in long for k, p in enumerate(c.parts)]
        dealt = in_pieces(own, cuts, *_ways())

        def run(batches):
            import pyarrow as pa

            for part, types in _pieces(batches):
                (conv, piece), _, ends, _, got = part
                turns = [(r[:1], f) for _, r, _, f in got]
                if shape == "prices":
                    columns = [solve(turns, [0 if q == role else NEVER for q in range(4)])[0] for role in range(4)]
                    table = [min(columns[q][p], NEVER) for p in range(4) for q in range(4)]
                else:
                    choices = solve(turns, ends)[1]
                    table = [walk(choices, len(turns), p)[1] for p in range(4)]
                yield pa.RecordBatch.from_arrays([pa.array([conv], types[0]), pa.array([piece], pa.int64()), pa.array([table], pa.list_(pa.int64()))], ["conv_id", "piece", "table"])

        return {(r["conv_id"], r["piece"]): r["table"] for r in dealt.mapInArrow(run, f"conv_id {kind}, piece long, table array<long>").collect()}  # a row for each border of blocks

    prices = tables({(c.conv_id, k): ENDS for c in long for k in range(len(c.parts))}, "prices")
    ends = {}
    for c in long:
        after = ENDS
        for k in range(len(c.parts) - 1, -1, -1):
            ends[c.conv_id, k] = after
            table = prices[c.conv_id, k]
            after = [min(min(table[4 * p + q] + after[q] for q in range(4)), NEVER) for p in range(4)]
    exits = tables(ends, "exits")
    out = {}
    for c in long:
        role = START
        for k in range(len(c.parts)):
            out[c.conv_id, k] = (role, ends[c.conv_id, k])
            role = exits[c.conv_id, k][role]
    return out


def summary(rows: DataFrame) -> DataFrame:
    """One row a conversation from edits(): gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Read in order, holding nothing but the audit; a conversation without rows has none here.
    """
    kinds = dict(rows.dtypes)
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]

    def run(batches):
        import pyarrow as pa

        key, s, kept = None, None, None

        def closed(rows_out):
            types = (kept, *[pa.int64()] * 6, pa.string(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows_out), types)], names)

        for batch in batches:
            kept, out = batch.schema.field("conv_id").type, []
            for conv, turn, edit, role, text, was, fault in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "edit", "role", "text", "was", "fault"))):
                if s is None or conv != key:
                    if s:
                        out.append(s.row(key))
                    key, s = conv, _Summary()
                s.add(turn, edit, role, text, was, fault)
            if out:
                yield closed(out)
        if s:
            yield closed([s.row(key)])

    dealt = rows.repartition(shuffle_width(rows.sparkSession), "conv_id").sortWithinPartitions("conv_id", "piece", "seq")
    return dealt.mapInArrow(run, f"conv_id {kinds['conv_id']}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")


class _Summary:
    """Running figures of one conversation whose edits come in order."""

    def __init__(self):
        self.audit, self.sha, self.some = [], hashlib.sha256(), False
        self.count = {BLANK: 0, DUPLICATE: 0, SHORT: 0}
        self.first = self.last = self.before = None
        self.distinct = self.illegal = self.cost = 0

    def add(self, turn, edit, role, text, was, fault) -> None:
        self.audit.append(edit)
        self.cost += {"K": 0, "R": REROLE, "D": DELETE, "I": INSERT}[edit]
        if fault:
            self.count[fault] += 1
            self.cost += TRUNCATED if fault == SHORT and edit != "D" else 0
        if edit != "I":
            pair = (self.before or "") + was[:1]
            self.illegal += self.before is not None and pair not in ("su", "ua", "au")
            self.before = was[:1]
            if turn is not None:
                self.distinct += turn != self.last
                self.first, self.last = turn if self.first is None else self.first, turn
        if edit != "D":
            self.sha.update(f"{chr(10) if self.some else ''}{role}:{text}".encode())
            self.some = True

    def row(self, key) -> tuple:
        gaps = self.last - self.first + 1 - self.distinct if self.distinct else 0
        return (key, gaps, *self.count.values(), self.illegal, self.cost, "".join(self.audit), self.sha.hexdigest())


def repair(turns: DataFrame, all_ids: DataFrame | None = None, most: int = 1 << 24) -> DataFrame:
    """summary() of edits() for each conversation; ids (conv_id) of all_ids without any rows get zeros, an empty audit and the hash of nothing."""
    out = summary(edits(turns, most))
    if all_ids is None:
        return out
    ids = all_ids.select(F.col("conv_id").alias("_id")).distinct()
    joined = ids.join(out, ids["_id"].eqNullSafe(out["conv_id"]), "left")
    numbers = {c: F.coalesce(c, F.lit(0)) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    return joined.select(F.col("_id").alias("conv_id"), *(v.alias(k) for k, v in numbers.items()), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))


def damaged(turns: DataFrame, at: Column | None = None) -> DataFrame:
    """Rows with faults put in, told by a number from 0 to 19 of each: 0 drops it, 1 empties the text, 2 takes its sentence ends, 3 repeats it, 4 makes it the user's.

    The number is the crc32 of "conv_id:turn" modulo 20. Nulls in any of the four columns count as one space.
    """
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    rows = turns.select("conv_id", "turn", *(F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")), key.alias("_key"))
    rows = rows.withColumn("_k", at if at is not None else crc32_mod("_key", 20)).where("_k <> 0")
    text = F.when(F.col("_k") == 1, "").when(F.col("_k") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.withColumns({"text": text, "role": F.when(F.col("_k") == 4, "user").otherwise(F.col("role"))})
    copies = F.explode(F.when(F.col("_k") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return rows.select("conv_id", "turn", "role", "text", copies.alias("_copy")).drop("_copy")
