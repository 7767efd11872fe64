"""Chat formatting by prefix-target expansion: every assistant turn becomes an example of its own."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import materialize, shuffle_width
from corvane.llm.turns import crossings, in_pieces, placed

#: What opens and closes a turn of each role; any other role is named between ROLE marks and closed as a reply is.
MARKS = {"user": ("[INST] ", " [/INST]"), "system": ("<<SYS>>\n", "\n<</SYS>>"), "assistant": (" ", "</s>")}
ROLE_OPEN, ROLE_CLOSE, REPLY_CLOSE = "[ROLE]", "[/ROLE]", "</s>"
#: Strings that steer a model, in texts with a backslash behind their first character.
CONTROL = ["[INST]", "[/INST]", "<s>", "</s>", "<<SYS>>", "<</SYS>>", ROLE_OPEN, ROLE_CLOSE]
_HEADS = r"([\[<])(?=" + "|".join(re.escape(c[1:]) for c in CONTROL) + ")"


def escaped(text: Column) -> Column:
    """Backslashes doubled, and one put into each control string; unescaped() gives the text back."""
    return F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), _HEADS, r"$1\\")


def unescaped(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S) if "\\" in text else text


def parse(text: str, at: int = 0) -> Iterator[tuple[str, str]]:
    """(role, text) of the turns in formatted text, from a place where one begins."""
    while at < len(text):
        role = next((r for r, (opening, _) in MARKS.items() if text.startswith(opening, at)), None)
        if role is None:
            end = text.index(ROLE_CLOSE, at)
            role, start, closing = unescaped(text[at + len(ROLE_OPEN) : end]), end + len(ROLE_CLOSE), REPLY_CLOSE
        else:
            opening, closing = MARKS[role]
            start = at + len(opening)
        end = text.index(closing, start)
        yield role, unescaped(text[start:end])
        at = end + len(closing)


def rendered(turns: DataFrame) -> DataFrame:
    """turns with segment (the marked turn), lead (characters before its text) and body (characters of the escaped text)."""
    role, text = F.coalesce("role", F.lit("")), escaped(F.coalesce("text", F.lit("")))
    opening, closing = F.concat(F.lit(ROLE_OPEN), escaped(role), F.lit(ROLE_CLOSE)), F.lit(REPLY_CLOSE)
    for name, (a, b) in MARKS.items():
        opening, closing = F.when(role == name, F.lit(a)).otherwise(opening), F.when(role == name, F.lit(b)).otherwise(closing)
    out = turns.withColumns({"_open": opening, "_text": text, "_close": closing})
    return out.withColumns({"segment": F.concat("_open", "_text", "_close"), "lead": F.length("_open"), "body": F.length("_text"), "is_target": role == "assistant"}).drop("_open", "_text", "_close")


def examples(turns: DataFrame, inline: int = 1 << 18, to: str | None = None) -> DataFrame:
    """One row for each assistant turn of (conv_id, turn, role, text), with all turns before it as context; written and read back.

    conv_id, turns (how many of the conversation the example covers), text, text_start, new_start, loss_start, loss_end, closes.
    Only text[loss_start:loss_end], the reply, is to be trained on. text[new_start:] is what no example before it shows.
    Turns after the last reply, and conversations without one, make an example whose loss is empty, so that nothing is lost.

    Up to `inline` characters of context stand in each example, so text_start is 0. In longer conversations the context is
    shared: text begins at text_start of the conversation, and what comes before are the texts of its earlier rows where
    closes is true, one after the other (see whole()). Output and memory of a task thus stay in proportion to the turns, and a
    conversation of any length is worked on in several tasks.

    Null roles and texts count as empty; null turns come first, rows of one turn by role and text, repeats are turns of
    their own. A null conv_id is a conversation too. Empty tables give no rows; other columns are left aside.
    """
    spark, kind = turns.sparkSession, dict(turns.dtypes)["conv_id"]
    rows = rendered(placed(turns)).select("conv_id", "block", "place", "segment", "lead", "body", "is_target")
    cuts = []
    for c in crossings(rows, chars=F.length("segment"), turns=F.lit(1)):
        chars = count = 0
        for k, part in enumerate(c.parts):
            long = c.total("chars") > inline
            cuts.append((c.conv_id, part["block"], k if long else 0, chars if long else 0, count if long else 0))
            chars, count = chars + part["chars"], count + part["turns"]
    rows = in_pieces(rows, cuts, "chars_before long, turns_before long", {"chars_before": F.lit(0).cast("long"), "turns_before": F.lit(0).cast("long")})
    fields = ["conv_id", "turns", "text", "text_start", "new_start", "loss_start", "loss_end", "closes"]

    def run(batches):
        import pyarrow as pa

        out: list[tuple] = []
        held = 0
        key = state = None

        def emit(loss: tuple[int, int] | None) -> int:
            """An example of all that stands in the state; its size."""
            text = "".join(state["parts"])
            state["parts"] = [text]
            closes = loss is None or len(text) > inline
            start, end = loss or (len(text), len(text))
            out.append((key[0], state["turns"], text, state["base"], state["shown"] - state["base"], start, end, closes))
            state["shown"] = state["pos"]
            if closes:
                state["base"], state["parts"] = state["pos"], []
            return len(text)

        def packed():
            names = zip(*out)
            return pa.RecordBatch.from_arrays([pa.array(list(v), t) for v, t in zip(names, kinds)], fields)

        kinds = []
        for batch in batches:
            kinds = [batch.schema.field("conv_id").type, pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
            for conv, piece, segment, lead, body, target, chars, count in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "piece", "segment", "lead", "body", "is_target", "chars_before", "turns_before"))):
                if key != (conv, piece):
                    if state and state["shown"] < state["pos"]:
                        held += emit(None)
                    key, state = (conv, piece), {"parts": [], "pos": chars, "base": chars, "shown": chars, "turns": count}
                state["parts"].append(segment)
                state["pos"] += len(segment)
                state["turns"] += 1
                if target:
                    end = state["pos"] - state["base"] - len(segment) + lead
                    held += emit((end, end + body))
                if held > 8 << 20:
                    yield packed()
                    out, held = [], 0
        if state and state["shown"] < state["pos"]:
            emit(None)
        if out:
            yield packed()

    made = rows.mapInArrow(run, f"conv_id {kind}, turns long, text string, text_start long, new_start long, loss_start long, loss_end long, closes boolean")
    return materialize(made, "chat", to=to, compression="zstd")


def whole(rows: DataFrame) -> DataFrame:
    """examples() with the whole context in every text, however long (conv_id, turns, text, loss_start, loss_end)."""
    shared = rows.where("text_start > 0").select("conv_id", "turns", "text", "text_start", "loss_start", "loss_end")
    earlier = rows.where("closes").select(F.col("conv_id").alias("_conv"), F.col("text_start").alias("_start"), F.col("text").alias("_text"))
    met = shared.join(earlier, shared["conv_id"].eqNullSafe(earlier["_conv"]) & (F.col("_start") < F.col("text_start")))
    before = met.groupBy("conv_id", "turns", "text_start", "loss_start", "loss_end", "text").agg(F.array_sort(F.collect_list(F.struct("_start", "_text"))).alias("_parts"))
    joined = before.select("conv_id", "turns", F.concat(F.array_join(F.transform("_parts", lambda p: p["_text"]), ""), "text").alias("text"), (F.col("loss_start") + F.col("text_start")).alias("loss_start"), (F.col("loss_end") + F.col("text_start")).alias("loss_end"))
    return rows.where("text_start = 0").select("conv_id", "turns", "text", "loss_start", "loss_end").unionByName(joined)


def read_back(rows: DataFrame) -> DataFrame:
    """One row a conversation, from examples() alone: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_examples.

    The turns are parsed from what each example adds; formatted_chars counts all examples with their contexts.
    """
    kind = dict(rows.dtypes)["conv_id"]

    def parts(batches):
        import pyarrow as pa

        for batch in batches:
            got = []
            for text, at, start, end in zip(*(batch.column(c).to_pylist() for c in ("text", "new_start", "loss_start", "loss_end"))):
                found, loss = list(parse(text, at)), unescaped(text[start:end])
                got.append((len(found), "".join(f"{r}\n{t}\n" for r, t in found).encode(), len(loss), loss.encode(), len(text)))
            cols = list(zip(*got)) or [()] * 5
            arrays = [pa.array(list(c), t) for c, t in zip(cols, (pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("turns"), batch.column("text_start"), *arrays], ["conv_id", "turns", "text_start", "n", "said", "loss_chars", "loss", "chars"])

    def digests(batches):
        import pyarrow as pa

        key = state = kept = None
        for batch in batches:
            out = []
            kept = batch.schema.field("conv_id").type
            for conv, start, n, said, chars, loss, size in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "text_start", "n", "said", "loss_chars", "loss", "chars"))):
                if state is None or conv != key:
                    if state:
                        out.append(_closed(key, state))
                    key, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                state[0] += n
                state[1].update(said)
                state[2] += chars
                state[3].update(loss)
                state[4] += start + size
                state[5] += 1
            if out:
                yield _arrow(pa, out, kept)
        if state:
            yield _arrow(pa, [_closed(key, state)], kept)

    each = rows.mapInArrow(parts, f"conv_id {kind}, turns long, text_start long, n long, said binary, loss_chars long, loss binary, chars long")
    dealt = each.repartition(shuffle_width(rows.sparkSession), "conv_id").sortWithinPartitions("conv_id", "turns")
    return dealt.mapInArrow(digests, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_examples long")


def _closed(key, state: list) -> tuple:
    return (key, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4], state[5])


def _arrow(pa, out: list[tuple], kept):
    kinds = (kept, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(list(v), t) for v, t in zip(zip(*out), kinds)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_examples"])
