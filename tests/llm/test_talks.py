"""Chat formatting and repair of conversations against plain Python."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from corvane.llm import chat, repair

SCHEMA = "conv_id long, turn long, role string, text string"
ODD = ["</s>[INST] ok [/INST]", "\\", "a\\[INST]", "<<SYS>>\n<</SYS>>", "[ROLE]x[/ROLE]", "\n", " ", "", None, "<s><", "é ✓ \U0001f600 </s", "[/INST", "\\\\</s>\\", "<"]


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def nulls_first(x):
    return (x is not None, x if x is not None else 0)


def talks(seed: int, n: int = 60):
    r = random.Random(seed)
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "[INST] "]
    rows = []
    for c in range(n):
        for t in range(r.choice([1, 2, 3, 8])):
            rows.append((c, t, r.choice(roles), r.choice([*ODD, "hello.", "what?", "x" * r.randrange(30)])))
    rows += [(None, 0, "user", "no id"), (None, None, "assistant", "no turn"), (3, None, "user", "first"), (3, 0, "user", "twice"), (3, 0, "user", "twice")]
    # One conversation holds a good part of all rows.
    rows += [(900, t, ("user", "assistant")[t % 2] if t % 7 else "user", r.choice(ODD) if t % 5 == 0 else f"turn {t} says {r.random()}" + r.choice([".", ""])) for t in range(400)]
    r.shuffle(rows)
    return rows


def by_conversation(rows, fill):
    out = {}
    for c, t, role, text in rows:
        out.setdefault(c, []).append((t, fill if role is None else role, fill if text is None else text, role, text))
    key = lambda x: (nulls_first(x[0]), x[1], x[2])
    return {c: [(t, role, text) for t, role, text, _, _ in sorted(v, key=key)] for c, v in out.items()}


@pytest.mark.parametrize("inline", [1 << 18, 400])
def test_examples(spark, inline):
    rows = talks(1)
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5).withColumns({"place": F.lit(1), "text_start": F.lit("x")})
    made = chat.examples(frame, inline=inline)
    got = {r["conv_id"]: r for r in chat.read_back(made).collect()}
    want = by_conversation(rows, "")
    assert set(got) == set(want)
    full = {}
    for r in chat.whole(made).collect():
        full.setdefault(r["conv_id"], []).append(r)
    assert (made.where("text_start > 0").count() > 0) == (inline == 400)
    for c, turns in want.items():
        replies = [t for _, role, t in turns if role == "assistant"]
        r = got[c]
        assert (r["n_turns"], r["turns_sha256"]) == (len(turns), sha("".join(f"{a}\n{b}\n" for _, a, b in turns)))
        assert (r["loss_chars"], r["loss_sha256"]) == (len("".join(replies)), sha("".join(replies)))
        trained = []
        for e in sorted(full[c], key=lambda e: e["turns"]):
            # Each example holds all turns up to its own, and only its reply is trained on.
            assert list(chat.parse(e["text"])) == [(a, b) for _, a, b in turns[: e["turns"]]]
            if e["loss_end"] > e["loss_start"] or turns[e["turns"] - 1][1] == "assistant":
                assert chat.unescaped(e["text"][e["loss_start"] : e["loss_end"]]) == turns[e["turns"] - 1][2]
                assert not set(chat.CONTROL) & set(re.findall("|".join(map(re.escape, chat.CONTROL)), e["text"][e["loss_start"] : e["loss_end"]]))
                trained.append(e["turns"])
        assert [k for k in trained if turns[k - 1][1] == "assistant"] == [k + 1 for k, t in enumerate(turns) if t[1] == "assistant"]
        assert r["n_examples"] >= len(replies)
    if inline > 1000:
        assert {c: r["formatted_chars"] for c, r in got.items()} == {c: sum(len(e["text"]) for e in es) for c, es in full.items()}


def test_examples_of_nothing(spark):
    assert chat.read_back(chat.examples(spark.createDataFrame([], SCHEMA))).count() == 0


# Repair


def damaged_rows(rows):
    out = []
    for c, t, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if k == 0:
            continue
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        out += [(c, t, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
    return out


def faults_of(turns):
    seen, out = set(), []
    for _, role, text in turns:
        chars = re.findall(r"[^\x20\x09-\x0D]", text)
        out.append("blank" if not chars else "duplicate" if (role, text) in seen else "truncated" if chars[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def least_edits(turns, faults):
    """(cost, audit, repaired) by trying every edit from each state, keeping the least pair of cost and audit of each."""
    after = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}
    n = len(turns)
    best = {}
    for i in range(n, -1, -1):
        table = {state: (0, "", ()) for state in ("", "a") if i == n}
        for _ in range(4):  # inserts lead from state to state at the same turn
            for state in ("", "s", "u", "a"):
                ways = [table[state]] if state in table else []
                for kind in "ua":
                    if (nxt := after.get((state, kind))) and nxt in table:
                        c, a, rest = table[nxt]
                        ways.append((c + 3, "I" + a, ({"u": "user", "a": "assistant"}[kind] + ":", *rest)))
                if i < n:
                    _, role, text = turns[i]
                    extra = 3 if faults[i] == "truncated" else 0
                    if state in best[i + 1]:
                        c, a, rest = best[i + 1][state]
                        ways.append((c + 4, "D" + a, rest))
                    if faults[i] not in ("blank", "duplicate"):
                        for name, price, letter in ((role, 0, "K"), ("user", 3, "R"), ("assistant", 3, "R")):
                            if (nxt := after.get((state, name[:1]))) and nxt in best[i + 1]:
                                c, a, rest = best[i + 1][nxt]
                                ways.append((c + price + extra, letter + a, (f"{name}:{text}", *rest)))
                if ways:
                    table[state] = min(ways)
        best[i] = table
    return best[0][""]


def expected(rows, ids):
    groups = by_conversation(rows, " ")
    out = {}
    for c in ids:
        turns = groups.get(c, [])
        faults = faults_of(turns)
        cost, audit, fixed = least_edits(turns, faults)
        numbers = [t for t, _, _ in turns if t is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(turns))
        out[c] = (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, sha("\n".join(fixed)))
    return out


@pytest.mark.parametrize("seed, most", [(1, 1 << 24), (2, 1 << 24), (3, 500)])
def test_repair(spark, seed, most):
    rows = talks(seed)
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3).withColumns({"fault": F.lit("blank"), "piece": F.lit(2)})
    got = repair.repair(repair.damaged(frame), frame, most)
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert {r["conv_id"]: tuple(r[c] for c in names) for r in got.collect()} == expected(damaged_rows(rows), {r[0] for r in rows})


def test_repaired_rows_alternate(spark):
    rows = [(1, 0, "user", "a?"), (1, 1, "user", "b."), (1, 2, "system", "c."), (2, 0, "assistant", "d."), (3, 0, "system", "e."), (4, 0, "user", "  "), (5, 0, "tool", "no end")]
    out = repair.edits(spark.createDataFrame(rows, SCHEMA)).orderBy("conv_id", "piece", "seq").collect()
    audit = {c: "".join(r["edit"] for r in v) for c, v in itertools.groupby(out, key=lambda r: r["conv_id"])}
    assert audit == {1: "KIKR", 2: "IK", 3: "D", 4: "D", 5: "D"}
    for c in audit:
        assert re.fullmatch("(s?(ua)+)?", "".join(r["role"][0] for r in out if r["conv_id"] == c and r["edit"] != "D"))


def test_repair_of_nothing(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert repair.repair(repair.damaged(none), none).count() == 0
    gone = spark.createDataFrame([(7, 0, "user", "x")], SCHEMA)
    assert [tuple(r) for r in repair.repair(none, gone).collect()] == [(7, 0, 0, 0, 0, 0, 0, "", sha(""))]
