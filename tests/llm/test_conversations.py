"""Conversation repair against an enumeration of all edit sequences."""

import hashlib
import os
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from sunledger.llm import conversations, queries

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def damage(rows):
    """conversation -> its rows after damage, by turn, as (turn, role, text)."""
    out = {}
    for conv, turn, role, text in rows:
        key = ":".join(" " if v is None else str(v) for v in (conv, turn))
        kind = zlib.crc32(key.encode()) % 20
        role, text = (" " if v is None else v for v in (role, text))
        own = out.setdefault(conv, [])
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        own += [(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    order = {conv: sorted(own, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
             for conv, own in out.items()}
    return order


def fault_of(rows, at):
    _, role, text = rows[at]
    bare = text.strip(" \t\n\x0b\x0c\r")
    if not bare:
        return "blank"
    if any(r[1:] == (role, text) for r in rows[:at]):
        return "duplicate"
    return "" if bare[-1] in ".!?" else "truncated"


def every_repair(rows, faults, limit):
    """All (cost, audit, turns) up to a cost, with at most two turns inserted in one place."""
    def go(at, inserted, cost, audit, turns):
        if cost > limit:
            return
        if inserted < 2:
            for role in ("user", "assistant"):
                yield from go(at, inserted + 1, cost + 3, audit + "I", [*turns, f"{role}:"])
        if at == len(rows):
            if re.fullmatch("(s?(ua)+)?", "".join((t.split(":")[0] or "?")[0] for t in turns)):
                yield cost, audit, turns
            return
        _, role, text = rows[at]
        yield from go(at + 1, 0, cost + 4, audit + "D", turns)
        if faults[at] in ("", "truncated"):
            more = 3 if faults[at] else 0
            yield from go(at + 1, 0, cost + more, audit + "K", [*turns, f"{role}:{text}"])
            for new in ("user", "assistant"):
                yield from go(at + 1, 0, cost + more + 3, audit + "R", [*turns, f"{new}:{text}"])
    yield from go(0, 0, 0, "", [])


def wanted(rows):
    out = []
    for conv, own in damage(rows).items():
        found = [fault_of(own, i) for i in range(len(own))]
        turns = {t for t, _, _ in own if t is not None}
        cost, audit, left = min(every_repair(own, found, 4 * len(own)), default=(0, "", []))
        out.append((conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0,
                    *(found.count(f) for f in ("blank", "duplicate", "truncated")),
                    sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:])),
                    cost, audit, hashlib.sha256("\n".join(left).encode()).hexdigest()))
    return sorted(map(repr, out))


def some_rows(conversations_, longest):
    rng, rows = random.Random(8), []
    for conv in range(conversations_):
        for turn in range(rng.randrange(longest + 1)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", "ué", None])
            text = rng.choice(["Yes.", "No!", "so", "so ", " ", None, "a.b\n", "Why? ", "Why? \t\n", "中"])
            rows.append((conv, rng.choice([turn, turn, turn, turn + 7, None]), role, text))
    return rows + [(None, 1, "user", "Hm."), (None, None, "assistant", "Yes."), (None, 1, "user", "Hm.")]


def got_of(frame, **settings):
    got = conversations.repair(conversations.damaged(frame), **settings)
    return sorted(repr(tuple(r)) for r in got.drop("repaired_turns").collect())


@pytest.mark.parametrize("settings", [{}, {"chunk_rows": 1}, {"chunk_rows": 2}])
def test_repair_against_every_edit_sequence(spark, settings):
    rows = some_rows(60, 4)
    frame = spark.createDataFrame(rows, SCHEMA).withColumns(
        {c: F.lit("clash") for c in ("copies", "digest", "part", "seq", "first", "audit", "cost", "of")})
    assert got_of(frame.repartition(3), **settings) == wanted(rows)


def test_long_conversation_in_chunks(spark):
    """A conversation that holds most rows: the chunks give what one search over it gives."""
    rng = random.Random(2)
    rows = [(7, t // 2, rng.choice(["user", "assistant", "system", "x"]),
             rng.choice(["One.", "Two.", f"Text {t}.", f"open {t}", ""])) for t in range(700)]
    rows += [(c, t, "user", "Hi.") for c in range(5) for t in range(3)]
    frame = spark.createDataFrame(rows, SCHEMA)
    own = damage(rows)[7]
    marks = [(r[1][:1], fault_of(own, i)) for i, r in enumerate(own)]
    cost, audit = conversations.lightest(marks)[conversations.START]
    left = conversations.repaired_turns(audit, conversations.START, [r[1] for r in own], [r[2] for r in own])
    assert re.fullmatch("(s?(ua)+)?", "".join(t[0] for t in left))
    for size in (4096, 50):
        row = conversations.repair(conversations.damaged(frame), chunk_rows=size).where("conv_id = 7").first()
        assert (row["cost"], row["audit"], row["repaired_turns"]) == (cost, audit, len(left))
        assert row["repaired_sha256"] == hashlib.sha256("\n".join(left).encode()).hexdigest()


def test_repair_of_nothing_and_of_one_long_text(spark):
    assert got_of(spark.createDataFrame([], SCHEMA)) == []
    rows = [(1, 1, "user", "word " * 600_000 + "."), (1, 2, "assistant", "Yes.")]
    assert got_of(spark.createDataFrame(rows, SCHEMA)) == wanted(rows)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="given tables are absent")
def test_query_on_the_given_table(spark):
    frame = spark.read.parquet(f"{FOLDER}/conversations.parquet")
    rows = [tuple(r) for r in frame.select("conv_id", "turn", "role", "text").collect()]
    got = queries.QUERIES["op11_conversation_repair"](spark, FOLDER).collect()
    short = {c for c, own in damage(rows).items() if len(own) <= 5}
    assert sorted(repr(tuple(r)) for r in got if r["conv_id"] in short) \
        == wanted([r for r in rows if r[0] in short])
    assert len(got) == len({r[0] for r in rows})
