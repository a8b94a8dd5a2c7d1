"""Repair of the structure of conversations by lightest derivations.

A conversation is well formed when its role initials read ``(s?(ua)+)?``: nothing, or at most one
system turn and then user and assistant in turn. Rows are kept, given another role or deleted, and
empty turns are inserted, at the least total cost; of equal costs the audit (the initials K, R, D
and I of the edits in order) that is least in ASCII wins.

The search is Knuth's agenda over weighted deductions. An item ``[i, q]`` says that the rows from
``i`` on can be repaired into what the grammar still accepts after state ``q``; its value is (cost,
rows covered, audit). A deduction joins an edit of row ``i - 1`` with an item at ``i``, or an insertion
with an item, and puts its letter in front of the audit. Every deduction is monotone in the values
of its premises and never below them (a kept row costs nothing but covers one row more), so the
first value popped for an item is final, and the search stops when the goal is popped. Candidates of
one item start with different letters, so two audits of an item are compared by their first letter.

Scale: rows are sorted in ranges over all conversations, never gathered by conversation. A
conversation inside one range is repaired as it streams by. One that crosses ranges, or has more
than ``chunk_rows`` rows, is cut: every chunk gives the lightest audit from each grammar state to each
other one, the chunks of a conversation are combined by the same agenda, and the repaired text is
hashed as it streams by in order (a digest of a whole text is sequential by nature; no more than one
chunk is in memory). Duplicates are found by a grouping of digests, not by looking back.

Defined results: a null role or text is one space, as are a null ``conv_id`` or ``turn`` in the key
of the damage; a null ``conv_id`` is a conversation of its own; null turns come first; rows of one turn are
ordered by role, then text, and repeated rows are neighbours (all but the first are duplicates). A role
without characters has no initial: it is never kept. Other columns are ignored whatever their name; an empty table
gives no rows. Texts of any length work: rows travel in batches bounded in bytes.
"""

from __future__ import annotations

import hashlib
from heapq import heappop, heappush
from itertools import chain, zip_longest

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import kept, record_batch, table

BLANK, DUPLICATE, TRUNCATED, SOUND = "blank", "duplicate", "truncated", ""
COST = {"K": 0, "R": 3, "D": 4, "I": 3}
UNMENDED = 3  # for a truncated row that stays
ROLES = {"u": "user", "a": "assistant"}
START, SYSTEM, USER, ASSISTANT = range(4)
STATES, ACCEPTED = range(4), (START, ASSISTANT)
#: For a state that a turn leads to: the turn's initial and the states that it may follow.
BEFORE = {START: (), SYSTEM: (("s", START),), ASSISTANT: (("a", USER),),
          USER: (("u", START), ("u", SYSTEM), ("u", ASSISTANT))}
AFTER = {(start, initial): end for end, steps in BEFORE.items() for initial, start in steps}


def lightest(rows: list[tuple[str, str]], ends=ACCEPTED, goals=(START,)) -> dict[int, tuple[int, str]]:
    """Lightest (cost, audit) that leads from each goal state over all rows to one of ``ends``.

    ``rows`` are pairs of role initial and fault.
    """
    agenda, final, open_goals, made = [], set(), set(goals), 0
    found: dict[int, tuple[int, str]] = {}

    def offer(cost, covered, letter, state, rest):
        nonlocal made
        if (covered, state) not in final:
            made += 1
            heappush(agenda, (cost, covered, letter, made, state, rest))

    for state in ends:
        offer(0, 0, "", state, None)
    while agenda and open_goals:
        cost, covered, letter, _, state, rest = heappop(agenda)
        if (covered, state) in final:
            continue
        final.add((covered, state))
        audit = (letter, rest)
        if covered == len(rows) and state in open_goals:
            open_goals.discard(state)
            letters, link = [], audit
            while link is not None:
                letters.append(link[0])
                link = link[1]
            found[state] = (cost, "".join(letters))
        for initial, start in BEFORE[state]:
            if initial in ROLES:
                offer(cost + COST["I"], covered, "I", start, audit)
        if covered == len(rows):
            continue
        own, fault = rows[len(rows) - covered - 1]
        offer(cost + COST["D"], covered + 1, "D", state, audit)
        if fault in (BLANK, DUPLICATE):
            continue
        stays = cost + (UNMENDED if fault == TRUNCATED else 0)
        for initial, start in BEFORE[state]:
            if initial == own:
                offer(stays + COST["K"], covered + 1, "K", start, audit)
            elif initial in ROLES:
                offer(stays + COST["R"], covered + 1, "R", start, audit)
    return found


def crossings(rows: list[tuple[str, str]]) -> list[tuple[int, int, int, str]]:
    """Lightest audits of a chunk from every state to every state: from, to, cost, audit."""
    return [(start, end, *best) for end in STATES
            for start, best in sorted(lightest(rows, (end,), STATES).items())]


def _less(one, other) -> bool:
    """Whether the audit linked from ``one`` is less; both are (audit, link) chains."""
    def letters(link):
        while link is not None:
            yield link[0]
            link = link[1]

    pairs = zip_longest(chain.from_iterable(letters(one)), chain.from_iterable(letters(other)), fillvalue="")
    return next((a < b for a, b in pairs if a != b), False)


def combined(chunks: list[list[tuple[int, int, int, str]]]) -> tuple[int, list[tuple[int, str]]]:
    """Total cost, and for every chunk the state it starts from and its audit.

    Items ``[chunk, state]`` are finalised from the last chunk on: every deduction covers one
    chunk more, so that is the order in which an agenda by (chunks covered, cost, audit) pops.
    """
    best = {state: (0, None) for state in ACCEPTED}
    for steps in reversed(chunks):
        now: dict[int, tuple] = {}
        for start, end, cost, audit in steps:
            if end in best:
                offered = (cost + best[end][0], (audit, best[end][1], start))
                held = now.get(start)
                if held is None or offered[0] < held[0] or offered[0] == held[0] and _less(
                        offered[1], held[1]):
                    now[start] = offered
        best = now
    total, link = best[START]
    path = []
    while link is not None:
        path.append((link[2], link[0]))
        link = link[1]
    return total, path


def repaired_turns(audit: str, state: int, roles: list[str], texts: list[str]) -> list[str]:
    """``role:text`` of the turns that an audit leaves, read from a grammar state on."""
    out, at = [], 0
    for letter in audit:
        if letter == "D":
            at += 1
            continue
        initial = roles[at][:1] if letter == "K" else "a" if state == USER else "u"
        state = AFTER[state, initial]
        if letter == "K":
            out.append(f"{roles[at]}:{texts[at]}")
        else:
            out.append(f"{ROLES[initial]}:{texts[at] if letter == 'R' else ''}")
        at += letter != "I"
    return out


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows with planted faults: ``conv_id, turn, role, text, copies``; dropped rows have 0 copies."""
    space = F.lit(" ")
    key = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"),
                           F.coalesce(F.col("turn").cast("string"), space))) % 20
    role, text = F.coalesce("role", space), F.coalesce("text", space)
    return conversations.select(
        "conv_id", F.col("turn").cast("bigint").alias("turn"),
        F.when(key == 4, F.lit("user")).otherwise(role).alias("role"),
        F.when(key.isin(0, 1), F.lit("")).when(key == 2, F.regexp_replace(text, "[.!?]", ""))
        .otherwise(text).alias("text"),
        F.when(key == 0, 0).when(key == 3, 2).otherwise(1).alias("copies"))


def faults(rows: DataFrame) -> DataFrame:
    """Rows with ``blank``, ``open`` (the last character ends no sentence) and ``again`` (role and
    text stand in an earlier turn of the conversation)."""
    marked = rows.withColumns({
        "blank": ~F.col("text").rlike(r"[^\x20\x09-\x0D]"),
        "open": ~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"),
        "digest": F.when(F.col("copies") > 0, F.sha2("text", 256))})
    place = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    repeated = kept(
        marked.where("copies > 0 AND NOT blank").groupBy("conv_id", "role", "digest")
        .agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last")
        .select(F.col("conv_id").alias("of"), F.col("role").alias("by"),
                F.col("digest").alias("what"), "first"), "repeated")
    return marked.join(repeated, F.col("conv_id").eqNullSafe(F.col("of"))
                       & (F.col("role") == F.col("by")) & (F.col("digest") == F.col("what")), "left") \
        .select("conv_id", "turn", "role", "text", "copies", "blank", "open",
                F.coalesce(place > F.col("first"), F.lit(False)).alias("again"))


_COUNTS = ("rows", "turns", "blank", "duplicate", "truncated", "illegal")
_STEP = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])
_LEGAL = {"su", "ua", "au"}


class _Chunk:
    """Rows of one conversation that follow each other."""

    def __init__(self):
        self.roles, self.texts, self.faults, self.size = [], [], [], 0
        self.count = dict.fromkeys(_COUNTS, 0)
        self.low = self.high = None

    def add(self, turn, role, text, fault):
        if self.roles:
            self.count["illegal"] += self.roles[-1][:1] + role[:1] not in _LEGAL
        if turn is not None and turn != self.high:
            self.count["turns"] += 1
            self.low = turn if self.low is None else self.low
            self.high = turn
        self.count["rows"] += 1
        if fault:
            self.count[fault] += 1
        self.roles.append(role)
        self.texts.append(text)
        self.faults.append(fault)
        self.size += len(text)

    def marks(self):
        return [(role[:1], fault) for role, fault in zip(self.roles, self.faults)]


def repair(rows: DataFrame, chunk_rows: int = 4096, chunk_chars: int = 4 << 20) -> DataFrame:
    """One row per conversation: ``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit,
    repaired_sha256`` and ``repaired_turns`` (their number).

    ``rows`` has ``conv_id, turn, role, text, copies``; a row of 0 copies only makes its
    conversation appear.
    """
    kind = rows.schema["conv_id"].dataType.simpleString()
    order = ["conv_id", "turn", "role", "text"]
    lined = faults(rows).repartitionByRange(*order).sortWithinPartitions(*order)

    def stream(batches):
        part, seq = TaskContext.get().partitionId(), 0
        out: list[dict] = []
        ids, conv, chunk, whole, before = None, (), None, False, ()

        def close(finished):
            """The chunk as a row: a result, or a piece of a longer conversation."""
            nonlocal seq
            row = {"conv_id": conv[0], "part": part, "seq": seq, "low": chunk.low, "high": chunk.high,
                   **chunk.count, "closed": finished, "first": chunk.roles[0][:1] if chunk.roles else "",
                   "final": chunk.roles[-1][:1] if chunk.roles else ""}
            seq += 1
            if finished:
                row["cost"], row["audit"] = lightest(chunk.marks())[START]
                left = repaired_turns(row["audit"], START, chunk.roles, chunk.texts)
                row["left"] = len(left)
                row["sha"] = hashlib.sha256("\n".join(left).encode()).hexdigest()
            else:
                row.update(roles=chunk.roles, texts=chunk.texts, steps=[
                    dict(zip(("start", "end", "cost", "audit"), s)) for s in crossings(chunk.marks())])
            out.append(row)

        def flushed():
            batch = pa.RecordBatch.from_pylist(out, schema=pa.schema(
                [("conv_id", ids), *_PIECES]))
            out.clear()
            return batch

        for batch in batches:
            ids = batch.schema.field("conv_id").type
            for cid, turn, role, text, copies, blank, unended, again in zip(
                    *[batch.column(i).to_pylist() for i in range(8)]):
                if conv != (cid,):
                    if conv:
                        close(whole)
                    # the first conversation of a range may have begun in the range before
                    whole, before = bool(conv), ()
                    conv, chunk = (cid,), _Chunk()
                for _ in range(copies):
                    again = again or before == (turn, role, text)
                    before = (turn, role, text)
                    if len(chunk.roles) >= chunk_rows or chunk.size > chunk_chars:
                        close(False)
                        chunk, whole = _Chunk(), False
                    chunk.add(turn, role, text, BLANK if blank else DUPLICATE if again
                              else TRUNCATED if unended else SOUND)
            if out:
                yield flushed()
        if conv:
            close(False)  # the last one may go on in the next range
            yield flushed()

    pieces = kept(lined.mapInArrow(
        stream, f"conv_id {kind}, part int, seq int, low bigint, high bigint, "
        + ", ".join(f"{c} bigint" for c in _COUNTS) + ", closed boolean, first string, final string, "
        "cost bigint, audit string, left bigint, sha string, roles array<string>, texts array<string>, "
        "steps array<struct<start: int, end: int, cost: bigint, audit: string>>"), "pieces")
    gaps = F.when(F.col("turns") > 0, F.col("high") - F.col("low") + 1 - F.col("turns")).otherwise(0)
    result = ["conv_id", gaps.cast("bigint").alias("gaps"), "blank", "duplicate", "truncated", "illegal",
              "cost", "audit", F.col("sha").alias("repaired_sha256"), F.col("left").alias("repaired_turns")]
    return pieces.where("closed").select(*result).union(_joined(pieces.where("NOT closed"), kind)
                                                        .select(*result))


_PIECES = [("part", pa.int32()), ("seq", pa.int32()), ("low", pa.int64()), ("high", pa.int64()),
           *[(c, pa.int64()) for c in _COUNTS], ("closed", pa.bool_()), ("first", pa.string()),
           ("final", pa.string()), ("cost", pa.int64()), ("audit", pa.string()), ("left", pa.int64()),
           ("sha", pa.string()), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string())),
           ("steps", pa.list_(_STEP))]


def _joined(pieces: DataFrame, kind: str) -> DataFrame:
    """Conversations that were cut, from their chunks."""
    def choose(table):
        """The state and the audit of every chunk, and the sums over the conversation."""
        rows = sorted(table.to_pylist(), key=lambda r: (r["part"], r["seq"]))
        total, path = combined([[(s["start"], s["end"], s["cost"], s["audit"]) for s in r["steps"]]
                                for r in rows])
        sums = {c: sum(r[c] for r in rows) for c in _COUNTS}
        end, last = "", None
        for r in rows:
            if r["rows"]:
                sums["illegal"] += bool(end) and end[0] + r["first"] not in _LEGAL
                end = (r["final"],)
            if r["turns"]:
                sums["turns"] -= r["low"] == last
                last = r["high"]
        known = [r for r in rows if r["turns"]]
        sums.update(low=known[0]["low"] if known else None, high=known[-1]["high"] if known else None)
        out = [{"of": r["conv_id"], "in_part": r["part"], "in_seq": r["seq"], "state": state, "piece": audit,
                "total": total, **{f"all_{k}": v for k, v in sums.items() if k != "rows"}}
               for r, (state, audit) in zip(rows, path)]
        return pa.Table.from_pylist(out, schema=pa.schema(
            [("of", table.schema.field("conv_id").type), ("in_part", pa.int32()), ("in_seq", pa.int32()),
             ("state", pa.int32()), ("piece", pa.string()), ("total", pa.int64()),
             *[(c, pa.int64()) for c in chosen]]))

    chosen = [f"all_{c}" for c in (*_COUNTS[1:], "low", "high")]
    choices = pieces.drop("roles", "texts", "cost", "audit", "left", "sha", "closed") \
        .groupBy("conv_id").applyInArrow(
        choose, f"of {kind}, in_part int, in_seq int, state int, piece string, total bigint, "
        + ", ".join(f"{c} bigint" for c in chosen))
    lined = (pieces.select("conv_id", "part", "seq", "roles", "texts")
             .join(choices, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("part") == F.col("in_part"))
                   & (F.col("seq") == F.col("in_seq")))
             .drop("of", "in_part", "in_seq").repartition("conv_id")
             .sortWithinPartitions("conv_id", "part", "seq"))

    def hashed(batches):
        ids, conv, row, sha, audit = None, (), None, None, []

        def result():
            return pa.RecordBatch.from_pylist(
                [{**row, "audit": "".join(audit), "sha": sha.hexdigest()}], schema=pa.schema(
                    [("conv_id", ids), ("cost", pa.int64()), ("left", pa.int64()), ("audit", pa.string()),
                     ("sha", pa.string()), *[(c.removeprefix("all_"), pa.int64()) for c in chosen]]))

        for batch in batches:
            ids = batch.schema.field("conv_id").type
            for at in range(batch.num_rows):
                piece = batch.slice(at, 1).to_pylist()[0]
                if conv != (piece["conv_id"],):
                    if conv:
                        yield result()
                    conv, sha, audit = (piece["conv_id"],), hashlib.sha256(), []
                    row = {"conv_id": conv[0], "cost": piece["total"], "left": 0,
                           **{c.removeprefix("all_"): piece[c] for c in chosen}}
                turns = repaired_turns(piece["piece"], piece["state"], piece["roles"], piece["texts"])
                if turns:
                    sha.update(("\n" if row["left"] else "").encode() + "\n".join(turns).encode())
                    row["left"] += len(turns)
                audit.append(piece["piece"])
        if conv:
            yield result()

    return lined.mapInArrow(hashed, f"conv_id {kind}, cost bigint, left bigint, audit string, sha string, "
                            + ", ".join(f"{c.removeprefix('all_')} bigint" for c in chosen))


def op11_conversation_repair(spark, sf_dir):
    return repair(damaged(table(spark, sf_dir, "conversations"))).drop("repaired_turns")
