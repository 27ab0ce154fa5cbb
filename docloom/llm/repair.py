"""Conversation structure repair: the cheapest edits that make turns follow a grammar, by cost-to-go from the end."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import SPACES, materialise

#: What a conversation has said last: nothing, system, user, assistant. It may end at the first and the last.
START, SYSTEM, USER, ASSISTANT = range(4)
#: The state that an inserted or re-roled turn leads to, and the role that it gets.
NEXT = (USER, USER, ASSISTANT, USER)
ROLE = {USER: "user", ASSISTANT: "assistant"}
#: The state that a kept turn leads to, by state and initial of its role.
KEEP = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
LEGAL = {"su", "ua", "au"}
NONE, IS_BLANK, IS_DUPLICATE, IS_TRUNCATED = range(4)
FAR = 1 << 50
#: A segment of a conversation has about so many rows and bytes of text at most.
ROWS, BYTES = 4096, 1 << 20
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def fault_of(text: str) -> int:
    """What is wrong with a text by itself."""
    bare = text.strip(SPACES)
    return IS_BLANK if not bare else NONE if bare[-1] in ".!?" else IS_TRUNCATED


def closed(v: list[int]) -> list[int]:
    """Cost-to-go where turns may be inserted first."""
    return [min(v[s], INSERT + v[NEXT[s]], 2 * INSERT + v[NEXT[NEXT[s]]]) for s in range(4)]


END = closed([0, FAR, FAR, 0])


def costs_to_go(roles: list[str], faults: list[int], after: list[int]) -> list[list[int]]:
    """The cost of what follows, by state, before each row and after the last one, where it is `after`."""
    out = [after]
    for role, fault in zip(reversed(roles), reversed(faults)):
        v = [x + DELETE for x in after]
        if fault not in (IS_BLANK, IS_DUPLICATE):
            more = TRUNCATED if fault == IS_TRUNCATED else 0
            for s in range(4):
                kept = KEEP[s].get(role[:1])
                v[s] = min(v[s], REROLE + more + after[NEXT[s]], FAR if kept is None else more + after[kept])
        after = closed(v)
        out.append(after)
    return out[::-1]


def walk(roles: list[str], texts: list[str], faults: list[int], costs: list[list[int]], state: int, last: bool) -> tuple[int, str, list[tuple[str, str]]]:
    """From state through the rows by edits that keep to the costs, the ASCII-least initial first: the state reached, the
    initials, the turns left. With `last`, turns are inserted after the rows until the conversation may end."""
    audit, turns, i = [], [], 0
    while i < len(roles) or (last and costs[i][state]):
        togo = costs[i][state]
        if i < len(roles) and DELETE + costs[i + 1][state] == togo:
            audit.append("D")
        elif INSERT + costs[i][NEXT[state]] == togo:
            audit.append("I")
            state = NEXT[state]
            turns.append((ROLE[state], ""))
            continue
        else:
            kept, more = KEEP[state].get(roles[i][:1]), TRUNCATED if faults[i] == IS_TRUNCATED else 0
            if kept is not None and more + costs[i + 1][kept] == togo:
                audit.append("K")
                state = kept
                turns.append((roles[i], texts[i]))
            else:
                audit.append("R")
                state = NEXT[state]
                turns.append((ROLE[state], texts[i]))
        i += 1
    return state, "".join(audit), turns


def joined(turns: list[tuple[str, str]]) -> bytes:
    return "\n".join(f"{role}:{text}" for role, text in turns).encode("utf-8", "surrogatepass")


def damaged(rows: DataFrame) -> DataFrame:
    """conversations with faults that a hash of conversation and turn decides; `gone` marks rows that were dropped."""
    at = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    rows = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), (F.crc32(at.cast("binary")) % 20).alias("d"))
    text = F.when(F.col("d") == 1, "").when(F.col("d") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.explode(F.sequence(F.lit(1), F.when(F.col("d") == 3, 2).otherwise(1))).alias("copy")
    role = F.when(F.col("d") == 4, "user").otherwise(F.col("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("d") == 0).alias("gone"), copies).drop("copy")


class _Segment:
    """Rows of one conversation that follow each other."""

    def __init__(self):
        self.roles, self.texts, self.faults, self.turns, self.bytes, self.seen, self.keys, self.key_rows = [], [], [], [], 0, set(), [], []

    def add(self, turn: int | None, role: str, text: str) -> None:
        fault = fault_of(text)
        if fault != IS_BLANK:
            head = role.encode("utf-8", "surrogatepass")
            key = hashlib.blake2b(len(head).to_bytes(8, "little") + head + text.encode("utf-8", "surrogatepass"), digest_size=16).digest()
            if key in self.seen:
                fault = IS_DUPLICATE
            else:
                self.seen.add(key)
                self.keys.append(key)
                self.key_rows.append(len(self.roles))
        self.turns.append(turn)
        self.roles.append(role)
        self.texts.append(text)
        self.faults.append(fault)
        self.bytes += len(role) + len(text)

    def full(self, rows: int) -> bool:
        return len(self.roles) >= rows or self.bytes >= BYTES

    def counts(self) -> dict:
        turns = [t for t in self.turns if t is not None]
        pairs = sum(a[:1] + b[:1] not in LEGAL for a, b in zip(self.roles, self.roles[1:]))
        return {"low": turns[0] if turns else None, "high": turns[-1] if turns else None, "distinct": len(set(turns)), "illegal": pairs}


def _turns(turns: list[tuple[str, str]]) -> list[dict]:
    return [{"role": r, "text": t} for r, t in turns]


def _whole(s: _Segment, with_turns: bool) -> dict:
    """The result of a conversation that is one segment."""
    costs = costs_to_go(s.roles, s.faults, END)
    _, audit, turns = walk(s.roles, s.texts, s.faults, costs, START, True)
    c = s.counts()
    gaps = c["high"] - c["low"] + 1 - c["distinct"] if c["distinct"] else 0
    out = {"gaps": gaps, "blank": s.faults.count(IS_BLANK), "duplicate": s.faults.count(IS_DUPLICATE), "truncated": s.faults.count(IS_TRUNCATED), "illegal": c["illegal"], "cost": costs[0][START], "audit": audit, "repaired_sha256": hashlib.sha256(joined(turns)).hexdigest()}
    return out | ({"turns": _turns(turns)} if with_turns else {})


_TURNS = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
_SEGMENT = [("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string())), ("faults", pa.list_(pa.int32())), ("keys", pa.list_(pa.binary())), ("key_rows", pa.list_(pa.int32())), ("low", pa.int64()), ("high", pa.int64()), ("distinct", pa.int64())]
_RESULT = [*((c, pa.int64()) for c in COUNTS), ("audit", pa.string()), ("repaired_sha256", pa.string())]
_SEGMENT_KIND = "roles array<string>, texts array<string>, faults array<int>, keys array<binary>, key_rows array<int>, low long, high long, distinct long"
_RESULT_KIND = ", ".join(f"{c} long" for c in COUNTS) + ", audit string, repaired_sha256 string"
_TURNS_KIND = "array<struct<role: string, text: string>>"


def _packed(rows: Iterator[tuple[int, dict]], schema: pa.Schema):
    """Record batches of rows that come with their sizes."""
    held, size = [], 0
    for n, row in rows:
        held.append(row)
        size += n + 200
        if size > BYTES:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _cut(most_rows: int, with_turns: bool):
    """Rows in order to conversations that lie within a partition, with their results, and segments of all others: of
    the first and the last of a partition, which may go on in its neighbours, and of those of more than a segment."""

    def rows(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        now, s, parted, at = (), _Segment(), True, 0

        def out(whole: bool):
            nonlocal at, parted
            row = {"conv_id": now[0], "whole": whole, "seq": (part << 32) + at}
            size = s.bytes
            if whole:
                row |= _whole(s, with_turns)
            else:
                row |= {"roles": s.roles, "texts": s.texts, "faults": s.faults, "keys": s.keys, "key_rows": s.key_rows} | s.counts()
                at, parted = at + 1, True
            return size, row

        for batch in batches:
            for one in batch.to_pylist():
                if now != (one["conv_id"],):
                    if now:
                        yield out(not parted)
                    s, parted, now = _Segment(), not now, (one["conv_id"],)
                elif s.full(most_rows):
                    yield out(False)
                    s = _Segment()
                if not one["gone"]:
                    s.add(one["turn"], one["role"], one["text"])
        if now:
            yield out(False)

    def run(batches):
        batches = iter(batches)
        first = next(batches, None)
        if first is None:
            return
        conv = first.schema.field("conv_id")
        schema = pa.schema([conv, ("whole", pa.bool_()), ("seq", pa.int64()), *_SEGMENT, *_RESULT, *([("turns", _TURNS)] if with_turns else [])])
        yield from _packed(rows(b for x in ([first], batches) for b in x), schema)

    return run


def _marked(row: dict) -> list[int]:
    """Faults of a segment's rows, with those whose text was said in an earlier segment."""
    faults = list(row["faults"])
    for k in row["later"] or ():
        faults[row["key_rows"][k]] = IS_DUPLICATE
    return faults


def _costs(batches):
    """Of each segment the least cost from each state to each other, and what else its conversation needs of it."""
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            faults = _marked(r)
            units = [[0 if s == t else FAR for s in range(4)] for t in range(4)]
            to = [costs_to_go(r["roles"], faults, u)[0] for u in units]
            out.append({"conv_id": r["conv_id"], "seq": r["seq"], "cost": [min(to[t][s], FAR) for s in range(4) for t in range(4)], "n": len(faults), "first": r["roles"][0][:1] if faults else "", "final": r["roles"][-1][:1] if faults else "", "low": r["low"], "high": r["high"], "distinct": r["distinct"], "illegal": r["illegal"], "blank": faults.count(IS_BLANK), "duplicate": faults.count(IS_DUPLICATE), "truncated": faults.count(IS_TRUNCATED)})
        yield pa.RecordBatch.from_pylist(out, pa.schema([batch.schema.field("conv_id"), ("seq", pa.int64()), ("cost", pa.list_(pa.int64())), ("n", pa.int64()), ("first", pa.string()), ("final", pa.string()), *((c, pa.int64()) for c in ("low", "high", "distinct", "illegal", "blank", "duplicate", "truncated"))]))


def _after(group: pa.Table) -> pa.Table:
    """The cost-to-go after each segment of a conversation; with its first segment what the conversation adds up to."""
    rows = sorted(group.to_pylist(), key=lambda r: r["seq"])
    out, after = [], END
    for r in reversed(rows):
        out.append({"seq": r["seq"], "after": after})
        # no rows (all were dropped): nothing changes
        after = [min(r["cost"][4 * s + t] + after[t] for t in range(4)) for s in range(4)] if r["n"] else after
    total = {c: sum(r[c] for r in rows) for c in ("blank", "duplicate", "truncated", "illegal")}
    said = [r for r in rows if r["n"]]
    total["illegal"] += sum(a["final"] + b["first"] not in LEGAL for a, b in zip(said, said[1:]))
    timed = [r for r in said if r["distinct"]]
    distinct = sum(r["distinct"] for r in timed) - sum(a["high"] == b["low"] for a, b in zip(timed, timed[1:]))
    total["gaps"] = timed[-1]["high"] - timed[0]["low"] + 1 - distinct if timed else 0
    out[-1] |= total | {"cost": after[START]}
    for n, r in enumerate(reversed(out)):
        r |= {"conv_id": rows[0]["conv_id"], "last": n == len(out) - 1}
    return pa.Table.from_pylist(out, pa.schema([group.schema.field("conv_id"), ("seq", pa.int64()), ("after", pa.list_(pa.int64())), ("last", pa.bool_()), *((c, pa.int64()) for c in COUNTS)]))


def _exits(batches):
    """Where the walk through each segment ends, by the state where it begins."""
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            faults = _marked(r)
            costs = costs_to_go(r["roles"], faults, r["after"])
            ends = [walk(r["roles"], r["texts"], faults, costs, s, False)[0] if costs[0][s] < FAR else s for s in range(4)]
            out.append({"conv_id": r["conv_id"], "seq": r["seq"], "ends": ends})
        yield pa.RecordBatch.from_pylist(out, pa.schema([batch.schema.field("conv_id"), ("seq", pa.int64()), ("ends", pa.list_(pa.int32()))]))


def _entries(group: pa.Table) -> pa.Table:
    state, out = START, []
    for r in sorted(group.to_pylist(), key=lambda r: r["seq"]):
        out.append({"seq": r["seq"], "state": state})
        state = r["ends"][state]
    return pa.Table.from_pylist(out, pa.schema([("seq", pa.int64()), ("state", pa.int32())]))


def _pieces(batches):
    """Of each segment its part of the edits and of the repaired turns."""
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            faults = _marked(r)
            costs = costs_to_go(r["roles"], faults, r["after"])
            _, audit, turns = walk(r["roles"], r["texts"], faults, costs, r["state"], r["last"])
            out.append({"conv_id": r["conv_id"], "seq": r["seq"], "audit": audit, "turns": _turns(turns)} | {c: r[c] for c in COUNTS})
        yield pa.RecordBatch.from_pylist(out, pa.schema([batch.schema.field("conv_id"), ("seq", pa.int64()), ("audit", pa.string()), ("turns", _TURNS), *((c, pa.int64()) for c in COUNTS)]))


def _digests(batches):
    """Conversations of segments in order: edits joined, turns hashed one after the other."""

    def rows():
        now = None
        for batch in batches:
            for r in batch.to_pylist():
                if r["cost"] is not None:  # the first segment
                    if now:
                        yield len(now["audit"]), now | {"audit": "".join(now["audit"]), "repaired_sha256": digest.hexdigest()}
                    now, digest, some = {"conv_id": r["conv_id"], "audit": []} | {c: r[c] for c in COUNTS}, hashlib.sha256(), False
                now["audit"].append(r["audit"])
                turns = [(t["role"], t["text"]) for t in r["turns"]]
                if turns:
                    digest.update((b"\n" if some else b"") + joined(turns))
                    some = True
        if now:
            yield len(now["audit"]), now | {"audit": "".join(now["audit"]), "repaired_sha256": digest.hexdigest()}

    batches = iter(batches)
    first = next(batches, None)
    if first is not None:
        conv = first.schema.field("conv_id")
        rest = batches
        batches = (b for x in ([first], rest) for b in x)
        yield from _packed(rows(), pa.schema([conv, *_RESULT]))


def _edited(rows: DataFrame, gone: str | None, most_rows: int, with_turns: bool) -> tuple[DataFrame, DataFrame]:
    """Conversations that are whole, with their results; pieces of the others, in order of seq."""
    conv = rows.schema["conv_id"].dataType.simpleString()
    rows = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), (F.col(gone) if gone else F.lit(False)).alias("gone"))
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "tie"]
    # bounds of the exchange carry hashes, not texts; equal rows from several tasks may part, as they change places freely
    dealt = rows.withColumn("tie", F.md5("text")).withColumn("origin", F.spark_partition_id()).repartitionByRange(*order, "origin").sortWithinPartitions(*order).drop("tie", "origin")
    kind = f"conv_id {conv}, whole boolean, seq long, {_SEGMENT_KIND}, {_RESULT_KIND}" + (f", turns {_TURNS_KIND}" if with_turns else "")
    cut = materialise(dealt.mapInArrow(_cut(most_rows, with_turns), kind), "cut")
    parted = cut.where("not whole").select("conv_id", "seq", "roles", "texts", "faults", "keys", "key_rows", "low", "high", "distinct", "illegal")
    # texts said in an earlier segment: a segment holds each once
    said = parted.select("conv_id", "seq", F.posexplode("keys").alias("k", "key"))
    first = said.groupBy("conv_id", "key").agg(F.min("seq").alias("first"), F.count("*").alias("n")).where("n > 1").select(F.col("conv_id").alias("c"), F.col("key").alias("said"), "first")
    later = said.join(first, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("key") == F.col("said")) & (F.col("seq") > F.col("first"))).groupBy("seq").agg(F.collect_list("k").alias("later"))
    parted = materialise(parted.join(later, "seq", "left"), "segments")
    cost = parted.mapInArrow(_costs, f"conv_id {conv}, seq long, cost array<long>, n long, first string, final string, low long, high long, distinct long, illegal long, blank long, duplicate long, truncated long")
    after = materialise(cost.groupBy("conv_id").applyInArrow(_after, f"conv_id {conv}, seq long, after array<long>, last boolean, {', '.join(f'{c} long' for c in COUNTS)}"), "after")
    with_after = parted.drop("illegal").join(after.drop("conv_id"), "seq")
    exits = with_after.mapInArrow(_exits, f"conv_id {conv}, seq long, ends array<int>")
    entries = materialise(exits.groupBy("conv_id").applyInArrow(_entries, "seq long, state int"), "entries")
    pieces = with_after.join(entries, "seq").mapInArrow(_pieces, f"conv_id {conv}, seq long, audit string, turns {_TURNS_KIND}, {', '.join(f'{c} long' for c in COUNTS)}")
    return cut.where("whole"), pieces


def repair(rows: DataFrame, gone: str | None = None, most_rows: int = ROWS) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of each conversation of
    rows(conv_id, turn, role, text): its faults, the cheapest edits that leave no blank or repeated turn and roles
    that read `(s?(ua)+)?` by their initials, and a hash of the turns left.

    Turns go by number, null ones first, ties by role and then a hash of the text; equal rows are repeats of each other. A
    null role or text reads as one space, so that a null text is blank; null conversation ids are one conversation. Rows
    that are true in the column `gone` only name their conversation: one without any other rows has zeros, no edits and the
    hash of nothing. An empty table gives no rows; further columns are not read.

    All rows are range-partitioned once, by conversation and turn, so that a long conversation lies in many tasks. Those
    within a partition are walked there. The first and the last of a partition, and those of over most_rows or 1 MB, go on
    as segments: each has a matrix of costs between the four states of the grammar, matrices are chained from the end to
    costs-to-go, and states from the start by where the walk through each segment leads. One task gets 20 numbers a segment
    of a conversation. The hash must read the turns of a conversation in one place; it takes them segment by segment."""
    whole, pieces = _edited(rows, gone, most_rows, False)
    conv = rows.schema["conv_id"].dataType.simpleString()
    in_order = pieces.repartition("conv_id").sortWithinPartitions("conv_id", "seq")
    digested = in_order.mapInArrow(_digests, f"conv_id {conv}, {_RESULT_KIND}")
    out = ["conv_id", *COUNTS, "audit", "repaired_sha256"]
    return whole.select(*out).unionByName(digested.select(*out))


def repaired_turns(rows: DataFrame, gone: str | None = None, most_rows: int = ROWS) -> DataFrame:
    """(conv_id, seq, place, role, text): the turns that repair() leaves, in order of seq and place in a conversation."""
    whole, pieces = _edited(rows, gone, most_rows, True)
    both = whole.select("conv_id", "seq", "turns").unionByName(pieces.select("conv_id", "seq", "turns"))
    return both.select("conv_id", "seq", F.posexplode("turns").alias("place", "turn")).select("conv_id", "seq", "place", "turn.role", "turn.text")
