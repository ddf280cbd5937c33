"""Conversation repair by weighted interval parsing.

A conversation is well formed if its role initials spell (s?(ua)+)?. The repair grammar is in Chomsky normal form over
pairs of states of that language: p-q derives what leads from p to q, either one row (kept, given another role or deleted,
with closure: any rows inserted before and after it) or two parts, p-r and r-q. A chart holds for each span of rows and
each p-q the cheapest derivation and of equal ones the edits that sort first; spans are filled in order of their length.

Equal costs never make one span's edits a prefix of another's (what follows could only be inserted rows, which cost), so
the best of a span is made of the bests of its parts, and with pairs of states every split of a span gives the same cell.
Spans of up to _CHART rows try all splits; longer ones are halved, which keeps the work near linear in the rows.

Conversations of at most LONG rows are parsed whole in one task's row. Longer ones are cut in pieces of _TURNS turns:
pieces are charted in parallel, their cells folded in order, and each piece is then repaired on its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import load, ship, small, stage

LONG, _TURNS, _CHART = 4096, 1024, 12
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: Moves of (s?(ua)+)? between start, after s, after u and after a; the first and the last state accept.
_MOVES = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
_ACCEPT = (0, 3)
_ROLES = {"u": "user", "a": "assistant"}

#: (cost, edits) of each pair of states, or None where nothing leads from the one to the other.
Cell = dict[tuple[int, int], tuple[int, str]]


def _better(cell: Cell, pair: tuple[int, int], found: tuple[int, str]) -> None:
    if pair not in cell or found < cell[pair]:
        cell[pair] = found


def combine(left: Cell, right: Cell) -> Cell:
    """The cell of two neighbouring spans: for each p-q the best of p-r and r-q."""
    out: Cell = {}
    for (p, r), (cost, edits) in left.items():
        for q in range(4):
            if (r, q) in right:
                more = right[r, q]
                _better(out, (p, q), (cost + more[0], edits + more[1]))
    return out


def _closure() -> Cell:
    """Rows that are only inserted: none, or more until every state is reached that can be."""
    cell: Cell = {(p, p): (0, "") for p in range(4)}
    one = cell | {(p, q): (INSERT, "I") for (p, role), q in _MOVES.items() if role in _ROLES}
    while (wider := combine(cell, one)) != cell:
        cell = wider
    return cell


_INSERTED = _closure()


@lru_cache(maxsize=1 << 16)
def _chart(kinds: str) -> Cell:
    """The cell of a span of rows, from all its splits; kinds has x for a row that must go, else its role's initial, in
    upper case where the row is truncated."""
    if not kinds:
        return _INSERTED
    if len(kinds) > 1:
        best: Cell = {}
        for k in range(1, len(kinds)):
            for pair, found in combine(_chart(kinds[:k]), _chart(kinds[k:])).items():
                _better(best, pair, found)
        return best
    row: Cell = {(p, p): (DELETE, "D") for p in range(4)}
    if kinds != "x":
        more = TRUNCATED if kinds.isupper() else 0
        for (p, role), q in _MOVES.items():
            if role == kinds.lower():
                _better(row, (p, q), (KEEP + more, "K"))
            elif role in _ROLES:
                _better(row, (p, q), (REROLE + more, "R"))
    return combine(combine(_INSERTED, row), _INSERTED)


def span(kinds: str) -> Cell:
    """The cell of a span of any length."""
    if len(kinds) <= _CHART:
        return _chart(kinds)
    half = (len(kinds) // 2 + _CHART - 1) // _CHART * _CHART
    return combine(span(kinds[:half]), span(kinds[half:]))


def whole(cell: Cell) -> tuple[int, str]:
    """The cheapest repair: from the first state to one that accepts."""
    return min(cell[0, q] for q in _ACCEPT if (0, q) in cell)


def kinds_of(rows: list[dict], seen: set) -> tuple[str, dict[str, int]]:
    """The kinds string and the counts of faults of rows in order; seen holds the (role, text) pairs before and grows."""
    kinds, count = [], dict.fromkeys(("blank", "duplicate", "truncated"), 0)
    for row in rows:
        role, text, copies = row["role"], row["text"], row["copies"]
        said = text.rstrip(" \t\n\x0b\x0c\r")
        if not said:
            count["blank"] += copies
            kinds.append("x" * copies)
            continue
        again = row["again"] or (role, text) in seen
        seen.add((role, text))
        count["duplicate"] += copies - 1 + again
        if again:
            kinds.append("x" * copies)
            continue
        initial = role[:1] if role[:1] in ("s", "u", "a") else "o"
        if said[-1] not in ".!?":
            count["truncated"] += 1
            initial = initial.upper()
        kinds.append(initial + "x" * (copies - 1))
    return "".join(kinds), count


def repaired(rows: list[dict], edits: str, state: int) -> tuple[list[tuple[str, str]], int]:
    """(role, text) of what the edits leave of the rows, entering in a state; and the state after them."""
    each = iter([row for row in rows for _ in range(row["copies"])])
    out = []
    for edit in edits:
        row = None if edit == "I" else next(each)
        if edit == "D":
            continue
        role = row["role"] if edit == "K" else _ROLES["a" if state == 2 else "u"]
        state = _MOVES[state, role[:1]]
        out.append((role, row["text"] if row else ""))
    return out, state


def _initials(rows: list[dict]) -> list[str]:
    return [row["role"][:1] for row in rows for _ in range(min(row["copies"], 2))]


def _illegal(rows: list[dict]) -> int:
    """Neighbouring rows whose initials aren't su, ua or au."""
    first = [row["role"][:1] for row in rows]
    bad = sum(a + b not in ("su", "ua", "au") for a, b in zip(first, first[1:], strict=False))
    return bad + sum(row["copies"] - 1 for row in rows)  # a role never follows itself


_DONE = "conv_id {id}, piece long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, lines array<struct<role:string,text:string>>"
_FOUND = "conv_id {id}, piece long, first string, last string, low long, high long, turns long, blank long, duplicate long, truncated long, illegal long, cells array<struct<p:int,q:int,cost:long,edits:string>>"


def _table(schema: str, id_type: pa.DataType, rows: list[tuple]) -> pa.RecordBatch:
    names = [x.split()[0] for x in schema.replace("{id}", "x").split(", ")]
    long, text = pa.int64(), pa.string()
    kinds = {
        "conv_id": id_type, "audit": text, "first": text, "last": text, "lines": pa.list_(pa.struct([("role", text), ("text", text)])),
        "cells": pa.list_(pa.struct([("p", pa.int32()), ("q", pa.int32()), ("cost", long), ("edits", text)])),
    }
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds.get(n, long)) for i, n in enumerate(names)], names)


def _lines(out: list[tuple[str, str]]) -> list[dict]:
    return [{"role": role, "text": text} for role, text in out]


def _turns(rows: list[dict]) -> tuple[int | None, int | None, int]:
    turns = {row["turn"] for row in rows if row["turn"] is not None}
    return min(turns, default=None), max(turns, default=None), len(turns)


def _gaps(low: int | None, high: int | None, turns: int) -> int:
    return 0 if low is None else high - low + 1 - turns


def _parse_whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Conversations, one a row (conv_id, rows), to their repair."""
    for batch in batches:
        out = []
        for conv, rows in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            kinds, count = kinds_of(rows, set())
            cost, edits = whole(span(kinds))
            lines = _lines(repaired(rows, edits, 0)[0])
            out.append((conv, 0, _gaps(*_turns(rows)), *count.values(), _illegal(rows), cost, edits, lines))
        yield _table(_DONE, batch.schema.field(0).type, out)


def _parse_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces (conv_id, piece, rows) to their cells and counts."""
    for batch in batches:
        out = []
        for conv, piece, rows in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            kinds, count = kinds_of(rows, set())
            cells = [{"p": p, "q": q, "cost": c, "edits": e} for (p, q), (c, e) in span(kinds).items()]
            ends = rows[0]["role"][:1], rows[-1]["role"][:1]
            out.append((conv, piece, *ends, *_turns(rows), *count.values(), _illegal(rows), cells))
        yield _table(_FOUND, batch.schema.field(0).type, out)


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted pieces of conversations to (conv_id, piece, state, edits, last, counts): each piece's share of the repair.

    For every piece the best way from the start to each state is kept as a cost and the state before the piece; ties are
    settled by the edits so far, kept for the four states.
    """

    def close(conv, held: list[dict]) -> list[tuple]:
        reach: dict[int, tuple[int, str]] = {0: (0, "")}
        back: list[dict[int, int]] = []
        for one in held:
            cell = {(c["p"], c["q"]): (c["cost"], c["edits"]) for c in one["cells"]}
            nxt: dict[int, tuple[int, str]] = {}
            came: dict[int, int] = {}
            for p, (cost, edits) in reach.items():
                for q in range(4):
                    if (p, q) in cell:
                        found = (cost + cell[p, q][0], edits + cell[p, q][1])
                        if q not in nxt or found < nxt[q]:
                            nxt[q], came[q] = found, p
            reach = nxt
            back.append(came)
        state = min((reach[q], q) for q in _ACCEPT if q in reach)[1]
        cost, low, high, turns = reach[state][0], [], [], 0
        total = dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)
        for i, one in enumerate(held):
            for k in total:
                total[k] += one[k]
            low += [one["low"]] if one["low"] is not None else []
            high += [one["high"]] if one["high"] is not None else []
            turns += one["turns"]
            if i and held[i - 1]["last"] + one["first"] not in ("su", "ua", "au"):
                total["illegal"] += 1
        gaps = _gaps(min(low, default=None), max(high, default=None), turns)
        rows = []
        for one, came in zip(reversed(held), reversed(back), strict=True):
            p = came[state]
            edits = next(c["edits"] for c in one["cells"] if (c["p"], c["q"]) == (p, state))
            rows.append((conv, one["piece"], p, edits, gaps, *total.values(), cost))
            state = p
        return rows

    names = ["conv_id", "piece", "state", "edits", "gaps", "blank", "duplicate", "truncated", "illegal", "cost"]

    def table(rows: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], id_type if not i else pa.string() if i == 3 else pa.int64()) for i in range(len(names))], names)

    held: list[dict] = []
    for batch in batches:
        id_type, out = batch.schema.field(0).type, []
        for one in batch.to_pylist():
            if held and held[-1]["conv_id"] != one["conv_id"]:
                out += close(held[-1]["conv_id"], held)
                held = []
            held.append(one)
        if out:
            yield table(out, id_type)
    if held:
        yield table(close(held[-1]["conv_id"], held), id_type)


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces with their share of the repair (conv_id, piece, rows, state, edits, counts) to repaired pieces."""
    for batch in batches:
        out = []
        for one in batch.to_pylist():
            lines = _lines(repaired(one["rows"], one["edits"], one["state"])[0])
            counts = (one[k] for k in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost"))
            out.append((one["conv_id"], one["piece"], *counts, one["edits"], lines))
        yield _table(_DONE, batch.schema.field(0).type, out)


def repair(rows: DataFrame) -> DataFrame:
    """conv_id, piece, gaps, blank, duplicate, truncated, illegal, cost, audit, lines and cut of every conversation.

    rows: conv_id, turn, role, text; other columns are left out. A conversation's rows go by turn, null turns first, rows
    of one turn by role and text. Null roles and texts are one space; a null conv_id is a conversation of its own. A
    conversation of more than LONG rows is cut in pieces, in order (null first), whose audits and lines follow each other;
    counts and cost are the whole conversation's in each. A task holds the distinct rows of _TURNS turns at most. Conversations without rows, so empty tables, give no rows.

    A row counts for its first fault: blank, duplicate (its role and text stand before it), truncated (its last character
    that is no white space is none of .!?). Initials other than s, u and a are kept nowhere: such rows are given another
    role or deleted. Equal rows of a turn are counted before anything is shuffled, where a conversation is long.
    """
    ship(rows.sparkSession)
    rows = rows.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")]
    )
    id_type = dict(rows.dtypes)["conv_id"]
    long_ = rows.groupBy("conv_id").count().where(F.col("count") > LONG).select("conv_id", F.lit(True).alias("long"))
    long_ = stage(long_, "long-conversations")
    one = lambda *more: F.struct("turn", "role", "text", "copies", "again", *more)
    ordered = lambda: F.sort_array(F.collect_list(one())).alias("rows")
    plain = rows.withColumns({"copies": F.lit(1).cast("long"), "again": F.lit(False)})
    if long_.isEmpty():
        return plain.groupBy("conv_id").agg(ordered()).mapInArrow(_parse_whole, _DONE.format(id=id_type)).withColumn("cut", F.lit(False))

    ids = small(long_.withColumnRenamed("conv_id", "id"))
    same = F.col("conv_id").eqNullSafe(F.col("id"))
    short = plain.join(ids, same, "left_anti").groupBy("conv_id").agg(ordered())
    short = short.mapInArrow(_parse_whole, _DONE.format(id=id_type)).withColumn("cut", F.lit(False))
    rows = rows.join(ids, same, "left_semi").groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("copies"))
    before = Window.partitionBy("conv_id", "role", "text").orderBy("turn")
    rows = rows.withColumn("again", F.row_number().over(before) > 1).withColumn("piece", F.expr(f"turn div {_TURNS}"))
    pieces = stage(rows.groupBy("conv_id", "piece").agg(ordered()), "conversation-pieces")
    found = pieces.mapInArrow(_parse_pieces, _FOUND.format(id=id_type))
    kinds = f"conv_id {id_type}, piece long, state long, edits string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long"
    folded = found.repartition("conv_id").sortWithinPartitions("conv_id", F.asc_nulls_first("piece")).mapInArrow(_fold, kinds)
    folded = folded.withColumnsRenamed({"conv_id": "id", "piece": "at"})
    joined = pieces.join(folded, same & F.col("piece").eqNullSafe(F.col("at"))).drop("id", "at")
    return short.unionByName(joined.mapInArrow(_apply, _DONE.format(id=id_type)).withColumn("cut", F.lit(True)))


def damage(rows: DataFrame) -> DataFrame:
    """Rows with planted faults: by crc32 of conv_id:turn (null: one space) some are dropped, emptied, cut, repeated or given to the user."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")) % 20
    rows = rows.select("conv_id", "turn", part("role").alias("role"), part("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    return rows.withColumns({"text": text, "role": role, "n": F.explode(F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))}).drop("n", "kind")


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted pieces to one row a conversation, the digest of its lines taken piece by piece."""
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]

    def table(rows: list[list], id_type: pa.DataType) -> pa.RecordBatch:
        kinds = [id_type, *[pa.int64()] * 6, pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    last, audit, sha, any_ = None, [], None, False
    for batch in batches:
        id_type, out = batch.schema.field(0).type, []
        for one in batch.to_pylist():
            if last is None or last["conv_id"] != one["conv_id"]:
                if last is not None:
                    out.append([*(last[k] for k in names[:7]), "".join(audit), sha.hexdigest()])
                audit, sha, any_ = [], hashlib.sha256(), False
            for line in one["lines"]:
                sha.update(("\n" if any_ else "").encode() + f"{line['role']}:{line['text']}".encode())
                any_ = True
            audit.append(one["audit"])
            last = {k: one[k] for k in names[:7]}
        if out:
            yield table(out, id_type)
    if last is not None:
        yield table([[*(last[k] for k in names[:7]), "".join(audit), sha.hexdigest()]], id_type)


def digests(conversations: DataFrame, repaired_: DataFrame) -> DataFrame:
    """One row for every conv_id of conversations, with the digest of its repaired lines; those without rows are empty."""
    id_type = dict(repaired_.dtypes)["conv_id"]
    kinds = f"conv_id {id_type}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    cut = repaired_.where("cut").select("conv_id", "piece", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "lines")
    cut = cut.repartition("conv_id").sortWithinPartitions("conv_id", F.asc_nulls_first("piece")).mapInArrow(_digest, kinds)
    text = F.array_join(F.transform("lines", lambda x: F.concat(x.role, F.lit(":"), x.text)), "\n")
    done = repaired_.where("NOT cut").withColumn("repaired_sha256", F.sha2(text, 256)).select(*cut.columns).unionByName(cut)
    every = conversations.select(F.col("conv_id").alias("id")).distinct()
    out = every.join(done, F.col("id").eqNullSafe(F.col("conv_id")), "left")
    zero = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select(
        F.col("id").alias("conv_id"), *zero, F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )


def op13_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, damaged and repaired."""
    conversations = load(spark, sf_dir, "conversations")
    return digests(conversations, repair(damage(conversations)))
