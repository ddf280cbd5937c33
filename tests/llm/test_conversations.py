"""Conversation repair against a left-to-right search over rows and states, whole and in pieces; awkward rows."""

import hashlib
import random
import zlib

import pytest

from lotwise.llm import conversations as C

MOVES = {("0", "s"): "s", ("0", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
NAMES = {"u": "user", "a": "assistant"}


def damaged(conv, rows):
    out = []
    for turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else "".join(c for c in text if c not in ".!?") if kind == 2 else text
        role = "user" if kind == 4 else role
        out += [(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))


def direct(rows):
    turns, seen, faults = {t for t, _, _ in rows if t is not None}, set(), []
    for _, role, text in rows:
        said = text.strip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else "")
        seen.add((role, text))

    def relax(best, state, found):
        if state not in best or found[:2] < best[state][:2]:
            best[state] = found

    def inserted(best):
        for _ in range(6):
            for state, (cost, audit, lines) in list(best.items()):
                for (p, c), q in MOVES.items():
                    if p == state and c in NAMES:
                        relax(best, q, (cost + 5, audit + "I", [*lines, (NAMES[c], "")]))
        return best

    best = inserted({"0": (0, "", [])})
    for (_, role, text), fault in zip(rows, faults, strict=True):
        after = {}
        for state, (cost, audit, lines) in best.items():
            relax(after, state, (cost + 2, audit + "D", lines))
            if fault in ("blank", "duplicate"):
                continue
            cost += 5 * (fault == "truncated")
            if (state, role[:1]) in MOVES:
                relax(after, MOVES[state, role[:1]], (cost, audit + "K", [*lines, (role, text)]))
            for c, name in NAMES.items():
                if (state, c) in MOVES:
                    relax(after, MOVES[state, c], (cost + 1, audit + "R", [*lines, (name, text)]))
        best = inserted(after)
    cost, audit, lines = min((best[q] for q in "0a" if q in best), key=lambda v: v[:2])
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest()
    return gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, sha


def both(df):
    got = C.digests(df, C.repair(C.damage(df)))
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    rows, by = got.collect(), {}
    for r in df.select("conv_id", "turn", "role", "text").collect():
        by.setdefault(r[0], []).append(tuple(r[1:]))
    assert len(rows) == len(by)
    return {r["conv_id"]: tuple(r[n] for n in names) for r in rows}, {k: direct(damaged(k, v)) for k, v in by.items()}


@pytest.fixture(scope="module")
def mixed(spark):
    rng, rows = random.Random(5), []
    for conv in [None, *range(40)]:
        for i in range(rng.choice([1, 2, 5, 9, 30, 100])):
            turn = rng.choice([None, i, i, i, i, rng.randint(-20, 100)])
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "User"])
            rows += [(conv, turn, role, rng.choice(["Hi.", "ok?", "no", "  ", None, "", "x !\n", "Y. "]), "z")] * rng.choice([1, 1, 1, 2])
    rows += [(90, 0, "user", "a. " * 50_000, "z"), (90, 1, "assistant", "b " * 50_000, "z")]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, piece string").repartition(3)


def test_repair_equals_a_direct_search(mixed):
    got, want = both(mixed)
    assert got == want


def test_long_conversations_in_pieces_have_the_same_result(mixed, monkeypatch):
    monkeypatch.setattr(C, "LONG", 20)
    monkeypatch.setattr(C, "_TURNS", 7)
    got, want = both(mixed)
    assert got == want


def test_query_equals_a_direct_search(spark, tiny):
    rows = C.op13_conversations(spark, tiny).collect()
    by = {}
    for r in spark.read.parquet(f"{tiny}/conversations.parquet").collect():
        by.setdefault(r["conv_id"], []).append((r["turn"], r["role"], r["text"]))
    assert {r[0]: tuple(r[1:]) for r in rows} == {k: direct(damaged(k, v)) for k, v in by.items()}


def test_halves_and_all_splits_give_one_cell():
    rng = random.Random(6)
    for _ in range(30):
        kinds = "".join(rng.choice("suaoSUAOxx") for _ in range(rng.randint(13, 20)))
        assert C.span(kinds) == C._chart(kinds)


def test_copies_and_empty_tables(spark, monkeypatch):
    rows = [(1, 0, "user", "Same."), (1, 0, "user", "Same."), (1, 1, "assistant", "Yes.")] * 40
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    plain = C.repair(df).first()
    monkeypatch.setattr(C, "LONG", 30)
    assert C.repair(df).first()["audit"] == plain["audit"] == "K" + "D" * 79 + "K" + "D" * 39
    assert plain["duplicate"] == 118 and plain["cost"] == 236
    assert C.repair(df.limit(0)).count() == 0 and C.digests(df.limit(0), C.repair(df.limit(0))).count() == 0
