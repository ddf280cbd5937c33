"""Periodic runs against a brute-force search, and awkward rows."""

import hashlib
import random
import re
import zlib

import numpy as np

from lotwise.llm import runs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(words):
    out = []
    for q in range(1, len(words) // 3 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            s, e = i, j + q
            shorter = any(all(words[x] == words[x + r] for x in range(s, e - r)) for r in range(1, q))
            if j > i and e - s >= max(24, 3 * q) and not shorter:
                out.append((s, e - s, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def periodic(rng):
    words = []
    for _ in range(rng.randint(1, 5)):
        k = rng.choice([1, 2, 3, 5, 8, 9, 13])
        unit = [rng.randint(0, rng.choice([1, 2, 5, 50])) for _ in range(k)]
        n = rng.choice([1, 8, 23, 24, 25, 40, 3 * k - 1, 3 * k, 3 * k + 1])
        words += (unit * (n // k + 2))[:n] + [rng.randint(0, 3) for _ in range(rng.choice([0, 0, 1, 5]))]
    return words


def test_runs_equal_brute_force():
    rng = random.Random(1)
    for _ in range(150):
        docs = [periodic(rng) for _ in range(rng.randint(1, 4))]
        number = {}
        ids = np.array([number.setdefault((i, x), len(number)) for i, d in enumerate(docs) for x in d], np.int64)
        found = runs.runs_of(ids, np.cumsum([0] + [len(d) for d in docs]))
        assert [found.get(i, []) for i in range(len(docs))] == [brute(d) for d in docs]


def test_equal_words_make_one_run_in_little_time():
    n = 200_000
    assert runs.runs_of(np.zeros(n, np.int64), np.array([0, n])) == {0: [(0, n, 1)]}


def expected(doc_id, text):
    words = WORD.findall(text or "")
    n = len(words)
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = brute(words)
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    top = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None,) * 3)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (
        len(found), *top, None if top[0] is None else 1000 * top[1] // top[2], sha("".join(f"{s},{length},{q}\n" for s, length, q in found)),
        sha(" ".join(w for i, w in enumerate(words) if i not in gone)),
    )


def digest_query(spark, tmp_path, rows, schema):
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    out = runs.op11_runs(spark, str(tmp_path)).collect()
    return sorted((tuple(r) for r in out), key=lambda r: tuple(str(x) for x in r))


def test_query_equals_brute_force(spark, tmp_path):
    rng, rows = random.Random(2), []
    for i in range(120):
        words = [f"w{x}é" for x in periodic(rng)] if i % 3 else [f"v{rng.randint(0, 400)}" for _ in range(rng.choice([1, 5, 60, 300]))]
        rows.append((i, rng.choice([" ", "\n", " \t "]).join(words), 1, "x"))
    rows += [(None, "a b " * 30, 1, "x"), (7, None, 1, "x"), (8, "", 1, "x"), (9, " \n\t", 1, "x"), (3, "yes no " * 20, 1, "x"), (3, "yes no " * 20, 1, "x")]
    rows += [(10**9 + k, "long " * 20_000 + f"tail{k}", 1, "x") for k in range(2)]
    short = [r for r in rows if not r[1] or len(r[1]) < 50_000]
    got = digest_query(spark, tmp_path / "a", rows, "doc_id long, text string, start long, kept string")
    want = sorted(((r[0], *expected(*r[:2])) for r in short), key=lambda r: tuple(str(x) for x in r))
    assert [r for r in got if r[0] is None or r[0] < 10**9] == want
    assert sum(r[0] is not None and r[0] >= 10**9 for r in got) == 2


def test_empty_table_gives_no_rows(spark, tmp_path):
    assert digest_query(spark, tmp_path / "b", [], "doc_id long, text string") == []


def test_a_long_text_is_one_run_up_to_its_tail(spark):
    docs = spark.createDataFrame([(None, "x " + "a b c " * 10_000 + "z")], "doc_id long, text string")
    row = runs.periodic_runs(docs).first()
    assert [tuple(r) for r in row["runs"]] == [(1, 30_000, 3)]
    assert row["kept"] == "x a b c z" and row["exponent_milli"] == 10_000_000
