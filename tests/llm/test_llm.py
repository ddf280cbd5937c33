"""The llm operators on small tables: brute-force versions, round trips, held-out accuracy and awkward rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lotwise.llm import decontaminate, embeddings, encoder, language, licenses, mixing, ngram_join, quality, sharding, simple8b, substrings, textvec, tokens

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, shard string, score double"


def docs_of(spark, rows):
    """documents with extra columns whose names clash with the operators' own."""
    full = [(i, t, lang, src, None if t is None else len(t), 7, "x", 0.1) for i, t, lang, src in rows]
    return spark.createDataFrame(full, DOCS)


AWKWARD = [
    (1, None, "en", "a"), (2, "", None, None), (None, "some text here", "de", "b"), (3, " \n\t ", "fr", "a"), (4, "x " * 5000 + "y" * 3000, "en", "a"),
    (5, "same words again and again and again", "en", "b"), (5, "same words again and again and again", "en", "b"), (6, "é…\x00ß 🙂 <|endoftext|> it's", None, "c"),
]


@pytest.fixture(scope="module")
def awkward(spark):
    return docs_of(spark, AWKWARD)


@pytest.fixture(scope="module")
def corpus(spark):
    """Texts with exact copies, near copies, shared passages and short ones."""
    rng = random.Random(4)
    vocab = ["".join(rng.choice("abcdeilnorst") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    text = lambda n: [rng.choice(vocab) for _ in range(n)]
    passage, rows = text(60), []
    for i in range(150):
        words = text(rng.choice([1, 3, 5, 8, 20, 21, 60, 200]))
        if i % 7 == 0:
            words[len(words) // 2 : len(words) // 2] = passage
        rows.append(words)
    for base in (rows[7], rows[14], rows[20], rows[28]):
        for k in range(12):
            copy = list(base)
            for _ in range(k // 3):
                copy[rng.randrange(len(copy))] = rng.choice(vocab)
            rows.append(copy)
    rng.shuffle(rows)
    return docs_of(spark, [(i * 3, " ".join(w), ["en", "de"][i % 2], f"s{i % 4}") for i, w in enumerate(rows)])


def test_awkward_rows_have_defined_results(spark, awkward, tmp_path):
    n = len(AWKWARD)
    assert mixing.mix(awkward).count() == n
    assert sharding.shard(awkward, shards=3).count() == n
    assert tokens.token_index(awkward, tokens.default_tokenizer()).count() == n
    assert ngram_join.ngram_join(awkward).count() == n
    assert substrings.dedup_substrings(awkward).count() == n
    assert quality.score(awkward, None, "doc_id").where("score = 0.5").count() == n
    got = language.identify(awkward, language.train(awkward), "doc_id").collect()
    assert len(got) == n and {r.lang_pred for r in got if r.doc_id in (1, 2, 3)} == {"und"}
    assert licenses.scan(awkward).count() == 0
    bench = spark.createDataFrame([(1, None), (None, "a b c d e f"), (2, ""), (3, "and again and again and")], "item_id long, text string")
    assert [(r.doc_id, r.item_id) for r in decontaminate.leaks(awkward, bench).collect()] == []
    assert mixing.mixed_documents(awkward).count() > 0


def test_empty_tables(spark, awkward):
    none = awkward.limit(0)
    for out in (
        mixing.mix(none), sharding.shard(none), tokens.token_index(none, tokens.default_tokenizer()), ngram_join.ngram_join(none), substrings.dedup_substrings(none),
        language.identify(none, language.train(none), "doc_id"), licenses.scan(none), mixing.mixed_documents(none),
        decontaminate.leaks(none, spark.createDataFrame([], "item_id long, text string")),
        embeddings.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")),
    ):
        assert out.count() == 0
    assert quality.train(none, spark.createDataFrame([], "doc_id long, quality int")) is None


def test_targets_share_and_cap():
    assert mixing.targets([100, 100, 100], [5, 2, 1], 3) == pytest.approx([187.5, 75, 37.5])
    got = mixing.targets([10, 1000, 1000], [5, 2, 1], 3)
    assert got[0] == 30 and sum(got) == pytest.approx(2010) and got[1] == pytest.approx(2 * got[2])


def test_quotas_are_exact():
    q = mixing.split_quotas([100, 37, 0, 5], 7, 1)
    assert [sum(c) for c in zip(*q, strict=True)] == [100, 37, 0, 5]
    sizes = [sum(r) for r in q]
    assert max(sizes) - min(sizes) <= 3


def test_mix_query_returns_every_document(spark, tmp_path):
    """Documents that the mix doesn't read have no shard and place; the others have those of their first reading."""
    docs = [(i, f"w{i} " * 50, "en", "a" if i % 3 else "b", 100) for i in range(300)] + [(300, None, "en", "b", 0), (301, "", "en", None, 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in mixing.op2_mix(spark, str(tmp_path)).collect()}
    assert sorted(got) == list(range(302)) and {r.n_readings for r in got.values()} >= {0, 1}
    assert all((r.shard is None) == (r.place is None) == (r.n_readings == 0) == (r.taken == 0) for r in got.values())


def test_mix_meets_targets_and_agrees_on_reruns(spark, corpus, tmp_path):
    plan = mixing.mix(corpus, shards=4, block_words=64).select("doc_id", "source", "size", "target", F.expr(mixing.TAKEN).alias("taken"), "readings")
    rows = plan.collect()
    taken, shard_of, owned = defaultdict(int), {}, defaultdict(Counter)
    for r in rows:
        taken[r.source, r.target] += r.taken
        assert r.taken <= 3 * r.size and [x.epoch for x in r.readings] == list(range(len(r.readings)))
        assert all(0 < x.n_words <= r.size for x in r.readings) and sum(x.n_words < r.size for x in r.readings) <= 1
        for x in r.readings:
            assert shard_of.setdefault((r.source, x.block), x.shard) == x.shard
    for (_, target), n in taken.items():
        assert abs(n - target) < 1
    # the blocks that hold a start keep to the tree's quotas, and a shard's blocks aren't neighbours
    for (source, block), shard in shard_of.items():
        owned[source][shard] += 1
    sources = sorted({s for s, _ in taken})
    quotas = mixing.split_quotas([-(-int(t + 1e-6) // 64) for t in (next(t for s, t in taken if s == x) for x in sources)], 4, mixing.SEED)
    for i, source in enumerate(sources):
        assert all(owned[source][k] <= quotas[k][i] for k in range(4))
        runs = [shard for (s, _), shard in sorted(shard_of.items()) if s == source]
        assert sum(a != b for a, b in zip(runs, runs[1:], strict=False)) > len(runs) // 2
    assert sorted((r.doc_id, r.taken, r.readings) for r in rows) == sorted((r.doc_id, r.taken, r.readings) for r in plan.collect())
    wider = mixing.mix(corpus, shards=7, block_words=100).select("doc_id", F.expr(mixing.TAKEN).alias("taken"))
    assert {(r.doc_id, r.taken) for r in rows} == {(r.doc_id, r.taken) for r in wider.collect()}
    path = str(tmp_path / "shards")
    mixing.write_shards(corpus, path, shards=4, block_words=64)
    written = spark.read.parquet(path)
    words = written.groupBy("source").agg(F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))).alias("n")).collect()
    assert {r.source: r.n for r in words} == {s: n for (s, _), n in taken.items()}
    want = Counter((x.shard, x.place, r.doc_id) for r in rows for x in r.readings)
    assert Counter((r.shard, r.place, r.doc_id) for r in written.collect()) == want


def test_block_permutation():
    for n in (1, 2, 7, 100, 4096):
        a, b = mixing.permutation(n, n)
        assert sorted((a * k + b) % n for k in range(n)) == list(range(n))


def test_shards_balance_and_keep_groups(spark, corpus):
    rows = sharding.shard(corpus, shards=5).collect()
    loads, slots, of_text = Counter(), defaultdict(list), defaultdict(set)
    for r in rows:
        loads[r.shard] += r.size
        slots[r.shard].append(r.slot)
        of_text[r.text_crc32].add(r.shard)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert max(loads.values()) < 1.1 * min(loads.values())
    assert all(len(s) == 1 for s in of_text.values())
    t = {r.doc_id: r.text for r in corpus.collect()}
    assert all(r.text_crc32 == zlib.crc32(t[r.doc_id].encode()) and r.size == len(t[r.doc_id].encode()) + 8 for r in rows)
    hot = spark.createDataFrame([(i, "hot text " * 20 if i % 3 == 0 else f"text {i} " * 20) for i in range(900)], "doc_id long, text string")
    sizes = Counter()
    for r in sharding.shard(hot, shards=6).collect():
        sizes[r.shard] += r.size
    assert max(sizes.values()) < 1.15 * min(sizes.values())


def test_ring_moves_little():
    loads = [random.Random(1).randint(50, 150) for _ in range(2000)]
    a, _, have = sharding.ring_walk(loads, [], 10, 64, 0.02, 7)
    b, _, _ = sharding.ring_walk(loads, [], 11, 64, 0.02, 7)
    assert max(have) <= sum(loads) / 10 * 1.02
    assert sum(x != y for x, y in zip(a, b, strict=True)) < 0.45 * len(loads)


@pytest.mark.parametrize("n", [0, 1, 127, 128, 129, 5000])
@pytest.mark.parametrize("top", [2, 300, 50257, 1 << 40, 1 << 63])
def test_simple8b_round_trip(n, top):
    ids = np.random.default_rng(n).integers(0, top, n, dtype=np.uint64)
    words, offsets = simple8b.encode(ids)
    assert (simple8b.decode(words, offsets, n) == ids).all()


def test_token_index_equals_the_library(spark, corpus, awkward):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokens.default_tokenizer())
    docs = corpus.unionByName(docs_of(spark, [(100_000, "x <|endoftext|> y  z\n\n q", "en", "a"), (100_001, None, "en", "a")]))
    start = 0
    got = {r.doc_id: r for r in tokens.token_index(docs, tokens.default_tokenizer()).collect()}
    for r in sorted(docs.collect(), key=lambda r: r.doc_id):
        ids = [*tok.encode(r.text or "", add_special_tokens=False).ids, 2]
        g = got[r.doc_id]
        assert (g.start, g.n_tokens, g.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_units_with_a_nul_equal_the_library():
    enc = encoder.UnitEncoder(tokens.default_tokenizer())
    for text in ("x \0y", "\0y", "x y\0 z", "\0", "x \0 y", "x \0\0y\n\0z"):
        assert enc.encode(text) == np.array(enc.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_chunks_equal_the_library():
    """Random texts of letters, marks, scripts, digits and all kinds of white space, with a small and a large memory."""
    import pyarrow as pa

    rng = random.Random(12)
    pieces = ["word", "Wort,", "été.", "naïve!!", "ß", "x\ny", "end.\nNew", "\n", "\n\n", " ", "  ", "\t", "it's", "'s", "12.50", "a1b2", "…", "“quote”", "слово",
              "語", "🙂", "\u00a0", "\u2003", "\u3000", "\0", "<|endoftext|>", "_", "x_", "--", "×", "é×.", "\r\n", "don't.", "(ok)", "ʼ", "ŉ.", "\x85", "\x1c"]
    texts = ["".join(rng.choice(pieces) + rng.choice(["", " ", " ", "\n"]) for _ in range(rng.randrange(9))) for _ in range(4000)]
    texts += [None, "", " ", "\n", "a", "\na", "a\n", " a", "a "]
    for memory in (50, 100_000):
        enc = encoder.ChunkEncoder(tokens.default_tokenizer(), 2, memory)
        for _ in range(2):
            for a, _, data, offsets in textvec.text_chunks(pa.array(texts), 5000):
                ids, counts = enc.encode(data, offsets)
                ends = np.cumsum(counts)
                for i, (end, n) in enumerate(zip(ends, counts, strict=True)):
                    want = enc.units.tok.encode(texts[a + i] or "", add_special_tokens=False).ids
                    assert ids[end - n : end].tolist() == [*want, 2], texts[a + i]


def brute_sets(rows, k):
    out = {}
    for i, t in rows:
        w = WORD.findall((t or "").translate(LOWER))
        out[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    return out


@pytest.mark.parametrize(("k", "percent", "options"), [(4, 85, {}), (5, 80, {}), (3, 60, {"hot": 2, "block": 4, "nearest_turns": 1})])
def test_ngram_join_equals_brute_force(corpus, k, percent, options):
    """The third case has several buckets for an n-gram and several blocks for a cluster."""
    rows = [(r.doc_id, r.text) for r in corpus.collect()]
    sets = brute_sets(rows, k)
    low = {i: i for i in sets}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    for _ in range(len(sets)):
        before = dict(low)
        for a, b in links:
            low[a] = low[b] = min(low[a], low[b])
        if low == before:
            break
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_join(corpus, k, percent, **options).collect()}
    assert links and got == {i: (len(s), low[i]) for i, s in sets.items()}


def test_substrings_equal_brute_force(corpus):
    rows = sorted((r.doc_id, r.text) for r in corpus.collect())
    seen, want = set(), {}
    for i, t in rows:
        w = WORD.findall(t)
        gone = set()
        for s in range(len(w) - 19):
            window = tuple(w[s : s + 20])
            if window in seen:
                gone.update(range(s, s + 20))
            seen.add(window)
        kept = " ".join(x for p, x in enumerate(w) if p not in gone)
        want[i] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substrings.dedup_substrings(corpus).collect()}
    assert got == want and sum(x[1] for x in want.values()) > 500


@pytest.mark.parametrize("parts", [1, 2])
def test_repeated_rows_are_one_document(spark, parts):
    """Rows equal in id and text, or of one text without id, keep their words, in one batch and in two."""
    text = lambda c, n=40: " ".join(f"{c}{i}" for i in range(n))
    half = [(1, text("a")), (None, text("b")), (2, text("c") + " " + text("a", 25))]
    rows = half + [*half[:2], (3, text("d"))]
    docs = spark.createDataFrame(spark.sparkContext.parallelize(rows, parts), "doc_id long, text string")
    got = sorted(((r.doc_id or 0, r.n_words, r.n_removed) for r in substrings.dedup_substrings(docs).collect()))
    assert got == [(0, 40, 0), (0, 40, 0), (1, 40, 0), (1, 40, 0), (2, 65, 25), (3, 40, 0)]


def test_a_full_sketch_loses_nothing(corpus):
    """With very few cells everything looks repeated, and the result stays the same."""
    rows = corpus.select("doc_id", F.xxhash64("text").alias("key"), "text")
    flat = lambda df: {(r.doc_id, p) for r in df.collect() for x in r.ranges for p in range(x.low, x.high + 1)}
    small = substrings.repeated_words(rows, cells=256, bloom=1 << 10)
    assert flat(small) == flat(substrings.repeated_words(rows))


def test_near_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 16))
    x[50:90] = x[50] + rng.normal(size=(40, 16)) * 0.12
    x[100:110] = x[100] * 3
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    bad = [(1000, None), (1001, [0.0] * 16), (1002, [None, *[1.0] * 15]), (1003, [float("nan")] * 16), (1004, [1.0, 2.0]), (1005, []), (None, rows[0][1])]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>")
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    near = unit @ unit.T >= 0.95
    np.fill_diagonal(near, False)
    got = {r.vec_id: r for r in embeddings.near_vectors(df, block=16).collect()}
    found = sum(got[i].n_links for i in range(400))
    assert all(got[i].n_links <= near[i].sum() for i in range(400)) and found >= 0.97 * near.sum() > 0
    assert {got[i].component_id for i in range(100, 110)} == {100}
    assert all(got[i].n_links == 0 and got[i].kept for i in range(1000, 1006)) and not got[None].kept


def test_equal_vectors_are_one_class(spark):
    """A third of the vectors are equal, some others near them; every link counts."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(9000, 16))
    x[::3] = x[0]
    x[1:61:3] = x[0] + rng.normal(size=(20, 16)) * 0.05
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    got = {r.vec_id: r for r in embeddings.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    want = [int((unit @ unit[i] >= 0.95).sum()) - 1 for i in range(9000)]
    assert all(got[i].n_links <= want[i] for i in range(9000)) and sum(got[i].n_links for i in range(9000)) >= 0.99 * sum(want)
    assert all(got[i].n_links == want[i] for i in range(0, 9000, 3)) and {got[i].component_id for i in [*range(0, 9000, 3), *range(1, 61, 3)]} == {0}
    assert not got[3].kept and got[0].kept


def test_leaks_are_found_and_clean_texts_left(spark, corpus):
    rng = random.Random(9)
    items = [" ".join(f"w{rng.randrange(4000)}" for _ in range(rng.choice([12, 25, 40]))) for _ in range(20)]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    rows = [(500_000 + i, f"before it {t.upper()} and after.", "en", "a") for i, t in enumerate(items)]
    near = items[3].split()
    near[0] = "changed"
    rows.append((600_000, "x y z " + " ".join(near), "en", "a"))
    docs = corpus.unionByName(docs_of(spark, rows))
    got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.leaks(docs, bench).collect()}
    assert {k for k in got if k[0] < 600_000} == {(500_000 + i, i) for i in range(20)}
    assert all(got[500_000 + i, i] == 1 for i in range(20)) and (len(near) < 15 or (600_000, 3) in got)
    kept = {r.doc_id for r in decontaminate.clean(docs, bench).collect()}
    assert {r.doc_id for r in corpus.collect()} <= kept and not kept & {k[0] for k in got}


def test_licences_by_brute_force(spark, corpus):
    lines = ["Released under the MIT License.", "Licensed under the Apache License, Version 2.0.", "Licensed under CC BY-NC 4.0.",
             "This work is licensed under the GNU General Public License, version 3."]
    names = ["MIT", "Apache-2.0", "CC-BY-NC-4.0", "GPL-3.0"]
    texts = [r.text for r in corpus.collect()]
    rows = [(700_000 + i, texts[i] + "\n" + lines[i % 4] + "\n" + texts[-i - 1], "en", "a") for i in range(40)]
    docs = corpus.unionByName(docs_of(spark, rows))
    got = {(r.doc_id, r.license) for r in licenses.scan(docs).collect()}
    assert got == {(700_000 + i, names[i % 4]) for i in range(40)}


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    scored = quality.score(docs, quality.train(docs, labels), "doc_id").join(labels, "doc_id").where(held % 3 == 1)
    r = scored.agg(F.avg(((F.col("score") >= 0.5).cast("int") == F.col("quality")).cast("int")).alias("a"), F.count("*").alias("n")).first()
    assert r.a > 0.93 and r.n > 50
    out = language.identify(docs, language.train(docs), "doc_id", "lang").where(held % 4 == 2)
    assert out.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97


def test_code_lengths_are_probabilities():
    """They sum to one, less what an escape wastes where no byte is left to escape to."""
    counts = np.random.default_rng(1).integers(0, 3, (5, 5, 5))
    counts[0, 0] = 0
    total = np.exp2(-language.code_lengths(counts)).sum(-1)
    assert (total <= 1 + 1e-9).all() and (total > 0.5).all()
    few = np.zeros((5, 5, 5), np.int64)
    few[1, 2, 3] = 4
    assert np.allclose(np.exp2(-language.code_lengths(few)).sum(-1), 1)
    assert language.code_lengths(few)[1, 2, 3] == pytest.approx(np.log2(5 / 4))


def test_code_lengths_equal_brute_force():
    """Every byte value counts, at several depths."""
    rng = np.random.default_rng(3)
    text, new = rng.integers(0, 256, 3000).astype(np.uint8), np.concatenate([rng.integers(0, 256, 200), [7] * 50]).astype(np.uint8)
    text[500:1500] = rng.integers(100, 104, 1000)
    for order in (0, 2, 3):
        seen = defaultdict(Counter)
        before = lambda b, i, k: bytes(order)[: max(0, k - i)] + b[max(0, i - k) : i]  # noqa: B023, E731
        for i in range(len(text)):
            for k in range(order + 1):
                seen[before(text.tobytes(), i, k)][text[i]] += 1
        want = 0.0
        for i, byte in enumerate(new):
            out = set()
            for k in range(order, -1, -1):
                left = {s: n for s, n in seen[before(new.tobytes(), i, k)].items() if s not in out}
                total = sum(left.values()) + len(left)
                if byte in left:
                    want += np.log2(total / left[byte])
                    break
                want += np.log2(total / len(left)) if left else 0
                out |= set(left)
            else:
                want += np.log2(max(1, 256 - len(out)))
        codes, n = np.unique(language._codes(text, np.array([0, len(text)]), order), return_counts=True)
        model = language.LanguageModel([("a", int(c), int(k)) for c, k in zip(codes, n, strict=True)], order)
        assert model.bits(new, np.array([0, len(new)]))[0, 0] == pytest.approx(want)


def test_a_rare_script_keeps_its_languages(spark):
    """Two languages that differ in their lead bytes only, a hundredth of the corpus, stay apart."""
    rng = random.Random(5)
    letters = lambda a, n: [chr(a + i) for i in range(n)]
    of = {"latin": letters(0x21, 94), "han": letters(0x4E00, 6000), "greek": letters(0x391, 16), "cyrillic": letters(0x411, 16)}
    word = lambda lang: "".join(rng.choice(of[lang]) for _ in range(6))
    names = ["latin"] * 1200 + ["han"] * 800 + ["greek"] * 10 + ["cyrillic"] * 10
    rows = [(i, " ".join(word(lang) for _ in range(30)), lang) for i, lang in enumerate(names)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    got = language.identify(docs, language.train(docs), "lang").where("lang IN ('greek', 'cyrillic')").collect()
    assert len(got) == 20 and all(r.lang == r.lang_pred and r.score > 0.99 for r in got)


def test_pipeline_stages_take_effect(spark, tiny):
    import corpus_pipeline as p

    docs, seen = spark.read.parquet(f"{tiny}/documents.parquet"), []
    for _, f in p.STAGES[:-1]:
        docs = p.stage(f(spark, docs, tiny), "test")
        assert docs.columns == p.COLUMNS
        seen.append(docs.count())
    assert seen[0] > seen[1] >= seen[2] > 0 and seen[3] > 0
    assert p.STAGES[-1][1](spark, docs, tiny).count() == seen[3]


def test_encoder_needs_little_memory_beside_its_units():
    import tracemalloc

    import pyarrow as pa
    from lotwise.llm import tokens
    from lotwise.llm.encoder import ChunkEncoder
    from lotwise.llm.textvec import text_chunks

    column = pa.array(["some words of a text, and more of them " * 40] * 2000)
    enc = ChunkEncoder(tokens.default_tokenizer(), 2)
    tracemalloc.start()
    for _, _, data, offsets in text_chunks(column, tokens.CHUNK):
        enc.encode(data, offsets)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60 << 20
