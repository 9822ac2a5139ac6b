"""Corpus operators against brute force, on tables with nulls, empty and long texts, ties, repeats and clashing columns."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from conftest import compare
from pyspark.sql import functions as F

from strandline.llm import common, counting, exact, jaccard, mixing, packing, quality, registry, sharding, substrings, tokens, tokenstore, vectors, words
from strandline.session import ship_package

WORD = re.compile("[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def corpus(seed=0, n=60):
    """Texts with shared passages, near copies, exact copies, blanks, nulls and repeats."""
    rng = random.Random(seed)
    word = lambda: rng.choice(["the", "of", "And", "naïve", "x1", "dog,", "日本", "tree", "runs"]) + (str(rng.randint(0, 60)) if rng.random() < 0.8 else "")
    passage = [word() for _ in range(70)]
    rows = []
    for i in range(n):
        kind = rng.random()
        body = [word() for _ in range(rng.choice([1, 3, 6, 40, 90, 200]))]
        if kind < 0.25 and rows:
            body = (rng.choice(rows)[1] or "a").split()
            for _ in range(rng.randint(0, 4)):
                body[rng.randrange(len(body))] = word()
        elif kind < 0.45:
            cut = rng.randrange(len(body) + 1)
            body[cut:cut] = passage[rng.randint(0, 10) : 60 + rng.randint(0, 10)]
        rows.append((i, rng.choice([" ", "  ", "\n"]).join(body)))
    rows += [(1000, None), (1001, ""), (1002, " \t\n"), (1003, "one"), (1004, "ONE"), (1005, "word " * 3000), (1006, "Word " * 3000), (7, rows[7][1]), (None, rows[8][1]), (None, None)]
    return [(d, t, f"src{(d or 0) % 3}" if d != 1003 else None, "x", 1, 2, "k") for d, t in rows]


SCHEMA = "doc_id long, text string, source string, lang string, size int, shard int, digest string"


@pytest.fixture(scope="module")
def docs(spark):
    ship_package(spark)
    rows = corpus()
    return rows, spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def listed(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_oracle(spark, oracle, small_data, name):
    compare(registry.QUERIES[name](spark, small_data), oracle, registry.ORACLES[name])


def test_word_kernel():
    import pyarrow as pa

    texts = [t for _, t, *_ in corpus(3)]
    got, seen = [], {}
    for _, w in words.slices(pa.array(texts), lower=True):
        for d in range(len(w.count)):
            span = range(w.first[d], w.first[d + 1])
            got.append([w.data[w.start[i] : w.end[i]].tobytes().decode() for i in span])
            for i, word in zip(span, got[-1]):
                assert seen.setdefault(word.translate(LOWER), w.hash[i]) == w.hash[i]
    assert got == [WORD.findall(t or "") for t in texts] and len(set(seen.values())) == len(seen)


def test_mix(docs, empty):
    rows, df = docs
    out = mixing.mix_sources(df).collect()
    assert len(out) == len(rows)
    by, took = {}, {}
    for r in out:
        assert r["taken"] in (0, r["size"], 2 * r["size"], 3 * r["size"])
        by[r["src"]] = (r["source_size"], r["target"])
        took[r["src"]] = took.get(r["src"], 0) + r["taken"]
    assert sum(t for _, t in by.values()) == pytest.approx(sum(s for s, _ in by.values()))
    assert all(t <= 3 * s + 1e-6 for s, t in by.values())
    largest = max(r["size"] for r in out) * 2
    assert all(abs(took[k] - by[k][1]) <= largest for k in by)
    assert listed(mixing.mix_sources(df.repartition(5)), "doc_id", "size", "taken") == listed(mixing.mix_sources(df), "doc_id", "size", "taken")
    assert mixing.mix_sources(empty).count() == 0
    mixed = mixing.take_mixed(df)
    assert mixed.columns == df.columns and mixed.count() == sum(r["copies"] for r in out)


def test_exact(docs, empty):
    rows, df = docs
    groups = {}
    for d, t, *_ in rows:
        groups.setdefault((t or "").translate(LOWER), []).append(d)
    got = exact.exact_dedup(df, digest_all=True).collect()
    assert len(got) == len(rows)
    kept = {}
    for r in got:
        kept[r["digest"]] = kept.get(r["digest"], 0) + r["kept"]
    for text, ids in groups.items():
        sha = hashlib.sha256(text.encode()).hexdigest()
        best = max((i for i in ids if i is not None), default=None)
        assert kept[sha] == 1 and {(r["keep_id"], r["group_size"]) for r in got if r["digest"] == sha} == {(best, len(ids))}
    assert exact.exact_dedup(empty).count() == 0
    left = exact.drop_exact_copies(df)
    assert left.columns == df.columns and left.count() == len(groups)


def test_exact_beyond_the_broadcast_bound(docs, monkeypatch):
    rows, df = docs
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(exact, "maybe_broadcast", lambda df: df)
    assert exact.exact_dedup(df).filter("kept").count() == len({(t or "").translate(LOWER) for _, t, *_ in rows})


@pytest.mark.parametrize("bits", [(22, 24), (6, 6)])
def test_refinement_settles_rows_step_by_step(spark, monkeypatch, bits):
    monkeypatch.setattr(exact, "LENGTH_BITS", bits[0])
    monkeypatch.setattr(exact, "PREFIX_BITS", bits[1])
    long = "x" * 100
    rows = [(1, "alone"), (2, long + "a"), (3, long + "b"), (4, "y" + long), (5, "Same"), (6, "sAME"), (7, None), (8, ""), (9, "z" * 300)]
    got = {r["doc_id"]: r["candidate"] for r in exact.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    must, may = {2, 3, 5, 6, 7, 8}, {1, 4, 9}
    assert {k for k, v in got.items() if v} >= must and (bits[0] == 6 or not any(got[k] for k in may))
    kept = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in exact.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == {1: (1, 1), 2: (2, 1), 3: (3, 1), 4: (4, 1), 5: (6, 2), 6: (6, 2), 7: (8, 2), 8: (8, 2), 9: (9, 1)}


def brute_components(rows, size=5):
    sets = []
    for d, t, *_ in rows:
        w = WORD.findall((t or "").translate(LOWER))
        sets.append({tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, *_) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(s), least.get(find(i)) if s else d) for i, ((d, *_), s) in enumerate(zip(rows, sets))), key=str)


@pytest.mark.parametrize("frequent, growth", [(16, 4), (2, 2)])
def test_jaccard(docs, empty, monkeypatch, frequent, growth):
    rows, df = docs
    monkeypatch.setattr(jaccard, "FREQUENT_MIN", frequent)
    monkeypatch.setattr(jaccard, "GROWTH", growth)
    assert listed(jaccard.jaccard_components(df), "doc_id", "n_shingles", "component_id") == brute_components(rows)
    assert jaccard.jaccard_components(empty).count() == 0


def test_keep_one(docs):
    rows, df = docs
    ids = {r["doc_id"] for r in jaccard.keep_one(df).collect()}
    assert {c for _, n, c in brute_components(rows) if n and c is not None} <= ids and jaccard.keep_one(df).columns == df.columns


def brute_removed(rows, size=50):
    texts = [(d, WORD.findall(t or "")) for d, t, *_ in rows]
    least = {}
    for d, w in texts:
        for i in range(len(w) - size + 1):
            if d is not None:
                key = tuple(w[i : i + size])
                least[key] = min(d, least.get(key, d))
    out = []
    for d, w in texts:
        gone = set()
        for i in range(len(w) - size + 1):
            if d is not None and least[tuple(w[i : i + size])] < d:
                gone.update(range(i, i + size))
        out.append((d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out, key=str)


@pytest.mark.parametrize("limit", [60_000, 1])
def test_substrings(docs, empty, monkeypatch, limit):
    rows, df = docs
    monkeypatch.setattr(substrings, "SHARD_WORDS", limit)
    assert listed(substrings.remove_repeats(df), "doc_id", "n_words", "n_removed", "kept") == brute_removed(rows)
    assert substrings.remove_repeats(empty).count() == 0


def test_suffix_automaton():
    rng = random.Random(2)
    texts = [([rng.randint(0, 2) for _ in range(rng.randint(3, 40))], d) for d in range(12)]
    automaton = substrings.SuffixAutomaton()
    for t, d in texts:
        automaton.add(t, d)
    automaton.finish()
    for t, _ in texts:
        want = [min(d for u, d in texts if any(u[j : j + 4] == t[i : i + 4] for j in range(len(u) - 3))) for i in range(len(t) - 3)]
        assert automaton.statistics(t, 4) == want


def encode(text):
    from tokenizers import Tokenizer

    encode.tokenizer = getattr(encode, "tokenizer", None) or Tokenizer.from_file(tokens.tokenizer_path("word_bpe_49k.json"))
    return encode.tokenizer.encode(text or "", add_special_tokens=False).ids


ODD = ["it's We'll a'. x's! 'S", "á b̧́ é Å", "one two three\x1cfour", "<|endoftext|> a<|startoftext|>b <|endof text|>", "İstanbul ΣΑΣ ß", "…—¿? 12.5% a1b2", "́ ̧x ᄀ ᅡ", "end. \n\n end.\r\nend", "a\u0000b", "🙂🙂 🙂!"]


def test_piece_ids_equal_the_library():
    ids = tokens.PieceIds(tokens.tokenizer_path("word_bpe_49k.json"))
    for text in ODD + [t for _, t, *_ in corpus(4)] + [" ".join(ODD)]:
        assert np.frombuffer(ids.encode(text), "<u4").tolist() == encode(text), text


def test_piece_ids_round_combining_marks():
    import unicodedata

    ids = tokens.PieceIds(tokens.tokenizer_path("word_bpe_49k.json"))
    encode("")
    chars = [chr(c) for c in range(0x20, 0x3000)]
    marks = [c for c in chars if unicodedata.combining(unicodedata.normalize("NFC", c.lower())[-1])]
    texts = [head + mark + tail for mark in marks for tail in ".,;:!?#$%&*" for head in ("", "a")]
    rng = random.Random(8)
    texts += ["".join(rng.choice([rng.choice(marks), rng.choice(chars), rng.choice("abAZ.,!?$&*' \n\t")]) for _ in range(rng.randint(1, 12))) for _ in range(20_000)]
    for text, want in zip(texts, encode.tokenizer.encode_batch(texts, add_special_tokens=False)):
        assert np.frombuffer(ids.encode(text), "<u4").tolist() == want.ids, ascii(text)


def test_packing(docs, empty):
    rows, df = docs
    capacity = 64
    out = packing.pack(packing.token_pieces(df, capacity), capacity).collect()
    whole = sorted((str(d), str(encode(t) + [0])) for d, t, *_ in rows)
    by = {}
    for r in out:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    assert sum(r["length"] for r in out) == sum(len(encode(t)) + 1 for _, t, *_ in rows)
    crcs = sorted((str(d), i // capacity, zlib.crc32(np.array(ids[i : i + capacity], "<u4").tobytes())) for (d, t, *_) in rows for ids in [encode(t) + [0]] for i in range(0, len(ids), capacity))
    assert sorted((str(r["doc_id"]), r["piece"], r["ids_crc32"]) for r in out) == crcs
    least = -(-sum(r["length"] for r in out) // capacity)
    assert whole and least <= len(by) <= 1.25 * least + 1
    assert packing.pack(packing.token_pieces(empty, capacity), capacity).count() == 0


def test_sweep_matches_successors_by_rank(spark):
    rng = random.Random(6)
    for trial in range(4):
        rows = [(i, rng.choice([3, 3, 5, 8, rng.randint(1, 40)]), False) for i in range(60)] + [(i, rng.randint(1, 30 + 10 * trial), True) for i in range(45)]
        waiting, want = [], {}
        for i, size, gap in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
            if not gap:
                waiting.append((i, size))
            elif waiting:
                want[i] = waiting.pop()
        got = packing.sweep(spark.createDataFrame(rows, "id long, size int, gap boolean").repartition(3)).collect()
        mates = {r["id"]: (r["mate"], r["mate_size"]) for r in got if r["gap"] and r["mate"] is not None}
        back = {r["mate"]: r["id"] for r in got if not r["gap"] and r["mate"] is not None}
        assert len(got) == 105 and {g: s for g, (_, s) in mates.items()} == {g: s for g, (_, s) in want.items()}
        assert back == {g: m for g, (m, _) in mates.items()} and len(set(back.values())) == len(back)


def test_packing_of_many_short_and_many_long_pieces(spark):
    rng = random.Random(3)
    for sizes in ([rng.randint(1, 3) for _ in range(900)] + [90] * 3, [rng.randint(51, 60) for _ in range(40)] + [100] * 9, [1] * 2000, [100] * 30, [rng.randint(1, 100) for _ in range(300)]):
        df = spark.createDataFrame([(i, n) for i, n in enumerate(sizes)], "doc_id long, length long")
        by, got = {}, packing.pack(df, 100).collect()
        for r in got:
            by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        for parts in by.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= 100
        least = max(-(-sum(sizes) // 100), sum(n > 50 for n in sizes))
        assert len(got) == len(sizes) and len(by) <= 1.1 * least + 2



def test_sharding(docs, spark):
    _, df = docs
    out = sharding.assign_shards(df)
    assert out.count() == df.count() and out.filter("shard < 0 OR shard >= 64").count() == 0
    names = [f"s{i}" for i in range(7)]
    table = sharding.fill_table(names, 10_007)
    counts = np.bincount(table)
    assert counts.max() - counts.min() <= 1
    fewer = sharding.fill_table(names[:-1], 10_007)
    moved = sum(a != b for a, b in zip(table, fewer) if a != 6)
    assert moved < 0.25 * 10_007
    with pytest.raises(ValueError):
        sharding.fill_table(names, 10_000)


def test_sharding_by_an_independent_hash(docs, empty, spark):
    import xxhash

    rows, df = docs
    slots, names = 101, ["a", "b", "c"]
    orders = []
    for n in names:
        digest = hashlib.sha256(n.encode()).digest()
        start, step = int.from_bytes(digest[:8], "little") % slots, int.from_bytes(digest[8:16], "little") % (slots - 1) + 1
        orders.append([(start + i * step) % slots for i in range(slots)])
    owner, turn = {}, 0
    while len(owner) < slots:
        owner[next(x for x in orders[turn % 3] if x not in owner)] = turn % 3
        turn += 1
    assert sharding.fill_table(names, slots) == [owner[i] for i in range(slots)]
    out = sharding.assign_shards(df, names=names, slots=slots)
    assert len(out.columns) == len(set(out.columns)) == len(df.columns) + 1 and out.count() == len(rows)
    for r in out.select("doc_id", "slot", "shard").collect():
        key = 42 if r["doc_id"] is None else xxhash.xxh64_intdigest(r["doc_id"].to_bytes(8, "little", signed=True), 42)
        key -= (key >> 63) << 64
        assert r["slot"] == key % slots and r["shard"] == owner[r["slot"]]
    assert sharding.assign_shards(empty).count() == 0


def test_counts(docs, empty):
    from sentencepiece import SentencePieceProcessor

    rows, df = docs
    model = SentencePieceProcessor(model_file=tokens.tokenizer_path("piece_bpe_32k.model"))
    got = counting.count_tokens(df, chunk=200, overlap=12)
    want = sorted(((d, len((t or "").encode()), len(model.encode(t or ""))) for d, t, *_ in rows), key=str)
    assert listed(got, "doc_id", "n_bytes", "n_tokens") == want and got.agg(F.max("chunks")).first()[0] > 1
    assert counting.count_tokens(empty).count() == 0


def test_counts_without_stable_boundaries(spark):
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=tokens.tokenizer_path("piece_bpe_32k.model"))
    texts = ["a" * 5000, "漢字仮名" * 700, " " * 3000, "ab\n" * 1500, "<s></s> <unk>" * 300, "é" * 2500]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["n_tokens"] for r in counting.count_tokens(df, chunk=500, overlap=20).collect()}
    assert got == {i: len(model.encode(t)) for i, t in enumerate(texts)}


def test_token_store(docs, empty, spark, tmp_path):
    rows, df = docs
    tokenstore.write_tokens(df, str(tmp_path / "t"), block_tokens=500)
    got = sorted(tokenstore.read_tokens(spark, str(tmp_path / "t")).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == sorted((d for d, *_ in rows), key=lambda d: (d is not None, d or 0))
    at, texts = 0, {}
    for d, t, *_ in rows:
        texts.setdefault(d, set()).add(zlib.crc32(np.array(encode(t) + [1], "<u4").tobytes()))
    for r in got:
        assert r["start"] == at and r["ids_crc32"] in texts[r["doc_id"]]
        at += r["n_tokens"]
    tokenstore.write_tokens(empty, str(tmp_path / "e"))
    assert tokenstore.read_tokens(spark, str(tmp_path / "e")).count() == 0


def test_long_pieces_of_text_and_small_slices(monkeypatch):
    rng = random.Random(11)
    texts = [" ".join(rng.choice(["word", "Naïve,", "x1.", "\n", "", "日本!"]) + str(rng.randint(0, 99)) for _ in range(n)) for n in (0, 1, 400, 3000)] + [None, "a" * 3000]
    ids = tokens.PieceIds(tokens.tokenizer_path("word_bpe_49k.json"))
    monkeypatch.setattr(tokens, "SLICE", 2000)
    monkeypatch.setattr(tokens, "STRETCH", 700)
    assert [np.frombuffer(ids.encode(t), "<u4").tolist() for t in texts] == [encode(t) for t in texts]


def test_very_long_texts_at_default_sizes(spark, tmp_path):
    from sentencepiece import SentencePieceProcessor

    rng = random.Random(12)
    word = lambda: rng.choice(["river", "Naïve,", "x1.", "\n\n", "日本語テキスト", "🙂", "   ", "open%"]) + str(rng.randint(0, 999))
    rows = [(1, " ".join(word() for _ in range(60_000)), "s", "en"), (2, "z" * 150_000, "s", "en"), (3, None, None, None), (4, "short", "s", "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    model = SentencePieceProcessor(model_file=tokens.tokenizer_path("piece_bpe_32k.model"))
    got = {r["doc_id"]: r for r in counting.count_tokens(df).collect()}
    assert {d: (r["n_bytes"], r["n_tokens"]) for d, r in got.items()} == {d: (len((t or "").encode()), len(model.encode(t or ""))) for d, t, *_ in rows}
    assert got[1]["chunks"] > 1
    tokenstore.write_tokens(df, str(tmp_path / "t"))
    read = {r["doc_id"]: r["ids_crc32"] for r in tokenstore.read_tokens(spark, str(tmp_path / "t")).collect()}
    assert read == {d: zlib.crc32(np.array(encode(t) + [1], "<u4").tobytes()) for d, t, *_ in rows}
    known = spark.createDataFrame([(4, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    assert quality.score_documents(df, known).count() == 4
    pieces = packing.pack(packing.token_pieces(df)).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert {r["doc_id"]: r["n"] for r in pieces} == {d: len(encode(t)) + 1 for d, t, *_ in rows}


def test_elias_fano():
    rng = np.random.default_rng(1)
    for values in (np.array([0]), np.array([5, 5, 5]), np.sort(rng.integers(0, 10**7, 3000)), np.arange(1, 1000), np.array([2**40])):
        coded = tokenstore.EliasFano.encode(values)
        assert coded.decode().tolist() == values.tolist() and [coded[i] for i in range(len(values))] == values.tolist()
    dense = tokenstore.EliasFano.encode(np.cumsum(rng.integers(1, 600, 10_000)))
    assert dense.nbytes() * 8 / 10_000 < 13


def test_vectors(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(400, 12))
    base[50:90] = base[50]
    rows = [(i, v.tolist()) for i, v in enumerate(base)]
    rows += [(400, None), (450, []), (500, [0.0] * 12), (550, [float("nan")] * 12), (600, [None] * 12), (650, [1.0, 2.0]), (700, [2.0, 4.0]), (3, rows[3][1])]
    df = vectors.valid_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = vectors.search(vectors.build_index(df, shard=150), df.filter("vec_id % 50 = 0")).collect()
    hits = total = 0
    for q in range(0, 400, 50):
        sims = [(-float(base[q] @ v / (np.linalg.norm(base[q]) * np.linalg.norm(v))), i) for i, v in enumerate(base) if i != q]
        best = sorted((round(s, 12), i) for s, i in sims)[:5]
        mine = sorted((r["rank"], r["vec_id"]) for r in got if r["query_id"] == q)
        assert [k for k, _ in mine] == [1, 2, 3, 4, 5]
        hits, total = hits + len({i for _, i in best} & {i for _, i in mine}), total + 5
    assert hits / total >= 0.9
    assert [(r["query_id"], r["vec_id"]) for r in got if r["query_id"] in (650, 700)] in ([(650, 700), (700, 650)], [(700, 650), (650, 700)])
    none = vectors.valid_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>"))
    assert vectors.search(vectors.build_index(none), none).count() == 0


def test_extreme_vectors_and_clashing_names(spark):
    pairs = {0: (1e-200, 2e-200), 1: (1e200, 1.0), 2: (3.0, 4.0), 3: (-2e-300, 1e-300), 4: (1e308, 1e308), 50: (5e-324, 1.0), 100: (1.0, 2.0)}
    rows = [(i, [float(x) for x in v], 1, 2, 3, "x") for i, v in pairs.items()]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, shard int, dim int, query_id int, vector string")
    df = vectors.valid_vectors(df)
    got = vectors.search(vectors.build_index(df), df.filter("vec_id % 50 = 0")).collect()

    def cosine(a, b):
        (a, b), (c, d) = ([x / max(map(abs, v)) for x in v] for v in (pairs[a], pairs[b]))
        return (a * c + b * d) / ((a * a + b * b) ** 0.5 * (c * c + d * d) ** 0.5)

    for q in (0, 50, 100):
        want = sorted((-round(cosine(q, i), 12), i) for i in pairs if i != q)[:5]
        mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
        assert [s for s, _ in want] == [-round(s, 12) for _, _, s in mine] and len({i for _, i, _ in mine}) == 5


def test_recall_over_shards_of_the_default_size(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(3500, 64))
    base[:900] = base[0] + rng.normal(size=(900, 64)) * 0.05  # a tight cluster
    rows = [(i, v.tolist()) for i, v in enumerate(base)]
    df = vectors.valid_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    index = vectors.build_index(df)
    assert index.count() == -(-3500 // vectors.SHARD)
    unit = base / np.linalg.norm(base, axis=1, keepdims=True)
    hits = {}
    for r in vectors.search(index, df.filter("vec_id % 50 = 0")).collect():
        hits.setdefault(r["query_id"], set()).add(r["vec_id"])
    found = 0
    for q, mine in hits.items():
        sims = unit @ unit[q]
        sims[q] = -2
        found += len(mine & set(np.argsort(-sims)[:5].tolist()))
    assert len(hits) == 70 and found / 350 >= 0.9


def quality_rows(n=600):
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(n):
        bad, ill = rng.random() < 0.25, rng.random() < 0.15
        body = [rng.choice("alpha beta gamma delta rivers under open".split()) + rng.choice(["", ".", ","]) for _ in range(rng.randint(20, 80))]
        if bad:
            body = [w + "%%%" for w in body]
        if ill:
            body.insert(rng.randrange(len(body)), rng.choice(["vile", "Vile.", "nasty,"]))
        rows.append((i, " ".join(body), f"host{i % 9}", "en"))
        labels.append((i, int(not bad), int(ill)))
    return rows, labels


def test_quality(spark, empty):
    rows, labels = quality_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    known = spark.createDataFrame(labels[:400], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality.score_documents(df, known).collect()}
    held = labels[400:]
    assert sum((got[i]["bad"] > 0.5) == (not q) for i, q, _ in held) / len(held) >= 0.95
    assert sum((got[i]["toxic"] > 0.5) == bool(t) for i, _, t in held) / len(held) >= 0.95
    left = {r["doc_id"] for r in quality.drop_rejected(df, known).collect()}
    assert left == {i for i, r in got.items() if r["keep"]}
    nothing = known.limit(0)
    assert quality.drop_rejected(df, nothing).count() == len(rows)
    odd = spark.createDataFrame([(None, None, None, None), (1, "", "h", None), (1, "", "h", None)], df.schema)
    assert quality.score_documents(odd, known).count() == 3
    assert quality.score_documents(empty, known).count() == 0


def brute_posteriors(rows):
    """Rates and final probabilities of rows (host, path, log odds), recomputed one by one."""
    p = [1 / (1 + np.exp(-x)) for *_, x in rows]
    center = sum(p) / len(p)

    def strength(groups):  # (n, sum, center) of each
        n = sum(g[0] for g in groups)
        between = sum(g[0] * (g[1] / g[0] - g[2]) ** 2 for g in groups) - sum(g[2] * (1 - g[2]) for g in groups)
        if len(groups) < 2 or between / n <= 1e-12:
            return 1e6
        return min(1e6, max(1.0, sum(g[0] * g[2] * (1 - g[2]) for g in groups) / between - 1))

    def sums(keys):
        out = {}
        for k, x in zip(keys, p):
            n, s = out.get(k, (0, 0.0))
            out[k] = (n + 1, s + x)
        return out

    hosts, paths = sums([h for h, *_ in rows]), sums([(h, q) for h, q, _ in rows])
    strong = strength([(n, s, center) for n, s in hosts.values()])
    rate = {h: (s + strong * center) / (n + strong) for h, (n, s) in hosts.items()}
    firm = strength([(n, s, rate[h]) for (h, _), (n, s) in paths.items()])
    logit = lambda x: np.log(x / (1 - x))
    out = []
    for (h, q, x), own in zip(rows, p):
        others = (hosts[h][1] - own + strong * center) / (hosts[h][0] - 1 + strong)
        path = (paths[h, q][1] - own + firm * others) / (paths[h, q][0] - 1 + firm)
        out.append((rate[h], path, 1 / (1 + np.exp(-(x + logit(path) - logit(center))))))
    return center, out


def test_posteriors_by_brute_force(spark):
    """Rates shrink toward the host's and the corpus's; a host with one document stays near the corpus rate, a large one speaks for itself."""
    rng = random.Random(4)
    rows = []
    for i in range(400):
        host = "bad" if i % 4 == 0 else "good" if i % 4 == 1 else None if i % 4 == 2 else f"tiny{i}"
        shift = {"bad": 3.0, "good": -3.0}.get(host, -1.0)
        rows.append((i, host, rng.choice(["x", "y", None]), rng.gauss(shift, 1), rng.gauss(-4, 1)))
    df = spark.createDataFrame(rows, "doc_id long, host string, path string, bad double, ill double")
    got = {r["doc_id"]: r for r in quality.posteriors(df).collect()}
    assert len(got) == 400
    for kind, names in ((3, ("host_rate", "path_rate", "bad")), (4, ("toxic_host_rate", "toxic_path_rate", "toxic"))):
        center, want = brute_posteriors([(r[1], r[2], r[kind]) for r in rows])
        for row, values in zip(rows, want):
            assert [got[row[0]][n] for n in names] == pytest.approx(list(values), rel=1e-6), (row, names)
        if kind == 3:
            own = np.mean([1 / (1 + np.exp(-r[3])) for r in rows if r[1] == "bad"])
            assert all(abs(got[r[0]]["host_rate"] - own) < 0.05 for r in rows if r[1] == "bad")
            lone = [r for r in rows if r[1] and r[1].startswith("tiny")]
            assert all(abs(got[r[0]]["host_rate"] - center) < abs(1 / (1 + np.exp(-r[3])) - center) + 1e-9 for r in lone)


def test_quality_with_clashing_names_and_repeats(spark):
    rows, labels = quality_rows(300)
    schema = "doc_id long, text string, source string, lang string, quality int, toxic int, bad double, host string, path string, h string, n int, tag int, _id int"
    wide = [(*r, 1, 2, 3.0, "h", "p", "q", 4, 5, 6) for r in rows] + [(0, rows[1][1], "s", "en", 1, 2, 3.0, "h", "p", "q", 4, 5, 6)] * 30
    df, known = spark.createDataFrame(wide, schema), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    first, second = ({(r["doc_id"], r["tag"]): r["bad"] for r in quality.score_documents(df.repartition(k), known).collect()} for k in (2, 5))
    assert first.keys() == second.keys() and all(first[k] == pytest.approx(second[k]) for k in first)
    left = quality.drop_rejected(df, known)
    assert left.columns == df.columns and 0 < left.count() < len(wide)


def brute_mix(rows):
    """(row index, copies) of rows (id, source, text) by sorting each source by hash."""
    size = [len(WORD.findall(t or "")) for _, _, t in rows]
    names = sorted({s for _, s, _ in rows}, key=lambda s: (s is None, s or ""))
    total = {s: sum(n for (_, x, _), n in zip(rows, size) if x == s) for s in names}
    weight, capped = {s: (5.0, 2.0, 1.0)[i % 3] for i, s in enumerate(names)}, set()
    while True:
        free = [s for s in names if s not in capped]
        rest = sum(total.values()) - sum(3 * total[s] for s in capped)
        level = rest / sum(weight[s] for s in free) if free else 0.0
        more = {s for s in free if weight[s] * level > 3 * total[s]}
        if not more:
            break
        capped |= more
    target = {s: 3.0 * total[s] if s in capped else weight[s] * level for s in names}
    hashed = lambda d: int(hashlib.sha256(("" if d is None else str(d)).encode()).hexdigest()[:15], 16)
    copies = {}
    for s in names:
        whole = int(target[s] // total[s]) if total[s] else 0
        budget, below = target[s] - whole * total[s], 0
        groups = {}
        for i, (d, x, _) in enumerate(rows):
            if x == s:
                groups.setdefault(hashed(d), []).append(i)
        for h in sorted(groups):
            mass = sum(size[i] for i in groups[h])
            extra = below <= budget and (below + mass <= budget or below + mass - budget < budget - below)
            for i in groups[h]:
                copies[i] = whole + int(extra and size[i] > 0 and mass > 0)
            below += mass
    return copies


def test_pipeline_by_brute_force(spark, tmp_path):
    """run() on a fixture with nulls, empty texts, repeats and extra columns, each stage against brute force on what the one before kept."""
    import corpus_pipeline

    rows, labels = quality_rows(250)
    body = corpus(5, 40)
    rows = [(i, t, s, l) for i, t, s, l in rows] + [(500 + i, t, s, l) for i, (_, t, s, l, *_) in enumerate(body)]
    rows += [(rows[3][0], rows[3][1], "host1", "en"), (None, rows[4][1], "host1", None), (None, None, None, "en"), (900, rows[5][1].upper(), "host2", "en"), (901, rows[6][1] + " tail", "host2", "en")]
    rows = [(*r, 1, "x") for r in rows]
    schema = "doc_id long, text string, source string, lang string, quality int, sequence_id string"
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs, stages = common.table(spark, str(tmp_path), "documents"), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        had = [tuple(r) for r in docs.collect()]
        after = stage(spark, docs, str(tmp_path))
        assert after.columns == docs.columns, name
        docs = spark.createDataFrame(after.collect(), docs.schema)
        stages.append((name, had, [tuple(r) for r in docs.collect()]))
    by = {name: (had, left) for name, had, left in stages}
    had, left = by["quality classifier"]
    verdict = {(r["doc_id"], r["tag"]): r["keep"] for r in quality.score_documents(common.table(spark, str(tmp_path), "documents"), common.table(spark, str(tmp_path), "labels")).collect()}
    tags = {(r["doc_id"], r["text"]): r["t"] for r in common.table(spark, str(tmp_path), "documents").select("doc_id", "text", F.xxhash64("text").alias("t")).collect()}
    assert sorted(left, key=str) == sorted((r for r in had if verdict[r[0], tags[r[0], r[1]]]), key=str) and len(left) < len(had)
    had, left = by["exact dedup"]
    groups = {}
    for r in had:
        groups.setdefault((r[1] or "").translate(LOWER), []).append(r)
    want = sorted((max((-1 if r[0] is None else r[0] for r in g)), t) for t, g in groups.items())
    assert sorted((-1 if r[0] is None else r[0], (r[1] or "").translate(LOWER)) for r in left) == want
    had, left = by["near-duplicate join"]
    kept = sorted({c for _, n, c in brute_components(had) if n and c is not None})
    assert sorted(r[0] for r in left if WORD.findall(r[1] or "") and r[0] is not None) == kept
    had, left = by["mixing sources"]
    want = sorted(str(had[i]) for i, k in brute_mix([(r[0], r[2], r[1]) for r in had]).items() for _ in range(k))
    assert sorted(map(str, left)) == want
    last = [tuple(r) for r in left]
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    pieces = sorted((str(d), i // 2048, min(2048, len(ids) - i), zlib.crc32(np.array(ids[i : i + 2048], "<u4").tobytes())) for d, t, *_ in last for ids in [encode(t) + [0]] for i in range(0, len(ids), 2048))
    assert sorted((str(r["doc_id"]), r["piece"], r["length"], r["ids_crc32"]) for r in packed) == pieces
    room = {}
    for r in sorted(packed, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == room.get(r["sequence_id"], 0)
        room[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(room.values()) <= 2048 and len(room) <= 1.1 * -(-sum(p[2] for p in pieces) // 2048) + 2


def test_pipeline_of_an_empty_table(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
