"""Training-data operators against brute-force versions, exact round trips and held-out accuracy."""

import hashlib
import random
import sys
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from faultline.llm import decontaminate, htmltext, merkle, minhash, packing, pii, suffixdedup, tokencount, toxicity, warc
from faultline.llm.queries import ORACLE_SQL, QUERIES, vocabulary

DOC = "doc_id long, text string, lang string, source string, n_chars long"
SMALL = "/root/testdata/sf0.001"


def words(rng, n):
    return " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta"]) + str(rng.randint(0, 9)) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    """Copies, near copies, shared passages, ties, nulls, empty and very long texts."""
    rng = random.Random(4)
    base = [words(rng, 120) for _ in range(12)]
    out = [None, "", " ", "one two", base[0], base[0], base[0] + " tail", words(rng, 9000)]
    for b in base:
        cut = b.split()
        cut[rng.randrange(len(cut))] = "edited"
        out += [b, " ".join(cut), words(rng, 30) + " " + b[:400] + " " + words(rng, 30)]
    return list(enumerate(out))


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in texts], DOC)


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_near_duplicates_equal_brute_force(docs, texts, monkeypatch):
    want = sorted(minhash.brute_force(texts))
    assert rows(minhash.near_duplicates(docs)) == want
    assert rows(minhash.near_duplicates(docs, bucket_rows=3)) == want
    monkeypatch.setattr(minhash, "BANDS_COPIED", 1)
    assert rows(minhash.near_duplicates(docs, bucket_rows=2)) == want
    kept = {d for d, _, _, k in want if k}
    assert {r.doc_id for r in minhash.deduplicate(docs).collect()} == kept


def test_near_duplicates_between_80_and_85_percent(spark):
    """The pipeline's stage removes near copies at 0.8 or more; op5's 85 keeps those of under 0.85."""
    import corpus_pipeline as p

    cases = []
    for k in range(12):  # four to seven edits: 0.87, 0.84, 0.82 and 0.79
        body = [f"w{k}x{i}" for i in range(300)]
        cases.append((2 * k, " ".join(body)))
        for i in range(4, 4 + 5 * (4 + k % 4), 5):
            body[i] = "other"
        cases.append((2 * k + 1, " ".join(body)))
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in cases], DOC)
    want = {q: {d for d, _, _, kept in minhash.brute_force(cases, q) if kept} for q in (80, 85)}
    assert want[80] < want[85]
    assert {r.doc_id for r in p.near_duplicates_stage(spark, df, SMALL).collect()} == want[80]
    for q in (80, 85):
        assert rows(minhash.near_duplicates(df, percent=q)) == sorted(minhash.brute_force(cases, q))
    assert minhash.agree(85) == 0.65 and minhash.agree(80) == 0.55 and minhash.splits(85) == 2 and minhash.splits(80) == 1


def test_rows_without_or_with_repeated_ids(spark):
    """One row of each group stays, whatever its id; items without id are found; op6 leaves such documents alone."""
    rng = random.Random(21)
    texts = {k: words(rng, 120) for k in "abcdef"}
    near = " ".join([*texts["c"].split()[:-1], "edited"])
    data = [(None, texts["a"]), (5, texts["b"]), (5, texts["b"]), (None, texts["c"]), (7, near), (None, texts["d"]), (None, texts["d"]), (9, texts["e"]), (9, texts["f"]), (None, None), (None, "")]
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in data], DOC).repartition(3)
    got = minhash.deduplicate(df)
    assert got.columns == df.columns
    want = [(None, texts["a"]), (5, texts["b"]), (7, near), (None, texts["d"]), (9, texts["e"]), (9, texts["f"]), (None, None), (None, "")]
    assert sorted(map(repr, ((r.doc_id, r.text) for r in got.collect()))) == sorted(map(repr, want))

    items = [(None, texts["a"][:200]), (3, texts["a"][:200]), (None, texts["b"][:200]), (None, None)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    own = df.where("doc_id is null or doc_id <> 9")
    report = decontaminate.report(decontaminate.find_windows(own, bench))
    assert sorted(map(repr, map(tuple, report.collect()))) == sorted(map(repr, decontaminate.brute_force([(r.doc_id, r.text) for r in own.collect()], items)))
    assert [r.n_items for r in report.where("doc_id = 5").collect()] == [1, 1]
    left = decontaminate.decontaminate(own, bench)
    assert {r.text for r in left.collect()} == {t for _, t in data} - {texts[k] for k in "abef"}

    clean = suffixdedup.deduplicate(df.where("doc_id is null or doc_id = 7")).collect()
    assert len(clean) == 7 and all(r.n_removed == 0 for r in clean)


def test_fine_sketch_loses_no_similar_pair():
    rng = np.random.default_rng(3)
    for n in (1, 7, 40, 300, 2000, 20000):
        kept = []
        for _ in range(60):
            apart = int(n * 0.15 / 1.85)  # what each set may have on its own at 0.85
            pool = rng.integers(0, 2**64, n + apart, dtype=np.uint64)
            a, b = np.unique(pool[:n]), np.unique(pool[apart:])
            assert minhash.similar(set(a.tolist()), set(b.tolist()))
            fine = minhash.unpacked([minhash.fine_sketch(a).tobytes(), minhash.fine_sketch(b).tobytes()])
            kept.append(minhash.likely(fine[:1], fine[1], np.array([len(a) + len(b)]))[0])
            c = np.unique(np.concatenate([pool[: n // 2], rng.integers(0, 2**64, n - n // 2, dtype=np.uint64)]))
            far = minhash.unpacked([minhash.fine_sketch(c).tobytes()])
            assert n < 300 or not minhash.likely(fine[:1], far[0], np.array([len(a) + len(c)]))[0]
        assert all(kept)


def test_substring_dedup_equals_brute_force(spark, docs, texts):
    want = suffixdedup.brute_force(texts)
    assert rows(suffixdedup.deduplicate(docs).drop("kept")) == want
    table = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert rows(suffixdedup.deduplicate(table, kept=False)) == suffixdedup.brute_force([(r.doc_id, r.text) for r in table.collect()])
    for hot, strings in ((3, 5), (1, 2)):  # anchors dealt by windows, collections of a few strings
        assert rows(suffixdedup.deduplicate(docs, kept=False, hot=hot, strings=strings)) == want


def test_substring_dedup_of_equal_ids(spark):
    """Rows of one doc_id lose bytes of their own only; equal rows are one document; what is left is what stays."""
    rng = random.Random(31)
    x, a, b = (words(rng, 60)[:300] for _ in "xab")
    data = [(1, x), (2, a + x), (2, b), (3, x), (3, x), (4, a), (4, a + "!")]
    df = spark.createDataFrame(data, "doc_id long, text string")
    got = suffixdedup.deduplicate(df).collect()
    assert sorted(tuple(r)[:5] for r in got) == suffixdedup.brute_force(data)
    assert (2, 300, 0, 0) in [tuple(r)[:4] for r in got] and {bytes(r.kept) for r in got if r.doc_id == 2} == {a.encode(), b.encode()}


def test_substring_dedup_reads_long_texts_in_parts(spark, monkeypatch):
    rng = random.Random(32)
    long = words(rng, 700)
    data = [(1, long), (2, words(rng, 5) + long[900:2500]), (3, None), (4, long[-150:]), (5, "é" * 400)]
    parts = suffixdedup.contexts_of
    monkeypatch.setattr(suffixdedup, "SLICE_BYTES", 1000)
    data_bytes = np.frombuffer(long.encode(), np.uint8)
    found = parts(data_bytes, np.array([0, len(data_bytes)]), np.array([True]))
    covered = np.concatenate([np.arange(lo, lo + n) for lo, n in zip(found["lo"], found["n"], strict=True)])
    assert sorted(covered.tolist()) == list(range(len(data_bytes) - suffixdedup.LENGTH + 1))
    df = spark.createDataFrame(data, "doc_id long, text string")
    assert rows(suffixdedup.deduplicate(df, kept=False)) == suffixdedup.brute_force(data)


def test_substring_dedup_holds_the_hashes_of_a_part_at_once():
    rng = random.Random(7)
    text = words(rng, 400_000)[:2_000_000].encode()
    ends = np.array([0, 700_000, 700_050, 1_999_000, len(text)])
    data = np.frombuffer(text, np.uint8)
    tracemalloc.start()
    try:
        found = suffixdedup.contexts_of(data, ends, np.ones(4, dtype=bool))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 60_000_000
    for k, size in enumerate(np.diff(ends)):
        own = found["idx"] == k
        covered = np.concatenate([np.arange(lo, lo + n) for lo, n in zip(found["lo"][own], found["n"][own], strict=True)] or [[]])
        assert sorted(covered.tolist()) == list(range(size - suffixdedup.LENGTH + 1))


def test_collection_is_the_suffix_order(tmp_path):
    rng = random.Random(8)
    for _ in range(60):
        strings = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 30))).encode() for _ in range(rng.randint(2, 12))]
        string, length, prefix = suffixdedup.Collection(strings, f"file://{tmp_path}", block=rng.choice([3, 7, 50, 1 << 20])).rows()
        got = [strings[s][len(strings[s]) - k :] for s, k in zip(string.tolist(), length.tolist(), strict=True)]
        assert got == sorted(got)
        for a, b, p in zip(got, got[1:], prefix[1:].tolist(), strict=False):
            assert p == next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    assert not list(tmp_path.iterdir())


def test_decontamination_equals_brute_force(spark, docs, texts):
    items = [(1, texts[8][1][:200]), (2, "one two"), (10, None), (11, "..."), (3, "never seen words stand here in a row of ten words")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = sorted(decontaminate.brute_force(texts, items))
    assert rows(decontaminate.report(decontaminate.find_windows(docs, bench))) == want
    assert rows(decontaminate.report(decontaminate.find_windows(docs, bench, block_bytes=150))) == want
    assert {r.doc_id for r in decontaminate.decontaminate(docs, bench).collect()} == {w[0] for w in want if not w[-1]}
    cut = decontaminate.decontaminate(docs, bench, remove="spans")
    assert cut.columns == docs.columns and not any(r.contaminated for r in decontaminate.report(decontaminate.find_windows(cut.where("doc_id <> 3"), bench.where("item_id = 2"))).collect())


def test_windows_of_a_large_benchmark_need_little_memory():
    """A block of 4 MB takes 31 MB (73 MB while it is built); a worker keeps KEPT_BYTES of sets at most."""
    import tracemalloc

    rng = np.random.default_rng(2)
    vocab = np.array([f"w{k}" for k in range(60_000)])
    items = [(str(k), " ".join(vocab[rng.integers(0, len(vocab), 400)]).encode()) for k in range(1500)]
    total = sum(len(t) for _, t in items)
    tracemalloc.start()
    own = decontaminate.WindowSet(items)
    size, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert size < 9 * total and peak < 20 * total and own.nbytes() < 9 * total, (size, peak, total)
    words_of = items[7][1].split()
    (n, runs, names), (_, none, _) = own.scan([b"x " + b" ".join(words_of[50:65]) + b" y", b" ".join(words_of[50:59])])
    assert (n, runs, names) == (17, [(1, 16)], {"7"}) and none == []


def test_windows_with_equal_hashes_stay_apart(monkeypatch):
    """Even if all hashes agree, words decide."""
    monkeypatch.setattr(decontaminate, "rolled", lambda codes, n: np.zeros(len(codes) - n + 1, dtype=np.uint64))
    own = decontaminate.WindowSet([("a", b"one two"), ("b", b"three four"), ("c", b"one two")])
    assert [(r, n) for _, r, n in own.scan([b"x one two", b"three four one", b"two one"])] == [([(1, 3)], {"a", "c"}), ([(0, 2)], {"b"}), ([], set())]


def test_pii_equals_patterns():
    rng = random.Random(6)
    for _ in range(4000):
        text = "".join(rng.choice("0123456789.+-@ ()ab:/") for _ in range(rng.randint(0, 60)))
        assert [s for s in pii.find_spans(text) if s[0] in pii.BASE_KINDS] == pii.brute_force(text)
    assert pii.masked("mail a.b@c.org or 10.0.0.1, ftp://me:pw@host/x") == "mail [EMAIL] or [IP], [URL]"


def test_pii_secrets():
    """Values of secret cues are found whole, in all spellings; words, names in code and short values are left alone."""
    value = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    for text in (f'x token = "{value}" y', f"TOKEN: {value.upper()}!", f"api-key={value}", f"'Api_Key': '{value}',", f"Secret Key => {value}.", "password: hunter42x"):
        found = [text[a:b] for kind, a, b in pii.find_spans(text) if kind == "secret"]
        assert found == [value.upper() if "TOKEN" in text else "hunter42x" if "password" in text else value], text
        assert "[SECRET]" in pii.masked(text) and found[0] not in pii.masked(text)
    for text in ("a token of thanks", "token = get_token_from_v2()", "password: required", "token: 16 words", "secretary: 1234567890123456a", "tokens = 4096"):
        assert not [s for s in pii.find_spans(text) if s[0] == "secret"], text
    assert pii.masked('token = "' + "token=" * 100_000 + '"').count("token") == 100_001  # no digit; read once


def test_pii_rows_equal_the_patterns(spark, docs):
    """Counts, digests and spans of two whole tables and of a very long text."""
    table = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").union(docs.selectExpr("-doc_id - 1", "text"))
    table = table.union(spark.createDataFrame([(None, "a@b.co 10.0.0.1"), (2**60, "+49 30 1234567, x@y.de " * 60_000)], "doc_id long, text string"))
    texts = {r.doc_id: r.text for r in table.collect()}
    got = pii.detect(table.selectExpr("*", "1 as spans", "2 as n_email")).collect()
    assert len(got) == len(texts)
    for r in got:
        base = pii.brute_force(texts[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == kind for k, _, _ in base) for kind in pii.BASE_KINDS]
        assert r.base_sha256 == hashlib.sha256(pii.joined(base).encode()).hexdigest()
        kinds = [s.split(":")[0] for s in r.spans.split(",") if s]
        assert [r.n_url, r.n_account, r.n_secret, r.n_spans] == [*(kinds.count(k) for k in ("url", "account", "secret")), len(kinds)]
        assert [s for s in r.spans.split(",") if s.split(":")[0] in pii.BASE_KINDS] == ([s for s in pii.joined(base).split(",") if s])


def test_toxicity_rows_equal_noisy_or(spark):
    """Scores recomputed from sentence scores, for every row; held-out rows teach nothing."""
    import zlib

    table, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    more = table.select("doc_id", "text").union(spark.createDataFrame([(None, None), (10**9, ""), (10**9, "word " * 200_000)], "doc_id long, text string")).selectExpr("*", "1 as score", "2 as toxic", "3 as id", "4 as sentences")
    model = toxicity.fit(more, labels.withColumn("text", F.lit("x")))
    got = toxicity.score(more, model).collect()
    texts = {(r.doc_id, len(r.text or "")): r.text for r in more.collect()}
    assert len(got) == more.count()
    for (doc_id, _), text in texts.items():
        clean = 1.0
        for sentence in toxicity.sentences(text):
            z = model.bias + sum(model.weights.get(w, 0.0) for w in toxicity.sentence_features(sentence))
            clean *= 1 - 1 / (1 + np.exp(-z))
        mine = [r for r in got if r.doc_id == doc_id and abs(r.score - (1 - clean)) < 1e-9]
        assert mine and all(r.predicted == int(r.score >= 0.7) and r.held_out == (doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 1) for r in mine)
    held = [r.doc_id for r in got if r.held_out]
    flipped = labels.withColumn("toxic", F.when(F.col("doc_id").isin(held), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = toxicity.fit(more, flipped)
    assert again.weights == model.weights and again.bias == model.bias


def test_pii_mask_keeps_columns(docs):
    masked = pii.mask(docs)
    assert masked.columns == docs.columns and masked.count() == docs.count()


def test_packing_plan_is_gapless_and_tight():
    rng = random.Random(2)
    for _ in range(300):
        capacity = rng.choice([8, 30, 64])
        histogram = {rng.randint(1, capacity): rng.randint(1, 9) for _ in range(rng.randint(1, 10))}
        placed, seen = {}, {}
        for n, first, count, sequence, offset in packing.plan(histogram, capacity):
            assert first == seen.get(n, 0)
            seen[n] = first + count
            for k in range(count):
                placed.setdefault(sequence + k, []).append((offset, n))
        assert seen == histogram
        for own in placed.values():
            at = 0
            for offset, n in sorted(own):
                assert offset == at
                at += n
            assert at <= capacity


def test_packing_reduction_keeps_the_optimum():
    """The sequences that are fixed and the best of what remains are together the best of all."""

    def best(items, capacity):
        items, found = sorted(items, reverse=True), [len(items)]

        def place(k, used):
            if len(used) >= found[0]:
                return
            if k == len(items):
                found[0] = len(used)
                return
            for room in {u for u in used if u + items[k] <= capacity}:
                i = used.index(room)
                place(k + 1, [*used[:i], room + items[k], *used[i + 1 :]])
            place(k + 1, [*used, items[k]])

        place(0, [])
        return found[0]

    rng = random.Random(3)
    worse = fixed = 0
    for _ in range(400):
        capacity, histogram = rng.choice([10, 17, 30]), {}
        for _ in range(rng.randint(1, 9)):
            n = rng.randint(1, capacity)
            histogram[n] = histogram.get(n, 0) + 1
        optimum = best([n for n, c in histogram.items() for _ in range(c)], capacity)
        sequences = lambda p: {s + k for _, _, count, s, _ in p for k in range(count)}
        worse += len(sequences(packing.plan(histogram, capacity))) > optimum
        reduced, rest = packing.plan(histogram, capacity, fit=False), dict(histogram)
        for n, _, count, _, _ in reduced:
            rest[n] -= count
        fixed += len(sequences(reduced))
        assert len(sequences(reduced)) + best([n for n, c in rest.items() for _ in range(c)], capacity) == optimum
    assert worse <= 2 and fixed > 400


def test_packing_rows_equal_the_tokenizer(spark, docs):
    """Every column of every piece of two whole tables, and few sequences."""
    import zlib

    from tokenizers import Tokenizer

    path = vocabulary("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    table = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").union(docs.selectExpr("-doc_id - 1", "text")).union(spark.createDataFrame([(None, "no id"), (2**60, "x")], "doc_id long, text string"))
    want = []
    for r in table.collect():
        ids = [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1]
        want += [(r.doc_id, k // 4096, k, len(ids[k : k + 4096]), zlib.crc32(np.array(ids[k : k + 4096], dtype="<u4").tobytes())) for k in range(0, len(ids), 4096)]
    more = table.selectExpr("*", "1 as length", "2 as rank", "3 as file", "4 as piece")
    got = packing.pack(more, path).collect()
    assert sorted((tuple(r)[:5] for r in got), key=repr) == sorted(want, key=repr)
    used: dict[int, list] = {}
    for r in got:
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in used.values():
        ends = [a + n for a, n in sorted(own)]
        assert [a for a, _ in sorted(own)] == [0, *ends[:-1]] and ends[-1] <= 4096
    assert len(used) <= -(-sum(w[3] for w in want) // 4096) + 1


def test_packing_ids(docs, texts):
    from tokenizers import Tokenizer

    path = vocabulary("word_bpe_49k.json")
    got = packing.pack(docs, path).collect()
    tokenizer = Tokenizer.from_file(path)
    assert {r.doc_id: r.length for r in got if r.piece == 0 and r.length < 4096} == {i: n for i, t in texts if (n := len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1) < 4096}
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in by.values():
        ends = [a + n for a, n in sorted(own)]
        assert [a for a, _ in sorted(own)] == [0, *ends[:-1]] and ends[-1] <= 4096
    encoder = packing.WordEncoder(path)
    odd = ["a<|endoftext|>b", "İ ΣΑΣ é", "it's we'll'd", "!!'s x'", "", "a\x1cb\x85c", "²³½ ª"]
    assert encoder.ids(odd) == [encoder.exact(t) for t in odd]


def test_token_tree_follows_edits():
    counts = tokencount.counter(vocabulary("byte_bpe_50k.tiktoken"))
    rng = random.Random(5)
    parts = ["a", "the", " ", "  ", "\n", "'s", "'", ".", "!!", "23", "é", "word"]
    for _ in range(400):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 300)))
        tree = tokencount.TokenTree(text, counts)
        for _ in range(4):
            a = rng.randint(0, len(text))
            b = min(len(text), a + rng.choice([0, 1, 5, 60]))
            new = "".join(rng.choice(parts) for _ in range(rng.randint(0, 6)))
            tree.edit(a, b, new)
            text = text[:a] + new + text[b:]
            assert tree.text() == text and tree.tokens == len(counts.encoding.encode_ordinary(text))
            tree = tokencount.TokenTree.stored(tree.text(), *tree.figures(), counts)
            assert tree.text() == text and tree.tokens == len(counts.encoding.encode_ordinary(text))


def test_count_edited_equals_encoding_the_edited_text(spark, docs):
    """Whole tables: stored trees after edits, and after edits of the edited, against encoding the texts anew."""
    path = vocabulary("byte_bpe_50k.tiktoken")
    counts = tokencount.counter(path)
    size = lambda t: len(counts.encoding.encode_ordinary(t))

    def edited(text):
        third, half = len(text) // 3, len(text) // 2
        text = text[:third] + "a revised passage, 2024" + text[third + 20 :]
        text = text[:half] + text[half + 15 :]
        return text + " The end."

    table = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "lang").union(docs.select(-F.col("doc_id") - 1, "text", "lang"))
    texts = {r.doc_id: r.text or "" for r in table.collect()}
    more = table.selectExpr("*", "1 as n_tokens", "2 as leaf_chars", "3 as edits")
    got = tokencount.count_edited(more, tokencount.standard_edits(F.col("text")), path).collect()
    assert len(got) == len(texts) and sum(r.n_encoded for r in got) < 0.2 * sum(r.n_pretokens for r in got)
    for r in got:
        assert (r.n_tokens, r.n_pretokens) == (size(texts[r.doc_id]), len(tokencount._SPLIT.findall(texts[r.doc_id])))
    trees = tokencount.build_trees(table, path)
    for _ in range(2):
        trees = tokencount.apply_edits(trees, tokencount.standard_edits(F.col("text")), path)
        own = trees.collect()
        texts = {r.doc_id: r.text for r in own}
        assert all(r.n_tokens == size(r.text) == sum(r.leaf_tokens) for r in own)
        trees = trees.drop("n_tokens_before", "n_pretokens_before", "n_encoded")
    once = {r.doc_id: r.n_tokens_edited for r in got}
    first = tokencount.apply_edits(tokencount.build_trees(table, path), tokencount.standard_edits(F.col("text")), path).collect()
    assert {r.doc_id: r.n_tokens for r in first} == once
    plain = {r.doc_id: r.text or "" for r in table.collect()}
    assert all(r.text == edited(plain[r.doc_id]) for r in first if len(plain[r.doc_id]) > 200)
    none = F.lit(None).cast("array<struct<start:int,stop:int,replacement:string>>")
    assert all(r.n_tokens == r.n_tokens_edited and r.n_encoded == 0 for r in tokencount.count_edited(docs, none, path).collect())


def test_fingerprints(docs, texts):
    got = {r.doc_id: r for r in merkle.edited_fingerprints(docs).collect()}
    order = [t or "" for _, t in texts]
    for i, t in enumerate(order):
        k, after = len(t) // 4, order[(i + 1) % len(order)]
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256((t[: len(t) - k] + after[:k]).encode()).hexdigest()
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
    by_text = {}
    for i, t in enumerate(order):
        by_text.setdefault(t, set()).add(got[i].fingerprint)
    assert all(len(v) == 1 for v in by_text.values()) and len({v for s in by_text.values() for v in s}) == len(by_text)


def test_warc_round_trip_and_validation(spark):
    page = "<p>" + "x" * 1500
    pages = spark.createDataFrame([(1, "http://a/", page), (2, None, page), (3, "u", "short"), (4, "u", "short"), (5, "u", None)], "page_id long, url string, html string")
    got = {r.page_id: r for r in warc.archive_pages(pages).collect()}
    assert got[1].record_type == "revisit" and got[1].refers_to == 2 and got[1].payload_bytes == 1503
    assert got[2].record_type == got[3].record_type == got[4].record_type == "response" and got[5].payload_bytes == 0
    assert got[1].payload_digest == hashlib.sha1(page.encode()).hexdigest()
    record = warc.warc_record(7, "u", b"payload", None)
    assert warc.read_record(record)["payload"] == b"payload"
    for broken in (record[:-1], record.replace(b"payload\r\n", b"paYload\r\n"), record.replace(b"WARC/1.1", b"WARX/1.1"), record.replace(b"WARC-Date", b"WARC-Data")):
        with pytest.raises(warc.InvalidRecord):
            warc.read_record(broken)
    writer = warc.ArchiveWriter(b"a dictionary of bytes " * 40)
    writer.add(record)
    raw = writer.take()
    assert int.from_bytes(raw[:4], "little") == warc.SKIPPABLE and [r["page_id"] for r in warc.read_archive(raw)] == [7]
    with pytest.raises(warc.InvalidRecord):
        list(warc.read_archive(raw[:-3]))


def test_warc_spreads_copies_and_ignores_lost_attempts(spark):
    """50,000 copies of a page: no task gets them all; archives of a lost attempt are not read; a cut archive fails."""
    from faultline.llm.common import workspace

    page = "<p>" + "y" * 1200
    pages = spark.range(50_000).selectExpr("id as page_id", "'http://h/' || id as url", f"'{page}' as html", "1 as k_salt", "2 as largest")
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
        spark.conf.set("spark.sql.adaptive.enabled", False)
        roles = warc.with_roles(pages)
        sizes = [r["count"] for r in roles.groupBy(F.spark_partition_id().alias("p")).count().collect()]
        assert len(sizes) == 4 and max(sizes) < 20_000
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert roles.where("refers_to = 49999").count() == 49_999
    few = warc.with_roles(pages.where("page_id < 300"))
    folder = workspace(spark, "warc")
    warc.write_archives(few, folder, None)  # an attempt that Spark gave up
    archives = warc.write_archives(few, folder, None, archive_bytes=4000)
    got = warc.read_archives(archives, folder, payload=True).collect()
    assert len(got) == 300 == archives.agg(F.sum("records")).first()[0] and archives.count() > 2
    assert [r.page_id for r in got if r.record_type == "response"] == [299] and [bytes(r.payload) for r in got if r.payload] == [page.encode()]
    with pytest.raises(Exception, match="records, not"):
        warc.read_archives(archives.withColumn("records", F.col("records") + 1), folder).collect()


def test_html(spark):
    page = "<html><head><title>T</title></head><body><nav><a>Menu</a></nav><div class='ad'>Buy</div><article><h1>Head &amp; line</h1><p>One  <b>two</b><br><p>three<script>x</script></article><footer>F</footer></body>"
    assert htmltext.blocks(page)[-4:-1] == [("article", "Head & line"), ("article", "One two"), ("article", "three")]
    menu = "<div>Home News Sport Weather About us today and more</div>"
    plain = [(k, f"http://h/{k}", f"{menu}<p>Own text {k} of page {k * 7} here</p>") for k in range(6)] + [(9, None, None), (10, "http://h/x", page)]
    got = {r.page_id: r.text for r in htmltext.extract(spark.createDataFrame(plain, "page_id long, url string, html string")).collect()}
    assert got[3] == "Own text 3 of page 21 here" and got[9] == "" and got[10] == "Head & line\nOne two\nthree"


def test_html_counts_repeats_over_the_whole_host(spark):
    """What three of a host's pages share goes, however the host is dealt into groups; copies are one witness."""
    notice = "This notice stands on three pages of the host and nowhere else"
    plain = [(k, f"http://h/{k}", f"<p>Own{k} w{k}a w{k}b w{k}c w{k}d w{k}e w{k}f w{k}g w{k}h</p>" + f"<div>{notice}</div>" * (k % 8 == 0)) for k in range(24)]
    plain += [(30 + k, "http://h/copy", "<p>a page that stands here three times and so is one witness</p>") for k in range(3)]
    df = spark.createDataFrame(plain, "page_id long, url string, html string")
    for chunk in (400, 7, 2, 1):
        got = {r.page_id: r.text for r in htmltext.extract(df, chunk=chunk).collect()}
        assert all(got[k] == f"Own{k} w{k}a w{k}b w{k}c w{k}d w{k}e w{k}f w{k}g w{k}h" for k in range(24)) and len(got) == 27
        assert all(got[30 + k] == "a page that stands here three times and so is one witness" for k in range(3))


def test_html_keeps_common_phrases_of_main_text(spark):
    """Phrases, headings and a quotation that some pages share stay; menus, notices and long runs of the host go."""
    phrase, quotation = "as a matter of fact we", " ".join(f"q{k}" for k in range(35))
    menu, terms = "".join(f"<li>Item {k}</li>" for k in range(6)), " ".join(f"t{k}" for k in range(40))
    plain, want = [], {}
    for k in range(60):
        own = f"Page{k} says {phrase} x{k} y{k}" + (f" {quotation} end{k}" if k < 4 else "")
        plain.append((k, f"http://h/{k}", f"<ul>{menu}</ul><h2>Introduction</h2><p>{own}</p><h2>See also</h2><p>p{k} q{k} r{k} s{k} {terms}</p><p>Last words of page {k} z{k} here, not shared</p>"))
        want[k] = f"Introduction\n{own}\nSee also\np{k} q{k} r{k} s{k}\nLast words of page {k} z{k} here, not shared"
    df = spark.createDataFrame(plain, "page_id long, url string, html string")
    for chunk in (400, 9):
        assert {r.page_id: r.text for r in htmltext.extract(df, chunk=chunk).collect()} == want
    for blocks in (["a b", "c d e f g h", "i"], ["a"] * 9, ["a"] * 3, []):
        sizes = [len(b.split()) for b in blocks]
        stops = [(i, next((j for j in range(i + 1, len(blocks) + 1) if sum(sizes[i:j]) >= 8), None)) for i in range(len(blocks))]
        assert [u[:2] for u in htmltext._units(blocks, [True] * len(blocks))] == [x for x in stops if x[1]]
        assert htmltext._units(blocks, [False] * len(blocks)) == []


def test_html_structure():
    of = lambda page: [t for z, t in htmltext.blocks(page) if z == "article"]
    assert of("<article>one <img src=x> two<input>three <br/>four<hr>five</article>") == ["one twothree four", "five"]
    assert of('<div class="layout no-sidebar"><article>body</article></div>') == ["body"]
    assert of('<div class="sidebar"><p>x</p><main class="related-reading-off">body <div class="share">s</div></main><p>y</p></div>') == ["body"]
    assert of('<article>a<div id="comments"><article class="comment">b</article></div>c</article>') == ["a", "c"]
    assert of("<article>a<p>b</article>") == ["a", "b"] and of("<nav><article>a</article></nav>") == []


def test_html_equals_brute_force(spark):
    """Random hosts: pages with and without article, shared long runs, menus, copies, nulls and a very long page."""
    rng = random.Random(12)
    passages = [" ".join(f"p{i}t{k}" for k in range(45)) for i in range(4)]
    menus = ["".join(f"<li>{m}{k}</li>" for k in range(5)) for m in ("home", "about")]
    pages = [(900, None, None), (901, "http://a.org/", ""), (None, "http://a.org/x", "<p>no id"), (902, "http://a.org/long", "<article>" + "<p>".join(words(rng, 300) for _ in range(60)) + "</article>")]
    for k in range(70):
        body = [f"<p>{words(rng, rng.randint(1, 50))}</p>" for _ in range(3)]
        for p in passages:
            if rng.random() < (0.7 if p is passages[0] else 0.15):
                body.insert(rng.randrange(4), f"<p>{words(rng, 3)} {p} {words(rng, 3)}</p>")
        menu = f"<ul>{rng.choice(menus)}</ul>"
        main = "".join(body)
        page = f"{menu}<article>{main}</article>" if k % 3 else f"{menu}{main}"
        pages.append((k, f"http://{'abc'[k % 2 if k < 60 else 2]}.org/{k}", page))
        if k % 9 == 0:
            pages.append((k, f"http://a.org/copy{k}", page))
    want = sorted(htmltext.brute_force(pages), key=repr)
    cut = {i: t for i, t in want}
    assert any(k % 3 and "p0t7" in pages_of and "p0t7" not in cut[k] for k, _, pages_of in pages if k is not None and k < 60)
    df = spark.createDataFrame([(*p, 1, "x") for p in pages], "page_id long, url string, html string, host int, content string")
    for chunk in (400, 9):
        assert sorted(((r.page_id, r.text) for r in htmltext.extract(df, chunk=chunk).collect()), key=repr) == want


def test_toxicity_learns_held_out(spark):
    rng = random.Random(1)
    data = []
    for k in range(600):
        bad = k % 5 == 0
        body = [words(rng, 12) for _ in range(5)]
        if bad:
            body[rng.randrange(5)] += " " + rng.choice(["vile", "rotten", "nasty"])
        data.append((k, ". ".join(body), int(bad)))
    df = spark.createDataFrame(data, "doc_id long, text string, toxic int")
    model = toxicity.fit(df.select("doc_id", "text"), df.select("doc_id", "toxic"))
    got = toxicity.score(df.select("doc_id", "text"), model).join(df, "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.toxic for r in got) >= 0.97 * len(got)
    assert model.offending("a calm line. you vile one")[0][0] == 1
    empty = toxicity.fit(df.select("doc_id", "text"), df.select("doc_id", "toxic").where("toxic = 9"))
    assert empty.score("anything") < 0.01


def test_near_duplicates_of_a_whole_table(spark):
    """Recall and precision on sf0.01: each row equals the comparison of all pairs of 1,000 documents, by words."""
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    want = sorted(minhash.brute_force([(r.doc_id, r.text) for r in table.collect()], 85))
    assert rows(QUERIES["op5_near_duplicates"](spark, "/root/testdata/sf0.01")) == want


def test_empty_tables(spark, docs):
    import corpus_pipeline as p

    none = docs.where("doc_id < 0")
    bench = spark.createDataFrame([], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    path, ids = vocabulary("word_bpe_49k.json"), vocabulary("byte_bpe_50k.tiktoken")
    edits = tokencount.standard_edits(F.col("text"))
    for df in (minhash.near_duplicates(none), minhash.deduplicate(none), suffixdedup.deduplicate(none), merkle.edited_fingerprints(none), pii.detect(none), pii.mask(none), packing.pack(none, path), decontaminate.report(decontaminate.find_windows(none, bench)), decontaminate.decontaminate(none, bench), warc.archive_pages(pages), htmltext.extract(pages), toxicity.score(none, toxicity.fit(none, labels)), tokencount.count_edited(none, edits, ids)):
        assert df.count() == 0
    assert not any(r.contaminated for r in decontaminate.report(decontaminate.find_windows(docs, bench)).collect())
    assert decontaminate.decontaminate(docs, bench).count() == docs.count()
    assert toxicity.score(docs, toxicity.fit(docs, labels)).where("score > 0.001").count() == 0
    for _, stage in p.STAGES:
        assert stage(spark, none, SMALL).count() == 0


def test_clashing_extra_columns(spark, docs):
    """The same rows with and without columns that are named as the operators' own; stages keep the columns."""
    import corpus_pipeline as p

    names = "id n signature key place length kept_id component kept runs items score score_ toxic page host sentences slice idx lo file rank row segment u v a b _place _row bytes band bands fine group salt n_tokens edits"
    extra = [f"{k} as {name}" for k, name in enumerate(names.split())]
    more = docs.selectExpr("*", *extra)
    labels = spark.createDataFrame([(i, 0, int(i % 4 == 0), "x", 1) for i in range(40)], "doc_id long, quality int, toxic int, text string, id int")
    bench = spark.createDataFrame([(1, "alpha1 beta2", 5, "x")], "item_id long, text string, doc_id int, item string")
    path, ids = vocabulary("word_bpe_49k.json"), vocabulary("byte_bpe_50k.tiktoken")
    one = lambda f: sorted(map(repr, (tuple(r) for r in f(docs).collect())))
    two = lambda f: sorted(map(repr, (tuple(r) for r in f(more).collect())))
    for f in (minhash.near_duplicates, suffixdedup.deduplicate, merkle.edited_fingerprints, pii.detect, lambda d: decontaminate.find_windows(d, bench), lambda d: toxicity.score(d, toxicity.fit(d, labels)), lambda d: packing.pack(d, path).select("doc_id", "piece", "start", "length", "ids_crc32"), lambda d: tokencount.count_edited(d, tokencount.standard_edits(F.col("text")), ids)):
        assert one(f) == two(f)
    for _, stage in p.STAGES[:-1]:
        left = stage(spark, more, SMALL)
        assert left.columns == more.columns and rows(left.select("doc_id", "text").na.fill("-")) == rows(stage(spark, docs, SMALL).select("doc_id", "text").na.fill("-"))
    pages = spark.createDataFrame([(1, "http://a/", "<p>one", 3, "x", "y"), (1, None, None, 4, "x", "y")], "page_id long, url string, html string, refers_to int, host string, content string").selectExpr("*", *(f"{k} as {c}" for k, c in enumerate("k_sha1 largest o_k_hash k_salt zones texts prints part name records".split())))
    assert warc.archive_pages(pages).count() == 2 and sorted(r.text for r in htmltext.extract(pages).collect()) == ["", "one"]


@pytest.mark.skipif(sys.platform != "linux", reason="test tables")
@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_oracles(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.sql(f"create view {t} as select * from read_parquet('{SMALL}/{t}.parquet')")
    df = QUERIES[name](spark, SMALL)
    columns = sorted(df.columns)
    want = con.sql(ORACLE_SQL[name])
    order = [want.columns.index(c) for c in columns]
    assert sorted(map(repr, (tuple(r[c] for c in columns) for r in df.collect()))) == sorted(map(repr, (tuple(r[k] for k in order) for r in want.fetchall())))


def test_pipeline_stages(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    before = docs
    for _, stage in p.STAGES[:-1]:
        after = stage(spark, before, SMALL).cache()
        assert after.columns == docs.columns and 0 < after.count() <= before.count()
        before = after
    packed = p.STAGES[-1][1](spark, before, SMALL)
    assert packed.select("doc_id").distinct().count() == before.select("doc_id").distinct().count()
    left = [(r.doc_id, r.text) for r in p.STAGES[1][1](spark, docs, SMALL).collect()]
    assert {d for d, _ in left} == {d for d, _, _, k in minhash.brute_force([(r.doc_id, r.text) for r in docs.collect()]) if k}
    assert F.col("x") is not None
