"""Small fixtures against brute force: nulls, empty and long texts, ties, repeated rows, empty tables, other columns."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from netohm.llm import (
    context_coder,
    decontamination,
    line_dedup,
    order_minhash,
    packing,
    quality_classifier,
    robust_outliers,
    substring_dedup,
    token_files,
    tokens,
    toxicity,
    warc,
)
from netohm.llm.components import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, starts string, copy string"


def words(seed, n):
    r = np.random.default_rng(seed)
    return [f"w{x}" for x in r.integers(0, 5000, n)]


def rows():
    base, shared = words(1, 120), words(2, 70)
    near = list(base)
    near[60] = "other"
    texts = [
        None, "", " \n\t ", "one two", " ".join(base), " ".join(base), " ".join(near), " ".join(words(3, 80) + shared + words(4, 30)), "\n".join([*words(5, 30), " ".join(shared), *words(6, 9)]),
        " ".join(words(7, 30) * 40), "It's\tan   odd text <|endoftext|> with 12,5 km and naïve ½\n\nend ", "a b " * 3000,
    ]
    out = [(i, t, None if i % 4 == 0 else "en", "hot" if i % 3 else None, 0, "x", "y") for i, t in enumerate(texts)]
    return [*out, (4, " ".join(base), "en", "hot", 0, "x", "y")]


@pytest.fixture()
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture()
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def split(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def test_substring_dedup(docs, none):
    first = {}
    for i, t in sorted((r[0], r[1] or "") for r in rows()):
        w = split(t)
        for k in range(len(w) - 49):
            first[tuple(w[k : k + 50])] = min(i, first.get(tuple(w[k : k + 50]), i))
    want = []
    for i, t, *_ in rows():
        w = split(t)
        gone = set()
        for k in range(len(w) - 49):
            if first[tuple(w[k : k + 50])] < i:
                gone.update(range(k, k + 50))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        want.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    assert sorted(map(tuple, substring_dedup.remove_repeats(docs).collect())) == sorted(want)
    assert substring_dedup.remove_repeats(none).count() == 0


def test_substring_dedup_of_repeated_ids(spark):
    a, own, late = words(41, 60), words(42, 60), words(43, 320)
    texts = [(1, " ".join(a)), (2, " ".join(a)), (2, " ".join(own)), (3, " ".join(late + a)), (3, " ".join(own[:55])), (3, " ".join(own[:55]))]
    got = substring_dedup.remove_repeats(spark.createDataFrame(texts, "doc_id long, text string").repartition(3)).collect()
    assert sorted((r["doc_id"], r["n_words"], r["n_removed"]) for r in got) == [(1, 60, 0), (2, 60, 0), (2, 60, 60), (3, 55, 55), (3, 55, 55), (3, 380, 60)]


def test_order_minhash(docs, none):
    got = {r["doc_id"]: r["class_id"] for r in order_minhash.near_duplicates(docs).collect()}
    assert got == {**{i: i for i in range(12)}, 5: 4, 6: 4}
    assert sorted(r["doc_id"] for r in order_minhash.keep_one(docs).collect()) == [0, 1, 2, 3, 4, 4, 7, 8, 9, 10, 11]
    assert order_minhash.near_duplicates(none).count() == 0
    a, b = np.arange(100, dtype=np.uint32), np.arange(5, 105, dtype=np.uint32)
    assert order_minhash.aligned(a, a, 5, 0.8) == 1.0
    assert order_minhash.aligned(a, b, 5, 0.8) == pytest.approx(91 / 101)
    assert order_minhash.aligned(a, a[::-1].copy(), 5, 0.8) == 0.0


def test_large_group_of_near_copies(spark):
    base = words(9, 300)
    variants = []
    for i in range(60):
        w = list(base)
        w[5 * i] = f"new{i}"
        variants.append((i, " ".join(w)))
    got = order_minhash.near_duplicates(spark.createDataFrame(variants, "doc_id long, text string")).collect()
    assert {r["class_id"] for r in got} == {0}


def edited(base, seed, edits):
    r, w = np.random.default_rng(seed), list(base)
    for j in r.choice(len(w), edits, replace=False):
        w[j] = f"e{seed}x{j}"
    return w


def test_large_families_hold_together(spark):
    code = {}
    number = lambda w: np.array([code.setdefault(x, len(code)) for x in w], np.uint32)
    base, other = words(21, 300), words(22, 200)
    texts = [base] + [edited(base, i, 5) for i in range(1, 1001)] + [edited(other, i, 4) for i in range(1001, 1101)]
    assert all(order_minhash.aligned(number(base), number(t), 5, 0.8) >= 0.8 for t in texts[:1001])
    seqs, root = [number(t) for t in texts[1001:]], list(range(100))
    for i in range(100):
        for j in range(i):
            if order_minhash.aligned(seqs[i], seqs[j], 5, 0.8) >= 0.8:
                u, v = root[i], root[j]
                root = [min(u, v) if x in (u, v) else x for x in root]
    want = {i: 0 for i in range(1001)} | {1001 + i: 1001 + c for i, c in enumerate(root)}
    d = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    assert {r["doc_id"]: r["class_id"] for r in order_minhash.near_duplicates(d).collect()} == want


def test_recall_against_all_pairs(spark):
    texts = [edited(words(70 + f, 400), 100 * f + i, i) for f in range(6) for i in range(12)]
    code = {}
    seqs = [np.array([code.setdefault(x, len(code)) for x in t], np.uint32) for t in texts]
    pairs = [(i, j) for i in range(len(seqs)) for j in range(i) if order_minhash.aligned(seqs[i], seqs[j], 5, 0.8) >= 0.8]
    d = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    cls = {r["doc_id"]: r["class_id"] for r in order_minhash.near_duplicates(d).collect()}
    assert len(pairs) > 50 and np.mean([cls[i] == cls[j] for i, j in pairs]) >= 0.95
    assert all(any(cls[i] == cls[j] and i != j for j in range(len(seqs))) for i in cls if cls[i] != i)


def test_repeated_ids_in_near_duplicates(spark):
    a, b = " ".join(words(80, 60)), " ".join(words(81, 60))
    d = spark.createDataFrame([(1, a), (2, a), (2, b), (3, b), (4, b)], "doc_id long, text string").repartition(3)
    runs = [sorted(map(tuple, order_minhash.near_duplicates(d.repartition(n)).collect())) for n in (1, 4)]
    assert runs[0] == runs[1] and len(runs[0]) == 5


def test_components(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (3, 9), (9, 8), (20, 21), (21, 20)], "a long, b long")
    assert {r["doc_id"]: r["class_id"] for r in components(links).collect()} == {1: 1, 2: 1, 3: 1, 9: 1, 8: 1, 20: 20, 21: 20}


def test_line_dedup(spark, none):
    a, b, c = "alpha beta gamma delta epsilon", "one two three four five six", "short"
    texts = [f"{a}\n{b}\n{c}", f"{c}\n{a}\n\n{b}\nlast", f"{a}\nother line of some words here", None, "", f"{a}\n{b}\n{a}\n{b}"]
    d = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_lines string")
    got = {r["doc_id"]: (r["text"], r["n_lines"], r["n_deleted"]) for r in line_dedup.remove_repeated_runs(d).collect()}
    assert got == {0: (texts[0], 3, 0), 1: (f"{c}\n\nlast", 5, 2), 2: (texts[2], 2, 0), 3: (None, 0, 0), 4: ("", 1, 0), 5: ("", 4, 4)}
    assert line_dedup.remove_repeated_runs(none).count() == 0


def brute_lines(texts, min_lines, min_words, single):
    """Kept text of each (doc_id, text), for texts in the order of places."""
    seqs = [[(i, x.strip(" \t\n\x0b\x0c\r")) for i, x in enumerate((t or "").split("\n")) if split(x)] for _, t in texts]
    gone = [set() for _ in texts]
    for size, least in ((min_lines, min_words), (1, single)):
        first = {}
        for d, s in enumerate(seqs):
            for j in range(len(s) - size + 1):
                run = tuple(x for _, x in s[j : j + size])
                if sum(len(split(x)) for x in run) < least:
                    continue
                e, k = first.setdefault(run, (d, j))
                if (e, k) != (d, j):
                    gone[d] |= {s[g][0] for g in range(j, j + size) if e != d or not k <= g < k + size}
    return [None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone[d]) for d, (_, t) in enumerate(texts)]


@pytest.mark.parametrize("min_lines", [1, 2, 3, 4, 7])
def test_line_dedup_against_brute_force(spark, min_lines):
    r = np.random.default_rng(min_lines)
    some = [f"line {k} of a few words" for k in range(5)] + ["", "  ", " ".join(words(51, 12))]
    texts = [(i, "\n".join(some[k] for k in r.choice(8, r.integers(0, 30), p=[0.3, 0.2, 0.1, 0.1, 0.1, 0.1, 0.05, 0.05]))) for i in range(25)]
    texts += [(30, "\n".join([some[0]] * n)) for n in (1, 2, 3)][2:] + [(31, None), (32, ""), (33, texts[3][1]), (34, "\n".join([some[0], some[1]] * 9))]
    d = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    got = {x["doc_id"]: x["text"] for x in line_dedup.remove_repeated_runs(d, min_lines, 10, 12).collect()}
    assert got == {i: t for (i, _), t in zip(texts, brute_lines(texts, min_lines, 10, 12))}


@pytest.mark.parametrize("size", [1, 2, 3, 5])
def test_line_runs_are_maximal(spark, size):
    r = np.random.default_rng(40 + size)
    seqs = [[f"line {k} of a few words" for k in r.choice(4, r.integers(0, 40), p=[0.4, 0.3, 0.2, 0.1])] for _ in range(15)]
    seqs += [seqs[3] + seqs[4], ["line 0 of a few words"] * 20, [f"other line {k} that comes in one place and its copy" for k in range(70)]]
    seqs += [seqs[-1][5:60] + ["an end"], seqs[-1]]
    first, want = {}, set()
    for d, s in enumerate(seqs):
        for j in range(len(s) - size + 1):
            first.setdefault(tuple(s[j : j + size]), (d, j))
    source = lambda d, j: first.get(tuple(seqs[d][j : j + size])) if 0 <= j <= len(seqs[d]) - size else None
    for d, s in enumerate(seqs):
        for j in range(len(s) - size + 1):
            e, f = source(d, j)
            if (e, f) == (d, j) or j and source(d, j - 1) == (e, f - 1) != (d, j - 1):
                continue
            n = 1
            while source(d, j + n) == (e, f + n):
                n += 1
            n += size - 1
            assert s[j : j + n] == seqs[e][f : f + n]
            want.add((d, j, e, f, n))
    docs = spark.createDataFrame([(d, "\n \n".join(s)) for d, s in enumerate(seqs)], "doc_id long, text string").repartition(3)
    rows = line_dedup.repeated_runs(docs, size, 0, None).collect()
    assert {(x["doc_id"], x["j"], x["first"]["doc_id"], x["first"]["j"], x["lcp"]) for x in rows} == want and len(rows) == len(want)
    assert all(x["lines"] == list(range(2 * x["j"], 2 * (x["j"] + x["lcp"]), 2)) for x in rows)


def test_suffix_array_is_whole_and_in_order(spark):
    r = np.random.default_rng(77)
    seqs = [[f"line {k}" for k in r.choice(4, r.integers(0, 40), p=[0.4, 0.3, 0.2, 0.1])] for _ in range(12)]
    seqs += [seqs[3], ["line 0"] * 21, [f"only {k}" for k in range(5)], [f"long {k}" for k in range(90)]]
    seqs += [seqs[-1][7:80] + ["line 1"], seqs[-1], ["line 3", "line 0", "an end"]]
    docs = spark.createDataFrame([(d, "\n".join(s)) for d, s in enumerate(seqs)], "doc_id long, text string").repartition(3)
    ids = {(x["doc_id"], x["j"]): (x["h1"], x["h2"]) for x in line_dedup.sequences(docs).collect()}
    suffixes = sorted(([ids[d, k] for k in range(j, len(s))], d, j) for d, s in enumerate(seqs) for j in range(len(s)))
    want, before = [], []
    for pos, (x, d, j) in enumerate(suffixes):
        n = 0
        while n < min(len(x), len(before)) and x[n] == before[n]:
            n += 1
        if seqs[d][0] != "only 0":
            want.append((pos, d, j, n))
        before = x
    array = line_dedup.suffix_array(docs)
    got = sorted((x["pos"], x["doc_id"], x["j"], x["lcp"]) for x in array.collect())
    assert got == want
    for size in (1, 2, 3, 6, 40):
        first = {}
        for _, d, j, _ in sorted(want, key=lambda x: x[1:3]):
            if j + size <= len(seqs[d]):
                first.setdefault(tuple(seqs[d][j : j + size]), []).append((d, j))
        places = {(*p, *of[0]) for of in first.values() if len(of) > 1 for p in of}
        found = line_dedup.intervals(array, size, 0).collect()
        assert {(x["doc_id"], x["j"], x["first"]["doc_id"], x["first"]["j"]) for x in found} == places and len(found) == len(places)
    stretch, line_dedup.STRETCH = line_dedup.STRETCH, 7  # intervals that span several windows of positions
    try:
        assert sorted(line_dedup.intervals(array, 40, 0).collect(), key=str) == sorted(found, key=str)
    finally:
        line_dedup.STRETCH = stretch


def test_lines_are_cut_and_hashed_once(spark):
    text = "one two\n\n \t \n a  b\tc\x0bd \r\nlast one here\n\u00a0 x"
    docs = spark.createDataFrame([(1, text), (1, text), (2, ""), (3, None), (4, " \n")], "doc_id long, text string").repartition(2)
    rows = line_dedup.sequences(docs)
    assert sorted((x["doc_id"], x["j"], x["i"], x["n"]) for x in rows.collect()) == [(1, 0, 0, 2), (1, 1, 3, 4), (1, 2, 4, 3), (1, 3, 5, 2)]
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    above, below = plan.split("Generate ", 1)
    assert "xxhash64(text" not in above and below.count("xxhash64(text") == 1
    assert plan.count("split(text") == 1


def test_lines_of_rows_without_id(spark):
    a = "alpha beta gamma delta epsilon\none two three four five six\n" + " ".join(words(33, 60))
    d = spark.createDataFrame([(None, a), (1, a), (2, a), (None, None)], "doc_id long, text string")
    got = [(x["doc_id"], x["text"], x["n_deleted"]) for x in line_dedup.remove_repeated_runs(d).collect()]
    assert sorted(got, key=str) == sorted([(None, a, 0), (1, a, 0), (2, "", 3), (None, None, 0)], key=str)


def test_line_dedup_of_overlaps_and_repeated_ids(spark):
    a, b, own = "alpha beta gamma delta epsilon", "one two three four five six", "nothing else holds this line\nnor this one of six words"
    texts = [(1, f"{a}\n{b}"), (2, f"{a}\n{b}"), (2, own), (3, f"{own}"), (4, "\n".join(["some words that make a line"] * 3)), (5, "x"), (5, "x")]
    d = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    got = sorted((x["doc_id"], x["text"]) for x in line_dedup.remove_repeated_runs(d).collect())
    assert got == sorted([(1, texts[0][1]), (2, ""), (2, own), (3, ""), (4, "\n".join(["some words that make a line"] * 2)), (5, "x"), (5, "x")])


def test_line_dedup_of_single_long_lines(spark):
    long, under = " ".join(words(31, 50)), " ".join(words(32, 49))
    texts = [f"a b\n{long}\nc d\n{under}", f"e f\n  {long} \ng h\n{under}\ni", f"{long}\nj\n{long}"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["text"], r["n_deleted"]) for r in line_dedup.remove_repeated_runs(d).collect()}
    assert got == {0: (texts[0], 0), 1: (f"e f\ng h\n{under}\ni", 1), 2: ("j", 2)}
    kept = line_dedup.remove_repeated_runs(d, single_words=None).collect()
    assert {r["doc_id"]: r["n_deleted"] for r in kept} == {0: 0, 1: 0, 2: 0}


def test_tokens_match_the_library():
    enc = tokens.encoder(tokens.default_path())
    for _, t, *_ in rows():
        assert enc.ids(t) == np.asarray(enc.whole.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes()


def test_coder_round_trip():
    r = np.random.default_rng(3)
    blocks = [np.zeros(0, np.uint16), np.array([65534, 0, 65534], np.uint16), r.integers(0, 50257, 1000).astype(np.uint16), np.tile(np.arange(50, dtype=np.uint16), 40), np.full(700, 7, np.uint16)]
    coded = context_coder.encode_blocks(blocks)
    assert all(np.array_equal(a, b) for a, b in zip(blocks, context_coder.decode_blocks(coded)))
    assert len(coded[3]) < 800 and len(coded[4]) < 200
    broken = bytearray(coded[2])
    broken[40] ^= 1
    with pytest.raises(ValueError):
        context_coder.decode_blocks([bytes(broken)])


def test_coder_learns_the_ids_of_a_block():
    r = np.random.default_rng(8)
    share = 1 / np.arange(1, 101)
    share /= share.sum()
    block = (r.permutation(50_000)[:100][r.choice(100, 20_000, p=share)]).astype(np.uint16)
    coded = context_coder.encode_blocks([block])
    assert 8 * len(coded[0]) / len(block) < 1.25 * -(share * np.log2(share)).sum()
    assert np.array_equal(context_coder.decode_blocks(coded)[0], block)


def test_batch_of_texts_matches_the_library(monkeypatch):
    enc = tokens.Encoder(tokens.default_path())
    odd = [None, "", " ", "\n", "a", " a", "a ", "a\n", "\na", "a \nb", "a\n b", "a\n\nb", "a  b", "a\tb c", "a\u00a0b \u00a0 c", "x\ud7ffy à.\nàb", "it's 12.5% <|endoftext|> b", "Ünï.\nÇa va?!\n1", "é" * 300]
    r = np.random.default_rng(4)
    many = [" ".join("".join(chr(97 + c) for c in r.integers(0, 26, 9)) for _ in range(500)) for _ in range(4)]
    texts = odd + many + [t for _, t, *_ in rows()] + odd
    calls = []

    class Model:
        def __init__(self, model):
            self.model = model

        def tokenize(self, x):
            calls.append(x)
            return self.model.tokenize(x)

    monkeypatch.setattr(enc.many.pieces, "model", Model(enc.many.pieces.model))
    enc.batch(pa.array(many, pa.string()), 2)
    assert len(calls) < 100  # 2,000 new words
    for _ in range(2):
        got, sizes = enc.batch(pa.array(texts, pa.string()), 2)
        assert [x.tolist() for x in np.split(got, np.cumsum(sizes)[:-1])] == [[*enc.whole.encode(t or "", add_special_tokens=False).ids, 2] for t in texts]
    monkeypatch.setattr(tokens, "MOST", 100)  # words forgotten between batches
    for k in range(0, len(texts), 7):
        got, sizes = enc.batch(pa.array(texts[k : k + 7], pa.string()), 2)
        assert got.tolist() == [i for t in texts[k : k + 7] for i in [*enc.whole.encode(t or "", add_special_tokens=False).ids, 2]]
    assert [len(x) for x in enc.batch(pa.array([], pa.string()), 2)] == [0, 0]


def test_coder_shares_a_table_and_beats_single_ids():
    r = np.random.default_rng(9)
    share = 1 / np.arange(1, 2001)
    share /= share.sum()
    names = r.permutation(50_000)[:2000]
    row = names[r.choice(2000, 1 << 17, p=share)].astype(np.uint16)
    row[1::2] = names[(row[0::2].astype(int) * 7) % 2000]  # every second id follows from the one before
    blocks = [row[i : i + 4096] for i in range(0, len(row), 4096)]
    tables = [context_coder.by_frequency(row)] * len(blocks)
    coded = context_coder.encode_blocks(blocks, tables)
    p = np.bincount(row)[np.unique(row)] / len(row)
    assert 8 * (sum(map(len, coded)) + 2 * len(tables[0])) / len(row) < -(p * np.log2(p)).sum()
    assert all(np.array_equal(a, b) for a, b in zip(blocks, context_coder.decode_blocks(coded, tables)))
    assert np.array_equal(context_coder.decode_blocks(coded[5:6], tables[5:6])[0], blocks[5])
    with pytest.raises(ValueError):
        context_coder.decode_blocks(coded[5:6], [tables[0][::-1]])
    every = r.permutation(65535).astype(np.uint16)  # all ids once: all classes
    assert np.array_equal(context_coder.decode_blocks(context_coder.encode_blocks([every]))[0], every)


def ids(t, end):
    enc = tokens.encoder(tokens.default_path())
    return np.append(np.asarray(enc.whole.encode(t or "", add_special_tokens=False).ids, "<u4"), np.uint32(end)).astype("<u4")


def test_token_files(spark, docs, none, tmp_path):
    token_files.write_token_files(docs, str(tmp_path / "a"), tokens.default_path())
    want, at = [], 0
    for i, t in sorted((r[0], r[1] or "") for r in rows()):
        x = ids(t, 2)
        want.append((i, at, len(x), zlib.crc32(x.tobytes())))
        at += len(x)
    assert sorted(map(tuple, token_files.read_token_files(spark, str(tmp_path / "a")).collect())) == sorted(want)
    token_files.write_token_files(none, str(tmp_path / "b"), tokens.default_path())
    assert token_files.read_token_files(spark, str(tmp_path / "b")).count() == 0


def test_packing(docs, none):
    got = packing.pack(docs, tokens.default_path()).collect()
    text = {r[0]: r[1] for r in rows()}
    for p in got:
        x = ids(text[p["doc_id"]], 0)
        part = x[p["start"] : p["start"] + p["length"]]
        assert p["doc_tokens"] == len(x) and len(part) == p["length"] and p["ids_crc32"] == zlib.crc32(part.tobytes())
    assert sum(p["length"] for p in got) == sum(len(ids(r[1], 0)) for r in rows())
    by = {}
    for p in sorted(got, key=lambda p: p["offset"]):
        assert by.get(p["sequence_id"], 0) == p["offset"]
        by[p["sequence_id"]] = p["offset"] + p["length"]
        assert by[p["sequence_id"]] <= p["sequence_size"] <= 1024
    assert packing.pack(none, tokens.default_path()).count() == 0
    h = np.zeros(1025, np.int64)
    h[[300, 724, 500]] = 10
    used = Counter()
    for ls, n in packing.repeats(h, 1024):
        assert sum(ls) <= 1024
        used.update({x: k * n for x, k in Counter(ls).items()})
    assert used == {300: 10, 724: 10, 500: 10}


def test_quality_rules(docs, none):
    got = {r["doc_id"]: r for r in robust_outliers.quality_rules(docs).collect()}
    for i, t, *_ in rows():
        w = split(t)
        seen = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        twice = {j for k in range(len(w) - 7) if seen[tuple(w[k : k + 8])] > 1 for j in range(k, k + 8)}
        lines = [x for x in (t or "").split("\n") if split(x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(twice))
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (len(w) < 20 or 100 * len(twice) > 30 * len(w)) and (not r["base_failed"] or not r["kept"])
    assert robust_outliers.quality_rules(none).count() == 0


def best_share(x, starts, seed):
    """Location and covariance of the three quarters of rows with the least determinant that random starts lead to."""
    floors, r, n = np.diag(np.square(robust_outliers.FLOORS)), np.random.default_rng(seed), len(x)
    h, best = int(np.ceil(robust_outliers.SHARE * n)), None
    for _ in range(starts):
        rows = x[r.choice(n, 6, replace=False)]
        for _ in range(12):
            m, c = rows.mean(0), np.cov(rows.T, bias=True) * robust_outliers.CONSISTENT + floors
            d = np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m)
            rows = x[np.argsort(d)[:h]]
        m, c = rows.mean(0), np.cov(rows.T, bias=True) * robust_outliers.CONSISTENT + floors
        if best is None or np.linalg.slogdet(c)[1] < best[0]:
            best = np.linalg.slogdet(c)[1], m, c
    return best


def test_robust_estimates_against_numpy(spark):
    r = np.random.default_rng(1)
    mix = r.normal(size=(4, 4))
    groups = {"a": r.normal(size=(600, 4)) @ mix, "b": 3 + r.normal(size=(300, 4)) * [1, 2, 0.5, 1], "c": r.normal(size=(40, 4)), "one": np.ones((1, 4))}
    groups["a"][:150] = [9, -9, 9, 4] + 0.1 * r.normal(size=(150, 4))
    groups["b"][:60, 2] = 40
    df = spark.createDataFrame([(g, *map(float, v)) for g, x in groups.items() for v in x], "grp string, u0 double, u1 double, u2 double, u3 double").repartition(3)
    got = {p["grp"]: p for p in robust_outliers.estimates(df).collect()}
    assert {g: p["n"] for g, p in got.items()} == {g: len(x) for g, x in groups.items()}
    for g in "abc":
        size, m, c = best_share(groups[g], 200, 7)
        mine = np.array([[got[g][f"c{min(i, j)}{max(i, j)}"] for j in range(4)] for i in range(4)]) * robust_outliers.CONSISTENT + np.diag(np.square(robust_outliers.FLOORS))
        assert np.linalg.slogdet(mine)[1] < size + (0.1 if g != "c" else 0.5)
        if g != "c":
            assert np.allclose([got[g][f"m{i}"] for i in range(4)], m, atol=0.1) and np.allclose(mine, c, rtol=0.15, atol=0.15)


def test_quality_verdicts_by_group(spark):
    r = np.random.default_rng(4)
    plain = lambda n, size: " ".join("x" * k for k in r.poisson(size, n) + 1)
    texts = [(i, plain(200, 4), "en", "a") for i in range(300)] + [(300 + i, plain(200, 9), "de", "b") for i in range(199)] + [(600 + i, plain(200, 9), "de", None) for i in range(3)]
    texts += [(700, plain(200, 30), "en", "a"), (701, plain(200, 30), "de", "b"), (702, plain(60, 4) + " #$%&" * 40, "en", "a"), (703, plain(200, 4), None, ""), (704, plain(200, 4), "", None)]
    got = {x["doc_id"]: x for x in robust_outliers.quality_rules(spark.createDataFrame(texts, "doc_id long, text string, lang string, source string")).collect()}
    judged = {i: x["kept"] for i, x in got.items() if not x["base_failed"]}
    assert not any(judged.get(i, False) for i in (700, 701, 702))
    assert np.mean([k for i, k in judged.items() if i < 700]) > 0.98 and all(judged.get(i, True) for i in (600, 601, 602))


def test_quality_classifier(spark, docs, none):
    train = spark.createDataFrame([(i, " ".join(words(i, 60)) if i % 2 else "### $$$ !!! " * 20) for i in range(80)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(61, None)], "doc_id long, quality int")
    got = {r["doc_id"]: r["predicted"] for r in quality_classifier.classify(train, labels).collect()}
    assert got == {i: i % 2 for i in range(80)}
    assert {r["score"] for r in quality_classifier.classify(docs, labels.where("quality is null")).collect()} == {0.5}
    assert quality_classifier.classify(none, labels).count() == 0


def test_quality_scores_against_numpy(spark):
    r = np.random.default_rng(11)
    texts = [(i, "\n".join(" ".join(words(1000 * i + k, int(r.integers(1, 12)))) + ("!#" * int(r.integers(0, 3)) if i % 2 else "") for k in range(int(r.integers(1, 9))))) for i in range(120)]
    d = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, i % 2) for i in range(90)], "doc_id long, quality int")
    rows = {x["doc_id"]: np.array([x[f] for f in quality_classifier.FEATURES]) for x in quality_classifier.statistics(d).collect()}
    parts = {k: np.array([rows[i] for i in range(90) if i % 2 == k]) for k in (0, 1)}
    own = {k: np.cov(x.T, bias=True) for k, x in parts.items()}
    common = sum(len(parts[k]) * own[k] for k in (0, 1)) / 90
    log = {}
    for k in (0, 1):
        c = (1 - quality_classifier.DIAGONAL) * ((1 - quality_classifier.POOLED) * own[k] + quality_classifier.POOLED * common)
        c += quality_classifier.DIAGONAL * np.diag(np.diag(common)) + quality_classifier.RIDGE * np.eye(len(c))
        x = np.array([rows[i] for i in range(120)]) - parts[k].mean(0)
        log[k] = np.log(len(parts[k]) / 90) - 0.5 * np.linalg.slogdet(c)[1] - 0.5 * np.einsum("ij,jk,ik->i", x, np.linalg.inv(c), x)
    want = 1 / (1 + np.exp(-np.clip(log[1] - log[0], -30, 30)))
    got = {x["doc_id"]: x["score"] for x in quality_classifier.classify(d, labels).collect()}
    assert np.allclose([got[i] for i in range(120)], want, atol=1e-6)


def test_toxicity(spark, docs, none):
    bad = [("badword", "awful1", "awful2", "awful3")[i % 4] for i in range(400)]
    train = [(i, " ".join(words(i, 90) + ([bad[i]] if i % 2 else []) + words(i + 500, 60))) for i in range(400)]
    d, labels = spark.createDataFrame(train, "doc_id long, text string"), spark.createDataFrame([(i, i % 2) for i in range(300)], "doc_id long, toxic int")
    got = toxicity.score(d, labels).where("doc_id >= 300").collect()
    pos, neg = ([r["score"] for r in got if r["doc_id"] % 2 == y] for y in (1, 0))
    assert np.mean([a > b for a in pos for b in neg]) > 0.8
    edge = {r["doc_id"]: r["score"] for r in toxicity.score(docs, labels.withColumn("doc_id", F.col("doc_id") + 10**6)).collect()}
    assert set(edge.values()) == {0.0}
    assert toxicity.score(none, labels).count() == 0


def test_decontamination(spark, docs, none):
    q = "Tom has 12 apples and gives 5 apples to each of his friends before he walks 3 km back home"
    items = spark.createDataFrame([(1, q), (2, "one two three four five six seven"), (3, None), (4, "short")], "item_id long, text string")
    other = q.replace("12", "40").replace(" 5 ", " 7 ").replace(" 3 ", " 9 ")
    twisted = q.replace("apples to", "pears to")
    texts = ["Well. " + q + " Yes.", other, twisted, "say one two, three four FIVE six seven now", None, "", "nothing here"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.leaks(d, items).collect()}
    assert got == {(0, 1), (1, 1), (3, 2)}
    assert sorted(r["doc_id"] for r in decontamination.decontaminate(d, items).collect()) == [2, 4, 5, 6]
    assert decontamination.leaks(none, items).count() == 0 and decontamination.leaks(docs, items.where("item_id > 2")).count() == 0


def found(spark, texts, items):
    schema = "doc_id long, text string", "item_id long, text string"
    got = decontamination.leaks(spark.createDataFrame(list(enumerate(texts)), schema[0]), spark.createDataFrame(list(enumerate(items)), schema[1]))
    return {(r["doc_id"], r["item_id"]): (r["n_windows"], r["n_slots"]) for r in got.collect()}


def test_decontamination_by_occurrence(spark):
    q = "the shop sells 12 apples and then 5 pears to each of those people"
    again = "first add 3 cups of flour to the bowl and stir it well then add 4 cups of flour to the bowl and stir it well then rest"
    variant = q.replace("12", "40").replace(" 5 ", " 7 ")
    bent = "the shop sells 12 apples and then 12 pears to each of those people"
    texts = [f"{q}. {variant}.", f"so {variant} or {variant.replace('40', '41')}", f"well {again} now", again.replace("3", "8").replace("4", "9"), bent]
    assert found(spark, texts, [q, again]) == {(0, 0): (4, 4), (1, 0): (4, 3), (2, 1): (16, 4), (3, 1): (16, 4)}


def test_decontamination_of_names_and_short_items(spark):
    pens = "Anna has 3 pens. Anna buys 2 more pens and gives all of them away. How many are left?"
    items = ["Anna has 3 pens and buys 2 more", "What is 17 * 23 + 4?", "Name the capital", pens]
    texts = [
        "Ben has 5 pens and buys 7 more", "we heard, Anna has 3 pens and buys 2 more", "Now: What is 17 * 23 + 4? Yes", "What is 18 * 23 + 4?", "please name the capital of it", "Name a capital",
        pens.replace("Anna", "Ben").replace("3", "8"), "6 has 5 pens and buys 7 more", pens.replace("Anna has", "Ben has"),
    ]
    assert set(found(spark, texts, items)) == {(0, 0), (1, 0), (2, 1), (4, 2), (6, 3), (8, 3)}


def test_warc(spark, tmp_path):
    html = '<html lang="en"><head><title>A &amp; B</title><style>p{}</style></head><body><!-- x --><p>One<br>two &lt;3</p><a href="/x">link</a></body></html>'
    pages = spark.createDataFrame([(1, "http://a/", html, "z"), (2, None, None, "z")], "page_id long, url string, html string, block string")
    source = warc.responses(pages)
    made = warc.derivatives(source)
    got = {(r["page_id"], r["warc_type"]): r for r in made.collect()}
    assert got[1, "conversion"]["block"] == "One\ntwo <3\nlink" and got[2, "conversion"]["block"] == ""
    assert "title: A &amp; B\r\nlanguage: en\r\nlinks: 1\r\n" in got[1, "metadata"]["block"]
    ids = {r["page_id"]: r["record_id"] for r in source.collect()}
    assert all(r["refers_to"] == ids[r["page_id"]] for r in got.values()) and len({r["record_id"] for r in got.values()}) == 4
    everything = source.drop("page_id").unionByName(made.drop("page_id"))
    warc.write_records(everything, str(tmp_path / "w"))
    back = warc.read_records(spark, str(tmp_path / "w"))
    cols = ["record_id", "warc_type", "refers_to", "target_uri", "block_digest", "payload_digest", "content_length", "block"]
    key = lambda x: sorted(map(str, x.select(*cols).collect()))
    assert key(back) == key(everything)
    assert warc.derivatives(warc.responses(pages.limit(0))).count() == 0


def test_warc_blocks_that_look_like_records(spark, tmp_path):
    quoted = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc"
    html = [f"before\r\n\r\n{quoted}\r\n\r\nafter", "\r\n\r\nWARC/1.", "é" * 9 + "\r\n\r\n", "", "plain"]
    pages = spark.createDataFrame([(i, f"http://a/{i}", h) for i, h in enumerate(html)], "page_id long, url string, html string").repartition(2)
    source = warc.responses(pages)
    warc.write_records(source.drop("page_id"), str(tmp_path / "w"))
    key = lambda x: sorted(map(str, x.select("record_id", "target_uri", "content_length", "block").collect()))
    assert key(warc.read_records(spark, str(tmp_path / "w"))) == key(source)
    (tmp_path / "plain.warc").write_bytes(b"WARC/1.0\r\nWARC-Type: metadata\r\nContent-Length: 2\r\n\r\nok\r\n\r\nWARC/1.0\r\nWARC-Type: metadata\r\nContent-Length: 9\r\n\r\ncut")
    assert [r["block"] for r in warc.read_records(spark, str(tmp_path / "plain.warc")).collect()] == ["ok"]
