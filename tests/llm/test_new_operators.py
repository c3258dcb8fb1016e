"""Operators 11 to 13 against brute force."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from netohm.llm import spelling, token_counts, tokens, whitening

SCHEMA = "doc_id long, text string, n long, word string, tokens string"


# --- 11 ---


@pytest.mark.parametrize("kind", ["plain", "ties", "one", "low rank", "close", "graded"])
@pytest.mark.parametrize("d", [1, 2, 7, 64])
def test_spectrum_against_numpy(kind, d):
    r = np.random.default_rng(d)
    e = {"plain": r.random(d) * 900, "ties": np.resize([5.0, 2.0, 1.0], d), "one": np.full(d, 3.0), "low rank": np.where(np.arange(d) < 2, 7.0 + np.arange(d), 0), "close": 1000 * (1 + 1e-7 * r.random(d)), "graded": 10.0 ** -np.arange(d)}[kind]
    q = np.linalg.qr(r.standard_normal((d, d)))[0]
    a = (q * e) @ q.T
    values, vectors = whitening.components((a + a.T) / 2)
    assert np.allclose(values, np.sort(e)[::-1], atol=1e-13 * e.max(), rtol=0)
    assert np.abs(vectors.T @ vectors - np.eye(d)).max() < 1e-13
    assert np.abs(a @ vectors - vectors * values).max() < 1e-12 * e.max()


def test_polar_is_the_sign():
    r = np.random.default_rng(1)
    q = np.linalg.qr(r.standard_normal((9, 9)))[0]
    e = np.array([5, 3, 1, 1e-6, -1e-9, -2, -2, -40, 100.0])
    assert np.allclose(whitening.polar((q * e) @ q.T), (q * np.sign(e)) @ q.T, atol=1e-6)


def vectors():
    r = np.random.default_rng(7)
    rows = [(i, [float(x) for x in r.standard_normal(6) * [3, 1, 2, 0.5, 0.1, 1]]) for i in range(200)]
    rows += [(500 + i, rows[3][1]) for i in range(90)] + [(3, rows[3][1]), (3, rows[4][1])]
    return rows + [(900, None), (901, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (902, [float("nan")] * 6), (903, [float("inf")] * 6), (904, []), (905, [1.0, 2.0]), (906, [-0.0] * 6)]


def test_whitening(spark):
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in vectors()], "vec_id long, embedding array<float>, x string, n int").repartition(3)
    got = whitening.whiten(df).collect()
    rows = [(i, np.floor(256 * np.array(v, np.float32).astype(float)).astype(int)) for i, v in vectors() if v and len(v) == 6 and all(y is not None and np.isfinite(y) for y in v)]
    fit = np.unique(np.array([x for _, x in rows]), axis=0)
    n, s = len(fit), fit.sum(0)
    c = fit - s / n
    e, q = np.linalg.eigh(c.T @ c / n)
    e, q = e[::-1], q[:, ::-1]
    want = {}
    for i, x in rows:
        for k in range(4):
            want.setdefault((i, k + 1, int(((n * x - s) ** 2).sum())), []).append((x - s / n) @ q[:, k] / np.sqrt(e[k]))
    ours = {}
    for r in got:
        ours.setdefault((r.vec_id, r.component, r.deviation), []).append(r.whitened)
        assert r.n == n and r.identity_error <= 1e-9 and abs(r.explained - e[r.component - 1] / e.sum()) < 1e-12
    assert ours.keys() == want.keys()
    for k in range(1, 5):
        a, b = (np.array([x for key in sorted(want) if key[1] == k for x in sorted(of[key])]) for of in (ours, want))
        flipped = np.array([x for key in sorted(want) if key[1] == k for x in sorted(-y for y in want[key])])
        assert min(np.abs(a - b).max(), np.abs(a - flipped).max()) < 1e-9
    assert not whitening.whiten(df.limit(0)).collect()
    assert not whitening.whiten(df.where("vec_id between 500 and 600")).collect()  # one distinct vector
    line = spark.createDataFrame([(i, [float(i), 2.0 * i, 0.0]) for i in range(50)], "vec_id long, embedding array<double>")
    assert {r.component for r in whitening.whiten(line).collect()} == {1}


# --- 12 ---


def texts():
    r = np.random.default_rng(3)
    letters = np.array(list("abcdeéßÀxyz"))
    base = ["".join(r.choice(letters, int(r.integers(5, 11)))) for _ in range(250)]
    base += ["aaaaaaa", "aaaaaaaa", "aaaaaab", "baaaaaa", "abcabcabc", "bcabcabc", "q" * 3000, "q" * 2999, "q" * 2998 + "z", "Ürgendwo", "ürgendwo"]
    near = []
    for w in base[:120]:
        k, c = int(r.integers(0, len(w))), str(r.choice(letters))
        near += [w[:k] + w[k + 1 :], w[:k] + c + w[k + 1 :], w[:k] + c + w[k:]]
    common = base[:40]
    out = [(i, " ".join([*r.choice([*base, *near], 60), *np.repeat(r.choice(common, 5), 12), *base[-11:]]).replace("a", "A") if i % 2 else " ".join(r.choice([*base, *near], 80))) for i in range(60)]
    return [*out, (None, "Wörterbuch wörterbuch Wörterbuch"), (70, None), (71, ""), (72, "kurz 12 ,,"), (3, "zebrastreifen-zebrastreifen×zebra")]


def brute(rows, damaged):
    n = Counter()
    for i, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = re.sub("[A-Z]", lambda m: m.group().lower(), w)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if damaged and h % damaged == 0:
                k = h % len(w)
                w = w[:k] + w[k + 1 :]
            n[w] += 1
    words = {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}
    cut = {}
    for w in words:
        for k in range(len(w)):
            cut.setdefault((w[:k] + w[k + 1 :], None), set()).add(w)
            cut.setdefault((w[:k] + w[k + 1 :], k), set()).add(w)
    out = {}
    for w, c in words.items():
        near = set()
        for k in range(len(w)):
            short = w[:k] + w[k + 1 :]
            near |= cut[short, k] - {w}  # replaced
            near |= {short} & words.keys()
        near |= cut.get((w, None), set())  # those with one letter more
        best = min(near, key=lambda x: (-words[x], x), default=None)
        out[w] = (len(near), best if best is not None and words[best] >= 10 * c else None)
    rows = []
    for w, c in words.items():
        root = w
        while out[root][1]:
            root = out[root][1]
        rows.append((w, out[w][1], root, c, out[w][0], words.get(out[w][1])))
    return sorted(rows, key=lambda r: r[0])


@pytest.mark.parametrize(("damaged", "block"), [(None, 16384), (31, 16384), (5, 64)])
def test_spelling_variants(spark, monkeypatch, damaged, block):
    monkeypatch.setattr(spelling, "BLOCK", block)
    df = spark.createDataFrame([(i, t, 1, "x", "y") for i, t in texts()], SCHEMA).repartition(3)
    got = sorted(map(tuple, spelling.variants(df, damaged).collect()), key=lambda r: r[0])
    want = brute(texts(), damaged)
    assert got == want
    assert sum(r[1] is not None for r in want) > 10 and len(want) > 200
    assert not spelling.variants(df.limit(0), damaged).collect()


def test_large_groups_of_words_in_blocks(spark):
    r = np.random.default_rng(5)
    words = sorted({"pre" + "".join(r.choice(list("abc"), 6)) for _ in range(900)})
    df = spark.createDataFrame([(w, 2 + k % 3) for k, w in enumerate(words)], "word string, n long")
    whole = {tuple(x) for x in spelling.near_words(df).collect()}
    before, spelling.BLOCK = spelling.BLOCK, 64
    try:
        assert {tuple(x) for x in spelling.near_words(df).collect()} == whole
    finally:
        spelling.BLOCK = before


def test_roots(spark):
    rows = [(f"w{i}", f"w{i + 1}") for i in range(11)] + [("a", "b"), ("c", "w3")]
    got = dict(map(tuple, spelling.roots(spark.createDataFrame(rows, "word string, form string")).collect()))
    assert got == {f"w{i}": "w11" for i in range(11)} | {"a": "b", "c": "w11"}


# --- 13 ---


def odd_texts():
    r = np.random.default_rng(9)
    chars = list("ab cd  \n\n\t'sé½日本 ÀÉ12,.!?-_<|>") + [" ", " ", "\r", "\x1c", "\x85", "🎉", "é", "<|endoftext|>", "'ll", " 'm", "İ"]
    made = ["".join(r.choice(chars, int(r.integers(1, 60)))) for _ in range(300)]
    return [None, "", " ", "\n", "a", "x" * 5000, "=" * 200 + " " + "=" * 200, "naïve " * 500, "a<|endoftext|>b <|endoftext|> ", "<|endoftext|>" * 3, "a b " * 3000, "  lead and trail  ", *made]


@pytest.mark.parametrize("head", [0, 20, 200_000])
def test_token_counts(spark, head):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokens.default_path())
    rows = [(i, t, 1, "x", "y") for i, t in enumerate(odd_texts())]
    rows += [(5, "other text of an id", 0, None, None), rows[7], rows[7], (None, "no id at all", 0, None, None), (None, "x" * 5000, 0, None, None)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = sorted(map(tuple, token_counts.count_tokens(df, tokens.default_path(), head=head).collect()), key=str)
    want = []
    for i, t, *_ in rows:
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        want.append((i, len((t or "").encode()), n, n > 1024))
    assert got == sorted(want, key=str)
    assert not token_counts.count_tokens(df.limit(0), tokens.default_path()).collect()
    counts = token_counts.piece_counts(df, tokens.default_path())
    assert counts.count() == counts.select("key").distinct().count()


def test_token_counts_refuse_other_files(spark):
    import public_tokenizers

    with pytest.raises(ValueError, match="byte-level"):
        token_counts.count_tokens(spark.createDataFrame([(1, "a")], "doc_id long, text string").withColumn("x", F.lit(1)), public_tokenizers.path("word_bpe_49k.json"))


# --- 5 and 6 ---


def decontamination_tokens(text):
    import regex

    from netohm.llm.decontamination import UNITS

    t = re.sub(r"(\d)[.,](?=\d)", r"\1", text or "")
    t = regex.sub(rf"(\d) ?((?i:{UNITS}))(?![\p{{L}}\p{{N}}])", r"\1 0U\2", t)
    t = regex.sub(r" (?<=[\p{Ll}\d,;] )(?=\p{Lu}\p{Ll})", " 0P", t)
    t = regex.sub(r"(?=\p{Lu})(?<![\p{L}\p{N}])", "0Q", t)
    return [w for w in regex.split(r"[^\p{L}\p{N}]+", t.lower()) if w]


def leaks_by_brute_force(docs, items, window, least):
    """All windows of all texts against all windows of all items."""
    from netohm.llm.decontamination import MARKS, NUMBERS

    marked = lambda w: w[:2] in MARKS and len(w) > 2
    bare = lambda w: w[2:] if marked(w) else w

    def slot(w, names):
        if bare(w) in NUMBERS:
            return "n"
        if marked(w):
            return ("p" if names else None) if w[:2] == "0q" else w[1]
        return "n" if w[0] <= "9" else None

    def code(own, kind):
        if kind == "exact":
            return tuple(map(bare, own))
        return tuple(slot(w, kind == "name") or ":" + bare(w) for w in own)

    out = {}
    for doc, text in {(d, t) for d, t in docs if t}:
        words = decontamination_tokens(text)
        for item, its in items:
            q = decontamination_tokens(its)
            size = min(len(q), window)
            places, met = set(), {}
            for a in range(len(q) - size + 1 if size else 0):
                own = q[a : a + size]
                sure, every = (sum(slot(w, n) is not None for w in own) for n in (False, True))
                kinds = [k for k, ok in (("word", len(q) >= least and 2 * sure <= size), ("name", len(q) >= least and 2 * every <= size), ("exact", len(q) < least or 2 * every > size)) if ok]
                for b in range(len(words) - size + 1):
                    ours = words[b : b + size]
                    for kind in kinds:
                        if code(own, kind) != code(ours, kind):
                            continue
                        pairs = {(slot(x, kind == "name") + ":" + bare(x), slot(x, kind == "name") + ":" + bare(y)) for x, y in zip(own, ours) if kind != "exact" and slot(x, kind == "name")}
                        if pairs:
                            held = met.setdefault((kind, b - a), (set(), set()))
                            held[0].update(pairs)
                            held[1].add(b)
                        else:
                            places.add(b)
            values = set()
            for pairs, at in met.values():
                if len({x for x, _ in pairs}) == len(pairs) == len({y for _, y in pairs}):
                    places |= at
                    values |= pairs
            if places:
                n, m = out.get((doc, item), (0, 0))
                out[doc, item] = n + len(places), m + len(values)
    return out


@pytest.mark.parametrize("rows", [0, 500_000])
def test_decontamination_against_all_windows(spark, rows):
    from netohm.llm import decontamination

    r = np.random.default_rng(11)
    some = ["apples", "buys", "red", "then", "walks", "shop", "12", "7", "7", "3,5", "4 km", "two", "Anna", "Ben", "So", "Anna", "km", "x.", "Well,"]
    text = lambda n: " ".join(r.choice(some, n))
    items = [(i, text(int(r.integers(1, 12)))) for i in range(12)] + [(20, None), (21, ""), (0, "apples buys red then walks 7 shop")]
    docs = [(i, text(int(r.integers(0, 60)))) for i in range(60)]
    docs += [(70 + i, f"{text(3)} {x} {text(3)}") for i, (_, x) in enumerate(items) if x] + [(5, items[1][1]), (5, (items[1][1] or "").replace("7", "9")), (90, None), (3, docs[3][1])]
    # a text of a doc_id with the item, and another with other figures at the same place
    q = "the shop sells 12 apples and then 5 pears"
    items.append((30, q))
    docs += [(95, q), (95, q.replace("12", "40").replace("5", "6"))]
    d, b = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")
    got = {(x["doc_id"], x["item_id"]): (x["n_windows"], x["n_slots"]) for x in decontamination.leaks(d, b, 5, 3, rows).collect()}
    # items of one id count together, as their windows do
    assert {k: v for k, v in got.items() if k[1] != 0} == leaks_by_brute_force(docs, [x for x in items if x[0] != 0], 5, 3)
    assert {k for k in got if k[1] == 0} == {k for x in items if x[0] == 0 for k in leaks_by_brute_force(docs, [x], 5, 3)}
    assert (95, 30) in got and len(got) > 30


def test_warc_files_in_splits(spark, tmp_path):
    from netohm.llm import warc

    quoted = "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    rows = [(f"<id:{i}>", f"{'x' * (i * 7)}{quoted * (i % 4)}{'y' * 50}") for i in range(40)]
    raw = [(f"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: {i}\r\nContent-Length: {len(b)}\r\n\r\n{b}\r\n\r\n").encode() for i, b in rows]
    (tmp_path / "w").mkdir()
    (tmp_path / "w/a.warc").write_bytes(b"".join(raw[:25]))
    (tmp_path / "w/b.warc").write_bytes(b"".join(raw[25:]))
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for size in ("300", "1000", "7000"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "0")
            assert sorted((r["record_id"], r["block"]) for r in warc.read_records(spark, str(tmp_path / "w")).collect()) == sorted(rows)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


# --- 9 ---


def test_pages_that_share_a_frame(spark):
    import time

    from netohm.llm import order_minhash

    r = np.random.default_rng(17)
    frame = [f"f{x}" for x in range(150)]
    own = lambda i, n: [f"p{i}x{x}" for x in range(n)]
    pages = [frame + own(i, 100) for i in range(2000)]
    # two near copies of one page, a page of another length, and a family that a chain of edits holds together
    pages += [[*pages[7][:-3], "a", "b", "c"], [*pages[7][:-6], "a", "b", "c"], frame + own(7, 40)]
    chain = frame + own("c", 50)
    for i in range(30):
        chain = list(chain)
        chain[int(r.integers(150, 200))] = f"e{i}"
        pages.append(chain)
    d = spark.createDataFrame([(i, " ".join(p)) for i, p in enumerate(pages)], "doc_id long, text string").repartition(4)
    began = time.time()
    got = dict(map(tuple, order_minhash.near_duplicates(d).collect()))
    assert time.time() - began < 180
    want = {i: i for i in range(2003)} | {2000: 7, 2001: 7} | {2003 + i: 2003 for i in range(30)}
    assert got == want


@pytest.mark.parametrize("small", [2, 16, 10_000])
def test_classes_do_not_depend_on_what_counts_as_large(spark, small):
    from netohm.llm import order_minhash

    r = np.random.default_rng(23)
    base = [[f"b{f}w{x}" for x in range(120)] for f in range(3)]
    texts = []
    for i in range(90):
        w = list(base[i % 3])
        for j in r.choice(120, int(r.integers(0, 9)), replace=False):
            w[j] = f"e{i}x{j}"
        texts.append(w)
    d = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    code = {}
    seqs = [np.array([code.setdefault(x, len(code)) for x in t], np.uint32) for t in texts]
    root = list(range(90))
    for i in range(90):
        for j in range(i):
            if order_minhash.aligned(seqs[i], seqs[j], 5, 0.8) >= 0.8:
                u, v = root[i], root[j]
                root = [min(u, v) if x in (u, v) else x for x in root]
    assert dict(map(tuple, order_minhash.near_duplicates(d, small=small).collect())) == dict(enumerate(root))


# --- 2 ---


def small_network(seed=3):
    from netohm.llm import toxicity as X

    r = np.random.default_rng(seed)
    net = X.Network(np.zeros(0, np.uint64), np.zeros((1, X.WORD_DIM), np.float32), r.standard_normal((X.CHAR_TABLE, X.CHAR_DIM)).astype(np.float32), seed)
    return X, r, net


def test_gradients_against_differences():
    X, r, net = small_network()
    x = r.standard_normal((9, X.WORD_DIM + X.CHAR_DIM)).astype(np.float32)
    window = r.integers(0, 9, (5, X.WIDTH))
    for i, n in enumerate((1, 7, 20, 48, 33)):
        window[i, n:] = -1
    y = np.array([0, 1, 1, 0, 1], np.float32)

    def loss(x):
        logit = net.run(net.gates(x), window)[0].astype(float)
        return np.mean(np.logaddexp(0, logit) - y * logit)

    g, dx = net.gradient(x, window, y)
    step = 1e-2
    for name in ("w", "b", "v", "Wf", "Uf", "cf", "Wb", "Ub", "cb"):
        p = net.p[name]
        for at in {tuple(int(r.integers(0, n)) for n in p.shape) for _ in range(6)}:
            old = p[at]
            p[at] = old + step
            up = loss(x)
            p[at] = old - step
            down = loss(x)
            p[at] = old
            assert abs((up - down) / (2 * step) - g[name][at]) < 2e-4 + 0.02 * abs(g[name][at]), (name, at)
    for at in [(0, 0), (3, 5), (8, 15)]:
        up, down = x.copy(), x.copy()
        up[at] += step
        down[at] -= step
        assert abs((loss(up) - loss(down)) / (2 * step) - dx[at]) < 2e-4 + 0.02 * abs(dx[at])


def test_scores_window_by_window():
    import pyarrow as pa

    X, r, net = small_network(4)
    texts = [" ".join(f"word{x}" for x in r.integers(0, 40, n)) for n in (1, 20, 48, 49, 81, 200)] + ["", None, "...", "x " * 70]
    got = net.scores(pa.array(texts, pa.string()), most=3)
    for text, score in zip(texts, got):
        words = (text or "").replace(".", " ").split()
        starts = [0, *range(X.STRIDE, len(words) - X.WIDTH + X.STRIDE, X.STRIDE)] if words else []
        each = [float(net.scores(pa.array([" ".join(words[s : s + X.WIDTH])]))[0]) for s in starts]
        assert abs(max(each, default=0.0) - score) < 1e-5


def test_a_toxic_span_counts_wherever_it_starts():
    """Spans of up to WIDTH - STRIDE + 1 words lie whole in a window, so no place in a long text hides one."""
    import pyarrow as pa

    X, _, _ = small_network()
    for n in (1, 20, X.WIDTH - X.STRIDE + 1):
        for length in (n, 60, 137, 300):
            inp = X.Inputs(pa.array([" ".join(f"w{k}" for k in range(length))], pa.string()))
            at, end = inp.at, inp.at + inp.size
            assert all(((at <= k) & (k + n <= end)).any() for k in range(length - n + 1))
