"""Spelling variants by a bit-sliced position index over the vocabulary.

Words are counted first; those of MIN_LENGTH letters and MIN_COUNT occurrences form the vocabulary. Two words are near if one
inserted, deleted or replaced letter makes one of the other. Near words have their first three letters or their last four in
common, as one change lies in one place of seven letters or more; so words meet in groups by those letters and by length.

In a group the index holds, for each position and letter, a bit set of the words with that letter there. A query word is read
letter by letter for all of the group's words at once: the zero-error set Z keeps words that agree so far, the one-error set E
words with one change so far. With M the bit set of position i and letter c,

    replaced, equal lengths:        E' = E & M[i, c] | Z & ~M[i, c]         Z' = Z & M[i, c]
    query has one letter more:      E' = E & M[i - 1, c] | Z
    index word has one letter more: E' = E & M[i + 1, c] | Z'

Bits stand in order of falling count and rising word: near words are counted by the bits set, the most frequent one is the lowest bit.
No pairs are made. Groups of more than BLOCK words are dealt into blocks of index words and of queries.

Defined cases: null and empty texts have no words; null doc_ids count as empty text in a word's hash; repeated rows count each
with its words; an empty table gives no rows; extra columns are ignored; words of any length are kept whole.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netohm.llm.work import ship, written

MIN_LENGTH, MIN_COUNT, FACTOR = 7, 2, 10
#: Letters at a word's front and end by which near words of seven letters or more meet: one of the two is untouched by the change.
FRONT, END = 3, 4
#: Words of an index block; long words get smaller blocks. Bit sets of words of over HELD letters are made position by position.
BLOCK, HELD = 16_384, 1024
#: Rows of large groups' numbers of blocks up to which they are broadcast (some 20 bytes each).
BROADCAST_GROUPS = 100_000
#: 64-bit words of bit sets that a step of the recurrence holds for its queries.
STEP = 1 << 19
#: Runs that a task holds before it hands its counts on.
MOST = 400_000
_SMALL = {c: c + 32 for c in range(65, 91)}


def _lowered(run: str) -> str:
    return run.lower() if run.isascii() else run.translate(_SMALL)


def _counts(damaged: int | None):
    """Words with their occurrences by task; where damaged divides a run's hash, the run loses the letter at hash % length."""
    runs = re.compile(r"[A-Za-zÀ-ÿ]{%d,}" % MIN_LENGTH)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        small: dict[str, tuple[str, bytes]] = {}
        held: dict[str, int] = {}

        def rows():
            return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])

        for b in batches:
            for doc, text in zip(b.column("doc").to_pylist(), b.column("text").to_pylist()):
                start = zlib.crc32(f"{doc}:".encode())
                for found, n in Counter(runs.findall(text or "")).items():
                    known = small.get(found)
                    if known is None:
                        if len(small) >= MOST:
                            small.clear()
                        w = _lowered(found)
                        known = small[found] = (w, w.encode())
                    word, own = known
                    if damaged and not (h := zlib.crc32(own, start)) % damaged:
                        k = h % len(word)
                        word = word[:k] + word[k + 1 :]
                        if len(word) < MIN_LENGTH:
                            continue
                    held[word] = held.get(word, 0) + n
                if len(held) >= MOST:
                    yield rows()
                    held.clear()
        if held:
            yield rows()

    return run


def vocabulary(docs: DataFrame, damaged: int | None = None, count: int = MIN_COUNT) -> DataFrame:
    """word, n: runs of Latin letters, A to Z in small letters, of MIN_LENGTH letters and `count` occurrences or more over all texts.

    damaged: runs of which crc32 of `<doc_id>:<run>` is a multiple lose a letter, which stands for misspellings.
    """
    ship(docs.sparkSession)
    texts = docs.where(F.col("text").isNotNull()).select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), "text")
    found = texts.mapInArrow(_counts(damaged), "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= count)


class Index:
    """Bit sets by position and letter over words of one length, in the order given."""

    def __init__(self, words: list[str]):
        self.length, self.n, self.size = len(words[0]), len(words), -(-len(words) // 64)
        self.codes = np.frombuffer("".join(words).encode("latin-1"), np.uint8).reshape(self.n, self.length)
        letters = np.unique(self.codes)
        self.letters = len(letters)
        self.letter = np.full(256, self.letters)  # others have no bits
        self.letter[letters] = np.arange(self.letters)
        self.every = self._packed(np.ones((1, self.n), bool))[0]
        self.none = np.zeros((self.letters + 1, self.size), np.uint64)
        self.held = [self._made(p) for p in range(self.length)] if self.length <= HELD else None

    def _packed(self, of: np.ndarray) -> np.ndarray:
        wide = np.zeros((len(of), self.size * 64), bool)
        wide[:, : self.n] = of
        return np.packbits(wide, axis=1, bitorder="little").view("<u8")

    def _made(self, p: int) -> np.ndarray:
        of = np.zeros((self.letters + 1, self.n), bool)
        of[self.letter[self.codes[:, p]], np.arange(self.n)] = True
        return self._packed(of)

    def at(self, p: int) -> np.ndarray:
        """The bit set of each letter at position p; none outside the words."""
        if not 0 <= p < self.length:
            return self.none
        return self.held[p] if self.held else self._made(p)

    def near(self, words: list[str], front: int) -> np.ndarray:
        """Bit sets of the words one change away from each of `words` (of one length); front: without those that share so many first letters."""
        length = len(words[0])
        letters = self.letter[np.frombuffer("".join(words).encode("latin-1"), np.uint8).reshape(len(words), length)]
        zero = np.broadcast_to(self.every, (len(words), self.size))
        longer = length - self.length
        one = zero if longer < 0 else np.zeros_like(zero)
        shared = zero
        for i in range(length):
            c = letters[:, i]
            hit = self.at(i)[c]
            if longer == 0:
                one = one & hit | zero & ~hit
                zero = zero & hit
            elif longer > 0:
                one = one & self.at(i - 1)[c] | zero
                zero = zero & hit
            else:
                zero = zero & hit
                one = one & self.at(i + 1)[c] | zero
            if i + 1 == front:
                shared = zero
        return one & ~shared if front else one


def _best(index: Index, known: list[tuple[str, int]], queries: list[str], front: int) -> Iterator[tuple[str, int, int, str]]:
    """word, n_near, and the count and word of its near word of largest count, for queries of one length that have near words."""
    step = max(1, min(STEP // index.size, 8 * STEP // len(queries[0])))
    for a in range(0, len(queries), step):
        some = queries[a : a + step]
        near = index.near(some, front)
        n = np.bitwise_count(near).sum(1, dtype=np.int64)
        rows = np.flatnonzero(n)
        first = (near[rows] != 0).argmax(1)
        low = near[rows, first]
        bit = np.bitwise_count((low & -low) - np.uint64(1)).astype(np.int64)
        for r, k, m in zip(rows.tolist(), (first * 64 + bit).tolist(), n[rows].tolist()):
            yield some[r], m, known[k][1], known[k][0]


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, pa.Table]]:
    """Rows of each run of one value of g."""
    now, held = None, []
    for b in batches:
        if not b.num_rows:
            continue
        g = b.column("g")
        cuts = [0, *(np.flatnonzero(pc.not_equal(g[1:], g[:-1]).to_numpy(zero_copy_only=False)) + 1).tolist(), b.num_rows]
        for a, z in zip(cuts, cuts[1:]):
            name = g[a].as_py()
            if name != now and held:
                yield now, pa.Table.from_batches(held)
                held = []
            now = name
            held.append(b.slice(a, z - a))
    if held:
        yield now, pa.Table.from_batches(held)


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a group come with its index words first, by falling count and rising word, then queries by length."""
    out: list[tuple] = []

    def rows():
        columns = zip(*out) if out else ((),) * 4
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["word", "n_near", "best_n", "best"])

    for name, group in _groups(batches):
        order, words, counts = (group.column(c).to_pylist() for c in ("query", "word", "n"))
        n = order.count(0)
        if 0 < n < len(order):
            index, known = Index(words[:n]), list(zip(words[:n], counts[:n]))
            a = n
            while a < len(order):  # query is the length here
                z = a
                while z < len(order) and order[z] == order[a]:
                    z += 1
                if not (n == 1 and words[a:z] == words[:1]):
                    out += _best(index, known, words[a:z], 0 if name[0] == "f" else FRONT)
                a = z
        if len(out) >= 10_000:
            yield rows()
            out.clear()
    yield rows()


def near_words(words: DataFrame) -> DataFrame:
    """word, n_near, best_n, best: of each word that has near words their number and the one of largest count (ties: least) among words (word, n)."""
    size = F.length("word")
    keys = F.array(F.concat(F.lit("f"), F.substring("word", 1, FRONT)), F.concat(F.lit("e"), F.right("word", F.lit(END))))
    rows = words.select("word", "n", size.alias("length"), F.explode(keys).alias("key"))
    block = F.greatest(F.lit(64), F.least(F.lit(BLOCK), F.floor(F.lit(2_000_000) / F.col("length")))).cast("long")
    large = written(rows.groupBy("key", "length").agg(F.ceil(F.count("*") / F.first(block)).cast("int").alias("blocks")).where("blocks > 1"), "large")
    if large.count() <= BROADCAST_GROUPS:  # a row for BLOCK words at least
        large = F.broadcast(large)
    deal = lambda seed: F.pmod(F.xxhash64(F.lit(seed), "word"), F.coalesce("blocks", F.lit(1))).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1))
    index = rows.join(large, ["key", "length"], "left").select("*", deal(1).alias("i"), every.alias("q")).select("key", "length", "i", "q", F.lit(0).alias("query"), "word", "n")
    asked = rows.select("word", "n", "key", F.col("length").alias("query"), F.explode(F.array(F.col("length") - 1, F.col("length"), F.col("length") + 1)).alias("length"))
    asked = asked.join(large, ["key", "length"], "left").select("*", every.alias("i"), deal(2).alias("q")).select("key", "length", "i", "q", "query", "word", "n")
    both = index.unionByName(asked).select(F.concat_ws(" ", "key", "length", "i", "q").alias("g"), "query", "word", "n")
    both = both.repartition("g").sortWithinPartitions("g", "query", F.desc("n"), "word")
    found = both.mapInArrow(_search, "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("m"), "best"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", (-F.col("b.m")).alias("best_n"), "b.best")


def roots(forms: DataFrame) -> DataFrame:
    """word, root: the end of the way from each word of (word, form); ways are halved until none gets shorter."""
    now = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = now.select(F.col("word").alias("__w"), F.col("root").alias("__r"))
        more = written(now.join(ahead, F.col("root") == F.col("__w"), "left").select("word", F.coalesce("__r", "root").alias("root"), F.col("__r").isNotNull().alias("moved")), "roots")
        if more.where("moved").isEmpty():
            return now
        now = more.drop("moved")


def variants(docs: DataFrame, damaged: int | None = None, factor: int = FACTOR) -> DataFrame:
    """word, form, root, n, n_near, form_n of the vocabulary: a word's form is its most frequent near word, if that has `factor` times its count."""
    words = written(vocabulary(docs, damaged), "words")
    near = written(near_words(words), "near")
    fits = F.col("best_n") >= factor * F.col("n")
    rows = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(fits, F.col("best")).alias("form"), F.when(fits, F.col("best_n")).alias("form_n"))
    rows = written(rows, "forms")
    ends = roots(rows.where(F.col("form").isNotNull()).select("word", "form"))
    return rows.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
