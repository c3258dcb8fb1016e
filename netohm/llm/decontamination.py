"""Benchmark decontamination by template canonicalisation, DataFrame functions only.

Numbers (digits and English number words), units after numbers and capitalised names become typed slots; other words
are lower-cased without punctuation. Windows of `window` tokens are compared as templates, that is with all values of a slot
type alike, by a hash join of documents with benchmark items, so a question with other figures still meets its source.
For windows with slots the values must then fit within an occurrence, that is over the windows of an item and a document
that met at one distance of places: one value of the item always stands for the same value of the document and the other
way round. Occurrences that break this are dropped; the item is reported if any occurrence fits.

Capitalised words after a word, number, comma or semicolon are names. Others, as at the start of a sentence, may be names
or not: windows are compared with all of them as words and with all of them as names, and slots must fit in one of the
two ways. Windows of slots mostly (fewer than half plain words in either way) say little as templates; they are compared by
their exact tokens.

Items with fewer tokens than a window are one window of their own length; those under `least` tokens are compared by
their exact tokens only. So verbatim copies of every item with a token are found, whatever its length and slots.

Equal templates hold equal plain words, so only windows around an anchor are hashed: each benchmark window names its two
neighbouring plain words with most letters, and every two neighbouring words of a document are looked up among them. Up to
`broadcast_rows` anchors are broadcast and documents are read once; with more of them word pairs shuffle to the anchors,
and documents that met some are read again.

Defined cases: null and empty texts match nothing; equal rows count once, and other texts of the same doc_id each for itself; repeated items match each
under their own item_id; an empty benchmark or table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netohm.llm.work import written

WINDOW, LEAST = 13, 5
#: Keys of benchmark windows up to this many are broadcast (about 40 bytes each); beyond it the join shuffles.
BROADCAST_ROWS = 500_000
#: Units that follow a number, and number words.
UNITS = "km|m|cm|mm|kg|g|mg|l|ml|s|ms|min|h|hours?|minutes?|seconds?|days?|weeks?|months?|years?|miles?|feet|ft|inch(?:es)?|pounds?|lbs?|euros?|dollars?|cents?|percent|mph|kmh"
NUMBERS = (
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen "
    "twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million"
).split()
LETTER = r"\p{L}\p{N}"
#: Name, unit, and a capitalised word that may be a name.
MARKS = ("0p", "0u", "0q")


def tokens(text: Column) -> Column:
    """The tokens of a text in small letters; capitalised words and units carry a two-letter mark."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"(\d)[.,](?=\d)", "$1")
    t = F.regexp_replace(t, rf"(\d) ?((?i:{UNITS}))(?![{LETTER}])", "$1 0U$2")
    t = F.regexp_replace(t, r" (?<=[\p{Ll}\d,;] )(?=\p{Lu}\p{Ll})", " 0P")
    t = F.regexp_replace(t, rf"(?=\p{{Lu}})(?<![{LETTER}])", "0Q")
    return F.array_remove(F.split(F.lower(t), rf"[^{LETTER}]+"), "")


def _marked(w: Column) -> Column:
    return F.substring(w, 1, 2).isin(*MARKS) & (F.length(w) > 2)


def _bare(w: Column) -> Column:
    return F.when(_marked(w), F.substring(w, 3, 1 << 30)).otherwise(w)


def _slot(w: Column, names: bool) -> Column:
    """The slot type of a token: n, u, p or null; names: capitalised words that may be names are."""
    unsure = F.when(F.substring(w, 1, 2) != "0q", F.substring(w, 2, 1)).otherwise(F.lit("p" if names else None).cast("string"))
    return F.when(_bare(w).isin(*NUMBERS), F.lit("n")).when(_marked(w), unsure).when(F.substring(w, 1, 1) <= "9", F.lit("n"))


CODES = {"word": lambda w: F.coalesce(_slot(w, False), F.concat(F.lit(":"), _bare(w))), "name": lambda w: F.coalesce(_slot(w, True), F.concat(F.lit(":"), _bare(w))), "exact": _bare}


def _hash(own: Column, kind: str) -> Column:
    """The hash of a window as a template of one kind, or of its exact tokens."""
    return F.xxhash64(F.lit(kind == "exact"), F.transform(own, CODES[kind]))


def _held(own: Column, names: bool) -> Column:
    """Places in a window (from 0), types and values of its slots."""
    every = F.transform(own, lambda w, k: F.struct(k.cast("int").alias("k"), F.concat(_slot(w, names), F.lit(":"), _bare(w)).alias("v")))
    return F.filter(every, lambda s: s["v"].isNotNull())


def _anchor(slots: Column) -> Column:
    """Place p (from 0) and words of a window's anchor: of its two neighbouring tokens without slot that hold most letters; of one if no two stand together."""
    taken = F.transform(slots, lambda s: s["k"])

    def entry(i: Column, n: int) -> Column:
        ws = [F.get("own", i + k) for k in range(n)]
        clear = ~F.arrays_overlap(taken, F.array(*[(i + k).cast("int") for k in range(n)]))
        return F.when(clear, F.struct(sum(F.length(_bare(w)) for w in ws).alias("n"), i.cast("int").alias("p"), F.array(*map(_bare, ws)).alias("words")))

    one = F.array_max(F.transform(F.sequence(F.lit(0), F.size("own") - 1), lambda i: entry(i, 1)))
    two = F.when(F.size("own") > 1, F.array_max(F.transform(F.sequence(F.lit(0), F.greatest(F.size("own") - 2, F.lit(0))), lambda i: entry(i, 2))))
    return F.coalesce(two, one)


def _known(benchmark: DataFrame, window: int, least: int) -> DataFrame:
    """item_id, size, kind, h, at (from 1), slots and anchor of the benchmark's windows, each compared in the ways that say something."""
    items = benchmark.select("item_id", tokens(F.col("text")).alias("tokens")).where(F.size("tokens") > 0)
    items = items.select("item_id", "tokens", F.least(F.size("tokens"), F.lit(window)).alias("size"))
    rows = items.select("item_id", "size", F.size("tokens").alias("n"), "tokens", F.explode(F.sequence(F.lit(1), F.size("tokens") - F.col("size") + 1)).alias("at"))
    rows = rows.select("item_id", "size", "n", "at", F.slice("tokens", F.col("at"), F.col("size")).alias("own"))
    rows = rows.select("*", _held(F.col("own"), False).alias("sure"), _held(F.col("own"), True).alias("all"))
    short, heavy, none = F.col("n") < least, 2 * F.size("all") > F.col("size"), F.slice("all", 1, 0)
    kinds = {"word": (~short & (2 * F.size("sure") <= F.col("size")), F.col("sure")), "name": (~short & ~heavy, F.col("all")), "exact": (short | heavy, none)}
    each = F.filter(F.array(*[F.when(w, F.struct(F.lit(k).alias("kind"), _hash(F.col("own"), k).alias("h"), s.alias("slots"))) for k, (w, s) in kinds.items()]), lambda x: x.isNotNull())
    return rows.select("item_id", "size", "at", "own", F.inline(each)).withColumn("anchor", _anchor(F.col("slots"))).drop("own")


def _anchors(known: DataFrame) -> DataFrame:
    """key, p, size: anchors as documents may hold them, that is with each mark that their kind allows."""
    marks = F.when(F.col("kind") == "exact", F.array(F.lit(""), *map(F.lit, MARKS))).otherwise(F.array(F.lit(""), F.lit("0q")))
    rows = known.select("anchor.p", "anchor.words", "size", marks.alias("m")).distinct().withColumn("a", F.explode("m")).withColumn("b", F.explode("m"))
    second = F.when(F.size("words") > 1, F.concat("b", F.get("words", F.lit(1)))).otherwise(F.lit(""))
    return rows.select(F.xxhash64(F.concat("a", F.get("words", F.lit(0))), second).alias("key"), "p", "size").distinct()


def _met(docs: DataFrame, known: DataFrame, small: bool) -> DataFrame:
    """doc_id, t (the text's hash), at (from 1), own (the tokens) and h of windows of documents around an anchor of the benchmark's."""
    anchors = _anchors(known)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("t"), tokens(F.col("text")).alias("tokens"))
    # after the explode Spark compiles the rest; inside a transform it would interpret it
    rows = texts.select("doc_id", "t", "tokens", F.explode(F.when(F.size("tokens") > 0, F.sequence(F.lit(0), F.size("tokens") - 1))).alias("i"))
    word, after = F.get("tokens", F.col("i")), F.coalesce(F.get("tokens", F.col("i") + 1), F.lit(""))
    lone = not known.where("size(anchor.words) = 1").isEmpty()
    rows = rows.select("doc_id", "t", "tokens", "i", F.explode(F.array(F.xxhash64(word, after), F.xxhash64(word, F.lit("")))).alias("key") if lone else F.xxhash64(word, after).alias("key"))
    start = F.col("i") - F.col("p") + 1
    own = F.slice("tokens", F.col("at"), F.col("size")).alias("own")
    if small:
        rows = rows.join(F.broadcast(anchors), "key").where((start >= 1) & (start + F.col("size") <= F.size("tokens") + 1)).select("doc_id", "t", "tokens", start.alias("at"), "size").select("doc_id", "t", "at", own)
    else:
        rows = rows.select("doc_id", "t", "i", F.size("tokens").alias("n"), "key").join(anchors, "key").where((start >= 1) & (start + F.col("size") <= F.col("n") + 1))
        rows = written(rows.select("doc_id", "t", start.alias("at"), "size").distinct(), "places").groupBy("doc_id", "t").agg(F.collect_list(F.struct("at", "size")).alias("w"))
        rows = texts.join(rows, ["doc_id", "t"]).select("doc_id", "t", "tokens", F.inline("w")).select("doc_id", "t", "at", own)
    return rows.select("doc_id", "t", "at", "own", F.explode(F.array_distinct(F.array(*[_hash(F.col("own"), k) for k in CODES]))).alias("h"))


def leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, least: int = LEAST, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(doc_id, item_id, n_windows, n_slots) for every document and item that share template windows with fitting slots.

    n_windows counts places of the document, n_slots pairs of values, over the occurrences that fit; texts of a repeated doc_id are
    held against an item each for itself, and their numbers add up.
    """
    known = written(_known(benchmark, window, least), "templates")
    small = known.count() <= broadcast_rows
    hashes = known.select("h").distinct()
    met = _met(docs, known, small).join(F.broadcast(hashes) if small else hashes, "h", "left_semi")
    pairs = written(met.distinct(), "met").join(known.withColumnRenamed("at", "its"), "h")
    text = ["doc_id", "t", "item_id"]
    plain = pairs.where(F.size("slots") == 0).groupBy(*text).agg(F.collect_set("at").alias("places"))
    slots = F.transform("slots", lambda x: F.struct(x["v"].alias("theirs"), F.concat(F.substring(x["v"], 1, 2), _bare(F.get("own", x["k"]))).alias("ours")))
    held = pairs.where(F.size("slots") > 0).select(*text, "kind", (F.col("at") - F.col("its")).alias("off"), "at", F.explode(slots).alias("s"))
    fits = held.groupBy(*text, "kind", "off").agg(F.collect_set("s").alias("s"), F.collect_set("at").alias("places"))
    fits = fits.where((F.size("s") == F.size(F.array_distinct("s.theirs"))) & (F.size("s") == F.size(F.array_distinct("s.ours"))))
    both = plain.select(*text, "places", F.lit(None).cast(fits.schema["s"].dataType).alias("s")).unionByName(fits.select(*text, "places", "s"))
    number = lambda c: F.size(F.array_distinct(F.flatten(F.collect_list(c)))).cast("long")
    each = both.groupBy(*text).agg(number("places").alias("n_windows"), number("s").alias("n_slots"))
    return each.groupBy("doc_id", "item_id").agg(F.sum("n_windows").alias("n_windows"), F.sum("n_slots").alias("n_slots"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """docs without the documents that leak."""
    return docs.join(leaks(docs, benchmark, **options).select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)
