"""Removal of repeated line runs from a suffix array over line ids, by distributed prefix doubling.

Every line with a word gets an id; lines without words are no part of the sequence and stay. Suffixes are ranked by their
first line, then by their first 2, 4, ... lines: a step sorts all open suffixes globally, by range, by the pair of ranks at j and
j + n, and a group's new ranks count the suffixes before them in it, so they stay comparable with those of all other groups. A suffix is
closed when its rank is its own or when its end has been compared; steps go on until none is open. Suffixes that are equal up to
their ends follow by place. The lines of texts that share no line are told from all others in the first step and go no further.

The ranks that two neighbours of the array held after each step tell the longest common prefix: its leading power of two is the last step in which they
agree, and the lower ones follow from their ranks in earlier steps, at the places behind the part that is known. Neighbours whose prefix is
min_lines lines or more form the maximal intervals of the array: all places of one run of min_lines lines, the least of which (doc_id, then line) is kept.

Longer prefixes with an interval's first place are those of neighbouring intervals: what the
suffix at j shares with its interval's first at f is one line longer than that of j + 1 where the interval of j + 1 starts
at f + 1, and else ends with min_lines lines (or goes on as a copy of a still earlier place). So intervals whose places and first places both move
on by a line make one maximal run: it has no longer copy of the same place to either side. Later copies are deleted by whole runs; a run
that overlaps its own first place loses the lines behind min_lines lines of that place only. Windows of min_lines lines
count only if they hold min_words words together; others end a run. A single line of single_words words at least is a run of
its own, whatever its neighbours, and so are several in a row; single_words = None leaves such lines to the runs.

Defined cases: null text stays null with no lines, empty texts and blank lines stay; rows that repeat a doc_id with other
text are separate texts under one doc_id, ordered by a hash of the text; rows equal in doc_id and text are one text and come out
alike; rows without a doc_id stay whole and are no copy's first place; an empty table gives no rows; extra columns pass through, but n_lines and n_deleted are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from netohm.llm.work import ship, write, written

MIN_LINES, MIN_WORDS, SINGLE_WORDS = 2, 10, 50
BLANKS = " \t\n\x0b\x0c\r"
#: A place: document, hash of its text, index among lines with words.
PLACE = ("doc_id", "t", "j")
#: Positions of the array that one window goes over, and rows for which a sort gets one more shard, up to the session's shuffle partitions.
STRETCH, SHARD = 1 << 13, 20_000


def _text() -> WindowSpec:
    return Window.partitionBy("doc_id", "t")


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def sequences(docs: DataFrame) -> DataFrame:
    """PLACE, i (index among all lines), h1, h2 (the id) and n (words) of every line with words; rows equal in doc_id and text count once."""
    # a text is hashed once, before its lines become rows, and its lines are cut once: without "outer" Spark cuts them again for a filter
    texts = docs.where(F.col("text").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.xxhash64("text").alias("t"), "text")
    cut = texts.select("doc_id", "t", F.posexplode_outer(_lines(F.col("text"))).alias("i", "x"))
    rows = cut.where(F.ltrim("x", F.lit(BLANKS)) != "").select("doc_id", "t", "i", F.trim("x", F.lit(BLANKS)).alias("line"))
    line = F.col("line")
    odd = line.contains("  ")
    for c in BLANKS.replace(" ", ""):
        odd |= line.contains(c)
    spaces = F.octet_length(line) - F.octet_length(F.replace(line, F.lit(" "), F.lit("")))
    words = F.when(odd, F.size(F.split(line, r"[\x20\x09-\x0D]+"))).otherwise(spaces + 1)
    rows = rows.select("doc_id", "t", "i", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(7), "line").alias("h2"), words.alias("n"))
    inside = _text().orderBy("i")
    rows = rows.withColumn("j", F.dense_rank().over(inside) - 1).withColumn("before", F.lag("i").over(inside))
    return rows.where("before is null or before < i").select(*PLACE, "i", "h1", "h2", "n")


def _counted(keys: list[str]):
    def run(batches):
        rows = list(batches)
        if not sum(b.num_rows for b in rows):
            return
        rows = pa.Table.from_batches(rows)
        row = np.arange(rows.num_rows)

        def differs(names: list[str]) -> np.ndarray:
            out = row == 0
            for x in (rows.column(c).to_numpy() for c in names):
                out[1:] |= x[1:] != x[:-1]
            return out

        group, part = differs(keys[:1]), differs(keys)
        starts = [np.maximum.accumulate(np.where(x, row, 0)) for x in (group, part)]
        for name, x in (("row", row), ("g", starts[0]), ("s", starts[1]), ("last", np.append(part[1:], True))):
            rows = rows.append_column(name, pa.array(x))
        yield from rows.to_batches()

    return run


def _ranked(rows: DataFrame, by: list[str], name: str, n: int | None = None) -> DataFrame:
    """rows without `by`, with the rank after a sort of each rank's rows by `by`, pos (rows before, ties by place) and alone (no other row has the rank)."""
    spark, keys = rows.sparkSession, ["rank", *by]
    ship(spark)
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shards = shards if n is None else min(shards, 1 + n // SHARD)
    ordered = rows.repartitionByRange(shards, *keys, *PLACE).sortWithinPartitions(*keys, *PLACE)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields) + ", row long, g long, s long, last boolean"
    counted = written(ordered.mapInArrow(_counted(keys), schema).withColumn("shard", F.spark_partition_id()), name)
    # a row for each shard: where the group and the part that it starts with began
    ends = counted.groupBy("shard").agg(F.count("*").alias("n"), F.min_by(F.struct(*keys), "row").alias("head"), F.max_by(F.struct(*keys, "g", "s"), "row").alias("tail"))
    facts: list[list] = []
    before, group, part, tail = 0, 0, 0, None
    for x in sorted(ends.collect(), key=lambda x: x["shard"]):
        goes_on = tail is not None and all(x["head"][c] == tail[c] for c in keys)
        group = group if tail is not None and x["head"]["rank"] == tail["rank"] else before
        part = part if goes_on else before
        if goes_on:
            facts[-1][-1] = x["n"] > 0
        facts.append([x["shard"], before, x["n"], group, part, False])
        tail = x["tail"]
        group, part = before + tail["g"] if tail["g"] else group, before + tail["s"] if tail["s"] else part
        before += x["n"]
    shard = spark.createDataFrame(facts, "shard int, before long, rows long, group long, part long, goes_on boolean")
    at = F.col("before") + F.col("row")
    g, s = (F.when(F.col(c) == 0, F.col(first)).otherwise(F.col("before") + F.col(c)) for c, first in (("g", "group"), ("s", "part")))
    alone = (s == at) & F.col("last") & ~(F.col("goes_on") & (F.col("row") == F.col("rows") - 1))
    keep = [c for c in rows.columns if c not in (*keys, "pos", "alone")]
    return counted.join(F.broadcast(shard), "shard").select(*keep, (F.col("rank") + s - g).alias("rank"), (F.col("rank") + at - g).alias("pos"), alone.alias("alone"))


def _ranks(docs: DataFrame) -> tuple[DataFrame, int]:
    """(rows, steps): PLACE, i, n, left (lines to the text's end), common (another suffix has the first line), pos (place in the array) and ranks (after each step) of texts that share a line."""
    rows = _ranked(written(sequences(docs).withColumn("rank", F.lit(0).cast("long")), "lines"), ["h1", "h2"], "order1")
    rows = rows.withColumn("common", ~F.col("alone")).withColumn("left", F.count("*").over(_text()) - F.col("j")).withColumn("ranks", F.array("rank"))
    rows = rows.withColumn("shares", F.max("common").over(_text())).where("shares").drop("shares")
    paths, size = [], 1
    # after a step ranks has an entry more, so its length tells size; a number would make each step's code another one to compile
    reach = F.pow(F.lit(2), F.size("ranks") - 1)
    while True:
        rows = rows.withColumn("alone", F.col("alone") | (F.col("left") < reach))  # closed
        rows = rows.withColumn("rank2", F.coalesce(F.lead("rank", size).over(_text().orderBy("j")), F.lit(-1).cast("long"))).withColumn("closed", F.min("alone").over(_text()))
        table = rows.select(*PLACE, "i", "n", "left", "common", "pos", "ranks", "rank", "rank2", "alone", "closed")
        paths.append(write(table, f"ranks{size}"))
        rows = docs.sparkSession.read.schema(table.schema).parquet(paths[-1]).where("not closed").drop("closed")
        n = rows.where("not alone").count()
        if not n:
            break
        size *= 2
        opened = _ranked(rows.where("not alone"), ["rank2"], f"order{size}", n)
        rows = opened.unionByName(rows.where("alone").drop("rank2")).withColumn("ranks", F.concat("ranks", F.array("rank")))
    array = docs.sparkSession.read.schema(table.schema).parquet(*paths).where("closed")
    return written(array.drop("rank", "rank2", "alone", "closed"), "ranks"), len(paths)


def _prefixes(array: DataFrame, steps: int) -> DataFrame:
    """pos, lcp: the lines that the suffix at pos shares with the one before it, where there are any."""
    rows = array.where("common")
    before = rows.select((F.col("pos") + 1).alias("pos"), F.struct(*PLACE).alias("x"), F.col("ranks").alias("x_ranks"))
    pairs = rows.select("pos", F.struct(*PLACE).alias("y"), "ranks", "left").join(before, "pos").where(F.col("ranks")[0] == F.col("x_ranks")[0])
    same = F.aggregate(F.zip_with("ranks", "x_ranks", lambda a, b: F.coalesce((a == b).cast("int"), F.lit(0))), F.lit(0), lambda a, b: a + b)
    ends = F.element_at("ranks", -1) == F.element_at("x_ranks", -1)  # a rank that is shared to the last is that of equal suffixes
    pairs = pairs.select("pos", "x", "y", same.alias("same"), ends.alias("ends"), F.when(ends, F.col("left")).otherwise(F.pow(F.lit(2), same - 1)).cast("long").alias("lcp"))
    pairs = written(pairs, "pairs")
    deep = None
    for k in range(steps - 3, -1, -1):  # pairs that agree in k + 2 steps enter here
        enter = pairs.where((F.col("same") == k + 2) & ~F.col("ends")).select("pos", "x", "y", "lcp")
        deep = enter if deep is None else deep.unionByName(enter)
        for p in "xy":
            rank = array.where(F.size("ranks") > k + 2).select(*[F.col(c).alias(f"_{c}") for c in PLACE], F.get("ranks", F.lit(k)).alias(f"{p}_rank"))
            here = (F.col(f"{p}.doc_id") == F.col("_doc_id")) & (F.col(f"{p}.t") == F.col("_t")) & (F.col(f"{p}.j") + F.col("lcp") == F.col("_j"))
            deep = deep.join(rank, here, "left").drop("_doc_id", "_t", "_j")
        more = F.when(F.col("x_rank") == F.col("y_rank"), 1 << k).otherwise(0)
        deep = written(deep.select("pos", "x", "y", (F.col("lcp") + more).alias("lcp")), f"pairs{k}")
    shallow = pairs.where("same = 1 or ends").select("pos", "lcp")
    return shallow if deep is None else shallow.unionByName(deep.select("pos", "lcp"))


def suffix_array(docs: DataFrame) -> DataFrame:
    """PLACE, i, n, left, common, pos and lcp (lines shared with the suffix at pos - 1) of all suffixes of texts that share a line."""
    array, steps = _ranks(docs)
    return written(array.drop("ranks").join(_prefixes(array, steps), "pos", "left").fillna(0, ["lcp"]), "array")


def intervals(array: DataFrame, size: int, least: int) -> DataFrame:
    """PLACE, lines (indices among all), n (words) and first (the least place) of the suffixes in the array's maximal intervals of prefixes of `size` lines and `least` words or more."""
    window = _text().orderBy("j").rowsBetween(0, size - 1)
    rows = array.withColumn("lines", F.collect_list("i").over(window)).withColumn("n", F.sum("n").over(window)) if size > 1 else array.withColumn("lines", F.array("i"))
    rows = rows.where("common").withColumn("stretch", F.floor(F.col("pos") / STRETCH))
    start = F.when(F.col("lcp") < size, F.col("pos"))
    inside = F.max(start).over(Window.partitionBy("stretch").orderBy("pos"))
    carried = array.where("common").groupBy(F.floor(F.col("pos") / STRETCH).alias("stretch")).agg(F.max(start).alias("start"))
    carried = carried.select("stretch", F.max("start").over(Window.orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)).alias("start"))
    rows = rows.withColumn("inside", inside).join(carried, "stretch").where((F.col("left") >= size) & (F.col("n") >= least))
    rows = written(rows.select(*PLACE, "lines", "n", F.coalesce("inside", "start").alias("interval")), f"members{size}")
    firsts = rows.groupBy("interval").agg(F.min(F.struct(*PLACE)).alias("first"), F.count("*").alias("places")).where("places > 1")
    # tables on both sides of a join let Spark split a hot key
    return rows.join(written(firsts.drop("places"), f"firsts{size}"), "interval").drop("interval")


def repeated_runs(docs: DataFrame, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS, single_words: int | None = SINGLE_WORDS) -> DataFrame:
    """A row for each maximal run that copies an earlier place: doc_id, t, j (where it starts), size (min_lines, or 1 for long lines), first (the earlier place), lcp (lines of the run) and lines (their indices among all)."""
    array = suffix_array(docs)
    found = intervals(array, min_lines, min_words).withColumn("size", F.lit(min_lines))
    if single_words is not None:
        found = found.unionByName(intervals(array, 1, single_words).withColumn("size", F.lit(1)))
    found = found.where(F.struct(*PLACE) != F.col("first"))
    before = Window.partitionBy("doc_id", "t").orderBy("size", "j")  # the windows of one text
    last = F.lag(F.struct("size", "j", "first")).over(before)
    shifted = F.struct("size", (F.col("j") - 1).alias("j"), F.struct("first.doc_id", "first.t", (F.col("first.j") - 1).alias("j")).alias("first"))
    marked = found.withColumn("starts", F.when(last == shifted, 0).otherwise(1)).withColumn("run", F.sum("starts").over(before))
    return marked.groupBy("doc_id", "t", "run").agg(
        F.min("j").alias("j"), F.first("size").alias("size"), F.min("first").alias("first"), (F.count("*") + F.first("size") - 1).cast("int").alias("lcp"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("lines")))).alias("lines"),
    ).drop("run")


def deleted_lines(docs: DataFrame, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS, single_words: int | None = SINGLE_WORDS) -> DataFrame:
    """(doc_id, t, __gone): the deleted lines of each text that loses some, as indices among all its lines."""
    runs = repeated_runs(docs, min_lines, min_words, single_words)
    own = (F.col("doc_id") == F.col("first.doc_id")) & (F.col("t") == F.col("first.t"))
    behind = F.when(own, F.greatest(F.col("size") - (F.col("j") - F.col("first.j")), F.lit(0))).otherwise(0)  # lines that lie in the first place, too
    gone = runs.select("doc_id", "t", F.slice("lines", behind + 1, F.col("lcp")).alias("g"))
    return gone.groupBy("doc_id", "t").agg(F.array_distinct(F.flatten(F.collect_list("g"))).alias("__gone"))


def remove_repeated_runs(docs: DataFrame, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS, single_words: int | None = SINGLE_WORDS) -> DataFrame:
    """docs with text without the deleted lines, and the columns n_lines and n_deleted."""
    gone = deleted_lines(docs.select("doc_id", "text"), min_lines, min_words, single_words)
    gone = gone.select(F.col("doc_id").alias("__doc"), F.col("t").alias("__t"), "__gone")
    lines = _lines(F.col("text"))
    breaks = F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit("")))
    kept = F.array_join(F.filter(lines, lambda x, i: ~F.array_contains("__gone", i)), "\n")
    keep = [c for c in docs.columns if c not in ("n_lines", "n_deleted") and not c.startswith("__")]
    return docs.select(keep).join(gone, (docs["doc_id"] == F.col("__doc")) & (F.xxhash64(docs["text"]) == F.col("__t")), "left").select(
        *[F.when(F.col("__gone").isNull(), F.col("text")).otherwise(kept).alias("text") if c == "text" else F.col(c) for c in keep],
        F.when(F.col("text").isNull(), 0).otherwise(breaks + 1).cast("long").alias("n_lines"),
        F.coalesce(F.size("__gone"), F.lit(0)).cast("long").alias("n_deleted"),
    )
