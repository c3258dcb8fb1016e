"""Quality rules with minimum-covariance-determinant estimates per language and source, DataFrame functions only.

Counts of every whole text are array and string expressions. Texts that fail the base rules go at once. From the others,
four transformed statistics form a vector: mean word length, symbols a word, repeated lines and repeated words
(smoothed, so that short texts lie near the middle; square roots for rates).

Each (language, source) gets the location and covariance of the `SHARE` of its rows whose covariance has the least determinant. Five
deterministic starts (medians with the floors, medians, lower and upper quartiles with quartile ranges, mean with covariance) take
FIRST concentration steps: the rows nearest by Mahalanobis distance give the next mean and covariance. The start with the
least determinant goes on for MORE steps. One pass over the rows is one step of all starts: sums are kept by group, start
and distance bin, so the share's cut (to the end of a bin, of 1.1 % of a distance) and its moments follow from one small
aggregate, and no group meets in one task. The covariance gets a floor on its diagonal, as most texts repeat no line at
all and the least determinant would be zero.

Groups of every size are treated alike: estimates are shrunk towards those of their language with weight PRIOR / (n + PRIOR), and
languages' towards those of all rows. The estimate of a language is the mixture of its groups' (means of locations, and
covariances within groups plus that between their locations, weighted by rows). A document is rejected if its squared
distance exceeds CUT; so a verdict may change when rows join its group, the less the larger the group is.

Defined cases: null and empty texts have no words and fail the base rules; a null language or source is a value of its own,
apart from the empty one; repeated rows count each; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from netohm.llm.work import written

SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
RUN = 8
VECTOR = ("u0", "u1", "u2", "u3")
#: Share of rows in each step, and the factor that makes it consistent for normal rows in four dimensions.
SHARE, CONSISTENT = 0.75, 1.49
#: Steps of all starts, and further steps of the best.
FIRST, MORE = 2, 3
#: Floors of the standard deviations, in the order of VECTOR.
FLOORS = (0.25, 0.12, 0.18, 0.16)
#: The chi-square quantile of 0.9999 with four degrees of freedom.
CUT = 23.51
#: Rows that the estimate of a language weighs against a group's own, and distance bins in each power of two.
PRIOR, BINS = 200, 64
#: Estimates of up to this many groups and starts are broadcast (some 200 bytes each).
BROADCAST_ROWS = 100_000


def counts(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words."""
    text = F.coalesce("text", F.lit(""))
    base = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        "lang",
        "source",
        F.length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.filter(F.split(text, "\n"), lambda x: F.translate(x, " \t\x0b\x0c\r", "") != "").alias("lines"),
        F.transform(F.filter(F.split(text, SPACES), lambda w: w != ""), lambda w: F.xxhash64(w)).alias("words"),
    )
    runs = F.when(
        F.size("words") >= RUN,
        F.transform(F.sequence(F.lit(0), F.size("words") - RUN), lambda i: F.xxhash64(*[F.get("words", i + k) for k in range(RUN)])),
    ).otherwise(F.array().cast("array<bigint>"))
    base = base.select(
        "doc_id", "lang", "source", "word_chars", "n_symbols", F.size("words").cast("long").alias("n_words"), F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), runs.alias("runs"),
    )
    pairs = F.array_sort(F.transform("runs", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    twice = F.size(F.array_distinct("runs")) < F.size("runs")
    base = base.withColumn("pairs", F.when(twice, pairs))
    same = F.filter(
        F.transform("pairs", lambda x, k: F.when((x["h"] == F.get("pairs", k + 1)["h"]) | ((k > 0) & (x["h"] == F.get("pairs", F.greatest(k - 1, F.lit(0)))["h"])), x["i"])),
        lambda x: x.isNotNull(),
    )
    base = base.withColumn("at", F.array_sort(same)).drop("pairs", "runs")
    covered = RUN + F.aggregate(F.zip_with(F.slice("at", 2, F.greatest(F.size("at"), F.lit(1))), F.slice("at", 1, F.greatest(F.size("at") - 1, F.lit(0))), lambda b, a: F.least(b - a, F.lit(RUN))), F.lit(0), lambda t, x: t + x)
    return base.select(
        "doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", F.when(F.size("at") > 0, covered).otherwise(0).cast("long").alias("n_repeat_words")
    )


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def vector() -> list[Column]:
    c = F.col
    return [
        (c("word_chars") + 100) / (c("n_words") + 20),
        F.sqrt(c("n_symbols") / (c("n_words") + 10)),
        F.sqrt(c("n_dup_lines") / (c("n_lines") + 5)),
        F.sqrt(c("n_repeat_words") / (c("n_words") + 20)),
    ]


P = range(len(VECTOR))
PAIRS = [(i, j) for i in P for j in P if i <= j]
M, C = [f"m{i}" for i in P], [f"c{i}{j}" for i, j in PAIRS]


def _cholesky() -> list[Column]:
    """The lower factor of the covariance C with its consistency factor and floors, as l00, l10, l11 and so on."""
    low: dict[tuple[int, int], Column] = {}
    for j in P:
        d = F.col(f"c{j}{j}") * F.lit(CONSISTENT) + F.lit(FLOORS[j] ** 2)
        for k in range(j):
            d = d - low[j, k] * low[j, k]
        low[j, j] = F.sqrt(F.greatest(d, F.lit(1e-9)))
        for i in range(j + 1, len(P)):
            s = F.col(f"c{j}{i}") * F.lit(CONSISTENT)
            for k in range(j):
                s = s - low[i, k] * low[j, k]
            low[i, j] = s / low[j, j]
    return [low[i, j].alias(f"l{i}{j}") for i in P for j in range(i + 1)]


def _distance() -> Column:
    z: list[Column] = []
    for i, u in enumerate(VECTOR):
        s = F.col(u) - F.col(f"m{i}")
        for k in range(i):
            s = s - F.col(f"l{i}{k}") * z[k]
        z.append(s / F.col(f"l{i}{i}"))
    return sum((x * x for x in z[1:]), z[0] * z[0])


def _moments(prefix: list[Column], n: Column, s, q) -> list[Column]:
    """prefix, mean and covariance from the sums s(i) and q(i, j) over n rows."""
    mean = [s(i) / n for i in P]
    return [*prefix, *[mean[i].alias(f"m{i}") for i in P], *[(q(i, j) / n - mean[i] * mean[j]).alias(f"c{i}{j}") for i, j in PAIRS]]


def _starts(rows: DataFrame) -> DataFrame:
    """grp, start, M and C of the five starts."""
    u = F.col
    sums = [F.sum(u(VECTOR[i]) * u(VECTOR[j])).alias(f"q{i}{j}") for i, j in PAIRS]
    agg = rows.groupBy("grp").agg(
        F.count("*").alias("n"), *[F.sum(x).alias(f"s{i}") for i, x in enumerate(VECTOR)], *sums, *[F.percentile_approx(x, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), 2000).alias(f"p{i}") for i, x in enumerate(VECTOR)]
    )
    agg = agg.select(*_moments([u("grp"), *[u(f"p{i}") for i in P]], u("n"), lambda i: u(f"s{i}"), lambda i, j: u(f"q{i}{j}")))
    spread = [F.pow((F.get(f"p{i}", F.lit(2)) - F.get(f"p{i}", F.lit(0))) / 1.349, 2) for i in P]

    def start(k: int, at: int | None, wide: bool) -> Column:
        m = [u(f"m{i}") if at is None else F.get(f"p{i}", F.lit(at)) for i in P]
        c = [u(f"c{i}{j}") if at is None else spread[i] if wide and i == j else F.lit(0.0) for i, j in PAIRS]
        return F.struct(F.lit(k).alias("start"), *[x.cast("double").alias(n) for x, n in zip(m + c, M + C)])

    every = [start(0, 1, False), start(1, 1, True), start(2, 0, True), start(3, 2, True), start(4, None, True)]
    return agg.select("grp", F.inline(F.array(*every)))


def _step(rows: DataFrame, params: DataFrame) -> DataFrame:
    """grp, start, n (rows of the group), M and C of the share of rows nearest by params, for every group and start."""
    factors = params.select("grp", "start", *M, *_cholesky())
    if params.count() <= BROADCAST_ROWS:  # else rows would be dealt by group
        factors = F.broadcast(factors)
    near = rows.join(factors, "grp").select("grp", "start", *VECTOR, F.floor(F.log2(_distance() + 1e-6) * BINS).alias("bin"))
    binned = near.groupBy("grp", "start", "bin").agg(
        F.count("*").alias("n"), *[F.sum(u).alias(f"s{i}") for i, u in enumerate(VECTOR)], *[F.sum(F.col(VECTOR[i]) * F.col(VECTOR[j])).alias(f"q{i}{j}") for i, j in PAIRS]
    )
    binned = written(binned, "bins")  # else Spark would deal the partial sums of all tasks by group for the window
    whole = W.partitionBy("grp", "start")  # bins of one group: some hundreds at most
    binned = binned.select("*", F.sum("n").over(whole).alias("all"), F.sum("n").over(whole.orderBy("bin").rowsBetween(W.unboundedPreceding, -1)).alias("before"))
    inner = binned.where(F.coalesce("before", F.lit(0)) < SHARE * F.col("all"))
    sums = inner.groupBy("grp", "start").agg(F.first("all").alias("all"), F.sum("n").alias("n"), *[F.sum(x).alias(x) for x in (*[f"s{i}" for i in P], *[f"q{i}{j}" for i, j in PAIRS])])
    return sums.select(*_moments([F.col("grp"), F.col("start"), F.col("all").alias("n")], F.col("n"), lambda i: F.col(f"s{i}"), lambda i, j: F.col(f"q{i}{j}")))


def estimates(rows: DataFrame) -> DataFrame:
    """grp, n, M and C (without factor and floors) of every group `grp` of rows with the columns of VECTOR."""
    params = written(_starts(rows), "starts")
    for k in range(FIRST):
        params = written(_step(rows, params), f"step{k}")
    factor = params.select("*", *_cholesky())
    size = sum((F.log(f"l{i}{i}") for i in P), F.lit(0.0))
    best = factor.groupBy("grp").agg(F.min(F.struct(size.alias("size"), "start", "n", *M, *C)).alias("x"))
    params = written(best.select("grp", "x.start", "x.n", *[f"x.{c}" for c in M + C]), "best")
    for k in range(MORE):
        params = written(_step(rows, params), f"more{k}")
    return params.drop("start")


def _mixture(params: DataFrame, key: str) -> DataFrame:
    """key, n, M and C of the mixtures of estimates."""
    n, c = F.col("n"), F.col
    second = {(i, j): c(f"c{i}{j}") + c(f"m{i}") * c(f"m{j}") for i, j in PAIRS}
    agg = params.groupBy(key).agg(F.sum(n).alias("n"), *[F.sum(n * c(m)).alias(f"s{i}") for i, m in enumerate(M)], *[F.sum(n * second[p]).alias(f"q{p[0]}{p[1]}") for p in PAIRS])
    return agg.select(*_moments([c(key), n], n, lambda i: c(f"s{i}"), lambda i, j: c(f"q{i}{j}")))


def _shrunk(params: DataFrame, prior: DataFrame, key: str) -> DataFrame:
    """params drawn towards the prior of the same key."""
    w = F.col("n") / (F.col("n") + F.lit(PRIOR))
    both = params.join(prior.select(key, *[F.col(x).alias(f"prior_{x}") for x in M + C]), key)
    return both.select(*[c for c in params.columns if c not in M + C], *[(w * F.col(x) + (1 - w) * F.col(f"prior_{x}")).alias(x) for x in M + C])


def quality_rules(docs: DataFrame) -> DataFrame:
    """Every document's counts, base_failed, distance (null where the base rules fail) and kept."""
    stats = counts(docs).select("*", base_failed().alias("base_failed"), F.to_json(F.array("lang", "source")).alias("grp"), *[v.alias(u) for v, u in zip(vector(), VECTOR)])
    stats = written(stats, "counts")
    good = stats.where(~F.col("base_failed"))
    own = estimates(good.select("grp", *VECTOR)).join(good.groupBy("grp").agg(F.to_json(F.array(F.first("lang"))).alias("lng")), "grp").withColumn("every", F.lit(1))
    own = written(own, "own")
    by_lang = _mixture(own.select("lng", "every", "n", *M, *C), "lng").withColumn("every", F.lit(1))
    by_lang = _shrunk(by_lang, _mixture(own, "every"), "every")
    params = written(_shrunk(own, by_lang, "lng").select("grp", *M, *_cholesky()), "shrunk")
    judged = stats.join(params, "grp", "left")
    distance = F.when(~F.col("base_failed"), _distance())
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        distance.alias("distance"), (~F.col("base_failed") & F.coalesce(distance <= CUT, F.lit(True))).alias("kept"),
    )
