"""Quality rules: simple counts, then robust multivariate outliers per language and source.

Everything here is DataFrame functions. The estimate is the minimum covariance determinant: from several starts, each
group repeatedly takes mean and covariance of those of its rows that lie nearest under the last estimate, until the
determinant no longer falls, and keeps the start whose covariance has the least determinant. A group's rows are only ever
summed (partial sums before the shuffle), so a source that holds a third of all rows is no larger a task than any other.
Groups too small for an estimate are judged by that of their language, or of all rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnframe.llm.common import materialize

WORD_GAP = r"[\x20\x09-\x0D]+"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: Parameters of the estimate. A start has converged when its log determinant falls by no more than CONVERGED.
STARTS = 4
MIN_GROUP = 40
SUBSET = 0.6
CONVERGED = 1e-6
#: Standard deviation added to each feature, against zero variance: most texts have no symbols and repeat nothing, and a single symbol or repeated line in a short text is chance.
FLOORS = (0.01, 1.0, 0.05, 0.25)
#: Squared distance beyond which a row is an outlier: the 1 - 1e-4 quantile of chi-square with 4 degrees of freedom.
CUTOFF = 23.513
#: Medians of chi-square with 1 to 4 degrees of freedom.
MEDIANS = (0.4549, 1.3863, 2.366, 3.3567)
#: Stands for any language, or any source, of a pooled estimate; named ones begin with "=".
ANY = "*"
FEATURES = ("f0", "f1", "f2", "f3")


def base_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of whole texts; a null text has no words."""
    text = F.coalesce("text", F.lit(""))
    lined = docs.select(
        "doc_id", "lang", "source",
        F.filter(F.split(text, WORD_GAP), lambda w: w != "").alias("words"),
        F.length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        F.filter(F.split(text, "\n"), lambda s: s.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
    )
    # a window's hash by doubling: of 1, 2, 4 and 8 words
    hashed = lined.select(
        "doc_id", "lang", "source", F.size("words").cast("long").alias("n_words"), "word_chars", "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("words") >= WINDOW, F.transform("words", lambda w: F.xxhash64(w))).otherwise(F.array().cast("array<long>")).alias("h"),
    )
    for step in (1, 2, 4):
        head, tail = F.expr(f"slice(h, 1, greatest(size(h) - {step}, 0))"), F.expr(f"slice(h, {step + 1}, greatest(size(h) - {step}, 0))")
        hashed = hashed.withColumn("h", F.zip_with(head, tail, lambda a, b: F.xxhash64(a, b)))
    # only texts that repeat a window sort their windows
    repeats = F.size(F.array_distinct("h")) < F.size("h")
    placed = hashed.withColumn("p", F.when(repeats, F.array_sort(F.transform("h", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))))
    same = placed.withColumn("same", F.expr("zip_with(slice(p, 1, size(p) - 1), slice(p, 2, size(p) - 1), (a, b) -> a.x = b.x)"))
    starts = same.withColumn("at", F.expr("array_sort(filter(zip_with(p, zip_with(concat(array(false), same), concat(same, array(false)), (a, b) -> a or b), (x, f) -> if(f, x.i, null)), x -> x is not null))"))
    covered = F.expr(f"aggregate(zip_with(slice(at, 1, size(at) - 1), slice(at, 2, size(at) - 1), (a, b) -> cast(least({WINDOW}, b - a) as long)), {WINDOW}L, (s, x) -> s + x)")
    return starts.select("doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", F.coalesce(covered, F.lit(0).cast("long")).alias("n_repeat_words"))


def _features(stats: DataFrame) -> DataFrame:
    """The transformed statistics: mean word length, symbols, repeated lines and repeated words, as logarithms of rates."""
    words = F.greatest(F.col("n_words"), F.lit(1))
    return stats.withColumns({
        "f0": F.log((F.col("word_chars") + 1) / (words + 1)),
        "f1": F.log1p(1000 * F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1))),
        "f2": F.log1p(10 * F.col("n_dup_lines") / words),
        "f3": F.log1p(10 * F.col("n_repeat_words") / words),
        "g_lang": F.coalesce(F.concat(F.lit("="), "lang"), F.lit("")), "g_source": F.coalesce(F.concat(F.lit("="), "source"), F.lit("")),
    })


_PAIRS = [(i, j) for i in range(len(FEATURES)) for j in range(i + 1)]


def _sums() -> list[Column]:
    """n, s_i and q_i_j: count, sums and sums of products of the features."""
    return [F.count("*").alias("n"), *[F.sum(f).alias(f"s_{i}") for i, f in enumerate(FEATURES)], *[F.sum(F.col(FEATURES[i]) * F.col(FEATURES[j])).alias(f"q_{i}_{j}") for i, j in _PAIRS]]


def _moments(sums: DataFrame, keys: list[str]) -> DataFrame:
    """Count, mean m_i and covariance c_i_j of the features from their sums."""
    mean = [F.col(f"s_{i}") / F.col("n") for i in range(len(FEATURES))]
    return sums.select(*keys, "n", *[m.alias(f"m_{i}") for i, m in enumerate(mean)], *[(F.col(f"q_{i}_{j}") / F.col("n") - mean[i] * mean[j]).alias(f"c_{i}_{j}") for i, j in _PAIRS])


def _cholesky(moments: DataFrame) -> DataFrame:
    """l_i_j: the lower factor of the covariance with FLOORS on its diagonal, and its log determinant; each entry is a column of its own, so none is computed twice."""
    for i in range(len(FEATURES)):
        for j in range(i + 1):
            rest = reduce(lambda a, b: a + b, [F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}") for k in range(j)], F.lit(0.0))
            value = F.col(f"c_{i}_{j}") + (FLOORS[i] ** 2 if i == j else 0.0) - rest
            moments = moments.withColumn(f"l_{i}_{j}", F.sqrt(F.greatest(value, F.lit(1e-12))) if i == j else value / F.col(f"l_{j}_{j}"))
    return moments.withColumn("logdet", reduce(lambda a, b: a + b, [2 * F.log(f"l_{i}_{i}") for i in range(len(FEATURES))]))


def _distance(rows: DataFrame) -> DataFrame:
    """d2: squared Mahalanobis distance, by forward substitution."""
    total: Column = F.lit(0.0)
    for i in range(len(FEATURES)):
        rest = reduce(lambda a, b: a + b, [F.col(f"l_{i}_{k}") * F.col(f"z_{k}") for k in range(i)], F.lit(0.0))
        rows = rows.withColumn(f"z_{i}", (F.col(FEATURES[i]) - F.col(f"m_{i}") - rest) / F.col(f"l_{i}_{i}"))
        total = total + F.col(f"z_{i}") ** 2
    return rows.withColumn("d2", total)


def _estimate_keys(spark: SparkSession, stats: DataFrame) -> DataFrame:
    """(g_lang, g_source, e_lang, e_source): by which estimate each group is judged, its own, its language's or that of all rows; none where all rows are under MIN_GROUP."""
    counts = materialize(spark, stats.groupBy("g_lang", "g_source").agg(F.count_if(~F.col("base_failed")).alias("n")), "groups")
    total = counts.agg(F.sum("n")).first()[0] or 0
    level = counts.join(counts.groupBy("g_lang").agg(F.sum("n").alias("n_lang")), "g_lang").where(F.lit(total >= MIN_GROUP))
    own, lang = F.col("n") >= MIN_GROUP, F.col("n_lang") >= MIN_GROUP
    return level.select("g_lang", "g_source", F.when(own | lang, F.col("g_lang")).otherwise(ANY).alias("e_lang"), F.when(own, F.col("g_source")).otherwise(ANY).alias("e_source"))


def robust_estimates(spark: SparkSession, rows: DataFrame, used: DataFrame) -> DataFrame:
    """Of each e_lang and e_source in used the estimate with the least determinant, from all rows that it covers.

    The nearest rows are found by summing them in bins of distance a sixteenth of an octave wide, so no group is ever
    sorted. Each start steps until its determinant falls no further, which ends, as subsets are finitely many. The nearest
    rows spread less than all; so the covariance is scaled for the median distance to be that of chi-square, with as many
    degrees of freedom as features spread beyond their floors.
    """
    group = ["e_lang", "e_source"]
    keys = [*group, "start"]
    covering = F.array(*[F.struct(a.alias("e_lang"), b.alias("e_source")) for a, b in ((F.col("g_lang"), F.col("g_source")), (F.col("g_lang"), F.lit(ANY)), (F.lit(ANY), F.lit(ANY)))])
    start = F.pmod(F.xxhash64("doc_id"), F.lit(STARTS)).cast("int")
    covered = rows.select(F.explode(covering).alias("e"), start.alias("start"), *FEATURES).select("e.*", "start", *FEATURES)
    covered = materialize(spark, covered.join(used.select(*group).distinct(), group, "left_semi"), "covered")
    members = covered.select(*group, *FEATURES)
    bin_ = F.floor(16 * F.log2(F.col("d2") + 1e-6)).cast("int")
    first = _cholesky(_moments(covered.groupBy(*keys).agg(*_sums()), keys))
    estimate = materialize(spark, first.withColumns({"logdet": F.lit(float("inf")), "moves": F.lit(True)}), "mcd")
    so_far = Window.partitionBy(*keys).orderBy("bin")
    while not (moving := estimate.where("moves")).isEmpty():
        per_bin = _distance(members.join(moving, group)).groupBy(*keys, bin_.alias("bin")).agg(*_sums())
        before, total = F.sum("n").over(so_far) - F.col("n"), F.sum("n").over(Window.partitionBy(*keys))
        nearest = per_bin.withColumns({"before": before, "total": total}).where(F.col("before") < SUBSET * F.col("total"))
        summed = nearest.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in per_bin.columns if c not in (*keys, "bin")])
        stepped = _cholesky(_moments(summed, keys))
        values = [c for c in stepped.columns if c not in keys]
        both = estimate.select(*keys, F.struct(*values).alias("old")).join(stepped.select(*keys, F.struct(*values).alias("new")), keys, "left")
        better = F.coalesce(F.col("new.logdet") < F.col("old.logdet") - CONVERGED, F.lit(False))
        estimate = materialize(spark, both.select(*keys, F.when(better, F.col("new")).otherwise(F.col("old")).alias("e"), better.alias("moves")).select(*keys, "e.*", "moves"), "mcd")
    best = estimate.groupBy(*group).agg(F.min_by(F.struct(*[c for c in estimate.columns if c not in (*group, "moves")]), F.struct("logdet", "start")).alias("e")).select(*group, "e.*")
    best = materialize(spark, best, "mcd")
    bins = _distance(members.join(best, group)).groupBy(*group, bin_.alias("bin")).agg(F.count("*").alias("n"))
    middle = bins.withColumns({"before": F.sum("n").over(Window.partitionBy(*group).orderBy("bin")), "total": F.sum("n").over(Window.partitionBy(*group))})
    half = middle.where("2 * before >= total").groupBy(*group).agg(F.min("bin").alias("half"))
    spread = reduce(lambda a, b: a + b, [(F.col(f"c_{i}_{i}") > FLOORS[i] ** 2).cast("int") for i in range(len(FEATURES))])
    expected = F.get(F.array(*map(F.lit, MEDIANS)), F.greatest(spread, F.lit(1)) - 1)
    scale = F.when(spread == 0, 1.0).otherwise(F.greatest(F.pow(F.lit(2.0), (F.col("half") + 0.5) / 16.0) / expected, F.lit(1.0)))
    scaled = best.join(half, group).withColumn("scale", scale)
    return _cholesky(scaled.select(*group, *[f"m_{i}" for i in range(len(FEATURES))], *[(F.col(f"c_{i}_{j}") * F.col("scale")).alias(f"c_{i}_{j}") for i, j in _PAIRS]))


def quality(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Counts, base_failed and kept of every document.

    A null or empty text has zero counts and fails the base rules. A null lang or source is a group of its own. Only rows
    that pass the base rules enter an estimate; a group of fewer than MIN_GROUP of them is judged by its language's, a
    language of fewer by that of all rows, and if these are fewer still, there is no estimate and none is rejected by
    distance. No rows give no rows.
    """
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    stats = materialize(spark, _features(base_statistics(docs)).withColumn("base_failed", failed), "quality")
    used = materialize(spark, _estimate_keys(spark, stats), "levels")
    estimates = robust_estimates(spark, stats.where("not base_failed"), used)
    judges = materialize(spark, used.join(estimates, ["e_lang", "e_source"]), "judges")
    judged = _distance(stats.join(judges, ["g_lang", "g_source"], "left"))
    inlier = F.coalesce(F.col("d2") <= CUTOFF, F.lit(True))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & inlier).alias("kept"), F.round("d2", 3).alias("distance2"))
