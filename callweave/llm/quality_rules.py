"""Quality rules: robust multivariate outliers by minimum covariance determinant, with DataFrame functions only.

Every document gets counts of its text, and from them a vector of four transformed statistics (log of the mean word
length; square roots of the shares of symbols, of duplicate lines and of repeated words). Of duplicate lines one is left out: a
single repeated line is chance in a text of any length, and its share tells only how short the text is. For each language and source
the covariance of least determinant over half of the documents is sought by concentration steps from two deterministic
starts (robust scales, and equal scales round the medians), then widened to its consistent size and refitted on the
documents near it. A ridge of ``FLOORS`` squared keeps it regular where most documents agree in a statistic; it is small
beside the range of each statistic, so that any one of them alone can reject. A document whose squared Mahalanobis
distance is over ``CUTOFF`` is rejected.

Order statistics come from counts in fine bins, so no group is ever gathered: each step is one partially aggregated pass
over a table of numbers, in which large groups are split evenly. Of two starts with equal determinants the first counts. Languages and sources with under ``MIN_GROUP`` documents are pooled by language; a pool that is
still smaller rejects nothing. Nulls: a null text counts as empty (and fails the base rules), null languages and sources
are groups of their own. Repeated rows count each. Very long texts are documents like
any other. Extra columns, whatever their names, are carried along. An empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from callweave.llm.common import SPACES, join_groups, saved, table

MIN_WORDS, MAX_REPEATED = 50, 50
SYMBOLS = "#*$%&|<>"
#: Least standard deviation of each statistic. Where no other document has any, a document is over CUTOFF by duplicate
#: lines (beyond the first) alone at a share of 0.22 and by repeated words alone at 0.17; at larger ones where they are usual.
FLOORS = (0.06, 0.04, 0.08, 0.07)
P = len(FLOORS)
MIN_GROUP, STEPS = 20, 4
#: Quantiles of chi squared with four degrees of freedom: 0.5, 0.975 and one minus a millionth.
CHI2_HALF, CHI2_NEAR, CUTOFF = 3.3567, 11.1433, 33.3768

X = [f"x{i}" for i in range(P)]
M = [f"m{i}" for i in range(P)]
L = [f"l{i}{j}" for i in range(P) for j in range(i + 1)]


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is evaluated once."""
    return F.transform(F.array(value), body)[0]


def repeated_words(words: Column) -> Column:
    """How many words lie in 3-word windows found twice or more, the first included."""

    def covered(windows: Column) -> Column:
        def starts(s: Column) -> Column:
            twice = F.transform(s, lambda x, j: F.when((F.get(s, j - 1)["k"] == x["k"]) | (F.get(s, j + 1)["k"] == x["k"]), x["i"]))
            return F.array_sort(F.filter(twice, lambda i: i.isNotNull()))

        placed = F.sort_array(F.transform(windows, lambda k, i: F.struct(k.alias("k"), i.alias("i"))))
        lengths = _let(_let(placed, starts), lambda p: F.transform(p, lambda i, j: F.least(F.lit(3), F.coalesce(F.get(p, j + 1) - i, F.lit(3)))))
        total = F.aggregate(lengths, F.lit(0), lambda a, b: a + b)
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), 0).otherwise(total)

    windows = _let(words, lambda w: F.transform(F.slice(w, F.lit(1), F.greatest(F.size(w) - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2))))
    return _let(windows, covered)


def text_stats(text: Column) -> Column:
    """Struct n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words of a text; null counts as empty."""

    def of(t: Column) -> Column:
        words = F.array_remove(F.split(t, SPACES), "")
        solid = F.translate(t, " \t\n\x0b\x0c\r", "")
        lines = F.filter(F.split(t, "\n"), lambda x: F.translate(x, " \t\n\x0b\x0c\r", "") != "")
        return _let(
            F.struct(words.alias("w"), lines.alias("l"), F.length(solid).alias("c"), F.length(F.translate(solid, SYMBOLS, "")).alias("r")),
            lambda s: F.struct(
                F.size(s["w"]).cast("long").alias("n_words"),
                s["c"].cast("long").alias("word_chars"),
                (s["c"] - s["r"]).cast("long").alias("n_symbols"),
                F.size(s["l"]).cast("long").alias("n_lines"),
                (F.size(s["l"]) - F.size(F.array_distinct(s["l"]))).cast("long").alias("n_dup_lines"),
                repeated_words(s["w"]).cast("long").alias("n_repeat_words"),
            ),
        )

    return _let(F.coalesce(text, F.lit("")), of)


def base_failed(s: Column) -> Column:
    return (s["n_words"] < MIN_WORDS) | (100 * s["n_repeat_words"] > MAX_REPEATED * s["n_words"])


def vector(s: Column) -> list[Column]:
    share = lambda part, whole: F.sqrt(part / (s[whole] + 1.0))
    more = F.greatest(s["n_dup_lines"] - 1, F.lit(0))
    return [F.log((s["word_chars"] + 1.0) / (s["n_words"] + 1.0)), share(s["n_symbols"], "word_chars"), share(more, "n_lines"), share(s["n_repeat_words"], "n_words")]


def _quantile_bin(binned: DataFrame, keys: list[str], share: float) -> DataFrame:
    """keys + bin -> keys + the first bin up to which at least ``share`` of the key's rows lie, from counts of bins."""
    counts = binned.groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*keys)
    upto = counts.withColumn("upto", F.sum("n").over(w.orderBy("bin"))).withColumn("all", F.sum("n").over(w))
    return upto.filter(F.col("upto") >= share * F.col("all")).groupBy(*keys).agg(F.min("bin").alias("bin"), F.max("all").alias("all"))


def _with_factor(df: DataFrame, cov) -> DataFrame:
    """Adds the lower triangular factor of the covariance ``cov(i, j)`` plus the ridge, and its log determinant."""
    for i in range(P):
        for j in range(i + 1):
            rest = cov(i, j) - sum((F.col(f"l{i}{k}") * F.col(f"l{j}{k}") for k in range(j)), F.lit(0.0))
            df = df.withColumn(f"l{i}{j}", F.sqrt(F.greatest(rest + FLOORS[i] ** 2, F.lit(FLOORS[i] ** 2))) if i == j else rest / F.col(f"l{j}{j}"))
    return df.withColumn("logdet", sum((F.log(f"l{i}{i}") for i in range(P)), F.lit(0.0)))


def distance2(x: list[Column]) -> Column:
    """Squared Mahalanobis distance, given the columns of centre and factor."""
    z: list[Column] = []
    for i in range(P):
        z.append((x[i] - F.col(M[i]) - sum((F.col(f"l{i}{j}") * z[j] for j in range(i)), F.lit(0.0))) / F.col(f"l{i}{i}"))
    return reduce(lambda a, b: a + b, (v * v for v in z))


def _moments(points: DataFrame, keys: list[str]) -> DataFrame:
    """Centre and factor of the points of each key."""
    sums = [F.avg(x).alias(m) for x, m in zip(X, M, strict=True)]
    sums += [F.covar_pop(X[i], X[j]).alias(f"c{i}{j}") for i in range(P) for j in range(i + 1)]
    fitted = _with_factor(points.groupBy(*keys).agg(*sums), lambda i, j: F.col(f"c{i}{j}"))
    return fitted.select(*keys, *M, *L, "logdet")


def _log_bin(d2: Column) -> Column:
    return F.floor(F.log(d2 + 1e-6) * 50).cast("int")


def fit(points: DataFrame) -> DataFrame:
    """(lang, source, x0 .. x3) -> one row per lang and source: number of points, centre, factor and ``usable``."""
    name = "cw-mcd"
    parts = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counted = saved(points.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n")), name)
    total = counted.agg(F.sum("n")).first()[0] or 0
    counted = counted.select(F.col("lang").alias("g_lang"), F.col("source").alias("g_source"), "n", (F.col("n") < MIN_GROUP).alias("pooled"))
    # The key of a group: hashable also where its parts are null.
    key = F.to_json(F.struct(F.col("g_lang"), F.when(~F.col("pooled"), F.col("g_source")).alias("s"), "pooled"))
    # The points of a key are dealt to so many splits that none has more than an even share of a partition; there are
    # no more splits than keys and partitions together, and parameters are repeated for each.
    sizes = saved(counted.groupBy(key.alias("key")).agg(F.sum("n").alias("all")).withColumn("splits", F.ceil(F.col("all") * parts / F.lit(max(total, 1))).cast("int")), name)
    groups = saved(counted.withColumn("key", key).join(sizes, "key"), name)
    own = join_groups(points, groups, {"lang": "g_lang", "source": "g_source"}, "n", total)
    keyed = saved(own.select("key", F.pmod(F.monotonically_increasing_id(), F.col("splits")).cast("int").alias("split"), *X), name)
    splits = sizes.select("key", F.explode(F.sequence(F.lit(0), F.col("splits") - 1)).alias("split"))

    def with_key(params: DataFrame) -> DataFrame:
        return keyed.join(params.join(splits, "key"), ["key", "split"]).drop("split")

    # Medians of the statistics, then of the distances from them, by bins of an eighth of the floor.
    width = F.element_at(F.array(*[F.lit(f / 8) for f in FLOORS]), F.col("d") + 1)
    wide = lambda df, v: df.groupBy("key").agg(*[F.max(F.when(F.col("d") == i, F.col(v))).alias(f"{v}{i}") for i in range(P)])
    long = keyed.select("key", F.posexplode(F.array(*X)).alias("d", "x"))
    mid = _quantile_bin(long.withColumn("bin", F.round(F.col("x") / width).cast("int")), ["key", "d"], 0.5).select("key", "d", (F.col("bin") * width).alias("mid"))
    mids = saved(wide(mid, "mid"), name)
    off = with_key(mids).select("key", F.posexplode(F.array(*[F.abs(F.col(X[i]) - F.col(f"mid{i}")) for i in range(P)])).alias("d", "x"))
    mad = _quantile_bin(off.withColumn("bin", F.round(F.col("x") / width).cast("int")), ["key", "d"], 0.5).select("key", "d", (F.col("bin") * width * 1.4826).alias("mad"))
    starts = mids.join(wide(mad, "mad"), "key").withColumn("start", F.explode(F.array(F.lit(0), F.lit(1))))
    starts = starts.select("key", "start", *[F.col(f"mid{i}").alias(M[i]) for i in range(P)], *[f"mad{i}" for i in range(P)])
    first = lambda i, j: F.when(F.col("start") == 0, F.col(f"mad{i}") ** 2).otherwise(0.0) if i == j else F.lit(0.0)
    at = saved(_with_factor(starts, first).select("key", "start", *M, *L, "logdet"), name)

    def placed(params: DataFrame) -> DataFrame:
        return with_key(params).withColumn("d2", distance2([F.col(x) for x in X]))

    for _ in range(STEPS):
        cut = _quantile_bin(placed(at).select("key", "start", _log_bin(F.col("d2")).alias("bin")), ["key", "start"], 0.5)
        within = placed(at.join(cut.select("key", "start", F.col("bin").alias("cut")), ["key", "start"])).filter(_log_bin(F.col("d2")) <= F.col("cut"))
        at = saved(_moments(within, ["key", "start"]), name)

    best = at.withColumn("rank", F.row_number().over(Window.partitionBy("key").orderBy("logdet", "start"))).filter("rank = 1").drop("rank", "start")
    # The half's spread is too small by a factor known from the median distance; it never shrinks below the ridge.
    half = _quantile_bin(placed(best).select("key", _log_bin(F.col("d2")).alias("bin")), ["key"], 0.5)
    grown = F.greatest(F.exp((F.col("bin") + 1) / 50.0) / CHI2_HALF, F.lit(1.0))
    scaled = saved(best.join(half.select("key", grown.alias("wide")), "key").select("key", *M, *[(F.col(x) * F.sqrt("wide")).alias(x) for x in L]), name)
    near = _moments(placed(scaled).filter(F.col("d2") <= CHI2_NEAR), ["key"])
    final = near.join(sizes, "key").withColumn("usable", F.col("all") >= MIN_GROUP)
    return saved(groups.select("g_lang", "g_source", "n", "key").join(final.drop("logdet", "all", "splits"), "key").drop("key"), name)


def _with_params(rows: DataFrame, params: DataFrame) -> DataFrame:
    """``rows`` with the parameters of their language and source as the struct ``_cw_p``: of rows that passed the base
    rules, which are those that the parameters count."""
    own = params.select(F.struct(*M, *L, "usable").alias("_cw_p"), F.col("n").alias("_cw_n"), F.col("g_lang").alias("_cw_lang"), F.col("g_source").alias("_cw_source"))
    total = params.agg(F.sum("n")).first()[0] or 0
    return join_groups(rows, own, {"lang": "_cw_lang", "source": "_cw_source"}, "_cw_n", total).drop("_cw_n")


def _verdict(s: Column, p: Column) -> tuple[Column, Column]:
    """Squared distance of the statistics, and whether it is one to keep."""
    x, z = vector(s), []
    for i in range(P):
        z.append((x[i] - p[M[i]] - sum((p[f"l{i}{j}"] * z[j] for j in range(i)), F.lit(0.0))) / p[f"l{i}{i}"])
    d2 = reduce(lambda a, b: a + b, (v * v for v in z))
    return d2, ~(F.coalesce(p["usable"], F.lit(False)) & F.coalesce(d2 > CUTOFF, F.lit(False)))


def judged(rows: DataFrame, params: DataFrame, stats: str) -> DataFrame:
    """``rows`` (lang, source and the struct ``stats``) with ``_cw_kept`` and ``_cw_d2`` by the fitted parameters; rows that fail
    the base rules need none, and their distance is null."""
    s = F.col(stats)
    d2, kept = _verdict(s, F.col("_cw_p"))
    passed = _with_params(rows.filter(~base_failed(s)), params).withColumn("_cw_d2", d2).withColumn("_cw_kept", kept).drop("_cw_p")
    return passed.unionByName(rows.filter(base_failed(s)).withColumns({"_cw_d2": F.lit(None).cast("double"), "_cw_kept": F.lit(False)}))


def _points(stats: DataFrame, s: str = "s") -> DataFrame:
    return stats.filter(~base_failed(F.col(s))).select("lang", "source", *[v.alias(x) for v, x in zip(vector(F.col(s)), X, strict=True)])


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, source, s) of all documents, written to the shared folder."""
    return saved(docs.select("doc_id", "lang", "source", text_stats(F.col("text")).alias("s")), "cw-stats")


def filter_outliers(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that both the base rules and the distance keep, columns unchanged. The documents are written with
    their statistics, so that these are taken once; they must have text, lang and source."""
    stats = saved(docs.withColumn("_cw_s", text_stats(F.col("text"))), "cw-stats", "zstd")
    return judged(stats, fit(_points(stats, "_cw_s")), "_cw_s").filter("_cw_kept").select(*[F.col(f"`{c}`") for c in docs.columns])


def op9_quality_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = measured(table(spark, sf_dir, "documents"))
    out = judged(stats, fit(_points(stats)), "s")
    cols = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return out.select("doc_id", *[F.col("s")[c].alias(c) for c in cols], base_failed(F.col("s")).alias("base_failed"), F.col("_cw_kept").alias("kept"), F.col("_cw_d2").alias("distance2"))
