"""Quality rules with a robust multivariate outlier test per language and source (Spark SQL only).

*Base statistics* come from one pass over the whole text with higher-order functions: words are
``[^\\x20\\x09-\\x0D]+``; the repeated three-word windows of a document are found by sorting its
(window hash, position) structs and looking at neighbours, so a document costs n log n.

*Minimum covariance determinant.* The statistics become a vector of ``FEATURES``: mean word length,
a variance-stabilised share of symbols, and for repeated lines and repeated words the standard
deviations above none. One repeated header is at most about one and three of them and stays at any
length; half of the words of 100, or ten lines of 40, are beyond the cutoff alone. For each (language,
source) three starts (the quartiles of each coordinate as centre, each with the median absolute
deviation, all from histograms) are refined by concentration steps: all rows get their Mahalanobis
distance under the current estimate, the rows of the group with the smallest distances (at least
``SUPPORT`` of them) give the next mean and covariance. The steps end when no estimate of any group
moves by more than ``TOLERANCE``, or after ``MAX_STEPS`` (the support is cut at a bin, so two estimates
can alternate). Of the three the one of least determinant stays, and is reweighted: the rows within the
0.975 quantile of chi-square give the final mean and covariance. Up to half of a group can be outliers.
One step is one aggregate by (language, source, start, distance bin): counts and moments per bin are
reduced map-side, so a source with a third of all rows sends at most 3 x ``BINS`` rows per task, and
the support is cut at the bin where the running count reaches its share. Every row takes part in
every step. ``PRIOR_ROWS`` rows of the variance floor are blended into each covariance, so constant
statistics and groups of a few rows stay regular. A row is rejected when its squared distance
exceeds ``CUTOFF``.

The parameter table has one row per (language, source), three during the steps. It is joined without a hint: AQE broadcasts
it when it is small and splits a skewed source when it is not.

Defined results: null text counts as empty (all statistics 0, base_failed); null language or source
is a group of its own; base-failed rows take no part in the estimates and are never kept; a group
of one row has distance 0; repeated rows count once each; an empty table gives an empty result.
The statistics table is written once to the shared checkpoint folder and read by every step.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricelake.llm.common import col, fresh
from pricelake.session import freeze

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Transformed statistics and their measurement noise, below which no spread is believed: 2.5 characters
#: a word over MIN_WORDS words, half a root of a symbol count over some 120 words, and one of a z-score.
FEATURES = {"word_length": 0.35, "symbols": 0.045, "dup_lines": 1.0, "repeats": 1.0}
#: Words of the smallest repetition (a three-word window written twice), the unit of ``repeats``.
REPEAT_UNIT = 6
#: Lines, or units of words, beyond which a text counts by its share and not by its number of repeats.
SATURATION = 200
SUPPORT = 0.5
#: Shares of the rows below the centres of the starts; the first wins ties.
CENTRES = (0.5, 0.25, 0.75)
MAX_STEPS = 20
#: Largest change of a converged estimate: of a mean in its noise, of the logarithm of the determinant.
TOLERANCE = 1e-3
BINS = 256
PRIOR_ROWS = 25
#: Rejected beyond this squared distance, the 0.9999 quantile of chi-square with 4 degrees of freedom.
CUTOFF = 23.513
#: Share / P(chi2_6 <= q), q the quantile of chi2_4 at the share: makes the covariance of the closest
#: rows consistent. For SUPPORT q = 3.35669; for the reweighting q = 11.14329 at a share of 0.975.
CONSISTENCY = 2.10906
REWEIGHTED, REWEIGHTED_CONSISTENCY = 11.14329, 1.06447

_F = list(FEATURES)
_P = len(_F)
_STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
_MEASURED = [*_STATS, "n_lines"]


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _repeat_words(words: Column) -> Column:
    """Words inside three-word windows that occur at least twice in the text."""
    def windows(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.struct(
            F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i")))

    def repeated(s: Column) -> Column:
        same = lambda x, k: (F.get(s, k)["h"] == x["h"])
        return F.array_sort(F.transform(
            F.filter(s, lambda x, k: F.coalesce(same(x, k - 1), F.lit(False)) | F.coalesce(same(x, k + 1), F.lit(False))),
            lambda x: x["i"]))

    def covered(at: Column) -> Column:
        return F.aggregate(F.transform(at, lambda p, k: F.least(F.lit(3), F.coalesce(F.get(at, k + 1) - p, F.lit(3)))),
                           F.lit(0), lambda a, x: a + x)

    return F.when(F.size(words) >= 4, _let(F.sort_array(windows(words)), lambda s: _let(repeated(s), covered))
                  ).otherwise(F.lit(0)).cast("long")


def statistics(text: Column) -> Column:
    """Struct of n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines of a text."""
    t = F.coalesce(text.cast("string"), F.lit(""))
    sep = r"[^\x20\x09-\x0D]"
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(sep))
    return _let(F.regexp_extract_all(t, F.lit(f"{sep}+"), F.lit(0)), lambda w: _let(lines, lambda x: F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"),
        F.regexp_count(t, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        _repeat_words(w).alias("n_repeat_words"),
        F.size(x).cast("long").alias("n_lines"))))


def _base_failed() -> Column:
    return ((F.col("n_words") < MIN_WORDS)
            | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))


def _above_none(k: Column, n: Column) -> Column:
    """How far ``k`` of ``n`` is above none, in standard deviations of a binomial share (Anscombe's
    angles); the number of trials saturates at ``SATURATION``, so long texts are compared by share."""
    angle = lambda k: F.asin(F.sqrt(F.least((k + 0.375) / (n + 0.75), F.lit(1.0))))
    return 2 * F.sqrt(n * SATURATION / (n + SATURATION)) * (angle(k) - angle(F.lit(0.0)))


def _vector() -> dict[str, Column]:
    """The transformed statistics; words are at least one here."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return {"word_length": F.col("word_chars") / n,
            "symbols": F.asinh(4 * F.sqrt(F.col("n_symbols") / n)) / 4,
            "dup_lines": _above_none(F.col("n_dup_lines"), F.greatest(F.col("n_lines"), F.lit(1)).cast("double")),
            "repeats": _above_none(F.col("n_repeat_words") / REPEAT_UNIT, n / REPEAT_UNIT)}


def described(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source",
              *keep: Column) -> DataFrame:
    """Statistics, base verdict and transformed vector of every row, beside the columns ``keep``."""
    rows = docs.select(*keep, col(lang).alias("g_lang"), col(source).alias("g_source"),
                       statistics(col(text)).alias("s"))
    rows = rows.select(*[c for c in rows.columns if c != "s"], *[F.col(f"s.{k}").alias(k) for k in _MEASURED])
    return rows.withColumn("base_failed", _base_failed()).withColumns(_vector())


def _start(rows: DataFrame) -> DataFrame:
    """The starts of each group: quartiles and median absolute deviation of each coordinate, from
    histograms of a quarter of the floor."""
    step = F.element_at(F.array(*[F.lit(FEATURES[f] / 4) for f in _F]), F.col("k") + 1)
    each = rows.select("g_lang", "g_source", F.posexplode(F.array(*_F)).alias("k", "x"))
    bins = (each.withColumn("bin", F.floor(F.col("x") / step)).groupBy("g_lang", "g_source", "k", "bin")
            .agg(F.count("*").alias("n")).withColumn("at", (F.col("bin") + 0.5) * step))
    w = Window.partitionBy("g_lang", "g_source", "k")
    run = bins.withColumn("upto", F.sum("n").over(w.orderBy("bin"))).withColumn("all", F.sum("n").over(w))
    centre = lambda p: F.min(F.when(F.col("upto") >= p * F.col("all"), F.col("at")))
    run = run.withColumn("off", F.abs(F.col("at") - centre(0.5).over(w)))
    run = run.withColumn("within", F.sum("n").over(w.orderBy("off")))
    per = run.groupBy("g_lang", "g_source", "k").agg(
        F.array(*[centre(p) for p in CENTRES]).alias("m"),
        (F.min(F.when(F.col("within") >= 0.5 * F.col("all"), F.col("off"))) * 1.4826).alias("s"))
    pick = lambda c, k: F.max(F.when(F.col("k") == k, F.col(c)))
    out = per.groupBy("g_lang", "g_source").agg(
        *[pick("m", k).alias(f"centres{k}") for k in range(_P)], *[pick("s", k).alias(f"s{k}") for k in range(_P)])
    out = out.withColumn("start", F.explode(F.array(*[F.lit(i) for i in range(len(CENTRES))])))
    for i, f in enumerate(_F):
        out = out.withColumn(f"m{i}", F.get(f"centres{i}", F.col("start")))
        for j in range(i + 1):
            out = out.withColumn(f"l{i}{j}", F.greatest(F.col(f"s{i}"), F.lit(FEATURES[f])) if i == j else F.lit(0.0))
    return out.select("g_lang", "g_source", "start", *_params())


def _params() -> list[str]:
    return [f"m{i}" for i in range(_P)] + [f"l{i}{j}" for i in range(_P) for j in range(i + 1)]


def _with_distance(rows: DataFrame, params: DataFrame) -> DataFrame:
    """Adds ``distance``: the squared Mahalanobis distance, by forward substitution with the
    Cholesky factor of the row's group (null where the group has no estimate); with several starts
    a group, one row for each."""
    p = params.withColumnsRenamed({"g_lang": "p_lang", "g_source": "p_source"})
    out = rows.join(p, F.col("g_lang").eqNullSafe(F.col("p_lang")) & F.col("g_source").eqNullSafe(F.col("p_source")), "left")
    for i, f in enumerate(_F):
        z = F.col(f) - F.col(f"m{i}")
        for j in range(i):
            z = z - F.col(f"l{i}{j}") * F.col(f"z{j}")
        out = out.withColumn(f"z{i}", z / F.col(f"l{i}{i}"))
    return (out.withColumn("distance", sum((F.col(f"z{i}") * F.col(f"z{i}") for i in range(1, _P)), F.col("z0") * F.col("z0")))
            .drop("p_lang", "p_source", *_params(), *[f"z{i}" for i in range(_P)]))


_PAIRS = [(i, j) for i in range(_P) for j in range(i + 1)]


def _moments() -> list[Column]:
    return [F.count("*").alias("n"), *[F.sum(f).alias(f"a{i}") for i, f in enumerate(_F)],
            *[F.sum(F.col(_F[i]) * F.col(_F[j])).alias(f"b{i}{j}") for i, j in _PAIRS]]


def _estimate(s: DataFrame, keys: list[str], consistency: float) -> DataFrame:
    """Mean and Cholesky factor from moments."""
    s = s.withColumns({f"m{i}": F.col(f"a{i}") / F.col("n") for i in range(_P)})
    cov = {}
    for i, j in _PAIRS:
        c = (F.col(f"b{i}{j}") / F.col("n") - F.col(f"m{i}") * F.col(f"m{j}")) * consistency * F.col("n")
        if i == j:
            c = F.greatest(c, F.lit(0.0)) + PRIOR_ROWS * FEATURES[_F[i]] ** 2
        cov[f"c{i}{j}"] = c / (F.col("n") + PRIOR_ROWS)
    s = s.withColumns(cov)
    for i, j in _PAIRS:  # Cholesky, row by row
        v = F.col(f"c{i}{j}")
        for k in range(j):
            v = v - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
        # no spread below the noise after conditioning on the others
        least = FEATURES[_F[i]] ** 2
        s = s.withColumn(f"l{i}{j}", F.sqrt(F.greatest(v, F.lit(least))) if i == j else v / F.col(f"l{j}{j}"))
    return s.select(*keys, *_params())


def _concentrate(rows: DataFrame, params: DataFrame) -> DataFrame:
    """One concentration step: the mean and Cholesky factor of the closest rows of each group and start."""
    keys = ["g_lang", "g_source", "start"]
    # bins of the distance by its logarithm: 2**-8 to 2**24, eight to the octave
    bin_ = F.least(F.greatest(F.floor(8 * F.log2(F.col("distance") + 2.0 ** -8)) + 64, F.lit(0)), F.lit(BINS - 1))
    bins = _with_distance(rows, params).withColumn("bin", bin_).groupBy(*keys, "bin").agg(*_moments())
    w = Window.partitionBy(*keys)
    cut = (bins.withColumn("before", F.sum("n").over(w.orderBy("bin")) - F.col("n"))
           .withColumn("all", F.sum("n").over(w)).where(F.col("before") < SUPPORT * F.col("all")))
    sums = ["n", *[f"a{i}" for i in range(_P)], *[f"b{i}{j}" for i, j in _PAIRS]]
    return _estimate(cut.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums]), keys, CONSISTENCY)


def _log_det(at: str = "") -> Column:
    return sum((2 * F.log(f"{at}l{i}{i}") for i in range(1, _P)), 2 * F.log(f"{at}l00"))


def _moved(now: DataFrame, before: DataFrame) -> bool:
    """Whether the estimate of any group and start has changed."""
    both = now.alias("x").join(before.alias("y"), F.col("x.g_lang").eqNullSafe(F.col("y.g_lang"))
                               & F.col("x.g_source").eqNullSafe(F.col("y.g_source")) & (F.col("x.start") == F.col("y.start")))
    change = F.greatest(F.abs(_log_det("x.") - _log_det("y.")),
                        *[F.abs(F.col(f"x.m{i}") - F.col(f"y.m{i}")) / FEATURES[f] for i, f in enumerate(_F)])
    return not both.where(change > TOLERANCE).isEmpty()


def estimates(rows: DataFrame) -> DataFrame:
    """Mean and Cholesky factor per (language, source) from rows that pass the base rules."""
    good = rows.where(~F.col("base_failed"))
    params = freeze(_start(good), "mcd")
    for _ in range(MAX_STEPS):
        before, params = params, freeze(_concentrate(good, params), "mcd")
        if not _moved(params, before):
            break
    keys = ["g_lang", "g_source"]
    best = params.groupBy(*keys).agg(F.min(F.struct(_log_det().alias("det"), "start", *_params())).alias("p"))
    best = best.select(*keys, *[F.col(f"p.{c}").alias(c) for c in _params()])
    near = _with_distance(good, best).where(F.col("distance") <= REWEIGHTED).groupBy(*keys).agg(*_moments())
    return freeze(_estimate(near, keys, REWEIGHTED_CONSISTENCY), "mcd")


def _verdict() -> Column:
    return ~F.col("base_failed") & F.coalesce(F.col("distance") <= CUTOFF, F.lit(True))


def judge(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang",
          source: str = "source") -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, distance
    and kept for every row."""
    rows = freeze(described(docs, text, lang, source, col(doc_id).alias("doc_id")), "stats")
    return (_with_distance(rows, estimates(rows)).withColumn("kept", _verdict())
            .select("doc_id", *_STATS, "base_failed", F.round("distance", 6).alias("distance"), "kept"))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that pass, with their columns. The rows are stored once with their statistics;
    the estimates read the statistics alone."""
    row = fresh(docs, "kept_row")
    rows = freeze(described(docs, "text", "lang", "source", F.struct(*[col(c) for c in docs.columns]).alias(row)), "described")
    return _with_distance(rows, estimates(rows.drop(row))).where(_verdict()).select(f"{row}.*")
