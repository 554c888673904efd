"""Quality rules: plain limits, then robust multivariate outliers per language and source."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coastgrid.functions.session import materialise
from coastgrid.llm.common import BLANKS, narrow

BLANK_CHARS = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
FEATURES = ("word_length", "marks", "capitals", "repeats", "line_repeats")
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

#: Added to a ratio before its logarithm: counts below this per word or line are noise.
SOFTENING = 0.05
#: Standard deviation that each transformed statistic has at least.  Ratios of repeats are
#: zero in most documents; a quoted line or two must not count as far away.
FLOORS = (0.1, 0.15, 0.15, 0.08, 0.12)
#: Bins per unit of log(1 + squared distance), and of a statistic for its median.
DISTANCE_BINS = 200
VALUE_BINS = 200
#: Pool of the languages too small for their own; its estimate is that of the documents of all pools.
EVERY = "*"
#: A pool is settled when half the logarithm of its determinant shrinks by less.
SETTLED = 5e-4
#: Parts of a pool's rows where they are joined with its estimate.
SALTS = 16


def text_statistics(text: Column, docs: DataFrame) -> DataFrame:
    """``docs`` with the counts of ``BASE`` and ``n_marks, n_capitals, n_lines`` of ``text``."""
    step = docs.withColumn("_text", F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANK_CHARS)))
    step = step.withColumn("_words", F.split("_text", BLANKS)).withColumn(
        # Of the text as it is: blanks at its ends belong to its first and last line.
        "_lines", F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.btrim(x, F.lit(BLANK_CHARS)) != "")
    )
    words, n = F.col("_words"), F.col("n_words")
    step = step.withColumn("n_words", F.when(F.col("_text") == "", 0).otherwise(F.size("_words")).cast("long"))
    step = step.withColumn(
        "_windows",
        F.when(
            n >= 3,
            F.transform(
                F.sequence(F.lit(0), (n - 3).cast("int")),
                lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)),
            ),
        ),
    )
    # Only texts in which some window occurs twice are sorted.
    step = step.withColumn(
        "_sorted",
        F.when(
            F.size(F.array_distinct("_windows")) < F.size("_windows"),
            F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ),
    )
    ordered = F.col("_sorted")
    step = step.withColumn(
        "_places",
        F.sort_array(
            F.transform(
                F.filter(
                    ordered,
                    lambda x, k: x["h"].eqNullSafe(F.get(ordered, k - 1)["h"]) | x["h"].eqNullSafe(F.get(ordered, k + 1)["h"]),
                ),
                lambda x: x["i"],
            )
        ),
    )
    places = F.col("_places")
    covered = F.aggregate(
        F.transform(places, lambda p, k: F.when(k == 0, 3).otherwise(F.least(F.lit(3), p - F.get(places, k - 1)))),
        F.lit(0),
        lambda a, x: a + x,
    )
    length = lambda pattern: F.char_length(F.regexp_replace("_text", pattern, "")).cast("long")
    return step.withColumns(
        {
            "word_chars": F.char_length(F.array_join("_words", "")).cast("long"),
            "n_symbols": length(f"[^{SYMBOLS}]+"),
            "n_marks": length(r"[\p{L}\p{M}\p{N}\s]+"),
            "n_capitals": length(r"[^\p{Lu}]+"),
            "n_lines": F.size("_lines").cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_repeat_words": F.coalesce(covered, F.lit(0)).cast("long"),
        }
    ).drop("_text", "_words", "_lines", "_windows", "_sorted", "_places")


def _features() -> dict[str, Column]:
    share = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    ratio = lambda a, b: F.log(F.lit(SOFTENING) + share(a, b))
    return dict(
        zip(
            FEATURES,
            (
                ratio("word_chars", "n_words"),
                ratio("n_marks", "n_words"),
                ratio("n_capitals", "n_words"),
                share("n_repeat_words", "n_words"),
                share("n_dup_lines", "n_lines"),
            ),
        )
    )


def chi_square_cdf(x: float, freedom: int) -> float:
    """By the series of the lower incomplete gamma function."""
    a, x = freedom / 2, x / 2
    term = total = 1 / a
    for k in range(1, 10_000):
        term *= x / (a + k)
        total += term
        if term < total * 1e-15:
            break
    return total * math.exp(a * math.log(x) - x - math.lgamma(a)) if x > 0 else 0.0


def chi_square_quantile(p: float, freedom: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square_cdf(middle, freedom) < p else (low, middle)
    return high


def _groups(rows: DataFrame, smallest: int) -> DataFrame:
    """``rows`` with ``pool``: its language and source, or what small groups are pooled into.

    A group below ``smallest`` goes into that of its language; a language of fewer goes into ``EVERY``.
    """
    count = rows.groupBy("lang", "source").agg(F.count("*").alias("n"))
    by_lang = Window.partitionBy("lang")
    count = count.withColumn("own", F.col("n") >= smallest)
    count = count.withColumn("rest", F.sum(F.when(~F.col("own"), F.col("n"))).over(by_lang))
    names = materialise(
        count.select(
            "lang",
            "source",
            F.when(F.col("own"), F.to_json(F.struct("lang", "source")))
            .when(F.col("rest") >= smallest, F.to_json(F.struct("lang")))
            .otherwise(EVERY)
            .alias("pool"),
        )
    )
    match = rows["lang"].eqNullSafe(names["lang"]) & rows["source"].eqNullSafe(names["source"])
    return rows.join(names, match, "left").select(*(rows[c] for c in rows.columns), "pool")


def _quantile_bins(rows: DataFrame, keys: list[str], bin_: str, q: float) -> DataFrame:
    """The first bin per key at or below which lies a share ``q`` of the rows."""
    # Written first: else Spark would deal the sums by ``keys`` alone for the windows, all of a pool to one task.
    counts = materialise(rows.groupBy(*keys, bin_).agg(F.count("*").alias("n")))
    run = Window.partitionBy(*keys).orderBy(bin_)
    whole = Window.partitionBy(*keys)
    return (
        counts.withColumns({"upto": F.sum("n").over(run), "all": F.sum("n").over(whole)})
        .filter(F.col("upto") >= F.lit(q) * F.col("all"))
        .groupBy(*keys)
        .agg(F.min(bin_).alias(bin_))
    )


def _cholesky(estimates: DataFrame) -> DataFrame:
    """Adds ``l_i_j`` from ``c_i_j``, and half the log-determinant."""
    p = len(FEATURES)
    for j in range(p):
        rest = reduce(lambda a, k: a - F.col(f"l_{j}_{k}") ** 2, range(j), F.col(f"c_{j}_{j}"))
        estimates = estimates.withColumn(f"l_{j}_{j}", F.sqrt(F.greatest(rest, F.lit(1e-9))))
        estimates = estimates.withColumns(
            {
                f"l_{i}_{j}": reduce(lambda a, k: a - F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}"), range(j), F.col(f"c_{j}_{i}"))
                / F.col(f"l_{j}_{j}")
                for i in range(j + 1, p)
            }
        )
    volume = reduce(lambda a, j: a + F.log(f"l_{j}_{j}"), range(p), F.lit(0.0))
    kept = ["pool", "n", *(f"m_{i}" for i in range(p)), *(f"l_{i}_{j}" for i in range(p) for j in range(i + 1))]
    return estimates.withColumn("volume", volume).select(*kept, "volume")


def _squared_distance() -> Column:
    """Forward substitution of ``l z = x - m``; the distance is the sum of the squares of z."""
    z: list[Column] = []
    for i, name in enumerate(FEATURES):
        left = reduce(lambda a, k: a - F.col(f"l_{i}_{k}") * z[k], range(i), F.col(name) - F.col(f"m_{i}"))
        z.append(left / F.col(f"l_{i}_{i}"))
    return reduce(lambda a, b: a + b, [x * x for x in z])


def _measured(vectors: DataFrame, estimates: DataFrame) -> DataFrame:
    """``vectors`` with ``d2, settled``.  A left join by pool and salt, so that a hot pool is split and sums after it are not dealt by pool."""
    salted = estimates.drop("n", "volume").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>")))
    joined = vectors.withColumn("salt", F.pmod(F.xxhash64(*FEATURES), F.lit(SALTS))).join(salted, ["pool", "salt"], "left")
    return joined.select(*vectors.columns, _squared_distance().alias("d2"), "settled")


def _start(vectors: DataFrame) -> DataFrame:
    """Medians and scaled median absolute deviations, axes taken as independent."""
    p = len(FEATURES)
    long = vectors.select(
        "pool", F.posexplode(F.array(*FEATURES)).alias("axis", "x")
    ).withColumn("bin", F.round(F.col("x") * VALUE_BINS).cast("long"))
    middle = materialise(_quantile_bins(long, ["pool", "axis"], "bin", 0.5).withColumnRenamed("bin", "middle"))
    spread = _quantile_bins(
        long.join(middle, ["pool", "axis"]).withColumn("off", F.abs(F.col("bin") - F.col("middle"))), ["pool", "axis"], "off", 0.5
    )
    both = middle.join(spread, ["pool", "axis"])
    at = lambda i, c: F.max(F.when(F.col("axis") == i, c))
    one = both.groupBy("pool").agg(
        F.lit(0).cast("long").alias("n"),
        *(at(i, F.col("middle") / VALUE_BINS).alias(f"m_{i}") for i in range(p)),
        *(at(i, F.pow(1.4826 * F.col("off") / VALUE_BINS, F.lit(2)) + FLOORS[i] ** 2).alias(f"c_{i}_{i}") for i in range(p)),
    )
    zeros = {f"c_{i}_{j}": F.lit(0.0) for i in range(p) for j in range(i + 1, p)}
    return materialise(_cholesky(one.withColumns(zeros)))


def _concentrate(vectors: DataFrame, estimates: DataFrame, share: float, inflate: float) -> DataFrame:
    """One C-step: moments of the ``share`` of each pool that lies nearest to its centre.

    Moments are summed by pool and distance bin inside the tasks; running sums over a
    pool's bins then give those of the nearest rows, so no pool is ever in one place.
    """
    p = len(FEATURES)
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    binned = _measured(vectors, estimates).withColumn("bin", F.floor(F.log1p("d2") * DISTANCE_BINS))
    x = [F.col(name) for name in FEATURES]
    sums = binned.groupBy("pool", "bin").agg(
        F.count("*").alias("n"),
        *(F.sum(x[i]).alias(f"s_{i}") for i in range(p)),
        *(F.sum(x[i] * x[j]).alias(f"s_{i}_{j}") for i, j in pairs),
    )
    sums = materialise(sums)  # Dealt by pool and bin; the windows below then see bins only.
    run, whole = Window.partitionBy("pool").orderBy("bin"), Window.partitionBy("pool")
    totals = [c for c in sums.columns if c not in ("pool", "bin")]
    upto = sums.select("pool", "bin", F.sum("n").over(whole).alias("all"), *(F.sum(c).over(run).alias(c) for c in totals))
    core = upto.filter(F.col("n") >= F.lit(share) * F.col("all")).groupBy("pool").agg(F.min_by(F.struct(*totals), "bin").alias("s"))
    core = core.select("pool", "s.*").withColumns({f"m_{i}": F.col(f"s_{i}") / F.col("n") for i in range(p)})
    core = core.withColumns(
        {
            f"c_{i}_{j}": F.lit(inflate) * (F.col(f"s_{i}_{j}") / F.col("n") - F.col(f"m_{i}") * F.col(f"m_{j}"))
            + F.lit(FLOORS[i] ** 2 if i == j else 0.0)
            for i, j in pairs
        }
    )
    return materialise(_cholesky(core))


def quality_rules(
    docs: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    lang: str = "lang",
    source: str = "source",
    share: float = 0.75,
    tail: float = 1e-6,
    smallest: int = 100,
    steps: int = 40,
) -> DataFrame:
    """One row per document: ``doc_id``, the counts of ``BASE``, ``base_failed, kept, distance, settled``.

    Base rule: fewer than 50 words, or more than half of the words in three-word windows
    that occur twice or more in the text.  Documents that pass it are then compared with
    the other such documents of their language and source.  Minimum-covariance-determinant
    estimates come from C-steps on binned distances, from a median start, until no
    determinant shrinks by more than 0.1 % or after ``steps``; ``settled`` tells whether that of the document's pool
    did not any more.  A document is rejected when
    its squared Mahalanobis distance, as it is for texts of any length, exceeds the chi-square
    quantile at ``1 - tail``: 35.9 for the default.
    Variances have a floor, since most documents have no repeated line at all and the
    covariance of the core would be singular.

    Languages and sources with fewer than ``smallest`` such documents are pooled by
    language.  Those of languages that are still smaller are judged by an estimate over the
    documents of all languages.  Only where all such documents together are fewer than ``smallest``
    there is no estimate, and none is rejected.  Null text counts as empty and fails; null language or source is a value of
    its own.  Repeated rows and ties are judged alike, each on its own.  Texts are read
    whole.  Other columns of ``docs`` are not used and may have any name.
    """
    rows = narrow(docs, doc_id=doc_id, lang=lang, source=source, text=text)
    counted = text_statistics(F.col("text"), rows).drop("text")
    failed = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    counted = materialise(counted.withColumn("base_failed", failed).withColumns(_features()))
    passed = materialise(_groups(counted.filter("not base_failed"), smallest))
    vectors = passed.select("pool", *FEATURES)
    sizes = passed.groupBy("pool").agg(F.count("*").alias("n")).agg(F.sum("n").alias("n"), F.max(F.col("pool") == EVERY).alias("rest")).first()
    own = vectors.filter(F.col("pool") != EVERY) if (sizes["n"] or 0) >= smallest else vectors.limit(0)
    if sizes["rest"] and sizes["n"] >= smallest:
        own = own.unionByName(vectors.withColumn("pool", F.lit(EVERY)))
    vectors = materialise(own)

    p = len(FEATURES)
    inflate = share / chi_square_cdf(chi_square_quantile(share, p), p + 2)
    estimates = _start(vectors).withColumn("settled", F.lit(False))
    for step in range(steps):
        nearer = _concentrate(vectors, estimates, share, inflate)
        # The first step comes from another kind of estimate.
        same = F.lit(step > 0) & (F.col("before") - F.col("volume") < SETTLED)
        before = estimates.select("pool", F.col("volume").alias("before"))
        estimates = materialise(nearer.join(before, "pool").withColumn("settled", same).drop("before"))
        if estimates.filter(~F.col("settled")).isEmpty():
            break

    judged = _measured(passed, estimates).withColumnRenamed("d2", "distance")
    keep = F.coalesce(F.col("distance") <= chi_square_quantile(1 - tail, p), F.lit(True))
    columns = ["doc_id", *BASE, "base_failed"]
    judged = judged.select(*columns, keep.alias("kept"), "distance", "settled")
    dropped = counted.filter("base_failed").select(*columns, F.lit(False).alias("kept"), F.lit(None).cast("double").alias("distance"), F.lit(None).cast("boolean").alias("settled"))
    return judged.unionByName(dropped)
