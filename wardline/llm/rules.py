"""Quality rules whose cutoffs come with a guarantee against false rejection.

Every rule is a per-mille figure of a text and rejects above a cutoff. Labelled documents are the
holdout: of the ``n`` good ones of a stratum (its language) a cutoff rejects ``k``. It is valid if the
exact one-sided binomial bound on its false rejection rate lies below ``alpha`` at a confidence that
is corrected (Bonferroni) for all strata, rules and cutoffs tested, so that with probability
``1 - delta`` every cutoff in use keeps the rate. Of the valid cutoffs the one that gains most is used, the
most lenient of equals: a bad document that it rejects counts one, a good one costs ``PRICE``. A rule
that gains nothing stays off.

Only column expressions and joins. Texts are read once for the figures, which are stored; what is
learnt is one row per stratum, joined back with a salt because one language may hold most rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# White space between words, and the characters that count as symbols.
SPACE = r"[\x20\x09-\x0D]+"
SYMBOL = r"[#*$%&|<>]"
RUN = 5
SALTS = 64
#: Bad documents that a rule has to reject for every good one it rejects.
PRICE = 10

#: Rules by name: per-mille figure as (numerator, denominator), and the cutoffs tried.
STEPS = (50, 100, 150, 200, 300, 400, 500, 600, 700, 800, 900, 1000)
RULES: dict[str, tuple[str, str, tuple[int, ...]]] = {
    "symbols": ("n_symbols", "n_words", STEPS),
    "dup_lines": ("n_dup_lines", "n_lines", STEPS),
    "repeats": ("n_repeat_words", "n_words", STEPS),
    "capitals": ("n_capitals", "word_chars", STEPS),
    "word_length": ("word_chars", "n_words", tuple(range(6000, 30000, 2000))),
}


def features(docs: DataFrame, *carry: str) -> DataFrame:
    """Figures of each whole text: doc_id, stratum, counts, and the columns in ``carry`` (as ``carried``).

    A null or empty text has counts of 0, a null lang is a stratum of its own name ''. A text of any length is
    one row's arrays in one task. Every row gives one row, repeated rows and null ids too; an empty table none;
    other columns are ignored.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("stratum"),
        F.struct(*carry).alias("carried") if carry else F.lit(None).cast("int").alias("carried"),
        text.alias("body"),
    )
    # Each step is a projection of its own: the next one refers to its array more than once, which
    # keeps the optimiser from evaluating it anew for every element.
    rows = rows.withColumn("words", F.array_remove(F.split("body", SPACE), ""))
    rows = rows.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))
    n = F.size("hashes")
    rows = rows.withColumn(
        "runs",
        F.when(
            n >= RUN,
            F.transform(
                F.sequence(F.lit(0), n - RUN),
                lambda i: F.xxhash64(*(F.col("hashes")[i + j] for j in range(RUN))),
            ),
        ).otherwise(F.array().cast("array<long>")),
    )
    # only texts with a repeated run sort theirs
    rows = rows.withColumn(
        "sorted",
        F.when(
            F.size(F.array_distinct("runs")) < F.size("runs"),
            F.array_sort(F.transform("runs", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ).otherwise(F.array().cast("array<struct<h:long,i:int>>")),
    )
    last = F.size("sorted") - 1
    repeated = F.filter(
        "sorted",
        lambda x, i: ((i > 0) & (F.col("sorted")[F.greatest(i - 1, F.lit(0))]["h"] == x["h"]))
        | ((i < last) & (F.col("sorted")[F.least(i + 1, last)]["h"] == x["h"])),
    )
    starts = F.array_sort(F.transform(repeated, lambda x: x["i"]))
    under = F.aggregate(
        starts,
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto")),
        lambda a, s: F.struct(
            (a["n"] + s + RUN - F.greatest(a["upto"], s)).alias("n"), (s + RUN).alias("upto")
        ),
    )["n"]
    rows = rows.withColumn(
        "lines", F.filter(F.split("body", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    )
    n_words = F.size("words").cast("long")
    n_repeat = under.cast("long")
    # Handed on by a generator, below which no later filter is pushed: it would take the steps
    # above apart and compute an array anew for each element of another.
    counted = F.struct(
        "doc_id",
        "stratum",
        "carried",
        n_words.alias("n_words"),
        F.length(F.regexp_replace("body", SPACE, "")).cast("long").alias("word_chars"),
        F.regexp_count("body", F.lit(SYMBOL)).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        n_repeat.alias("n_repeat_words"),
        F.regexp_count("body", F.lit("[A-Z]")).cast("long").alias("n_capitals"),
        F.size("lines").cast("long").alias("n_lines"),
    )
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return rows.select(F.inline(F.array(counted))).withColumn("base_failed", failed)


def figure(rule: str) -> Column:
    """Per-mille figure of a rule, a whole number; 0 where there is nothing to divide by."""
    over, under, _ = RULES[rule]
    share = F.floor(F.lit(1000) * F.col(over) / F.col(under))
    return F.when(F.col(under) > 0, share).otherwise(F.lit(0)).cast("long")


def log_gamma(x: Column) -> Column:
    """ln of the gamma function for x >= 1 (Stirling's series, ten steps further up)."""
    y = x + 10
    rise = sum((F.log(x + i) for i in range(1, 10)), F.log(x))
    tail = 1 / (12 * y) - 1 / (360 * F.pow(y, 3)) + 1 / (1260 * F.pow(y, 5))
    return (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + tail - rise


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(at most ``k`` of ``n``) at rate ``p``, exact; 1 if ``k`` reaches the mean.

    Summed downwards from ``k``, where terms shrink; those past twenty standard deviations are
    below the precision of a double.
    """
    reach = F.least(k, F.ceil(20 * F.sqrt(n * p) + 40)).cast("int")
    top = (
        log_gamma(n + 1.0) - log_gamma(k + 1.0) - log_gamma(n - k + 1.0)
        + k * math.log(p) + (n - k) * math.log1p(-p)
    )
    ratio = (1 - p) / p
    total = F.aggregate(
        F.sequence(F.lit(0), reach),
        F.struct(F.lit(1.0).alias("t"), F.lit(0.0).alias("s")),
        lambda a, j: F.struct(
            (a["t"] * ((k - j) * ratio / (n - k + j + 1))).alias("t"), (a["s"] + a["t"]).alias("s")
        ),
    )["s"]
    return F.when(k >= n * p, F.lit(1.0)).otherwise(F.exp(top) * total)


def holdout(figures: DataFrame, labels: DataFrame) -> DataFrame:
    """(stratum, rule, cutoff, n, k, bad): what every cutoff would reject of the labelled rows.

    A document is bad if any label of its id says so. Rows that fail the base rules take no part.
    """
    marks = (
        labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.min("quality").cast("int").alias("good"))
    )
    own = figures.where(~F.col("base_failed")).join(marks, "doc_id")
    values = [F.struct(F.lit(r).alias("rule"), figure(r).alias("value")) for r in RULES]
    rows = own.select("stratum", "good", F.explode(F.array(*values)).alias("v")).select(
        "stratum", "good", "v.rule", "v.value"
    )
    # all rules have the same number of cutoffs; the i-th one of each is counted in one column
    steps = len(STEPS)
    tried = F.create_map(
        *(x for r, (_, _, cuts) in RULES.items() for x in (F.lit(r), F.array(*map(F.lit, cuts))))
    )
    rows = rows.withColumn("cuts", tried[F.col("rule")])
    good = F.col("good") == 1
    counts = rows.groupBy("stratum", "rule").agg(
        F.count_if(good).alias("n"),
        F.first("cuts").alias("cuts"),
        *(F.count_if(good & (F.col("value") > F.col("cuts")[i])).alias(f"k{i}") for i in range(steps)),
        *(F.count_if(~good & (F.col("value") > F.col("cuts")[i])).alias(f"b{i}") for i in range(steps)),
    )
    each = [
        F.struct(
            F.col("cuts")[i].alias("cutoff"), F.col(f"k{i}").alias("k"), F.col(f"b{i}").alias("bad")
        )
        for i in range(steps)
    ]
    return counts.select("stratum", "rule", "n", F.inline(F.array(*each)))


def cutoffs(
    figures: DataFrame, labels: DataFrame, alpha: float = 0.05, delta: float = 0.05
) -> DataFrame:
    """One row per labelled stratum: the cutoff in use for each rule, or null.

    With probability ``1 - delta`` the rules together reject at most ``alpha`` of the good documents
    of every stratum; each rule gets an equal part of ``alpha``.
    """
    tests = holdout(figures, labels)
    everyone = Window.partitionBy(F.lit(1))
    # as many tests as rows; the table has a few per stratum
    level = F.lit(delta) / F.count("*").over(everyone)
    part = alpha / len(RULES)
    judged = tests.withColumn("level", level).withColumn(
        "chance", binomial_tail(F.col("k").cast("double"), F.col("n").cast("double"), part)
    )
    judged = judged.withColumn("gain", F.col("bad") - PRICE * F.col("k"))
    valid = judged.where((F.col("chance") <= F.col("level")) & (F.col("gain") > 0))
    best = valid.groupBy("stratum", "rule").agg(
        F.max(F.struct("gain", "cutoff"))["cutoff"].cast("long").alias("cutoff")
    )
    columns = [F.max(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"cut_{r}") for r in RULES]
    return best.groupBy("stratum").agg(*columns)


def verdicts(figures: DataFrame, learnt: DataFrame) -> DataFrame:
    """``figures`` with ``kept``: neither the base rules nor a cutoff in use rejects the row.

    A stratum without cutoffs is judged by the base rules alone.
    """
    salted = figures.withColumn(
        "salt", F.pmod(F.xxhash64("doc_id", "n_words", "word_chars"), F.lit(SALTS)).cast("int")
    )
    copies = learnt.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    over = F.lit(False)
    for rule in RULES:
        over = over | F.coalesce(figure(rule) > F.col(f"cut_{rule}"), F.lit(False))
    return salted.join(copies, ["stratum", "salt"], "left").withColumn(
        "kept", ~F.col("base_failed") & ~over
    )
