"""Quality rules with risk-controlled cutoffs, in DataFrame functions only.

`measure` counts what the rules need in every whole text. `calibrate` learns one cutoff for each rule and stratum
from labelled documents: cutoffs are tried from the loosest to the tightest, and each is certified only if the exact
binomial (Clopper-Pearson) bound on the share of good documents that it rejects is at most `risk / rules`, at level
`error / (rules * strata)`. Trying in a fixed order and stopping at the first failure needs no further correction
within a rule; the division by rules and strata is the Bonferroni correction for the rest. So with probability
`1 - error`, in no stratum do all rules together reject more than a share `risk` of good documents. Among certified
cutoffs the one with the best balance of bad against good labelled documents is taken, the loosest of equals.

Defined cases: null or empty text has no words (base_failed); a null stratum is a stratum of its own; a stratum with
too few labels to certify anything gets no cutoff and rejects nothing beyond the base rules; labels that are null or
that name no document are ignored; repeated labels count as often as they stand; repeated documents give a row each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import NOT_SPACE, SPACE, Shared

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: Rules, all "more is worse", as (name, numerator, denominator, tightest cutoff, loosest cutoff).
RULES = (
    ("symbols", "n_symbols", "word_chars", 0.01, 0.41),
    ("dup_lines", "n_dup_lines", "n_lines", 0.10, 0.90),
    ("repeats", "n_repeat_words", "n_words", 0.05, 0.30),
    ("long_words", "word_chars", "n_words", 6.0, 16.0),
)
STEPS = 40
RISK = 0.04
ERROR = 0.05
#: A good labelled document that is lost weighs as much as so many bad ones caught.
GOOD_WEIGHT = 20
#: Cutoffs are broadcast up to so many strata; beyond, they are joined on salted strata.
MOST_STRATA = 10_000
SALTS = 64

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def _let(value: Column, then) -> Column:
    """then(value), with value computed once."""
    return F.transform(F.array(value), then)[0]


def _repeat_words(words: Column) -> Column:
    """Words inside WINDOW-word windows that the text holds twice or more; windows are compared by 128 bits."""

    def windows(n: Column, a: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[F.get(a, i + k) for k in range(WINDOW)]))

    def covered(first: Column, second: Column) -> Column:
        rows = F.array_sort(F.zip_with(F.transform(first, lambda h, i: F.struct(h.alias("a"), i.alias("i"))), second, lambda x, h: F.struct(x["a"].alias("a"), h.alias("b"), x["i"].alias("i"))))

        def same(s: Column, x: Column, i: Column) -> Column:
            y = F.get(s, i)
            return F.coalesce((y["a"] == x["a"]) & (y["b"] == x["b"]), F.lit(False))

        twice = _let(rows, lambda s: F.filter(s, lambda x, i: same(s, x, i - 1) | same(s, x, i + 1)))
        at = F.array_sort(F.transform(twice, lambda x: x["i"]))
        start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))
        return F.aggregate(at, start, lambda acc, p: F.struct((acc["n"] + (p + WINDOW) - F.greatest(p, acc["end"])).alias("n"), (p + WINDOW).alias("end")), lambda acc: acc["n"])

    def of_hashes(a: Column) -> Column:
        def checked(first: Column) -> Column:
            second = _let(F.transform(words, lambda w: F.xxhash64(w, F.lit("second"))), lambda b: windows(F.size(a), b))
            return F.when(F.size(F.array_distinct(first)) < F.size(first), covered(first, second)).otherwise(F.lit(0).cast("long"))

        return F.when(F.size(a) > WINDOW, _let(windows(F.size(a), a), checked)).otherwise(F.lit(0).cast("long"))

    return _let(F.transform(words, lambda w: F.xxhash64(w)), of_hashes)


def measures(text: Column) -> Column:
    """A struct of MEASURES for one text."""
    text = F.coalesce(text, F.lit(""))

    def of_words(words: Column) -> Column:
        def of_lines(lines: Column) -> Column:
            n_words = F.size(words).cast("long")
            return F.struct(
                n_words.alias("n_words"),
                (F.length(text) - F.regexp_count(text, F.lit(SPACE))).cast("long").alias("word_chars"),
                F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
                (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
                _repeat_words(words).alias("n_repeat_words"),
                F.size(lines).cast("long").alias("n_lines"),
            )

        return _let(F.filter(F.split(text, "\n"), lambda line: line.rlike(NOT_SPACE)), of_lines)

    return _let(F.array_remove(F.split(text, SPACE + "+"), ""), of_words)


def measure(docs: DataFrame, text_col: str = "text", into: str = "_measures") -> DataFrame:
    """Adds one struct column of MEASURES; all other columns stay."""
    return docs.withColumn(into, measures(F.col(text_col)))


def base_failed(m: Column) -> Column:
    return (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > MAX_REPEAT_PERCENT * m["n_words"])


def _value(m: Column, rule: tuple) -> Column:
    return F.when(m[rule[2]] > 0, m[rule[1]] / m[rule[2]]).otherwise(F.lit(0.0))


def _cutoff(rule: tuple, step: Column) -> Column:
    """Step 0 is the loosest cutoff, STEPS the tightest."""
    return F.lit(rule[4]) - (rule[4] - rule[3]) / STEPS * step


def _log_cdf(k: Column, n: Column, p: float) -> Column:
    """log P(Binomial(n, p) <= k): the terms' logs, added up from j = 0."""
    odds = F.log(F.lit(p)) - F.log1p(F.lit(-p))
    first = n * F.log1p(F.lit(-p))

    def add(acc: Column, j: Column) -> Column:
        term = acc["term"] + F.log((n - j + 1) / j) + odds
        high, low = F.greatest(acc["total"], term), F.least(acc["total"], term)
        return F.struct(term.alias("term"), (high + F.log1p(F.exp(low - high))).alias("total"))

    js = F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>"))
    return F.aggregate(js, F.struct(first.alias("term"), first.alias("total")), add, lambda acc: acc["total"])


def calibrate(measured: DataFrame, labels: DataFrame, stratum: str = "lang", id_col: str = "doc_id", label_col: str = "quality", risk: float = RISK, error: float = ERROR, into: str = "_measures") -> DataFrame:
    """One row for each stratum and rule with a certified cutoff: stratum, rule, cutoff, n_good, lost_good, caught_bad.

    All labelled documents count, but for those that the base rules reject anyway.
    """
    m = F.col(into)
    docs = measured.filter(~base_failed(m)).select(F.col(id_col).alias("_id"), F.col(stratum).alias("_stratum"), m.alias("_m"))
    marks = labels.filter(F.col(label_col).isNotNull()).select(F.col(id_col).alias("_id"), (F.col(label_col) > 0).alias("_good"))
    # the first step at which a document is rejected, for every rule; STEPS + 1 if none rejects it
    steps = F.array(*[F.struct(F.lit(r[0]).alias("rule"), F.greatest(F.lit(0), F.when(_value(F.col("_m"), r) > r[3], F.floor((r[4] - _value(F.col("_m"), r)) / ((r[4] - r[3]) / STEPS)).cast("int") + 1).otherwise(STEPS + 1)).alias("step")) for r in RULES])
    counts = docs.join(marks, "_id").select("_stratum", "_good", F.explode(steps).alias("_s")).groupBy("_stratum", F.col("_s.rule").alias("rule"), F.col("_s.step").alias("step")).agg(F.count_if("_good").alias("good"), F.count_if(~F.col("_good")).alias("bad"))
    # from here on there are at most strata * rules * (STEPS + 2) rows
    grid = counts.groupBy("_stratum", "rule").agg(F.sum("good").alias("n_good")).withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(STEPS))))
    so_far = W.partitionBy("_stratum", "rule").orderBy("step").rowsBetween(W.unboundedPreceding, 0)
    table = grid.join(counts.select(F.col("_stratum").alias("_g"), F.col("rule").alias("_r"), F.col("step").alias("_n"), "good", "bad"), F.col("_stratum").eqNullSafe(F.col("_g")) & (F.col("rule") == F.col("_r")) & (F.col("step") == F.col("_n")), "left").drop("_g", "_r", "_n")
    table = table.withColumn("lost_good", F.coalesce(F.sum("good").over(so_far), F.lit(0))).withColumn("caught_bad", F.coalesce(F.sum("bad").over(so_far), F.lit(0)))
    strata = counts.agg(F.count_distinct(F.coalesce(F.col("_stratum").cast("string"), F.lit("\0null"))).alias("_strata"))
    level = F.log(F.lit(error / len(RULES)) / F.greatest(F.col("_strata"), F.lit(1)))
    table = table.join(F.broadcast(strata)).withColumn("_ok", _log_cdf(F.col("lost_good"), F.col("n_good"), risk / len(RULES)) <= level)
    certified = table.withColumn("_all", F.min("_ok").over(so_far)).filter("_all")
    gain = F.col("caught_bad") - GOOD_WEIGHT * F.col("lost_good")
    best = certified.filter(gain > 0).groupBy("_stratum", "rule").agg(F.max_by(F.struct("step", "n_good", "lost_good", "caught_bad"), F.struct(gain, -F.col("step"))).alias("b"))
    cutoff = F.coalesce(*[F.when(F.col("rule") == r[0], _cutoff(r, F.col("b.step"))) for r in RULES])
    return best.select(F.col("_stratum").alias("stratum"), "rule", cutoff.alias("cutoff"), "b.n_good", "b.lost_good", "b.caught_bad")


def judge(measured: DataFrame, cutoffs: DataFrame, stratum: str = "lang", into: str = "_measures") -> DataFrame:
    """Adds `_kept`: false if a base rule or a certified cutoff rejects the document."""
    wide = cutoffs.groupBy(F.col("stratum").alias("_cut")).agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("_cutoffs"))
    few = wide.limit(MOST_STRATA + 1).count() <= MOST_STRATA
    if few:
        joined = measured.join(F.broadcast(wide), F.col(stratum).eqNullSafe(F.col("_cut")), "left")
    else:
        salted = wide.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = measured.withColumn("_row_salt", F.floor(F.rand(7) * SALTS).cast("int")).join(salted, F.col(stratum).eqNullSafe(F.col("_cut")) & (F.col("_row_salt") == F.col("_salt")), "left").drop("_salt", "_row_salt")
    m = F.col(into)
    passes = ~base_failed(m)
    for rule in RULES:
        passes &= F.coalesce(_value(m, rule) <= F.try_element_at(F.col("_cutoffs"), F.lit(rule[0])), F.lit(True))
    return joined.withColumn("_kept", passes).drop("_cut", "_cutoffs")


def _judged(held: DataFrame, labels: DataFrame, label_col: str, risk: float, error: float) -> DataFrame:
    """held: id, stratum, text and whatever is to be kept. The measured table is written once to the shared folder, as both
    the calibration and the verdict read it."""
    shared = Shared(held.sparkSession, "quality")
    measured = shared.write(measure(held, "text").drop("text"), "measured")
    cutoffs = shared.write(calibrate(measured, labels, "stratum", "id", label_col, risk, error), "cutoffs")
    return judge(measured, cutoffs, "stratum")


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum: str = "lang", label_col: str = "quality", risk: float = RISK, error: float = ERROR) -> DataFrame:
    """id, stratum, `_measures` and `_kept` of every document."""
    held = docs.select(F.col(id_col).alias("id"), F.col(stratum).alias("stratum"), F.col(text_col).alias("text"))
    found = _judged(held, labels.select(F.col(id_col).alias("id"), label_col), label_col, risk, error)
    return found.select(F.col("id").alias(id_col), F.col("stratum").alias(stratum), "_measures", "_kept")


def passed(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum: str = "lang", label_col: str = "quality", risk: float = RISK, error: float = ERROR) -> DataFrame:
    """The documents that are kept, with all their columns, whatever their names."""
    held = docs.select(F.col(id_col).alias("id"), F.col(stratum).alias("stratum"), F.col(text_col).alias("text"), F.struct(*docs.columns).alias("doc"))
    return _judged(held, labels.select(F.col(id_col).alias("id"), label_col), label_col, risk, error).filter("_kept").select("doc.*")
