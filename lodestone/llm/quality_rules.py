"""Quality rules with risk-controlled thresholds, all in DataFrame functions.

Each rule compares a document's measure with a cutoff. Cutoffs are chosen per
stratum (language) on labelled documents, along a path fixed beforehand: from
all rules at the loosest cutoff of their grids in equal steps to all at the
strictest. At each step the good documents that any rule would reject are
counted, and the exact binomial tail P(Bin(n, risk_total) <= k) is the p-value
of "this rejects risk_total of the good documents or more". Steps are nested,
so they are tested in order of the path (fixed-sequence testing) at a level of
error / (strata + 1), without a share of the error for each rule and cutoff; the
last step certified holds. With probability 1 - error no stratum with cutoffs of
its own loses more than risk_total of its good documents to these rules.

A stratum needs log(error / (strata + 1)) / log(1 - risk_total) good documents
before any step can be certified: 459 at the defaults and four strata. One with
fewer takes the cutoffs certified on all strata together, tested at the share of
the error left for that; their bound holds for all strata's documents together,
not for the small stratum by itself.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import written

_SPACE = " \t\n\x0b\x0c\r"
_HAS_WORD = r"[^\x20\x09-\x0D]"
#: Measures by rule, as a count over another; a document is rejected where its measure is above the cutoff.
RULES = {"symbols": ("n_symbols", "n_words"), "bangs": ("n_bangs", "n_words"), "lines": ("n_dup_lines", "n_lines"), "repeats": ("n_repeat_words", "n_words"), "length": ("word_chars", "n_words")}
#: Grid of cutoffs by rule.
GRID = {
    "symbols": [k / 20 for k in range(1, 31)], "bangs": [k / 20 for k in range(1, 31)], "lines": [k / 20 for k in range(1, 20)],
    "repeats": [k / 20 for k in range(1, 20)], "length": [float(k) for k in range(6, 31)],
}


#: Steps of the path, counted from 1, and the cutoffs of each.
STEPS = max(map(len, GRID.values()))
PATH = [{rule: sorted(cuts, reverse=True)[-(-step * len(cuts) // STEPS) - 1] for rule, cuts in GRID.items()} for step in range(1, STEPS + 1)]


def _let(value: Column, body) -> Column:
    """body(value) with `value` worked out once."""
    return F.transform(F.array(value), body)[0]


def _measure(rule: str) -> Column:
    part, whole = RULES[rule]
    return F.lit(1.0) * F.col(part) / F.greatest(F.col(whole), F.lit(1))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")


def repeated_words(words: Column, window: int = 8) -> Column:
    """Words that lie in windows of `window` words found twice or more, the first included.

    Windows are compared by a 64-bit hash. Texts without a repeated window stop
    after one pass; for the others, (hash, position) pairs are sorted, those
    with an equal neighbour kept, and the lengths that their windows newly cover
    summed in order of position.
    """

    def covered(hashes: Column) -> Column:
        pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def repeated(s: Column) -> Column:
            same = lambda x, i: (x["h"] == F.get(s, i - 1)["h"]) | (x["h"] == F.get(s, i + 1)["h"])
            return F.array_sort(F.transform(F.filter(s, lambda x, i: F.coalesce(same(x, i), F.lit(False))), lambda x: x["i"]))

        def total(at: Column) -> Column:
            return F.aggregate(F.transform(at, lambda x, i: F.least(F.lit(window), F.coalesce(F.get(at, i + 1) - x, F.lit(window)))), F.lit(0).cast("long"), lambda a, x: a + x)

        return _let(pairs, lambda s: _let(repeated(s), total))

    def of(ws: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(1), F.size(ws) - (window - 1)), lambda i: F.xxhash64(F.slice(ws, i, window)))
        some = _let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered(h)))
        return F.when(F.size(ws) > window, some).otherwise(F.lit(0).cast("long"))

    return _let(words, of)


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """id, stratum and the counts that the rules use, from whole texts."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    removed = lambda chars: (F.length(text) - F.length(F.translate(text, chars, ""))).cast("long")
    lines = F.filter(F.split(text, "\n"), lambda x: F.rlike(x, F.lit(_HAS_WORD)))
    words = words_of(text)
    pair = _let(words, lambda w: F.struct(F.size(w).cast("long").alias("n"), repeated_words(w).alias("r")))
    line = _let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("d")))
    counted = docs.select(
        F.col(id_col).alias("id"), F.col(stratum_col).alias("stratum"), (F.length(text) - removed(_SPACE)).cast("long").alias("word_chars"), removed("#*$%&|<>").alias("n_symbols"), removed("!?").alias("n_bangs"),
        pair.alias("pair"), line.alias("line"),
    )
    out = counted.select("id", "stratum", F.col("pair.n").alias("n_words"), "word_chars", "n_symbols", "n_bangs", F.col("line.n").alias("n_lines"), F.col("line.d").alias("n_dup_lines"), F.col("pair.r").alias("n_repeat_words"))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return out.withColumn("base_failed", failed)


def binomial_tail(n: Column, k: Column, p: float) -> Column:
    """P(Bin(n, p) <= k), exact: the last term from sums of logarithms, the others from its ratio to it; 1 where k >= n * p."""
    odds = (1 - p) / p
    log_choose = F.when(k > 0, F.aggregate(F.sequence(F.lit(1).cast("long"), k), F.lit(0.0), lambda a, i: a + F.log((n - k + i) / i))).otherwise(0.0)
    last = log_choose + k * F.log(F.lit(p)) + (n - k) * F.log(F.lit(1 - p))
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))

    def step(a: Column, j: Column) -> Column:
        term = a["term"] * (k - j + 1) / (n - k + j) * odds
        return F.struct(term.alias("term"), (a["sum"] + term).alias("sum"))

    total = F.when(k > 0, F.aggregate(F.sequence(F.lit(1).cast("long"), k), start, step, lambda a: a["sum"])).otherwise(1.0)
    return F.when(k >= n * p, F.lit(1.0)).otherwise(F.exp(last + F.log(total)))


def thresholds(measured: DataFrame, labels: DataFrame, risk_total: float = 0.01, error: float = 0.05, label_col: str = "quality", id_col: str = "doc_id") -> DataFrame:
    """Certified cutoffs: stratum, rule, cutoff, n (good documents), rejected (by any rule), p_value; those of the last certified step of the stratum, or of all strata for one with too few labels.

    Good documents that already fail the base rules take no part: the verdict
    does not concern them. The grid is fixed beforehand, so all labels serve as
    the holdout.
    """
    good = labels.where(F.col(label_col) == 1).select(F.col(id_col).alias("id")).distinct()
    held = measured.where(~F.col("base_failed")).join(good, "id", "left_semi")
    measure = held.select("stratum", *[_measure(r).alias(r) for r in RULES])
    counts = [F.struct(F.lit(k + 1).alias("step"), F.count_if(reduce(lambda a, b: a | b, [F.col(r) > cut for r, cut in cuts.items()])).alias("rejected")) for k, cuts in enumerate(PATH)]
    table = written(measure.groupBy("stratum").agg(F.count("*").alias("n"), F.array(*counts).alias("tests")), "rule-counts")
    level = error / (max(1, table.count()) + 1)
    least = math.ceil(math.log(level) / math.log(1 - risk_total))
    each = table.select("stratum", "n", F.inline("tests"))
    tail = binomial_tail(F.col("n"), F.col("rejected"), risk_total)
    last = F.max(F.struct("step", "n", "rejected", "p_value")).alias("x")
    own = each.withColumn("p_value", tail).where(F.col("p_value") <= level).groupBy("stratum").agg(last)
    pool = each.groupBy("step").agg(F.sum("n").alias("n"), F.sum("rejected").alias("rejected")).withColumn("p_value", tail).where(F.col("p_value") <= level).agg(last).where("x is not null")
    steps = own.unionByName(table.where(F.col("n") < least).select("stratum").crossJoin(pool))
    cutoffs = F.array(*[F.struct(F.lit(r).alias("rule"), F.get(F.array(*[F.lit(float(c[r])) for c in PATH]), F.col("x.step") - 1).alias("cutoff")) for r in RULES])
    return steps.select("stratum", F.col("x.n").alias("n"), F.col("x.rejected").alias("rejected"), F.col("x.p_value").alias("p_value"), F.inline(cutoffs)).select("stratum", "rule", "cutoff", "n", "rejected", "p_value")


def apply_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", **options) -> DataFrame:
    """One row per input row: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, failed_rules.

    kept is false where the base rules fail or a measure is above its stratum's
    certified cutoff; failed_rules names the latter. Strata with too few
    labels have the cutoffs of all strata together. Strata without a certified
    cutoff, unlabelled ones among them, reject by the base rules alone.
    Null and empty texts have no words and fail the base rules. Repeated rows
    are judged alike; an empty table stays empty.
    """
    measured = written(measures(docs, id_col, text_col, stratum_col), "rule-measures")
    cuts = thresholds(measured, labels, id_col=id_col, **options).select("stratum", "rule", "cutoff")
    wide = cuts.groupBy("stratum").agg(*[F.min(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"cut_{r}") for r in RULES])
    wide = written(wide, "rule-cutoffs").withColumnRenamed("stratum", "s")
    joined = measured.join(wide, measured["stratum"].eqNullSafe(wide["s"]), "left")
    above = {r: F.coalesce(_measure(r) > F.col(f"cut_{r}"), F.lit(False)) for r in RULES}
    bad = reduce(lambda a, b: a | b, above.values())
    return joined.select(
        F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~bad).alias("kept"),
        F.array_join(F.array_compact(F.array(*[F.when(a, F.lit(r)) for r, a in above.items()])), ",").alias("failed_rules"),
    )
