"""Quality classifier with hierarchical empirical Bayes over sites.

A logistic regression on surface features gives each document's evidence. Its
probabilities are averaged over hosts and over paths within hosts by grouped
aggregation, and every average is shrunk: a host's toward the global mean, a
path's toward its host, each as if it had `strength` more documents, where the
strength comes from how much the averages vary beyond chance (method of
moments). The document's final odds are its own odds times how far its path's
posterior departs from the global mean, its own share taken out.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import WORD, clear, tables, without, written

SYMBOLS = "#*$%&|<>"
FEATURES = ("log_words", "symbol_share", "bang_share", "pipe_share", "upper_share", "digit_share", "repeat_share", "line_share", "long_words")


def features(text: Column) -> dict[str, Column]:
    """Surface features of a whole text, all finite; null is empty."""
    text = F.coalesce(text, F.lit(""))
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    lines = F.filter(F.split(text, "\n"), lambda x: F.rlike(x, F.lit(WORD)))
    removed = lambda chars: (F.length(text) - F.length(F.translate(text, chars, ""))).cast("double")
    n, chars = F.greatest(F.size(words), F.lit(1)), F.greatest(F.length(text), F.lit(1))
    return {
        "log_words": F.log1p(F.size(words).cast("double")), "symbol_share": removed(SYMBOLS) / n, "bang_share": removed("!?") / n, "pipe_share": removed("|") / n,
        "upper_share": F.regexp_count(text, F.lit(r"\p{Lu}")) / chars, "digit_share": removed("0123456789") / chars,
        "repeat_share": 1 - F.size(F.array_distinct(words)) / n,
        "line_share": 1 - F.size(F.array_distinct(lines)) / F.greatest(F.size(lines), F.lit(1)),
        "long_words": F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]{25,}")) / n,
    }


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 30) -> tuple[np.ndarray, float]:
    """Logistic regression by Newton's method; weights of the raw features and the intercept."""
    mean, scale = x.mean(0), x.std(0)
    scale = np.where(scale > 1e-12, scale, 1.0)
    z = np.hstack([(x - mean) / scale, np.ones((len(x), 1))])
    w, penalty = np.zeros(z.shape[1]), np.r_[np.full(x.shape[1], ridge), 1e-6]
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = (z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty)
        step = np.linalg.solve(h, z.T @ (y - p) - penalty * w)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    raw = w[:-1] / scale
    return raw, float(w[-1] - raw @ mean)


def expand(x: np.ndarray) -> np.ndarray:
    """The features and, for the bounded ones, whether they are above a low level: junk shows by kind rather than by degree."""
    return np.hstack([x, np.sqrt(np.abs(x[:, 1:]))])


def _terms() -> list[Column]:
    own = [F.col(f) for f in FEATURES]
    return own + [F.sqrt(F.abs(c)) for c in own[1:]]


def _moments(table: DataFrame, prior: Column) -> float:
    """Strength of the prior for groups with columns n, good (sum of probabilities), square (sum of their squares).

    Between-group variance of the means beyond what their documents' spread
    explains; the strength is within-document variance over that.
    """
    many = F.col("n") > 1
    within = (F.col("square") - F.col("good") * F.col("good") / F.col("n")) / (F.col("n") - 1)
    mean = F.col("good") / F.col("n")
    r = table.where(many).select(F.col("n"), within.alias("v"), (mean - prior).alias("d")).agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("v")).alias("v"), F.sum(F.col("n") * F.col("d") * F.col("d") - F.col("v")).alias("b"),
    ).first()
    if not r["n"] or r["b"] is None:
        return 10.0
    between, spread = r["b"] / r["n"], r["v"] / r["n"]
    return float(min(1e6, max(1.0, spread / between))) if between > 1e-12 else 1e6


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang", label_col: str = "quality", sample: int = 20_000, reject_below: float = 0.5, weight: float = 1.0, tag: bool = False) -> DataFrame:
    """One row per input row: id, document_score, host_posterior, path_posterior, score, kept; with `tag` also host, path and text_key (xxhash64 of the text).

    document_score is the classifier's probability of good quality, score the
    one after the sites' evidence; kept is score >= reject_below. Null and empty
    texts are scored by their features (no words). Null hosts and paths are
    groups of their own; null ids are scored but never labelled. Repeated rows
    each count; a score of exactly reject_below is kept. Whole texts are read,
    very long ones too; columns of the input may have any names. Without labelled
    rows of both classes everything scores 1 and is kept. An empty table stays
    empty.

    sample: most labelled rows that the classifier is fitted on, those with the
    least hash of their id; site statistics use all documents. Rows above a
    hash that leaves a little more than `sample` of them are cut off where they
    lie, so that about as many rows and no more go to the driver. weight: of the
    sites' log odds.
    """
    cols = features(F.col(text_col))
    base = docs.select(F.col(id_col).alias("id"), F.col(host_col).alias("host"), F.col(path_col).alias("path"), *[c.cast("double").alias(k) for k, c in cols.items()], *([F.xxhash64(text_col).alias("text_key")] if tag else []))
    base = written(base, "quality-features")
    known = labels.where(F.col(label_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("y"))
    train = training_rows(known.join(base.select("id", *FEATURES), "id"), sample).toPandas()
    if train["y"].nunique() == 2:
        w, b = fit(expand(train[list(FEATURES)].to_numpy(float)), train["y"].to_numpy(float))
        z = F.lit(b)
        for k, c in zip(w.tolist(), _terms(), strict=True):
            z = z + F.lit(k) * c
        p = 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z))))
    else:
        p = F.lit(1.0)
    scored = base.select("id", "host", "path", p.alias("p"), *(["text_key"] if tag else []))
    paths = scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p").alias("good"), F.sum(F.col("p") * F.col("p")).alias("square"))
    paths = written(paths, "quality-paths")
    hosts = paths.groupBy("host").agg(*[F.sum(c).alias(c) for c in ("n", "good", "square")])
    total = hosts.agg(F.sum("n").alias("n"), F.sum("good").alias("good")).first()
    mean = min(1 - 1e-6, max(1e-6, total["good"] / total["n"])) if total["n"] else 0.5
    k_host = _moments(hosts, F.lit(mean))
    shrunk = hosts.select("host", F.col("n").alias("host_n"), F.col("good").alias("host_good"), ((F.col("good") + k_host * mean) / (F.col("n") + k_host)).alias("host_posterior"))
    sites = paths.join(shrunk, paths["host"].eqNullSafe(shrunk["host"])).drop(shrunk["host"])
    k_path = _moments(sites, F.col("host_posterior"))
    sites = written(sites.select(F.col("host").alias("h"), F.col("path").alias("q"), "n", "good", "host_n", "host_good", "host_posterior", ((F.col("good") + k_path * F.col("host_posterior")) / (F.col("n") + k_path)).alias("path_posterior")), "quality-sites")
    joined = scored.join(sites, scored["host"].eqNullSafe(sites["h"]) & scored["path"].eqNullSafe(sites["q"]))
    logit = lambda x: F.log(x) - F.log(1 - x)
    clip = lambda x: F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), x))
    # what the other documents of the site say
    other_host = (F.col("host_good") - F.col("p") + k_host * mean) / (F.col("host_n") - 1 + k_host)
    other = (F.col("good") - F.col("p") + k_path * other_host) / (F.col("n") - 1 + k_path)
    z = logit(clip(F.col("p"))) + weight * (logit(clip(other)) - float(np.log(mean / (1 - mean))))
    score = F.round(1 / (1 + F.exp(-z)), 9)
    return joined.select(
        F.col("id").alias(id_col), F.round("p", 9).alias("document_score"), F.round("host_posterior", 9).alias("host_posterior"), F.round("path_posterior", 9).alias("path_posterior"),
        score.alias("score"), (score >= reject_below).alias("kept"), *(["host", "path", "text_key"] if tag else []),
    )


def training_rows(rows: DataFrame, sample: int) -> DataFrame:
    """The `sample` rows (id, y, features) with the least hash of their id.

    Their number is known from one count, so a bound on the hash leaves
    `sample` rows and six standard deviations more; what is ordered, on each
    executor and on the driver, is those only.
    """
    n = rows.count()
    share = (sample + 6 * sample**0.5) / n if n else 1.0
    key = F.xxhash64("id", F.lit(11))
    some = rows if share >= 1 else rows.where(key <= int((2 * share - 1) * 2.0**63))
    return some.orderBy(key, "id", "y", *FEATURES).limit(sample)


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang", **options) -> DataFrame:
    """The rows of `docs` that the classifier keeps, with all columns; cases are as in `classify`.

    Texts are not carried through the classification: the rejected rows' id,
    text hash, host and path are, and rows alike in these have the same score.
    Texts of rows that stay are not dealt either, but for those that meet a
    rejected one's mark by chance.
    """
    others = tables(docs.sparkSession)
    scored = classify(docs, labels, id_col, text_col, host_col, path_col, tag=True, **options)
    gone = scored.where("not kept").select(F.col(id_col).alias("__id"), F.col("text_key").alias("__key"), F.col("host").alias("__host"), F.col("path").alias("__path")).distinct()
    gone = written(gone, "quality-rejected")
    clear(docs.sparkSession, keep=others | {gone._scratch})
    same = F.col(f"d.{id_col}").eqNullSafe(F.col("g.__id")) & (F.xxhash64(f"d.{text_col}") == F.col("g.__key")) & F.col(f"d.{host_col}").eqNullSafe(F.col("g.__host")) & F.col(f"d.{path_col}").eqNullSafe(F.col("g.__path"))
    return without(docs, gone, same, F.xxhash64(f"d.{text_col}"), F.col("g.__key"))
