"""URL filters: rules by host and path, and for the other urls word segmentation with naive Bayes.

A host's labels are split into words by the most probable sequence under a
unigram model (Viterbi), whose counts come from the words of all pages and of
their urls. The words of host and path are scored by multinomial naive Bayes, and
a url is blocked where the posterior is at least `threshold`.

Naive Bayes is trained on labelled host names, which are segmented like others:
compositions of a qualifier and a topic, of which some qualifiers go with both
classes. One round of expectation maximisation then adds the urls of the corpus:
the words of each count for either class by its posterior, summed over all urls
by grouped aggregation and weighed, in either class, as much as its labelled
names together. So words that keep company with unwanted ones become evidence,
and words that stand in all urls are none.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import LOWER, UPPER, dropped, written

# Topics and qualifiers of unwanted and of ordinary host names, which labelled names are composed of.
UNWANTED = (
    "adult", "ads", "adserver", "bet", "bets", "betting", "bingo", "bonus", "casino", "cialis", "clicks", "cracks", "dating", "escorts", "gambling", "hookup", "jackpot", "keygen", "loan", "loans", "lottery", "malware", "nude",
    "payday", "pharma", "pills", "poker", "popunder", "porn", "replica", "roulette", "scam", "sex", "slots", "spam", "spins", "sportsbook", "torrents", "tracking", "viagra", "warez", "xxx",
)
UNWANTED_QUALIFIERS = ("best", "big", "cheap", "easy", "farm", "fast", "free", "hot", "instant", "link", "live", "lucky", "mega", "my", "online", "super", "top", "track", "win", "x")
ORDINARY = (
    "academy", "archive", "art", "bank", "biology", "books", "bridge", "care", "chemistry", "church", "city", "clinic", "college", "cooking", "culture", "design", "dictionary", "farm", "football", "forum", "garden", "guide", "health", "history",
    "journal", "law", "library", "magazine", "maps", "market", "medicine", "museum", "music", "news", "parts", "photo", "physics", "press", "radio", "recipes", "research", "school", "science", "sport", "statistics", "store", "theatre",
    "tools", "track", "travel", "university", "weather", "wiki", "writing",
)
ORDINARY_QUALIFIERS = ("best", "big", "city", "daily", "first", "free", "great", "green", "home", "live", "local", "my", "national", "new", "north", "old", "online", "open", "our", "public", "the", "top", "world", "young")
#: Rules (host and path, verdict); a rule fits its host and all subdomains where the path starts with the rule's.
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
TOKEN = re.compile(r"[a-z]+|[0-9]+")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to /, ?, # or the end, A-Z lower-cased; path: from there up to ? or #. Both empty where there is no ://, or for null."""
    part = lambda k: F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", k), F.lit(""))
    return F.translate(part(1), UPPER, LOWER), part(2)


@dataclass
class Segmenter:
    """Splits a concatenated name into its most probable words under unigram counts."""

    counts: dict[str, float]
    longest: int = 20
    memory: dict[str, tuple[str, ...]] = field(default_factory=dict)

    def __post_init__(self):
        self.total = sum(self.counts.values()) + 1.0

    def cost(self, word: str) -> float:
        """Negative log probability; unknown strings get less likely tenfold with each letter."""
        if n := self.counts.get(word):
            return math.log(self.total / n)
        return math.log(self.total) + len(word) * math.log(10.0)

    def split(self, name: str) -> tuple[str, ...]:
        """Viterbi over the positions of `name`; the empty name has no words. Neighbouring unknown letters stay one word."""
        if name in self.memory:
            return self.memory[name]
        best, back = [0.0] + [math.inf] * len(name), [0] * (len(name) + 1)
        for i in range(1, len(name) + 1):
            for j in range(0 if i <= self.longest else i - self.longest, i):
                c = best[j] + self.cost(name[j:i])
                if c < best[i]:
                    best[i], back[i] = c, j
        words, i = [], len(name)
        while i:
            words.append(name[back[i] : i])
            i = back[i]
        if len(self.memory) > 100_000:
            self.memory.clear()
        self.memory[name] = out = tuple(reversed(words))
        return out


@dataclass
class NaiveBayes:
    """Multinomial naive Bayes over words, add-one smoothed; words it was not trained on say nothing."""

    log_odds: dict[str, float]
    prior: float

    @classmethod
    def of_counts(cls, bad: dict[str, float], good: dict[str, float], unwanted_share: float) -> NaiveBayes:
        """bad, good: (weighted) counts of words in unwanted and ordinary urls. unwanted_share: of urls in the wild."""
        vocabulary = bad.keys() | good.keys()
        nb, ng = sum(bad.values()) + len(vocabulary), sum(good.values()) + len(vocabulary)
        return cls({w: math.log((bad.get(w, 0) + 1) / nb) - math.log((good.get(w, 0) + 1) / ng) for w in vocabulary}, math.log(unwanted_share / (1 - unwanted_share)))

    @classmethod
    def train(cls, examples: list[tuple[list[str], bool]], unwanted_share: float = 0.25) -> NaiveBayes:
        """examples: words of a url and whether it is unwanted."""
        return cls.of_counts(*word_counts(examples), unwanted_share)

    def score(self, words: list[str]) -> float:
        """Posterior probability of unwanted."""
        z = self.prior + sum(self.log_odds.get(w, 0.0) for w in words)
        return 1 / (1 + math.exp(-max(-700.0, min(700.0, z))))


def word_counts(examples: list[tuple[list[str], bool]]) -> tuple[Counter, Counter]:
    """Counts of words in unwanted and in ordinary examples."""
    bad, good = Counter(), Counter()
    for words, unwanted in examples:
        (bad if unwanted else good).update(words)
    return bad, good


def labelled_hosts() -> list[tuple[str, bool]]:
    """Names of hosts and whether they are unwanted: each topic alone, behind two qualifiers, and before another topic, run together."""
    out = []
    for topics, qualifiers, bad in ((UNWANTED, UNWANTED_QUALIFIERS, True), (ORDINARY, ORDINARY_QUALIFIERS, False)):
        for k, t in enumerate(topics):
            out += [(t, bad), (qualifiers[k % len(qualifiers)] + t, bad), (qualifiers[(7 * k + 3) % len(qualifiers)] + t, bad), (t + topics[(5 * k + 2) % len(topics)], bad)]
    return out


def unigrams(pages: DataFrame, known: tuple[str, ...], url_col: str = "url", html_col: str = "html", least_share: float = 2e-6, known_share: float = 1e-5) -> dict[str, float]:
    """Counts of the words (two letters a-z or more) of all pages' texts and urls' paths.

    Hosts, and host names within texts, are not counted: they are what is to be
    split. Words of under two occurrences or under least_share of them are left out, so
    at most 1 / least_share rows go to the driver. `known` words count as
    known_share at least. Without a column html_col the urls alone are counted.
    """
    parts = [host_and_path(F.col(url_col))[1]]
    if html_col in pages.columns:
        parts.append(F.regexp_replace(F.coalesce(F.col(html_col), F.lit("")), r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", " "))
    words = pages.select(F.explode(F.regexp_extract_all(F.lower(F.concat_ws(" ", *parts)), F.lit(r"(?<![a-z]|[a-z0-9-]\.)[a-z]{2,24}(?![a-z]|\.[a-z0-9])"), F.lit(0))).alias("word"))
    counts = written(words.groupBy("word").count(), "url-words")
    total = counts.agg(F.sum("count")).first()[0] or 0
    found = {r["word"]: float(r["count"]) for r in counts.where(F.col("count") >= max(2, math.ceil(total * least_share))).collect()}
    dropped(counts)
    least = max(1.0, total * known_share)
    return found | {w: max(found.get(w, 0.0), least) for w in known}


def corpus_counts(urls: DataFrame, segment: Segmenter, bayes: NaiveBayes, least_share: float) -> tuple[dict[str, float], dict[str, float], float]:
    """Words of all urls (host, path) weighed by the urls' posteriors: counts for unwanted and for ordinary ones, and the mean posterior.

    Words of under least_share of all are left out, so a bounded number of rows
    goes to the driver.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            bad, good = Counter(), Counter()
            for host, path in zip(pdf["host"], pdf["path"], strict=True):
                words = url_words(host, path, segment)
                p = bayes.score(words)
                bad[""] += p
                good[""] += 1 - p
                for w in words:
                    if w.isalpha():
                        bad[w] += p
                        good[w] += 1 - p
            yield pd.DataFrame([(w, bad[w], good[w]) for w in good.keys() | bad.keys()], columns=["word", "bad", "good"])

    # rounded, so that the order of summation shows in no verdict
    sums = urls.mapInPandas(run, "word string, bad double, good double").groupBy("word").agg(*[F.round(F.sum(c), 6).alias(c) for c in ("bad", "good")])
    sums = written(sums, "url-evidence")
    total = sums.where("word <> ''").agg(F.sum(F.col("bad") + F.col("good"))).first()[0] or 0.0
    rows = sums.where((F.col("bad") + F.col("good") >= max(2.0, total * least_share)) | (F.col("word") == "")).collect()
    dropped(sums)
    urls_ = next(((r["bad"], r["good"]) for r in rows if r["word"] == ""), (0.0, 0.0))
    words = [r for r in rows if r["word"]]
    return {r["word"]: r["bad"] for r in words}, {r["word"]: r["good"] for r in words}, urls_[0] / (sum(urls_) or 1.0)


def url_words(host: str, path: str, segment: Segmenter) -> list[str]:
    """Words of a host, each label segmented, and of a path, lower-cased."""
    return [w for t in TOKEN.findall(host) + TOKEN.findall(path.lower()) for w in segment.split(t)]


def fits(host: str, path: str, rules: dict[str, list[tuple[str, str, str]]]) -> tuple[str, str] | None:
    """The longest rule (host and path as one string; on equal lengths the longer host) that fits, and its verdict."""
    best, name = None, host
    while True:
        for prefix, rule, verdict in rules.get(name, ()):
            if path.startswith(prefix) and (best is None or len(rule) > len(best[0])):
                best = (rule, verdict)
        dot = name.find(".")
        if dot < 0:
            return best
        name = name[dot + 1 :]


def judge(pages: DataFrame, rules: tuple = RULES, threshold: float = 0.5, examples: list[tuple[str, bool]] | None = None, unwanted_share: float = 0.25, least_share: float = 2e-6, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per input row: id, host, path, rule (null where none fits), verdict, score (naive Bayes' posterior; null where a rule decides).

    Null urls and urls without :// have an empty host and path and are judged by
    their (missing) words alone, so they are allowed. Equal rows are judged
    alike, null ids are kept; of rules that fit alike the longer holds, then that
    with the longer host; a score of exactly the threshold blocks. Very long urls
    are read whole, other columns may have any names; an empty table gives an
    empty result.

    rules: (host and path, verdict), a bounded list; examples: (host name,
    unwanted) for the classifier; unwanted_share: of the urls, beforehand;
    least_share: see `unigrams`.
    """
    by_host: dict[str, list[tuple[str, str, str]]] = {}
    for rule, verdict in rules:
        cut = rule.index("/") if "/" in rule else len(rule)
        by_host.setdefault(rule[:cut], []).append((rule[cut:], rule, verdict))
    examples = examples or labelled_hosts()
    topics = tuple(dict.fromkeys([*UNWANTED, *UNWANTED_QUALIFIERS, *ORDINARY, *ORDINARY_QUALIFIERS]))
    segment = Segmenter(unigrams(pages, topics, url_col, html_col, least_share))
    bad, good = word_counts([(url_words(name, "", segment), unwanted) for name, unwanted in examples])
    host, path = host_and_path(F.col(url_col))
    more_bad, more_good, _ = corpus_counts(pages.select(host.alias("host"), path.alias("path")), segment, NaiveBayes.of_counts(bad, good, unwanted_share), least_share)
    # a corpus of fewer words than the labelled names weighs as much less
    part = min(1.0, (sum(more_bad.values()) + sum(more_good.values())) / (sum(bad.values()) + sum(good.values())))
    for own, more in ((bad, more_bad), (good, more_good)):
        scale = part * sum(own.values()) / (sum(more.values()) or 1.0)
        for w, n in more.items():
            own[w] += n * scale
    bayes = NaiveBayes.of_counts(bad, good, unwanted_share)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for host, path in zip(pdf["host"], pdf["path"], strict=True):
                if hit := fits(host, path, by_host):
                    out.append((hit[0], hit[1], None))
                else:
                    p = bayes.score(url_words(host, path, segment))
                    out.append((None, "block" if p >= threshold else "allow", p))
            pdf = pdf.reset_index(drop=True)
            pdf[["rule", "verdict", "score"]] = pd.DataFrame(out, columns=["rule", "verdict", "score"], dtype=object)
            yield pdf

    kind = pages.schema[id_col].dataType.simpleString()
    return pages.select(F.col(id_col), host.alias("host"), path.alias("path")).mapInPandas(run, f"`{id_col}` {kind}, host string, path string, rule string, verdict string, score double")
