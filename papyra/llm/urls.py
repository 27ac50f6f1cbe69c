"""URL filters: host and path rules, and gradient-boosted trees for the rest.

Native: DataFrame functions only.  Urls that a rule decides are the labelled
ones.  Their lexical features (length, depth, digit ratio, entropy, parameter
counts, suffix statistics) and label train boosted trees on the driver, on at most ``sample``
of them (smallest hash); there a url's suffix statistics leave out its own label.  The trees become one expression, so judging is a single pass over the
urls without a shuffle.  Suffix statistics are the smoothed log odds of a block
by hashed host suffix, counted over all labelled urls, in a fixed number of bins.

Cases.  Null urls and urls without ``://`` have an empty host and path, fit no
rule and are judged by the trees like any other.  Without labelled urls, or with one verdict only
among them, the trees are empty: what no rule decides gets the usual verdict, ``allow`` if there is none.
Very long urls are judged whole.  Repeated rows are judged each.  Columns other than those named are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyra.llm.common import lower_ascii, picked

#: (rule, verdict) in the order of the contract.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
SAMPLE = 20_000
BINS = 512
FEATURES = ("length", "depth", "digits", "entropy", "params", "labels", "hyphens", "path_length", "suffix1", "suffix2")


def parts(url: Column) -> tuple[Column, Column]:
    """host and path of a url."""
    has = F.instr(url, "://")
    rest = F.when(has > 0, F.expr("substring(_url, _at + 3)"))
    return (
        F.coalesce(lower_ascii(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.lit("")),
        F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit("")),
    )


def split_urls(pages: DataFrame, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """page_id, _url, host, path."""
    base = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("_url"), F.instr(F.col(url), "://").alias("_at"))
    host, path = parts(F.col("_url"))
    return base.select("page_id", "_url", host.alias("host"), path.alias("path"))


def fitting_rule(rules: tuple[tuple[str, str], ...] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits host and path, and its verdict; both null if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, what in sorted(rules, key=lambda r: (len(r[0]), r[0])):  # the longest is tried first
        at = text.index("/")
        name, start = text[:at], text[at:]
        fits = ((F.col("host") == name) | F.col("host").endswith("." + name)) & F.col("path").startswith(start)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def _suffix(labels: int) -> Column:
    return F.substring_index(F.col("host"), ".", -labels)


def _bin(labels: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(labels), _suffix(labels)), F.lit(BINS)).cast("int")


def lexical(urls: DataFrame) -> DataFrame:
    """The features of urls but for the suffix statistics, and the bins of these."""
    u = F.coalesce(F.col("_url"), F.lit(""))
    n = F.length(u)
    some = F.greatest(n, F.lit(1)).cast("double")
    chars = F.filter(F.array_distinct(F.split(u, "")), lambda c: c != "")
    often = F.transform(chars, lambda c: (n - F.length(F.replace(u, c, F.lit("")))).cast("double"))
    bits = F.aggregate(often, F.lit(0.0), lambda a, k: a + k * F.log2(k))
    query = F.when(F.instr(u, "?") > 0, F.substring_index(u, "?", -1)).otherwise(F.lit(""))
    count = lambda c, x: (F.length(c) - F.length(F.replace(c, F.lit(x), F.lit("")))).cast("double")
    return urls.select(
        "*",
        n.cast("double").alias("length"),
        count(F.col("path"), "/").alias("depth"),
        (F.length(F.regexp_replace(u, "[^0-9]", "")) / some).alias("digits"),
        (F.log2(some) - bits / some).alias("entropy"),
        count(query, "=").alias("params"),
        count(F.col("host"), ".").alias("labels"),
        count(F.col("host"), "-").alias("hyphens"),
        F.length("path").cast("double").alias("path_length"),
        _bin(1).alias("bin1"),
        _bin(2).alias("bin2"),
    )


@dataclass
class Tree:
    """A split (feature number, threshold: at most it goes left) or, without a feature, a leaf."""

    feature: int = -1
    threshold: float = 0.0
    left: Tree | None = None
    right: Tree | None = None
    value: float = 0.0

    def column(self) -> Column:
        if self.feature < 0:
            return F.lit(float(self.value))
        return F.when(F.col(FEATURES[self.feature]) <= self.threshold, self.left.column()).otherwise(self.right.column())

    def of(self, row: list[float]) -> float:
        if self.feature < 0:
            return self.value
        return (self.left if row[self.feature] <= self.threshold else self.right).of(row)


@dataclass
class Boosted:
    base: float
    trees: list[Tree] = field(default_factory=list)

    def column(self) -> Column:
        """Log odds of a block."""
        total = F.lit(float(self.base))
        for t in self.trees:
            total = total + t.column()
        return total

    def of(self, row: list[float]) -> float:
        return self.base + sum(t.of(row) for t in self.trees)


def boost(rows: list[list[float]], labels: list[int], *, trees: int = 20, depth: int = 3, rate: float = 0.3, bins: int = 16, l2: float = 1.0) -> Boosted:
    """Newton boosting of the log loss with histogram splits; deterministic."""
    x, y = np.array(rows, float), np.array(labels, float)
    n, pos = len(y), y.sum()
    base = math.log((pos + 0.5) / (n - pos + 0.5)) if n else -1.0
    model = Boosted(base)
    if not n or pos in (0, n):
        return model
    cuts, binned = [], []
    for col in x.T:
        values = np.unique(col)
        if len(values) > bins:
            values = np.unique(np.sort(col)[[k * n // bins for k in range(1, bins)]])
        cuts.append(values)
        binned.append(np.searchsorted(values, col))
    score = np.full(n, base)

    def grow(members: np.ndarray, g: np.ndarray, h: np.ndarray, left: int) -> Tree:
        gs, hs = g[members].sum(), h[members].sum()
        best, leaf = (1e-6, -1, 0), Tree(value=float(-rate * gs / (hs + l2)))
        if not left or len(members) < 2:
            return leaf
        for j, b in enumerate(binned):
            lg, lh = (np.cumsum(np.bincount(b[members], v[members], len(cuts[j]) + 1))[:-1] for v in (g, h))
            gain = lg**2 / (lh + l2) + (gs - lg) ** 2 / (hs - lh + l2) - gs * gs / (hs + l2)
            gain[(lh < 1e-3) | (hs - lh < 1e-3)] = -1
            k = int(gain.argmax())
            if gain[k] > best[0] + 1e-12:
                best = (gain[k], j, k)
        if best[1] < 0:
            return leaf
        _, j, k = best
        low = binned[j][members] <= k
        return Tree(j, float(cuts[j][k]), grow(members[low], g, h, left - 1), grow(members[~low], g, h, left - 1))

    for _ in range(trees):
        q = 1 / (1 + np.exp(-score))
        t = grow(np.arange(n), q - y, q * (1 - q), depth)
        model.trees.append(t)
        score += np.array([t.of(r) for r in rows])
    return model


def _with_suffix(feats: DataFrame, stats: list[list[float]]) -> DataFrame:
    at = [F.element_at(F.array(*map(F.lit, s)), F.col(f"bin{k}") + 1) for k, s in enumerate(stats, 1)]
    return feats.select("*", at[0].alias("suffix1"), at[1].alias("suffix2"))


def suffix_odds(blocked: int, urls: int, own: int | None = None) -> float:
    """Smoothed log odds of a block among the labelled urls of a suffix, for a url to learn from without its own label."""
    if own is not None:
        blocked, urls = blocked - own, urls - 1
    return math.log((blocked + 1) / (urls - blocked + 1))


def judge_urls(pages: DataFrame, *, rules: tuple[tuple[str, str], ...] = RULES, page_id: str = "page_id", url: str = "url", sample: int = SAMPLE) -> DataFrame:
    """page_id, host, path, rule, verdict, score (probability of a block by the trees): one row per row of pages."""
    urls = split_urls(pages, page_id, url)
    rule, verdict = fitting_rule(rules)
    feats = lexical(urls.select("*", rule.alias("rule"), verdict.alias("by_rule")))
    labelled = feats.where(F.col("by_rule").isNotNull()).withColumn("y", (F.col("by_rule") == "block").cast("int"))
    stats, sums = [[0.0] * BINS for _ in range(2)], {}
    both = labelled.select(F.explode(F.array(F.struct(F.lit(1).alias("k"), F.col("bin1").alias("b")), F.struct(F.lit(2).alias("k"), F.col("bin2").alias("b")))).alias("s"), "y")
    for r in both.groupBy("s").agg(F.sum("y").alias("y"), F.count("y").alias("n")).collect():  # 2 x BINS rows at most
        stats[r["s"]["k"] - 1][r["s"]["b"]] = suffix_odds(r["y"], r["n"])
        sums[r["s"]["k"], r["s"]["b"]] = (r["y"], r["n"])
    rows = picked(labelled.select("_url", "page_id", *FEATURES[:-2], "bin1", "bin2", "y"), F.xxhash64("_url", "page_id"), sample).collect()
    rows.sort(key=lambda r: (r["_url"] or "", str(r["page_id"])))
    x = [[float(r[c]) for c in FEATURES[:-2]] + [suffix_odds(*sums[k, r[f"bin{k}"]], own=r["y"]) for k in (1, 2)] for r in rows]
    odds = boost(x, [r["y"] for r in rows]).column()
    return _with_suffix(feats, stats).select(
        "page_id",
        "host",
        "path",
        "rule",
        F.coalesce("by_rule", F.when(odds > 0, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
        (1 / (1 + F.exp(-odds))).alias("score"),
    )
