"""URL filter: gradient-boosted trees on lexical features.

Features of a URL: lengths of the whole, the host, the path and the longest path part; path
depth; shares of digits, in the URL and in the host, of letters and of hyphens; entropy of
the URL's and of the host's characters; counts of host labels, host hyphens, parameters,
underscores, percent escapes; an IP host, a port, a fragment, https, www; and suffix
statistics: the smoothed rate of bad URLs among the training URLs with the same top-level
domain, the same registered domain (last two labels) and the same host.

Training URLs are labelled bad by terms in the host, by category, as block lists have
them: terms that no other word holds anywhere in the host, the rest as whole runs of
letters.  A URL without a term is unlabelled rather than known to be good, and counts for
``UNKNOWN`` of a row as a good example.  The trees never see the terms; training rows get
suffix statistics from the other folds only, so a host's own label doesn't leak.  Trees are grown best level by
level on quantile bins with Newton steps for the logistic loss.  The sample holds at most
``max_rows`` URLs of either label, chosen by hash; every URL of the table is scored.

Defined cases: null page_id: kept with a null id.  Null or blank URL: null probability and
kept, as there is nothing to judge.  URLs without a host, in odd forms or very long: like
any other string.  Repeated rows: each.  No labelled URLs, or of one label only: that
label's smoothed rate for every URL.  Empty table: no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.llm.common import bounded_sample, project, table

#: Terms by category: found anywhere in a host, and as whole runs of its letters.
TERMS = {
    "spam": (("spam", "phish", "malware", "warez"), ("scam", "scams", "crack", "cracks", "keygen", "torrent", "torrents")),
    "pharmacy": (("pills", "viagra", "cialis", "pharmacy"), ("pill", "meds", "drugs")),
    "gambling": (("casino", "betting", "gambling", "jackpot"), ("bet", "bets", "poker", "slots", "lottery", "roulette")),
    "adult": (("porn", "xxx"), ("adult", "adults", "sex", "sexy", "nude", "nudes", "escort", "escorts", "webcams")),
    "ads": (("adserver", "doubleclick"), ("ads", "adserv", "advert", "adverts", "banners", "popup", "popups", "track", "tracker", "trackers", "tracking")),
    "loans": (("payday",), ("loan", "loans")),
}
SEEDS = tuple(t for kinds in TERMS.values() for kind in kinds for t in kind)
UNKNOWN = 0.5
MAX_ROWS = 10_000
TREES, DEPTH, RATE, BINS, PENALTY, LEAST = 60, 4, 0.15, 32, 1.0, 5
FLAG, FOLDS, PRIOR = 0.5, 5, 5.0
NAMES = ("length", "host_length", "path_length", "longest_part", "depth", "digit_share", "host_digit_share", "letter_share", "hyphen_share", "entropy", "host_entropy", "labels", "host_hyphens", "parameters", "underscores", "escapes", "ip_host", "port", "fragment", "https", "www", "tld_rate", "domain_rate", "host_rate")
_URL = re.compile(r"^\s*(?:([a-zA-Z][a-zA-Z0-9+.-]*):)?(?://)?(?:[^/?#@]*@)?([^/?#:]*)(:[^/?#]*)?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$", re.S)
_IP = re.compile(r"^\d{1,3}(\.\d{1,3}){3}$")


def host_of(url: str) -> str:
    found = _URL.match(url)
    return found.group(2).lower() if found else ""


def bad_host(terms: dict[str, tuple[tuple[str, ...], tuple[str, ...]]] = TERMS) -> str:
    """A regular expression that finds a term in a lower-case host."""
    anywhere, whole = ("|".join(t for kinds in terms.values() for t in kinds[k]) for k in (0, 1))
    return rf"(?:{anywhere})|(?<![a-z])(?:{whole})(?![a-z])"


def suffixes(host: str) -> tuple[str, str, str]:
    labels = host.split(".")
    return labels[-1], ".".join(labels[-2:]), host


def _entropy(text: str) -> float:
    n = len(text)
    return -sum(k / n * math.log2(k / n) for k in Counter(text).values()) if n else 0.0


def _digits(text: str) -> float:
    return sum(c.isdigit() for c in text) / max(1, len(text))


def lexical(url: str) -> list[float]:
    scheme, host, port, path, query, fragment = _URL.match(url).groups()
    host, path = host.lower(), path or ""
    parts = [p for p in path.split("/") if p]
    n = max(1, len(url))
    return [
        len(url), len(host), len(path), max(map(len, parts), default=0), len(parts), _digits(url), _digits(host),
        sum(c.isalpha() for c in url) / n, url.count("-") / n, _entropy(url), _entropy(host), host.count(".") + 1, host.count("-"),
        len([p for p in (query or "").split("&") if p]), url.count("_"), url.count("%"), bool(_IP.match(host)), bool(port), fragment is not None,
        (scheme or "").lower() == "https", host.startswith("www."),
    ]


class SuffixRates:
    """Smoothed share of bad URLs by suffix, each URL with its weight."""

    def __init__(self, urls: list[str], bad: np.ndarray, weight: np.ndarray):
        self.prior = float(((bad * weight).sum() + 0.5) / (weight.sum() + 1))
        sums: dict[tuple[int, str], list[float]] = defaultdict(lambda: [0.0, 0.0])
        for url, b, w in zip(urls, bad, weight):
            for k, s in enumerate(suffixes(host_of(url))):
                at = sums[k, s]
                at[0] += b * w
                at[1] += w
        self.rates = {key: (b + PRIOR * self.prior) / (n + PRIOR) for key, (b, n) in sums.items()}

    def of(self, urls: list[str]) -> np.ndarray:
        return np.array([[self.rates.get((k, s), self.prior) for k, s in enumerate(suffixes(host_of(u)))] for u in urls], np.float64).reshape(-1, 3)


@dataclass
class Forest:
    """Trees as arrays (trees, nodes) of a complete binary tree: feature (-1: leaf), threshold, value; left if x <= threshold."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    base: float
    suffix: SuffixRates

    def raw(self, x: np.ndarray) -> np.ndarray:
        score = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for f, t, v in zip(self.feature, self.threshold, self.value):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                inner = f[node] >= 0
                right = x[rows, np.maximum(f[node], 0)] > t[node]
                node = np.where(inner, 2 * node + 1 + right, node)
            score += v[node]
        return score

    def predict(self, urls: list[str]) -> np.ndarray:
        x = np.column_stack([np.array([lexical(u) for u in urls], np.float64).reshape(-1, len(NAMES) - 3), self.suffix.of(urls)])
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -30, 30)))


def best_split(bins: np.ndarray, g: np.ndarray, h: np.ndarray, n_bins: int = BINS) -> tuple[float, int, int] | None:
    """(gain, feature, last bin on the left) of the best Newton split of these rows."""
    n, width = bins.shape
    at = (bins + np.arange(width) * n_bins).ravel()
    sums = [np.bincount(at, w, width * n_bins).reshape(width, n_bins).cumsum(axis=1) for w in (np.repeat(g, width), np.repeat(h, width), np.ones(n * width))]
    gl, hl, nl = sums
    gt, ht = gl[:, -1:], hl[:, -1:]
    gain = gl**2 / (hl + PENALTY) + (gt - gl) ** 2 / (ht - hl + PENALTY) - gt**2 / (ht + PENALTY)
    gain[(nl < LEAST) | (n - nl < LEAST)] = -np.inf
    k = int(gain.argmax())
    best = gain.ravel()[k]
    return (float(best), k // n_bins, k % n_bins) if best > 1e-6 else None


def train(urls: list[str], bad: np.ndarray, trees: int = TREES, weight: np.ndarray | None = None) -> Forest:
    bad = bad.astype(np.float64)
    weight = np.ones(len(bad)) if weight is None else weight
    whole = SuffixRates(urls, bad, weight)
    nodes = 2 ** (DEPTH + 1) - 1
    base = math.log(whole.prior / (1 - whole.prior))
    if not len(bad) or bad.min() == bad.max():
        return Forest(np.zeros((0, nodes), np.int64), np.zeros((0, nodes)), np.zeros((0, nodes)), base, whole)
    fold = np.array([xxhash.xxh3_64_intdigest(u) % FOLDS for u in urls])
    rates = np.zeros((len(urls), 3))
    for k in range(FOLDS):
        asked = np.nonzero(fold == k)[0]
        other = np.nonzero(fold != k)[0]
        if len(asked):
            rates[asked] = SuffixRates([urls[i] for i in other], bad[other], weight[other]).of([urls[i] for i in asked])
    x = np.column_stack([np.array([lexical(u) for u in urls], np.float64), rates])
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    bins = np.column_stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T)])
    feature, threshold, value = np.full((trees, nodes), -1), np.zeros((trees, nodes)), np.zeros((trees, nodes))
    score = np.full(len(urls), base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = weight * (p - bad), weight * np.maximum(p * (1 - p), 1e-6)
        level = {0: np.arange(len(urls))}
        for depth in range(DEPTH + 1):
            below = {}
            for node, rows in level.items():
                split = best_split(bins[rows], g[rows], h[rows]) if depth < DEPTH and len(rows) >= 2 * LEAST else None
                if split is None or split[2] >= len(cuts[split[1]]):
                    value[t, node] = -RATE * g[rows].sum() / (h[rows].sum() + PENALTY)
                    score[rows] += value[t, node]
                    continue
                _, f, b = split
                feature[t, node], threshold[t, node] = f, cuts[f][b]
                left = bins[rows, f] <= b
                below[2 * node + 1], below[2 * node + 2] = rows[left], rows[~left]
            level = below
    return Forest(feature, threshold, value, base, whole)


def fit(pages: DataFrame, max_rows: int = MAX_ROWS) -> Forest:
    urls = project(pages, url=("url", "string")).where(F.col("url").rlike(r"\S")).distinct()
    host = F.lower(F.regexp_extract("url", r"^\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?(?://)?(?:[^/?#@]*@)?([^/?#:]*)", 1))
    marked = urls.select("url", host.rlike(bad_host()).alias("bad"))
    sizes = {r["bad"]: r["count"] for r in marked.groupBy("bad").count().collect()}
    rows = [r for b, n in sorted(sizes.items()) for r in bounded_sample(marked.where(F.col("bad") == b), n, max_rows, "url").collect()]
    rows.sort(key=lambda r: (xxhash.xxh3_64_intdigest(r["url"]), r["url"]))
    bad = np.array([r["bad"] for r in rows], np.float64)
    return train([r["url"] for r in rows], bad, weight=np.where(bad > 0, 1.0, UNKNOWN))


def score(pages: DataFrame, forest: Forest, flag: float = FLAG) -> DataFrame:
    """(page_id, url, bad_probability, keep) for each row."""
    shared = pages.sparkSession.sparkContext.broadcast(forest)

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            real = np.array([isinstance(u, str) and bool(u.strip()) for u in pdf["url"]], bool)
            p = np.full(len(pdf), np.nan)
            if real.any():
                p[real] = shared.value.predict(pdf["url"][real].tolist())
            out = pd.DataFrame({"page_id": pdf["page_id"].to_numpy(), "url": pdf["url"].to_numpy(), "bad_probability": p, "keep": ~(p > flag)})
            out["bad_probability"] = out["bad_probability"].astype(object).where(real, None)
            yield out

    rows = project(pages, page_id=("page_id", "long"), url=("url", "string"))
    return rows.mapInPandas(look, "page_id long, url string, bad_probability double, keep boolean")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return score(pages, fit(pages))
