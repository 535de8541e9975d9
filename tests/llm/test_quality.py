from __future__ import annotations

import math
import random
from fractions import Fraction

from pyspark.sql import functions as F

from quillmesh.llm import quality


def exact_tail(k, n, p):
    return float(sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(min(k, n) + 1)))


def test_binomial_tail_is_exact():
    for n, k, p in [(1, 0, Fraction(1, 2)), (50, 3, Fraction(1, 20)), (400, 11, Fraction(1, 50)), (10, 10, Fraction(1, 3)), (0, 0, Fraction(1, 9))]:
        assert math.isclose(quality.binomial_tail(k, n, float(p)), exact_tail(k, n, p), rel_tol=1e-9)


def test_false_rejections_are_limited():
    """Over many holdouts the certified cutoff breaks the risk no more often than the level allows."""
    rng, grid, broken = random.Random(2), (0.9, 0.8, 0.7, 0.6, 0.5), 0
    for _ in range(400):
        good = [rng.random() ** 6 for _ in range(400)]
        rejected = [sum(x > c for x in good) for c in grid]
        cutoff = quality.certify(400, rejected, 1, [1, 1, 1, 1, 1], grid, 0.05, 0.05)
        broken += cutoff is not None and 1 - cutoff ** (1 / 6) > 0.05
    assert broken <= 0.08 * 400


def plain_signals(text):
    words = [w for w in __import__("re").split(r"[ \t\r\n]+", text) if w]
    n = len(words)
    return {
        "symbols": sum(text.count(c) for c in quality.SYMBOLS) / max(1, len(text)),
        "capitals": sum(c in quality.CAPITALS for c in text) / max(1, len(text)),
        "repetition": 1 - math.log(len(set(words))) / math.log(n) if n > 1 else 0.0,
    }


def test_equals_brute_force(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    risk, delta = 0.15, 0.1
    texts = {r.doc_id: (r.lang, r.text) for r in docs.collect()}
    marks = {r.doc_id: r.quality for r in labels.collect()}
    signal = {i: plain_signals(t) for i, (_, t) in texts.items()}
    strata = {lang for i, (lang, _) in texts.items() if i in marks}
    want = {}
    for s in strata:
        for rule in quality.RULES:
            good = [signal[i][rule] for i in marks if texts[i][0] == s and marks[i] == 1]
            bad = [signal[i][rule] for i in marks if texts[i][0] == s and marks[i] == 0]
            best = None
            for c in quality.GRID[rule]:
                k = sum(x > c for x in good)
                if exact_tail(k, len(good), Fraction(risk / 3)) > delta / (3 * len(strata)):
                    break
                gain = sum(x > c for x in bad) / max(1, len(bad)) - k / max(1, len(good))
                if best is None or gain > best[0]:
                    best = (gain, c)
            want[s, rule] = best and best[1]
    got = {(s, r): c for s, by in quality.cutoffs(docs, labels, risk, delta) for r, c in by.items()}
    assert got == want and any(want.values())
    judged = {r.doc_id: r.failed for r in quality.judge(docs, labels, risk, delta).collect()}
    assert judged == {i: ",".join(r for r in quality.RULES if want[lang, r] is not None and signal[i][r] > want[lang, r]) for i, (lang, _) in texts.items()}
    kept = {r.doc_id for r in quality.keep_good(docs, labels, risk, delta).collect()}
    assert kept == {i for i, f in judged.items() if not f} and 0 < len(kept) < len(texts)


def test_rejects_junk_and_keeps_clean(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    rows = quality.judge(docs, labels).join(labels, "doc_id").where("lang = 'en'").groupBy("quality").agg(F.avg(F.col("keep").cast("int")).alias("kept")).collect()
    kept = {r.quality: r.kept for r in rows}
    assert kept[1] > 0.98 and kept[0] < 0.2


def test_defined_cases(spark):
    rows = [(1, None, "en"), (2, "", "en"), (3, " \n", None), (4, "fine words", None), (4, "fine words", None), (None, "fine too", "xx"), (5, "Sh " * 60_000, "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("keep", F.lit("x")).withColumn("stratum", F.lit(1)).withColumn("symbols", F.lit(2))
    labels = spark.createDataFrame([(4, 1, 0), (4, 0, 0), (None, 1, 0), (5, None, 0), (5, 0, 0), (5, 0, 0)], "doc_id long, quality int, toxic int")
    got = sorted((r.doc_id or 0, r.failed, r.keep) for r in quality.judge(df, labels).collect())
    assert got == [(0, "", True), (1, "empty", False), (2, "empty", False), (3, "empty", False), (4, "", True), (4, "", True), (5, "", True)]
    assert quality.judge(df.limit(0), labels.limit(0)).collect() == []
    kept = quality.keep_good(df, labels)
    assert kept.columns == df.columns and kept.count() == 4
    by_null = [(None, {"symbols": None, "capitals": None, "repetition": 0.5})]
    flagged = df.select(quality.failed_rules(F.lit("a a a a a a a a"), F.lit(None).cast("string"), by_null).alias("f")).first()
    assert flagged.f == ["repetition"]
