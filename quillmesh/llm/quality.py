"""Quality rules with risk-controlled cutoffs.

Three signals, higher is worse: the share of symbol characters, the share of capitals and
repetition (1 - log distinct words / log words).  A rule rejects a document whose signal is
above the cutoff for its stratum (its language).  Cutoffs come from labelled holdout
documents: for each stratum and rule the candidates of a fixed grid are tested from the
most lenient on; a candidate passes if the exact binomial tail shows that at most
``risk / rules`` of the stratum's good documents are rejected, at a level of
``delta / (strata * rules)`` (Bonferroni; the fixed testing order stops at the first
failure and so needs no further correction).  Of the candidates that passed the one that
tells bad from good best is taken (ties: the most lenient).  So with probability
1 - delta no stratum loses more than ``risk`` of its good documents.

Defined cases: a text that is null or has no words is rejected outright by the rule
"empty".  A stratum without enough labels to prove anything has no cutoffs and loses
nothing else.  Null language: a stratum of its own.  Labels: null doc_ids and null
qualities are ignored, a document with contradicting labels counts as bad, repeated rows
count once; of several texts with one labelled doc_id the one with the least hash counts.
Null doc_ids and repeated rows of documents are judged like any other row, and very long
texts whole.  Ties: a signal equal to the cutoff passes.  Extra columns: ignored, or kept
by ``keep_good``.  Empty tables: no rows, or no cutoffs.  The driver gets one row of counts
for each language among the labelled documents.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.llm.common import project, table

SYMBOLS = "%&*#$|!"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞ"
RULES = ("symbols", "capitals", "repetition")
GRID = {
    "symbols": (0.5, 0.4, 0.3, 0.2, 0.15, 0.1, 0.08, 0.06, 0.05, 0.04, 0.03, 0.02),
    "capitals": (0.8, 0.6, 0.5, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.12, 0.1, 0.08),
    "repetition": (0.6, 0.5, 0.4, 0.35, 0.3, 0.25, 0.2, 0.18, 0.16, 0.14, 0.12, 0.1),
}
RISK = 0.02
DELTA = 0.05


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) for X ~ Bin(n, p), summed in logs."""
    if n == 0 or k >= n:
        return 1.0
    term = n * math.log1p(-p)
    ratio, total = math.log(p) - math.log1p(-p), math.exp(term)
    for i in range(1, k + 1):
        term += math.log(n - i + 1) - math.log(i) + ratio
        total += math.exp(term)
    return min(1.0, total)


def signals(text: Column) -> dict[str, Column]:
    chars = F.greatest(F.length(text), F.lit(1)).cast("double")
    words = F.array_remove(F.split(text, r"[ \t\r\n]+"), "")
    log_size = lambda x: F.log(F.size(x).cast("double"))
    repeated = lambda w: F.when(F.size(w) > 1, 1 - log_size(F.array_distinct(w)) / log_size(w)).otherwise(0.0)
    share = lambda chosen: F.regexp_count(text, F.lit(f"[{chosen}]")) / chars
    # words are a function's argument, so that they are made once though used three times
    return {"symbols": share(SYMBOLS), "capitals": share(CAPITALS), "repetition": F.get(F.transform(F.array(words), repeated), 0)}


def certify(good: int, rejected: list[int], bad: int, bad_rejected: list[int], grid: tuple[float, ...], risk: float, level: float) -> float | None:
    """The cutoff of one stratum and rule; rejected: good documents above each candidate."""
    best: tuple[float, float] | None = None
    for cutoff, k, b in zip(grid, rejected, bad_rejected):
        if binomial_tail(k, good, risk) > level:
            break
        gain = b / max(bad, 1) - k / max(good, 1)
        if best is None or gain > best[0]:
            best = (gain, cutoff)
    return best and best[1]


def cutoffs(docs: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> list[tuple[str | None, dict[str, float | None]]]:
    """For each stratum with labels: its cutoffs by rule (None: nothing certified).  The counts are over all labelled documents."""
    rows = project(docs, doc_id=("doc_id", "long"), text=("text", "string"), stratum=("lang", "string"))
    rows = rows.where(F.col("text").rlike(r"[^ \t\r\n]"))
    rows = rows.select("doc_id", "stratum", F.xxhash64("text").alias("draw"), *[c.alias(r) for r, c in signals(F.col("text")).items()])
    marks = project(labels, doc_id=("doc_id", "long"), quality=("quality", "int")).where("doc_id is not null and quality is not null")
    marks = marks.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    one = F.min(F.struct("draw", "stratum", *RULES)).alias("one")
    held = rows.join(marks, "doc_id").groupBy("doc_id").agg(one, F.first("quality").alias("quality")).select("quality", "one.*")
    good, bad = F.col("quality") > 0, F.col("quality") <= 0
    counts = held.groupBy("stratum").agg(
        F.count_if(good).alias("good"),
        F.count_if(bad).alias("bad"),
        *[F.array(*[F.count_if(side & (F.col(r) > c)) for c in GRID[r]]).alias(f"{name}_{r}") for name, side in (("good", good), ("bad", bad)) for r in RULES],
    )
    found = counts.collect()
    level = delta / (len(RULES) * max(1, len(found)))
    return [(x["stratum"], {r: certify(x["good"], x[f"good_{r}"], x["bad"], x[f"bad_{r}"], GRID[r], risk / len(RULES), level) for r in RULES}) for x in found]


def failed_rules(text: Column, stratum: Column, cuts: list[tuple[str | None, dict[str, float | None]]]) -> Column:
    """Names of the rules that reject a text, in order, as an array; the cutoffs are literals, so nothing is joined."""
    named = [F.when(~F.coalesce(text.rlike(r"[^ \t\r\n]"), F.lit(False)), F.lit("empty"))]
    for rule, signal in signals(text).items():
        limit = F.lit(None).cast("double")
        known = [x for kv in ((s, c[rule]) for s, c in cuts if s is not None and c[rule] is not None) for x in kv]
        if known:
            limit = F.try_element_at(F.create_map(*[F.lit(x) for x in known]), stratum)
        of_null = next((c[rule] for s, c in cuts if s is None), None)
        if of_null is not None:
            limit = F.when(stratum.isNull(), F.lit(of_null)).otherwise(limit)
        named.append(F.when(signal > limit, F.lit(rule)))
    return F.filter(F.array(*named), lambda x: x.isNotNull())


def judge(docs: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """(doc_id, lang, failed, keep) for every row; failed joins the names of the rules that reject it."""
    cuts = cutoffs(docs, labels, risk, delta)
    rows = project(docs, doc_id=("doc_id", "long"), text=("text", "string"), lang=("lang", "string"))
    failed = F.array_join(failed_rules(F.col("text"), F.col("lang"), cuts), ",")
    return rows.select("doc_id", "lang", failed.alias("failed")).withColumn("keep", F.col("failed") == "")


def keep_good(docs: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """The rows of docs that no rule rejects, with all their columns."""
    cuts = cutoffs(docs, labels, risk, delta)
    return docs.where(F.size(failed_rules(F.col("text").cast("string"), F.col("lang").cast("string"), cuts)) == 0)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


_GRID = ", ".join(f"('{r}', {c}::DOUBLE)" for r in RULES for c in GRID[r])
_BROKEN = ", ".join(f"CASE WHEN s.{r} > l.{r} THEN '{r}' END" for r in RULES)
ORACLE = rf"""
WITH d AS (
    SELECT doc_id, lang, coalesce(regexp_matches(text, '[^ \t\r\n]'), false) AS worded, text, greatest(length(text), 1)::DOUBLE AS chars,
           list_filter(string_split_regex(text, '[ \t\r\n]+'), lambda x: x <> '') AS w
    FROM documents),
s AS (
    SELECT doc_id, lang, worded, length(regexp_replace(text, '[^{SYMBOLS}]', '', 'g')) / chars AS symbols,
           length(regexp_replace(text, '[^{CAPITALS}]', '', 'g')) / chars AS capitals,
           CASE WHEN len(w) > 1 THEN 1 - ln(len(list_distinct(w))::DOUBLE) / ln(len(w)::DOUBLE) WHEN text IS NOT NULL THEN 0 END AS repetition
    FROM d),
m AS (SELECT doc_id, min(quality) AS quality FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
held AS (SELECT s.*, quality > 0 AS good FROM s JOIN m USING (doc_id) WHERE worded),
long AS (UNPIVOT held ON {", ".join(RULES)} INTO NAME rule VALUE signal),
counted AS (
    SELECT lang, rule, cutoff, count(*) FILTER (WHERE good) AS n, count(*) FILTER (WHERE good AND signal > cutoff) AS k,
           count(*) FILTER (WHERE NOT good) AS bad, count(*) FILTER (WHERE NOT good AND signal > cutoff) AS b
    FROM long JOIN (VALUES {_GRID}) g(rule, cutoff) USING (rule) GROUP BY lang, rule, cutoff),
tails AS (
    SELECT *, CASE WHEN k >= n THEN 1 ELSE list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1)
               + i * ln({RISK / len(RULES)!r}) + (n - i) * ln(1 - {RISK / len(RULES)!r})))) END AS tail,
           {DELTA!r} / ({len(RULES)} * (SELECT count(DISTINCT coalesce(lang, chr(0))) FROM held)) AS level
    FROM counted),
passed AS (SELECT *, bool_and(tail <= level) OVER (PARTITION BY lang, rule ORDER BY cutoff DESC) AS ok FROM tails),
best AS (
    SELECT lang, rule, cutoff FROM passed WHERE ok
    QUALIFY row_number() OVER (PARTITION BY lang, rule ORDER BY b / greatest(bad, 1) - k / greatest(n, 1) DESC, cutoff DESC) = 1),
l AS (SELECT lang, {", ".join(f"max(cutoff) FILTER (WHERE rule = '{r}') AS {r}" for r in RULES)} FROM best GROUP BY lang),
f AS (
    SELECT s.doc_id, s.lang, array_to_string(list_filter([CASE WHEN NOT worded THEN 'empty' END, {_BROKEN}], lambda x: x IS NOT NULL), ',') AS failed
    FROM s LEFT JOIN l ON s.lang IS NOT DISTINCT FROM l.lang)
SELECT doc_id, lang, failed, failed = '' AS keep FROM f
"""
