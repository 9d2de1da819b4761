"""Quality rules with risk-controlled thresholds.

Rules compare counts of a text with a cutoff. Labelled texts are folded, so copies are one trial, and split
by their hash. One half lays out a path for each stratum: cutoffs of use, the most precise first and of a
rule the loosest first, each step rejecting what the steps before reject and more. On the other half, held
out, an exact binomial tail shows for each step that all rules of the path so far together reject at most
``risk`` of the good texts. The steps of a path reject nested sets, so they are tested in their fixed
sequence, up to the first failure, at one level; it is divided by the number of paths (Bonferroni), so the
guarantees of all strata hold together with probability 1 - ``level``. A stratum takes the last step that
passes; without one its rules are off. Strata with too few held-out good labels to pass for themselves
(``least_labels``) are judged as one: their bound is for the good texts of all of them together, not
for each.

Defined cases: a null or empty text has no words and fails the base; a null stratum is a stratum; a
document with conflicting labels, and copies with different ones, count by their lowest; labels without
document, null ids and null labels teach nothing; without labels, only the base decides; repeated rows are
judged alike; rows of one id are judged each by its own text."""

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plotlink.llm.common import pages, same, text_hash, without_rows, words_of, written

STATS = "n_words word_chars n_symbols n_dup_lines n_repeat_words n_lines".split()
SYMBOLS = "#*$%&|<>"
#: Rule: (numerator, factor, denominator, +1 rejects above and -1 below the cutoff, cutoffs).
RULES = {
    "symbols": ("n_symbols", 1000, "word_chars", 1, (10, 20, 30, 50, 80, 120, 200)),
    "dup_lines": ("n_dup_lines", 1000, "n_lines", 1, (50, 100, 150, 200, 300, 400, 500)),
    "repeats": ("n_repeat_words", 1000, "n_words", 1, (20, 40, 60, 80, 100, 120, 150)),
    "long_words": ("word_chars", 100, "n_words", 1, (700, 800, 900, 1000, 1200, 1500, 2000)),
    "short_words": ("word_chars", 100, "n_words", -1, (450, 400, 350, 300, 250, 200, 150)),
    "few_words": ("n_words", 1, None, -1, (60, 50, 40, 30, 25, 20, 15)),
}


def measure(text: str) -> tuple:
    """STATS of one text."""
    words = words_of(text)
    n = len(words)
    lines = [x for x in text.split("\n") if words_of(x)] if "\n" in text else ([text] if n else [])
    grams = list(zip(words, words[1:], words[2:], words[3:], words[4:]))
    repeated = 0
    if len(set(grams)) < len(grams):
        number, first = {}, []
        for g in grams:
            first.append(number.setdefault(g, len(number)))
        at = np.array(first)
        often = np.flatnonzero(np.bincount(at)[at] > 1)
        edge = np.zeros(n + 1, np.int64)
        np.add.at(edge, often, 1)
        np.add.at(edge, often + 5, -1)
        repeated = int((np.cumsum(edge) > 0).sum())
    chars = len(text) - sum(map(text.count, " \t\n\x0b\x0c\r"))
    return n, chars, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated, len(lines)


def stats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """doc_id, stratum, same (hash of the text) and STATS of every whole text."""
    def run(frames):
        for pdf in pages(frames):
            got = pd.DataFrame([measure(x) for x in pdf["text"]], columns=STATS, index=pdf.index, dtype="int64")
            yield pd.concat([pdf[["doc_id", "stratum", "same"]].astype({"doc_id": "Int64"}), got], axis=1)

    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(stratum_col).cast("string").alias("stratum"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), text_hash(F.col(text_col)).alias("same"))
    return base.mapInPandas(run, "doc_id long, stratum string, same long, " + ", ".join(f"{c} long" for c in STATS))


def base_failed():
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def _value(rule):
    num, factor, den, _, _ = RULES[rule]
    return F.col(num) if den is None else F.floor(F.col(num) * factor / F.greatest(F.col(den), F.lit(1))).cast("long")


def _rejects(rule, value, cutoff):
    return value > cutoff if RULES[rule][3] > 0 else value < cutoff


def tail(k: int, n: int, p: float) -> float:
    """P(X <= k) of n trials of probability p, by its terms from k down; 1 where k is not below the mean,
    where no test could pass."""
    if k >= n * p:
        return 1.0
    term = math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p))
    total = 0.0
    for i in range(k, -1, -1):
        total += term
        if term < total * 1e-17:
            break
        term *= i / (n - i + 1) * (1 - p) / p
    return min(1.0, total)


def least_labels(n_tests: int, risk: float, level: float) -> int:
    """Held-out good labels, none of them rejected, that ``n_tests`` tests at ``level`` need."""
    return math.ceil(math.log(level / max(n_tests, 1)) / math.log1p(-risk))


def paths(fitted: DataFrame, benefit: float) -> DataFrame:
    """judge, rule, cutoff, step: the path of each judge, from counts of the fitting half by judge, rule and
    cutoff. A cutoff is of use if at least ``benefit`` of what it rejects is bad."""
    of_use = fitted.filter((F.col("bad_out") > 0) & (F.col("bad_out") >= benefit * (F.col("bad_out") + F.col("good_out"))))
    share = F.col("good_out") / (F.col("good_out") + F.col("bad_out"))
    # a stricter cutoff comes no earlier than the looser ones of its rule; where it is no worse, they are left out
    by_rule = Window.partitionBy("judge", "rule").orderBy("strict")
    late = of_use.withColumn("late", F.max(share).over(by_rule)).withColumn("next", F.lead("late").over(by_rule)).filter("next IS NULL OR next > late")
    order = Window.partitionBy("judge").orderBy("late", F.desc("bad_out"), "rule", "strict")  # rules x cutoffs at most
    return late.select("judge", "rule", "cutoff", F.row_number().over(order).alias("step"))


def first_step(path: Column) -> Column:
    """The first step of a path (array of rule, cutoff, step) that rejects a measured row; null if none does."""
    sign = {rule: r[3] for rule, r in RULES.items()}
    value = F.create_map(*[x for rule in RULES for x in (F.lit(rule), _value(rule) * sign[rule])])
    signs = F.create_map(*[x for rule in RULES for x in (F.lit(rule), F.lit(sign[rule]))])
    return F.array_min(F.transform(path, lambda x: F.when(value[x["rule"]] > x["cutoff"] * signs[x["rule"]], x["step"])))


def thresholds(measured: DataFrame, labels: DataFrame, risk: float = 0.01, level: float = 0.05, benefit: float = 0.9,
               label_id: str = "doc_id", label: str = "quality") -> DataFrame:
    """stratum, rule, cutoff and what they were chosen by: n held-out good texts, k of them rejected by all the
    stratum's rules together, p. Everything per text stays in Spark, and so do counts: strata x rules x cutoffs."""
    labelled = labels.select(F.col(label_id).cast("long").alias("lid"), F.col(label).cast("int").alias("good")).dropna().groupBy("lid").agg(F.min("good").alias("good"))
    rows = measured.filter(~base_failed()).join(labelled, F.col("doc_id") == F.col("lid"))
    texts = written(rows.groupBy("stratum", "same", *STATS).agg(F.min("good").alias("good")).withColumn("held", F.pmod(F.xxhash64(F.lit("holdout"), "same"), F.lit(2)) == 0), "trials")
    held_good = texts.groupBy("stratum").agg(F.count_if(F.col("held") & (F.col("good") == 1)).alias("n"))
    need = least_labels(held_good.count(), risk, level)
    judge = F.when(F.col("n") < need, "pool").when(F.col("stratum").isNull(), "null").otherwise(F.concat(F.lit("="), "stratum"))
    judges = written(held_good.select(F.col("stratum").alias("s"), judge.alias("judge")), "judges")
    texts = texts.join(judges, same(F.col("stratum"), F.col("s"))).drop("s")
    tests = F.array(*[F.struct(F.lit(rule).alias("rule"), F.lit(c).alias("cutoff"), F.lit(i).alias("strict"), _rejects(rule, _value(rule), c).alias("rejected"))
                      for rule, r in RULES.items() for i, c in enumerate(sorted(r[4], reverse=r[3] > 0))])
    fitted = texts.filter(~F.col("held")).select("judge", "good", F.inline(tests)).filter("rejected").groupBy("judge", "rule", "cutoff", "strict").agg(
        F.count_if(F.col("good") == 1).alias("good_out"), F.count_if(F.col("good") == 0).alias("bad_out"))
    path = written(paths(fitted, benefit), "paths")
    n_paths = path.select("judge").distinct().count()
    steps = path.groupBy(F.col("judge").alias("j")).agg(F.collect_list(F.struct("rule", "cutoff", "step")).alias("path"))
    trials = texts.filter(F.col("held") & (F.col("good") == 1)).join(steps, F.col("judge") == F.col("j")).select("judge", first_step(F.col("path")).alias("step"))
    out = trials.groupBy("judge", "step").agg(F.count("*").alias("c"))
    total = out.groupBy("judge").agg(F.sum("c").alias("n"))
    so_far = Window.partitionBy("judge").orderBy("step")
    tested = path.join(total, "judge").join(out, ["judge", "step"], "left").withColumn("k", F.coalesce(F.sum("c").over(so_far), F.lit(0)))

    def bound(frames):
        for pdf in frames:
            yield pdf.assign(p=[tail(int(k), int(n), risk) if n else 1.0 for k, n in zip(pdf["k"], pdf["n"])])

    # k grows along a path and so does p: what is within the level is the sequence up to its first failure
    fit = tested.select("judge", "rule", "cutoff", "step", "n", "k").mapInPandas(bound, "judge string, rule string, cutoff int, step int, n long, k long, p double").filter(F.col("p") <= level / max(n_paths, 1))
    last = F.struct("step", "n", "k", "p")
    best = fit.groupBy("judge").agg(F.max(last).alias("at")).join(fit.groupBy("judge", "rule").agg(F.max_by("cutoff", "step").alias("cutoff")), "judge")
    return judges.join(best, "judge").select(F.col("s").alias("stratum"), "rule", "cutoff", "at.n", "at.k", "at.p", (F.col("judge") == "pool").alias("pooled"))


def judged(measured: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """The measured rows with base_failed, failed (the rules a row fails) and kept."""
    by_stratum = cutoffs.groupBy(F.col("stratum").alias("s")).agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("c"))
    rows = measured.join(by_stratum, same(F.col("stratum"), F.col("s")), "left")
    fails = F.array_compact(F.array(*[F.when(_rejects(r, _value(r), F.col("c")[r]), F.lit(r)) for r in RULES]))
    return rows.withColumn("base_failed", base_failed()).withColumn("failed", fails).withColumn("kept", ~F.col("base_failed") & (F.size("failed") == 0)).drop("s", "c")


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", **options) -> DataFrame:
    """Every document's counts and verdict."""
    measured = written(stats(docs, id_col, text_col, stratum_col), "stats")
    return judged(measured, written(thresholds(measured, labels, **options), "thresholds"))


def kept_documents(docs: DataFrame, verdicts: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """The documents, all columns, without the rows that ``verdicts`` rejects, known by id, text and stratum."""
    gone = verdicts.filter("not kept").select("doc_id", "same", "stratum")
    return without_rows(docs, gone, F.col(id_col).cast("long"), text_hash(F.col(text_col)), F.col(stratum_col).cast("string"))
