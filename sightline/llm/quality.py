"""Quality rules with risk-controlled cutoffs from a labelled holdout."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import again, aside, checkpointed, in_text_batches, small, table, text_of

#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
#: Words of a window, and what the base rules reject.
WINDOW, LEAST_WORDS, MOST_REPEATED_PERCENT = 8, 20, 30
#: The rules that get cutoffs: a document fails one if its measure is at or over the cutoff. Each is in [0, 1].
RULES = ("symbol_share", "dup_line_share", "repeat_share", "long_word_share")
#: Cutoffs are multiples of 1/200.
STEPS = 200
#: Levels of a stratum's path of cutoffs: at level i each rule rejects i of so many parts of the stratum's documents at most.
LEVELS, PARTS = 1000, 4000
MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_long_words long"
#: A word of more code points counts as long.
LONG_WORD = 12


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in a window which occurs twice or more, its first place included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    codes: dict[bytes, int] = {}
    code = np.fromiter((codes.setdefault(w, len(codes)) for w in words), np.int64, len(words))
    if len(codes) == len(words):
        return 0
    # Codes of 1, 2, 4, ... words: each from two of half the length.
    length = 1
    while length < window:
        step = min(length, window - length)
        pair = code[:-step] * (int(code.max()) + 1) + code[step:]
        _, code = np.unique(pair, return_inverse=True)
        length += step
    again = np.bincount(code)[code] > 1
    if not again.any():
        return 0
    edge = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(again)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + window, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def measures(text: str) -> tuple[int, ...]:
    """The numbers named in MEASURES; words stand between ASCII white space."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    if not words:
        return 0, 0, sum(map(text.count, SYMBOLS)), 0, 0, 0, 0
    if len(raw) == len(text):
        chars = sum(map(len, words))
        long_words = sum(len(w) > LONG_WORD for w in words)
    else:
        lengths = [len(w) if len(w) <= LONG_WORD else len(w.decode("utf-8", "surrogatepass")) for w in words]
        chars = len(text) - sum(map(text.count, " \t\n\v\f\r"))
        long_words = sum(n > LONG_WORD for n in lengths)
    lines = [x for x in raw.split(b"\n") if not x.isspace() and x]
    return len(words), chars, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words), len(lines), long_words


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the columns of MEASURES in place of the text."""
    names = [x.split()[0] for x in MEASURES.split(", ")]

    @F.pandas_udf(MEASURES)
    def measure(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([measures(t) for t in batch], columns=names, dtype="int64")

    keep = [c for c in docs.columns if c not in {text, *names}]
    return in_text_batches(docs).select(*keep, measure(text_of(text)).alias("_m")).select(*keep, "_m.*")


def with_rules(df: DataFrame) -> DataFrame:
    share = lambda a, b: F.coalesce(F.least(F.lit(1.0), F.try_divide(F.col(a).cast("double"), F.col(b))), F.lit(0.0))
    return (
        df.withColumn("symbol_share", share("n_symbols", "word_chars"))
        .withColumn("dup_line_share", share("n_dup_lines", "n_lines"))
        .withColumn("repeat_share", share("n_repeat_words", "n_words"))
        .withColumn("long_word_share", share("n_long_words", "n_words"))
    )


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) for X binomial of n trials at p."""
    if k >= n or p <= 0:
        return 1.0
    if p >= 1:
        return 0.0
    log_p, log_q, top = math.log(p), math.log1p(-p), math.lgamma(n + 1)
    logs = [top - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * log_p + (n - i) * log_q for i in range(k + 1)]
    most = max(logs)
    return min(1.0, math.exp(most) * math.fsum(math.exp(x - most) for x in logs))


def upper_bound(k: int, n: int, delta: float) -> float:
    """The exact (Clopper-Pearson) upper bound, at confidence 1 - delta, of a rate of which k in n were seen."""
    if n == 0 or k >= n:
        return 1.0
    low, high = k / n, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if binomial_tail(k, n, mid) > delta else (low, mid)
    return high


def certified_step(rejected: list[int], n: int, risk: float, delta: float) -> int | None:
    """The last step, from the most lenient on, up to which every bound is within risk.

    rejected: good documents that each step rejects, never falling. The tests go in a fixed order and end
    at the first that fails, so they need no correction among themselves.
    """
    found = None
    for i, k in enumerate(rejected):
        # P(X <= k) at the risk itself decides whether the bound is within it.
        if n == 0 or binomial_tail(k, n, risk) > delta:
            return found
        found = i
    return found


def binned(rows: DataFrame, *columns: str) -> DataFrame:
    """A row for each rule of each row: rule, and the measure's bin of STEPS."""
    stack = ", ".join(f"'{r}', {r}" for r in RULES)
    long = rows.selectExpr(*columns, f"stack({len(RULES)}, {stack}) as (rule, measure)")
    return long.select(*columns, "rule", F.least(F.lit(STEPS), F.floor(F.col("measure") * STEPS + 1e-9)).cast("int").alias("bin"))


def joint_paths(unlabelled: DataFrame) -> DataFrame:
    """(stratum, rule, bin, level): the first level of a stratum's path at which a rule rejects a measure of that bin.

    All rules tighten together: at level i each rejects at most i / PARTS of the stratum's documents, and as many as that allows. Bins that no level rejects are left out, bin 0 is one of them. The path
    comes from documents without labels, so what labels show of it is a fair test.
    """
    counts = binned(unlabelled, "stratum").groupBy("stratum", "rule", "bin").agg(F.count("*").alias("n"))

    def levels(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for rule in RULES:
            own = rows[rows["rule"] == rule]
            counted = np.zeros(STEPS + 1, np.int64)
            np.add.at(counted, own["bin"].to_numpy(), own["n"].to_numpy())
            over = np.cumsum(counted[::-1])[::-1]
            level = np.maximum(1, -(-PARTS * over // max(1, over[0])))
            used = np.flatnonzero(level <= LEVELS)
            out.append(pd.DataFrame({"rule": rule, "bin": used, "level": level[used]}))
        out = pd.concat(out).query("bin > 0")
        return out.assign(stratum=rows["stratum"].iloc[0])[["stratum", "rule", "bin", "level"]]

    return counts.groupBy("stratum").applyInPandas(levels, "stratum string, rule string, bin int, level int")


def risk_cutoffs(holdout: DataFrame, paths: DataFrame, strata: int, risk: float = 0.02, delta: float = 0.05) -> DataFrame:
    """(stratum, cutoff of each rule) from holdout(doc_id, stratum, the rules) of documents labelled good.

    In every stratum, with probability 1 - delta over all strata together, at most `risk` of the good documents fail any rule: the levels of its path are tested in order, each on what all rules together reject at the
    whole risk, with a Bonferroni share of delta for the stratum, up to the first that can't be certified. Without a rejection among them ln(strata / delta) / risk good documents, 217 for four strata, certify a
    level. Counts are aggregated by Spark over all labelled rows; where no level is certified a stratum's cutoffs are null, and the rules reject nothing there.
    """
    met = binned(holdout, "doc_id", "stratum").join(small(paths), ["stratum", "rule", "bin"], "left")
    first = met.groupBy("doc_id", "stratum").agg(F.min("level").alias("level")).groupBy("stratum", "level").agg(F.count("*").alias("n"))

    def certified(rows: pd.DataFrame) -> pd.DataFrame:
        counts = np.zeros(LEVELS + 2, np.int64)
        np.add.at(counts, rows["level"].fillna(LEVELS + 1).astype(int).to_numpy(), rows["n"].to_numpy())
        step = certified_step(np.cumsum(counts)[1 : LEVELS + 1].tolist(), int(counts.sum()), risk, delta / max(1, strata))
        return pd.DataFrame({"stratum": rows["stratum"].iloc[:1], "last": [0 if step is None else step + 1]})

    last = first.groupBy("stratum").applyInPandas(certified, "stratum string, last int")
    inside = paths.join(last, "stratum").where("level <= last")
    return inside.groupBy("stratum").agg(*(F.min(F.when(F.col("rule") == r, F.col("bin") / float(STEPS))).alias(r) for r in RULES))


def quality_verdicts(docs: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = 0.02, delta: float = 0.05, text: str = "text") -> DataFrame:
    """docs without the text, with the measures, base_failed and kept.

    labels: doc_id, quality (1: good). A document whose labels disagree or are null is no part of the holdout, which
    has the good documents that pass the base rules; each doc_id counts once there, rows that share one by the largest of their measures. kept is false if base_failed, or if a
    measure reaches its stratum's certified cutoff, a measure equal to it included. A null stratum is a stratum of its own; without labels
    only the base rules reject. The order in which cutoffs are tried comes from the documents that have no label and pass the base rules, or from all that pass where a stratum has none without.
    A null text has no words and fails the base rules. Rows are returned each, repeated ones too, and no rows give none.
    Texts of any length are measured whole. Columns of docs with the names of measures, rules, base_failed or kept are replaced; others stay, whatever their names.
    """
    names = [x.split()[0] for x in MEASURES.split(", ")]
    kept = [c for c in docs.columns if c not in {text, *names, *RULES, "base_failed", "kept"}]
    own = docs.select(F.col("doc_id").alias("doc_id"), F.coalesce(F.col(stratum).cast("string"), F.lit("\x00")).alias("stratum"), F.col(text).alias("text"), *aside(kept))
    base = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))
    found = checkpointed(measured(own).withColumn("base_failed", base))
    ruled = with_rules(found)
    known = labels.where("doc_id is not null").groupBy("doc_id").agg((F.min("quality") == 1).alias("q"), (F.max("quality") == 1).alias("r"))
    known = checkpointed(known.select("doc_id", F.coalesce(F.col("q") & F.col("r"), F.lit(False)).alias("good")))
    passing = ruled.where("not base_failed").select("doc_id", "stratum", *RULES).join(small(known), "doc_id", "left")
    passing = checkpointed(passing)
    strata = ruled.select("stratum").distinct().count()
    free = passing.where("good is null")
    unlabelled = free.unionByName(passing.join(F.broadcast(free.select("stratum").distinct()), "stratum", "left_anti").select(free.columns))  # a row for each stratum
    holdout = passing.where("good").groupBy("doc_id").agg(F.max(F.struct("stratum", *RULES)).alias("_v")).select("doc_id", "_v.*")
    cutoffs = risk_cutoffs(holdout, checkpointed(joint_paths(unlabelled)), strata, risk, delta)
    for r in RULES:
        cutoffs = cutoffs.withColumnRenamed(r, f"_{r}_cutoff")
    judged = ruled.join(small(checkpointed(cutoffs)), "stratum", "left")  # a row for each stratum
    fails = F.lit(False)
    for r in RULES:
        fails = fails | F.coalesce(F.floor(F.col(r) * STEPS + 1e-9) >= F.round(F.col(f"_{r}_cutoff") * STEPS), F.lit(False))
    return judged.select(*again(kept), *names, *RULES, "base_failed", (~F.col("base_failed") & ~fails).alias("kept"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    return quality_verdicts(docs, table(spark, sf_dir, "labels")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )
