"""URL filters: rules first, then naive Bayes over the words that hosts and paths are made of."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import again, aside, checkpointed, small, table

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: (host, path, verdict): the production rules.
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
#: The longest word that segmentation looks for: no part of a host name between dots is longer.
LONGEST = 63
#: Letters of a name whose substrings are made at once.
STRETCH = 1024
#: A url of more pages is hot: hot urls' verdicts are broadcast, and their pages spread over so many keys.
HOT_URL, SALTS = 10_000, 4096
NOT_LETTERS = "[^\\p{L}]+"


def with_parts(pages: DataFrame, url: str = "url") -> DataFrame:
    """pages with host and path; both are empty for a null url or one without `://`."""
    text = F.coalesce(F.col(url), F.lit(""))
    at = F.instr(text, "://")
    rest = F.when(at > 0, F.substring(text, at + 3, F.length(text))).otherwise("")
    return pages.withColumn("host", F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, UPPER.lower())).withColumn(
        "path", F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    )


def best_rule(rules: tuple[tuple[str, str, str], ...]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits host and path, null if none does; of equal length the first by name.

    A rule list is configuration and becomes part of the expression.
    """
    rule = verdict = None
    for host, path, what in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r)):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule = F.when(fits, host + path) if rule is None else rule.when(fits, host + path)
        verdict = F.when(fits, what) if verdict is None else verdict.when(fits, what)
    none = F.lit(None).cast("string")
    return (none, none) if rule is None else (rule, verdict)


def best_split(label: str, known: dict[str, int], total: int) -> list[str]:
    """The most likely words of a name under the unigram counts, by Viterbi; an unknown piece of n letters counts 10 / (total 10^n)."""
    n = len(label)
    score, back = [0.0] + [-math.inf] * n, [0] * (n + 1)
    log_total = math.log(max(1, total))
    for end in range(1, n + 1):
        for start in range(max(0, end - LONGEST), end):
            word = label[start:end]
            count = known.get(word)
            p = math.log(count) - log_total if count else math.log(10) - log_total - (end - start) * math.log(10)
            if score[start] + p > score[end]:
                score[end], back[end] = score[start] + p, start
    words, end = [], n
    while end:
        words.append(label[back[end] : end])
        end = back[end]
    return words[::-1]


def host_words(hosts: DataFrame, unigrams: DataFrame) -> DataFrame:
    """(host, words) of the distinct hosts: names between dots, hyphens and digits are split into words.

    unigrams(word, n). A name's substrings are joined with the counts, so the vocabulary stays distributed; a name stands for itself by 128 bits of hash there.
    """
    names = hosts.select("host", F.explode(F.array_distinct(F.split("host", NOT_LETTERS))).alias("name")).where("name != ''")
    names = checkpointed(names)
    keyed = names.select("name").distinct().select("name", F.xxhash64("name").alias("a"), F.xxhash64(F.lit(1), "name").alias("b"))
    pieces = keyed.selectExpr("a", "b", f"explode(transform(sequence(0, (length(name) - 1) div {STRETCH}), k -> substring(name, int(k) * {STRETCH} + 1, {STRETCH + LONGEST - 1}))) as piece")
    parts = pieces.selectExpr("a", "b", "piece", f"explode(sequence(1, least({STRETCH}, length(piece)))) as i").selectExpr(
        "a", "b", f"explode(transform(sequence(1, least({LONGEST}, length(piece) - i + 1)), k -> substring(piece, i, k))) as word"
    ).distinct()
    counts = parts.join(unigrams, "word").groupBy("a", "b").agg(F.collect_list(F.struct("word", "n")).alias("known"))
    total = unigrams.agg(F.sum("n")).first()[0] or 1
    each = keyed.join(counts, ["a", "b"], "left").select("name", "known")

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name, known in zip(batch["name"], batch["known"], strict=True):
                found = {} if known is None else {x["word"]: x["n"] for x in known}
                rows.append((name, best_split(name, found, total)))
            yield pd.DataFrame(rows, columns=["name", "words"])

    segmented = each.mapInPandas(split, "name string, words array<string>")
    return names.join(segmented, "name").groupBy("host").agg(F.array_sort(F.flatten(F.collect_list("words"))).alias("words"))


def naive_bayes(tokens: DataFrame) -> DataFrame:
    """(token, weight) from tokens(token, verdict, n): log P(token | allow) - log P(token | block), with one added to each count."""
    counts = tokens.groupBy("token").agg(
        F.sum(F.when(F.col("verdict") == "allow", F.col("n")).otherwise(0)).alias("a"),
        F.sum(F.when(F.col("verdict") == "block", F.col("n")).otherwise(0)).alias("b"),
    )
    all_a, all_b, kinds = counts.agg(F.sum("a"), F.sum("b"), F.count("*")).first()
    shift = math.log((all_b or 0) + kinds) - math.log((all_a or 0) + kinds) if kinds else 0.0
    return counts.select("token", (F.log(F.col("a") + 1.0) - F.log(F.col("b") + 1.0) + shift).alias("weight"))


def judged_urls(pages: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES, html: str = "html", url: str = "url") -> DataFrame:
    """pages without html, with host, path, rule and verdict: a rule's, else the classifier's. Columns of these names are replaced; others stay.

    Words (runs of letters) and their counts (pages that have a word) come from all pages' texts; hosts are split into words with them. The
    classifier learns from the urls that rules judge: the host's words, and the path's words, where
    digits count as one token; what the rules themselves name is left out, as it would only repeat them. An url is judged `allow` if that is at least as likely. Without judged urls every other url
    is allowed. A null url has an empty host and path and no words, so the verdicts' shares decide. Each distinct
    host and path is judged once, however many pages have it; repeated rows are returned each, and no rows give none.
    Equally likely splits of a name: the one whose last words are longest. Urls and pages of any length are read whole.
    """
    rule, verdict = best_rule(rules)
    kept = [c for c in pages.columns if c not in {html, "host", "path", "rule", "verdict"}]
    parts = with_parts(pages.select(F.col(url).alias("url"), *aside(kept)), "url")
    texts = pages.select(F.lower(F.regexp_replace(F.coalesce(F.col(html), F.lit("")), "<[^>]*>", " ")).alias("t"))
    unigrams = (
        texts.select(F.explode(F.array_distinct(F.split("t", NOT_LETTERS))).alias("word"))
        .where(F.length("word").between(1, LONGEST)).groupBy("word").agg(F.count("*").alias("n"))
    )
    urls = checkpointed(parts.groupBy("host", "path").agg(F.count("*").alias("n")).withColumn("rule", rule).withColumn("by_rule", verdict))
    words = host_words(urls.select("host").distinct(), checkpointed(unigrams))
    path_words = F.filter(F.split(F.regexp_replace(F.lower("path"), "[0-9]+", "0"), "[^\\p{L}0]+"), lambda x: x != "")
    tokens = urls.join(words.withColumnRenamed("words", "_host_words"), "host", "left").select(
        "host", "path", "by_rule", "n",
        F.explode(F.concat(
            F.transform(F.coalesce("_host_words", F.array().cast("array<string>")), lambda x: F.concat(F.lit("host:"), x)),
            F.transform(path_words, lambda x: F.concat(F.lit("path:"), x)),
        )).alias("token"),
    )
    # What the rules themselves name says nothing about urls that no rule judges.
    own = {f"host:{x}" for r in rules for x in re.split("[^a-z]+", r[0])} | {f"path:{x}" for r in rules for x in re.split("[^a-z]+", r[1])}
    tokens = checkpointed(tokens.where(~F.col("token").isin(sorted(own))))
    weights = naive_bayes(tokens.where("by_rule is not null").select("token", F.col("by_rule").alias("verdict"), "n"))
    allowed, blocked = (x or 0 for x in urls.agg(*(F.sum(F.when(F.col("by_rule") == v, F.col("n"))) for v in ("allow", "block"))).first())
    prior = math.log(allowed + 1.0) - math.log(blocked + 1.0)
    by_words = F.when(F.lit(blocked == 0) | (F.coalesce("score", F.lit(0.0)) + prior >= 0), "allow").otherwise("block")
    scores = tokens.where("by_rule is null").join(weights, "token").groupBy("host", "path").agg(F.sum("weight").alias("score"))
    decided = urls.where("by_rule is null").join(scores, ["host", "path"], "left").select("host", "path", "n", by_words.alias("v"))
    decided = checkpointed(decided)
    hot = decided.where(F.col("n") > HOT_URL).select("host", "path", F.col("v").alias("_hot"))
    cold = decided.where(F.col("n") <= HOT_URL).select("host", "path", F.lit(-1).cast("long").alias("_salt"), F.col("v").alias("_cold"))
    # Pages whose verdict is known by now carry a key that meets nothing, so that those of one url don't gather in a task.
    out = parts.withColumn("rule", rule).withColumn("_rule", verdict).join(small(hot), ["host", "path"], "left")
    known = F.coalesce("_rule", "_hot")
    out = out.withColumn("_salt", F.when(known.isNull(), F.lit(-1)).otherwise(F.monotonically_increasing_id() % SALTS).cast("long"))
    out = out.join(cold, ["host", "path", "_salt"], "left").withColumn("verdict", F.coalesce("_rule", "_hot", "_cold"))
    return out.select(*again(kept), "host", "path", "rule", "verdict")


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")
