"""Whole queries, and the pipeline stage by stage, against brute force."""

import collections
import math
import re
from fractions import Fraction

import pytest
import regex

import corpus_pipeline
from sightline.llm.mixing import WEIGHTS, domain_of
from sightline.llm.quality import RULES, op5_quality_rules
from sightline.llm.url_filters import op6_url_filters

from .test_ngram_join import brute as brute_components
from .test_pages_embeddings_pipeline import brute_url
from .test_pii_quality_mixing import brute_mix, brute_spans
from .test_tokens_packing_sharding import check_pieces

SF, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
WORD = re.compile("[^\\x20\\x09-\\x0D]+")


def brute_measures(text):
    words = WORD.findall(text or "")
    windows = collections.Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    repeated = {i + j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(8)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    chars, symbols, again = sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines))
    shares = [(symbols, chars), (again, len(lines)), (len(repeated), len(words)), (sum(len(w) > 12 for w in words), len(words))]
    return (len(words), chars, symbols, again, len(repeated)), [min(Fraction(1), Fraction(a, b)) if b else Fraction(0) for a, b in shares]


def tail(k, n, p):
    return sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))


def brute_quality(docs, labels, risk=Fraction(1, 50), delta=Fraction(1, 20)):
    """kept by exact binomial tests in rational numbers."""
    good, seen = {}, {}
    for d, q in labels:
        good[d] = good.get(d, True) and q == 1
    for d, lang, text in docs:
        counts, shares = brute_measures(text)
        seen[d] = (lang, counts, shares, counts[0] < 20 or 100 * counts[4] > 30 * counts[0])
    strata = {x[0] for x in seen.values()}
    cutoff, bins = {}, {d: [math.floor(y * 200 + Fraction(1, 10**9)) for y in x[2]] for d, x in seen.items()}
    for s in strata:
        passing = [d for d, x in seen.items() if x[0] == s and not x[3]]
        path = [d for d in passing if d not in good] or passing
        share = lambda r, c: sum(bins[d][r] >= c for d in path)
        tight = {r: {c: share(r, c) for c in range(1, 202)} for r in range(len(RULES))}
        holdout = [d for d in passing if good.get(d)]
        tested = None
        for level in range(1, 1001):
            now = {r: min(c for c in tight[r] if 4000 * tight[r][c] <= level * len(path)) for r in tight}
            if now == tested:
                continue
            tested = now
            rejected = sum(any(bins[d][r] >= now[r] for r in now) for d in holdout)
            if not holdout or tail(rejected, len(holdout), risk) > delta / len(strata):
                break
            cutoff |= {(s, r): c for r, c in now.items()}
    return {d: not failed and not any(math.floor(x * 200 + Fraction(1, 10**9)) >= cutoff.get((s, r), 201) for r, x in enumerate(shares)) for d, (s, _, shares, failed) in seen.items()}, seen


@pytest.mark.parametrize("sf", [SF, LARGER])
def test_op5_on_the_whole_table(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang", "text").collect()]
    labels = [tuple(r) for r in spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality").collect()]
    kept, seen = brute_quality(docs, labels)
    rows = op5_quality_rules(spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == seen[r.doc_id][1]
        assert r.base_failed == seen[r.doc_id][3] and r.kept == kept[r.doc_id]


def viterbi(name, counts, total):
    best = [(0.0, [])]
    for end in range(1, len(name) + 1):
        options = []
        for start in range(end):
            word = name[start:end]
            p = math.log(counts[word] / total) if word in counts else math.log(10 / total) - len(word) * math.log(10)
            options.append((best[start][0] + p, best[start][1] + [word]))
        best.append(max(options, key=lambda x: x[0]))
    return best[-1][1]


def test_op6_verdicts_of_the_method(spark):
    """Segmentation and naive Bayes by hand over the whole table."""
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    counts = collections.Counter()
    for r in pages:
        counts.update(set(regex.findall(r"\p{L}+", re.sub("<[^>]*>", " ", r.html or "").lower())))
    total = sum(counts.values())
    split, tokens = {}, {}
    own = {"host:com", "host:example", "host:net", "host:www", "path:en", "path:es", "path:fr"}
    for r in pages:
        host, path, _, _ = brute_url(r.url)
        words = []
        for name in set(regex.findall(r"\p{L}+", host)):
            split.setdefault(name, viterbi(name, counts, total))
            words += [f"host:{w}" for w in split[name]]
        words += [f"path:{w}" for w in regex.findall(r"[\p{L}0]+", re.sub("[0-9]+", "0", path.lower()))]
        tokens[r.page_id] = [w for w in words if w not in own]
    rows = op6_url_filters(spark, SF).collect()
    seen = {v: collections.Counter() for v in ("allow", "block")}
    pages_of = collections.Counter()
    for r in rows:
        if r.rule:
            seen[r.verdict].update(tokens[r.page_id])
            pages_of[r.verdict] += 1
    kinds = len(seen["allow"] | seen["block"])
    n = {v: sum(c.values()) for v, c in seen.items()}
    judged = 0
    for r in rows:
        if not r.rule:
            score = math.log(pages_of["allow"] + 1) - math.log(pages_of["block"] + 1)
            for w in tokens[r.page_id]:
                if w in seen["allow"] or w in seen["block"]:
                    score += math.log((seen["allow"][w] + 1) / (n["allow"] + kinds)) - math.log((seen["block"][w] + 1) / (n["block"] + kinds))
            if abs(score) > 1e-6:
                assert r.verdict == ("allow" if score >= 0 else "block"), (r.host, r.path, score)
                judged += 1
    assert judged > 10


def test_pipeline_stage_by_stage(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = [tuple(r) for r in spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality").collect()]
    stages = dict(corpus_pipeline.STAGES)
    kept, _ = brute_quality([tuple(r) for r in docs.select("doc_id", "lang", "text").collect()], labels)
    first = stages["quality_rules"](spark, docs, SF)
    rows = {r.doc_id: r for r in first.collect()}
    assert set(rows) == {d for d, k in kept.items() if k}
    groups = brute_components({d: r.text for d, r in rows.items()}, 5, 80)
    second = stages["ngram_join"](spark, spark.createDataFrame(list(rows.values()), docs.schema), SF)
    rows = {r.doc_id: r for r in second.collect()}
    assert set(rows) == {c for _, c in groups.values()}
    third = {r.doc_id: r for r in stages["pii"](spark, spark.createDataFrame(list(rows.values()), docs.schema), SF).collect()}
    assert set(third) == set(rows)
    plain = 0
    for d, r in rows.items():
        want, at = "", 0
        for kind, start, end in sorted(brute_spans(r.text or ""), key=lambda s: (s[1], -s[2])):
            if start >= at:
                want += (r.text or "")[at:start] + f"[{kind.upper()}]"
            at = max(at, end)
        want += (r.text or "")[at:]
        plain += third[d].text == want
        assert third[d].text == want or "[TERM]" in third[d].text or len(third[d].text) < len(want)
        assert third[d].n_chars == len(third[d].text) and third[d][2:4] == r[2:4]
    assert plain > 0.9 * len(rows)
    domain = {r.doc_id: r.d for r in docs.select("doc_id", domain_of().alias("d")).collect()}
    n = {d: len(WORD.findall(r.text)) for d, r in third.items()}
    leaf = {d: (domain[d], r.lang, r.source) for d, r in third.items()}
    _, budgets = brute_mix([(*leaf[d], n[d]) for d in third], WEIGHTS, 0.7, 1)
    fourth = {r.doc_id: r for r in stages["mixing"](spark, spark.createDataFrame(list(third.values()), docs.schema), SF).collect()}
    taken, longest = collections.Counter(), collections.Counter()
    for d, k in leaf.items():
        longest[k] = max(longest[k], n[d])
        taken[k] += n[d] * (d in fourth)
    assert all(fourth[d] == third[d] for d in fourth)
    for k, b in budgets.items():
        assert b - longest[k] - 1e-6 <= taken[k] <= b + 1e-6
    pieces = stages["packing"](spark, spark.createDataFrame(list(fourth.values()), docs.schema), SF).collect()
    check_pieces(pieces, {d: r.text for d, r in fourth.items()})
