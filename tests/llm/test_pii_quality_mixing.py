import hashlib
import math
import random
import re

import pytest

from sightline.llm.mixing import LEVELS, WEIGHTS, domain_of, mix, mixed_documents, op9_mixing, water_fill
from sightline.llm.pii import base_spans, op2_pii, private_spans, sanitised
from sightline.llm.quality import binomial_tail, certified_step, measures, op5_quality_rules, quality_verdicts, upper_bound

SF = "/root/testdata/sf0.001"
BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(sum(divmod(int(x) * (2 if i % 2 else 1), 10)) for i, x in enumerate(reversed(d))) % 10 == 0


def brute_spans(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {
                "email": True,
                "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else False,
                "card": 16 <= len(digits) <= 19 and luhn(digits),
                "phone": 8 <= len(digits) <= 15,
            }[kind]
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


ODD = [
    None, "", "a.b@c.d_e@f.g", "a@b.c.d@e.f x@y.z", "@@a@b.c", "x" * 3000, "a@b", "1.2.3.4.5.6.7.8", "256.1.1.1 0255.1.1.1 1.1.1.1", "00001.2.3.4",
    "4111 1111 1111 1111", "4111-1111-1111-1111 12", "4111111111111111é4111 1111 1111 1111", "1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 7", "4111 1111  1111 1111",
    "+1 (202) 555-0100.", "+1-", "+12345678", "++123456789+12345678 +1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6", "🎉 a@b.co 🎉 +49 30 1234567", "x\u00014111\u0001111111111111",
    "4111 1111 1111 1111-+4111 1111 1111 1111", "9" * 4000, "1 " * 3000, "mail:a@b.c,d@e.f", "10.0.0.1@host.com 192.168.0.1", "+1" * 500, "4111111111111111\n4111111111111111",
]


def listed(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def test_base_spans_against_brute_force(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()} | {100_000 + i: t for i, t in enumerate(ODD)}
    docs = spark.createDataFrame([(d, t, "x") for d, t in texts.items()], "doc_id long, text string, base string")
    rows = private_spans(docs.drop("base")).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert [(s.kind, s.start, s.end) for s in r.base] == brute_spans(texts[r.doc_id] or ""), (texts[r.doc_id] or "")[:90]


def test_op2_columns(spark):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in op2_pii(spark, SF).collect():
        want = brute_spans(texts[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in want) for k in BASE]
        assert r.base_sha256 == hashlib.sha256(listed(want).encode()).hexdigest()
        assert r.spans.startswith(listed(want))


def test_revealing_terms(spark):
    filler = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
    rows = [(i, " ".join(filler[(i + j) % 10] for j in range(8))) for i in range(200)]
    # A nickname that stands only by one address, in different surroundings; a common word stands there as well.
    for i in range(5):
        rows.append((300 + i, f"{filler[i]} {filler[i + 1]} Zorblat zorb.lat@mail.example.com {filler[i + 2]} alpha"))
    rows += [(400 + i, "one copied passage Quuxly quux@mail.example.com and nothing more") for i in range(9)]
    for i in range(4):
        rows.append((350 + i, f"{filler[i]} Wibblet wib@mail.example.com {filler[i + 3]} beta"))
    rows += [(500, "a page on ZORBLAT and Zorblatt"), (501, None), (502, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: [(s.kind, s.value) for s in r.terms] for r in private_spans(docs).collect()}
    assert {d for d, x in found.items() if x} == {*range(300, 305), *range(350, 354), 500}
    assert found[500] == [("generalised", "ZORBLAT")] and found[351] == [("removed", "Wibblet")]
    clean = {r.doc_id: r.text for r in sanitised(docs).collect()}
    assert clean[300] == "alpha beta [TERM] [EMAIL] gamma alpha" and clean[500] == "a page on [TERM] and Zorblatt" and clean[351] == "beta  [EMAIL] epsilon beta"
    assert clean[501] is None and clean[502] == "" and clean[0] == rows[0][1]
    assert sanitised(docs.limit(0)).count() == 0


def test_near_copies_dont_hide_a_term_that_surroundings_disclose(spark):
    filler = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
    rows = [(i, " ".join(filler[(i + j) % 10] for j in range(8))) for i in range(200)]
    rows += [(300 + i, f"{filler[i]} {filler[i + 1]} Zorblat zorb.lat@mail.example.com {filler[i + 2]} alpha") for i in range(5)]
    copies = [(400 + i, f"passage {i} copied: Zorblat zorb.lat@mail.example.com, and no. {i} more") for i in range(20)]
    copies_only = [(500 + i, f"passage {i} copied: Quuxly quux@mail.example.com, and no. {i} more") for i in range(20)]
    docs = spark.createDataFrame([*rows, *copies, *copies_only, (600, "a page on Zorblat and Quuxly")], "doc_id long, text string")
    found = {r.doc_id: [s.value for s in r.terms] for r in private_spans(docs).collect()}
    assert found[600] == ["Zorblat"]
    assert {d for d, x in found.items() if x} == {*range(300, 305), *range(400, 420), 600}


def test_sanitised_overlaps_and_extra_columns(spark):
    docs = spark.createDataFrame([(1, "call +4111111111111111 or 4111 1111 1111 1111 x", 5)], "doc_id long, text string, terms int")
    row = sanitised(docs).first()
    assert row.text == "call +[CARD] or [CARD] x" and row.terms == 5


def brute_measures(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = {}
    for i in range(len(words) - 7):
        windows.setdefault(tuple(words[i : i + 8]), []).append(i)
    covered = {i + j for at in windows.values() if len(at) > 1 for i in at for j in range(8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_measures_against_brute_force(spark):
    texts = [r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    for t in [*texts, "", " \n\t", "a b " * 30, "é à " * 20 + " x", "x\n\nx\n x\nx\r\n", "#|<>", "1 2 3 4 5 6 7 8 1 2 3 4 5 6 7 8 9", "🎉 " * 9, "\x1c a\x85b"]:
        assert measures(t)[:5] == brute_measures(t), t[:60]


def test_exact_bounds():
    assert binomial_tail(0, 10, 0.1) == pytest.approx(0.9**10)
    assert binomial_tail(2, 5, 0.5) == pytest.approx(0.5)
    assert upper_bound(0, 100, 0.05) == pytest.approx(1 - 0.05 ** (1 / 100), abs=1e-9)
    assert upper_bound(5, 5, 0.05) == 1.0
    k = certified_step([0, 0, 1, 3, 9, 30], 1000, 0.01, 0.01)
    assert k == 3 - (binomial_tail(3, 1000, 0.01) > 0.01)
    assert certified_step([0, 0], 10, 0.01, 0.01) is None


def test_op5_base_and_clean_documents(spark):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = op5_quality_rules(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        m = brute_measures(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == m
        assert r.base_failed == (m[0] < 20 or 100 * m[4] > 30 * m[0])
        assert not (r.base_failed and r.kept)


def test_risk_controlled_cutoffs_reject_junk_and_keep_good(spark):
    good = " ".join(f"word{i}" for i in range(60))
    junk = " ".join(f"w{i}###$$" for i in range(60))
    rows = [(i, "en" if i % 2 else None, good, 1) for i in range(4000)] + [(9000 + i, "en", junk, 0) for i in range(50)] + [(9900, "xx", junk, 0), (9901, "en", None, 0)]
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id long, lang string, text string")
    labels = spark.createDataFrame([(r[0], r[3]) for r in rows] + [(0, 0), (None, 1), (2, None)], "doc_id long, quality int")
    out = {r.doc_id: r.kept for r in quality_verdicts(docs, labels).collect()}
    assert all(out[i] for i in range(4000))
    assert not any(out[9000 + i] for i in range(50))
    assert out[9900] and not out[9901]  # no holdout for xx: only the base rules
    none = quality_verdicts(docs, labels.limit(0)).where("kept").count()
    assert none == 4051
    assert quality_verdicts(docs.limit(0), labels).count() == 0
    large = spark.createDataFrame([(2**62 + 1, "en", good), (None, "en", good)], "doc_id long, lang string, text string").coalesce(1)
    assert {r.doc_id for r in quality_verdicts(large, labels).collect()} == {2**62 + 1, None}


def test_water_fill():
    assert water_fill(10, [1, 1], [100, 100]) == [5, 5]
    assert water_fill(10, [1, 1, 2], [1, 100, 100]) == pytest.approx([1, 3, 6])
    assert water_fill(10, [1, 1], [2, 3]) == [2, 3]
    assert water_fill(10, [0, 1], [50, 50]) == [0, 10]


def brute_mix(rows, weights, share, epochs):
    """Taken tokens allowed for each leaf, by recursion over the tree."""
    leaves = {}
    for r in rows:
        leaves[r[:3]] = leaves.get(r[:3], 0) + r[3]

    def fill(prefix, budget):
        if len(prefix) == 3:
            return {prefix: budget}
        names = sorted({k[len(prefix)] for k in leaves if k[: len(prefix)] == prefix})
        w = [weights.get(LEVELS[len(prefix)], {}).get(x, 1.0) for x in names]
        able = lambda k: all(weights.get(level, {}).get(x, 1.0) > 0 for level, x in zip(LEVELS, k, strict=True))
        caps = [epochs * sum(v for k, v in leaves.items() if k[: len(prefix) + 1] == (*prefix, x) and able(k)) for x in names]
        out = {}
        for x, b in zip(names, water_fill(budget, w, caps), strict=True):
            out |= fill((*prefix, x), b)
        return out

    return leaves, fill((), share * sum(leaves.values()))


def test_mix_takes_prefixes_up_to_the_budget(spark):
    weights = {"domain": {"a": 0.7, "b": 0.3}, "lang": {"en": 2.0}}
    docs = spark.range(6000).selectExpr(
        "id as doc_id", "repeat('w ', cast(id % 13 as int)) as text", "case when id % 5 = 0 then 'de' else 'en' end as lang",
        "case when id % 3 = 0 then 'hot' else concat('s', id % 7) end as source",
    )
    domain = "case when source in ('hot', 's1') then 'b' else 'a' end"
    from pyspark.sql import functions as F

    out = mix(docs, F.expr(domain), weights, budget_share=1.5, max_epochs=3, seed=4).collect()
    rows = [(r.d, r.lang, r.source, r.n) for r in docs.selectExpr(f"{domain} as d", "lang", "source", "id % 13 as n" if False else "doc_id % 13 as n").collect()]
    leaves, budgets = brute_mix(rows, weights, 1.5, 3)
    taken, per = {}, {}
    for r in out:
        k = (r.domain, r.lang, r.source)
        taken[k] = taken.get(k, 0) + r.n_tokens
        per.setdefault((r.doc_id), []).append(r.epoch)
    for k, b in budgets.items():
        assert b - 13 - 1e-6 <= taken.get(k, 0) <= b + 1e-6, (k, b, taken.get(k))
    assert all(sorted(e) == list(range(len(e))) and len(e) <= 3 for e in per.values())
    again = mix(docs, F.expr(domain), weights, budget_share=1.5, max_epochs=3, seed=4).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, out))


def test_mix_edge_cases(spark):
    docs = spark.createDataFrame([(1, None, None, None), (1, "a b", "en", "src1"), (1, "a b", "en", "src1"), (None, "", "en", "x")], "doc_id long, text string, lang string, source string")
    assert mix(docs, domain_of(), budget_share=9, max_epochs=2).where("n_tokens = 2").count() == 4
    assert mix(docs.limit(0), domain_of()).count() == 0
    kept = mixed_documents(docs, budget_share=1.0)
    assert kept.columns == docs.columns and kept.count() == 4
    assert kept.select("doc_id", "text").subtract(docs.select("doc_id", "text")).count() == 0


def test_zero_weights_leave_their_tokens_to_others(spark):
    """A leaf that can take nothing is no capacity of its ancestors: their siblings get what it would have."""
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(i, "w " * 10, "en" if i < 10 else "de", "src0" if i < 60 else "src12") for i in range(120)], "doc_id long, text string, lang string, source string")
    weights = {"domain": {"web": 0.5, "forum": 0.5}, "lang": {"de": 0.0}}
    taken = mix(docs, domain_of(), {"domain": weights["domain"], "lang": {"de": 0.0, "*": 1.0}}, budget_share=0.5, max_epochs=1)
    assert taken.count() == 10  # all of English, as the forum has none
    weights = {"domain": {"web": 0.5, "forum": 0.5}, "source": {"src0": 0.0}}
    taken = mix(docs, domain_of(), weights, budget_share=0.5, max_epochs=1).groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()
    assert [(r.source, r.n) for r in taken] == [("src12", 600)]


def test_op9_against_brute_force(spark):
    """The query's takings per leaf, and each leaf's prefix in its seeded order, on the whole small table."""
    import re

    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", domain_of().alias("d")).collect()
    n = {r.doc_id: len(re.findall("[^\x20\x09-\x0D]+", r.text or "")) for r in rows}
    leaves, budgets = brute_mix([(r.d, r.lang, r.source, n[r.doc_id]) for r in rows], WEIGHTS, 1.0, 4)
    taken, epochs = {}, {}
    for r in op9_mixing(spark, SF).collect():
        k = (r.domain, r.lang, r.source)
        assert r.n_tokens == n[r.doc_id]
        taken[k] = taken.get(k, 0) + r.n_tokens
        epochs.setdefault(r.doc_id, []).append(r.epoch)
    longest = {}
    for r in rows:
        k = (r.d, r.lang, r.source)
        longest[k] = max(longest.get(k, 0), n[r.doc_id])
    for k, b in budgets.items():
        assert b - longest[k] - 1e-6 <= taken.get(k, 0) <= b + 1e-6, (k, b, taken.get(k))
    assert all(sorted(e) == list(range(len(e))) for e in epochs.values())
    for r in rows:  # whole epochs take every document
        k = (r.d, r.lang, r.source)
        if leaves[k]:
            assert len(epochs.get(r.doc_id, [])) in (int(budgets[k] / leaves[k] + 1e-9), int(budgets[k] / leaves[k] + 1e-9) + 1)


LONG = {"domain": "x@" + "a." * 100_000 + "com", "numbers": "1." * 400_000, "letters": "a" * 2_000_000, "spaces": " " * 2_000_000}


@pytest.mark.parametrize(("name", "kinds"), [("domain", ["email"]), ("numbers", ["ip"] * 100_000), ("letters", []), ("spaces", [])])
def test_long_texts_have_all_their_spans(spark, name, kinds):
    t = LONG[name]
    found = base_spans(spark.createDataFrame([(1, t)], "doc_id long, text string")).select("base.kind", "base.start", "base.end").first()
    assert list(found.kind) == kinds
    if name == "numbers":
        assert list(found.start) == list(range(0, 800_000, 8)) and list(found.end) == list(range(7, 800_000, 8))
    if name == "domain":
        assert (found.start, found.end) == ([0], [len(t)])


def test_words_that_the_window_cuts_are_no_terms(spark):
    """Six windows end within `catalogue`; the unrelated document keeps its cat."""
    fill = ("aa bb " * 20)[:75] + " "
    texts = ["plain text"] + [f"{w} joe@corp.com {fill}catalogue" for w in ("red", "blue", "green", "pink", "grey", "gold")] + ["my cat sleeps"] * 2 + ["other words here"] * 40
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r.doc_id: r for r in private_spans(docs).collect()}
    assert not out[7].terms and not out[8].terms


def test_disclosure_against_brute_force(spark):
    """Terms and actions equal those counted by hand over all documents."""
    import re

    from sightline.llm.pii import revealing_terms

    rng = random.Random(3)
    common = [f"{a}{b}" for a in ("lor", "ips", "dol", "sit", "amet") for b in ("em", "um", "or", "is", "an")]
    docs = []
    for i in range(300):
        words = rng.sample(common, 12)
        if i % 4 == 0:
            words.insert(rng.randrange(12), ["ann@mail.org", "10.0.0.7", "+49 30 1234567"][i % 3])
            words.insert(rng.randrange(13), ["kestrel", "falcon", "plover"][i % 3])
        elif i % 40 == 3:
            words.insert(3, "plover")
        docs.append((i, " ".join(words)))
    got, _ = revealing_terms(spark.createDataFrame(docs, "doc_id long, text string"), base_spans(spark.createDataFrame(docs, "doc_id long, text string")))
    with_term, both, of = {}, {}, {}
    for i, t in docs:
        for w in set(re.split("[^a-z]+", t.lower())):
            with_term.setdefault(w, set()).add(i)
        m = re.search(r"[a-z]+@[a-z.]+|10\.0\.0\.7|\+[0-9 ]+[0-9]", t)
        if m:
            of.setdefault(m[0], set()).add(i)
            left, right = t[max(0, m.start() - 80) : m.start()], t[m.end() : m.end() + 80]
            left = re.sub("^[a-z]+", "", t[m.start() - 81] + left) if m.start() > 80 else left
            right = re.sub("[a-z]+$", "", right + t[m.end() + 80]) if m.end() + 80 < len(t) else right
            for w in set(re.findall("[a-z]{3,}", left + " " + right)):
                both.setdefault((m[0], w), set()).add(i)
    want = {}
    for (e, w), d in both.items():
        information = -math.log2(len(of[e]) / len(docs))
        posterior = len(d) / len(with_term[w])
        assert posterior <= 1
        pmi = math.log2(posterior) + information
        if len(d) >= 3 and pmi > 0 and pmi >= 0.9 * information:
            want[w] = max(want.get(w, 0), posterior)
    assert {r.term: r.action for r in got.collect()} == {w: "remove" if p >= 0.9 else "generalise" for w, p in want.items()}
    assert "kestrel" in want
