"""A user's columns may have any names: those that the operators use inside change nothing and stay as they are."""

import re
from pathlib import Path

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

import sightline.llm
from sightline.llm.mixing import mix, mixed_documents
from sightline.llm.pii import private_spans, sanitised
from sightline.llm.quality import quality_verdicts
from sightline.llm.sharding import interleave_shards
from sightline.llm.url_filters import judged_urls

SF = "/root/testdata/sf0.001"
SOURCES = "".join(p.read_text() for p in Path(sightline.llm.__file__).parent.glob("*.py")) + Path(corpus_pipeline.__file__).read_text()
#: Every name that a module quotes with an underscore before it, those that it makes of others, and some plain ones.
HELPERS = sorted(set(re.findall(r"[\"'](_[a-z]\w*)[\"']", SOURCES)) | {f"_{k}" for k in ("email", "ip", "card", "phone")} | {"__base", "key0", "stratum", "tokens", "budget", "c_cell", "b_lang", "a.b", "od`d"})
OPERATORS = {
    "sanitised": (sanitised, "documents"), "private_spans": (lambda d: private_spans(d).drop("base", "terms"), "documents"), "quality_verdicts": (lambda d: quality_verdicts(d, labels(d)).select(*(f"`{c.replace('`', '``')}`" for c in d.columns if c != "text"), "kept"), "documents"),
    "interleave_shards": (lambda d: interleave_shards(d, 5), "documents"), "mixed_documents": (mixed_documents, "documents"), "mix": (lambda d: mix(d, F.lit("web")), "documents"), "judged_urls": (judged_urls, "pages"),
} | {f"stage {name}": (lambda d, f=f: f(d.sparkSession, d, SF), "documents") for name, f in corpus_pipeline.STAGES}


def labels(d):
    return d.sparkSession.read.parquet(f"{SF}/labels.parquet")


@pytest.mark.parametrize("name", OPERATORS)
def test_names_of_helpers(spark, name):
    run, table = OPERATORS[name]
    plain = spark.read.parquet(f"{SF}/{table}.parquet")
    key = plain.columns[0]
    extra = [h for h in HELPERS if h not in plain.columns]
    wide = plain.select("*", *(F.concat(F.lit(f"{h} "), F.col(key).cast("string")).alias(h) for h in extra))
    want, got = run(plain), run(wide)
    quoted = lambda c: "`" + c.replace("`", "``") + "`"
    columns = [c for c in want.columns if c in got.columns]
    assert columns == want.columns
    rows = lambda d: sorted(map(str, d.select(*map(quoted, columns)).collect()))
    assert rows(got) == rows(want)
    kept = [h for h in extra if h in got.columns]
    assert kept == (extra if name not in ("mix", "stage packing") else [])
    if kept:
        wrong = F.lit(False)
        for h in kept:
            wrong = wrong | ~F.col(quoted(h)).eqNullSafe(F.concat(F.lit(f"{h} "), F.col(key).cast("string")))
        assert got.where(wrong).count() == 0
