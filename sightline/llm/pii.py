"""Personal data: patterns, and terms that reveal them by corpus co-occurrence. DataFrame and SQL functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, again, aside, called, checkpointed, table, text_of

KINDS = ("email", "ip", "card", "phone")
#: What stands in the text for a digit's separator while cards are looked for; one in the text itself stands as a letter.
JOINT = "\\u0001"
#: Each matches the base pattern's leftmost non-overlapping matches in linear time: a match that could only start
#: inside a run of its first characters starts where the run does, or where the last match ended; loops never give back, so long
#: matches need no stack.
PATTERNS = {
    "email": r"(?:\\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\\G|(?<![0-9]))[0-9]++\\.[0-9]++\\.[0-9]++\\.[0-9]++",
    "card": rf"(?<![0-9{JOINT}])[0-9{JOINT}]{{16,37}}(?![0-9{JOINT}])",
    "phone": r"\\+[0-9][\\x20().0-9-]+[0-9]",
}
TRIGGERS = {"email": "contains({t}, '@')", "ip": "{t} rlike '[0-9][.][0-9]'", "card": "{t} rlike '[0-9][- ]?[0-9]'", "phone": "{t} rlike '[+][0-9]'"}
PART = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
DIGITS = "regexp_replace(x.value, '[^0-9]', '')"
LUHN = (
    "aggregate(sequence(1, length(d)), 0, (a, i) -> a + element_at(array(0, 2, 4, 6, 8, 1, 3, 5, 7, 9, 0, 1, 2, 3, 4, 5, 6, 7, 8, 9),"
    " cast(substring(d, length(d) - i + 1, 1) as int) + if(i % 2 = 0, 1, 11))) % 10 = 0"
)
CHECKS = {
    "email": "true",
    "ip": rf"x.value rlike '^{PART}(?:[.]{PART}){{3}}$'",
    "card": f"exists(array({DIGITS}), d -> length(d) between 16 and 19 and {LUHN})",
    "phone": f"length({DIGITS}) between 8 and 15",
}
#: Words that can reveal: runs of letters, of so many at least.
SHORTEST_TERM = 3
WORD_SPLIT = "[^\\\\p{L}]+"
TEXT_TERMS = f"array_distinct(split(lower(coalesce(text, '')), '{WORD_SPLIT}'))"


#: Matches whose lengths are added up at once; a place is the sum of the stretches before its own and of the lengths within that.
STRETCH = 256


def located(text: str, pattern: str) -> str:
    """SQL for the array of (start, value) of a pattern's matches: the lengths of matches and of the pieces between them give the places."""
    total = "aggregate({}, 0, (a, x) -> a + x)".format
    return f"""
        element_at(transform(array(named_struct('m', regexp_extract_all({text}, {pattern}, 0), 'p', transform(split({text}, {pattern}, -1), x -> length(x)))),
          s -> if(size(s.m) = 0, cast(array() as array<struct<start: int, value: string>>),
            element_at(transform(array(transform(sequence(0, size(s.m) - 1), i -> s.p[i] + if(i = 0, 0, length(s.m[i - 1])))),
              n -> element_at(transform(array(transform(sequence(0, (size(n) - 1) div {STRETCH}), k -> {total(f"slice(n, int(k) * {STRETCH} + 1, {STRETCH})")})),
                t -> element_at(transform(array(transform(sequence(0, size(t) - 1), k -> {total("slice(t, 1, k)")})),
                  u -> transform(sequence(0, size(n) - 1), i -> named_struct(
                    'start', u[int(i div {STRETCH})] + {total(f"slice(n, int(i div {STRETCH}) * {STRETCH} + 1, i % {STRETCH} + 1)")}, 'value', s.m[i]))), 1)), 1)), 1))), 1)"""


def kind_spans(kind: str, text: str) -> str:
    """SQL for the spans of one kind: (kind, start, end, value)."""
    where = f"regexp_replace(translate({text}, '{JOINT}', 'x'), '(?<=[0-9])[- ](?=[0-9])', '{JOINT}')" if kind == "card" else text
    return f"""
        if({TRIGGERS[kind].format(t=text)},
           transform(filter({located(where, f"'{PATTERNS[kind]}'")}, x -> {CHECKS[kind]}),
             x -> named_struct('kind', '{kind}', 'start', x.start, 'end', x.start + length(x.value), 'value', x.value)),
           cast(array() as array<struct<kind: string, start: int, end: int, value: string>>))"""


def base_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with `base`: the spans of all kinds in the order of KINDS, then by start."""
    docs = docs.withColumn("_text", text_of(text))
    for k in KINDS:
        docs = docs.withColumn(f"_{k}", F.expr(kind_spans(k, "_text")))
    return docs.withColumn("base", F.concat(*(f"_{k}" for k in KINDS))).drop("_text", *(f"_{k}" for k in KINDS))


def entity(value: str = "s.value", kind: str = "s.kind") -> str:
    return f"concat({kind}, ':', if({kind} = 'email' or {kind} = 'ip', lower({value}), regexp_replace({value}, '[^0-9]', '')))"


def held(df: DataFrame, column: str, rows: int = BROADCAST_ROWS, size: int = 32_000_000) -> DataFrame:
    """df, already materialised, with a broadcast hint if it has at most so many rows and bytes in the column; else Spark shuffles."""
    n, total = df.limit(rows + 1).agg(F.count("*"), F.sum(F.octet_length(F.col(column).cast("string")))).first()
    return F.broadcast(df) if n <= rows and (total or 0) <= size else df


def surroundings(spanned: DataFrame, reach: int) -> DataFrame:
    """(doc_id, entity, around): the whole words within reach of each protected entity; words that the window's edge or the entity itself cuts are left out."""
    left = f"substring(_text, greatest(1, s.start - {reach}), least({reach + 1}, s.start))"
    right = f"substring(_text, s.end + 1, {reach + 1})"
    left = f"if(s.start > {reach}, regexp_replace({left}, '^\\\\p{{L}}+', ''), {left})"
    right = f"if(length(_text) > s.end + {reach}, regexp_replace({right}, '\\\\p{{L}}+$', ''), {right})"
    left = f"if(s.value rlike '^\\\\p{{L}}', regexp_replace({left}, '\\\\p{{L}}+$', ''), {left})"
    right = f"if(s.value rlike '\\\\p{{L}}$', regexp_replace({right}, '^\\\\p{{L}}+', ''), {right})"
    each = spanned.where(F.size("base") > 0).select("doc_id", text_of().alias("_text"), F.explode("base").alias("s"))
    return each.selectExpr("doc_id", f"{entity()} as entity", f"concat({left}, '\\u0000', {right}) as around")


def revealing_terms(docs: DataFrame, spanned: DataFrame, reach: int = 80, contexts: int = 3, strength: float = 0.9, remove_at: float = 0.9) -> tuple[DataFrame, DataFrame]:
    """(term, action) of the terms that give away a protected entity near which they stand, and (doc_id, term) of the rows that hold them.

    docs: doc_id, text; spanned: the same rows with base. A term is a run of letters, lower-cased. A term and an entity meet in
    a document if the term stands, as a whole word, within `reach` characters of the entity. Over all documents:
    PMI(term; entity) = log p(entity | term) - log p(entity), which is at most the entity's information,
    -log p(entity), and reaches it when the term never occurs without the entity. A term discloses if it meets
    the entity in at least `contexts` different surroundings (copies of a passage are one, and near copies rarely are more), however many copies there are besides, and its PMI
    is at least `strength` of the entity's information. It is removed if p(entity | term) is at least
    remove_at, else generalised. The counts cover all documents.
    """
    near = checkpointed(surroundings(spanned, reach))  # a row for each span
    words = F.expr(f"array_distinct(split(lower(around), '{WORD_SPLIT}'))")
    met = near.select("doc_id", "entity", words.alias("words")).select("*", F.explode("words").alias("term")).where(F.length("term") >= SHORTEST_TERM)
    # Three min-hashes of the other words: near copies of a passage nearly all share them, independent surroundings don't.
    sketch = ", ".join(f"array_min(transform(array_remove(words, term), w -> xxhash64({i}, w)))" for i in range(3))
    met = met.select("doc_id", "entity", "term", F.expr(f"xxhash64({sketch})").alias("context"))
    of_entity = near.select("doc_id", "entity").distinct().groupBy("entity").agg(F.count("*").alias("with_entity"))
    total = docs.count()
    met = checkpointed(met.groupBy("doc_id", "entity", "term").agg(F.min("context").alias("context")))
    joint = met.groupBy("entity", "term").agg(F.count("*").alias("both"), F.countDistinct("context").alias("contexts")).where(F.col("contexts") >= contexts)
    # A term is in at least the documents where it stands near any entity; most terms can't disclose by that bound, and needn't be counted in all texts.
    bound = met.groupBy("term").agg(F.countDistinct("doc_id").alias("with_near"))
    informed = joint.join(of_entity, "entity").withColumn("information", F.expr(f"-log2(with_entity / {total}D)"))
    able = informed.join(bound, "term").where(f"log2(both / greatest(with_near, 1)) + information >= {strength} * information - 1e-9")
    joint = checkpointed(able.select("entity", "term", "both", "information"))
    terms = held(checkpointed(joint.select("term").distinct()), "term")
    found = checkpointed(docs.select("doc_id", F.explode(F.expr(TEXT_TERMS)).alias("term")).join(terms, "term", "left_semi"))
    marginal = found.groupBy("term").agg(F.count("*").alias("with_term"))
    scored = joint.join(marginal, "term").selectExpr("term", "both / with_term as posterior", "log2(both / with_term) + information as pmi", "information")
    disclosing = scored.where(f"pmi > 0 and pmi >= {strength} * information").groupBy("term").agg(
        F.when(F.max("posterior") >= remove_at, "remove").otherwise("generalise").alias("action")
    )
    return disclosing, found


def private_spans(docs: DataFrame, reach: int = 80, contexts: int = 3, strength: float = 0.9) -> DataFrame:
    """docs (doc_id, text, ...) with `base`, the pattern spans, and `terms`, the spans of revealing terms.

    Pattern spans: e-mail addresses, IP addresses, card numbers that pass Luhn, and telephone numbers, each kind leftmost and
    non-overlapping over the whole text. Term spans, of kind generalised or removed, never overlap those. A null or empty text has no
    spans; no rows give no rows. Rows with the same doc_id are masked for the terms that either has; a repeated row counts as one document
    beside an entity and as itself in a term's total, so repeats never make a term look more revealing. Rows without doc_id count as one. A term that ties between
    both actions is removed. Extra columns stay, whatever their names; those named base or terms are replaced. Texts of any length are read whole, in time linear in their length but
    for the square root of their matches.
    """
    kept = [c for c in docs.columns if c not in ("doc_id", "text", "base", "terms")]
    docs = docs.select("doc_id", "text", *aside(kept))
    narrow = docs.select("doc_id", "text")
    disclosing, found = revealing_terms(narrow, base_spans(narrow), reach, contexts, strength)
    found = checkpointed(found.select(F.col("doc_id").alias("_doc"), "term").join(held(checkpointed(disclosing), "term"), "term"))
    has = checkpointed(found.groupBy("_doc").agg(F.sort_array(F.collect_set(F.struct("term", "action"))).alias("_terms")))
    has = held(has.withColumn("_said", F.array_join(F.transform("_terms", lambda t: t["term"]), "|")), "_said", 100_000).drop("_said")
    spans = base_spans(docs)
    joined = spans.join(has, spans["doc_id"].eqNullSafe(has["_doc"]), "left")
    pattern = "concat('(?iu)(?<![\\\\p{L}])(?:', array_join(transform(_terms, x -> x.term), '|'), ')(?![\\\\p{L}])')"
    located_terms = f"""
        if(_terms is null, cast(array() as array<struct<kind: string, start: int, end: int, value: string>>),
           filter(transform({located("text", pattern)},
             x -> named_struct('kind', if(exists(_terms, t -> t.term = lower(x.value) and t.action = 'generalise'), 'generalised', 'removed'),
                               'start', x.start, 'end', x.start + length(x.value), 'value', x.value)),
             x -> not exists(base, b -> b.start < x.end and x.start < b.end)))"""
    return joined.withColumn("terms", F.expr(located_terms)).select("doc_id", "text", *again(kept), "base", "terms")


def listed(spans: str) -> str:
    return f"array_join(transform({spans}, s -> concat(s.kind, ':', s.start, ':', s.end)), ',')"


def sanitised(docs: DataFrame, **options) -> DataFrame:
    """docs with each private span of the text replaced: base kinds and generalised terms by [KIND], removed terms by nothing.

    Spans of two kinds that overlap are replaced as one, by what stands for the first.
    """
    columns = docs.columns
    kept = [c for c in columns if c not in ("doc_id", "text")]
    spanned = private_spans(docs.select("doc_id", "text", *aside(kept)), **options).withColumn(
        "_all", F.expr("array_sort(concat(base, terms), (a, b) -> case when a.start != b.start then a.start - b.start else b.end - a.end end)")
    )
    cut = """
        aggregate(_all, named_struct('at', 0, 'out', cast('' as string)),
          (acc, s) -> if(s.start >= acc.at,
            named_struct('at', s.end, 'out', concat(acc.out, substring(text, acc.at + 1, s.start - acc.at), case s.kind when 'removed' then '' when 'generalised' then '[TERM]' else concat('[', upper(s.kind), ']') end)),
            named_struct('at', greatest(acc.at, s.end), 'out', acc.out)),
          acc -> concat(acc.out, substring(text, acc.at + 1, length(text))))"""
    clean = F.when(F.size("_all") > 0, F.expr(cut)).otherwise(F.col("text"))
    return spanned.select("doc_id", clean.alias("text"), *again(kept)).select(*called(columns))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = private_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [F.expr(f"cast(size(filter(base, s -> s.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in KINDS]
    return spans.select(
        "doc_id", *counts,
        F.sha2(F.expr(listed("base")), 256).alias("base_sha256"),
        F.expr(listed("concat(base, array_sort(terms, (a, b) -> case when a.kind != b.kind then if(a.kind < b.kind, -1, 1) else a.start - b.start end))")).alias("spans"),
    )
