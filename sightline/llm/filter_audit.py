"""How filters interact: every order of applying them, enumerated by a recursive query over cells of failure masks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import small, table, text_of

#: Letters of the filters, in the order of their bits.
LETTERS = "ABCDE"
WORD_GAP = r"[\x20\x09-\x0D]+"


def own_failures(text: Column) -> Column:
    """The bits of the filters A to D that a text fails, from the text alone.

    A: under 50 words; B: distinct words are under 65 % of the words; C: A-Z are over 5 % of the code points; D: holds a symbol of #$%&*|.
    """
    words = F.filter(F.split(text, WORD_GAP), lambda w: w != "")
    return F.transform(
        F.array(F.struct(F.size(words).alias("n"), F.size(F.array_distinct(words)).alias("d"))),
        lambda w: F.when(w["n"] < 50, 1).otherwise(0)
        + F.when(100 * w["d"].cast("long") < 65 * w["n"].cast("long"), 2).otherwise(0)
        + F.when(100 * F.regexp_count(text, F.lit("[A-Z]")).cast("long") > 5 * F.length(text).cast("long"), 4).otherwise(0)
        + F.when(text.rlike("[#$%&*|]"), 8).otherwise(0),
    )[0]


def mask_cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): for each part and each set of failed filters the documents, those of quality 1 and the toxic ones.

    docs(doc_id, part, text); labels(doc_id, quality, toxic), of several labels of an id any 1 counts. Filter E, bit 16: a smaller doc_id has the
    same text. Texts meet as SHA-256 digests. Copies of one text are first counted by part, bits and labels, with the smallest id of each such group, so
    a text that a third of all rows share is a few rows by the time that its smallest id is looked up. A row without an id is no one's
    predecessor and has none.
    """
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("_id"))
    marks = marks.agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("_good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("_toxic"))
    rows = docs.select(F.col("doc_id").cast("long").alias("_id"), F.coalesce(F.col("part").cast("string"), F.lit("")).alias("part"), text_of().alias("_text"))
    rows = rows.select("_id", "part", F.unhex(F.sha2("_text", 256)).alias("_same"), own_failures(F.col("_text")).alias("_bits"))
    rows = rows.join(small(marks), "_id", "left").fillna(False, ["_good", "_toxic"])
    ids = rows.groupBy("_id", "_same", "part", "_bits", "_good", "_toxic").agg(F.count("*").alias("_c"))
    known = F.col("_id").isNotNull().alias("_known")
    groups = ids.groupBy("_same", "part", "_bits", "_good", "_toxic", known).agg(F.sum("_c").alias("_n"), F.min(F.struct("_id", "_c")).alias("_least"))
    first = F.min(F.when(F.col("_known"), F.col("_least._id"))).over(Window.partitionBy("_same"))
    groups = groups.withColumn("_clean", F.when(~F.col("_known"), F.col("_n")).when(F.col("_least._id") == first, F.col("_least._c")).otherwise(F.lit(0)))
    both = groups.select("part", "_good", "_toxic", F.explode(F.array(
        F.struct(F.col("_bits").alias("mask"), F.col("_clean").alias("n")), F.struct((F.col("_bits") + 16).alias("mask"), (F.col("_n") - F.col("_clean")).alias("n"))
    )).alias("_cell")).where("_cell.n > 0")
    n = F.col("_cell.n")
    return both.groupBy("part", F.col("_cell.mask").cast("int").alias("mask")).agg(
        F.sum(n).alias("n"), F.sum(F.when(F.col("_good"), n).otherwise(0)).alias("good"), F.sum(F.when(F.col("_toxic"), n).otherwise(0)).alias("toxic")
    )


#: A prefix of an order is extended by each letter that it lacks; the bits applied so far go along, and each of the masks that
#: any cell has is carried through all prefixes. A level's rows are what its step does to the masks. 325 prefixes of five letters, and 32 masks at most.
STEPS = """
WITH RECURSIVE filters AS (
  SELECT substr('{letters}', id + 1, 1) AS letter, CAST(shiftleft(1, CAST(id AS INT)) AS INT) AS bit FROM range(length('{letters}'))
), steps(prefix, step, bit, applied, mask) AS (
  SELECT CAST('' AS STRING), 0, 0, 0, mask FROM {masks}
  UNION ALL
  SELECT concat(s.prefix, f.letter), s.step + 1, f.bit, s.applied + f.bit, s.mask FROM steps s JOIN filters f ON instr(s.prefix, f.letter) = 0
), metrics AS (
  SELECT c.part, s.prefix, s.step,
    sum(CASE WHEN s.mask & s.applied = 0 THEN c.n ELSE 0 END) AS kept,
    sum(CASE WHEN s.mask & s.applied = s.bit THEN c.n ELSE 0 END) AS removed,
    sum(CASE WHEN s.mask & s.bit <> 0 AND s.mask & s.applied <> s.bit THEN c.n ELSE 0 END) AS redundant,
    sum(CASE WHEN s.mask = s.bit THEN c.n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN s.mask & s.applied = s.bit THEN c.good ELSE 0 END) AS good_lost,
    sum(CASE WHEN s.mask & s.applied = s.bit THEN c.toxic ELSE 0 END) AS toxic_lost
  FROM steps s JOIN {cells} c ON s.mask = c.mask WHERE s.step > 0 GROUP BY c.part, s.prefix, s.step
), orders AS (
  SELECT DISTINCT prefix AS filter_order, substr(prefix, 1, n) AS prefix FROM (SELECT prefix, explode(sequence(1, length('{letters}'))) AS n FROM steps WHERE step = length('{letters}'))
)
SELECT m.part, o.filter_order, m.step, m.kept, m.removed, m.redundant, m.unique_fails, m.good_lost, m.toxic_lost,
  sum(m.removed) OVER (PARTITION BY m.part, substr(o.prefix, m.step, 1)) AS shapley
FROM metrics m JOIN orders o ON m.prefix = o.prefix
"""


def interactions(cells: DataFrame) -> DataFrame:
    """Per part, order of the filters and step: what stays, goes, is redundant, fails this filter only, and what good and toxic documents go.

    cells(part, mask, n, good, toxic). shapley is what the step's filter removes, summed over all orders. Cells are a few rows a part, whatever the documents; a
    part's 600 rows come even where nothing fails. No cells, no rows.
    """
    from .common import checkpointed

    cells = checkpointed(cells)
    return cells.sparkSession.sql(STEPS.replace("{letters}", LETTERS), cells=cells, masks=cells.select("mask").distinct())


def filter_audit(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """The audit of five filters over docs(doc_id, text and a part), for each part.

    A null or empty text has no words: it fails A, and E if a smaller id has none either; a null part is the empty string. Repeated rows are documents each, and
    rows that share an id don't precede one another. Words end at ASCII white space and differ by case; texts of any length are read
    whole, without Python. Other columns are left out, whatever their names; a table without rows gives none.
    """
    return interactions(mask_cells(docs.select("doc_id", F.col(part).alias("part"), "text"), labels.select("doc_id", "quality", "toxic")))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP12_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), marked AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id
), f AS (
  SELECT part, [len(w) < 50, 100 * len(list_distinct(w)) < 65 * len(w), 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 5 * length(text), regexp_matches(text, '[#$%&*|]'),
      coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false)] AS fail, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic
  FROM d LEFT JOIN marked USING (doc_id)
), c AS (SELECT part, fail, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY ALL
), o AS (
  SELECT '' AS o UNION ALL SELECT o || l FROM o, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l) WHERE NOT contains(o, l)
), s AS (
  SELECT o AS filter_order, CAST(step AS INTEGER) AS step, list_transform(range(1, step + 1), lambda i: CAST(strpos('ABCDE', o[i]) AS INTEGER)) AS used FROM o, (SELECT unnest(range(1, 6)) AS step) WHERE length(o) = 5
), r AS (
  SELECT part, filter_order, step, used[step] AS own, fail[used[step]] AS hit, list_bool_or(list_transform(used[:step - 1], lambda i: fail[i])) IS TRUE AS gone, len(list_filter(fail, lambda x: x)) AS fails, n, good, toxic FROM s, c
), m AS (
  SELECT part, filter_order, step, own, CAST(coalesce(sum(n) FILTER (NOT gone AND NOT hit), 0) AS BIGINT) AS kept, CAST(coalesce(sum(n) FILTER (hit AND NOT gone), 0) AS BIGINT) AS removed,
    CAST(coalesce(sum(n) FILTER (hit AND gone), 0) AS BIGINT) AS redundant, CAST(coalesce(sum(n) FILTER (hit AND fails = 1), 0) AS BIGINT) AS unique_fails,
    CAST(coalesce(sum(good) FILTER (hit AND NOT gone), 0) AS BIGINT) AS good_lost, CAST(coalesce(sum(toxic) FILTER (hit AND NOT gone), 0) AS BIGINT) AS toxic_lost
  FROM r GROUP BY part, filter_order, step, own
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM m
"""
