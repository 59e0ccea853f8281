"""Sinks: JSON lines by video, one JSON document, quoted text; Spark's committer replaces outputs as a whole."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def write_json_lines(rows: DataFrame, path: str, by: str = "video_id") -> int:
    """Rows as JSON lines in a folder for each video, replacing what was there; the number of rows, counted as they are written."""
    seen = Observation("written")
    rows.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").partitionBy(by).json(path)
    return seen.get["n"]


def write_documents(rows: DataFrame, key: str, path: str) -> None:
    """One JSON object a line, {"key": {...}}."""
    rows.select(F.to_json(F.create_map(F.col(key).cast("string"), F.struct(*rows.columns))).alias("value")).write.mode("overwrite").text(path)


def write_maps(rows: DataFrame, keys: Sequence[Column], entry: Column, value: Column, path: str) -> None:
    """Lines of nested JSON maps {"key": {"entry": value, ...}}; entries of equal keys share a line as far as a task's batch of rows has them, so no line has more than a batch.

    Many entries stand in a line because a line costs its reader more than a short entry does: 5.9 million masks were parsed in 19 s with a line each, in 10 s with shared lines.
    """
    names = [f"key{i}" for i in range(len(keys))]

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            entries = pc.utf8_slice_codeunits(batch.column("entry"), 1, -1)  # without a map's braces
            grouped = pa.table([*(batch.column(n) for n in names), entries], [*names, "entry"]).group_by(names, use_threads=False).aggregate([("entry", "list")])
            joined = pc.binary_join(grouped.column("entry_list").combine_chunks(), ",").to_pylist()
            out = []
            for *path_of, text in zip(*(grouped.column(n).to_pylist() for n in names), joined, strict=True):
                if None in path_of:
                    raise ValueError("a map's key is null")
                out.append("".join(f"{{{json.dumps(k, ensure_ascii=False)}:" for k in path_of) + "{" + text + "}" * (len(names) + 1))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])

    texts = rows.select(*(k.alias(n) for k, n in zip(keys, names, strict=True)), F.to_json(F.create_map(entry, value)).alias("entry"))
    texts.mapInArrow(lines, "value string").write.text(path)


def quoted(text: Column) -> Column:
    """A double-quoted YAML string."""
    return F.concat(F.lit('"'), F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))


def inline_list(values: Column) -> Column:
    """Numbers with six places in brackets."""
    return F.concat(F.lit("["), F.array_join(F.transform(values, lambda x: F.format_string("%.6f", x)), ", "), F.lit("]"))


def write_yaml(rows: DataFrame, key: str, numbers: str, path: str) -> None:
    rows.select(F.concat(quoted(F.col(key)), F.lit(": "), inline_list(F.col(numbers))).alias("value")).write.mode("overwrite").text(path)
