"""JSON lines and delimited text: tolerant scans and plain sinks."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.jsons import json_mended


def json_lines(spark: SparkSession, path: str, schema: str, key: str | None = None, order: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Good rows, and broken lines (`_corrupt`), of JSON-lines files.

    With a key the last row by `order` counts, as after a resumed run whose
    last line may be cut short.
    """
    rows = spark.read.schema(f"{schema}, _corrupt string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    parsed = spark.read.text(path).select(F.from_json("value", f"{schema}, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"}).alias("r"), F.trim("value").alias("v"))
    parsed = parsed.where("v <> ''").select("r.*")
    good, bad = parsed.where("_corrupt is null").drop("_corrupt"), parsed.where("_corrupt is not null").select("_corrupt")
    if key:
        newest = Window.partitionBy(key).orderBy(F.col(order).desc())
        good = good.withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n")
    return good.select(*[c for c in rows.columns if c != "_corrupt"]), bad


#: The sign in front of or between the values of a JSON text sequence (RFC 7464); no JSON holds it unescaped.
SEPARATOR = "\x1e"


def json_rows(spark: SparkSession, path: str, schema: str, sequence: bool = False) -> DataFrame:
    """Rows of JSON files that hold a list, an object whose `data` or `rows` is one, or a single object.

    A file is one value, or with `sequence` any number of them, parted by
    SEPARATOR; broken ones are mended, those beyond mending give no rows. Read
    by Spark's reader, one value at a time; files of sequences are split.
    """
    reader = spark.read.option("lineSep", SEPARATOR) if sequence else spark.read.option("wholetext", True)
    values = reader.text(path).select(json_mended(F.col("value")).alias("j"))
    opened = values.select(F.try_parse_json("j").alias("v"))
    held = lambda at: F.expr(f"try_variant_get(v, '{at}', 'array<variant>')")
    rows = F.coalesce(held("$"), held("$.data"), held("$.rows"), F.when(F.schema_of_variant("v").startswith("OBJECT"), F.array("v")))
    return opened.select(F.explode(rows).alias("r")).select(F.from_json(F.to_json("r"), schema).alias("r")).where("r is not null").select("r.*")


def write_json_lines(df: DataFrame, path: str, append: bool = False) -> None:
    """Rows as JSON lines, nulls kept as such; a run that appends leaves what is there."""
    df.write.option("ignoreNullFields", False).mode("append" if append else "overwrite").json(path)


def write_manifest(spark: SparkSession, path: str, facts: dict, counts: DataFrame | None = None) -> None:
    """One JSON object: facts, and `counts` (name, n) under their names; a few numbers, written as one line."""
    told = dict(facts) | ({"counts": {r["name"]: r["n"] for r in counts.orderBy("name").limit(10_000).collect()}} if counts is not None else {})
    spark.createDataFrame([(json.dumps(told, sort_keys=True, ensure_ascii=False),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def delimited(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """A table with a header; blank names become column_i, blank rows go, a byte-order mark is not seen."""
    df = spark.read.option("sep", sep).option("header", True).option("multiLine", True).option("encoding", "UTF-8").csv(path)
    names = [c.lstrip("﻿").strip() for c in df.columns]
    names = [f"column_{i}" if not n or n.startswith("_c") and n[2:].isdigit() else n for i, n in enumerate(names)]
    df = df.toDF(*apart(names))
    return df.where(F.coalesce(*(F.nullif(F.trim(F.col(f"`{c}`")), F.lit("")) for c in df.columns)).isNotNull())


def apart(names: list[str]) -> list[str]:
    """Equal names get _2, _3, ..."""
    seen: dict[str, int] = {}
    out = []
    for n in names:
        seen[n] = seen.get(n, 0) + 1
        out.append(n if seen[n] == 1 else f"{n}_{seen[n]}")
    return out


def write_csv(df: DataFrame, path: str) -> None:
    """Nulls as N/A; columns that are null throughout are left out, which takes one aggregation."""
    held = df.agg(*(F.count(F.col(f"`{c}`")).alias(str(i)) for i, c in enumerate(df.columns))).first()
    df.select(*(F.col(f"`{c}`") for i, c in enumerate(df.columns) if held[i])).write.option("header", True).option("nullValue", "N/A").csv(path)


def quarantined(df: DataFrame, reason, kept_path: str, rejected_path: str) -> None:
    """Rows without a reason to one folder, the others with it to another, by reason."""
    marked = df.withColumn("reason", reason)
    marked.where("reason is null").drop("reason").write.json(kept_path)
    marked.where("reason is not null").write.partitionBy("reason").json(rejected_path)


def markdown(df: DataFrame, table: str, order: str, columns: list[str]) -> DataFrame:
    """(table, markdown): each small table as Markdown, pipes escaped, line ends as spaces."""
    cell = lambda c: F.regexp_replace(F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")), r"[\r\n]+", " ")
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *map(cell, columns)), F.lit(" |"))
    head = f"| {' | '.join(columns)} |\n|{' --- |' * len(columns)}\n"
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, line.alias("l")))), lambda s: s["l"]), "\n")
    return df.groupBy(table).agg(F.concat(F.lit(head), lines).alias("markdown"))
