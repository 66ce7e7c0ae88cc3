"""Readers and writers: lenient CSV, strict and lenient JSON lines, markdown vaults, ZIP members, exclusive sinks."""

from __future__ import annotations

import io
import json
import re
import uuid
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


BOM = "\ufeff"


def _files(spark: SparkSession, path: str):
    """Hadoop path and file system of ``path``."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    where, files = _files(spark, path)
    return files.exists(where)


def read_csv_first(spark: SparkSession, path: str, schema: str, n: int) -> DataFrame:
    """The first ``n`` rows of a CSV file with a header; a missing file has none."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.option("header", True).schema(schema).csv(path).limit(n)


def read_csv_lenient(spark: SparkSession, path: str, text: list[str], numbers: list[str], limit: int | None = None) -> DataFrame:
    """CSV with a header; numeric fields that cannot be read become 0, a byte-order mark is dropped; ``limit`` rows at most."""
    schema = StructType([StructField(c, StringType()) for c in [*text, *numbers]])
    raw = spark.read.option("header", True).option("encoding", "UTF-8").option("enforceSchema", False).csv(path)
    raw = raw.toDF(*(c.lstrip("﻿") for c in raw.columns))
    out = raw.select(*(F.col(f.name) for f in schema))
    out = out if limit is None else out.limit(limit)
    return out.select(*text, *(F.coalesce(F.expr(f"try_cast(replace(trim(`{c}`), ',', '') as double)"), F.lit(0.0)).alias(c) for c in numbers))


def append_up_to(rows: DataFrame, more: DataFrame, name: str, limit: int) -> DataFrame:
    """``rows`` and so many of ``more`` that ``limit`` is reached; ``name`` of the latter splits at its first space into brand and model.

    Blank names are skipped; a name of one word is brand and model at once.
    """
    whole = F.trim(F.col(name))
    parts = F.split(whole, " ", 2)
    split = more.where(whole != "").withColumn("brand", parts[0]).withColumn("model", F.coalesce(F.get(parts, F.lit(1)), whole))
    room = max(0, limit - rows.count())
    return rows.limit(limit).unionByName(split.limit(room).select(*(c if c in split.columns else F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in rows.columns)))


def read_jsonl_strict(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(good rows, quarantine of blank, broken or non-object lines with their reason)."""
    lines = spark.read.text(path)
    parsed = F.try_parse_json("value")
    kind = F.schema_of_variant(parsed)
    reason = F.when(F.trim("value") == "", "blank").when(parsed.isNull(), "broken").when(~kind.startswith("OBJECT"), "not an object")
    tagged = lines.withColumn("reason", reason)
    return tagged.where("reason is null").select(F.from_json("value", schema).alias("r")).select("r.*"), tagged.where("reason is not null")


def read_jsonl_lenient(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of all lines that are not blank."""
    return spark.read.text(path).where(F.trim("value") != "").select(F.from_json("value", schema).alias("r")).select("r.*")


def read_vault(spark: SparkSession, path: str) -> DataFrame:
    """Markdown notes: path, title from the front matter or the file name, body, sorted distinct wiki links."""
    notes = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.md").withColumn("path", F.input_file_name())
    body = F.regexp_replace("value", "(?s)^---\\n.*?\\n---\\n", "")
    title = F.coalesce(F.nullif(F.regexp_extract("value", "(?m)^title:\\s*(.+)$", 1), F.lit("")), F.regexp_extract("path", "([^/]+)\\.md$", 1))
    links = F.array_sort(F.array_distinct(F.regexp_extract_all("value", F.lit("\\[\\[([^\\]|#]+)"), F.lit(1))))
    return notes.select("path", title.alias("title"), body.alias("body"), links.alias("links"))


def read_zip_json(spark: SparkSession, path: str, inside: str = "/src/", limit: int | None = None) -> DataFrame:
    """(member, value) of JSON members under ``inside`` of ZIP files, in name order; ``limit`` members of each file."""

    def unzip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                with zipfile.ZipFile(io.BytesIO(content.as_py())) as bundle:
                    names = [n for n in sorted(bundle.namelist()) if inside in n and n.endswith(".json")][:limit]
                    rows = [(n, json.dumps(json.loads(bundle.read(n)), ensure_ascii=False)) for n in names]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], type=pa.string()) for i in (0, 1)], names=["member", "value"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(unzip, "member string, value string")


def _questions(value) -> Iterator[str]:
    """Strings under ``query``, and the content of user messages, at any depth; blank ones are no questions."""
    todo = [value]
    while todo:
        item = todo.pop()
        if isinstance(item, dict):
            found = [item.get("query"), item.get("content") if item.get("role") == "user" else None]
            yield from (x for x in found if isinstance(x, str) and x.strip())
            todo += item.values()
        elif isinstance(item, list):
            todo += item


def scan_questions(spark: SparkSession, path: str) -> DataFrame:
    """(path, query) of the different questions of each JSON and JSONL file under a folder. Broken JSON is an error that names its file."""
    read = lambda glob, whole: spark.read.text(path, wholetext=whole, recursiveFileLookup=True, pathGlobFilter=glob).select(F.input_file_name().alias("path"), "value")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, queries = [], []
            for name, value in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    found = set(_questions(json.loads(value))) if value.strip() else ()
                except json.JSONDecodeError as error:
                    raise ValueError(f"invalid JSON: {name}") from error
                paths += [name] * len(found)
                queries += found
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(queries, pa.string())], names=["path", "query"])

    return read("*.json", True).unionAll(read("*.jsonl", False)).mapInArrow(walk, "path string, query string").distinct()


def write_jsonl(df: DataFrame, path: str, key: str) -> None:
    """One JSON object a line in key order; an existing target is an error."""
    df.orderBy(key).select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("errorifexists").text(path)


def write_csv_quoted(df: DataFrame, path: str) -> None:
    """CSV with every cell quoted and quotes doubled."""
    df.write.mode("errorifexists").option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def write_csv_bom(df: DataFrame, path: str, key: str, quoted: bool = False) -> None:
    """One CSV file for a spreadsheet: byte-order mark, header, rows in key order. For small exports: one task writes it."""
    options = {"quoteAll": str(quoted).lower(), "escape": '"'}
    cell = lambda c: f'"{c}"' if quoted else c
    rows = df.orderBy(key).select(F.to_csv(F.struct(*df.columns), options).alias("value"))
    head = df.sparkSession.createDataFrame([(BOM + ",".join(map(cell, df.columns)),)], "value string")
    numbered = head.withColumn("n", F.lit(-1).cast("long")).unionByName(rows.coalesce(1).withColumn("n", F.monotonically_increasing_id()))
    numbered.coalesce(1).sortWithinPartitions("n").select("value").write.mode("errorifexists").text(path)


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def replace(df: DataFrame, path: str) -> None:
    """Put ``df`` in the place of a table: written beside it first, then renamed, so ``df`` may read the table itself.

    A failure before the rename leaves the old table as it was.
    """
    spark = df.sparkSession
    beside = f"{path.rstrip('/')}.{uuid.uuid4().hex}.tmp"
    df.write.mode("errorifexists").parquet(beside)
    target, files = _files(spark, path)
    source = spark._jvm.org.apache.hadoop.fs.Path(beside)
    files.delete(target, True)
    if not files.rename(source, target):
        raise OSError(f"{beside} could not be renamed to {path}")


def replace_if_changed(spark: SparkSession, df: DataFrame, path: str) -> bool:
    """Reload a table when it is missing or its number of rows differs from the source's."""
    same = exists(spark, path) and spark.read.parquet(path).count() == df.count()
    if not same:
        replace(df, path)
    return not same


def insert(df: DataFrame, path: str, id_col: str = "id") -> DataFrame:
    """Append rows with new ids above all that are there, and return them as they were stored."""
    spark = df.sparkSession
    last = (spark.read.parquet(path).agg(F.max(id_col)).first()[0] or 0) if exists(spark, path) else 0
    part = f"{path.rstrip('/')}.{uuid.uuid4().hex}.new"
    df.select((F.monotonically_increasing_id() + last + 1).alias(id_col), *(c for c in df.columns if c != id_col)).write.parquet(part)
    new = spark.read.parquet(part)
    new.write.mode("append").parquet(path)
    return new


def delete_where(spark: SparkSession, path: str, condition: str) -> int:
    """Delete the rows of a table that fulfil a condition (null keeps a row); how many went."""
    rows = spark.read.parquet(path)
    gone = rows.where(condition).count()
    if gone:
        replace(rows.where(~F.coalesce(F.expr(condition), F.lit(False))), path)
    return gone


def clear(spark: SparkSession, path: str) -> int:
    """Delete all rows of a table; its schema stays."""
    return delete_where(spark, path, "true")


def write_note(spark: SparkSession, folder: str, title: str, meta: dict[str, str], body: str) -> str:
    """A markdown note with front matter, named by its title's slug; the file's path."""
    name = re.sub(r"^-+|-+$", "", re.sub(r'[\\/:*?"<>|\s]+', "-", title)) or "untitled"
    head = "\n".join(f"{k}: {v}" for k, v in {"title": title, **meta}.items())
    where, files = _files(spark, f"{folder.rstrip('/')}/{name}.md")
    out = files.create(where, True)
    try:
        out.write(bytearray(f"---\n{head}\n---\n\n# {title}\n\n{body.strip()}\n".encode()))
    finally:
        out.close()
    return where.toString()


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256) of files, for sidecars and their check."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def write_digests(spark: SparkSession, path: str, sidecar: str) -> None:
    """A table of the digests of files, to be checked later."""
    file_digests(spark, path).write.mode("errorifexists").json(sidecar)


def changed_files(spark: SparkSession, path: str, sidecar: str) -> DataFrame:
    """(path, state) of files that are missing, new or changed against a sidecar; none if all are as they were."""
    then = spark.read.schema("path string, sha256 string").json(sidecar).withColumnRenamed("sha256", "then")
    both = file_digests(spark, path).join(then, "path", "full_outer")
    state = F.when(F.col("sha256").isNull(), "missing").when(F.col("then").isNull(), "new").when(F.col("sha256") != F.col("then"), "changed")
    return both.select("path", state.alias("state")).where("state is not null")
