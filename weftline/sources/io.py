"""Readers and writers: records from JSON or JSON lines, strict JSON, atomic writes, tab-separated relevance lists."""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from weftline.operators.verdicts import strict_json


def read_records(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Records of a JSON array or of JSON lines; which of the two is told by the first character."""
    first = spark.read.text(path, wholetext=False).where(F.trim("value") != "").limit(1).collect()
    array = bool(first) and first[0]["value"].lstrip().startswith("[")
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path, multiLine=array)


def read_nonempty(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """As ``read_records``; a missing file and one without records are errors."""
    rows = read_records(spark, path, schema)
    if rows.isEmpty():
        raise ValueError(f"no records in {path}")
    return rows


def read_results(spark: SparkSession, path: str, schema: StructType) -> tuple[DataFrame, DataFrame]:
    """(rows, broken lines) of a results file of JSON lines: an interrupted last line does not spoil the rest; no file gives no rows."""
    lines = StructType([*schema.fields, StructField("_broken", StringType())])
    try:
        text = spark.read.text(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        text = spark.createDataFrame([], "value string")
    parsed = F.from_json("value", lines, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"})
    read = text.where(F.trim("value") != "").select(parsed.alias("r")).select("r.*")
    return read.where("_broken is null").drop("_broken"), read.where("_broken is not null").select("_broken")


def read_strict_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, value, problem) of JSON lines: objects only, no repeated keys, no NaN, nothing behind the object."""

    def check(values):
        import pyarrow as pa

        for batch in values:
            out = []
            for line in batch.column(0).to_pylist():
                try:
                    out.append(None if isinstance(strict_json(line), dict) else "not_an_object")
                except ValueError as e:
                    out.append(str(e) if str(e) in ("duplicate_key", "not_finite") else "not_json")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["line", "problem"])

    lines = spark.read.text(path).where(F.trim("value") != "").select("value")
    return lines.mapInArrow(check, "line string, problem string")


def read_or_empty(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Parquet table at ``path``; an empty one if there is none."""
    try:
        return spark.read.schema(schema).parquet(path)
    except Exception as e:  # the analysis error of a missing path
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def write_table(df: DataFrame, path: str, by: list[str] | None = None, key: str | None = None) -> None:
    """Write a table in one commit; ``by`` partitions the folders, ``key`` sorts each file for pruning."""
    out = df.sortWithinPartitions(key) if key else df
    writer = out.write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """Write a small file at once, on any file system that Spark can reach: beside its place first, then renamed over it."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    beside = jvm.org.apache.hadoop.fs.Path(target.getParent(), f".{target.getName()}.{uuid.uuid4().hex}")
    try:
        out = system.create(beside, True)
        try:
            out.write(bytearray(data))
            out.hsync()
        finally:
            out.close()
        if not system.rename(beside, target):
            system.delete(target, False)
            if not system.rename(beside, target):
                raise OSError(f"cannot rename to {path}")
    finally:
        system.delete(beside, False)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """As ``write_bytes``, UTF-8."""
    write_bytes(spark, path, text.encode())


def write_report(spark: SparkSession, path: str, value) -> None:
    """A small JSON report with sorted keys, written at once; NaN and infinities are refused."""
    write_text(spark, path, json.dumps(value, ensure_ascii=False, sort_keys=True, allow_nan=False))


def write_lines(spark: SparkSession, path: str, values: list) -> None:
    """A small file of JSON lines, written at once; tables go through ``write_table``."""
    write_text(spark, path, "".join(json.dumps(v, ensure_ascii=False, sort_keys=True, allow_nan=False) + "\n" for v in values))


def write_decimals(df: DataFrame, path: str, places: int = 12) -> None:
    """CSV with a header; numbers with a fraction have so many decimals."""
    cols = [F.format_string(f"%.{places}f", c).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes]
    df.select(*cols).write.mode("overwrite").csv(path, header=True)


def append_results(df: DataFrame, path: str, allowed: set[str], key: str) -> int:
    """Append results whose key the table lacks, columns guarded first; the number of rows that the table has then.

    Rows are found by an anti join on the key alone, so a run that is started again adds nothing twice.
    """
    spark = df.sparkSession
    rows = guard_columns(df, allowed).dropDuplicates([key])
    before = read_or_empty(spark, path, rows.schema)
    rows.join(before.select(key), key, "left_anti").select(*rows.columns).write.mode("append").parquet(path)
    return spark.read.schema(rows.schema).parquet(path).count()


def inside(base: str, path: str) -> str:
    """``path`` below ``base``, normal; raises where it leads out of it."""
    from posixpath import normpath

    root, full = normpath(base), normpath(path if path.startswith("/") or "://" in path else f"{base}/{path}")
    if full != root and not full.startswith(root.rstrip("/") + "/"):
        raise ValueError(f"{path} is not below {base}")
    return full


def check_seal(df: DataFrame, columns: list[str], sealed: str) -> DataFrame:
    """The table itself if its fingerprint is the sealed one; a held-out table that changed must not be used."""
    found = fingerprint(df, columns)
    if found != sealed:
        raise ValueError(f"the table is not the sealed one: {found}")
    return df


def fingerprint(df: DataFrame, columns: list[str]) -> str:
    """SHA-256 over a table's rows whatever their order: sums of the rows' digests, so only numbers reach the driver."""
    row = F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)
    parts = [F.sum(F.conv(F.substring(row, 1 + 15 * k, 15), 16, 10).cast("decimal(38,0)")).alias(f"s{k}") for k in range(4)]
    got = df.select(*columns).agg(F.count("*").alias("n"), *parts).first()
    return hashlib.sha256("|".join(str(x) for x in got).encode()).hexdigest()


def write_tsv(df: DataFrame, path: str, lists: list[str]) -> None:
    """Tab-separated text with a header; list columns are joined with semicolons."""
    cols = [F.array_join(c, ";").alias(c) if c in lists else F.col(c) for c in df.columns]
    df.select(*cols).write.mode("overwrite").csv(path, sep="\t", header=True)


def guard_columns(df: DataFrame, allowed: set[str]) -> DataFrame:
    """The table itself if it has no other columns than ``allowed``; looks at the schema only."""
    extra = sorted(set(df.columns) - allowed)
    if extra:
        raise ValueError(f"columns that must not be here: {', '.join(extra)}")
    return df
