"""Recordings as directories of CSV files, one per record type."""

from __future__ import annotations

import csv
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spoor import schemas
from spoor.functions import bytes as B
from spoor.session import path_exists

OPTIONAL = (18,)
_MOST = {"u64": (1 << 63) - 1, "u32": (1 << 32) - 1, "enum": 255}
_ABSENT = "\u0001absent"     # never a field value; keeps empty fields apart from missing ones


def _columns(kind: int) -> list[tuple[str, str]]:
    """(column, type) pairs of the text form: flags appear as an ``event`` word."""
    return [("event", "word") if n in schemas.FLAG_WORDS else (n, c) for n, c in schemas.fields(kind)]


def _words(kind: int, name: str) -> list[str] | None:
    if (kind, name) in schemas.ENUMS:
        return schemas.ENUMS[(kind, name)]
    flags = [n for n, _ in schemas.fields(kind) if n in schemas.FLAG_WORDS]
    return list(schemas.FLAG_WORDS[flags[0]]) if name == "event" and flags else None


def _first_line(spark: SparkSession, path: str) -> str | None:
    """The first line of a file, or of the first file of a folder that holds any; opened by itself, without a job."""
    jvm = spark._jvm
    place = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    system = place(path).getFileSystem(spark._jsc.hadoopConfiguration())
    files = [path]
    if system.getFileStatus(place(path)).isDirectory():
        listed = [f for f in system.listStatus(place(path)) if f.isFile() and f.getLen() and f.getPath().getName()[0] not in "._"]
        files = sorted(f.getPath().toString() for f in listed)[:1]
    for file in files:
        reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(system.open(place(file)), "UTF-8"))
        try:
            return reader.readLine()
        finally:
            reader.close()
    return None


def read_header(spark: SparkSession, path: str, kind: int) -> list[str]:
    first = _first_line(spark, path)
    if first is None:
        raise ValueError(f"Empty CSV file: {path}")
    header = next(csv.reader([first]))
    if len(set(header)) != len(header):
        raise ValueError("Repeated column in CSV header")
    for name, _ in _columns(kind):
        if name not in header:
            raise ValueError(f"Column not in CSV header: {name}")
    return header


def _holds_text(header: list[str], kind: int) -> bool:
    known = dict(_columns(kind)) | dict(schemas.text_extras(kind))
    return any(known.get(n, "text") == "text" for n in header)


def check_encoding(spark: SparkSession, paths: list[str]) -> None:
    """Refuses files with bytes that are not UTF-8; one pass over all of them, before their text is decoded."""
    lines = spark.read.text(paths).filter(~F.is_valid_utf8("value")).select(F.input_file_name().alias("file"))
    if (bad := lines.first()) is not None:
        raise ValueError(f"Malformed UTF-8 in {bad.file}")


def read_text_dataset(spark: SparkSession, path: str, kind: int) -> DataFrame:
    """All columns as text; a row whose width differs from the header fails the job.

    Only files with text fields may hold line breaks inside quotes; the large event files are read
    line by line so that Spark can split them.
    """
    header = read_header(spark, path, kind)
    multiline = _holds_text(header, kind)
    schema = T.StructType([T.StructField(n, T.StringType()) for n in header])
    return (spark.read.schema(schema).option("header", True).option("quote", '"').option("escape", '"')
            .option("multiLine", multiline).option("mode", "FAILFAST").option("columnPruning", False)
            .option("enforceSchema", False).option("nullValue", _ABSENT).option("emptyValue", "")
            .csv(path))


def _whole(text: Column, digits: int) -> Column:
    """Decimal digits as a number, 0 where there are too many; leading zeros do not count."""
    shown = F.ltrim(text, F.lit("0"))
    return F.when(F.length(shown).between(1, digits), shown.cast("decimal(20,0)")).otherwise(F.lit(0).cast("decimal(20,0)"))


def _allowed(kind: int, name: str, stored: str) -> Column | None:
    """Whether the text of a column is in its domain; None: every text is."""
    v, words = F.col(name), _words(kind, name)
    if words is not None:
        return v.isin(*words)
    if stored == "flag":
        return v.isin("true", "false")
    if stored == "bytes":
        return v.rlike("^(?:[0-9a-fA-F]{2})*$")
    if stored == "address":
        hexadecimal = v.rlike("^0x[0-9a-fA-F]{1,16}$")
        return hexadecimal | v.rlike("^[0-9]+$") if (kind, name) == (16, "size") else hexadecimal
    if stored in _MOST:
        return v.rlike("^[0-9]+$") & (F.length(F.ltrim(v, F.lit("0"))) <= 19) & (_whole(v, 19) <= _MOST[stored])
    if stored == "i32":
        size = F.regexp_replace(v, "^[+-]", "")
        least = F.when(v.startswith("-"), F.lit(1 << 31)).otherwise(F.lit((1 << 31) - 1))
        return v.rlike("^[+-]?[0-9]+$") & (F.length(F.ltrim(size, F.lit("0"))) <= 10) & (_whole(size, 10) <= least)
    return None


def _violation(kind: int, name: str, stored: str) -> Column:
    allowed = _allowed(kind, name, stored)
    missing = F.col(name).isNull()
    return F.when(missing if allowed is None else missing | ~allowed, F.lit(name))


def csv_violations(df: DataFrame, kind: int) -> DataFrame:
    """Adds ``violations``: names of columns whose text is outside the field's domain."""
    checks = [_violation(kind, n, c) for n, c in _columns(kind)]
    return df.withColumn("violations", F.array_compact(F.array(*checks)))


def typed(df: DataFrame, kind: int, strict: bool = True) -> DataFrame:
    """Text columns to the canonical types; ``strict`` fails the job at the first violation."""
    if strict:
        checks = F.array_compact(F.array(*[_violation(kind, n, c) for n, c in _columns(kind)]))
        first = _columns(kind)[0][0]
        failed = F.raise_error(F.concat(F.lit(f"Field outside its domain in {schemas.NAMES[kind]}: "), F.array_join(checks, ",")))
        df = df.withColumn(first, F.when(F.size(checks) > 0, failed).otherwise(F.col(first)))
    result = []
    for name, stored in schemas.fields(kind) + schemas.text_extras(kind):
        if name in schemas.FLAG_WORDS:
            result.append((F.col("event") == schemas.FLAG_WORDS[name][0]).alias(name))
            continue
        dtype = schemas.spark_type(kind, name, stored)
        if name not in df.columns:
            value = F.lit(None).cast(dtype)
        elif stored == "address":
            value = B.parse_unsigned(name)
        elif stored == "bytes":
            value = F.unhex(name)
        else:
            value = F.col(name).cast(dtype)
        result.append(value.alias(name))
    extra = [c for c in df.columns if c not in dict(_columns(kind)) and c != "event"
             and c not in dict(schemas.text_extras(kind))]
    return df.select(*result, *extra)


def read_csv_run(spark: SparkSession, path: str, run_id: int = 1, strict: bool = True) -> dict[str, DataFrame]:
    """The typed tables of a CSV recording; ``strict`` refuses fields outside their domain and text that is not UTF-8."""
    if not path_exists(spark, f"{path}/run.csv"):
        raise FileNotFoundError("No recording found: run.csv is missing")
    tables, texts = {}, []
    for kind, name in schemas.NAMES.items():
        file = f"{path}/{name}.csv"
        if not path_exists(spark, file):
            if kind in OPTIONAL:
                continue
            raise FileNotFoundError(f"Dataset file not found: {name}.csv")
        rows = read_text_dataset(spark, file, kind)
        if _holds_text(rows.columns, kind):
            texts.append(file)
        tables[name] = typed(rows, kind, strict).withColumn("run_id", F.lit(run_id).cast("bigint"))
    if strict:
        check_encoding(spark, texts)
    _check_run(tables["run"])
    return tables


def _check_run(run: DataFrame) -> None:
    facts = run.agg(F.max(F.col("started")).alias("started"),
                    F.count_if(F.col("format_version") != schemas.FORMAT_VERSION).alias("other")).first()
    if facts["other"]:
        raise ValueError("Only recording format 20 can be read")
    if not facts["started"]:
        raise ValueError("The recording has no start row")


def text_form(df: DataFrame, kind: int) -> DataFrame:
    """Typed rows as the text columns of a CSV file."""
    shown = []
    names = dict(schemas.text_extras(kind))
    for name, stored in schemas.fields(kind) + [(n, c) for n, c in names.items() if n in df.columns]:
        c = F.col(name)
        if name in schemas.FLAG_WORDS:
            on, off = schemas.FLAG_WORDS[name]
            shown.append(F.when(c, on).otherwise(off).alias("event"))
        elif stored == "address" and (kind, name) != (16, "size"):
            shown.append(B.hex_address(c).alias(name))
        elif stored == "bytes":
            shown.append(F.coalesce(B.hex_text(c), F.lit("")).alias(name))
        else:
            shown.append(c.cast("string").alias(name))
    return df.select(*shown)


def write_csv_run(tables: dict[str, DataFrame], path: str) -> None:
    """One CSV folder per dataset; dynamic rows in sequence order over the part files, text quoted."""
    for name, df in tables.items():
        kind = schemas.KIND_OF[name]
        ordered = df.orderBy("sequence") if "sequence" in df.columns else df
        (text_form(ordered, kind).write.mode("errorifexists").option("header", True).option("quoteAll", True)
         .option("quote", '"').option("escape", '"').option("emptyValue", "").csv(f"{path}/{name}.csv"))


def all_violations(tables: dict[str, DataFrame]) -> DataFrame:
    """Text datasets to (dataset, column, rows) counts of violations."""
    parts = [csv_violations(df, schemas.KIND_OF[name]).select(
        F.lit(name).alias("dataset"), F.explode("violations").alias("column")) for name, df in tables.items()]
    return reduce(DataFrame.unionByName, parts).groupBy("dataset", "column").agg(F.count(F.lit(1)).alias("rows"))
