"""Files in and out: one table or many with a source label."""

from __future__ import annotations

import csv
import os
import re
import uuid
from collections.abc import Iterable, Sequence
from functools import reduce
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.cols import c, num, require, to_number

READERS = {
    "csv": lambda spark, path: spark.read.csv(path, header=True, inferSchema=True),
    "parquet": lambda spark, path: spark.read.parquet(path),
    "json": lambda spark, path: spark.read.json(path),
    "orc": lambda spark, path: spark.read.orc(path),
}


def label_of(path: str) -> str:
    """The file's name without folder and extension."""
    return os.path.splitext(os.path.basename(path.rstrip("/")))[0]


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A table by its file extension; an unknown extension is an error."""
    kind = os.path.splitext(path.rstrip("/"))[1].lower().lstrip(".")
    if kind not in READERS:
        raise ValueError(f"unsupported file type {kind!r}: {path}")
    return READERS[kind](spark, path)


def try_read(spark: SparkSession, path: str) -> DataFrame | None:
    """A table, or None where it can't be read."""
    try:
        return read_table(spark, path)
    except (AnalysisException, ValueError):
        return None


def read_many(spark: SparkSession, paths: Iterable[str], needed: Sequence[str] = (), label: str = "file_source") -> DataFrame:
    """All readable files that have the needed columns, with the file's label; missing columns are null."""
    tables = [(p, try_read(spark, p)) for p in paths]
    return union_labelled([(label_of(p), t) for p, t in tables if t is not None], needed, label)


def scan_files(spark: SparkSession, paths: Sequence[str], needed: Sequence[str], label: str = "file_source") -> tuple[DataFrame, DataFrame]:
    """The needed columns of many files, numbers as doubles, with the file's label; and (file, rows, status).

    Files of a kind are read together: text files a scan for each different header line, which one scan over all of them
    finds, others one scan. A file that can't be read, lacks a column (or has no value in it) or has no good record is
    ``failed: ...`` and gives no rows; records that don't fit the header are left out and counted in the status. Two files of one name are told apart
    by their paths.
    """
    names = [label_of(p) for p in paths]
    labels = {_plain(spark, p): (n if names.count(n) == 1 else p) for p, n in zip(paths, names, strict=True)}
    kinds: dict[str, list[str]] = {}
    for path in paths:
        kinds.setdefault(os.path.splitext(path.rstrip("/"))[1].lower().lstrip("."), []).append(path)
    parts: list[DataFrame] = []
    failed: dict[str, str] = {}
    for kind, own in kinds.items():
        if kind == "csv":
            headers = _headers(spark, own, labels)
            failed |= {labels[_plain(spark, p)]: "failed: empty" for p in own if labels[_plain(spark, p)] not in {n for h in headers.values() for n in h}}
            by_label = {labels[_plain(spark, p)]: p for p in own}
            for header, members in headers.items():
                columns = next(csv.reader([header]))
                missing = [n for n in needed if n not in columns]
                if missing:
                    failed |= dict.fromkeys(members, f"failed: no column {', '.join(missing)}")
                    continue
                schema = StructType([*[StructField(n, StringType()) for n in columns], StructField(_BROKEN, StringType())])
                rows = spark.read.schema(schema).csv([by_label[m] for m in members], header=True, columnNameOfCorruptRecord=_BROKEN)
                seen = F.coalesce(c(needed[0] if needed else columns[0]), F.lit(""))  # Spark reads the record's text beside other columns only
                parts.append(_labelled(rows, rows.inputFiles(), labels, needed, F.concat(seen, F.coalesce(c(_BROKEN), F.lit(""))) != seen))
        elif kind in READERS:
            try:
                rows = spark.read.format(kind).option("mergeSchema", True).option("ignoreCorruptFiles", True).load(own)
            except AnalysisException:
                continue  # none of them can be read
            there, own_files = [n for n in needed if n in rows.columns], rows.inputFiles()
            rows = rows.select(*map(c, there), F.col("_metadata.file_path").alias(_PATH)).withColumns({n: F.lit(None).cast("double") for n in needed if n not in there})
            parts.append(_labelled(rows, own_files, labels, needed, F.lit(False)))
        else:
            failed |= {labels[_plain(spark, p)]: f"failed: unsupported file type {kind!r}" for p in own}
    every = spark.createDataFrame([(n, failed.get(n)) for n in labels.values()], "file string, told string")
    if not parts:
        empty = spark.createDataFrame([], ", ".join(f"`{n}` double" for n in needed) + f", `{label}` string")
        return empty, every.select("file", F.lit(0).cast("long").alias("rows"), F.coalesce("told", F.lit("failed: unreadable")).alias("status"))
    rows = kept(reduce(DataFrame.unionByName, parts))
    values = [F.count(F.when(~c(_BROKEN), c(n))).alias(f"v{k}") for k, n in enumerate(needed)]
    met = rows.groupBy(c(_LABEL).alias("file")).agg(F.count("*").alias("all"), F.count_if(c(_BROKEN)).alias("broken"), *values)
    without = F.concat_ws(", ", *[F.when(F.col(f"v{k}") == 0, F.lit(n)) for k, n in enumerate(needed)])
    told = (
        F.when(F.col("told").isNotNull(), F.col("told")).when(F.col("all").isNull(), "failed: unreadable").when(F.col("all") == F.col("broken"), "failed: no good record")
        .when(without != "", F.concat(F.lit("failed: no value in "), without)).when(F.col("broken") > 0, F.concat(F.lit("ok, without "), F.col("broken"), F.lit(" broken records"))).otherwise("ok")
    )
    found = every.join(met, "file", "left").select("file", F.coalesce(F.col("all") - F.col("broken"), F.lit(0)).alias("rows"), told.alias("status")).collect()  # a row for each path given
    status = spark.createDataFrame(found, "file string, rows long, status string")
    good = rows.where(~c(_BROKEN) & c(_LABEL).isin([r["file"] for r in found if r["status"].startswith("ok")]))
    return good.select(*map(c, needed), c(_LABEL).alias(label)), status


_PATH, _LABEL, _BROKEN = "__path", "__label", "__broken"


def _plain(spark: SparkSession, path: str) -> str:
    """A path with its scheme, as files' metadata name it, slashes after the scheme as one."""
    made = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    full = made.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(made).toString()
    return _one_slash(full)


def _one_slash(path: str) -> str:
    return re.sub(r"^([a-z0-9]+):/+", r"\1:/", path)


def kept(rows: DataFrame) -> DataFrame:
    """Rows made once for all passes over them, in the checkpoint folder; without one they are made anew each time."""
    spark = rows.sparkSession
    folder = spark.sparkContext.getCheckpointDir()
    if not folder:
        return rows
    path = f"{folder}/rows-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def _label_column(labels: dict[str, str]) -> Column:
    """The label of the given path that a file is, or lies in."""
    path = F.regexp_replace(F.url_decode(F.regexp_replace(c(_PATH), r"\+", "%2B")), r"^([a-z0-9]+):/+", "$1:/")
    known = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])
    return F.coalesce(known[path], known[F.regexp_replace(path, "/[^/]*$", "")])


def _label_of_row(labels: dict[str, str], files: Sequence[str]) -> Column:
    """`_label_column`, of the named files found by the path as it stands, or its folder's: these are taken apart here, once,
    with any number of slashes after the scheme, and not in every row."""
    whole: dict[str, str] = {}
    folder: dict[str, str] = {}
    for f in files:
        path, above = _one_slash(unquote(f)), os.path.dirname(_one_slash(unquote(f)))
        known, key, label = (whole, f, labels[path]) if path in labels else (folder, f.rpartition("/")[0], labels.get(above))
        if label is not None:
            known |= {_one_slash(key).replace(":/", f":{slashes}", 1): label for slashes in ("/", "//", "///")}
    found = []
    for known, key in ((whole, c(_PATH)), (folder, F.expr(f"left({_PATH}, length({_PATH}) - length(substring_index({_PATH}, '/', -1)) - 1)"))):
        if known:
            found.append(F.create_map(*[F.lit(x) for kv in known.items() for x in kv])[key])
    return F.coalesce(*found, _label_column(labels))


def _labelled(rows: DataFrame, files: Sequence[str], labels: dict[str, str], needed: Sequence[str], broken: Column) -> DataFrame:
    if _PATH not in rows.columns:
        rows = rows.withColumn(_PATH, F.col("_metadata.file_path"))
    kinds = dict(rows.dtypes)
    return rows.select(*[(to_number(n) if kinds[n] == "string" else num(n)).alias(n) for n in needed], _label_of_row(labels, files).alias(_LABEL), broken.alias(_BROKEN))


def _headers(spark: SparkSession, paths: Sequence[str], labels: dict[str, str]) -> dict[str, list[str]]:
    """The different header lines and the labels of the files that have them; a folder's files share the first."""
    lines = spark.read.option("ignoreCorruptFiles", True).text(list(paths)).where("_metadata.file_block_start = 0")
    first = lines.select("value", F.col("_metadata.file_path").alias(_PATH), F.monotonically_increasing_id().alias("at")).groupBy(_PATH).agg(F.min_by("value", "at").alias("header"))
    found = first.groupBy(_label_column(labels).alias("label")).agg(F.min_by("header", _PATH).alias("header")).collect()  # a row for each path given
    out: dict[str, list[str]] = {}
    for r in sorted(found, key=lambda r: r["label"]):
        out.setdefault(r["header"].rstrip("\r"), []).append(r["label"])
    return out


def union_labelled(tables: Sequence[tuple[str, DataFrame]], needed: Sequence[str] = (), label: str = "file_source") -> DataFrame:
    """Tables one under the other, each row with its table's label; tables without the needed columns are skipped."""
    fit = [t.withColumn(label, F.lit(name)) for name, t in tables if set(needed) <= set(t.columns)]
    if not fit:
        raise ValueError(f"no table has the columns {list(needed)}")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), fit)


def union_common(tables: Sequence[tuple[str, DataFrame]], label: str = "source_file") -> DataFrame:
    """Tables on the columns that all of them have; the label is added if there are several."""
    if not tables:
        raise ValueError("no readable table")
    common = [n for n in tables[0][1].columns if all(n in t.columns for _, t in tables)]
    if not common:
        raise ValueError("the tables have no common column")
    parts = [t.select(*[c(n) for n in common], *([F.lit(name).alias(label)] if len(tables) > 1 else [])) for name, t in tables]
    return reduce(DataFrame.unionByName, parts)


def read_common(spark: SparkSession, paths: Iterable[str]) -> DataFrame:
    """`union_common` of the readable files."""
    tables = [(label_of(p), try_read(spark, p)) for p in paths]
    return union_common([(n, t) for n, t in tables if t is not None])


def bind_datasets(first: DataFrame, second: DataFrame, names: Sequence[str], label: str = "dataset") -> DataFrame:
    """The named columns of two datasets, labelled "Dataset 1" and "Dataset 2"."""
    require(first, names)
    require(second, names)
    return union_labelled([("Dataset 1", first.select(*map(c, names))), ("Dataset 2", second.select(*map(c, names)))], names, label)


def write_table(df: DataFrame, path: str, kind: str = "csv", mode: str = "overwrite", partition_by: Sequence[str] = ()) -> None:
    """A table as csv (with header), parquet, json or orc."""
    if kind not in READERS:
        raise ValueError(f"unsupported file type {kind!r}")
    out = df.write.mode(mode)
    if partition_by:
        out = out.partitionBy(*partition_by)
    (out.option("header", True) if kind == "csv" else out).format(kind).save(path)


def export_tables(tables: dict[str, DataFrame | None], folder: str, spark: SparkSession, kind: str = "parquet") -> list[str]:
    """Each table in its own folder; one that is missing, empty or fails becomes a one-row message."""
    paths = []
    for name, table in tables.items():
        path = f"{folder}/{re.sub(r'[^A-Za-z0-9_.-]', '_', name)}"
        message = None
        try:
            if table is None or table.isEmpty():
                message = "no data"
            else:
                write_table(table, path, kind)
        except Exception as e:  # the other tables are still wanted
            message = f"failed: {type(e).__name__}"
        if message:
            write_table(spark.createDataFrame([(message,)], "message string"), path, kind)
        paths.append(path)
    return paths


def preview(df: DataFrame, key: str | Sequence[str], names: Sequence[str] | None = None, n: int = 10) -> DataFrame:
    """The first rows in the order of ``key``: chosen columns, or the first five."""
    keys = [key] if isinstance(key, str) else list(key)
    wanted = list(names) if names else df.columns[:5]
    return df.orderBy(*map(c, keys)).limit(n).select(*map(c, wanted))
