"""Readers for bar, news and benchmark files with varying headers.

Files are read once, header line included, as plain string cells. A header line
is recognised by its names and joined back to the rows of its file, so files
with different headers share one scan and no header is read on the driver.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelark.operators.rows import first_per_key
from panelark.schema import (
    BAR_ALIASES,
    BENCH_CLOSE_NAMES,
    BENCH_DATE_NAMES,
    NEWS_ALIASES,
    NEWS_FLAGS,
)

DATE_FORMATS = ("yyyy/MM/dd", "dd-MM-yyyy", "dd/MM/yyyy", "dd-MMM-yyyy", "yyyyMMdd")


def canonical(name: Column) -> Column:
    return F.translate(F.lower(F.trim(name)), " ", "_")


def to_number(text: Column) -> Column:
    """Number or null; the text NaN and infinities count as missing."""
    x = F.trim(text).try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def to_time(text: Column) -> Column:
    t = F.trim(text)
    tries = [t.try_cast("timestamp_ntz")]
    tries += [F.try_to_timestamp(t, F.lit(f)).cast("timestamp_ntz") for f in DATE_FORMATS]
    return F.coalesce(*tries)


def symbol_of_file(file_name: Column) -> Column:
    """Stem in upper case with dashes and blanks as underscores."""
    return F.translate(F.upper(F.regexp_extract(file_name, r"^(.*?)(\.[^.]*)?$", 1)), "- ", "__")


def _paths(paths: str | Iterable[str]) -> list[str]:
    return [paths] if isinstance(paths, str) else [str(p) for p in paths]


def existing(spark: SparkSession, paths: str | Iterable[str]) -> list[str]:
    """The given paths that exist, in any file system the session knows."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def there(p: str) -> bool:
        path = jvm.org.apache.hadoop.fs.Path(p)
        return path.getFileSystem(conf).exists(path)

    return [p for p in _paths(paths) if there(p)]


def read_cells(
    spark: SparkSession,
    paths: str | Iterable[str],
    columns: dict[str, Sequence[str]],
    needed: Sequence[str],
    recursive: bool = False,
) -> DataFrame:
    """(file_name, place, cells, at_<column>) rows of CSV files.

    A file without a header line fails the query with its name. The number of
    cells is that of the widest line, counted in a pass of its own.

    ``columns`` maps a canonical column to its accepted header names; a line
    naming one of each ``needed`` column is the header of its file. ``at_<column>``
    lists the cells that hold the column, worked out once per file. ``place``
    orders the rows of a folder.
    """
    if not has_files(spark, paths, "*.csv", recursive):
        raise ValueError("no CSV files found")
    text = spark.read.option("pathGlobFilter", "*.csv").option("recursiveFileLookup", recursive).text(_paths(paths))
    commas = F.length("value") - F.length(F.replace("value", F.lit(","), F.lit("")))
    width = (text.agg(F.max(commas)).first()[0] or 0) + 1
    cells = [F.col(f"c{i}") for i in range(width)]
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(width)])
    reader = spark.read.schema(schema).option("header", False).option("mode", "PERMISSIVE")
    raw = reader.option("pathGlobFilter", "*.csv").option("recursiveFileLookup", recursive).csv(_paths(paths))
    # one pattern per needed column over the joined line keeps the generated code small
    line = F.concat_ws("|", F.lit(""), *cells, F.lit(""))
    is_header = F.lit(True)
    for column in needed:
        spellings = "|".join(re.escape(n).replace("_", "[_ ]") for n in columns[column])
        is_header = is_header & line.rlike(rf"(?i)\|\s*({spellings})\s*\|")
    file = F.col("_metadata.file_path")
    place = F.struct(
        file.alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")
    )
    lines = raw.select(
        file.alias("file"),
        F.col("_metadata.file_name").alias("file_name"),
        place.alias("place"),
        is_header.alias("_header"),
        F.array(*cells).alias("cells"),
    )
    found = lines.where("_header").groupBy("file").agg(F.min(F.transform("cells", canonical)).alias("_names"))

    def positions(names: Sequence[str]) -> Column:
        each = [F.nullif(F.coalesce(F.array_position("_names", n), F.lit(0)), F.lit(0)).cast("int") - 1 for n in names]
        return F.array_compact(F.array(*each))

    headers = found.select("file", F.lit(True).alias("_known"), *[positions(a).alias(f"at_{n}") for n, a in columns.items()])
    # one header per file: the join method is left to the runtime size check
    rows = lines.where(~F.col("_header")).drop("_header").join(headers, "file", "left")
    missing = F.raise_error(F.concat(F.lit(f"no header line naming {', '.join(needed)} in "), F.col("file")))
    return rows.withColumn("cells", F.when(F.col("_known"), F.col("cells")).otherwise(missing)).drop("file", "_known")


def cell(column: str, names: Sequence[str]) -> Column:
    """Value of a column: the first filled cell among those that hold it."""
    return F.coalesce(*[F.get("cells", F.get(f"at_{column}", F.lit(i))) for i in range(len(names))])


def _texts(columns: dict[str, Sequence[str]]) -> dict[str, Column]:
    return {n: cell(n, a) for n, a in columns.items()}


def read_bars(spark: SparkSession, paths: str | Iterable[str], symbol: str | None = None) -> DataFrame:
    """Bars from CSV files or folders of them, with canonical names and types.

    A missing symbol column is replaced by ``symbol`` or the file name; missing
    sentiment columns are 0. Unparsable numbers are null.
    """
    cells = read_cells(spark, paths, BAR_ALIASES, ["timestamp", "close"])
    hint = F.lit(symbol) if symbol else symbol_of_file(F.col("file_name"))
    return cells.select(*bar_columns(_texts(BAR_ALIASES), hint))


def bar_columns(text: dict[str, Column], symbol_hint: Column) -> list[Column]:
    """Typed bar columns from text columns; shared by the batch and stream readers."""
    numbers = [n for n in BAR_ALIASES if n not in ("timestamp", "symbol")]
    zero = ("sentiment", "positive_news", "negative_news")
    out = [to_time(text["timestamp"]).alias("timestamp"), F.coalesce(text["symbol"], symbol_hint).alias("symbol")]
    for n in numbers:
        value = to_number(text[n])
        out.append((F.coalesce(value, F.lit(0.0)) if n in zero else value).alias(n))
    return out


def read_news(spark: SparkSession, paths: str | Iterable[str], json_lines: bool = False) -> DataFrame:
    """News items from CSV and JSON files; folders are read recursively, absent paths skipped.

    A JSON file holds an array of records, or with ``json_lines`` one record per
    line, which Spark can split.
    """
    found = existing(spark, paths)
    parts = []
    aliases = NEWS_ALIASES | {f: [f] for f in NEWS_FLAGS}
    csv = [p for p in found if not p.endswith(".json")]
    if csv:
        if has_files(spark, csv, "*.csv", recursive=True):
            cells = read_cells(spark, csv, aliases, ["timestamp", "symbol"], recursive=True)
            parts.append(cells.select(*news_columns(_texts(aliases))))
    json = [p for p in found if not p.endswith(".csv")]
    if json:
        reader = spark.read.option("multiLine", not json_lines).option("recursiveFileLookup", True)
        raw = reader.option("pathGlobFilter", "*.json").json(json) if has_files(spark, json, "*.json", recursive=True) else None
        if raw is not None:
            have = {c.strip().lower().replace(" ", "_"): c for c in raw.columns}
            none = F.lit(None).cast("string")
            picked = {
                n: F.coalesce(*[F.col(f"`{have[x]}`").cast("string") for x in a if x in have], none)
                for n, a in aliases.items()
            }
            parts.append(raw.select(*news_columns(picked)))
    if not parts:
        raise ValueError("no news files found")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def has_files(spark: SparkSession, paths: str | Iterable[str], pattern: str, recursive: bool = False) -> bool:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).option("pathGlobFilter", pattern)
    return bool(files.load(_paths(paths)).inputFiles())


def news_columns(text: dict[str, Column]) -> list[Column]:
    out = [
        to_time(text["timestamp"]).alias("timestamp"),
        F.upper(text["symbol"]).alias("symbol"),
        text["headline"].alias("headline"),
        F.coalesce(to_number(text["news_sentiment"]), F.lit(0.0)).alias("news_sentiment"),
        text["language"].alias("language"),
    ]
    return out + [F.coalesce(to_number(text[f]), F.lit(0.0)).alias(f) for f in NEWS_FLAGS]


def read_benchmark(spark: SparkSession, path: str, name: str = "nifty") -> DataFrame:
    """Benchmark series: first row of each timestamp in file order, ``<name>_close`` and ``<name>_volume``."""
    columns = {"time": BENCH_DATE_NAMES, "close": BENCH_CLOSE_NAMES, "volume": ["volume"]}
    cells = read_cells(spark, path, columns, ["time", "close"])
    text, prefix = _texts(columns), name.lower()
    rows = cells.select(
        to_time(text["time"]).alias("timestamp"),
        to_number(text["close"]).alias(f"{prefix}_close"),
        to_number(text["volume"]).alias(f"{prefix}_volume"),
        "place",
    )
    return first_per_key(rows, ["timestamp"], "place").drop("place")
