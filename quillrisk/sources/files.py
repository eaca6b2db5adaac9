"""Readers and writers of feeds, quotes, transactions and signals kept as files."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Places (from 0) of the fields that are kept from a row of a 27-column feed file.
FEED_FIELDS = {"at": 1, "domain": 3, "url": 4, "themes": 7, "locations": 9, "orgs": 13, "tone": 15, "extras": 26}
FEED_WIDTH = 27


def scan_zipped_feed(spark: SparkSession, path: str, max_file_bytes: int = 256 << 20) -> DataFrame:
    """Rows of the zipped feed files under ``path``; see ``unzip_feed``."""
    return unzip_feed(spark.read.format("binaryFile").load(path).select("content", "length"), max_file_bytes)


def unzip_feed(archives: DataFrame, max_file_bytes: int = 256 << 20) -> DataFrame:
    """Rows of zipped, unquoted TSV files (``content, length``) without a header. Rows of another width and files that are no archive give nothing.

    One file is one task's work at a time, read line by line; a file over ``max_file_bytes`` fails rather than being cut.
    """

    def rows(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for content, size in zip(part["content"], part["length"]):
                if size > max_file_bytes:
                    raise ValueError(f"a feed file of {size} bytes is over the limit of {max_file_bytes}")
                try:
                    archive = zipfile.ZipFile(io.BytesIO(content))
                except zipfile.BadZipFile:
                    continue
                for name in archive.namelist():
                    kept = []
                    with archive.open(name) as lines:
                        for line in io.TextIOWrapper(lines, "utf-8", errors="replace", newline="\n"):
                            fields = line.rstrip("\r\n").split("\t")
                            if len(fields) == FEED_WIDTH:
                                kept.append([fields[k] for k in FEED_FIELDS.values()])
                            if len(kept) == 4096:
                                yield pd.DataFrame(kept, columns=list(FEED_FIELDS))
                                kept = []
                    yield pd.DataFrame(kept, columns=list(FEED_FIELDS), dtype=str)

    return archives.mapInPandas(rows, ", ".join(f"{c} string" for c in FEED_FIELDS))


def zip_feed(lines: DataFrame, line: str) -> DataFrame:
    """``(content, length)``: an archive of each batch of lines."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = io.BytesIO()
            with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
                archive.writestr("rows.csv", "\n".join(part[line]) + "\n")
            yield pd.DataFrame({"content": [out.getvalue()], "length": [out.tell()]})

    return lines.select(line).mapInPandas(run, "content binary, length long")


def append_monthly(rows: DataFrame, path: str, time: Column) -> None:
    """Append rows as compressed JSON lines, a folder a month."""
    rows.withColumn("month", F.date_format(time, "yyyy-MM")).write.mode("append").partitionBy("month").option("compression", "gzip").json(path)


def read_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All rows kept under ``path``; only months that a filter on ``month`` names are read."""
    return spark.read.schema(f"{schema}, month string").json(path)


def append_signals(rows: DataFrame, path: str) -> None:
    """Add rows as JSON lines to what is under ``path``."""
    rows.write.mode("append").json(path)


def read_signals(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Signals kept under ``path``; none where nothing has been written yet."""
    try:
        return spark.read.schema(schema).json(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def save_tables(tables: dict[str, DataFrame], path: str) -> None:
    """Replace the named tables under ``path``."""
    for name, rows in tables.items():
        rows.write.mode("overwrite").parquet(f"{path}/{name}")


def scan_posts(spark: SparkSession, path: str, aliases: dict[str, str]) -> DataFrame:
    """``(at, ticker, text)`` of a CSV of posts; old tickers get their present name."""
    rows = spark.read.schema("at string, ticker string, text string").csv(path, header=True, escape='"', multiLine=False)
    names = F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv])
    return rows.select(F.try_to_timestamp("at").alias("at"), F.coalesce(F.try_element_at(names, F.col("ticker")), "ticker").alias("ticker"), "text")


def scan_headlines(spark: SparkSession, path: str) -> DataFrame:
    """``(day, ticker, title)`` of a CSV of headlines; rows without a readable date, a ticker or a title go."""
    rows = spark.read.schema("date string, ticker string, title string").csv(path, header=True, escape='"')
    title = F.trim(F.regexp_replace("title", r"\s+", " "))
    out = rows.select(F.to_date(F.try_to_timestamp("date")).alias("day"), F.nullif(F.trim("ticker"), F.lit("")).alias("ticker"), F.nullif(title, F.lit("")).alias("title"))
    return out.dropna()


ARTICLES = "array<struct<title: string, description: string, url: string, seen: string>>"


def articles_to_documents(lists: DataFrame, payload: str) -> DataFrame:
    """A document for each article of JSON lists; articles whose time cannot be read are skipped."""
    one = lists.select(F.explode(F.from_json(payload, ARTICLES)).alias("a"))
    at = F.try_to_timestamp("a.seen", F.lit("yyyyMMdd'T'HHmmss'Z'"))
    return one.select(at.alias("at"), "a.url", F.concat_ws(" ", "a.title", F.nullif("a.description", F.lit(""))).alias("text")).where("at IS NOT NULL")


def prices_long(wide: DataFrame, symbols: list[str], time: str = "session") -> DataFrame:
    """``(time, symbol, close)`` of a table with a column a symbol; missing closes go."""
    return wide.unpivot([time], symbols, "symbol", "close").where("close IS NOT NULL")


def money(text: Column) -> Column:
    """``$1,234.50`` and ``-$3`` as numbers; null where it is none."""
    return F.regexp_replace(text, r"[$,\s]", "").try_cast("double")


def scan_transactions(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """The named columns of a CSV of card transactions; ``amount`` is a number."""
    rows = spark.read.schema("merchant string, month string, amount string, code string").csv(path, header=True)
    return rows.withColumn("amount", money(F.col("amount"))).select(*columns)
