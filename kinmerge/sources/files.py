"""Sources as DataFrames of (key, updated, payload): files, tables and pushed events; cursors and source settings.

payload is one JSON object a row, so that sources of any shape share what follows.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Mapping
from urllib.parse import urlsplit

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*(\.[A-Za-z_][A-Za-z0-9_]*)*")


def _since(rows: DataFrame, cursor: str | None) -> DataFrame:
    """Rows after the cursor, compared as text; rows without a time always pass."""
    return rows if cursor is None else rows.where(F.col("updated").isNull() | (F.col("updated") > cursor))


def _text(df: DataFrame, column: str | None) -> Column:
    return F.col(f"`{column}`").cast("string") if column and column in df.columns else F.lit(None).cast("string")


def _packed(df: DataFrame, key: Column, updated: str | None) -> DataFrame:
    return df.select(key.alias("key"), _text(df, updated).alias("updated"), F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns))).alias("payload"))


def with_row_index(df: DataFrame, column: str) -> DataFrame:
    """df with each row's number, from 0, in the order its file is read in.

    Partitions are counted first, one row each, so the numbers need neither a sort nor a single task.
    """
    part, inside = F.spark_partition_id(), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    counts = df.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("part", before.alias("start"))
    marked = df.withColumns({"_part": part, "_inside": inside})
    # as many rows as partitions
    joined = marked.join(F.broadcast(starts), F.col("_part") == F.col("part"))
    return joined.withColumn(column, F.col("start") + F.col("_inside")).select(*(f"`{c}`" for c in df.columns), column)


def csv(spark: SparkSession, path: str, key: str | None = None, updated: str | None = None, cursor: str | None = None, sep: str = ",", encoding: str = "UTF-8") -> DataFrame:
    """A CSV file with a header, all text; quoted values may hold line feeds. Without a key column a row's key is its number."""
    df = spark.read.csv(path, header=True, sep=sep, encoding=encoding, multiLine=True, escape='"', ignoreLeadingWhiteSpace=False)
    df = df.toDF(*(c.lstrip("\ufeff").strip() for c in df.columns))
    if key:
        return _since(_packed(df, _text(df, key), updated), cursor)
    numbered = with_row_index(df, "_row")
    body = F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns)))
    return _since(numbered.select(F.col("_row").cast("string").alias("key"), _text(df, updated).alias("updated"), body.alias("payload")), cursor)


def jsonl(spark: SparkSession, path: str, key: str = "id", updated: str | None = None, cursor: str | None = None) -> DataFrame:
    """One JSON object a line; blank lines are left out but count. Payloads stay as they are written. Without the key field a row's key is its line's number."""
    lines = with_row_index(spark.read.text(path), "_line").where(F.trim("value") != "")
    top = F.from_json("value", "map<string,string>")
    own = F.coalesce(F.try_element_at(top, F.lit(key)), F.col("_line").cast("string"))
    at = F.try_element_at(top, F.lit(updated)) if updated else F.lit(None).cast("string")
    return _since(lines.select(own.alias("key"), at.alias("updated"), F.col("value").alias("payload")), cursor)


def rows(df: DataFrame, key: str, updated: str | None = None, cursor: str | None = None) -> DataFrame:
    """Any DataFrame as a source: a table read by Spark, or rows a program made. The filter is on the column itself, to be pushed down."""
    if cursor is not None and updated:
        df = df.where(F.col(updated).isNull() | (F.col(updated) > F.lit(cursor).cast(df.schema[updated].dataType)))
    return _packed(df, _text(df, key), updated)


def jdbc(spark: SparkSession, url: str, table: str, key: str, updated: str | None = None, cursor: str | None = None, options: Mapping[str, str] | None = None) -> DataFrame:
    """A database table; names are checked as they go into SQL."""
    for name in (table, key, *([updated] if updated else [])):
        if not _NAME.fullmatch(name):
            raise ValueError(f"not an identifier: {name!r}")
    return rows(spark.read.format("jdbc").options(url=url, dbtable=table, **(options or {})).load(), key, updated, cursor)


def identified(events: DataFrame, payload: str = "payload") -> DataFrame:
    """Pushed events, batch or stream: those of type identify, keyed by user or else anonymous id."""
    e = F.from_json(payload, "type string, userId string, anonymousId string, timestamp string, traits string")
    parsed = events.select(e.alias("e")).where("e.type = 'identify'")
    body = F.to_json(F.struct(F.col("e.userId").alias("userId"), F.col("e.timestamp").alias("timestamp"), F.from_json("e.traits", "map<string,string>").alias("traits")))
    return parsed.select(F.coalesce("e.userId", "e.anonymousId").alias("key"), F.col("e.timestamp").alias("updated"), body.alias("payload")).where("key is not null")


def next_cursor(read: DataFrame) -> DataFrame:
    """One row: the greatest time read, to be kept once the batch is in."""
    return read.agg(F.max("updated").alias("cursor"))


def check_settings(settings: Mapping[str, object]) -> None:
    """Secrets come by the name of an environment variable, never as values."""
    for name in settings:
        if re.search(r"token|secret|password|api_?key", name, re.IGNORECASE) and not name.endswith("_env"):
            raise ValueError(f"{name}: give the name of an environment variable as {name}_env")


def check_url(url: str, hosts: Iterable[str]) -> None:
    """https only, to hosts that one of the patterns matches whole."""
    parts = urlsplit(url)
    if parts.scheme != "https" or not any(re.fullmatch(h, parts.hostname or "") for h in hosts):
        raise ValueError(f"not allowed: {parts.scheme}://{parts.hostname}")


def retrying(call: Callable[[], tuple[int, Mapping[str, str], object]], sleep: Callable[[float], None], attempts: int = 6, cap: float = 30.0) -> object:
    """The body of the first answer below 400. 429 and 5xx are tried again, after retry-after or doubling waits; others are final."""
    for n in range(attempts):
        status, headers, body = call()
        if status < 400:
            return body
        if status != 429 and status < 500:
            break
        if n + 1 < attempts:
            sleep(min(cap, float(headers.get("retry-after", 2.0**n))))
    raise OSError(f"status {status}")


def pages(fetch: Callable[[object], tuple[list, object]], start: object = None):
    """Items of all pages of a paged interface: fetch(place) gives (items, next place or None)."""
    place = start
    while True:
        items, place = fetch(place)
        yield from items
        if place is None:
            return
