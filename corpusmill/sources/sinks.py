"""Sinks of lines in order: archives with a header and a receipt, tables of comma-separated values, event messages.

Lines are sorted by ranges, so each file is a part of the order and no task sees all; the header is a file of its own that
comes first. A folder appears under its name when it is whole.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.sources.versions import _path

#: What a sheet program tells UTF-8 by.
MARK = "﻿"


def publish_lines(lines: DataFrame, order: list[str], header: str, folder: str, compression: str = "gzip") -> DataFrame:
    """lines (line, columns of order): write header, then lines in order. -> part, bytes, sha256 of each file, in order.

    The folder is written under another name and renamed when all is there; one that exists is replaced."""
    spark = lines.sparkSession
    draft = f"{folder}.{uuid.uuid4().hex}.draft"
    spark.createDataFrame([(header,)], "line string").coalesce(1).write.option("compression", compression).text(f"{draft}/0-header")
    lines.repartitionByRange(*order).sortWithinPartitions(*order).select("line").write.option("compression", compression).text(f"{draft}/1-lines")
    fs, where = _path(spark, folder)
    fs.delete(where, True)
    if not fs.rename(_path(spark, draft)[1], where):
        raise OSError(f"{folder} could not be put in place")
    return receipts(spark, folder)


def receipts(spark: SparkSession, folder: str) -> DataFrame:
    """part, bytes, sha256 of each file of an archive, as they lie there."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    part = F.concat_ws("/", F.element_at(F.split("path", "/"), -2), F.element_at(F.split("path", "/"), -1))
    return files.select(part.alias("part"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def lines_of(spark: SparkSession, folder: str) -> DataFrame:
    """part, line of a published folder."""
    read = lambda sub: spark.read.text(f"{folder}/{sub}").select(F.lit(sub).alias("part"), F.col("value").alias("line"))
    return read("0-header").unionByName(read("1-lines"))


def quoted(c: Column) -> Column:
    """A value of a table of comma-separated values: in quotes if it holds a comma, a quote or a line's end; null is empty."""
    text = F.coalesce(c.cast("string"), F.lit(""))
    return F.when(text.rlike('[,"\r\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def csv_line(columns: list[Column]) -> Column:
    """Lines end with a carriage return, to which the sink adds a line feed."""
    return F.concat(F.concat_ws(",", *map(quoted, columns)), F.lit("\r"))


def csv_header(names: list[str]) -> str:
    return MARK + ",".join(names) + "\r"


def message(number: Column, kind: Column, payload: Column) -> Column:
    """An event for a stream of server-sent events; payload: a struct, whose nulls are told."""
    return F.concat(F.lit("id: "), number.cast("string"), F.lit("\nevent: "), kind, F.lit("\ndata: "), F.to_json(payload, {"ignoreNullFields": "false"}), F.lit("\n\n"))


def task_message(e: DataFrame) -> Column:
    """e: event_id, task_id, sequence, global_sequence, type, timestamp, data."""
    fields = ("event_id", "task_id", "sequence", "global_sequence", "type", "timestamp", "data")
    return message(e["sequence"], e["type"], F.struct(*[e[f] for f in fields]))


def conversation_message(e: DataFrame) -> Column:
    """As of a task, numbered within the conversation."""
    fields = [e["event_id"], e["conversation_id"], e["task_id"], e["conversation_sequence"].alias("sequence"), e["sequence"].alias("task_sequence"), e["global_sequence"], e["type"], e["timestamp"], e["data"]]
    return message(e["conversation_sequence"], e["type"], F.struct(*fields))


def audit_message(e: DataFrame) -> Column:
    """Numbered over all, under one kind, with what its task says of who asked for it."""
    fields = [
        e["event_id"], e["task_id"].alias("trace_id"), e["task_id"], e["global_sequence"].alias("sequence"), e["sequence"].alias("task_sequence"), e["conversation_id"], e["type"], e["timestamp"],
        e["trigger_source"], e["client_id"], e["client_request_id"], e["project_id"], e["project_code"], e["data"],
    ]
    return message(e["global_sequence"], F.lit("audit.event"), F.struct(*fields))
