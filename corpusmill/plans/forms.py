"""Queries over formats of files, scans of paths, and shapes of records."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions import paths as P
from corpusmill.operators.windows import global_sequence
from corpusmill.sources import files as S
from corpusmill.sources.tables import importable, read

#: Formats of format_texts, by the customer's number.
FORMATS = ("docx", "odt", "xlsx", "rtf", "zip", "html", "doc")


def _zipped(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def as_format(kind: str, one: str, two: str) -> bytes:
    """A small file of a format that holds two texts."""
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    relations = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    if kind == "docx":
        return _zipped({"word/document.xml": f"<d><p><t>{one}</t></p><p><t>{two}</t></p></d>", "word/styles.xml": "<s>no text</s>"})
    if kind == "odt":
        return _zipped({"mimetype": "x", "content.xml": f"<office><text>{one}</text></office>"})
    if kind == "xlsx":
        sheet = f'<worksheet xmlns="{main}"><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="B1"><f>1+1</f><v>2</v></c><c r="C1" t="inlineStr"><is><t>{two}</t></is></c></row></sheetData></worksheet>'
        return _zipped({
            "xl/workbook.xml": f'<workbook xmlns="{main}" xmlns:r="{relations}"><sheets><sheet name="S" sheetId="1" state="hidden" r:id="r1"/></sheets></workbook>',
            "xl/_rels/workbook.xml.rels": '<Relationships xmlns="x"><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>',
            "xl/sharedStrings.xml": f'<sst xmlns="{main}"><si><t>{one}</t></si></sst>', "xl/worksheets/sheet1.xml": sheet,
        })
    if kind == "rtf":
        return (r"{\rtf1\ansi {\fonttbl{\f0 Arial;}}" + one + r"\par " + two + r"\'e9}").encode()
    if kind == "zip":
        return _zipped({"a.txt": one, "../out.txt": two, "/abs.txt": two, "sub/b.txt": two})
    if kind == "doc":
        return S.OLE + bytes(8) + one.encode("utf-16-le") + bytes(4) + b"\x01" + two[:4].encode() + b"\x01"
    return f"<p>{one}</p>".encode()


def format_texts(spark: SparkSession, d: str) -> DataFrame:
    """What is read from files of many formats that hold customers' names."""
    importable(spark)

    @F.pandas_udf("binary")
    def content(kind: pd.Series, one: pd.Series, two: pd.Series) -> pd.Series:
        return pd.Series([as_format(*x) for x in zip(kind, one, two, strict=True)])

    kind = F.element_at(F.array(*map(F.lit, FORMATS)), (F.col("c_custkey") % len(FORMATS) + 1).cast("int"))
    c = read(spark, d, "customer").select("c_custkey", F.concat_ws(".", F.concat(F.lit("f"), "c_custkey"), kind).alias("path"), content(kind, "c_name", "c_mktsegment").alias("content"))
    out = S.extract(c)
    return out.select(F.regexp_extract("path", r"f(\d+)", 1).cast("long").alias("c_custkey"), F.replace("text", F.lit("\n"), F.lit("|")).alias("text"), F.split_part("extractor", F.lit("-"), F.lit(1)).alias("extractor"), "error")


def scan_order(spark: SparkSession, d: str) -> DataFrame:
    """Files and directories in the order of a scan by levels."""
    docs = read(spark, d, "documents")
    part = lambda name, n: F.concat(F.lit(name), (F.col("doc_id") % n).cast("string"))
    middle = F.when(F.col("doc_id") % 11 == 0, "node_modules").when(F.col("doc_id") % 2 == 0, part("Dir", 5)).otherwise(part("dir", 7))
    path = F.when(F.col("doc_id") % 13 == 0, part("Root file ", 10_000_000)).otherwise(F.concat_ws("/", "source", middle, F.when(F.col("doc_id") % 3 == 0, part("Sub", 4)), part("f", 10_000_000)))
    return global_sequence(P.scanned(docs.select(path.alias("path"))), ["depth", "folded", "path"], "position").select("path", "kind", "position")


def contained_paths(spark: SparkSession, d: str) -> DataFrame:
    """Which paths lie in the root that they are asked for in."""
    c = read(spark, d, "customer").select("c_custkey")
    tails = ("a/b", "../top", "../top0/x", "..", "a/../../top/y", "a/./b/..", "/a//b/", "../../top/x", "")
    tail = F.element_at(F.array(*map(F.lit, tails)), (F.col("c_custkey") % len(tails) + 1).cast("int"))
    return c.select("c_custkey", P.contained(F.concat(F.lit("/data/top/"), tail), F.lit("/data/top")).alias("inside"))


def response_shape(spark: SparkSession, d: str) -> DataFrame:
    """Orders as an interface shows them: other names, what follows from a status, and what stands for nothing."""
    o = read(spark, d, "orders")
    large = F.when(F.col("o_totalprice") > 200_000, "large")
    return o.select(
        F.col("o_orderkey").alias("id"), F.concat(F.lit("ORD-"), "o_orderkey").alias("code"), (F.col("o_orderstatus") == "O").alias("open"), (F.col("o_totalprice") > 100_000).alias("needs_approval"),
        F.coalesce(large, F.lit("")).alias("label"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"),
    )


def field_schemas(spark: SparkSession, d: str) -> DataFrame:
    """A JSON schema for each field contract: its type, what it may be, and whether null will do."""
    p = read(spark, d, "part").select("p_partkey", (F.col("p_size") % 3).alias("k"), (F.col("p_size") % 2 == 0).alias("required"), "p_name", "p_brand", "p_type")
    kind = F.when(F.col("k") == 0, "string").when(F.col("k") == 1, "number").otherwise("array")
    types = F.when(F.col("required"), F.array(kind)).otherwise(F.array(kind, F.lit("null")))
    allowed = F.when(F.col("k") == 0, F.array("p_brand", "p_type"))
    value = F.struct(types.alias("type"), F.col("p_name").alias("description"), allowed.alias("enum"), F.when(F.col("k") == 2, F.struct(F.lit("string").alias("type"))).alias("items"))
    schema = F.struct(F.lit("object").alias("type"), F.struct(value.alias("value"), F.struct(F.array(F.lit("number")).alias("type")).alias("confidence")).alias("properties"), F.when(F.col("required"), F.array(F.lit("value"))).otherwise(F.array().cast("array<string>")).alias("required"), F.lit(False).alias("additionalProperties"))
    return p.select("p_partkey", F.to_json(schema).alias("schema"))


def merged_metadata(spark: SparkSession, d: str) -> DataFrame:
    """Two maps as one, where the later one wins."""
    c = read(spark, d, "customer")
    left = F.create_map(F.lit("name"), "c_name", F.lit("segment"), "c_mktsegment")
    right = F.when(F.col("c_custkey") % 3 == 0, F.create_map(F.lit("segment"), F.lit("other"), F.lit("extra"), F.col("c_custkey").cast("string"))).otherwise(F.create_map(F.lit("seen"), F.lit("yes")))
    kept = F.map_filter(left, lambda k, v: ~F.map_contains_key(right, k))
    merged = F.array_sort(F.map_entries(F.map_concat(kept, right)))
    return c.select("c_custkey", F.array_join(F.transform(merged, lambda e: F.concat_ws("=", e["key"], e["value"])), ";").alias("merged"))


QUERIES = {f.__name__: f for f in (format_texts, scan_order, contained_paths, response_shape, field_schemas, merged_metadata)}

ORACLE = {
    "format_texts": """SELECT c_custkey, CASE c_custkey % 7 WHEN 0 THEN c_name || ' ' || c_mktsegment WHEN 1 THEN c_name
        WHEN 2 THEN '[workbook] name=f' || c_custkey || '.xlsx|[sheet] index=1 name=S state=hidden|A1' || chr(9) || 'value=' || c_name || '|B1' || chr(9) || 'formula==1+1' || chr(9) || 'cached_value=2|C1' || chr(9) || 'value=' || c_mktsegment
        WHEN 3 THEN c_name || '|' || c_mktsegment || 'é' WHEN 4 THEN '[member] a.txt|' || c_name || '|[left out] ../out.txt|[left out] /abs.txt|[member] sub/b.txt|' || c_mktsegment
        WHEN 5 THEN '<p>' || c_name || '</p>' ELSE c_name || '|' || c_mktsegment[1:4] END AS text,
      CASE c_custkey % 7 WHEN 0 THEN 'office' WHEN 1 THEN 'office' WHEN 2 THEN 'workbook' WHEN 3 THEN 'rtf' WHEN 4 THEN 'archive' WHEN 5 THEN 'utf' ELSE 'ole' END AS extractor, CAST(NULL AS VARCHAR) AS error FROM customer""",
    "scan_order": """WITH f AS (SELECT CASE WHEN doc_id % 13 = 0 THEN 'Root file ' || doc_id % 10000000 ELSE concat_ws('/', source, CASE WHEN doc_id % 11 = 0 THEN 'node_modules' WHEN doc_id % 2 = 0 THEN 'Dir' || doc_id % 5 ELSE 'dir' || doc_id % 7 END, CASE WHEN doc_id % 3 = 0 THEN 'Sub' || doc_id % 4 END, 'f' || doc_id % 10000000) END AS path FROM documents),
      p AS (SELECT DISTINCT string_split(path, '/') AS parts FROM f), l AS (SELECT parts, unnest(generate_series(1, len(parts))) AS depth FROM p),
      m AS (SELECT DISTINCT parts[1:depth] AS parts, depth, CASE WHEN depth < len(parts) THEN 'directory' ELSE 'file' END AS kind FROM l)
      SELECT array_to_string(parts, '/') AS path, kind, row_number() OVER (ORDER BY depth, list_transform(parts, lambda x: lower(x)), array_to_string(parts, '/')) AS position FROM m WHERE NOT list_contains(parts[1:depth - 1], 'node_modules')""",
    "contained_paths": "SELECT c_custkey, c_custkey % 9 NOT IN (2, 3, 7) AS inside FROM customer",
    "response_shape": "SELECT o_orderkey AS id, 'ORD-' || o_orderkey AS code, o_orderstatus = 'O' AS open, o_totalprice > 100000 AS needs_approval, CASE WHEN o_totalprice > 200000 THEN 'large' ELSE '' END AS label, strftime(o_orderdate, '%Y-%m-%d') AS date FROM orders",
    "field_schemas": """WITH p AS (SELECT *, CASE p_size % 3 WHEN 0 THEN 'string' WHEN 1 THEN 'number' ELSE 'array' END AS kind, p_size % 2 = 0 AS required FROM part)
      SELECT p_partkey, '{"type":"object","properties":{"value":{"type":["' || kind || '"' || CASE WHEN required THEN '' ELSE ',"null"' END || '],"description":"' || p_name || '"' || CASE kind WHEN 'string' THEN ',"enum":["' || p_brand || '","' || p_type || '"]' WHEN 'array' THEN ',"items":{"type":"string"}' ELSE '' END
        || '},"confidence":{"type":["number"]}},"required":[' || CASE WHEN required THEN '"value"' ELSE '' END || '],"additionalProperties":false}' AS schema FROM p""",
    "merged_metadata": "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'extra=' || c_custkey || ';name=' || c_name || ';segment=other' ELSE 'name=' || c_name || ';seen=yes;segment=' || c_mktsegment END AS merged FROM customer",
}
