"""Readers of single formats: bytes in, text or facts out. Spark deals the files; each call sees one."""

from __future__ import annotations

import ast
import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame

MAX_CELLS, MAX_CHARS = 200_000, 20_000_000
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


class LimitExceeded(ValueError):
    """A file holds more than a reader may take."""


def workbook_text(data: bytes, name: str = "workbook", cells: int = MAX_CELLS, chars: int = MAX_CHARS) -> str:
    """A line for each sheet and each filled cell: its coordinate and value, or its formula and the value it had."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        xml = lambda part: ElementTree.fromstring(z.read(part))
        shared = ["".join(t.text or "" for t in si.iter(f"{_MAIN}t")) for si in xml("xl/sharedStrings.xml")] if "xl/sharedStrings.xml" in z.namelist() else []
        targets = {r.get("Id"): r.get("Target", "").lstrip("/").removeprefix("xl/") for r in xml("xl/_rels/workbook.xml.rels")}
        out, size, filled = [f"[workbook] name={name}"], len(name) + 16, 0
        for k, sheet in enumerate(xml("xl/workbook.xml").iter(f"{_MAIN}sheet"), 1):
            lines = [f"[sheet] index={k} name={sheet.get('name')} state={sheet.get('state', 'visible')}"]
            for c in xml(f"xl/{targets[sheet.get(_REL)]}").iter(f"{_MAIN}c"):
                formula, value = c.find(f"{_MAIN}f"), c.findtext(f"{_MAIN}v")
                if c.get("t") == "s" and value is not None:
                    value = shared[int(value)]
                elif c.get("t") == "inlineStr":
                    value = "".join(t.text or "" for t in c.iter(f"{_MAIN}t"))
                elif c.get("t") == "b" and value is not None:
                    value = "True" if value == "1" else "False"
                if formula is not None:
                    lines.append(f"{c.get('r')}\tformula=={formula.text or ''}" + (f"\tcached_value={value}" if value is not None else ""))
                elif value is not None:
                    lines.append(f"{c.get('r')}\tvalue={value}")
            filled += len(lines) - 1
            size += sum(map(len, lines)) + len(lines)
            if filled > cells or size > chars:
                raise LimitExceeded("spreadsheet_cell_limit_exceeded" if filled > cells else "spreadsheet_text_limit_exceeded")
            out += lines
    return "\n".join(out)


def rtf_text(data: bytes) -> str:
    """Rich text without its control words, tables of fonts and colours, and pictures."""
    text = data.decode("latin-1")
    text = re.sub(r"\{\\\*?\\?(?:fonttbl|colortbl|stylesheet|info|pict)(?:[^{}]|\{[^{}]*\})*\}", "", text)
    text = re.sub(r"\\u(-?\d+)\??", lambda m: chr(int(m[1]) % 65536), text)
    text = re.sub(r"\\'([0-9a-fA-F]{2})", lambda m: bytes([int(m[1], 16)]).decode("cp1252", "replace"), text)
    text = re.sub(r"\\(?:par|line)\b ?", "\n", text)
    return re.sub(r"\\[a-zA-Z]+-?\d* ?|\\[^a-zA-Z]|[{}]", "", text).strip()


def printable_runs(text: str, least: int = 4) -> list[str]:
    """Stretches of at least four printable characters or tabs, stripped."""
    marked = "".join(c if c.isprintable() or c == "\t" else "\n" for c in text)
    return [run.strip() for run in marked.split("\n") if len(run) >= least and run.strip()]


def python_symbols(text: str) -> list[tuple[str, str, str, int, int, str, list[str]]]:
    """(kind, name, qualified name, first line, last line, signature, calls) of classes, functions and methods."""
    lines, out = text.splitlines(), []

    def name_of(node: ast.expr) -> str:
        if isinstance(node, ast.Name):
            return node.id
        if isinstance(node, ast.Attribute):
            return f"{before}.{node.attr}" if (before := name_of(node.value)) else node.attr
        return ""

    def walk(body: list[ast.stmt], parents: tuple[str, ...]) -> None:
        for node in body:
            if isinstance(node, ast.ClassDef | ast.FunctionDef | ast.AsyncFunctionDef):
                kind = "class" if isinstance(node, ast.ClassDef) else "method" if parents else "function"
                calls = sorted({name_of(c.func) for c in ast.walk(node) if isinstance(c, ast.Call)} - {""})
                out.append((kind, node.name, ".".join((*parents, node.name)), node.lineno, node.end_lineno or node.lineno, lines[node.lineno - 1].strip()[:1000], calls))
                walk(node.body, (*parents, node.name))

    walk(ast.parse(text).body, ())
    return out


def symbols_of_python(files: DataFrame) -> DataFrame:
    """files (doc_id, text) -> symbols of those that parse; others give none here and are left to patterns."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, text in zip(b["doc_id"], b["text"], strict=True):
                try:
                    rows += [(i, *s) for s in python_symbols(text or "")]
                except (SyntaxError, ValueError, RecursionError, MemoryError):
                    continue
            yield pd.DataFrame(rows, columns=["doc_id", "kind", "name", "qualified_name", "start_line", "end_line", "signature", "calls"])

    return files.select("doc_id", "text").mapInPandas(run, "doc_id long, kind string, name string, qualified_name string, start_line long, end_line long, signature string, calls array<string>")
