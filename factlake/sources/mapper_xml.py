"""Mapper XML files to statements, result maps and fragments.

A file is parsed whole where it lies, by a generator over Arrow batches. DOCTYPEs are dropped and external
entities are off; text inside dynamic tags and CDATA is kept; includes are expanded five levels deep. A file
that cannot be parsed gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame

KINDS = ("select", "insert", "update", "delete")
DEPTH = 5
STATEMENTS = "source_file string, mapper_interface string, method_name string, sql_type string, sql_text string, xml_line int"
MAPPINGS = "source_file string, mapper_interface string, java_type string, property_name string, column_name string, is_id boolean"
_DOCTYPE = re.compile(r"<!DOCTYPE[^>\[]*(\[[^\]]*\])?[^>]*>", re.I)


def parsed(content: str) -> ElementTree.Element | None:
    if "<!ENTITY" in content:
        content = re.sub(r"<!ENTITY[^>]*>", "", content)
    try:
        return ElementTree.fromstring(_DOCTYPE.sub("", content))
    except ElementTree.ParseError:
        return None


def fragments(root: ElementTree.Element) -> dict[str, ElementTree.Element]:
    """S7."""
    return {e.get("id"): e for e in root.findall("sql") if e.get("id")}


def statement_text(e: ElementTree.Element, known: dict[str, ElementTree.Element], depth: int = 0) -> str:
    """All text, includes replaced by their fragments, unknown ones by nothing."""
    out = [e.text or ""]
    for child in e:
        if child.tag == "include":
            named = known.get((child.get("refid") or "").rpartition(".")[2])
            if named is not None and depth < DEPTH:
                out.append(statement_text(named, known, depth + 1))
        elif child.tag != "selectKey":
            out.append(statement_text(child, known, depth))
        out.append(child.tail or "")
    return " ".join(" ".join(out).split())


def line_of(lines: list[str], tag: str, name: str) -> int:
    """The line of the element, whose id may stand on the next one; else 0."""
    for i, line in enumerate(lines):
        if re.search(rf"<{tag}\b", line) and any(f'id="{name}"' in x for x in lines[i : i + 2]):
            return i + 1
    return 0


def statements_of(path: str, content: str) -> Iterator[tuple]:
    """By kind in a fixed order; elements without an id are passed over."""
    root = parsed(content)
    if root is None:
        return
    known, lines = fragments(root), content.split("\n")
    for kind in KINDS:
        for e in root.findall(kind):
            if e.get("id"):
                yield path, root.get("namespace"), e.get("id"), kind.upper(), statement_text(e, known), line_of(lines, kind, e.get("id"))


def mappings_of(path: str, content: str) -> Iterator[tuple]:
    """The entries of result maps."""
    root = parsed(content)
    for m in [] if root is None else root.findall("resultMap"):
        for e in m:
            if e.tag in ("id", "result"):
                yield path, root.get("namespace"), m.get("type"), e.get("property"), e.get("column"), e.tag == "id"


def _each(files: DataFrame, of, schema: str) -> DataFrame:
    names = [f.split(" ")[0] for f in schema.split(", ")]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [r for p, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for r in of(p, c or "")]
            kinds = [{"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_()}[f.split(" ")[1]] for f in schema.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * len(kinds), kinds)], names=names)

    return files.select("path", "content").mapInArrow(scan, schema)


def statements(files: DataFrame) -> DataFrame:
    """S4 and S5 over a table of files (path, content text)."""
    return _each(files, statements_of, STATEMENTS)


def mappings(files: DataFrame) -> DataFrame:
    return _each(files, mappings_of, MAPPINGS)
