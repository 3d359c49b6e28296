"""Template catalogs as XML, optionally gzipped, through the cluster's file systems."""

from __future__ import annotations

import gzip
import xml.etree.ElementTree as ET

from pyspark.sql import SparkSession

from ..functions.types import ASCII, BYTES, DECIMAL, NULL, SINT, SLONG, UINT, ULONG
from ..operators.schema import Template

TAGS = {UINT: "uInt32", SINT: "int32", ULONG: "uInt64", SLONG: "int64", ASCII: "string", BYTES: "byteVector", DECIMAL: "decimal", NULL: "string"}


def to_xml(templates: list[Template], operators: dict[tuple[int, int], str] | None = None) -> bytes:
    """Templates with a field element for each type; operators: (template_id, position) -> its name."""
    top = ET.Element("templates")
    for t in templates:
        node = ET.SubElement(top, "template", id=str(t.template_id), count=str(t.count), shapes=" ".join(t.raw))
        for i, (kind, opt) in enumerate(zip(t.types, t.optional, strict=True)):
            f = ET.SubElement(node, TAGS[kind], name=f"c{i}", kind=str(kind))
            if opt:
                f.set("presence", "optional")
            if op := (operators or {}).get((t.template_id, i)):
                ET.SubElement(f, op)
            elif kind == DECIMAL:
                ET.SubElement(ET.SubElement(f, "exponent"), "default", value="2")
    return ET.tostring(top, encoding="utf-8", xml_declaration=True)


def from_xml(raw: bytes) -> list[Template]:
    """The inverse; raw may be gzipped, and its elements may lie in a namespace. Unknown child elements are operators and are left out; a catalog without a template is an error."""
    raw = gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw
    back = {v: k for k, v in reversed(TAGS.items())}
    out = []
    name = lambda e: e.tag.rpartition("}")[2]
    for node in ET.fromstring(raw).iter():
        if name(node) != "template":
            continue
        fields = [f for f in node if name(f) in back]
        kinds = tuple(int(f.get("kind", back[name(f)])) for f in fields)
        shapes = node.get("shapes")
        out.append(Template(int(node.get("id", len(out))), kinds, tuple(f.get("presence") == "optional" for f in fields), int(node.get("count", 0)), tuple(shapes.split(" ")) if shapes is not None else ("".join(map(str, kinds)),)))
    if not out:
        raise ValueError("a catalog without a template")
    return out


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def save(spark: SparkSession, raw: bytes, path: str) -> None:
    """Write a small file in place of what is there."""
    p, fs = _path(spark, path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(raw))
    finally:
        out.close()


def load(spark: SparkSession, path: str) -> bytes:
    return bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])
