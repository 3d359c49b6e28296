"""Schema discovery: signatures are counted in Spark, and the set of them is merged as a type tree on the driver.

The whole set is merged at once to a fixpoint, so the result does not depend on the order of rows or partitions.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.types import ASCII, BYTES, DECIMAL, NAMES, NULL, SINT, SLONG, SUPER, UINT, ULONG, infer_type
from ..sources.text import split_fields

MAX_SHAPES = 50_000
SPARK_TYPES = {UINT: "int", SINT: "int", ULONG: "bigint", SLONG: "bigint", ASCII: "string", BYTES: "string", DECIMAL: "decimal(38,9)", NULL: "string"}


def signature(line: Column, force_ascii: bool = True) -> Column:
    """The type codes of a line's fields as a string of digits."""
    return F.array_join(F.transform(split_fields(line), lambda v: infer_type(v, force_ascii).cast("string")), "")


def signature_counts(lines: DataFrame, line: str = "line") -> DataFrame:
    return lines.groupBy(signature(F.col(line)).alias("sig")).agg(F.count("*").alias("n"))


@dataclass
class Node:
    children: dict[int, Node] = field(default_factory=dict)
    optional: bool = False
    count: int = 0
    raw: list[str] = field(default_factory=list)

    def total(self) -> int:
        return self.count + sum(c.total() for c in self.children.values())


@dataclass(frozen=True)
class Template:
    template_id: int
    types: tuple[int, ...]
    optional: tuple[bool, ...]
    count: int
    raw: tuple[str, ...]


def _join(a: Node, b: Node) -> None:
    """b into a, type by type."""
    a.count += b.count
    a.raw += b.raw
    a.optional |= b.optional
    for t, c in b.children.items():
        if t in a.children:
            _join(a.children[t], c)
        else:
            a.children[t] = c


def _targets(t: int, into: Node) -> list[int]:
    """Children of `into` that can take type t, nearest first."""
    if t == NULL:
        others = [c for c in into.children if c != NULL]
        return [NULL] * (NULL in into.children) + (others if len(others) == 1 else [])
    out = []
    while t in NAMES_OF_NUMBERS or t == DECIMAL:
        if t in into.children:
            out.append(t)
        if t == DECIMAL:
            return out
        t = SUPER[t]
    return [t] if t in into.children else []


NAMES_OF_NUMBERS = {UINT, SINT, ULONG, SLONG}


def contains(small: Node, large: Node) -> bool:
    """Whether every path below `small` has a place below `large`, widening numbers and absorbing nulls."""
    if small.count and not large.count:
        return False
    return all(any(contains(c, large.children[k]) for k in _targets(t, large)) for t, c in small.children.items())


def _fold(small: Node, large: Node) -> None:
    """`small`, which `large` contains, into it."""
    large.count += small.count
    large.raw += small.raw
    large.optional |= small.optional
    for t, c in small.children.items():
        k = next(k for k in _targets(t, large) if contains(c, large.children[k]))
        large.children[k].optional |= t == NULL and k != NULL
        _fold(c, large.children[k])


def _down(node: Node, merge_signed: bool) -> bool:
    changed = False
    kids = node.children
    for a, b in ((UINT, ULONG), (SINT, SLONG), *(((UINT, SINT), (ULONG, SLONG)) if merge_signed else ())):
        if a in kids and b in kids:
            _join(kids[b], kids.pop(a))
            changed = True
    others = [t for t in kids if t != NULL]
    if NULL in kids and len(others) == 1:
        _join(kids[others[0]], kids.pop(NULL))
        kids[others[0]].optional = True
        changed = True
    return any([_down(c, merge_signed) for c in kids.values()]) or changed


def _up(node: Node) -> bool:
    changed = any([_up(c) for c in node.children.values()])
    for t in (UINT, SINT, ULONG, SLONG):
        if t in node.children and DECIMAL in node.children and contains(node.children[t], node.children[DECIMAL]):
            _fold(node.children.pop(t), node.children[DECIMAL])
            changed = True
    return changed


def build_tree(shapes: list[tuple[str, int]]) -> Node:
    root = Node()
    for sig, n in sorted(shapes):
        at = root
        for t in map(int, sig):
            at = at.children.setdefault(t, Node())
        at.count += n
        at.raw.append(sig)
    return root


def merge_shapes(shapes: list[tuple[str, int]], merge_signed: bool = False) -> list[Template]:
    """Templates of a set of (signature, count), ids by falling count, then signature."""
    root = build_tree(shapes)
    while _down(root, merge_signed) | _up(root):
        pass
    found, todo = [], [(root, (), ())]
    while todo:
        node, types, opt = todo.pop()
        if node.count:
            found.append((types, opt, node.count, tuple(sorted(node.raw))))
        todo += [(c, (*types, t), (*opt, c.optional or t == NULL)) for t, c in node.children.items()]
    found.sort(key=lambda x: (-x[2], x[0]))
    return [Template(i, *x) for i, x in enumerate(found)]


def tree_report(root: Node, name: str = "", depth: int = 0) -> str:
    """The tree as indented lines with counts."""
    line = f"{'  ' * depth}{name or 'records'} {root.total()}{' optional' * root.optional}\n"
    return line + "".join(tree_report(c, NAMES[t], depth + 1) for t, c in sorted(root.children.items()))


def discover(lines: DataFrame, line: str = "line", merge_signed: bool = False, most: int = MAX_SHAPES) -> list[Template]:
    """Templates of delimited lines. The different signatures come to the driver; more than `most` are an error."""
    found = signature_counts(lines, line).limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"more than {most} record shapes; the text is hardly delimited records")
    return merge_shapes([(r.sig, r.n) for r in found], merge_signed)


def mapping(spark, templates: list[Template]) -> DataFrame:
    """sig -> template_id and resolved type codes: a row per shape, at most MAX_SHAPES, so it can be broadcast."""
    rows = [(s, t.template_id, list(t.types)) for t in templates for s in t.raw]
    return spark.createDataFrame(rows, "sig string, template_id int, types array<int>")


def template_table(spark, templates: list[Template]) -> DataFrame:
    rows = [(t.template_id, ",".join(NAMES[x] + "?" * o for x, o in zip(t.types, t.optional, strict=True)), len(t.types), t.count) for t in templates]
    return spark.createDataFrame(rows, "template_id int, types string, n_fields int, n long")
