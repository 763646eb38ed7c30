"""A subset of Cypher over a stored graph, compiled to DataFrame operations.

    MATCH (n[:Label [{p: v}]])[-[r[:R] [{p: v}]]->(m ...)] [, ...]
    [WHERE cond AND|OR ...] RETURN [DISTINCT] items [ORDER BY ...] [SKIP n] [LIMIT n]
    CREATE (n:Label {...}) | MATCH ... CREATE (a)-[:R {...}]->(b) | MATCH ... DETACH DELETE n

A label is a partition of the node table, a relation two joins on node ids, a
property map equality filters.  ``count``, ``sum``, ``avg``, ``min``, ``max`` and
``collect`` in RETURN group by the other items.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stemma.plans.store import EDGE_SCHEMA, bucket_of

TOKEN = re.compile(r"\s*(?:(?P<str>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<num>\d+(?:\.\d+)?)|(?P<par>\$\w+)|(?P<op><=|>=|<>|!=|->|<-|=~|[-=<>(){}\[\]:,.*|])|(?P<word>\w+))")
AGGREGATES = {"count", "sum", "avg", "min", "max", "collect"}


#: Matches that the lesser end of a relation to create may have.
MATCHES = 100_000


class QueryError(ValueError):
    """A query outside the subset."""


@dataclass
class Pattern:
    """A node or a relation of a pattern."""

    name: str
    label: str | None = None
    properties: dict = field(default_factory=dict)
    source: str | None = None
    target: str | None = None


class Parser:
    def __init__(self, text: str, parameters: dict):
        self.tokens, self.at, self.parameters, self.unnamed = [], 0, parameters, 0
        place = 0
        text = text.strip().rstrip(";")
        while place < len(text):
            m = TOKEN.match(text, place)
            if not m:
                raise QueryError(f"unexpected text at {text[place : place + 20]!r}")
            self.tokens.append((m.lastgroup, m.group(m.lastgroup)))
            place = m.end()
            while place < len(text) and text[place].isspace():
                place += 1

    def peek(self, *wanted: str) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at][1].upper() in wanted and self.tokens[self.at][0] != "str"

    def take(self, *wanted: str) -> str | None:
        if self.peek(*wanted):
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def need(self, *wanted: str) -> str:
        got = self.take(*wanted)
        if got is None:
            raise QueryError(f"expected {' or '.join(wanted)} at {self.tokens[self.at][1] if self.at < len(self.tokens) else 'the end'!r}")
        return got

    def word(self) -> str:
        if self.at >= len(self.tokens) or self.tokens[self.at][0] != "word":
            raise QueryError("expected a name")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def value(self):
        if self.at >= len(self.tokens):
            raise QueryError("expected a value")
        negative = self.take("-")
        kind, text = self.tokens[self.at]
        self.at += 1
        if kind == "str":
            return re.sub(r"\\(.)", r"\1", text[1:-1])
        if kind == "num":
            number = float(text) if "." in text else int(text)
            return -number if negative else number
        if kind == "par":
            if text[1:] not in self.parameters:
                raise QueryError(f"no parameter {text}")
            return self.parameters[text[1:]]
        if text.upper() in ("TRUE", "FALSE", "NULL"):
            return {"TRUE": True, "FALSE": False, "NULL": None}[text.upper()]
        raise QueryError(f"expected a value at {text!r}")

    def properties(self) -> dict:
        out = {}
        if self.take("{"):
            while not self.take("}"):
                key = self.word()
                self.need(":")
                out[key] = self.value()
                self.take(",")
        return out

    def _name(self) -> str:
        if self.at < len(self.tokens) and self.tokens[self.at][0] == "word":
            return self.word()
        self.unnamed += 1
        return f"_{self.unnamed}"

    def node(self) -> Pattern:
        self.need("(")
        out = Pattern(self._name())
        if self.take(":"):
            out.label = self.word()
        out.properties = self.properties()
        self.need(")")
        return out

    def patterns(self) -> tuple[list[Pattern], list[Pattern]]:
        nodes, relations = [], []
        while True:
            left = self.node()
            nodes.append(left)
            while self.peek("-", "<-"):
                backwards = self.need("-", "<-") == "<-"
                relation = Pattern("")
                if self.take("["):
                    relation.name = self._name()
                    if self.take(":"):
                        relation.label = self.word()
                    relation.properties = self.properties()
                    self.need("]")
                else:
                    relation.name = self._name()
                self.need("-") if backwards else self.need("->")
                right = self.node()
                nodes.append(right)
                relation.source, relation.target = (right.name, left.name) if backwards else (left.name, right.name)
                relations.append(relation)
                left = right
            if not self.take(","):
                return nodes, relations

    def operand(self) -> Column:
        kind, text = self.tokens[self.at] if self.at < len(self.tokens) else ("", "")
        if kind == "word" and text.upper() not in ("TRUE", "FALSE", "NULL"):
            name = self.word()
            if self.take("("):
                inner = self.operand()
                self.need(")")
                simple = {"TOLOWER": F.lower, "TOUPPER": F.upper, "SIZE": F.length, "ABS": F.abs}
                if name.upper() not in simple:
                    raise QueryError(f"unknown function {name}")
                return simple[name.upper()](inner)
            if self.take("."):
                return F.col(f"`{name}.{self.word()}`")
            return F.col(f"`{name}`")
        return F.lit(self.value())

    def condition(self) -> Column:
        left = self.conjunction()
        while self.take("OR"):
            left = left | self.conjunction()
        return left

    def conjunction(self) -> Column:
        left = self.comparison()
        while self.take("AND"):
            left = left & self.comparison()
        return left

    def comparison(self) -> Column:
        if self.take("NOT"):
            return ~self.comparison()
        if self.take("("):
            inner = self.condition()
            self.need(")")
            return inner
        left = self.operand()
        if self.take("IS"):
            negative = self.take("NOT")
            self.need("NULL")
            return left.isNotNull() if negative else left.isNull()
        if self.take("IN"):
            self.need("[")
            values = []
            while not self.take("]"):
                values.append(self.value())
                self.take(",")
            return left.isin(values)
        if self.take("CONTAINS"):
            return left.contains(self.operand())
        if self.take("STARTS"):
            self.need("WITH")
            return left.startswith(self.operand())
        if self.take("ENDS"):
            self.need("WITH")
            return left.endswith(self.operand())
        op = self.need("=", "<>", "!=", "<", "<=", ">", ">=")
        right = self.operand()
        return {"=": left == right, "<>": left != right, "!=": left != right, "<": left < right, "<=": left <= right, ">": left > right, ">=": left >= right}[op]


def _node_columns(store, pattern: Pattern) -> DataFrame:
    rows = store.nodes()
    if pattern.label:
        rows = rows.filter(F.col("label") == pattern.label)
    for key, value in pattern.properties.items():
        rows = rows.filter(F.col(key) == value)
    return rows.select(*[F.col(c).alias(f"{pattern.name}.{c}") for c in rows.columns])


def _matched(store, nodes: list[Pattern], relations: list[Pattern]) -> DataFrame:
    by_name: dict[str, Pattern] = {}
    for n in nodes:
        known = by_name.setdefault(n.name, n)
        known.label, known.properties = known.label or n.label, {**known.properties, **n.properties}
    out, seen = None, set()
    for r in relations:
        stored, buckets = store.relations()
        rows, start = stored, by_name[r.source]
        for key, value in r.properties.items():
            rows = rows.filter(F.col(key) == value)
        if buckets and start.label:  # relations are laid out by the label and the bucket of their sources
            rows = rows.filter(F.col("source_label") == start.label)
        if buckets and "uid" in start.properties:
            uid = F.lit(start.properties["uid"])
            rows = rows.filter((F.col("source") == uid) & (F.col("bucket") == F.pmod(F.xxhash64(uid), F.lit(buckets)).cast("int")))
        if r.source == r.target:
            rows = rows.filter("source = target")
        ends = [F.col("source").alias(f"{r.source}.uid")] + ([F.col("target").alias(f"{r.target}.uid")] if r.source != r.target else [])
        rows = rows.select(*ends, F.col("bucket").alias(f"{r.source}.#bucket"), *[F.col(c).alias(f"{r.name}.{c}") for c in EDGE_SCHEMA.names])
        shared = [c for c in (f"{r.source}.uid", f"{r.target}.uid") if out is not None and c in out.columns]
        if out is not None and not shared:
            raise QueryError("patterns must hang together")
        out = rows if out is None else out.drop(f"{r.source}.#bucket").join(rows, [f"{c}" for c in dict.fromkeys(shared)])
        for name in (r.source, r.target):
            if name not in seen:
                seen.add(name)
                own = _node_columns(store, by_name[name])
                if name == r.source and buckets:  # a bound node's bucket prunes the partitions that are read
                    out = out.join(own.withColumn(f"{name}.#bucket", bucket_of(f"`{name}.uid`", buckets)), [f"{name}.uid", f"{name}.#bucket"])
                else:
                    out = out.join(own, f"{name}.uid")
        out = out.drop(f"{r.source}.#bucket")
    for name, n in by_name.items():
        if name not in seen:
            if out is not None:
                raise QueryError("patterns must hang together")
            out = _node_columns(store, n)
    return out


def run(store, text: str, parameters: dict | None = None) -> DataFrame:
    """The result of a query; writes return the affected ids."""
    p = Parser(text, parameters or {})
    if p.take("CREATE"):
        return _created(store, p.node())
    p.need("MATCH")
    nodes, relations = p.patterns()
    while p.take("MATCH"):
        more, further = p.patterns()
        nodes, relations = nodes + more, relations + further
    if p.peek("CREATE"):
        return _related(store, nodes, p)
    rows = _matched(store, nodes, relations)
    if p.take("WHERE"):
        rows = rows.filter(p.condition())
    if p.take("DETACH"):
        p.need("DELETE")
        return _deleted(store, rows, p.word())
    p.need("RETURN")
    return _returned(p, rows, {n.name for n in nodes}, {r.name for r in relations})


def _returned(p: Parser, rows: DataFrame, nodes: set[str], relations: set[str]) -> DataFrame:
    distinct = bool(p.take("DISTINCT"))
    plain, aggregates, order = [], [], []
    while True:
        start = p.at
        name = p.word() if p.tokens[p.at][0] == "word" else None
        if name and name.lower() in AGGREGATES and p.take("("):
            once = bool(p.take("DISTINCT"))
            title = "".join(t for _, t in p.tokens[start : p.at])
            if p.take("*"):
                value, title = F.lit(1), title + "*"
            else:
                inner = p.word()
                prop = p.word() if p.take(".") else None
                title += inner + (f".{prop}" if prop else "")
                value = F.col(f"`{inner}.{prop}`") if prop else F.col(f"`{inner}.{'uid' if inner in nodes else 'source'}`")
            p.need(")")
            title += ")"
            f = {"count": F.count_distinct if once else F.count, "sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "collect": F.collect_set if once else F.collect_list}[name.lower()]
            column, kind = f(value), aggregates
        elif name and p.take("."):
            prop = p.word()
            title, column, kind = f"{name}.{prop}", F.col(f"`{name}.{prop}`"), plain
        elif name in nodes or name in relations:
            own = [c for c in rows.columns if c.startswith(f"{name}.")]
            title, column, kind = name, F.struct(*[F.col(f"`{c}`").alias(c.split(".", 1)[1]) for c in own]), plain
        else:
            p.at = start
            value = p.value()
            title, column, kind = str(value), F.lit(value), plain
        alias = p.word() if p.take("AS") else title
        kind.append((alias, column))
        order.append((alias, title))
        if not p.take(","):
            break
    names = [a for a, _ in order]
    kept = rows.select(*[c.alias(a) for a, c in plain]) if not aggregates else rows
    if aggregates:
        grouped = rows.groupBy(*[c.alias(a) for a, c in plain]) if plain else rows
        out = grouped.agg(*[c.alias(a) for a, c in aggregates]).select(*[F.col(f"`{a}`") for a in names])
        kept = out
    by = []
    if p.take("ORDER"):
        p.need("BY")
        while True:
            title = p.word()
            if p.take("("):
                title += "(" + p.word() + ")"
                p.need(")")
            elif p.take("."):
                title += "." + p.word()
            alias = next((a for a, t in order if title in (a, t)), title)
            column = F.col(f"`{alias}`")
            down = p.take("DESC", "DESCENDING")
            p.take("ASC", "ASCENDING")
            by.append(column.desc() if down else column.asc())
            if not p.take(","):
                break
    ordered = kept.orderBy(*by, *[F.col(f"`{a}`") for a in names]) if by else kept
    out = ordered.select(*[F.col(f"`{a}`") for a in names])
    if distinct:
        out = out.distinct()
    if p.take("SKIP"):
        out = out.offset(int(p.value()))
    if p.take("LIMIT"):
        out = out.limit(int(p.value()))
    if p.at < len(p.tokens):
        raise QueryError(f"unexpected {p.tokens[p.at][1]!r}")
    return out


def _created(store, node: Pattern) -> DataFrame:
    if not node.label:
        raise QueryError("a node to create needs a label")
    values = {**node.properties, "label": node.label}
    row = store.spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    store.add(row)
    return row.select("uid") if "uid" in values else row.select("label")


def _related(store, nodes: list[Pattern], p: Parser) -> DataFrame:
    p.need("CREATE")
    _, relations = p.patterns()
    by_name = {n.name: n for n in nodes}
    out = None
    for r in relations:
        left, right = _node_columns(store, by_name[r.source]), _node_columns(store, by_name[r.target])
        for end in (by_name[r.source], by_name[r.target]):
            if not end.label and not end.properties:
                raise QueryError("an end of a relation to create needs a label or a property")
        sources, targets = left.select(F.col(f"`{r.source}.uid`").alias("source")), right.select(F.col(f"`{r.target}.uid`").alias("target"))
        if by_name[r.source] is by_name[r.target]:
            ends = sources.withColumn("target", F.col("source"))
        else:  # every match of one end with every match of the other
            small, large = sorted([sources, targets], key=lambda m: m.limit(MATCHES + 1).count())
            if small.limit(MATCHES + 1).count() > MATCHES:
                raise QueryError(f"both ends of a relation to create have more than {MATCHES} matches")
            ends = large.join(F.broadcast(small))
        rows = ends.select("source", "target", F.lit(r.properties.get("kind", r.label)).cast("string").alias("kind"), F.lit(float(r.properties.get("weight", 1.0))).alias("weight"))
        store.relate(rows)
        out = rows if out is None else out.unionByName(rows)
    return out.select("source", "target")


def _deleted(store, rows: DataFrame, name: str) -> DataFrame:
    from stemma.operators.graph import settled

    gone = settled(rows.select(F.col(f"`{name}.uid`").alias("uid")).distinct())
    nodes = settled(store.nodes().join(gone, "uid", "left_anti"))
    left = store.edges().join(gone.withColumnRenamed("uid", "source"), "source", "left_anti").join(gone.withColumnRenamed("uid", "target"), "target", "left_anti")
    store._write(nodes, settled(left.select("source", "target", "kind", "weight")))
    return gone
