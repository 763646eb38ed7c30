"""Small source files of our own, for queries over source text where no table holds any."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

PYTHON = {
    "shop/prices.py": '''"""Prices."""
import math
from decimal import Decimal as D

RATE = 0.2


class Price:
    """An amount."""

    currency = "EUR"

    def __init__(self, amount):
        self.amount = amount

    @property
    def gross(self):
        return rounded(self.amount * (1 + RATE))

    def _unused(self):
        if self.amount > 3 and self.currency == "EUR" or math.isnan(self.amount):
            return None
        return self.amount


def rounded(value):
    return math.floor(value * 100) / 100
''',
    "shop/cart.py": '''"""A cart."""
from shop.prices import Price, rounded


class Item(Price):
    def total(self, n: int = 1) -> float:
        return rounded(self.gross * n)


def load(rows):
    """Reads rows."""
    items = []
    for row in rows:
        if not row:
            continue
        try:
            items.append(Item(row["amount"]))
        except KeyError:
            print("skipped")  # TODO: report
    return items


def main(rows):
    """Totals."""
    # --- Load ---
    items = load(rows)
    # --- Sum ---
    for item in items:
        if item.amount == True:
            continue
        value = item.total(n=count(rows))
        emit(value)
    return summary(items)


def count(rows):
    """Counts."""
    return len(rows)


def summary(items):
    """Sums up."""
    return report(items)


def report(items):
    """Reports."""
    return sorted(items)
''',
    "shop/run.py": '''import os
import pickle
from shop.cart import *


def x1(a, b, c, d, e, f):
    eval(a.decode("utf8"))
    os.system(b)
    try:
        main([])
    except:
        pass
''',
    "shop/broken.py": "def (:\n",
    "shop/empty.py": "",
}
OTHER = {
    "web/app.js": 'import { a } from "./a.js";\nexport class View {\n  constructor(x) { this.x = x; }\n  async load() { return fetchAll(this.x); }\n}\nfunction fetchAll(u) { return helper(u); }\nconst helper = (u) => { console.log(u); };\n',
    "web/app.ts": 'import * as q from "q";\nclass Box { get size(): number { return measure(this); } }\nfunction measure(b: Box): number { return 1; }\n',
    "core/lib.rs": "use std::fmt;\npub struct Point { x: i32 }\nenum Kind { A, B }\nimpl Point { fn new() -> Self { make() } fn len(&self) -> i32 { 0 } }\nfn make() -> Point { Point { x: 1 } }\n",
    "svc/main.go": 'package main\nimport "fmt"\ntype Server struct { n int }\nfunc (s *Server) Run() { fmt.Println(s.n) }\nfunc main() { helper() }\nfunc helper() {}\n',
    "app/Main.java": "package app;\nimport java.util.List;\npublic class Main {\n  private int n;\n  public Main(int n) { this.n = n; }\n  public int getN() { return n; }\n}\n",
    "sys/io.c": '#include <stdio.h>\nstruct buf { int n; };\nstatic int read_all(struct buf *b) { return b->n; }\nint main(void) { struct buf b; return read_all(&b); }\n',
    "sys/box.hpp": "#include \"io.h\"\nclass Box {\n int n;\n};\nint open_box(Box *b) { return 0; }\n",
    "notes.txt": "nothing to parse",
}


def sources(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(sorted(PYTHON.items()), "file string, text string")


def other_sources(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(sorted(OTHER.items()), "file string, text string")
