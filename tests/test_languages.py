"""Nested and odd declarations of the languages with braces."""

import pytest

from stemma.sources.lexing import Tokens
from stemma.sources.other_languages import scan


def read(lang, text, path="pkg/mod.x"):
    nodes, edges = scan(path, text, lang)
    by = {n["id"]: n for n in nodes}
    own = {(n["node_type"], n["qualified_name"]) for n in nodes if n["node_type"] in ("function", "method", "class")}
    calls = {(by[e["source_id"]]["name"], by[e["target_id"]]["qualified_name"], by[e["target_id"]]["node_type"]) for e in edges if e["edge_type"] == "call"}
    return own, calls, [n["name"] for n in nodes if n["node_type"] == "external"], by


JS = r"""
import React, { useState as s } from 'react';
import './style.css'
export * from './other';
const re = /[/"{]+\/(x)/g, half = total / 2 / 3;
/* function no() {} */ // class No {}
const text = `a ${inner(`b ${deep(1)} function no2() {}`)} }`;
export default class Shop extends mixin(Base, { a: 1 }) {
  #count = 0;
  static rate = { tax() { return 1; } };
  handler = () => { this.run(); };
  static async *items() { yield load(); }
  get size() { return this.#count; }
  'quoted name'(x) { return x; }
  [Symbol.iterator]() { return next(); }
  #hidden(a = { b: 1 }) { if (a) { check(a); } function nested() { inNested(); } }
}
async function fetchAll(url, { retries = 3 } = {}) {
  const r = await http.get(url)?.json?.();
  return new Parser(r).parse(retries);
}
function* gen() { function within() { return 1; } }
if (ready) { function late() { fetchAll(); } }
const add = (a, b) => a + helper(b),
  sub = async function () { return 1; }, twice = x => ({ v: dbl(x) });
const api = { list() { return add(1, 2); }, async save(x) {}, plain: function () {} };
(function () { function hidden() { super_(1); } })();
const named = function other() {};
let late2 = async (x) => {
  const inner2 = () => sub2(x);
  return inner2();
};
"""


def test_javascript():
    own, calls, imports, by = read("javascript", JS)
    assert own == {
        ("class", "mod:Shop"),
        ("method", "mod:Shop:tax"),
        ("method", "mod:Shop:items"),
        ("method", "mod:Shop:size"),
        ("method", "mod:Shop:'quoted name'"),
        ("method", "mod:Shop:[Symbol.iterator]"),
        ("method", "mod:Shop:#hidden"),
        ("function", "mod:fetchAll"),
        ("function", "mod:within"),
        ("function", "mod:late"),
        ("function", "mod:add"),
        ("function", "mod:twice"),
        ("method", "mod:list"),
        ("method", "mod:save"),
        ("function", "mod:hidden"),
        ("function", "mod:late2"),
        ("function", "mod:inner2"),
    }
    assert imports == ["react", "./style.css"]
    assert {("late", "mod:fetchAll", "function"), ("list", "mod:add", "function"), ("add", "helper", "builtin"), ("twice", "dbl", "builtin"), ("fetchAll", "get", "builtin"), ("fetchAll", "parse", "builtin"), ("#hidden", "inNested", "builtin"), ("late2", "mod:inner2", "function"), ("inner2", "sub2", "builtin"), ("items", "load", "builtin")} <= calls
    assert not {c for c in calls if c[1] in ("Parser", "nested", "if")}
    shop = next(n for n in by.values() if n["name"] == "Shop")
    assert (shop["line"], shop["end_line"], shop["column"]) == (8, 17, 15)


TS = r"""
import type { A } from "./a";
abstract class Box<T extends { id: number }> implements Holder<T> {
  private items: Map<string, () => void> = new Map();
  constructor(private readonly size: number, public on = () => 1) { super(); }
  size2(): { w: number; h: number } { return measure<T>(this); }
  overload(x: string): void;
  overload(x: any): void { this.items.forEach((i) => use(i)); }
  @log({ level: 1 }) async load<K extends keyof T>(key: K): Promise<Array<T[K]>> { return fetchOne(key); }
  abstract area(): number;
}
interface Shape { draw(): void; }
type Fn = (a: number) => void;
enum Color { Red, Green }
declare function external(x: number): void;
function over(a: string): string;
function over(a: any): any { return a; }
export const pick = <T,>(xs: T[], f: (x: T) => boolean): T | undefined => xs.find(f);
export const make = (n: number): { a: number } => { return build(n); };
namespace Inner { export function inside() { return external(1); } }
"""


def test_typescript():
    own, calls, imports, _ = read("typescript", TS)
    assert own == {("class", "mod:Box"), *(("method", f"mod:Box:{m}") for m in ("constructor", "size2", "overload", "load")), ("function", "mod:over"), ("function", "mod:pick"), ("function", "mod:make"), ("function", "mod:inside")}
    assert {("size2", "measure", "builtin"), ("overload", "use", "builtin"), ("load", "fetchOne", "builtin"), ("pick", "find", "builtin"), ("make", "build", "builtin"), ("inside", "external", "builtin")} <= calls
    assert imports == ["./a"]


JAVA = r'''
package app;
import java.util.List;
import static java.lang.Math.max;
import java.io.*;
@Entity(name = "x")
public final class Main<T extends Comparable<T>> extends Base<Map<String, List<T>>> implements Runnable {
  private static final Map<String, int[]> TABLE = new HashMap<>() {{ put("}", new int[] {1}); }};
  private final Runnable r = new Runnable() { @Override public void run() { go(); } };
  int a = max(1, 2), b;
  static { init(); }
  public Main(int n) throws IOException { this.n = n; }
  @Override @SuppressWarnings({"a", "b"})
  protected <K, V> Map<K, List<V>> convert(final K key, V... values) { class Local { void no() {} } return null; }
  abstract int[] sizes();
  String text = """
      class Not { void method() {} }
      """;
  interface Inner { void call(); default int two() { return 2; } }
  enum Kind { A(1) { int f() { return 1; } }, B(2); private final int v; Kind(int v) { this.v = v; } }
  record Point(int x, int y) { double len() { return 0; } }
}
'''


def test_java():
    own, calls, imports, by = read("java", JAVA)
    assert own == {
        ("class", "mod:Main"),
        ("method", "mod:Main:run"),
        ("method", "mod:Main:Main"),
        ("method", "mod:Main:convert"),
        ("method", "mod:Main:sizes"),
        ("class", "mod:Main:Inner"),
        ("method", "mod:Main:Inner:call"),
        ("method", "mod:Main:Inner:two"),
        ("class", "mod:Main:Kind"),
        ("method", "mod:Main:Kind:f"),
        ("method", "mod:Main:Kind:Kind"),
        ("method", "mod:Main:len"),
    }
    assert imports == ["java.util.List", "java.lang.Math.max", "java.io"] and not calls
    assert next(n for n in by.values() if n["name"] == "Main" and n["node_type"] == "class")["line"] == 6


GO = r"""
package main

import (
	"fmt"
	str "strings"
)
import "os"

type Server[T any] struct { n int; f func(int) struct{ x int } }
type Iface interface { Run(); Stop() error }
type Alias = Server[int]
type (
	A struct { a int }
	B struct { b int }
)
func (s *Server[T]) Run(ctx context.Context) (out map[string]interface{}, err error) {
	defer func() { recover() }()
	raw := `func not() {}`
	if ok() { fmt.Println([]byte(raw), Map[int, string](s.n)) }
	return s.inner.call(1), nil
}
func Map[K comparable, V any](k K) V { var v V; return v }
func typed() struct{ x int } { return make2() }
func external(x int) int
var handler = func(w int) { hidden() }
"""


def test_go():
    own, calls, imports, _ = read("go", GO)
    assert own == {("class", "mod:Server"), ("class", "mod:A"), ("method", "mod:Run"), ("function", "mod:Map"), ("function", "mod:typed"), ("function", "mod:external")}
    assert calls == {("Run", "recover", "builtin"), ("Run", "ok", "builtin"), ("Run", "fmt.Println", "builtin"), ("Run", "mod:Map", "function"), ("Run", "s.inner.call", "builtin"), ("typed", "make2", "builtin")}
    assert imports == ["fmt", "os"]


RUST = r"""
use std::{fmt, collections::HashMap};
pub use crate::other as o;
#[derive(Debug, Clone)]
pub struct Point<T: Into<f64>> where T: Copy { x: T }
pub struct Unit;
struct Pair(i32, i32);
enum Kind { A(i32), B { x: i32 } }
/* outer /* fn nested_comment() {} */ fn no() {} */
impl<T: Into<f64> + Copy> Point<T> {
    pub const fn new(x: T) -> Self { Self { x } }
    pub(crate) async unsafe fn len<'a>(&'a self) -> Result<f64, Box<dyn Error>> where T: Copy {
        let Some(v) = self.get() else { return Err(fail("}")) };
        match v { Ok(Some(x)) if good(x) => emit(x), _ => println!("{} {}", no_call(1), '"') }
        let c = |a: i32| -> i32 { inner(a) };
        Point::<f64>::new(1.0).len(); r#"fn raw() {}"#;
        fn local() { in_local(); }
    }
}
impl fmt::Display for Pair { fn fmt(&self, f: &mut fmt::Formatter) -> fmt::Result { write!(f, "") } }
impl From<Kind> for Other { fn from(k: Kind) -> Self { std::mem::swap(a, b) } }
trait Shape { fn area(&self) -> f64; fn twice(&self) -> f64 { self.area() } }
mod tests { #[test] fn check() { helper::<i32>(); assert!(x()); } }
macro_rules! make { ($x:ident) => { fn $x() {} } }
pub extern "C" fn exported() -> i32 { 'x' as i32 }
"""


def test_rust():
    own, calls, imports, by = read("rust", RUST)
    assert own == {
        ("class", "mod:Point"),
        ("class", "mod:Unit"),
        ("class", "mod:Pair"),
        ("class", "mod:Kind"),
        ("method", "mod:Point:new"),
        ("method", "mod:Point:len"),
        ("method", "mod:Pair:fmt"),
        ("class", "mod:Other"),
        ("method", "mod:Other:from"),
        ("function", "mod:twice"),
        ("function", "mod:check"),
        ("function", "mod:exported"),
    }
    assert {("len", "get", "builtin"), ("len", "Err", "builtin"), ("len", "fail", "builtin"), ("len", "good", "builtin"), ("len", "emit", "builtin"), ("len", "inner", "builtin"), ("len", "mod:Point:len", "method"), ("len", "in_local", "builtin"), ("from", "std::mem::swap", "builtin"), ("check", "helper::<i32>", "builtin"), ("twice", "area", "builtin")} <= calls
    assert not {c for c in calls if c[1] in ("Some", "Ok", "no_call", "local", "x")}
    assert imports == ["std::{fmt, collections::HashMap}", "crate::other as o"]
    length = next(n for n in by.values() if n["name"] == "len")
    assert length["source_code"].startswith("pub(crate) async unsafe fn len")


C = r"""
#include <stdio.h>
#include "own.h"
#define MAX(a, b) ((a) > (b) ? (a) : (b)) { \
  not_a_body(a)
struct node { struct { int x; } in; int (*cmp)(const void *, const void *); struct inner { int y; } i; };
typedef struct { int z; } anonymous;
static struct node table[] = { { .in = { 1 } } };
int (*callback)(int) = NULL;
static inline unsigned long *find(struct node *n, int (*f)(int)) {
  struct local { int q; } l;
  if (n->in.x > MAX(1, 2)) { n->cmp(a, b); }
  return (unsigned long *) sizeof(int) + f(n->in.x);
}
__attribute__((noinline)) void fill(char c)
{
  char brace = '{', *s = "}{"; while (*s) { put(c); }
}
int declared(int x);
enum color { RED, GREEN };
"""


def test_c():
    own, calls, imports, by = read("c", C)
    assert own == {("class", "mod:node"), ("class", "mod:node:inner"), ("function", "mod:find"), ("function", "mod:fill")}
    assert calls == {("find", "MAX", "builtin"), ("find", "cmp", "builtin"), ("find", "f", "builtin"), ("fill", "put", "builtin")}
    assert imports == ["stdio.h", "own.h"]
    assert next(n for n in by.values() if n["name"] == "fill")["line"] == 15


CPP = r"""
#include <vector>
namespace app { namespace {
template <class T, typename U = std::map<int, T>>
class Box final : public Base<T>, private virtual Other {
 public:
  Box() : n(0), v{1, 2} { init(); }
  ~Box() { clear(); }
  T get() const noexcept override { return n; }
  struct Inner { int x; };
  bool operator==(const Box& o) const { return same(o); }
 private:
  int n = make();
};
enum class Mode { A, B };
class Forward;
template <typename T>
std::vector<T> collect(const std::vector<T>& in, T def = T{}) noexcept(true) {
  std::vector<int> sized(10);
  auto f = [&](int x) { return visit(x); };
  for (auto& x : in) { out.push_back(std::move(x)); }
  return build<T>(in)->finish();
}
}  // namespace
auto trailing(int a) -> decltype(a) { return R"(} not(1) {)"; }
void Box<int>::outside() { hidden(); }
Forward::Forward(int x) : Base(x), y{2} { hidden2(); }
extern "C" { int exported(void) { return 1; } }
}
int main(int argc, char** argv) { app::run(argc); delete new Thing(1); return 0; }
"""


def test_cpp():
    own, calls, imports, _ = read("cpp", CPP)
    assert own == {("class", "mod:Box"), ("class", "mod:Box:Inner"), ("function", "mod:collect"), ("function", "mod:trailing"), ("function", "mod:exported"), ("function", "mod:main")}
    assert {("collect", "visit", "builtin"), ("collect", "push_back", "builtin"), ("collect", "std::move", "builtin"), ("collect", "finish", "builtin"), ("main", "app::run", "builtin")} <= calls
    assert not {c for c in calls if c[1] in ("sized", "Thing", "not", "hidden")}
    assert imports == ["vector"]


@pytest.mark.parametrize("lang", ["javascript", "typescript", "tsx", "java", "go", "rust", "c", "cpp"])
@pytest.mark.parametrize("text", ["", "\n\n", "}}}))]", "{{{(((", "class", "class A", "class A {", "function f(", "fn", "fn f<", "func (", "impl", "import", "import {", "use", "struct", "type (", "'", '"', "`${", "`${`", "/*", "//", "#", "#include", "a<b<c<d", "@", "@A(", "const", "const a = (", "=> =>", "x = async", "enum E { A(", "r#\"", 'R"x(', "<p>Don't {it}</p>", "new A() {", "::<", "() () ()", "->", "f()()[0](1)", "template <", "operator("])
def test_broken_texts_are_read_to_their_end(lang, text):
    nodes, edges = scan("a/b.x", text, lang)
    assert nodes[0]["node_type"] == "module" and len({n["id"] for n in nodes}) == len(nodes)
    ids = {n["id"] for n in nodes}
    assert all(e["source_id"] in ids and e["target_id"] in ids for e in edges)


def test_brackets_belong_together():
    t = Tokens("a ( b [ c ) ] { `x${ { y } }z` }", "javascript")
    assert [(x.text, t[x.pair].text if 0 <= x.pair < len(t) else None) for x in t if x.text in ("(", "[", "{", "${")] == [("(", ")"), ("[", ")"), ("{", "}"), ("${", "}"), ("{", "}")]


def test_a_long_text_takes_time_in_proportion():
    import time

    def seconds(n):
        text = "".join(f"class K{i} {{ m{i}(a) {{ return f{i}(a, g(a)[1](2)); }} }}\nconst q{i} = (x) => h(x);\n" for i in range(n))
        start = time.perf_counter()
        nodes, _ = scan("a.js", text, "javascript")
        assert sum(x["node_type"] == "method" for x in nodes) == n
        return time.perf_counter() - start

    seconds(200)
    assert seconds(4000) < 60 * seconds(400)
