"""Extraction in each language, from broken files, and of each kind of reference."""

import pytest

from orrery.operators import extract
from orrery.operators.languages import LANGUAGES, blank_out
from orrery.sources.tree import EXTENSIONS

SOURCES = {
    "c": ('#include "list.h"\n/* int old(void) { } */\nstruct node {\n  int x;\n};\nstatic int push(struct node *n) {\n  return helper(n);\n}\nenum kind { A, B };\n', {("class", "node"), ("function", "push"), ("enum", "kind")}, {("imports", "list.h"), ("calls", "helper")}),
    "cpp": ("#include <vector>\nclass Shape : public Base {\n public:\n  int area(int x) {\n    return compute(x);\n  }\n};\nint Shape::side(int y) {\n  return y;\n}\nusing Id = int;\n", {("class", "Shape"), ("method", "area"), ("method", "side"), ("type_alias", "Id")}, {("extends", "Base"), ("calls", "compute"), ("imports", "vector")}),
    "csharp": ("using System.Text;\npublic class Order : Entity, IOrder {\n  public int Total(int n) {\n    return Sum(n);\n  }\n}\npublic interface IOrder { }\nenum State { Open }\n", {("class", "Order"), ("method", "Total"), ("interface", "IOrder"), ("enum", "State")}, {("extends", "Entity"), ("imports", "System.Text"), ("calls", "Sum")}),
    "php": ("<?php\nuse App\\Models\\User;\nclass Cart extends Base implements Countable {\n  public function add($x) {\n    return check($x);\n  }\n}\nfunction top() { }\n", {("class", "Cart"), ("method", "add"), ("function", "top")}, {("extends", "Base"), ("implements", "Countable"), ("imports", "App\\Models\\User")}),
    "kotlin": ("import a.b.C\nclass Repo(val x: Int) : Store() {\n  fun load(id: Int): User {\n    return fetch(id)\n  }\n}\ninterface Store\nfun main() {\n}\nenum class Mode { A }\n", {("class", "Repo"), ("method", "load"), ("interface", "Store"), ("function", "main"), ("enum", "Mode")}, {("imports", "a.b.C"), ("extends", "Store"), ("types", "User")}),
    "swift": ("import UIKit\nclass View: Base {\n  func draw(_ r: Rect) {\n    paint(r)\n  }\n}\nprotocol Drawable { }\nfunc free() { }\n", {("class", "View"), ("method", "draw"), ("interface", "Drawable"), ("function", "free")}, {("imports", "UIKit"), ("extends", "Base"), ("types", "Rect"), ("calls", "paint")}),
    "scala": ("import a.B\ntrait T\nobject Main extends App {\n  def run(x: Conf): Int = {\n    go(x)\n  }\n}\n", {("interface", "T"), ("class", "Main"), ("method", "run")}, {("extends", "App"), ("types", "Conf"), ("calls", "go")}),
    "ruby": ("require 'json'\nmodule Shop\n  class Cart < Base\n    def add(x)\n      if x\n        check(x)\n      end\n    end\n\n    def size?\n      1\n    end\n  end\nend\n", {("class", "Shop"), ("class", "Cart"), ("method", "add"), ("method", "size?")}, {("imports", "json"), ("extends", "Base"), ("calls", "check")}),
    "bash": ("source ./lib.sh\nRATE=3\ndeploy() {\n  echo hi # deploy() {\n}\nfunction undo {\n  true\n}\n", {("variable", "RATE"), ("function", "deploy"), ("function", "undo")}, {("imports", "./lib.sh")}),
    "lua": ("local json = require('json')\nlocal function near(a)\n  if a then\n    return far(a)\n  end\nend\nfunction M.go(x)\n  return x\nend\n", {("variable", "json"), ("function", "near"), ("function", "go")}, {("imports", "json"), ("calls", "far")}),
    "elixir": ("defmodule Shop.Cart do\n  alias Shop.Item\n  def add(x) do\n    check(x)\n  end\nend\n", {("class", "Cart"), ("method", "add")}, {("imports", "Shop.Item"), ("calls", "check")}),
    "dart": ("import 'a.dart';\nclass App extends Base {\n  int sum(int a) {\n    return plus(a);\n  }\n}\n", {("class", "App"), ("method", "sum")}, {("imports", "a.dart"), ("extends", "Base"), ("calls", "plus")}),
    "groovy": ("import a.b.C\nclass Job {\n  def run(x) {\n    call(x)\n  }\n}\n", {("class", "Job"), ("method", "run")}, {("imports", "a.b.C"), ("calls", "call")}),
    "zig": ('const std = @import("std");\npub fn go(a: u8) void {\n  help(a);\n}\nconst P = struct {\n  x: u8,\n};\n', {("function", "go"), ("class", "P")}, {("imports", "std"), ("calls", "help")}),
    "powershell": ("Import-Module Az\nfunction Get-It {\n  Write-Host 1\n}\n", {("function", "Get-It")}, {("imports", "Az")}),
    "r": ("library(dplyr)\nadd <- function(a, b) {\n  plus(a, b)\n}\n", {("function", "add")}, {("imports", "dplyr"), ("calls", "plus")}),
    "haskell": ("import Data.Map\ndata Tree = Leaf\nsize :: Tree -> Int\nsize t = 1\n", {("class", "Tree"), ("function", "size")}, {("imports", "Data.Map")}),
    "elm": ("import Html\ntype alias Model = Int\ntype Msg = A\nview : Model -> Html\nview m = text\n", {("type_alias", "Model"), ("enum", "Msg"), ("function", "view")}, {("imports", "Html")}),
    "ocaml": ("open List\ntype t = int\nlet add a b =\n  a + b\n", {("type_alias", "t"), ("function", "add")}, {("imports", "List")}),
    "clojure": ("(ns a (:require [b.c]))\n(defn go [x]\n  (help x))\n(defprotocol P)\n", {("function", "go"), ("interface", "P")}, {("imports", "b.c")}),
    "erlang": ('-include("a.hrl").\ngo(X) ->\n  help(X).\n', {("function", "go")}, {("imports", "a.hrl"), ("calls", "help")}),
    "nix": ("{ pkgs }:\nlet\n  tool = import ./tool.nix;\n  f = x: x;\nin f\n", {("variable", "tool"), ("function", "f")}, {("imports", "./tool.nix")}),
    "verilog": ('`include "a.v"\nmodule top(input a);\n  function int add(input int x);\n  endfunction\nendmodule\n', {("class", "top"), ("method", "add")}, {("imports", "a.v")}),
    "fortran": ("module m\n  use iso\ncontains\n  subroutine go(x)\n    call help(x)\n  end subroutine\nend module\n", {("class", "m"), ("method", "go")}, {("imports", "iso"), ("calls", "help")}),
    "typescript": ("import { a, b as c } from './x';\nexport * from './y';\nexport class A extends B implements I {\n  go(p: Conf): void {\n    new Thing();\n    obj.call();\n  }\n}\n", {("class", "A"), ("method", "go")}, {("imports", "./x"), ("imports", "./y"), ("extends", "B"), ("implements", "I"), ("types", "Conf"), ("calls", "Thing"), ("calls", "call")}),
    "java": ("import a.B;\npublic class A extends C implements D, E {\n  public int go(Conf c) {\n    return help(c);\n  }\n}\n", {("class", "A"), ("method", "go")}, {("imports", "a.B"), ("extends", "C"), ("implements", "D"), ("implements", "E"), ("types", "Conf")}),
    "go": ('package m\nimport "fmt"\ntype S struct {\n}\nfunc (s *S) Run(c Conf) error {\n\treturn help(c)\n}\n', {("class", "S"), ("method", "Run")}, {("imports", "fmt"), ("types", "Conf"), ("calls", "help")}),
    "rust": ("use a::b;\npub struct P {}\nimpl T for P {\n  fn go(x: Conf) -> u8 {\n    help(x)\n  }\n}\n", {("class", "P"), ("function", "go")}, {("imports", "a::b"), ("implements", "T"), ("types", "Conf")}),
    "python": ("import os\nclass A(B):\n    def go(self, c: Conf) -> int:\n        return help(c)\n", {("class", "A"), ("method", "go")}, {("imports", "os"), ("extends", "B"), ("types", "Conf"), ("calls", "help")}),
}


@pytest.mark.parametrize("language", sorted(SOURCES))
def test_language(language):
    text, defs, refs = SOURCES[language]
    rows = extract.extract_file("f", language, text)
    assert defs <= {(r[1], r[2]) for r in rows if r[0] == "def"}, rows
    assert refs <= {(r[1], r[2]) for r in rows if r[0] == "ref"}, rows
    assert all(1 <= r[3] <= r[4] <= text.count("\n") + 1 for r in rows)


def test_all_languages_are_known():
    assert set(LANGUAGES) == set(EXTENSIONS) and all(extract.extract_file("f", x, "") == [] for x in LANGUAGES)
    for name, language in LANGUAGES.items():
        text = "x = \"a { b\" /* c { */ // d {\n# e {\n'f"
        assert len(blank_out(text, language)) == len(text), name


def test_blocks():
    of = lambda lang: {r[2]: (r[3], r[4], r[9], r[10]) for r in extract.extract_file("f", lang, SOURCES[lang][0]) if r[0] == "def"}
    assert of("ruby")["add"] == (4, 8, "Shop.Cart", "class:Cart:3") and of("ruby")["Cart"][:2] == (3, 13)
    assert of("lua")["near"][:2] == (2, 6) and of("c")["push"][:2] == (6, 8) and of("kotlin")["load"] == (3, 5, "Repo", "class:Repo:2")
    assert of("clojure")["go"][:2] == (2, 3) and of("fortran")["m"][:2] == (1, 7)


def test_broken_files():
    text = "import os\n\nclass A(Base):\n    def go(self):\n        return helper()\n\n    def bad(self:\n        pass\n\ndef after():\n    return 1\n"
    rows = extract.extract_file("f", "python", text)
    assert {("class", "A"), ("method", "go"), ("function", "after")} <= {(r[1], r[2]) for r in rows if r[0] == "def"}
    assert {("imports", "os"), ("calls", "helper"), ("extends", "Base")} <= {(r[1], r[2]) for r in rows if r[0] == "ref"}
    open_ = extract.extract_file("f", "typescript", "export function a() {\n  b(\nfunction c() {\n")
    assert {(r[2], r[4]) for r in open_ if r[0] == "def"} >= {("a", 3), ("c", 3)}


def test_edges_and_properties(spark):
    files = spark.createDataFrame([("src/a.ts", "typescript", SOURCES["typescript"][0]), ("src/x.ts", "typescript", "export class Thing {}\nexport class Conf {}\nexport class B {}\n"), ("src/z.ts", "typescript", "export class Thing {}\n")], "file_path string, language string, content string")
    found = extract.extract(files)
    got = {(r.source_id, r.target_id, r.type): r.properties for r in extract.edges_of(found, extract.nodes_of(found)).collect()}
    go = "method:src/a.ts:go:4"
    assert got[go, "class:src/x.ts:Thing:1", "calls"] == '{"filePath":"src/a.ts","line":"5","constructor":"true"}'
    assert got[go, "unresolved:call", "calls"] == '{"filePath":"src/a.ts","line":"6","object":"obj"}'
    assert (go, "class:src/x.ts:Conf:2", "references") in got and ("class:src/a.ts:A:3", go, "contains") in got
    assert ("class:src/a.ts:A:3", "class:src/x.ts:B:3", "extends") in got and ("class:src/a.ts:A:3", "unresolved:I", "implements") in got
    assert got["file:src/a.ts", "module:./x", "imports"] == '{"filePath":"src/a.ts","line":"1","names":"a,b"}' and '"reexport":"true"' in got["file:src/a.ts", "module:./y", "imports"]


def test_relational_scope(spark):
    nodes = spark.createDataFrame([("c", "class", "f", 1, 20), ("d", "class", "f", 5, 15), ("m", "method", "f", 6, 8), ("n", "method", "f", 16, 17), ("o", "method", "g", 1, 2)], "id string, type string, file_path string, start_line int, end_line int")
    assert {tuple(r) for r in extract.contains_edges(nodes).collect()} == {("d", "m"), ("c", "n")}
    refs = spark.createDataFrame([("f", 7), ("f", 12), ("f", 40), ("h", 1)], "file_path string, start_line int")
    assert {(r.file_path, r.start_line): r.scope for r in extract.enclosing_scope(refs, nodes).collect()} == {("f", 7): "m", ("f", 12): "d", ("f", 40): "file:f", ("h", 1): "file:h"}


def test_barrels_and_components(spark):
    edges = spark.createDataFrame([("file:a", "file:i", "imports", "{}"), ("file:i", "file:x", "imports", '{"reexport":"true"}'), ("file:i", "file:y", "imports", "{}")], "source_id string, target_id string, type string, properties string")
    assert {tuple(r)[:2] for r in extract.resolve_barrel(edges).collect()} == {("file:a", "file:x")}
    nodes = spark.createDataFrame([(f"c{i}", "function", "Card", f"f{i}.tsx", 1, "tsx") for i in range(4)] + [("lone", "function", "Menu", "f.tsx", 1, "tsx"), ("low", "function", "card", "g.tsx", 1, "tsx")], "id string, type string, name string, file_path string, start_line int, language string")
    assert {tuple(r)[:2] for r in extract.react_components(nodes).collect()} == {("c0", "c1"), ("c1", "c0"), ("c2", "c0"), ("c3", "c0")}


def test_comments_and_quotes():
    assert extract.clean_comment("/**\n * Adds.\n * @param a it\n */") == "Adds.\n@param a it" and extract.clean_comment("// a\n// b") == "a\nb" and extract.strip_quotes("'x'") == "x" and extract.strip_quotes("'") == "'"
