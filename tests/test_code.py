"""The scanners of six languages and the shortened texts."""

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkloom.functions import code, compress


def parse(text, ext):
    return code.parse(text, ext)


def test_python_signatures_keep_annotations_and_skip_nested():
    got = parse('def f(a: int,\n      b=2) -> list[int]:\n    def g(): pass\n    return 1\n\nclass A:\n    async def m(self): return 1\n', ".py")
    assert got["signatures"] == ["f(a: int,\n      b=2) -> list[int]", "m(self)"]


def test_python_strings_hide_code():
    got = parse('x = """\ndef no(): pass\nimport nothing\n"""\n# import neither\ndef yes(): pass\n', ".py")
    assert got["signatures"] == ["yes()"] and got["dependencies"] == []


def test_python_imports():
    assert parse("import os, a.b as c, d.e\nfrom x.y import z\nfrom . import q\nfrom .r import s\nfrom __future__ import annotations\n", ".py")["dependencies"] == ["os", "d.e", "x.y", ".", ".r"]


@pytest.mark.parametrize(
    ("decorator", "route"),
    [('@app.get("/x")', ["GET /x"]), ("@r.api.patch('/y')", ["PATCH /y"]), ('@app.route("/x")', []), ("@cached", []), ('@first\n@app.get("/x")', [])],
)
def test_routes_read_the_first_decorator(decorator, route):
    assert parse(f"{decorator}\ndef f():\n    pass\n", ".py")["api"] == route


def test_routes_stop_at_decorated_classes():
    text = '@deco\nclass A:\n    @app.get("/hidden")\n    def f(self):\n        pass\n\nclass B:\n    @app.post("/seen")\n    def g(self):\n        pass\n'
    assert parse(text, ".py")["api"] == ["POST /seen"]


def test_java():
    got = parse('import java.util.List;\nimport static a.b.C.*;\nclass X {\n  X() { go(); }\n  String run(int a, List<String> b) throws E {\n    return "x{";\n  }\n  abstract void z();\n}\n', ".java")
    assert got["signatures"] == ["run(int a, List<String> b)", "z()"]
    assert got["dependencies"] == ["java.util.List", "a.b.C.*"]
    assert got["compressed"].splitlines()[5] == code.BODY_MARK and got["compressed"].splitlines()[6] == "  }"


def test_typescript():
    got = parse('import { a } from "./a";\nimport "side"\nexport async function f(x: number): Promise<string> {\n  return g(x);\n}\nclass Q {\n  private go(x) {\n    if (x) { y(); }\n  }\n}\nconst h = function n() { return 1 };\nconst k = (a) => { return 2 };\n', ".ts")
    assert got["dependencies"] == ["./a", "side"]
    assert [s.split("(")[0] for s in got["signatures"]] == ["f", "go"]


def test_javascript_templates_and_expressions_hide_braces():
    got = parse('function a() {\n  const s = `}${x}`; const r = /[{]/;\n  return "{";\n}\nfunction b() { return 1; }\n', ".js")
    assert got["signatures"] == ["a()", "b()"]
    assert got["compressed"] == f"function a() {{\n{code.BODY_MARK}\n}}\nfunction b() {{ return 1; }}"


def test_lua():
    got = parse('local a = require("mod.a")\nlocal b = require \'b\'\nlocal function f(x)\n  if x then return 1 end\n  for i=1,2 do p(i) end\nend\nfunction T:m(a) return a end\nM.n = function() end\nrequire(name)\n', ".lua")
    assert got["signatures"] == ["f(x)", "T:m(a)"] and got["dependencies"] == ["mod.a", "b"]
    assert got["compressed"].splitlines()[2:5] == ["local function f(x)", code.BODY_MARK, "end"]


def test_gdscript():
    got = parse('extends "res://Base.gd"\nconst C = preload("res://s/player.controller.gd")\nvar x = ResourceLoader.load("res://a.tscn")\nfunc _ready() -> void:\n\tpass\nfunc _init(a):\n\tb = a\nclass In:\n\tfunc go(x: int):\n\t\treturn x\n', ".gd")
    assert got["signatures"] == ["_ready() -> void", "go(x: int)"] and got["dependencies"] == ["Base", "player.controller", "a"]
    assert got["compressed"].count(code.BODY_MARK) == 3


def test_unknown_extension():
    assert parse("def f(): pass", ".rb") is None and code.outline("x", ".rb") == []


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="defunction(){}[]:;,.\"'`#/*-\\ \n\tab1=<>@|$", max_size=200), st.sampled_from(code.LANGUAGES))
def test_broken_code_never_raises(text, ext):
    got = code.parse(text, ext)
    assert len(got["compressed"].splitlines()) <= max(1, len(text.splitlines()))


def test_json():
    assert compress.compress_json('{"b": [1, 2, 3, 4, 5], "a": "x"}') == '{"b":[1,2,3,"⋮---- (2개 항목 생략)"],"a":"x"}'
    assert compress.compress_json("{broken") == "{broken"
    assert len(json.loads(compress.compress_json(json.dumps({"a": "y" * 500})))["a"]) < 230


def test_markdown():
    text = "# h\n\n" + "- i\n" * 7 + "\n|a|b|\n|-|-|\n" + "|1|2|\n" * 8 + "\n```python\ndef f():\n    return 1\n```\n\n~~~\n" + "line\n" * 12 + "~~~\n" + "w " * 150
    got = compress.compress_markdown(text).splitlines()
    assert got.count("- i") == 5 and got.count("|1|2|") == 5 and got.count("line") == 10
    assert code.BODY_MARK in got and got[-1].endswith("⋮---- (생략)")


def test_text():
    got = compress.compress_txt("\n".join(["x" * 300, *["l"] * 14, "", "end"])).splitlines()
    assert len(got) == 10 + 1 + 2 and got[0].endswith("(생략)") and got[10] == "⋮---- (5줄 생략)"


def test_the_markdown_query_equals_its_sql_on_odd_texts(spark, tmp_path):
    import duckdb

    from sparkloom.plans import catalog

    long = "word " * 60
    odd = [None, "", "\n", "\n\n", "a\n", " ", "\t", long, f"x\n3. {long}\ny", "- a\n" * 8, f"# {long}", "x\r\ny", "x\ry", "a\x0bb\x0cc\x1cd\x85e\u2028f\u2029g"]
    odd += [f"{long}\n{c}\n{long}" for c in "\t \u00a0\u1680\u180e\u2003\u200b\u202f\u205f\u3000\r\x0b\x1f\x85\ufeff"] + [f"|{long}|", "```\n" + "a\n" * 15 + "```", "\U0001f600" * 201, "e\u0301" * 150, "\n" + long]
    spark.createDataFrame(list(enumerate(odd)), "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    expected = sorted(con.execute(catalog.ORACLE_SQL["compress_markdown"]).fetchall())
    got = sorted((r["file"], r["compressed"]) for r in catalog.compress_markdown(spark, str(tmp_path)).collect())
    assert got == expected and len(got) == len(odd) - 1
