"""Registered queries over fixed files, with the rows that they must give: what SQL can't compute it can still state.

Each case is (name, content, expected columns...); the expected values are written down from what the operator has to do.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import features, graph, references, search, secrets, snapshots, tech_stack
from ..sources import project_tree
from . import enrich
from . import pack as packs

Query = Callable[[SparkSession, str], DataFrame]

CODE = (
    (
        "a.py",
        'import os, a.b as c\nfrom x.y import z\nfrom . import q\n\n@app.get("/items")\nasync def items(limit: int = 5) -> list:\n    found = load(limit)\n    return found\n\nclass A:\n    def m(self):\n        return 1\n',
        ("items(limit: int = 5) -> list|m(self)", "os|x.y|.", "GET /items"),
    ),
    (
        "b.java",
        "import java.util.List;\nimport static a.b.C.*;\nclass X {\n  X() { go(); }\n  String run(int a, List<String> b) throws E {\n    return \"x{\";\n  }\n  abstract void z();\n}\n",
        ("run(int a, List<String> b)|z()", "java.util.List|a.b.C.*", ""),
    ),
    ("c.ts", 'import { a } from "./a";\nimport "side";\nexport function f(x) {\n  return a(x);\n}\nclass Q {\n  go(x) {\n    if (x) { y(); }\n  }\n}\n', ("f(x)|go(x)", "./a|side", "")),
    ("d.js", 'import z from "z";\nfunction a(p, q) {\n  const s = `}${p}`;\n  return "{";\n}\nfunction b() { return 1; }\n', ("a(p, q)|b()", "z", "")),
    ("e.lua", 'local a = require("mod.a")\nlocal b = require \'b\'\nlocal function f(x)\n  return x\nend\nfunction T:m(a) return a end\n', ("f(x)|T:m(a)", "mod.a|b", "")),
    ("f.gd", 'extends "res://Base.gd"\nconst C = preload("res://s/player.controller.gd")\nfunc _ready() -> void:\n\tpass\nfunc go(x: int):\n\treturn x\n', ("_ready() -> void|go(x: int)", "Base|player.controller", "")),
    ("g.py", 'text = """\ndef no(): pass\nimport nothing\n"""\n# import neither\ndef yes(): pass\n', ("yes()", "", "")),
    ("h.rb", "def f; end\n", ("", "", "")),
)

MARK = "⋮----"
BODIES = (
    ("a.py", "def add(a, b):\n    total = a + b\n    return total\nx = 1\n", f"def add(a, b):\n    {MARK}\nx = 1"),
    ("b.java", "class A {\n    int add(int a) {\n        int t = a;\n        return t;\n    }\n}\n", f"class A {{\n    int add(int a) {{\n    {MARK}\n    }}\n}}"),
    ("c.lua", "local function add(a, b)\n    local t = a + b\n    return t\nend\n", f"local function add(a, b)\n    {MARK}\nend"),
    ("d.gd", "func add(a):\n\tvar t = a\n\treturn t\n", f"func add(a):\n    {MARK}"),
    ("e.rb", "def f\n  1\nend", "def f\n  1\nend"),
)

SHORTENED = (
    ("a.json", '{"b": [1, 2, 3, 4, 5], "a": "x", "c": {"d": [true, null]}}', '{"b":[1,2,3,"⋮---- (2개 항목 생략)"],"a":"x","c":{"d":[true,null]}}'),
    ("b.json", '["' + "y" * 201 + '"]', '["' + "y" * 200 + ' ⋮---- (생략)"]'),
    ("c.json", "{broken", "{broken"),
    ("d.json", '{"é": 1.5}', '{"é":1.5}'),
    ("e.md", "# h\n\n" + "- i\n" * 7 + "\n1. one\n2. two\n", "# h\n\n" + "- i\n" * 5 + "⋮---- (2개 항목 생략)\n\n1. one\n2. two"),
    ("f.md", "|a|b|\n|-|-|\n" + "|1|2|\n" * 8, "|a|b|\n|-|-|\n" + "|1|2|\n" * 5 + "⋮---- (3개 행 생략)"),
    ("g.md", "~~~\n" + "line\n" * 12 + "~~~\nafter\n", "~~~\n" + "line\n" * 10 + "⋮---- (2줄 생략)\n~~~\nafter"),
    ("h.md", "```python\ndef f():\n    return 1\n```\n", f"```python\ndef f():\n    {MARK}\n```"),
    ("i.md", "w" * 201 + "\n\nshort\nlines\n", "w" * 200 + " ⋮---- (생략)\n\nshort\nlines"),
    ("j.txt", "x" * 201 + "\n" + "l\n" * 11 + "\nend", "x" * 200 + " ⋮---- (생략)\n" + "l\n" * 9 + "⋮---- (2줄 생략)\n\nend"),
    ("k.csv", "a,b\n1,2\n", "a,b\n1,2\n"),
)

MANIFESTS = (
    ("package.json", '{"dependencies": {"react": "^18", "lodash": "4"}, "devDependencies": {"eslint": "^9", "lodash": "4"}}', (0, "JavaScript/TypeScript", "npm", "react,lodash,eslint")),
    (
        "requirements.txt",
        "flask[async]>=2.0\nrequests==2.31.0  # pinned\n# a comment\n\n-r other.txt\n-c limits.txt\n--index-url https://x.example/simple\ngit+https://g.example/foo/bar.git#egg=bar\n-e git+https://g.example/foo/baz.git#egg=baz\ngit+https://g.example/foo/none.git\nnumpy ; python_version > '3'\nzope.interface~=6.0\n",
        (1, "Python", "pip", "flask,requests,bar,baz,numpy,zope.interface"),
    ),
    ("pyproject.toml", '[project]\ndependencies = ["flask>=2.0", 123, "requests"]\n[tool.poetry.dependencies]\npython = "^3.11"\nrich = "^13"\n', (2, "Python", "poetry/pip", "flask,requests,rich")),
    ("Cargo.toml", '[dependencies]\nserde = "1.0"\ntokio = { version = "1", features = ["full"] }\n[dev-dependencies]\nproptest = "1"\n', (3, "Rust", "cargo", "serde,tokio")),
    (
        "go.mod",
        "module example.com/x\n\nrequire ()\n\nrequire (\n\tgithub.com/gin-gonic/gin v1.9.0\n\tgithub.com/stretchr/testify v1.8.0 // indirect\n)\nrequire golang.org/x/net v0.1.0\nreplace example.com/foo => ./local\n",
        (4, "Go", "go modules", "github.com/gin-gonic/gin,github.com/stretchr/testify,golang.org/x/net"),
    ),
    ("Gemfile", "source \"https://rubygems.org\"\ngem \"rails\", \"~> 7\"\n  gem 'pg'\n# gem 'no'\n", (5, "Ruby", "bundler", "rails,pg")),
    ("composer.json", '{"require": {"php": ">=8.0", "laravel/framework": "^10"}, "require-dev": {"phpunit/phpunit": "^10"}}', (6, "PHP", "composer", "laravel/framework,phpunit/phpunit")),
    (
        "pom.xml",
        '<project xmlns="http://maven.apache.org/POM/4.0.0"><dependencyManagement><dependencies><dependency><artifactId>managed</artifactId></dependency></dependencies></dependencyManagement><dependencies><dependency><groupId>org.s</groupId><artifactId> spring-core </artifactId></dependency></dependencies></project>',
        (7, "Java", "maven", "spring-core"),
    ),
)
BROKEN = (("package.json", '{"dependencies": true}'), ("pyproject.toml", 'project = "foo"\ntool = "bar"\n'), ("Cargo.toml", "dependencies = true\n"), ("composer.json", "{ not json"), ("pom.xml", "<project>"), ("sub/go.mod", "require a v1\n"))

PROJECT = (
    ("app.py", "import lib.util\nimport os\n\ndef run(path):\n    return path\n"),
    ("lib/util.py", "def clean(text):\n    return text\n"),
    ("lib/more.py", "import util\n"),
    ("notes.txt", "start with app.py\nthen read lib/util.py, not myapp.pyc\n"),
)


def _rows(*rows: tuple) -> str:
    literal = lambda v: "NULL" if v is None else str(v) if isinstance(v, int) else "'" + str(v).replace("'", "''") + "'"
    return ", ".join(f"({', '.join(literal(v) for v in r)})" for r in rows)


def _files(spark: SparkSession, cases) -> DataFrame:
    return spark.createDataFrame([(c[0], c[1]) for c in cases], "file string, content string")


def _joined(*columns: str):
    return [F.array_join(c, "|").alias(c) for c in columns]


def code_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signatures, imports and routes of six languages, of code in strings and comments and of an unknown language."""
    return features.features(_files(spark, CODE)).select("file", *_joined("signatures", "dependencies", "api"))


def code_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code with its bodies left out."""
    return features.features(_files(spark, BODIES)).select("file", "compressed")


def shortened_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON, Markdown and plain text at the edges of their limits."""
    return _files(spark, SHORTENED).select("file", features.compress_text(F.col("content"), text.extension(F.col("file"))).alias("compressed"))


def manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All eight kinds of manifests."""
    return tech_stack.tech_stack(_files(spark, MANIFESTS)).select("ord", "manifest", "language", "package_manager", F.array_join("dependencies", ",").alias("dependencies"))


def broken_manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifests that can't be read are there and name nothing; those below the root don't count."""
    return tech_stack.tech_stack(_files(spark, BROKEN)).select("manifest", F.size("dependencies").alias("n"), "dependencies_truncated")


def _pack(spark: SparkSession) -> packs.Pack:
    return packs.build(spark, _files(spark, PROJECT), "demo", use_llm=False)


def pack_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list of files of a pack made without a language model."""
    return _pack(spark).files.select("file", "ord", "summary")


def pack_relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Imports and mentions as internal and external relationships."""
    p = _pack(spark)
    return graph.adjacency(p.edges, p.files).select("file", F.array_join("internal", "|").alias("internal"), F.array_join("external", "|").alias("external"))


def pack_dependents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Direct dependents and blast radius of one file."""
    p = _pack(spark)
    of = lambda kind, df: df.select(F.lit(kind).alias("kind"), "file")
    return of("dependent", graph.dependents(p.edges, "lib/util.py")).union(of("blast", graph.blast_radius(p.edges, "lib/util.py")))


def pack_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line ranges of a shortened text: all, from, to and beyond its end."""
    own = _pack(spark).detail.where("file = 'app.py'")
    parts = [search.line_range(own, a, b).select(F.lit(str((a, b))).alias("range"), "text") for a, b in ((None, None), (4, None), (None, 2), (5, 99))]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


def pack_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _pack(spark)
    return p.project.crossJoin(p.files.agg(F.count("*").alias("file_count"))).select("name", F.size("rules").alias("rules"), "file_count")  # one row each


def pack_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Against a manifest: a file changed, one gone, one new, one with other line ends only."""
    now = [("app.py", "changed\n"), ("lib/util.py", PROJECT[1][1].replace("\n", "\r\n")), ("lib/more.py", PROJECT[2][1]), ("new.py", "")]
    return snapshots.compare(snapshots.manifest(_files(spark, now)), snapshots.manifest(_files(spark, PROJECT))).select("file", "status")


def project_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search.search(_files(spark, PROJECT), "IMPORT (lib|util)", 1, True)
    return found.select("file", "line_number", "line", F.array_join("context_before", "|").alias("before"), F.array_join("context_after", "|").alias("after"))


def written_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dependencies as written after linking (also one that is there under another name), unlinking and moving."""
    raw = spark.createDataFrame([("a.py", ["os", "b", "pkg.c"]), ("b.py", ["c.py", "c"]), ("c.py", []), ("d.py", ["x.c", "json"])], "file string, dependencies array<string>")
    steps = {"link": graph.link_written(raw, "a.py", "d.py"), "link again": graph.link_written(raw, "a.py", "b.py"), "unlink": graph.unlink_written(raw, "b.py", "c.py"), "move": graph.move_written(raw, "c.py", "d.py")}
    made = [df.select(F.lit(k).alias("step"), "file", F.array_join("dependencies", "|").alias("dependencies")) for k, df in steps.items()]
    return made[0].union(made[1]).union(made[2]).union(made[3])


def shared_base_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file name that several files share stands for all of them; a stem, a part of a word and the file itself don't count."""
    files = [("a/__init__.py", ""), ("b/__init__.py", ""), ("readme.txt", "see __init__.py and readme.txt"), ("x.txt", "my__init__.py, __init__, b/__init__.pyc"), ("y.txt", "(b/__init__.py)"), ("c d/e-f.txt", "x.txt's")]
    return references.references(_files(spark, files))


def external_scanner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An external scanner finds, clears or isn't available; only in the last case the patterns decide."""
    files = [("a.txt", 'password = "x"'), ("b.txt", 'password = "x"'), ("c.txt", 'one\npassword = "x"'), ("d.txt", "nothing")]
    return secrets.dangerous(secrets.scan(_files(spark, files), external=_scanner))


def _scanner(file: str, content: str) -> dict | bool | None:
    return {"reason": "own rule", "line": 1, "matched_text": content} if file == "a.txt" else False if file == "b.txt" else None


TREE = (
    ("a.py", b"x\r\ny"), ("node_modules/z.py", b""), ("sub/build/q.py", b""), ("k.log", b""), ("bad.py", b"\xff\xfe"), ("gen/x.py", b""), ("keep/k.py", "é".encode()), ("own.tmp", b""), ("docs/r.md", b"r"), ("z.md", b""),
)


def collected_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Built-in, root and the call's own ignore patterns, include patterns and files that aren't text."""
    raw = spark.createDataFrame([(n, bytearray(b)) for n, b in TREE], "file string, bytes binary")
    return project_tree.collected(raw, include=["*.py", "docs/", "*.tmp"], ignore=["*.tmp"], gitignore="# made\ngen/\n")


def mocked_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summaries in requests of eight from the provider with fixed replies."""
    return enrich.summarize(features.features(_files(spark, CODE)), "mock")


CORRECTIONS = (
    (1, "name", None, "shop"), (2, "rule_add", None, "one"), (3, "rule_add", None, "two"), (4, "rule_replace", "1", "uno"), (5, "rule_remove", None, "2"), (6, "summary", "app.py", "Runs."),
    (7, "link", "lib/util.py", "app.py"), (8, "summary", "none.py", "x"), (9, "unlink", "app.py", "lib/util.py"), (10, "rule_remove", None, "7"), (11, "summary", "notes.txt", " "),
)


def corrected_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of corrections: what they change, and what of them couldn't be applied."""
    made, problems = packs.apply_corrections(_pack(spark), spark.createDataFrame(list(CORRECTIONS), packs.CORRECTIONS))
    parts = [
        made.project.select(F.lit("name").alias("kind"), F.col("name").alias("value")), made.project.select(F.lit("rules"), F.array_join("rules", "|")), made.files.select(F.lit("summary"), F.concat_ws(": ", "file", "summary")),
        graph.internal(made.edges).select(F.lit("edge"), F.concat_ws(" > ", "src", "dst")), spark.createDataFrame([("problem", x) for x in problems], "kind string, value string"),
    ]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3]).union(parts[4])


ALL = "\n".join(["import lib.util", "import os", "", "def run(path):", f"    {MARK}"])
EXPECTED: dict[str, tuple[Query, str, str]] = {
    "code_features": (code_features, "file, signatures, dependencies, api", _rows(*((n, *e) for n, _, e in CODE))),
    "code_bodies": (code_bodies, "file, compressed", _rows(*((n, e) for n, _, e in BODIES))),
    "shortened_files": (shortened_files, "file, compressed", _rows(*((n, e) for n, _, e in SHORTENED))),
    "manifests": (manifests, "ord, manifest, language, package_manager, dependencies", _rows(*((e[0], n, *e[1:]) for n, _, e in MANIFESTS))),
    "broken_manifests": (broken_manifests, "manifest, n, dependencies_truncated", "('package.json', 0, false), ('pyproject.toml', 0, false), ('Cargo.toml', 0, false), ('composer.json', 0, false), ('pom.xml', 0, false)"),
    "pack_files": (
        pack_files,
        "file, ord, summary",
        _rows(("app.py", 1, "Defines: run(path)"), ("lib/more.py", 2, "References: util"), ("lib/util.py", 3, "Defines: clean(text)"), ("notes.txt", 4, "No signatures or dependencies found (structure only).")),
    ),
    "pack_relationships": (pack_relationships, "file, internal, external", _rows(("app.py", "lib/util.py", "os"), ("lib/util.py", "", ""), ("lib/more.py", "lib/util.py", ""), ("notes.txt", "app.py|lib/util.py", ""))),
    "pack_dependents": (pack_dependents, "kind, file", _rows(("dependent", "app.py"), ("dependent", "lib/more.py"), ("dependent", "notes.txt"), ("blast", "app.py"), ("blast", "lib/more.py"), ("blast", "notes.txt"))),
    "pack_detail": (pack_detail, "range, text", _rows(("(None, None)", ALL), ("(4, None)", f"def run(path):\n    {MARK}"), ("(None, 2)", "import lib.util\nimport os"), ("(5, 99)", f"    {MARK}"))),
    "pack_overview": (pack_overview, "name, rules, file_count", "('demo', 0, 4)"),
    "pack_freshness": (pack_freshness, "file, status", _rows(("app.py", "changed"), ("lib/util.py", "unchanged"), ("lib/more.py", "unchanged"), ("notes.txt", "removed"), ("new.py", "added"))),
    "project_search": (project_search, "file, line_number, line, before, after", _rows(("app.py", 1, "import lib.util", "", "import os"), ("lib/more.py", 1, "import util", "", ""))),
    "written_edits": (
        written_edits,
        "step, file, dependencies",
        _rows(
            ("link", "a.py", "os|b|pkg.c|d.py"), ("link", "b.py", "c.py|c"), ("link", "c.py", ""), ("link", "d.py", "x.c|json"), ("link again", "a.py", "os|b|pkg.c"), ("link again", "b.py", "c.py|c"), ("link again", "c.py", ""), ("link again", "d.py", "x.c|json"),
            ("unlink", "a.py", "os|b|pkg.c"), ("unlink", "b.py", ""), ("unlink", "c.py", ""), ("unlink", "d.py", "x.c|json"), ("move", "a.py", "os|b"), ("move", "b.py", ""), ("move", "c.py", ""), ("move", "d.py", "json|c.py"),
        ),
    ),
    "shared_base_names": (shared_base_names, "src, dst", _rows(("readme.txt", "a/__init__.py"), ("readme.txt", "b/__init__.py"), ("y.txt", "a/__init__.py"), ("y.txt", "b/__init__.py"), ("c d/e-f.txt", "x.txt"))),
    "external_scanner": (external_scanner, "file, reason, line, matched_text", _rows(("a.txt", "own rule", 1, 'password = "x"'), ("c.txt", "PASSWORD\\s*=\\s*[\\\"']", 2, 'password = "x"'))),
    "collected_tree": (collected_tree, "file, content", _rows(("a.py", "x\ny"), ("keep/k.py", "é"), ("docs/r.md", "r"))),
    "mocked_summaries": (mocked_summaries, "file, summary", _rows(*((n, "A fixed summary.") for n, _, _ in CODE))),
    "corrected_pack": (
        corrected_pack,
        "kind, value",
        _rows(
            ("name", "shop"), ("rules", "uno"), ("summary", "app.py: Runs."), ("summary", "lib/util.py: Defines: clean(text)"), ("summary", "lib/more.py: References: util"), ("summary", "notes.txt: No signatures or dependencies found (structure only)."),
            ("edge", "lib/more.py > lib/util.py"), ("edge", "notes.txt > app.py"), ("edge", "notes.txt > lib/util.py"),
            ("problem", "link lib/util.py app.py: an edge from 'lib/util.py' to 'app.py' would close a cycle"), ("problem", "rule_remove  7: no rule 7"), ("problem", "summary none.py: unknown file"),
        ),
    ),
}
QUERIES: dict[str, Query] = {name: f for name, (f, _, _) in EXPECTED.items()}
ORACLE_SQL: dict[str, str] = {name: f"SELECT * FROM (VALUES {rows}) t({columns})" for name, (_, columns, rows) in EXPECTED.items()}
