"""Patterns, folders of files and manifests."""

import json

import pytest
from pyspark.sql import functions as F

from sparkloom.functions import manifests
from sparkloom.operators import tech_stack
from sparkloom.plans import settings
from sparkloom.sources import project_tree
from sparkloom.sources.ignore_rules import Rules, gitignore_lines


@pytest.mark.parametrize(
    ("rules", "path", "covered"),
    [
        (["*.log"], "a/b.log", True), (["/top"], "top/x", True), (["/top"], "q/top", False), (["docs/*.md"], "docs/a.md", True), (["docs/*.md"], "docs/s/a.md", False),
        (["a/**/b"], "a/b", True), (["a/**/b"], "a/x/y/b", True), (["build/"], "x/build/y", True), (["build/"], "x/build", False), (["*.py", "!keep.py"], "keep.py", False),
        (["dir/", "!dir/keep"], "dir/keep", True), (["a[0-9].txt"], "a7.txt", True), (["a[!0-9].txt"], "a7.txt", False), (["src/**"], "src/a/b", True), (["**/x"], "q/x", True), ([r"\#f"], "#f", True), (["# c"], "# c", False),
    ],
)
def test_rules_agree_in_python_and_spark(spark, rules, path, covered):
    own = Rules(rules)
    assert own.covers(path) is covered
    assert spark.createDataFrame([(path,)], "p string").select(project_tree.covered(F.col("p"), own)).head()[0] is covered


def test_gitignore_comments():
    assert gitignore_lines("# c\n a \n\n  # kept\n") == ["a", "# kept"]


@pytest.fixture
def project(tmp_path):
    for name, data in {
        "src/a.py": b"import b\r\n", "src/__init__.py": b"", ".gitignore": b"*.tmp\n", "x.tmp": b"t", "node_modules/m.js": b"m", "img.bin": b"\xff\xfe\x00", "docs/r.md": b"r",
        "package.json": json.dumps({"dependencies": {"b": "1", "a": "2"}, "devDependencies": {"b": "1"}}).encode(), "sub/requirements.txt": b"no",
    }.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    return tmp_path


def test_tree_is_pruned_decoded_and_keeps_hidden_names(spark, project):
    got = {r["file"]: r["content"] for r in project_tree.read(spark, str(project)).collect()}
    assert sorted(got) == [".gitignore", "docs/r.md", "package.json", "src/__init__.py", "src/a.py", "sub/requirements.txt"]
    assert got["src/a.py"] == "import b\n"


def test_include_narrows_and_config_is_merged(spark, project):
    (project / project_tree.CONFIG).write_text(json.dumps({"include": ["src/**"], "ignore": ["a.py"], "other": 1}))
    assert [r["file"] for r in project_tree.read(spark, str(project)).collect()] == ["src/__init__.py"]
    assert project_tree.load_config(str(project / "none")) == {}
    with pytest.raises(FileExistsError):
        project_tree.init_config(str(project))


def test_collected_equals_the_tree(spark, project):
    raw = [(str(p.relative_to(project)), p.read_bytes()) for p in project.rglob("*") if p.is_file()]
    got = project_tree.collected(spark.createDataFrame(raw, "file string, bytes binary"), gitignore="*.tmp\n")
    assert sorted(r["file"] for r in got.collect()) == sorted(r["file"] for r in project_tree.read(spark, str(project)).collect())


def test_tech_stack(spark, project):
    [row] = tech_stack.tech_stack(project_tree.read(spark, str(project))).collect()
    assert (row["manifest"], row["dependencies"], row["dependencies_truncated"]) == ("package.json", ["b", "a"], False)


@pytest.mark.parametrize(
    ("name", "text", "expected"),
    [
        ("requirements.txt", "flask[async]>=2; x\n# c\n-r o.txt\n--hash=1\ngit+https://h/r#egg=foo\n-e git+https://h/r\nbar # z\n", ["flask", "foo", "bar"]),
        ("pyproject.toml", '[project]\ndependencies=["a>=1","b [x]"]\n[tool.poetry.dependencies]\nPython="3"\nq="1"\n', ["a", "b", "q"]),
        ("pyproject.toml", 'project = "odd"\n', []), ("pyproject.toml", "broken = [", []),
        ("Cargo.toml", '[dependencies]\nserde={version="1"}\nx="1"\n', ["serde", "x"]),
        ("go.mod", "module m\nrequire ()\nrequire (\n\ta v1\n\tb v2 // i\n)\nrequire (c v1)\nrequire d v3\nreplace q => z\n", ["a", "b", "c", "d"]),
        ("Gemfile", "gem 'rails', '7'\n# gem 'no'\n  gem \"pg\"\n", ["rails", "pg"]),
        ("composer.json", '{"require":{"php":"8","a/b":"1"},"require-dev":{"c/d":"1"}}', ["a/b", "c/d"]), ("composer.json", "[]", []),
        ("pom.xml", '<project xmlns="m"><dependencyManagement><dependencies><dependency><artifactId>no</artifactId></dependency></dependencies></dependencyManagement><dependencies><dependency><artifactId> a </artifactId></dependency></dependencies></project>', ["a"]),
        ("pom.xml", "<broken", []), ("package.json", '{"dependencies": true}', []),
    ],
)
def test_manifests(name, text, expected):
    assert manifests.dependencies(name, text) == expected


def test_cap(spark):
    shown, more = tech_stack.capped(F.col("n"))
    df = spark.createDataFrame([([f"d{k % 50}" for k in range(60)],)], "n array<string>").select(shown.alias("s"), more.alias("m")).head()
    assert len(df["s"]) == 40 and df["m"]


def test_settings(tmp_path):
    path = str(tmp_path / "s.json")
    assert settings.load(path) == settings.DEFAULT and settings.output_path(path, "/p/q") == ""
    settings.save(path, {"output_dir": "/all", "project_output_dirs": {}})
    settings.pin(path, "/p/q", "/own")
    assert settings.output_path(path, "/p/q") == "/own/q.json" and settings.output_dir(path, "/p/z") == "/all"
    (tmp_path / "s.json").write_text("[broken")
    assert settings.load(path) == settings.DEFAULT
