"""Registered fixed cases, graph searches and edits, unreadable files, scanners, policies, stages and corrections."""

import os
import random
import sys

import pytest
from pyspark.sql import functions as F

from sparkloom.functions import manifests
from sparkloom.operators import graph, references, scoring, secrets
from sparkloom.plans import enrich, fixed_cases, jobs, serve
from sparkloom.plans import pack as packs
from sparkloom.session import shared_dir
from sparkloom.sources import project_tree

FILES = [("a.py", "import b\n\ndef run(x):\n    return x\n"), ("b.py", "def go():\n    return 1\n"), ("n.txt", "see a.py\n")]


def files(spark, rows=FILES):
    return spark.createDataFrame(rows, "file string, content string")


def test_fixed_cases_give_their_rows(spark):
    import duckdb

    for name, query in fixed_cases.QUERIES.items():
        df, rel = query(spark, ""), duckdb.sql(fixed_cases.ORACLE_SQL[name])
        assert sorted(df.columns) == sorted(rel.columns), name
        assert sorted(str([r[c] for c in sorted(df.columns)]) for r in df.collect()) == sorted(str([r[rel.columns.index(c)] for c in sorted(df.columns)]) for r in rel.fetchall()), name


@pytest.mark.parametrize(
    ("line", "name"),
    [
        ("A.b-c_d >= 1", "A.b-c_d"), ("x[extra1,extra2]==1", "x"), ("x(>=1)", "x"), ("x @ https://h.example/x.whl", None), ("x @ git+https://h.example/x#egg=y", "y"), ("--editable=git+ssh://g@h/x.git@v1#subdirectory=s&egg=z-1", "z-1"),
        ("  # x", None), ("-r x.txt", None), ("./local", None), ("", None), ("https://h.example/x.tgz", None), ("x;sys_platform=='win32'", "x"), ("x~=1", "x"), ("x!=1", "x"), ("x # c", "x"),
    ],
)
def test_requirements(line, name):
    assert list(manifests.required(line)) == ([name] if name else [])


def test_go_modules_and_gems():
    assert manifests.dependencies("go.mod", 'require (\n  "a.b/c" v1\n\n  // d v1\n  e v2 // x\n)\nrequire f v3\nretract v1\nrequirement g\n') == ["a.b/c", "e", "f"]
    assert manifests.dependencies("go.mod", "require (\n a v1\n") == ["a"] and manifests.dependencies("go.mod", "require(\n a v1\n)\n") == ["a"]
    assert manifests.dependencies("Gemfile", "gem('a')\ngems 'b'\ngem \"c\", require: false\ngem 'd\"\n") == ["a", "c"]
    assert manifests.dependencies("pom.xml", "<project><dependencies><dependency><artifactId/></dependency></dependencies></project>") == []


def test_reaches_equals_a_plain_search(spark):
    rng = random.Random(3)
    for _ in range(4):
        links = {(f"n{rng.randrange(14)}", f"n{rng.randrange(14)}") for _ in range(14)}
        edges = spark.createDataFrame([(a, b, "internal", 0) for a, b in links] + [("n0", "n13", "external", 1)], "src string, dst string, kind string, ord int")
        for start, goal in [(f"n{rng.randrange(14)}", f"n{rng.randrange(14)}") for _ in range(5)] + [("n1", "none")]:
            seen, ahead = {start}, [start]
            while ahead:
                ahead = [b for a, b in links if a in ahead and b not in seen]
                seen |= set(ahead)
            assert graph.reaches(edges, start, goal, every=2) == (goal in seen)


def test_written_edits_refuse(spark):
    raw = spark.createDataFrame([("a.py", ["b"]), ("b.py", None)], "file string, dependencies array<string>")
    for edit in (graph.link_written, graph.move_written):
        with pytest.raises(ValueError):
            edit(raw, "a.py", "a.py")
        with pytest.raises(ValueError):
            edit(raw, "a.py", "zz")
    with pytest.raises(graph.CycleError):
        graph.link_written(raw, "b.py", "a.py")
    with pytest.raises(graph.CycleError):
        graph.move_written(raw, "a.py", "b.py")
    assert [r["dependencies"] for r in graph.unlink_written(raw, "a.py", "b.py").orderBy("file").collect()] == [[], []]


def test_unreadable_files_are_left_out(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one")
    os.symlink(tmp_path / "none", tmp_path / "dangling.txt")
    os.mkfifo(tmp_path / "pipe.txt")
    (tmp_path / "b.txt").write_bytes(b"\xff\xfe")
    assert [r["file"] for r in project_tree.read(spark, str(tmp_path)).collect()] == ["a.txt"]
    reader = project_tree.TreeReader({"path": str(tmp_path)})
    [part] = reader.partitions()
    os.unlink(tmp_path / "a.txt")  # between the walk and the read
    assert sum(b.num_rows for b in reader.read(part)) == 0


def test_mentions_are_verified_once_for_a_shared_name(spark):
    names = spark.createDataFrame([(f"d{k}/x.txt",) for k in range(50)], "file string")
    texts = files(spark, [("t1.txt", "x.txt"), ("t2.txt", "y x.txty")])
    parts = names.select(F.lit("x.txt").alias("part")).distinct()
    assert [tuple(r) for r in references.mentioned(texts, parts).collect()] == [("t1.txt", "x.txt")]
    assert references.references(texts, names).count() == 50


def test_texts_meet_only_names_whose_rarest_word_they_hold(spark, monkeypatch):
    made, n, kept = {}, 60, references.cut
    monkeypatch.setattr(references, "cut", lambda df, name: made.setdefault(name, kept(df, name)))
    texts = files(spark, [(f"t{k}.txt", f"common example.org/{k}/ and example.org/en/{(k * 7) % n}.html, {k}x.longer") for k in range(n)])
    names = spark.createDataFrame([(f"example.org/{k}/",) for k in range(n)] + [(f"example.org/en/{k}.html",) for k in range(n)] + [("no/common.none",)], "file string")
    found = sorted((r["src"], r["dst"]) for r in references.references(texts, names).collect())
    assert found == sorted([(f"t{k}.txt", f"example.org/{k}/") for k in range(n)] + [(f"t{k}.txt", f"example.org/en/{(k * 7) % n}.html") for k in range(n)])
    assert made["met"].count() <= 4 * n  # each text holds two numbers; by the longest word all n * n pairs met


def test_mentions_end_at_letters_digits_and_underscores_only(spark):
    contents = {"a.md": "²x.longer", "b.md": "x.longer² ", "c.md": "x.longer\u0301", "d.md": "\u0301x.longer", "e.md": "_x.longer", "f.md": "‿x.longer", "g.md": "longer x.longer-"}
    expected = [(f, "x.longer") for f in ("c.md", "d.md", "f.md", "g.md")]
    found = references.references(files(spark, list(contents.items())), spark.createDataFrame([("x.longer",)], "file string"))
    assert sorted((r["src"], r["dst"]) for r in found.collect()) == expected


def test_numbers_are_whole_however_partitions_are_joined(spark):
    names = spark.range(40_000).select((F.col("id") * 7919 % 40_000 - 20_000).alias("k")).select("k", F.concat(F.lit("f"), F.col("k").cast("string")).alias("file"), F.repeat(F.sha2(F.col("k").cast("string"), 256), 4).alias("content"))
    odd = names.union(spark.createDataFrame([(None, None, "x"), (7, "f7", "twice")], names.schema))
    settings = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "300k", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        for by in ("file", "k"):
            placed = secrets.numbered(odd) if by == "file" else secrets.numbered(odd, by)
            got = sorted(((r["place"], r[by]) for r in placed.select("place", by, F.length("content")).collect()), key=lambda x: x[0])
            values = sorted(r[by] for r in odd.where(f"{by} is not null").collect())
            assert got == list(enumerate([*values, None], 1))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_an_external_command(spark, tmp_path):
    script = tmp_path / "scan.py"
    script.write_text("import json,sys\nt=open(sys.argv[1]).read()\nif 'crash' in t: sys.exit('no')\nm=[{'message':'found it','range':{'start':{'line':2}}}] if 'bad' in t else []\nprint(json.dumps([{'messages':m}]))\n")
    rows = [("a.txt", "x\nbad\n"), ("b.txt", 'password = "x"'), ("c.txt", 'crash\npassword = "x"')]
    got = {r["file"]: (r["reason"], r["line"], r["matched_text"]) for r in secrets.dangerous(secrets.scan(files(spark, rows), external=secrets.Command(sys.executable, str(script)))).collect()}
    assert got["a.txt"] == ("found it", 2, "bad") and "b.txt" not in got and got["c.txt"][1] == 2
    none = {r["file"] for r in secrets.dangerous(secrets.scan(files(spark, rows), external=secrets.Command("/no/such/program"))).collect()}
    assert none == {"b.txt", "c.txt"}


class Silent:
    def generate(self, prompt):
        return "{}"


def test_policies(spark, tmp_path, monkeypatch):
    monkeypatch.setitem(enrich.PROVIDERS, "silent", Silent)
    stages, asked = str(tmp_path / "s"), []
    monkeypatch.setattr(enrich, "rules_of_all", lambda *a, **k: None)  # runs in workers, which don't know this test's provider
    monkeypatch.setattr(enrich, "guide", lambda *a, **k: "g" if len(asked) > 3 else None)
    monkeypatch.setattr(enrich, "summarize", lambda df, *a, **k: enrich.structural(df))

    def failed(field):
        asked.append(field)
        return ["by hand"] if field == "rules" else packs.RETRY

    with pytest.raises(packs.SummariesFailed):
        packs.build(spark, files(spark), "p", stages=stages)
    assert os.path.exists(f"{stages}/features")
    made = packs.build(spark, files(spark), "p", policy=packs.Policy(failed=failed))
    assert packs.rules_of(made) == ["by hand"] and made.project.head()["prompt"] == "g" and asked == ["rules", "guide", "guide", "guide"]


def test_stopped_runs_go_on_by_file(spark, tmp_path, monkeypatch):
    stages, calls = str(tmp_path / "s"), []
    plain = packs.features.features

    def counted(df):
        calls.append(sorted(r["file"] for r in df.select("file").collect()))
        return plain(df)

    monkeypatch.setattr(packs.features, "features", counted)
    stop = iter([False, True])
    with pytest.raises(packs.Cancelled):
        packs.build(spark, files(spark), "p", use_llm=False, stages=stages, cancelled=lambda: next(stop))
    changed = [("a.py", FILES[0][1]), ("b.py", "def other():\n    pass\n"), ("new.py", "import a\n")]
    made = packs.build(spark, files(spark, changed), "p", use_llm=False, stages=stages)
    assert {r["file"]: r["summary"] for r in made.files.collect()} == {"a.py": "Defines: run(x)", "b.py": "Defines: other()", "new.py": "References: a"}
    assert calls[-1] == ["b.py", "new.py"] and not os.path.exists(stages)
    with pytest.raises(packs.Cancelled):
        packs.build(spark, files(spark), "p", use_llm=False, stages=stages, cancelled=iter([False, True]).__next__, policy=packs.Policy(keep=lambda: False))
    assert not os.path.exists(stages)


def test_rules_are_asked_over_all_signatures(spark):
    signed = spark.createDataFrame([(f"f{k}.py", [f"s{k}_{j}()" for j in range(7)]) for k in range(30)], "file string, signatures array<string>")
    assert enrich.rules_of_all(signed, "mock", most=20) == ["a fixed rule"]
    assert enrich.rules_of_all(signed.limit(0), "mock") == []


def test_corrections(spark):
    made = packs.build(spark, files(spark), "p", use_llm=False)
    table = [(1, "name", None, "New"), (2, "rule_add", None, "r1"), (3, "rule_add", None, "r2"), (4, "rule_remove", None, "1"), (5, "rule_replace", "1", "r3"), (6, "rule_remove", None, "9"), (7, "summary", "b.py", "old"), (8, "summary", "b.py", "by hand"), (9, "summary", "zz", "x"), (10, "link", "b.py", "a.py"), (11, "link", "n.txt", "b.py"), (12, "unlink", "a.py", "b.py"), (13, "hm", None, None)]
    done, problems = packs.apply_corrections(made, spark.createDataFrame(table, packs.CORRECTIONS))
    assert done.project.head()["name"] == "New" and packs.rules_of(done) == ["r3"]
    assert {r["file"]: r["summary"] for r in done.files.collect()}["b.py"] == "by hand"
    lists = {r["file"]: list(r["internal"]) for r in graph.adjacency(done.edges, done.files).collect()}
    assert lists == {"a.py": [], "b.py": [], "n.txt": ["a.py", "b.py"]} and [p.split()[0] for p in problems] == ["rule_remove", "link", "hm", "summary"]
    assert packs.overview_text(done).startswith("# New\n\n") and packs.overview_text(done).endswith("## Rules\n- r3")
    assert packs.file_text(done, "b.py") == "# b.py\n\nby hand\n\n```\ndef go():\n    ⋮----\n```"
    with pytest.raises(ValueError):
        packs.file_text(done, "zz")


def test_config_and_stopping(spark, tmp_path):
    service = serve.Service(spark, str(tmp_path / "s.json"), {"pack": "x"})
    assert service.answer("GET", "/api/config") == (200, {"project": None, "pack": "x"})
    own = jobs.Jobs(spark)
    own.jobs["j"] = jobs.Job("j", "p", "o", {})
    own.stop("j", save=False)
    assert own.jobs["j"].stop.is_set() and not own.jobs["j"].keep


def test_counts_by_a_vocabulary(spark, tmp_path):
    import base64

    path = tmp_path / "v.tiktoken"
    pieces = [bytes([b]) for b in range(256)] + [b"ab", b"abc"]
    path.write_bytes(b"\n".join(base64.b64encode(p) + b" %d" % k for k, p in enumerate(pieces)))
    count = scoring.vocabulary_counter(str(path), r"\S+|\s+")
    assert [r[0] for r in spark.createDataFrame([("abc ab",), ("",), (None,), ("é",)], "t string").select(count("t")).collect()] == [3, 0, 0, 2]


def test_a_cluster_must_name_its_shared_folder(spark):
    class Conf:
        def get(self, key):
            return None

    class Context:
        master = "spark://h:7077"
        getConf = Conf

    class Session:
        sparkContext = Context

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Session)
    assert shared_dir(spark)
