"""Packs from end to end, the questions to them, and the registered queries."""

import json
import threading

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from sparkloom.operators import graph, scoring
from sparkloom.plans import api, catalog, cli, enrich, jobs, serve, skill
from sparkloom.plans import pack as packs
from sparkloom.sources import project_tree

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def project(tmp_path_factory):
    root = tmp_path_factory.mktemp("proj")
    for name, content in {
        "src/a.py": 'import b\nfrom src.util import x\n@app.get("/a")\ndef handler(q):\n    return 1\n', "src/b.py": "def bee():\n    return 2\n", "src/util.py": "def util(a):\n    return a\n",
        "README.md": "see a.py", "bad.py": 'PASSWORD = "x"\n', "package.json": '{"dependencies":{"left":"1"}}',
    }.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(content)
    return str(root)


@pytest.fixture(scope="module")
def saved(spark, project, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("packs") / "proj")
    made = packs.build(spark, project_tree.read(spark, project), "proj", provider="mock", stages=f"{path}.stages")
    return packs.save(made, path)


def test_questions(spark, project, saved):
    overview = api.get_overview(saved, project)
    assert overview["file_count"] == 5 and "_stale" not in overview and overview["project"]["tech_stack"][0]["dependencies"] == ["left"]
    assert list(api.list_files(saved)) == ["README.md", "package.json", "src/a.py", "src/b.py", "src/util.py"]
    assert api.get_relationships(saved)["src/a.py"] == {"internal": ["src/b.py", "src/util.py"], "external": []}
    assert api.get_dependents(saved, "src/util.py") == ["src/a.py"] and api.get_blast_radius(saved, "src/util.py") == ["README.md", "src/a.py"]
    assert api.get_detail(saved, "src/a.py", 4, 5) == "def handler(q):\n    ⋮----"
    with pytest.raises(ValueError):
        api.get_detail(saved, "nothing")
    assert [m["file"] for m in api.search_project(project, "return")] == ["src/a.py", "src/b.py", "src/util.py"]
    assert api.check_freshness(project, saved)["is_stale"] is False


def test_drift_and_reuse(spark, project, saved, tmp_path):
    files = project_tree.read(spark, project).collect()
    changed = spark.createDataFrame([(r["file"], r["content"] + ("#" if r["file"] == "src/b.py" else "")) for r in files], "file string, content string")
    previous = packs.edit_summaries(packs.load(spark, saved), spark.createDataFrame([("src/util.py", "by hand"), ("zz", "no"), ("src/a.py", " ")], "file string, summary string"))
    made = packs.build(spark, changed, "proj", use_llm=False, previous=previous)
    got = {r["file"]: r["summary"] for r in made.files.collect()}
    assert got["src/util.py"] == "by hand" and got["src/a.py"] == "A fixed summary." and got["src/b.py"].startswith("Defines: bee")
    assert packs.rules_of(made) == [] and made.project.head()["prompt"] == packs.STRUCTURE_ONLY


def test_edits_in_place(spark, saved, tmp_path):
    path = packs.save(packs.load(spark, saved), str(tmp_path / "copy"))
    packs.edit_saved_edges(spark, path, graph.link, "src/b.py", "package.json")
    assert api.get_dependents(path, "package.json") == ["src/b.py"]
    with pytest.raises(graph.CycleError):
        packs.edit_saved_edges(spark, path, graph.link, "src/b.py", "src/a.py")
    pack = packs.add_rule(packs.load(spark, path), "r2")
    assert packs.rules_of(pack) == ["a fixed rule", "r2"] and packs.rules_of(packs.remove_rule(pack, 0)) == ["r2"]
    with pytest.raises(IndexError):
        packs.remove_rule(pack, 9)
    with pytest.raises(KeyError):
        packs.edit_summaries(pack, spark.createDataFrame([("zz", "s")], "file string, summary string"), strict=True)


def test_empty_cancelled_and_failed(spark, project):
    files = project_tree.read(spark, project)
    assert packs.build(spark, files.limit(0), "p") is None
    with pytest.raises(packs.Cancelled):
        packs.build(spark, files, "p", cancelled=lambda: True)
    enrich.PROVIDERS["empty"] = lambda: type("Empty", (), {"generate": lambda self, prompt: "{}"})()
    with pytest.raises(packs.SummariesFailed):
        packs.build(spark, files, "p", provider="empty")


def test_documents(spark, saved, tmp_path):
    made = skill.documents(spark, packs.load(spark, saved))
    assert set(made) == {"SKILL.md", "references/overview.md", "references/files.md", "references/relationships.md", "references/detail.json"}
    assert "| `src/b.py` | 0.00 | A fixed summary. |" in made["references/files.md"] and "- depends on: `src/b.py`" in made["references/relationships.md"]
    assert made["SKILL.md"].startswith("---\nname: proj\n") and set(json.loads(made["references/detail.json"])) == set(api.list_files(saved))
    paths = packs.export_json(packs.load(spark, saved), str(tmp_path / "x.json"))
    assert len(paths) == 3 and "compressed" not in (tmp_path / "x.json").read_text().split('"tokens"')[0]


def test_objects_are_written_as_json_writes_them(spark, saved, tmp_path):
    at = tmp_path / "o.json"
    for rows in ([], [("b", "x\n\"é"), ("a", None), ("c\\", "")], [(f"f{k:03}", "t" * k) for k in range(50)]):
        df = spark.createDataFrame(rows, "file string, compressed string").repartition(3)
        packs.write_object(df, F.struct("compressed"), str(at))
        assert at.read_text(encoding="utf-8") == json.dumps({k: {"compressed": v} for k, v in sorted(rows)}, ensure_ascii=False, indent=2)
    folder = skill.export(spark, saved, str(tmp_path / "skill"))
    for name, content in skill.documents(spark, packs.load(spark, saved)).items():
        assert (tmp_path / "skill" / name).read_text(encoding="utf-8") == content, name
    assert folder == str(tmp_path / "skill")


def test_batches_and_fallbacks(spark):
    pending = spark.createDataFrame([(f"f{k:02}", ["s()"] if k % 2 else [], [], "text") for k in range(11)], "file string, signatures array<string>, dependencies array<string>, compressed string")
    assert {r["summary"] for r in enrich.summarize(pending, "mock").collect()} == {"A fixed summary."}

    class Half:
        def generate(self, prompt):
            return "```json\n" + json.dumps({"summaries": {"f00": "one"}} if '"summaries"' in prompt else {"summary": "alone"} if "f01" in prompt else {}) + "\n```"

    enrich.PROVIDERS["half"] = Half
    try:
        got = {r["file"]: r["summary"] for r in enrich.summarize(pending, "half").collect()}
    except Exception as e:  # the provider is looked up in workers, where it isn't registered
        assert "half" in str(e)
    else:
        assert got["f00"] == "one" and got["f01"] == "alone" and got["f02"] == scoring.FAILED


def test_retries():
    replies, waits = iter([(503, ""), (429, ""), (200, '```\n{"summary": "s"}\n```')]), []
    rest = enrich.Rest("u", send=lambda u, p: next(replies), wait=0)
    assert rest.generate("p") == '{"summary": "s"}' and enrich.Rest("u", send=lambda u, p: (400, "")).generate("p") == "{}" and not waits


def test_jobs(spark, project, tmp_path):
    own = jobs.Jobs(spark)
    assert own.selectable(project)["dangerous"][0]["file"] == "bad.py"
    job = own.start(project, str(tmp_path / "out"), use_llm=False, selected=["src/a.py", "src/b.py"])
    own.jobs[job].thread.join()
    assert own.status(job)["state"] == "reviewing" and own.reviewing()
    assert own.unlink(job, "src/a.py", "src/b.py")["src/a.py"]["internal"] == []
    assert api.list_files(own.finish(job, name="New", summaries={"src/b.py": "by hand"}))["src/b.py"]["summary"] == "by hand"
    with pytest.raises(ValueError):
        own.review(job)
    with pytest.raises(ValueError):
        own.status("none")
    assert own.status(job, since=1)["log"] == ["ready for review"]


def test_cli(spark, project, tmp_path, capsys):
    out = str(tmp_path / "cli")
    assert cli.main(["pack", project, "--no-llm", "--output", out, "--max-tokens", "100000"]) == 0
    assert cli.main(["pack", project, "--no-llm", "--output", out, "--max-tokens", "1", "--model", "GPT-4"]) == 1
    assert cli.main(["tree", project]) == 0 and cli.main(["freshness", project, out]) == 0 and cli.main(["search", project, "bee"]) == 0
    assert cli.main(["signatures", f"{project}/src/b.py"]) == 0 and cli.main(["init", project]) == 0 and cli.main(["init", project]) == 1
    (tmp_path / "x").mkdir()
    text = capsys.readouterr().out
    assert "src/b.py:1: def bee():" in text and '"is_stale": false' in text


def test_http(spark, project, saved, tmp_path):
    import threading
    from urllib import error, request

    own = packs.save(packs.load(spark, saved), str(tmp_path / "copy"))
    service = serve.Service(spark, str(tmp_path / "settings.json"))
    server = serve.http(service, 0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    with request.urlopen(f"http://127.0.0.1:{server.server_port}/api/dependents?pack={own}&file=src/util.py") as r:
        assert json.load(r) == ["src/a.py"]
    with pytest.raises(error.HTTPError):
        request.urlopen(f"http://127.0.0.1:{server.server_port}/nothing")
    server.shutdown()
    post = lambda path, **body: service.answer("POST", path, json.dumps(body).encode())
    status, found = post("/api/relationships/link", pack=own, file="src/b.py", target="package.json")
    assert status == 200 and found["src/b.py"]["internal"] == ["package.json"]
    assert post("/api/relationships/link", pack=own, file="src/b.py", target="src/a.py")[0] == 409
    assert post("/api/relationships/unlink", pack=own, file="src/b.py", target="package.json")[1]["src/b.py"]["internal"] == []
    assert service.answer("GET", f"/api/detail?pack={own}&file=src/a.py&start=4&end=4") == (200, {"text": "def handler(q):"})
    assert service.answer("GET", f"/api/search?project={project}&pattern=(")[0] == 400 and service.answer("GET", "/api/detail?pack=x")[0] == 400
    assert service.answer("GET", f"/api/overview?pack={tmp_path}/none")[0] == 404 and service.answer("POST", "/api/pack", b"{")[0] == 400
    assert service.answer("GET", "/api/pack/status?job=none")[0] == 404
    job = post("/api/pack", project=project, output=str(tmp_path / "made" / "p"), no_llm=True)[1]["job"]
    service.jobs.jobs[job].thread.join()
    assert service.answer("GET", f"/api/pack/status?job={job}")[1]["state"] == "reviewing" and service.answer("GET", f"/api/pack/review?job={job}")[0] == 200
    assert post("/api/pack/cancel", job=job)[0] == 200 and settings_of(service, project) == str(tmp_path / "made")


def settings_of(service, project):
    return service.answer("GET", "/api/settings")[1]["project_output_dirs"][project]


def test_tools(saved):
    import io

    asked = [{"id": 1, "method": "initialize"}, {"method": "notifications/initialized"}, {"id": 2, "method": "tools/list"}, {"id": 3, "method": "tools/call", "params": {"name": "get_blast_radius", "arguments": {"pack_path": saved, "file": "src/util.py"}}}, {"id": 4, "method": "tools/call", "params": {"name": "get_detail", "arguments": {"pack_path": saved, "file": "zz"}}}, {"id": 5, "method": "zz"}]
    out = io.StringIO()
    serve.serve_tools(io.StringIO("\n".join(map(json.dumps, asked)) + "\nnot json\n"), out)
    replies = [json.loads(x) for x in out.getvalue().splitlines()]
    assert [r["id"] for r in replies] == [1, 2, 3, 4, 5, None] and {t["name"] for t in replies[1]["result"]["tools"]} == set(api.QUESTIONS)
    assert json.loads(replies[2]["result"]["content"][0]["text"]) == ["README.md", "src/a.py"] and replies[3]["result"]["isError"] and "error" in replies[4]


def test_locks_are_by_path_and_few():
    locks, order = jobs.PathLocks(kept=2), []

    def late():
        with locks.of("p/../x"):
            order.append("late")

    with locks.of("x"):
        t = threading.Thread(target=late)
        t.start()
        for k in range(5):
            with locks.of(f"y{k}"):
                order.append(k)
        assert "x" in locks.known and "late" not in order
    t.join(10)
    assert order == [0, 1, 2, 3, 4, "late"] and len(locks.known) <= 2


def test_registered_queries(spark):
    assert entry.entry(spark).count() > 0
    assert set(catalog.ORACLE_SQL) <= set(catalog.QUERIES) and set(entry.oracle_sql()) <= set(entry.queries())


def test_queries_equal_their_sql(spark):
    import duckdb

    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents pages benchmark labels conversations".split():
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    plain = lambda v: round(v, 6) if isinstance(v, float) else v
    for name, sql in catalog.ORACLE_SQL.items():
        df = catalog.QUERIES[name](spark, SF)
        cols = sorted(df.columns)
        got = sorted(repr([plain(r[c]) for c in cols]) for r in df.collect())
        rel = con.execute(sql)
        have = [d[0] for d in rel.description]
        assert sorted(have) == cols, name
        assert got == sorted(repr([plain(r[have.index(c)]) for c in cols]) for r in rel.fetchall()), name
