import json
import os
import subprocess
import zipfile

import pytest

from tempograph.sources import analysis, exports, gitlog
from tempograph.streaming import incremental


@pytest.fixture
def repo(tmp_path):
    p = tmp_path / "r"
    p.mkdir()
    env = os.environ | {"GIT_AUTHOR_NAME": "a", "GIT_AUTHOR_EMAIL": "a@x", "GIT_COMMITTER_NAME": "c", "GIT_COMMITTER_EMAIL": "c@x", "GIT_CONFIG_GLOBAL": "/dev/null"}
    run = lambda *a: subprocess.run(["git", "-C", str(p), *a], check=True, capture_output=True, env=env)
    run("init", "-q", "-b", "main")
    (p / "a.py").write_text("def f(x):\n    return g(x)\n" * 5)
    run("add", ".")
    run("commit", "-qm", "first\n\nbody")
    run("mv", "a.py", "b.py")
    run("commit", "-qm", "second")
    return str(p)


def test_git_source(spark, repo):
    spark.dataSource.register(gitlog.GitSource)
    load = lambda kind: spark.read.format("githistory").option("path", repo).option("kind", kind).load()
    c = load("commits").orderBy("seq").collect()
    assert [r.message for r in c] == ["first\n\nbody", "second"] and c[0].parents == [] and c[1].parents == [c[0].oid]
    ch = load("changes").orderBy("seq").collect()
    assert [(r.status, r.old_path, r.new_path) for r in ch] == [("A", "a.py", "a.py"), ("R", "a.py", "b.py")]
    b = load("blobs").collect()
    assert len(b) == 1 and b[0].size == len(b[0].content)
    assert gitlog.object_format(repo) == "sha1"


SOURCE = 'class A(Base):\n    """Doc."""\n    @deco\n    def m(self, x: int) -> int:\n        é = x\n        return helper(é)\n\ndef helper(v):\n    return v\n'


def test_python_analyzer(spark):
    x = analysis.python_analyzer("pkg/mod.py", SOURCE)
    kinds = {(s["kind"], s["name"]) for s in x["symbols"]}
    assert {("class", "A"), ("method", "m"), ("parameter", "x"), ("variable", "é"), ("function", "helper")} <= kinds
    raw = SOURCE.encode()
    for r in x["references"]:
        if r["kind"] == "read":
            assert raw[r["range"]["start_byte"] : r["range"]["end_byte"]].decode() == r["target_text"]
    call = next(r for r in x["references"] if r["kind"] == "call")
    assert call["resolution"] == "resolved" and call["target_qualified_name"] == "pkg.mod.helper"
    assert analysis.python_analyzer("a.py", "def (")["diagnostics"] and x == analysis.python_analyzer("pkg/mod.py", SOURCE)
    df = spark.createDataFrame([("b1", "pkg/mod.py", "python", SOURCE), ("b1", "copy/mod.py", "python", SOURCE), ("b2", "x.py", "python", "def ("), ("b3", "x.js", "javascript", "x")], "blob_oid string, path string, language string, source string")
    s, refs = analysis.explode(analysis.analyze(df))
    assert {r.path for r in s.collect()} == {"pkg/mod.py", "copy/mod.py"} and refs.where("owner is not null and owner_name is null").count() == 0


def test_jsonl(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    good = {"file": {"path": "a.clj", "language": "clojure", "blob_oid": "b"}, "symbols": [{"local_id": "s0", "name": "f"}], "references": [], "extra": 1}
    p.write_text(json.dumps(good) + "\nnot json\n{}\n")
    ok, bad = analysis.ingest_jsonl(spark, str(p))
    assert [r.file.path for r in ok.collect()] == ["a.clj"] and bad.count() == 2


def export():
    msg = lambda i, role, t: {"id": i, "author": {"role": role}, "create_time": 1.0, "content": {"content_type": "text", "parts": [t]}}
    m = {"root": {"id": "root", "message": None, "parent": None, "children": ["u1"]}}
    for i, role, parent in (("u1", "user", "root"), ("a1", "assistant", "u1"), ("a2", "assistant", "u1"), ("u2", "user", "a2")):
        m[i] = {"id": i, "message": msg(i, role, f"text {i}"), "parent": parent, "children": []}
    return [{"id": "c", "title": "t", "update_time": 1.0, "current_node": "u2", "mapping": m}, {"id": "c", "title": "old", "update_time": 0.5, "current_node": "u1", "mapping": {}}]


def test_export(spark, tmp_path):
    z = tmp_path / "e.zip"
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("top/conversations.json", json.dumps(export()))
    files = exports.stage(str(z), str(tmp_path / "out"))
    msgs, edges, path = exports.normalise(exports.read(spark, files))
    assert msgs.count() == 4 and edges.count() == 3
    assert [r.node for r in path.orderBy("position").collect()] == ["u1", "a2", "u2"]
    assert exports.fingerprint(files, str(tmp_path / "out")) == exports.fingerprint(files, str(tmp_path / "out"))
    bad = tmp_path / "bad.zip"
    with zipfile.ZipFile(bad, "w") as f:
        f.writestr("../evil.json", "{}")
    with pytest.raises(ValueError):
        exports.stage(str(bad), str(tmp_path / "out2"))


def test_incremental_equals_full(spark, tmp_path):
    src, ix = str(tmp_path / "src"), incremental.Index(spark, str(tmp_path / "ix"))
    schema = "k long, v string"
    a = spark.createDataFrame([(1, "a"), (2, "b")], schema)
    b = spark.createDataFrame([(2, "b"), (3, "c")], schema)
    a.write.parquet(src)
    ix.update(src, schema, ["k"])
    first = len(ix.done())
    b.write.mode("append").parquet(src)
    ix.update(src, schema, ["k"])
    ix.update(src, schema, ["k"])
    assert sorted(map(tuple, ix.rows().collect())) == [(1, "a"), (2, "b"), (3, "c")] and first >= 1
    # a batch without its manifest entry doesn't count
    a.write.parquet(f"{ix.root}/batches/999")
    assert ix.rows().count() == 3


def test_upsert(spark):
    s = "k long, seq long, first string, last string"
    old, new = spark.createDataFrame([(1, 1, "x", "a")], s), spark.createDataFrame([(1, 2, "y", "b"), (2, 3, "z", "c")], s)
    assert sorted((r.k, r.first, r.last) for r in incremental.upsert(old, new, ["k"], "seq", ["first"]).collect()) == [(1, "x", "b"), (2, "z", "c")]
