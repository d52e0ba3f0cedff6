from pyspark.sql import functions as F

from tempograph.operators import recovery, render
from tempograph.plans import history
from tempograph.queries import QUERIES
from tempograph.sources import observations


def test_states_and_gaps(spark):
    refs = spark.createDataFrame([("a", "h1"), ("b", "h2"), ("c", "h3"), ("d", "h4")], "ref string, head string")
    cp = spark.createDataFrame([("a", "h1"), ("b", "h0"), ("c", "gone")], "ref string, oid string")
    commits = spark.createDataFrame([("h0",), ("h1",), ("h2",), ("h3",), ("h4",)], "oid string")
    jobs = spark.createDataFrame([("a", "failed"), ("a", "completed")], "ref string, status string")
    got = {r.ref: (r.state, r.failed) for r in recovery.inspect(refs, cp, commits, jobs).collect()}
    assert got == {"a": ("current", 1), "b": ("behind", 0), "c": ("rewritten", 0), "d": ("missing", 0)}
    ch = spark.createDataFrame([("x", "p", "100644"), ("y", "q", "100644"), ("0000", "r", "100644"), ("z", "s", "160000"), (None, "t", "100644")], "new_blob string, new_path string, new_mode string")
    an = spark.createDataFrame([("x", "v1"), ("y", "v0")], "blob_oid string, fingerprint string")
    assert [r.new_blob for r in recovery.gaps(ch, an, "v1").collect()] == ["y"]


def test_skips(spark):
    p = spark.createDataFrame([("generated/a.py", 1), ("x/vendor/a.py", 1), ("a.unknown", 1), ("a.py", 11 << 20), ("a.py", 1)], "path string, size long")
    got = [r.r for r in p.select(history.skip_reason(F.col("path"), F.col("size")).alias("r")).collect()]
    assert got == ["generated", "vendored", "unsupported-language", "oversized", None]


def test_observation_rules(spark):
    n = "conversation string, node string, parent string, text string, keys array<string>"
    c = "conversation string, current_node string, path array<string>"
    ok = [("ok", "r", None, "x", []), ("ok", "m", "r", "x", ["title"])]
    bad = [("cyc", "a", "b", "x", []), ("cyc", "b", "a", "x", []), ("par", "a", "zz", "x", []), ("key", "a", None, "x", ["access_token"]), ("path", "a", None, "x", []), ("path", "b", None, "x", [])]
    nodes = spark.createDataFrame(ok + bad, n)
    conv = spark.createDataFrame([("ok", "m", ["r", "m"]), ("path", "b", ["a", "b"]), ("key", "nope", ["a"])], c)
    got = {(r.conversation, r.rule) for r in observations.violations(nodes, conv).collect()}
    assert got == {("cyc", "cycle"), ("par", "unknown-parent"), ("key", "credential-key"), ("key", "unknown-current-node"), ("path", "broken-active-path")}


def test_blocks(spark):
    b = spark.createDataFrame([([("code", "a ``` b", "py", None), ("text", "t", None, None), ("link", None, None, "u")],)], "b array<struct<type: string, text: string, language: string, url: string>>")
    assert b.select(render.blocks(F.col("b")).alias("m")).first().m == "````py\na ``` b\n````\n\nt\n\n[u](u)"


def test_gaps_take_the_key_zero(spark, tmp_path):
    spark.createDataFrame([(0, "R"), (0, "R"), (1, "R"), (2, "N"), (10, "R")], "l_partkey long, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(0, 40), (1, 3), (2, 40), (10, 40)], "p_partkey long, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    assert sorted(r.new_blob for r in QUERIES["repair_gaps"](spark, str(tmp_path)).collect()) == [0, 10]
