"""Analyzers as table functions, and the ingestion of their results from JSON lines."""

from __future__ import annotations

import ast
import hashlib
import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

RANGE = "struct<start_byte: long, end_byte: long, start: struct<line: int, column: int>, end: struct<line: int, column: int>>"
SYMBOL = f"struct<local_id: string, kind: string, name: string, qualified_name: string, signature: string, documentation: string, structural_hash: string, features: struct<shape_hash: string, features: array<string>, node_count: int, depth: int, arity: int>, range: {RANGE}>"
REFERENCE = f"struct<owner: string, kind: string, target_text: string, target_qualified_name: string, resolution: string, confidence: double, range: {RANGE}>"
RESULT = f"file struct<path: string, language: string, blob_oid: string>, symbols array<{SYMBOL}>, references array<{REFERENCE}>, diagnostics array<struct<severity: string, message: string, line: int>>"


def ingest_jsonl(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Results and rejected lines of an analyzer's JSON lines; unknown fields are let through, bad lines kept apart."""
    raw = spark.read.schema(f"{RESULT}, _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").option("mode", "PERMISSIVE").json(path)
    bad = F.col("_corrupt").isNotNull() | F.col("file.path").isNull()
    return raw.where(~bad).drop("_corrupt"), raw.where(bad).select("_corrupt")


def explode(results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Symbols and references; a reference's owner is resolved by its local id."""
    symbols = results.select("file.path", "file.blob_oid", F.inline("symbols"))
    refs = results.select("file.path", "file.blob_oid", F.inline("references"))
    owner = symbols.select("path", "blob_oid", F.col("local_id").alias("owner"), F.col("qualified_name").alias("owner_name"))
    return symbols, refs.join(owner, ["path", "blob_oid", "owner"], "left")


class _Source:
    """Byte offsets and 1-based line and column of positions in a source text."""

    def __init__(self, text: str):
        self.starts = [0]
        for line in text.encode().splitlines(keepends=True):
            self.starts.append(self.starts[-1] + len(line))

    def range(self, node: ast.AST) -> dict:
        a, b = (node.lineno, node.col_offset), (node.end_lineno, node.end_col_offset)
        return {"start_byte": self.starts[a[0] - 1] + a[1], "end_byte": self.starts[b[0] - 1] + b[1], "start": {"line": a[0], "column": a[1] + 1}, "end": {"line": b[0], "column": b[1] + 1}}


def shape(node: ast.AST) -> dict:
    """Structure without names and literals: hash, node kinds, count, depth, largest call arity."""
    kinds: set[str] = set()
    count = arity = deepest = 0

    def walk(n: ast.AST, depth: int) -> list:
        nonlocal count, arity, deepest
        count, deepest = count + 1, max(deepest, depth)
        kinds.add(type(n).__name__)
        if isinstance(n, ast.Call):
            arity = max(arity, len(n.args) + len(n.keywords))
        return [type(n).__name__, [walk(c, depth + 1) for c in ast.iter_child_nodes(n) if not isinstance(c, ast.expr_context)]]

    tree = walk(node, 1)
    return {"shape_hash": hashlib.sha256(json.dumps(tree).encode()).hexdigest(), "features": sorted(kinds), "node_count": count, "depth": deepest, "arity": arity}


def _name(n: ast.AST) -> str | None:
    if isinstance(n, ast.Name):
        return n.id
    if isinstance(n, ast.Attribute):
        base = _name(n.value)
        return f"{base}.{n.attr}" if base else n.attr
    return None


def python_analyzer(path: str, source: str) -> dict:
    """Symbols and references of a Python source; a syntax error gives one diagnostic and no facts."""
    module = path.rsplit(".", 1)[0].removesuffix("/__init__").replace("/", ".")
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError) as e:
        return {"symbols": [], "references": [], "diagnostics": [{"severity": "error", "message": getattr(e, "msg", str(e)), "line": getattr(e, "lineno", None)}]}
    src, symbols, refs, seen = _Source(source), [], [], set()

    def symbol(node: ast.AST, kind: str, name: str, signature: str | None = None, doc: str | None = None) -> str:
        f = shape(node)
        i = f"s{len(symbols)}"
        symbols.append({"local_id": i, "kind": kind, "name": name, "qualified_name": f"{module}.{name}", "signature": signature, "documentation": doc, "structural_hash": f["shape_hash"], "features": f, "range": src.range(node)})
        return i

    def reference(node: ast.AST, owner: str | None, kind: str, target: str | None) -> None:
        if not target:
            return
        r = src.range(node)
        key = (kind, r["start_byte"], r["end_byte"], target)
        if key not in seen:
            seen.add(key)
            refs.append({"owner": owner, "kind": kind, "target_text": target, "range": r})

    def targets(t: ast.AST) -> Iterator[ast.Name]:
        yield from (n for n in ast.walk(t) if isinstance(n, ast.Name))

    def visit(node: ast.AST, owner: str | None, in_class: bool) -> None:
        for c in ast.iter_child_nodes(node):
            mine, inside = owner, False
            if isinstance(c, (ast.FunctionDef, ast.AsyncFunctionDef)):
                kind = "test" if c.name.startswith("test_") else "method" if in_class else "function"
                mine = symbol(c, kind, c.name, f"({ast.unparse(c.args)})", ast.get_docstring(c))
                for a in [*c.args.posonlyargs, *c.args.args, *c.args.kwonlyargs, *filter(None, (c.args.vararg, c.args.kwarg))]:
                    symbol(a, "parameter", a.arg)
                    if a.annotation:
                        reference(a.annotation, mine, "type", _name(a.annotation))
                for d in c.decorator_list:
                    reference(d, mine, "decorator", _name(d.func if isinstance(d, ast.Call) else d))
            elif isinstance(c, ast.ClassDef):
                mine, inside = symbol(c, "class", c.name, None, ast.get_docstring(c)), True
                for b in c.bases:
                    reference(b, mine, "inheritance", _name(b))
            elif isinstance(c, (ast.Assign, ast.AnnAssign, ast.For, ast.AsyncFor)):
                for t in c.targets if isinstance(c, ast.Assign) else [c.target]:
                    for n in targets(t):
                        symbol(n, "constant" if n.id.isupper() else "field" if in_class else "variable", n.id)
                        reference(n, owner, "write", n.id)
            elif isinstance(c, ast.withitem) and c.optional_vars is not None:
                for n in targets(c.optional_vars):
                    symbol(n, "variable", n.id)
            elif isinstance(c, (ast.Import, ast.ImportFrom)):
                for a in c.names:
                    reference(c, owner, "import", f"{c.module}.{a.name}" if isinstance(c, ast.ImportFrom) and c.module else a.name)
            elif isinstance(c, ast.Call):
                reference(c, owner, "call", _name(c.func))
            elif isinstance(c, ast.Name) and isinstance(c.ctx, ast.Load):
                reference(c, owner, "read", c.id)
            visit(c, mine, inside)

    visit(tree, None, False)
    local = {s["name"]: s["qualified_name"] for s in symbols}
    for r in refs:
        t = r["target_text"]
        hit = local.get(t)
        r["target_qualified_name"] = hit or (t if "." in t or r["kind"] == "import" else None)
        r["resolution"] = "resolved" if hit else "candidate" if r["target_qualified_name"] else "unresolved"
        r["confidence"] = 1.0 if hit else 0.8 if r["kind"] == "import" else 0.7 if r["target_qualified_name"] else 0.4
    return {"symbols": symbols, "references": refs, "diagnostics": []}


ANALYZERS: dict[str, Callable[[str, str], dict]] = {"python": python_analyzer}


def analyze(blobs: DataFrame, fingerprint: str = "python-ast-1") -> DataFrame:
    """Results for (blob_oid, path, language, source): each distinct blob of a language is analyzed once, its paths are joined back."""

    def run(batches):
        for p in batches:
            rows = []
            for r in p.itertuples(index=False):
                x = ANALYZERS[r.language](r.path, r.source or "")
                rows.append({"blob_oid": r.blob_oid, "language": r.language, "result": json.dumps(x)})
            yield pd.DataFrame(rows, columns=["blob_oid", "language", "result"])

    one = blobs.where(F.col("language").isin(list(ANALYZERS))).groupBy("blob_oid", "language").agg(F.min("path").alias("path"), F.first("source").alias("source"))
    done = one.select("blob_oid", "language", "path", "source").mapInPandas(run, "blob_oid string, language string, result string")
    body = ", ".join(x for x in [f"symbols: array<{SYMBOL}>", f"references: array<{REFERENCE}>", "diagnostics: array<struct<severity: string, message: string, line: int>>"])
    done = done.withColumn("r", F.from_json("result", f"struct<{body}>"))
    x = blobs.select("blob_oid", "language", "path").distinct().join(done, ["blob_oid", "language"])
    return x.select(F.struct("path", "language", "blob_oid").alias("file"), "r.symbols", "r.references", "r.diagnostics", F.lit(fingerprint).alias("fingerprint"))


def usage_resolution(target, alias):
    """Resolution of a use by what the linter knows of it: resolved with a known target namespace, candidate with an alias only, else unresolved."""
    known = target.isNotNull() & (target != UNKNOWN)
    return F.when(known, "resolved").when(alias.isNotNull(), "candidate").otherwise("unresolved")


UNKNOWN = "unknown-namespace"


def dedupe_symbols(symbols: list[dict]) -> list[dict]:
    """Symbols of one file, each once: those with the same kind and qualified name, or with the same range, are one. The first stays in its place, but a variable gives way to what isn't one."""
    out: list[dict] = []
    by_name: dict[tuple, int] = {}
    by_range: dict[tuple, int] = {}
    for s in symbols:
        r = s.get("range") or {}
        name, at = (s.get("kind"), s.get("qualified_name")), (r.get("start_byte"), r.get("end_byte"))
        i = min((k for k in (by_name.get(name), by_range.get(at) if at != (None, None) else None) if k is not None), default=None)
        if i is None:
            i = len(out)
            out.append(s)
        elif out[i].get("kind") == "variable" and s.get("kind") != "variable":
            out[i] = s
        else:
            continue
        by_name.setdefault(name, i)
        by_range.setdefault(at, i)
    return out


def ingest_tree(spark: SparkSession, root: str, pattern: str = "*.py") -> tuple[DataFrame, DataFrame]:
    """Results of analyzing the files of a folder and all below it, and counts of files, symbols, references and diagnostics. Paths are relative to the folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(root)
    base = F.regexp_replace("path", "^[a-z0-9]+:/*", "/")
    prefix = "/" + root.split("://")[-1].strip("/") + "/"
    x = files.select(F.sha2("content", 256).alias("blob_oid"), F.expr(f"substring(regexp_replace(path, '^[a-z0-9]+:/*', '/'), {len(prefix) + 1})").alias("path"), F.lit("python").alias("language"), F.decode("content", "UTF-8").alias("source")).where(base.startswith(prefix))
    results = analyze(x)
    counts = results.agg(F.count("*").alias("files"), F.sum(F.size("symbols")).alias("symbols"), F.sum(F.size("references")).alias("references"), F.sum(F.size("diagnostics")).alias("diagnostics"))
    return results, counts
