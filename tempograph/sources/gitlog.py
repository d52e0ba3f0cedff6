"""Git history as Spark data sources: commits in topological order, path changes, blobs. Reading only.

``spark.dataSource.register(GitSource)``, then ``spark.read.format("githistory").option("path", repo).option("kind", "commits").load()``.
Commits are listed once by one process; changes and blobs are read by a process for each partition.
"""

from __future__ import annotations

import json
import subprocess

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMAS = {
    "commits": "seq long, oid string, parents array<string>, author string, author_email string, authored_at string, committer string, committed_at string, message string",
    "changes": "seq long, oid string, parent string, status string, old_mode string, new_mode string, old_blob string, new_blob string, old_path string, new_path string",
    "blobs": "oid string, size long, content binary",
    "refs": "ref string, oid string",
    "paths": "seq long, oid string, parent string, path string",
    "objects": "oid string, type string, size long, state string, content binary",
}
BATCH, BATCH_BYTES = 256, 64 << 20
#: What a ref's name can't hold, and the largest JSON object that is read.
BAD_REF, MAX_OBJECT = "\0\n\r\t ", 16 << 20


def git(path: str, *args: str, data: bytes | None = None) -> bytes:
    return subprocess.run(["git", "-C", path, *args], input=data, check=True, capture_output=True).stdout


def object_format(path: str) -> str:
    """sha1 or sha256."""
    return git(path, "rev-parse", "--show-object-format").decode().strip()


class Part(InputPartition):
    def __init__(self, rows: list):
        self.rows = rows


class GitSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "githistory"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("kind", "commits")]

    def reader(self, schema) -> GitReader:
        return GitReader(self.options)


class GitReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.kind = options["path"], options.get("kind", "commits")
        self.refs = [r for r in options.get("refs", "HEAD").split(",") if r]
        self.parts = int(options.get("partitions", "8"))
        self.oids = [x for x in options.get("oids", "").split(",") if x]
        self.options_prefix = options.get("prefix", "refs/")
        if not self.options_prefix.startswith("refs/") or any(c in self.options_prefix for c in BAD_REF):
            raise ValueError(f"no prefix of refs: {self.options_prefix!r}")

    def partitions(self) -> list[Part]:
        if git(self.path, "rev-parse", "--is-shallow-repository").strip() == b"true":
            raise ValueError("a shallow clone lacks history")
        if self.kind == "refs":
            return [Part([self.options_prefix])]
        if self.kind == "objects":
            rows = self.oids
        elif self.kind == "blobs":
            rows = self.oids or sorted({x.split()[0].decode() for x in git(self.path, "rev-list", "--objects", *self.refs).splitlines() if x})
        else:
            lines = git(self.path, "rev-list", "--topo-order", "--reverse", "--parents", *self.refs).decode().splitlines()
            rows = [(i, *line.split()) for i, line in enumerate(lines)]
        n = max(1, min(self.parts, len(rows)))
        return [Part(rows[i * len(rows) // n : (i + 1) * len(rows) // n]) for i in range(n)]

    def read(self, part: Part):
        if part.rows:
            yield from getattr(self, "_" + self.kind)(part.rows)

    def _commits(self, rows):
        fmt = "%x1e%H%x00%an%x00%ae%x00%aI%x00%cn%x00%cI%x00%B"
        out = git(self.path, "log", "--no-walk=unsorted", "--stdin", f"--format={fmt}", data="\n".join(r[1] for r in rows).encode())
        meta = {}
        for rec in out.decode("utf-8", "replace").split("\x1e")[1:]:
            oid, *f = rec.split("\0")
            meta[oid] = (f[0], f[1], f[2], f[3], f[4], f[5].rstrip("\n"))
        for seq, oid, *parents in rows:
            yield (seq, oid, parents, *meta[oid])

    def _changes(self, rows):
        for seq, oid, *parents in rows:
            for parent in parents or [None]:
                args = ["diff-tree", "-r", "-z", "-M", "-C", "--raw", "--no-abbrev", "--no-commit-id"]
                out = git(self.path, *args, parent, oid) if parent else git(self.path, *args, "--root", oid)
                f = out.decode("utf-8", "surrogateescape").split("\0")
                i = 0
                while i < len(f) and f[i].startswith(":"):
                    om, nm, ob, nb, st = f[i][1:].split(" ")
                    two = st[0] in "RC"
                    yield (seq, oid, parent, st[0], om, nm, ob, nb, f[i + 1], f[i + 2] if two else f[i + 1])
                    i += 3 if two else 2

    def _refs(self, rows):
        """Refs under a prefix and the objects that they name, in order of name."""
        for prefix in rows:
            for line in sorted(git(self.path, "for-each-ref", "--format=%(refname)%09%(objectname)", prefix).decode().splitlines()):
                yield tuple(line.split("\t", 1))

    def _paths(self, rows):
        """Paths that each commit changes against each of its parents, once and in order."""
        for seq, oid, *parents in rows:
            for parent in parents or [None]:
                out = git(self.path, "diff-tree", "--no-commit-id", "--name-only", "-r", "-z", *([parent, oid] if parent else ["--root", oid]), "--")
                for p in sorted({x for x in out.decode("utf-8", "surrogateescape").split("\0") if x}):
                    yield (seq, oid, parent, p)

    def _objects(self, rows):
        """A row for each object asked for, with its state: json, other (a blob that is no JSON), not-a-blob, too-large or missing; content only for json."""
        lines = git(self.path, "cat-file", "--batch-check", data="\n".join(rows).encode()).decode().splitlines()
        want = []
        for oid, line in zip(rows, lines, strict=True):
            f = line.split()
            if len(f) != 3:
                yield (oid, None, None, "missing", None)
            elif f[1] != "blob":
                yield (oid, f[1], int(f[2]), "not-a-blob", None)
            elif int(f[2]) > MAX_OBJECT:
                yield (oid, f[1], int(f[2]), "too-large", None)
            else:
                want.append((f[0], int(f[2])))
        for oid, size, raw in self._batched(want):
            try:
                json.loads(raw)
                yield (oid, "blob", size, "json", raw)
            except ValueError:
                yield (oid, "blob", size, "other", None)

    def _batched(self, want):
        batch, held = [], 0
        for oid, size in want:
            if batch and (len(batch) >= BATCH or held + size > BATCH_BYTES):
                yield from self._read_batch(batch)
                batch, held = [], 0
            batch.append((oid, size))
            held += size
        yield from self._read_batch(batch)

    def _blobs(self, rows):
        sizes = git(self.path, "cat-file", "--batch-check", data="\n".join(rows).encode()).decode().split("\n")
        found = (line.split() for line in sizes)
        yield from self._batched([(f[0], int(f[2])) for f in found if len(f) == 3 and f[1] == "blob"])

    def _read_batch(self, batch):
        if not batch:
            return
        out, at = git(self.path, "cat-file", "--batch", data="\n".join(o for o, _ in batch).encode()), 0
        for oid, size in batch:
            at = out.index(b"\n", at) + 1
            yield (oid, size, out[at : at + size])
            at += size + 1
