"""Content-derived identities."""

from __future__ import annotations

import base64
import hashlib
import json
import math

import pyarrow as pa
from pyspark.sql import Column, functions as F, types as T
from pyspark.sql.functions import arrow_udf


def sha256_text(c: Column) -> Column:
    return F.sha2(c, 256)


def logical_id(repo: Column, kind: Column, name: Column) -> Column:
    """sha256 of the JSON list [repo, kind, name]."""
    return F.sha2(F.to_json(F.array(repo, kind, name)), 256)


def revision_id(logical: Column, structural_hash: Column) -> Column:
    return F.sha2(F.to_json(F.array(logical, structural_hash)), 256)


def source_key(provider: Column, identity: Column) -> Column:
    return F.concat(provider, F.lit("-"), F.substring(F.sha2(F.concat(provider, F.lit("\0"), identity), 256), 1, 24))


def shard_path(digest: Column) -> Column:
    return F.concat_ws("/", F.substring(digest, 1, 2), F.substring(digest, 3, 2), digest)


def canonical(value) -> str:
    """JSON with sorted keys; numbers that aren't finite are null, bytes an object with base64."""

    def clean(x):
        if isinstance(x, dict):
            return {str(k): clean(v) for k, v in sorted(x.items())}
        if isinstance(x, (list, tuple)):
            return [clean(v) for v in x]
        if isinstance(x, bytes):
            return {"base64": base64.b64encode(x).decode()}
        if isinstance(x, float):
            return None if not math.isfinite(x) else int(x) if x.is_integer() and abs(x) < 2**53 else x
        return x

    return json.dumps(clean(value), separators=(",", ":"), ensure_ascii=False)


@arrow_udf(T.StringType())
def canonical_id(text: pa.Array) -> pa.Array:
    """sha256 of the canonical form of a JSON text; of the text itself where it isn't JSON."""

    def one(t: str | None) -> str | None:
        if t is None:
            return None
        try:
            t = canonical(json.loads(t))
        except ValueError:
            pass
        return hashlib.sha256(t.encode()).hexdigest()

    return pa.array([one(t) for t in text.to_pylist()], pa.string())
