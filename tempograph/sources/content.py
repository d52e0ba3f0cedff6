"""Message contents of an export as typed blocks: text, code, images, audio, and what is left as it came."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import functions as F, types as T
from pyspark.sql.functions import arrow_udf

FIELDS = ["type", "text", "language", "asset_pointer", "width", "height", "provider_type", "data"]
_PA = pa.list_(pa.struct([(f, pa.int64() if f in ("width", "height") else pa.string()) for f in FIELDS]))
_T = T.ArrayType(T.StructType([T.StructField(f, T.LongType() if f in ("width", "height") else T.StringType()) for f in FIELDS]))


def _dump(x) -> str:
    return json.dumps(x, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def _pixels(x) -> int | None:
    return int(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else None


def block(part, kind: str) -> dict:
    """One block of a part, whose own type goes before that of the content it is in."""
    out = dict.fromkeys(FIELDS)
    if isinstance(part, str):
        out |= {"type": "code" if kind == "code" else "text", "text": part, "provider_type": None if kind in ("text", "unknown") else kind}
    elif part is None:
        out |= {"type": "provider", "provider_type": kind, "data": "null"}
    elif isinstance(part, (bool, int, float)):
        out |= {"type": "text", "text": _dump(part)}
    elif isinstance(part, list):
        out |= {"type": "provider", "provider_type": kind, "data": _dump(part)}
    else:
        own = str(next((part[k] for k in ("content_type", "type") if part.get(k) is not None), kind))
        text = next((part[k] for k in ("text", "content", "result") if part.get(k) is not None), None)
        out["provider_type"] = own
        if own == "image_asset_pointer" or part.get("asset_pointer") and "audio" not in own or part.get("image_url"):
            at = part.get("asset_pointer") or part.get("image_url")
            out |= {"type": "image", "asset_pointer": at if isinstance(at, str) else _dump(at), "width": _pixels(part.get("width")), "height": _pixels(part.get("height"))}
        elif "audio" in own:
            at = part.get("asset_pointer") or part.get("audio_url")
            out |= {"type": "audio", "asset_pointer": at if at is None or isinstance(at, str) else _dump(at), "data": _dump(part)}
        elif "code" in own or part.get("language"):
            out |= {"type": "code", "language": part.get("language"), "text": _dump(part) if text is None else text if isinstance(text, str) else _dump(text)}
        elif text is not None and not isinstance(text, (dict, list)):
            out |= {"type": "text", "text": text if isinstance(text, str) else _dump(text)}
        else:
            out |= {"type": "provider", "data": _dump(part)}
    return out


def blocks_of(content) -> list[dict]:
    """Blocks of a content: null has none, a text is one, a list is its parts, an object its parts, text or result, else itself."""
    if content is None:
        return []
    if isinstance(content, str):
        return [block(content, "text")]
    if isinstance(content, list):
        return [block(p, "unknown") for p in content]
    if not isinstance(content, dict):
        return [block(content, "unknown")]
    kind = str(content.get("content_type") or content.get("type") or "unknown")
    parts = content["parts"] if isinstance(content.get("parts"), list) else [content[k] for k in ("text", "result") if k in content][:1]
    return [block(p, kind) for p in parts] or [block(content, kind)]


@arrow_udf(_T)
def blocks(content: pa.Array) -> pa.Array:
    """Blocks of contents given as JSON; null is null, and what is no JSON is a text of its own."""
    out = []
    for c in content.to_pylist():
        if c is None:
            out.append(None)
            continue
        try:
            x = json.loads(c)
        except ValueError:
            x = c
        out.append(blocks_of(x))
    return pa.array(out, _PA)


def plain_text(b):
    """Text of an array of blocks: what text and code blocks hold, a line between them."""
    return F.array_join(F.filter(F.transform(b, lambda x: x["text"]), lambda s: s.isNotNull()), "\n")
