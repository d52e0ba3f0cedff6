"""Roles in transcripts by a hidden Markov model, and canonical rendering.

A transcript is lines of text. The states are a role's first line and its further lines. A line's features are its speaker
marker ('User:', '### Assistant', '[Human]', another name, none), whether it follows a blank line or the start, and the
bucket of its length. Start, transition and feature counts come from transcripts whose lines have known roles, all of them,
added to the counts of PRIOR (a marker names its own role; further lines have none). Viterbi finds the likeliest states;
each first line opens a turn. A turn is rendered as <|role|>, its text without the marker, <|end|>.

Defined results: null and empty transcripts have no turn and render as ''. Turns with null or blank text are not part of
a transcript. Lines of unknown or null role are not counted. Ties go to the first state in order. Repeated rows (same
conv_id and turn) are turns of their own, in order of role and text. Turns with a null conv_id are conversations
of one turn each; conv_id is of an integer type. Extra columns are not in the result.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import integral

ROLES = ("system", "user", "assistant", "tool")
STATES = [(r, k) for r in ROLES for k in "BI"]
NAMES = {"system": "system", "instruction": "system", "instructions": "system", "user": "user", "human": "user", "q": "user", "question": "user", "prompt": "user", "customer": "user", "assistant": "assistant", "ai": "assistant", "bot": "assistant", "model": "assistant", "a": "assistant", "answer": "assistant", "agent": "assistant", "gpt": "assistant", "tool": "tool", "function": "tool", "observation": "tool"}
MARK = re.compile(r"^\s*(?:#{1,4}\s*|\*\*|\[|<\|?)?\s*([^\W\d_]{1,14})\s*(?:\*\*:?|\]:?|\|?>:?|:)(?:\*\*)?[ \t]*|^\s*#{2,4}\s*([^\W\d_]{1,14})\s*$")
MARKS = [*ROLES, "other", "none"]
LENGTHS = [1, 30, 60, 100, 150, 220, 320, 480, 720]


def marker(line: str) -> tuple[str, int]:
    """Class of the line's speaker marker, and where the text after it starts."""
    m = MARK.match(line)
    if not m:
        return "none", 0
    name = (m.group(1) or m.group(2)).lower()
    if name in NAMES:
        return NAMES[name], m.end()
    return ("other", 0)


def features(text: str) -> tuple[list[str], np.ndarray]:
    """Lines that aren't blank, and for each its features (marker, after a blank line, length bucket, first of all)."""
    lines, rows, gap = [], [], True
    for line in text.split("\n"):
        if not line.strip():
            gap = True
            continue
        kind, at = marker(line)
        rows.append((MARKS.index(kind), int(gap), int(np.searchsorted(LENGTHS, len(line) - at, "right"))))
        lines.append(line)
        gap = False
    return lines, np.array(rows, np.int64).reshape(-1, 3)


SIZES = (len(MARKS), 2, len(LENGTHS) + 1)


def prior() -> dict[str, np.ndarray]:
    n = len(STATES)
    start, step = np.full(n, 0.01), np.full((n, n), 0.01)
    emit = [np.full((n, s), 0.5) for s in SIZES]
    for i, (r, k) in enumerate(STATES):
        start[i] += k == "B"
        for j, (r2, k2) in enumerate(STATES):
            if k2 == "I":
                step[i, j] = 1.0 if r2 == r else 0.0
            else:
                step[i, j] = 0.02 if r2 == r else 0.3
        marks = emit[0][i]
        marks[:] = 0.01
        marks[MARKS.index("none")] = 40.0 if k == "I" else 10.0
        if k == "B":
            marks[MARKS.index(r)] = 30.0
        marks[MARKS.index("other")] = 0.2
        emit[1][i] = (40.0, 0.4) if k == "I" else (2.0, 20.0)
    return {"start": start, "step": step, "m": emit[0], "g": emit[1], "l": emit[2]}


def logs(counts: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    with np.errstate(divide="ignore"):
        return {k: np.log(v / v.sum(axis=-1, keepdims=True)) for k, v in counts.items()}


def viterbi(f: np.ndarray, p: dict[str, np.ndarray]) -> list[int]:
    """Likeliest states of the lines."""
    if not len(f):
        return []
    e = p["m"][:, f[:, 0]] + p["g"][:, f[:, 1]] + p["l"][:, f[:, 2]]
    score, back = p["start"] + e[:, 0], []
    for i in range(1, len(f)):
        t = score[:, None] + p["step"]
        b = t.argmax(axis=0)
        back.append(b)
        score = t[b, np.arange(len(b))] + e[:, i]
    s = [int(score.argmax())]
    for b in reversed(back):
        s.append(int(b[s[-1]]))
    return s[::-1]


def parse(text: str | None, p: dict[str, np.ndarray]) -> list[tuple[str, str]]:
    """Turns (role, text) of a transcript."""
    lines, f = features(text or "")
    turns: list[tuple[str, list[str]]] = []
    for line, s in zip(lines, viterbi(f, p), strict=True):
        role, k = STATES[s]
        if k == "B" or not turns:
            kind, at = marker(line)
            rest = line[at:] if kind in ROLES else line
            turns.append((role, [rest] if rest.strip() else []))
        else:
            turns[-1][1].append(line)
    return [(r, "\n".join(x)) for r, x in turns]


def render(turns: list[tuple[str, str]]) -> str:
    return "".join(f"<|{r}|>\n{t}\n<|end|>\n" for r, t in turns)


STYLES = [{}, {"system": "System: ", "user": "User: ", "assistant": "Assistant: ", "tool": "Tool: "}, {"system": "[System] ", "user": "[Human] ", "assistant": "[AI] ", "tool": "[Tool] "}, {"system": "### System\n", "user": "### User\n", "assistant": "### Assistant\n", "tool": "### Tool\n"}]


def transcripts(conversations: DataFrame) -> DataFrame:
    """(conv_id, style, text, roles): each conversation as one raw text. By its hash it has no marker, or those of one of STYLES; roles: of each line that isn't blank."""
    integral(conversations, "conv_id")
    c = conversations.select("conv_id", F.struct("turn", "role", "text").alias("t")).where(F.length(F.trim("t.text")) > 0)
    alone = c.where("conv_id is null").select("conv_id", F.array("t").alias("t"))
    c = c.where("conv_id is not null").groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t")).unionByName(alone)
    c = c.withColumn("style", F.pmod(F.xxhash64("conv_id"), F.lit(len(STYLES))).cast("int"))

    def build(batches):
        for p in batches:
            text, roles = [], []
            for style, turns in zip(p["style"], p["t"], strict=True):
                parts, rr = [], []
                for x in turns:
                    part = STYLES[style].get(x["role"], "") + x["text"]
                    parts.append(part)
                    rr += [x["role"]] + [f"{x['role']}+"] * (sum(1 for y in part.split("\n") if y.strip()) - 1)
                text.append("\n\n".join(parts))
                roles.append(rr)
            yield pd.DataFrame({"conv_id": p["conv_id"].astype("Int64"), "style": p["style"], "text": text, "roles": roles})

    return c.mapInPandas(build, "conv_id long, style int, text string, roles array<string>")


def fit(labelled: DataFrame) -> dict[str, np.ndarray]:
    """Log-probabilities from the transcripts' counts and the prior."""

    def count(batches):
        total = {k: np.zeros_like(v) for k, v in prior().items()}
        index = {(r if k == "B" else f"{r}+"): i for i, (r, k) in enumerate(STATES)}
        for p in batches:
            for text, roles in zip(p["text"], p["roles"], strict=True):
                _, f = features(text)
                s = [index.get(x, -1) for x in roles]
                if len(s) != len(f):
                    continue
                for i, x in enumerate(s):
                    if x < 0:
                        continue
                    for k, v in zip("mgl", f[i], strict=True):
                        total[k][x, v] += 1
                    if i == 0:
                        total["start"][x] += 1
                    elif s[i - 1] >= 0:
                        total["step"][s[i - 1], x] += 1
        yield pd.DataFrame([(k, i, float(x)) for k, v in total.items() for i, x in enumerate(v.ravel()) if x], columns=["k", "i", "n"])

    rows = labelled.select("text", "roles").mapInPandas(count, "k string, i int, n double").groupBy("k", "i").agg(F.sum("n").alias("n")).collect()  # bounded by the model's size
    p = prior()
    for r in rows:
        p[r.k].ravel()[r.i] += r.n
    return logs(p)


def format_chats(raw: DataFrame, p: dict[str, np.ndarray]) -> DataFrame:
    """conv_id, n_turns, roles, rendered: a row for each row of raw (conv_id, text)."""

    def run(batches):
        for x in batches:
            turns = [parse(t, p) for t in x["text"]]
            yield pd.DataFrame({"conv_id": x["conv_id"].astype("Int64"), "n_turns": [len(t) for t in turns], "roles": [[r for r, _ in t] for t in turns], "rendered": [render(t) for t in turns]})

    return raw.select(F.col("conv_id").cast("long").alias("conv_id"), "text").mapInPandas(run, "conv_id long, n_turns int, roles array<string>, rendered string")
