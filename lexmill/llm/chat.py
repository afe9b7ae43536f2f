"""Chat formatting: transcripts of plain lines become canonical turns.

A hidden Markov model tells who speaks. Its states are the roles, each as first line of a turn or as a
further line. A line shows a speaker marker (the few words before a colon or after ``#`` signs at its
start), its length, its ending, and how it begins. Probabilities of states, transitions and features
are counted on transcripts whose roles are known, with one added to every count. Viterbi finds the
likeliest states of a transcript's lines; turns are then rendered with one tag for each role, without
the markers known for it. A tag inside a text is escaped, so a rendering reads back as the same turns.

Transcripts are parsed in pieces of ``PIECE`` turns by their numbers, so that a very long
conversation is many rows of work and not one.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from lexmill.llm.common import map_arrow

ROLES = ("system", "user", "assistant")
STATES = 2 * len(ROLES)
PIECE = 256
MARKERS = 256
SIZES = (MARKERS, 16, 6, 6)
MARKER = re.compile(r"[#*\s]{0,8}([^\W\d_]{1,20}(?: [^\W\d_]{1,20}){0,2})\s{0,2}:[*]{0,2}(?:\s|$)|#{2,4} ([^\W\d_]{1,20})\s*$")

# Ways in which logs mark who speaks, for system, user and assistant.
STYLES = (
    ("System: ", "User: ", "Assistant: "),
    ("SYSTEM: ", "Human: ", "AI: "),
    ("Instructions: ", "Q: ", "A: "),
    ("### System:\n", "### Instruction:\n", "### Response:\n"),
)

#: The words that mark each role in some style; any other word before a colon is the text's own.
SPEAKERS = tuple({MARKER.match(marks[r]).group(1).lower() for marks in STYLES} for r in range(len(ROLES)))


@dataclass(frozen=True)
class Model:
    """Logarithms of start, transition and feature probabilities."""

    start: np.ndarray
    step: np.ndarray
    features: tuple[np.ndarray, ...]


def line_features(line: str) -> tuple[int, int, int, int]:
    """Marker, length, ending and beginning of a line, each as a small number."""
    found = MARKER.match(line)
    marker = 0
    if found:
        marker = 1 + crc32((found.group(1) or found.group(2)).lower().encode("utf-8", "replace")) % (MARKERS - 1)
    bare = line.strip()
    last = 0 if not bare else {"?": 1, ":": 2, ".": 3, "!": 4}.get(bare[-1], 5)
    head = bare[:1]
    first = 0 if not bare else 1 if head in "-*•" else 2 if head.isdigit() else 3 if bare.startswith("```") else 4 if head.isupper() else 5
    return marker, min(len(bare).bit_length(), 15), last, first


def grid(lines: list[str]) -> np.ndarray:
    return np.array([line_features(x) for x in lines], dtype=np.int64).reshape(len(lines), len(SIZES))


def states_of(roles: list[str], counts: list[int]) -> np.ndarray:
    """States of the lines of turns with known roles: 2 r for the first line of role r, 2 r + 1 after."""
    out = []
    for role, n in zip(roles, counts):
        r = 2 * ROLES.index(role)
        out += [r] + [r + 1] * (n - 1)
    return np.array(out, dtype=np.int64)


def transcripts(conversations: DataFrame, style: Column | None = None) -> DataFrame:
    """(conv_id, piece, text, roles, counts): turns written out as lines, one row per piece.

    ``style`` numbers the way in which speakers are marked, null for no mark; by default conversations
    have different styles, and one turn in eight lacks its mark. ``roles`` and ``counts`` (lines of
    each turn) are what a parse should find. Equal rows count once; a role other than the known ones
    is taken for the user's; null texts are empty; rows without conv_id are left out, a null turn
    counts as 0. Turns with the same number stand in the order of role and text.
    """
    role = F.when(F.col("role").isin(*ROLES), F.col("role")).otherwise("user")
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("turn"),
        role.alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    ).filter("conv_id IS NOT NULL").distinct()
    if style is None:
        bare = F.pmod(F.xxhash64("conv_id", "turn"), F.lit(8)) == 0
        style = F.when(~bare, F.pmod(F.xxhash64("conv_id"), F.lit(len(STYLES))))
    mark = F.lit("")
    for number, marks in enumerate(STYLES):
        for known, text in zip(ROLES, marks):
            mark = F.when((F.col("style") == number) & (F.col("role") == known), text).otherwise(mark)
    rows = rows.withColumn("style", style).withColumn("text", F.concat(mark, F.col("text")))
    rows = rows.withColumn("piece", F.floor(F.col("turn") / PIECE))
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    rows = rows.groupBy("conv_id", "piece").agg(turns.alias("turns"))
    return rows.select(
        "conv_id",
        "piece",
        F.array_join(F.transform("turns", lambda t: t.text), "\n").alias("text"),
        F.transform("turns", lambda t: t.role).alias("roles"),
        F.transform("turns", lambda t: F.size(F.split(t.text, "\n", -1))).alias("counts"),
    )


def fit(known: DataFrame) -> Model:
    """The model of transcripts with roles. Runs a job that gives the driver a few thousand counts."""

    def count(batch):
        start, step = np.zeros(STATES), np.zeros((STATES, STATES))
        seen = [np.zeros((STATES, n)) for n in SIZES]
        for text, roles, counts in zip(*(batch.column(c).to_pylist() for c in ("text", "roles", "counts"))):
            lines = text.split("\n")
            states = states_of(roles, counts)
            start[states[0]] += 1
            np.add.at(step, (states[:-1], states[1:]), 1)
            values = grid(lines)
            for k in range(len(SIZES)):
                np.add.at(seen[k], (states, values[:, k]), 1)
        flat = np.concatenate([start, step.ravel(), *[x.ravel() for x in seen]])
        at = np.flatnonzero(flat)
        yield {"at": at, "n": flat[at].astype(np.int64)}

    total = np.zeros(STATES + STATES**2 + STATES * sum(SIZES))
    for at, n in map_arrow(known, count, "at long, n long", "text", "roles", "counts").groupBy("at").agg(F.sum("n")).collect():
        total[at] = n
    total += 1
    cuts = np.cumsum([STATES, STATES**2, *[STATES * n for n in SIZES]])[:-1]
    start, step, *seen = np.split(total, cuts)
    share = lambda x: np.log(x / x.sum(axis=-1, keepdims=True))
    step = step.reshape(STATES, STATES)
    return Model(share(start), share(step), tuple(share(x.reshape(STATES, -1)) for x in seen))


def viterbi(values: np.ndarray, model: Model) -> np.ndarray:
    """The likeliest states; of equally likely ones the smallest. A transcript starts with a turn's first line."""
    shown = sum(model.features[k][:, values[:, k]] for k in range(len(SIZES)))
    score = model.start + shown[:, 0]
    score[1::2] = -np.inf
    back = np.zeros((len(values), STATES), dtype=np.int64)
    # A further line follows a line of the same role only.
    step = model.step.copy()
    for s in range(STATES):
        if s % 2:
            step[[t for t in range(STATES) if t // 2 != s // 2], s] = -np.inf
    for i in range(1, len(values)):
        paths = score[:, None] + step
        back[i] = paths.argmax(axis=0)
        score = paths.max(axis=0) + shown[:, i]
    out = np.zeros(len(values), dtype=np.int64)
    out[-1] = score.argmax()
    for i in range(len(values) - 1, 0, -1):
        out[i - 1] = back[i, out[i]]
    return out


def rendered(lines: list[str], states: np.ndarray) -> list[dict]:
    """Turns of the states, without the markers that began them; a marker's own line goes with it.

    Only a marker known for the turn's role is taken off: ``Note: bring two`` stays as it is.
    """
    turns: list[dict] = []
    for line, state in zip(lines, states):
        if state % 2 == 0 or not turns:
            found = MARKER.match(line)
            if found and (found.group(1) or found.group(2)).lower() not in SPEAKERS[state // 2]:
                found = None
            rest = line[found.end() :] if found else line
            turns.append({"role": ROLES[state // 2], "lines": [rest] if rest or not found else []})
        else:
            turns[-1]["lines"].append(line)
    return [{"role": t["role"], "text": "\n".join(t["lines"])} for t in turns]


TURN = re.compile(rf"<\|({'|'.join(ROLES)})\|>\n(.*?)\n<\|end\|>(?:\n|\Z)", re.DOTALL)


def escaped(text: str) -> str:
    """``<|`` with one backslash more between its characters, however many there are."""
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescaped(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def canonical(turns: list[dict]) -> str:
    return "\n".join(f"<|{t['role']}|>\n{escaped(t['text'])}\n<|end|>" for t in turns)


def read_back(rendering: str) -> list[dict]:
    """The turns a rendering was made of."""
    return [{"role": role, "text": unescaped(text)} for role, text in TURN.findall(rendering)]


KIND = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))


def parse(plain: DataFrame, model: Model) -> DataFrame:
    """(conv_id, piece, states, turns, rendered) of transcripts (conv_id, piece, text).

    ``states`` holds a line's role times two, and one more for a further line. Other columns are not
    read. An empty text is one empty line; a null text has no turns. An empty table gives no rows.
    """

    def step(batch):
        out: dict = {"states": [], "turns": [], "rendered": []}
        for text in batch.column("text").to_pylist():
            lines = [] if text is None else text.split("\n")
            states = viterbi(grid(lines), model) if lines else np.zeros(0, np.int64)
            turns = rendered(lines, states)
            out["states"].append(states.tolist())
            out["turns"].append(turns)
            out["rendered"].append(canonical(turns))
        yield {
            "conv_id": batch.column("conv_id"),
            "piece": batch.column("piece"),
            "states": pa.array(out["states"], pa.list_(pa.int32())),
            "turns": pa.array(out["turns"], KIND),
            "rendered": pa.array(out["rendered"], pa.string()),
        }

    schema = "conv_id long, piece long, states array<int>, turns array<struct<role:string,text:string>>, rendered string"
    return map_arrow(plain, step, schema, "conv_id", "piece", "text")
