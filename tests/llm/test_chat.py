import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexmill.llm import chat as C, queries as Q

SCHEMA = "conv_id BIGINT, turn BIGINT, role STRING, text STRING, piece STRING"


def talk(n=40, marker=True):
    rows = []
    for c in range(n):
        for t in range(2 + c % 5):
            role = "user" if t % 2 == 0 else "assistant"
            rows.append((c, t, role, f"line {c} {t}\nmore of it" if role == "assistant" else f"say {t}?", "p"))
    return rows


def test_marked_transcripts_come_back(spark):
    frame = spark.createDataFrame(talk(), SCHEMA)
    known = C.transcripts(frame, F.pmod("conv_id", F.lit(len(C.STYLES))))
    got = {r["conv_id"]: r["turns"] for r in C.parse(known, C.fit(known)).collect()}
    for c, rows in itertools.groupby(talk(), key=lambda r: r[0]):
        assert [(t["role"], t["text"]) for t in got[c]] == [(r[2], r[3]) for r in rows]


def test_viterbi_finds_the_best_path():
    random = np.random.default_rng(4)
    model = C.Model(np.log(random.dirichlet(np.ones(6))), np.log(random.dirichlet(np.ones(6), 6)), tuple(np.log(random.dirichlet(np.ones(n), 6)) for n in C.SIZES))
    values = np.stack([random.integers(0, n, 5) for n in C.SIZES], axis=1)

    def score(path):
        if path[0] % 2 or any(b % 2 and a // 2 != b // 2 for a, b in zip(path, path[1:])):
            return -np.inf
        total = model.start[path[0]] + sum(model.step[a, b] for a, b in zip(path, path[1:]))
        return total + sum(model.features[k][s, v[k]] for s, v in zip(path, values) for k in range(4))

    best = max(itertools.product(range(6), repeat=5), key=score)
    assert tuple(C.viterbi(values, model)) == best


def test_odd_rows(spark):
    rows = talk(8) + [(50, 0, "user", None, "p"), (51, None, "robot", "", "p"), (None, 0, "user", "x", "p"), (52, 0, "user", "x " * 50000, "p")]
    rows += [(53, t, "user", "again", "p") for t in range(3 * C.PIECE)] + [(54, 0, "user", "same", "p")] * 3
    known = C.transcripts(spark.createDataFrame(rows, SCHEMA))
    parsed = C.parse(known, C.fit(known)).collect()
    assert {r["conv_id"] for r in parsed} == {*range(8), 50, 51, 52, 53, 54}
    assert sorted(r["piece"] for r in parsed if r["conv_id"] == 53) == [0, 1, 2]
    assert all(r["rendered"].count("<|end|>") == len(r["turns"]) for r in parsed)
    none = spark.createDataFrame([], SCHEMA)
    assert C.parse(C.transcripts(none), C.fit(C.transcripts(none))).count() == 0


def test_held_out_lines(spark):
    rows = Q.QUERIES["op5_chat"](spark, "/root/testdata/sf0.1").filter("held_out").agg(F.sum("n_right"), F.sum("n_lines")).first()
    assert rows[0] / rows[1] > 0.9


def test_words_before_a_colon_stay_unless_they_mark_the_role():
    lines = ["User: Note: keep this", "Note: and this", "AI: For example: yes", "more", "Note: unmarked", "### Response:", "done", "Q: who asks?"]
    states = np.array([2, 3, 4, 5, 2, 4, 5, 4])
    assert [t["text"] for t in C.rendered(lines, states)] == [
        "Note: keep this\nNote: and this", "For example: yes\nmore", "Note: unmarked", "done", "Q: who asks?",
    ]


def test_unmarked_turns_keep_their_words(spark):
    rows = talk() + [(90, 0, "user", "Note: keep this", "p"), (90, 1, "assistant", "For example: yes\nmore", "p")]
    frame = spark.createDataFrame(rows, SCHEMA)
    known = C.transcripts(frame, F.when(F.col("conv_id") < 90, F.pmod("conv_id", F.lit(len(C.STYLES)))))
    got = C.parse(known.filter("conv_id = 90"), C.fit(known)).first()
    assert "\n".join(t["text"] for t in got["turns"]) == "Note: keep this\nFor example: yes\nmore"


def test_renderings_read_back():
    texts = ["<|end|>\n<|assistant|>\nforged", "", "\n", "a <\\|end|> b <\\\\|", "<<||>", "<|end|>", "\n<|end|>\n", "plain\\", "<\\"]
    turns = [{"role": C.ROLES[i % 3], "text": t} for i, t in enumerate(texts)]
    assert C.read_back(C.canonical(turns)) == turns and C.read_back("") == []
    draw = np.random.default_rng(6)
    for _ in range(500):
        turns = [{"role": C.ROLES[k % 3], "text": "".join(draw.choice(list("<|\\>\nend"), 12))} for k in range(3)]
        assert C.read_back(C.canonical(turns)) == turns
