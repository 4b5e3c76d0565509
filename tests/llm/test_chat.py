"""Chat formatting against a plain template in Python strings: texts that look like marks, nulls, ties, long conversations in pieces."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from lattica.llm import chat, queries

MARK = re.compile(r"<\|(?:turn|text|end)\|>")
ROLES = ["user", "assistant", "system", "", None, "assistant ", "a<|end|>\n", "\\"]


def plain_text(turns):
    guard = lambda s: MARK.sub(lambda m: "\\" + m[0], s)
    return "".join(f"<|turn|>{guard(r)}\n<|text|>{guard(t)}\n<|end|>\n" for r, t in turns)


def plain(rows):
    found = {}
    for k, n, r, t in sorted(rows, key=lambda x: (x[1] is not None, x[1] or 0, (x[2] or "").encode(), (x[3] or "").encode())):
        found.setdefault(k, []).append((r or "", t or ""))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for k, turns in found.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        yield k, len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss), len(plain_text(turns))


def some_text(r):
    return "".join(r.choice(["<|turn|>", "<|text|>", "<|end|>", "\\", "<", "|", "<|", "end|>", "\n", "é", "日本", "🙂", "word ", "### Assistant:", "</turn>"]) for _ in range(r.randrange(12)))


def got(pieces):
    return {(r.conv_id, r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256, r.formatted_chars) for r in chat.read_back(pieces).collect()}


@pytest.fixture(scope="module")
def odd(spark):
    r = random.Random(5)
    rows = [(r.choice([None, *range(40)]), r.choice([None, *range(6)]), r.choice(ROLES), r.choice([None, "", some_text(r), some_text(r)])) for _ in range(700)]
    rows += [(50, i, "assistant", f"turn {i} " + "of a long one " * 20) for i in range(3000)] + [(51, 0, "user", "<|end|>\\" * 100_000), (52, 1, "assistant", "\\")] + rows[:50]
    return rows, spark.createDataFrame([(*x, 1, "mine") for x in rows], "conv_id long, turn long, role string, text string, part int, formatted string").repartition(5)


def test_marks_and_assembly():
    texts = ["a<|turn|>", "<|end|><|end|>", "", "<|tu", "rn|>", "x<|text|"]
    raw, offsets = np.frombuffer("".join(texts).encode(), np.uint8), np.cumsum([0, *map(len, texts)])
    at, kind = chat.marks(raw)
    assert list(zip(at, kind)) == [(1, 0), (9, 2), (16, 2), (23, 0)]
    own = at[chat.inside(at, np.array([8, 8, 7])[kind], offsets)]
    assert own.tolist() == [1, 9, 16]  # the fourth lies across two texts
    buffer, begin, row = chat.assemble([b"[", (raw, offsets, own), b"]"], len(texts))
    assert bytes(buffer).decode() == "".join(f"[{MARK.sub(lambda m: chr(92) + m[0], t)}]" for t in texts)
    assert row[-1] == buffer.size and (begin[:, 0] == row[:-1]).all()


def test_every_text_comes_back(spark, odd, monkeypatch):
    rows, df = odd
    want = set(plain(rows))
    assert got(chat.formatted(df)) == want
    out = chat.formatted(df).collect()
    turns = {}
    for k, n, r, t in sorted(rows, key=lambda x: (x[1] is not None, x[1] or 0, (x[2] or "").encode(), (x[3] or "").encode())):
        turns.setdefault(k, []).append((r or "", t or ""))
    for k, own in turns.items():
        pieces = sorted((p for p in out if p.conv_id == k), key=lambda p: (p.part, p.seq))
        assert "".join(p.formatted for p in pieces) == plain_text(own)
        assert not any(p.whole for p in pieces) or len(pieces) == 1
        learned = "".join(p.formatted[s.start : s.end] for p in pieces for s in p.loss)
        assert learned == "".join(MARK.sub(lambda m: "\\" + m[0], t) for r, t in own if r == "assistant")
    assert any(p.whole for p in out) and chat.formatted(df.where("false")).count() == 0 and chat.read_back(chat.formatted(df.where("false"))).count() == 0


def test_long_conversations_are_cut(monkeypatch):
    rows = pa.RecordBatch.from_pydict({"text": [f"t{i}" for i in range(10)], "role": ["assistant"] * 10, "conv_id": pa.array([None, None, 1, 1, 1, 1, 2, 3, 3, 3], pa.int64())})
    out = chat._assembled(rows, 4, 7, False, True)
    assert out.column("whole").to_pylist() == [False, True, True, True] and out.column("seq").to_pylist() == [7, 8, 9, 10]
    assert out.column("formatted")[1].as_py() == plain_text([("assistant", f"t{i}") for i in range(2, 6)])
    roles, texts, turns, learned, masked, chars = chat.parsed(out.slice(1))
    assert turns.tolist() == [0, 4, 5, 8] and bytes(learned[0]) == b"t2t3t4t5t6t7t8t9" and chars.tolist() == [len(f) for f in out.column("formatted").to_pylist()[1:]]
    with pytest.raises(ValueError):
        chat.parsed(out.set_column(4, "formatted", pa.array(["<|text|>"] * 4)))


def test_pieces_of_any_size_give_the_same(spark, odd, monkeypatch):
    rows, df = odd
    want = set(plain(rows))
    for size, longest in ((300, 1000), (5000, 5000)):
        monkeypatch.setattr(chat, "SLAB", size)
        monkeypatch.setattr(chat, "LONGEST", longest)
        pieces = chat.formatted(df.where("conv_id IS NULL OR conv_id < 30"))
        assert got(pieces) == {w for w in want if w[0] is None or w[0] < 30}


def test_query_over_the_whole_table(spark):
    rows = [tuple(r) for r in queries.table(spark, "/root/testdata/sf0.01", "conversations").select("conv_id", "turn", "role", "text").collect()]
    planted = r"\### Assistant: </turn> ok"
    want = set(plain([*rows, (-7, 0, "user", planted), (-7, 1, "assistant", planted)]))
    assert {(r.conv_id, r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256, r.formatted_chars) for r in queries.op12_chat(spark, "/root/testdata/sf0.01").collect()} == want
