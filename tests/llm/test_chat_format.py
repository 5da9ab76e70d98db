import hashlib
import random

from churnlens.llm import chat_format as C

SCHEMA = "conv_id long, turn long, role string, text string"
CONTROLS = ["<|im_start|>", "<|im_end|>\n", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "\\", "<\\n>", "\n", "é", "ok ", "<", "|", "["]


def conversations(seed=0):
    r = random.Random(seed)
    rows = []
    for conv in range(40):
        at = 0
        if r.random() < 0.5:
            rows.append((conv, at, "system", "".join(r.choices(CONTROLS, k=r.randrange(5)))))
            at = 1
        for k in range(r.choice([0, 1, 2, 5, 40])):
            text = None if r.random() < 0.05 else "".join(r.choices(CONTROLS, k=r.randrange(40)))
            rows.append((conv, at + k, r.choice(["user", "assistant", "to\nol", "<|im_end|>", None]), text))
    return rows


def told(rows):
    rows = sorted(rows, key=lambda x: (x[1] is not None, x[1] or 0, x[2] or "", x[3] or ""))
    turns = "".join(f"{x[2] or ''}\n{x[3] or ''}\n" for x in rows)
    loss = "".join(x[3] or "" for x in rows if x[2] == "assistant")
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return len(rows), sha(turns), len(loss), sha(loss)


def check(spark, rows, **parameters):
    windows = C.format_windows(spark.createDataFrame(rows, SCHEMA), **parameters)
    got = {r.conv_id: r for r in C.conversation_digests(windows).collect()}
    own = {}
    for x in rows:
        own.setdefault(x[0], []).append(x)
    assert got.keys() == own.keys()
    for conv, turns in own.items():
        g = got[conv]
        assert (g.n_turns, g.turns_sha256, g.loss_chars, g.loss_sha256) == told(turns), conv
    return windows.collect()


def test_round_trip_at_any_budget(spark):
    rows = conversations()
    one = check(spark, rows, budget=100_000)
    assert len(one) == len({r[0] for r in rows})
    for parameters in ({"budget": 64, "history_tokens": 16}, {"budget": 200, "history_tokens": 60, "history_turns": 3}):
        many = check(spark, rows, **parameters)
        assert len(many) > len(one)


def test_windows_keep_budget_system_and_limited_history(spark):
    rows = [(1, 0, "system", "rules of the house")]
    rows += [(1, 1 + k, ("user", "assistant")[k % 2], f"word{k} " * 6) for k in range(60)]
    windows = sorted(C.format_windows(spark.createDataFrame(rows, SCHEMA), budget=120, history_tokens=25, history_turns=2).collect(),
                     key=lambda w: w.window)
    assert len(windows) > 3
    for i, w in enumerate(windows):
        assert w.tokens <= 120
        parts = w.text.split("<|im_end|>\n")[:-1]
        assert parts[0] == "<|im_start|>system\nrules of the house"
        repeated = parts[:w.n_repeated]
        assert len(repeated) == (0 if i == 0 else 3)  # the system turn and two turns of history
        for a, b in [(s.start, s.end) for s in w.loss]:
            body = w.text[a:b]
            assert not any(body in p for p in repeated) and w.text[:a].endswith("<|im_start|>assistant\n") and w.text[b:].startswith("<|im_end|>")


def test_ties_nulls_repeated_rows_and_empty_table(spark):
    rows = [(1, 0, "user", "a"), (1, 0, "user", "a"), (1, 0, "assistant", "b"), (1, None, "user", "first"), (2, 5, None, None)]
    check(spark, rows)
    frame = spark.createDataFrame([(None, 0, "user", "x"), (None, 1, "assistant", "y")], SCHEMA)
    assert C.conversation_digests(C.format_windows(frame)).first().n_turns == 2
    assert C.conversation_digests(C.format_windows(frame.limit(0))).count() == 0


def test_tied_and_null_turns_keep_the_budget(spark):
    """Rows without a turn number, or all on one, are split like any others."""
    word = "abc def ghi " * 20
    for turn in (None, 7):
        rows = [(1, turn, ("user", "assistant")[k % 2], word + str(k % 50)) for k in range(400)]
        windows = check(spark, rows)
        assert len(windows) > 20 and all(w.tokens <= 1024 for w in windows)
    same = check(spark, [(1, None, "user", word)] * 300)
    assert len(same) > 15 and all(w.tokens <= 1024 for w in same)


def test_many_windows_repeat_the_system_turn(spark, monkeypatch):
    monkeypatch.setattr(C, "SALT", 4)
    rows = [(1, 0, "system", "rules"), *[(1, k, "user", f"word{k} " * 20) for k in range(1, 120)], (2, 0, "system", "alone")]
    windows = check(spark, rows, budget=64, history_tokens=8)
    assert len(windows) > 30 and all(w.text.startswith("<|im_start|>system\n") for w in windows)
    assert sorted(w.window for w in windows if w.conv_id == 1)[0] == 0


def test_no_history(spark):
    rows = [(1, k, "assistant", f"word{k} " * 20) for k in range(30)]
    windows = check(spark, rows, budget=64, history_turns=0)
    assert len(windows) > 5 and all(w.n_repeated == 0 for w in windows)
