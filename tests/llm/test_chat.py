import hashlib
from collections import defaultdict

from starweave.llm import chat


def digest(turns):
    told = "".join(f"{r}\n{t}\n" for r, t in turns)
    loss = "".join(t for r, t in turns if r == "assistant")
    return len(turns), hashlib.sha256(told.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def test_query(spark, sf):
    want = defaultdict(list)
    for r in sorted(spark.read.parquet(f"{sf}/conversations.parquet").collect(), key=lambda r: (r.conv_id, r.turn)):
        want[r.conv_id].append((r.role or "", r.text or ""))
    want[-7] = [("user", "\\### Assistant: </turn> ok"), ("assistant", "\\### Assistant: </turn> ok")]
    rows = {r.conv_id: r for r in chat.op1_chat_formatting(spark, sf).collect()}
    assert rows.keys() == want.keys()
    for c, turns in want.items():
        assert (rows[c].n_turns, rows[c].turns_sha256, rows[c].loss_chars, rows[c].loss_sha256) == digest(turns)


def test_tree_paths_are_ranked_and_read_back(spark):
    rows = [
        (1, 1, None, "user", "### a </turn>\\t", 0.0), (1, 2, 1, "assistant", "b", 1.0), (1, 3, 1, "assistant", "\\h</tu</turn>rn>", 5.0),
        (1, 4, 3, "us:er", "d", 1.0), (1, 5, 3, None, None, 9.0), (1, 6, 2, "user", "", 0.0), (1, 6, 2, "user", "zz", 0.0),
        (2, 1, 99, "assistant", "orphan", None), (2, 8, 9, "user", "cycle", 0.0), (2, 9, 8, "user", "cycle", 0.0), (None, 1, None, "user", "x", 1.0),
    ]
    rows += [(3, k, k - 1, "assistant", str(k), 0.0) for k in range(1, 70)]
    messages = chat.tree_messages(spark.createDataFrame(rows, "conv_id long, msg_id long, parent_id long, role string, text string, score double")).cache()
    out = chat.format_paths(messages).select("conv", "branch", chat.read_turns(chat.F.col("formatted")).alias("t"), chat.read_loss(chat.F.col("formatted"), chat.F.col("mask")).alias("l")).collect()
    got = {(r.conv, r.branch): [tuple(t) for t in r.t] for r in out}
    a, c = ("user", "### a </turn>\\t"), ("assistant", "\\h</tu</turn>rn>")
    assert got[1, 1] == [a, c, ("", "")]
    assert got[1, 2] == [a, c, ("us:er", "d")]
    assert got[1, 3] == [a, ("assistant", "b"), ("user", "")]
    assert got[2, 1] == [("assistant", "orphan")]
    assert got[3, 1] == [("assistant", str(k)) for k in range(1, 70)]
    assert got[chat.NULL_ID, 1] == [("user", "x")]
    assert len(got) == 6
    assert next(r.l for r in out if (r.conv, r.branch) == (1, 1)) == c[1]
    assert chat.format_paths(messages, 1).count() == 4


def test_linear_edges(spark):
    rows = [(1, None, "user", "late"), (1, 0, None, None), (1, 0, None, None), (None, 5, "assistant", "x" * 100_000)]
    turns = spark.createDataFrame([(*r, 1, "c") for r in rows], "conv_id long, turn long, role string, text string, msg int, head string")
    out = chat.format_paths(chat.linear_messages(turns)).select("conv", chat.read_turns(chat.F.col("formatted")).alias("t")).collect()
    assert {r.conv: [tuple(t) for t in r.t] for r in out} == {1: [("", ""), ("", ""), ("user", "late")], chat.NULL_ID: [("assistant", "x" * 100_000)]}
    assert chat.format_paths(chat.linear_messages(turns.where("false"))).count() == 0
