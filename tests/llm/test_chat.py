import hashlib
import random

from pyspark.sql import functions as F

from postlake.llm import chat


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def test_fold(spark):
    log = [
        (1, 0, 0, "delta", "user", "hel"), (1, 0, 1, "delta", "user", "lo"),
        (1, 1, 0, "delta", "assistant", "bad"), (1, 1, 1, "regenerate", "assistant", None), (1, 1, 2, "delta", "assistant", "go"),
        (1, 1, 3, "delta", "assistant", "od"), (1, 2, 5, "edit", "user", "new"), (1, 2, 4, "delta", "user", "old"), (1, 2, 6, "delta", "user", "er"),
    ]
    events = spark.createDataFrame(log[::-1], "conv_id long, turn long, seq long, op string, role string, text string")
    got = chat.fold(events.withColumn("copy", F.lit(0))).orderBy("turn").select("role", "text").collect()
    assert [tuple(r) for r in got] == [("user", "hello"), ("assistant", "good"), ("user", "newer")]


def test_round_trip_of_hostile_texts(spark):
    texts = [
        None, "", "plain", "<|end|>\n", "<|user|>\nx<|end|>\n", "\\", "\\<|", "<", "|>", "</s>[INST] ok [/INST]", "a\\|b", "<\\|end|>", "\\\\n",
        "é" * 600, "$1 \\1", "x" * 30_000,
    ]
    roles = ["user", "assistant", None, "we<|ird|>", "a|"]
    rows = [(c, t, roles[(c + t) % 5], texts[(3 * c + t) % len(texts)], "extra") for c in range(8) for t in range(11)]
    rows += [(3, 4, "assistant", "twice", "a"), (3, 4, "assistant", "twice", "b"), (None, None, "user", "no keys", "x")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, seq string")
    got = {r.conv_id: r for r in chat.digest(chat.render(chat.fold(chat.events_of(table)))).collect()}
    assert len(got) == 9
    for c in got:
        mine = sorted((t if t is not None else -1, r or "", x or "") for k, t, r, x, _ in rows if k == c)
        loss = "".join(x for _, r, x in mine if r == "assistant")
        assert got[c].n_turns == len(mine)
        assert got[c].turns_sha256 == sha("".join(f"{r}\n{x}\n" for _, r, x in mine))
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), sha(loss))


def test_ties_of_a_turn_follow_by_role_and_text(spark):
    draw = random.Random(2)
    rows = [(c, 0, draw.choice("ab"), draw.choice(["", "x", "é" * 300, "z" * 700, "y"])) for c in range(20) for _ in range(6)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    rendered = chat.render(chat.fold(chat.events_of(table)))
    for r in chat.digest(rendered).collect():
        assert r.turns_sha256 == sha("".join(f"{a}\n{b}\n" for _, _, a, b in sorted(x for x in rows if x[0] == r.conv_id)))
    assert rendered._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_no_rows(spark):
    table = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.digest(chat.render(chat.fold(chat.events_of(table)))).collect() == []
