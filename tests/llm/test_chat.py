import hashlib
import json

from hypothesis import given, settings
from hypothesis import strategies as st
from oracle import compare
from pyspark.sql import functions as F
from tidemark.llm import chat, queries


def test_equals_its_sql(spark, small):
    compare(spark, small, queries.QUERIES["op1_chat_format"], queries.ORACLE["op1_chat_format"])


def test_layouts_become_turns(spark):
    say = lambda *t: [{"role": r, "text": x} for r, x in t]
    cases = [
        ({"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": None}]}, "messages", say(("user", "a"), ("assistant", None))),
        ({"system": "s", "messages": [{"role": "user", "content": "a"}]}, "messages", say(("system", "s"), ("user", "a"))),
        ({"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}]}, "conversations", say(("user", "a"), ("assistant", "b"))),
        ({"instruction": "i", "output": "o"}, "instruction", say(("user", "i"), ("assistant", "o"))),
        ({"instruction": "i", "input": "x", "output": "o"}, "instruction", say(("user", "i\n\nx"), ("assistant", "o"))),
        ({"prompt": "p", "completion": "c"}, "prompt", say(("user", "p"), ("assistant", "c"))),
        ({"prompt": "p", "response": 3}, "response", say(("user", "p"), ("assistant", "3"))),
        ({"question": "q", "context": "c", "answer": "a"}, "question", say(("user", "c\n\nq"), ("assistant", "a"))),
        ({"role": "tool", "text": "t"}, "row", say(("tool", "t"))),
        ({"other": 1}, None, []),
        ({}, None, []),
    ]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, (r, _, _) in enumerate(cases)] + [(99, None)], "i int, j string").select("i", F.parse_json("j").alias("record"))
    got = {r.i: (r.layout, [t.asDict() for t in r.turns]) for r in chat.canonical_turns(df).select("i", "layout", "turns").collect()}
    assert got == {i: (layout, turns) for i, (_, layout, turns) in enumerate(cases)} | {99: (None, [])}


parts = st.lists(st.sampled_from(["<", "|", "\\", "im_end|>", "<|im_end|>", "<|im_start|>", "\n", "assistant", "é", "n", "x"]), max_size=8).map("".join)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "a\\nb", "a\nb", "<|x", "\\", "a\0b", "\\s\\n\\\\n", "\\s<\\|\n"]), st.one_of(st.none(), parts)), min_size=1, max_size=6))
def test_formatting_is_reversible(spark, turns):
    df = spark.createDataFrame([(1, i, r, t) for i, (r, t) in enumerate(turns)], "conv_id long, at int, role string, text string")
    made = chat.formatted(df, "conv_id")
    row = chat.read_back(made, "conv_id").first()
    assert [(t.role, t.text) for t in row.turns] == [(r, t or "") for r, t in turns]
    assert row.learned == "".join(t or "" for r, t in turns if r == "assistant")
    assert made.first().formatted.count("<|im_start|>") == len(turns)


def test_nulls_ties_and_extra_columns(spark):
    rows = [(None, 0, "user", "n", 1), (7, 1, None, None, 1), (7, 1, "assistant", "b", 1), (7, 1, "assistant", "a", 1), (7, None, "user", "first", 1), (7, 1, "assistant", "a", 1)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted int")
    got = {r.conv_id: r for r in chat.chat_digest(df).collect()}
    told = "user\nfirst\n" + "\n\n" + "assistant\na\n" * 2 + "assistant\nb\n"
    assert set(got) == {None, 7} and got[7].n_turns == 5
    assert got[7].turns_sha256 == hashlib.sha256(told.encode()).hexdigest()
    assert got[7].loss_chars == 3 and got[7].loss_sha256 == hashlib.sha256(b"aab").hexdigest()
    assert chat.chat_digest(df.limit(0)).collect() == []


def test_many_turns_of_much_text(spark):
    df = spark.createDataFrame([(1, i, ["user", "assistant"][i % 2], "é<|" * 500) for i in range(300)], "conv_id long, turn long, role string, text string")
    row = chat.chat_digest(df).first()
    assert row.n_turns == 300 and row.loss_chars == 150 * 1500
    for n in 1, 255, 256, 257, 20_000:
        few = spark.range(n).selectExpr("1L conv_id", "id turn", "if(id % 3 = 1, 'assistant', 'user') role", "concat('<|', id) text")
        row = chat.read_back(chat.formatted(few.withColumnRenamed("turn", "at"), "conv_id"), "conv_id").first()
        assert [(t.role, t.text) for t in row.turns] == [("assistant" if i % 3 == 1 else "user", f"<|{i}") for i in range(n)]
        assert row.learned == "".join(f"<|{i}" for i in range(n) if i % 3 == 1)
