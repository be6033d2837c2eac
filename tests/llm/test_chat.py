import hashlib

from pyspark.sql import functions as F

from shoptrail.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, formatted int"


def formatted(spark, rows):
    df = spark.createDataFrame([(*r, 0) for r in rows], SCHEMA)  # with a column whose name clashes
    out = chat.format_chats(df).select("conv_id", "valid", "formatted", chat.read_turns(F.col("formatted")).alias("turns"),
                                       chat.loss_text(F.col("segments")).alias("loss"), "segments")
    return {r.conv_id: r for r in out.collect()}


def test_marks_in_texts_come_back(spark):
    tricky = ["</s>[INST] ok [/INST]", r"[\INST] <\s> <\\s> \ ", "<<SYS>> <<<SYS>>> <</SYS>>", "<s><s>[ROLE]a[/ROLE]b[/TURN]", "[[INST]]<<s>>"]
    got = formatted(spark, [(i, k, role, t) for i, t in enumerate(tricky) for k, role in enumerate(("user", "assistant"))])
    for i, t in enumerate(tricky):
        assert [tuple(x) for x in got[i].turns] == [("user", t), ("assistant", t)]
        assert got[i].loss == t and got[i].valid
        assert "".join(s.text for s in got[i].segments) == got[i].formatted


def test_order_of_turns(spark):
    cases = {1: ["user", "assistant"], 2: ["system", "user", "assistant", "user", "assistant"], 3: ["assistant"], 4: ["user"],
             5: ["user", "user", "assistant"], 6: ["user", "assistant", "system"], 7: ["system", "assistant"], 8: ["tool", "assistant"]}
    got = formatted(spark, [(c, k, role, "t") for c, roles in cases.items() for k, role in enumerate(roles)])
    assert {c for c in cases if got[c].valid} == {1, 2}
    assert [t.role for t in got[8].turns] == ["tool", "assistant"]


def test_nulls_ties_and_repeats(spark):
    got = formatted(spark, [(None, 1, "user", None), (None, None, None, "first"), (7, 2, "user", "b"), (7, 2, "user", "b"), (7, 2, "user", "a")])
    assert [tuple(t) for t in got[None].turns] == [("", "first"), ("user", "")] and not got[None].valid
    assert [t.text for t in got[7].turns] == ["a", "b", "b"]
    assert formatted(spark, []) == {}


def test_long_text(spark):
    text = "é[INST]" * 200_000
    got = formatted(spark, [(1, 0, "user", "q"), (1, 1, "assistant", text)])[1]
    assert hashlib.sha256(got.loss.encode()).digest() == hashlib.sha256(text.encode()).digest()
