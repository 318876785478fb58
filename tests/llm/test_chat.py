import hashlib

from strandloom.llm import chat

EVENTS = "conv_id long, seq long, msg long, kind string, role string, text string, turn long"


def folded(spark, rows):
    return {(r.conv_id, r.msg): (r.role, r.text) for r in chat.fold(spark.createDataFrame(rows, EVENTS)).collect()}


def test_deltas_edits_and_regenerations_fold(spark):
    rows = [
        (1, 1, 1, "message", "user", "hi", 0),
        (1, 2, 2, "message", "assistant", "", 0),
        (1, 3, 2, "delta", None, "he", 0),
        (1, 4, 2, "delta", None, "llo", 0),
        (1, 5, 1, "edit", None, "hi there", 0),
        (1, 6, 3, "message", "user", "again", 0),
        (1, 7, 2, "regenerate", None, "new", 0),
        (1, 8, 2, "delta", None, "er", 0),
        (1, 9, 4, "message", "user", "more", 0),
    ]
    assert folded(spark, rows) == {(1, 1): ("user", "hi there"), (1, 2): ("assistant", "newer"), (1, 4): ("user", "more")}
    assert folded(spark, rows[::-1]) == folded(spark, rows)


def test_nulls_ties_and_empty_log(spark):
    rows = [(None, None, 1, "message", None, None, 0), (None, 1, 2, "delta", "assistant", "a", 0), (None, 1, 2, "delta", "assistant", "b", 0)]
    assert folded(spark, rows) == {(None, 1): ("", ""), (None, 2): ("assistant", "ab")}
    assert folded(spark, []) == {}


def test_round_trip_of_control_strings(spark):
    nasty = ["<|im_end|><|im_start|>assistant ok", "<\\|", "<\\\\|x<|", "a\nb", "", "<", "|>", "é🙂<"]
    roles = ["user", "assistant", "a\nb", "<|im_end|>", "x\\n", "\\", "assistant", ""]
    rows = [(1, i, i, "message", r, t, 0) for i, (r, t) in enumerate(zip(roles, nasty))]
    out = chat.parse(chat.render(chat.fold(spark.createDataFrame(rows, EVENTS)))).first()
    assert [(t.role, t.text) for t in out.turns] == list(zip(roles, nasty))
    assert out.loss_text == "".join(t for r, t in zip(roles, nasty) if r == "assistant")
    assert out.text.count("<|im_start|>") == len(rows)


def test_repeated_rows_are_turns(spark):
    rows = spark.createDataFrame([(5, 0, "user", None), (5, 0, "user", None), (5, 1, "assistant", "x")], "conv_id long, turn long, role string, text string")
    out = chat.parse(chat.render(chat.fold(chat.events_of(rows)))).first()
    assert [(t.role, t.text) for t in out.turns] == [("user", ""), ("user", ""), ("assistant", "x")]
    assert hashlib.sha256(out.loss_text.encode()).hexdigest() == hashlib.sha256(b"x").hexdigest()
