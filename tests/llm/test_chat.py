from callweave.llm import chat

ROWS = "conv_id long, turn long, role string, text string, turns string"


def conv(spark, *rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], ROWS)


def test_common_turns_are_the_prompt(spark):
    a = [("user", "hi"), ("assistant", "yo"), ("user", "more"), ("assistant", "good")]
    b = [("user", "hi"), ("assistant", "yo"), ("assistant", "bad")]
    pairs = spark.createDataFrame([(1, a, b), (2, a, a), (3, None, b), (4, [], None), (5, [(None, None)], [(None, None)])], f"id long, chosen {chat.TURNS}, rejected {chat.TURNS}")
    out = {r.id: r.formatted for r in chat.format_preferences(pairs).collect()}
    turn = lambda role, text: f"<|im_start|>{role}\n{text}<|im_end|>\n"
    f = out[1]
    assert (f.n_common, f.prompt) == (2, turn("user", "hi") + turn("assistant", "yo"))
    assert f.chosen == turn("user", "more") + turn("assistant", "good") and f.rejected == turn("assistant", "bad")
    assert f.chosen_mask == "17:0,15:0,22:0,15:1" and f.rejected_mask == "22:0,14:1"
    assert sum(int(x.split(":")[0]) for x in f.chosen_mask.split(",")) == len(f.chosen)
    assert (out[2].n_common, out[2].chosen, out[2].chosen_mask, out[2].rejected) == (4, "", "", "")
    assert (out[3].prompt, out[3].chosen) == ("", "") and out[3].rejected.startswith("<|im_start|>user\nhi")
    assert (out[4].n_common, out[4].prompt, out[4].rejected) == (0, "", "") and out[5].n_common == 1


def test_conversations_and_swapped_answers(spark):
    c = conv(
        spark,
        (0, 1, "assistant", "a0"), (0, 0, "user", "q0"), (1, 0, "user", "q1"), (1, 1, "assistant", "a1"), (1, 2, "user", "then"),
        (2, 0, "user", "alone"), (2, 0, "user", "alone"), (None, 0, "user", "nobody"), (3, 0, None, None), (3, None, "assistant", "early"), (9, 0, "assistant", "x" * 2_000_000), (-1, 0, "user", "below"), (-2, 0, "assistant", "zero"),
    )
    turns = {r.conv_id: [tuple(t) for t in r.turns] for r in chat.conversation_turns(c).collect()}
    assert turns[0] == [("user", "q0"), ("assistant", "a0")] and turns[2] == [("user", "alone")] * 2
    assert turns[3] == [("assistant", "early"), ("", "")] and None not in turns
    pairs = chat.swapped_answers(c).collect()
    assert {r.conv_id: [tuple(t) for t in r.chosen] for r in pairs} == turns and len(pairs) == len(turns)
    out = {r.conv_id: [tuple(t) for t in r.rejected] for r in pairs}
    assert out[0] == [("user", "q0"), ("assistant", "a1")]
    assert out[1] == [("user", "q1"), ("assistant", "a0")]
    assert out[2] == [("user", "alone"), ("user", "alone"), ("assistant", "early")] and out[3] == [] and out[9] == [] and out[-1] == [("user", "below"), ("assistant", "zero")] and out[-2] == []


def test_empty_table(spark):
    c = chat.swapped_answers(conv(spark))
    assert chat.format_preferences(c).count() == 0
