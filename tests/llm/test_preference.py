from antecede.llm import preference as op

TURNS = "conv_id long, turn long, role string, text string, side string"


def _examples(spark, chosen, rejected):
    make = lambda rows: spark.createDataFrame([(*r, "clash") for r in rows], TURNS)
    return {r.pair_id: r for r in op.preference_examples(make(chosen), make(rejected)).collect()}


def _chat(*turns):
    return "".join(f"<|im_start|>{r}\n{t}<|im_end|>\n" for r, t in turns)


def test_common_turns_are_the_prompt_and_only_answers_carry_loss(spark):
    chosen = [(1, 1, "user", "q"), (1, 2, "assistant", "good é"), (1, 0, "system", "s"), (1, 0, "system", "s")]
    rejected = [(1, 0, "system", "s"), (1, 1, "user", "q"), (1, 2, "assistant", "bad"), (1, 3, "user", "why")]
    r = _examples(spark, chosen, rejected)[1]
    assert r.n_prefix == 2 and r.prompt == _chat(("system", "s"), ("user", "q"))
    assert r.chosen == _chat(("assistant", "good é")) and r.rejected == _chat(("assistant", "bad"), ("user", "why"))
    assert [r.chosen[s.first:s.last] for s in r.chosen_spans] == ["good é<|im_end|>"]
    assert [r.rejected[s.first:s.last] for s in r.rejected_spans] == ["bad<|im_end|>"]


def test_equal_missing_and_null_sides(spark):
    got = _examples(spark, [(1, 0, "user", "a"), (None, None, None, None), (3, 0, "user", "x")], [(1, 0, "user", "a"), (2, 0, "user", None)])
    assert (got[1].n_prefix, got[1].chosen, got[1].rejected) == (1, "", "")
    assert got[2].chosen == "" and got[2].rejected == _chat(("user", ""))
    assert got[None].chosen == _chat(("", "")) and got[3].n_prefix == 0
    assert _examples(spark, [], []) == {}


def test_a_long_conversation(spark):
    turns = [(7, i, "assistant" if i % 2 else "user", f"text {i}") for i in range(2000)]
    r = _examples(spark, turns, turns[:-1] + [(7, 1999, "assistant", "other")])[7]
    assert r.n_prefix == 1999 and r.chosen == _chat(("assistant", "text 1999"))


def test_last_answers_are_swapped_with_the_neighbour(spark):
    rows = [(1, 0, "user", "a", ""), (1, 1, "assistant", "b", ""), (2, 0, "user", "c", ""), (2, 1, "assistant", "d", ""), (2, 2, "user", "e", "")]
    got = op.answers_swapped(spark.createDataFrame(rows, TURNS)).collect()
    assert {(r.conv_id, r.turn, r.text) for r in got} == {(1, 0, "a"), (1, 1, "d"), (2, 0, "c"), (2, 2, "e")}
