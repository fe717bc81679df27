"""Templates that rewrite history late, whatever context they declare."""

import pytest

from lodestone.llm import chat


def drops_oldest(turns):
    """From turn 6 on the oldest turns are dropped."""
    return "".join(f"<{r}>{t}" for r, t in turns[-5:])


def summary(turns):
    return ("(summary)" if len(turns) > 5 else "") + "".join(f"<{r}>{t}" for r, t in turns)


@pytest.mark.parametrize("template", [drops_oldest, summary])
@pytest.mark.parametrize("context", [None, 0, 2])
def test_rewriting_at_turn_6_is_detected(spark, template, context):
    rows = [(c, i, "assistant" if i % 2 else "user", f"text {i}") for c, n in ((1, 5), (2, 6), (3, 7), (4, 20)) for i in range(n)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = chat.formatted(turns, template, context).collect()
    rewritten = {c: min((r["turn_index"] for r in got if r["conv_id"] == c and r["rewritten"]), default=None) for c in (1, 2, 3, 4)}
    assert rewritten == {1: None, 2: 5, 3: 5, 4: 5}
    assert not [r for r in got if r["loss"] and r["rewritten"]]


def test_no_context_is_declared_by_default(spark):
    turns = spark.createDataFrame([(1, i, "user", f"text {i}") for i in range(10)], "conv_id long, turn long, role string, text string")
    assert [r["turn_index"] for r in chat.formatted(turns, drops_oldest).collect() if r["rewritten"]] == [5, 6, 7, 8, 9]


@pytest.mark.parametrize("n,changed,found", [(7, 7, 6), (20, 20, 19), (64, 64, 63), (100, 70, 71), (100, 100, 99), (200, 100, 103), (200, 201, None)])
def test_history_is_checked_over_the_whole_conversation(n, changed, found):
    """A template that declares no context rewrites history at turn changed: up to CHECKED turns at once, then when the text has grown by SHARE, or at the last turn."""

    def late(turns):
        return "".join(f"<{r}>{t}" for r, t in (turns[1:] if len(turns) >= changed else turns))

    state, seen = chat.Incremental(late, 0), None
    for i in range(n):
        state.add("user", f"text {i}", i == n - 1)
        seen = i if seen is None and state.rewritten else seen
    assert seen == found


@pytest.mark.parametrize("n", [110, 128, 150, 1000])
def test_rewriting_that_is_over_by_the_end_is_detected(n):
    """A template that drops the first turn between turns 70 and 100 only."""
    state = chat.Incremental(lambda turns: "".join(f"<{r}>{t}" for r, t in (turns[1:] if 70 <= len(turns) <= 100 else turns)), 0)
    for i in range(n):
        state.add("user", f"text {i:03}", i == n - 1)
        assert state.rewritten == (i >= 71)


def test_rendering_is_linear_in_the_turns():
    size = []

    def counting(turns):
        size.append(len(turns))
        return chat.instruct(turns)

    for n in (3000, 6000):
        state = chat.Incremental(counting, 0)
        for i in range(n):
            state.add("user", "x", i == n - 1)
        assert not state.rewritten and sum(size) < 2 * chat.CHECKED**2 + (1 / chat.SHARE + 5) * n
        size.clear()


def test_very_long_texts_and_clashing_columns(spark):
    long = "ein [langer] Text </s> " * 50_000
    rows = [(1, 0, "user", long), (1, 1, "assistant", long), (2, 0, None, None), (None, 0, "user", "no id")]
    turns = spark.createDataFrame([(*r, "x", True) for r in rows], "conv_id long, turn long, role string, text string, piece string, loss boolean")
    got = {r["conv_id"]: r for r in chat.digests(chat.formatted(turns, context=0)).collect()}
    assert set(got) == {1, 2, None} and got[1]["loss_chars"] == len(long) and got[2]["n_turns"] == 1
    assert got[1]["formatted_chars"] == len(chat.instruct([("user", long), ("assistant", long)]))
