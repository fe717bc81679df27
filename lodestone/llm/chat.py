"""Chat formatting by incremental rendering of a black-box template.

A template is any function from a list of (role, text) turns to a string. Successive turn prefixes are rendered; where the
longer output starts with the shorter one, the rest is the new turn's span; where it does not, the template has rewritten
history and the conversation is reported as such. Rendering the same prefix with another last text shows where in the span
the text stands, so the loss mask covers exactly the assistant texts.

The first CHECKED prefixes of every conversation are rendered whole. From there on a template that declares how many earlier
turns a turn's rendering looks at (context) is rendered on that window, so that its cost is linear in the text; whenever what
has come since the last whole rendering is a SHARE of it, and at the last turn, the prefix is also rendered whole and compared
with the pieces so far; rows are reported as rewritten from the first such turn on that differs. So history that is rewritten
and restored within less than that share of the text, beyond CHECKED turns of a template that declared otherwise, is not
seen. A template that declares no context is rendered whole at every turn, and nothing is missed.
Rows stream through sorted by conversation and turn; a conversation of any length is one row a turn, never one value, but
the turns of the one at hand are kept for rendering it whole.

Defined results: null text or role counts as empty; turns of equal number stand in order of role and text, repeated rows
each count; a null conv_id is a conversation of its own; texts of any length are formatted whole; an empty table gives no
rows; other columns are ignored. A conversation is one task's, as its order and digests ask for.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import slices

Turns = list[tuple[str, str]]

#: Prefixes of each conversation that are all rendered whole even if the template declares its context.
CHECKED = 64
#: Beyond these a whole rendering follows when the text has grown by this share: at most 1 / SHARE + 1 times the text in all.
SHARE = 1 / 8
#: A text that no escaping touches, to find the place of a text in a span.
PROBE = "\ue000"

ESCAPES = {"\\": "\\\\", "[": "\\(", "]": "\\)", "<": "\\{", ">": "\\}"}
RESTORED = {v[1]: k for k, v in ESCAPES.items()}


def escape(text: str) -> str:
    """No control string, nor part of one, is left in the text; unescape gives the text back."""
    return re.sub(r"[\\\[\]<>]", lambda m: ESCAPES[m[0]], text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: RESTORED[m[1]], text, flags=re.S)


def instruct(turns: Turns) -> str:
    """Turn markup with one instruction bracket for each turn but the assistant's; a turn depends on none before it."""
    out = ["<s>"]
    for role, text in turns:
        if role == "assistant":
            out.append(f"[ANS]{escape(text)}[/ANS]</s>")
        elif role == "user":
            out.append(f"[INST]{escape(text)}[/INST]")
        else:
            out.append(f"[ROLE]{escape(role)}[/ROLE][TEXT]{escape(text)}[/TEXT]")
    return "".join(out)


TURN = re.compile(r"\[ANS\](.*?)\[/ANS\]</s>|\[INST\](.*?)\[/INST\]|\[ROLE\](.*?)\[/ROLE\]\[TEXT\](.*?)\[/TEXT\]", re.S)


def parse(text: str) -> Turns:
    """The turns of text that instruct has made."""
    out = []
    for m in TURN.finditer(text):
        answer, user, role, other = m.groups()
        out.append(("assistant", unescape(answer)) if answer is not None else ("user", unescape(user)) if user is not None else (unescape(role), unescape(other)))
    return out


def span(render: Callable[[Turns], str], before: str, turns: Turns, after: str) -> tuple[int, int] | None:
    """Where the last text stands in after, the rendering of turns; None if the template has rewritten what came before it."""
    if not after.startswith(before):
        return None
    probed = render([*turns[:-1], (turns[-1][0], PROBE)])
    head = probed.find(PROBE, len(before) if probed.startswith(before) else 0)
    if head < 0:
        return len(after), len(after)
    tail = len(probed) - head - len(PROBE)
    return head, max(head, len(after) - tail)


class Incremental:
    """Feeds turns of one conversation after another to a template; pieces come out with the place of their text."""

    def __init__(self, render: Callable[[Turns], str], context: int | None):
        self.render, self.context = render, context
        self.turns: Turns = []
        self.n = 0
        self.made = [render([])]  # joined, what the template has made of the turns so far
        self.whole, self.added = len(self.made[0]), 0
        self.rewritten = False

    def add(self, role: str, text: str, last: bool = False) -> tuple[str, int, int]:
        """(piece, start, end): what the turn adds to the output, and where in it the text stands. last: no turn follows."""
        self.n += 1
        whole = self.context is None or self.n <= CHECKED
        history = self.turns if whole else self.turns[max(0, len(self.turns) - self.context) :]
        before = "".join(self.made) if whole else self.render(history)
        turns = [*history, (role, text)]
        after = self.render(turns)
        found = span(self.render, before, turns, after)
        opening = before if self.n == 1 else ""
        self.turns.append((role, text))
        if whole:
            self.made, self.whole, self.added = [after], len(after), 0
        else:
            self.made.append(after[len(before) :])
            self.added += len(self.made[-1])
            if self.added >= SHARE * self.whole or last:
                real = self.render(self.turns)
                if real != "".join(self.made):
                    found = None
                self.made, self.whole, self.added = [real], len(real), 0
        if found is None:
            self.rewritten = True
            return opening, len(opening), len(opening)
        # the opening stands before the first turn's text and is part of its piece
        start, end = found[0] - len(before), found[1] - len(before)
        return opening + after[len(before) :], len(opening) + start, len(opening) + end


FORMATTED = "conv_id long, turn_index long, role string, piece string, text_start int, text_end int, loss boolean, rewritten boolean"


def formatted(turns: DataFrame, render: Callable[[Turns], str] = instruct, context: int | None = None, loss_role: str = "assistant") -> DataFrame:
    """Per row of turns(conv_id, turn, role, text): its piece of the conversation's formatted text, in order.

    text_start and text_end (code points in the piece) bound the text; loss says whether they are under the loss mask.
    Rows of a conversation stand together and in order of turn in one partition. rewritten: the template has changed history.
    """

    def run(batches):
        key, state, held = (object(),), None, None

        def take(out: list[list], last: bool):
            conv, role, text = held
            piece, start, end = state.add(role, text, last)
            for k, x in enumerate((conv, state.n - 1, role, piece, start, end, role == loss_role and not state.rewritten, state.rewritten)):
                out[k].append(x)

        def made(out: list[list]):
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.bool_(), pa.bool_()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=["conv_id", "turn_index", "role", "piece", "text_start", "text_end", "loss", "rewritten"])

        # a turn is rendered when the next row tells whether it is its conversation's last one
        for batch in slices(batches):
            out: list[list] = [[] for _ in range(8)]
            for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text"))):
                if held is not None:
                    take(out, key != (conv,))
                if key != (conv,):
                    key, state = (conv,), Incremental(render, context)
                held = (conv, role or "", text or "")
            yield made(out)
        if held is not None:
            take(out := [[] for _ in range(8)], True)
            yield made(out)

    rows = turns.select(F.col("conv_id").cast("long"), "turn", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return rows.select("conv_id", "role", "text").mapInArrow(run, FORMATTED)


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, rewritten boolean"


def digests(pieces: DataFrame) -> DataFrame:
    """One row a conversation, read back from the pieces alone, as they come from formatted (no shuffle between them)."""

    def run(batches):
        key, held = None, None

        def close():
            conv, n, turns, chars, loss, size, rewritten = held
            return conv, n, turns.hexdigest(), chars, loss.hexdigest(), size, rewritten

        for batch in slices(batches):
            rows = []
            for conv, piece, start, end, loss, rewritten in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "piece", "text_start", "text_end", "loss", "rewritten"))):
                if key != (conv,):
                    if held:
                        rows.append(close())
                    key, held = (conv,), [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, False]
                for role, text in parse(piece):
                    held[1] += 1
                    held[2].update(f"{role}\n{text}\n".encode())
                if loss:
                    text = unescape(piece[start:end])
                    held[3] += len(text)
                    held[4].update(text.encode())
                held[5] += len(piece)
                held[6] = held[6] or rewritten
            yield _digest_batch(rows)
        if held:
            yield _digest_batch([close()])

    return pieces.mapInArrow(run, DIGESTS)


def _digest_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]
    cols = list(zip(*rows)) or [()] * 7
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "rewritten"])
