"""Chat formatting in budgeted windows.

Turns of a conversation have token counts; their prefix sums choose, for each window, a span of whole turns that fits the
budget. A window holds the leading system turn, then up to ``HISTORY`` tokens of turns that were new in the window
before, then new turns. Only assistant texts of new turns are under the loss mask: a repeated target is masked, so each
is learnt once. A turn that exceeds the budget alone gets a window of its own, never cut.

Template, one line for each mark: ``<<SYS>>``...``<</SYS>>`` system, ``[INST]``...``[/INST]`` user, ``<s>``...``</s>``
assistant, ``[ROLE]`` role ``[TEXT]`` text ``[/ROLE]`` any other role. Escaping: a mark inside a text, with the
backslashes before it, gets one backslash more; reading back takes one off. Marks of the template follow a line end, so
a text that ends in a backslash cannot escape them.

Defined results: a null text or role is empty; turns are ordered by turn (nulls first), then role and text, so equal
turn numbers give a fixed order and repeated rows are repeated turns; a null conv_id is a conversation of its own. Extra
columns are ignored; an empty table gives an empty result. A conversation's turns are streamed in order, holding one
window at a time, whatever its length.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship

BUDGET, HISTORY = 384, 96
MARKS = ("<<SYS>>", "<</SYS>>", "[INST]", "[/INST]", "<s>", "</s>", "[ROLE]", "[TEXT]", "[/ROLE]")
_ANY = "|".join(map(re.escape, MARKS))
_ESCAPE, _UNESCAPE = re.compile(rf"\\*(?:{_ANY})"), re.compile(rf"\\(\\*(?:{_ANY}))")
_TURN = re.compile(r"<<SYS>>\n(.*?)\n<</SYS>>\n|\[INST\]\n(.*?)\n\[/INST\]\n|<s>\n(.*?)\n</s>\n|\[ROLE\]\n(.*?)\n\[TEXT\]\n(.*?)\n\[/ROLE\]\n", re.S)
_OPEN = {"system": ("<<SYS>>\n", "\n<</SYS>>\n"), "user": ("[INST]\n", "\n[/INST]\n"), "assistant": ("<s>\n", "\n</s>\n")}
WINDOWS = "conv_id long, window long, text string, loss array<struct<start:long,end:long>>, repeated long, tokens long"


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(lambda m: m[1], text)


def word_tokens(text: str) -> int:
    """The default token count: words of a text and two marks."""
    return len(text.split()) + 2


def vocabulary_tokens(path: str) -> Callable[[str], int]:
    """Counts tokens by a rank file (base64 token, rank) of a public byte-level vocabulary at ``path``."""
    held: list = []

    def count(text: str) -> int:
        if not held:
            import base64

            import tiktoken

            with open(path, "rb") as lines:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            held.append(tiktoken.Encoding("own", pat_str=r"\s?\S+|\s+", mergeable_ranks=ranks, special_tokens={}))
        return len(held[0].encode_ordinary(text)) + 2

    return count


def turn_text(role: str, text: str) -> tuple[str, int, int]:
    """A turn in the template, and where its escaped text starts and ends."""
    if role in _OPEN:
        before, after = _OPEN[role]
    else:
        before, after = f"[ROLE]\n{escape(role)}\n[TEXT]\n", "\n[/ROLE]\n"
    body = escape(text)
    return before + body + after, len(before), len(before) + len(body)


def read_turns(text: str) -> list[tuple[str, str, int, int]]:
    """Turns of a formatted window: (role, text, start, end), the last two of the escaped text."""
    out, at = [], 0
    while at < len(text):
        m = _TURN.match(text, at)
        if m is None:
            raise ValueError("not a formatted window")
        k = m.lastindex
        role = {1: "system", 2: "user", 3: "assistant"}.get(k) or unescape(m[4])
        out.append((role, unescape(m[k]), m.start(k), m.end(k)))
        at = m.end()
    return out


class _Conversation:
    """The windows of one conversation, from its turns in order."""

    def __init__(self, conv_id: int | None, budget: int, history: int, count: Callable[[str], int]):
        self.conv_id, self.budget, self.history, self.count = conv_id, budget, history, count
        self.system: tuple | None = None
        self.before: list[tuple] = []  # turns that were new in the last window
        self.new: list[tuple] = []
        self.sums = [0]  # prefix sums of the tokens of the new turns
        self.kept: list[tuple] = []  # history that the open window repeats
        self.number, self.first = 0, True

    def add(self, role: str, text: str) -> Iterator[tuple]:
        turn = (role, text, self.count(text))
        if self.new and self._fixed() + self.sums[-1] + turn[2] > self.budget:
            yield self.close()
        if not self.new and not self.first:  # the turn opens a window: history gives way to it
            room = min(self.history, self.budget - (self.system[2] if self.system else 0) - turn[2])
            total, k = 0, len(self.before)
            while k and self.before[k - 1] is not self.system and total + self.before[k - 1][2] <= room:
                k -= 1
                total += self.before[k][2]
            self.kept = self.before[k:]
        if self.first and role == "system":
            self.system = turn
        self.first = False
        self.new.append(turn)
        self.sums.append(self.sums[-1] + turn[2])

    def _fixed(self) -> int:
        again = self.system is not None and not any(t is self.system for t in self.new)
        return (self.system[2] if again else 0) + sum(t[2] for t in self.kept)

    def close(self) -> tuple:
        again = [self.system] if self.system is not None and not any(t is self.system for t in self.new) else []
        old, out, loss, at = [*again, *self.kept], [], [], 0
        for k, (role, text, _) in enumerate([*old, *self.new]):
            piece, a, b = turn_text(role, text)
            if k >= len(old) and role == "assistant":
                loss.append({"start": at + a, "end": at + b})
            out.append(piece)
            at += len(piece)
        row = (self.conv_id, self.number, "".join(out), loss, len(old), self._fixed() + self.sums[-1])
        self.before = [*self.kept, *self.new]
        self.number, self.new, self.sums, self.kept = self.number + 1, [], [0], []
        return row


def _windows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays(
        [pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["conv_id", "window", "text", "loss", "repeated", "tokens"]
    )


def format_chats(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY, count: Callable[[str], int] = word_tokens) -> DataFrame:
    """Turns (conv_id, turn, role, text) to windows (conv_id, window, text, loss spans, repeated turns, tokens); rows of a
    conversation are in one partition, in order of windows."""
    ship(turns.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: _Conversation | None = None
        rows: list[tuple] = []
        size = 0
        for batch in batches:
            for conv_id, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                if open_ is None or open_.conv_id != conv_id:
                    if open_ is not None:
                        rows.append(open_.close())
                    open_ = _Conversation(conv_id, budget, history, count)
                for row in open_.add(role, text):
                    rows.append(row)
                    size += len(row[2])
                if size > 1 << 20:
                    yield _windows(rows)
                    rows, size = [], 0
        if open_ is not None:
            rows.append(open_.close())
        yield _windows(rows)

    empty = F.lit("")
    narrow = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), empty).alias("role"),
        F.coalesce(F.col("text").cast("string"), empty).alias("text")
    )
    return narrow.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(run, WINDOWS)


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long"


def read_back(windows: DataFrame) -> DataFrame:
    """Digests of the conversations that the windows hold, from nothing but the windows, wherever they lie."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in DIGEST.split(", ")]
        kinds = [pa.string() if "sha256" in x else pa.int64() for x in names]
        current: list | None = None

        def done() -> tuple:
            return (current[0], current[1], current[2].hexdigest(), current[3], current[4].hexdigest(), current[5], current[6])

        for batch in batches:
            rows = []
            for conv_id, text, loss, repeated in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "text", "loss", "repeated")), strict=True):
                if current is None or current[0] != conv_id:
                    if current is not None:
                        rows.append(done())
                    current = [conv_id, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                for role, said, _, _ in read_turns(text)[repeated:]:
                    current[1] += 1
                    current[2].update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
                for span in loss:
                    target = unescape(text[span["start"] : span["end"]])
                    current[3] += len(target)
                    current[4].update(target.encode("utf-8", "surrogatepass"))
                current[5] += len(text)
                current[6] += 1
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)
        if current is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(done(), kinds, strict=True)], names)

    rows = windows.select("conv_id", "window", "text", "loss", "repeated")
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "window").mapInArrow(run, DIGEST)
