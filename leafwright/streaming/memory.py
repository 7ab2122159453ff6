"""Conversation memory over a stream of turns: the incremental form of functions.dialogue's window."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "conv_id long, turn long, n_messages int, n_chars long, summary string"
STATE = "summary string, roles array<string>, texts array<string>"
SALIENT = re.compile(r"(?:-|\*|\d+\.)\s+")


class Memory:
    """The last messages of one conversation and a summary, within a budget, of those before them."""

    def __init__(self, recent: int = 12, most_chars: int = 8000, summary_chars: int = 2000, summary: str = "", messages: list[tuple[str, str]] | None = None):
        self.recent, self.most_chars, self.summary_chars = recent, most_chars, summary_chars
        self.summary, self.messages = summary, list(messages or [])

    def size(self) -> int:
        return len(self.summary) + sum(len(t) for _, t in self.messages)

    def add(self, role: str, text: str) -> None:
        self.messages.append((role, text))
        over = len(self.messages) - self.recent
        if over > 0:
            self._forget(over)
        while len(self.messages) > 2 and self.size() > self.most_chars:
            self._forget(1)

    def _forget(self, n: int) -> None:
        gone, self.messages = self.messages[:n], self.messages[n:]
        lines = [x.strip() for _, t in gone for x in t.splitlines() if x.strip()]
        told = [x for x in lines if SALIENT.match(x) or len(x.split()) >= 8]
        before = self.summary.strip() + "\n" if self.summary else ""
        self.summary = (before + "\n".join(told))[: self.summary_chars]


def remembered(turns: DataFrame, recent: int = 12, most_chars: int = 8000, summary_chars: int = 2000) -> DataFrame:
    """turns: a stream of conv_id, turn, role, text. After each turn, what the memory of its conversation holds."""

    def step(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        summary, roles, texts = state.get if state.exists else ("", [], [])
        memory = Memory(recent, most_chars, summary_chars, summary, list(zip(roles, texts, strict=True)))
        rows = pd.concat(list(batches)).sort_values("turn", kind="stable")
        out = []
        for r in rows.itertuples():
            memory.add(r.role or "unknown", r.text or "")
            out.append((key[0], r.turn, len(memory.messages), memory.size(), memory.summary))
        state.update((memory.summary, [m[0] for m in memory.messages], [m[1] for m in memory.messages]))
        yield pd.DataFrame(out, columns=["conv_id", "turn", "n_messages", "n_chars", "summary"])

    return turns.groupBy("conv_id").applyInPandasWithState(step, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)
