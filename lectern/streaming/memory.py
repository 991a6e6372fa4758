"""Conversation memory over a stream of turns: whatever the order of arrival, equal to the batch form.

The state store keeps, per conversation, its turns by position and the memory after the last one.  A micro-batch
sees only its own rows: turns that follow the last position extend the memory; a turn that comes late or again with
another text is put in its place, and the conversation is folded anew from its state.  What changed goes out, the
last batch counts.  One conversation is folded by one task.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from lectern.functions import text as T
from lectern.operators import memory
from lectern.streaming import folders

ROLE_CONTENT = "array<struct<role: string, content: string>>"
STATES = f"conversation_id string, position long, n long, query string, recent_messages {ROLE_CONTENT}, summary string, active_topic string, total long"
_WS = regex.compile(r"[\s\x0b\x1c-\x1f\x85\p{Z}]+")
_TOKEN = regex.compile(T.TOKEN)


def _text(value) -> str | None:
    return value if isinstance(value, str) else None


class Memory:
    """Memory after ``n`` exchanges; ``add`` gives the state row of one more."""

    def __init__(self, saved: str | None = None):
        self.n, self.last, self.user, self.topic, self.summary, self.kept = json.loads(saved) if saved else (0, None, None, None, "", [])

    def saved(self) -> str:
        return json.dumps([self.n, self.last, self.user, self.topic, self.summary, self.kept])

    def turn(self, position: int, role: str | None, content: str | None) -> tuple | None:
        """The next turn in order; a state row where it answers the user turn just before it."""
        asked = self.user if self.last == position - 1 else None
        self.last, self.user = position, [content] if role == "user" else None
        return self._exchange(position - 1, asked[0], content) if role == "assistant" and asked else None

    def _exchange(self, position: int, query: str | None, answer: str | None) -> tuple:
        self.n += 1
        if query is not None and sum(1 for _ in _TOKEN.finditer(query)) >= memory.TOPIC_TOKENS:
            self.topic = query
        self.kept.append([query, None if answer is None else answer[: memory.ANSWER_CHARS]])
        stay = len(self.kept) if self.n <= memory.FULL_MESSAGES // 2 else memory.KEPT_MESSAGES // 2 if self.n % 2 == 0 else memory.FULL_MESSAGES // 2
        for q, a in self.kept[: len(self.kept) - stay]:
            parts = [f"{role}: {_WS.sub(' ', x).strip(' ')[: memory.MESSAGE_CHARS]}" for role, x in (("user", q), ("assistant", a)) if x is not None]
            joined = " | ".join(parts)
            self.summary = (f"{self.summary} | {joined}" if self.summary else joined)[-memory.SUMMARY_CHARS :]
        self.kept = self.kept[len(self.kept) - stay :]
        messages = [{"role": r, "content": x} for pair in self.kept for r, x in zip(("user", "assistant"), pair, strict=True)]
        return position, self.n, query, messages, self.summary, self.topic


class _Remember(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.turns = handle.getMapState("turns", "position long", "role string, content string")
        self.memory = handle.getValueState("memory", "saved string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new: dict[int, tuple] = {}
        for frame in rows:
            for position, role, content in zip(frame["position"], frame["role"], frame["content"], strict=True):
                turn = (_text(role), _text(content))
                known = new.get(int(position))
                new[int(position)] = turn if known is None else max(known, turn, key=lambda t: [(x is not None, x or "") for x in t])
        now = Memory(self.memory.get()[0] if self.memory.exists() else None)
        follows = now.last is None or min(new) > now.last
        if follows:
            todo = new
        else:
            todo = {int(p[0]): (_text(t[0]), _text(t[1])) for p, t in self.turns.iterator()}
            if all(todo.get(p) == t for p, t in new.items()):
                return  # only repeated turns
            now, todo = Memory(), todo | new
        for position, turn in new.items():
            self.turns.updateValue((position,), turn)
        out = [row for position in sorted(todo) if (row := now.turn(position, *todo[position]))]
        self.memory.update((now.saved(),))
        if not out and not follows:
            out = [(None, 0, None, [], "", None)]  # no exchange is left
        if out:
            columns = ["position", "n", "query", "recent_messages", "summary", "active_topic"]
            made = pd.DataFrame({c: list(v) for c, v in zip(columns, zip(*out, strict=True), strict=True)})
            made.insert(0, "conversation_id", key[0])
            made["position"] = made["position"].astype("Int64")
            yield made.assign(total=now.n)

    def close(self) -> None:
        pass


def resolved(rows: DataFrame) -> DataFrame:
    """The last state of every exchange, without those that a later batch took away."""
    columns = [c for c in rows.columns if c not in ("batch", "conversation_id", "n")]
    last = rows.groupBy("conversation_id").agg(F.max_by("total", "batch").alias("_total"))
    states = rows.groupBy("conversation_id", "n").agg(F.max_by(F.struct(*columns), "batch").alias("_row"))
    kept = states.join(last, "conversation_id").filter((F.col("n") <= F.col("_total")) & (F.col("n") > 0))
    return kept.select("conversation_id", "n", "_row.*", F.col("_total")).withColumn("total", F.col("_total")).drop("_total")


def write_states(turns: DataFrame, root: str, checkpoint: str) -> StreamingQuery:
    """Write the memory states of ``conversation_id, position, role, content`` below ``root``."""
    keyed = turns.select("conversation_id", F.col("position").cast("long").alias("position"), "role", "content")
    states = keyed.groupBy("conversation_id").transformWithStateInPandas(_Remember(), STATES, "update", "None")
    return folders.start(states, lambda batch, i: folders.save(batch, i, root, resolved), checkpoint)


def read_states(spark: SparkSession, root: str) -> DataFrame:
    """The states of every conversation as its last batch left them."""
    return folders.read(spark, root, resolved).drop("total")
