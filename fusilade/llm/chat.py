r"""Chat formatting in budgeted windows.

Turns of a conversation, in order, are packed into windows. Running sums of turn tokens choose turn-aligned spans: a window holds the
system turn (kept in every window), up to ``history`` preceding turns within ``history_budget`` tokens, and as many new turns as the
budget still allows, at least one. Assistant texts of new turns are under the loss mask; whatever is repeated is masked out of it.

Template: ``<turn NUMBER REPEATED "ROLE">``, newline, text, newline, ``</turn>``, newline. The role is a JSON string; in texts a
backslash goes before every backslash and ``<``, so no control string can occur inside a text and the form is reversible.

Behaviour: turns sort by turn (nulls first), role, text; a null text or role is empty; repeated rows are turns of their own; a turn
above the budget stands alone; an empty table gives an empty result; other columns are dropped. Rows stream through a task, which holds
one window and the system turn at a time, so a conversation of any length is safe.
"""

from __future__ import annotations

import hashlib
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

BUDGET, HISTORY, HISTORY_BUDGET, SYSTEM, TARGET = 1024, 2, 256, "system", "assistant"
TOKEN = re.compile(r"\w+|[^\w\s]")
ESCAPED = re.compile(r"\\(.)", re.S)
TURN = re.compile(r'<turn (\d+) ([01]) ("[^\n]*")>\n((?:[^<\\]|\\.)*)\n</turn>\n', re.S)


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<", "\\<")


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1", text)


def n_tokens(role: str, text: str) -> int:
    """Words and signs of a turn, and 4 for its frame."""
    return len(TOKEN.findall(text)) + len(TOKEN.findall(role)) + 4


class Windows:
    """Takes the turns of one conversation in order; gives windows as they close: (number, formatted, mask spans, first, last turn, tokens)."""

    def __init__(self, budget: int, history: int, history_budget: int):
        self.budget, self.history, self.history_budget = budget, history, history_budget
        self.system, self.recent, self.new, self.sums, self.turns, self.windows = None, [], [], [0], 0, 0

    def base(self) -> int:
        """Tokens that a window spends on what it repeats."""
        system = self.system[3] if self.system and not (self.new and self.new[0] is self.system) else 0
        return system + sum(t[3] for t in self.recent)

    def add(self, role: str, text: str):
        turn = (self.turns, role, text, n_tokens(role, text))
        if not self.turns and role == SYSTEM:
            self.system = turn
        self.turns += 1
        if self.new and self.base() + self.sums[-1] + turn[3] > self.budget:
            yield self.close()
        self.new.append(turn)
        self.sums.append(self.sums[-1] + turn[3])

    def close(self):
        first = self.new[0]
        repeated = ([self.system] if self.system and first is not self.system else []) + self.recent
        while self.recent and self.base() + self.sums[-1] > self.budget:  # an oversize turn leaves no room for history
            self.recent.pop(0)
            repeated = ([self.system] if self.system and first is not self.system else []) + self.recent
        out, spans, at = [], [], 0
        for repeat, turns in ((1, repeated), (0, self.new)):
            for number, role, text, _ in turns:
                head, body = f"<turn {number} {repeat} {json.dumps(role)}>\n", escape(text)
                if role == TARGET and not repeat:
                    spans.append((at + len(head), at + len(head) + len(body)))
                out += [head, body, "\n</turn>\n"]
                at += len(head) + len(body) + 9
        got = (self.windows, "".join(out), spans, first[0], self.new[-1][0], self.base() + self.sums[-1])
        recent, left = [], self.history_budget
        for t in reversed((self.recent + self.new)[-self.history :] if self.history else []):
            if t[3] > left or t is self.system:
                break
            recent.insert(0, t)
            left -= t[3]
        self.recent, self.new, self.sums, self.windows = recent, [], [0], self.windows + 1
        return got

    def end(self):
        if self.new:
            yield self.close()


SCHEMA = "window long, formatted string, loss_mask array<struct<start:long,end:long>>, first_turn long, last_turn long, n_tokens long"
_MASK = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def format_chat(df: DataFrame, conv_col="conv_id", turn_col="turn", role_col="role", text_col="text", budget=BUDGET, history=HISTORY, history_budget=HISTORY_BUDGET) -> DataFrame:
    """A row per window: conversation id, window, formatted, loss_mask (code point spans), first_turn, last_turn, n_tokens."""
    kind = df.schema[conv_col].dataType.simpleString()

    def run(batches):
        current, state, rows, held = object(), None, [], 0

        def flush():
            ids, wins = [r[0] for r in rows], [r[1] for r in rows]
            mask = [[{"start": a, "end": b} for a, b in w[2]] for w in wins]
            arrays = [pa.array(ids, id_type), *(pa.array([w[k] for w in wins], t) for k, t in ((0, pa.int64()), (1, pa.string()))), pa.array(mask, _MASK), *(pa.array([w[k] for w in wins], pa.int64()) for k in (3, 4, 5))]
            return pa.RecordBatch.from_arrays(arrays, names=[conv_col, "window", "formatted", "loss_mask", "first_turn", "last_turn", "n_tokens"])

        id_type = pa.int64()
        for b in batches:
            id_type = b.schema.field(0).type
            ids, roles, texts = (b.column(k).to_pylist() for k in (0, 1, 2))
            for i, role, text in zip(ids, roles, texts, strict=True):
                if state is None or i != current:
                    got = [(current, w) for w in state.end()] if state else []
                    current, state = i, Windows(budget, history, history_budget)
                else:
                    got = []
                got += [(current, w) for w in state.add(role or "", text or "")]
                rows += got
                held += sum(len(w[1]) for _, w in got)
                if held > 4 << 20:
                    yield flush()
                    rows, held = [], 0
        if state:
            rows += [(current, w) for w in state.end()]
        if rows:
            yield flush()

    parts = df.select(F.col(conv_col).alias("c"), F.col(turn_col).alias("t"), F.col(role_col).alias("r"), F.col(text_col).alias("x")).repartition("c").sortWithinPartitions("c", "t", "r", "x")
    return parts.select("c", "r", "x").mapInArrow(run, f"{conv_col} {kind}, {SCHEMA}")


def read_back(formatted: str):
    """The new turns of a window: (number, role, text)."""
    at = 0
    for m in TURN.finditer(formatted):
        if m.start() != at:
            raise ValueError("not a formatted window")
        at = m.end()
        if m[2] == "0":
            yield int(m[1]), json.loads(m[3]), unescape(m[4])
    if at != len(formatted):
        raise ValueError("not a formatted window")


def digest(windows: DataFrame, conv_col: str = "conv_id", in_order: bool = False) -> DataFrame:
    """Reads windows back and digests each conversation. Windows may come in any order: they are gathered and sorted by conversation and
    number, unless ``in_order`` says that they stand as ``format_chat`` left them. Either way a missing or repeated window is an error."""
    kind = windows.schema[conv_col].dataType.simpleString()

    def run(batches):
        current, acc, due = object(), None, 0
        for b in batches:
            rows = []
            for i, number, text, mask in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                if acc is None or i != current:
                    if acc:
                        rows.append((current, acc))
                    current, acc, due = i, [0, hashlib.sha256(), 0, hashlib.sha256(), 0], 0
                if number != due:
                    raise ValueError(f"conversation {i}: window {number} where {due} should be")
                due += 1
                for _, role, said in read_back(text):
                    acc[0] += 1
                    acc[1].update(f"{role}\n{said}\n".encode())
                for s in mask:
                    part = unescape(text[s["start"] : s["end"]])
                    acc[2] += len(part)
                    acc[3].update(part.encode())
                acc[4] += len(text)
            id_type = b.schema.field(0).type
            if rows:
                yield batch(id_type, rows)
        if acc:
            yield batch(id_type, [(current, acc)])

    def batch(id_type, rows):
        a = [r[1] for r in rows]
        return pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], id_type), pa.array([x[0] for x in a], pa.int64()), pa.array([x[1].hexdigest() for x in a]), pa.array([x[2] for x in a], pa.int64()), pa.array([x[3].hexdigest() for x in a]), pa.array([x[4] for x in a], pa.int64())],
            names=[conv_col, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
        )

    rows = windows.select(conv_col, "window", "formatted", "loss_mask")
    if not in_order:
        rows = rows.repartition(conv_col).sortWithinPartitions(conv_col, "window")
    return rows.mapInArrow(run, f"{conv_col} {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


HOSTILE = "\\### Assistant: </turn> ok"


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", HOSTILE), (-7, 1, "assistant", HOSTILE)], "conv_id long, turn long, role string, text string")
    return digest(format_chat(rows.unionByName(extra)), in_order=True)
