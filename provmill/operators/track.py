"""Documents built step by step from editor buffers.

A session is a sequence of operations: init, step, visit, note, annotate.  The
state holds the text of each known buffer sequence number, the step that each
number stands for, the head and the number of steps.
"""

from __future__ import annotations

import difflib
from collections.abc import Iterable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame

OPERATION = "session string, n long, op string, seq long, parent_seq long, content string, actor string, ts string, intent string, source string"
STEP = "session string, pos int, step_id string, parents array<string>, actor string, ts string, diff string, intent string, source string, head boolean, error string"


def unified_diff(old: str, new: str) -> str | None:
    """Hunks with three lines of context, without file headers; null if the texts are equal."""
    if old == new:
        return None
    out = []
    for line in difflib.unified_diff(old.splitlines(keepends=True), new.splitlines(keepends=True), n=3):
        if not line.startswith(("--- ", "+++ ")) or out:
            out.append(line if line.endswith("\n") else line + "\n\\ No newline at end of file\n")
    return "".join(out)


@dataclass
class State:
    actor: str = "human:unknown"
    buffers: dict[int, str] = field(default_factory=dict)
    step_of: dict[int, str] = field(default_factory=dict)
    count: int = 0
    head: str | None = None


@dataclass
class Step:
    step_id: str
    parents: list[str]
    actor: str
    ts: str
    diff: str
    intent: str | None = None
    source: str | None = None


def apply(state: State, op: dict, steps: dict[str, Step]) -> str | None:
    """Apply one operation; the result is an error or null.  New steps and changes of steps go to ``steps``."""
    kind, seq, parent = op["op"], op["seq"], op["parent_seq"]
    content = op["content"] or ""
    if kind == "init":
        state.buffers, state.step_of, state.head, state.count = {0: content}, {0: ""}, None, 0
        state.actor = op["actor"] or state.actor
    elif kind in ("step", "visit"):
        if seq in state.step_of and kind == "step" or seq in state.buffers and kind == "visit" and seq in state.step_of:
            return None
        if kind == "visit":
            state.buffers.setdefault(seq, content)
            state.step_of.setdefault(seq, state.step_of.get(parent, ""))
            return None
        if parent not in state.buffers:
            return f"unknown parent sequence {parent}"
        diff = unified_diff(state.buffers[parent], content)
        state.buffers[seq] = content
        origin = state.step_of.get(parent, "")
        if diff is None:
            state.step_of[seq] = origin
            return None
        state.count += 1
        new = Step(f"step-{state.count:03d}", [origin] if origin else [], op["actor"] or state.actor, op["ts"] or "", diff, op["intent"], op["source"])
        steps[new.step_id] = new
        state.step_of[seq] = state.head = new.step_id
    elif kind in ("note", "annotate"):
        target = state.head
        if target is None or target not in steps:
            return "no step to write to"
        steps[target].intent = op["intent"] or steps[target].intent
        steps[target].source = op["source"] or steps[target].source
    else:
        return f"unknown operation {kind}"
    return None


def _clean(row: dict) -> dict:
    return {k: None if not isinstance(v, list) and pd.isna(v) else int(v) if k in ("seq", "parent_seq", "n") else v for k, v in row.items()}


def fold(session: str, operations: Iterable[dict]) -> pd.DataFrame:
    state, steps, failed = State(), {}, []
    for op in operations:
        error = apply(state, _clean(op), steps)
        if error:
            failed.append(error)
    rows = [(session, i, s.step_id, s.parents, s.actor, s.ts, s.diff, s.intent, s.source, s.step_id == state.head, None) for i, s in enumerate(steps.values())]
    rows += [(session, None, None, None, None, None, None, None, None, False, e) for e in failed]
    return pd.DataFrame(rows, columns=[c.split()[0] for c in STEP.split(", ")]).astype({"pos": "Int32"})


def sessions(operations: DataFrame) -> DataFrame:
    """The steps of all sessions, and a row with an error for each operation that failed.

    A session is folded in one task, operation by operation, in order of n.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return fold(pdf["session"].iloc[0], pdf.sort_values("n").to_dict("records"))

    return operations.groupBy("session").applyInPandas(run, STEP)
