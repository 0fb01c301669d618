"""Alert commands as a stream: an alert's commands may come out of order (H3)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tarnlight.operators.alerts import DRY_RUN

OUTPUT = "alert_id string, status string, recipient bigint, note string, errors int, commands bigint"
_FOLDED = "status string, recipient bigint, note string, errors int, commands bigint"
_COMMAND = "command string, authority_id bigint, reason string, at bigint"


def step(state: tuple, command: str, authority_id: int | None, reason: str | None) -> tuple:
    """(status, recipient, note, errors) after one command; the same rules as ``alerts.apply_command``."""
    status, recipient, note, errors = state
    if command == "assign":
        return status, authority_id, None, errors
    if command == "dismiss":
        return "dismissed", recipient, "Dismissed" if reason is None else reason, errors
    if command == "send" and status != "sent":
        return (status, recipient, note, errors + 1) if status == "dismissed" or recipient is None else ("sent", recipient, DRY_RUN, errors)
    return state


class AlertStates(StatefulProcessor):
    """Keeps of each alert a folded state and, by number, the commands that an earlier one may still come before.

    When the watermark has passed a command's time, no command of that time can come any more; commands are folded and
    forgotten up to the last one such that it and all before it are as old. Each batch puts out the state with all commands
    so far in the order of their numbers.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.folded = handle.getValueState("folded", _FOLDED)
        self.waiting = handle.getMapState("waiting", "seq bigint", _COMMAND)

    def _begin(self) -> tuple[tuple, int]:
        got = self.folded.get() if self.folded.exists() else None
        return (("pending_review", None, None, 0), 0) if got is None else (tuple(got[:4]), got[4])

    def _state(self) -> tuple:
        state, n = self._begin()
        waiting = sorted((k[0], v) for k, v in self.waiting.iterator())
        for _, (command, authority_id, reason, _) in waiting:
            state, n = step(state, command, authority_id, reason), n + 1
        return (*state, n)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        for part in rows:
            for seq, command, authority, reason, at in zip(part["seq"], part["command"], part["authority_id"], part["reason"], part["at"], strict=True):
                none = lambda v: None if pd.isna(v) else v
                ms = int(pd.Timestamp(at).timestamp() * 1000)
                self.waiting.updateValue((int(seq),), (none(command), None if pd.isna(authority) else int(authority), none(reason), ms))
                self.handle.registerTimer(ms + 1)
        state = self._state()
        yield pd.DataFrame([(key[0], *state)], columns=["alert_id", "status", "recipient", "note", "errors", "commands"]).astype({"recipient": "Int64", "errors": "int32", "commands": "int64"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        passed = timerValues.getCurrentWatermarkInMs()
        state, n = self._begin()
        for (seq,), (command, authority_id, reason, at) in sorted((tuple(k), tuple(v)) for k, v in self.waiting.iterator()):
            if at >= passed:
                break
            state, n = step(state, command, authority_id, reason), n + 1
            self.waiting.removeKey((seq,))
        self.folded.update((*state, n))
        return iter(())

    def close(self) -> None:
        pass


def alert_states(commands: DataFrame, late: str = "1 day") -> DataFrame:
    """H3 as a stream of (alert_id, seq, command, authority_id, reason, at): after each batch the state of the alerts it touched.

    Runs with the update mode and the RocksDB state store. A command that comes again under its number replaces itself; one
    that comes later than ``late`` after the newest is dropped.
    """
    marked = commands.selectExpr("cast(alert_id as string) alert_id", "cast(seq as bigint) seq", "command", "cast(authority_id as bigint) authority_id", "reason", "cast(at as timestamp) at")
    keyed = marked.where("alert_id is not null and seq is not null").withWatermark("at", late).groupBy("alert_id")
    return keyed.transformWithStateInPandas(AlertStates(), OUTPUT, "update", "eventTime")
