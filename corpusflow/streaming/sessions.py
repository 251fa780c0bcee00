"""Session state on a stream of turns (ST1): the same steps as the batch folds."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from corpusflow.functions.policy import empty_state, step
from corpusflow.operators.sessions import FEATURES, _turn_of
from corpusflow.streaming.state import restart_timer, stateful

CONSTRAINTS = ["region", "named_tenant", "named_name", "deictic", "multi"]
OUTPUT = ("session_id string, turn bigint, language string, source string, text_to_process string, locked string, "
          "first_unambiguous boolean, region_state string, focus_tenant string, focus_name string")
_NAMES = [c.split()[0] for c in OUTPUT.split(", ")]


class FoldSession(StatefulProcessor):
    """The language, region and focus of a session, one value state each; a batch's turns are folded in their order.

    Parts of a batch are kept as plain tuples until the last has come, since turns may come in any order.
    """

    def __init__(self, ttl_ms: int | None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.language = handle.getValueState("language", "locked string, first_unambiguous boolean")
        self.region = handle.getValueState("region", "region string")
        self.focus = handle.getValueState("focus", "tenant string, name string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        turns = []
        for part in rows:
            # names that begin with an underscore arrive as positions
            turns += part.iloc[:, 1:2 + len(CONSTRAINTS) + len(FEATURES)].itertuples(index=False, name=None)
            restart_timer(self.handle, part, self.ttl_ms)
        language = empty_state()
        if self.language.exists():
            language["locked"], language["first_unambiguous"] = self.language.get()
        region = self.region.get()[0] if self.region.exists() else None
        focus, name = self.focus.get() if self.focus.exists() else (None, None)
        out = []
        for turn, found, tenant, tenant_name, deictic, multi, *values in sorted(turns, key=lambda t: t[0]):
            language, code, source, text = step(language, _turn_of(values))
            if found is not None:
                region = found
            if tenant is not None:
                focus, name = tenant, tenant_name
            elif multi and not deictic:
                focus, name = None, None
            out.append([key[0], turn, code, source, text, language["locked"], bool(language["first_unambiguous"]), region, focus, name])
        self.language.update((language["locked"], bool(language["first_unambiguous"])))
        self.region.update((region,))
        self.focus.update((focus, name))
        yield pd.DataFrame(out, columns=_NAMES)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        for state in (self.language, self.region, self.focus):
            state.clear()
        return iter(())

    def close(self) -> None:
        pass


def fold_sessions(turns: DataFrame, ts: str | None = None, ttl_hours: float = 24.0, watermark: str = "1 hour") -> DataFrame:
    """ST1: turns is a stream with the columns of ``language_features`` and ``tag_turns``.

    A few small values per session. With an event time ``ts`` a session is forgotten once the
    watermark is ``ttl_hours`` past its last turn; without one it is kept.
    """
    columns = ["session_id", F.col("turn").cast("long").alias("turn"), *CONSTRAINTS, *FEATURES]
    return stateful(turns, ["session_id"], columns, FoldSession(int(ttl_hours * 3600_000) if ts else None), OUTPUT, ts, watermark)
