"""Labels carried forward on a stream: the fold of :mod:`annolith.operators.propagation` as a stateful processor."""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import propagation as pg


class _Carrier(StatefulProcessor):
    """One value per sequence: its newest labelled frames, predicted ones among them."""

    def __init__(self, payload: Sequence[str], track: pg.Tracker, rules: pg.Rules):
        self.payload, self.track, self.rules = list(payload), track, rules

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getValueState("kept", "fold binary")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        fold = pg.Fold(self.rules, self.track)
        if self.kept.exists():
            fold.before, fold.here, fold.index, fold.first_target = pickle.loads(self.kept.get()[0])
        frames, out = pd.concat(list(rows)), []
        for row in frames.sort_values(["frame_index", "name"], kind="stable").to_dict("records"):
            late = fold.index is not None and row["frame_index"] < fold.index
            given = row["objects"]
            own = [pg._object(_plain(o)) for o in given] if given is not None else []
            got = None if late else fold.step(row["frame_index"], tuple(row[c] for c in self.payload), own)
            made, counts, sources = got or ([], {}, [])
            out.append((key[0], row["frame_index"], row["name"], late, len(own), sources, pg.predicted_rows(made), counts))
        self.kept.update((pickle.dumps((fold.before, fold.here, fold.index, fold.first_target)),))
        yield pd.DataFrame(out, columns=["seq_id", "frame_index", "name", "late", "existing", "sources", "predicted", "counts"])

    def close(self) -> None:
        """Nothing is held outside the state."""


def _plain(o) -> dict:
    """A struct as pandas gives it, as a dict with a list of dicts."""
    o = o.asDict(recursive=True) if hasattr(o, "asDict") else dict(o)
    points = o.get("kpts")
    o["kpts"] = [p.asDict() if hasattr(p, "asDict") else p for p in points] if points is not None else []
    return o


def carry_forward(stream: DataFrame, payload: Sequence[str], track: pg.Tracker, rules: pg.Rules = pg.Rules()) -> DataFrame:  # noqa: B008
    """One row per frame (seq_id, frame_index, name, payload, objects), with what is predicted for it; empty if it is no target or has no sources.

    Frames of a trigger are taken in order. A frame with an index before one that an earlier trigger had is ``late``: nothing is predicted for
    it and it is no source. The state is ``rules.history`` frames a sequence, kept in the checkpoint, so a stream that is
    begun again goes on as if it hadn't ended. Needs the RocksDB state store.
    """
    kind = stream.schema["seq_id"].dataType.simpleString()
    form = f"seq_id {kind}, frame_index long, name string, late boolean, existing int, sources array<long>, predicted {pg.PREDICTED}, counts map<string, long>"
    return stream.groupBy("seq_id").transformWithStateInPandas(_Carrier(payload, track, rules), form, "append", "none")
