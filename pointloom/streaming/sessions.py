"""Session-like behaviour: residency of nodes, frame-over-frame changes, picks, and a streaming form of measurements."""

from __future__ import annotations

import json
from collections import OrderedDict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def lru_trace(frames: DataFrame, budget: int) -> DataFrame:
    """frames (session, frame, node) -> (session, frame, resident, evicted): the counts after each frame.

    Touched nodes go to the front; over the budget the oldest untouched are dropped, so a frame that needs more than the
    budget keeps all it needs. A session's fold is sequential, so one task holds one session's touches.
    """

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        live: OrderedDict[str, None] = OrderedDict()
        out = []
        for frame, own in pdf.sort_values(["frame", "node"]).groupby("frame", sort=True):
            touched = own["node"].tolist()
            for n in touched:
                live[n] = None
                live.move_to_end(n)
            gone, now = 0, set(touched)
            for n in list(live):
                if len(live) <= budget or n in now:
                    break
                del live[n]
                gone += 1
            out.append((pdf["session"].iloc[0], frame, len(live), gone))
        return pd.DataFrame(out, columns=["session", "frame", "resident", "evicted"])

    return frames.groupBy("session").applyInPandas(fold, "session long, frame long, resident long, evicted long")


def active_diff(frames: DataFrame) -> DataFrame:
    """frames (session, frame, node) -> (session, frame, node, change): load where a frame wants a node that the one before
    did not, cull in the frame after the last that wanted it. frame counts 0, 1, 2, ... within a session."""
    order = W.partitionBy("session", "node").orderBy("frame")
    rows = frames.distinct().withColumns({"before": F.lag("frame").over(order), "after": F.lead("frame").over(order)})
    last = F.max("frame").over(W.partitionBy("session"))
    rows = rows.withColumn("last", last)
    load = rows.where("before is null or before < frame - 1").select("session", "frame", "node", F.lit("load").alias("change"))
    cull = rows.where("(after is null or after > frame + 1) and frame < last").select("session", (F.col("frame") + 1).alias("frame"), "node", F.lit("cull").alias("change"))
    return load.union(cull)


def latest_generation(results: DataFrame) -> DataFrame:
    """results (session, generation, value): the value of each session's latest generation; older ones are stale."""
    return results.groupBy("session").agg(F.max("generation").alias("generation"), F.max_by("value", "generation").alias("value"))


def repicks(picks: DataFrame, *what: str) -> DataFrame:
    """picks (session, event_id, ...) that differ in `what` from the session's pick before."""
    order = W.partitionBy("session").orderBy("event_id")
    same = F.lit(True)
    out = picks
    for c in what:
        out = out.withColumn(f"__{c}", F.lag(c).over(order))
        same = same & F.col(f"__{c}").eqNullSafe(F.col(c))
    first = F.row_number().over(order) == 1
    return out.withColumn("__keep", first | ~same).where("__keep").drop("__keep", *[f"__{c}" for c in what])


def measurement_stream(picks: DataFrame, size: int = 2) -> DataFrame:
    """A stream of picks (session, event_id, x, y, z) -> (session, measurement, length): each complete run of `size` picks.

    The open measurement is kept as state, so batches may cut a measurement anywhere.
    """

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        done, open_picks = (state.get[0], json.loads(state.get[1])) if state.exists else (0, [])
        rows = pd.concat(list(batches)).sort_values("event_id")
        out = []
        for r in rows.itertuples():
            open_picks.append([r.x, r.y, r.z])
            if len(open_picks) == size:
                total = sum(sum((a - b) ** 2 for a, b in zip(p, q, strict=True)) ** 0.5 for p, q in zip(open_picks, open_picks[1:], strict=False))
                out.append((key[0], done, total))
                done, open_picks = done + 1, []
        state.update((done, json.dumps(open_picks)))
        yield pd.DataFrame(out, columns=["session", "measurement", "length"])

    return picks.groupBy("session").applyInPandasWithState(update, "session long, measurement long, length double", "done long, open string", "append", GroupStateTimeout.NoTimeout)
