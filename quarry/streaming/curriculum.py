"""The ratio curriculum over a stream of training steps: a run's ratio is kept as state."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quarry.operators.scans import UNIT, in_units


def streamed_ratios(steps: DataFrame, run: str = "run", step: str = "step", passed: str = "pass_rate", start: float = 0.2, least: float = 0.2, most: float = 0.2, alpha: float = 0.02) -> DataFrame:
    """(run, step, ratio) of a stream, as scans.ratio_curriculum has them over the whole of it.

    A run's steps must come in order over the micro-batches; within one they are sorted.
    Steps up to the last one seen are taken for repeats and left out, so that a restart
    or a source that sends twice changes nothing.
    """
    first, low, high, move = (in_units(v) for v in (start, least, most, alpha))
    kind = steps.schema[run].dataType.simpleString()

    def fold(key, parts, state: GroupState):
        ratio, last = state.get if state.exists else (first, None)
        rows = pd.concat(list(parts), ignore_index=True).sort_values("step")
        out = []
        for s, rate in zip(rows["step"], rows["rate"], strict=True):
            if last is not None and s <= last:
                continue
            ratio, last = max(low, min(high, ratio + (-move if rate > 0.5 else move))), int(s)
            out.append((key[0], last, ratio / UNIT))
        if last is not None:
            state.update((ratio, last))
        yield pd.DataFrame(out, columns=["run", "step", "ratio"])

    slim = steps.select(F.col(run).alias("run"), F.col(step).cast("long").alias("step"), F.coalesce(F.col(passed).cast("double"), F.lit(0.0)).alias("rate"))
    return slim.groupBy("run").applyInPandasWithState(fold, f"run {kind}, step long, ratio double", "ratio long, last long", "append", GroupStateTimeout.NoTimeout)
