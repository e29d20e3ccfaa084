"""Forecasts whose state is updated by actuals as they arrive, in Spark's state store.

A model's path of ``horizon`` steps is made when a block begins, from the values known then; the
block's actuals are answered with it one by one and join the known values, and the next block begins
from those.  The known values, the path and the place in it are keyed state, so a query that stops in
mid-block goes on after a restart from its checkpoint with the same rows as one that never stopped.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..config import TARGET, TIMESTAMP
from ..operators.models import SeasonalAR

STATE = "last timestamp, known array<double>, path array<double>, step int, block int"


def fitted_states(train: DataFrame, period: int = 24, series: list[str] = (), target: str = TARGET) -> DataFrame:
    """``(series..., model)``: the seasonal model of each series as text, with the values that its lags look back on."""
    keys = list(series)
    kinds = "".join(f"`{k}` {train.schema[k].dataType.simpleString()}, " for k in keys)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        y = pdf.sort_values(TIMESTAMP)["y_"].to_numpy(float)
        m = SeasonalAR(period).fit(y)
        body = json.dumps({"lags": list(m.lags), "beta": [float(b) for b in m.beta], "known": [float(v) for v in y[-max([*m.lags, 1]) :]]})
        return pdf[keys].iloc[:1].assign(model=body)

    rows = train.select(*keys, TIMESTAMP, F.col(target).cast("double").alias("y_"))
    return rows.groupBy(*(keys or [F.lit(0).alias("one")])).applyInPandas(fit, f"{kinds}model string")


def state_updating_forecast(actuals: DataFrame, models: DataFrame, horizon: int = 24, series: list[str] = (), target: str = TARGET) -> DataFrame:
    """``(series..., timestamp, actual, predicted, origin_block, horizon_step)`` of a stream of actuals.

    ``models``: a table from ``fitted_states``.  Actuals of a series come in order from batch to batch,
    in any order inside one; rows that aren't later than the last answered one, such as rows sent
    twice, give nothing.  Rows with a null time or value are left out; series without a model too.
    """
    keys = list(series)
    rows = actuals.select(*keys, F.col(TIMESTAMP).cast("timestamp").alias(TIMESTAMP), F.col(target).cast("double").alias("y_")).filter(F.col(TIMESTAMP).isNotNull() & F.col("y_").isNotNull())
    met = rows.join(F.broadcast(models), keys) if keys else rows.join(F.broadcast(models))  # a row per series
    by = keys or ["one_"]
    met = met if keys else met.withColumn("one_", F.lit(0))
    names = [*keys, TIMESTAMP, "actual", "predicted", "origin_block", "horizon_step"]
    kinds = "".join(f"`{k}` {actuals.schema[k].dataType.simpleString()}, " for k in keys)

    def answer(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(batches)).sort_values(TIMESTAMP)
        model = json.loads(pdf["model"].iloc[0])
        last, known, path, step, block = state.get if state.exists else (None, model["known"], [], 0, 0)
        known, path = list(known), list(path)
        ar = SeasonalAR()
        ar.lags, ar.beta = model["lags"], model["beta"]
        out = []
        for at, y in zip(pdf[TIMESTAMP], pdf["y_"]):
            if last is not None and at <= pd.Timestamp(last):
                continue
            if step == len(path):
                path, step, block = ar.forecast(np.array(known), horizon).tolist(), 0, block + 1
            step += 1
            out.append((*(key if keys else ()), at, float(y), path[step - 1], block, step))
            known = [*known[1:], float(y)]
            last = at
        if last is not None:
            state.update((pd.Timestamp(last).to_pydatetime(), known, path, step, block))
        yield pd.DataFrame(out, columns=names)

    return met.groupBy(*by).applyInPandasWithState(answer, f"{kinds}timestamp timestamp, actual double, predicted double, origin_block int, horizon_step int", STATE, "append", GroupStateTimeout.NoTimeout)
