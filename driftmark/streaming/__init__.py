"""Streams of observations."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftmark.operators.movement import Grid, Predictor


def binned_stream(observations: DataFrame, step: str, late: str = "1 day", by: str = "tag_id") -> DataFrame:
    """(by, time, n_obs, total_temperature, deepest) of tumbling bins; observations later than ``late`` are dropped."""
    w = F.window("time", step)
    return observations.withWatermark("time", late).groupBy(by, w).agg(F.count("*").alias("n_obs"), F.sum(F.col("temperature").cast("decimal(18,6)")).alias("total_temperature"), F.max("pressure").alias("deepest")).select(by, F.col("window.start").alias("time"), "n_obs", "total_temperature", "deepest")


def online_forward(emission: DataFrame, initial: DataFrame, grid: DataFrame, predictor: Predictor, sigma: float) -> DataFrame:
    """(tag_id, time, cell_id, states): the forward filter as emission arrives, one field of state a tag.

    emission is a stream of (tag_id, time, pdf), pdf an array over the grid's cells in the order of their ids; steps of
    a tag come in order of time.  A step that isn't later than the last one taken is ignored.  initial (tag_id, p array)
    is collected: a stream's tags are few.
    """
    own = Grid.collect(grid)
    starts = {r["tag_id"]: np.array(r["p"], dtype=float) for r in initial.select("tag_id", "p").collect()}
    kernel = predictor.build(own, sigma)
    tag = emission.schema["tag_id"].dataType.simpleString()

    def step(key: tuple, parts, state):
        if state.exists:
            last, field = state.get
            field = np.frombuffer(field)
        else:
            last, field = None, starts.get(key[0])
        rows = pd.concat(list(parts)).sort_values("time")
        for t, p in zip(rows["time"], rows["pdf"], strict=True):
            micros = int(t.value // 1000)
            if field is None or (last is not None and micros <= last):
                continue
            if last is not None:
                updated = kernel.predict(field) * np.nan_to_num(np.array(p, dtype=float))
                field = updated / updated.sum() if updated.sum() > 0 else updated
            last = micros
            c = np.flatnonzero(field > 0)
            yield pd.DataFrame({"tag_id": key[0], "time": t, "cell_id": own.cell_id[c], "states": field[c]})
        if last is not None:
            state.update((last, field.tobytes()))

    return emission.groupBy("tag_id").applyInPandasWithState(step, f"tag_id {tag}, time timestamp, cell_id bigint, states double", "last bigint, field binary", "append", "NoTimeout")
