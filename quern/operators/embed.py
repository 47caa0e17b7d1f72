"""Embeddings by a model that the caller brings: a function from a batch of inputs to a matrix, a row each."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators.tables import required

Model = Callable[[list], np.ndarray]


def _vectors(found: np.ndarray, rows: int) -> pa.Array:
    found = np.asarray(found, float)
    if found.shape[:1] != (rows,) or found.ndim != 2:
        raise ValueError("the model must give a vector for each input")
    return pa.ListArray.from_arrays(pa.array(np.arange(rows + 1) * found.shape[1], pa.int32()), pa.array(found.ravel()))


def embedded_tracks(windows: DataFrame, model: Model, size: int | None = None) -> DataFrame:
    """track_id, window and vector. A track's windows are one batch of the model, in order, so that the result does not depend
    on what else a worker has at hand; a track has a bounded number of windows. Windows of another `size` raise."""
    if size is not None:
        windows = required(windows, F.size("samples") == size, f"a window must have {size} samples")

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("window")
        return pa.Table.from_arrays([t.column("track_id"), t.column("window"), _vectors(model(t.column("samples").to_pylist()), t.num_rows)], names=["track_id", "window", "vector"])

    return windows.select("track_id", "window", "samples").groupBy("track_id").applyInArrow(run, f"track_id {windows.schema['track_id'].dataType.simpleString()}, window {windows.schema['window'].dataType.simpleString()}, vector array<double>")


def embedded_texts(texts: DataFrame, model: Model) -> DataFrame:
    """id and vector of each text that is not blank, in Arrow batches."""

    def run(batches):
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column("id"), _vectors(model(b.column("text").to_pylist()), b.num_rows)], names=["id", "vector"])

    rows = texts.select("id", "text").filter(F.trim("text") != "")
    return rows.mapInArrow(run, f"id {texts.schema['id'].dataType.simpleString()}, vector array<double>")
