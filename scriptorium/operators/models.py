"""Batch model calls with an injected model (M1 M4 M5 M6).

The caller supplies ``make_fn``: a zero-argument factory that loads the
model and returns ``predict(batch) -> list``.  It runs once per Python
worker (cached in the worker process), and each Arrow batch is cut into
calls of ``batch_size`` rows, so a GPU-sized batch never depends on the
partitioning.  Nothing is collected to the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: (factory, model) of this worker: the factory is held, so its identity cannot be taken by another one.
_MODELS: list[tuple[Callable, Callable]] = []
MAX_MODELS = 8


def _model(make_fn: Callable) -> Callable:
    for held, fn in _MODELS:
        if held is make_fn:
            return fn
    fn = make_fn()
    _MODELS.append((make_fn, fn))
    del _MODELS[:-MAX_MODELS]
    return fn


def _to_python(v):
    if isinstance(v, np.ndarray):
        return [_to_python(x) for x in v]
    if isinstance(v, dict):
        return {k: _to_python(x) for k, x in v.items()}
    return v


def model_column(make_fn: Callable, return_type: T.DataType, batch_size: int = 32):
    """A vectorised (iterator-of-batches) pandas UDF around an injected model."""

    @F.pandas_udf(return_type)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        predict = _model(make_fn)
        for s in batches:
            if isinstance(s, pd.DataFrame):     # struct input arrives as columns
                items = [_to_python(v) for v in s.to_dict("records")]
            else:
                items = [_to_python(v) for v in s.tolist()]
            out: list = []
            for i in range(0, len(items), batch_size):
                out.extend(predict(items[i:i + batch_size]))
            yield pd.Series(out, index=s.index)

    return run


def embed(texts: Column, make_fn: Callable, batch_size: int = 256) -> Column:
    """Text -> vector (M1).  ``predict(list[str]) -> list[list[float]]``."""
    return model_column(make_fn, T.ArrayType(T.FloatType()), batch_size)(texts)


def generate(prompts: Column, make_fn: Callable, batch_size: int = 32) -> Column:
    """Messages (array<struct<role,content>>) or text -> generated text (M4 M5 M6)."""
    return model_column(make_fn, T.StringType(), batch_size)(prompts)
