"""Model stages: Python callables with an output schema, one model per worker.

A stage is made from a factory that loads the model.  The factory runs in a Python worker, once,
when its first batch arrives; the model then serves all batches and later tasks of that worker.
Where a model fails on a row, the row comes back with what went wrong, and the job goes on.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_MODELS: dict[str, Any] = {}


def model(key: str, factory: Callable[[], Any]) -> Any:
    """This worker's model of that key, loaded at first use."""
    if key not in _MODELS:
        _MODELS[key] = factory()
    return _MODELS[key]


@dataclass(frozen=True)
class Stage:
    """``infer(model, row)`` gives a list of tuples in the order of ``schema``.

    Input columns named in ``keep`` (with their types) stand before them in the output, an ``error``
    column behind them: null, or what ``infer`` raised for that row, the other columns then being null.
    ``variant`` names a column on whose value the model depends (say a language); the factory gets it.
    """

    name: str
    factory: Callable[..., Any]
    infer: Callable[[Any, Any], list[tuple]]
    schema: str
    keep: tuple[tuple[str, str], ...] = (("media_id", "string"),)
    variant: str | None = None
    resources: dict[str, float] = field(default_factory=dict)

    def apply(self, rows: DataFrame) -> DataFrame:
        names = [x.strip().split(" ")[0] for x in _split(self.schema)]
        out_schema = ", ".join([*(f"{n} {t}" for n, t in self.keep), self.schema, "error string"])
        stage = self

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                out = []
                for row in pdf.itertuples(index=False):
                    kept = tuple(getattr(row, n) for n, _ in stage.keep)
                    try:
                        kind = getattr(row, stage.variant) if stage.variant else None
                        own = model(f"{stage.name}:{kind}", (lambda k=kind: stage.factory(k)) if stage.variant else stage.factory)
                        out += [(*kept, *x, None) for x in stage.infer(own, row)]
                    except Exception as e:  # a model's failure is a row's status
                        out.append((*kept, *([None] * len(names)), f"{type(e).__name__}: {e}"))
                yield pd.DataFrame(out, columns=[*(n for n, _ in stage.keep), *names, "error"])

        return rows.mapInPandas(run, out_schema)


def kept(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared checkpoint folder: what follows never runs a model again.

    The folder is ``spark.checkpoint.dir``; where it is unset, as in tests, one beside the warehouse.
    """
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        told = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        context.setCheckpointDir(told or df.sparkSession.conf.get("spark.sql.warehouse.dir") + "-checkpoints")
    return df.checkpoint()


def failures(stage: str, out: DataFrame) -> DataFrame:
    """``media_id, stage, error``: what a stage's rows say went wrong, once each."""
    return out.where("error is not null").select(F.col("media_id"), F.lit(stage).alias("stage"), "error").distinct()


def _split(schema: str) -> list[str]:
    """A DDL schema's columns: commas inside <> do not part them."""
    out, depth, at = [], 0, 0
    for i, c in enumerate(schema):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(schema[at:i])
            at = i + 1
    return [*out, schema[at:]]


def energy_detector(threshold: float = 0.05, frame: int = 512, rate: int = 16_000) -> Stage:
    """A stand-in voice detector: start and end events where a frame's level crosses a threshold.

    Takes rows (media_id, pcm) of whole windows; for tests and as a pattern for real detectors.
    """

    def infer(_, row) -> list[tuple]:
        import numpy as np

        x = np.asarray(row.pcm, np.float32)
        x = np.pad(x, (0, -len(x) % frame)).reshape(-1, frame)
        on = np.concatenate([[False], np.sqrt((x * x).mean(1)) >= threshold])
        turn = np.flatnonzero(on[1:] != on[:-1])
        return [(i, "start" if on[t + 1] else "end", int(round(t * frame * 1000 / rate))) for i, t in enumerate(turn)]

    return Stage("energy", lambda: None, infer, "ord int, kind string, at_ms long")
