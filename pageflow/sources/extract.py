"""Work that needs Python: running a page extractor and measuring pixels. Arrow batches only."""

from __future__ import annotations

import sys
import types
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructType

from pageflow.schemas import EXTRACTED


# Results held before they are passed on; a page may have thousands of lines.
PAGES_AT_ONCE = 200


def worker_models() -> dict[str, Any]:
    """Models kept by this Python process. Functions arrive by value with fresh globals for every
    task, so the store hangs on the interpreter, not on this module."""
    store = sys.modules.setdefault("pageflow_worker_models", types.ModuleType("pageflow_worker_models"))
    return store.__dict__.setdefault("models", {})


def analyze_pages(
    pages: DataFrame,
    extractor: Callable[[Any, dict], dict],
    init: Callable[[], Any] = lambda: None,
    partitions: int | None = None,
    schema: StructType = EXTRACTED,
) -> DataFrame:
    """Run ``extractor(model, page)`` for every page row; feed the result to ``analyze_orientation``.

    ``init()`` runs once per call and Python worker process (workers are reused); a later call has
    its own model, and the worker lets go of the one before. An exception becomes that page's ``error`` value instead of failing the job.
    ``partitions`` spreads pages evenly when the input has few large splits: extraction, unlike
    the exchange, is the expensive part.
    """
    fields = schema.fieldNames()
    call = uuid.uuid4().hex

    def analyzed(model: Any, batch: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for page in batch.to_dict("records"):
            keys = {k: page[k] for k in ("job_id", "filename", "page")}
            try:
                rows.append({**dict.fromkeys(fields), **extractor(model, page), **keys})
            except Exception as exc:  # noqa: BLE001 - recorded as the page's error
                rows.append({**dict.fromkeys(fields), **keys, "error": str(exc) or type(exc).__name__})
        return pd.DataFrame(rows, columns=fields).astype(
            {f.name: "Int32" for f in schema.fields if f.dataType.simpleString() == "int"}
        )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        models = worker_models()
        if call not in models:
            models.clear()
            models[call] = init()
        model = models[call]
        for whole in batches:
            for start in range(0, len(whole), PAGES_AT_ONCE):
                yield analyzed(model, whole.iloc[start : start + PAGES_AT_ONCE])

    spread = pages.repartition(partitions) if partitions else pages
    return spread.mapInPandas(run, schema)


@F.pandas_udf(DoubleType())
def _dark_share(samples: pd.Series, channels: pd.Series) -> pd.Series:
    def share(raw: bytes | None, ch: int) -> float | None:
        if raw is None:
            return None
        # OCR renders are RGB; alpha and further channels do not count. One channel is grey already.
        px = np.frombuffer(raw, dtype=np.uint8).reshape(-1, ch).astype(np.int32)
        if ch == 1:
            dark = np.count_nonzero(px[:, 0] < 200)
        else:
            # Rounded 0.299 R + 0.587 G + 0.114 B below 200, in whole thousandths.
            dark = np.count_nonzero(px[:, 0] * 299 + px[:, 1] * 587 + px[:, 2] * 114 < 199_500)
        return float(dark) / float(len(px) or 1)

    return pd.Series([share(r, c) for r, c in zip(samples, channels)], dtype="float64")


def ink_ratio(samples: Column, channels: Column) -> Column:
    """Share of pixels whose grey value is below 200; 0 for an empty image."""
    return _dark_share(samples, channels)
