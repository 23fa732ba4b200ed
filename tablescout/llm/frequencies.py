"""In how many documents each hashed feature occurs, counted over all of them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def document_frequencies(docs: DataFrame, text: str, counts: Callable[[str], np.ndarray], width: int) -> tuple[np.ndarray, int]:
    """Documents with each feature, and all documents.  Every task sends one total per feature, so what is
    shuffled and what reaches the driver is bounded by ``width``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = np.zeros(width, np.int64), 0
        for batch in batches:
            for t in batch.column(0).to_pylist():
                seen += counts(t or "") > 0
                n += 1
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(seen[at], n))], ["at", "n"])

    rows = (docs.select(text).mapInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect())
    out, n = np.zeros(width, np.int64), 0
    for r in rows:
        if r["at"] < 0:
            n = r["n"]
        else:
            out[r["at"]] = r["n"]
    return out, n


def inverse(df: np.ndarray, n: int) -> np.ndarray:
    return np.log((1 + n) / (1 + df)) + 1
