"""Similarity of column names."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _squeezed(name: str) -> str:
    return name.lower().translate(str.maketrans("", "", "_-"))


def score_names(left: str, right: str) -> float:
    """1 for equal names, else the Ratcliff-Obershelp ratio.

    Separators and case are ignored.  Two identifiers are compared without their ``id`` parts,
    unless nothing else is left of one of them.
    """
    a, b = _squeezed(left), _squeezed(right)
    if a == b:
        return 1.0
    stems = [n.replace("id", "") for n in (a, b)]
    if "id" in a and "id" in b and all(stems):
        a, b = stems
    return SequenceMatcher(None, a, b).ratio()


@F.pandas_udf(T.DoubleType())
def name_similarity(left: pd.Series, right: pd.Series) -> pd.Series:
    """Pairs of column names; runs over catalog rows only, never over data rows."""
    return pd.Series([score_names(a, b) for a, b in zip(left, right)], dtype="float64")
