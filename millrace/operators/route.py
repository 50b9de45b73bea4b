"""The two ways out of a pipe."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.model import ERR, RAW, STATUS, VALID, Status


def succeeded(df: DataFrame) -> DataFrame:
    """Records that didn't fail: validated data where there is a model, raw data else."""
    rows = df.filter(F.col(STATUS) != Status.FAILED.value)
    return rows.select(f"{VALID}.*" if VALID in df.columns else f"{RAW}.*")


def failed(df: DataFrame, *, include_errors: bool = False) -> DataFrame:
    """Raw data of records that failed, and on request what was wrong with them."""
    rows = df.filter(F.col(STATUS) == Status.FAILED.value)
    return rows.select(f"{RAW}.*", *([ERR] if include_errors else []))
