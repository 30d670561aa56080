"""Helpers for pandas frames inside workers."""

from __future__ import annotations

import pandas as pd


def plain_strings(frame: pd.DataFrame) -> pd.DataFrame:
    """Text columns as plain objects: those backed by several Arrow chunks can't be sent back as one array."""
    texts = [c for c, t in frame.dtypes.items() if isinstance(t, pd.StringDtype)]
    return frame.astype(dict.fromkeys(texts, object)) if texts else frame


def local_table(spark, rows: list[tuple], schema: str):
    """A small table of the driver as part of the plan: no job of its own, and small enough to be broadcast without being told."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))
    columns = list(zip(*rows)) if rows else [()] * len(arrow.names)
    return spark.createDataFrame(pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, arrow.types)], schema=arrow))
