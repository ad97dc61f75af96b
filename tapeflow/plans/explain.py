"""Plan text through the public ``DataFrame.explain`` (for checks and reports)."""

from __future__ import annotations

import contextlib
import io

from pyspark.sql import DataFrame


def plan_text(df: DataFrame, mode: str | None = None) -> str:
    """The physical plan as printed by ``df.explain`` (after an action on
    ``df`` this is the final adaptive plan)."""
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode) if mode else df.explain()
    return buf.getvalue()
