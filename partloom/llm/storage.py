"""Shared tables and row keys."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame

from partloom.operators.common import materialize as written

__all__ = ["free_name", "located", "written"]


def free_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` bears it (Spark's names ignore case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def located(docs: DataFrame) -> tuple[DataFrame, str, str]:
    """``docs`` with the file and the row in it that hold each row, and the names of those two columns.

    The pair tells repeated rows apart and stays the same whenever the table is read.  A frame that
    does not come straight from files is written to the shared folder first.
    """
    file, row = free_name(docs, "_file"), free_name(docs, "_row")

    def keyed(df: DataFrame) -> DataFrame:
        meta = df.metadataColumn("_metadata")
        return df.select(
            *[df[f"`{c}`"] for c in df.columns], meta["file_path"].alias(file), meta["row_index"].alias(row)
        )

    try:
        out = keyed(docs)
        out.schema  # noqa: B018  resolves the plan
    except AnalysisException:
        out = keyed(written(docs, "rows"))
    return out, file, row
