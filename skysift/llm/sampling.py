"""Bounded samples by a threshold on the id's hash: no order, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_RANGE = 1 << 31


def hashed_share(share: Column | float, id_col: str = "doc_id") -> Column:
    """True for about this share of ids, the same ones everywhere."""
    limit = (share if isinstance(share, Column) else F.lit(float(share))) * float(_RANGE)
    return F.pmod(F.xxhash64(F.col(id_col), F.lit("sample")), F.lit(_RANGE)) < limit
