"""Edge keys: from|to|kind."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cairnlake.schemas import EDGE_KINDS


def edge_key(source: Column, target: Column, kind: Column) -> Column:
    return F.concat_ws("|", source, target, kind)


def parse_edge_key(key: Column) -> Column:
    """struct(from, to, kind), read from the right; null for anything but three valid parts."""
    parts = F.split(key, r"\|", -1)
    valid = (F.size(parts) == 3) & (F.get(parts, F.lit(0)) != "") & (F.get(parts, F.lit(1)) != "") & F.get(parts, F.lit(2)).isin(*EDGE_KINDS)
    return F.when(valid, F.struct(F.get(parts, F.lit(0)).alias("from"), F.get(parts, F.lit(1)).alias("to"), F.get(parts, F.lit(2)).alias("kind")))
