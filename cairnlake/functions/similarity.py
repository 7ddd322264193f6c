"""Similarity of names, tags and sources; the collision score."""

from __future__ import annotations

import math
import os

from pyspark.sql import Column
from pyspark.sql import functions as F

from cairnlake.functions.text import bigrams, with_values

DEFAULT_THRESHOLD, TOP = 0.65, 3
NAME_WEIGHT, SOURCE_WEIGHT, TAG_WEIGHT = 0.5, 0.25, 0.25
OVERLAP_BONUS = 0.1


def threshold() -> float:
    """The collision threshold: COLLISION_THRESHOLD if it is a finite number, else the default."""
    try:
        value = float(os.environ.get("COLLISION_THRESHOLD", ""))
    except ValueError:
        return DEFAULT_THRESHOLD
    return value if math.isfinite(value) else DEFAULT_THRESHOLD


def dice(a: Column, b: Column, bigrams_a: Column | None = None, bigrams_b: Column | None = None) -> Column:
    """Dice coefficient of bigram sets; 1 for equal strings, 0 if either has fewer than two characters."""
    x, y = bigrams(a) if bigrams_a is None else bigrams_a, bigrams(b) if bigrams_b is None else bigrams_b
    both = F.size(F.array_intersect(x, y)).cast("double")
    return F.when(a == b, F.lit(1.0)).when((F.length(a) < 2) | (F.length(b) < 2), F.lit(0.0)).otherwise(2 * both / (F.size(x) + F.size(y)))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)).cast("double") / F.greatest(union, F.lit(1)))


def ranges_overlap(start_a: Column, end_a: Column, start_b: Column, end_b: Column) -> Column:
    return (start_a <= end_b) & (start_b <= end_a)


def source_overlap(a: Column, b: Column) -> Column:
    """Jaccard of the paths of two arrays of anchors, and 0.1 more (up to 1) if ranges of one file overlap."""

    def overlap(x: Column, y: Column) -> Column:
        same = lambda s, t: (s["file_path"] == t["file_path"]) & ranges_overlap(s["start_line"], s["end_line"], t["start_line"], t["end_line"])
        meets = F.exists(x, lambda s: F.exists(y, lambda t: same(s, t)))
        paths = jaccard(F.transform(x, lambda s: s["file_path"]), F.transform(y, lambda s: s["file_path"]))
        return F.when((F.size(x) == 0) | (F.size(y) == 0), F.lit(0.0)).otherwise(F.least(paths + F.when(meets, OVERLAP_BONUS).otherwise(0.0), F.lit(1.0)))

    return with_values(overlap, a, b)


def tag_overlap(a: Column, b: Column) -> Column:
    return jaccard(a, b)


def best_alias(name: Column, aliases: Column) -> Column:
    """The largest Dice coefficient of ``name`` and an alias; 0 without aliases."""
    return with_values(lambda n, every: F.coalesce(F.array_max(F.transform(every, lambda x: dice(n, x))), F.lit(0.0)), name, aliases)


def collision_score(name: Column, other_name: Column, other_aliases: Column, sources: Column, other_sources: Column, tags: Column, other_tags: Column) -> Column:
    """Half the better of name and alias similarity, a quarter each for sources and tags; only the existing side's aliases count."""
    return NAME_WEIGHT * F.greatest(dice(name, other_name), best_alias(name, other_aliases)) + SOURCE_WEIGHT * source_overlap(sources, other_sources) + TAG_WEIGHT * tag_overlap(tags, other_tags)
