"""Images as rows of grey values: orientation, grey conversion, hash checks. Decoding files is a parameter of the readers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names of orientations.
ORIENTATIONS = ("none", "identity", "ccw90", "cw90", "180")


def _turned(rows: Column, clockwise: bool) -> Column:
    columns = F.sequence(F.lit(0), F.size(rows[0]) - 1)
    order = rows if not clockwise else F.reverse(rows)
    return F.transform(columns if clockwise else F.reverse(columns), lambda c: F.transform(order, lambda r: F.get(r, c)))


def orient(rows: Column, transform: Column, strict: bool = False) -> Column:
    """The image turned as its camera's transform says. Unknown names leave it as it is, or are an error with ``strict``, which knows none and ccw90 only."""
    plain = transform.isin("none") if strict else F.lit(True)
    out = F.when(transform == "ccw90", _turned(rows, False))
    if strict:
        return out.when(plain, rows).otherwise(F.raise_error(F.concat(F.lit("unknown transform "), F.coalesce(transform, F.lit("null")))).cast("array<array<double>>"))
    return out.when(transform == "cw90", _turned(rows, True)).when(transform == "180", F.reverse(F.transform(rows, F.reverse))).otherwise(rows)


def grey(red: Column, green: Column, blue: Column) -> Column:
    """Luma of 8-bit colours, in whole numbers."""
    return F.floor((red * 19595 + green * 38470 + blue * 7471 + 32768) / 65536).cast("int")


def verified(content: Column, sha256: Column) -> Column:
    """The content, failing at run time where its digest is another."""
    return F.when(F.sha2(content, 256) == sha256, content).otherwise(F.raise_error(F.lit("an image has another digest than recorded")).cast("binary"))
