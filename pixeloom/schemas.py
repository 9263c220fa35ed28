"""Column types of the tables; the key of pixel tables is (image_id, y, x)."""

from __future__ import annotations

from pyspark.sql import types as T

_INT, _LONG = T.IntegerType(), T.LongType()


def _struct(**columns: T.DataType) -> T.StructType:
    out = T.StructType()
    for name, kind in columns.items():
        out = out.add(name, kind)
    return out


PIXELS_RGB = _struct(image_id=_LONG, y=_INT, x=_INT, r=_INT, g=_INT, b=_INT)
PIXELS = _struct(image_id=_LONG, y=_INT, x=_INT, l=_INT, a=_INT, b=_INT)
CLUSTERS = _struct(image_id=_LONG, k=_INT, cx=_INT, cy=_INT, l=_INT, a=_INT, b=_INT, num_members=_LONG)
ASSIGNMENTS = _struct(image_id=_LONG, y=_INT, x=_INT, k=_INT, min_dist=_INT)
COMPONENTS = _struct(image_id=_LONG, comp=_LONG, leader=_LONG, members=_LONG)
LABELS = _struct(image_id=_LONG, y=_INT, x=_INT, label=_INT)
LUT = _struct(i=_INT, j=_INT, d=_INT)
