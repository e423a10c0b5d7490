"""What operators on vectors share: which rows take part, and vectors of whole numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Quantised components are smaller than this, so that squared distances of vectors of up to 64 components fit in a long.
LARGEST = 1 << 27


def finite_vector(v: str) -> Column:
    """True where the vector is there, not empty, and none of its components is null, NaN or infinite."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return F.col(v).isNotNull() & (F.size(v) > 0) & finite


def floors(v: str, scale: float) -> Column:
    """floor(scale * x) of every component as a long, null where it is not finite; a component that is too large for exact work is
    an error, not another number."""
    large = F.raise_error(F.lit(f"a component times {scale} is beyond {LARGEST}")).cast("bigint")
    scaled = lambda x: F.lit(float(scale)) * x.cast("double")
    finite = lambda x: F.abs(x.cast("double")) < F.lit(float("inf"))
    return F.transform(v, lambda x: F.when(F.abs(scaled(x)) < LARGEST, F.floor(scaled(x)).cast("bigint")).when(finite(x), large))


def usual_length(df: DataFrame, v: str) -> int:
    """The most frequent length of finite vectors, the smaller of equally frequent ones; 0 where there are none."""
    sizes = df.where(finite_vector(v)).groupBy(F.size(v).alias("d")).count()
    first = sizes.orderBy(F.desc("count"), "d").first()
    return 0 if first is None else first.d
