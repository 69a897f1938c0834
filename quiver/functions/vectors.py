"""Vector column expressions (all JVM-side higher-order functions).

Vectors are ``ARRAY<FLOAT>`` or ``ARRAY<DOUBLE>`` columns; arithmetic is done
in DOUBLE. Functions that need a per-row scalar inside a lambda (a norm, a
weight) come in a DataFrame form (``with_*``) that first projects the scalar
into its own column: an outer expression referenced inside a lambda is
re-evaluated for every element, which would make normalisation O(d^2).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ColumnOrName = Column | str

# Fixed values.
NORM_EPS = 1e-6          # eps of the eps-clamped normalisation
SCORE_DIGITS = 6         # scores are ranked after rounding to 6 places


def _c(x: ColumnOrName) -> Column:
    return F.col(x) if isinstance(x, str) else x


def as_double(v: ColumnOrName) -> Column:
    """Widening cast (float vectors are stored, double vectors are computed)."""
    return _c(v).cast("array<double>")


def sum_array(v: ColumnOrName) -> Column:
    return F.aggregate(_c(v), F.lit(0.0).cast("double"), lambda acc, x: acc + x)


def dot(a: ColumnOrName, b: ColumnOrName) -> Column:
    """Inner product, accumulated in DOUBLE."""
    return sum_array(F.zip_with(as_double(a), as_double(b), lambda x, y: x * y))


def sq_l2_distance(a: ColumnOrName, b: ColumnOrName) -> Column:
    return sum_array(F.zip_with(as_double(a), as_double(b), lambda x, y: (x - y) * (x - y)))


def l2_norm(v: ColumnOrName) -> Column:
    return F.sqrt(sum_array(F.transform(as_double(v), lambda x: x * x)))


def scale(v: ColumnOrName, s: ColumnOrName) -> Column:
    """v * s for a scalar column ``s`` (project ``s`` first if it is an expression)."""
    return F.transform(as_double(v), lambda x: x * _c(s))


def vec_add(a: ColumnOrName, b: ColumnOrName) -> Column:
    return F.zip_with(as_double(a), as_double(b), lambda x, y: x + y)


def fuse_sum(img: ColumnOrName, txt: ColumnOrName) -> Column:
    """Sum fusion: img + txt (commutative)."""
    return vec_add(img, txt)


def clamp01(x: ColumnOrName) -> Column:
    return F.least(F.greatest(_c(x).cast("double"), F.lit(0.0)), F.lit(1.0))


def fuse_weighted(img: ColumnOrName, txt: ColumnOrName, text_weight: float | Column) -> Column:
    """Weighted fusion ``w*txt + (1-w)*img`` with ``w`` clamped to [0, 1].

    The learned weight multiplies the *text* vector: the fusion is declared
    (img, txt) but called with (txt, img), and we keep that behaviour.
    """
    w = clamp01(text_weight if isinstance(text_weight, Column) else F.lit(float(text_weight)))
    return F.zip_with(as_double(txt), as_double(img), lambda t, i: w * t + (F.lit(1.0) - w) * i)


def mask_gate(v: ColumnOrName, mask: ColumnOrName) -> Column:
    """Zero a vector whose modality is missing (gate after encoding)."""
    return F.transform(as_double(v), lambda x: x * _c(mask).cast("double"))


def round_score(s: ColumnOrName) -> Column:
    return F.round(_c(s), SCORE_DIGITS)


# ---- DataFrame forms (scalar projected once per row) -------------------------

def with_l2_normalized(df: DataFrame, src: str, dst: str | None = None) -> DataFrame:
    """Zero-safe L2 normalisation: a zero vector stays zero (so all its scores are 0)."""
    dst = dst or src
    n = "__quiver_norm"
    return (df.withColumn(n, l2_norm(src))
              .withColumn(dst, F.when(F.col(n) > 0, F.transform(as_double(src), lambda x: x / F.col(n)))
                                .otherwise(as_double(src)))
              .drop(n))


def with_l2_normalized_eps(df: DataFrame, src: str, dst: str | None = None, eps: float = NORM_EPS) -> DataFrame:
    """L2 normalisation dividing by max(norm, eps)."""
    dst = dst or src
    n = "__quiver_norm"
    return (df.withColumn(n, F.greatest(l2_norm(src), F.lit(float(eps))))
              .withColumn(dst, F.transform(as_double(src), lambda x: x / F.col(n)))
              .drop(n))


def dim_stats(df: DataFrame, vec: str) -> DataFrame:
    """One row: min and max vector length and row count (ragged if min != max)."""
    return df.agg(F.min(F.size(vec)).alias("min_dim"), F.max(F.size(vec)).alias("max_dim"),
                  F.count(F.lit(1)).alias("n_rows"))
