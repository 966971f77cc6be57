"""Vector and activation functions as column expressions over ``array<double>``. All run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def col(x: ColumnOrName) -> Column:
    return F.col(x) if isinstance(x, str) else x


def number(x: float) -> Column:
    """A double literal (SQL literals with a point would be decimals)."""
    return F.lit(float(x))


def r6(x: ColumnOrName) -> Column:
    """Rounded to six places, without a negative zero."""
    return F.round(col(x), 6) + number(0)


def total(v: ColumnOrName) -> Column:
    return F.aggregate(col(v), number(0), lambda a, x: a + x)


def dot(a: ColumnOrName, b: ColumnOrName) -> Column:
    return total(F.zip_with(col(a), col(b), lambda x, y: x * y))


def norm(v: ColumnOrName) -> Column:
    return F.sqrt(F.aggregate(col(v), number(0), lambda a, x: a + x * x))


def squared_distance(a: ColumnOrName, b: ColumnOrName) -> Column:
    return total(F.zip_with(col(a), col(b), lambda x, y: (x - y) * (x - y)))


def l2_normalise(v: ColumnOrName, eps: float = 1e-8) -> Column:
    length = norm(v) + number(eps)
    return F.transform(col(v), lambda x: x / length)


def cosine(a: ColumnOrName, b: ColumnOrName, eps: float = 1e-8) -> Column:
    """Cosine of two vectors; the lengths have ``eps`` added, so a zero vector gives 0."""
    return dot(a, b) / ((norm(a) + number(eps)) * (norm(b) + number(eps)))


def softmax(v: ColumnOrName) -> Column:
    """Softmax of an array, shifted by its largest element."""
    shifted = F.transform(col(v), lambda x: F.exp(x - F.array_max(col(v))))
    return F.transform(shifted, lambda x: x / total(shifted))


def one_hot(code: ColumnOrName, size: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda k: F.when(k == col(code), number(1)).otherwise(number(0)))


def argmax(v: ColumnOrName) -> Column:
    """The place (from 0) of the first largest element."""
    return F.array_position(col(v), F.array_max(col(v))) - 1


def sigmoid(x: ColumnOrName) -> Column:
    return number(1) / (number(1) + F.exp(-col(x)))


def elu(x: ColumnOrName) -> Column:
    return F.when(col(x) > 0, col(x)).otherwise(F.expm1(col(x)))


def relu(x: ColumnOrName) -> Column:
    return F.greatest(col(x), number(0))


def clip(x: ColumnOrName, low: float, high: float) -> Column:
    return F.greatest(number(low), F.least(number(high), col(x)))


def bce_with_logits(logit: ColumnOrName, target: ColumnOrName) -> Column:
    """Binary cross entropy from a logit, without overflow."""
    x = col(logit)
    return F.greatest(x, number(0)) - x * col(target) + F.log1p(F.exp(-F.abs(x)))


def kl_to_unit_normal(mean: ColumnOrName, logvar: ColumnOrName) -> Column:
    """KL of one normal dimension from the unit normal."""
    m, lv = col(mean), col(logvar)
    return number(-0.5) * (number(1) + lv - m * m - F.exp(lv))


def hashed(*parts: ColumnOrName) -> Column:
    """A hash of the parts that other engines can repeat: 8 hex digits of the MD5 of the joined text."""
    return F.substring(F.md5(F.concat_ws("|", *[col(p).cast("string") for p in parts]).cast("binary")), 1, 8)


def hashed_uniform(*parts: ColumnOrName) -> Column:
    """A number in [0, 1) from ``hashed``."""
    return F.conv(hashed(*parts), 16, 10).cast("double") / number(2**32)
