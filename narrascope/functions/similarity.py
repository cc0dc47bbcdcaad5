"""Set, multiset and vector similarity as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def share(part: Column, whole: Column) -> Column:
    """part / whole, 0 if the whole is."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all distinct tokens; 0 if both are empty."""
    return share(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b)))


def set_jaccard(a: Column, b: Column) -> Column:
    """The same for lists without repeats, which saves building their union."""
    shared = F.size(F.array_intersect(a, b))
    return share(shared, F.size(a) + F.size(b) - shared)


def coverage(a: Column, b: Column) -> Column:
    """Share of the distinct tokens of ``a`` that ``b`` has; 0 if ``a`` is empty."""
    return share(F.size(F.array_intersect(a, b)), F.size(F.array_distinct(a)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Null where a norm is 0."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def cosine_or_zero(a: Column, b: Column) -> Column:
    """NaN components count as 0, and a similarity that isn't defined is 0."""
    clean = lambda v: F.transform(v, lambda x: F.nanvl(x.cast("double"), F.lit(0.0)))
    return F.coalesce(cosine(clean(a), clean(b)), F.lit(0.0))


def unit(a: Column) -> Column:
    length = norm(a)
    return F.transform(a, lambda x: F.try_divide(x.cast("double"), length))


def pair_features(a: Column, b: Column) -> Column:
    """Absolute differences, then products."""
    return F.concat(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y)), F.zip_with(a, b, lambda x, y: x.cast("double") * y))


def inference_features(a: Column, b: Column) -> Column:
    """Both vectors, products, absolute differences."""
    wide = lambda v: F.transform(v, lambda x: x.cast("double"))
    return F.concat(wide(a), wide(b), F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y)))


def masked_mean(vectors: Column, mask: Column, dim: int) -> Column:
    """Mean of the vectors whose mask is 1, component by component."""
    kept = F.filter(F.zip_with(vectors, mask, lambda v, m: F.when(m == 1, v)), lambda v: v.isNotNull())
    return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.try_divide(F.aggregate(kept, F.lit(0.0), lambda s, v: s + F.get(v, i)), F.size(kept)))


def pooled(layers: Column, mask: Column, mode: str, dim: int, dense: Callable[[Column], Column] | None = None) -> Column:
    """One vector of a model's layers (arrays of token vectors, the first layer first).

    ``cls`` is the last layer's first token, after the model's own ``dense`` layer if that is given, ``cls_before_pooler``
    without it; ``last`` is the last token whose mask is 1.  ``avg`` is the masked mean of the last layer, ``avg_top2`` of the
    mean of the last two, ``avg_first_last`` of the mean of the first and the last.
    """
    last = F.element_at(layers, -1)
    wide = lambda v: F.transform(v, lambda x: x.cast("double"))
    if mode in ("cls", "cls_before_pooler"):
        first = wide(F.get(last, F.lit(0)))
        return dense(first) if dense is not None and mode == "cls" else first
    if mode == "last":
        return wide(F.get(last, (F.array_size(mask) - 1 - F.array_position(F.reverse(mask), 1) + 1).cast("int")))
    other = {"avg": last, "avg_top2": F.element_at(layers, -2), "avg_first_last": F.element_at(layers, 1)}[mode]
    a, b = masked_mean(last, mask, dim), masked_mean(other, mask, dim)
    return F.zip_with(a, b, lambda x, y: (x + y) / 2)


def dense_tanh(weights: list[list[float]], bias: list[float]) -> Callable[[Column], Column]:
    """A model's pooling layer: the tangent of each row of weights times the vector, plus its bias."""
    rows = F.array(*[F.struct(F.array(*map(F.lit, w)).alias("w"), F.lit(b).alias("b")) for w, b in zip(weights, bias)])
    return lambda v: F.transform(rows, lambda r: F.tanh(dot(r["w"], v) + r["b"]))


def max_pool(vectors: Column, dim: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.array_max(F.transform(vectors, lambda v: F.get(v, i).cast("double"))))


def soft_label(score: Column, bins: int = 5) -> Column:
    """A score from 1 to ``bins`` as shares of its two neighbouring whole numbers."""
    low = F.floor(score)
    return F.transform(
        F.sequence(F.lit(1), F.lit(bins)),
        lambda k: F.when(k == low, low - score + 1).when(k == low + 1, score - low).otherwise(F.lit(0.0)).cast("double"),
    )


def expected_score(shares: Column) -> Column:
    return F.aggregate(F.transform(shares, lambda p, i: p * (i + 1)), F.lit(0.0), lambda s, x: s + x)


def clamp_quantile(values: str, q: float) -> Column:
    """Linear interpolation between order statistics; shares outside 0..1 are cut to it."""
    return F.percentile(values, F.lit(min(1.0, max(0.0, q))))
