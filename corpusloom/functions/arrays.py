"""Functions of probability arrays as Column expressions (no UDFs)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def total(p: Column) -> Column:
    return F.aggregate(p, F.lit(0.0), lambda a, x: a + x)


def entropy(p: Column) -> Column:
    """Nats; 0 log 0 is 0."""
    return -F.aggregate(p, F.lit(0.0), lambda a, x: a + F.when(x > 0, x * F.ln(x)).otherwise(0.0))


def normalised_entropy(p: Column) -> Column:
    return F.when(F.size(p) > 1, -F.aggregate(p, F.lit(0.0), lambda a, x: a + x * F.ln(F.greatest(x, F.lit(1e-12)))) / F.ln(F.size(p).cast("double"))).otherwise(0.0)


def least_confidence(p: Column) -> Column:
    return 1.0 - F.array_max(p)


def margin(p: Column) -> Column:
    """Gap between the two largest; 1 for one class."""
    top = F.sort_array(p, asc=False)
    return F.when(F.size(p) > 1, top[0] - F.coalesce(F.get(top, F.lit(1)), F.lit(0.0))).otherwise(1.0)


def softmax(x: Column) -> Column:
    e = F.transform(x, lambda v: F.exp(v - F.array_max(x)))
    return F.transform(e, lambda v: v / total(e))


def renormalise(p: Column) -> Column:
    """Shares of the sum; uniform where the sum is not positive."""
    return F.when(total(p) > 0, F.transform(p, lambda v: v / total(p))).otherwise(F.transform(p, lambda _: 1.0 / F.size(p)))


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 where either is all zeros."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / F.when(n > 0, n).otherwise(1.0)).otherwise(0.0)


def argmax_label(p: Column, classes: list[str]) -> Column:
    """The first label of the largest probability."""
    return F.element_at(F.array(*map(F.lit, classes)), F.array_position(p, F.array_max(p)).cast("int"))


def brier(p: Column, truth: Column, classes: list[str]) -> Column:
    return total(F.zip_with(p, F.array(*map(F.lit, classes)), lambda x, c: (x - (c == truth).cast("double")) ** 2))


def ranked(p: Column, classes: list[str]) -> Column:
    """Labels with probabilities, most probable first, ties in class order."""
    pairs = F.zip_with(p, F.array(*[F.struct(F.lit(-i).alias("i"), F.lit(c).alias("label")) for i, c in enumerate(classes)]), lambda x, c: F.struct(x.alias("p"), c["i"].alias("i"), c["label"].alias("label")))
    return F.sort_array(pairs, asc=False)


def conformal_set(p: Column, q: Column, classes: list[str], fallback: bool = True) -> Column:
    """Labels with 1 - p <= q, most probable first; empty ones become the top label if fallback."""
    order = ranked(p, classes)
    kept = F.transform(F.filter(order, lambda s: 1.0 - s["p"] <= q), lambda s: s["label"])
    return F.when(F.size(kept) == 0, F.array(order[0]["label"])).otherwise(kept) if fallback else kept


def mean_of(members: Column) -> Column:
    """Mean over an array of arrays."""
    first = F.transform(members[0], lambda _: F.lit(0.0))
    return F.transform(F.aggregate(members, first, lambda a, m: F.zip_with(a, m, lambda x, y: x + y)), lambda v: v / F.size(members))


def uncertainty(members: Column) -> dict[str, Column]:
    """Entropy of the mean, mean entropy, and what is left."""
    whole = entropy(mean_of(members))
    inner = F.aggregate(members, F.lit(0.0), lambda a, m: a + entropy(m)) / F.size(members)
    return {"total": whole, "aleatoric": inner, "epistemic": F.greatest(whole - inner, F.lit(0.0))}


def fuse(modalities: list[Column], kind: str, weights: list[float] | None = None) -> Column:
    """Late fusion of probability arrays; a null one is left out, one alone passes through. kind: weighted, maximum, confidence, logpool."""
    weights = weights or [1.0] * len(modalities)
    present = F.filter(F.array(*[F.when(m.isNotNull(), F.struct(m.alias("p"), F.lit(w).alias("w"))) for m, w in zip(modalities, weights)]), lambda s: s.isNotNull())
    start = F.transform(present[0]["p"], lambda _: F.lit(0.0))
    if kind == "maximum":
        merged = F.aggregate(present, start, lambda a, s: F.zip_with(a, s["p"], lambda x, y: F.greatest(x, y)))
    elif kind == "logpool":
        merged = F.transform(F.aggregate(present, start, lambda a, s: F.zip_with(a, s["p"], lambda x, y: x + s["w"] * F.ln(F.greatest(y, F.lit(1e-12))))), F.exp)
    else:
        weight = (lambda s: s["w"]) if kind == "weighted" else (lambda s: s["w"] * F.array_max(s["p"]))
        merged = F.aggregate(present, start, lambda a, s: F.zip_with(a, s["p"], lambda x, y: x + weight(s) * y))
    return F.when(F.size(present) > 1, renormalise(merged)).when(F.size(present) == 1, present[0]["p"])
