"""Scalar column functions that the operators share."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def shuffle_key(key: Column, seed: str | int) -> Column:
    """A pseudorandom sort key that depends on nothing but the seed and the row's key."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def finite(value: Column) -> Column:
    """The value, or null where it isn't a finite number."""
    value = value.try_cast("double")
    return F.when(F.isnan(value) | (F.abs(value) == float("inf")), None).otherwise(value)


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """What ``use`` makes of a value that is computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def softmax(scores: Column) -> Column:
    """Probabilities from an array of logits."""
    raised = lambda x: bound(F.array_max(x), lambda most: F.transform(x, lambda v: F.exp(v - most)))
    shared = lambda e: bound(F.aggregate(e, F.lit(0.0), lambda a, b: a + b), lambda total: F.transform(e, lambda v: v / total))
    return bound(scores, lambda x: bound(raised(x), shared))


def argmax(values: Column) -> Column:
    """Position of the first maximum of an array, from 0."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def binary_decision(logit: Column) -> Column:
    """Label and both probabilities of a logit."""
    p = sigmoid(logit)
    return F.struct(F.when(p >= 0.5, 1).otherwise(0).alias("label"), F.array(1.0 - p, p).alias("probabilities"))


def multiclass_decision(logits: Column) -> Column:
    """Label and probabilities of an array of logits."""
    return bound(softmax(logits), lambda p: F.struct(argmax(p).alias("label"), p.alias("probabilities")))


def markdown_value(value: Column) -> Column:
    """Text for a cell of a Markdown table."""
    return F.replace(F.replace(F.coalesce(value.cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))


def safe_name(value: Column) -> Column:
    """Text for a part of a path: other characters than letters, digits, dot, dash and underscore become underscores."""
    return F.regexp_replace(value, "[^A-Za-z0-9._-]+", "_")


def true_false(value: Column) -> Column:
    """Booleans written as text in any case; other values are null."""
    text = F.lower(value.cast("string"))
    return F.when(text == "true", True).when(text == "false", False)


def run_key(case: Column, method: Column, resample: Column, seed: Column) -> Column:
    return F.concat_ws(":", case, method, resample, F.concat(F.lit("seed-"), seed.cast("string")))


def resample_id(repeat: Column, fold: Column, sample: Column) -> Column:
    return F.format_string("repeat_%02d_fold_%02d_sample_%02d", repeat, fold, sample)


def sample_variance_entropy(x: Column) -> Column:
    """Entropy of a normal variable with the column's variance (an aggregate)."""
    return 0.5 * F.log(2 * F.pi() * F.e() * F.var_pop(x))


def gaussian_mutual_information(x: Column, y: Column) -> Column:
    """Mutual information of two columns taken as jointly normal (an aggregate)."""
    return -0.5 * F.log(1 - F.corr(x, y) * F.corr(x, y))


def place(value: Column, cuts: Column, most: int) -> Column:
    """How many of the ascending ``cuts`` (an array of at most ``most``) are below the value, found by halving."""
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(most.bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda i, step: F.when(F.get(cuts, i + step - 1) < value, i + step).otherwise(i))


def same(names: Sequence[str], prefix: str) -> Column:
    """The condition that columns equal those whose names have the prefix, nulls included."""
    return reduce(lambda a, b: a & b, [F.col(n).eqNullSafe(F.col(f"{prefix}{n}")) for n in names], F.lit(True))
