"""Likelihoods from logits, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def token_nll(logits: Column, target: Column, masked: Column | None = None) -> Column:
    """Minus the log softmax of an array of logits at ``target``; 0 where ``masked``."""
    most = F.array_max(logits)
    total = F.aggregate(logits, F.lit(0.0), lambda s, x: s + F.exp(x.cast("double") - most.cast("double")))
    nll = most.cast("double") + F.log(total) - F.get(logits, target).cast("double")
    return nll if masked is None else F.when(masked, F.lit(0.0)).otherwise(nll)


def sequence_nll(nlls: Column, kept: Column, how: str = "mean") -> Column:
    """The sum of an array's entries where ``kept`` (an array of booleans), or their mean; 0
    without any."""
    if how not in ("mean", "sum"):
        raise ValueError(how)
    some = F.filter(F.zip_with(nlls, kept, lambda x, k: F.when(k, x.cast("double"))), lambda x: x.isNotNull())
    total = F.aggregate(some, F.lit(0.0), lambda s, x: s + x)
    return total if how == "sum" else total / F.greatest(F.lit(1), F.size(some))
