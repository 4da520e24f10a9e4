"""Expressions around model calls: billed tokens, list prices, class probabilities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def billed_output(prompt: Column, completion: Column, total: Column) -> Column:
    """Output tokens as billed: hidden ones may stand in the total only. Nulls count as 0."""
    zero = F.lit(0)
    return F.greatest(F.coalesce(completion, zero), F.coalesce(total, zero) - F.coalesce(prompt, zero))


def list_cost(tokens_in: Column, tokens_out: Column, price_in: float, price_out: float) -> Column:
    """The cost at prices per million tokens, with eight decimals."""
    return ((tokens_in * price_in + tokens_out * price_out) / 1e6).cast("decimal(12,8)")


def class_probabilities(reply: Column, labels: list[str]) -> Column:
    """map(label, share) of a JSON reply: negatives count as 0; equal shares if nothing usable is there.

    A value that is no number spoils the reply; a missing one counts as 0.
    """
    given = [F.get_json_object(reply, f"$.{x}") for x in labels]
    numbers = [g.try_cast("double") for g in given]
    broken = F.lit(False)
    for g, n in zip(given, numbers):
        broken = broken | (g.isNotNull() & n.isNull())
    values = [F.greatest(F.coalesce(n, F.lit(0.0)), F.lit(0.0)) for n in numbers]
    total = sum(values[1:], values[0])
    usable = ~broken & (total > 0)
    return F.create_map(*(c for x, v in zip(labels, values) for c in (F.lit(x), F.when(usable, v / total).otherwise(1 / len(labels)))))
