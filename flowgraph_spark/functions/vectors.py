"""Array expressions for scores: softmax, entropy, argmax, small dense layers."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def array_sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0).cast("double"), lambda acc, x: acc + x)


def let(value: Column, body) -> Column:
    """``body`` applied to ``value`` evaluated once."""
    return F.transform(F.array(value), body)[0]


def softmax(logits: Column) -> Column:
    """Stable softmax of an array; the largest logit is subtracted first."""

    def shifted(top):
        return F.transform(logits, lambda x: F.exp(x - top))

    def scaled(powers):
        return let(array_sum(powers), lambda total: F.transform(powers, lambda x: x / total))

    return let(F.array_max(logits), lambda top: let(shifted(top), scaled))


def softmax_scalars(df, kept, groups):
    """Softmax over groups of scalar columns, all inside generated code.

    ``groups`` maps an output name to the list of its logits' column names. Each
    step is its own projection, so no power is computed twice.
    """
    every = [c for logits in groups.values() for c in logits]
    tops = [
        (F.greatest(*logits) if len(logits) > 1 else F.col(logits[0])).alias(f"__top_{name}")
        for name, logits in groups.items()
    ]
    powers = df.select(*kept, *every, *tops).select(
        *kept,
        *[F.exp(F.col(c) - F.col(f"__top_{name}")).alias(c) for name, logits in groups.items() for c in logits],
    )

    def total(logits):
        result = F.col(logits[0])
        for c in logits[1:]:
            result = result + F.col(c)
        return result

    sums = powers.select(
        *kept, *every, *[total(logits).alias(f"__sum_{name}") for name, logits in groups.items()]
    )
    return sums.select(
        *kept,
        *[
            F.array(*[F.col(c) / F.col(f"__sum_{name}") for c in logits]).alias(name)
            for name, logits in groups.items()
        ],
    )


def entropy_epsilon(probabilities: Column) -> Column:
    """``-sum p ln(p + 1e-12)``, the serving-time entropy."""
    return array_sum(F.transform(probabilities, lambda p: -p * F.log(p + F.lit(1e-12))))


def entropy_clipped(probabilities: Column) -> Column:
    """``-sum p ln(clip(p, 1e-12, 1))``, the report-time entropy."""
    return array_sum(
        F.transform(
            probabilities,
            lambda p: -p * F.log(F.least(F.greatest(p, F.lit(1e-12)), F.lit(1.0))),
        )
    )


def argmax(values: Column) -> Column:
    """0-based position of the first maximum."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def probabilities_valid(probabilities: Column) -> Column:
    inside = F.forall(
        probabilities,
        lambda p: p.isNotNull() & ~F.isnan(p) & (p >= 0.0) & (p <= 1.0),
    )
    # numpy.allclose against 1.0: absolute tolerance 1e-5 plus relative 1e-5.
    sums_to_one = F.abs(array_sum(probabilities) - 1.0) <= F.lit(1e-5 + 1e-5)
    return F.coalesce(inside & sums_to_one, F.lit(False))


def dense(inputs, weights, bias):
    """Linear layer over scalar columns, one output column per weight row.

    Meant for small widths: the products stay inside generated code.
    """
    outputs = []
    for row, offset in zip(weights, bias):
        total = F.lit(float(offset))
        for weight, value in zip(row, inputs):
            total = total + F.lit(float(weight)) * value
        outputs.append(total)
    return outputs


def relu(value: Column) -> Column:
    return F.greatest(value, F.lit(0.0))
