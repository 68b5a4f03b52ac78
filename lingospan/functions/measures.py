"""Column expressions for association and divergence measures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lingospan.functions.vectors import array_sum, doubles, let

# Fixed value: keeps the logarithm of a zero count finite.
NPMI_EPSILON = 1e-12


def umass(together: Column, target_docs: Column) -> Column:
    return F.log((together + 1) / target_docs)


def npmi(together: Column, docs_i: Column, docs_j: Column, n_docs: Column) -> Column:
    """Epsilon is added to the joint probability."""
    joint = together / n_docs + F.lit(NPMI_EPSILON)
    pmi = F.log(joint / ((docs_i / n_docs) * (docs_j / n_docs)))
    return pmi / (-F.log(joint))


def npmi_reference(together: Column, docs_i: Column, docs_j: Column, n_docs: Column) -> Column:
    """Epsilon is added to the joint count, before the division."""
    joint = (together + F.lit(NPMI_EPSILON)) / n_docs
    pmi = F.log(joint / ((docs_i / n_docs) * (docs_j / n_docs)))
    return pmi / (-F.log(joint))


def jensen_shannon(p: Column, q: Column) -> Column:
    """Base-2 divergence of two weight arrays, each normalised to sum one first."""

    def normalised(v: Column) -> Column:
        return let(array_sum(doubles(v)), lambda s: F.transform(doubles(v), lambda x: x / s))

    def half(a: Column, b: Column) -> Column:
        terms = F.zip_with(
            a, b, lambda x, y: F.when(x > 0, x * F.log2(x / ((x + y) / 2))).otherwise(F.lit(0.0))
        )
        return array_sum(terms) / 2

    return let(
        F.struct(normalised(p).alias("p"), normalised(q).alias("q")),
        lambda s: half(s["p"], s["q"]) + half(s["q"], s["p"]),
    )
