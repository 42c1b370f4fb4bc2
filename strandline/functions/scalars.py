"""Column functions: keyed draws, resample weights, rules of regions and verdicts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def keyed(seed: str, *columns: str) -> Column:
    """The first eight hexadecimal digits of the md5 of ``seed:column:...``: an even draw for each key."""
    return F.substring(F.md5(F.concat_ws(":", F.lit(seed), *[F.col(c).cast("string") for c in columns])), 1, 8)


def below(draw: Column, share: float) -> Column:
    """Whether a keyed draw falls in the first ``share`` of its range."""
    return F.lit(True) if share >= 1 else draw < f"{int(share * (1 << 32)):08x}"


def poisson_weight(draw: Column) -> Column:
    """How often a keyed draw takes its key in a Poisson(1) resample."""
    weight, p, total = F.lit(0), 0.36787944117144233, 0.0
    for k in range(8):
        total += p
        weight = weight + (draw >= f"{int(min(total, 1 - 2**-33) * (1 << 32)):08x}").cast("int")
        p /= k + 1
    return weight


def verdict(p: Column, wins: Column) -> Column:
    """better or worse where p < 0.05 and nine of ten pairs agree, else no difference."""
    return F.when((p < 0.05) & (wins >= 0.9), "better").when((p < 0.05) & (wins <= 0.1), "worse").otherwise("no difference")


def region_of(pos: Column, start: Column, end: Column, rule: str) -> Column:
    """utr5, cds or utr3 of a position by three rules: a stop codon belongs to the coding part, to what follows, or the span decides."""
    last = {"through_stop": end + 2, "before_stop": end - 1, "span": end}[rule]
    return F.when(pos < start, "utr5").when(pos <= last, "cds").otherwise("utr3")
