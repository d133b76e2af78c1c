"""Row-local sequence algebra on ARRAY<STRING> columns.

A sequence stands for a closed, repeating unit: writing the unit from another start
point (rotation) or twice in a row (repetition) names the same thing.  ``loose_key``
is invariant to both and linear in the length of the sequence.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from coobs.functions.binding import let


#: Elements of all rotations of one sequence that may be written out.
WRITTEN_OUT = 4096


def repeat_unit(seq: Column, times: int | Column) -> Column:
    """The unit written ``times`` times."""
    return F.flatten(F.array_repeat(seq, times))


def rotate(seq: Column, k: int | Column) -> Column:
    """Re-cut ``k`` positions later; unchanged when there is no other cut."""
    k = F.lit(k) if isinstance(k, int) else k
    n = F.size(seq)
    by = F.pmod(k, F.greatest(n, F.lit(1))).cast("int")
    turned = F.concat(F.slice(seq, by + 1, n - by), F.slice(seq, F.lit(1), by))
    return F.when((n < 2) | (by == 0), seq).otherwise(turned)


def smallest_period(seq: Column) -> Column:
    """Length of the shortest unit whose repetition is the sequence.

    p is a period when the sequence equals itself shifted by p, which one slice
    comparison tells; only divisors of the length are compared.
    """

    def period_of(a: Column) -> Column:
        n = F.size(a)

        def is_period(p: Column) -> Column:
            same = F.slice(a, F.lit(1), n - p) == F.slice(a, p + 1, n - p)
            return (n % p == 0) & ((p == n) | same)

        hits = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), is_period)
        return F.when(n > 0, F.element_at(hits, 1)).otherwise(F.lit(0))

    return let(seq, period_of)


def unit(seq: Column) -> Column:
    """The shortest repeating unit."""
    return F.when(F.size(seq) > 0, F.slice(seq, F.lit(1), smallest_period(seq))).otherwise(seq)


def least_rotation_start(seq: Column) -> Column:
    """0-based start of the lexicographically least rotation.

    Two candidate starts i < j are compared position by position; a mismatch rules
    out a whole run of starts, so 3n steps are enough.
    """
    n = F.size(seq)
    start = F.struct(F.lit(0).alias("i"), F.lit(1).alias("j"), F.lit(0).alias("k"))

    def step(s: Column, _: Column) -> Column:
        i, j, k = s["i"], s["j"], s["k"]
        live = (i < n) & (j < n) & (k < n)
        a = F.element_at(seq, ((i + k) % n + 1).cast("int"))
        b = F.element_at(seq, ((j + k) % n + 1).cast("int"))
        drop_i = i + k + 1
        drop_j = j + k + 1
        bumped = F.when(drop_i == j, drop_i + 1).otherwise(drop_i)
        pushed = F.when(drop_j == i, drop_j + 1).otherwise(drop_j)

        def state(x, y, z):
            return F.struct(x.alias("i"), y.alias("j"), z.alias("k"))

        return (
            F.when(~live, s)
            .when(a == b, state(i, j, k + 1))
            .when(a > b, state(bumped, j, F.lit(0)))
            .otherwise(state(i, pushed, F.lit(0)))
        )

    end = F.aggregate(F.sequence(F.lit(1), F.greatest(n * 3, F.lit(1))), start, step)
    scanned = F.least(end["i"], end["j"])

    def compared(starts: Column) -> Column:
        # the least rotation starts with the least element: few such starts are written out and compared
        turns = F.transform(starts, lambda p: F.struct(F.concat(F.slice(seq, p, n), F.slice(seq, F.lit(1), p - 1)).alias("a"), (p - 1).cast("int").alias("p")))
        few = (F.size(starts) * n <= WRITTEN_OUT) & ~F.exists(seq, lambda t: t.isNull())
        return F.when(few, F.array_min(turns)["p"]).otherwise(scanned)

    starts = let(F.array_min(seq), lambda least: F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda p: F.element_at(seq, p) == least))
    return F.when(n > 1, let(starts, compared)).otherwise(F.lit(0))


def loose_key(seq: Column) -> Column:
    """Key invariant to start point and repetition: least rotation of the unit."""
    return let(
        unit(seq), lambda u: let(least_rotation_start(u), lambda start: rotate(u, start))
    )


def spell(seq: Column, sep: str = "") -> Column:
    """The sequence as one string."""
    return F.array_join(seq, sep)
