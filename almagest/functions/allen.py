"""Allen's interval relations, crisp and over fuzzy intervals, as 13-bit sets."""

from __future__ import annotations

from functools import cache
from itertools import combinations

from pyspark.sql import Column
from pyspark.sql import functions as F

from almagest.functions.ticks import NEG_INF, POS_INF, infinite

# The relations in the order of their bits; the inverse of bit i is bit 12 - i.
RELATIONS = ["before", "meets", "overlaps", "starts", "during", "finishes", "equals", "finished_by", "contains", "started_by", "overlapped_by", "met_by", "after"]
#: Each relation as an order of the four ends (s1 e1 s2 e2); ends in one group are equal.
ORDERS = {
    "before": ["s1", "e1", "s2", "e2"], "meets": ["s1", "e1 s2", "e2"], "overlaps": ["s1", "s2", "e1", "e2"], "starts": ["s1 s2", "e1", "e2"], "during": ["s2", "s1", "e1", "e2"], "finishes": ["s2", "s1", "e1 e2"], "equals": ["s1 s2", "e1 e2"],
    "finished_by": ["s1", "s2", "e1 e2"], "contains": ["s1", "s2", "e2", "e1"], "started_by": ["s1 s2", "e2", "e1"], "overlapped_by": ["s2", "s1", "e2", "e1"], "met_by": ["s2", "e2 s1", "e1"], "after": ["s2", "e2", "s1", "e1"],
}


def _holds(order: list[str], at: dict) -> Column:
    groups = [g.split() for g in order]
    tests = [at[a] == at[b] for g in groups for a, b in zip(g, g[1:], strict=False)] + [at[g[0]] < at[h[0]] for g, h in zip(groups, groups[1:], strict=False)]
    out = tests[0]
    for t in tests[1:]:
        out = out & t
    return out


def relation(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Name of the one relation between two intervals with s < e; null if an end is null or no interval."""
    at = {"s1": s1, "e1": e1, "s2": s2, "e2": e2}
    out = F.lit(None).cast("string")
    for name in RELATIONS:
        out = F.when(_holds(ORDERS[name], at), name).otherwise(out)
    return F.when((s1 < e1) & (s2 < e2), out)


def possible_mask(a: Column, b: Column) -> Column:
    """Set of relations that some choice of ends inside two fuzzy intervals allows, as a bit mask.

    An order of the ends is possible if placing them one after the other, each as early as its bounds and its
    predecessor allow, never exceeds a bound.
    """
    low = lambda x: F.when(infinite(x), F.lit(NEG_INF)).otherwise(x)
    high = lambda x: F.when(infinite(x), F.lit(POS_INF)).otherwise(x)
    lo = {"s1": low(a["es"]), "e1": low(a["ee"]), "s2": low(b["es"]), "e2": low(b["ee"])}
    hi = {"s1": high(a["ls"]), "e1": high(a["le"]), "s2": high(b["ls"]), "e2": high(b["le"])}
    mask = F.lit(0)
    for bit, name in enumerate(RELATIONS):
        at, ok = None, F.lit(True)
        for group in ORDERS[name]:
            ends = group.split()
            first = F.greatest(*[lo[x] for x in ends]) if len(ends) > 1 else lo[ends[0]]
            last = F.least(*[hi[x] for x in ends]) if len(ends) > 1 else hi[ends[0]]
            at = first if at is None else F.greatest(first, at + 1)
            ok = ok & (at <= last)
        mask = mask + F.when(ok, 1 << bit).otherwise(0)
    return mask.cast("int")


def names(mask: Column) -> Column:
    return F.filter(F.array(*[F.when(mask.bitwiseAND(1 << i) != 0, n) for i, n in enumerate(RELATIONS)]), lambda x: x.isNotNull())


def inverse(mask: Column) -> Column:
    out = F.lit(0)
    for i in range(13):
        out = out + F.when(mask.bitwiseAND(1 << i) != 0, 1 << (12 - i)).otherwise(0)
    return out.cast("int")


@cache
def composition() -> dict[tuple[str, str], int]:
    """Relations possible between a and c given those between a and b and between b and c, from all intervals on six points."""
    spans = list(combinations(range(6), 2))

    def of(x: tuple[int, int], y: tuple[int, int]) -> str:
        at = {"s1": x[0], "e1": x[1], "s2": y[0], "e2": y[1]}
        return next(n for n, order in ORDERS.items() if all(len({at[e] for e in g.split()}) == 1 for g in order) and all(at[g.split()[0]] < at[h.split()[0]] for g, h in zip(order, order[1:], strict=False)))

    out: dict[tuple[str, str], int] = {}
    for a in spans:
        for b in spans:
            for c in spans:
                key = of(a, b), of(b, c)
                out[key] = out.get(key, 0) | 1 << RELATIONS.index(of(a, c))
    return out
