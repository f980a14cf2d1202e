"""Sparse vectors of character n-grams, their cosine join, and average-linkage clusters.

A string is a circle of characters, so that its n-grams are the same whichever of its parts comes first. An n-gram
weighs by its rarity among the known strings. Weights are kept for hash buckets (a fixed size, whatever the corpus);
the n-grams themselves are joined by their full 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from almagest.llm.spelling import ANY
from almagest.plans import cut

BUCKETS = 1 << 20
POWER = 3  # weight: rarity ln(1 + n / df) to this power
#: Length of the n-grams of whole names, single words, names without blanks, and of short whole names and single words.
GRAM = {"c": 7, "s": 5, "j": 3, "q": 3, "t": 3}
_WORDS = ("s", "t")
_BASE = 0x9E3779B97F4A7C15
FORM = "fid bigint, fam string, s string"


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def grams(strings: list[str], families: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(index of the string, hash) of the different n-grams of each string; single words are no circles but have marked ends."""
    owner, hashes = [], []
    for fam, n in GRAM.items():
        at = [i for i, f in enumerate(families) if f == fam and strings[i]]
        if not at:
            continue
        if fam in _WORDS:
            texts = [f"^{strings[i]}$" for i in at]
            count = [max(1, len(t) - n + 1) for t in texts]
            texts = [t.ljust(n, "\0") for t in texts]
        else:
            texts = [strings[i] * -(-n // len(strings[i])) if len(strings[i]) < n else strings[i] for i in at]
            count = [len(strings[i]) for i in at]
            texts = [(t + t[: n - 1])[: c + n - 1].ljust(n, "\0") if len(t) >= c else t for t, c in zip(texts, count, strict=True)]
        codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
        size, count = np.array([len(t) for t in texts]), np.array(count)
        begin = np.repeat(np.cumsum(size) - size, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        h = np.full(len(begin), ord(fam), dtype=np.uint64)
        for k in range(n):
            h = h * np.uint64(_BASE) + codes[begin + k] + np.uint64(1)
        owner.append(np.repeat(np.array(at), count))
        hashes.append(_mixed(h))
    if not owner:
        return np.array([], dtype=np.int64), np.array([], dtype=np.uint64)
    o, h = np.concatenate(owner), np.concatenate(hashes)
    order = np.lexsort((h, o))
    o, h = o[order], h[order]
    keep = np.ones(len(o), dtype=bool)
    keep[1:] = (o[1:] != o[:-1]) | (h[1:] != h[:-1])
    return o[keep], h[keep]


def _counted(forms: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            _, h = grams(pdf["s"].tolist(), pdf["fam"].tolist())
            yield pd.DataFrame({"b": (h & np.uint64(BUCKETS - 1)).astype(np.int64)})

    return forms.mapInPandas(run, "b bigint").groupBy("b").count()


def gram_weights(forms: DataFrame) -> np.ndarray:
    """Weight of each bucket, negative in buckets that no n-gram of ``forms`` falls in."""
    n = forms.count()
    out = np.full(BUCKETS, -(math.log(1 + n) ** POWER), dtype=np.float32)
    got = _counted(forms).toPandas()  # at most BUCKETS rows
    out[got["b"].to_numpy()] = np.log1p(n / got["count"].to_numpy()) ** POWER
    return out


def prefixes(strings: list[str], families: list[str], weights: np.ndarray, least: float) -> tuple[pd.DataFrame, np.ndarray]:
    """The n-grams without which no cosine reaches ``least``: string at, hash h, weight w in the unit vector; and whether each is known.

    Heaviest first, ties by hash: two vectors whose cosine reaches it share one n-gram that is among these of both. With
    each come, of its whole string, what is left out: its norm (rest), its heaviest weight (edge), and the bound of a
    unit vector's part of n-grams no heavier than one as a multiple of their weight (flat).
    """
    o, h = grams(strings, families)
    w = weights[(h & np.uint64(BUCKETS - 1)).astype(np.int64)].astype(np.float64)
    known, w = w > 0, np.abs(w)
    order = np.lexsort((h, -w, o))
    o, h, w, known = o[order], h[order], w[order], known[order]
    total = np.bincount(o, weights=w * w, minlength=len(strings))
    left = total[o] + np.concatenate([[0.0], np.cumsum(w * w)])[np.searchsorted(o, o)] - np.concatenate([[0.0], np.cumsum(w * w)])[:-1]
    # a hair below, as the running sums are rounded
    keep = left >= least * least * total[o] * (1 - 1e-9)
    out = o[~keep]
    norm = np.sqrt(np.maximum(total, 1e-30))
    rest, edge = np.zeros(len(strings)), np.zeros(len(strings))
    np.add.at(rest, out, w[~keep] ** 2)
    np.maximum.at(edge, out, w[~keep])
    flat = np.sqrt(np.bincount(o, minlength=len(strings))) / norm
    o = o[keep]
    return pd.DataFrame({"at": o, "h": h[keep].view(np.int64), "w": w[keep] / norm[o], "rest": np.sqrt(rest[o]) / norm[o], "edge": edge[o], "flat": flat[o]}), known[keep]


def cosines(left: list[str], right: list[str], families: list[str], weights: np.ndarray) -> np.ndarray:
    """Cosine of each pair of strings."""
    n, sides = len(left), []
    for strings in (left, right):
        o, h = grams(strings, families)
        w = np.abs(weights[(h & np.uint64(BUCKETS - 1)).astype(np.int64)].astype(np.float64))
        sides.append((o, h, w, np.sqrt(np.bincount(o, weights=w * w, minlength=n))))
    o, h, w = (np.concatenate([a, b]) for a, b in zip(sides[0][:3], sides[1][:3], strict=True))
    order = np.lexsort((h, o))
    o, h, w = o[order], h[order], w[order]
    same = np.nonzero((o[1:] == o[:-1]) & (h[1:] == h[:-1]))[0]
    dot = np.bincount(o[same], weights=w[same] * w[same + 1], minlength=n)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.nan_to_num(dot / (sides[0][3] * sides[1][3]))


def _postings(forms: DataFrame, shared: Broadcast, least: float, name: str, kept: dict[str, str]) -> DataFrame:
    """The known n-grams of ``prefixes`` of each form, under 32 bits of their hash, and what is ``kept`` of the form (column: type)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows, known = prefixes(pdf["s"].tolist(), pdf["fam"].tolist(), shared.value, least)
            rows = rows[known]
            at = rows.pop("at").to_numpy()
            rows["h"] = (rows["h"].to_numpy() >> 32).astype(np.int32)
            rows.columns = ["h", *(f"{name}{c}" for c in rows.columns[1:])]
            yield rows.assign(**{f"{name}{c}": pdf[c].to_numpy()[at] for c in kept})

    columns = "".join(f", {name}{c} {t}" for c, t in kept.items())
    return forms.select("fam", "s", *kept).mapInPandas(run, f"h int, {name}w float, {name}rest float, {name}edge float, {name}flat float{columns}")


def cosine_join(left: DataFrame, right: DataFrame, weights: np.ndarray, least: float) -> DataFrame:
    """(lid, rid, cosine) of all pairs of forms (fid, fam, s; one row per fid) whose cosine is at least ``least``.

    Exact for these vectors: both sides are joined on the n-grams of ``prefixes`` only; partial products are summed per
    pair, and pairs that the n-grams left out cannot lift over the threshold end there; the full cosine is taken of the
    rest. n-grams that many strings share weigh little, so only strings made of nothing else are kept under them; what
    one n-gram still gathers is split by adaptive execution. Empty inputs give an empty result.
    """
    shared = left.sparkSession.sparkContext.broadcast(weights)

    def full(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            c = cosines(pdf["_ls"].tolist(), pdf["_rs"].tolist(), pdf["fam"].tolist(), shared.value)
            yield pd.DataFrame({"lid": pdf["lid"], "rid": pdf["rid"], "cosine": c})

    one = F.lit(1.0).cast("float")
    # what the side whose prefix ends first leaves out meets only n-grams of the other that are no heavier; where both end at one weight, either may be first
    first, second = F.col("lrest") * F.least(one, F.col("ledge") * F.col("rflat")), F.col("rrest") * F.least(one, F.col("redge") * F.col("lflat"))
    missing = F.when(F.col("ledge") > F.col("redge"), first).when(F.col("ledge") < F.col("redge"), second).otherwise(F.greatest(first, second))
    hits = _postings(left, shared, least, "l", {"fid": "bigint"}).join(_postings(right, shared, least, "r", {"fid": "bigint"}), "h")
    hits = hits.select(F.col("lfid").alias("lid"), F.col("rfid").alias("rid"), (F.col("lw") * F.col("rw")).alias("w"), missing.alias("m"))
    near = hits.groupBy("lid", "rid").agg(F.sum("w").alias("part"), F.max("m").alias("m")).filter(F.col("part") + F.col("m") >= least - 1e-4).select("lid", "rid")
    near = near.join(left.select(F.col("fid").alias("lid"), "fam", F.col("s").alias("_ls")), "lid").join(right.select(F.col("fid").alias("rid"), F.col("s").alias("_rs")), "rid")
    return near.mapInPandas(full, "lid bigint, rid bigint, cosine double").filter(F.col("cosine") >= least)


def meeting(left: DataFrame, right: DataFrame, shared: Broadcast, least: float, bits: int) -> DataFrame:
    """(lid, rid): all pairs of forms whose cosine reaches ``least`` and of which two bags differ in at most ``bits`` bits, and some others.

    The forms have fid, fam, s and two bags a, b (``spelling.bags``), a form with more of them several rows. Bags travel
    with the n-grams, so that pairs that only share common ones end in the join and are never moved. The result is
    partitioned by lid.
    """
    kept = {"fid": "bigint", "a": "bigint", "b": "bigint"}
    columns = lambda name: ["h", *(f"{name}{c}" for c in kept)]
    hits = _postings(left, shared, least, "l", kept).select(*columns("l")).join(_postings(right, shared, least, "r", kept).select(*columns("r")), "h")
    hits = hits.filter(" or ".join(f"bit_count({x} ^ {y}) <= {bits}" for x in ("la", "lb") for y in ("ra", "rb")) + f" or la = {ANY} or lb = {ANY}")
    return hits.select(F.col("lfid").alias("lid"), F.col("rfid").alias("rid")).repartition("lid").dropDuplicates()


def average_linkage(edges: DataFrame, *, least: float) -> DataFrame:
    """(node, cluster) of every end of an edge: clusters by average linkage, each named by its smallest node.

    ``edges`` has a, b, sim, each pair once; pairs without an edge have similarity 0. The two clusters nearest to each
    other merge while their average similarity is at least ``least``. As an average never rises over both its parts,
    all pairs of clusters that are each other's nearest may merge at once, which gives the same clusters as one merge
    at a time; sums over the pairs between two clusters are added up when these merge. No cluster, however large, is
    held in one task. Edges with a null, and of a node with itself, link nothing; ties go to the smaller pair of names.
    """
    e = cut(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.col("sim").cast("double").alias("t")).filter("a is not null and b is not null and t is not null and a <> b").groupBy("a", "b").agg(F.max("t").alias("t")))
    members = cut(e.select(F.col("a").alias("node")).unionByName(e.select(F.col("b").alias("node"))).distinct().withColumn("cluster", F.col("node")))
    e = e.withColumns({"na": F.lit(1).cast("bigint"), "nb": F.lit(1).cast("bigint")})
    while True:
        near = e.withColumn("avg", F.round(F.col("t") / (F.col("na") * F.col("nb")), 9)).filter(F.col("avg") >= least)
        ends = near.select(F.col("a").alias("c"), "a", "b", "avg").unionByName(near.select(F.col("b").alias("c"), "a", "b", "avg"))
        best = ends.groupBy("c").agg(F.min(F.struct((-F.col("avg")).alias("far"), "a", "b")).alias("m"))
        merge = cut(best.groupBy("m.a", "m.b").count().filter("count = 2").select("a", "b"))  # both ends chose it
        if merge.isEmpty():
            return members
        to = merge.select(F.col("b").alias("_from"), F.col("a").alias("_to"))
        members = cut(members.join(to, members["cluster"] == to["_from"], "left").select("node", F.coalesce("_to", "cluster").alias("cluster")))
        size = members.groupBy("cluster").count()
        moved = e.select("a", "b", "t").join(to, F.col("a") == F.col("_from"), "left").select(F.coalesce("_to", "a").alias("a"), "b", "t")
        moved = moved.join(to, F.col("b") == F.col("_from"), "left").select("a", F.coalesce("_to", "b").alias("b"), "t").filter("a <> b")
        e = moved.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("t").alias("t"))
        e = cut(e.join(size.select(F.col("cluster").alias("a"), F.col("count").alias("na")), "a").join(size.select(F.col("cluster").alias("b"), F.col("count").alias("nb")), "b"))
