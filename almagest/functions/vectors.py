"""Vectors as arrays of floats: dot product, unit length, sign codes with Hamming distance."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    n = F.sqrt(dot(v, v))
    return F.when(n > 0, F.transform(v, lambda x: x / n)).otherwise(v)


def sign_code(v: Column, dims: int) -> Column:
    """Bits of the signs, 32 to a bigint."""
    def word(w: int) -> Column:
        bits = [F.when(F.element_at(v, i + 1) > 0, F.lit(1 << (i - w)).cast("bigint")).otherwise(F.lit(0).cast("bigint")) for i in range(w, min(w + 32, dims))]
        return sum(bits[1:], bits[0])

    return F.array(*[word(w) for w in range(0, dims, 32)])


def hamming(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def top_k(vectors: DataFrame, query: list[float], k: int, *, id_col: str = "vec_id", vec_col: str = "embedding", keep: Column | None = None) -> DataFrame:
    """(id, score) of the k nearest by dot product, ties by id; a TakeOrdered, so each task sends at most k rows."""
    v = vectors if keep is None else vectors.filter(keep)
    q = F.array(*[F.lit(float(x)) for x in query])
    return v.filter(F.size(vec_col) == len(query)).select(id_col, dot(F.col(vec_col), q).alias("score")).orderBy(F.desc("score"), id_col).limit(k)


def nearest_each(vectors: DataFrame, queries: DataFrame, k: int, dims: int, *, by: str = "dot", same: str | None = None, id_col: str = "vec_id", vec_col: str = "embedding", block_rows: int = 50_000, block_queries: int = 2_000) -> DataFrame:
    """(query_id, id, score) of the k nearest rows of each query, ties by id, among all rows or those with the query's value of column ``same``.

    ``by`` is ``dot`` (the greatest dot products) or ``hamming`` (the least distances of sign codes, as whole numbers).
    Rows and queries are dealt out in blocks; each task multiplies one block of rows with one of queries and keeps the
    k best of each query. Vectors of another length take no part; repeated ids count as they come.
    """
    n, m = vectors.count(), queries.count()
    rb, qb = max(1, -(-n // block_rows)), max(1, -(-m // block_queries))
    tag = F.col(same).cast("string") if same else F.lit("")
    fits = F.size(vec_col) == dims
    rows = vectors.filter(fits).select(F.lit(False).alias("query"), F.col(id_col).alias("id"), F.col(vec_col).alias("v"), tag.alias("tag"), F.pmod(F.xxhash64(id_col), F.lit(rb)).alias("r"), F.explode(F.sequence(F.lit(0), F.lit(qb - 1))).alias("q"))
    asks = queries.filter(fits).select(F.lit(True).alias("query"), F.col(id_col).alias("id"), F.col(vec_col).alias("v"), tag.alias("tag"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(rb - 1).cast("bigint"))).alias("r"), F.pmod(F.xxhash64(id_col, F.lit(1)), F.lit(qb)).cast("int").alias("q"))

    def best(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = pdf[pdf["query"]], pdf[~pdf["query"]].sort_values("id", kind="stable")
        out = []
        if len(a) and len(b):
            x, y = (np.stack(d["v"].to_numpy()).astype(np.float64) for d in (a, b))
            if by == "hamming":
                x, y = (np.where(d > 0, 1.0, -1.0) for d in (x, y))
            ids, tags = b["id"].to_numpy(), b["tag"].to_numpy(object)
            for at in range(0, len(a), 256):
                score = x[at : at + 256] @ y.T
                for row, name, t in zip(score, a["id"].iloc[at : at + 256], a["tag"].iloc[at : at + 256], strict=True):
                    near = np.nonzero(tags == t)[0] if same else np.arange(len(b))
                    near = near[np.argsort(-np.round(row[near], 12), kind="stable")[:k]]  # ties by id
                    out += [(name, i, (dims - s) / 2 if by == "hamming" else s) for i, s in zip(ids[near], row[near], strict=True)]
        return pd.DataFrame(out, columns=["query_id", id_col, "score"])

    kind = vectors.schema[id_col].dataType.simpleString()
    found = rows.unionByName(asks).groupBy("r", "q").applyInPandas(best, f"query_id {kind}, {id_col} {kind}, score double")
    order = [F.asc("score") if by == "hamming" else F.desc(F.round("score", 12)), id_col]
    return found.withColumn("_n", F.row_number().over(W.partitionBy("query_id").orderBy(*order))).filter(F.col("_n") <= k).drop("_n")


def top_k_by_code(vectors: DataFrame, query: list[float], k: int, *, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """As ``top_k``, but exact scores only for the max(16 k, 64) nearest by the Hamming distance of sign codes."""
    q = F.array(*[F.lit(float(x)) for x in query])
    d = len(query)
    near = vectors.filter(F.size(vec_col) == d).withColumn("_h", hamming(sign_code(F.col(vec_col), d), sign_code(q, d))).orderBy("_h", id_col).limit(max(16 * k, 64))
    return near.select(id_col, dot(F.col(vec_col), q).alias("score")).orderBy(F.desc("score"), id_col).limit(k)


def top_k_by_code_each(vectors: DataFrame, queries: DataFrame, k: int, dims: int, *, share: float = 0.3, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, id, score) of the k nearest of every row of ``queries`` by dot product, ties by id.

    Exact scores for those within the least Hamming distance of sign codes that holds ``share`` of the rows, and 16 k or 64 rows.
    """
    v = vectors.filter(F.size(vec_col) == dims).select(id_col, vec_col, sign_code(F.col(vec_col), dims).alias("_code"))
    q = queries.filter(F.size(vec_col) == dims).select(F.col(id_col).alias("query_id"), F.col(vec_col).alias("_q"), sign_code(F.col(vec_col), dims).alias("_qcode"))
    pairs = v.crossJoin(q).withColumn("_h", hamming(F.col("_code"), F.col("_qcode")))
    counts = pairs.groupBy("query_id", "_h").agg(F.count("*").alias("_n"))  # at most dims + 1 rows a query
    w = W.partitionBy("query_id")
    counts = counts.withColumn("_upto", F.sum("_n").over(w.orderBy("_h"))).withColumn("_all", F.sum("_n").over(w))
    enough = F.least("_all", F.greatest(F.lit(max(16 * k, 64)), F.ceil(F.col("_all") * share)))
    bound = counts.filter(F.col("_upto") >= enough).groupBy("query_id").agg(F.min("_h").alias("_bound"))
    near = pairs.join(bound, "query_id").filter("_h <= _bound").select("query_id", id_col, dot(F.col(vec_col), F.col("_q")).alias("score"))
    return near.withColumn("_r", F.row_number().over(w.orderBy(F.desc("score"), id_col))).filter(F.col("_r") <= k).drop("_r")
