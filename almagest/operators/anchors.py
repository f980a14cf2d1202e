"""Times that hang on other events: resolved round by round from those already known."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from almagest.functions.ticks import NEG_INF, POS_INF, offset
from almagest.plans import cut


def resolve_anchored(known: DataFrame, relative: DataFrame, *, max_rounds: int = 8) -> DataFrame:
    """(node, es, ls, ee, le, reason) for nodes with a time of their own and those that hang on others.

    ``known`` has node, es, ls, ee, le. ``relative`` has node, after, before (names of nodes, either may be null) and
    least_ms, most_ms, the shift from ``after`` where ``before`` is null (null: any time after it). A node with after and
    before lies between the two. Unresolved nodes have the reason ``not_found`` (an anchor exists nowhere), ``cycle`` (it
    waits for itself or for one that does) or ``depth`` (more than ``max_rounds`` steps away). Each round joins only
    nodes whose anchors were resolved before; nodes with a time of their own keep it; repeated rows count once.
    """
    at = cut(known.select("node", "es", "ls", "ee", "le").dropDuplicates(["node"]))
    open_ = cut(relative.select("node", "after", "before", F.col("least_ms").cast("bigint").alias("least_ms"), F.col("most_ms").cast("bigint").alias("most_ms")).filter("node is not null").dropDuplicates(["node"]).join(at, "node", "left_anti"))
    every = cut(at.select("node").unionByName(open_.select("node")).distinct())
    rounds = 0
    while rounds < max_rounds:
        a = at.select(F.col("node").alias("after"), F.col("es").alias("a_es"), F.col("le").alias("a_le"), F.col("ee").alias("a_ee"))
        b = at.select(F.col("node").alias("before"), F.col("es").alias("b_es"), F.col("ls").alias("b_ls"))
        j = open_.join(a, "after", "left").join(b, "before", "left").filter("(after is null or a_es is not null) and (before is null or b_es is not null) and (after is not null or before is not null)")
        shifted = F.col("before").isNull() & F.col("least_ms").isNotNull()
        lo = F.when(shifted, offset(F.col("a_es"), F.col("least_ms"))).otherwise(F.coalesce("a_ee", F.lit(NEG_INF)))
        hi = F.when(shifted, offset(F.col("a_le"), F.coalesce("most_ms", "least_ms"))).otherwise(F.coalesce("b_ls", F.lit(POS_INF)))
        new = cut(j.select("node", lo.alias("es"), hi.alias("ls"), lo.alias("ee"), hi.alias("le")))
        if new.isEmpty():
            break
        at, open_, rounds = cut(at.unionByName(new)), cut(open_.join(new, "node", "left_anti")), rounds + 1
    if open_.isEmpty():
        return at.withColumn("reason", F.lit(None).cast("string"))
    waits = open_.select("node", F.explode(F.array("after", "before")).alias("on")).filter("on is not null")
    missing = waits.join(every.withColumnRenamed("node", "on"), "on", "left_anti").select("node").distinct().withColumn("_m", F.lit(True))
    # what still waits after circles are walked out hangs on one; where rounds ran out it may only be deep
    left, edges = open_, waits
    while True:
        stuck = edges.join(left.select(F.col("node").alias("on")), "on", "left_semi").select("node").distinct()
        kept = cut(left.join(stuck, "node", "left_semi"))
        if kept.count() == left.count():
            break
        left = kept
    circle = left.select("node").withColumn("_c", F.lit(True))
    why = F.when(F.col("_m"), "not_found").when(F.col("_c"), "cycle").otherwise("depth")
    lost = open_.join(missing, "node", "left").join(circle, "node", "left").select("node", *[F.lit(None).cast("bigint").alias(c) for c in ("es", "ls", "ee", "le")], why.alias("reason"))
    return at.withColumn("reason", F.lit(None).cast("string")).unionByName(lost)
