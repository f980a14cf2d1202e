"""Variant spellings of names linked to the persons and organisations they mean.

Every different spelling becomes a vector of character n-grams weighted by their rarity among the known names
(``vectors``); a sparse join finds every pair of a spelling and a name whose cosine reaches the threshold. Pairs that
typing slips, reordering, initials and short forms cannot explain are then taken out by an exact check. What is left is
grouped by average linkage: a mention, with its one or two spellings, joins the resource whose names are nearest on
average over them, unless two are equally near; mentions that mean no resource form clusters of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from almagest.llm.spelling import FULL, NEAR_BAGS, NO, STRONG, bags, compare, spell
from almagest.llm.vectors import FORM, average_linkage, cosine_join, cosines, gram_weights, meeting
from almagest.plans import cut, release

LEAST_COSINE = 0.15
LEAST_AVERAGE = 0.35  # of clusters of mentions that mean no known name
JOINED = 12  # a single word of so many letters may be a whole name written without blanks
SHORT = {"c": ("q", 11), "s": ("t", 7)}  # names of at most so many letters are also kept under shorter n-grams, and met there by spellings of two letters more


def _circle(words: list[str]) -> str:
    """The words as one string, in that order among their rotations which is the smallest."""
    return min("".join(words[k:] + words[:k]) for k in range(len(words)))


def forms(text: str, person: bool | None = None) -> set[tuple[str, str]]:
    """(family, string) under which a spelling is compared: whole names, single words, names without blanks.

    ``person`` is given for known names: a person is also kept under the surname alone, which a spelling of one word
    (beside initials and titles) may mean. A spelling with short given names counts with each of their full forms instead.
    """
    s = spell(text)
    if s is None:
        return set()
    if s.ja:
        return {("j", s.tokens[0])}
    words = [w for w in s.tokens if len(w) > 1] or list(s.tokens)
    out = {("c", _circle(words))} if len(words) > 1 or len(words[0]) >= JOINED else set()
    if len(words) == 1:
        out.add(("s", words[0]))
    if person and len(words) > 1:
        out.add(("s", s.tokens[-1]))
    if person is None and len(words) > 1:
        out = {("c", _circle([*words[:i], full, *words[i + 1 :]])) for i, w in enumerate(words) for full in FULL.get(w, ())} or out
    slack = 2 if person is None else 0
    return out | {(SHORT[fam][0], x) for fam, x in out if len(x) <= SHORT[fam][1] + slack}


def _fid(form: tuple[str, str]) -> int:
    return xxhash.xxh3_64_intdigest(":".join(form)) - (1 << 63)


def _formed(df: DataFrame, text: str, known: bool) -> DataFrame:
    """(text column, fid, fam, s, bags): the forms of each different spelling; one with short given names has its full forms and that as written."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for x, p in zip(pdf["x"], pdf["p"], strict=True):
                of = sorted(bags(x, bool(p) if known else None))
                rows += [(x, _fid(f), *f, of) for f in (forms(x, bool(p)) if known else forms(x) | forms(x, False))]
            yield pd.DataFrame(rows, columns=[text, "fid", "fam", "s", "bags"])

    p = F.coalesce("person", F.lit(False)) if known else F.lit(False)
    return df.select(F.col(text).alias("x"), p.alias("p")).distinct().mapInPandas(run, f"{text} string, {FORM}, bags array<bigint>")


def _by_bags(formed: DataFrame) -> DataFrame:
    """(fid, fam, s, a, b): each form with the bags of all its spellings, two in a row."""
    each = formed.select("fid", "fam", "s", F.explode("bags").alias("bag")).groupBy("fid", "fam", "s").agg(F.sort_array(F.collect_set("bag")).alias("bags"))
    pair = F.explode(F.expr("transform(sequence(0, cast((size(bags) - 1) div 2 as int)), i -> struct(bags[2 * i] as a, coalesce(get(bags, 2 * i + 1), bags[2 * i]) as b))"))
    return each.select("fid", "fam", "s", pair.alias("p")).select("fid", "fam", "s", "p.a", "p.b")


def link_spellings(texts: DataFrame, names: DataFrame) -> DataFrame:
    """(text, resource_id, verdict, slips, cosine) for the names a spelling can mean.

    ``texts`` has text; ``names`` has resource_id, name, person boolean. Every spelling, also one that is a known name,
    meets in the sparse join all names whose cosine with one of its forms reaches ``LEAST_COSINE`` and whose letters
    are not too many others for ``compare``. The best name of each resource counts. None is left out for being one of
    many: the best resource is chosen for each mention, where its other spelling is known. Japanese names are joined by
    equality, as ``compare`` takes no others. The result is partitioned by resource_id.
    """
    texts = texts.select("text").filter("text is not null").distinct()
    names = cut(names.select("resource_id", "name", "person").filter("name is not null and resource_id is not null").distinct())
    said, known = cut(_formed(texts, "text", False)), cut(_formed(names, "name", True))
    shared = said.sparkSession.sparkContext.broadcast(gram_weights(known.select("fid", "fam", "s").dropDuplicates(["fid"])))
    whose = known.select("fid", F.col("s").alias("rs"), "name").distinct().join(names, "name").select(F.col("fid").alias("rid"), "rs", "name", "person", "resource_id")
    near = cut(meeting(_by_bags(said.filter("fam <> 'j'")), _by_bags(known.filter("fam <> 'j'")), shared, LEAST_COSINE, NEAR_BAGS))
    release(said.sparkSession)  # n-grams and their hits are the most that is on disk
    near = near.join(said.select(F.col("fid").alias("lid"), "text", "fam", "s"), "lid").select("rid", "text", "fam", "s")
    same = said.filter("fam = 'j'").select(F.col("fid").alias("rid"), "text", "fam", "s")
    pairs = near.unionByName(same).join(whose, "rid").select("text", "fam", "s", "rs", "name", "person", "resource_id").sortWithinPartitions("text")

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = np.array([compare(x, y, bool(p)) for x, y, p in zip(pdf["text"], pdf["name"], pdf["person"], strict=True)], dtype=np.int64).reshape(-1, 2)
            pdf = pdf[["text", "resource_id", "fam", "s", "rs"]].assign(verdict=found[:, 0], slips=found[:, 1])[found[:, 0] != NO]
            cosine = cosines(pdf["s"].tolist(), pdf["rs"].tolist(), pdf["fam"].tolist(), shared.value)
            yield pdf[["text", "resource_id", "verdict", "slips"]].assign(cosine=cosine)[cosine >= LEAST_COSINE]

    checked = pairs.mapInPandas(check, "text string, resource_id string, verdict int, slips int, cosine double").repartition("resource_id")
    best = checked.groupBy("text", "resource_id").agg(F.max(F.struct("verdict", (-F.col("slips")).alias("less"), "cosine")).alias("b"))
    return best.select("text", "resource_id", "b.verdict", (-F.col("b.less")).alias("slips"), "b.cosine")


def _rows(mentions: DataFrame) -> DataFrame:
    """(mention_id, said, noted, kind), each mention once; a missing spelling stands for the other."""
    kind = F.when(F.array_contains("types", "Person"), "p").when(F.array_contains("types", "Organization"), "o").otherwise("e")
    return mentions.filter("mention_id is not null").select("mention_id", F.coalesce("mention", "label").alias("said"), F.coalesce("label", "mention").alias("noted"), kind.alias("kind")).filter("said is not null").dropDuplicates(["mention_id"])


def _both(rows: DataFrame) -> DataFrame:
    return rows.select("mention_id", "kind", F.col("said").alias("text")).unionByName(rows.filter("said <> noted").select("mention_id", "kind", F.col("noted").alias("text")))


def link_mentions(mentions: DataFrame, resources: DataFrame) -> DataFrame:
    """(mention_id, resource_id, score, as_label) of each mention whose spellings mean one person or organisation.

    ``mentions`` has mention_id, mention, label, types; ``resources`` has resource_id, label, aliases, types. mention and
    label are two spellings of one entity, score is their average cosine with the resource's nearest names (0 for one
    that no name explains); a spelling that could only be a surname or initials counts only if the other does not speak
    against it; an acronym needs the other spelling. Of two equally near entities none is taken. as_label tells that the
    mention (the label where it is null) is written exactly as the resource's label, outer blanks aside. Null and blank
    spellings mean nothing; mentions of other types than the resource's, Entity aside, are not linked to it. Repeated
    rows count once; empty tables give an empty result.
    """
    is_kind = F.exists("types", lambda t: t.isin("Person", "Organization"))
    known = resources.filter(is_kind & F.col("resource_id").isNotNull()).select("resource_id", "label", "aliases", F.array_contains("types", "Person").alias("person"))
    names = known.select("resource_id", "person", F.explode(F.concat(F.array("label"), F.coalesce("aliases", F.array()))).alias("name")).filter("trim(name) <> ''").distinct()
    rows = cut(_rows(mentions))
    both = _both(rows)
    links = cut(link_spellings(both.select("text"), names))
    release(rows.sparkSession)
    persons = known.groupBy("resource_id").agg(F.bool_or("person").alias("person"))
    hits = both.join(links.join(persons, "resource_id"), "text").filter("kind = 'e' or (kind = 'p') = person")
    per = hits.repartition("mention_id").groupBy("mention_id", "resource_id").agg(F.max("verdict").alias("top"), F.sum("cosine").alias("cosine"), F.count("*").alias("spellings"))
    acronym = r"^\s*([Tt]he\s+)?[A-Z]{2,8}\s*$"
    said = rows.select("mention_id", "said", F.when(F.col("said") == F.col("noted"), 1).otherwise(2).alias("of"), (F.col("said").rlike(acronym) | F.col("noted").rlike(acronym)).alias("acronym"))
    per = per.join(said, "mention_id").withColumn("score", F.round(F.col("cosine") / F.col("of"), 9))
    # one spelling silent: enough only if the other is no mere surname, or the silent one is an acronym
    sure = per.filter((F.col("spellings") == F.col("of")) | (F.col("top") == STRONG) | F.col("acronym"))
    w = W.partitionBy("mention_id")
    ranked = sure.withColumn("_r", F.rank().over(w.orderBy(F.desc("score")))).filter("_r = 1").withColumn("_n", F.count("*").over(w)).filter("_n = 1")
    blank = lambda c: F.regexp_replace(c, r"^[\s　]+|[\s　]+$", "")
    labels = known.select("resource_id", blank(F.col("label")).alias("_label")).distinct().groupBy("resource_id").agg(F.collect_set("_label").alias("_labels"))
    return ranked.join(labels, "resource_id").select("mention_id", "resource_id", "score", F.array_contains("_labels", blank(F.col("said"))).alias("as_label"))


def group_mentions(mentions: DataFrame, resources: DataFrame) -> DataFrame:
    """(mention_id, group_id, resource_id): every mention with a spelling, in one group with all others of its entity.

    Mentions that mean a known resource (``link_mentions``) are grouped under its id. The spellings of all others are
    joined among themselves by cosine, checked as pairs of a spelling and a name, and clustered by average linkage; the
    two spellings of one mention are alike. Their groups are named ``mention:`` and the smallest mention_id. Input as
    for ``link_mentions``.
    """
    rows = cut(_rows(mentions))
    linked = cut(link_mentions(mentions, resources).select("mention_id", "resource_id"))
    rest = rows.join(linked, "mention_id", "left_anti")
    both = _both(rest)
    texts = both.groupBy("text").agg(F.bool_or(F.col("kind") == "p").alias("person"))

    def nodes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        order = {"c": 0, "j": 1, "s": 2, "q": 3, "t": 4}
        for pdf in batches:
            rows = [(x, p, *min(forms(x, False), key=lambda f: order[f[0]])) for x, p in zip(pdf["text"], pdf["person"], strict=True) if forms(x, False)]
            yield pd.DataFrame([(x, p, _fid((fam, s)), fam, s) for x, p, fam, s in rows], columns=["text", "person", "fid", "fam", "s"])

    of = cut(texts.mapInPandas(nodes, f"text string, person boolean, {FORM}"))
    every = cut(of.groupBy("fid").agg(F.first("fam").alias("fam"), F.first("s").alias("s"), F.min("text").alias("text"), F.bool_or("person").alias("person")))
    near = cosine_join(every, every, gram_weights(every), LEAST_COSINE).filter("lid < rid")
    near = near.join(every.select(F.col("fid").alias("lid"), F.col("text").alias("x"), "person"), "lid").join(every.select(F.col("fid").alias("rid"), F.col("text").alias("y"), F.col("person").alias("p")), "rid")

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ok = [STRONG in (compare(x, y, bool(p))[0], compare(y, x, bool(p))[0]) for x, y, p in zip(pdf["x"], pdf["y"], pdf["p"], strict=True)]
            yield pdf.loc[ok, ["lid", "rid", "cosine"]]

    edges = near.select("lid", "rid", "cosine", "x", "y", (F.col("person") | F.col("p")).alias("p")).mapInPandas(check, "lid bigint, rid bigint, cosine double")
    ids = both.join(of.select("text", "fid"), "text").select("mention_id", "fid")
    own = ids.groupBy("mention_id").agg(F.min("fid").alias("lid"), F.max("fid").alias("rid")).filter("lid < rid").select("lid", "rid", F.lit(1.0).alias("cosine"))
    clusters = average_linkage(edges.unionByName(own).select(F.col("lid").alias("a"), F.col("rid").alias("b"), F.col("cosine").alias("sim")), least=LEAST_AVERAGE)
    one = ids.groupBy("mention_id").agg(F.min("fid").alias("fid")).join(clusters.withColumnRenamed("node", "fid"), "fid", "left").select("mention_id", F.coalesce("cluster", "fid").alias("c"))
    named = one.join(one.groupBy("c").agg(F.min("mention_id").alias("first")), "c")
    free = named.select("mention_id", F.concat(F.lit("mention:"), F.col("first").cast("string")).alias("group_id"), F.lit(None).cast("string").alias("resource_id"))
    return linked.select("mention_id", F.col("resource_id").alias("group_id"), "resource_id").unionByName(free)
