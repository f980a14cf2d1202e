"""From texts to mentions, times and link decisions."""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from almagest.functions.temporal_text import parse
from almagest.functions.text import normalize_label
from almagest.plans import parts_for

DICTIONARY = 1_000_000  # labels of one automaton; a larger gazetteer is read in several passes
_TIMES = re.compile(
    r"(?:紀元前)?(?:令和|平成|昭和|大正|明治)?(?:元|\d{1,4})年(?:\d{1,2}月(?:\d{1,2}日|[上中下]旬)?)?|\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2})?Z?)?|\d{3,4}年代|\d{1,2}世紀"
    r"|\b\d{1,2} (?:January|February|March|April|May|June|July|August|September|October|November|December) \d{3,4}\b|\b(?:early |mid-|late )?\d{4}s\b|\b\d{1,2}(?:st|nd|rd|th) century\b|\b1\d{3}\b|\b20\d{2}\b"
)


def gazetteer_mentions(documents: DataFrame, labels: DataFrame, *, least: int = 2, dictionary: int = DICTIONARY) -> DataFrame:
    """(doc_id, place_id, label, span_start, span_end) of gazetteer labels in texts, in characters; of overlapping finds the longest, then the first.

    ``labels`` has place_id, label. A label inside a longer ASCII word is no find; one label of several places gives a
    row for each. Null texts and labels, and labels shorter than ``least``, give nothing. The automaton travels with the
    task in passes of at most ``dictionary`` labels; the longest finds are chosen over all passes.
    """
    names = labels.select("place_id", F.trim("label").alias("label")).filter(F.length("label") >= least).distinct()
    words = names.select("label").distinct().withColumn("_p", F.pmod(F.xxhash64("label"), F.lit(parts_for(names.count(), dictionary))))
    docs = documents.select("doc_id", "text").filter("text is not null")
    found = None
    for p in sorted(r["_p"] for r in words.select("_p").distinct().collect()):  # as many rows as passes
        a = ahocorasick.Automaton()
        for r in words.filter(F.col("_p") == p).select("label").toLocalIterator():
            a.add_word(r["label"], r["label"])
        a.make_automaton()
        shared = documents.sparkSession.sparkContext.broadcast(a)

        def find(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:  # noqa: ANN001
            automaton = shared.value
            for pdf in batches:
                rows = []
                for i, t in zip(pdf.doc_id, pdf.text, strict=True):
                    for end, w in automaton.iter(t):
                        s, e = end + 1 - len(w), end + 1
                        if not ((w[0].isascii() and w[0].isalnum() and s and t[s - 1].isalnum() and t[s - 1].isascii()) or (w[-1].isascii() and w[-1].isalnum() and e < len(t) and t[e].isalnum() and t[e].isascii())):
                            rows.append((i, w, s, e))
                yield pd.DataFrame(rows, columns=["doc_id", "label", "span_start", "span_end"])

        part = docs.mapInPandas(find, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, label string, span_start int, span_end int")
        found = part if found is None else found.unionByName(part)
    if found is None:
        return docs.select("doc_id", F.lit(None).cast("string").alias("label"), F.lit(0).alias("span_start"), F.lit(0).alias("span_end")).filter("false").join(names, "label").select("doc_id", "place_id", "label", "span_start", "span_end")

    def longest(pdf: pd.DataFrame) -> pd.DataFrame:
        kept: list[tuple] = []
        for r in sorted(pdf.itertuples(index=False), key=lambda r: (r.span_start - r.span_end, r.span_start)):
            if all(r.span_end <= k.span_start or r.span_start >= k.span_end for k in kept):
                kept.append(r)
        return pd.DataFrame(kept, columns=pdf.columns)

    best = found.distinct().groupBy("doc_id").applyInPandas(longest, found.schema)
    return best.join(names, "label").select("doc_id", "place_id", "label", "span_start", "span_end")


def time_mentions(documents: DataFrame) -> DataFrame:
    """(doc_id, raw, span_start, span_end, es, le) of time expressions in texts that can be resolved without a reference."""

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for i, t in zip(pdf.doc_id, pdf.text, strict=True):
                for m in _TIMES.finditer(t):
                    p = parse(m[0])
                    if p.range is not None:
                        rows.append((i, m[0], m.start(), m.end(), p.range.es, p.range.le))
            yield pd.DataFrame(rows, columns=["doc_id", "raw", "span_start", "span_end", "es", "le"])

    docs = documents.select("doc_id", "text").filter("text is not null")
    return docs.mapInPandas(find, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, raw string, span_start int, span_end int, es bigint, le bigint")


def validate_mentions(mentions: DataFrame) -> DataFrame:
    """(doc_id, mention_ref, problem): repeated references of one document, empty labels, missing wordings and spans, spans that are none."""
    m = mentions.distinct()
    twice = m.groupBy("doc_id", "mention_ref").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id", "mention_ref", F.lit("repeated").alias("problem"))
    empty = m.filter("label is null or trim(label) = ''").select("doc_id", "mention_ref", F.lit("no label").alias("problem"))
    span = m.filter("span_start >= span_end or span_start < 0").select("doc_id", "mention_ref", F.lit("bad span").alias("problem"))
    gone = [m.filter(f"{c} is null").select("doc_id", "mention_ref", F.lit(p).alias("problem")) for c, p in (("mention", "no wording"), ("span_start", "no span"))]
    return twice.unionByName(empty).unionByName(span).unionByName(gone[0]).unionByName(gone[1])


def link_decisions(mentions: DataFrame, resources: DataFrame) -> DataFrame:
    """(mention_id, candidates, decision, resource): by exact label in normal form and a common type. Events are always new; none: new, one: existing, more: ambiguous (resource null)."""
    m = mentions.filter("mention_id is not null").select("mention_id", normalize_label(F.col("label")).alias("norm"), F.coalesce("types", F.array()).alias("mt")).dropDuplicates(["mention_id"])
    r = resources.select("resource_id", F.coalesce("types", F.array()).alias("rt"), F.explode(F.concat(F.array("label"), F.coalesce("aliases", F.array()))).alias("l")).filter("l is not null")
    r = r.select("resource_id", "rt", normalize_label(F.col("l")).alias("norm")).distinct()
    fits = F.arrays_overlap("mt", "rt") | F.array_contains("mt", "Entity")
    hits = m.filter(~F.array_contains("mt", "Event")).join(r, "norm").filter(fits).groupBy("mention_id").agg(F.count_distinct("resource_id").alias("candidates"), F.min("resource_id").alias("_r"))
    j = m.join(hits, "mention_id", "left").withColumn("candidates", F.coalesce("candidates", F.lit(0)).cast("bigint"))
    decision = F.when(F.col("candidates") == 0, "new").when(F.col("candidates") == 1, "existing").otherwise("ambiguous")
    return j.select("mention_id", "candidates", decision.alias("decision"), F.when(F.col("candidates") == 1, F.col("_r")).alias("resource"))
