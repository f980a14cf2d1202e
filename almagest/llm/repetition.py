"""Repetition inside single documents.

A document that says the same over and over is easy to predict from itself. Every document gets a modified
Kneser-Ney trigram model of its own text: its n-gram counts are kept in sorted hash arrays, the discounts come from
counts of counts that Spark sums over all documents of a language. The perplexity of the text under its own model is
compared with the bands of its language: below the lower band the text repeats itself, above the upper band it is
noise. An exact count of the repeated share follows for the texts below the lower band.

All work is done on arrays over blocks of documents; whole texts are read, and a text longer than a block is a block.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache, lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_CHARS = 500_000  # about so many characters are worked on at once
ORDER = 3
WORDS, CHARS = 8, 14  # a phrase is at least so many words, or characters of a script without blanks
SEGMENT = 3  # a line or sentence of fewer tokens is no repetition
#: Perplexity of a text under its own model: below the first figure it repeats itself, above the second it is noise.
BANDS = {"en": (6.0, 25.0), "de": (5.5, 20.0), "ja": (4.1, 10.0), "und": (6.5, 25.0)}
LANGUAGES = list(BANDS)
_MUL, _ADD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)
_SEP, _LETTER, _SINGLE, _STOP, _LINE, _DOC = range(6)


@cache
def _classes() -> np.ndarray:
    """Class of each code point: letters make words, characters of scripts without blanks stand for themselves, all else separates."""
    out = np.zeros(0x110000, dtype=np.uint8)
    for c in range(0x30000):
        if unicodedata.category(chr(c))[0] in "LM":
            out[c] = _LETTER
    # fixed values: kana, CJK ideographs with their extensions, iteration and length marks
    for a, b in ((0x3040, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x2FFFF), (0x3005, 0x3007), (0x0E00, 0x0E7F)):
        out[a : b + 1] = _SINGLE
    for ch in ".!?。！？":
        out[ord(ch)] = _STOP
    for ch in "\n\r  ":
        out[ord(ch)] = _LINE
    out[0] = _DOC
    return out


@lru_cache(8)
def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of an odd number modulo 2^64, and of its inverse."""
    out = []
    for b in (base, pow(base, -1, 1 << 64)):
        p = np.full(n + 1, np.uint64(b))
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(10, int(n).bit_length())  # few different lengths, so that blocks share them
    up, down = _powers(base, size)
    return up[: n + 1], down[: n + 1]


def unique(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position of one occurrence of each different hash, number of each position's hash, how often each occurs)."""
    order = np.argsort(h)
    sorted_ = h[order]
    new = np.empty(len(h), dtype=bool)
    new[:1] = True
    np.not_equal(sorted_[1:], sorted_[:-1], out=new[1:])
    begin = np.nonzero(new)[0]
    inverse = np.empty(len(h), dtype=np.int64)
    inverse[order] = np.cumsum(new) - 1
    return order[begin], inverse, np.diff(np.append(begin, len(h)))


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (a ^ (b * _MUL + _ADD)) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


@dataclass
class Tokens:
    """Tokens of a block of documents: hash, document, length in characters, whether of a script without blanks, sentence and line they are in."""

    key: np.ndarray
    doc: np.ndarray
    size: np.ndarray
    single: np.ndarray
    sentence: np.ndarray
    line: np.ndarray
    docs: int


def tokenize(texts: list[str | None]) -> Tokens:
    """Case, width, blanks, digits and punctuation aside."""
    joined = "".join(f"\0{(t or '').replace(chr(0), ' ')}" for t in texts)
    if not joined.isascii():
        joined = unicodedata.normalize("NFKC", joined)
    cp = np.frombuffer(joined.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    kind = _classes()[cp]
    doc_at = np.cumsum(kind == _DOC, dtype=np.int32) - 1
    single = kind == _SINGLE
    letter = kind == _LETTER
    begins = single.copy()
    begins[1:] |= letter[1:] & ~letter[:-1]
    start = np.nonzero(begins)[0]
    none = np.array([], dtype=np.int64)
    if not len(start):
        return Tokens(none.astype(np.uint64), none, none, none.astype(bool), none, none, len(texts))
    run_end = np.nonzero(letter[:-1] & ~letter[1:])[0] + 1
    if letter[-1]:
        run_end = np.append(run_end, len(letter))
    is_single = single[start]
    end = start + 1
    end[~is_single] = run_end
    # hash of a word: characters times rising powers of an odd number, all products mod 2^64, moved back to the word's start
    power, inverse = powers(0x100000001B3, len(cp))
    sums = np.zeros(len(cp) + 1, dtype=np.uint64)
    np.cumsum((cp + np.uint64(1)) * power[:-1], out=sums[1:])
    size = end - start
    key = mix((sums[end] - sums[start]) * inverse[start], size.astype(np.uint64))
    stops = np.cumsum((kind == _STOP) | (kind == _LINE) | (kind == _DOC), dtype=np.int32)[start]
    lines = np.cumsum((kind == _LINE) | (kind == _DOC), dtype=np.int32)[start]
    return Tokens(key, doc_at[start].astype(np.int64), size, is_single, stops, lines, len(texts))


def grams(t: Tokens, order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For 1..order: (hash by last token of the n-gram in its document, indices of the last tokens that have one)."""
    h = mix(t.key, t.doc.astype(np.uint64))
    out = [(h, np.arange(len(h)))]
    for k in range(2, order + 1):
        longer = np.zeros(len(h), dtype=np.uint64)
        longer[1:] = mix(h[:-1], t.key[1:])
        has = np.nonzero(t.doc[k - 1 :] == t.doc[: len(h) - k + 1])[0] + k - 1
        out.append((longer, has))
        h = longer
    return out


class SelfModel:
    """Sorted arrays of the n-gram hashes of each document with their counts: raw at the highest order, numbers of different left neighbours below."""

    def __init__(self, t: Tokens, order: int = ORDER) -> None:
        self.t, self.levels = t, []
        g = grams(t, order)
        above: np.ndarray | None = None  # the last token of each different n-gram of the order above
        for k in range(order, 0, -1):
            h, last = g[k - 1]
            one, pos, count = unique(h[last])
            if above is not None:
                number = np.zeros(len(h), dtype=np.int64)
                number[last] = pos
                count = np.maximum(np.bincount(number[above], minlength=len(one)), 1)  # at a text's start nothing stands to the left
            above = last[one]
            self.levels.append({"k": k, "last": last, "pos": pos, "count": count, "doc": t.doc[above], "context": None if k == 1 else g[k - 2][0][above - 1]})

    def count_of_counts(self) -> np.ndarray:
        """documents x orders x 4: how many n-grams of each document occur once, twice, three and four times; the highest order first."""
        out = np.zeros((self.t.docs, len(self.levels), 4), dtype=np.int64)
        for i, level in enumerate(self.levels):
            low = level["count"] <= 4
            out[:, i] = np.bincount(level["doc"][low] * 4 + level["count"][low] - 1, minlength=self.t.docs * 4).reshape(-1, 4)
        return out

    def perplexity(self, discounts: np.ndarray) -> np.ndarray:
        """Of each document under its own interpolated model; nan where it has no token. discounts: documents x orders x 3, the highest order first."""
        t = self.t
        p = np.zeros(len(t.key))
        types = np.bincount(self.levels[-1]["doc"], minlength=t.docs)
        for i in range(len(self.levels) - 1, -1, -1):
            level = self.levels[i]
            count, doc = level["count"], level["doc"]
            d = discounts[doc, i, np.minimum(count, 3) - 1]
            if level["k"] == 1:
                total = np.bincount(doc, weights=count, minlength=t.docs)
                spared = np.bincount(doc, weights=d, minlength=t.docs)
                own = np.maximum(count - d, 0) / total[doc] + spared[doc] / total[doc] / (types[doc] + 1)
                p = own[level["pos"]]
                continue
            _, inv, _ = unique(level["context"])
            total, spared = np.bincount(inv, weights=count), np.bincount(inv, weights=d)
            own, rest = np.maximum(count - d, 0) / total[inv], spared[inv] / total[inv]
            last, pos = level["last"], level["pos"]
            p[last] = own[pos] + rest[pos] * p[last]
        with np.errstate(divide="ignore", invalid="ignore"):
            n = np.bincount(t.doc, minlength=t.docs)
            return np.exp(-np.bincount(t.doc, weights=np.log(np.maximum(p, 1e-12)), minlength=t.docs) / n)


def _again(hashes: np.ndarray) -> np.ndarray:
    """Whether the same hash stood before."""
    _, first = np.unique(hashes, return_index=True)
    out = np.ones(len(hashes), dtype=bool)
    out[first] = False
    return out


def repeated_share(t: Tokens, words: int = WORDS, chars: int = CHARS) -> np.ndarray:
    """Share of each document's characters in second and later occurrences of phrases, lines and sentences; nan without a token."""
    n = len(t.key)
    if not n:
        return np.full(t.docs, np.nan)
    mostly_single = np.bincount(t.doc, weights=t.single, minlength=t.docs) * 2 > np.bincount(t.doc, minlength=t.docs)
    own = mix(t.key, np.uint64(7) * np.ones(1, np.uint64))
    power, inverse = powers(0x9E3779B97F4A7C15, n)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(own * power[:-1], out=sums[1:])
    covered = np.zeros(n + 1, dtype=np.int64)

    def cover(a: np.ndarray, b: np.ndarray) -> None:
        h = mix((sums[b] - sums[a]) * inverse[a], (t.doc[a] << 20 | np.minimum(b - a, 1 << 20)).astype(np.uint64))
        again = _again(h)
        np.add.at(covered, a[again], 1)
        np.add.at(covered, b[again], -1)

    for k, kind in ((words, False), (chars, True)):
        a = np.arange(max(0, n - k + 1))
        a = a[(t.doc[a] == t.doc[a + k - 1]) & (mostly_single[t.doc[a]] == kind)]
        if len(a):
            cover(a, a + k)
    for part in (t.sentence, t.line):
        a = np.nonzero(np.concatenate([[True], part[1:] != part[:-1]]))[0]
        b = np.append(a[1:], n)
        keep = b - a >= SEGMENT
        if keep.any():
            cover(a[keep], b[keep])
    hit = np.cumsum(covered[:-1]) > 0
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.bincount(t.doc, weights=t.size * hit, minlength=t.docs) / np.bincount(t.doc, weights=t.size, minlength=t.docs)


def languages(t: Tokens, tags: list[str | None]) -> np.ndarray:
    """Index in LANGUAGES of each document: by script where blanks are not written, else by its tag, else ``und``."""
    n = np.bincount(t.doc, minlength=t.docs)
    single = np.bincount(t.doc, weights=t.single, minlength=t.docs) * 2 > np.maximum(n, 1)
    first = [(tag or "").strip().lower()[:2] for tag in tags]
    return np.array([LANGUAGES.index("ja") if s else LANGUAGES.index(x) if x in BANDS and x != "ja" else LANGUAGES.index("und") for s, x in zip(single, first, strict=True)], dtype=np.int64)


def _blocks(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
    size = pdf.text.str.len().fillna(0).to_numpy()
    block = np.cumsum(size) // BLOCK_CHARS
    for _, part in pdf.groupby(block, sort=False):
        yield part


def _texts(documents: DataFrame, id_col: str) -> DataFrame:
    lang = F.col("lang").cast("string") if "lang" in documents.columns else F.lit(None).cast("string")
    return documents.select(F.col(id_col).alias("id"), F.col("text").cast("string").alias("text"), lang.alias("lang")).filter("id is not null")


def discounts(documents: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(language, order, n1, n2, n3, n4, d1, d2, d3): counts of counts over all documents, and the discounts they give. A few rows, whatever the corpus."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((len(LANGUAGES), ORDER, 4), dtype=np.int64)
        for pdf in batches:
            for part in _blocks(pdf):
                t = tokenize(part.text.tolist())
                np.add.at(total, languages(t, part.lang.tolist()), SelfModel(t).count_of_counts())
        yield pd.DataFrame([(lang, ORDER - i, *total[j, i].tolist()) for j, lang in enumerate(LANGUAGES) for i in range(ORDER)], columns=["language", "order", "n1", "n2", "n3", "n4"])

    rows = _texts(documents, id_col).filter("text is not null").mapInPandas(count, "language string, order int, n1 bigint, n2 bigint, n3 bigint, n4 bigint")
    summed = rows.groupBy("language", "order").agg(*[F.sum(c).alias(c) for c in ("n1", "n2", "n3", "n4")])
    y = F.col("n1") / F.greatest(F.lit(1), F.col("n1") + 2 * F.col("n2"))
    d = [F.greatest(F.lit(0.0), F.lit(float(k)) - (k + 1) * y * F.col(f"n{k + 1}") / F.greatest(F.lit(1), F.col(f"n{k}"))) for k in (1, 2, 3)]
    return summed.select("*", *[x.alias(f"d{k}") for k, x in zip((1, 2, 3), d, strict=True)])


def self_perplexity(documents: DataFrame, id_col: str = "doc_id", *, bands: dict[str, tuple[float, float]] | None = None, shares: bool = False) -> DataFrame:
    """(id_col, language, perplexity, band, repeated_share): one row per document.

    band is ``low`` (repeats itself), ``ok`` or ``high`` (noise) against the bands of the language. repeated_share, the
    share of the text's letters in second and later occurrences of phrases, lines and sentences, is counted exactly:
    for texts in the low band, for all with ``shares``; else it is null. Null texts and texts without a letter have null
    perplexity and share and band ``ok``. Repeated rows give repeated rows; other columns are ignored.
    """
    limits = {**BANDS, **(bands or {})}
    rows = discounts(documents, id_col).collect()  # languages x orders rows, a fixed number
    table = np.ones((len(LANGUAGES), ORDER, 3)) * np.array([0.7, 1.0, 1.4])
    for r in rows:
        if r.n1 and r.n2:
            table[LANGUAGES.index(r.language), ORDER - r.order] = [min(max(x, 0.05), m) for x, m in ((r.d1, 1.0), (r.d2, 2.0), (r.d3, 3.0))]
    low, high = np.array([limits[x][0] for x in LANGUAGES]), np.array([limits[x][1] for x in LANGUAGES])

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for part in _blocks(pdf):
                t = tokenize(part.text.tolist())
                lang = languages(t, part.lang.tolist())
                ppl = SelfModel(t).perplexity(table[lang])
                band = np.where(ppl < low[lang], "low", np.where(ppl > high[lang], "high", "ok"))
                share = np.full(len(part), np.nan)
                chosen = np.arange(len(part)) if shares else np.nonzero(band == "low")[0]
                if len(chosen):
                    share[chosen] = repeated_share(tokenize(part.text.iloc[chosen].tolist()))
                yield pd.DataFrame({"id": part.id.to_numpy(), "language": np.array(LANGUAGES)[lang], "perplexity": ppl, "band": band, "repeated_share": share})

    texts = _texts(documents, id_col)
    out = texts.mapInPandas(score, f"id {texts.schema['id'].dataType.simpleString()}, language string, perplexity double, band string, repeated_share double")
    return out.select(F.col("id").alias(id_col), "language", *[F.when(~F.isnan(c), F.col(c)).alias(c) if c != "band" else F.col("band") for c in ("perplexity", "band", "repeated_share")])


def repetitive(documents: DataFrame, id_col: str = "doc_id", *, over: float = 0.35) -> DataFrame:
    """(id_col) of the documents whose repeated share is over the limit: the low perplexity band, then the exact share."""
    return self_perplexity(documents, id_col).filter((F.col("band") == "low") & (F.col("repeated_share") > over)).select(id_col).distinct()
