"""Spelling of names of persons and organisations: canonical tokens, typing slips, and whether two spellings can mean one entity."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

# Titles and words that carry no identity, in Latin and Japanese script.
TITLES = frozenset("dr prof professor doctor mr mrs ms miss mx capt captain sir lady lord dame rev reverend hon st col colonel gen general lt major maj sgt fr frau herr mme mlle".split())
IDLE = frozenset("the of and ltd limited inc llc plc gmbh ag kg jr sr est".split())
HONORIFICS = re.compile("(?:氏|さん|さま|様|殿|先生|博士|教授|君|くん|ちゃん|女史|社長|監督)$")
# Abbreviations of words in organisations' names.
SHORT = dict(
    x.split(":")
    for x in (
        "obs:observatory publ:publishing pub:publishing mus:museum inst:institute stud:studies dept:department hist:historical soc:society bros:brothers bro:brothers auth:authority assoc:association assn:association "
        "broadc:broadcasting corp:corporation anim:animation co:company cos:company univ:university rly:railway rwy:railway ry:railway intl:international natl:national lib:library acad:academy"
    ).split()
)
# Short forms of given names.
NICKNAMES = {
    full: short.split()
    for full, short in {
        "alexander": "alex alec sandy lex xander sasha", "andrew": "andy drew", "charles": "charlie chuck chas", "dorothy": "dot dottie dolly dora dodo", "eleanor": "ellie nell nora lena ella nellie elly", "elizabeth": "liz lizzie beth betty eliza bess libby lisa elsie",
        "frederick": "fred freddie freddy fritz rick", "gabrielle": "gabby gabi gaby elle", "harold": "harry hal", "isabella": "bella izzy belle isa", "josephine": "josie jo fifi josy", "katherine": "kate kathy katie kat kitty kay", "leonard": "leo len lenny",
        "margaret": "maggie meg peggy marge greta daisy madge rita", "michael": "mike mick mickey micky mikey", "nicholas": "nick nicky klaus nico", "oliver": "ollie olly noll", "penelope": "penny pen nell", "quentin": "quin quinn", "richard": "rick dick rich ricky richie", "robert": "bob rob bobby robbie bert",
        "susannah": "sue susie suzy susan sanna", "theodore": "theo ted teddy", "tomas": "tom tommy", "thomas": "tom tommy", "ursula": "ulla uschi", "victoria": "vicky vicki tori vic", "vincent": "vince vin vinny", "walter": "walt wally", "william": "will bill billy willy liam", "yvonne": "vonnie evie eve", "zachary": "zach zack zak zac",
        "edward": "ed eddie ted ned", "james": "jim jimmy jamie", "john": "jack johnny", "joseph": "joe joey", "anthony": "tony", "benjamin": "ben benny", "daniel": "dan danny", "david": "dave davy", "samuel": "sam sammy", "matthew": "matt", "christopher": "chris kit", "catherine": "kate cathy cath kitty", "rebecca": "becky", "patricia": "pat patty tricia", "jennifer": "jen jenny", "ingrid": "inge inga", "jurgen": "jorg", "lars": "lasse", "hanne": "hannah", "renee": "rena", "otto": "", "ewa": "eva",
    }.items()
}
FULL: dict[str, list[str]] = {}
for _full, _shorts in NICKNAMES.items():
    for _s in _shorts:
        FULL.setdefault(_s, []).append(_full)
# Older forms of kanji in names and the forms they are written with today.
KANJI = str.maketrans(
    "澤濱廣瀧惠眞邊邉嶋﨑髙櫻靜螢鴾齋齊國圓壽榮學實顯櫪條樂藏豐淨淺濟燒獨瑤縣繩聲茲莊萬藝號覺譽讀賴輕遙鄕鐵關險雜靈顏驛齡龍龜德彌禮亞爲來冨嶽巖檜桒槇會黑黃",
    "沢浜広滝恵真辺辺島崎高桜静蛍鴇斎斎国円寿栄学実顕檪条楽蔵豊浄浅済焼独瑶県縄声茲荘万芸号覚誉読頼軽遥郷鉄関険雑霊顔駅齢竜亀徳弥礼亜為来富岳巌檜桑槙会黒黄",
)
_CJK = re.compile("[぀-ヿ㐀-鿿豈-﫿]")
_LETTERS = str.maketrans({"ø": "o", "ł": "l", "ß": "ss", "æ": "ae", "œ": "oe", "đ": "d", "ð": "d", "þ": "th", "ı": "i"})


@dataclass(frozen=True)
class Spelling:
    """tokens in reading order without titles, idle words and commas, full: with the idle words, as one; script ``ja`` has the whole name as one token."""

    tokens: tuple[str, ...]
    ja: bool = False
    titled: bool = False
    acronym: str = ""
    full: str = ""


@lru_cache(60_000)
def spell(text: str | None) -> Spelling | None:
    """Canonical form of a name as written: width, case, accents, titles, abbreviations and order of ``Last, First`` aside. None for blanks."""
    if text is None or not (s := unicodedata.normalize("NFKC", text).strip()):
        return None
    if _CJK.search(s):
        s = re.sub(r"[\s・･·=＝,，、.]+", "", s).translate(KANJI)
        bare = HONORIFICS.sub("", s)
        return Spelling((bare or s,), ja=True, titled=bare != s)
    short = re.fullmatch(r"(?:[Tt]he\s+)?([A-Z]{2,8})", s)
    s = "".join(c for c in unicodedata.normalize("NFD", s.casefold().translate(_LETTERS)) if not unicodedata.combining(c))
    s = re.sub(r"['’`´]", "", s.replace("&", " and "))
    parts = [re.findall(r"[^\W_]+", p) for p in s.split(",")]
    parts = [p for p in parts if p and not all(w in IDLE for w in p)] or [p for p in parts if p]
    words = parts[0] if len(parts) == 1 else [w for p in parts[1:] for w in p] + parts[0] if parts else []
    titled = any(w in TITLES for w in words)
    kept = [w for w in words if w not in IDLE and not (w in TITLES and len(words) > 1)] or words
    tokens = tuple(re.sub("(?<=[aou])e(?=[^e])", "", w) if len(w) > 4 and re.search("[aou]e[^e]", w) else w for w in (SHORT.get(w, w) for w in kept))
    return Spelling(tokens, titled=titled, acronym=short[1].lower() if short else "", full="".join(SHORT.get(w, w) for w in words if w not in ("the", "est", "ltd"))) if tokens else None


def edits(a: str, b: str, limit: int) -> int:
    """Insertions, deletions, substitutions and swaps of neighbours between two strings, limit + 1 if there are more than ``limit``."""
    if a == b:
        return 0
    n, m = len(a), len(b)
    if abs(n - m) > limit:
        return limit + 1
    while n and m and a[n - 1] == b[m - 1]:
        n, m = n - 1, m - 1
    k = 0
    while k < n and k < m and a[k] == b[k]:
        k += 1
    a, b, n, m = a[k:n], b[k:m], n - k, m - k
    if not n or not m:
        return max(n, m)
    if limit == 0 or limit == 1 and n > 1 and m > 1 and not (n == m == 2 and a == b[::-1]):
        return limit + 1
    before, row = [], list(range(m + 1))
    for i in range(1, n + 1):
        two, before, row = before, row, [i] + [limit + 1] * m
        ca = a[i - 1]
        for j in range(max(1, i - limit), min(m, i + limit) + 1):
            cost = before[j - 1] + (ca != b[j - 1])
            cost = min(cost, before[j] + 1, row[j - 1] + 1)
            if i > 1 and j > 1 and ca == b[j - 2] and a[i - 2] == b[j - 1]:
                cost = min(cost, two[j - 2] + 1)
            row[j] = cost
        if min(row) > limit:
            return limit + 1
    return min(row[m], limit + 1)


def slip_limit(length: int) -> int:
    """Typing slips allowed in a name of that length."""
    return 0 if length < 4 else 1 if length < 7 else 2


def _slips(a: str, b: str) -> int | None:
    """Typing slips between two names written without blanks, None if too many for their length."""
    limit = slip_limit(min(len(a), len(b)))
    d = edits(a, b, limit)
    return d if d <= limit else None


NO, WEAK, STRONG = 0, 1, 2


@lru_cache(2_000)
def compare(text: str, name: str, person: bool) -> tuple[int, int]:
    """(verdict, slips) whether ``text`` can be a spelling of ``name``: STRONG by its own words, WEAK by a surname, initials or an acronym alone, NO."""
    m, r = spell(text), spell(name)
    if m is None or r is None:
        return NO, 9
    if m.ja or r.ja:
        return (STRONG, 0) if m.ja and r.ja and m.tokens == r.tokens else (NO, 9)
    whole = "".join(r.tokens)
    if m.acronym:
        letters = "".join(w[0] for w in r.tokens)
        if m.acronym == letters:
            return WEAK, 0
        if len(m.tokens) == 1 and "".join(m.tokens) != whole:
            return NO, 9
    if not person or len(r.tokens) < 2:
        best = None
        for k in range(len(r.tokens)):  # any rotation: X University, University of X
            d = _slips("".join(m.tokens), "".join(r.tokens[k:] + r.tokens[:k]))
            if d is not None and (best is None or d < best):
                best = d
        whole_slips = _slips(m.full, r.full)  # slips in the idle words
        if whole_slips is not None and (best is None or whole_slips < best):
            best = whole_slips
        if best is not None and not _core_differs(m.tokens, r.tokens):
            return STRONG, best
        return NO, 9
    given, middle, last = r.tokens[0], r.tokens[1:-1], r.tokens[-1]
    initials = [w for w in m.tokens if len(w) == 1]
    words = [w for w in m.tokens if len(w) > 1]
    if not words:
        return NO, 9
    if len(words) == 1:
        d = _slips(words[0], last)
        if d is not None:
            if not initials:
                return (WEAK, d) if m.titled or len(m.tokens) == 1 else (NO, 9)
            known = [given[0], *(w[0] for w in middle)]
            if initials[0] == known[0] and all(i in known or not middle for i in initials[1:]):
                return WEAK, d
            return NO, 9
        joined = [words[0]]
    else:
        joined = ["".join(words)]
    if initials and middle and initials[0] not in (middle[0][0], given[0]):
        return NO, 9
    forms = list(joined)
    for i, w in enumerate(words):
        for full in FULL.get(w, ()):
            forms.append("".join(words[:i] + [full] + words[i + 1 :]))
    best = None
    for form in forms:
        for target in (given + last, last + given, *((given + "".join(middle) + last,) if middle and len(middle[0]) > 1 else ())):
            d = _slips(form, target)
            if d is not None and (best is None or d < best) and (len(given) > 4 or d < 2 or any(_slips(w, given) is not None or given in FULL.get(w, ()) for w in words)):
                best = d
    return (STRONG, best) if best is not None else (NO, 9)


ANY = -1  # a bag that counts as near to every other
NEAR_BAGS = 4  # two slips change at most four bits of a bag


def _bag(s: str) -> int:
    """Letters of a string counted in 32 buckets, each count modulo 4 as two bits of a Gray code: a letter more or less changes one bit."""
    out = 0
    for c, n in Counter(ord(c) % 32 for c in s).items():
        out |= (0, 1, 3, 2)[n % 4] << 2 * c
    return out - (1 << 64) if out >> 63 else out


def bags(text: str, person: bool | None = None) -> set[int]:
    """Bags of the strings that ``compare`` measures slips between: of a spelling, or of a name if ``person`` is given.

    It says NO to a spelling and a name of which no two bags are within ``NEAR_BAGS`` bits of each other, Japanese aside.
    """
    s = spell(text)
    if s is None or s.ja:
        return set()
    if person and len(s.tokens) > 1:
        given, middle, last = s.tokens[0], "".join(s.tokens[1:-1]), s.tokens[-1]
        return {_bag(last), _bag(given + last), _bag(given + middle + last)}
    out = {_bag("".join(s.tokens)), _bag(s.full)}
    if person is None:
        words = [w for w in s.tokens if len(w) > 1]
        out.add(_bag("".join(words)))
        out |= {_bag("".join([*words[:i], full, *words[i + 1 :]])) for i, w in enumerate(words) for full in FULL.get(w, ())}
        if s.acronym:
            out.add(ANY)
    return out


def _core_differs(a: tuple[str, ...], b: tuple[str, ...]) -> bool:
    """Whether two names of as many words differ in one of them by a whole short word, such as a number or a single letter."""
    if len(a) != len(b):
        return False
    rest_a, rest_b = sorted(set(a) - set(b)), sorted(set(b) - set(a))
    return any(len(x) <= 3 for x in rest_a) and any(len(x) <= 3 for x in rest_b)
