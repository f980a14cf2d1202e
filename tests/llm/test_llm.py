import itertools
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from almagest.llm.components import connected_groups, forest_levels
from almagest.llm.mixture import mixture_report, training_order
from almagest.llm.names import LEAST_COSINE, forms, group_mentions, link_mentions, link_spellings
from almagest.llm.repetition import repeated_share, repetitive, self_perplexity, tokenize
from almagest.llm.spelling import ANY, NEAR_BAGS, NO, STRONG, WEAK, bags, compare, edits
from almagest.llm.tokenizer import VOCABULARY, PerfectHash, count_tokens, encode, vocabulary
from almagest.llm.vectors import BUCKETS, average_linkage, cosine_join, cosines, gram_weights, grams, meeting

# ---- components


@pytest.mark.parametrize("bound", [4, 1_000_000])
def test_groups(spark, bound):
    rng = random.Random(2)
    pairs = [(f"n{rng.randrange(120):03d}", f"n{rng.randrange(120):03d}") for _ in range(90)]
    pairs += [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(60)] + [("hub", f"h{i:02d}") for i in range(50)] + [("x", None), (None, None), ("alone", "alone"), ("a", "b"), ("b", "a"), ("a", "b")]
    got = {}
    for r in connected_groups(spark.createDataFrame(pairs, "a string, b string"), "a", "b", partition_edges=bound).collect():
        assert r.member not in got
        got[r.member] = r.group_id
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        if a and b and a != b:
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    assert got == {x: find(x) for x in up}


def test_levels_of_ordered_chains(spark):
    """Chains in the order of their ids, in 100 partitions: the levels shrink by a constant factor."""
    n, length = 100_000, 1000
    at = spark.range(n).withColumn("k", F.col("id") % length)
    name = lambda c: F.format_string("%06d", c)
    edges = at.filter(F.col("k") < length - 1).select(name(F.col("id")).alias("a"), name(F.col("id") + 1).alias("b"))
    levels = forest_levels(edges, n // 100)
    assert 1 < len(levels) < 2 * math.log2(n) / 3
    got = connected_groups(edges, "a", "b", partition_edges=n // 100)
    wrong = got.filter(F.col("group_id").cast("bigint") != F.floor(F.col("member").cast("bigint") / length) * length)
    assert got.count() == n and wrong.isEmpty()


def test_no_pairs(spark):
    assert connected_groups(spark.createDataFrame([], "a string, b string"), "a", "b").count() == 0


# ---- tokenizer


def test_perfect_hash():
    keys = [f"k{i}".encode() for i in range(5000)]
    h = PerfectHash(keys)
    assert h.find(keys).tolist() == list(range(5000)) and sorted(h.slot_key.tolist()) == list(range(5000))
    assert (h.find([b"no", b""]) == -1).all() and PerfectHash([]).find([b"x"]).tolist() == [-1]


def test_ids_equal_the_library_and_round_trip(spark):
    tokenizers = pytest.importorskip("tokenizers")
    tk = tokenizers.Tokenizer.from_file(VOCABULARY.replace(".tiktoken", ".json"))
    tk.encode_special_tokens = True
    rng = random.Random(4)
    alphabet = "aáb C1２½Ⅷ 　\n\t.,'’-_東京タワー日ñß🙂👩‍👧́\x1c\x85​"
    texts = ["", " ", "<|endoftext|> hi", "don't'Re I'll", "a" * 20_000, "日本語" * 5000, "x  \n\n  y  ", *("".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(200))]
    rows = [(i, t, "clash") for i, t in enumerate(texts)] + [(-1, None, None), (0, "", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    got = encode(df, "doc_id", "text").collect()
    assert len(got) == len(rows)
    v = vocabulary(VOCABULARY)
    by_id = dict(zip(v.ids.tolist(), v.tokens, strict=True))
    for r in got:
        if r.doc_id < 0:
            assert r.ids is None
            continue
        assert r.ids == tk.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert b"".join(by_id[i] for i in r.ids).decode() == texts[r.doc_id]
    n = {r.doc_id: r.n_tokens for r in count_tokens(df, "doc_id", "text").collect()}
    assert n == {r.doc_id: len(r.ids or []) for r in got}
    assert encode(df.filter("false"), "doc_id", "text").count() == 0


# ---- mixture


def test_mixture(spark):
    rng = random.Random(6)
    docs = [(i, rng.choice(["big"] * 8 + ["mid", "mid", "tiny"]), rng.randrange(1, 50)) for i in range(600)]
    docs += [(9001, None, 5), (9002, "other", 5), (None, "big", 5), (9003, "big", None), (9004, "big", 0), (docs[0])]
    targets = [("big", 0.3, 1), ("mid", 0.5, 3), ("tiny", 0.15, 2), ("none", 0.05, 4), ("none", 0.05, 4)]
    df = spark.createDataFrame(docs, "doc_id bigint, source string, n_tokens bigint")
    tg = spark.createDataFrame(targets, "source string, target_share double, max_repeats int")
    size = {s: sum(n for i, x, n in {*docs} if x == s and i is not None and n) for s in ("big", "mid", "tiny")}
    for bucket in (100, 10**9):
        rep = {r.source: r for r in mixture_report(df, tg, bucket_tokens=bucket).collect()}
        assert rep["none"].uses == 0 and sum(r.actual_share for r in rep.values()) == pytest.approx(1)
        for s, (_, w, cap) in zip(("big", "mid", "tiny"), targets, strict=False):
            assert rep[s].tokens == size[s] and rep[s].most_uses <= cap and rep[s].drawn_tokens <= cap * size[s]
        total = sum(size.values())
        capped = {s for s in size if rep[s].drawn_tokens == dict((a, c) for a, _, c in targets)[s] * size[s]}
        free = [s for s in size if s not in capped]
        assert sum(r.drawn_tokens for r in rep.values()) <= total + 50 * len(free)
        for a, b in itertools.combinations(free, 2):  # uncapped sources keep the proportion of their shares, a document apart
            wa, wb = (next(w for s, w, _ in targets if s == x) for x in (a, b))
            assert rep[a].drawn_tokens / wa == pytest.approx(rep[b].drawn_tokens / wb, rel=0.1)
        order = training_order(df, tg, bucket_tokens=bucket).collect()
        assert len(order) == sum(r.uses for r in rep.values()) and [r.position for r in order] == sorted(r.position for r in order)
        assert all(0 <= r.position <= 1 for r in order) and len({(r.doc_id, r.use) for r in order}) == len(order)
    late = training_order(df, tg, schedule={"mid": [(0.5, 0), (0.5001, 1), (1, 3)], "big": [(0, 2), (0.25, 2), (0.2501, 0), (0.75, 0), (0.7501, 2)], "tiny": [(0.3, 0)]}).collect()
    assert len(late) == len(order)
    at = lambda s: sorted(r.position for r in late if r.source == s)
    third = sum(p < 0.75 for p in at("mid")) / len(at("mid"))  # of the line from 1 to 3 over the second half: 0.75 / 2
    assert at("mid")[0] >= 0.5 and third == pytest.approx(0.375, abs=0.03) and not any(0.2502 < p < 0.75 for p in at("big")) and sum(p < 0.5 for p in at("big")) / len(at("big")) == pytest.approx(0.5, abs=0.05)
    assert sum(p < 0.5 for p in at("tiny")) / len(at("tiny")) == pytest.approx(0.5, abs=0.1)
    empty = mixture_report(df.filter("false"), tg).collect()
    assert all(r.uses == 0 and r.actual_share == 0 for r in empty)


# ---- repetition


def words(rng, n):
    return [("".join(rng.choice("abcdefghijklmnoprstuvw") for _ in range(rng.randrange(3, 9)))) for _ in range(n)]


def brute_share(text, k):
    t = [w for w in "".join(c if c.isalpha() else " " for c in text.lower()).split()]
    seen, hit = set(), [False] * len(t)
    for i in range(len(t) - k + 1):
        g = tuple(t[i : i + k])
        if g in seen:
            hit[i : i + k] = [True] * k
        seen.add(g)
    return sum(len(w) for w, h in zip(t, hit, strict=True) if h) / max(1, sum(map(len, t)))


def test_share_against_brute_force():
    rng = random.Random(8)
    texts = []
    for _ in range(40):
        base, phrase = words(rng, 60), words(rng, rng.randrange(8, 14))
        for _ in range(rng.randrange(5)):
            at = rng.randrange(len(base))
            base[at:at] = phrase
        texts.append(" ".join(base))
    got = repeated_share(tokenize([*texts, None, "", "12 .. !"]))
    assert np.allclose(got[:40], [brute_share(x, 8) for x in texts]) and np.isnan(got[40:]).all()


def test_repetitive(spark):
    rng = random.Random(9)
    plain = [" ".join(words(rng, 80)) + "." for _ in range(30)]
    loop = "the old bell rings twice at dawn "
    jp = "回廊に戻り地下室を越え"
    docs = [(i, t, "en") for i, t in enumerate(plain)]
    docs += [(100, plain[0] + " " + loop * 30, "EN"), (101, "\n".join(f"{i}. Same line again, HERE!" if i % 2 else "same line again here" for i in range(60)), None), (102, jp * 40, "ja-JP"), (103, None, "en"), (104, "", None), (105, "   ", "de"), (106, loop * 20_000, "en"), (100, plain[0] + " " + loop * 30, "EN"), (None, loop * 30, "en")]
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id bigint, text string, lang string, perplexity string")
    assert {r.doc_id for r in repetitive(df).collect()} == {100, 101, 102, 106}
    rows = self_perplexity(df, shares=True).collect()
    assert len(rows) == len(docs) - 1 and all(r.perplexity is None for r in rows if r.doc_id in (103, 104, 105))
    assert repetitive(df.filter("false")).count() == 0


# ---- names


def test_edits_against_brute_force():
    def dl(a, b):
        d = [[max(i, j) if not i or not j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
                if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                    d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
        return d[-1][-1]

    rng = random.Random(1)
    for _ in range(3000):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randrange(7))) for _ in range(2))
        for limit in (0, 1, 2):
            assert min(dl(a, b), limit + 1) == edits(a, b, limit), (a, b, limit)


@pytest.mark.parametrize(("text", "name", "person", "want"), [
    ("Dr. Soren Finquensarby", "Søren Finquensarby", True, STRONG), ("Finquensarby, Søren", "Søren Finquensarby", True, STRONG), ("FINQUENSARBY Søren", "Søren Finquensarby", True, STRONG), ("S. Finquensarby", "Søren Finquensarby", True, WEAK), ("Mr Finquensarby", "Søren Finquensarby", True, WEAK),
    ("Lars Finquensarby", "Søren Finquensarby", True, NO), ("Zach Uldramoor", "Zachary Uldramoor", True, STRONG), ("Zahcary Uldrammoor", "Zachary Uldramoor", True, STRONG), ("the RHS", "Renhel Historical Society", False, WEAK), ("University of Lartel", "Lartel University", False, STRONG), ("Lartel Univ.", "Lartel University", False, STRONG),
    ("The Lartel University, Ltd.", "Lartel University", False, STRONG), ("Lartel Observatory", "Lartel University", False, NO), ("澤濱・遥人先生", "沢浜 遥人", True, STRONG), ("沢浜遥花", "沢浜 遥人", True, NO), ("", "x y", True, NO),
])
def test_compare(text, name, person, want):
    assert compare(text, name, person)[0] == want


def test_link_mentions(spark):
    res = [("r1", "Søren Finquensarby", None, ["Person"], "e"), ("r2", "Lars Finquensarby", [], ["Person"], "e"), ("r3", " Lartelhelm University ", ["Lartelhelm Univ.", None], ["Organization"], "e"), ("r4", "沢浜　遥人", None, ["Person"], "e"), ("r5", "Mount Lartelhelm", None, ["Place"], "e"), ("r6", None, None, ["Person"], "e"), (None, "Nobody Here", None, ["Person"], "e")]
    m = [(1, "S. Finquensarby", "Dr Søren Finquensarby", ["Person"]), (2, "Mr Finquensarby", "Mr Finquensarby", ["Person"]), (3, None, "Larrs Finquensarby", ["Entity"]), (4, "the LU", "Lartelhelm Univresity", ["Organization"]), (5, "Lartelhelm University", None, ["Organization"]), (6, "澤濱遥人さん", "沢浜遥人", ["Person"]), (7, "Otto Finquensarby", "Mr Finquensarby", ["Person"]),
         (8, "", " ", ["Person"]), (9, None, None, None), (10, "Lartelhelm University", "Lartelhelm University", ["Person"]), (1, "S. Finquensarby", "Dr Søren Finquensarby", ["Person"]), (None, "Lars Finquensarby", None, ["Person"]), (11, "x" * 50_000, "y z", None)]
    rs = spark.createDataFrame(res, "resource_id string, label string, aliases array<string>, types array<string>, mention string")
    ms = spark.createDataFrame(m, "mention_id bigint, mention string, label string, types array<string>")
    got = {r.mention_id: (r.resource_id, r.as_label) for r in link_mentions(ms, rs).collect()}
    assert got == {1: ("r1", False), 3: ("r2", False), 4: ("r3", False), 5: ("r3", True), 6: ("r4", False)}
    assert link_mentions(ms.filter("false"), rs).count() == 0 and link_mentions(ms, rs.filter("false")).count() == 0
    more = ms.unionByName(spark.createDataFrame([(20, "Quentin Dalmorvertan", None, ["Person"]), (21, "Qeuntin Dalmorvertan", "Dalmorvertan, Quentin", ["Person"]), (22, "Ursula Dalmorvertan", None, ["Person"])], ms.schema))
    groups = {r.mention_id: r.group_id for r in group_mentions(more, rs).collect()}
    assert groups[3] == "r2" and groups[20] == groups[21] == "mention:20" and groups[22] == "mention:22" and len(groups) == 12


def test_candidates_hold_every_accepted_pair(spark):
    given, last = ["Anna", "William", "Katherine", "Jo"], ["Smith", "Marlowe", "Ek", "Finquensarby"]
    names = [(f"r{i}", f"{g} {x}", True) for i, (g, x) in enumerate((g, x) for g in given for x in last)]
    names += [(f"f{i}", f"Anna Q{'abcdefghijklmnopqrstuvwxy'[i]}lvane", True) for i in range(25)] + [("o1", "Lartel Historical Society", False), ("o2", "Ox Press " * 12, False)]
    texts = ["Anna Smyth", "Smyth", "Bill Smith", "Kate Marlwoe", "W. Marlowe", "J. Smiht", "Jo Ek", "Ek, Jo", "Anna Qalvnae", "Qblvane Ana", "Society Lartel Hist.", "Larel Histroical Society", "the LHS", "Ox Press " * 11 + "Xo Pres", "Ox Prses " + "Ox Press " * 11, "Wiliam Finquensarbi"]
    got = {(r.text, r.resource_id) for r in link_spellings(spark.createDataFrame([(t,) for t in texts], "text string"), spark.createDataFrame(names, "resource_id string, name string, person boolean")).collect()}
    kept = sorted({f for _, n, person in names for f in forms(n, person)})
    w = gram_weights(spark.createDataFrame([(i, *f) for i, f in enumerate(kept)], "fid bigint, fam string, s string"))

    def cosine(t, n, person):
        both = [(x, y, f) for f, x in forms(t) for g, y in forms(n, person) if f == g]
        return max(cosines(*map(list, zip(*both)), w), default=0) if both else 0

    want = {(t, i) for t in texts for i, n, person in names if compare(t, n, person)[0] != NO and cosine(t, n, person) >= LEAST_COSINE}
    assert got == want and {t for t, _ in want} >= {"Smyth", "Anna Smyth", "Anna Qalvnae", "Bill Smith", "J. Smiht", "Wiliam Finquensarbi", "Larel Histroical Society"}


def test_cosine_join_against_all_pairs(spark):
    rng = random.Random(3)
    syllables = ["dor", "pol", "cra", "fel", "mar", "tuk", "irb", "oss"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randrange(1, 6)))
    left, right = ([(i, rng.choice("csjqt"), word()) for i in range(300)] for _ in range(2))
    left += [(900, "c", "x" * 40_000), (901, "s", "ab"), (902, "j", "東京")]
    right += [(900, "j", "京東"), (901, "c", "a")]
    dfs = [spark.createDataFrame(x, "fid bigint, fam string, s string") for x in (left, right)]
    w = gram_weights(dfs[1])
    got = {(r.lid, r.rid): r.cosine for r in cosine_join(*dfs, w, 0.3).collect()}
    pairs = [(a, b) for a in left for b in right if a[1] == b[1]]
    all_ = cosines([a[2] for a, _ in pairs], [b[2] for _, b in pairs], [a[1] for a, _ in pairs], w)
    want = {(a[0], b[0]): c for (a, b), c in zip(pairs, all_, strict=True) if c >= 0.3}
    assert got.keys() == want.keys() and len(want) > 500 and (902, 900) in want and all(abs(got[k] - c) < 1e-9 for k, c in want.items())
    assert len(grams(["a\U0001f600b" * 3], ["c"])[0]) == 3 and cosine_join(dfs[0].filter("false"), dfs[1], w, 0.3).count() == 0


def test_known_spellings_meet_other_names_too(spark):
    names = [("r1", "Anna Finquensarby", True), ("r2", "Anna Finquensarbi", True), ("r3", "Taylor", False), ("r4", "Bo Tailor", True), ("r5", "Alex Quendolmarsk", True), ("r6", "Alexander Ossalgarthorpe", True), ("r7", "沢浜 遥人", True)]
    texts = ["Anna Finquensarby", "Taylor", "Tailor", "Alex Quendolmasrk", "Alex Ossalgarthorpe", "澤濱遥人"]
    links = link_spellings(spark.createDataFrame([(t,) for t in texts], "text string"), spark.createDataFrame(names, "resource_id string, name string, person boolean"))
    got = {(r.text, r.resource_id): r.cosine for r in links.collect()}
    assert got.keys() == {("Anna Finquensarby", "r1"), ("Anna Finquensarby", "r2"), ("Taylor", "r3"), ("Taylor", "r4"), ("Tailor", "r3"), ("Tailor", "r4"), ("Alex Quendolmasrk", "r5"), ("Alex Ossalgarthorpe", "r6"), ("澤濱遥人", "r7")}
    assert all(abs(got[k] - 1) < 1e-9 for k in (("Anna Finquensarby", "r1"), ("Taylor", "r3"), ("Tailor", "r4"), ("Alex Ossalgarthorpe", "r6"), ("澤濱遥人", "r7"))) and got["Anna Finquensarby", "r2"] < 1


def _near(text, name, person):
    return any(ANY in (x, y) or ((x ^ y) & ((1 << 64) - 1)).bit_count() <= NEAR_BAGS for x in bags(text) for y in bags(name, person))


def test_bags_of_all_that_compare_takes_are_near():
    rng = random.Random(8)
    words = ["anna", "jo", "bob", "robert", "alex", "alexander", "smith", "ek", "finquensarby", "a", "n", "society", "soc", "the", "of", "and", "dr", "ltd", "17", "müller", "muller"]
    taken = 0
    for _ in range(60_000):
        name = [rng.choice(words) for _ in range(rng.randrange(1, 5))]
        text = list(name) if rng.random() < 0.7 else [rng.choice(words) for _ in range(rng.randrange(1, 5))]
        rng.shuffle(text)
        text = " ".join(w[0] if rng.random() < 0.1 else w for w in text if rng.random() < 0.9)
        for _ in range(rng.randrange(3)):
            i = rng.randrange(len(text) + 1)
            text = rng.choice((text[:i] + rng.choice("abz") + text[i:], text[:i] + text[i + 1 :], text[:i] + text[i : i + 2][::-1] + text[i + 2 :], text[:i] + rng.choice("abz") + text[i + 1 :]))
        text = text.upper() if rng.random() < 0.1 else text
        for person in (True, False):
            if compare(text, " ".join(name), person)[0] != NO:
                taken += 1
                assert _near(text, " ".join(name), person), (text, name, person)
    assert taken > 5000


def test_common_ngrams_move_few_pairs(spark):
    kinds = ["Historical Society", "Survey Department", "Publishing Company"]
    rng = random.Random(4)
    stems = ["".join(rng.choice(["dor", "pol", "cra", "fel", "mar", "tuk", "irb", "oss"]) for _ in range(3)) for _ in range(200)]
    names = sorted({f"{x} {k}" for x in stems for k in kinds})
    rows = [(i, *f, b[0], b[-1]) for i, (n, b) in enumerate((n, sorted(bags(n, False))) for n in names) for f in forms(n, False)]
    assert all(len(bags(n, False)) <= 2 for n in names)
    df = spark.createDataFrame(rows, "fid bigint, fam string, s string, a bigint, b bigint")
    w = gram_weights(df)
    hits = {(r.lid, r.rid) for r in meeting(df, df, spark.sparkContext.broadcast(w), LEAST_COSINE, NEAR_BAGS).collect()}
    every = {(a, b) for a, x in enumerate(names) for b, y in enumerate(names) if x.split()[1:] == y.split()[1:]}  # these share n-grams of the prefixes
    assert {(i, i) for i in range(len(names))} <= hits and len(hits) < len(every) / 5
    taken = [(a, b) for a, b in every if compare(names[a], names[b], False)[0] != NO]
    each = cosines([rows[a][2] for a, _ in taken], [rows[b][2] for _, b in taken], ["c"] * len(taken), w)
    assert len(rows) == len(names) and {p for p, c in zip(taken, each, strict=True) if c >= LEAST_COSINE} <= hits


def test_cosine_join_of_equal_weights(spark):
    rng = random.Random(0)
    sides = [[(i, "j", "".join(rng.choice("abc") for _ in range(rng.randrange(*size)))) for i in range(150)] for size in ((3, 8), (15, 40))]
    dfs = [spark.createDataFrame(x, "fid bigint, fam string, s string") for x in sides]
    w = np.random.default_rng(0).choice(np.array([1, 2], dtype=np.float32), BUCKETS)
    pairs = [(a, b) for a in sides[0] for b in sides[1]]
    all_ = cosines([a[2] for a, _ in pairs], [b[2] for _, b in pairs], ["j"] * len(pairs), w)
    got = {(r.lid, r.rid) for r in cosine_join(*dfs, w, 0.5).collect()}
    assert got == {(a[0], b[0]) for (a, b), c in zip(pairs, all_, strict=True) if c >= 0.5} and len(got) > 1000


def test_average_linkage_against_one_merge_at_a_time(spark):
    rng = random.Random(12)
    n = 60
    sim = {(a, b): round(rng.random() ** 3, 3) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.15}
    sim |= {(a, a + 1): 0.9 for a in range(0, n - 1, 4)}
    clusters = {i: [i] for i in range(n)}

    def avg(x, y):
        return round(sum(sim.get((min(a, b), max(a, b)), 0) for a in clusters[x] for b in clusters[y]) / len(clusters[x]) / len(clusters[y]), 9)

    while True:
        far, x, y = min((-avg(x, y), x, y) for x in clusters for y in clusters if x < y)
        if -far < 0.3:
            break
        clusters[x] += clusters.pop(y)
    want = {i: k for k, c in clusters.items() for i in c}
    edges = spark.createDataFrame([(b, a, s) for (a, b), s in sim.items()] + [(1, 1, 0.9), (None, 2, 0.9)], "a bigint, b bigint, sim double")
    got = {r.node: r.cluster for r in average_linkage(edges, least=0.3).collect()}
    assert {i: got.get(i, i) for i in range(n)} == want and len(set(want.values())) < n
    assert average_linkage(edges.filter("false"), least=0.3).count() == 0
