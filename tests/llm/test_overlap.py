import random

import numpy as np

from tidemark.llm.overlap import Seeds, find_leaks, read_through, rolling, tiling
from tidemark.llm.words import folded, speech, wide

WORDS = "ferry canal tower amber resin slate windmill harbour moved sealed counted northern vaulted because each support mercury barrels measured autumn market rebuilt".split()
DOCS = "doc_id long, text string, item_id int"
ITEMS = "item_id long, passage string, doc_id int"


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


def longest_common(a, b):
    best, row = 0, [0] * (len(b) + 1)
    for x in a:
        new = [0] * (len(b) + 1)
        for j, y in enumerate(b):
            if x == y:
                new[j + 1] = row[j] + 1
                best = max(best, new[j + 1])
        row = new
    return best


def test_matches_brute_force(spark):
    rng = random.Random(9)
    items = [(i, sentence(rng, rng.randrange(18, 60)), 0) for i in range(12)]
    docs = []
    for d in range(60):
        text = sentence(rng, rng.randrange(0, 80))
        if d % 2:
            words = items[rng.randrange(12)][1].split()
            k = rng.randrange(8, 24)
            at = rng.randrange(max(1, len(words) - k))
            text += " " + " ".join(words[at : at + k]) + " " + sentence(rng, 5)
        docs.append((d, text, 0))
    got = {(r["doc_id"], r["item_id"]): r["longest"] for r in find_leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), min_coverage=9.0).collect()}
    want = {}
    for d, text, _ in docs:
        for i, passage, _ in items:
            n = longest_common(folded(text), folded(passage))
            if n >= 16:
                want[(d, i)] = n
    assert got == want and len(want) > 8
    blocks = find_leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), min_coverage=9.0, block_chars=900)
    assert {(r["doc_id"], r["item_id"]): r["longest"] for r in blocks.collect()} == want


PASSAGE = "Travellers from Gadok to Paidrik counted 282 canals along the vaulted observatory during spring 1794. Measured against the quarry of Fikrain a northern aqueduct holds about 172 litres of tin in winter"
SUBTITLE = """﻿1\r
00:00:01,000 --> 00:00:03,000\r
<i>NARRATOR: TRAVELLERS from Gad0k to Paidrik</i>\r
\r
2\r
00:00:04,000 --> 00:00:06,000\r
{\\an8}countcd 282 canals along the vau1ted\r
[door creaks]\r
observat0ry during\r
\r
3\r
00:00:07,000 --> 00:00:09,000\r
WOMAN: spring 1794! Measured, against the quarry\r
(sighs)\r
of Fikrain\r
"""


def test_reads_through_the_damage_of_subtitles(spark):
    docs = spark.createDataFrame([(1, SUBTITLE, 0), (2, SUBTITLE, 0), (3, " ".join(PASSAGE.split()[:15]), 0)], DOCS)
    rows = find_leaks(docs, spark.createDataFrame([(7, PASSAGE, 0)], ITEMS)).collect()
    assert sorted((r["doc_id"], r["item_id"], r["longest"]) for r in rows) == [(1, 7, 21), (2, 7, 21)]


def test_reordered_passages_add_up(spark):
    words = PASSAGE.split()
    parts = [words[i : i + 11] for i in range(0, 33, 11)]
    text = " then ".join(" ".join(p) for p in (parts[2], parts[0], parts[1]))
    r = find_leaks(spark.createDataFrame([(1, text, 0)], DOCS), spark.createDataFrame([(7, PASSAGE, 0)], ITEMS), gap_words=0).first()
    assert (r["longest"], r["covered"], r["tiles"], r["item_words"]) == (11, 32, 3, len(words))
    assert find_leaks(spark.createDataFrame([(1, " ".join(parts[2]), 0)], DOCS), spark.createDataFrame([(7, PASSAGE, 0)], ITEMS)).count() == 0


def test_other_scripts_short_items_and_encodings(spark):
    russian = "весной тысяча семьсот девяносто четвертого года путешественники насчитали двести каналов вдоль старой сводчатой обсерватории рядом с большой рекой и мельницей у дороги"
    spanish = "El túnel de Pedas fue fundado por Thin en otoño y cada año los vecinos perdían toneladas de sal junto al río más frío"
    broken = spanish.encode().decode("cp1252", "replace")
    docs = [(1, russian.upper(), 0), (2, broken, 0), (3, spanish.replace("ñ", "�").replace("í", "?"), 0), (4, "prefix only tiny words here", 0)]
    items = [(1, russian, 0), (2, spanish, 0), (3, "tiny words", 0), (4, "tiny swords", 0)]
    rows = find_leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in rows) == [(1, 1), (2, 2), (3, 2), (4, 3)]


def test_nulls_empty_repeats_and_long_texts(spark):
    long = " ".join(f"w{i}" for i in range(200_000)) + " " + PASSAGE + " " + PASSAGE * 200
    docs = spark.createDataFrame([(None, PASSAGE, 0), (1, None, 0), (2, "", 0), (3, long, 0), (3, long, 0), (4, "♪", 0)], DOCS)
    items = spark.createDataFrame([(7, PASSAGE, 0), (8, None, 0), (9, "", 0), (None, PASSAGE, 0), (10, "...", 0)], ITEMS)
    rows = sorted((r["doc_id"] or 0, r["item_id"] or 0) for r in find_leaks(docs, items).collect())
    assert rows == [(0, 0), (0, 7), (3, 0), (3, 0), (3, 7), (3, 7)]
    none = spark.createDataFrame([], DOCS)
    assert find_leaks(none, items).count() == 0 and find_leaks(docs, spark.createDataFrame([], ITEMS)).count() == 0


def test_parts():
    t = np.arange(1, 9, dtype=np.uint64)
    assert len(rolling(t, 3)) == 6 and len(rolling(t, 9)) == 0 and rolling(np.r_[t, t], 4)[0] == rolling(np.r_[t, t], 4)[8]
    assert tiling(np.array([[0, 5, 100], [0, 5, 30], [10, 10, 9]]), 5) == [10, 9, 5]
    assert speech("12\n00:01 --> 00:02\nBOY: Hi <b>there</b> [laughs]\n\n13\nYou").split() == ["Hi", "there", "You"]
    assert folded("modern clown") == folded("m0dem cIown".replace("m0dem", "m0dern")) and folded("well") == folded("vvcll")
    assert wide("Ｆｕｌｌ ÉTÉ") == ["full", "été"]


def test_a_foreign_line_inside_a_passage_is_read_through(spark):
    words = PASSAGE.split()
    cut = lambda gap, a=9, b=10: " ".join(["so", *words[:a], *(f"other{k}" for k in range(gap)), *words[a : a + b], "end"])
    docs = [(1, cut(4), 0), (2, cut(12), 0), (3, cut(13), 0), (4, cut(3, 12, 3), 0), (5, cut(3, 13, 4), 0), (6, " ".join(words[:9] + ["x"] * 3 + words[12:20]), 0)]
    got = {r["doc_id"]: r["longest"] for r in find_leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame([(7, PASSAGE, 0)], ITEMS), min_coverage=9.0).collect()}
    assert got == {1: 19, 2: 19, 5: 17}
    a, b = np.arange(1, 30, dtype=np.uint64), np.r_[np.arange(1, 5), [90, 91], np.arange(5, 15), [92], np.arange(15, 18)].astype(np.uint64)
    assert read_through(b, a, 6, 4, 10, 3) == 17 and read_through(b, a, 6, 4, 10, 1) == 13


def test_a_preamble_that_many_items_share_stays_bounded(spark):
    """Ten thousand items begin alike; documents with the beginning carry none of them, those with more carry one."""
    rng = random.Random(3)
    preamble = "read the following story about the old harbour town with care and then answer"
    items = [(i, f"{preamble} {sentence(rng, 12)} number{i}", 0) for i in range(10_000)]
    docs = [(d, f"{sentence(rng, 20)} {preamble} plainly {sentence(rng, 20)}", 0) for d in range(150)] + [(900 + k, items[k * 7][1], 0) for k in range(5)]
    rows = find_leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).collect()
    assert {(r["doc_id"], r["item_id"]) for r in rows} >= {(900 + k, k * 7) for k in range(5)} and all(r["doc_id"] >= 900 for r in rows)
    seeds = Seeds([np.arange(8, dtype=np.uint64)] * 50, 8)
    tokens, starts = np.tile(np.arange(8, dtype=np.uint64), 40), np.arange(0, 321, 8)
    parts = list(seeds.matches(tokens, starts, most=200))
    assert len(parts) == 10 and sum(h.shape[1] for _, h in parts) == 2000


def test_equal_hashes_of_other_words_do_not_count():
    seeds = Seeds([np.arange(8, dtype=np.uint64)], 8)
    seeds.flat = seeds.flat + np.uint64(1)  # the table's hashes now belong to other words
    assert list(seeds.matches(np.arange(8, dtype=np.uint64), np.array([0, 8]))) == []
