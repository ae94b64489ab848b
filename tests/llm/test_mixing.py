import random

import pytest
from pyspark.sql import functions as F

from tidemark.llm.mixing import count_tokens, mix_sources, sainte_lague

DOCS = "doc_id long, text string, source string, shard int, n_tokens string"
TARGETS = "source_name string, target_share double, max_repeats int"


def highest_quotients(weights, seats, caps):
    out = [0] * len(weights)
    for _ in range(seats):
        open_ = [i for i in range(len(weights)) if out[i] < caps[i] and weights[i] > 0]
        if not open_:
            break
        out[max(open_, key=lambda i: (weights[i] / (2 * out[i] + 1), -i))] += 1
    return out


@pytest.mark.parametrize("seed", range(30))
def test_apportionment_equals_the_plain_method(seed):
    rng = random.Random(seed)
    n = rng.randrange(1, 9)
    weights = [rng.choice([0.0, 1.0, 0.3, rng.random(), 5.0]) for _ in range(n)]
    caps = [rng.randrange(0, 60) for _ in range(n)]
    seats = rng.randrange(0, 150)
    got = sainte_lague(weights, seats, caps)
    want = highest_quotients(weights, seats, caps)
    assert got == want


def test_apportionment_of_many_seats_is_exact_in_size():
    assert sum(sainte_lague([0.3, 0.7, 1e-9], 10**12 + 1)) == 10**12 + 1
    assert sainte_lague([], 5) == [] and sainte_lague([1.0], 0) == [0]


def documents(spark, sizes, rng, extra=()):
    rows, i = [], 0
    for source, n in sizes.items():
        for _ in range(n):
            i += 1
            rows.append((i, "word " * rng.randrange(5, 60), rng.choice([source, source.upper(), f" {source} "]), 0, "x"))
    return spark.createDataFrame(rows + list(extra), DOCS)


def test_shares_are_met_within_the_repeats(spark):
    docs = documents(spark, {"a": 900, "b": 120, "c": 60, "unwanted": 50}, random.Random(1))
    targets = spark.createDataFrame([("A ", 0.5, 1), ("b", 0.3, 3), ("c", 0.15, 4), ("none", 0.05, 2)], TARGETS)
    selection, shares = mix_sources(docs, targets, shard_tokens=4000)
    got = {r["source_name"]: r for r in shares.collect()}
    for name, share in (("a", 0.5), ("b", 0.3), ("c", 0.15)):
        assert got[name]["actual_share"] == pytest.approx(share / 0.95, rel=0.02) and not got[name]["falls_short"]
    assert got["none"]["falls_short"] and got["none"]["reason"] == "no documents" and got["none"]["used_tokens"] == 0
    rows = selection.collect()
    limits = {"a": 1, "b": 3, "c": 4}
    assert all(1 <= r["repeats"] <= limits[r["source_name"]] for r in rows) and len({r["doc_id"] for r in rows}) == len(rows)
    used = {n: sum(r["n_tokens"] * r["repeats"] for r in rows if r["source_name"] == n) for n in limits}
    assert used == {n: got[n]["used_tokens"] for n in limits}
    again = mix_sources(docs.repartition(3), targets, shard_tokens=4000)[0]
    assert {tuple(r) for r in again.collect()} == {tuple(r) for r in rows}
    assert {tuple(r) for r in mix_sources(docs, targets, seed=5, shard_tokens=4000)[0].collect()} != {tuple(r) for r in rows}


def test_a_given_size_lets_small_sources_fall_short(spark):
    docs = documents(spark, {"a": 400, "b": 20}, random.Random(2))
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 2)], TARGETS)
    got = {r["source_name"]: r for r in mix_sources(docs, targets, total_tokens=8000)[1].collect()}
    assert got["b"]["falls_short"] and got["b"]["reason"] == "repeats used up" and got["b"]["used_tokens"] >= 1.9 * got["b"]["available_tokens"]
    assert got["a"]["used_tokens"] + got["b"]["used_tokens"] == pytest.approx(8000, rel=0.03)


def test_nulls_empty_texts_and_empty_tables(spark):
    extra = [(None, "word " * 30, "a", 0, "x"), (9001, None, "a", 0, "x"), (9002, "", "a", 0, "x"), (9003, "word", None, 0, "x"), (9004, "word " * 5000, "a", 0, "x")]
    docs = documents(spark, {"a": 30}, random.Random(3), extra)
    targets = spark.createDataFrame([("a", 1.0, None), (None, 0.5, 1), ("z", None, 1), ("y", -1.0, 1)], TARGETS)
    rows = mix_sources(docs, targets)[0].collect()
    assert {9001, 9002, 9003}.isdisjoint({r["doc_id"] for r in rows}) and all(r["repeats"] == 1 for r in rows)
    none = spark.createDataFrame([], DOCS)
    selection, shares = mix_sources(none, targets)
    assert selection.count() == 0 and [(r["source_name"], r["falls_short"], r["actual_share"]) for r in shares.collect()] == [("a", True, 0.0)]
    assert mix_sources(docs, spark.createDataFrame([], TARGETS))[1].count() == 0


def test_token_counts_are_those_of_the_vocabulary(spark):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    t.encode_special_tokens = True
    texts = ["Hello world", "", None, "<|endoftext|> ok", "año 12345  \n\n x", "日本語"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = {r["i"]: r["n_tokens"] for r in count_tokens(df, "text", ["i"]).collect()}
    assert got == {i: len(t.encode(x, add_special_tokens=False).ids) if x else 0 for i, x in enumerate(texts)}
    assert count_tokens(df, "text", ["i"]).where(F.col("n_tokens") < 0).count() == 0
