"""Mixing sources to target shares of the total tokens.

Equal-token blocks are the seats of a Sainte-Laguë apportionment: first among the sources, then
among the shards of each source, with what a source can supply (its tokens times its repeats) as
cap. Every shard then fills its integer quota of blocks from its own documents in a seeded order.
Shards are of bounded size, so a source that holds most of the corpus is many tasks, and the driver
sees figures of sources and shards only.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator, Sequence
from functools import lru_cache
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import cut_lineage

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
TOKENIZER = "byte_bpe_50k"
#: Rows of quotas up to which they are broadcast.
_MOST_BROADCAST = 200_000
#: Fixed value: the splitting pattern that belongs to the vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=4)
def _encoding(lines: bytes):
    """The tokenizer of a vocabulary, built once in each worker."""
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines.splitlines() if line.strip())}
    return tiktoken.Encoding("mixing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(df: DataFrame, text: str, keep: Sequence[str], vocabulary: str = VOCABULARY) -> DataFrame:
    """``keep`` and ``n_tokens``, the tokens of the whole text; 0 for null or empty text. Special tokens' strings are ordinary text.

    The vocabulary is read on the driver and sent with the job; one over 64 MB is refused.
    """
    source = df.select(*keep, F.col(text).alias("_text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields if f.name != "_text"), "n_tokens long"])
    lines = Path(vocabulary).read_bytes()
    if len(lines) > 64_000_000:
        raise ValueError(f"{vocabulary} is too large for a vocabulary")
    shared = df.sparkSession.sparkContext.broadcast(lines)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoding = _encoding(shared.value)
        for batch in batches:
            yield batch.assign(n_tokens=[len(encoding.encode_ordinary(t)) if t else 0 for t in batch.pop("_text")])

    return source.mapInPandas(count, schema)


def sainte_lague(weights: Sequence[float], seats: int, caps: Sequence[int] | None = None) -> list[int]:
    """Seats by highest quotients weight / (2 s + 1), none beyond its cap; ties go to the earlier entry.

    Found by bisection for the quotient that all but the last seats pass, so the work does not
    depend on the number of seats. Fewer seats are given only if all caps are reached.
    """
    size = np.asarray(weights, float)
    caps = np.array([seats if c is None else min(int(c), seats) for c in (caps if caps is not None else [None] * len(size))], np.int64)
    caps[size <= 0] = 0
    seats = min(seats, int(caps.sum()))
    if seats <= 0:
        return [0] * len(size)

    def given(quotient: float) -> np.ndarray:
        """Seats whose quotient is above ``quotient``."""
        with np.errstate(divide="ignore", over="ignore"):
            free = np.ceil((size / quotient - 1) / 2)
        return np.where(size > (2 * caps - 1) * quotient, caps, np.clip(free, 0, caps)).astype(np.int64)

    low, high = 0.0, float(size.max()) * 2
    for _ in range(2000):
        middle = (low + high) / 2
        if middle in (low, high):
            break
        if given(middle).sum() > seats:
            low = middle
        else:
            high = middle
    out = given(high)
    while (left := seats - int(out.sum())) > 0:
        # All that is left ties at one quotient: a seat each, in the order given.
        quotient = np.where(out < caps, size / (2 * out + 1), -1.0)
        out[np.argsort(-quotient, kind="stable")[: min(left, max(1, int((quotient == quotient.max()).sum())))]] += 1
    return out.tolist()


def mix_sources(
    documents: DataFrame,
    targets: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    block_tokens: int = 128,
    total_tokens: int | None = None,
    seed: int = 20240,
    shard_tokens: int = 8_000_000,
    vocabulary: str = VOCABULARY,
) -> tuple[DataFrame, DataFrame]:
    """(selection, shares) of a mix in which each source has its target share of all tokens.

    targets: ``source_name, target_share, max_repeats``, a table of parameters that the driver reads.
    selection: ``doc_id, source_name, n_tokens, repeats`` of each document used at least once;
    repeats never exceeds the source's max_repeats. shares: for each target ``source_name, target_share,
    max_repeats, documents, available_tokens, used_tokens, actual_share, falls_short, reason``.

    total_tokens: size of the mix. By default the largest at which every target source that has
    tokens can still supply its share within its repeats; then only sources without tokens fall
    short, and their share goes to the others in proportion. With a given size a source may run out: it
    is used to its cap, and its remaining blocks go to the next highest quotients. A source falls
    short if its share of the mix stays under its target by more than 2 % of it, or it has nothing.

    Source names are trimmed and lower-cased; documents of null or other sources are not used, nor
    are those without tokens (null or empty text). A null max_repeats is 1; targets with a null or
    non-positive share are not used. Repeated documents are documents; a long one may exceed a block and
    is used whole. Blocks have one length at all sizes: a source of
    fewer than 25 blocks may miss its share by over 2 %. The same seed, documents and
    targets give the same selection. Empty tables give an empty selection. The number of shards, about which
    alone the driver learns, is the tokens over ``shard_tokens``; no shard is larger, however large its source.
    """
    spark = documents.sparkSession
    wanted = [
        (r[0].strip().lower(), float(r[1]), max(0, 1 if r[2] is None else int(r[2])))
        for r in targets.select("source_name", "target_share", "max_repeats").collect()
        if r[0] is not None and r[1] is not None and r[1] > 0
    ]
    names = [w[0] for w in wanted]
    named = F.lower(F.trim(F.col(source)))
    # Only the counts stay: the texts are read and tokenised once.
    used = documents.select(F.col(doc_id).alias("doc_id"), named.alias("source_name"), F.col(text).alias("_whole")).where(F.col("source_name").isin(names))
    counted = cut_lineage(count_tokens(used, "_whole", ["doc_id", "source_name"], vocabulary).where(F.col("n_tokens") > 0))
    totals = {r["source_name"]: (r["n"], r["t"]) for r in counted.groupBy("source_name").agg(F.count(F.lit(1)).alias("n"), F.sum("n_tokens").alias("t")).collect()}
    block = block_tokens

    shards = {n: -(-totals[n][1] // shard_tokens) for n in totals}
    count = F.create_map(*[x for n, k in shards.items() for x in (F.lit(n), F.lit(k))])[F.col("source_name")] if shards else F.lit(1)
    order = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("n_tokens"))
    placed = counted.withColumn("shard", F.pmod(F.xxhash64(F.col("doc_id"), F.lit(seed + 1)), count).cast("int")).withColumn("_order", order)
    sizes: dict[str, list[tuple[int, int]]] = {n: [] for n in names}
    for r in placed.groupBy("source_name", "shard").agg(F.sum("n_tokens").alias("t")).orderBy("source_name", "shard").collect():
        sizes[r["source_name"]].append((r["shard"], r["t"]))

    caps = {n: [repeats * t // block for _, t in sizes[n]] for n, _, repeats in wanted}
    present = [(n, share) for n, share, _ in wanted if sum(caps[n]) > 0]
    whole = sum(share for _, share in present)
    if total_tokens is None:
        seats = min((math.floor(sum(caps[n]) * whole / share) for n, share in present), default=0)
    else:
        seats = total_tokens // block
    quotas = dict(zip(names, sainte_lague([share for _, share, _ in wanted], seats, [sum(caps[n]) for n in names])))
    plan = []
    for n, _, _ in wanted:
        each = sainte_lague([t for _, t in sizes[n]], quotas[n], caps[n])
        plan += [(n, shard, q * block // t, q * block % t, t) for (shard, t), q in zip(sizes[n], each)]
    quota = spark.createDataFrame(plan, "source_name string, shard int, _passes long, _rest long, _size long")

    inside = Window.partitionBy("source_name", "shard")
    drawn = placed.join(F.broadcast(quota) if len(plan) <= _MOST_BROADCAST else quota, ["source_name", "shard"])
    running = F.sum("n_tokens").over(inside.orderBy("_order", "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    width = F.greatest(F.lit(1.0), F.col("_size") / F.greatest(F.lit(1.0), F.round(F.col("_size") / F.lit(block))))
    drawn = drawn.withColumn("_block", F.floor((running - F.col("n_tokens") / 2) / width))
    drawn = drawn.withColumn("_draw", F.xxhash64(F.lit(seed + 2), "source_name", "shard", "_block"))
    # Whole blocks in their drawn order fill the rest of the quota; of the block that reaches it, the documents that come nearer.
    upto = F.sum("n_tokens").over(inside.orderBy("_draw", "_block", "_order", "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    picked = drawn.withColumn("_extra", F.when(upto - F.col("n_tokens") / 2 <= F.col("_rest"), 1).otherwise(0))
    selection = picked.select("doc_id", "source_name", "n_tokens", (F.col("_passes") + F.col("_extra")).cast("int").alias("repeats")).where(F.col("repeats") > 0)

    # A figure for each target.
    realised = {r["source_name"]: int(r["used"]) for r in selection.groupBy("source_name").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("used")).collect()}
    whole = sum(realised.values())
    rows = [(n, share, repeats, *map(int, totals.get(n, (0, 0))), realised.get(n, 0), realised.get(n, 0) / whole if whole else 0.0) for n, share, repeats in wanted]
    shares = spark.createDataFrame(rows, "source_name string, target_share double, max_repeats int, documents long, available_tokens long, used_tokens long, actual_share double")
    short = F.col("actual_share") < F.col("target_share") * 0.98
    spent = F.col("used_tokens") >= F.col("available_tokens") * F.col("max_repeats") * 0.98 - block
    reason = F.when(F.col("available_tokens") == 0, "no documents").when(short & spent, "repeats used up").when(short, "documents too coarse")
    return selection, shares.withColumn("falls_short", short).withColumn("reason", reason)
