"""Mixing sources to target weights by temperature."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, text_or_empty

#: White-space separated words stand for tokens unless a column is named.
WORDS = r"[^\x20\x09-\x0D]+"
BLOCK_TOKENS = 1 << 16
STEPS = 60
BROADCAST_SOURCES = 10_000


@dataclass(frozen=True)
class Mixture:
    exponent: float
    weights: dict[str, float]
    #: Tokens that the mixture has altogether, and of each source.
    budget: int
    quotas: dict[str, int]


def weights_at(tokens: dict[str, int], exponent: float) -> dict[str, float]:
    """Shares to the power ``exponent``, normalised; sources without tokens have none."""
    total = sum(tokens.values())
    raw = {s: (n / total) ** exponent for s, n in sorted(tokens.items()) if n > 0}
    z = math.fsum(raw.values())
    return {s: x / z for s, x in raw.items()}


def entropy(weights: dict[str, float]) -> float:
    return -math.fsum(w * math.log(w) for w in weights.values() if w > 0)


def solve(tokens: dict[str, int], target_entropy: float | None = None, max_repetition: float | None = None, budget: int | None = None) -> Mixture:
    """Bisect the exponent in [0, 1]: 1 keeps the shares, 0 makes all sources even.

    Entropy falls and repetition (quota over tokens of the most repeated source)
    falls as the exponent grows, so the smallest exponent within the repetition
    limit, or the largest that still reaches the entropy, is found by halving.
    Both limits given: the repetition limit wins.  Without ``budget`` the mixture
    is just large enough for every document once.
    """
    tokens = {s: n for s, n in tokens.items() if n > 0}
    if not tokens:
        return Mixture(1.0, {}, 0, {})

    def size(w: dict[str, float]) -> float:
        return budget if budget is not None else max(tokens[s] / w[s] for s in w)

    def repetition(a: float) -> float:
        w = weights_at(tokens, a)
        return max(size(w) * w[s] / tokens[s] for s in w)

    def least(ok) -> float:
        """The smallest exponent for which ``ok`` holds, given that it holds from some on."""
        if ok(0.0):
            return 0.0
        low, high = 0.0, 1.0
        for _ in range(STEPS):
            mid = (low + high) / 2
            low, high = (low, mid) if ok(mid) else (mid, high)
        return high

    exponent = 0.0 if target_entropy is not None or max_repetition is not None else 1.0
    if target_entropy is not None:
        # the largest exponent that reaches the entropy: the mirror image of least()
        exponent = 1.0 - least(lambda b: entropy(weights_at(tokens, 1.0 - b)) >= target_entropy)
    if max_repetition is not None:
        exponent = max(exponent, least(lambda a: repetition(a) <= max_repetition * (1 + 1e-12)))
    exponent = round(exponent, 9)
    w = weights_at(tokens, exponent)
    total = int(size(w)) if budget is not None else math.ceil(size(w))
    quotas = {s: int(total * w[s] + 1e-6) for s in w}
    if budget is None:
        top = max(w, key=lambda s: tokens[s] / w[s])
        quotas[top] = max(quotas[top], tokens[top])
        quotas = {s: max(q, tokens[s]) for s, q in quotas.items()}
    return Mixture(exponent, w, total, quotas)


def with_tokens(docs: DataFrame, tokens: str | None = None) -> DataFrame:
    """``docs`` with the columns ``__src`` and ``__tok``."""
    count = F.regexp_count(text_or_empty("text"), F.lit(WORDS)) if tokens is None else F.coalesce(F.col(tokens), F.lit(0))
    return docs.withColumns({"__src": F.coalesce(F.col("source"), F.lit("")), "__tok": count.cast("long")})


def copies(docs: DataFrame, target_entropy: float | None = None, max_repetition: float | None = 2.0, budget: int | None = None, seed: int = 17, tokens: str | None = None, key: str = "doc_id") -> DataFrame:
    """How often the mixture has each document: ``key``, ``source``, ``n_tokens``,
    ``n_copies``, one row per input row.

    Each source is taken in permutations of its blocks.  Documents are dealt into
    blocks of about ``BLOCK_TOKENS`` tokens by the hash of their id, so a hot
    source is many blocks; a permutation orders the blocks, and the documents in
    a block, by seeded hashes.  As many whole permutations as the source's quota
    holds give every document that many copies; of the last one, the leading
    documents whose running token count stays within the rest get one more.
    Running counts over blocks use one row per block; those over documents stay
    within the block at the border.

    ``block``, ``block_order`` and ``doc_order`` are the permutation: the last
    one's documents in the order of (block_order, block, doc_order, key); further
    epochs repeat it.

    A null source is the source ``""``; documents without tokens get the whole
    permutations alone, and one at least where no source has any tokens; a null
    id is an id like any; rows with the same id keep the order of their token
    counts.  An empty table gives an empty result.  The driver holds one number
    per source.
    """
    rows = with_tokens(docs.select(key, "source", tokens or "text"), tokens)
    # texts are read and counted once
    rows = materialise(rows.select(F.col(key).alias("key"), "source", "__src", "__tok"), "mixing")
    sizes = {r["__src"]: r["n"] for r in rows.groupBy("__src").agg(F.sum("__tok").alias("n")).toLocalIterator()}
    mix = solve(sizes, target_entropy, max_repetition, budget)
    spark = docs.sparkSession
    plan = [
        (s, mix.quotas.get(s, 0) // n if n else 1, mix.quotas.get(s, 0) % n if n else 0, max(1, -(-n // BLOCK_TOKENS)))
        for s, n in sizes.items()
    ]
    plan_df = spark.createDataFrame(plan, "__src string, whole long, rest long, blocks long")
    # sent to all tasks only while the sources are few; otherwise a shuffled join
    small = (lambda df: F.broadcast(df)) if len(plan) <= BROADCAST_SOURCES else (lambda df: df)
    dealt = rows.join(small(plan_df), "__src").withColumn("block", F.pmod(F.xxhash64("key", F.lit(seed)), F.col("blocks")))
    dealt = dealt.withColumns({"block_order": F.xxhash64("block", F.lit(seed + 1)), "doc_order": F.xxhash64("key", F.lit(seed + 2))})
    per_block = dealt.groupBy("__src", "block", "block_order").agg(F.sum("__tok").alias("t"), F.first("rest").alias("rest"))
    # running counts of a source's blocks: over RANGES ranges of the order, then in each
    per_block = per_block.withColumn("range", F.shiftright("block_order", 54))
    ahead = Window.partitionBy("__src").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = per_block.groupBy("__src", "range").agg(F.sum("t").alias("t")).select("__src", "range", F.coalesce(F.sum("t").over(ahead), F.lit(0)).alias("before"))
    in_range = Window.partitionBy("__src", "range").orderBy("block_order", "block").rowsBetween(Window.unboundedPreceding, 0)
    marks = per_block.join(ranges, ["__src", "range"]).withColumn("upto", F.col("before") + F.sum("t").over(in_range)).select(
        "__src", "block", (F.col("upto") <= F.col("rest")).alias("inside"), (F.col("rest") - F.col("upto") + F.col("t")).alias("left")
    )
    border = marks.filter(~F.col("inside") & (F.col("left") > 0)).select("__src", "block", "left")
    in_block = Window.partitionBy("__src", "block").orderBy("doc_order", "key", "__tok").rowsBetween(Window.unboundedPreceding, 0)
    chosen = (
        dealt.join(small(border), ["__src", "block"])  # one block per source at most
        .withColumn("run", F.sum("__tok").over(in_block))
        .filter("run <= left and __tok > 0")
        .groupBy(F.col("key").alias("ckey"), F.col("__src").alias("csrc"), F.col("__tok").alias("ctok"))
        .agg(F.count("*").alias("more"))
    )
    inside = marks.filter("inside").select("__src", "block", F.lit(True).alias("inside"))
    out = (
        dealt.join(inside, ["__src", "block"], "left")
        .join(chosen, F.col("key").eqNullSafe(F.col("ckey")) & (F.col("__src") == F.col("csrc")) & (F.col("__tok") == F.col("ctok")), "left")
    )
    extra = F.when(F.col("inside") & (F.col("__tok") > 0), 1).when(F.col("more") > 0, 1).otherwise(0)
    return out.select(F.col("key").alias(key), "source", F.col("__tok").alias("n_tokens"), (F.col("whole") + extra).cast("long").alias("n_copies"), "block", "block_order", "doc_order")


def mix(docs: DataFrame, counted: DataFrame | None = None, **options) -> DataFrame:
    """``docs`` with each document as often as :func:`copies` says; all columns
    stay, whatever their names.  Ids are taken to be unique; rows that share one
    are copied alike.  ``counted`` (key, source and a column of tokens that
    ``tokens`` names) saves counting the words of ``docs``."""
    key = options.get("key", "doc_id")
    n = copies(docs if counted is None else counted, **options).groupBy(F.col(key).alias("key")).agg(F.max("n_copies").cast("int").alias("n"))
    own = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(key).alias("own"))
    out = own.join(n, F.col("own").eqNullSafe(F.col("key"))).filter("n > 0")
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n")))).select("row.*")
