"""Temperature mixing of sources, realised as budgeted block permutations.

A source's weight is its share of the tokens to the power of an exponent, normalised. The exponent is searched between 0
(all sources alike) and 1 (as they are): the least one whose largest repetition stays within `repetition_limit`, or with
`target_entropy` (a part of the greatest entropy) the largest one that reaches it. The search narrows its interval 32
fold a round by evaluating 33 exponents in one aggregation over the table of shares, so no share is collected.

The default budget is the least with which no source loses a document: a source that the weights hold down is used once,
the others more often. A source's documents lie in blocks by a hash of the id, at most `MAX_BLOCKS` and one for each
source. Each pass over a source takes its blocks in an order drawn anew for the pass; whole passes take all blocks, the
last one takes them until the budget is met, the block on the border up to a hash of the id. So which copies a row gets
follows from its source, its block and its hash by a join with the small plan, and texts are never shuffled.

Tokens are words between blanks. Defined cases: a null or blank text has no tokens and is taken with its block; a null
source is a source of its own; a source without tokens is used once; rows of one id and source are placed together;
only the id, the source and the text are read; an empty table gives an empty plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, table

BLOCK_TOKENS, MAX_BLOCKS, SEED = 100_000, 1 << 16, 7
PLAN_ROWS = 1_000_000  # up to here the plan is sent to all executors


def n_tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t\n\x0B\f\r]+")), F.lit(0)).cast("long")


def _least_exponent(shares: DataFrame, repetition_limit: float | None, target_entropy: float | None) -> float:
    """shares: column s, shares over zero. Both measures are monotone in the exponent."""
    lo, hi = 0.0, 1.0
    for _ in range(4):
        grid = [lo + (hi - lo) * k / 32 for k in range(33)]
        # Repetition of a source against the one used once: (s / largest)^(a - 1).
        sums = [x for k, a in enumerate(grid) for x in (F.sum(F.pow("s", F.lit(a))).alias(f"z{k}"), F.sum(F.pow("s", F.lit(a)) * F.log("s")).alias(f"l{k}"))]
        r = shares.agg(F.min("s").alias("low"), F.max("s").alias("top"), F.count("*").alias("n"), *sums).first()
        if not r.n or r.n == 1:
            return 1.0
        import math

        if target_entropy is not None:
            good = [math.log(r[f"z{k}"]) - a * r[f"l{k}"] / r[f"z{k}"] >= target_entropy * math.log(r.n) for k, a in enumerate(grid)]
            k = max((k for k, g in enumerate(good) if g), default=0)  # entropy falls as the exponent grows
            lo, hi = grid[k], grid[min(k + 1, 32)]
        else:
            good = [(r.top / r.low) ** (1 - a) <= repetition_limit for a in grid]
            k = min((k for k, g in enumerate(good) if g), default=32)  # repetition falls as the exponent grows
            lo, hi = grid[max(k - 1, 0)], grid[k]
    return lo if target_entropy is not None else hi


def weights(tokens: DataFrame, repetition_limit: float | None = 2.0, target_entropy: float | None = None, budget_tokens: float | None = None) -> DataFrame:
    """source, tokens, weight, repeats, exponent, n_blocks from rows (source, n_tokens)."""
    sums = materialise(tokens.groupBy("source").agg(F.sum("n_tokens").alias("tokens")), "shares")
    total = sums.agg(F.sum("tokens").alias("t")).first().t or 0
    shares = sums.where("tokens > 0").select((F.col("tokens") / F.lit(float(total or 1))).alias("s"))
    exponent = _least_exponent(shares, repetition_limit, target_entropy)
    z = shares.agg(F.sum(F.pow("s", F.lit(exponent))).alias("z"), F.max("s").alias("top")).first()
    share = F.col("tokens") / F.lit(float(total or 1))
    weight = F.when(F.col("tokens") > 0, F.pow(share, F.lit(exponent)) / F.lit(z.z or 1.0)).otherwise(F.lit(0.0))
    whole = (z.top or 1.0) ** (1 - exponent) * (z.z or 1.0) * (total or 1)  # the largest source used once
    budget = float(whole if budget_tokens is None else budget_tokens)
    repeats = F.when(F.col("tokens") > 0, F.round(F.col("weight") * F.lit(budget) / F.col("tokens"), 9)).otherwise(F.lit(1.0))
    block = max(BLOCK_TOKENS, (total or 0) / MAX_BLOCKS)
    return sums.withColumn("weight", weight).withColumns({"repeats": repeats, "exponent": F.lit(exponent), "n_blocks": F.greatest(F.lit(1), F.ceil(F.col("tokens") / F.lit(float(block)))).cast("int")})


def _hash(*of) -> Column:
    return F.xxhash64(*of, F.lit(SEED))


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def _small(df: DataFrame) -> DataFrame:
    """To be broadcast as long as it has at most PLAN_ROWS rows; else Spark joins by a shuffle."""
    return F.broadcast(df) if df.limit(PLAN_ROWS + 1).count() <= PLAN_ROWS else df


def in_blocks(rows: DataFrame, w: DataFrame, doc_id: str, source: str) -> DataFrame:
    names = w.select(F.col("source").alias("_s"), F.col("n_blocks").alias("_n"))
    return rows.join(_small(names), F.col(source).eqNullSafe(F.col("_s")), "left").withColumn("_block", F.pmod(_hash(F.col(doc_id)), F.coalesce("_n", F.lit(1))).cast("int")).drop("_s", "_n")


def plan(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", **how) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The table of weights, the plan by source, block and pass (`_before`: tokens of the pass before the block; `_until`: the last
    hash taken, or null for all), and the rows (doc_id, source, n_tokens, _block)."""
    rows = materialise(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), n_tokens(F.col(text)).alias("n_tokens")), "mix-tokens")
    w = materialise(weights(rows, **how), "mix-weights")
    rows = in_blocks(rows, w, "doc_id", "source")
    blocks = rows.groupBy("source", "_block").agg(F.sum("n_tokens").alias("_t")).withColumnRenamed("source", "_src")
    joined = blocks.join(_small(w), _same("_src", "source")).select("source", "_block", "_t", "tokens", "repeats")
    passes = joined.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(1), F.ceil("repeats")).cast("int") - 1)))
    order = Window.partitionBy("source", "epoch").orderBy(_hash("epoch", "_block"), "_block").rowsBetween(Window.unboundedPreceding, -1)
    passes = passes.withColumn("_before", F.coalesce(F.sum("_t").over(order), F.lit(0)))
    passes = passes.withColumn("_room", F.when(F.col("epoch") + 1 <= F.col("repeats"), F.lit(None).cast("double")).otherwise((F.col("repeats") - F.col("epoch")) * F.col("tokens")))
    passes = materialise(passes.where("_room is null or _before < _room"), "mix-passes")
    border = passes.where("_before + _t > _room").select(F.col("source").alias("_src"), F.col("_block").alias("_b"), "epoch", "_before", "_room")
    inside = rows.join(_small(border), _same("source", "_src") & (F.col("_block") == F.col("_b")))
    run = Window.partitionBy("source", "_block", "epoch").orderBy("_h").rangeBetween(Window.unboundedPreceding, -1)
    inside = inside.withColumn("_h", _hash("epoch", "doc_id")).withColumn("_sum", F.coalesce(F.sum("n_tokens").over(run), F.lit(0)) + F.col("_before"))
    cut = inside.where("_sum < _room").groupBy("source", "_block", "epoch").agg(F.max("_h").alias("_until"))
    cut = cut.select(F.col("source").alias("_src"), F.col("_block").alias("_b"), F.col("epoch").alias("_e"), "_until")
    out = passes.join(_small(cut), _same("source", "_src") & (F.col("_block") == F.col("_b")) & (F.col("epoch") == F.col("_e")), "left")
    out = out.select(F.col("source").alias("_psource"), F.col("_block").alias("_pblock"), "epoch", "_before", "_until")
    return w, materialise(out, "mix-plan"), rows


def copies(rows: DataFrame, the_plan: DataFrame, doc_id: str, source: str) -> DataFrame:
    """Rows with `_block`, as often as the plan takes them; adds epoch and _before."""
    met = rows.join(_small(the_plan), F.col(source).eqNullSafe(F.col("_psource")) & (F.col("_block") == F.col("_pblock")))
    return met.where(F.col("_until").isNull() | (_hash("epoch", doc_id) <= F.col("_until"))).drop("_psource", "_pblock", "_until")


def mixture(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", **how) -> DataFrame:
    """doc_id, source, n_tokens, weight, repeats, epoch, block and slot: how far, between 0 and 1, the copy lies in its source's budget.
    Reading all copies by slot keeps the weights at every point of the stream."""
    w, the_plan, rows = plan(docs, doc_id, source, text, **how)
    taken = copies(rows, the_plan, "doc_id", "source")
    run = Window.partitionBy("source", "epoch", "_block").orderBy(_hash("epoch", "doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    taken = taken.withColumn("_at", F.coalesce(F.sum("n_tokens").over(run), F.lit(0)) + F.col("_before")).withColumnRenamed("source", "_src")
    slot = F.when(F.col("tokens") > 0, (F.col("epoch") * F.col("tokens") + F.col("_at")) / (F.col("repeats") * F.col("tokens"))).otherwise(F.lit(0.0))
    return taken.join(_small(w), _same("_src", "source")).select("doc_id", "source", "n_tokens", "weight", "repeats", "epoch", F.col("_block").alias("block"), slot.alias("slot"))


def mixed_rows(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", **how) -> DataFrame:
    """The rows of docs with their own columns, each as often as the mixture takes it."""
    w, the_plan, _ = plan(docs, doc_id, source, text, **how)
    packed = docs.select(F.struct("*").alias("_row"), F.col(doc_id).alias("doc_id"), F.col(source).alias("source"))
    return copies(in_blocks(packed, w, "doc_id", "source"), the_plan, "doc_id", "source").select("_row.*")


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(table(spark, sf_dir, "documents"), repetition_limit=2.0)


QUERIES = {"op2_mix_sources": op2_mix_sources}
ORACLES: dict[str, str] = {}
