"""Mixing of sources to target shares of the tokens (problem 7).

Each source gets its certain whole copies first, so many as fit for every document; the rest
of its share is a sample without replacement by Pareto order sampling: documents are ranked
by their random odds divided by their inclusion odds, and the first ones are taken until the
tokens are reached.  Documents whose inclusion probability would be 1 or more are certain; they
are taken out and the probabilities of the others are rescaled until none is above 1.  The cut is found on counts by bins of the rank, twice, so that no source
is ever sorted or gathered as a whole.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wordloom.llm.encode import TOKENIZER, count_tokens
from wordloom.runtime import materialize

#: Bins of the rank in each of the two rounds.
BINS = 1024


@dataclass(frozen=True)
class Mix:
    """``documents``: doc_id, source, tokens, copies (1 or more).  ``shares``: a row for each
    target with its weight, the weight among the sources that have documents, and what came
    out."""

    documents: DataFrame
    shares: DataFrame


def _plan(sizes: dict[str, tuple[int, int, float, float]], targets: list, total: float | None) -> list[tuple]:
    """For each source with documents: target tokens, whole copies, tokens left to sample."""
    usable = [t for t in targets if t.source in sizes and (t.weight or 0) > 0 and (t.max_repeats or 0) > 0]
    weight = sum(t.weight for t in usable)
    if not usable:
        return []
    most = min(sizes[t.source][1] * t.max_repeats / (t.weight / weight) for t in usable)
    total = most if total is None else min(total, most)
    plan = []
    for t in usable:
        _, tokens, spread, _ = sizes[t.source]
        want = total * t.weight / weight
        whole = min(int(want / tokens + 1e-9), t.max_repeats)
        left = want - whole * tokens if whole < t.max_repeats else 0.0
        plan.append((t.source, want, whole, left if left > 1e-6 * tokens else 0.0, left / spread))
    return plan


def _certain(counted: DataFrame, weight: Column, plan: list[tuple], heaviest: dict[str, float]) -> dict[str, tuple[float, float, float]]:
    """For each sampled source the weight from which on documents are certain, the tokens left for
    the others, and the rate by which their weights become inclusion probabilities, all below 1."""
    spark = counted.sparkSession
    found = {p[0]: (float("inf"), p[3], p[4]) for p in plan if p[3] > 0}
    left, top = {s: rest for s, (_, rest, _) in found.items()}, dict(heaviest)
    while True:
        # What has been certain stays so: the rates only grow.
        over = {s: 1 / rate for s, (_, _, rate) in found.items() if rate * top[s] >= 1}
        if not over:
            return found
        table = spark.createDataFrame(list(over.items()), "source string, certain double")
        sums = (
            counted.join(F.broadcast(table), "source")  # a row for each source
            .groupBy("source")
            .agg(
                F.sum(F.when(weight >= F.col("certain"), F.col("tokens"))).alias("taken"),
                F.sum(F.when(weight < F.col("certain"), weight * F.col("tokens"))).alias("spread"),
                F.max(F.when(weight < F.col("certain"), weight)).alias("top"),
            )
            .collect()
        )
        for r in sums:
            rest = max(left[r.source] - (r.taken or 0), 0.0)
            found[r.source] = (over[r.source], rest, rest / r.spread if r.spread else 0.0)
            top[r.source] = r.top or 0.0


def _cut(counts: list, left: dict[str, float]) -> dict[str, tuple[int, float]]:
    """For each source the bin in which its tokens are reached, and what is left before it."""
    cut = {}
    for source, tokens in left.items():
        rest = tokens
        rows = sorted((r.bin, r.tokens) for r in counts if r.source == source)
        for bin_, size in rows:
            if size >= rest:
                break
            rest -= size
        cut[source] = (bin_ if rows else 0, rest)
    return cut


def mix_sources(
    documents: DataFrame,
    targets: DataFrame,
    total_tokens: float | None = None,
    size_power: float = 0.5,
    seed: int = 7,
    tokenizer: str = TOKENIZER,
) -> Mix:
    """Documents with numbers of copies, so that each source has its weight in the tokens.

    ``documents``: doc_id, text, source; ``targets``: source (at most once; later repeats are
    ignored), weight, max_repeats, a table of bounded size.  Weights count among the sources
    that have documents.  ``total_tokens``: size of the mix, at most and by default the
    largest at which every source still reaches its weight.  The inclusion probability of a
    sampled copy grows with the tokens to the power ``size_power``.  A source ends within half a
    document of its target.  Documents without a token, without a source or of a source that
    is no target stay out.  A repeated row is a document of its own, with its own random number;
    the same seed gives the same mix as long as the table is read in the same splits.  Empty
    tables give an empty mix.
    """
    spark = documents.sparkSession
    wanted = targets.select("source", "weight", "max_repeats").dropDuplicates(["source"])
    listed = wanted.where("source is not null")
    counted = materialize(
        count_tokens(
            documents.select("doc_id", "source", "text", F.monotonically_increasing_id().alias("row")).join(
                listed.select("source"), "source", "left_semi"
            ),
            ["doc_id", "source", "row"],
            tokenizer,
        ).where("tokens > 0")
    )
    weight = F.pow(F.col("tokens").cast("double"), F.lit(size_power))
    sizes = {
        r.source: (r.docs, r.tokens, r.spread, r.heaviest)
        for r in counted.groupBy("source")
        .agg(
            F.count("*").alias("docs"),
            F.sum("tokens").alias("tokens"),
            F.sum(weight * F.col("tokens")).alias("spread"),
            F.max(weight).alias("heaviest"),
        )
        .collect()
    }
    plan = _plan(sizes, sorted(listed.collect(), key=lambda t: t.source), total_tokens)
    certain = _certain(counted, weight, plan, {s: x[3] for s, x in sizes.items()})
    table = spark.createDataFrame(
        [(*p[:3], *certain.get(p[0], (float("inf"), 0.0, 0.0))) for p in plan],
        "source string, want double, whole int, certain double, rest double, rate double",
    )
    # 53 bits of a hash, never 0 or 1.
    random = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", "row"), 11).cast("double") + 0.5) / F.lit(2.0**53)
    chance = F.least(F.col("rate") * weight, F.lit(1 - 2.0**-53))
    odds = (random / (1 - random)) / (chance / (1 - chance))
    ranked = counted.join(F.broadcast(table), "source").withColumn(
        "rank", F.when((F.col("rest") > 0) & (weight < F.col("certain")), odds / (1 + odds))
    )
    first = F.least(F.floor(F.col("rank") * BINS), F.lit(BINS - 1)).cast("int")
    second = F.least(F.floor((F.col("rank") * BINS - first) * BINS), F.lit(BINS - 1)).cast("int")
    sampled = ranked.where("rank is not null")

    def counts(rows: DataFrame, bin_: Column) -> list:
        return rows.groupBy("source", bin_.alias("bin")).agg(F.sum("tokens").alias("tokens")).collect()

    left = {source: rest for source, (_, rest, _) in certain.items() if rest > 0}
    outer = _cut(counts(sampled, first), left)
    outer_table = spark.createDataFrame(
        [(s, b, r) for s, (b, r) in outer.items()], "source string, outer int, outer_rest double"
    )
    edge = sampled.join(F.broadcast(outer_table), "source").where(first == F.col("outer"))
    inner = _cut(counts(edge, second), {s: r for s, (_, r) in outer.items()})
    inner_table = spark.createDataFrame(
        [(s, outer[s][0], b, r) for s, (b, r) in inner.items()],
        "source string, outer int, inner int, inner_rest double",
    )
    placed = ranked.join(F.broadcast(inner_table), "source", "left")
    before = (first < F.col("outer")) | ((first == F.col("outer")) & (second < F.col("inner")))
    at_edge = (first == F.col("outer")) & (second == F.col("inner"))
    clear = placed.where(~F.coalesce(at_edge, F.lit(False))).withColumn(
        "extra", F.coalesce(before | (weight >= F.col("certain")), F.lit(False)).cast("int")
    )
    # The few documents of the bin in which the cut lies are ranked one by one.
    order = Window.partitionBy("source").orderBy("rank", "doc_id", "row").rowsBetween(Window.unboundedPreceding, 0)
    border = placed.where(at_edge).withColumn(
        "extra",
        (F.sum("tokens").over(order) - F.col("tokens") / 2 <= F.col("inner_rest")).cast("int"),
    )
    chosen = (
        clear.unionByName(border)
        .withColumn("copies", F.col("whole") + F.col("extra"))
        .where("copies > 0")
        .select("doc_id", "source", "tokens", "copies")
    )
    used = chosen.groupBy("source").agg(
        F.count("*").alias("documents"),
        F.max("copies").alias("most_copies"),
        F.sum(F.col("tokens") * F.col("copies")).alias("tokens"),
    )
    everything = Window.partitionBy()  # a row for each target only
    shares = (
        wanted.join(table.select("source", "want"), "source", "left")
        .join(used, "source", "left")
        .select(
            "source",
            "weight",
            (F.col("want") / F.sum("want").over(everything)).alias("reachable_weight"),
            F.coalesce("documents", F.lit(0)).alias("documents"),
            F.coalesce("most_copies", F.lit(0)).alias("most_copies"),
            F.coalesce("tokens", F.lit(0)).alias("tokens"),
            (F.coalesce("tokens", F.lit(0)) / F.sum("tokens").over(everything)).alias("actual_share"),
        )
    )
    return Mix(chosen, shares)
