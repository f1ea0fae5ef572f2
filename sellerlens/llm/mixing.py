"""Mixing sources to temperature weights within a token budget.

Only DataFrame functions. A source's weight is its share of all tokens to the power ``alpha``,
normalised: 1 keeps the shares, 0 makes them equal. ``alpha`` is bisected to the largest value at which
the weights' entropy reaches the target; if a source would then be repeated more than ``repeats``
times within the budget, it is bisected to the smallest value at which none is.

The weights are realised as block permutations. A source is dealt into blocks of about ``BLOCK`` rows
by a hash of the row's id and text. In every epoch the blocks follow one another in an order drawn for that
epoch, and the rows within a block in one as well; a source takes whole epochs and then rows from the
next one until its share of the budget is filled (the row that reaches the share is the last one
taken). Rows are shuffled to their block once and multiplied by epochs there. They are added up within blocks, blocks
within runs and runs within sources, so that no window takes all rows, nor all blocks, of a source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sellerlens.llm.shared import stored

GAP = 0.5         # target entropy: this far from that of the shares to that of equal weights
REPEATS = 4.0     # no source is repeated more often within the budget
BUDGET = 1.0      # tokens of the mixture for each token of the corpus
BLOCK = 256
RUN_DIGITS = 3    # hexadecimal digits of a block's order that name its run
STEPS = 40
SEED = "mix"


def token_count(text: Column) -> Column:
    """Words between white space; 0 for null and empty texts."""
    return F.regexp_count(F.coalesce(text.cast("string"), F.lit("")), F.lit("[^ \\t\\n\\r]+")).cast("long")


def _draw(*parts: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(SEED), *[F.coalesce(p.cast("string"), F.lit("-")) for p in parts]))


def _number(drawn: Column) -> Column:
    return F.conv(F.substring(drawn, 1, 12), 16, 10).cast("long")


def weights(docs: DataFrame, source: str = "source", text: str = "text", gap: float = GAP, repeats: float = REPEATS, budget: float = BUDGET) -> DataFrame:
    """``source, n_rows, n_tokens, alpha, weight, share`` (``share``: tokens of the budget, rounded).

    Sources without tokens have weight 0. The bisection reads one array of the sources' token totals
    (a number per source), on one row.
    """
    sizes = stored(docs.select(F.col(source).alias("source"), token_count(F.col(text)).alias("tokens")).groupBy("source").agg(
        F.count("*").alias("n_rows"), F.sum("tokens").alias("n_tokens")
    ), "sources")
    some = sizes.where("n_tokens > 0").agg(
        F.sort_array(F.collect_list(F.col("n_tokens").cast("double"))).alias("sizes"), F.sum("n_tokens").cast("double").alias("total")
    )
    # Logarithms of the shares, relative to the largest.
    logs = some.where("total IS NOT NULL").select("total", F.transform("sizes", lambda s: F.ln(s / F.element_at("sizes", -1))).alias("logs"), "sizes")
    one = F.aggregate(
        F.sequence(F.lit(1), F.lit(STEPS)),
        F.struct(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi")),
        lambda b, _: _half(b, _entropy(F.col("logs"), (b["lo"] + b["hi"]) / 2) >= F.col("target")),
    )
    target = _entropy(F.col("logs"), F.lit(1.0)) * (1 - gap) + F.ln(F.size("logs").cast("double")) * gap
    by_entropy = logs.select("*", target.alias("target")).select("*", one["lo"].alias("alpha_e"))
    # Repetition of the smallest source, the one that low exponents raise most.
    fits = lambda alpha: (
        budget * F.col("total") * F.exp(alpha * F.element_at("logs", 1)) / _norm(F.col("logs"), alpha) / F.element_at("sizes", 1) <= repeats
    )
    two = F.aggregate(
        F.sequence(F.lit(1), F.lit(STEPS)),
        F.struct(F.col("alpha_e").alias("lo"), F.lit(1.0).alias("hi")),
        lambda b, _: _half(b, ~fits((b["lo"] + b["hi"]) / 2)),
    )
    chosen = by_entropy.select(
        "total", F.round(F.when(fits(F.col("alpha_e")), F.col("alpha_e")).otherwise(two["hi"]), 9).alias("alpha"), "logs",
        F.element_at("sizes", -1).alias("largest"),
    ).select("total", "alpha", "largest", _norm(F.col("logs"), F.col("alpha")).alias("norm")).first()
    if chosen is None:
        return sizes.select("*", F.lit(1.0).alias("alpha"), F.lit(0.0).alias("weight"), F.lit(0).cast("long").alias("share"))
    raw = F.exp(F.lit(chosen["alpha"]) * F.ln(F.col("n_tokens") / F.lit(chosen["largest"]))) / F.lit(chosen["norm"])
    weight = F.when(F.col("n_tokens") > 0, F.round(raw, 12)).otherwise(F.lit(0.0))
    share = F.floor(F.col("weight") * F.lit(budget * chosen["total"]) + 0.5).cast("long")
    return sizes.select("*", F.lit(chosen["alpha"]).alias("alpha"), weight.alias("weight")).select("*", share.alias("share"))


def _norm(logs: Column, alpha: Column) -> Column:
    return F.aggregate(logs, F.lit(0.0), lambda s, x: s + F.exp(alpha * x))


def _entropy(logs: Column, alpha: Column) -> Column:
    """Of weights exp(alpha x) / Z: ln Z - alpha * sum of x exp(alpha x) / Z."""
    norm = _norm(logs, alpha)
    return F.ln(norm) - alpha * F.aggregate(logs, F.lit(0.0), lambda s, x: s + x * F.exp(alpha * x)) / norm


def _half(b: Column, upper: Column) -> Column:
    mid = (b["lo"] + b["hi"]) / 2
    return F.struct(F.when(upper, mid).otherwise(b["lo"]).alias("lo"), F.when(upper, b["hi"]).otherwise(mid).alias("hi"))


def _sums_before(blocks: DataFrame) -> DataFrame:
    """``source, epoch, b, begin``: the sizes of a source's blocks that come before this one in the epoch's order.

    Blocks that begin with the same ``RUN_DIGITS`` digits of the drawn order follow one another, so
    that they form a run. Runs are added up first, and only runs (16 ** ``RUN_DIGITS`` a source and epoch at
    most) share a window with all others of their epoch; the blocks of a run share one with each other.
    """
    blocks = stored(blocks.withColumn("run", F.substring("order", 1, RUN_DIGITS)), "block-sizes")
    until = Window.unboundedPreceding, Window.currentRow
    runs = blocks.groupBy("source", "epoch", "run").agg(F.sum("size").alias("size"))
    of_epoch = Window.partitionBy("source", "epoch").orderBy("run").rowsBetween(*until)
    bases = runs.select(F.struct("source", "epoch", "run", (F.sum("size").over(of_epoch) - F.col("size")).alias("base")).alias("of"))
    of_run = Window.partitionBy("source", "epoch", "run").orderBy("order", "b").rowsBetween(*until)
    inside = blocks.withColumn("inside", F.sum("size").over(of_run) - F.col("size"))
    same = (inside["epoch"] == F.col("of.epoch")) & (inside["run"] == F.col("of.run"))
    both = inside.join(bases, inside["source"].eqNullSafe(F.col("of.source")) & same)
    return both.select("source", "epoch", "b", (F.col("of.base") + F.col("inside")).alias("begin"))


def mixture(docs: DataFrame, id_column: str = "doc_id", source: str = "source", text: str = "text", gap: float = GAP, repeats: float = REPEATS, budget: float = BUDGET) -> DataFrame:
    """``row`` (all columns of ``docs``), ``n_tokens, epoch, block, before``: a row for each time a row is taken.

    ``before`` counts the tokens of the source before the row in the order of this epoch. A null source is a source of its
    own, a null id is drawn like any other, rows that repeat an id are dealt by their text and follow in
    order of tokens and text where they meet in a block, rows of sources with share 0 aren't taken, rows without tokens are taken
    with their epoch, and no rows give no rows.
    """
    plan = weights(docs, source, text, gap, repeats, budget).select(
        F.struct(
            "source", F.greatest(F.lit(1), F.ceil(F.col("n_rows") / BLOCK)).alias("blocks"),
            F.when(F.col("n_tokens") > 0, F.floor(F.col("share") / F.col("n_tokens"))).otherwise(F.lit(0)).alias("whole"),
            F.when(F.col("n_tokens") > 0, F.col("share") % F.col("n_tokens")).otherwise(F.lit(0)).alias("rest"),
        ).alias("plan")
    )
    plan = stored(plan.where("plan.whole > 0 OR plan.rest > 0"), "mixture")
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    ident, words = F.col(f"row.`{id_column}`"), F.col(f"row.`{text}`")
    dealt = row.join(plan, F.col(f"row.`{source}`").eqNullSafe(F.col("plan.source"))).select(
        "row", "plan", F.col("plan.source").alias("source"), token_count(words).alias("n_tokens"),
        F.pmod(_number(_draw(F.lit("block"), ident, F.md5(words))), F.col("plan.blocks")).alias("block"),
    )
    # Whole epochs and, if tokens are left for it, the one that is taken in part.
    last = F.col("whole") - F.when(F.col("rest") > 0, 0).otherwise(1)

    def in_epochs(df: DataFrame) -> DataFrame:
        return df.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), last)))

    sizes = dealt.groupBy("source", F.col("block").alias("b"), F.col("plan.whole").alias("whole"), F.col("plan.rest").alias("rest"))
    blocks = in_epochs(sizes.agg(F.sum("n_tokens").alias("size")))
    order = _draw(F.lit("order"), F.col("source"), F.col("epoch"), F.col("b"))
    begins = _sums_before(blocks.select("source", "epoch", "b", "size", order.alias("order")))
    begins = stored(begins.select(F.struct("source", "epoch", "b", "begin").alias("at")), "blocks")

    # One shuffle brings a block together; windows by block and epoch need no other.
    gathered = dealt.select("*", F.col("plan.whole").alias("whole"), F.col("plan.rest").alias("rest")).drop("plan").repartition("source", "block")
    drawn = _draw(F.lit("row"), F.col("epoch"), ident)
    in_block = (
        Window.partitionBy("source", "block", "epoch").orderBy(drawn, "n_tokens", words)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    ranked = in_epochs(gathered).withColumn("inside", F.sum("n_tokens").over(in_block) - F.col("n_tokens"))
    here = F.col("source").eqNullSafe(F.col("at.source")) & (F.col("epoch") == F.col("at.epoch")) & (F.col("block") == F.col("at.b"))
    placed = ranked.join(begins, here).withColumn("before", F.col("inside") + F.col("at.begin"))
    taken = placed.where((F.col("epoch") < F.col("whole")) | (F.col("before") < F.col("rest")))
    return taken.select("row", "n_tokens", "epoch", "block", "before")


def mixed(docs: DataFrame, id_column: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """``docs`` with each row as often as the mixture takes it; columns unchanged."""
    taken = mixture(docs, id_column, source, text)
    return taken.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
