"""Temperature mixing of sources, realised as budgeted block permutations. DataFrame functions only.

1. Tokens are counted per source. With exponent a, source i has the weight n_i^a / sum n^a.
2. The exponent is bisected to the flattest mix (smallest a in [0, 1]) that keeps every source within
   ``max_repeats`` passes, or to the mix whose entropy (in bits) is ``target_entropy``.
3. Each source gets weight x budget tokens: whole passes over all its documents, then the part of one
   more pass that the rest pays for. A pass is a permutation by hash. Without ``budget_tokens`` the
   budget is the smallest one that drops no document.
4. A source's stream is cut so that each block of ``block_tokens`` holds every source at its weight;
   inside a block the order is a permutation by hash.

Running sums are taken inside hash ranges of one pass of one source, on top of the sums of the ranges
before; ranges get narrower as the table grows, and no task gets a whole source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewake.llm.common import unused, written

RANGE_ROWS = 50_000  # rows of a hash range, about, if one source had them all
FEW = 100_000  # sources whose plan is broadcast


def word_count(text: str) -> Column:
    return F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit("[^ \\t\\n\\x0B\\f\\r]+")).cast("long")


def _key(*parts) -> Column:
    """60 bits of md5 as a long: what DuckDB can compute too."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts).cast("binary")), 1, 15), 16, 10).cast("long")


def source_plan(totals: DataFrame, *, max_repeats: float = 2.0, target_entropy: float | None = None, budget_tokens: int | None = None, steps: int = 40) -> DataFrame:
    """Per source: n (tokens), weight, budget (tokens), passes (whole ones) and rest (tokens of one more pass).

    ``totals`` has a row (source, n) for each source. All sources meet in one row here, so their
    number, not the number of documents, bounds that row. Sources without tokens get weight 0 and one pass.
    """
    lists = totals.agg(F.array_sort(F.collect_list(F.struct("source", "n"))).alias("all")).withColumn("ns", F.filter(F.transform("all", lambda x: x.n.cast("double")), lambda n: n > 0))
    zero = F.lit(0.0)

    def too_flat(a: Column) -> Column:
        z = F.aggregate("ns", zero, lambda s, n: s + F.pow(n, a))
        if target_entropy is not None:
            return F.aggregate("ns", zero, lambda s, n: s - F.pow(n, a) / z * F.log2(F.pow(n, a) / z)) > target_entropy
        most = F.array_max(F.transform("ns", lambda n: F.pow(n, a - 1)))
        if budget_tokens is not None:
            return most * F.lit(float(budget_tokens)) / z > max_repeats
        return most / F.array_min(F.transform("ns", lambda n: F.pow(n, a - 1))) > max_repeats

    start = F.struct(zero.alias("lo"), F.lit(1.0).alias("hi"))

    def halve(s: Column, _: Column) -> Column:
        mid = (s.lo + s.hi) / 2
        flat = too_flat(mid)
        return F.struct(F.when(flat, mid).otherwise(s.lo).alias("lo"), F.when(flat, s.hi).otherwise(mid).alias("hi"))

    found = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, halve, lambda s: s.hi)
    exponent = F.when(too_flat(zero), F.round(found, 6)).otherwise(zero)
    lists = lists.withColumn("a", exponent).withColumn("z", F.aggregate("ns", zero, lambda s, n: s + F.pow(n, F.col("a"))))
    weight = lambda n: F.greatest(F.round(F.pow(n, F.col("a")) / F.col("z"), 9), F.lit(1e-9))
    lists = lists.withColumn("total", F.lit(float(budget_tokens)) if budget_tokens is not None else F.array_max(F.transform("ns", lambda n: n / weight(n))))
    rows = lists.withColumn("x", F.explode("all")).select("x.source", "x.n", "total", F.when(F.col("x.n") > 0, weight(F.col("x.n").cast("double"))).otherwise(zero).alias("weight"))
    rows = rows.withColumn("budget", F.coalesce(F.floor(F.col("weight") * F.col("total") + 0.5), F.lit(0)).cast("long")).drop("total")
    passes = F.when(F.col("n") > 0, F.floor(F.col("budget") / F.col("n"))).otherwise(F.lit(1)).cast("long")
    return rows.withColumn("passes", passes).withColumn("rest", F.when(F.col("n") > 0, F.col("budget") - F.col("passes") * F.col("n")).otherwise(F.lit(0)).cast("long"))


def counted(docs: DataFrame) -> DataFrame:
    return written(docs.select(F.col("doc_id"), F.coalesce("source", F.lit("")).alias("source"), word_count("text").alias("n_tokens")), "mix-counts")


def _passes(docs: DataFrame, plan: DataFrame, seed: int) -> DataFrame:
    """A row for each document and pass that may use it, with its place in the source's stream of tokens.

    ``begin`` is the sum of tokens of the pass before this document in hash order. Equal keys are
    repeated rows of one document: they begin at one place and come and go together.
    """
    n_passes = F.col("passes") + F.when(F.col("rest") > 0, 1).otherwise(0)
    bits = max(8, (docs.count() // RANGE_ROWS).bit_length())
    rows = docs.join(plan, "source").withColumn("epoch", F.explode(F.when(n_passes > 0, F.sequence(F.lit(0), (n_passes - 1).cast("int"))).otherwise(F.array().cast("array<int>"))))
    rows = rows.withColumn("key", _key(F.lit(str(seed)), F.col("epoch").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    rows = rows.withColumn("part", F.shiftright("key", 60 - bits))
    sums = rows.groupBy("source", "epoch", "part").agg(F.sum("n_tokens").alias("t"))
    before = sums.withColumn("before", F.sum("t").over(W.partitionBy("source", "epoch").orderBy("part")) - F.col("t")).drop("t")
    inside = W.partitionBy("source", "epoch", "part").orderBy("key").rangeBetween(W.unboundedPreceding, W.currentRow)
    same = W.partitionBy("source", "epoch", "part", "key")
    rows = rows.withColumn("within", F.sum("n_tokens").over(inside) - F.sum("n_tokens").over(same))
    rows = rows.join(before, ["source", "epoch", "part"]).withColumn("begin", F.col("before") + F.col("within"))
    return rows.filter((F.col("epoch") < F.col("passes")) | (F.col("begin") < F.col("rest")))


def mix_schedule(docs: DataFrame, *, max_repeats: float = 2.0, target_entropy: float | None = None, budget_tokens: int | None = None, block_tokens: int = 1_000_000, seed: int = 17) -> DataFrame:
    """The whole order of a mix: a row (block, place, doc_id, source, epoch, n_tokens) per use of a document.

    ``docs`` has doc_id, text, source; other columns are ignored. Null sources are the source "",
    null texts have no tokens. Documents without tokens take their place in each pass; those of sources
    without any are dealt out over the blocks. Repeated rows are documents of their own that keep together, equal
    keys are ordered by doc_id, epoch, tokens and source. Texts of any length are counted whole. An empty
    table gives an empty order.
    """
    base = counted(docs)
    plan = source_plan(base.groupBy("source").agg(F.sum("n_tokens").alias("n")), max_repeats=max_repeats, target_entropy=target_entropy, budget_tokens=budget_tokens)
    rows = _passes(base, plan.withColumn("all", F.sum("budget").over(W.partitionBy(F.lit(1)))), seed)  # one row a source
    share = F.col("weight") * F.lit(float(block_tokens))
    spread = F.pmod("key", F.greatest(F.lit(1), F.ceil(F.col("all") / F.lit(float(block_tokens)))))  # of sources without tokens
    block = F.when(F.col("weight") > 0, F.floor((F.col("epoch") * F.col("n") + F.col("begin")) / share)).otherwise(spread).cast("long")
    rows = rows.withColumn("block", block)
    order = _key(F.lit(str(seed)), F.lit("block"), F.col("block").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("epoch").cast("string"))
    rows = rows.withColumn("order", order)
    place = F.row_number().over(W.partitionBy("block").orderBy("order", "doc_id", "epoch", "n_tokens", "source"))
    return rows.withColumn("place", place.cast("long")).select("block", "place", "doc_id", "source", F.col("epoch").cast("long").alias("epoch"), "n_tokens")


def mixed(docs: DataFrame, *, max_repeats: float = 2.0, target_entropy: float | None = None, budget_tokens: int | None = None, seed: int = 17) -> DataFrame:
    """``docs`` itself, each row as often as the mix uses it: of the last pass only a threshold per source is needed.

    Texts aren't shuffled while the sources are few enough (``FEW`` at most) to be broadcast. Null
    texts have no tokens, null sources are the source "". Rows that share source and doc_id come and
    go together. Other columns come back as they are; an empty table stays empty.
    """
    base = counted(docs)
    plan = written(source_plan(base.groupBy("source").agg(F.sum("n_tokens").alias("n")), max_repeats=max_repeats, target_entropy=target_entropy, budget_tokens=budget_tokens), "mix-plan")
    last = _passes(base, plan, seed).filter(F.col("epoch") == F.col("passes")).groupBy("source").agg(F.max("key").alias("last"))
    source, passes, last_key, use = unused(docs, "_source", "_passes", "_last", "_use")
    uses = written(plan.join(last, "source", "left").select(F.col("source").alias(source), F.col("passes").alias(passes), F.col("last").alias(last_key)), "mix-uses")
    if uses.count() <= FEW:
        uses = F.broadcast(uses)
    key = _key(F.lit(str(seed)), F.col(passes).cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    rows = docs.join(uses, F.coalesce(docs["source"], F.lit("")) == F.col(source))
    n = F.col(passes) + F.when(F.col(last_key).isNotNull() & (key <= F.col(last_key)), 1).otherwise(0)
    return rows.withColumn(use, F.explode(F.array_repeat(F.lit(1), n.cast("int")))).select(*docs.columns)
