"""Vectors as the two vector operators use them: valid rows, and classes of equal vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewake.llm.common import written


def usable(embedding: str = "embedding") -> Column:
    """True for vectors that take part: not null, no null, NaN or infinite component, not zero."""
    e = F.col(embedding)
    sound = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(e.isNotNull() & sound & F.exists(e, lambda x: x != 0), F.lit(False))


def one_length(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding) with null for vectors of another length than most that take part, the longest where lengths are as frequent."""
    row = vectors.filter(usable()).groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return vectors.select("vec_id", F.when(F.size("embedding") == (row.d if row else -1), F.col("embedding")).alias("embedding"))


def digested(vectors: DataFrame) -> DataFrame:
    """(vec_id, vec, digest) of the rows that take part; equal digests are equal vectors, -0.0 being 0.0."""
    rows = vectors.filter(usable() & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(F.col("embedding").cast("array<double>"), lambda x: x + F.lit(0.0)).alias("vec"))
    return rows.withColumn("digest", F.sha2(F.array_join(F.transform("vec", lambda x: x.cast("string")), ",").cast("binary"), 256))


def vector_classes(vectors: DataFrame, members: int | None = None) -> DataFrame:
    """(rep, digest, vec, n, least, members): a row per distinct vector; rep is a number of its own, n its rows, least its smallest vec_id.

    ``members`` rows are kept of each class (smallest ids first), all that a search for that many
    neighbours can return; they are cut before rows of a class meet. Rows with a null vec_id take no part.
    """
    rows = digested(vectors)
    classes = rows.groupBy("digest").agg(F.min("vec_id").alias("least"), F.count("*").alias("n"), F.first("vec").alias("vec"))
    if members is None:
        return written(classes.select(F.monotonically_increasing_id().alias("rep"), "digest", "vec", "n", "least"), "vectors")
    ids = rows.select("digest", "vec_id").groupBy("digest", F.pmod("vec_id", F.lit(64)).alias("salt")).agg(F.slice(F.array_sort(F.collect_list("vec_id")), 1, members).alias("m"))
    ids = ids.groupBy("digest").agg(F.slice(F.array_sort(F.flatten(F.collect_list("m"))), 1, members).alias("members"))
    return written(classes.join(ids, "digest").select(F.monotonically_increasing_id().alias("rep"), "digest", "vec", "n", "least", "members"), "vectors")
