"""Mixing sources to target weights.

Every document gets a hash-random key. Within a source, documents are put in the order of that
key: equal ranges of the key's space make sub-ranges of about the square root of the number of
documents, each sub-range is sorted and summed by one task, and the sums of the sub-ranges before
it give every document its place on the source's word axis (a distributed prefix sum). A source
is cut at its exact budget on that axis: whole epochs first, then words up to the budget, so that
at most one document of a source is taken in part.

Sources are weighed by ``weights`` in turn, in code point order, null last. A target is limited
to ``most_epochs`` times its source's words; what is cut off goes to the other sources by weight,
until none is above. That is found as one factor for all weights: a few rounds of sums over the
table of sources, of which only the totals come to the driver.

Defined results: null text has no words and a taken count of 0; a null source is a source;
repeated rows each count; documents whose id and key are equal are ordered by size, and those
alike in that too can be exchanged without a difference; a corpus without words has targets of 0.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakeloom.llm.common import WORD_REGEX, Scratch

WEIGHTS = (5, 2, 1)


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD_REGEX)), F.lit(0)).cast("long")


def source_targets(spark: SparkSession, sized: DataFrame, scratch: Scratch, weights: tuple = WEIGHTS, most_epochs: int = 3) -> DataFrame:
    """source, source_size, weight, target. sized: source and size of each document."""
    table = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    pieces = scratch.save(table.repartitionByRange(16, F.col("source").asc_nulls_last()).withColumn("piece", F.spark_partition_id()), "pieces")
    before = pieces.groupBy("piece").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rank = F.col("before") + F.row_number().over(Window.partitionBy("piece").orderBy(F.col("source").asc_nulls_last())) - 1
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod("rank", F.lit(len(weights))) + 1).cast("int"))
    ranked = pieces.join(F.broadcast(before.select("piece", "before")), "piece").withColumn("rank", rank).withColumn("weight", pick)
    ranked = scratch.save(ranked.select("source", "source_size", "weight").withColumn("cap", F.lit(float(most_epochs)) * F.col("source_size")), "ranked")
    total = float(ranked.agg(F.sum("source_size")).first()[0] or 0)
    factor = 0.0
    while True:  # each round takes the sources that are above their limit at this factor as full
        full = F.col("cap") <= F.col("weight") * F.lit(factor)
        held, free = ranked.agg(F.coalesce(F.sum(F.when(full, F.col("cap"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0))).first()
        after = (total - held) / free if free else factor
        if not after > factor * (1 + 1e-15):
            break
        factor = after
    return ranked.withColumn("target", F.least("cap", F.col("weight") * F.lit(factor))).select("source", "source_size", "weight", "target")


def mix_sources(spark: SparkSession, docs: DataFrame, weights: tuple = WEIGHTS, most_epochs: int = 3, seed: int = 11, carry: tuple = ()) -> DataFrame:
    """doc_id, size, source, source_size, target, taken, copies (whole epochs), part (words of the last, partial one); carry: more columns of docs."""
    scratch = Scratch(spark)
    sized = docs.select(F.col("doc_id"), F.col("source"), word_count().alias("size"), *carry)
    if not carry:
        sized = scratch.save(sized, "sized")
    targets = source_targets(spark, sized, scratch, weights, most_epochs)
    ranges = max(1, math.isqrt(sized.count()))
    key = F.xxhash64(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("size"))
    # the upper half of the key, scaled to the number of sub-ranges
    keyed = sized.withColumn("key", key).withColumn("range", F.floor((F.shiftrightunsigned("key", 32) * F.lit(ranges)) / F.lit(2.0**32)).cast("int"))
    sums = keyed.groupBy("source", "range").agg(F.sum("size").alias("words"))
    ordered = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(F.col("source").alias("s"), F.col("range").alias("r"), F.coalesce(F.sum("words").over(ordered), F.lit(0)).alias("start"))
    starts = scratch.save(starts.join(targets, F.col("s").eqNullSafe(F.col("source"))).select("s", "r", "start", "source_size", "target"), "starts")
    inside = Window.partitionBy("source", "range").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = keyed.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    placed = placed.join(starts, F.col("source").eqNullSafe(F.col("s")) & (F.col("range") == F.col("r")))
    budget = F.floor("target").cast("long")
    copies = F.coalesce(F.expr("cast(floor(target) as bigint) div nullif(source_size, 0)"), F.lit(0))
    place = F.col("start") + F.col("inside")
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("budget") - F.col("copies") * F.col("source_size") - place))
    placed = placed.withColumn("budget", budget).withColumn("copies", copies).withColumn("part", part.cast("long"))
    taken = (F.col("copies") * F.col("size") + F.col("part")).cast("long")
    return placed.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"), "copies", "part", *carry)


def mixed_documents(spark: SparkSession, docs: DataFrame, **options) -> DataFrame:
    """The mix itself, with the columns of docs: a row for each time that a document is taken; one taken in part has its first words.

    n_chars, where docs has it, follows the text.
    """
    names = {c: f"__{i}" for i, c in enumerate(docs.columns) if c not in ("doc_id", "source")}  # no clash with what the mix adds
    mixed = mix_sources(spark, docs.select("doc_id", "source", "text", *[F.col(c).alias(n) for c, n in names.items()]), carry=tuple(names.values()), **options)
    whole = F.array_repeat(F.col("size"), F.col("copies").cast("int"))
    rows = mixed.withColumn("words", F.explode(F.concat(whole, F.when((F.col("part") > 0), F.array("part")).otherwise(F.array().cast("array<bigint>"))))).filter("words > 0")
    whole_text, text = F.col("words") == F.col("size"), F.col(names["text"])
    rows = rows.withColumn(names["text"], F.when(whole_text, text).otherwise(_cut_text(names["text"])))
    if "n_chars" in names:
        rows = rows.withColumn(names["n_chars"], F.when(whole_text, F.col(names["n_chars"])).otherwise(F.length(text).cast(docs.schema["n_chars"].dataType)))
    return rows.select(*[F.col(names.get(c, c)).alias(c) for c in docs.columns])


def _cut_text(text: str) -> Column:
    """The text up to the end of its last taken word. Inside a CASE it is made for the rows that are cut only."""
    words = F.regexp_extract_all(F.col(text), F.lit(r"([\x20\x09-\x0D]*[^\x20\x09-\x0D]+)"), F.lit(1))
    return F.array_join(F.slice(words, F.lit(1), F.col("words").cast("int")), "")
