"""Shards along a Hilbert curve over quantised metadata (native).

Each row's dimensions (language, source, size, id) are quantised, mapped to
their index on a Hilbert curve, and the rows in curve order are cut into runs of
equal count, so a shard covers a compact region of the metadata space and
readers can skip shards by the minima and maxima of several columns at once.
Only thin rows are sorted, by range partitioning with the id as last key, so a
dimension value with a third of the rows is spread over partitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import materialise, table

BITS = 6


def with_hilbert(df: DataFrame, dims: list[str], bits: int = BITS, name: str = "hilbert") -> DataFrame:
    """df with the index on the Hilbert curve of the columns dims (integers from 0 to 2**bits - 1).

    Skilling's transpose (2004): from the highest bit down the rotations are undone,
    then Gray coding and interleaving. Each step is a projection over the previous
    one's columns, so the whole is one span of generated code.
    """
    x = [f"_h{i}" for i in range(len(dims))]
    out = df.withColumns({c: F.col(d).cast("long") for c, d in zip(x, dims)})
    for level in range(bits - 1, 0, -1):
        q, p = 1 << level, (1 << level) - 1
        for c in x:
            flip, swap = F.col(c).bitwiseAND(q) != 0, F.col(x[0]).bitwiseXOR(F.col(c)).bitwiseAND(p)
            if c == x[0]:
                out = out.withColumn(c, F.when(flip, F.col(c).bitwiseXOR(p)).otherwise(F.col(c)))
            else:
                out = out.withColumns({
                    x[0]: F.when(flip, F.col(x[0]).bitwiseXOR(p)).otherwise(F.col(x[0]).bitwiseXOR(swap)),
                    c: F.when(flip, F.col(c)).otherwise(F.col(c).bitwiseXOR(swap)),
                })
    for before, c in zip(x, x[1:]):
        out = out.withColumn(c, F.col(c).bitwiseXOR(F.col(before)))
    out = out.withColumn("_t", F.lit(0).cast("long"))
    for level in range(bits - 1, 0, -1):
        bit = F.col(x[-1]).bitwiseAND(1 << level) != 0
        out = out.withColumn("_t", F.when(bit, F.col("_t").bitwiseXOR((1 << level) - 1)).otherwise(F.col("_t")))
    index = F.lit(0).cast("long")
    for b in range(bits - 1, -1, -1):
        for c in x:
            index = index * 2 + F.shiftright(F.col(c).bitwiseXOR(F.col("_t")), b).bitwiseAND(1)
    return out.withColumn(name, index).drop("_t", *x)


def quantised(thin: DataFrame, bits: int = BITS) -> DataFrame:
    """q_lang, q_source, q_size, q_id from 0 to 2**bits - 1. Strings by hash (equal values stay
    together); numbers by their equi-depth cell, from percentile_approx, a mergeable sketch."""
    cells = 1 << bits
    cuts = thin.agg(*[F.percentile_approx(c, [i / cells for i in range(1, cells)], 10_000).alias(f"c_{c}") for c in ("size", "doc_id")])
    cell = lambda c: F.coalesce(F.size(F.filter(F.col(f"c_{c}"), lambda x: x < F.col(c))), F.lit(0))
    return thin.crossJoin(F.broadcast(cuts)).select(  # cuts: one row of 2 * 63 numbers
        *thin.columns,
        F.pmod(F.xxhash64("lang"), F.lit(cells)).alias("q_lang"),
        F.pmod(F.xxhash64("source"), F.lit(cells)).alias("q_source"),
        F.greatest(cell("size"), F.lit(0)).alias("q_size"),
        F.greatest(cell("doc_id"), F.lit(0)).alias("q_id"),
    )


def ranked(df: DataFrame, keys: list[str], name: str, partitions: int | None = None) -> DataFrame:
    """df with `rank` (long, from 0): its place in the total order of keys.

    Rows are range-partitioned and sorted, written with their partition and place in
    it, and the partitions' counts (one row each) give the offsets. The keys must end
    in something (nearly) unique, so that no partition holds more than its share.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col(k) for k in keys]
    mono = F.monotonically_increasing_id()
    placed = materialise(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_m", mono), name)
    split = placed.withColumn("_part", F.shiftrightunsigned("_m", 33)).withColumn("_at", F.col("_m").bitwiseAND((1 << 33) - 1))
    sizes = split.groupBy("_part").agg(F.count("*").alias("_n"))
    # one row per partition: a running sum over so few is one short task, and its rows are what is broadcast
    offsets = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_off"))
    return split.join(F.broadcast(offsets), "_part").withColumn("rank", F.col("_off") + F.col("_at")).drop("_part", "_at", "_m", "_off")


def shard(docs: DataFrame, shards: int) -> DataFrame:
    """(doc_id, size, text_crc32, lang, source, hilbert, shard, slot): law `rows`, counts at most one apart.

    Null text: size 16, crc 0 (that of no bytes). Null metadata are values of their own.
    Repeated rows get places of their own; ties on the curve go by doc_id (null first), then by crc. Texts of any length
    are measured whole. Only doc_id, text, lang and source are read, so other columns are no matter. An empty table
    gives an empty result.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    thin = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("lang"), F.col("source"),
        (F.octet_length(text).cast("long") + 16).alias("size"), F.crc32(F.encode(text, "UTF-8")).cast("long").alias("text_crc32"),
    )
    thin = materialise(thin, "shard-thin")
    placed = ranked(with_hilbert(quantised(thin), ["q_lang", "q_source", "q_size", "q_id"]), ["hilbert", "doc_id", "text_crc32"], "shard-order")
    total = placed.agg(F.count("*").alias("_total"))
    exact = F.expr(f"cast(rank * {shards} div _total as int)")
    return (
        placed.crossJoin(F.broadcast(total))  # total: one row
        .withColumn("shard", exact)
        .withColumn("slot", F.expr(f"rank - (shard * _total + {shards} - 1) div {shards}"))
        .drop("_total", "rank", "q_lang", "q_source", "q_size", "q_id")
    )


def shard_ends(placed: DataFrame) -> DataFrame:
    """(shard, rows, min_<column>, max_<column>): what a reader skips shards by. One row per shard; nulls aren't counted."""
    ends = [f(c).alias(f"{n}_{c}") for c in ("lang", "source", "size", "doc_id") for n, f in (("min", F.min), ("max", F.max))]
    return placed.groupBy("shard").agg(F.count("*").alias("rows"), *ends)


def op3_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"), 40).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "hilbert", "lang", "source"
    )
