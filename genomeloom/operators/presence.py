"""Presence of members in sets as blocks of 64 bits: genomes of groups, genomes of alignments, columns of a matrix.

Members are numbered once, in their order. A set holds a bit for each member, in blocks; what it lacks is
the complement of its blocks. The names, a text and a list for each block, go to every task once, and the lists of what
sets lack are written out last, set by set: they are not moved, sorted or gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from genomeloom.sources.shared import staged

BITS = 64


def with_scalars(rows: DataFrame, scalars: DataFrame) -> DataFrame:
    """``rows`` with the columns of a table of one row, by an equi-join on a constant."""
    return rows.withColumn("_one", F.lit(1)).join(F.broadcast(scalars.withColumn("_one", F.lit(1))), "_one").drop("_one")


def numbered(rows: DataFrame, name: str, *order) -> DataFrame:
    """``rows`` numbered from 0 in ``order``: sorted by ranges, counted in each, and moved by the counts of the ranges before, so that no task sees all rows."""
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    held = staged(ranged.select("*", F.shiftright("_id", 33).alias("_part"), F.col("_id").bitwiseAND((1 << 33) - 1).alias("_at")).drop("_id"), "numbered", tidy=True)
    sizes = held.groupBy("_part").agg(F.count("*").alias("_k"))
    before = sizes.select("_part", (F.sum("_k").over(W.partitionBy(F.lit(0)).orderBy("_part")) - F.col("_k")).alias("_before"))  # a row a range
    return held.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_at")).drop("_part", "_at", "_before")


def number_members(members: DataFrame, member: str) -> DataFrame:
    """(member, number): distinct members from 0 in their order, written once."""
    distinct = members.select(member).where(F.col(member).isNotNull()).distinct()
    return staged(numbered(distinct, "number", F.asc(member)).select(member, "number"), "members", tidy=True)


def _shifted(by: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), by)


def presence_blocks(pairs: DataFrame, key: str, member: str, numbers: DataFrame) -> DataFrame:
    """(key, block, bits) of the pairs (key, member) whose member has a number; bits are summed map-side."""
    bit = _shifted((F.col("number") % BITS).cast("int"))
    marked = pairs.select(key, member).join(numbers, member)
    return marked.groupBy(key, F.floor(F.col("number") / BITS).alias("block")).agg(F.bit_or(bit).alias("bits"))


def lacking(pairs: DataFrame, key: str, member: str, members: DataFrame) -> DataFrame:
    """(key, n_missing, missing): of each key of ``pairs`` the members that it lacks, comma-joined in their order; keys that lack none are left out."""
    numbers = number_members(members, member)
    place = F.floor(F.col("number") / BITS)
    own = numbers.groupBy(place.alias("block")).agg(F.transform(F.array_sort(F.collect_list(F.struct("number", member))), lambda x: x[member]).alias("own"))
    listed = F.array_sort(F.collect_list(F.struct("block", F.array_join("own", ",").alias("whole"), "own")))
    names = own.agg(F.coalesce(F.sum(F.size("own")), F.lit(0)).alias("_n"), listed.alias("_names"))
    blocks = presence_blocks(pairs, key, member, numbers).groupBy(key).agg(F.sum(F.bit_count("bits")).alias("_k"), F.map_from_entries(F.collect_list(F.struct("block", "bits"))).alias("_held"))
    known = blocks.where(F.col(key).isNotNull())
    # written before the lists are, which are far larger: what was shuffled is gone by then
    keys = staged(pairs.select(key).distinct().join(known, key, "left"), "held", tidy=True)
    some = with_scalars(keys, names).withColumn("n_missing", (F.col("_n") - F.coalesce("_k", F.lit(0))).cast("int")).where("n_missing > 0")

    def rest(x: Column) -> Column:
        bits = F.try_element_at("_held", x["block"])
        left = F.filter(x["own"], lambda _, i: F.getbit(bits, i) == 0)
        return F.when(bits.isNull(), x["whole"]).when(F.bit_count(bits) < F.size(x["own"]), F.array_join(left, ","))

    # a block of which nothing is left is null, and not joined
    return some.select(key, "n_missing", F.array_join(F.transform("_names", rest), ",").alias("missing"))


def matrix_lines(pairs: DataFrame, key: str, member: str, numbers: DataFrame) -> DataFrame:
    """(key, line): a character 0 or 1 for each numbered member, in order, from the blocks of each key of ``pairs``."""
    total = numbers.agg(F.count("*").alias("_n"))
    blocks = presence_blocks(pairs, key, member, numbers).groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("block", "bits"))).alias("_held"))
    every = F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / BITS))
    digits = lambda bits: F.reverse(F.lpad(F.bin(bits), BITS, "0"))
    line = F.array_join(F.transform(every, lambda k: digits(F.coalesce(F.try_element_at("_held", k), F.lit(0).cast("long")))), "")
    return with_scalars(blocks, total).select(key, F.substring(line, F.lit(1), F.col("_n").cast("int")).alias("line"))
