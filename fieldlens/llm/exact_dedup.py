"""Exact duplicates by deterministic block naming.

A text, with its white space normalised, is cut into blocks of a fixed number of bytes. The distinct
blocks of the corpus are sorted and numbered: equal blocks get one integer name, different blocks get
different ones. Then adjacent names are named in the same way, pair by pair, until each document is one
name. Names are compared by value at every step, so no hash decides whether two texts are equal: hashes
only carry a block to the place of its name, and it is checked that none of them stands for two blocks.

Column functions only. Texts are shuffled once, as distinct blocks; all else is integers.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldlens.llm.common import SPACE, unused, utf8
from fieldlens.session import stored

BLOCK_BYTES = 4096


def normalised(text: Column) -> Column:
    """Each run of ASCII white space becomes one space; null becomes the empty text."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def _blocks(body: Column, size: int) -> Column:
    last = F.greatest(F.ceil(F.octet_length(body) / size) - 1, F.lit(0))
    return F.transform(F.sequence(F.lit(0), last.cast("int")), lambda i: F.substring(body, i * size + 1, F.lit(size)))


def _key(block: Column, salt: int) -> Column:
    return F.struct(F.xxhash64(F.lit(salt), block).alias("a"), F.xxhash64(block, F.lit(salt)).alias("b"))


def _named(distinct: DataFrame, *order: str) -> DataFrame:
    """Number distinct values, sorted inside the partitions that their grouping made."""
    return distinct.sortWithinPartitions(*order).withColumn("name", F.monotonically_increasing_id())


def _block_names(bodies: DataFrame, size: int, salt: int) -> DataFrame:
    blocks = bodies.select(F.explode(_blocks(F.col("body"), size)).alias("block"))
    distinct = blocks.select(_key(F.col("block"), salt).alias("key"), "block").distinct()
    return stored(_named(distinct, "block").select("key", "name"), "block-names")


def identities(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of ``docs``: row_id, doc_id, text_sha256, level, name.

    Two rows have equal (level, name) exactly when their normalised texts are equal.
    """
    bodies = docs.select("doc_id", normalised(F.col("text")).alias("text")).select("doc_id", utf8(F.col("text")).alias("body"))
    for salt in range(8):
        rows = stored(
            bodies.select(
                F.monotonically_increasing_id().alias("row_id"),
                "doc_id",
                F.sha2("body", 256).alias("text_sha256"),
                F.transform(_blocks(F.col("body"), block_bytes), lambda b: _key(b, salt)).alias("keys"),
            ),
            "block-keys",
        )
        names = _block_names(bodies, block_bytes, salt)
        # A key that stands for two blocks has two names. Other keys are tried then.
        if names.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
            break
    else:
        raise RuntimeError("no collision-free block keys found")

    n = F.size("keys")
    spread = rows.select("row_id", n.alias("n"), F.posexplode("keys").alias("pos", "key"))
    level = stored(spread.join(names, "key").select("row_id", "n", "pos", "name"), "names")
    longest = rows.agg(F.max(n)).first()[0] or 1
    done = []
    for depth in range((longest - 1).bit_length() + 1):
        done.append(level.where("n = 1").select("row_id", F.lit(depth).alias("level"), "name"))
        if 1 << depth >= longest:
            break
        # A last block without a neighbour is paired with -1, which is no name.
        pairs = (
            level.where("n > 1")
            .groupBy("row_id", F.expr("pos div 2").cast("int").alias("pos"))
            .agg(
                F.expr("int((max(n) + 1) div 2)").alias("n"),
                F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("a"),
                F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(-1)).alias("b"),
            )
        )
        pair_names = _named(pairs.select("a", "b").distinct(), "a", "b")
        level = stored(pairs.join(pair_names, ["a", "b"]).select("row_id", "n", "pos", "name"), "names")
    final = reduce(DataFrame.unionAll, done)
    return rows.drop("keys").join(final, "row_id")


def exact_duplicates(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Which rows repeat a text: doc_id, keep_id, group_size, kept, text_sha256, one row per row.

    Null and empty texts are equal. Of equal texts the row with the smallest doc_id is kept; rows
    without an id come last. Of repeated rows with the same id exactly one is kept. Other columns of
    ``docs`` are not read, whatever their names. An empty table gives an empty result.
    """
    rows = stored(identities(docs, block_bytes), "identities")
    # The id, and the row number where ids are equal, choose the row; a flag puts null ids last.
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_id")
    groups = rows.groupBy("level", "name").agg(F.min(rank).alias("first"), F.count(F.lit(1)).alias("group_size"))
    # Stored, so that both sides of the join are shuffled for it alone and a hot group can be split.
    groups = stored(groups, "groups")
    return rows.join(groups, ["level", "name"]).select(
        "doc_id",
        F.col("first.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row_id") == F.col("first.row_id")).alias("kept"),
        "text_sha256",
    )


def without_duplicates(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    sha = unused(docs, "_sha")
    kept = exact_duplicates(docs, block_bytes).where("kept").select(
        F.col("doc_id").alias("_kept_id"), F.col("text_sha256").alias("_kept_sha")
    )
    hashed = docs.withColumn(sha, F.sha2(utf8(normalised(F.col("text"))), 256))
    same = hashed["doc_id"].eqNullSafe(kept["_kept_id"]) & (hashed[sha] == kept["_kept_sha"])
    # Repeated rows with one id all pass the join; the grouping has the join's own partitioning.
    return hashed.join(kept, same, "left_semi").dropDuplicates(["doc_id", sha]).drop(sha)
