"""Jump consistent hashing of document records onto shards, in column expressions only."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docuvet.llm.graph import numbered

#: Multiplier of the 64-bit step generator of the published jump hash, in two 32-bit halves. Fixed value.
STEP = 2862933555777941757
STEP_HIGH, STEP_LOW = STEP >> 32, STEP & 0xFFFFFFFF
LOW_32, LOW_16 = 0xFFFFFFFF, 0xFFFF
ROWS_PER_PART = 50_000


def _product(high: Column, low: Column) -> tuple[Column, Column]:
    """Halves of (high, low) * STEP + 1 modulo 2**64; no partial result leaves 63 bits."""
    part = low.bitwiseAND(F.lit(LOW_16)) * STEP_LOW + 1
    upper = F.shiftright(low, 16) * STEP_LOW + F.shiftright(part, 16)
    new_low = F.shiftleft(upper.bitwiseAND(F.lit(LOW_16)), 16).bitwiseOR(part.bitwiseAND(F.lit(LOW_16)))
    from_high = high.bitwiseAND(F.lit(LOW_16)) * STEP_LOW + F.shiftleft((F.shiftright(high, 16) * STEP_LOW).bitwiseAND(F.lit(LOW_16)), 16)
    new_high = (F.shiftright(upper, 16) + low * STEP_HIGH).bitwiseAND(F.lit(LOW_32)) + from_high.bitwiseAND(F.lit(LOW_32))
    return new_high.bitwiseAND(F.lit(LOW_32)), new_low


def jump_shards(key: Column, shards: int) -> Column:
    """Struct of ``shard`` among ``shards`` and ``grown`` among one more, for a 64-bit integer key.

    The jumps of a key do not depend on the number of shards: its shard is the last jump below that number. A jump goes at
    least one shard on, so ``shards + 1`` rounds suffice; a key that has left the range is not computed further.
    """
    key = key.cast("long")
    start = F.struct(
        F.shiftrightunsigned(key, 32).alias("high"), key.bitwiseAND(F.lit(LOW_32)).alias("low"), F.lit(0).cast("long").alias("at"),
        F.lit(0).cast("long").alias("shard"), F.lit(0).cast("long").alias("grown"),
    )

    def step(state: Column, _: Column) -> Column:
        high, low = _product(state["high"], state["low"])
        to = F.floor((state["at"] + 1).cast("double") * (F.lit(2147483648.0) / (F.shiftright(high, 1) + 1).cast("double")))
        moved = F.struct(
            high.alias("high"), low.alias("low"), to.alias("at"),
            F.when(state["at"] < shards, state["at"]).otherwise(state["shard"]).alias("shard"), state["at"].alias("grown"),
        )
        return F.when(state["at"] <= shards, moved).otherwise(state)

    end = F.aggregate(F.sequence(F.lit(0), F.lit(shards)), start, step)
    return F.struct(end["shard"].cast("int").alias("shard"), end["grown"].cast("int").alias("grown"))


def mixed_key(key: Column) -> tuple[Column, Column]:
    """Halves of the first step of a key's generator: an order of the keys that spreads them evenly."""
    key = key.cast("long")
    return _product(F.shiftrightunsigned(key, 32), key.bitwiseAND(F.lit(LOW_32)))


def shard_documents(documents: DataFrame, shards: int) -> DataFrame:
    """Place document records (``doc_id``, ``raw_text``) into ``shards`` by the law ``key``.

    Only ``doc_id`` and the number of shards decide; one more shard takes rows only into itself (``grown_shard``). Returns
    doc_id, size (UTF-8 bytes of the text plus 8), text_crc32, law, shard, slot (position in the shard in the order of the
    first step of doc_id's generator, then doc_id, text checksum and size: gapless from 0), grown_shard.
    Null text: size 8, checksum 0. Null doc_id: the key is 0. Rows with one doc_id share a shard; whole repeated rows take
    neighbouring slots. Other columns of the input are not used. No rows in, none out. Copies of a text are not kept together:
    the law looks at the key alone, so a text with very many copies spreads evenly.
    Slots are counted per (shard, part) first, where the number of parts follows the number of rows.
    """
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(0))
    high, low = mixed_key(key)
    placed = documents.select(
        F.col("doc_id"),
        (F.coalesce(F.octet_length("raw_text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.coalesce(F.crc32("raw_text"), F.lit(0)).cast("long").alias("text_crc32"),
        F.lit("key").alias("law"), jump_shards(key, shards).alias("jump"), high.alias("high"), low.alias("low"),
    ).select("doc_id", "size", "text_crc32", "law", "jump.shard", F.col("jump.grown").alias("grown_shard"), "high", "low")
    parts = max(1, documents.count() // (shards * ROWS_PER_PART))
    placed = placed.withColumn("part", F.floor(F.col("high") / F.lit(2.0**32) * parts).cast("long"))
    slots = numbered(placed, ["shard"], "part", ["high", "low", "doc_id", "text_crc32", "size"], "slot")
    return slots.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
