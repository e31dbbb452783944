"""Jump consistent hashing of stable keys to shards, in DataFrame functions only.

Each key walks the jump sequence of Lamping and Veach: a 64-bit linear congruential generator seeded by the key
yields the next shard count at which the key moves. The last jump below n is the shard among n. No ring table is
kept, and going from n to n + 1 shards moves a key only if its next jump is n, that is, into the new shard.

Cases: a null id is the key 0; a null text has size 8 and the checksum of the empty text; rows that repeat an id go
to one shard and take slots of their own; an empty table gives no rows; columns of the input besides the id and the
text are not read, so clashing names do no harm.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: the multiplier of the published generator.
MULTIPLIER = 2862933555777941757
#: Sub-blocks of a shard; slots are numbered within a block and shifted by the sizes of the blocks before it.
SLOT_BLOCKS = 1024

_MASK = 0xFFFF


def _limb(x: Column, i: int) -> Column:
    return F.shiftrightunsigned(x, 16 * i).bitwiseAND(F.lit(_MASK).cast("long"))


def next_state(x: Column) -> Column:
    """x * MULTIPLIER + 1 modulo 2**64 in 16-bit limbs, so that no step overflows a signed long."""
    m = [(MULTIPLIER >> (16 * i)) & _MASK for i in range(4)]
    carry = F.lit(1).cast("long")
    out = None
    for k in range(4):
        term = carry
        for i in range(k + 1):
            term = term + _limb(x, i) * F.lit(m[k - i]).cast("long")
        piece = F.shiftleft(term.bitwiseAND(F.lit(_MASK).cast("long")), 16 * k)
        out = piece if out is None else out.bitwiseOR(piece)
        carry = F.shiftrightunsigned(term, 16)
    return out


def jump_pair(key: Column, n: int) -> Column:
    """struct(shard, grown): the shard among n and among n + 1."""

    def step(acc: Column, _: Column) -> Column:
        # Lambda variables are re-evaluated where they are used twice, so the state is stepped once and kept.
        state = next_state(acc["state"])
        jump = F.floor(
            (acc["jump"] + 1).cast("double") * F.lit(float(1 << 31))
            / (F.shiftrightunsigned(state, 33) + F.lit(1).cast("long")).cast("double")
        ).cast("long")
        go = acc["jump"] < F.lit(n + 1).cast("long")
        return F.struct(
            F.when(go, state).otherwise(acc["state"]).alias("state"),
            F.when(acc["jump"] < F.lit(n).cast("long"), acc["jump"]).otherwise(acc["shard"]).alias("shard"),
            F.when(go, acc["jump"]).otherwise(acc["grown"]).alias("grown"),
            F.when(go, jump).otherwise(acc["jump"]).alias("jump"),
        )

    zero = F.lit(0).cast("long")
    start = F.struct(key.alias("state"), zero.alias("shard"), zero.alias("grown"), zero.alias("jump"))
    # The first jump of a key is always to shard 0; n + 1 steps then pass every jump below n + 1.
    walked = F.aggregate(F.array_repeat(F.lit(0), n + 2), start, step)
    return F.struct(walked["shard"].cast("int").alias("shard"), walked["grown"].cast("int").alias("grown"))


def shard_rows(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: its size, checksum, shard, slot in the shard, and shard among one more.

    The text is read once and only its size and checksum are shuffled. A shard holds 1/n of all rows, so slots are
    not numbered by one window over a shard: rows are numbered in (shard, block) groups, block being a hash of the id,
    and the table of block sizes (shards * SLOT_BLOCKS rows at most, whatever the input) gives each block's start.
    """
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(0).cast("long"))
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long") + F.lit(8).cast("long")).alias("size"),
        F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("text_crc32"),
        jump_pair(key, shards).alias("to"),
        F.pmod(F.xxhash64(key), F.lit(SLOT_BLOCKS)).cast("int").alias("block"),
    ).select("doc_id", "size", "text_crc32", F.col("to.shard").alias("shard"), F.col("to.grown").alias("grown_shard"), "block")
    from pyspark.sql import Window

    sizes = rows.groupBy("shard", "block").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("shard", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inner = Window.partitionBy("shard", "block").orderBy("doc_id", "size", "text_crc32")
    numbered = rows.withColumn("in_block", F.row_number().over(inner) - 1)
    return numbered.join(F.broadcast(starts), ["shard", "block"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
        (F.col("start") + F.col("in_block")).cast("long").alias("slot"), "grown_shard",
    )
