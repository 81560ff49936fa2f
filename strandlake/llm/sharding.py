"""Jump consistent hashing of stable keys to shards, in DataFrame expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: The linear congruential generator of the published algorithm.
MULTIPLIER = 2862933555777941757
INCREMENT = 1

#: Parts of each shard that are counted and numbered apart, so that no task holds a shard.
PARTS = 1024

#: Jumps after which all but a vanishing share of keys has arrived; the others take the long way.
USUAL_JUMPS = 40

_LOW = 0xFFFFFFFF


def _long(n: int) -> Column:
    return F.lit(n).cast("long")


def _advance(high: Column, low: Column) -> tuple[Column, Column]:
    """key * MULTIPLIER + INCREMENT modulo 2**64 on 32-bit halves; no product leaves 63 bits."""
    mh, ml = MULTIPLIER >> 32, MULTIPLIER & _LOW
    upper, lower = F.shiftright(low, 16), low.bitwiseAND(_long(0xFFFF))
    p1, p0 = upper * _long(ml), lower * _long(ml)
    bottom = p0 + F.shiftleft(p1.bitwiseAND(_long(0xFFFF)), 16) + _long(INCREMENT)
    carry = F.shiftright(p1, 16) + F.shiftright(bottom, 32)
    cross = (low * _long(mh)).bitwiseAND(_long(_LOW))
    hl = high.bitwiseAND(_long(0xFFFF)) * _long(ml) + F.shiftleft((F.shiftright(high, 16) * _long(ml)).bitwiseAND(_long(0xFFFF)), 16)
    return (carry + cross + hl).bitwiseAND(_long(_LOW)), bottom.bitwiseAND(_long(_LOW))


def jump_hash(key: Column, shards: int, *more: int) -> Column:
    """The shard of a 64-bit key for `shards` shards, and for each further number: a struct n<number> int of each.

    Each jump goes from shard b to a later one, so `shards` jumps always suffice; the first USUAL_JUMPS are tried
    first. A null key counts as key 0, which is also what a null of any type counts as in stable_key.
    """
    counts = sorted({shards, *more})
    most = counts[-1]
    key = F.coalesce(key.cast("long"), _long(0))

    def start() -> Column:
        return F.struct(
            F.shiftrightunsigned(key, 32).alias("h"), key.bitwiseAND(_long(_LOW)).alias("l"), _long(0).alias("j"),
            *(_long(0).alias(f"n{n}") for n in counts),
        )

    def jump(s: Column, _: Column) -> Column:
        h, low = _advance(s["h"], s["l"])
        gap = F.lit(float(1 << 31)) / (F.shiftright(h, 1) + _long(1)).cast("double")
        to = F.floor((s["j"] + _long(1)).cast("double") * gap)
        to = F.least(to, _long(1 << 40))
        on = F.struct(h.alias("h"), low.alias("l"), to.alias("j"), *(F.when(to < _long(n), to).otherwise(s[f"n{n}"]).alias(f"n{n}") for n in counts))
        return F.when(s["j"] < _long(most), on).otherwise(s)

    def walk(state: Column, jumps: int) -> Column:
        return F.aggregate(F.sequence(F.lit(1), F.lit(max(1, jumps))), state, jump)

    state = walk(start(), min(most, USUAL_JUMPS))
    if most > USUAL_JUMPS:
        state = F.transform(F.array(state), lambda s: F.when(s["j"] < _long(most), walk(s, most)).otherwise(s))[0]
    return F.transform(F.array(state), lambda s: F.struct(*(s[f"n{n}"].cast("int").alias(f"n{n}") for n in counts)))[0]


def stable_key(df: DataFrame, key: str) -> Column:
    """An integer key as it is, one of another type by its xxHash64; null stays null."""
    own = F.col(f"`{key}`")
    whole = isinstance(df.schema[key].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))
    return own.cast("long") if whole else F.when(own.isNotNull(), F.xxhash64(own))


def assign_shards(df: DataFrame, shards: int, key: str = "doc_id", grow_to: int | None = None) -> DataFrame:
    """Adds _shard int (0 to shards - 1) and _grown int (the shard among grow_to, default one more), in place of columns of
    that name; no shuffle.

    Key and number of shards alone decide; a key that moves on growth moves to a new shard. Pass a group's key to keep
    the group together.
    """
    grow_to = grow_to or shards + 1
    names = [c for c in df.columns if c not in ("_shard", "_grown")]
    placed = df.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)), jump_hash(stable_key(df, key), shards, grow_to).alias("at"))
    return placed.select(*(f"c{i}" for i in range(len(names))), f"at.n{shards}", f"at.n{grow_to}").toDF(*names, "_shard", "_grown")


def number_slots(rows: DataFrame, order: list[str], shard: str = "_shard", parts: int = PARTS, part: Column | None = None) -> DataFrame:
    """Adds _slot long: numbers the rows of each shard from 0 without a gap.

    Equal rows are counted before the shuffle and spread again after it. Each shard is cut into `parts` parts by
    `part` (None: a hash of the columns `order`); the parts' counts (at most shards x parts rows) give each part's first slot. Within a part the
    columns `order` decide; null sorts first.
    """
    names = rows.columns
    columns = [F.col(f"`{c}`") for c in names]
    part = F.pmod(F.xxhash64(*(F.col(f"`{c}`") for c in order)) if part is None else part, F.lit(parts)).cast("int")
    counted = rows.groupBy(*columns).agg(F.count(F.lit(1)).alias("_copies")).withColumn("_part", part)
    sizes = counted.groupBy(F.col(shard).alias("_s"), F.col("_part").alias("_p")).agg(F.sum("_copies").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("_s").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))
    firsts = sizes.select("_s", "_p", F.coalesce(before, _long(0)).alias("_first"))
    inside = Window.partitionBy(shard, "_part").orderBy(*(F.col(f"`{c}`") for c in order)).rowsBetween(Window.unboundedPreceding, -1)
    placed = counted.withColumn("_at", F.coalesce(F.sum("_copies").over(inside), _long(0)))
    placed = placed.join(F.broadcast(firsts), (F.col(shard) == F.col("_s")) & (F.col("_part") == F.col("_p")))
    first = F.col("_first") + F.col("_at")
    return placed.select(*columns, F.explode(F.sequence(first, first + F.col("_copies") - 1)).alias("_slot"))


def shard_manifest(df: DataFrame, shards: int, key: str = "doc_id", text: str = "text", grow_to: int | None = None) -> DataFrame:
    """(key, size long, text_crc32 long, shard int, slot long, grown_shard int), one row per row of df.

    size: UTF-8 bytes of the text (null: none) plus 8. A null text has the check sum of the empty text, a null key the
    shard of key 0; repeated rows have slots of their own.
    """
    own = df.select(F.col(f"`{key}`").alias("_key"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_text"))
    narrow = own.select("_key", (F.octet_length("_text") + 8).cast("long").alias("_size"), F.crc32(F.encode("_text", "utf-8")).alias("_crc"))
    part = F.pmod(F.coalesce(stable_key(narrow, "_key"), _long(0)), _long(PARTS)) + F.col("_crc")
    placed = number_slots(assign_shards(narrow, shards, "_key", grow_to), ["_key", "_size", "_crc"], part=part)
    return placed.select(
        F.col("_key").alias(key), F.col("_size").alias("size"), F.col("_crc").alias("text_crc32"),
        F.col("_shard").alias("shard"), F.col("_slot").alias("slot"), F.col("_grown").alias("grown_shard"),
    )


def write_shards(df: DataFrame, path: str, shards: int, key: str = "doc_id") -> None:
    """Writes df as Parquet with one folder for each shard (column shard, or _shard where df has that one).

    Rows are first dealt to about as many tasks as there are partitions, several for each shard, so that no task holds a
    shard and a shard has no more than its tasks' files.
    """
    name = "shard" if "shard" not in df.columns else "_shard"
    placed = assign_shards(df, shards, key).drop("_grown").withColumnRenamed("_shard", name)
    tasks = max(df.rdd.getNumPartitions(), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    each = max(1, -(-tasks // shards))
    salt = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(each))
    placed.repartition(shards * each, F.col(f"`{name}`"), salt).write.partitionBy(name).parquet(path)
