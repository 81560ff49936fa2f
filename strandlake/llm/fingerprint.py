"""Exact document fingerprints of canonical texts, in DataFrame expressions only.

A text is brought to one form (Unicode composition, case and white space folded) and hashed to 128 bits by xxHash. Rows
with equal hashes form a bucket; in buckets of more than one row the canonical bytes are compared, and different texts
that met there get different fingerprints.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandlake.llm.common import materialize

#: Ids of rows in shared buckets up to which they are broadcast to narrow the second reading; beyond, it reads all rows.
BROADCAST_IDS = 2_000_000
#: Rows of a part when rows are put beside their successors, the greatest number of parts, and the quantiles of keys
#: between which parts are cut.
RANGE_ROWS, MOST_RANGES, QUANTILES = 2000, 1 << 16, 256


#: Fixed value: the class of the Unicode library that Spark ships, called by the SQL function `reflect`.
NORMALIZER = "com.ibm.icu.text.Normalizer"


def compose(text: Column) -> Column:
    """Unicode composition (NFC) of a text that is not null, by the Unicode library beside Spark's own collations.

    Texts without a character from U+0300 on, most of them, are composed already and are passed as they are.
    """
    full = F.reflect(F.lit(NORMALIZER), F.lit("compose"), text, F.lit(False))
    return F.when(text.rlike(r"[^\u0000-\u02ff]"), full).otherwise(text)


def canonical(text: Column) -> Column:
    """Composed, case folded (by way of upper case, so that sharp s meets ss), runs of white space as one space, none at
    the ends. A null text counts as empty."""
    folded = F.lower(F.replace(F.upper(compose(F.coalesce(text, F.lit("")))), F.lit("ẞ"), F.lit("SS")))
    return F.trim(F.regexp_replace(folded, r"[\s\u0085   -     　]+", " "))


def wide_hash(text: Column) -> Column:
    """128 bits of xxHash as 32 hexadecimal digits: two chained hashes with different beginnings."""
    return F.lower(F.concat(F.lpad(F.hex(F.xxhash64(text)), 16, "0"), F.lpad(F.hex(F.xxhash64(F.lit("second"), text)), 16, "0")))


def different_in_bucket(texts: DataFrame) -> DataFrame:
    """(h, sha, place) of the texts(h, canon) of all buckets that hold different bytes: places from 0.

    Rows are grouped by hash and bytes; copies are combined before the shuffle, so a bucket costs one row for each of
    its different texts and task. Digests of the texts that were told apart go on.
    """
    distinct = texts.groupBy("h", "canon").agg(F.count(F.lit(1)).alias("_n")).select("h", F.sha2("canon", 256).alias("sha"))
    distinct = materialize(distinct, "distinct")
    shared = distinct.groupBy("h").agg(F.count(F.lit(1)).alias("_texts")).where("_texts > 1").select("h")
    return distinct.join(shared, "h").select("h", "sha", (F.row_number().over(Window.partitionBy("h").orderBy("sha")) - 1).alias("place"))


def settle(hashed: DataFrame, columns: list[str], texts_of: Callable[[DataFrame | None], DataFrame], key: str = "doc_id", again: tuple[str, ...] = ()) -> DataFrame:
    """Turns the hash columns of `hashed` (each with a column <name>_sha beside it) to fingerprints.

    again: further hash columns, of texts that the other columns hold in other rows.

    texts_of(ids) gives texts(h, canon) again for the rows with these ids (None: of all). It is asked for the rows of
    shared buckets alone while their ids can be broadcast.
    """
    one = [hashed.select(F.col(c).alias("h"), F.col(key).alias("id"), F.lit(i).alias("i")) for i, c in enumerate(columns)]
    each = one[0]
    for more in one[1:]:
        each = each.unionByName(more)
    shared = each.groupBy("h").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("h")
    shared = materialize(shared, "shared")
    ids = each.join(shared, "h", "left_semi").select(F.col("id").alias("_id")).distinct()
    ids = materialize(ids, "ids")
    texts = texts_of(ids if ids.count() <= BROADCAST_IDS else None)
    texts = texts.join(F.broadcast(shared), "h", "left_semi") if shared.count() <= BROADCAST_IDS else texts
    clashes = materialize(different_in_bucket(texts), "clashes")
    if clashes.isEmpty():
        return hashed
    for c in [*columns, *again]:
        other = clashes.select(F.col("h").alias("_h"), F.col("sha").alias("_s"), "place")
        joined = hashed.join(other, (F.col(c) == F.col("_h")) & (F.col(f"{c}_sha") == F.col("_s")), "left")
        hashed = joined.withColumn(c, F.when(F.col("place") > 0, F.concat(c, F.lit("-"), F.col("place").cast("string"))).otherwise(F.col(c))).drop("_h", "_s", "place")
    return hashed


def fingerprint(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fingerprint string): equal exactly where the canonical texts are. Null and empty texts are equal; repeated
    rows give repeated rows."""
    own = docs.select(F.col(f"`{key}`").alias("_k"), canonical(F.col(f"`{text}`")).alias("canon"))
    hashed = materialize(own.select("_k", wide_hash(F.col("canon")).alias("f"), F.sha2("canon", 256).alias("f_sha")), "hashed")

    def texts_of(ids: DataFrame | None) -> DataFrame:
        some = own if ids is None else own.join(F.broadcast(ids), F.col("_k").eqNullSafe(F.col("_id")), "left_semi")
        return some.select(wide_hash(F.col("canon")).alias("h"), "canon")

    return settle(hashed, ["f"], texts_of, "_k").select(F.col("_k").alias(key), F.col("f").alias("fingerprint"))


def _place(cuts: list, key: Column) -> Column:
    """How many of the ascending cuts are at most the key, by binary search in a literal array."""
    if not cuts:
        return F.lit(0)
    known = F.array(*(F.lit(c) for c in cuts))
    steps = F.array(*(F.lit(1 << i) for i in reversed(range(len(cuts).bit_length()))))

    def step(at: Column, size: Column) -> Column:
        return F.when((at + size <= len(cuts)) & (F.try_element_at(known, at + size) <= key), at + size).otherwise(at)

    return F.aggregate(steps, F.lit(0), step)


def ordered_parts(own: DataFrame) -> DataFrame:
    """Adds part long to own(key, tie, ...): rows of a smaller part never follow, in (key, tie), rows of a larger one; a
    null key is the smallest. Parts are of like size, whatever the distribution of keys and however many rows share one.

    The keys are cut at measured quantiles, and each range of n rows into n / RANGE_ROWS parts by (key, tie), where tie,
    a hash, tells rows of one key apart.
    """
    key = F.col("key")
    quantiles = F.percentile_approx("key", [i / QUANTILES for i in range(1, QUANTILES)], 20 * QUANTILES)
    cuts = sorted({c for c in own.agg(quantiles).first()[0] or ()})
    cuts = sorted({*cuts, *(c + 1 for c in cuts)}) if cuts and isinstance(cuts[0], int) else cuts
    own = own.withColumn("_range", F.when(key.isNull(), -1).otherwise(_place(cuts, key)))
    found = own.groupBy("_range").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("low"), F.max("key").alias("high")).orderBy("_range").collect()
    total = sum(r["n"] for r in found)
    each = max(RANGE_ROWS, -(-total // MOST_RANGES))
    first, about = 0, {}
    for r in found:
        parts = -(-r["n"] // each)
        about[r["_range"]] = (first, parts, float(r["low"] or 0), float(r["high"] or 0) - float(r["low"] or 0) + 1)
        first += parts
    if not about:
        return own.withColumn("part", F.lit(0).cast("long")).drop("_range")
    index = F.col("_range") + 2
    at = lambda i: F.try_element_at(F.array(*(F.lit(about.get(r, (0, 1, 0.0, 1.0))[i]) for r in range(-1, max(about) + 1))), index)
    share = (F.coalesce(key.cast("double"), F.lit(0.0)) - at(2) + (F.col("tie") / float(1 << 64) + 0.5)) / at(3)
    inside = F.greatest(F.lit(0).cast("long"), F.least(F.floor(share * at(1)), at(1).cast("long") - 1))
    return own.withColumn("part", at(0) + inside).drop("_range")


def beside_next(docs: DataFrame, key: str = "doc_id", text: str = "text") -> Callable[[DataFrame | None], DataFrame]:
    """A function giving (key, n_chars, text, next_key, next_text), next in descending order of the key, after the last
    the first; for a set of ids, of those rows alone.

    Rows are cut into ordered parts of like size, each part is sorted in a window of its own, and the first row of a part
    is also sent to the part before it. Keys are numbers; of equal keys a hash of the text decides the order, a null key
    comes last. Texts are shuffled once.
    """
    own = docs.select(F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    own = ordered_parts(own.withColumn("tie", F.xxhash64("text")))
    heads = own.groupBy("part").agg(F.max(F.struct(F.col("key").isNotNull().alias("some"), "key", "tie")).alias("head"))
    around = Window.orderBy("part")
    above = F.coalesce(F.lead("part").over(around), F.first("part").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    heads = heads.select(F.col("head.key").alias("_key"), F.col("head.tie").alias("_tie"), "part", above.alias("to"))
    heads = materialize(heads.select("_key", "_tie", F.col("part").alias("_part"), "to"), "heads")

    def rows(ids: DataFrame | None) -> DataFrame:
        """ids: the keys whose rows are wanted and those of their successors."""
        some = own if ids is None else own.join(F.broadcast(ids), F.col("key").eqNullSafe(F.col("_id")), "left_semi")
        met = some.join(F.broadcast(heads), (F.col("part") == F.col("_part")) & F.col("key").eqNullSafe(F.col("_key")) & (F.col("tie") == F.col("_tie")), "left")
        place = F.array_compact(F.array(F.struct(F.col("part").alias("part"), F.lit(False).alias("guest")), F.when(F.col("to").isNotNull(), F.struct(F.col("to").alias("part"), F.lit(True).alias("guest")))))
        placed = met.select("key", "tie", "text", F.explode(place).alias("p")).select("key", "tie", "text", "p.part", "p.guest")
        order = Window.partitionBy("part").orderBy("guest", F.desc_nulls_last("key"), F.desc("tie"))
        beside = placed.select("key", "text", "guest", F.lead("text").over(order).alias("next_text"), F.lead("key").over(order).alias("next_key"))
        return beside.where(~F.col("guest")).select("key", F.length("text").cast("long").alias("n_chars"), "text", "next_key", F.coalesce("next_text", F.lit("")).alias("next_text"))

    return rows


def edited(text: Column, next_text: Column, n_chars: Column) -> Column:
    """The last half of the code points, rounded down, replaced by as many first ones (or all) of the next text."""
    half = F.floor(n_chars / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), n_chars.cast("int") - half), F.substring(next_text, F.lit(1), half))
