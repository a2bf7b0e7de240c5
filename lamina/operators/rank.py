"""Deterministic sampling, quotas, splits and orderings by digest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamina.functions.scalars import base62_tag
from lamina.operators.joins import lookup_join, null_safe_join
from lamina.session import cut

# Domains of the digests.
FRACTION_DOMAIN = "PTA-fraction-v1"
SPLIT_DOMAIN = "PTA-v4.0.2-split-unit"
BACKGROUND_DOMAIN = "background-v1"


def json_text(value: Column) -> Column:
    """A string as a JSON literal; of control characters NUL is escaped, which identities use as a separator."""
    escaped = F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return F.concat(F.lit('"'), F.replace(escaped, F.char(F.lit(0)), F.lit("\\u0000")), F.lit('"'))


def digest(domain: str, *parts: Column) -> Column:
    """SHA-256 of the JSON list of the domain and the parts, as lower-case hex (its order is the number's)."""
    items = [F.lit(f'"{domain}"'), *[json_text(p) for p in parts]]
    return F.sha2(F.concat(F.lit("["), F.concat_ws(",", *items), F.lit("]")), 256)


def fraction_threshold(fraction: float) -> str:
    """int(fraction * 2 ** 256) as 64 hex digits."""
    if not 0 <= fraction < 1:
        raise ValueError("a fraction is from 0 to below 1 here")
    numerator, denominator = float(fraction).as_integer_ratio()
    return f"{(numerator << 256) // denominator:064x}"


def fraction_sample(rows: DataFrame, identity: str, fraction: float) -> DataFrame:
    """Rows whose digest is below the fraction: independent of order, and nested for growing fractions."""
    return rows if fraction >= 1 else rows.where(digest(FRACTION_DOMAIN, F.col(identity)) < fraction_threshold(fraction))


def distributed_rank(df: DataFrame, *order: Column | str, name: str) -> DataFrame:
    """``df`` with its row number from 0 in the order of ``order``: a range sort, and for each of its partitions the rows before it.

    Where a window over the whole table, or over few keys, would sort in few tasks, this sorts in all of them.
    """
    sorted_rows = cut(df.orderBy(*order).withColumn("sorted_at", F.monotonically_increasing_id()))
    part = F.shiftright("sorted_at", 33)
    # a row for each partition of the sort, so no more than there are tasks
    counted = sorted(sorted_rows.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect())
    before, total = [], 0
    for number, n in counted:
        before.append((number, total))
        total += n
    if not before:
        return df.withColumn(name, F.lit(0).cast("long")).limit(0)
    offsets = F.broadcast(df.sparkSession.createDataFrame(before, "sorted_part long, sorted_before long"))
    place = F.col("sorted_before") + F.col("sorted_at").bitwiseAND((1 << 33) - 1)
    return sorted_rows.withColumn("sorted_part", part).join(offsets, "sorted_part").withColumn(name, place).drop("sorted_part", "sorted_before", "sorted_at")


def place_in(df: DataFrame, keys: list[str], *order: Column | str, name: str) -> DataFrame:
    """``df`` with its row number from 1 within ``keys`` (null is a key, too) in the order of ``order``, as ``row_number`` has it, however few keys there are."""
    ranked = distributed_rank(df, *keys, *order, name="rank_in_all")
    firsts = cut(ranked.groupBy(*keys).agg(F.min("rank_in_all").alias("first_in_all"), F.count(F.lit(1)).alias("rows_in_all")))
    joined = lookup_join(ranked, firsts, keys, "rows_in_all", firsts.agg(F.sum("rows_in_all")).first()[0] or 0)
    return joined.withColumn(name, F.col("rank_in_all") - F.col("first_in_all") + 1).drop("rank_in_all", "first_in_all", "rows_in_all")


def weight_before(df: DataFrame, keys: list[str], order: str, weight: str, name: str) -> DataFrame:
    """``df`` with the total ``weight`` of the rows before it within ``keys`` (null is a key, too) in the order of ``order``, however few keys there are.

    A range sort deals the keys over all tasks; sums of (partition, key), few as they are, give what lies in earlier partitions.
    """
    placed = cut(df.orderBy(*keys, order).withColumn("sorted_at", F.monotonically_increasing_id())).withColumn("sorted_part", F.shiftright("sorted_at", 33))
    parts = placed.groupBy("sorted_part", *keys).agg(F.sum(weight).alias("part_weight"))
    earlier = F.sum("part_weight").over(Window.partitionBy(*keys).orderBy("sorted_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = parts.withColumn("part_before", F.coalesce(earlier, F.lit(0))).drop("part_weight")
    own = F.sum(weight).over(Window.partitionBy("sorted_part", *keys).orderBy("sorted_at").rowsBetween(Window.unboundedPreceding, -1))
    inside = placed.withColumn("part_own", F.coalesce(own, F.lit(0)))
    joined = null_safe_join(inside, offsets, ["sorted_part", *keys])
    return joined.withColumn(name, F.col("part_before") + F.col("part_own")).drop("sorted_at", "sorted_part", "part_before", "part_own")


def background_limit(foreground: Column, percent: tuple[int, int]) -> Column:
    """floor(p / (1 - p) * foreground) for p = percent[0] / percent[1], in integers."""
    p, q = percent
    return F.floor(foreground * p / (q - p)) if p < q else F.lit(None)


def background_cap(rows: DataFrame, subset: str, percent: tuple[int, int] = (1, 4)) -> DataFrame:
    """All foreground, and of each subset the background that its limit allows, least digest first."""
    limit = rows.groupBy(subset).agg(background_limit(F.count_if("fg"), percent).alias("cap"))
    ranked = place_in(rows.where(~F.col("fg")).withColumn("key", digest(BACKGROUND_DOMAIN, F.col("identity"))), [subset], "key", "ord", name="place")
    kept = _within(ranked, limit, subset).drop("key", "place")
    return rows.where("fg").unionByName(kept)


def _within(ranked: DataFrame, limit: DataFrame, subset: str) -> DataFrame:
    """Rows whose place is within the cap of their subset."""
    sized = cut(null_safe_join(ranked.groupBy(subset).agg(F.count(F.lit(1)).alias("rows_in_all")), limit, [subset]))
    total = sized.agg(F.sum("rows_in_all")).first()[0] or 0
    return lookup_join(ranked, sized, subset, "rows_in_all", total).where(F.col("cap").isNull() | (F.col("place") <= F.col("cap"))).drop("cap", "rows_in_all")


def breadth_first_cap(rows: DataFrame, source: str, subset: str, percent: tuple[int, int] = (1, 4)) -> DataFrame:
    """As ``background_cap``, but sources take turns: first of each source, then second of each."""
    limit = rows.groupBy(subset).agg(background_limit(F.count_if("fg"), percent).alias("cap"))
    key = digest(BACKGROUND_DOMAIN, F.col("identity"))
    turned = place_in(rows.where(~F.col("fg")).withColumn("key", key), [subset, source], "key", "ord", name="turn")
    placed = place_in(turned, [subset], "turn", "key", "ord", name="place")
    kept = _within(placed, limit, subset).drop("key", "turn", "place")
    return rows.where("fg").unionByName(kept)


def final_cap(rows: DataFrame, source: str, subset: str, percent: tuple[int, int] = (1, 4)) -> DataFrame:
    """All foreground of originals (``version`` 0) and copies, and of each subset the background that its limit allows: originals first, least digest first, then
    copies, breadth first by source. The limit follows from all foreground, copies included."""
    limit = rows.groupBy(subset).agg(background_limit(F.count_if("fg"), percent).alias("cap"))
    key = digest(BACKGROUND_DOMAIN, F.concat_ws("#", "identity", F.col("version").cast("string")))
    behind = rows.where(~F.col("fg")).withColumn("key", key).withColumn("copy", F.col("version") > 0)
    turned = place_in(behind, [subset, "copy", source], "key", "ord", name="turn")
    # originals are one queue; a copy waits for the earlier copies of all sources
    placed = place_in(turned.withColumn("turn", F.when(F.col("copy"), F.col("turn")).otherwise(0)), [subset], "copy", "turn", "key", "ord", name="place")
    kept = _within(placed, limit, subset).drop("key", "copy", "turn", "place")
    return rows.where("fg").unionByName(kept)


def train_split(rows: DataFrame, unit: Column, share: tuple[int, int] = (4, 5)) -> DataFrame:
    """``rows`` with column ``part``: the first floor(share * n + 1/2) units by digest are train, the rest val.

    Units are few next to rows and are ranked apart from them; rows of a unit never part.
    """
    p, q = share
    with_unit = rows.withColumn("unit", unit)
    units = with_unit.select("unit").distinct()
    n = units.count()
    train = (2 * p * n + q) // (2 * q)
    keys = distributed_rank(units.select(digest(SPLIT_DOMAIN, F.col("unit")).alias("key")), "key", name="place")
    last = (keys.where(F.col("place") == train - 1).first() or [""])[0] if train else ""
    return with_unit.withColumn("part", F.when(digest(SPLIT_DOMAIN, F.col("unit")) <= last, "train").otherwise("val"))


def version_counts(rows: DataFrame, ratio: tuple[int, int], eligible: Column | None = None, copy_fg: Column | None = None) -> DataFrame:
    """``rows`` with ``copies``: floor(ratio * n + 1/2) versions in all of the n ``eligible`` rows (all if not given; of a split only the training part is).

    Each eligible row has the whole share; the remainder goes to the first of them by (foreground, digest, identity), where ``copy_fg`` tells whether the copy
    that it would be is foreground (that of the row if not given).
    """
    p, q = ratio
    counted = rows.withColumn("may_copy", F.coalesce(F.lit(True) if eligible is None else eligible, F.lit(False)))
    n = counted.where("may_copy").count()
    total = (2 * p * n + q) // (2 * q)
    whole, rest = divmod(max(total - n, 0), n) if n else (0, 0)
    key = F.struct((~(F.col("fg") if copy_fg is None else copy_fg)).alias("bg"), digest("version-v1", F.col("identity")).alias("key"), F.col("identity"))
    ordered = counted.where("may_copy").select(key.alias("k")).select("k.*")
    bound = distributed_rank(ordered, "bg", "key", "identity", name="place").where(F.col("place") == rest - 1).first() if rest else None
    extra = (key <= F.struct(F.lit(bound.bg), F.lit(bound.key), F.lit(bound.identity))).cast("int") if bound else F.lit(0)
    return counted.withColumn("copies", F.when(F.col("may_copy"), whole + extra).otherwise(0).cast("int")).drop("may_copy")


def versions(rows: DataFrame, ratio: tuple[int, int], eligible: Column | None = None, copy_fg: Column | None = None) -> DataFrame:
    """A row for each augmented version."""
    return version_counts(rows, ratio, eligible, copy_fg).where("copies > 0").withColumn("version", F.explode(F.sequence(F.lit(1), F.col("copies"))))


def exemplars(rows: DataFrame, key: str, tier: Column, order: list[str]) -> DataFrame:
    """One row for each exemplar key, the first by ``order``, with its rank by (tier, digest)."""
    first = rows.withColumn("turn", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("turn = 1").drop("turn")
    keyed = first.withColumn("tier", tier).withColumn("digest_of_key", digest("exemplar-v1", F.col(key)))
    return place_in(keyed, ["tier"], "digest_of_key", *order, name="rank").withColumn("rank", F.col("rank").cast("int")).drop("digest_of_key")


def round_robin(rows: DataFrame, group: str, order: str) -> DataFrame:
    """``rows`` with ``turn`` and ``place``: one of each group in rotation."""
    turned = place_in(rows, [group], order, name="turn").withColumn("turn", F.col("turn").cast("int"))
    return turned.withColumn(
        "place", F.row_number().over(Window.partitionBy("turn").orderBy(group))
    )


def compatible_batches(rows: DataFrame, key: str, order: list[str], limit: int) -> DataFrame:
    """``rows`` with ``batch``: consecutive rows of one key, ``limit`` at most."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return rows.withColumn("batch", F.floor((place - 1) / limit).cast("int"))


def digest_seed(hex_digest: Column) -> Column:
    """First four bytes of a digest, as a big-endian number."""
    return F.conv(F.substring(hex_digest, 1, 8), 16, 10).cast("long")


def unique_tags(rows: DataFrame, identity: str, length: int, max_rounds: int = 64) -> DataFrame:
    """(identity, nonce, tag): base-62 tags, unique over the table.

    All identities draw a tag with nonce 0; of those that drew one tag the first by identity keeps it, and the others
    draw again with the next nonce, never taking a tag that is held.
    """
    held = None
    left = cut(rows.select(F.col(identity).cast("string").alias("identity")).distinct())
    for nonce in range(max_rounds):
        if left.isEmpty():
            break
        drawn = left.withColumn("nonce", F.lit(nonce)).withColumn(
            "tag", base62_tag(F.sha2(F.concat_ws("|", "identity", "nonce"), 256), length)
        )
        free = drawn if held is None else drawn.join(held.select("tag"), "tag", "left_anti")
        first = free.groupBy("tag").agg(F.min("identity").alias("identity"), F.min("nonce").alias("nonce")).select("identity", "nonce", "tag")
        held = cut(first if held is None else held.unionByName(first))
        left = cut(left.join(held.select("identity"), "identity", "left_anti"))
    else:
        raise RuntimeError(f"tags of {length} digits still collide after {max_rounds} rounds")
    return held if held is not None else left.select("identity", F.lit(0).alias("nonce"), F.lit("").alias("tag"))
