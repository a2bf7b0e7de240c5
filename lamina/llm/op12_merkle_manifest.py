"""Merkle manifest: higher-order SQL blocks.

Every row is a leaf, the SHA-256 of its columns. The leaves of a group (a source) ascend by id; every ``FANOUT`` consecutive nodes become the
hash of their digests until one is left, the group's subroot; the subroots, ordered by group, likewise give the root.

1. Leaves (two digests a row at most, never texts) are sorted by group and id over the cluster, and a row's place in its group
   follows from the counts of (partition, group), so a group of any size is dealt over many tasks.
2. ``FANOUT ** BLOCK_LEVELS`` neighbouring leaves are one ordered array. ``sequence``, ``transform``, ``slice`` and ``aggregate`` collapse it level by
   level inside the JVM; the texts of its runs stay at hand for the proofs.
3. Block roots are the nodes of the next round, which has 1/256 of the rows, until each group has one block; so are the subroots of the groups.
4. The siblings above a block come back by a join on (group, block), one row a block; each leaf's proof is put together and folded inside its block's array.

Defined results: a null column counts as ``-``, an empty text as ``0:``; a null id or group sorts first; rows repeated with the same id are leaves of their own,
ordered by digest; a lone leaf is its group's subroot, a lone subroot the root; a leaf without siblings has the hash of the empty text as its
proof; an empty table gives an empty result; columns not named are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamina.llm.rows import quoted
from lamina.session import cut, stored

FANOUT = 16
BLOCK_LEVELS = 2
BLOCK = FANOUT**BLOCK_LEVELS
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
_PATH = "array<struct<left: string, right: string>>"


def row_digest(*values: Column) -> Column:
    """SHA-256 of the values, each with its UTF-8 byte count in front, or ``-`` where it is null."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def table_digest(columns: tuple[str, ...] = COLUMNS, **instead: Column) -> Column:
    """``row_digest`` of the named columns, some of them replaced by other values."""
    return row_digest(*[instead[c] if c in instead else F.col(quoted(c)) for c in columns])


def proofs(docs: DataFrame, columns: tuple[str, ...] = COLUMNS, claimed: Column | None = None, id_col: str = "doc_id", group_col: str = "source") -> DataFrame:
    """doc_id, source, leaf, subroot, root, proof_sha256, folded_root, verified for each row of ``docs``.

    ``claimed`` is a digest to be proved in place of the row's own (the row's own if not given): it is folded with the siblings of the row, and
    ``verified`` tells whether that gives the root.
    """
    leaf = table_digest(columns)
    claim = F.nullif(claimed, leaf) if claimed is not None else F.lit(None).cast("string")
    # written once, as the sort looks at its input twice
    leaves = stored(docs.select(F.col(quoted(id_col)).cast("long").alias("doc_id"), F.col(quoted(group_col)).alias("group"), leaf.alias("digest"), claim.alias("claim")))
    blocks = stored(_blocked(_placed(leaves), "doc_id", "claim"))
    upper = _above(blocks)
    subroots = upper.where("block = 0").select("group", "root")
    ranked = _placed(subroots.select(F.lit(None).cast("string").alias("group"), F.col("group").alias("doc_id"), F.col("root").alias("digest")), "doc_id")
    top = _climbed(_blocked(ranked, "doc_id")).select(F.col("doc_id").alias("of"), F.col("path").alias("top_path"), F.col("root").alias("top"))
    known = upper.join(top, F.col("group").eqNullSafe(F.col("of"))).select(
        F.col("group").alias("of_group"), F.col("block").alias("of_block"), F.concat("path", "top_path").alias("above"), F.col("root").alias("subroot"), "top"
    )
    joined = blocks.join(known, F.col("group").eqNullSafe(F.col("of_group")) & (F.col("block") == F.col("of_block")))
    proved = F.transform(F.sequence(F.lit(0), F.size("items") - 1), lambda k: _proof(F.get("items", k), k))
    return joined.select("group", "subroot", "top", F.explode(proved).alias("p")).select(
        "p.doc_id",
        F.col("group").alias("source"),
        "p.leaf",
        "subroot",
        F.col("top").alias("root"),
        "p.proof_sha256",
        "p.folded_root",
        (F.col("p.folded_root") == F.col("top")).alias("verified"),
    )


def manifest(docs: DataFrame, columns: tuple[str, ...] = COLUMNS, id_col: str = "doc_id", group_col: str = "source") -> DataFrame:
    """source, n_rows, subroot, root for each group of ``docs``."""
    found = proofs(docs, columns, None, id_col, group_col)
    return found.groupBy("source").agg(F.count(F.lit(1)).alias("n_rows"), F.min("subroot").alias("subroot"), F.min("root").alias("root"))


def _placed(leaves: DataFrame, *by: str) -> DataFrame:
    """``leaves`` with ``at``, the place in the group from 0, and ``width``, the group's size.

    Places come from the sorted order: rows of the group in earlier partitions, plus the place among those of its own partition.
    """
    order = by or ("doc_id", "digest", "claim")
    sorted_rows = cut(leaves.orderBy("group", *order).withColumn("at", F.monotonically_increasing_id()))
    rows = sorted_rows.withColumn("part", F.shiftright("at", 33)).withColumn("at", F.col("at").bitwiseAND((1 << 33) - 1))
    # a row for each group and each partition it lies in; a group lies in as many as there are tasks at most
    counts = rows.groupBy("part", "group").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    group = Window.partitionBy("group")
    before = F.coalesce(F.sum("n").over(group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select(F.col("part").alias("of_part"), F.col("group").alias("of_group"), (before - F.col("first")).alias("shift"), F.sum("n").over(group).alias("width"))
    joined = rows.join(offsets, (F.col("part") == F.col("of_part")) & F.col("group").eqNullSafe(F.col("of_group")))
    return joined.withColumn("at", F.col("at") + F.col("shift")).drop("part", "of_part", "of_group", "shift")


def _blocked(nodes: DataFrame, *carry: str) -> DataFrame:
    """Arrays of ``BLOCK`` neighbours and what they collapse to: group, block, width, items, runs, digest.

    ``runs`` has, level by level, the texts of the runs of ``FANOUT`` digests. A block of a wider group collapses by ``BLOCK_LEVELS``
    levels, a group's only block until one node is left.
    """
    item = F.struct("at", "digest", *carry)
    held = nodes.groupBy("group", F.floor(F.col("at") / BLOCK).alias("block")).agg(F.max("width").alias("width"), F.sort_array(F.collect_list(item)).alias("items"))
    levels = F.lit(BLOCK_LEVELS)
    for k in reversed(range(BLOCK_LEVELS)):
        levels = F.when(F.col("width") <= FANOUT**k, F.lit(k)).otherwise(levels)
    steps = F.slice(F.sequence(F.lit(1), F.lit(BLOCK_LEVELS)), F.lit(1), levels)

    def run_texts(digests: Column) -> Column:
        count = F.ceil(F.size(digests) / FANOUT).cast("int")
        return F.transform(F.sequence(F.lit(0), count - 1), lambda k: F.array_join(F.slice(digests, k * FANOUT + 1, F.lit(FANOUT)), ""))

    def level_up(runs: Column, step: Column) -> Column:
        below = F.when(step == 1, F.transform("items", lambda x: x["digest"])).otherwise(F.transform(F.element_at(runs, -1), lambda r: F.sha2(r, 256)))
        return F.concat(runs, F.array(run_texts(below)))

    collapsed = held.withColumn("runs", F.aggregate(steps, F.array().cast("array<array<string>>"), level_up))
    last = F.element_at(F.element_at("runs", -1), 1)
    return collapsed.withColumn("digest", F.when(F.size("runs") == 0, F.get("items", F.lit(0))["digest"]).otherwise(F.sha2(last, 256)))


def _above(blocks: DataFrame) -> DataFrame:
    """group, block, path, root: the siblings above each block within its group, and the group's last node."""
    own = blocks.select("group", "block", "width", "digest")
    widest = own.agg(F.max("width")).first()[0] or 0
    if widest <= BLOCK:
        return own.select("group", "block", F.array().cast(_PATH).alias("path"), F.col("digest").alias("root"))
    nodes = own.select("group", F.col("block").alias("at"), "digest", F.ceil(F.col("width") / BLOCK).alias("width"))
    return _climbed(stored(_blocked(nodes))).select("group", F.col("at").alias("block"), "path", "root")


def _climbed(blocks: DataFrame) -> DataFrame:
    """A row for each item of the blocks with ``path``, its siblings up to the group's last node, and ``root``, that node."""
    upper = _above(blocks).select(F.col("group").alias("of_group"), F.col("block").alias("of_block"), "path", "root")
    joined = blocks.join(upper, F.col("group").eqNullSafe(F.col("of_group")) & (F.col("block") == F.col("of_block")))
    paths = F.transform("items", lambda x, k: F.struct(x.alias("item"), F.concat(_siblings(k), F.col("path")).alias("path")))
    return joined.select("group", F.explode(paths).alias("p"), "root").select("group", "p.item.*", "p.path", "root")


def _siblings(k: Column) -> Column:
    """The others of its run, left and right of item ``k`` of a block, from the lowest level of the block up."""

    def others(run_texts: Column, level: Column) -> Column:
        place = F.floor(k / F.pow(F.lit(FANOUT), level)).cast("int")
        run, own = F.get(run_texts, F.floor(place / FANOUT).cast("int")), place % FANOUT
        return F.struct(F.substring(run, F.lit(1), own * 64).alias("left"), F.substring(run, own * 64 + 65, F.lit(64 * FANOUT)).alias("right"))

    return F.transform("runs", others)


def _proof(item: Column, k: Column) -> Column:
    path = F.concat(_siblings(k), F.col("above"))
    text = F.array_join(F.transform(path, lambda p: F.concat(p["left"], p["right"])), "")
    folded = F.aggregate(path, F.coalesce(item["claim"], item["digest"]), lambda h, p: F.sha2(F.concat(p["left"], h, p["right"]), 256))
    return F.struct(item["doc_id"].alias("doc_id"), item["digest"].alias("leaf"), F.sha2(text, 256).alias("proof_sha256"), folded.alias("folded_root"))


def oracle_sql() -> str:
    """The same proofs, one recursive step a level, over rows."""
    crc = """list_reduce(list_concat([4294967295::UBIGINT], list_transform(range(1, length({0}) + 1), lambda k: ascii(substr({0}, k, 1))::UBIGINT)),
        lambda c, b: list_reduce(list_concat([xor(c, b)], list_transform(range(8), lambda z: 0::UBIGINT)),
            lambda x, z: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384::UBIGINT ELSE 0::UBIGINT END)))"""
    h = lambda text: "sha256(" + " || ".join(f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR) || ':' || {c} END" for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH RECURSIVE hashed AS (
  SELECT doc_id, source, {h("text")} AS leaf, CASE WHEN xor({crc.format("doc_id::VARCHAR")}, 4294967295::UBIGINT) % 5 = 0 THEN {h(lower)} ELSE {h("text")} END AS claim
  FROM documents
), leaves AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS width FROM hashed
), tree AS (
  SELECT source, 0 AS level, pos, width, leaf AS digest FROM leaves
  UNION ALL
  SELECT source, level + 1, pos // 16, (width + 15) // 16, sha256(string_agg(digest, '' ORDER BY pos)) FROM tree WHERE width > 1 GROUP BY source, level, pos // 16, width
), subroots AS (
  SELECT source, level, digest AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS width FROM tree WHERE width = 1
), upper AS (
  SELECT 0 AS level, pos, width, subroot AS digest FROM subroots
  UNION ALL
  SELECT level + 1, pos // 16, (width + 15) // 16, sha256(string_agg(digest, '' ORDER BY pos)) FROM upper WHERE width > 1 GROUP BY level, pos // 16, width
), steps AS (
  SELECT l.source, l.pos AS leaf_pos, t.level AS step, coalesce(string_agg(t.digest, '' ORDER BY t.pos) FILTER (t.pos < (l.pos >> (4 * t.level))), '') AS lower_side,
         coalesce(string_agg(t.digest, '' ORDER BY t.pos) FILTER (t.pos > (l.pos >> (4 * t.level))), '') AS upper_side
  FROM leaves l JOIN tree t ON l.source IS NOT DISTINCT FROM t.source AND t.width > 1 AND t.pos // 16 = (l.pos >> (4 * t.level + 4))
  GROUP BY ALL
  UNION ALL
  SELECT l.source, l.pos, s.level + u.level, coalesce(string_agg(u.digest, '' ORDER BY u.pos) FILTER (u.pos < (s.pos >> (4 * u.level))), ''),
         coalesce(string_agg(u.digest, '' ORDER BY u.pos) FILTER (u.pos > (s.pos >> (4 * u.level))), '')
  FROM leaves l JOIN subroots s ON l.source IS NOT DISTINCT FROM s.source JOIN upper u ON u.width > 1 AND u.pos // 16 = (s.pos >> (4 * u.level + 4))
  GROUP BY l.source, l.pos, s.level, u.level
), folded AS (
  SELECT source, pos, 0 AS step, claim AS digest FROM leaves
  UNION ALL
  SELECT f.source, f.pos, f.step + 1, sha256(s.lower_side || f.digest || s.upper_side) FROM folded f JOIN steps s ON f.source IS NOT DISTINCT FROM s.source AND f.pos = s.leaf_pos AND f.step = s.step
), joined AS (
  SELECT source, leaf_pos AS pos, string_agg(lower_side || upper_side, '' ORDER BY step) AS siblings, max(step) + 1 AS height FROM steps GROUP BY ALL
)
SELECT l.doc_id, l.leaf, s.subroot, u.digest AS root, sha256(coalesce(j.siblings, '')) AS proof_sha256, f.digest AS folded_root, f.digest = u.digest AS verified
FROM leaves l JOIN subroots s ON l.source IS NOT DISTINCT FROM s.source JOIN upper u ON u.width = 1
LEFT JOIN joined j ON l.source IS NOT DISTINCT FROM j.source AND l.pos = j.pos
JOIN folded f ON l.source IS NOT DISTINCT FROM f.source AND l.pos = f.pos AND f.step = coalesce(j.height, 0)
"""
