"""Merkle manifest of a dataset: one tree of hashes for each group, a tree over the groups, and a proof for every row.

Nodes hold SHA-256 digests; a parent hashes the lower-case hex text of its children, one after another. Digests travel
as 32 bytes and become hex only where they are hashed or returned.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repolith.llm.common import broadcast_if_small, compact, cut

#: Children of a node; nodes of a level that one window holds (a multiple, so no run of children is parted).
ARITY, BLOCK = 8, 8**3
#: Columns of a leaf, in the order in which they are hashed.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def hashed(*texts: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*texts), 256))


def hex_text(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def leaf_digest(*values: Column) -> Column:
    """SHA-256 of each value's byte count, a colon and the value, or of a dash for null."""
    texts = [v.cast("string") for v in values]
    return hashed(*[F.when(t.isNull(), "-").otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts])


def ascii_folded(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


@dataclass
class Tree:
    """levels[r]: nodes (g, pos, n, digest, left, right and what the leaves carry) of groups that still have several at
    level r; tops[r]: the last node of groups that have one from level r on. left and right are the siblings' digests.
    """

    levels: list[DataFrame]
    tops: list[DataFrame]

    def subroots(self) -> DataFrame:
        """(g, digest): one row a group."""
        out = None
        for top in self.tops:
            out = top.select("g", "digest") if out is None else out.union(top.select("g", "digest"))
        return out

    def paths(self, above: DataFrame | None = None) -> DataFrame:
        """The leaves with path: array of (left, right) from the leaf's own level up.

        The paths of a level's nodes go down to their children, 1 row to ARITY, so each level is one join that is
        spread by parent. above: (g, path), what follows the path of each group's last node.
        """
        nothing = F.array().cast("array<struct<left: binary, right: binary>>")
        known = None
        for r in reversed(range(len(self.tops))):
            top = self.tops[r]
            top = top.withColumn("path", nothing) if above is None else top.join(above, "g")
            if r < len(self.levels):
                parents = known.select("g", F.col("pos").alias("up"), F.col("path").alias("rest"))
                below = self.levels[r].withColumn("up", _div("pos")).join(parents, ["g", "up"])
                below = below.withColumn("path", F.concat(F.array(F.struct("left", "right")), "rest"))
                top = below.select(*top.columns).union(top)
            known = top
        return known


def _div(column: str) -> Column:
    return F.floor(F.col(column) / ARITY).cast("long")


def placed(rows: DataFrame, group: str, *order: Column) -> DataFrame:
    """rows with g (a number of the row's group, ascending as the groups are), pos (place in the group, from 0) and n (rows
    of the group).

    Rows are dealt by ranges of group and order, so a large group fills many tasks; a range's rows are counted by group,
    and these counts (a row for each range and each group in it) tell where a range begins. Nulls are a group, the first.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(group).asc_nulls_first(), *order]
    ranged = cut(rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("_row", F.monotonically_increasing_id()))
    part = F.shiftright("_row", 33).alias("_part")
    sizes = ranged.groupBy(part, group).agg(F.min("_row").alias("_first"), F.count("*").alias("_count"))
    own = Window.partitionBy(group)
    sizes = sizes.select(
        "_part", F.col(group).alias("_group"), "_first", F.min("_first").over(own).alias("g"), F.sum("_count").over(own).alias("n"),
        F.coalesce(F.sum("_count").over(own.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
    )
    out = ranged.withColumn("_part", part).join(broadcast_if_small(sizes).withColumnRenamed("_part", "_p"), (F.col("_part") == F.col("_p")) & F.col(group).eqNullSafe(F.col("_group")))
    return out.withColumn("pos", F.col("_row") - F.col("_first") + F.col("_before")).drop("_row", "_part", "_p", "_group", "_first", "_before")


def with_siblings(nodes: DataFrame) -> DataFrame:
    """nodes (g, pos, n, digest) with left and right: the digests of the others of its run of ARITY.

    Columns at fixed lags and leads, masked by the node's slot in its run and by the run's length, supply them. A window
    is a block of a group, so that no task gets a whole group.
    """
    block = Window.partitionBy("g", F.floor(F.col("pos") / BLOCK)).orderBy("pos")
    slot = F.col("pos") % ARITY
    run = F.least(F.lit(ARITY), F.col("n") - F.col("pos") + slot)
    none = F.lit(b"")
    left = [F.when(slot >= k, F.lag("digest", k).over(block)).otherwise(none) for k in range(ARITY - 1, 0, -1)]
    right = [F.when(slot + k < run, F.lead("digest", k).over(block)).otherwise(none) for k in range(1, ARITY)]
    return nodes.withColumns({"left": F.concat(*left), "right": F.concat(*right)})


def tree(leaves: DataFrame, largest: int) -> Tree:
    """The tree over leaves (g, pos, n, digest, ...) of groups of at most ``largest``.

    In each level the first child of a run hashes the run, and so is its parent; a run of one is hashed as well.
    """
    levels, tops, nodes = [], [], leaves
    while largest > 1:
        tops.append(nodes.where("n = 1"))
        here = compact(with_siblings(nodes.where("n > 1")))
        levels.append(here)
        first = here.where(F.col("pos") % ARITY == 0)
        nodes = first.select("g", _div("pos").alias("pos"), F.ceil(F.col("n") / ARITY).cast("long").alias("n"), hashed(hex_text(F.concat("digest", "right"))).alias("digest"))
        largest = -(-largest // ARITY)
    return Tree(levels, [*tops, nodes])


def folded(start: Column, path: Column) -> Column:
    """The hex root that a leaf's digest and its siblings lead to."""
    return F.aggregate(path, hex_text(start), lambda h, p: F.sha2(F.concat(hex_text(p["left"]), h, hex_text(p["right"])), 256))


def _largest(rows: DataFrame) -> int:
    return rows.agg(F.max("n")).first()[0] or 0


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, group: str = "lang", order: str = "doc_id", altered: dict[str, Column] | None = None) -> DataFrame:
    """One row per document: ``order``, leaf, subroot (of its group), root, path, siblings (hex text of the path),
    altered_leaf. Digests are hex text.

    A group's leaves ascend by ``order`` (nulls last; ties by digest, and equal digests are equal rows); groups ascend
    by name as UTF-8 bytes, null first, and their subroots are the leaves of the tree that leads to the root. altered:
    other values for some fields, of which altered_leaf is made. Texts are hashed where they are read and shuffled
    nowhere. Rows that repeat are leaves of their own; null and empty values differ; other columns are ignored; an
    empty table gives an empty result.
    """
    values, other = [F.col(f) for f in fields], altered or {}
    rows = docs.select(
        F.col(group).alias("_name"), F.col(order).alias("_key"), leaf_digest(*values).alias("digest"),
        leaf_digest(*[other.get(f, F.col(f)) for f in fields]).alias("altered"),
    )
    leaves = placed(cut(rows), "_name", F.col("_key").asc_nulls_last(), F.col("digest"))
    groups = tree(leaves, _largest(leaves))
    subroots = cut(groups.subroots())
    upper = placed(subroots.select(F.lit(0).alias("_all"), F.col("g").alias("_g"), F.col("digest").alias("digest")), "_all", F.col("_g"))
    top = tree(upper, _largest(upper))
    root = top.subroots().first()
    above = top.paths().select(F.col("_g").alias("g"), "path", F.col("digest").alias("subroot"))
    above = broadcast_if_small(above)
    found = groups.paths(above.select("g", "path")).join(above.select("g", "subroot"), "g")
    siblings = F.array_join(F.transform("path", lambda p: hex_text(F.concat(p["left"], p["right"]))), "")
    return found.select(
        F.col("_key").alias(order), hex_text(F.col("digest")).alias("leaf"), hex_text(F.col("subroot")).alias("subroot"),
        F.lit(root["digest"].hex() if root else None).cast("string").alias("root"), "path", siblings.alias("siblings"), "altered",
    )


def tamper_check(docs: DataFrame, tampered: Column) -> DataFrame:
    """The manifest of ``docs``, checked against a copy in which ``tampered`` texts lost their capitals (A-Z).

    doc_id, leaf, subroot, root, proof_sha256 (of the siblings), folded_root (from the copy's leaf and the original
    siblings), verified (it is the root).
    """
    copy = {"text": F.when(F.coalesce(tampered, F.lit(False)), ascii_folded(F.col("text"))).otherwise(F.col("text"))}
    found = manifest(docs, altered=copy).withColumn("folded_root", folded(F.col("altered"), F.col("path")))
    return found.select("doc_id", "leaf", "subroot", "root", F.sha2("siblings", 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
