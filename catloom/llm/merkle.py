"""Merkle manifest of a dataset: an eight-ary hash tree whose versions share every node they do not change."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from catloom.llm.common import arrow_schema, remainder, stored, to_batches
from catloom.operators.rank import rank_rows

FAN = 8
BLOCK_LEVELS = 3  # a block of FAN ** BLOCK_LEVELS leaves is one group of a task
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(text: str) -> str:
    return sha256(text.encode()).hexdigest()


class PersistentTree:
    """An append-only store of nodes; a version is the number of its root, and versions share nodes."""

    def __init__(self, fan: int = FAN):
        self.fan = fan
        self.hashes: list[str] = []
        self.children: list[tuple[int, ...]] = []

    def _add(self, value: str, children: tuple[int, ...]) -> int:
        self.hashes.append(value)
        self.children.append(children)
        return len(self.hashes) - 1

    def _parent(self, children: tuple[int, ...]) -> int:
        return self._add(digest("".join(self.hashes[c] for c in children)), children)

    def build(self, leaves: Sequence[str], levels: int) -> int:
        """Root of a tree of ``levels`` levels above the leaves; they must fit below one root."""
        row = [self._add(leaf, ()) for leaf in leaves]
        for _ in range(levels):
            row = [self._parent(tuple(row[i:i + self.fan])) for i in range(0, len(row), self.fan)]
        return row[0]

    def path(self, root: int, index: int, levels: int) -> list[tuple[int, int]]:
        """(node, place of the child on the way) from the root down to the leaf's parent."""
        steps, node = [], root
        for level in reversed(range(levels)):
            place = index // self.fan ** level % self.fan
            steps.append((node, place))
            node = self.children[node][place]
        return steps

    def replace(self, root: int, index: int, levels: int, leaf: str) -> int:
        """Root of a new version with another leaf; only the leaf's ancestors are copied."""
        node = self._add(leaf, ())
        for parent, place in reversed(self.path(root, index, levels)):
            children = self.children[parent]
            node = self._parent((*children[:place], node, *children[place + 1:]))
        return node

    def siblings(self, root: int, index: int, levels: int) -> list[tuple[str, str]]:
        """(hashes left of the way, hashes right of it) of each level, from the leaf's up."""
        found = []
        for node, place in reversed(self.path(root, index, levels)):
            values = [self.hashes[c] for c in self.children[node]]
            found.append(("".join(values[:place]), "".join(values[place + 1:])))
        return found

    def forget(self, since: int) -> None:
        """Drop the nodes added after the first ``since``."""
        del self.hashes[since:], self.children[since:]


def leaf_hash(columns: Sequence[Column]) -> Column:
    """Hash of the columns in order: ``-`` for null, else bytes, colon, value."""
    parts = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(p).cast("string"), F.lit(":"), p), F.lit("-")) for p in parts]), 256)


def _levels(n: Column) -> Column:
    """Levels above ``n`` leaves: the least k for which FAN ** k is no less."""
    # 64-bit counts end below FAN ** 22.
    return F.aggregate(F.sequence(F.lit(0), F.lit(21)), F.lit(0), lambda k, i: F.when(
        F.pow(F.lit(float(FAN)), i) < n, i + 1).otherwise(k))


def _sorted(table: pa.Table) -> pa.Table:
    return table.sort_by("_pos")


_TOP = "_tree string,_pos long,_depth int,_hash string"
_PATH = "_tree string,_pos long,_lefts array<string>,_rights array<string>,_subroot string,_root string"


def _in_block(nodes: DataFrame, levels: int) -> DataFrame:
    return nodes.withColumn("_block", F.expr(f"_pos div {FAN ** levels}"))


def _tops(nodes: DataFrame, levels: int) -> DataFrame:
    """One row per aligned block: the node above it, at the block's place in the next tier."""
    schema = arrow_schema(_TOP)

    def top(table: pa.Table) -> pa.Table:
        table = _sorted(table.select(["_tree", "_pos", "_depth", "_hash", "_block"]))
        first = table.slice(0, 1).to_pylist()[0]
        tree, up = PersistentTree(), min(levels, first["_depth"])
        root = tree.build(table.column("_hash").to_pylist(), up)
        row = (first["_tree"], first["_block"], first["_depth"] - up, tree.hashes[root])
        return pa.Table.from_batches(to_batches([row], schema), schema)

    return _in_block(nodes, levels).groupBy("_tree", "_block").applyInArrow(top, _TOP)


def _descend(nodes: DataFrame, above: DataFrame, levels: int, fields: str, rows: Callable) -> DataFrame:
    """Meet every block of ``nodes`` with the path above it; ``rows(table, tree, root, up, path)`` gives the result."""
    schema = arrow_schema(fields)

    def meet(table: pa.Table, path: pa.Table) -> pa.Table:
        if not len(table):
            return pa.Table.from_batches([], schema)
        table, path = _sorted(table), path.to_pylist()[0]
        tree, up = PersistentTree(), min(levels, table.column("_depth")[0].as_py())
        root = tree.build(table.column("_hash").to_pylist(), up)
        return pa.Table.from_batches(to_batches(rows(table, tree, root, up, path), schema), schema)

    blocks = _in_block(nodes, levels).groupBy("_tree", "_block")
    return blocks.cogroup(above.withColumn("_block", F.col("_pos")).groupBy("_tree", "_block")).applyInArrow(meet, fields)


def _paths(table: pa.Table, tree: PersistentTree, root: int, up: int, path: dict):
    for index, (name, pos) in enumerate(zip(table.column("_tree").to_pylist(), table.column("_pos").to_pylist(), strict=True)):
        own = tree.siblings(root, index, up)
        yield (name, pos, [a for a, _ in own] + path["_lefts"], [b for _, b in own] + path["_rights"], path["_subroot"], path["_root"])


def _climb(nodes: DataFrame, levels: int) -> list[DataFrame]:
    """Tiers of nodes, each the tops of the blocks below it, up to one node per tree."""
    tiers = [nodes]
    depth = nodes.agg(F.max("_depth")).first()[0] or 0
    while depth > 0:
        tiers.append(stored(_tops(tiers[-1], levels)))
        depth -= levels
    return tiers


def _paths_down(tiers: list[DataFrame], above: DataFrame, levels: int, stop: int = 0) -> DataFrame:
    """Paths of the nodes of tier ``stop``, from those of the roots."""
    for tier in reversed(tiers[stop:-1]):
        above = stored(_descend(tier, above, levels, _PATH, _paths))
    return above


def merkle_manifest(
    docs: DataFrame, id: str = "doc_id", tree: str = "lang", text: str = "text", fields: Sequence[str] = FIELDS,
    tampered: Column | None = None, block_levels: int = BLOCK_LEVELS,
) -> DataFrame:
    """Per row: id, leaf, subroot, root, proof_sha256, folded_root, verified, version_nodes.

    Every row is a leaf, the hash of ``fields``. Leaves of one ``tree`` value ascend by id; eight consecutive nodes become their
    hash until one is left, the subroot; subroots in the order of the tree values (null first, bytewise) become the
    root likewise. ``proof_sha256`` is the hash of all siblings on the way up.

    Rows with ``tampered`` (default: crc32 of the id divisible by 3; null: no) are tampered by lower-casing A-Z in the text. Each makes a
    version of the tree: within the leaf's aligned block its ancestors are copied and all other nodes shared; above,
    the version goes on along the path of its block, which holds the untouched siblings. ``folded_root`` is the root
    of the row's version (of the original, if not tampered), ``version_nodes`` the hashes of the copied ancestors, lowest first.

    Blocks of 8 ** ``block_levels`` leaves are the groups of tasks, however large a tree is; tiers of block tops are
    built upwards, and paths go down from the root, one row per block. Leaves hold hashes, so no text is shuffled.

    Null ids come first and are not tampered, equal ids are ordered by their hashes, so rows that repeat an id are leaves of
    their own and fully equal rows are interchangeable. Null and empty fields differ. An empty table gives an empty result.
    Texts may be of any length; other columns may have any name.
    """
    if tampered is None:
        tampered = F.col(id).isNotNull() & (remainder(id, 3) == 0)
    changed = [F.translate(text, _UPPER, _LOWER) if f == text else F.col(f) for f in fields]
    name = F.coalesce(F.concat(F.lit("="), F.col(tree).cast("string")), F.lit(""))  # null first, then by bytes
    leaves = docs.select(
        name.alias("_tree"), F.col(id).cast("long").alias("_id"), leaf_hash([F.col(f) for f in fields]).alias("_hash"),
        F.when(F.coalesce(tampered, F.lit(False)), leaf_hash(changed)).alias("_other"))
    ranked = rank_rows(stored(leaves), [F.col("_id"), F.col("_hash"), F.col("_other")], ["_tree"], "_pos")
    ranked = stored(ranked.withColumn("_pos", F.col("_pos") - 1))
    sizes = stored(ranked.groupBy("_tree").agg(_levels(F.max("_pos") + 1).alias("_depth")))
    leaves = stored(ranked.join(sizes, "_tree"))

    tiers = _climb(leaves, block_levels)
    roots = tiers[-1].select(F.col("_tree").alias("_name"), "_hash")
    roots = rank_rows(roots, [F.col("_name")], (), "_pos").withColumn("_pos", F.col("_pos") - 1)
    size = _levels(F.lit(roots.agg(F.max("_pos")).first()[0] or 0) + 1)
    roots = stored(roots.withColumn("_tree", F.lit("")).withColumn("_depth", size))
    upper = _climb(roots, block_levels)
    nothing = F.array().cast("array<string>")
    top = upper[-1].select("_tree", "_pos", nothing.alias("_lefts"), nothing.alias("_rights"), F.lit("").alias("_subroot"), F.col("_hash").alias("_root"))
    above = _paths_down(upper, top, block_levels).drop("_tree", "_subroot")
    above = above.join(roots.select(F.col("_name").alias("_tree"), "_pos", F.col("_hash").alias("_subroot")), "_pos")
    above = stored(above.select("_tree", F.lit(0).cast("long").alias("_pos"), "_lefts", "_rights", "_subroot", "_root"))
    above = _paths_down(tiers, above, block_levels, stop=1)

    def versions(table: pa.Table, nodes: PersistentTree, root: int, up: int, path: dict):
        proof = "".join(a + b for a, b in zip(path["_lefts"], path["_rights"], strict=True))
        known = len(nodes.hashes)
        for index, row in enumerate(table.select(["_id", "_hash", "_other"]).to_pylist()):
            own = "".join(a + b for a, b in nodes.siblings(root, index, up))
            folded, copied = path["_root"], None
            if row["_other"] is not None:
                version = nodes.replace(root, index, up, row["_other"])
                copied = [nodes.hashes[n] for n, _ in reversed(nodes.path(version, index, up))]
                folded = nodes.hashes[version]
                nodes.forget(known)
                for left, right in zip(path["_lefts"], path["_rights"], strict=True):
                    folded = digest(left + folded + right)
                    copied.append(folded)
            yield (row["_id"], row["_hash"], path["_subroot"], path["_root"], digest(own + proof), folded, folded == path["_root"], copied)

    fields_out = ("_id long,leaf string,subroot string,root string,proof_sha256 string,folded_root string,verified boolean,"
                  "version_nodes array<string>")
    return _descend(leaves, above, block_levels, fields_out, versions).withColumnRenamed("_id", id)
