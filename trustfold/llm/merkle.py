"""Merkle manifest of a dataset, stored every few levels and recomputed in between.

Each group (source) has a tree over its rows in order of id, and the groups'
roots are the leaves of one more tree. Three neighbours make a node.

Of a tree only every ``STEP``-th level is stored. Its aligned subtrees have at
most 3^STEP stored nodes, whatever the size of the group, so a group with a
third of all rows is many subtrees. Building a level hashes each subtree to its
top. A proof goes the other way: from the top down, each subtree gets the proof
of its top, regenerates its missing inner nodes from the stored ones below,
emits the siblings of each, and forgets the inner nodes again. Subtrees are dealt out by
(group, number); no row is joined, only subtrees are.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from hashlib import sha256

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trustfold.llm.common import free_names, stored
from trustfold.plans.ordered import global_row_number, keyed_row_number

FANOUT = 3
STEP = 5  # levels from one stored level to the next

_OWN = ("tree", "at", "digest", "left", "right", "subroot", "root", "row", "block")


@dataclass(frozen=True)
class Manifest:
    """Stored levels: of the groups' trees (tree, at, digest, row), and of the tree over the groups' roots."""

    groups: list[DataFrame]
    top: list[DataFrame]
    step: int = STEP

    def root(self) -> str | None:
        """Digest of the whole dataset; None if it has no rows."""
        r = self.top[-1].first()
        return r["digest"] if r else None

    def save(self, path: str) -> None:
        for name, levels in (("groups", self.groups), ("top", self.top)):
            for i, level in enumerate(levels):
                level.write.parquet(f"{path.rstrip('/')}/{name}/{i}")
        spark = self.top[0].sparkSession
        spark.createDataFrame([(len(self.groups), len(self.top), self.step)], "groups int, top int, step int").write.parquet(f"{path.rstrip('/')}/levels")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Manifest:
        top = path.rstrip("/")
        n = spark.read.parquet(f"{top}/levels").first()
        return Manifest(*[[spark.read.parquet(f"{top}/{name}/{i}") for i in range(n[name])] for name in ("groups", "top")], step=n["step"])


def leaf_digest(*fields: Column) -> Column:
    """SHA-256, in lowercase hex, of the fields in turn: '-' for null, else the length in UTF-8 bytes, ':' and the value."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.when(t.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts]), 256)


def _node(digests: Sequence[str]) -> str:
    return sha256("".join(digests).encode()).hexdigest()


def _inner(digests: Sequence[str], block: int, step: int) -> list[Sequence[str]]:
    """All levels of aligned subtree ``block`` of a tree, from the stored one up to its top. A first subtree that is not
    full has no second: it ends as soon as one node is left. (A full one has ``step`` levels in either case.)"""
    alone = block == 0 and len(digests) < FANOUT**step
    levels = [digests]
    while len(levels) <= step and not (alone and len(levels[-1]) == 1):
        below = levels[-1]
        levels.append([_node(below[i : i + FANOUT]) for i in range(0, len(below), FANOUT)])
    return levels


def _subtrees(nodes: DataFrame, step: int) -> DataFrame:
    """(tree, block, digests, rows): the stored nodes of each aligned subtree, at most 3^step, in order."""
    own = F.sort_array(F.collect_list(F.struct("at", "digest", "row")))
    blocks = nodes.groupBy("tree", F.floor(F.col("at") / FANOUT**step).alias("block")).agg(own.alias("own"))
    return blocks.select("tree", "block", F.col("own.digest").alias("digests"), F.col("own.row").alias("rows"))


def _levels(nodes: DataFrame, step: int) -> list[DataFrame]:
    """The stored levels over ``nodes`` (tree, at, digest, row), up to the one at which each tree has a single node."""

    @F.pandas_udf(T.StringType())
    def top(digests: pd.Series, blocks: pd.Series) -> pd.Series:
        return pd.Series([_inner(list(d), b, step)[-1][0] for d, b in zip(digests, blocks)], dtype=object)

    levels = [stored(nodes)]
    while (levels[-1].agg(F.max("at")).first()[0] or 0) > 0:
        up = _subtrees(levels[-1], step).select("tree", F.col("block").alias("at"), top("digests", "block").alias("digest"))
        levels.append(stored(up.withColumn("row", F.struct("at"))))
    return levels


def _down(nodes: DataFrame, above: DataFrame, step: int) -> DataFrame:
    """(tree, row, digest, left, right, subroot, root) of every node; ``above`` has the same of each subtree's top, with
    ``block`` for row.

    left and right hold, level by level, the digests before and after the path within its run of three, concatenated.
    """
    both = _subtrees(nodes, step).join(above, ["tree", "block"])
    row_type = nodes.schema["row"].dataType
    texts = T.ArrayType(T.StringType())

    def run(batches):
        for b in batches:
            blocks, trees = b.column("block").to_pylist(), b.column("tree").to_pylist()
            for i in range(b.num_rows):
                digests = b.column("digests")[i].as_py()
                n = len(digests)
                levels = _inner(digests, blocks[i], step)[:-1]
                sides = []
                for level in levels:
                    runs = [level[j - j % FANOUT : j - j % FANOUT + FANOUT] for j in range(len(level))]
                    sides.append([("".join(r[: j % FANOUT]), "".join(r[j % FANOUT + 1 :])) for j, r in enumerate(runs)])
                paths = [[s[j // FANOUT**k] for k, s in enumerate(sides)] for j in range(n)]
                over = [b.column(c)[i].as_py() for c in ("left", "right")]
                left, right = ([[x[side] for x in p] + over[side] for p in paths] for side in (0, 1))
                same = lambda c: pa.array([b.column(c)[i].as_py()] * n, pa.string())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([trees[i]] * n, pa.string()), b.column("rows")[i].values, pa.array(digests, pa.string()),
                     pa.array(left, pa.list_(pa.string())), pa.array(right, pa.list_(pa.string())), same("subroot"), same("root")],
                    names=["tree", "row", "digest", "left", "right", "subroot", "root"])

    schema = T.StructType([T.StructField("tree", T.StringType()), T.StructField("row", row_type), T.StructField("digest", T.StringType()),
                           T.StructField("left", texts), T.StructField("right", texts), T.StructField("subroot", T.StringType()),
                           T.StructField("root", T.StringType())])
    return both.select("tree", "block", "digests", "rows", "left", "right", "subroot", "root").mapInArrow(run, schema)


def _proofs(levels: list[DataFrame], above: DataFrame, step: int) -> DataFrame:
    """``_down`` through all stored levels; ``above``: (tree, left, right, subroot, root) of the trees' tops."""
    found = _down(levels[-1], above.withColumn("block", F.lit(0).cast("long")), step)  # one node a tree
    for level in reversed(levels[:-1]):
        tops = stored(found).select("tree", F.col("row.at").alias("block"), "left", "right", "subroot", "root")
        found = _down(level, tops, step)
    return found


def build(docs: DataFrame, fields: Sequence[str], group_col: str = "source", id_col: str = "doc_id", carry: Sequence[str] = (),
          step: int = STEP) -> Manifest:
    """The manifest of ``docs``: a leaf per row, the digest of its ``fields`` (see ``leaf_digest``).

    Leaves ascend by id, null ids last, and rows of one id by their digest, so
    repeated rows are neighbours. A null group is a group and comes first;
    groups are in order of their UTF-8 bytes. Null fields are values of their
    own, empty texts are not null, and texts may have any length. ``carry``
    names further columns, of orderable types, that proofs return. An empty
    table has no root. Other columns are not read.
    """
    free_names(docs.select(*carry), *_OWN)
    tree = F.coalesce(F.concat(F.lit("="), F.col(group_col).cast("string")), F.lit(""))  # the null group sorts before all others
    rows = docs.select(tree.alias("tree"), F.col(id_col).alias("_id"), leaf_digest(*[F.col(f) for f in fields]).alias("digest"),
                       *[F.col(c).alias(f"_c{i}") for i, c in enumerate(carry)])
    placed = keyed_row_number(rows, "tree", ["_id", "digest"], out="_rn").withColumn("at", F.col("_rn") - 1)
    row = F.struct("at", F.col("_id").alias(id_col), *[F.col(f"_c{i}").alias(c) for i, c in enumerate(carry)])
    groups = _levels(placed.select("tree", "at", "digest", row.alias("row")), step)
    tops = global_row_number(groups[-1].select("tree", "digest"), ["tree"], out="at")
    top = _levels(tops.select(F.lit("").alias("tree"), "at", "digest", F.struct("at", F.col("tree").alias("tree")).alias("row")), step)
    return Manifest(groups, top, step)


def proofs(manifest: Manifest) -> DataFrame:
    """One row per leaf: id and carried columns, leaf, left, right, subroot, root.

    left[i] and right[i] are the concatenated digests before and after the path
    in its run of level i, from the leaf up to the root; both are empty for a
    leaf that is the root. See ``fold``.
    """
    none = F.array().cast("array<string>")
    last = manifest.top[-1].select("tree", none.alias("left"), none.alias("right"), F.lit(None).cast("string").alias("subroot"), F.col("digest").alias("root"))
    upper = _proofs(manifest.top, last, manifest.step)
    above = upper.select(F.col("row.tree").alias("tree"), "left", "right", F.col("digest").alias("subroot"), "root")
    out = _proofs(manifest.groups, stored(above), manifest.step)
    names = [f.name for f in manifest.groups[0].schema["row"].dataType.fields if f.name != "at"]
    return out.select(*[F.col(f"row.{n}").alias(n) for n in names], F.col("digest").alias("leaf"), "left", "right", "subroot", "root")


def fold(leaf: Column) -> Column:
    """The root that ``leaf`` and the proof (left, right) lead to."""
    return F.aggregate(F.arrays_zip("left", "right"), leaf, lambda node, x: F.sha2(F.concat(x["left"], node, x["right"]), 256))


def proof_digest() -> Column:
    """SHA-256 of all siblings of the proof (left, right), level by level."""
    return F.sha2(F.array_join(F.zip_with("left", "right", lambda a, b: F.concat(a, b)), ""), 256)


def audit(docs: DataFrame, seen: Column, fields: Sequence[str], group_col: str = "source", id_col: str = "doc_id",
          step: int = STEP) -> DataFrame:
    """Prove a copy of ``docs`` against its manifest: (id_col, leaf, subroot, root, proof_sha256, folded_root, verified).

    ``seen`` is the leaf digest of the copy's row (``leaf_digest`` of its fields); verified says that it and the original siblings give
    the root. For nulls, repeated rows and empty input see ``build``.
    """
    manifest = build(docs.withColumn("_seen", seen), fields, group_col, id_col, ["_seen"], step)
    rows = proofs(manifest).withColumn("folded_root", fold(F.col("_seen")))
    return rows.select(id_col, "leaf", "subroot", "root", proof_digest().alias("proof_sha256"), "folded_root",
                       (F.col("folded_root") == F.col("root")).alias("verified"))
