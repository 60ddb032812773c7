"""Operator 12: a Merkle manifest of a dataset by checkpoint and recompute.

A row's leaf is the hash of its fields. The leaves of a language in order are a tree of runs of eight, whose root is the
language's subroot; the subroots in order are a tree of the same kind, whose root stands for the dataset. Of each tree only every
``STEPS``-th level is written. A node of a written level stands for an aligned subtree of up to ``8 ** STEPS`` nodes of the written level
below, so building, and later extracting proofs, takes one such group at a time: it recomputes the levels between from the stored
nodes, gives every stored node its siblings there, on top of the path of the subtree's own root, and drops them again.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .ranges import placed

RUN, STEPS = 8, 3
#: Nodes of a written level below one node of the next.
SPAN = RUN**STEPS
#: The fields of a leaf, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

_PATH = "array<struct<l:string,r:string>>"


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(fields: dict[str, Column]) -> Column:
    """The hash of fields, each with its length in bytes before it and ``-`` for null."""
    said = []
    for c in fields.values():
        text = c.cast("string")
        said.append(F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text)))
    return F.sha2(F.concat(*said), 256)


def levels_of(nodes: list[str], n: int) -> list[list[str]]:
    """The levels from ``nodes`` up to their subtree's root; ``n`` is the number of nodes of the whole level.

    A whole level rises until one node is left. A part of one rises ``STEPS`` levels, as the whole still has several nodes below that.
    """
    out = [nodes]
    while len(out[-1]) > 1 if n <= SPAN else len(out) <= STEPS:
        out.append([digest(*out[-1][i : i + RUN]) for i in range(0, len(out[-1]), RUN)])
    return out


def siblings(levels: list[list[str]], i: int) -> list[dict[str, str]]:
    """What stands left and right of node ``i`` and of its ancestors, level by level."""
    out = []
    for level in levels[:-1]:
        a = i // RUN * RUN
        out.append({"l": "".join(level[a:i]), "r": "".join(level[i + 1 : a + RUN])})
        i //= RUN
    return out


def _chunk() -> Column:
    return F.floor(F.col("pos") / SPAN).cast("long").alias("chunk")


def _rows(table: pa.Table) -> list[dict]:
    return sorted(table.to_pylist(), key=lambda r: r["pos"])


def _rise(table: pa.Table) -> pa.Table:
    """The node of one aligned subtree."""
    rows = _rows(table)
    n = rows[0]["n"]
    node = levels_of([r["node"] for r in rows], n)[-1][0]
    return pa.table({"tree": pa.array([rows[0]["tree"]], pa.int64()), "pos": pa.array([rows[0]["chunk"]], pa.int64()), "n": pa.array([-(-n // SPAN)], pa.int64()), "node": [node]})


def written_levels(level: DataFrame, most: int, scratch: Scratch) -> list[DataFrame]:
    """The written levels ``(tree, pos, n, node)`` of trees from the lowest up; ``most``: nodes of the largest tree's lowest level.

    ``n`` is the number of nodes of the row's whole level; a tree ends where it is 1.
    """
    out = [level]
    while most > 1:
        groups = out[-1].filter("n > 1").select("tree", "pos", "n", "node", _chunk()).groupBy("tree", "chunk")
        out.append(scratch.write(groups.applyInArrow(_rise, "tree long, pos long, n long, node string")))
        most = -(-most // SPAN)
    return out


@dataclass
class Manifest:
    """Leaves ``(doc_id, lang, leaf, other, tree, pos, n)`` and the written levels of the languages' trees and of the tree over them."""

    leaves: DataFrame
    levels: list[DataFrame]
    top: list[DataFrame]


def build(docs: DataFrame, scratch: Scratch, other: Column | None = None) -> Manifest:
    """The manifest of ``docs`` with the columns ``FIELDS``; ``other``: for each row a leaf to check instead of its own, or null.

    Rows of a language come by ``doc_id`` (null first) and leaf, so repeated rows stand side by side; null is a language. Languages
    come in the order of their UTF-8 bytes, null first. Further columns are ignored; no rows give an empty manifest.
    """
    rows = docs.select("doc_id", "lang", leaf({c: F.col(c) for c in FIELDS}).alias("leaf"), (F.lit(None).cast("string") if other is None else other).alias("other"))
    rows = placed(rows, "lang", ["doc_id", "leaf"], scratch)
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n")).withColumn("all", F.lit(0))
    langs = placed(sizes, "all", ["lang"], scratch).select(F.col("lang").alias("of"), "n", F.col("place").alias("tree"))
    most, trees = langs.agg(F.coalesce(F.max("n"), F.lit(0)), F.count("*")).first()
    leaves = rows.join(langs, F.col("lang").eqNullSafe(F.col("of"))).select("doc_id", "lang", "leaf", "other", "tree", F.col("place").alias("pos"), "n")
    levels = written_levels(leaves.select("tree", "pos", "n", F.col("leaf").alias("node")), most, scratch)
    roots = None
    for level in levels:
        part = level.filter("n = 1").select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("pos"), F.lit(trees).cast("long").alias("n"), "node")
        roots = part if roots is None else roots.unionByName(part)
    top = scratch.write(roots)
    return Manifest(leaves, levels, written_levels(top, trees, scratch))


def _down(left: pa.Table, right: pa.Table) -> pa.Table:
    """The paths of one subtree's nodes, from the path of its root."""
    rows, above = _rows(left), right.to_pylist()[0]
    levels = levels_of([r["node"] for r in rows], rows[0]["n"])
    path = [siblings(levels, i) + above["path"] for i in range(len(rows))]
    kind = pa.list_(pa.struct([("l", pa.string()), ("r", pa.string())]))
    own = {c: pa.array([r[c] for r in rows], pa.int64()) for c in ("tree", "pos")}
    return pa.table(own | {"node": [r["node"] for r in rows], "path": pa.array(path, kind), "subroot": pa.array([above["subroot"]] * len(rows), pa.string()), "root": pa.array([above["root"]] * len(rows), pa.string())})


def _proofs(whole: bool):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows, above = _rows(left), right.to_pylist()[0]
        levels, out = levels_of([r["node"] for r in rows], rows[0]["n"]), []
        for i, r in enumerate(rows):
            path = siblings(levels, i) + above["path"]
            folded = r["other"] or r["node"]
            for step in path:
                folded = digest(step["l"], folded, step["r"])
            proof = [path] if whole else []
            out.append((r["doc_id"], r["node"], above["subroot"], above["root"], digest(*(s["l"] + s["r"] for s in path)), folded, folded == above["root"], *proof))
        kinds = [pa.int64(), *[pa.string()] * 5, pa.bool_(), pa.list_(pa.struct([("l", pa.string()), ("r", pa.string())]))]
        names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified", "proof"]
        return pa.table({n: pa.array(c, k) for n, c, k in zip(names, zip(*out), kinds)})

    return run


def _ends(k: int) -> Column:
    """Whether a tree of ``n`` leaves ends at written level ``k``."""
    fits = F.col("n") <= SPAN**k
    return fits & (F.col("n") > SPAN ** (k - 1)) if k else fits


def _above(levels: list[DataFrame], starts: DataFrame, k: int) -> DataFrame:
    """The paths ``(of, part, path, subroot, root)`` of the subtrees of written level ``k``.

    ``starts`` has the path of every tree's root, ``n`` its leaves: it is used where the tree ends, as this tree has no higher level.
    """
    own = starts.filter(_ends(k)).select(F.col("tree").alias("of"), F.lit(0).cast("long").alias("part"), "path", "subroot", "root")
    if k + 1 == len(levels):
        return own
    higher = paths(levels, starts, k + 1)
    return own.unionByName(higher.select(F.col("tree").alias("of"), F.col("pos").alias("part"), "path", "subroot", "root"))


def paths(levels: list[DataFrame], starts: DataFrame, k: int = 0) -> DataFrame:
    """``(tree, pos, node, path, subroot, root)`` of all nodes of written level ``k``."""
    nodes = levels[k].select("tree", "pos", "n", "node", _chunk()).groupBy("tree", "chunk")
    above = _above(levels, starts, k).groupBy("of", "part")
    return nodes.cogroup(above).applyInArrow(_down, f"tree long, pos long, node string, path {_PATH}, subroot string, root string")


def proofs(manifest: Manifest, whole: bool = False) -> DataFrame:
    """``(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified)`` for every leaf, and ``proof`` itself if ``whole``.

    A proof has the siblings left and right of the leaf and of its ancestors, up to the subroot and from there to the root. ``folded_root`` is
    what they make of the leaf to check, ``verified`` whether it is the root.
    """
    trees = manifest.leaves.filter("pos = 0").select("tree", "n")
    root = manifest.top[-1].select("tree", F.col("node").alias("root"), F.lit(None).cast("string").alias("subroot"), F.from_json(F.lit("[]"), _PATH).alias("path"))
    size = manifest.top[0].groupBy("tree").agg(F.first("n").alias("n"))
    roots = paths(manifest.top, root.join(size, "tree"))
    starts = roots.select(F.col("pos").alias("tree"), "path", F.col("node").alias("subroot"), "root").join(trees, "tree")
    leaves = manifest.leaves.select("tree", "pos", "n", F.col("doc_id").cast("long").alias("doc_id"), F.col("leaf").alias("node"), "other", _chunk()).groupBy("tree", "chunk")
    above = _above(manifest.levels, starts, 0).groupBy("of", "part")
    kinds = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return leaves.cogroup(above).applyInArrow(_proofs(whole), kinds + (f", proof {_PATH}" if whole else ""))


def lower_cased_third() -> Column:
    """The leaf of a row whose text's A-Z are lower case, where 3 divides the CRC-32 of its decimal id; else null."""
    fields = {c: F.col(c) for c in FIELDS}
    fields["text"] = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, leaf(fields))
