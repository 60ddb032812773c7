"""Operator 11: the prefix trie of all conversations, with totals of every subtree by time-forward processing.

A turn is an invertible affine map modulo a prime, made from a digest of its role and text; a node is what the turns down to it make of
a fixed start. Maps can be joined, so a conversation may lie in several ranges, and a conversation whose first turns are
replaced takes the nodes of those and goes on from there: no text moves after its digest is taken.

Totals are passed up within shards. A node's weight is the number of turns in its subtree before equal ones are merged. Subtrees below the cap
are dealt whole to shards; in each, nodes sorted by reverse level order take the messages addressed to them from a priority queue
that spills, and send theirs to their parents. Roots of these subtrees send theirs to the heavy nodes above, of which a level has at most as many as
caps go into all turns. Heavy nodes are shards of ``BAND`` levels. If there are several, a band's roots are contracted to a tree
of their own, with a level for each band, which is solved in the same way, and what it yields goes into the bands' second pass.
"""

from __future__ import annotations

import hashlib
import heapq
import pickle
import tempfile
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import Scratch
from .ranges import WALKED, Groups, in_ranges, offsets, summaries

PRIME = 2**127 - 1
START = 1
#: Least weight of a heavy node, and parts of all turns for each shuffle partition that are a subtree's most.
LEAST_CAP, PARTS = 256, 4
#: Levels of a shard of heavy nodes.
BAND = 64
#: Messages that a queue holds in memory.
HELD = 200_000


# Affine maps x -> a * x + b modulo PRIME, as pairs and as 32 bytes.
def _joined(first: tuple[int, int], then: tuple[int, int]) -> tuple[int, int]:
    return then[0] * first[0] % PRIME, (then[0] * first[1] + then[1]) % PRIME


def _undone(f: tuple[int, int], x: int) -> int:
    return (x - f[1]) * pow(f[0], -1, PRIME) % PRIME


def _bytes(f: tuple[int, int]) -> bytes:
    return f[0].to_bytes(16, "big") + f[1].to_bytes(16, "big")


def _pair(raw: bytes) -> tuple[int, int]:
    return int.from_bytes(raw[:16], "big"), int.from_bytes(raw[16:], "big")


def _of_digest(raw: bytes) -> tuple[int, int]:
    return 1 + int.from_bytes(raw[:16], "big") % (PRIME - 1), int.from_bytes(raw[16:], "big") % PRIME


def _at(raw: bytes, x: int) -> int:
    a, b = _pair(raw)
    return (a * x + b) % PRIME


_ONE = _bytes((1, 0))
_TURN = "conv_id long, chars long, before binary, upto binary"


def _maps(batches):
    """The joined maps of a range's conversations before and up to each turn, from the conversation's first turn in this range on."""
    groups, f = Groups(), (1, 0)
    for batch in batches:
        if not batch.num_rows:
            continue
        segment, place = groups.walk(batch.column(0))
        before, upto = [], []
        for i, raw in zip(place.tolist(), batch.column(3).to_pylist()):
            f = f if i else (1, 0)
            before.append(_bytes(f))
            f = _joined(f, _of_digest(raw))
            upto.append(_bytes(f))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(4), pa.array(before, pa.binary()), pa.array(upto, pa.binary()), *groups.columns(segment, place)], names=["conv_id", "chars", "before", "upto", *WALKED.names])


def turn_maps(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """``(conv_id, place, chars, before, upto)``: every turn's place in its conversation, and the joined maps before and up to it.

    ``rows`` has ``conv_id, turn, role, text``. Turns come by ``turn`` (null first), then role, then the digest of both; null roles and texts are empty;
    rows of a null ``conv_id`` belong to no conversation. Repeated rows are turns of their own.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    key = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)).alias("key")
    narrow = rows.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), key, F.char_length(text).cast("long").alias("chars")).filter("conv_id is not null")
    schema = StructType([*StructType.fromDDL(_TURN).fields, *WALKED.fields])
    walked = scratch.write(in_ranges(narrow, "conv_id", ["turn", "role", "key"]).mapInArrow(_maps, schema), narrow=False)
    parts = summaries(walked, "conv_id", F.col("upto"))
    before, carried, group, f = offsets(parts), [], None, (1, 0)
    for r in parts:
        held = r["_range"] in before
        if held:
            carried.append((r["_range"], before[r["_range"]], bytearray(_bytes(f))))
        f = _joined(f, _pair(r["value"])) if held and r["segments"] == 0 else _pair(r["value"])
    columns = ("conv_id", "place", "chars", "before", "upto")
    if not carried:
        return walked.select(*columns)
    table = F.broadcast(walked.sparkSession.createDataFrame(carried, "_range int, _more long, _carry binary"))
    join = F.arrow_udf(lambda carry, own: pa.array([x if c is None else _bytes(_joined(_pair(c), _pair(x))) for c, x in zip(carry.to_pylist(), own.to_pylist())], pa.binary()), "binary")
    first = F.col("_segment") == 0
    carry = F.when(first, F.col("_carry"))
    out = walked.join(table, "_range", "left")
    return out.withColumns({"place": F.col("place") + F.when(first, F.coalesce("_more", F.lit(0))).otherwise(0), "before": join(carry, F.col("before")), "upto": join(carry, F.col("upto"))}).select(*columns)


def _heads(batches):
    """Each conversation's first nodes, which its other one gives, and where its own turns go on from."""
    for batch in batches:
        out = []
        for conv, n, h, heads, cut in zip(*(c.to_pylist() for c in batch.columns)):
            heads = sorted(heads or [], key=lambda t: t["place"])[:h]
            x, steps = START, [(0, START, None, 0)]
            for d, t in enumerate(heads, 1):
                above, x = x, _at(t["upto"], START)
                steps.append((d, x, above, t["chars"]))
            own = max(n - h, 0)
            y = _undone(_pair(cut), x) if own and h else x
            told = [{"depth": d, "node": v.to_bytes(16, "big"), "parent": None if p is None else p.to_bytes(16, "big"), "chars": c} for d, v, p, c in steps]
            out.append((conv, h, len(heads), len(heads) + own, y.to_bytes(16, "big"), told))
        if out:
            step = pa.struct([("depth", pa.int64()), ("node", pa.binary()), ("parent", pa.binary()), ("chars", pa.int64())])
            kinds = [pa.int64()] * 4 + [pa.binary(), pa.list_(step)]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["conv_id", "h", "k", "size", "y", "steps"])


def _tails(batches):
    """The nodes of a conversation's own turns."""
    for batch in batches:
        conv, depth, chars, before, upto, y, size = batch.columns
        at = lambda maps: pa.array([_at(f, int.from_bytes(x, "big")).to_bytes(16, "big") for f, x in zip(maps.to_pylist(), y.to_pylist())], pa.binary())
        yield pa.RecordBatch.from_arrays([conv, depth, at(upto), at(before), chars, size], names=["conv_id", "depth", "node", "parent", "chars", "size"])


_STEP = "conv_id long, depth long, node binary, parent binary, chars long, size long"


def steps_of(turns: DataFrame, base: Column, keep: Column, scratch: Scratch) -> DataFrame:
    """``(conv_id, depth, node, parent, chars, size)``: all nodes of every rebuilt conversation from the root down; ``size`` is its number of turns.

    A conversation takes the first ``keep`` turns of conversation ``base`` (fewer if that has fewer, none if there is none) in place of
    its own first ``keep``; both are columns over ``conv_id``. ``keep`` is small and ``base`` may be the same for many.
    """
    convs = scratch.write(turns.groupBy("conv_id").agg(F.count("*").alias("n")).select("conv_id", "n", base.cast("long").alias("base"), keep.cast("long").alias("h")))
    most = convs.groupBy(F.col("base").alias("conv_id")).agg(F.max("h").alias("most")).filter("most > 0")
    heads = turns.join(most, "conv_id").filter("place < most").groupBy(F.col("conv_id").alias("base")).agg(F.collect_list(F.struct("place", "upto", "chars")).alias("heads"))
    cut = turns.join(convs.select("conv_id", "h"), "conv_id").filter("place = h - 1").select("conv_id", F.col("upto").alias("cut"))
    whole = convs.join(heads, "base", "left").join(cut, "conv_id", "left").select("conv_id", "n", "h", "heads", "cut")
    step = "struct<depth:long,node:binary,parent:binary,chars:long>"
    known = scratch.write(whole.mapInArrow(_heads, f"conv_id long, h long, k long, size long, y binary, steps array<{step}>"), narrow=False)
    first = known.select("conv_id", "size", F.explode("steps").alias("s")).select("conv_id", "s.depth", "s.node", "s.parent", "s.chars", "size")
    own = turns.join(known.filter("size > k").select("conv_id", "h", "k", "y", "size"), "conv_id").filter("place >= h")
    own = own.select("conv_id", (F.col("place") - F.col("h") + F.col("k") + 1).alias("depth"), "chars", "before", "upto", "y", "size").mapInArrow(_tails, _STEP)
    return scratch.write(first.unionByName(own), narrow=False)


class SpillingQueue:
    """A priority queue of tuples; beyond ``held`` of them it writes them as a sorted run to a file that ends with the task."""

    def __init__(self, held: int = HELD):
        self.held, self.heap, self.runs = held, [], []

    def push(self, item: tuple) -> None:
        heapq.heappush(self.heap, item)
        if len(self.heap) >= self.held:
            run = tempfile.TemporaryFile()
            self.heap.sort()
            for i in range(0, len(self.heap), 4096):
                pickle.dump(self.heap[i : i + 4096], run)
            run.seek(0)
            self.heap = []
            items = self._read(run)
            heapq.heappush(self.runs, (next(items), len(self.runs), items))

    @staticmethod
    def _read(run):
        with run:
            while True:
                try:
                    yield from pickle.load(run)
                except EOFError:
                    return

    def take(self, key: tuple):
        """Removes and yields the items that begin with ``key``; smaller ones must have been taken before."""
        n = len(key)
        while True:
            if self.runs and (not self.heap or self.runs[0][0] < self.heap[0]):
                if self.runs[0][0][:n] != key:
                    return
                item, number, items = self.runs[0]
                after = next(items, None)
                if after is None:
                    heapq.heappop(self.runs)
                else:
                    heapq.heapreplace(self.runs, (after, number, items))
                yield item
            elif self.heap and self.heap[0][:n] == key:
                yield heapq.heappop(self.heap)
            else:
                return

    def __bool__(self) -> bool:
        return bool(self.heap or self.runs)


_NODE = ("conv_id", "depth", "node", "parent", "n_convs", "children", "leaves", "saved")
_NODES = "conv_id long, depth long, node binary, parent binary, n_convs long, children long, leaves long, saved long"


def _forward(held: int):
    """One shard: nodes by falling depth, each with its own totals and whether it is a root of the shard, become nodes with their subtrees' totals."""

    def run(batches):
        queue = SpillingQueue(held)
        for batch in batches:
            out = []
            for *known, is_root in zip(*(c.to_pylist() for c in batch.columns)):
                conv, depth, node, parent, n, children, leaves, saved = known
                for message in queue.take((-depth, node)):
                    children, leaves, saved = children + 1, leaves + message[2], saved + message[3]
                if not is_root:
                    queue.push((1 - depth, parent, leaves, saved))
                out.append((conv, depth, node, parent, n, children, leaves, saved))
            if out:
                kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), *[pa.int64()] * 4]
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=list(_NODE))
        if queue:
            raise ValueError("a shard has a node whose parent it hasn't")

    return run


def forward(nodes: DataFrame, shard: str, is_root: Column, held: int = HELD) -> DataFrame:
    """``nodes`` with totals over the part of their subtree that lies in their shard."""
    dealt = nodes.withColumn("is_root", is_root).repartition(shard).sortWithinPartitions(F.desc("depth"), "node")
    return dealt.select(*_NODE, "is_root").mapInArrow(_forward(held), _NODES)


def _received(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """``nodes`` with the totals of ``roots``, which hang directly below them, added to their own."""
    sums = roots.filter("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("c"), F.sum("leaves").alias("l"), F.sum("saved").alias("s"))
    plus = lambda a, b: (F.col(a) + F.coalesce(b, F.lit(0))).alias(a)
    return nodes.join(sums, "node", "left").select("conv_id", "depth", "node", "parent", "n_convs", plus("children", "c"), plus("leaves", "l"), plus("saved", "s"))


def banded(nodes: DataFrame, ancestors: DataFrame, scratch: Scratch, band: int, held: int = HELD) -> DataFrame:
    """Whole totals of a tree's ``nodes``, in shards of ``band`` levels and then across the shards' roots.

    ``ancestors`` ``(conv_id, depth, node)`` has all nodes of the conversation that names a node. Each round divides the depth by ``band``.
    """
    nodes = nodes.withColumn("band", F.floor(F.col("depth") / band).cast("long"))
    top = F.col("depth") % band == 0
    if (nodes.agg(F.max("depth")).first()[0] or 0) < band:
        return scratch.write(forward(nodes, "band", top, held))
    local = scratch.write(forward(nodes, "band", top, held).filter(F.col("depth") % band == 0))
    higher = scratch.write(ancestors.filter(F.col("depth") % band == 0).withColumn("depth", (F.col("depth") / band).cast("long")))
    over = higher.select("conv_id", (F.col("depth") + 1).alias("depth"), F.col("node").alias("parent"))
    contracted = local.withColumn("depth", (F.col("depth") / band).cast("long")).drop("parent").join(over, ["conv_id", "depth"], "left").select(*_NODE)
    whole = banded(scratch.write(contracted), higher, scratch, band, held)
    parents = local.select("node", "parent").join(whole.select("node", "leaves", "saved"), "node")
    return scratch.write(forward(_received(nodes.select(*_NODE), parents).withColumn("band", F.floor(F.col("depth") / band).cast("long")), "band", top, held))


@dataclass
class Trie:
    """Nodes ``(conv_id, depth, node, parent, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens)`` and ``ends (node, conv_id)``."""

    nodes: DataFrame
    ends: DataFrame


def trie(rows: DataFrame, base: Column, keep: Column, cap: int | None = None, band: int = BAND, held: int = HELD) -> Trie:
    """The prefix trie of the rebuilt conversations of ``rows`` (see ``turn_maps`` and ``steps_of``).

    ``conv_id`` is a node's smallest member, and ``saved_tokens`` counts, over the subtree, code points of last turns once for each member but one. ``ends``
    has the conversations that end at a node, those without turns at the root. No rows give no nodes. ``cap`` only decides how nodes are dealt
    to shards.
    """
    scratch = Scratch(rows.sparkSession)
    steps = steps_of(turn_maps(rows, scratch), base, keep, scratch)
    ends = F.col("depth") == F.col("size")
    found = steps.groupBy("node").agg(
        F.min("conv_id").alias("conv_id"),
        F.min("depth").alias("depth"),
        F.min("parent").alias("parent"),
        F.count("*").alias("n_convs"),
        F.min("chars").alias("chars"),
        F.count(F.when(ends, 1)).alias("n_ends"),
        F.sum(F.col("size") - F.col("depth") + 1).alias("weight"),
    )
    own = [F.lit(0).cast("long").alias("children"), F.when(F.col("n_ends") == F.col("n_convs"), 1).otherwise(0).cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saved")]
    nodes = scratch.write(found.select("conv_id", "depth", "node", "parent", "n_convs", *own, "weight"), narrow=False)
    if cap is None:
        total = nodes.filter("depth = 0").agg(F.max("weight")).first()[0] or 0
        cap = max(LEAST_CAP, total // (PARTS * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    is_heavy = (F.col("depth") == 0) | (F.col("weight") > cap)
    heavy = scratch.write(nodes.filter(is_heavy))
    paths = steps.filter("depth > 0").select("conv_id", "depth", "node")
    named = heavy.filter("depth > 0").select(F.col("node").alias("heavy"))
    reach = scratch.write(paths.join(named, F.col("node") == F.col("heavy"), "left_semi").groupBy("conv_id").agg(F.max("depth").alias("reach")))
    tops = paths.join(reach, "conv_id", "left").filter("depth = coalesce(reach, 0) + 1").select("conv_id", F.col("node").alias("top"))
    light = nodes.filter(~is_heavy).join(tops, "conv_id")
    light = scratch.write(forward(light, "top", F.col("node") == F.col("top"), held), narrow=False)
    above = heavy.select(F.col("node").alias("parent"))
    received = scratch.write(_received(heavy.select(*_NODE), light.join(above, "parent", "left_semi")))
    # what bands need of the paths of conversations that name heavy nodes
    ancestors = steps.select("conv_id", "depth", "node").join(heavy.select("conv_id").distinct(), "conv_id", "left_semi")
    upper = banded(received, ancestors, scratch, band, held)
    scratch.keep(steps, light, upper)
    whole = light.unionByName(upper)
    over = whole.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    named = whole.join(over, "parent", "left").select("conv_id", "depth", "node", "parent", "parent_conv_id", "n_convs", F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"))
    return Trie(named, steps.filter(ends).select("node", "conv_id"))


def _lists(batches):
    """Blocks of a range's ids, comma-joined for each node."""
    for batch in batches:
        lists: dict[bytes, list[int]] = {}
        for node, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            lists.setdefault(node, []).append(conv)
        if lists:
            yield pa.record_batch([pa.array(list(lists), pa.binary()), pa.array([x[0] for x in lists.values()], pa.int64()), pa.array([",".join(map(str, x)) for x in lists.values()])], names=["node", "first", "ids"])


def _hashed(batches):
    """The hash of each node's blocks one after the other."""
    node, h, names = None, None, ["node", "ends_sha256"]
    for batch in batches:
        out = []
        for own, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
            if own == node:
                h.update(b",")
            else:
                if node is not None:
                    out.append((node, h.hexdigest()))
                node, h = own, hashlib.sha256()
            h.update(ids.encode())
        if out:
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out), (pa.binary(), pa.string()))], names=names)
    if node is not None:
        yield pa.record_batch([pa.array([node], pa.binary()), pa.array([h.hexdigest()])], names=names)


def ends_digest(ends: DataFrame) -> DataFrame:
    """``(node, ends_sha256)``: the SHA-256 of the decimal ids of conversations that end at a node, ascending and comma-joined.

    Ids are joined to blocks over ranges of ids first; a task then reads a node's blocks in order and holds one at a time. A hash of one
    text can't be split, so a node where very many end has its blocks, not its rows, in one task.
    """
    blocks = ends.repartitionByRange("conv_id").sortWithinPartitions("conv_id").mapInArrow(_lists, "node binary, first long, ids string")
    return blocks.repartition("node").sortWithinPartitions("node", "first").mapInArrow(_hashed, "node binary, ends_sha256 string")


def trie_digest(rows: DataFrame, **options) -> DataFrame:
    """The trie of conversations that share the turns of a hundred's first one: ``h`` turns, by the CRC-32 of the decimal id modulo 6."""
    keep = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6
    found = trie(rows, F.col("conv_id") - F.col("conv_id") % 100, keep, **options)
    out = found.nodes.join(ends_digest(found.ends), "node", "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))
