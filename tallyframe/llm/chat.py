"""Operator 9: chat formatting on a prefix tree.

A conversation is a path of turns; conversations that begin with the same turns share the nodes of a tree. The
tokens of a node are emitted once, depth first, in packed sequences. Each token has its position on its own path, and
each node the intervals of its ancestors' tokens, which together with its own earlier tokens it attends to.

A node is named by a digest of all turns down to it. Equal conversations are one path. Paths are dealt to sequences of
about ``paths`` paths: below the deepest node that more paths share (or above all first turns) its children are
binned by hash. A first turn that very many conversations share is so split over many tasks, each of which repeats
only the nodes above its bin.

The template marks turns as ``<|role|>role<|text|>text<|end|>``. Inside roles and texts a backslash is doubled and every
control string (``<|``, ``<s>``, ``</s>``, ``[INST]``, ``[/INST]``) gets a backslash after its first character, which is undone
by dropping the backslash before any character. The loss mask covers the texts of assistant turns.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NO_ID, Scratch
from .pretokens import byte_pieces, pre_tokens
from .words import utf8

_CONTROL = re.compile(r"\\|<\||</?s>|\[/?INST\]")
_ESCAPED = re.compile(r"\\(.)", re.S)
_TURN = re.compile(r"<\|role\|>(.*?)<\|text\|>(.*?)<\|end\|>", re.S)
#: The role whose texts are learnt.
LEARNT = "assistant"


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: f"{m[0][0]}\\{m[0][1:]}", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def segments(role: str, text: str) -> tuple[str, str, str]:
    """What stands before, as and after a turn's text."""
    return f"<|role|>{escape(role)}<|text|>", escape(text), "<|end|>"


def parse(formatted: str) -> list[tuple[str, str]]:
    return [(unescape(m[1]), unescape(m[2])) for m in _TURN.finditer(formatted)]


def _digests(turns: pa.Array) -> pa.Array:
    """The node of every turn: a digest of the turns down to it."""
    out = []
    for conversation in turns.to_pylist():
        above, nodes = b"", []
        for turn in conversation:
            h = hashlib.blake2b(above, digest_size=16)
            for part in (turn["role"], turn["text"]):
                raw = part.encode()
                h.update(len(raw).to_bytes(8, "little") + raw)
            above = h.digest()
            nodes.append(above.hex())
        out.append(nodes)
    return pa.array(out, pa.list_(pa.string()))


_PACK = (
    "pack string, tokens array<int>, positions array<int>, loss array<boolean>, leaves array<string>, "
    "nodes array<struct<node:string,start:int,end:int,first_position:int,attends:array<struct<s:int,e:int>>>>"
)


def _emit(path: str):
    """One sequence: nodes of all paths depth first, each once."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = sorted(zip(map(tuple, pdf["nodes"]), pdf["turns"]), key=lambda r: r[0])
        order, parent, parts, loss = {}, {}, [], []
        for nodes, turns in rows:
            above = None
            for node, turn in zip(nodes, turns):
                if node not in order:
                    order[node], parent[node] = len(order), above
                    parts += segments(turn["role"], turn["text"])
                    loss.append(turn["role"] == LEARNT)
                above = node
        flat, count = pre_tokens(path).encode(*utf8(pa.array(parts, pa.large_string())))
        size = count.reshape(-1, 3)
        end = np.cumsum(size.sum(1))
        start = end - size.sum(1)
        mask, position, found = np.zeros(len(flat), bool), np.zeros(len(flat), np.int32), []
        attends, last = {}, {}
        for node, i in order.items():
            above = parent[node]
            a, b = int(start[i]), int(end[i])
            first = last[above] if above else 0
            attends[node] = [*attends[above], (int(start[order[above]]), int(end[order[above]]))] if above else []
            if len(attends[node]) > 1 and attends[node][-2][1] == attends[node][-1][0]:
                attends[node] = [*attends[node][:-2], (attends[node][-2][0], attends[node][-1][1])]
            last[node] = first + b - a
            position[a:b] = np.arange(first, first + b - a)
            mask[a + size[i, 0] : b - size[i, 2]] = loss[i]
            found.append({"node": node, "start": a, "end": b, "first_position": first, "attends": [{"s": s, "e": e} for s, e in attends[node]]})
        return pd.DataFrame({"pack": [pdf["pack"].iloc[0]], "tokens": [flat.astype(np.int32)], "positions": [position], "loss": [mask], "leaves": [[r[0][-1] for r in rows]], "nodes": [found]})

    return run


def _read(path: str):
    """What every path of a sequence says, from the sequence alone."""

    def run(batches):
        pieces = byte_pieces(path)
        text = lambda x: x.tobytes().decode("utf-8", "replace")
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                row = {n: batch.column(j)[i] for j, n in enumerate(batch.schema.names)}
                tokens, loss = (np.asarray(row[n].values.to_numpy(zero_copy_only=False)) for n in ("tokens", "loss"))
                nodes = sorted(row["nodes"].as_py(), key=lambda n: n["start"])
                # a node's tokens are decoded once; what a path says are its nodes' texts one after the other
                raw, edge = pieces.gather(tokens)
                masked, spans = np.repeat(loss, np.diff(edge)), [(n["start"], n["end"]) for n in nodes]
                said = [text(raw[edge[a] : edge[b]]) for a, b in spans]
                learnt = [text(raw[edge[a] : edge[b]][masked[edge[a] : edge[b]]]) for a, b in spans]
                starts, named = [a for a, _ in spans], {n["node"]: n for n in nodes}
                for leaf in row["leaves"].as_py():
                    node, on_path = named[leaf], []
                    for s in [*node["attends"], {"s": node["start"], "e": node["end"]}]:
                        on_path += range(bisect_left(starts, s["s"]), bisect_left(starts, s["e"]))
                    formatted, loss_text = "".join(said[k] for k in on_path), unescape("".join(learnt[k] for k in on_path))
                    turns = parse(formatted)
                    out.append((leaf, len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss_text), sha(loss_text), len(formatted)))
            if out:
                kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
                names = ["leaf", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

    return run


def chat_tree(rows: DataFrame, path: str, paths: int = 256) -> tuple[DataFrame, DataFrame]:
    """Sequences ``(pack, tokens, positions, loss, nodes, leaves)`` and ``(conv_id, leaf)``, each conversation's last node.

    ``rows`` has ``conv_id, turn, role, text``; a conversation's rows are ordered by turn, ties by role and text, and repeated
    rows are turns of their own. Null roles and texts are empty, rows of null ``conv_id`` form one conversation and a null
    turn comes first. Other columns are ignored; empty input gives empty tables. ``path`` is the tokenizer's file.
    """
    scratch = Scratch(rows.sparkSession)
    rows = rows.select(F.coalesce(F.col("conv_id").cast("long"), F.lit(NO_ID)).alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    whole = scratch.write(whole.withColumn("nodes", F.arrow_udf(_digests, "array<string>")("turns")).withColumn("leaf", F.element_at("nodes", -1)), narrow=False)
    reps = whole.groupBy("leaf").agg(F.min("conv_id").alias("conv_id"))
    distinct = whole.join(reps.select("conv_id"), "conv_id", "left_semi")
    total = reps.count()
    steps = distinct.select("leaf", F.posexplode("nodes").alias("depth", "node"))
    hot = scratch.write(steps.groupBy("node").agg(F.count("*").alias("paths")).filter(F.col("paths") > paths))
    deepest = steps.join(hot, "node").groupBy("leaf").agg(F.max(F.struct("depth", "node", "paths")).alias("hot"))
    bins = lambda n: F.greatest(F.lit(1), F.ceil(n / paths))
    child = F.coalesce(F.try_element_at("nodes", F.coalesce("hot.depth", F.lit(-1)) + 2), "leaf")
    name = F.concat_ws(":", F.coalesce("hot.node", F.lit("")), F.pmod(F.xxhash64(child), bins(F.coalesce("hot.paths", F.lit(total)))))
    dealt = distinct.join(deepest, "leaf", "left").select(name.alias("pack"), "nodes", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))
    packs = scratch.write(dealt.groupBy("pack").applyInPandas(_emit(path), _PACK), narrow=False, large_rows=True)
    scratch.keep(packs, whole)
    return packs, whole.select("conv_id", "leaf")


def chat_digest(rows: DataFrame, path: str) -> DataFrame:
    """What each conversation says, read back from the packed sequences."""
    packs, convs = chat_tree(rows, path)
    read = packs.select("tokens", "loss", "leaves", "nodes").mapInArrow(_read(path), "leaf string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    out = convs.join(read.hint("merge"), "leaf").drop("leaf")
    return out.withColumn("conv_id", F.when(F.col("conv_id") != NO_ID, F.col("conv_id")))
