"""Operator 3: embedding near-duplicates on a robust-pruned flat graph.

1. Equal vectors of one label are one class. A label is a cell; cells of more than twice ``shard`` classes are divided by centroids,
   each cell's fitted in its own task on a bounded sample, level by level, until none is left (``_cells``).
2. Every class goes to the shards of its nearest cell and of the second nearest one at the last division, so shards overlap; what
   would fill a shard beyond ``cap`` stays out of it and is compared as under 4. Only a cell that centroids can't divide (vectors
   of one direction and many lengths) is dealt into parts at random.
3. Each part builds a graph: nearest neighbours are robustly pruned (an edge goes if a kept neighbour is closer to its
   end by the factor ``ALPHA``), random long edges and reverse edges are added, and every node is made reachable
   from the medoid. A class's adjacency lists of all its parts are united.
4. Every class is searched in every part of its shards: a greedy beam search from the medoid over the united lists, then
   range expansion, in which the neighbours of every vector in range are visited until no new one is found. Each pair
   is counted in one shard only, and kept if its cosine in double precision reaches the threshold.
   Two classes that share neither shard are compared exactly, in blocks (``_across``): a block is the largest cell of at most ``block``
   classes with its neighbours up to about as many, and a class goes to every block with a cell that the threshold's angle round it may reach, so no pair is lost between shards.
5. In each part the classes whose id is divisible by 20 are also searched exhaustively. If that audit finds a
   recall below ``RECALL``, the whole part is compared in blocks instead.

Only counts and, for each class, the smallest class of its component within the part leave a part, never all pairs of a group.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, components

DEGREE, CANDIDATES, RANDOM_EDGES, ALPHA, BEAM, RECALL = 24, 64, 4, 1.2, 24, 0.98
#: Rows of the sample that a cell's centroids are fitted on, centroids of a cell at most, and classes for each centroid.
SAMPLE_ROWS, FAN, SHARD = 8_192, 64, 400
#: Rows of a cell that one task takes to its children.
SLICE = 8_192
#: How a class belongs to a cell: as its own, as the second nearest, or only within reach of the threshold's angle.
HOME, NEAR, ASK = 0, 1, 2
#: Classes of a block, within which classes of different shards are compared.
BLOCK = 32_768


def _unit(rows) -> np.ndarray:
    x = np.array([np.asarray(r, np.float64) for r in rows]).reshape(len(rows), -1)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _centroids(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means from a seeded start."""
    rng = np.random.default_rng(5)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        near = (x @ c.T).argmax(1)
        for j in range(len(c)):
            s = x[near == j].sum(0)
            if (size := np.linalg.norm(s)) > 0:
                c[j] = s / size
    return c


def robust_graph(x: np.ndarray, seed: int = 0) -> list[np.ndarray]:
    """Adjacency lists of one part; ``x`` has unit rows."""
    n = len(x)
    rng = np.random.default_rng(seed)
    sims = x @ x.T
    np.fill_diagonal(sims, -2)
    m = min(CANDIDATES, n - 1)
    if not m:
        return [np.empty(0, np.int64)] * n
    near = np.argpartition(-sims, m - 1, axis=1)[:, :m]
    near = np.take_along_axis(near, np.argsort(-np.take_along_axis(sims, near, 1), axis=1, kind="stable"), 1)
    far = lambda s: np.sqrt(np.maximum(2 - 2 * s, 0))
    own, alive, every = far(np.take_along_axis(sims, near, 1)), np.ones((n, m), bool), np.arange(n)
    kept = np.zeros((n, m), bool)
    for _ in range(min(DEGREE, m)):
        some = alive.any(1)
        if not some.any():
            break
        rows, first = every[some], alive[some].argmax(1)
        kept[rows, first] = True
        pruned = ALPHA * far(sims[near[rows, first][:, None], near[rows]]) <= own[rows]
        pruned[np.arange(len(rows)), first] = True
        alive[rows] &= ~pruned
    a, j = np.nonzero(kept)
    b = near[a, j]
    ra, rb = np.repeat(every, RANDOM_EDGES), rng.integers(0, n, n * RANDOM_EDGES)
    a, b = np.concatenate([a, b, ra, rb]), np.concatenate([b, a, rb, ra])
    link = np.zeros((n, n), bool)
    link[a, b] = True
    np.fill_diagonal(link, False)
    seen = np.zeros(n, bool)
    front = np.zeros(n, bool)
    front[medoid(x)] = True
    while True:
        while front.any():
            seen |= front
            front = link[front].any(0) & ~seen
        if seen.all():
            break
        lost = int(np.flatnonzero(~seen)[0])
        to = int(np.where(seen, sims[lost], -3).argmax())
        link[to, lost] = link[lost, to] = True
        front[lost] = True
    return [np.flatnonzero(r) for r in link]


def medoid(x: np.ndarray) -> int:
    return int((x @ x.mean(0)).argmax())


def range_search(x: np.ndarray, lists: list[np.ndarray], queries: np.ndarray, least: float) -> np.ndarray:
    """Which rows of ``x`` each query finds at ``least`` or above: greedy from the medoid, then expansion."""
    n, q = len(x), len(queries)
    width = max(1, max(map(len, lists)))
    table = np.full((n, width), -1)
    for i, v in enumerate(lists):
        table[i, : len(v)] = v
    link = np.zeros((n, n), np.float32)
    link[np.repeat(np.arange(n), [len(v) for v in lists]), np.concatenate(lists) if n else []] = 1
    sims = np.full((q, n), -2.0)
    done = np.zeros((q, n), bool)
    start = medoid(x)
    sims[:, start] = queries @ x[start]
    active = np.arange(q)
    beam = min(BEAM, n)
    while len(active):
        here = sims[active]
        best = np.argpartition(-here, beam - 1, axis=1)[:, :beam]
        score = np.where(np.take_along_axis(done[active], best, 1), -2.0, np.take_along_axis(here, best, 1))
        pick = score.argmax(1)
        go = score[np.arange(len(active)), pick] > -2
        active, node = active[go], best[np.arange(len(best)), pick][go]
        done[active, node] = True
        to = table[node]
        row, col = np.nonzero(to >= 0)
        at, to = active[row], to[row, col]
        new = sims[at, to] == -2
        at, to = at[new], to[new]
        sims[at, to] = np.einsum("ij,ij->i", queries[at], x[to])
    while True:
        front = (sims >= least) & ~done
        rows = np.flatnonzero(front.any(1))
        if not len(rows):
            return sims >= least
        done[rows] |= front[rows]
        cols = np.flatnonzero(front[rows].any(0))
        reach = front[np.ix_(rows, cols)].astype(np.float32) @ link[cols] > 0
        row, to = np.nonzero(reach & (sims[rows] == -2))
        at = rows[row]
        for lo in range(0, len(at), 200_000):
            a, b = at[lo : lo + 200_000], to[lo : lo + 200_000]
            sims[a, b] = np.einsum("ij,ij->i", queries[a], x[b])


def _build(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("cid", ignore_index=True)
    lists = robust_graph(_unit(pdf["vector"]), int(pdf["part"].iloc[0]))
    ids = pdf["cid"].to_numpy()
    return pd.DataFrame({"cid": ids, "shard": pdf["shard"], "part": pdf["part"], "near": [ids[v] for v in lists]})


def _merge(low: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest node of each node's component after the edges ``a``-``b`` join ``low``."""
    while ((la := low[a]) != (lb := low[b])).any():
        least = np.minimum(la, lb)
        np.minimum.at(low, la, least)
        np.minimum.at(low, lb, least)
        while ((lower := low[low]) != low).any():
            low = lower
    return low


def _across(least: float):
    """Pairs of a block and the classes asked of it that share no shard, each in both directions."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        base, asked = (pdf[pdf["indexed"] == i].sort_values("cid", ignore_index=True) for i in (True, False))
        if base.empty or asked.empty:
            return pd.DataFrame({c: np.empty(0, np.int64) for c in ("cid", "low", "links", "audited", "missed")})
        x, y = _unit(base["vector"]), _unit(asked["vector"])
        small, slack = x.astype(np.float32), 1e-6 + 2e-7 * x.shape[1]
        ids = np.unique(np.concatenate([base["cid"], asked["cid"]]))
        at, to = np.searchsorted(ids, base["cid"]), np.searchsorted(ids, asked["cid"])
        pairs = [np.array([[h[0], h[-1]] for h in side["shards"]]) for side in (base, asked)]
        weights, inside = [side["size"].to_numpy() for side in (base, asked)], bool(pdf["block"].iloc[0] == pdf["ask_block"].iloc[0])
        low, links = np.arange(len(ids)), np.zeros(len(ids), np.int64)
        for lo in range(0, len(y), 128):
            rows, cols = np.nonzero(y[lo : lo + 128].astype(np.float32) @ small.T >= least - slack)
            for cut in range(0, len(rows), 200_000):
                row, col = rows[cut : cut + 200_000] + lo, cols[cut : cut + 200_000]
                apart = ~(pairs[0][col][:, :, None] == pairs[1][row][:, None, :]).any((1, 2))
                if inside:
                    apart &= at[col] < to[row]
                row, col = row[apart], col[apart]
                true = np.einsum("ij,ij->i", y[row], x[col]) >= least
                row, col = row[true], col[true]
                np.add.at(links, to[row], weights[0][col])
                np.add.at(links, at[col], weights[1][row])
                low = _merge(low, to[row], at[col])
        met = links > 0
        return pd.DataFrame({"cid": ids[met], "low": ids[low[met]], "links": links[met], "audited": 0, "missed": 0})

    return run


def _search(least: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        base = pdf[pdf["indexed"]].sort_values("cid", ignore_index=True)
        asked = pdf[~pdf["indexed"]].sort_values("cid", ignore_index=True)
        shard, slack = int(pdf["shard"].iloc[0]), 1e-9
        none = pd.DataFrame({"cid": np.empty(0, np.int64), "low": np.empty(0, np.int64), "links": np.empty(0, np.int64), "audited": np.empty(0, np.int64), "missed": np.empty(0, np.int64)})
        if base.empty or asked.empty:
            return none
        ids, x = base["cid"].to_numpy(), _unit(base["vector"])
        near = [np.asarray(v, np.int64) for v in base["near"]]
        at = np.minimum(np.searchsorted(ids, np.concatenate(near)), len(ids) - 1)
        here = ids[at] == np.concatenate(near)
        lists = [v[k] for v, k in zip(*(np.split(z, np.cumsum([len(v) for v in near])[:-1]) for z in (at, here)))]
        weight, home = base["size"].to_numpy(), [np.array([h[0] for h in base["shards"]]), np.array([h[-1] for h in base["shards"]])]
        every = np.unique(np.concatenate([ids, asked["cid"]]))
        out, audit, lowest = [], [0, 0], np.arange(len(every))
        blocks = [asked.iloc[lo : lo + 256] for lo in range(0, len(asked), 256)]
        queries = [_unit(b["vector"]) for b in blocks]
        found = [range_search(x, lists, q, least - slack) for q in queries]
        for b, q, hit in zip(blocks, queries, found):
            some = np.flatnonzero(b["cid"].to_numpy() % 20 == 0)
            true = q[some] @ x.T >= least - slack
            audit[0] += int(true.sum())
            audit[1] += int((true & ~hit[some]).sum())
        if audit[1] > (1 - RECALL) * audit[0]:
            found = [q @ x.T >= least - slack for q in queries]
        for b, q, hit in zip(blocks, queries, found):
            row, col = np.nonzero(hit)
            mine, theirs = b["cid"].to_numpy()[row], ids[col]
            lo, hi = (np.array([h[i] for h in b["shards"]])[row] for i in (0, -1))
            both = np.minimum(np.where((lo == home[0][col]) | (lo == home[1][col]), lo, 2**63 - 1), np.where((hi == home[0][col]) | (hi == home[1][col]), hi, 2**63 - 1))
            keep = (mine != theirs) & (both == shard)
            row, col, mine, theirs = row[keep], col[keep], mine[keep], theirs[keep]
            keep = np.einsum("ij,ij->i", q[row], x[col]) >= least
            got = pd.DataFrame({"cid": mine[keep], "links": weight[col[keep]]})
            lowest = _merge(lowest, np.searchsorted(every, mine[keep]), np.searchsorted(every, theirs[keep]))
            out.append(got.groupby("cid", as_index=False).agg({"links": "sum"}))
        out = pd.concat(out, ignore_index=True).assign(audited=0, missed=0)
        # the asked class and what it met are in one component, whose smallest class may be of either side
        out.insert(1, "low", every[lowest[np.searchsorted(every, out["cid"].to_numpy(np.int64))]])
        if len(out):
            out.loc[0, ["audited", "missed"]] = audit
        return out

    return run


def embedding_dedup(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = 0.93, shard: int = SHARD, cap: int = 1024, block: int = BLOCK) -> DataFrame:
    """``(id_col, n_links, component_id, kept)`` for every row of ``vectors``.

    Rows link when their labels are equal and not null and their cosine, in double precision, is at least ``threshold``.
    Null and zero vectors, those with null or non-finite components, and rows of a null id link with nothing; their component is
    their own id. Vectors of different lengths never link. Rows of equal vectors and labels link with each other, repeated
    rows too; each counts as a vector of its own. ``kept`` is whether the id is its component (null for a null id).
    """
    scratch = Scratch(vectors.sparkSession)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("vector"))
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    good = F.col("label").isNotNull() & F.col("id").isNotNull() & F.coalesce(F.forall("vector", finite), F.lit(False)) & F.exists("vector", lambda v: v != 0)
    rows = rows.withColumn("good", F.coalesce(good, F.lit(False))).withColumn("label", F.concat_ws(":", F.size("vector").cast("string"), "label"))
    rows = rows.withColumn("key", F.when(F.col("good"), F.struct(F.xxhash64("label", "vector").alias("a"), F.xxhash64(F.lit(1), "vector", "label").alias("b"))))
    classes = rows.filter("good").groupBy("key").agg(F.min("id").alias("cid"), F.count("*").alias("size"), F.first("label").alias("label"), F.first("vector").alias("vector"))
    classes = scratch.write(classes, narrow=False)
    links = _links(classes.select("cid", "size", "label", "vector"), scratch, threshold, shard, cap, block)
    counted = links.groupBy("cid").agg(F.sum("links").alias("links"))
    reached = components(links.select(F.col("cid").alias("u"), F.col("low").alias("v")), scratch)
    named = classes.join(counted, "cid", "left").join(reached.withColumnRenamed("node", "cid"), "cid", "left")
    named = scratch.write(named.select("key", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("component", "cid").alias("component_id")))
    scratch.keep(named)
    out = rows.select("id", "key").join(named, "key", "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("id") == component).alias("kept"))


def _fit(shard: int):
    """A cell's centroids, one row each."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf.iloc[0]
        c = _centroids(_unit(pdf.sort_values("cid")["vector"]), min(FAN, max(2, round(int(first["n"]) / shard))))
        return pd.DataFrame({"label": first["label"], "node": first["node"], "slices": first["slices"], "j": np.arange(len(c)), "centre": list(c)})

    return run


_ROW = "label string, cid long, size long, vector array<double>, node long, parent long, kind int, level int, block long, was long, asks array<long>, open boolean"


def _divide(least: float, block: int):
    """Rows of a cell on their way to its children, ``_ROW`` (``block`` and ``was`` are 0 where there is none); rows of a cell without a sample stay where they are.

    What a row asks for within the angle is a list beside it, of blocks or, where the cell is ``open`` (larger than a block), of children: a row without
    clusters is within reach of nearly every child, so its vector is not repeated for each.
    """
    sine = np.sqrt(1 - least * least) if 0 < least < 1 else 2.0 if least <= 0 else 0.0

    def run(pdf: pd.DataFrame, centres: pd.DataFrame) -> pd.DataFrame:
        names = [c.split()[0] for c in _ROW.split(", ")]
        if pdf.empty or centres.empty:
            stays = [[v] if k == ASK else None for v, k in zip(pdf["node"], pdf["kind"])]
            return pdf.assign(was=np.where(pdf["kind"] == HOME, pdf["n"], 0), asks=stays, open=True)[names]
        centres = centres.sort_values("j")
        c, child = np.array(centres["centre"].tolist()), centres["child"].to_numpy()
        n, node, step, kind = int(pdf["n"].iloc[0]), int(pdf["node"].iloc[0]), int(pdf["step"].iloc[0]), pdf["kind"].to_numpy()
        sims = _unit(pdf["vector"]) @ c.T
        near = np.argsort(-sims, axis=1, kind="stable")[:, :2]
        # a vector within the angle may lie in the cell of a centroid only if its edge (a plane through the origin) is within the angle
        gap = np.sqrt(np.maximum(2 - 2 * (c[near[:, 0]] @ c.T), 0))
        reach = np.take_along_axis(sims, near[:, :1], 1) - sims <= sine * gap + 1e-7
        at, own, only = (np.flatnonzero(x) for x in (kind != ASK, kind == HOME, kind == ASK))
        reach[at, near[at, 0]] = False
        moves = [(at, kind[at], child[near[at, 0]], pdf["level"].to_numpy()[at]), (only, kind[only], np.zeros(len(only), np.int64), np.zeros(len(only), np.int64))]
        if len(c) > 1:
            reach[own, near[own, 1]] = False
            moves.append((own, np.full(len(own), NEAR), child[near[own, 1]], np.full(len(own), step)))
        within = pdf["block"].to_numpy()
        if n <= block:
            within = np.where(within == 0, pdf["bundle"].to_numpy(), within)
            asks = [[v] if r else None for v, r in zip(within, reach.any(1))]
        else:
            asks = np.split(child[np.nonzero(reach)[1]], np.cumsum(reach.sum(1))[:-1])
        row, kind, node_, level = (np.concatenate([m[i] for m in moves]) for i in range(4))
        asks = [asks[i] if j < len(at) + len(only) else None for j, i in enumerate(row)]
        out = pdf[["label", "cid", "size", "vector"]].iloc[row].reset_index(drop=True).assign(node=node_, parent=node, kind=kind, level=level, asks=asks, open=n > block)
        return out.assign(block=np.where(kind == ASK, 0, within[row]), was=np.where(kind == HOME, n, 0))[names]

    return run


def _cells(classes: DataFrame, scratch: Scratch, least: float, shard: int, cap: int, block: int) -> DataFrame:
    """Each class with its ``home`` cell, its one or two ``shards``, its ``block`` and the blocks that it ``asks``.

    A pair is within reach at every level: of two vectors within the angle, each has a row in the cell of the other. Cells stop being divided
    at twice ``shard`` classes or where a division left nine tenths in one child. Rows of a cell go to their children in slices, so neither a hot label nor a hot cell lies in one task.
    Children of a cell that is larger than a block share blocks of about ``block`` classes, so there are few blocks to ask.
    """
    rows = classes.select("label", "cid", "size", "vector", F.xxhash64("label").alias("node"), F.lit(0).cast("long").alias("parent"), F.lit(HOME).alias("kind"), F.lit(0).alias("level"), F.lit(0).cast("long").alias("block"), F.lit(2**62).alias("was"))
    done, step = [], 0
    while True:
        step += 1
        n = F.count(F.when(F.col("kind") == HOME, 1))
        sizes = rows.groupBy("label", "node").agg(n.alias("n"), F.ceil(F.count("*") / SLICE).cast("int").alias("slices"), F.max("was").alias("was"), F.max("parent").alias("parent"))
        earlier = Window.partitionBy("label", "parent").orderBy("node").rowsBetween(Window.unboundedPreceding, -1)  # of one cell's children
        before = F.coalesce(F.sum(F.when(F.col("n") <= block, F.col("n"))).over(earlier), F.lit(0))
        sizes = sizes.withColumn("bundle", F.when(F.col("n") > block, F.col("node")).otherwise(F.xxhash64("parent", F.floor(before / block))))
        sizes = scratch.write(sizes.select("label", "node", "n", "slices", "bundle", F.coalesce((F.col("n") > 2 * shard) & (F.col("n") <= 0.9 * F.col("was")), F.lit(False)).alias("split")))
        known = rows.join(sizes, ["label", "node"]).withColumn("goes", F.col("split") & ((F.col("kind") != ASK) | (F.col("n") > block)))
        found = F.when(F.col("block") == 0, F.col("bundle")).otherwise(F.col("block")).alias("block")
        done.append(known.filter("not goes").select("label", "cid", "size", F.when(F.col("kind") == HOME, F.col("vector")).alias("vector"), "node", "kind", "level", found))
        if sizes.filter("split").isEmpty():
            break
        known = known.filter("goes").withColumn("step", F.lit(step))
        few = known.filter((F.col("kind") == HOME) & ((F.xxhash64("cid", "step") / F.lit(2.0**64) + 0.5) * F.col("n") < SAMPLE_ROWS))
        fitted = few.select("label", "node", "n", "slices", "cid", "vector").groupBy("label", "node").applyInPandas(_fit(shard), "label string, node long, slices int, j int, centre array<double>")
        fitted = fitted.withColumn("child", F.xxhash64("node", "j")).withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
        dealt = known.withColumn("slice", F.pmod(F.xxhash64("cid", "kind", "level"), F.col("slices")).cast("int"))
        key = ["label", "node", "slice"]
        made = scratch.write(dealt.groupBy(key).cogroup(fitted.groupBy(key)).applyInPandas(_divide(least, block), _ROW), narrow=False)
        asked = lambda test, vector, at: made.filter(test).select("label", "cid", "size", vector.alias("vector"), F.explode("asks").alias("node"), *at)  # noqa: B023, E731
        zero, none = F.lit(0).cast("long"), F.lit(None).cast("array<double>")
        done.append(asked("not open", none, [F.lit(ASK).alias("kind"), F.lit(0).alias("level")]).withColumn("block", F.col("node")))
        rows = made.filter(F.col("kind") != ASK).drop("asks", "open").unionByName(asked("open", F.col("vector"), ["parent", F.lit(ASK).alias("kind"), F.lit(0).alias("level"), zero.alias("block"), zero.alias("was")]))
    every = done[0]
    for more in done[1:]:
        every = every.unionByName(more)
    every = scratch.write(every, narrow=False)
    home = every.filter(F.col("kind") == HOME)
    second = every.filter(F.col("kind") == NEAR).groupBy("label", "cid").agg(F.sort_array(F.collect_list(F.struct("level", "node", "block")), asc=False).alias("found"))
    second = scratch.write(second.withColumn("node", F.col("found")[0]["node"]))
    filled = home.select("label", "node").unionByName(second.select("label", "node")).groupBy("label", "node").agg(F.count("*").alias("n")).filter(F.col("n") > cap)
    second = second.join(filled.select("label", "node", F.lit(True).alias("full")), ["label", "node"], "left").withColumn("full", F.coalesce("full", F.lit(False)))
    second = scratch.write(second.select("label", "cid", F.when(~F.col("full"), F.col("node")).alias("second"), F.expr("slice(found, if(full, 1, 2), size(found))").getField("block").alias("left_out")))
    asks = every.filter(F.col("kind") == ASK).select("label", "cid", "block").unionByName(second.select("label", "cid", F.explode("left_out").alias("block")))
    asks = asks.groupBy("label", "cid").agg(F.collect_set("block").alias("asks"))
    own = home.select("label", "cid", "size", "vector", F.col("node").alias("home"), "block").join(second.drop("left_out"), ["label", "cid"], "left").join(asks, ["label", "cid"], "left")
    return own.withColumn("shards", F.sort_array(F.array_distinct(F.array("home", F.coalesce("second", "home"))))).drop("second")


def _links(classes: DataFrame, scratch: Scratch, least: float, shard: int, cap: int, block: int) -> DataFrame:
    """``(cid, low, links, audited, missed)``: for each class and part the smallest class of its component and how many rows it links to."""
    named = _cells(classes, scratch, least, shard, cap, block)
    members = scratch.write(named.withColumn("shard", F.explode("shards")), narrow=False)
    parts = members.groupBy("label", "shard").agg(F.count("*").alias("n")).select("label", "shard", F.ceil(F.col("n") / cap).cast("int").alias("parts"))
    members = scratch.write(members.join(parts, ["label", "shard"]).withColumn("part", F.pmod(F.xxhash64("cid"), F.col("parts")).cast("int")), narrow=False)
    built = members.select("label", "cid", "shard", "part", "vector").groupBy("label", "shard", "part").applyInPandas(_build, "cid long, shard long, part int, near array<long>")
    united = scratch.write(built.groupBy("cid").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near")))
    base = members.join(united, "cid").withColumn("indexed", F.lit(True)).withColumn("ask", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    asked = members.withColumn("near", F.lit(None).cast("array<long>")).withColumn("indexed", F.lit(False)).withColumn("ask", F.col("part")).drop("part")
    asked = asked.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    names = ["label", "shard", "part", "ask", "cid", "size", "vector", "shards", "near", "indexed"]
    units = base.select(names).unionByName(asked.select(names))
    searched = units.groupBy("label", "shard", "part", "ask").applyInPandas(_search(least), "cid long, low long, links long, audited long, missed long")
    return scratch.write(searched.unionByName(_apart(members, scratch, least, block)), narrow=False)


def _apart(members: DataFrame, scratch: Scratch, least: float, block: int) -> DataFrame:
    """What ``_across`` finds: every block against the classes that ask for it, both dealt into parts of ``block`` classes."""
    own = members.filter("shard = home").select("label", "block", "cid", "size", "vector", "shards", "asks")
    parts = scratch.write(own.groupBy("label", "block").agg(F.ceil(F.count("*") / block).cast("int").alias("parts")))
    own = own.join(parts, ["label", "block"]).withColumn("sub", F.pmod(F.xxhash64("cid", F.lit(1)), F.col("parts")).cast("int")).drop("parts")
    key = ["label", "block", "sub", "ask_block", "ask_sub"]
    asked = own.withColumnsRenamed({"block": "ask_block", "sub": "ask_sub"}).withColumn("block", F.explode("asks")).filter("block <= ask_block").join(parts, ["label", "block"])
    asked = asked.withColumn("sub", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    names = [*key, "cid", "size", "vector", "shards"]
    units = scratch.write(asked.select(key).distinct())
    base = own.join(units, ["label", "block", "sub"]).select(*names, F.lit(True).alias("indexed"))
    both = base.unionByName(asked.select(*names, F.lit(False).alias("indexed")))
    return both.groupBy(key).applyInPandas(_across(least), "cid long, low long, links long, audited long, missed long")
