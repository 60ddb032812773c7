"""Operator 6: exact n-gram Jaccard join in a metric space.

The Jaccard distance ``d = 1 - |x & y| / |x | y|`` is a metric, and documents link when ``d <= eps = 1 - t``.

1. Documents with equal shingle sets are one *class* (a node). A fixed-size count sketch over all shingles of all
   documents orders shingles from rare to frequent; any fixed order is exact, rarity only makes regions small.
2. Two linked sets must share one of their first ``n - ceil(t n) + 1`` shingles in that order, so each such
   shingle names a *region* and a class is replicated to the regions of its prefix. Prefixes travel packed: one
   binary block for each task and bucket, from which the bucket keeps regions of two classes or more. A shingle of
   very many documents is dealt over all buckets, and its region is put together by an aggregation.
3. A region's *pivot* is the class in whose order its shingle comes first, as that class has the fewest shingles of its own and
   so lies in the middle. Every class that may link with the pivot is compared with it; those within ``eps`` are its Voronoi
   cell. Cells are contracted to components before any other pair is made.
4. What is left are pairs of a region whose classes lie in different components. The smaller set of a pair must hold the
   region's shingle early enough (*index* rows); the larger one asks for a window of sizes. In large regions
   classes also fall into rings round the pivot: an index row is in one cell (ring, size band), and an asking row is
   replicated to the cells which the triangle inequality leaves, ``|d(x, pivot) - d(y, pivot)| <= eps``. Parity signatures
   bound the pairs of a cell before whole sets are compared exactly.
5. If the cells of large regions still hold many pairs, the classes of these regions are joined again recursively: their
   shingles are counted exactly among them alone, which makes the passage that brought them together frequent, and
   new prefixes, regions and pivots are drawn. Recursion ends when it no longer halves the pairs.

Shingles are identified by 64-bit hashes of their words' bytes.
"""

from __future__ import annotations

import hashlib
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NO_ID, Scratch, joined_components
from .sketch import SLOTS, level_of, levels, packed, slot
from .words import Words, mix, parts, pieces, shingles, trim, utf8

#: Bits of the filter that keeps unwanted texts out of a shuffle.
_BITS = 1 << 23
#: Classes that a task remembers, so that copies of a text send their prefix once.
_SEEN = 500_000
_U = np.uint64


def _sets(batch: pa.RecordBatch, k: int, at: int = 1):
    """First column, sizes, offsets and sorted shingle hashes of a small batch whose column ``at`` has texts."""
    text, h = shingles(Words(*utf8(batch.column(at)), lower=True), k)
    n = np.bincount(text, minlength=batch.num_rows)
    return batch.column(0), n, np.concatenate([[0], np.cumsum(n)]), text, h


def _class(h: np.ndarray) -> int:
    return int.from_bytes(hashlib.sha1(h.tobytes()).digest()[:8], "little", signed=True)


def _signature(h: np.ndarray) -> bytes:
    """Parities of how many shingles fall into each of 2**b bins, about as many bins as shingles."""
    bits = 1 << max(6, int(len(h) - 1).bit_length())
    odd = np.bincount((h >> _U(20)).astype(np.int64) & (bits - 1), minlength=bits) & 1
    return np.packbits(odd.astype(bool), bitorder="little").tobytes()


def _describe(k: int):
    """For each document its class and size; for each task its part of the count sketch."""
    schema = pa.schema([("id", pa.int64()), ("key", pa.int64()), ("cls", pa.int64()), ("n", pa.int64()), ("sig", pa.binary()), ("part", pa.int32()), ("counts", pa.binary())])

    def run(batches):
        counts = np.zeros(SLOTS, np.uint32)
        for batch in batches:
            for piece in pieces(batch, batch.schema.names[1], 1 << 20):
                ids, n, off, _, h = _sets(piece, k)
                at, times = np.unique(slot(h), return_counts=True)
                counts[at] += times.astype(np.uint32)
                cls = [_class(h[a:b]) if b > a else None for a, b in zip(off[:-1], off[1:])]
                sig = [_signature(h[a:b]) if b > a else None for a, b in zip(off[:-1], off[1:])]
                none = pa.nulls(len(ids))
                yield pa.record_batch([ids, piece.column(2), pa.array(cls, pa.int64()), pa.array(n), pa.array(sig, pa.binary()), none.cast(pa.int32()), none.cast(pa.binary())], schema=schema)
        if counts.any():
            part, block = packed(counts)
            none = pa.nulls(len(part))
            yield pa.record_batch([*[none.cast(pa.int64())] * 4, none.cast(pa.binary()), part, block], schema=schema)
        trim()

    return run


def _needed(n: np.ndarray, t: Fraction) -> np.ndarray:
    """The least overlap that a set of ``n`` needs with any other: ceil(t n)."""
    return -((-n * t.numerator) // t.denominator)


_ENTRY = np.dtype([("h", "<u8"), ("c", "<i8"), ("p", "<i4"), ("n", "<i4")])


def _pack(levels_of, hot: int, t: Fraction, buckets: int, sets_of):
    """Prefix entries (shingle, class, position, size) packed into one block for each bucket; shingles of level ``hot`` go to all buckets."""
    schema = pa.schema([("bucket", pa.int32()), ("block", pa.binary())])

    def run(batches):
        table = levels_of()
        for cls, n, text, h in sets_of(batches):
            level = table[slot(h)]
            order = np.lexsort((h, level, text))
            h, level, start = h[order], level[order], np.cumsum(n) - n
            at = np.arange(len(h)) - start[text]
            keep = at < (n - _needed(n, t) + 1)[text]
            h, at, text, level = h[keep], at[keep], text[keep], level[keep]
            bucket = (mix(np.where(level >= hot, h + cls.view(_U)[text], h)) % _U(buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            h, at, text, bucket = h[order], at[order], text[order], bucket[order]
            row = np.empty(len(h), _ENTRY)
            row["h"], row["c"], row["p"], row["n"] = h, cls[text], at, n[text]
            edge = np.flatnonzero(np.diff(bucket, prepend=-1))
            blocks = [pa.compress(row[a:b].tobytes(), "zstd", asbytes=True) for a, b in zip(edge, [*edge[1:], len(row)])]
            size = np.diff([*edge, len(row)]).astype("<i4")
            blocks = [s.tobytes() + x for s, x in zip(size, blocks)]
            yield pa.record_batch([pa.array(bucket[edge]), pa.array(blocks, pa.binary())], schema=schema)
        trim()

    return run


_REGION = "region long, cls long, pos long, n long, pivot long, pivot_n long, pivot_pos long, size long, hot boolean"


def _regions(levels_of, hot: int):
    """Regions of two classes or more in one bucket, with their pivot; an entry appears once for each class. Of hot shingles all entries go on."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = [np.frombuffer(pa.decompress(x[4:], decompressed_size=_ENTRY.itemsize * int.from_bytes(x[:4], "little"), codec="zstd", asbytes=True), _ENTRY) for x in pdf["block"]]
        rows = np.concatenate(rows) if rows else np.empty(0, _ENTRY)
        rows = rows[np.lexsort((rows["c"], rows["p"], rows["h"]))]
        new = np.ones(len(rows), bool)
        new[1:] = (rows["h"][1:] != rows["h"][:-1]) | (rows["c"][1:] != rows["c"][:-1])
        rows = rows[new]
        first = np.flatnonzero(np.concatenate([[True], rows["h"][1:] != rows["h"][:-1]])) if len(rows) else np.empty(0, int)
        size = np.diff([*first, len(rows)])
        first, size = np.repeat(first, size), np.repeat(size, size)
        often = levels_of()[slot(rows["h"])] >= hot
        keep = (size > 1) | often
        rows, pivot, size, often = rows[keep], rows[first[keep]], size[keep], often[keep]
        long = lambda x: x.astype(np.int64)
        return pd.DataFrame({"region": rows["h"].view(np.int64), "cls": rows["c"], "pos": long(rows["p"]), "n": long(rows["n"]), "pivot": pivot["c"], "pivot_n": long(pivot["n"]), "pivot_pos": long(pivot["p"]), "size": long(size), "hot": often})

    return run


def _with_pivots(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """Entries ``(region, cls, pos, n)`` with their region's pivot and size; regions of one class are left out."""
    first = rows.groupBy("region").agg(F.min(F.struct("pos", "cls", "n")).alias("p"), F.count("*").alias("size")).filter("size > 1")
    first = scratch.write(first.select("region", F.col("p.cls").alias("pivot"), F.col("p.n").alias("pivot_n"), F.col("p.pos").alias("pivot_pos"), "size"))
    return rows.join(first, "region").select("region", "cls", "pos", "n", "pivot", "pivot_n", "pivot_pos", "size")


def _compare(batches):
    """Overlap and union of the two sets of each row ``(x, y, a, b)``, many pairs at once."""
    for batch in batches:
        for part in parts(batch, "ab"):
            rows = []
            for name in "ab":
                h = part.column(part.schema.get_field_index(name)).to_pylist()
                size = np.array([len(v) // 8 for v in h])
                rows.append((np.repeat(np.arange(len(size)), size), np.frombuffer(b"".join(h), _U)))
            pair, h = np.concatenate([rows[0][0], rows[1][0]]), np.concatenate([rows[0][1], rows[1][1]])
            order = np.lexsort((h, pair))
            pair, h = pair[order], h[order]
            same = (pair[1:] == pair[:-1]) & (h[1:] == h[:-1])
            both = np.bincount(pair[1:][same], minlength=part.num_rows)
            size = [np.bincount(r[0], minlength=part.num_rows) for r in rows]
            columns = [part.column(part.schema.get_field_index(c)) for c in "xy"] + [pa.array(c.astype(np.int64)) for c in (both, size[0] + size[1] - both)]
            yield pa.record_batch(columns, names=["x", "y", "both", "union"])
    trim()


def _bound(t: Fraction):
    """Least distance of each pair ``(x, y, na, nb, a, b)`` and whether it may link, from the signatures.

    Parities of two sets differ in no more bins than the sets differ in shingles, also after folding the larger
    signature to the size of the smaller, so this never loses a link.
    """

    def run(batches):
        for batch in batches:
            get = lambda name: batch.column(batch.schema.get_field_index(name))  # noqa: E731, B023
            low, may = [], []
            for na, nb, a, b in zip(get("na").to_pylist(), get("nb").to_pylist(), get("a").to_pylist(), get("b").to_pylist()):
                if len(a) > len(b):
                    a, b = b, a
                small, large, size = int.from_bytes(a, "little"), int.from_bytes(b, "little"), len(b) * 8
                while size > len(a) * 8:
                    size //= 2
                    large = large >> size ^ large & (1 << size) - 1
                both = min(na, nb, (na + nb - (small ^ large).bit_count()) // 2)
                union = na + nb - both
                low.append(1 - both / union)
                may.append(both * t.denominator >= union * t.numerator)
            yield pa.record_batch([get("x"), get("y"), pa.array(low, pa.float64()), pa.array(may, pa.bool_())], names=["x", "y", "low", "may"])

    return run


def _side(table: DataFrame, side: int, *what: str) -> DataFrame:
    """A table of classes as one side of pairs: x, na, a or y, nb, b."""
    names = {"cls": "xy"[side], "n": ("na", "nb")[side]}
    return table.select("cls", *what).select(*[F.col(c).alias(names.get(c, "ab"[side])) for c in ("cls", *what)])


class _Corpus:
    """The classes and the texts behind them; joins are of direct exchanges, so AQE can split a class in many pairs."""

    def __init__(self, source: DataFrame, classes: DataFrame, words: int, t: Fraction, scratch: Scratch):
        self.source, self.classes, self.words, self.t, self.scratch = source, classes, words, t, scratch

    def bounded(self, pairs: DataFrame) -> DataFrame:
        """``(x, y, low, may)``: a lower bound of each pair's distance and whether it may link."""
        signed = pairs.join(_side(self.classes, 0, "n", "sig"), "x").join(_side(self.classes, 1, "n", "sig"), "y")
        return self.scratch.write(signed.mapInArrow(_bound(self.t), "x long, y long, low double, may boolean"))

    def sets(self, wanted: DataFrame) -> DataFrame:
        """``(cls, h, n)`` of the classes ``wanted (cls)``, from the text of each one's first document.

        A bitmap of fixed size (1 MB), made of hashes of these documents' ids and texts, keeps other texts out; a task sends each set once.
        """
        reps = self.scratch.write(wanted.distinct().join(self.classes.select("cls", "rep"), "cls"))
        place = lambda *c: F.pmod(F.xxhash64(*c), F.lit(_BITS))
        at = place("rep.id", "rep.key") + 1
        bits = reps.select(F.bitmap_bucket_number(at).alias("bucket"), F.bitmap_bit_position(at).alias("at")).groupBy("bucket").agg(F.bitmap_construct_agg("at").alias("bits"))
        bits = self.scratch.write(bits)  # at most _BITS bits
        slot = self.source.withColumn("place", place("id", "key") + 1).withColumns({"bucket": F.bitmap_bucket_number("place"), "at": F.bitmap_bit_position("place")})
        some = slot.join(F.broadcast(bits), "bucket").filter("getbit(bigint(conv(hex(substring(bits, int(at div 8) + 1, 1)), 16, 10)), int(at % 8)) = 1")
        stored = some.select("text").mapInArrow(_store(self.words), "cls long, h binary, n long").join(reps.select("cls"), "cls", "left_semi")
        return self.scratch.write(stored.dropDuplicates(["cls"]), narrow=False)

    def exact(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """``(x, y, d, linked)`` by the whole sets."""
        both = pairs.select("x", "y").join(_side(sets, 0, "h"), "x").join(_side(sets, 1, "h"), "y")
        found = both.mapInArrow(_compare, "x long, y long, both long, union long")
        linked = F.col("both") * self.t.denominator >= F.col("union") * self.t.numerator
        return self.scratch.write(found.select("x", "y", (1 - F.col("both") / F.col("union")).alias("d"), linked.alias("linked")))


def _feasible(t: Fraction, na: str, pa_: str, nb: str, pb: str):
    """Whether sizes and positions leave enough overlap: both >= t/(1+t) (na+nb) for what follows the shared shingle."""
    most = F.least(F.expr(f"{na} - {pa_}"), F.expr(f"{nb} - {pb}"))
    return most * (t.numerator + t.denominator) >= t.numerator * (F.col(na) + F.col(nb))


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, threshold: Fraction = Fraction(3, 4), region: int = 256, hot: int = 1 << 21) -> DataFrame:
    """``(id_col, n_shingles, component_id)`` for every row of ``docs``.

    Words are runs of anything but space and 0x09-0x0D after lower-casing A-Z; a document's set has its distinct
    shingles of ``words`` words, or its whole word sequence if it has fewer. Null, empty and blank texts have an
    empty set, size 0, and their own id as component. Rows with equal texts, repeated rows included, share
    a component. A null id counts as the smallest and is returned as null. Other columns are ignored. Regions of more
    than ``region`` classes are cut into cells; shingles that ``hot`` documents or more may hold are dealt over all tasks. Neither changes
    the result.
    """
    spark, t = docs.sparkSession, threshold
    scratch = Scratch(spark)
    source = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("key"))
    described = scratch.write(source.mapInArrow(_describe(words), "id long, key long, cls long, n long, sig binary, part int, counts binary"), narrow=False)
    rows = described.filter("part is null").select("id", "key", "cls", "n", "sig")
    table = levels(described.filter("part is not null").select("part", "counts"))
    shared = spark.sparkContext.broadcast(table.tobytes())
    hot_level = int(level_of(hot))
    classes = scratch.write(rows.filter("n > 0").groupBy("cls").agg(F.min(F.struct("id", "key")).alias("rep"), F.first("n").alias("n"), F.first("sig").alias("sig")))

    def levels_of():
        return np.frombuffer(shared.value, np.uint8)

    def from_texts(batches):
        seen = set()
        for batch in batches:
            for piece in pieces(batch, "text", 1 << 20):
                _, n, off, text, h = _sets(piece, words)
                cls, fresh = np.zeros(len(n), np.int64), np.zeros(len(n), bool)
                for i, (a, b) in enumerate(zip(off[:-1], off[1:])):
                    if b > a and (c := _class(h[a:b])) not in seen:
                        seen.add(c)
                        cls[i], fresh[i] = c, True
                if fresh.any():
                    mine = fresh[text]
                    yield cls[fresh], n[fresh], (np.cumsum(fresh) - 1)[text[mine]], h[mine]
                if len(seen) > _SEEN:
                    seen.clear()

    buckets = _buckets(spark, rows.agg(F.sum("n")).first()[0] or 0, 4_000_000)
    blocks = source.mapInArrow(_pack(levels_of, hot_level, t, buckets, from_texts), "bucket int, block binary")
    found = scratch.write(blocks.groupBy("bucket").applyInPandas(_regions(levels_of, hot_level), _REGION), narrow=False)
    if (table >= hot_level).any():
        found = found.filter("not hot").drop("hot").unionByName(scratch.write(_with_pivots(found.filter("hot").select("region", "cls", "pos", "n"), scratch)))
    reached = _join(found, _Corpus(source, classes, words, t, scratch), region, None).select(F.col("node").alias("cls"), "component")
    named = classes.select("cls", F.col("rep.id").alias("rep")).join(reached, "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    least = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    final = scratch.write(named.join(least, "component").select("cls", "component_id"))
    scratch.keep(described, final)
    out = rows.filter("n > 0").join(final, "cls").select("id", "n", "component_id").unionByName(rows.filter("n = 0").select("id", "n", F.col("id").alias("component_id")))
    back = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return out.select(back("id").alias(id_col), F.col("n").alias("n_shingles"), back("component_id").alias("component_id"))


def _buckets(spark: SparkSession, entries: int, size: int) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), entries // size + 1) * 2


def _store(k: int):
    """Class and set of each text; a task sends a class once."""

    def run(batches):
        seen = set()
        for batch in batches:
            for piece in pieces(batch, "text"):
                _, n, off, _, h = _sets(piece, k, 0)
                got = []
                for a, b in zip(off[:-1], off[1:]):
                    if b > a and (c := _class(h[a:b])) not in seen:
                        seen.add(c)
                        got.append((c, h[a:b].tobytes(), b - a))
                yield pa.record_batch([pa.array([x[i] for x in got], kind) for i, kind in enumerate((pa.int64(), pa.binary(), pa.int64()))], names=["cls", "h", "n"])
                if len(seen) > _SEEN:
                    seen.clear()
        trim()

    return run


def _apart(pairs: DataFrame, reached: DataFrame) -> DataFrame:
    """Pairs whose ends are not known to lie in one component."""
    a, b = (reached.select(F.col("node").alias(c), F.col("component").alias(f"c{c}")) for c in "xy")
    named = pairs.join(a, "x", "left").join(b, "y", "left")
    return named.filter(F.coalesce("cx", "x") != F.coalesce("cy", "y")).drop("cx", "cy")


def _edges(measured: DataFrame) -> DataFrame:
    return measured.filter("linked").select(F.col("x").alias("u"), F.col("y").alias("v"))


def _asks(t: Fraction):
    """The sizes of smaller sets that a row may link with: those which its own size, and what follows the shared shingle, leave."""
    p, q = t.numerator, t.denominator
    return F.expr(f"bigint(ceil(n * {p} / {q}))"), F.expr(f"least(n, bigint(floor((n - pos) * {p + q} / {p})) - n)")


def _cells(rows: DataFrame, t: Fraction, eps: float) -> tuple[DataFrame, DataFrame]:
    """Asking and index rows of large regions with their cells ``(ring, band)``; index rows of unknown distance are in ring -1."""
    band = lambda n: F.floor(F.log(n.cast("double")) * 8).cast("int")
    ring = lambda d: F.floor(d / eps).cast("int")
    least, most = _asks(t)
    rings = F.concat(F.array(F.lit(-1)), F.sequence(ring(F.greatest(F.col("low") - eps, F.lit(0.0))), ring(F.col("high") + eps)))
    asking = rows.filter(most >= least).withColumn("ring", F.explode(rings)).withColumn("band", F.explode(F.sequence(band(least), band(most))))
    index = rows.filter(_index(t)).withColumns({"ring": F.when(F.col("low") == F.col("high"), ring(F.col("low"))).otherwise(-1), "band": band(F.col("n"))})
    return asking, index


def _index(t: Fraction):
    """Whether a set as large or larger may link with this row by the region's shingle as the first that they share."""
    return F.expr(f"(n - pos) * {t.numerator + t.denominator} >= {2 * t.numerator} * n")


def _meet(asking: DataFrame, index: DataFrame, on: list[str], t: Fraction, eps: float) -> DataFrame:
    """Pairs ``(x, y)``, larger set first, of different components which sizes, positions and the triangle inequality leave."""
    a, b = (rows.select(*on, *[F.col(c).alias(f"{c}_{s}") for c in ("cls", "pos", "n", "component", "low", "high")]) for s, rows in (("a", asking), ("b", index)))
    pairs = a.join(b, on).filter("component_a <> component_b and (n_a > n_b or n_a = n_b and cls_a > cls_b)")
    pairs = pairs.filter(f"low_a - high_b <= {eps} and low_b - high_a <= {eps}").filter(_feasible(t, "n_a", "pos_a", "n_b", "pos_b"))
    return pairs.select(F.col("cls_a").alias("x"), F.col("cls_b").alias("y"))


def _join(found: DataFrame, corpus: _Corpus, region: int, reached: DataFrame | None, stored: DataFrame | None = None, held: int | None = None) -> DataFrame:
    """Components ``(node, component)`` of everything which the pairs within the regions connect, and of ``reached``.

    Within a recursion ``stored`` has the sets of its classes and ``held`` the number of pairs in the cells that it came from.
    """
    sets_of = corpus.sets if stored is None else lambda wanted: stored
    t, scratch = corpus.t, corpus.scratch
    eps = float(1 - t) + 1e-9
    star = found.filter("cls <> pivot").filter(_feasible(t, "n", "pos", "pivot_n", "pivot_pos")).select(F.col("cls").alias("x"), F.col("pivot").alias("y")).distinct()
    star = scratch.write(star if reached is None else _apart(star, reached))
    near = star.select("x", "y", F.lit(None).cast("double").alias("d"))
    if not star.isEmpty():
        near = corpus.exact(star, sets_of(star.select(F.explode(F.array("x", "y")).alias("cls"))))
        reached = joined_components(reached, _edges(near), scratch)
    if reached is None:
        reached = star.select(F.col("x").alias("node"), F.col("y").alias("component"))
    more = found.filter("size > 2 and cls <> pivot").select("region", "cls", "pos", "n", "pivot", "size")
    named = scratch.write(more.join(reached.select(F.col("node").alias("cls"), "component"), "cls", "left").withColumn("component", F.coalesce("component", "cls")))
    mixed = named.groupBy("region").agg(F.min("component").alias("a"), F.max("component").alias("b")).filter("a <> b").select("region")
    known = near.select(F.col("x").alias("cls"), F.col("y").alias("pivot"), "d")
    rows = named.join(mixed, "region", "left_semi").join(known, ["cls", "pivot"], "left")
    rows = scratch.write(rows.withColumns({"low": F.coalesce("d", F.lit(0.0)), "high": F.coalesce("d", F.lit(1.0))}).drop("d"))
    small, large = rows.filter(F.col("size") <= region), rows.filter(F.col("size") > region)
    pairs = _meet(small, small.filter(_index(t)), ["region"], t, eps)
    asking, index = _cells(large, t, eps)
    cell = ["region", "ring", "band"]
    if (members := large.count()) > 0:
        counts = asking.select(*cell, F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(index.select(*cell, F.lit(0).alias("a"), F.lit(1).alias("b")))
        counts = counts.groupBy(cell).agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
        inside = counts.agg(F.sum(F.col("a").cast("double") * F.col("b"))).first()[0] or 0
        if inside > region * members and (held is None or 2 * inside <= held):
            wide = scratch.write(large.select("cls").distinct())
            inner = corpus.sets(wide) if stored is None else scratch.write(stored.join(wide, "cls"), narrow=False)
            reached = _join(_recount(inner, t, scratch), corpus, region, reached, inner, int(inside))
        else:
            pairs = pairs.unionByName(_meet(asking, index, cell, t, eps))
    rest = corpus.bounded(pairs.distinct()).filter("may").select("x", "y")
    if not rest.isEmpty():
        sets = sets_of(rest.select(F.explode(F.array("x", "y")).alias("cls")))
        reached = joined_components(reached, _edges(corpus.exact(rest, sets)), scratch)
    return reached


def _recount(sets: DataFrame, t: Fraction, scratch: Scratch) -> DataFrame:
    """Prefixes of these sets under exact counts within them alone."""
    def explode(batches):
        for batch in batches:
            for part in parts(batch, "h"):
                h = part.column(1).to_pylist()
                n = np.array([len(x) // 8 for x in h])
                yield pa.record_batch([pa.array(np.repeat(np.asarray(part.column(0)), n)), pa.array(np.frombuffer(b"".join(h), np.int64)), pa.array(np.repeat(n, n))], names=["cls", "s", "n"])
        trim()

    each = sets.mapInArrow(explode, "cls long, s long, n long")
    count = scratch.write(each.groupBy("s").agg(F.count("*").alias("df")).filter("df > 1"))
    ranked = each.join(count, "s", "left").select("cls", "n", F.struct(F.coalesce("df", F.lit(1)).alias("df"), "s").alias("e"))
    listed = ranked.groupBy("cls", "n").agg(F.array_sort(F.collect_list("e")).alias("es"))
    length = F.expr(f"int(n - ceil(n * {t.numerator} / {t.denominator}) + 1)")
    prefix = listed.select("cls", "n", F.posexplode(F.slice("es", F.lit(1), length)).alias("pos", "e")).filter("e.df > 1")
    rows = scratch.write(prefix.select(F.col("e.s").alias("region"), "cls", F.col("pos").cast("long").alias("pos"), "n"))
    return _with_pivots(rows, scratch)
