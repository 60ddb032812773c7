"""An item catalog in versions: uploads, renames and rollback behind one pointer.

A version has its items and the renames that its upload found. The pointer is a small file with the version that holds, the versions whose
renames count, and the number of the last rename. It is written beside and then renamed to the next free number, which either happens or doesn't: until
then everything is as before, and from then on catalog, renames and watermark are those of the new version together. A
rollback is a pointer to what an earlier one said.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.store import catalog_renames, duplicate_codes
from . import folders

RENAMES = "seq long, code string, old_name string, new_name string"


@dataclass(frozen=True)
class Pointer:
    """``version`` 0 is the empty catalog before any upload."""

    version: int = 0
    renames: tuple[int, ...] = ()
    watermark: int = 0


def _pointers(spark: SparkSession, home: str) -> dict[int, object]:
    path, fs = folders.hadoop_path(spark, f"{home}/pointers")
    if not fs.exists(path):
        return {}
    return {int(f.getPath().getName()): f.getPath() for f in fs.listStatus(path) if f.getPath().getName().isdigit()}


def current(spark: SparkSession, home: str, number: int | None = None) -> Pointer:
    """What the last pointer says, or that of a number."""
    found = _pointers(spark, home)
    if not found:
        return Pointer()
    said = json.loads(spark.read.text(found[max(found) if number is None else number].toString(), wholetext=True).first()[0])
    return Pointer(said["version"], tuple(said["renames"]), said["watermark"])


def _point(spark: SparkSession, home: str, to: Pointer) -> None:
    """Makes ``to`` hold; if someone else has moved the pointer meanwhile nothing happens but an error."""
    number = max(_pointers(spark, home), default=0) + 1
    path, fs = folders.hadoop_path(spark, f"{home}/pointers/{number}")
    spare = folders.hadoop_path(spark, f"{home}/pointers/_{uuid.uuid4().hex}")[0]
    out = fs.create(spare, False)
    out.write(json.dumps({"version": to.version, "renames": to.renames, "watermark": to.watermark}).encode())
    out.close()
    if fs.exists(path) or not fs.rename(spare, path):
        fs.delete(spare, False)
        raise RuntimeError("the catalog was changed by another upload")


def items(spark: SparkSession, home: str, columns: DataFrame | None = None) -> DataFrame | None:
    """The items that hold now; before any upload none, with the columns of ``columns`` if it is given."""
    at = current(spark, home)
    if at.version:
        return spark.read.parquet(f"{home}/versions/{at.version}/items")
    return None if columns is None else columns.limit(0)


def renames(spark: SparkSession, home: str) -> DataFrame:
    """The renames that hold now, numbered over all uploads."""
    at = current(spark, home)
    paths = [f"{home}/versions/{v}/renames" for v in at.renames]
    return spark.read.schema(RENAMES).parquet(*paths) if paths else spark.createDataFrame([], RENAMES)


def upload(spark: SparkSession, home: str, catalog: DataFrame) -> bool:
    """Makes ``catalog`` hold and logs the names that changed; false, and nothing changes, if a code occurs in it twice."""
    if not duplicate_codes(catalog).isEmpty():
        return False
    at = current(spark, home)
    path, fs = folders.hadoop_path(spark, f"{home}/versions")
    number = 1 + max([int(f.getPath().getName()) for f in fs.listStatus(path)], default=0) if fs.exists(path) else 1
    catalog.write.parquet(f"{home}/versions/{number}/items")
    new = spark.read.parquet(f"{home}/versions/{number}/items")
    found = catalog_renames(items(spark, home, new), new, at.watermark)
    found.select(*[F.col(c.split()[0]).cast(c.split()[1]) for c in RENAMES.split(", ")]).write.parquet(f"{home}/versions/{number}/renames")
    added = spark.read.schema(RENAMES).parquet(f"{home}/versions/{number}/renames").agg(F.max("seq")).first()[0]
    _point(spark, home, Pointer(number, (*at.renames, number), added or at.watermark))
    return True


def rollback(spark: SparkSession, home: str) -> Pointer:
    """Makes the last upload undone: items, renames and watermark of the version before it hold again, all at once."""
    at, found = current(spark, home), _pointers(spark, home)
    if not at.version:
        return at
    before = Pointer()
    for n in sorted(found, reverse=True)[1:]:
        earlier = current(spark, home, n)
        if earlier.renames == at.renames[:-1]:
            before = earlier
            break
    _point(spark, home, before)
    return before
