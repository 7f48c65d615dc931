"""Tables that are changed by small written layers and merged when read."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..session import cut_lineage, scratch_path

#: A read merges at most so many layers; one more and they are folded into a new base.
MAX_LAYERS = 16


def key_text(key: Sequence[str]) -> Column:
    parts = [F.col(k).cast("string") for k in key]
    # A single key stays a plain column, so that joins on it need no second shuffle.
    return parts[0] if len(parts) == 1 else F.concat_ws("|", *parts)


@dataclass(frozen=True)
class Layered:
    """A base table and the changes made to it since, each written once.

    A layer has one row per changed key: the whole row as it is now, or null
    where it is gone. Reading takes the newest layer of a key, and the base
    where no layer has it; the plan stays the same size whatever the number
    of layers. Without a key the table only grows.

    With ``changing`` rows never come nor go and only these columns change: a
    layer then has no other columns, however wide the table is.
    """

    base: DataFrame
    key: tuple[str, ...] = ()
    paths: tuple[str, ...] = ()
    changing: tuple[str, ...] = ()

    def _schema(self) -> T.StructType:
        if self.changing:
            return T.StructType([T.StructField("_key", T.StringType()), T.StructField("_at", T.LongType()), *[T.StructField(c, self.base.schema[c].dataType) for c in self.changing]])
        return T.StructType().add("_key", "string").add("_at", "long").add("_row", T.StructType([T.StructField(f.name, f.dataType, True) for f in self.base.schema]))

    def _write(self, rows: DataFrame) -> Layered:
        path = scratch_path(rows.sparkSession, "layer")
        values = [F.col(f.name).cast(f.dataType).alias(f.name) for f in self._schema().fields[2:]]
        kept = rows.select("_key", F.lit(len(self.paths)).cast("bigint").alias("_at"), *values)
        # Half of a hexadecimal digest is lost to other codecs.
        kept.write.option("compression", "zstd").parquet(path)
        out = replace(self, paths=(*self.paths, path))
        return out if len(out.paths) <= MAX_LAYERS else Layered(cut_lineage(out.view(), "base"), self.key, changing=self.changing)

    def changed(self, after: DataFrame, keys: DataFrame) -> Layered:
        """The rows of these keys (one text column, ``key``) become what they are in ``after``."""
        asked = keys.select(F.col("key").alias("_key")).distinct()
        if self.changing:
            return self.patched(after.select(*self.key, *self.changing).withColumn("_key", key_text(self.key)).join(asked, "_key", "left_semi"))
        mine = after.select(key_text(self.key).alias("_key"), F.struct(*self.base.columns).alias("_row"))
        return self._write(asked.join(mine, "_key", "left"))

    def patched(self, rows: DataFrame) -> Layered:
        """These rows, one per key with all ``changing`` columns, hold from now on; keys the table lacks count for nothing."""
        return self._write(rows.select(key_text(self.key).alias("_key"), *self.changing))

    def appended(self, rows: DataFrame) -> Layered:
        return self._write(rows.select(F.lit(None).cast("string").alias("_key"), F.struct(*self.base.columns).alias("_row")))

    def layers(self) -> DataFrame:
        return self._read(*self.paths)

    def last(self) -> DataFrame:
        """The newest layer."""
        return self._read(self.paths[-1])

    def _read(self, *paths: str) -> DataFrame:
        return self.base.sparkSession.read.schema(self._schema()).parquet(*paths)

    def view(self) -> DataFrame:
        """The table as it is now."""
        if not self.paths:
            return self.base
        if not self.key:
            return self.base.unionByName(self.layers().select("_row.*"))
        if self.changing:
            return self._patched_view()
        newest = self.layers().groupBy("_key").agg(F.max(F.struct("_at", "_row")).alias("_n")).select("_key", "_n._row")
        kept = self.base.withColumn("_key", key_text(self.key)).join(newest.select("_key"), "_key", "left_anti")
        return kept.select(*self.base.columns).unionByName(newest.where("_row IS NOT NULL").select("_row.*"))

    def _patched_view(self) -> DataFrame:
        newest = self.layers()
        if len(self.paths) > 1:
            # One aggregate per column: those that nobody reads are not shuffled.
            newest = newest.groupBy("_key").agg(*[F.max_by(c, "_at").alias(c) for c in self.changing])
        newest = newest.select("_key", F.lit(True).alias("_hit"), *[F.col(c).alias(f"_new_{c}") for c in self.changing])
        if len(self.key) == 1:
            kind = self.base.schema[self.key[0]].dataType
            joined = self.base.join(newest.withColumn(self.key[0], F.col("_key").cast(kind)).drop("_key"), self.key[0], "left")
        else:
            joined = self.base.withColumn("_key", key_text(self.key)).join(newest, "_key", "left")
        now = {c: F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) for c in self.changing}
        return joined.select(*[now.get(c, F.col(c)) for c in self.base.columns])
