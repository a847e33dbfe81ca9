"""Leaving out rows before a shuffle, by a filter of fixed size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinline.session import ship

# Bits of the filter (4 MB), and of the pieces in which the driver gets it.
FILTER_BITS, CHUNK_BITS = 1 << 25, 1 << 15


def maybe_in(df: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """Rows of ``df`` but for most of those whose ``column`` is not in ``ids``; a join decides.

    A bit for each hash of an id. The more ids, the more others pass, and none is lost.
    """
    ship(df.sparkSession)
    place = F.pmod(F.xxhash64(F.col(column).cast("long")), F.lit(FILTER_BITS)).cast("int")

    def pack(table: pa.Table) -> pa.Table:
        places = table.column("_place").to_numpy()
        chunk = np.zeros(CHUNK_BITS, bool)
        chunk[places % CHUNK_BITS] = True
        return pa.table({"chunk": pa.array([int(places[0]) // CHUNK_BITS], pa.int32()), "bits": [np.packbits(chunk).tobytes()]})

    places = ids.select(place.alias("_place")).distinct()
    packed = places.groupBy(F.shiftright("_place", CHUNK_BITS.bit_length() - 1)).applyInArrow(pack, "chunk int, bits binary")
    every = np.zeros(FILTER_BITS // 8, np.uint8)
    for row in packed.collect():
        every[row["chunk"] * CHUNK_BITS // 8 :][: CHUNK_BITS // 8] = np.frombuffer(row["bits"], np.uint8)
    shared = df.sparkSession.sparkContext.broadcast(every)
    names = df.columns

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column("_place").to_numpy()
            known = shared.value[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1
            batch = batch.filter(pa.array(known.astype(bool)))
            if batch.num_rows:
                yield batch.select(names)

    return df.withColumn("_place", place).mapInArrow(keep, df.schema)
