"""Helpers shared by the operators: skew-free ranks and Arrow row streams."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from tessera.session import materialize

#: A word: a longest run of characters other than ASCII white space.  For UTF-8
#: bytes ``bytes.split()`` yields exactly these runs.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def n_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def doc_crc(col: str = "doc_id") -> Column:
    """crc32 of the id as text (null id: of the empty text)."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")))


def salted(df: DataFrame, group: Sequence[str], order: Sequence[str], salt_of: Column,
           n_salt: int) -> DataFrame:
    """Add ``_rank``: a gapless 0-based position of each row within its group.

    The group is cut into ``n_salt`` hash pieces, so that a group with a third
    of all rows is ranked by many tasks: row numbers within a piece, plus the
    rows of the pieces before it.  Group columns must not be null.  ``df`` is
    read twice and should be a written table.
    """
    g = list(group)
    s = df.withColumn("_salt", F.pmod(salt_of, F.lit(n_salt)).cast("int"))
    w = Window.partitionBy(*g).orderBy("_salt")
    off = s.groupBy(*g, "_salt").agg(F.count(F.lit(1)).alias("_n")) \
        .select(*g, "_salt", (F.sum("_n").over(w) - F.col("_n")).alias("_off"))
    r = F.row_number().over(Window.partitionBy(*g, "_salt").orderBy(*order))
    return s.join(off, [*g, "_salt"]).withColumn("_rank", F.col("_off") + r - 1).drop("_salt", "_off")


def range_rank(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """Written copy of ``df`` with ``_rank``, the gapless 0-based position of
    each row in the given total order, without a one-task window: range
    partitions are numbered locally and shifted by the rows before them."""
    n = n_partitions(df.sparkSession)
    s = materialize(df.repartitionByRange(n, *order).sortWithinPartitions(*order)
                    .withColumn("_id", F.monotonically_increasing_id()), name)
    s = s.withColumn("_p", F.shiftright("_id", 33)).withColumn("_i", F.col("_id").bitwiseAND((1 << 33) - 1))
    off = s.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))  # one row per partition
    off = off.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_off"))
    return s.join(off, "_p").withColumn("_rank", F.col("_off") + F.col("_i")).drop("_id", "_p", "_i", "_off")


def rows_of(batches: Iterable[pa.RecordBatch], binary: Sequence[int] = (), step: int = 256) -> Iterator[tuple]:
    """Rows of Arrow batches as tuples, a few at a time; the columns in
    ``binary`` come as bytes (texts as UTF-8)."""
    for batch in batches:
        for i in range(0, batch.num_rows, step):
            part = batch.slice(i, step)
            yield from zip(*[(c.cast(pa.binary()) if k in binary else c).to_pylist()
                             for k, c in enumerate(part.columns)])


def batches_of(rows: Iterable[tuple], schema: pa.Schema, step: int = 1024) -> Iterator[pa.RecordBatch]:
    """Pack tuples into record batches of at most ``step`` rows."""
    buf: list[tuple] = []

    def pack() -> pa.RecordBatch:
        cols = list(zip(*buf)) or [()] * len(schema)
        return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(cols, schema)], schema=schema)

    for r in rows:
        buf.append(r)
        if len(buf) >= step:
            yield pack()
            buf = []
    if buf:
        yield pack()


def stream(df: DataFrame, fn: Callable[[Iterator[tuple]], Iterable[tuple]], schema: str,
           binary: Sequence[int] = (), step: int = 1024) -> DataFrame:
    """``fn`` over the rows of every partition; rows pass through in small
    Arrow batches, nothing of a partition is kept but what ``fn`` keeps."""
    struct = T._parse_datatype_string(schema)
    arrow = to_arrow_schema(struct)

    def run(batches):
        yield from batches_of(fn(rows_of(batches, binary)), arrow, step)

    return df.mapInArrow(run, struct)


def runs(text: str | bytes, run: re.Pattern, gap: re.Pattern, size: int = 1 << 20) -> Iterator[list]:
    """All matches of ``run`` in ``text``, as lists.  A very long text is cut
    at the first place without a run character (``gap``) after every ``size``
    characters, so that no list holds a whole long text and no run is cut."""
    at = 0
    while at < len(text):
        m = gap.search(text, at + size) if len(text) - at > size else None
        end = m.start() if m else len(text)
        yield run.findall(text, at, end)
        at = end
