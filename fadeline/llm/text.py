"""Words and the reading of batches, shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

#: Characters that part words: space, tab, line feed, vertical tab, form feed, return.
SPACES = " \t\n\x0b\f\r"
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of the longest word that is remembered.
LONGEST_KNOWN = 64

#: Rows whose texts are looked at together inside a task, at most; and their bytes.
SLICE_ROWS, SLICE_BYTES = 512, 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def word_count(column: Column) -> Column:
    """Number of words; null has none."""
    return F.coalesce(F.regexp_count(column, F.lit(WORD)), F.lit(0)).cast("long")


def words(text: str) -> list[bytes]:
    """The words as UTF-8: ``bytes.split`` parts at exactly the characters of SPACES."""
    return text.encode("utf-8", "surrogatepass").split()


def unused(df: DataFrame, name: str) -> str:
    """A column name that ``df`` has not."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


class Bounded(dict):
    """A dictionary that makes missing values and starts anew when it is full.  Values of
    words longer than ``longest`` are made and not kept, so that bytes are bounded too."""

    def __init__(self, make: Callable, most: int, longest: int | None = None):
        super().__init__()
        self._make, self._most, self._longest = make, most, longest

    def __missing__(self, key):
        if self._longest is not None and len(key) > self._longest:
            return self._make(key)
        if len(self) >= self._most:
            self.clear()
        value = self[key] = self._make(key)
        return value


def map_texts(df: DataFrame, column: str, make: Callable[[], Callable[[list], Iterable]], added: dict[str, tuple[str, pa.DataType]], drop: Iterable[str] = ()) -> DataFrame:
    """``df`` with columns computed from ``column`` by Python inside the tasks.

    ``make()`` runs once per task and gives a function from a list of texts (null
    is None) to rows of added values.  ``added`` has each new column's Spark and
    Arrow type; a column of ``df`` with such a name is replaced.  Rows keep their
    task: nothing is shuffled, and a lost task is simply run again.
    """
    names = list(added)
    kept = [c for c in df.columns if c not in added and c not in drop]
    own = unused(df, "text_in")
    source = df.select(*(F.col(f"`{c}`") for c in kept), F.col(f"`{column}`").alias(own))
    new_fields = T.StructType.fromDDL(", ".join(f"`{n}` {added[n][0]}" for n in names)).fields
    schema = T.StructType([*(df.schema[c] for c in kept), *new_fields])
    types = [added[n][1] for n in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function = make()
        for batch in batches:
            at = batch.schema.get_field_index(own)
            for part in slices(batch, at):
                rows = list(function(part.column(at).to_pylist()))
                new = [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]
                columns = [part.column(i) for i in range(at)]
                yield pa.RecordBatch.from_arrays([*columns, *new], names=[*kept, *names])

    return source.mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, at: int) -> Iterator[pa.RecordBatch]:
    """The batch in parts of few rows and bytes, so that long texts are not all
    decoded at once."""
    rows = max(1, min(SLICE_ROWS, batch.num_rows * SLICE_BYTES // max(1, batch.column(at).nbytes)))
    for begin in range(0, batch.num_rows, rows):
        yield batch.slice(begin, rows)
