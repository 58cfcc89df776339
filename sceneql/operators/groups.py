"""Ordered groups for the few algorithms without a relational form: one array a group, many groups an Arrow batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from sceneql.sources.package import ship


#: Rows of one kind that a group may have; more raise an error instead of filling a task's memory.
MOST = 2_000_000
#: Rows of groups that are Python objects at once, unless one group has more, and rows of results that wait for a batch.
AT_ONCE = 20_000


def pieces(sizes: np.ndarray, most: int = AT_ONCE) -> Iterator[tuple[int, int]]:
    """Stretches [i, j) of groups that have at most `most` rows together, or are one group."""
    i, rows = 0, 0
    for j, n in enumerate(sizes.tolist()):
        if j > i and rows + n > most:
            yield i, j
            i, rows = j, 0
        rows += n
    if i < len(sizes):
        yield i, len(sizes)


def structs(rows: pa.Array) -> list[dict]:
    """The structs of an array as dicts, column by column."""
    names = [rows.type.field(k).name for k in range(rows.type.num_fields)]
    return [dict(zip(names, x)) for x in zip(*(c.to_pylist() for c in rows.flatten()))]


def _ordered(df: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    """(keys, rows): each group's rows as one array in the order of the names."""
    rows = F.array_sort(F.collect_list(F.struct(*names)))
    return df.groupBy(*keys).agg(F.when(F.count("*") <= MOST, rows).otherwise(F.raise_error(F.lit(f"a group has more than {MOST} rows"))).alias("rows"))


def rows_of_groups(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str], f: Callable[[dict[str, np.ndarray], np.ndarray], np.ndarray], out: Sequence[str]) -> DataFrame:
    """(keys, out) of the rows that f chooses, many groups a call and no row a Python object.

    f gets `columns` as arrays of doubles (null: NaN) of many groups' rows, each group in the order of `order` then `columns`, and
    where the groups begin, with the end; it returns which rows stay. A group of more than MOST rows raises an error.
    """
    ship(df.sparkSession)
    names = list(dict.fromkeys([*order, *columns]))
    schema = _parse_datatype_string(", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in [*keys, *out]))
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(len(keys))
            for i, j in pieces(lists.value_lengths().to_numpy(zero_copy_only=False)):
                part = lists.slice(i, j - i)
                size = part.value_lengths().to_numpy(zero_copy_only=False)
                own = dict(zip(names, part.flatten().flatten()))
                given = {c: own[c].cast(pa.float64()).to_numpy(zero_copy_only=False) for c in columns}
                chosen = np.flatnonzero(f(given, np.append(0, np.cumsum(size))))
                rows, group = pa.array(chosen), pa.array(np.repeat(np.arange(i, j), size)[chosen])
                yield pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip([*(b.column(k).take(group) for k in range(len(keys))), *(own[c].take(rows) for c in out)], arrow.types)], names=arrow.names)

    return _ordered(df, keys, names).mapInArrow(run, schema)


def by_group(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str], f: Callable[[list[dict]], list[dict]], schema: str) -> DataFrame:
    """f over each group's rows, in the order of `order` then `columns`; f returns rows of `schema`. A group of more than MOST rows
    raises an error."""
    ship(df.sparkSession)
    names = list(dict.fromkeys([*order, *columns]))
    g = _ordered(df, keys, names)
    key_types = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)
    out = StructType.fromDDL(f"{key_types}, {schema}") if hasattr(StructType, "fromDDL") else _parse_datatype_string(f"{key_types}, {schema}")
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: list[dict] = []
        for b in batches:
            lists = b.column(b.num_columns - 1)
            for i, j in pieces(lists.value_lengths().to_numpy(zero_copy_only=False)):
                part = lists.slice(i, j - i)
                rows, ends = structs(part.flatten()), np.cumsum(part.value_lengths().to_numpy(zero_copy_only=False)).tolist()
                first = 0
                for at, end in enumerate(ends, i):
                    own = {k: b.column(n)[at].as_py() for n, k in enumerate(keys)}
                    made += [own | r for r in f(rows[first:end])]
                    first = end
                if len(made) >= AT_ONCE:
                    yield pa.RecordBatch.from_pylist(made, schema=arrow)
                    made = []
        if made:
            yield pa.RecordBatch.from_pylist(made, schema=arrow)

    return g.mapInArrow(run, out)


def by_arrays(frames: Mapping[str, tuple[DataFrame, Sequence[str]]], keys: Sequence[str], f: Callable[[dict[str, dict[str, np.ndarray]]], Sequence[tuple]], schema: str, most: int = MOST) -> DataFrame:
    """f over each group of the first frame with the same keys' rows of the others; f returns rows of `schema` as tuples.

    frames: name -> (frame, columns that order it); a group comes as arrays, one for each column that isn't a key. Each frame
    is shuffled once by the keys, and the groups are joined where they are. A group with more than `most` rows of one kind
    raises an error.
    """
    first = next(iter(frames.values()))[0]
    ship(first.sparkSession)
    columns, joined = {}, None
    for name, (df, order) in frames.items():
        columns[name] = [*order, *(c for c in df.columns if c not in order and c not in keys)]
        rows = F.array_sort(F.collect_list(F.struct(*columns[name])))
        bounded = F.when(F.count("*") <= most, rows).otherwise(F.raise_error(F.lit(f"a group has more than {most} rows of {name}")))
        g = df.groupBy(*keys).agg(bounded.alias(name))
        joined = g if joined is None else joined.join(g, list(keys), "left")
    key_types = ", ".join(f"{k} {first.schema[k].dataType.simpleString()}" for k in keys)
    out = _parse_datatype_string(f"{key_types}, {schema}")
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made: list[tuple] = []
            kept = list(zip(*(b.column(k).to_pylist() for k in range(len(keys)))))
            lists = {name: b.column(len(keys) + k) for k, name in enumerate(columns)}
            for i, key in enumerate(kept):
                group = {}
                for name, own in columns.items():
                    values = lists[name][i].values
                    group[name] = {c: values.field(c).to_numpy(zero_copy_only=False) if values is not None else np.zeros(0) for c in own}
                made += [(*key, *row) for row in f(group)]
                if len(made) >= AT_ONCE:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made), arrow.types)], names=arrow.names)
                    made = []
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made), arrow.types)], names=arrow.names)

    return joined.select(*keys, *columns).mapInArrow(run, out)
