"""Ordered computations that stay parallel when one key holds most rows.

A plain window over a key puts that key's whole history in one task. Sequence numbers are unique
within a run, so ``seq div SEGMENT`` cuts any key into pieces of at most SEGMENT rows. Each helper
runs a window inside the pieces, reduces every piece to one summary row, scans the (tiny) summaries
and joins the carried value back to the pieces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spoor.session import scratch_path

SEGMENT = 1 << 16
_SEG = "_seg"


def _pieces(df: DataFrame, order: str, size: int | None) -> DataFrame:
    return df.withColumn(_SEG, F.expr(f"CAST({order} div {size or SEGMENT} AS BIGINT)"))


def _local(keys, order, tie):
    return Window.partitionBy(*keys, _SEG).orderBy(order, *tie)


def _earlier_pieces(keys):
    return Window.partitionBy(*keys).orderBy(_SEG).rowsBetween(Window.unboundedPreceding, -1)


def _attach(df: DataFrame, summary: DataFrame, keys) -> DataFrame:
    return df.join(summary, [*keys, _SEG], "left")


def carry_last(df: DataFrame, keys: list[str], candidate: Column, value: Column | None, out: str, *,
               order: str = "seq", tie: tuple = (), inclusive: bool = False,
               segment: int | None = None) -> DataFrame:
    """Add ``out``: ``value`` (a struct) of the newest candidate row before each row with equal keys.

    Without a value, ``out`` is the order column of that row; its summaries are plain maxima, which
    need no sort. ``inclusive`` also lets a row see itself. Keys must not be null.
    """
    return carry_many(df, [(keys, candidate, value, out)], order=order, tie=tie, inclusive=inclusive,
                      segment=segment)


def carry_many(df: DataFrame, specs: list[tuple[list[str], Column, Column | None, str]], *, order: str = "seq",
               tie: tuple = (), inclusive: bool = False, segment: int | None = None) -> DataFrame:
    """Several ``carry_last`` columns over one input, so that it is read once per column and not squared."""
    pieces = _pieces(df, order, segment)
    position = F.struct(F.col(order), *[F.col(t) for t in tie])
    end = 0 if inclusive else -1
    result = pieces
    for keys, candidate, value, out in specs:
        near = _local(keys, order, tie).rowsBetween(Window.unboundedPreceding, end)
        picked = F.when(candidate, F.col(order) if value is None else value)
        result = result.withColumn(f"_near_{out}", F.last(picked, ignorenulls=True).over(near))
    for keys, candidate, value, out in specs:
        newest = (F.max(F.when(candidate, F.col(order))) if value is None
                  else F.max_by(value, F.when(candidate, position)))
        carried = (pieces.groupBy(*keys, _SEG).agg(newest.alias("_value"))
                   .select(*keys, _SEG, F.last("_value", ignorenulls=True)
                           .over(_earlier_pieces(keys)).alias(f"_carried_{out}"))
                   .filter(F.col(f"_carried_{out}").isNotNull()))
        result = (_attach(result, carried, keys)
                  .withColumn(out, F.coalesce(f"_near_{out}", f"_carried_{out}"))
                  .drop(f"_near_{out}", f"_carried_{out}"))
    return result.drop(_SEG)


def running_sum(df: DataFrame, keys: list[str], delta: Column, out: str, *, order: str = "seq",
                tie: tuple = (), segment: int | None = None) -> DataFrame:
    """Add ``out``: inclusive prefix sum of ``delta`` along ``order`` within equal keys."""
    df = _pieces(df, order, segment).withColumn("_delta", delta.cast("bigint"))
    near = _local(keys, order, tie).rowsBetween(Window.unboundedPreceding, 0)
    carried = (df.groupBy(*keys, _SEG).agg(F.sum("_delta").alias("_total"))
               .select(*keys, _SEG, F.sum("_total").over(_earlier_pieces(keys)).alias("_carried")))
    df = df.withColumn("_near", F.sum("_delta").over(near))
    return (_attach(df, carried, keys)
            .withColumn(out, F.col("_near") + F.coalesce("_carried", F.lit(0)))
            .drop("_near", "_carried", "_delta", _SEG))


def ordinals(df: DataFrame, keys: list[str], out: str, *, order: str = "seq", tie: tuple = (),
             segment: int | None = None) -> DataFrame:
    """Add ``out``: 0-based position of each row along ``order`` within equal keys."""
    df = _pieces(df, order, segment)
    carried = (df.groupBy(*keys, _SEG).agg(F.count(F.lit(1)).alias("_rows"))
               .select(*keys, _SEG, F.sum("_rows").over(_earlier_pieces(keys)).alias("_carried")))
    df = df.withColumn("_near", F.row_number().over(_local(keys, order, tie)))
    return (_attach(df, carried, keys)
            .withColumn(out, F.col("_near") - 1 + F.coalesce("_carried", F.lit(0)))
            .drop("_near", "_carried", _SEG))


_CHUNK = 1 << 16


def _whole_pieces(batches, order: list[str]):
    """Some pieces at a time: their rows, sorted within each piece, the row each begins at, and the batch's other columns.
    A batch's first column holds the rows of a piece as one array."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc
    for batch in batches:
        ends = np.cumsum(batch.column(0).value_lengths().to_numpy(zero_copy_only=False), dtype=np.int64)
        cuts = np.flatnonzero(np.diff((ends - 1) // _CHUNK, prepend=-1)).tolist()
        for i, j in zip(cuts, [*cuts[1:], batch.num_rows]):
            some = batch.slice(i, j - i)
            sizes = some.column(0).value_lengths().to_numpy(zero_copy_only=False)
            rows = pa.RecordBatch.from_struct_array(some.column(0).flatten())
            rows = rows.append_column("_piece", pa.array(np.repeat(np.arange(len(sizes)), sizes)))
            keys = [(c, "ascending") for c in ("_piece", *order)]
            yield rows.take(pc.sort_indices(rows, sort_keys=keys, null_placement="at_start")), np.cumsum(sizes) - sizes, some


def _codes(column):
    """Whole numbers that are equal where values are equal; null is a value."""
    import numpy as np
    return column.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False).astype(np.int64)


def _by_place(rows, place: str, value: list[str]):
    """The rows by piece and place, in order; where a place begins there; where a value is another one than in the row before."""
    import numpy as np
    n, place = rows.num_rows, _codes(rows.column(place))
    group = rows.column("_piece").to_numpy() * (place.max() + 1) + place
    by = np.argsort(group, kind="stable")
    begins = np.flatnonzero(np.diff(group[by], prepend=-1))
    differs = np.zeros(n, bool)
    for column in value:
        codes = _codes(rows.column(column))[by]
        differs[1:] |= codes[1:] != codes[:-1]
    return by, begins, differs


def _counted(flags, piece, starts):
    """How many flags are set in a row's piece up to the row."""
    import numpy as np
    total = np.concatenate([[0], np.cumsum(flags)])
    return total[1:] - total[starts][piece]


def _met(place: str, value: list[str], order: list[str], names: list[str]):
    """First pass of ``number_changes``: one row per piece and place."""
    def run(batches):
        import numpy as np
        import pyarrow as pa
        for rows, starts, pieces in _whole_pieces(batches, order):
            piece = rows.column("_piece").to_numpy()
            by, begins, changed = _by_place(rows, place, value)
            changed[begins] = False
            flags = np.empty_like(changed)
            flags[by] = changed
            count, position = _counted(flags, piece, starts), np.arange(len(by)) - starts[piece] + 1
            newest = np.maximum.accumulate(np.where(changed, np.arange(len(by)), -1))
            ends = np.append(begins[1:], len(by)) - 1
            some, first, last = newest[ends] >= begins, by[begins], by[ends]
            newest = by[newest[ends]]
            own = pa.array(piece[first])
            yield pa.RecordBatch.from_arrays(
                [*[c.take(own) for c in pieces.columns[1:]], *[rows.column(c).take(pa.array(first)) for c in (place, *value)],
                 *[rows.column(c).take(pa.array(last)) for c in value], pa.array(position[first]), pa.array(position[newest], mask=~some),
                 pa.array(count[first]), pa.array(count[newest], mask=~some), pa.array(np.add.reduceat(changed, begins, dtype=np.int64)),
                 pa.array(ends - begins + 1)], names)
    return run


def _numbered(place: str, value: list[str], order: list[str], kept: list[str], names: list[str]):
    """Second pass of ``number_changes``: rows with the numbers that their places' heads, which come first, begin with."""
    def run(batches):
        import numpy as np
        import pyarrow as pa
        for rows, starts, _ in _whole_pieces(batches, order):
            piece = rows.column("_piece").to_numpy()
            by, begins, created = _by_place(rows, place, value)
            real, known = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("_row", "_known"))
            base, row_base, carried = (rows.column(c).fill_null(0).to_numpy() for c in ("_base", "_row_base", "_carried"))
            size = np.diff(begins, append=len(by))
            created[begins] = False                            # the heads
            created[begins + 1] |= known[by[begins]] != True   # noqa: E712  (null in rows)
            flags = np.empty_like(created)
            flags[by] = created
            newest = np.maximum.accumulate(np.where(created, np.arange(len(by)), -1))
            head = np.repeat(by[begins], size)
            number = np.empty(len(by), np.int64)
            number[by] = np.where(newest >= np.repeat(begins, size), base[head] + _counted(flags, piece, starts)[by[newest]], carried[head])
            ordinal = _counted(real, piece, starts) - 1 + row_base[starts][piece]
            out = [*[rows.column(c) for c in kept], pa.array(flags), pa.array(number), pa.array(ordinal)]
            yield pa.RecordBatch.from_arrays(out[:len(names)], names).filter(pa.array(real))
    return run


def number_changes(df: DataFrame, keys: list[str], place: str, value: list[str], created: str, out: str, ordinal: str | None = None, *,
                   order: str = "seq", tie: tuple = (), segment: int | None = None) -> DataFrame:
    """Number the rows whose ``value`` (columns) differs from the one before with an equal place, from 1 within equal keys.

    Adds ``created`` (the row differs, or is the first of its place), ``out`` (the number of the place's newest created
    row, itself included) and ``ordinal`` (0-based position within equal keys). Keys and order must not be null. Rows that
    order and tie leave open are taken by place and value, alike in both passes.

    Rows are dealt twice, by piece; tasks sort and count some pieces at a time. The first pass writes one row per piece and
    place, from which follow the value and number that the place enters the piece with. In the second pass that row, the
    head, stands before the place's rows, which need nothing else.
    """
    spark, pieces, group = df.sparkSession, _pieces(df, order, segment), [_SEG, *keys]

    def typed(columns):
        return [T.StructField(n, df.schema[c].dataType if c in df.columns else T.LongType()) for n, c in columns]

    # Arrow sorts NaN with the nulls, Spark after all numbers.
    nans = {f"_nan_{c}": F.isnan(c) for c in (order, *tie) if isinstance(df.schema[c].dataType, (T.FloatType, T.DoubleType))}
    along = [n for c in (order, *tie) for n in (f"_nan_{c}", c) if n in nans or n == c]
    sort = [*along, place, *value]

    def dealt(rows, columns):
        """One row per piece, so that Spark measures and passes on pieces instead of rows."""
        rows = rows.withColumns(nans | {"_deal": F.xxhash64(*group)}).select(
            "_deal", *group, F.struct(*dict.fromkeys([place, *value, *along, *columns])).alias("_rows")).repartition("_deal")
        return rows.groupBy("_deal", *group).agg(F.collect_list("_rows").alias("_rows")).select("_rows", *group)

    # First pass: a place's changes inside a piece, counted along the piece; whether its first row is one is not known yet.
    numbers = ["_begin", "_newest", "_count_begin", "_count_newest", "_changes", "_rows"]
    columns = [*[(c, c) for c in (*group, place)], *[(f"_in{i}", v) for i, v in enumerate(value)],
               *[(f"_out{i}", v) for i, v in enumerate(value)], *[(n, n) for n in numbers]]
    met = dealt(pieces, []).mapInArrow(_met(place, value, sort, [n for n, _ in columns]), T.StructType(typed(columns)))
    before = Window.partitionBy(place, *keys).orderBy(_SEG)
    came, went = (F.struct(*[F.col(f"_{side}{i}").alias(v) for i, v in enumerate(value)]) for side in ("in", "out"))
    met = met.withColumn("_prior", F.lag(went).over(before))
    met = met.withColumn("_opens", ~came.eqNullSafe(F.col("_prior")))
    # The newest created row of each place in the piece, and the created first rows up to it.
    met = met.withColumn("_ends", F.coalesce("_newest", F.when(F.col("_opens"), F.col("_begin"))))
    met = met.withColumn("_event", F.explode(F.array(
        F.struct(F.col("_begin").alias("p"), F.lit(0).alias("asks")),
        F.struct(F.coalesce("_ends", F.lit(0)).alias("p"), F.lit(1).alias("asks")))))
    opened = F.sum(F.when(F.col("_opens") & (F.col("_event.asks") == 0), 1).otherwise(0)).over(
        Window.partitionBy(*group).orderBy("_event").rowsBetween(Window.unboundedPreceding, 0))
    met = met.withColumn("_opened", opened).filter("_event.asks = 1")
    path = scratch_path(spark, "changes")
    met.select(*group, place, "_prior", "_rows", (F.col("_changes") + F.col("_opens").cast("bigint")).alias("_made"),
               F.when(F.col("_ends").isNotNull(), F.coalesce("_count_newest", "_count_begin") + F.col("_opened")).alias("_number")
               ).write.parquet(path)
    met = spark.read.parquet(path)

    totals = met.groupBy(*group).agg(F.sum("_made").alias("_made"), F.sum("_rows").alias("_rows"))
    earlier = _earlier_pieces(keys)
    totals = totals.select(*group, F.coalesce(F.sum("_made").over(earlier), F.lit(0)).alias("_base"),
                           F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_row_base"))
    carried = F.last(F.col("_base") + F.col("_number"), ignorenulls=True).over(before.rowsBetween(Window.unboundedPreceding, -1))
    heads = _attach(met.drop("_made", "_rows"), totals, keys).select(
        *group, place, *[F.col("_prior")[v].alias(v) for v in value], F.lit(False).alias("_row"), F.col("_prior").isNotNull().alias("_known"),
        "_base", "_row_base", carried.alias("_carried"))

    rows = dealt(pieces.withColumn("_row", F.lit(True)).unionByName(heads, allowMissingColumns=True),
                 [*df.columns, "_row", "_known", "_base", "_row_base", "_carried"])
    added = [T.StructField(created, T.BooleanType()), T.StructField(out, T.LongType()), *([T.StructField(ordinal, T.LongType())] if ordinal else [])]
    schema = T.StructType([*typed([(c, c) for c in df.columns]), *added])
    return rows.mapInArrow(_numbered(place, value, ["_row", *sort], df.columns, schema.names), schema)


def open_levels(df: DataFrame, keys: list[str], entering: Column, *, order: str = "seq",
                segment: int | None = None) -> DataFrame:
    """Add ``level`` and ``orphan`` for last-in-first-out pairing of enter and exit rows.

    An enter and the exit that closes it share a level; an exit with nothing open is an orphan.
    With S the running sum of +1/-1 and m = least(0, running minimum of S), an exit is an orphan
    exactly when it makes a new minimum below zero.
    """
    df = (_pieces(df, order, segment).withColumn("_enter", entering)
          .withColumn("_step", F.when(F.col("_enter"), F.lit(1)).otherwise(F.lit(-1)).cast("bigint")))
    near = _local(keys, order, ()).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("_sum", F.sum("_step").over(near))
    df = df.withColumn("_low", F.min("_sum").over(near))
    df = df.withColumn("_low_before", F.lag("_low").over(_local(keys, order, ())))
    before = _earlier_pieces(keys)
    pieces = (df.groupBy(*keys, _SEG).agg(F.sum("_step").alias("_total"), F.min("_sum").alias("_deep"))
              .withColumn("_base", F.coalesce(F.sum("_total").over(before), F.lit(0)))
              .withColumn("_floor", F.least(F.lit(0), F.min(F.col("_base") + F.col("_deep")).over(before)))
              .select(*keys, _SEG, "_base", "_floor"))
    df = _attach(df, pieces, keys)
    s = F.col("_base") + F.col("_sum")
    floor = F.least("_floor", F.col("_base") + F.col("_low"))
    floor_before = F.least("_floor", F.col("_base") + F.col("_low_before"))  # least() skips nulls
    return (df.withColumn("orphan", ~F.col("_enter") & (s < floor_before))
            .withColumn("level", F.when(F.col("_enter"), s - floor)
                        .when(~F.col("orphan"), s - floor + 1).cast("bigint"))
            .drop("_enter", "_step", "_sum", "_low", "_low_before", "_base", "_floor", _SEG))


def match_levels(df: DataFrame, keys: list[str], entering: Column, value: Column | None, out: str, *,
                 segment: int | None = None) -> DataFrame:
    """Pair each exit with the enter it closes: ``out`` is the enter's ``value`` (or seq), null for orphans."""
    df = open_levels(df, keys, entering, segment=segment)
    df = df.withColumn("level", F.coalesce("level", F.lit(-1)))
    df = carry_last(df, [*keys, "level"], entering, value, out, segment=segment)
    return df.withColumn(out, F.when(~entering & ~F.col("orphan"), F.col(out)))


# Positions handled by the dyadic helpers run from 0 to LAST.
_TOP = 48
LAST = (1 << _TOP) - 1


def cover_nodes(low: str, high: str, top: int = _TOP) -> Column:
    """Dyadic nodes (level, node) that exactly tile the whole numbers low..high (SQL expressions).

    A point p lies in the range iff one of the nodes equals (level, p div 2^level); that node is
    unique, so joining ranges to points on it gives every pair once. At most two nodes per level.
    """
    left = f"shiftright(({low}) + shiftleft(1L, L) - 1, L)"
    right = f"shiftright(({high}) + 1, L)"
    return F.expr(f"""
        filter(flatten(transform(sequence(0, {top}), L -> array(
            CASE WHEN {left} < {right} AND ({left} & 1) = 1
                 THEN struct(L AS level, {left} AS node) END,
            CASE WHEN {left} < {right} AND ({right} & 1) = 1
                 THEN struct(L AS level, {right} - 1 AS node) END))), n -> n IS NOT NULL)""")


def point_nodes(point: str, top: int = _TOP) -> Column:
    """All dyadic nodes that contain a point, one per level."""
    return F.expr(f"transform(sequence(0, {top}), L -> struct(L AS level, shiftright(({point}), L) AS node))")
