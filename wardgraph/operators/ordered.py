"""Time-ordered operators that stay balanced when one key holds most of the rows.

A window partitioned by patient puts all rows of one patient into one task.
Here the rows of a key are cut into time slices. Each slice is ordered on its
own, a summary of one row per (key, slice) carries what later slices need, and
the summary is joined back on (key, slice). The big side is shuffled once, on
(key, slice); only the summary is ever gathered per key.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLICE = "_slice"
# Width of a slice. A slice gives one row of summary, which is shuffled three
# times, so a slice should hold several rows of an ordinary key.
GRAIN = "week"
_LAST = "9999-12-31"


@dataclass(frozen=True)
class Spec:
    kind: str
    name: str
    value: Column | None = None
    fields: tuple[str, ...] = ()


def number(name: str) -> Spec:
    """Position of the row in its key, from 1."""
    return Spec("number", name)


def previous(name: str, value: Column | None = None, fields: Sequence[str] = ()) -> Spec:
    """``value`` of the row before, or a struct of its ``fields``; null on the first row of a key.

    Columns named as ``fields`` go through the shuffle once, not once more inside a struct.
    """
    return Spec("previous", name, value, tuple(fields))


def last_known(name: str, value: Column) -> Spec:
    """Latest non-null ``value`` among the rows before this one."""
    return Spec("last_known", name, value)


def next_known(name: str, value: Column) -> Spec:
    """First non-null ``value`` among the rows after this one."""
    return Spec("next_known", name, value)


def total_before(name: str, value: Column) -> Spec:
    """Sum of ``value`` over the rows before this one."""
    return Spec("total_before", name, value)


def with_slice(df: DataFrame, ts: str, grain: str = GRAIN) -> DataFrame:
    """Add the time slice of a row; rows without a time form the last slice."""
    return df.withColumn(
        SLICE,
        F.coalesce(F.date_trunc(grain, F.col(ts).cast("timestamp")), F.lit(_LAST).cast("timestamp")),
    )


def along(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    *specs: Spec,
    grain: str = GRAIN,
    slice_by: Column | None = None,
) -> DataFrame:
    """Add one column per spec, looking along ``order`` inside each key.

    ``order[0]`` is the time column, the others make the order total. Rows
    without a time sort last. Key columns must not be null. ``grain`` is the
    width of a slice; choose a finer one for denser keys. Rows that are not
    ordered by time give ``slice_by``, any value that never falls along the
    order.
    """
    keys = list(keys)
    sliced = with_slice(df, order[0], grain) if slice_by is None else df.withColumn(SLICE, slice_by)
    for spec in specs:
        if spec.value is not None:
            sliced = sliced.withColumn(f"_v_{spec.name}", spec.value)
    position = F.struct(*[F.col(c) for c in order])
    in_slice = Window.partitionBy(*keys, SLICE).orderBy(*[F.col(c).asc_nulls_last() for c in order])
    before = in_slice.rowsBetween(Window.unboundedPreceding, -1)
    after = in_slice.rowsBetween(1, Window.unboundedFollowing)

    local = sliced.withColumn("_pos", F.row_number().over(in_slice))
    aggs: list[Column] = [F.count(F.lit(1)).alias("_n")]
    for spec in specs:
        v = F.col(f"_v_{spec.name}")
        if spec.fields:
            lags = [F.lag(f).over(in_slice).alias(f) for f in spec.fields]
            local = local.withColumn(f"_l_{spec.name}", F.struct(*lags))
            aggs.append(F.max_by(F.struct(F.struct(*spec.fields).alias("v")), position).alias(f"_s_{spec.name}"))
        elif spec.kind == "previous":
            local = local.withColumn(f"_l_{spec.name}", F.lag(v).over(in_slice))
            aggs.append(F.max_by(F.struct(v.alias("v")), position).alias(f"_s_{spec.name}"))
        elif spec.kind == "last_known":
            local = local.withColumn(f"_l_{spec.name}", F.last(v, ignorenulls=True).over(before))
            aggs.append(F.max_by(v, F.when(v.isNotNull(), position)).alias(f"_s_{spec.name}"))
        elif spec.kind == "next_known":
            local = local.withColumn(f"_l_{spec.name}", F.first(v, ignorenulls=True).over(after))
            aggs.append(F.min_by(v, F.when(v.isNotNull(), position)).alias(f"_s_{spec.name}"))
        elif spec.kind == "total_before":
            local = local.withColumn(f"_l_{spec.name}", F.coalesce(F.sum(v).over(before), F.lit(0)))
            aggs.append(F.coalesce(F.sum(v), F.lit(0)).alias(f"_s_{spec.name}"))

    slices = sliced.groupBy(*keys, SLICE).agg(*aggs)
    by_key = Window.partitionBy(*keys).orderBy(SLICE)
    earlier = by_key.rowsBetween(Window.unboundedPreceding, -1)
    later = by_key.rowsBetween(1, Window.unboundedFollowing)
    carry = [*keys, SLICE]
    slices = slices.withColumn("_c_n", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    carry.append("_c_n")
    for spec in specs:
        s, c = F.col(f"_s_{spec.name}"), f"_c_{spec.name}"
        if spec.kind == "previous":
            slices = slices.withColumn(c, F.lag(s).over(by_key)["v"])
        elif spec.kind == "last_known":
            slices = slices.withColumn(c, F.last(s, ignorenulls=True).over(earlier))
        elif spec.kind == "next_known":
            slices = slices.withColumn(c, F.first(s, ignorenulls=True).over(later))
        elif spec.kind == "total_before":
            slices = slices.withColumn(c, F.coalesce(F.sum(s).over(earlier), F.lit(0)))
        else:
            continue
        carry.append(c)

    joined = local.join(slices.select(*carry), [*keys, SLICE])
    out = {}
    for spec in specs:
        here, carried = F.col(f"_l_{spec.name}") if spec.kind != "number" else None, F.col(f"_c_{spec.name}")
        if spec.kind == "number":
            out[spec.name] = (F.col("_pos") + F.col("_c_n")).cast("bigint")
        elif spec.kind == "previous":
            out[spec.name] = F.when(F.col("_pos") == 1, carried).otherwise(here)
        elif spec.kind == "total_before":
            out[spec.name] = here + carried
        else:
            out[spec.name] = F.coalesce(here, carried)
    kept = [c for c in df.columns if c not in out]
    return joined.select(*kept, *[v.alias(k) for k, v in out.items()])


def runs(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    id_col: str,
    joins_previous,
    carried: Sequence[str],
    name: str = "run_id",
    grain: str = GRAIN,
) -> DataFrame:
    """Label gap-free runs: ``name`` is the id of the first row of the run.

    ``joins_previous(prev, row)`` takes two functions from column name to
    column and says whether a row continues the run of the row just before
    it; ``carried`` lists the columns it reads. Same slicing as ``along``, one
    pass: whether the first row of a slice continues a run is settled on the
    slice summary.
    """
    keys = list(keys)
    sliced = with_slice(df, order[0], grain)
    position = F.struct(*[F.col(c) for c in order])
    in_slice = Window.partitionBy(*keys, SLICE).orderBy(*[F.col(c).asc_nulls_last() for c in order])
    upto = in_slice.rowsBetween(Window.unboundedPreceding, 0)

    # Column by column: a struct of them would go through the shuffle beside them.
    local = sliced.withColumns(
        {"_pos": F.row_number().over(in_slice), **{f"_prev_{c}": F.lag(c).over(in_slice) for c in carried}}
    )
    continues = F.coalesce(joins_previous(lambda c: F.col(f"_prev_{c}"), F.col), F.lit(False))
    # Runs that begin inside the slice; the slice's first row is left open.
    local = local.withColumn(
        "_start", F.when((F.col("_pos") > 1) & ~continues, F.col(id_col))
    ).withColumn("_open", F.last("_start", ignorenulls=True).over(upto))

    # Taken from the rows as they lie for the windows: no shuffle of their own, and
    # where ``carried`` names all columns, one shuffle serves both uses of the rows.
    slices = local.groupBy(*keys, SLICE).agg(
        F.min_by(F.struct(id_col, *[c for c in carried if c != id_col]), position).alias("_first"),
        F.max_by(F.struct(*carried), position).alias("_last"),
        F.max_by("_start", F.when(F.col("_start").isNotNull(), position)).alias("_last_start"),
    )
    by_key = Window.partitionBy(*keys).orderBy(SLICE)
    slices = slices.withColumn("_before", F.lag("_last").over(by_key))
    opens = ~F.coalesce(joins_previous(lambda c: F.col("_before")[c], lambda c: F.col("_first")[c]), F.lit(False))
    slices = (
        slices.withColumn("_first_start", F.when(opens, F.col("_first")[id_col]))
        .withColumn("_left_over", F.coalesce("_last_start", "_first_start"))
        .withColumn(
            "_incoming",
            F.last("_left_over", ignorenulls=True).over(by_key.rowsBetween(Window.unboundedPreceding, -1)),
        )
        .withColumn("_head", F.coalesce("_first_start", "_incoming"))
        .select(*keys, SLICE, "_head")
    )
    return local.join(slices, [*keys, SLICE]).select(
        *df.columns, F.coalesce("_open", "_head").alias(name)
    )
