"""Ordered neighbours within a customer: one sorted scan, whatever the customers' sizes.

Rows are range-partitioned and sorted by customer, date, rental and category, so a
customer with most of the rows, even at one timestamp, is spread over as many
partitions as its rows need. Each task reads its partition once, in order, and compares
every row with the one before. What it cannot compare is its first row: the first and
last row of every partition (its edges) come out beside the results, and neighbouring
edges are compared afterwards. The last rows of each customer in a partition come out
as well; which of a customer's are the last of all is seen by comparing them. The scan works on columns of Arrow batches in numpy, as
a window would have to gather a customer, or a slice of one, in one task.

As the rows are in order of customers, the scan can also add up their measures by category.
Those of a partition's first and last customer may go on in its neighbours and are added up
with theirs afterwards; all others are whole, so the measures are not shuffled again.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rentlens.functions.scalar import DAY_US, wall_clock_us

ORDER = ["customer_id", "rental_date", "rental_id", "category"]
GAP, STEP, FIRST, LAST, TAIL, MEASURES = range(6)
SCAN = (
    "kind int, customer_id long, gap_days long, category string, next_category string, "
    "count long, place int, at_us long, rental_id long, inventory_id long"
)
_GROUP = ["customer_id", "category"]
_DATES = {"first_date": "min", "last_date": "max"}
_TAIL = ["customer_id", "at_us", "rental_id", "category", "inventory_id"]
_NO_ID = np.iinfo(np.int64).min
_FIELDS = [x.split()[0] for x in SCAN.split(", ")]
_KINDS = [{"int": pa.int32(), "long": pa.int64(), "string": pa.string()}[x.split()[1]] for x in SCAN.split(", ")]


def _array(values, kind: pa.DataType) -> pa.Array:
    return values.cast(kind) if isinstance(values, pa.Array) else pa.array(values, kind)


def _rows(kind: int, n: int, **columns) -> pa.RecordBatch:
    columns["kind"] = np.full(n, kind)
    return pa.RecordBatch.from_arrays(
        [_array(columns[f], k) if f in columns else pa.nulls(n, k) for f, k in zip(_FIELDS, _KINDS, strict=True)],
        _FIELDS,
    )


def _folded(rows: pa.Table) -> pa.Table:
    """One row for each customer and category."""
    how = {c: _DATES.get(c, "sum") for c in rows.column_names if c not in _GROUP}
    found = rows.group_by(_GROUP, use_threads=False).aggregate(list(how.items()))
    return found.select([*_GROUP, *(f"{c}_{f}" for c, f in how.items())]).rename_columns([*_GROUP, *how]).cast(rows.schema)


def _measured(batches: Iterator[pa.RecordBatch], sums: list[str]) -> Iterator[pa.RecordBatch]:
    """What _scan tells of a sorted partition, and the measures; those of its first and last customer are not whole yet."""
    going: pa.Table | None = None
    first = None

    def told(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        for batch in rows.combine_chunks().to_batches():
            base = _rows(MEASURES, len(batch), **{c: batch.column(c) for c in _GROUP})
            whole = pc.not_equal(batch.column("customer_id"), first)
            yield pa.RecordBatch.from_arrays([*base.columns, whole, *batch.columns[len(_GROUP) :]], [*base.schema.names, "whole", *batch.schema.names[len(_GROUP) :]])

    def passed() -> Iterator[pa.RecordBatch]:
        nonlocal going, first
        for batch in batches:
            if len(batch):
                rows = pa.Table.from_batches([batch])
                for name in _DATES:
                    rows = rows.append_column(name, batch.column("rental_date"))
                rows = _folded(rows.select([*_GROUP, *sums, *_DATES]))
                rows = rows if going is None else _folded(pa.concat_tables([going, rows]))
                first = batch.column("customer_id")[0] if first is None else first
                last = pc.equal(rows.column("customer_id"), batch.column("customer_id")[-1])
                done, going = rows.filter(pc.invert(last)), rows.filter(last)
                waiting.extend(told(done))
                kinds[:] = [*rows.schema][len(_GROUP) :]
            yield batch

    waiting: list[pa.RecordBatch] = []
    kinds: list[pa.Field] = []
    for part in _scan(passed()):
        blank = [pa.nulls(len(part), k) for k in (pa.bool_(), *(f.type for f in kinds))]
        yield pa.RecordBatch.from_arrays([*part.columns, *blank], [*part.schema.names, "whole", *(f.name for f in kinds)])
        yield from waiting
        waiting.clear()
    yield from waiting
    if going is not None:
        first = going.column("customer_id")[0]
        yield from told(going)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Gaps and last rows per customer, steps per category pair, and the edges of one sorted partition."""
    place = TaskContext.get().partitionId()
    names: dict[str | None, int] = {}
    steps: Counter[tuple[int, int]] = Counter()
    last: tuple | None = None
    tail: pa.Table | None = None
    for batch in batches:
        if not len(batch):
            continue
        done, tail = _tails(batch, tail)
        if done is not None:
            yield from _tail_rows(done)
        customer, at = (batch.column(c).to_numpy() for c in ("customer_id", "at_us"))
        extra = batch.column("n_rows").to_numpy() - 1
        coded = batch.column("category").dictionary_encode()
        known = np.array([names.setdefault(x, len(names)) for x in coded.dictionary.to_pylist()] + [names.setdefault(None, len(names))], np.int64)
        code = known[coded.indices.fill_null(len(known) - 1).to_numpy()]
        # A row that stands for n joined rows steps n - 1 times to its own category.
        own = np.bincount(code, extra, len(names))
        steps.update({(int(k), int(k)): int(own[k]) for k in np.flatnonzero(own)})
        if last is None:
            yield _rows(FIRST, 1, customer_id=customer[:1], at_us=at[:1], category=[coded[0].as_py()], place=[place])
        else:
            customer, at, code = (np.concatenate([[x], y]) for x, y in zip(last, (customer, at, code), strict=True))
        last = customer[-1], at[-1], code[-1]
        same = np.flatnonzero(customer[1:] == customer[:-1])
        pairs, n = np.unique(code[same] * len(names) + code[same + 1], return_counts=True)
        steps.update({(int(p) // len(names), int(p) % len(names)): int(k) for p, k in zip(pairs, n, strict=True)})
        days = (at[same + 1] - at[same]) // DAY_US
        same, days = same[days > 0], days[days > 0]
        if len(same):
            starts = np.flatnonzero(np.concatenate([[True], customer[same][1:] != customer[same][:-1]]))
            yield _rows(GAP, len(starts), customer_id=customer[same][starts], gap_days=np.add.reduceat(days, starts))
    if last is not None:
        back = list(names)
        yield _rows(STEP, len(steps), category=[back[a] for a, _ in steps], next_category=[back[b] for _, b in steps], count=list(steps.values()))
        yield _rows(LAST, 1, customer_id=[last[0]], at_us=[last[1]], category=[back[last[2]]], place=[place])
        yield from _tail_rows(tail)


def _tails(batch: pa.RecordBatch, before: pa.Table | None) -> tuple[pa.Table | None, pa.Table]:
    """The last rows of customers that end in a sorted batch, and those of the one that may go on.

    Rows that are equal in the order are not ordered among themselves, so all of them are last.
    """
    rows = pa.Table.from_batches([batch]).select(_TAIL)
    rows = (rows if before is None else pa.concat_tables([before, rows])).combine_chunks()
    customer = rows.column("customer_id").to_numpy()
    coded = rows.column("category").combine_chunks().dictionary_encode().indices.fill_null(-1)
    keys = [customer, rows.column("at_us").to_numpy(), rows.column("rental_id").fill_null(_NO_ID).to_numpy(), coded.to_numpy()]
    fresh = np.flatnonzero(np.concatenate([[True], np.any([k[1:] != k[:-1] for k in keys], axis=0)]))
    sizes = np.diff(np.append(fresh, len(customer)))
    ends = np.append(customer[fresh][1:] != customer[fresh][:-1], True)
    at = np.flatnonzero(np.repeat(ends, sizes))
    closed = at[customer[at] != customer[-1]]
    # Equal rows say the same, whatever their number.
    going = rows.take(at[customer[at] == customer[-1]]).group_by(_TAIL).aggregate([]).select(_TAIL).cast(rows.schema)
    return (rows.take(closed) if len(closed) else None), going


def _tail_rows(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    for batch in rows.combine_chunks().to_batches():
        yield _rows(TAIL, len(batch), **{c: batch.column(c) for c in _TAIL})


def neighbour_scan(rows: DataFrame, sums: dict[str, Column] | None = None) -> DataFrame:
    """What neighbouring rows say, as rows of SCAN; store it, as two summaries read it.

    ``rows`` needs customer_id, rental_date, rental_id, category and n_rows; its
    inventory_id, if there, is told of the last rows. With ``sums``, names of measures and
    what a row adds to them, ``category_measures`` reads their sums from the result.
    """
    copy = F.col("inventory_id") if "inventory_id" in rows.columns else F.lit(None)
    ordered = rows.withColumn("inventory_id", copy.cast("long"))
    ordered = (ordered if sums else ordered.select(*ORDER, "n_rows", "inventory_id")).repartitionByRange(*ORDER).sortWithinPartitions(*ORDER)
    told = [
        "customer_id", wall_clock_us("rental_date").alias("at_us"), "category", "n_rows",
        F.col("rental_id").cast("long").alias("rental_id"), "inventory_id",
    ]
    if not sums:
        return ordered.select(*told).mapInArrow(_scan, SCAN)
    given = ordered.select(*told, "rental_date", *[c.alias(name) for name, c in sums.items()])
    kinds = {f.name: f.dataType.simpleString() for f in given.schema.fields}
    more = [f"{name} {kinds[name]}" for name in sums] + [f"{name} {kinds['rental_date']}" for name in _DATES]
    names = list(sums)
    return given.mapInArrow(lambda batches: _measured(batches, names), ", ".join([SCAN, "whole boolean", *more]))


def category_measures(scan: DataFrame) -> DataFrame:
    """customer_id, category, and the sums, first_date and last_date of each, from a scan with measures."""
    rows = scan.where(F.col("kind") == MEASURES)
    sums = [c for c in scan.columns[len(_FIELDS) + 1 :] if c not in _DATES]
    kinds = {f.name: f.dataType for f in scan.schema.fields}
    split = rows.where(~F.col("whole")).groupBy(*_GROUP).agg(
        *[F.sum(c).cast(kinds[c]).alias(c) for c in sums], F.min("first_date").alias("first_date"), F.max("last_date").alias("last_date")
    )
    return rows.where(F.col("whole")).select(*split.columns).unionByName(split)


def scanned_customers(scan: DataFrame) -> DataFrame:
    """The customers with rows."""
    return scan.where(F.col("kind") == TAIL).select("customer_id").distinct()


def last_rows(scan: DataFrame) -> DataFrame:
    """customer_id, at_us, rental_id, category and inventory_id of rows, among them the last of each customer."""
    return scan.where(F.col("kind") == TAIL).select(*_TAIL)


def _stitched(scan: DataFrame) -> DataFrame:
    """The scan with the results of neighbouring edges, two rows a partition, which the driver compares."""
    edges = scan.where(F.col("kind").isin(FIRST, LAST)).select("place", "kind", "customer_id", "at_us", "category").collect()
    edges.sort(key=lambda e: (e["place"], e["kind"]))
    found = []
    for before, after in zip(edges[1::2], edges[2::2]):
        if before["customer_id"] == after["customer_id"]:
            days = (after["at_us"] - before["at_us"]) // DAY_US
            found.append((GAP, before["customer_id"], days, None, None, None))
            found.append((STEP, None, None, before["category"], after["category"], 1))
    names = ["kind", "customer_id", "gap_days", "category", "next_category", "count"]
    kinds = dict(x.split() for x in SCAN.split(", "))
    more = scan.sparkSession.createDataFrame(found, ", ".join(f"{n} {kinds[n]}" for n in names))
    return scan.where(F.col("kind").isin(GAP, STEP)).select(*names).unionByName(more)


def rental_gaps(scan: DataFrame) -> DataFrame:
    """Per customer the sum of whole-day gaps between consecutive rentals, where it is above 0.

    Rows that share a timestamp are 0 days apart, so their multiplicity does not change the sum.
    """
    return _stitched(scan).where(F.col("kind") == GAP).groupBy("customer_id").agg(F.sum("gap_days").alias("gap_days"))


def category_steps(scan: DataFrame) -> DataFrame:
    """Counts of (category, next_category) over consecutive fact rows."""
    steps = _stitched(scan).where((F.col("kind") == STEP) & F.col("next_category").isNotNull())
    return steps.groupBy("category", "next_category").agg(F.sum("count").alias("count")).where("count > 0")
