"""Time-ordered target encoding: counts and hits of a value's past in other folds, by prefix sums of fold vectors.

Rows carry a time, a fold, a count and hits, and a value in each encoded column.
Every (column, value, time, row) is an entry; entries are sorted in ranges and
each range is read in chunks, so a chunk has a bounded size wherever a value, a
time or a sale is hot.  In a chunk the entries of one value and time are pivoted into one vector with a
count and hits for each fold; a prefix scan adds the vectors of a value up, and
an entry takes the total less its own fold's part at its latest strictly
earlier vector.  A chunk also tells what its last value came to, so what the
first value of a chunk missed is a prefix sum over those short rows: a tree of
windows of ``FAN`` rows at most.  No task, broadcast or driver sees anything
that grows with the input: the driver knows counts, and the bounds of at most
``RANGES`` ranges from a sample of fixed size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .resampling import CRC_SQL

#: Entries of a chunk, and most rows of a window of the tree above the chunks.
CHUNK, FAN = 250_000, 1024
#: Most ranges of the sort, and rows sampled for their bounds (Spark takes three times as many).
RANGES = SAMPLED = 8192
#: Chunks of a range are numbered by so many low bits.
PIECE_BITS = 20
FOLDS = 5
#: Prior rate of all history in millionths, its weight in rows, and fewest rows of a rate of one's own.
PRIOR, WEIGHT, LEAST = 500_000, 50, 1
KEY = ("col", "str", "num")
_EDGE = ", ".join(f"{side}_{name} {kind}" for side in ("first", "last") for name, kind in (("col", "int"), ("str", "string"), ("num", "long"), ("t", "long")))


def micros(rows: DataFrame, name: str) -> Column:
    """Microseconds since 1970 of a time with or without a zone."""
    at = F.col(f"`{name}`")
    if not isinstance(rows.schema[name].dataType, T.TimestampNTZType):
        return F.unix_micros(at.cast("timestamp"))
    minutes = (F.unix_date(at.cast("date")).cast("long") * 24 + F.hour(at)) * 60 + F.minute(at)
    return minutes * 60_000_000 + (F.extract(F.lit("SECOND"), at) * 1_000_000).cast("long")


def _entries(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One row for each row and column.  Whole numbers stay numbers, anything else is a text; null is a value of its own."""
    listed = []
    for k, c in enumerate(columns):
        value, whole = F.col(f"`{c}`"), isinstance(rows.schema[c].dataType, T.IntegralType)
        text = F.lit("") if whole else F.concat(F.lit("v"), value.cast("string"))
        number = F.coalesce(value.cast("long"), F.lit(0)) if whole else F.lit(0)
        listed.append(F.struct(F.lit(k).alias("col"), F.when(value.isNull(), F.lit("null")).otherwise(text).alias("str"), number.cast("long").alias("num")))
    return rows.select("id", "t", "fold", "n", "s", F.explode(F.array(*listed)).alias("e")).select("e.*", "t", "id", "fold", "n", "s")


def _changes(table: pa.Table, names: tuple[str, ...]) -> np.ndarray:
    """True at rows that differ from the row before in one of the columns, and at the first."""
    out = np.ones(table.num_rows, dtype=bool)
    if table.num_rows > 1:
        out[1:] = False
        for name in names:
            values = table[name].combine_chunks()
            out[1:] |= pc.not_equal(values[1:], values[:-1]).to_numpy(zero_copy_only=False)
    return out


def _scan(table: pa.Table, chunk: int, folds: int) -> Iterator[pa.RecordBatch]:
    """A chunk's entries with counts and hits before them in the chunk, and a last row that tells its edges."""
    size = table.num_rows
    new_value = _changes(table, KEY)
    new_time = new_value | _changes(table, ("t",))
    starts, at = np.flatnonzero(new_time), np.cumsum(new_time) - 1  # an entry's key-time
    fold = table["fold"].to_numpy()
    vectors = np.empty((len(starts), 2 * folds), dtype=np.int64)
    for k, name in enumerate(("n", "s")):
        values = table[name].to_numpy()
        for f in range(folds):
            vectors[:, k * folds + f] = np.add.reduceat(np.where(fold == f, values, 0), starts)
    before = np.cumsum(vectors, axis=0) - vectors
    value = np.cumsum(new_value[starts]) - 1  # a key-time's value
    before -= before[np.flatnonzero(new_value[starts])][value]
    found = [before[at, k * folds : (k + 1) * folds].sum(axis=1) - before[at, k * folds + fold] for k in range(2)]
    open_ = np.where(value[at] > 0, 0, np.where(at == 0, 1, 2)).astype(np.int32)
    nulls = lambda kind: pa.nulls(size, kind)
    edge_type, list_type = pa.struct([pa.field(f"{s}_{c}", k) for s in ("first", "last") for c, k in (("col", pa.int32()), ("str", pa.string()), ("num", pa.int64()), ("t", pa.int64()))]), pa.list_(pa.int64())
    names = ["chunk", "open", "id", "col", "fold", "n", "s", "edge", "earlier", "latest"]
    main = [pa.array(np.full(size, chunk, dtype=np.int64)), pa.array(open_), table["id"].combine_chunks(), table["col"].combine_chunks(), table["fold"].combine_chunks(), pa.array(found[0]), pa.array(found[1]), nulls(edge_type), nulls(list_type), nulls(list_type)]
    edge = {f"{side}_{c}": table[c][k].as_py() for side, k in (("first", 0), ("last", size - 1)) for c in (*KEY, "t")}
    last = [pa.array([chunk], pa.int64()), pa.array([-1], pa.int32()), *[pa.nulls(1, x.type) for x in main[2:7]], pa.array([edge], edge_type), pa.array([before[-1].tolist()], list_type), pa.array([vectors[-1].tolist()], list_type)]
    for arrays in (main, last):
        yield pa.RecordBatch.from_arrays(arrays, names)


def prefix_sums(rows: DataFrame, sums: list[str], top: int, fan: int = FAN) -> DataFrame:
    """``rows`` (group, seq, ``sums``) with each of ``sums`` over the rows of the group with smaller ``seq``, which is under ``top``.

    Beyond ``fan`` the sums of blocks of ``fan`` numbers are added up in the same
    way, so no window has more than ``fan`` rows.
    """
    if top <= fan:
        own = W.partitionBy("group").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
        return rows.select("group", "seq", *[F.coalesce(F.sum(c).over(own), F.lit(0)).alias(c) for c in sums])
    rows = rows.withColumn("block", F.floor(F.col("seq") / fan))
    own = W.partitionBy("group", "block").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    inside = rows.select("group", "block", "seq", *[F.coalesce(F.sum(c).over(own), F.lit(0)).alias(c) for c in sums])
    blocks = rows.groupBy("group", "block").agg(*[F.sum(c).alias(c) for c in sums]).withColumnRenamed("block", "seq")
    above = prefix_sums(blocks, sums, top // fan + 1, fan).select(F.col("group").alias("_g"), F.col("seq").alias("_b"), *[F.col(c).alias(f"_{c}") for c in sums])
    return inside.join(above, F.col("group").eqNullSafe(F.col("_g")) & (F.col("block") == F.col("_b"))).select("group", "seq", *[(F.col(c) + F.col(f"_{c}")).alias(c) for c in sums])


def _carried(scanned: DataFrame, folds: int, fan: int) -> DataFrame:
    """For each chunk, counts and hits of other folds that its first value has in the chunks before: with the chunk's first time, and without."""
    edges = scanned.where("edge IS NOT NULL").select("chunk", "edge.*", "earlier", "latest")
    low = F.col("chunk").bitwiseAND((1 << PIECE_BITS) - 1)
    ranges, pieces = (x + 1 if x is not None else 1 for x in edges.agg(F.max(F.shiftright("chunk", PIECE_BITS)), F.max(low)).first())
    edges = edges.withColumn("place", F.shiftright("chunk", PIECE_BITS) * pieces + low)
    sums = [f"v{k}" for k in range(2 * folds)]
    group = lambda side, tie: F.struct(F.lit(tie).alias("tie"), *[F.col(f"{side}_{c}").alias(c) for c in KEY], (F.col(f"{side}_t") if tie else F.lit(None).cast("long")).alias("t")).alias("group")
    parts = []
    for tie in (False, True):
        given = [(F.col("latest")[k] + (F.lit(0) if tie else F.col("earlier")[k])).alias(v) for k, v in enumerate(sums)]
        parts.append(edges.select(group("last", tie), (2 * F.col("place") + 1).alias("seq"), *given))
        parts.append(edges.select(group("first", tie), (2 * F.col("place")).alias("seq"), *[F.lit(0).cast("long").alias(v) for v in sums]))
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    place = F.shiftright("seq", 1)
    chunk = F.shiftleft(F.floor(place / pieces), PIECE_BITS) + place % pieces
    found = prefix_sums(rows, sums, 2 * ranges * pieces, fan).where("seq % 2 = 0").select(chunk.alias("chunk"), F.col("group.tie").alias("tie"), *sums)
    both = found.groupBy("chunk").agg(*[F.sum(F.when(~F.col("tie"), F.col(v))).alias(f"a{v}") for v in sums], *[F.sum(F.when(F.col("tie"), F.col(v))).alias(f"b{v}") for v in sums])

    def others(kind: int, tied: bool) -> Column:
        own = [F.col(f"av{kind * folds + f}") - (F.col(f"bv{kind * folds + f}") if tied else F.lit(0)) for f in range(folds)]
        total = own[0]
        for x in own[1:]:
            total = total + x
        return F.array(*[total - x for x in own])

    # a row for each chunk; Spark broadcasts it only under its size limit
    return common.written(both.select(F.col("chunk").alias("_chunk"), others(0, False).alias("n_all"), others(1, False).alias("s_all"), others(0, True).alias("n_tied"), others(1, True).alias("s_tied")), "carried")


def histories(rows: DataFrame, columns: list[str], folds: int = FOLDS, chunk: int = CHUNK, fan: int = FAN) -> DataFrame:
    """``rows`` with ``<column>_n`` and ``<column>_s``: counts and hits of the earlier rows of other folds with the same value.

    ``rows`` have a unique ``id``, a time ``t``, a ``fold`` from 0, a count ``n``
    and hits ``s``, all whole numbers that aren't null, and should be a written
    frame, since they are read several times.  Null is a value like any other.
    """
    entries = _entries(rows, columns)
    spark = rows.sparkSession
    ranges = min(RANGES, common.parts(spark, rows.count() * len(columns), chunk))
    order = [*KEY, "t", "id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, held = TaskContext.get().partitionId() << PIECE_BITS, []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= chunk:
                yield from _scan(pa.Table.from_batches(held), own, folds)
                own, held = own + 1, []
        if sum(b.num_rows for b in held):
            yield from _scan(pa.Table.from_batches(held), own, folds)

    schema = f"chunk long, open int, id long, col int, fold int, n long, s long, edge struct<{_EDGE.replace(' int', ':int').replace(' string', ':string').replace(' long', ':long')}>, earlier array<long>, latest array<long>"
    setting = "spark.sql.execution.rangeExchange.sampleSizePerPartition"
    before = spark.conf.get(setting, None)
    spark.conf.set(setting, str(max(1, SAMPLED // ranges)))
    try:
        scanned = common.written(common.mapped(entries.repartitionByRange(ranges, *order).sortWithinPartitions(*order), run, schema), "scanned")
    finally:
        spark.conf.set(setting, before) if before else spark.conf.unset(setting)
    carried = _carried(scanned, folds, fan)
    main = scanned.where("edge IS NULL").select("chunk", "open", "id", "col", "fold", "n", "s").join(carried, F.col("chunk") == F.col("_chunk"), "left")
    more = lambda k: F.when(F.col("open") == 1, F.get(f"{k}_tied", "fold")).when(F.col("open") == 2, F.get(f"{k}_all", "fold")).otherwise(F.lit(0))
    main = main.select("id", "col", (F.col("n") + more("n")).alias("n"), (F.col("s") + more("s")).alias("s"))
    each = [F.sum(F.when(F.col("col") == k, F.col(v))).alias(f"{c}_{v}") for k, c in enumerate(columns) for v in ("n", "s")]
    found = main.groupBy("id").agg(*each).withColumnRenamed("id", "_found")
    return rows.join(found, F.col("id") == F.col("_found")).drop("_found")


def rate(n: str, s: str, prior: str, weight: int = WEIGHT, least: int = LEAST) -> Column:
    """Millionths of hits, drawn to ``prior`` (an SQL expression) as ``weight`` rows would; the prior itself under ``least`` rows."""
    return F.expr(f"CASE WHEN `{n}` < {least} THEN {prior} ELSE (1000000 * `{s}` + {weight} * {prior}) DIV (`{n}` + {weight}) END")


def _smallest(rows: DataFrame, key: str, value: str) -> DataFrame:
    """One row an id: its smallest value that isn't null."""
    return common.written(rows.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_id")).agg(F.min(value).alias(value)), value)


def encoded(lines: DataFrame, sales: DataFrame, items: DataFrame, vendors: DataFrame, clients: DataFrame, folds: int = FOLDS, chunk: int = CHUNK, fan: int = FAN) -> DataFrame:
    """Per ``sale_id``, ``item_id`` and ``vendor_id``: lines, returned ones, and the rates of item, vendor and client before the sale.

    Lines without a sale or a time of sale don't count; repeated lines count each.
    Null items and clients are the id -1.  A null vendor is a value like any
    other, and so is the kind, nation or segment of what has none.  Folds come
    from the sale's number, so a sale never sees itself, and sales of one moment
    don't see each other.  A sale number that stands in several rows of ``sales``
    gives a row for each.  An id that repeats in ``items``, ``vendors`` or
    ``clients`` counts with its smallest value.  Other columns play no part.
    Empty tables give an empty result.
    """
    own = lines.select("sale_id", F.coalesce("item_id", F.lit(-1)).cast("long").alias("item_id"), F.col("vendor_id").cast("long").alias("vendor_id"), (F.col("flag") == "returned").alias("hit"))
    groups = own.where("sale_id IS NOT NULL").groupBy("sale_id", "item_id", "vendor_id").agg(F.count("*").alias("n"), F.coalesce(F.sum(F.when(F.col("hit"), 1)), F.lit(0)).cast("long").alias("s"))
    groups = common.written(groups, "groups")
    fold = (F.crc32(F.encode(F.col("sale_id").cast("string"), "UTF-8")) % folds).cast("int")
    sold = sales.where("sale_id IS NOT NULL AND sold_at IS NOT NULL").select("sale_id", F.coalesce("client_id", F.lit(-1)).cast("long").alias("client_id"), micros(sales, "sold_at").alias("t"), fold.alias("fold"))
    totals = groups.groupBy("sale_id").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).withColumnRenamed("sale_id", "_sale")
    sold = sold.join(_smallest(clients, "client_id", "segment"), F.col("client_id") == F.col("_id"), "left").drop("_id")
    sold = sold.join(totals, F.col("sale_id") == F.col("_sale")).drop("_sale")
    sold = common.written(sold.withColumn("all", F.lit(0)).withColumn("id", F.monotonically_increasing_id()), "sold")
    sold = histories(sold, ["all", "segment", "client_id"], folds, chunk, fan)
    sold = sold.withColumn("p", rate("all_n", "all_s", str(PRIOR))).withColumn("q", rate("segment_n", "segment_s", "p"))
    sold = sold.select(F.col("sale_id").alias("_sale"), "t", "fold", "p", F.col("client_id_n").alias("client_n"), rate("client_id_n", "client_id_s", "q").alias("client_rate"))
    rows = common.again(groups).join(sold, F.col("sale_id") == F.col("_sale")).drop("_sale")
    rows = rows.join(_smallest(items, "item_id", "kind"), F.col("item_id") == F.col("_id"), "left").drop("_id")
    rows = rows.join(_smallest(vendors, "vendor_id", "nation_id"), F.col("vendor_id") == F.col("_id"), "left").drop("_id")
    rows = common.written(rows.withColumn("id", F.monotonically_increasing_id()), "lines")
    rows = histories(rows, ["kind", "nation_id", "item_id", "vendor_id"], folds, chunk, fan)
    rows = rows.withColumn("kind_rate", rate("kind_n", "kind_s", "p")).withColumn("nation_rate", rate("nation_id_n", "nation_id_s", "p"))
    return rows.select("sale_id", "item_id", "vendor_id", F.col("n").alias("n_lines"), F.col("s").alias("n_returned"), F.col("item_id_n").alias("item_n"), rate("item_id_n", "item_id_s", "kind_rate").alias("item_rate"), F.col("vendor_id_n").alias("vendor_n"), rate("vendor_id_n", "vendor_id_s", "nation_rate").alias("vendor_rate"), "client_n", "client_rate")


def query(spark, sf_dir: str) -> DataFrame:
    """op12: the lines of all sales by item, vendor and client before them."""
    return encoded(*[common.table(spark, sf_dir, name) for name in ("sale_lines", "sales", "items", "vendors", "clients")])


def _history_sql(name: str, value: str) -> str:
    """Counts and hits by a value: those of all folds strictly before, less those of the own fold."""
    part = f"{value}, " if value else ""
    window = lambda f: f"OVER (PARTITION BY {part}{f} ORDER BY t RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING)"
    return ", ".join(f"coalesce(sum({v}) {window('1')}, 0)::BIGINT - coalesce(sum({v}) {window('fold')}, 0)::BIGINT AS {name}_{v}" for v in ("n", "s"))


def _rate_sql(name: str, prior: str) -> str:
    return f"CASE WHEN {name}_n < {LEAST} THEN {prior} ELSE (1000000 * {name}_s + {WEIGHT} * {prior}) // ({name}_n + {WEIGHT}) END"


ORACLE_SQL = f"""
WITH RECURSIVE crc_inputs AS (SELECT DISTINCT CAST(sale_id AS VARCHAR) AS x FROM sales WHERE sale_id IS NOT NULL),
    {CRC_SQL},
    i AS (SELECT item_id, min(kind) AS kind FROM items GROUP BY 1), v AS (SELECT vendor_id, min(nation_id) AS nation_id FROM vendors GROUP BY 1),
    c AS (SELECT client_id, min(segment) AS segment FROM clients GROUP BY 1),
    g AS (SELECT sale_id, coalesce(item_id, -1) AS item_id, vendor_id, count(*) AS n, count(*) FILTER (WHERE flag = 'returned') AS s FROM sale_lines GROUP BY ALL),
    j AS (SELECT g.*, coalesce(sales.client_id, -1) AS client_id, sold_at AS t, crc % {FOLDS} AS fold
        FROM g JOIN sales USING (sale_id) JOIN crc ON x = CAST(sale_id AS VARCHAR) WHERE sold_at IS NOT NULL),
    d AS (SELECT j.*, kind, nation_id, segment FROM j LEFT JOIN i USING (item_id) LEFT JOIN v USING (vendor_id) LEFT JOIN c USING (client_id)),
    h AS (SELECT *, {_history_sql("a", "")}, {_history_sql("kind", "kind")}, {_history_sql("nation", "nation_id")}, {_history_sql("segment", "segment")},
        {_history_sql("item", "item_id")}, {_history_sql("vendor", "vendor_id")}, {_history_sql("client", "client_id")} FROM d),
    p AS (SELECT *, {_rate_sql("a", str(PRIOR))} AS p FROM h),
    q AS (SELECT *, {_rate_sql("kind", "p")} AS pk, {_rate_sql("nation", "p")} AS pn, {_rate_sql("segment", "p")} AS ps FROM p)
SELECT sale_id, item_id, vendor_id, n AS n_lines, s AS n_returned, item_n, {_rate_sql("item", "pk")} AS item_rate,
    vendor_n, {_rate_sql("vendor", "pn")} AS vendor_rate, client_n, {_rate_sql("client", "ps")} AS client_rate FROM q
"""
