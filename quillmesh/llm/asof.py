"""Operator 12, tolerant as-of join by a range partition of both sides' union, two scans and a prefix scan between them.

Rows of both sides are dealt by ranges of (key, time, side, preference), so a hot key, or a hot time of one key, is spread
over as many partitions as its rows need; right rows that are equal in all of this are spread by a salt. Each sorted
partition is scanned once in batches with one open group in hand (the last key and time of the right side, its preferred
row, how many rows it has); the left rows get what the partition itself tells, and its last group is the partition's
summary. A prefix scan over the summaries, in blocks of BLOCK partitions and blocks of blocks, gives what is carried into
each partition. The second scan takes the carry in: a left row whose key had no right row in its partition yet takes it if
it has the row's key, and a group that began in an earlier partition takes its count and preferred row from it.

No task, broadcast or driver holds more than a partition of the ranges, BLOCK summaries, or one summary of each partition
(behind a checked bound; beyond it that join shuffles).

Edge cases: a null key or time never matches; equal times match, the right row counts as the earlier one; among equal times
the smaller preference columns win, nulls losing, in order; repeated right rows count each in n_tied; repeated left rows stay
(op12 drops copies by click_id; of copies that differ the one with client and time, then the earliest, then the smallest
client stays, and clicks without an id are copies of each other); empty sides give unmatched rows or none; other columns
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmesh.llm.common import few, small_batches, stash, table

#: Summaries that one task scans.
BLOCK = 256
#: Summaries (some 60 bytes each) that may be broadcast; beyond that the same join shuffles.
BROADCAST_ROWS = 65_536
TOLERANCE = 72 * 3_600_000_000
DAY = 24 * 3_600_000_000


def micros(df: DataFrame, name: str) -> Column:
    """Microseconds since 1970 (UTC) of a time, whatever the session's zone; one without a zone is taken as UTC."""
    at = F.col(f"`{name}`")
    if dict(df.dtypes)[name] != "timestamp_ntz":
        return F.unix_micros(at.cast("timestamp"))
    clock = (F.hour(at) * 3600 + F.minute(at) * 60).cast("long")
    return F.unix_date(at.cast("date")) * F.lit(DAY) + clock * F.lit(1_000_000) + (F.expr(f"extract(SECOND FROM `{name}`)") * 1_000_000).cast("long")


def _scanned(rows: DataFrame) -> DataFrame:
    """The first scan of rows (key, t, right, l, r) in sorted partitions.

    (part, last, key, t, l, m_t, n, m): each left row with the time, number and first row of the latest group of its key in
    the partition; and, with last set, the partition's last group.
    """
    kinds = dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, key, t, n, best, left = TaskContext.get().partitionId(), 0, 0, 0, None, None
        for b in batches:
            k, at, right = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            l, r = b.column(3), b.column(4)
            left = l.type
            best = best if best is not None else pa.nulls(1, r.type)
            o, c = np.flatnonzero(right), np.flatnonzero(~right)
            ko, to = k[o], at[o]
            new = np.ones(len(o), bool)
            new[1:] = (ko[1:] != ko[:-1]) | (to[1:] != to[:-1])
            if len(o) and n:
                new[0] = ko[0] != key or to[0] != t
            group, start = np.cumsum(new), np.flatnonzero(new)
            # Group 0 is the one in hand; the others start in this batch.
            first = np.concatenate([[0], start]).astype(np.int64)
            group_key, group_t = (np.concatenate([[x], y[start]]).astype(np.int64) for x, y in ((key, ko), (t, to)))
            group_row = np.concatenate([[0], 1 + o[start]]).astype(np.int64)
            group_before = np.concatenate([[n], np.zeros(len(start))]).astype(np.int64)
            seen = np.cumsum(right)[c].astype(np.int64)
            g = np.concatenate([[0], group])[seen].astype(np.int64)
            count = group_before[g] + seen - first[g]
            none = (count == 0) | (group_key[g] != k[c])
            if len(c):
                held = pa.concat_arrays([best, r]).take(pa.array(group_row[g], mask=none))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(c), part), pa.int32()), pa.array(np.zeros(len(c), bool)), pa.array(k[c]), pa.array(at[c]), l.take(pa.array(c)), pa.array(group_t[g], mask=none), pa.array(count, mask=none), held], names=NAMES)
            if len(o):
                if len(start):
                    key, t, n, best = int(ko[-1]), int(to[-1]), len(o) - int(start[-1]), r.take(pa.array([o[start[-1]]]))
                else:
                    n += len(o)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([True]), pa.array([key]), pa.array([t]), pa.nulls(1, left), pa.array([t]), pa.array([n]), best], names=NAMES)

    return rows.mapInArrow(run, f"part int, last boolean, key long, t long, l {kinds['l']}, m_t long, n long, m {kinds['r']}")


NAMES = ["part", "last", "key", "t", "l", "m_t", "n", "m"]


def _then(a: Column, b: Column) -> Column:
    """The last group of what a and then b summarise: b, with a's count and first row where a's group goes on in b."""
    on = (a["key"] == b["key"]) & (a["t"] == b["t"])
    return F.when(a.isNull(), b).when(b.isNull(), a).when(on, F.struct(b["key"].alias("key"), b["t"].alias("t"), (a["n"] + b["n"]).alias("n"), a["m"].alias("m"))).otherwise(b)


def _carried(last: DataFrame, parts: int) -> DataFrame:
    """(part, carry) for each of the partitions: the last group of all partitions before it, from (part, s) of those that have one."""
    kind = dict(last.dtypes)["s"]
    fold = lambda listed: F.aggregate(listed, F.lit(None).cast(kind), _then)
    every = last.sparkSession.range(parts).select(F.col("id").cast("int").alias("part"))
    every = every.join(last, "part", "left").withColumn("block", F.floor(F.col("part") / BLOCK).cast("int"))
    inside = Window.partitionBy("block").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    inner = every.select("block", "part", fold(F.collect_list("s").over(inside)).alias("inner"))
    blocks = -(-parts // BLOCK)
    if blocks == 1:
        return inner.select("part", F.col("inner").alias("carry"))
    whole = every.groupBy("block").agg(F.array_sort(F.collect_list(F.when(F.col("s").isNotNull(), F.struct("part", "s")))).alias("listed"))
    whole = whole.select(F.col("block").alias("part"), fold(F.transform("listed", lambda x: x["s"])).alias("s")).filter("s IS NOT NULL")
    outer = _carried(stash(whole), blocks).select(F.col("part").alias("block"), F.col("carry").alias("outer"))
    return inner.join(outer, "block").select("part", _then(F.col("outer"), F.col("inner")).alias("carry"))


def asof_join(left: DataFrame, right: DataFrame, prefer: list[str], values: list[str], tolerance: int, key: str = "key", time: str = "t", parts: int | None = None) -> DataFrame:
    """left's columns, and m_t, n_tied and values of the latest row of right that has its key and a time not after its own.

    key and time are longs in both; m_t, n_tied and values are null (n_tied 0) where the latest one is older than tolerance.
    Among rows of right with that time the one with the smallest prefer columns (longs) is taken; n_tied is their number.
    """
    spark = left.sparkSession
    small_batches(spark)
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    own, here = F.struct(*[F.col(f"`{c}`") for c in left.columns]), F.col(key).isNotNull() & F.col(time).isNotNull()
    got = F.struct(*[F.col(f"`{c}`") for c in values])
    kinds = {"l": left.select(own.alias("x")).dtypes[0][1], "r": right.select(got.alias("x")).dtypes[0][1]}
    prefs = [f"p{i}" for i in range(len(prefer))]
    a = left.filter(here).select(F.col(key).alias("key"), F.col(time).alias("t"), F.lit(False).alias("right"), own.alias("l"), F.lit(None).cast(kinds["r"]).alias("r"), *[F.lit(None).cast("long").alias(p) for p in prefs])
    b = right.filter(here).select(F.col(key).alias("key"), F.col(time).alias("t"), F.lit(True).alias("right"), F.lit(None).cast(kinds["l"]).alias("l"), got.alias("r"), *[F.col(f"`{c}`").cast("long").alias(p) for p, c in zip(prefs, prefer, strict=True)])
    order = [F.col("key"), F.col("t"), F.col("right").desc(), *[F.col(p).asc_nulls_last() for p in prefs], F.col("salt")]
    dealt = a.unionByName(b).withColumn("salt", F.rand(17).cast("float")).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    scanned = stash(_scanned(dealt.select("key", "t", "right", "l", "r")))

    last = scanned.filter("last").select("part", F.struct("key", "t", "n", "m").alias("s"))
    carry = stash(_carried(last, parts).filter("carry IS NOT NULL"))
    rows = scanned.filter("NOT last").join(few(carry, BROADCAST_ROWS), "part", "left")
    c, alone = F.col("carry"), F.col("n").isNull()
    same = (c["key"] == F.col("key")) & (alone | (c["t"] == F.col("m_t")))
    found = rows.select("l", "t", F.when(same, c["t"]).otherwise(F.col("m_t")).alias("m_t"), F.when(same, c["n"] + F.coalesce("n", F.lit(0).cast("long"))).otherwise(F.col("n")).alias("n"), F.when(same, c["m"]).otherwise(F.col("m")).alias("m"))
    near = F.col("t") - F.col("m_t") <= F.lit(tolerance)
    out = found.select("l.*", F.when(near, F.col("m_t")).alias("m_t"), F.when(near, F.col("n")).otherwise(F.lit(0)).cast("long").alias("n_tied"), *[F.when(near, F.col(f"m.`{v}`")).alias(v) for v in values])
    rest = left.filter(~here | F.col(key).isNull() | F.col(time).isNull())
    kind = dict(right.dtypes)
    return out.unionByName(rest.select("*", F.lit(None).cast("long").alias("m_t"), F.lit(0).cast("long").alias("n_tied"), *[F.lit(None).cast(kind[v]).alias(v) for v in values]))


def _crc(name: str) -> Column:
    return F.crc32(F.col(name).cast("string"))


def _floored(name: str, at: str) -> Column:
    """The time, floored to days where the crc32 of the id is odd."""
    return F.when(_crc(name) % 2 == 1, F.col(at) - F.pmod(F.col(at), F.lit(DAY))).otherwise(F.col(at))


def clicks_of(df: DataFrame) -> DataFrame:
    """(click_id, client_id, ts_us) of each click once."""
    plain = df.select("click_id", "client_id", micros(df, "ts").alias("at"))
    one = plain.groupBy("click_id").agg(F.min(F.struct((F.col("at").isNull() | F.col("client_id").isNull()).alias("lacking"), F.col("at").isNull().alias("never"), "at", F.col("client_id").isNull().alias("nobody"), "client_id")).alias("c"))
    return one.select("click_id", "c.client_id", "c.at").select("click_id", "client_id", _floored("click_id", "at").alias("ts_us"))


def orders_of(df: DataFrame) -> DataFrame:
    """(client_id, at, sale_id, urgency, total_cents): each sale, and the second one of those that have one; less urgency is preferred."""
    plain = df.select("sale_id", "client_id", F.col("priority").cast("long").alias("priority"), F.floor(F.lit(100) * F.col("total") + F.lit(0.5)).cast("long").alias("total_cents"), micros(df, "sold_at").alias("at"))
    own = F.struct(F.col("sale_id"), F.col("priority"))
    second = F.struct((-1 - F.col("sale_id")).alias("sale_id"), (6 - F.col("priority")).alias("priority"))
    both = plain.select("client_id", "total_cents", _floored("sale_id", "at").alias("at"), F.explode(F.when(_crc("sale_id") % 3 != 0, F.array(own, second)).otherwise(F.array(own))).alias("o"))
    return both.select("client_id", "at", "o.sale_id", (-F.col("o.priority")).alias("urgency"), "total_cents")


def op12_asof_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = clicks_of(table(spark, sf_dir, "clicks")).select("click_id", "client_id", "ts_us", F.col("client_id").cast("long").alias("key"), F.col("ts_us").alias("t"))
    right = orders_of(table(spark, sf_dir, "sales")).withColumn("key", F.col("client_id").cast("long")).withColumn("t", F.col("at"))
    got = asof_join(left, right, ["urgency", "sale_id"], ["sale_id", "total_cents"], TOLERANCE)
    return got.select("click_id", "client_id", "ts_us", "sale_id", (F.col("ts_us") - F.col("m_t")).alias("lag_us"), "total_cents", "n_tied")


OP12_SQL = """
WITH b AS (SELECT list(x ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS x
    FROM (SELECT unnest(range(256)) AS i))),
i AS (SELECT DISTINCT click_id AS id FROM clicks UNION SELECT sale_id FROM sales),
h AS (SELECT id, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
    lambda a, c: xor(a >> 8, t[(xor(a, c) & 255) + 1]))) AS h FROM i, b WHERE id IS NOT NULL),
c AS (SELECT click_id, client_id, CASE WHEN h % 2 = 1 THEN u - ((u % 86400000000) + 86400000000) % 86400000000 ELSE u END AS ts_us
  FROM (SELECT DISTINCT click_id, client_id, epoch_us(ts) AS u FROM clicks) LEFT JOIN h ON id = click_id),
s AS (SELECT sale_id, client_id, priority, CAST(floor(100 * total + 0.5) AS BIGINT) AS total_cents, h, CASE WHEN h % 2 = 1 THEN u - ((u % 86400000000) + 86400000000) % 86400000000 ELSE u END AS tm
  FROM (SELECT *, epoch_us(sold_at) AS u FROM sales) LEFT JOIN h ON id = sale_id),
o AS (SELECT sale_id, client_id, priority, total_cents, tm FROM s UNION ALL SELECT -1 - sale_id, client_id, 6 - priority, total_cents, tm FROM s WHERE h % 3 <> 0),
g AS (SELECT client_id, tm, sale_id, total_cents, count(*) OVER (PARTITION BY client_id, tm) AS n,
    row_number() OVER (PARTITION BY client_id, tm ORDER BY priority DESC NULLS LAST, sale_id NULLS LAST) AS k
  FROM o WHERE client_id IS NOT NULL AND tm IS NOT NULL),
m AS (SELECT c.*, g.sale_id, g.total_cents, g.n, g.tm FROM c ASOF LEFT JOIN (SELECT * FROM g WHERE k = 1) g ON c.client_id = g.client_id AND c.ts_us >= g.tm)
SELECT click_id, client_id, ts_us, CASE WHEN ts_us - tm <= 259200000000 THEN sale_id END AS sale_id, CASE WHEN ts_us - tm <= 259200000000 THEN ts_us - tm END AS lag_us,
  CASE WHEN ts_us - tm <= 259200000000 THEN total_cents END AS total_cents, CASE WHEN ts_us - tm <= 259200000000 THEN n ELSE 0 END AS n_tied
FROM m
"""
