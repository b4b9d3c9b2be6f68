"""Point-in-time features of sales by a Fenwick sweep.

A sale's features at a time t count what its client did within the last d days, as far as it was known at t. An event has an event time ts and becomes available at x (never before ts), so
it counts for x <= t < ts + d. A shard holds whole keys (a client, or a cell of its time) and goes through their rows by availability: events are inserted
into a Fenwick tree over the ranks of event times, probes ask for the sums of the suffix with ts > t - d and for the latest click inserted. Rows are taken in chunks, so that numpy walks the
tree's levels for many rows at once; what is in the same chunk is compared directly. An item counts once however many of its lines do, so its tree
holds unions of its lines' intervals, from the first activity to the last.

A client of more than ``CELL`` rows has its time cut into cells, as wide as its fullest day allows. An event then has a row in the cell of its x and, for each d, one in the cell where it
leaves the window; for the cells between it is part of a carry: sums of arrivals less departures by cell, run up in two levels, which join a cell as one row for each kind. So an event is
repeated at most twice, whatever the width, and no task, the driver or broadcast gets a hot client whole. Events that leave at the same instant, lines of equal times and an item's
lines within a quarter day are summed up before they are dealt out.

Edge cases: rows without client or event time are left out; an event without arrival never counts, but its sale does for labels; null or non-finite amounts are 0 cents; a null click_id is
the smallest and is returned as null; a null sale_id is hashed as an empty text; repeated clicks count once, repeated sales and lines each time; lines without sale count nowhere; an
empty table gives no rows, or zeros; other columns are ignored whatever their names. Timestamps with a zone are instants, those without are UTC.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage, trimmed

DAY = 86_400_000_000
WINDOWS, LABEL, DELAY_MINUTES, SPREAD = (2, 14), 7, 240, 259_200
#: Rows of a key from which it is cut, rows of a shard at least, rows of a chunk, cells that are run up together.
CELL, SHARD, CHUNK, SPAN = 20_000, 200_000, 512, 1024
QUARTER = DAY // 4
CLICK, SALE, LINE, ITEM, SOLD, PROBE = range(6)
#: Where the sums of a kind stand: clicks, purchases, cents; sales, cents; lines, cents; items.
COLUMN, COLUMNS = {CLICK: 0, SALE: 3, LINE: 5, ITEM: 7}, 8
#: Before and after all times; no identifier, and a null one.
FIRST, LAST, NO_ID, NULL_ID = -(1 << 62), 1 << 62, -(1 << 63), -(1 << 63) + 1

ROWS = ("client", "cell", "kind", "mask", "x", "ts", "n", "p", "v", "id")
FEATURES = "sale_id long, d int, t_us long, label boolean, n_clicks long, n_purchases long, click_cents long, last_click_id long, n_sales long, sale_cents long, n_lines long, n_items long, line_cents long"


def micros(df: DataFrame, name: str) -> Column:
    """Epoch microseconds of a timestamp; one without a zone is UTC, whatever the session's zone."""
    c = df[name]
    if df.schema[name].dataType.typeName() != "timestamp_ntz":
        return F.unix_micros(c)
    if df.sparkSession.conf.get("spark.sql.session.timeZone") in ("UTC", "Etc/UTC", "GMT", "Z"):
        return F.unix_micros(c.cast("timestamp"))
    seconds = F.date_part(F.lit("SECONDS"), c)
    return F.unix_date(c.cast("date")).cast("long") * DAY + (F.hour(c).cast("long") * 60 + F.minute(c)) * 60_000_000 + (seconds * 1_000_000).cast("long")


def cents(amount: Column) -> Column:
    fine = amount.isNotNull() & ~F.isnan(amount) & (F.abs(amount) < float("inf"))
    return F.when(fine, F.floor(100 * amount + 0.5)).otherwise(0).cast("long")


def events(clicks: DataFrame, sales: DataFrame, lines: DataFrame, windows: tuple[int, ...] = WINDOWS) -> DataFrame:
    """``client, kind, x, ts, p, v, id``: what can count, what labels need, and the probes (x is their t)."""
    most, delay = max(windows) * DAY, DELAY_MINUTES * 60_000_000
    lives = F.col("x") < F.col("ts") + most
    row = lambda df, kind, p=F.lit(0), v=F.lit(0): df.select("client", F.lit(kind).alias("kind"), "x", "ts", p.cast("long").alias("p"), v.cast("long").alias("v"), F.coalesce("id", F.lit(NULL_ID)).alias("id"))
    c = clicks.select("click_id", "ts", "arrived_at", "client_id", "kind", "value", "props").filter("client_id IS NOT NULL AND ts IS NOT NULL AND arrived_at IS NOT NULL").dropDuplicates()
    c = c.select(F.col("client_id").alias("client"), micros(c, "ts").alias("ts"), micros(c, "arrived_at").alias("arrived"), F.coalesce(F.col("kind") == "purchase", F.lit(False)).alias("bought"), cents(F.col("value")).alias("v"), F.col("click_id").alias("id"))
    c = c.withColumn("x", F.greatest(F.col("arrived") + delay, "ts")).filter(lives)
    s = sales.filter("client_id IS NOT NULL AND sold_at IS NOT NULL")
    s = s.select(F.col("sale_id").alias("id"), F.col("client_id").alias("client"), micros(s, "sold_at").alias("ts"), micros(s, "arrived_at").alias("arrived"), cents(F.col("total")).alias("v"))
    s = s.withColumn("x", F.when(F.col("arrived").isNotNull(), F.greatest(F.col("arrived") + delay, "ts")))
    told = F.coalesce(lives, F.lit(False))
    t = F.col("ts") + F.crc32(F.coalesce(F.col("id").cast("string"), F.lit("")).cast("binary")) % SPREAD * 1_000_000
    shipped = lines.filter("sale_id IS NOT NULL AND shipped_at IS NOT NULL")
    shipped = shipped.select("sale_id", micros(shipped, "shipped_at").alias("shipped"), cents(F.col("amount")).alias("v"), F.coalesce("item_id", F.lit(NO_ID)).alias("id"))
    of = s.filter(told).select(F.col("id").alias("sale_id"), "client", "ts", F.col("x").alias("known"))
    its = shipped.join(of, "sale_id").withColumn("x", F.greatest("known", "shipped")).filter(lives)
    out = row(c, CLICK, F.col("bought"), F.col("v")).unionByName(row(s.filter(told), SALE, v=F.col("v"))).unionByName(row(its, LINE, v=F.col("v")))
    return out.unionByName(row(s.filter(~told).withColumn("x", F.lit(FIRST)), SOLD)).unionByName(row(s.withColumn("x", t), PROBE))


def for_windows(rows: DataFrame, windows: tuple[int, ...]) -> DataFrame:
    """``rows`` for each window, its number in ``w``."""
    return reduce(DataFrame.unionByName, (rows.withColumn("w", F.lit(w)) for w in range(len(windows))))


def unions(lines: DataFrame, windows: tuple[int, ...] = WINDOWS) -> DataFrame:
    """``client, width, w, x, end``: for each item and window the unions of its lines' intervals from x to ts + d.

    Intervals of lines whose ts lie in the same quarter day all hold its start plus d, or the moment before, unless they begin later; the former are one interval, the latter
    one for each beginning. What is left is run through in order of beginnings: an item has as many rows there as quarter days, not lines.
    """
    d = F.element_at(F.array(*(F.lit(w * DAY) for w in windows)), F.col("w") + 1)
    each = for_windows(lines.select("client", "width", "id", "x", "ts"), windows).withColumn("end", F.col("ts") + d).filter("x < end")
    quarter = F.col("ts") - F.pmod("ts", F.lit(QUARTER))
    each = each.select("client", "width", "id", "w", "x", "end", quarter.alias("quarter"), F.when(F.col("x") >= quarter + d, F.col("x")).alias("late"))
    parts = each.groupBy("client", "width", "id", "w", "quarter", "late").agg(F.min("x").alias("x"), F.max("end").alias("end"))
    own = Window.partitionBy("client", "id", "w").orderBy("x", "end")
    before = F.max("end").over(own.rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.withColumn("opens", F.when(before.isNull() | (F.col("x") > before), 1).otherwise(0)).withColumn("union", F.sum("opens").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    return parts.groupBy("client", "id", "w", "union").agg(F.max("width").alias("width"), F.min("x").alias("x"), F.max("end").alias("end"))


def running(rows: DataFrame, keys: list[str], at: str, columns: dict[str, str], forward: bool = True, span: int = SPAN) -> DataFrame:
    """``rows`` (one for each key and ``at``) with each column's aggregate ('sum', 'max') over all earlier (or later) rows of the key, in two levels, so that a task holds ``span`` of them."""
    order = lambda c: F.col(c) if forward else F.col(c).desc()
    rows = rows.withColumn("_big", F.floor(F.col(at) / span))
    inner = Window.partitionBy(*keys, "_big").orderBy(order(at)).rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy(*keys).orderBy(order("_big")).rowsBetween(Window.unboundedPreceding, -1)
    fn = {"sum": F.sum, "max": F.max}
    big = rows.groupBy(*keys, "_big").agg(*(fn[f](c).alias(c) for c, f in columns.items()))
    big = big.select(*keys, "_big", *(fn[f](c).over(outer).alias(f"_{c}") for c, f in columns.items()))
    near = rows.select(*keys, at, "_big", *(c for c in rows.columns if c not in (*keys, at, "_big", *columns)), *(fn[f](c).over(inner).alias(c) for c, f in columns.items()))
    both = lambda c, f: F.coalesce(F.col(c), F.lit(0)) + F.coalesce(F.col(f"_{c}"), F.lit(0)) if f == "sum" else F.greatest(c, f"_{c}")
    out = near.join(big.hint("merge"), [*keys, "_big"])
    return out.select(*(c for c in near.columns if c not in columns and c != "_big"), *(both(c, f).alias(c) for c, f in columns.items()))


def cut(hot: DataFrame, windows: tuple[int, ...] = WINDOWS) -> DataFrame:
    """``ROWS`` of the clients that are cut. ``hot``: events with their client's ``width``."""
    cell = lambda c: ((c - F.pmod(c, "width")) / F.col("width")).cast("long")
    every = (1 << len(windows)) - 1
    zero, one, none = F.lit(0).cast("long"), F.lit(1).cast("long"), F.lit(NO_ID)
    row = lambda df, c, kind, mask, x, ts, n=zero, p=zero, v=zero, id_=none: df.select("client", c.alias("cell"), *(y.cast("int").alias(name) for y, name in ((kind, "kind"), (mask, "mask"))), *(y.cast("long").alias(name) for y, name in ((x, "x"), (ts, "ts"), (n, "n"), (p, "p"), (v, "v"), (id_, "id"))))
    col, first, last = F.col, F.lit(FIRST), F.lit(LAST)

    single = hot.filter(col("kind").isin(CLICK, SALE)).select("client", "width", "kind", F.lit(every).alias("mask"), "x", "ts", one.alias("n"), "p", "v", F.when(col("kind") == CLICK, col("id")).otherwise(none).alias("id"))
    lines = hot.filter(col("kind") == LINE)
    summed = lines.groupBy("client", "width", "x", "ts").agg(F.count("*").alias("n"), F.sum("v").alias("v")).select("client", "width", F.lit(LINE).alias("kind"), F.lit(every).alias("mask"), "x", "ts", "n", zero.alias("p"), "v", none.alias("id"))
    d = F.element_at(F.array(*(F.lit(w * DAY) for w in windows)), col("w") + 1)
    items = unions(lines.filter(col("id") != NO_ID), windows).select("client", "width", F.lit(ITEM).alias("kind"), F.expr("shiftleft(1, w)").alias("mask"), "x", (col("end") - d).alias("ts"), one.alias("n"), zero.alias("p"), zero.alias("v"), none.alias("id"))
    base = stage(single.unionByName(summed).unionByName(items), "cut")
    starts = row(base, cell(col("x")), col("kind"), col("mask"), col("x"), col("ts"), col("n"), col("p"), col("v"), col("id"))

    each = for_windows(base, windows).filter(F.expr("mask & shiftleft(1, w)") != 0).withColumn("end", col("ts") + d)
    each = each.filter("x < end").withColumns({"cell": cell(col("end")), "entered": cell(col("x"))}).filter("cell > entered")
    sums = [F.sum(c).alias(c) for c in ("n", "p", "v")]
    ends = stage(each.groupBy("client", "cell", "entered", "w", "kind", "ts").agg(*sums), "ends")
    leaving = row(ends, col("cell"), col("kind"), F.expr("shiftleft(1, w)"), first, col("ts"), col("n"), col("p"), col("v"))

    probes = hot.filter(col("kind") == PROBE)
    asked = probes.select("client", cell(col("x")).alias("cell")).distinct()
    net = ends.groupBy("client", col("entered").alias("cell"), "w", "kind").agg(*sums, *(zero.alias(f"gone_{c}") for c in "npv"))
    gone = ends.groupBy("client", "cell", "w", "kind").agg(*(F.sum(-col(c)).alias(c) for c in "npv"), *(F.sum(c).alias(f"gone_{c}") for c in "npv"))
    open_ = for_windows(asked.select("client", "cell", *(zero.alias(c) for c in (*"npv", *(f"gone_{c}" for c in "npv")))), windows).withColumn("kind", F.explode(F.array(*map(F.lit, COLUMN))))
    steps = net.withColumn("asks", F.lit(0)).unionByName(gone.withColumn("asks", F.lit(0))).unionByName(open_.withColumn("asks", F.lit(1)))
    steps = steps.groupBy("client", "cell", "w", "kind").agg(*(F.sum(c).alias(c) for c in (*"npv", *(f"gone_{c}" for c in "npv"))), F.max("asks").alias("asks"))
    carry = running(steps, ["client", "w", "kind"], "cell", dict.fromkeys("npv", "sum")).filter("asks = 1")
    carried = row(carry, col("cell"), col("kind"), F.expr("shiftleft(1, w)"), first, last, *(col(c) - col(f"gone_{c}") for c in "npv")).filter("n <> 0")

    click = hot.filter(col("kind") == CLICK).groupBy("client", cell(col("x")).alias("cell")).agg(F.max(F.struct("ts", "id")).alias("click"))
    seen = asked.join(click, ["client", "cell"], "full").select("client", "cell", "click")
    latest = running(seen, ["client"], "cell", {"click": "max"}).filter("click IS NOT NULL").join(asked.hint("merge"), ["client", "cell"], "left_semi")
    latest = row(latest, col("cell"), F.lit(CLICK), F.lit(every), first, col("click.ts"), id_=col("click.id"))
    sold = hot.filter(col("kind").isin(SALE, SOLD)).select("client", cell(col("ts")).alias("cell"), "ts")
    soonest = asked.join(sold.groupBy("client", "cell").agg(F.min("ts").alias("ts")), ["client", "cell"], "full").select("client", "cell", (-col("ts")).alias("ts"))
    soonest = running(soonest, ["client"], "cell", {"ts": "max"}, forward=False).filter("ts IS NOT NULL").join(asked.hint("merge"), ["client", "cell"], "left_semi")
    soonest = row(soonest, col("cell"), F.lit(SOLD), F.lit(0), first, -col("ts"))
    here = row(sold.distinct(), col("cell"), F.lit(SOLD), F.lit(0), first, col("ts"))
    out = starts
    for more in (leaving, carried, latest, soonest, here, row(probes, cell(col("x")), col("kind"), F.lit(0), col("x"), col("ts"), id_=col("id"))):
        out = out.unionByName(more)
    return out


class _Ranks:
    """Places of (key, value) rows in order; ``upto`` counts those of a key and below, up to a value."""

    def __init__(self, key: np.ndarray, value: np.ndarray):
        self.values = np.unique(value)
        self.base = len(self.values) + 1
        self.rank = key * self.base + np.searchsorted(self.values, value) + 1
        self.ordered = np.sort(self.rank)

    def upto(self, key: np.ndarray, value: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ordered, key * self.base + np.searchsorted(self.values, value, "right"), "right")

    def at(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Key and value of a place."""
        rank = self.ordered[place]
        return rank // self.base, self.values[rank % self.base - 1]


def item_unions(key: np.ndarray, item: np.ndarray, x: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Key, beginning and end of the unions of each item's intervals."""
    order = np.lexsort((x, item, key))
    key, item, x, end = key[order], item[order], x[order], end[order]
    fresh = np.ones(len(key), bool)
    fresh[1:] = (key[1:] != key[:-1]) | (item[1:] != item[:-1])
    ends = np.unique(end)
    most = np.maximum.accumulate(np.cumsum(fresh) * len(ends) + np.searchsorted(ends, end))  # the latest end so far, of this item
    reach = ends[most % len(ends)] if len(ends) else end
    opens = fresh.copy()
    opens[1:] |= x[1:] > reach[:-1]
    at = np.flatnonzero(opens)
    return key[at], x[at], reach[np.append(at[1:], len(key)) - 1] if len(at) else end


class Fenwick:
    """Sums of ``COLUMNS`` columns and the highest marked place, over places from 1 to n; takes many rows at once."""

    def __init__(self, n: int):
        self.n, self.sums, self.top = n, np.zeros((n + 1, COLUMNS), np.int64), np.zeros(n + 1, np.int64)
        self.flat = self.sums.reshape(-1)

    def insert(self, place: np.ndarray, values: np.ndarray, marked: np.ndarray) -> None:
        row, column = np.nonzero(values)
        value, at = values[row, column], place[row]
        while len(at):
            np.add.at(self.flat, at * COLUMNS + column, value)
            at = at + (at & -at)
            if len(at) and at.max() > self.n:
                left = at <= self.n
                at, column, value = at[left], column[left], value[left]
        at = mark = place[marked]
        while len(at):
            np.maximum.at(self.top, at, mark)
            at = at + (at & -at)
            left = at <= self.n
            at, mark = at[left], mark[left]

    def total(self, place: np.ndarray) -> np.ndarray:
        out, at = np.zeros((len(place), COLUMNS), np.int64), place.copy()
        while at.any():
            out += self.sums[at]
            at &= at - 1
        return out

    def highest(self, place: np.ndarray) -> np.ndarray:
        out, at = np.zeros(len(place), np.int64), place.copy()
        while at.any():
            np.maximum(out, self.top[at], out=out)
            at &= at - 1
        return out


def sweep(key: np.ndarray, x: np.ndarray, ts: np.ndarray, values: np.ndarray, id_: np.ndarray, is_click: np.ndarray, probe_key: np.ndarray, t: np.ndarray, d: int, chunk: int = CHUNK) -> tuple[np.ndarray, np.ndarray]:
    """For each probe the sums of its key's events with x <= t and ts > t - d, and the identifier of the latest click among them (``NO_ID``: none)."""
    n = len(key)
    ranks = _Ranks(key, ts)
    order = np.lexsort((id_, ranks.rank))
    place = np.empty(n, np.int64)
    place[order] = np.arange(1, n + 1)
    low, high = ranks.upto(probe_key, t - d), ranks.upto(probe_key, np.full(len(t), np.iinfo(np.int64).max))
    tree = Fenwick(n)
    out, last = np.zeros((len(t), COLUMNS), np.int64), np.zeros(len(t), np.int64)
    rows = np.lexsort((np.arange(n + len(t)) >= n, np.concatenate((x, t))))  # by availability; events first
    for k in range(0, len(rows), chunk):
        part = rows[k : k + chunk]
        probe = part >= n
        new, asks = part[~probe], part[probe] - n
        if len(asks):
            lo, hi = low[asks], high[asks]
            got, top = tree.total(hi) - tree.total(lo), tree.highest(hi)
            if len(new):
                at = place[new]
                near = (np.flatnonzero(~probe) < np.flatnonzero(probe)[:, None]) & (at > lo[:, None]) & (at <= hi[:, None])
                if near.any():
                    got += near.astype(np.int64) @ values[new]
                    top = np.maximum(top, (near * np.where(is_click[new], at, 0)).max(1))
            out[asks], last[asks] = got, np.where(top > lo, top, 0)
        if len(new):
            tree.insert(place[new], values[new], is_click[new])
    return out, np.where(last > 0, id_[order][last - 1] if n else NO_ID, NO_ID)


def shard_features(rows: dict[str, np.ndarray], windows: tuple[int, ...] = WINDOWS, label_days: int = LABEL, chunk: int = CHUNK) -> pa.RecordBatch | None:
    """``FEATURES`` of the probes of a shard, whose rows are sorted by client and cell."""
    fresh = np.ones(len(rows["client"]), bool)
    fresh[1:] = (np.diff(rows["client"]) != 0) | (np.diff(rows["cell"]) != 0)
    key = np.cumsum(fresh) - 1
    asked = np.bincount(key[rows["kind"] == PROBE], minlength=key[-1] + 1)[key] > 0
    if not asked.any():
        return None
    key, rows = key[asked], {c: v[asked] for c, v in rows.items()}
    kind, ts = rows["kind"], rows["ts"]
    probe = kind == PROBE
    t, probe_key, sale = rows["x"][probe], key[probe], rows["id"][probe]
    sold = ((kind == SALE) | (kind == SOLD)) & (ts < LAST)
    sales = _Ranks(key[sold], ts[sold])
    after = sales.upto(probe_key, t)
    label = np.zeros(len(t), bool)
    there = after < len(sales.ordered)
    its, when = sales.at(after[there])
    label[there] = (its == probe_key[there]) & (when <= t[there] + label_days * DAY)
    out = []
    for w, days in enumerate(windows):
        d = days * DAY
        event = (kind <= ITEM) & (rows["mask"] >> w & 1 == 1)
        of, k = kind[event], key[event]
        values = np.zeros((len(k), COLUMNS), np.int64)
        for name, column in COLUMN.items():
            mine = of == name
            values[mine, column] = rows["n"][event][mine]
            if name == CLICK:
                values[mine, column + 1] = rows["p"][event][mine]
            if name != ITEM:
                values[mine, column + 1 + (name == CLICK)] = rows["v"][event][mine]
        x, at, id_ = rows["x"][event], ts[event], rows["id"][event]
        lines = (of == LINE) & (id_ != NO_ID) & (x < at + d)
        item_key, begins, ends = item_unions(k[lines], id_[lines], x[lines], at[lines] + d)
        more = np.zeros((len(item_key), COLUMNS), np.int64)
        more[:, COLUMN[ITEM]] = 1
        is_click = (of == CLICK) & (id_ != NO_ID)
        join = lambda a, b: np.concatenate((a, b))
        got, last = sweep(join(k, item_key), join(x, begins), join(at, ends - d), join(values, more), join(id_, np.full(len(item_key), NO_ID)), join(is_click, np.zeros(len(item_key), bool)), probe_key, t, d, chunk)
        number = lambda a: pa.array(a, mask=a <= NULL_ID)
        columns = [number(sale), pa.array(np.full(len(t), days, np.int32)), pa.array(t), pa.array(label), *(pa.array(got[:, i]) for i in (0, 1, 2)), number(last), *(pa.array(got[:, i]) for i in (3, 4, 5, 7, 6))]
        out.append(pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in FEATURES.split(", ")]))
    return pa.concat_batches(out)


def features(clicks: DataFrame, sales: DataFrame, lines: DataFrame, windows: tuple[int, ...] = WINDOWS, label_days: int = LABEL, most: int = CELL, chunk: int = CHUNK) -> DataFrame:
    """``FEATURES`` of every sale with a client and a time, a row for each window."""
    rows = stage(events(clicks, sales, lines, windows), "events")
    kind, n = F.col("kind"), len(windows)
    # What an event comes to where its client is cut: itself, its leave of each window, and, of lines, as much for the item in each window.
    weight = F.when(kind == LINE, 1 + 3 * n).when(kind < ITEM, 1 + n).otherwise(1)
    days = rows.groupBy("client", F.floor(F.when(kind == SOLD, F.col("ts")).otherwise(F.col("x")) / DAY).alias("day")).agg(F.count("*").alias("n"), F.sum(weight).alias("weight"))
    many = days.groupBy("client").agg(F.sum("n").alias("n"), F.max("weight").alias("weight")).filter(F.col("n") > most)
    width = stage(many.select("client", F.greatest(F.lit(1), F.floor(F.lit(DAY * most) / F.col("weight"))).cast("long").alias("width")), "width")
    cold, hot = rows, None
    if not width.isEmpty():
        # A plain join, which Spark splits where a client is hot; the clients that are cut grow with the input, so they are not broadcast.
        placed = stage(rows.join(width.hint("merge"), "client", "left"), "placed")
        cold, hot = placed.filter("width IS NULL"), placed.filter("width IS NOT NULL")
    ones = F.when(kind < ITEM, 1).otherwise(0)
    out = cold.select("client", F.lit(0).cast("long").alias("cell"), kind.cast("int").alias("kind"), (ones * ((1 << n) - 1)).cast("int").alias("mask"), "x", "ts", ones.cast("long").alias("n"), "p", "v", F.when(kind == SALE, F.lit(NO_ID)).otherwise(F.col("id")).alias("id"))
    if hot is not None:
        out = out.unionByName(stage(cut(hot, windows), "cells"))
    dealt = out.select(*ROWS).repartition("client", "cell").sortWithinPartitions("client", "cell")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict[str, np.ndarray]] = []
        n = 0
        for batch in batches:
            part = {c: batch.column(c).to_numpy() for c in ROWS}
            n += batch.num_rows
            if n >= SHARD and batch.num_rows:
                before = held[-1] if held else part
                border = np.flatnonzero((np.diff(part["client"], prepend=before["client"][-1:] if held else part["client"][:1]) != 0) | (np.diff(part["cell"], prepend=before["cell"][-1:] if held else part["cell"][:1]) != 0))
                if len(border):
                    at = border[-1]
                    whole = [*held, {c: v[:at] for c, v in part.items()}]
                    if (made := shard_features({c: np.concatenate([h[c] for h in whole]) for c in ROWS}, windows, label_days, chunk)) is not None:
                        yield made
                    del whole
                    part = {c: v[at:].copy() for c, v in part.items()}
                    held, n = [], len(part["client"])
            if len(part["client"]):
                held.append(part)
        if held and (made := shard_features({c: np.concatenate([h[c] for h in held]) for c in ROWS}, windows, label_days, chunk)) is not None:
            yield made

    return dealt.mapInArrow(trimmed(run), FEATURES)
