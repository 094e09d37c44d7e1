"""Stock under commands: reserve, confirm, release and adjust, decided one after another for each sale.

A command has a sale, user, section, quantity and idempotency key, and a time; a sale has sections with a stock, a moment
it opens, a time that holds last, and a limit of sold tickets for each user. Verdicts, first that applies:

reserve   replayed (the user's key got a reservation within the last `ttl` seconds), no_such_section, invalid_quantity,
          sold_out, not_on_sale, limit_exceeded (sold to the user with these), already_holding, held
confirm   no_such_reservation, hold_expired, already_closed, confirmed (again: confirmed)
release   no_such_reservation, hold_expired, already_closed, released (again: released)
adjust    no_such_section, invalid_delta, correction_below_committed, stock_added, stock_corrected

Holds run out at their deadline, before the command that comes at that time. A sale's clock never goes back: a command
with an earlier time than one before it counts as at that one's time. Commands with a null sale, user, quantity or time,
an unknown kind, and all but `adjust` without a key are `malformed` and change nothing.

One sale's commands depend on each other, so a sale is decided in order by one task. It streams them: what it holds is
the sale's stock, holds and keys, not its commands. Sales are dealt over all tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.workers import reachable
from .ranks import running

KINDS = ("reserve", "confirm", "release", "adjust")
COLUMNS = "sale string, seq long, at double, kind string, user string, section string, qty long, key string, total long, opens double, hold_seconds double, most long"
VERDICTS = "sale string, seq long, verdict string, available long"


class Held(dict):
    """State in memory; `streaming.reservations` has the same three calls over a state store."""

    put, drop = dict.__setitem__, lambda self, key: self.pop(key, None)


class Sale:
    """The state of one sale. stock: section to (extra, held, sold); taken: (user, key) to (section, qty, deadline,
    forget, status); holding: user to key; owned: user to qty; queue: number to (user, key, deadline, forget), in order;
    clock: the only entry is (now, first hold that hasn't run out, first not forgotten, next number)."""

    def __init__(self, stock, taken, holding, owned, queue, clock):
        self.stock, self.taken, self.holding, self.owned, self.queue, self.clock = stock, taken, holding, owned, queue, clock

    def _move(self, section: str, extra: int, held: int, sold: int) -> None:
        a, b, c = self.stock.get((section,)) or (0, 0, 0)
        self.stock.put((section,), (a + extra, b + held, c + sold))

    def _end(self, user: str, key: str, status: str) -> None:
        section, qty, deadline, forget, _ = self.taken.get((user, key))
        self.taken.put((user, key), (section, qty, deadline, forget, status))
        self.holding.drop((user,))
        self._move(section, 0, -qty, qty if status == "sold" else 0)
        if status == "sold":
            self.owned.put((user,), (self.bought(user) + qty,))

    def bought(self, user: str) -> int:
        return (self.owned.get((user,)) or (0,))[0]

    def left(self, section: str, total: int) -> int:
        extra, held, sold = self.stock.get((section,)) or (0, 0, 0)
        return total + extra - held - sold

    def run_out(self, now: float) -> None:
        """Ends holds whose deadline has come."""
        _, first, old, end = self.clock.get((0,)) or (now, 0, 0, 0)
        while first < end:
            user, key, deadline, _ = self.queue.get((first,))
            if deadline > now:
                break
            if self.taken.get((user, key))[4] == "held":
                self._end(user, key, "expired")
            first += 1
        self.clock.put((0,), (now, first, old, end))

    def forget(self, upto: float) -> float | None:
        """Drops keys that no command from then on can name; the time of the next one to drop."""
        if (state := self.clock.get((0,))) is None:
            return None
        now, first, old, end = state
        while old < first and (entry := self.queue.get((old,)))[3] <= upto:
            # a key that was free again may have been taken anew
            if self.taken.get(entry[:2])[3] == entry[3]:
                self.taken.drop(entry[:2])
            self.queue.drop((old,))
            old += 1
        self.clock.put((0,), (now, first, old, end))
        return self.queue.get((old,))[3] if old < end else None

    def verdict(self, row: tuple, ttl: float) -> tuple[str, int | None]:
        """The verdict on a command (COLUMNS from `at` on), and what its section has left after it."""
        at, kind, user, section, qty, key, total, opens, hold_seconds, most = row
        now = max(at, (self.clock.get((0,)) or (at,))[0])
        self.run_out(now)
        known = section is not None and total is not None
        if kind == "adjust":
            said = self._adjust(section, qty, total) if known else "no_such_section"
        else:
            prior = self.taken.get((user, key))
            prior = prior if prior and prior[3] > now else None
            if kind != "reserve":
                said = self._close(kind, user, key, prior)
            elif prior:
                said = "replayed"
            elif not known:
                said = "no_such_section"
            elif qty <= 0:
                said = "invalid_quantity"
            elif qty > self.left(section, total):
                said = "sold_out"
            elif now < opens:
                said = "not_on_sale"
            elif self.bought(user) + qty > most:
                said = "limit_exceeded"
            elif self.holding.get((user,)):
                said = "already_holding"
            else:
                said = "held"
                _, first, old, end = self.clock.get((0,))
                deadline, forget = now + hold_seconds, now + max(ttl, hold_seconds)
                self.taken.put((user, key), (section, qty, deadline, forget, "held"))
                self.holding.put((user,), (key,))
                self._move(section, 0, qty, 0)
                self.queue.put((end,), (user, key, deadline, forget))
                self.clock.put((0,), (now, first, old, end + 1))
        return said, self.left(section, total) if known else None

    def _adjust(self, section: str, qty: int, total: int) -> str:
        if qty == 0:
            return "invalid_delta"
        if -qty > self.left(section, total):
            return "correction_below_committed"
        self._move(section, qty, 0, 0)
        return "stock_added" if qty > 0 else "stock_corrected"

    def _close(self, kind: str, user: str, key: str, prior: tuple | None) -> str:
        if prior is None:
            return "no_such_reservation"
        done = "sold" if kind == "confirm" else "released"
        if prior[4] == "held":
            self._end(user, key, done)
        elif prior[4] == "expired":
            return "hold_expired"
        elif prior[4] != done:
            return "already_closed"
        return "confirmed" if kind == "confirm" else "released"


def well_formed() -> F.Column:
    given = F.col("sale").isNotNull() & F.col("at").isNotNull() & F.col("user").isNotNull()
    return given & F.col("kind").isin(*KINDS) & F.when(F.col("kind") == "adjust", F.col("qty").isNotNull() & F.col("section").isNotNull()).when(F.col("kind") == "reserve", F.col("qty").isNotNull() & F.col("key").isNotNull()).otherwise(F.col("key").isNotNull())


def prepared(commands: DataFrame, sections: DataFrame, sales: DataFrame) -> DataFrame:
    """COLUMNS of commands (sale, seq, at, kind, user, section, qty, key) with their section's total and their sale's
    rules (sale, opens, hold_seconds, most); a sale without rules is open at once, without a limit, for 0 seconds."""
    second = lambda c: F.unix_micros(F.col(c).cast("timestamp")) / 1e6
    text = lambda c: F.col(c).cast("string").alias(c)
    rows = commands.select(text("sale"), F.col("seq").cast("long").alias("seq"), second("at").alias("at"), text("kind"), text("user"), text("section"), F.col("qty").cast("long").alias("qty"), text("key"))
    rules = sales.select(text("sale"), second("opens").alias("opens"), F.col("hold_seconds").cast("double").alias("hold_seconds"), F.col("most").cast("long").alias("most"))
    rows = rows.join(sections.select(text("sale"), text("section"), F.col("total").cast("long").alias("total")), ["sale", "section"], "left").join(rules, "sale", "left")
    return rows.select("sale", "seq", "at", "kind", "user", "section", "qty", "key", "total", F.coalesce("opens", F.lit(float("-inf"))).alias("opens"), F.coalesce("hold_seconds", F.lit(0.0)).alias("hold_seconds"), F.coalesce("most", F.lit(2**62)).alias("most"))


def replay(commands: DataFrame, sections: DataFrame, sales: DataFrame, ttl: float) -> DataFrame:
    """(sale, seq, verdict, available): each command's verdict, and what is left of its section after it, in the order of
    (at, seq) within each sale."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, sale = None, None
        for b in batches:
            said, left = [], []
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if row[0] != name:
                    name, sale = row[0], Sale(*(Held() for _ in range(6)))
                verdict, available = sale.verdict(row[2:], ttl)
                said.append(verdict)
                left.append(available)
            yield pa.RecordBatch.from_arrays([b["sale"], b["seq"], pa.array(said, pa.string()), pa.array(left, pa.int64())], names=["sale", "seq", "verdict", "available"])

    reachable(commands.sparkSession)
    rows = prepared(commands, sections, sales)
    bad = rows.filter(~F.coalesce(well_formed(), F.lit(False))).select("sale", "seq", F.lit("malformed").alias("verdict"), F.lit(None).cast("long").alias("available"))
    good = rows.filter(well_formed()).repartition("sale").sortWithinPartitions("sale", "at", "seq")
    return good.mapInArrow(run, VERDICTS).unionByName(bad)


def admission_schedule(joins: DataFrame, sales: DataFrame, seed: str) -> DataFrame:
    """(sale, user, place, second): when each user of a queue is let in. joins: sale, user, at; sales: sale, opens, rate.

    Who joined before a sale opens draws a place in the lobby (a seeded hash, so reruns agree); later ones queue behind by
    arrival, ties by user. Joining again keeps the first place. From the opening on `rate` users are let in each second:
    place k in second floor(k / rate). Sales without rules have no schedule; rows with a null count for nothing."""
    first = joins.filter("sale is not null and user is not null and at is not null").groupBy("sale", "user").agg(F.min("at").alias("at"))
    rows = first.join(sales.select("sale", "opens", "rate"), "sale")
    lobby = F.col("at") < F.col("opens")
    rows = rows.withColumn("late", (~lobby).cast("int")).withColumn("draw", F.when(lobby, F.md5(F.concat_ws(":", F.lit(seed), F.col("sale").cast("string"), F.col("user").cast("string")))))
    order = [F.col("late"), F.col("draw"), F.when(~lobby, F.col("at")), F.col("user")]
    placed = running(rows, "sum", F.lit(1).cast("long"), "place", *order, by=["sale"])
    return placed.select("sale", "user", (F.col("place") - 1).alias("place"), F.expr("(place - 1) div rate").alias("second"))
