"""Stateful monitors over minute summaries: stops of positions and daily circuit breakers of accounts.

Both are two steps. A windowed aggregation folds ticks into one summary per key and minute (combined map-side, so a key with a third of
all ticks sends one row per task and minute); a keyed processor with event-time timers then sees at most the minutes of a
batch. State is one row per open position, or per account and day, and is freed when the position closes or the day ends.
Times inside the processors are milliseconds since the epoch.
"""

from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from barwright.sources import universe
from barwright.streaming.jobs import LATE

MINUTE, HOUR, DAY = 60_000, 3_600_000, 86_400_000
#: The session runs at a fixed offset from UTC, as in the batch frames.
OFFSET = 4 * HOUR
#: A warning is due at this share of a stop's depth.
NEAR = 0.8


def minute_bars(ticks, late=LATE):
    """One closed summary per symbol and minute: symbol, at (event time, in the minute), ms (its start), high, close."""
    bars = ticks.withWatermark("ts", late).groupBy("symbol", F.window("ts", "1 minute").alias("w")).agg(
        F.max("price").alias("high"), F.max_by("price", F.struct("ts", "event_id")).alias("close"))
    return bars.select("symbol", F.window_time("w").alias("at"), F.unix_millis("w.start").alias("ms"), "high", "close")


def flatten_moment(since, minute):
    """The first time at or after ``since`` at which a session reaches its flatten minute."""
    day = (since - OFFSET) // DAY
    at = day * DAY + OFFSET + minute * MINUTE
    return at if at >= since else at + DAY


STOP_OUT = "account long, symbol string, ms long, kind string, price double, high double, entry double"
STOP_STATE = "entry double, since long, flatten long, day long, high double, close double, near int"


class StopMonitor(StatefulProcessor):
    """One open position: entry from the positions, high of the session so far, at most one exit and one warning of each kind a session."""

    def __init__(self, stop, trail, flatten_minute):
        self.stop, self.trail, self.minute = stop, trail, flatten_minute

    def init(self, handle):
        self.handle = handle
        self.state = handle.getValueState("position", STOP_STATE)

    def handleInitialState(self, key, initialState, timerValues):
        p = initialState.iloc[0]
        flatten = flatten_moment(int(p["since"]), self.minute) if self.minute is not None else -1
        self.state.update((float(p["entry"]), int(p["since"]), flatten, -1, 0.0, 0.0, 0))
        if flatten >= 0:
            self.handle.registerTimer(flatten)

    def close_out(self):
        """The position is gone: its state and timers are freed, later bars find nothing."""
        self.state.clear()
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)

    def flattened(self, key, entry, flatten, day, high, close):
        seen = day >= 0
        return (*key, flatten, "eod_flatten", close if seen else None, high if seen else None, entry)

    def handleInputRows(self, key, rows, timerValues):
        import pandas as pd
        if not self.state.exists():
            return
        entry, since, flatten, day, high, close, near = self.state.get()
        bars, out, open_ = pd.concat(list(rows)).sort_values("ms"), [], True
        for ms, top, last in zip(bars["ms"], bars["high"], bars["close"]):
            ms = int(ms)
            if ms < since:
                continue
            if 0 <= flatten <= ms:
                # the timer's moment has come with this bar: what it reports does not depend on how batches were cut
                out.append(self.flattened(key, entry, flatten, day, high, close))
                open_ = False
                break
            today = (ms - OFFSET) // DAY
            if today != day:
                day, high, near = today, top, 0
            high, close = max(high, top), last
            fall, drop = (close - entry) / entry, (close - high) / high
            if fall <= -self.stop or drop <= -self.trail:
                out.append((*key, ms, "hard_stop" if fall <= -self.stop else "trailing_stop", close, high, entry))
                open_ = False
                break
            for bit, kind, depth, limit in ((1, "near_hard_stop", fall, self.stop), (2, "near_trailing_stop", drop, self.trail)):
                if depth <= -NEAR * limit and not near & bit:
                    near |= bit
                    out.append((*key, ms, kind, close, high, entry))
        if open_:
            self.state.update((entry, since, flatten, day, high, close, near))
        else:
            self.close_out()
        if out:
            yield pd.DataFrame(out, columns=[c.split()[0] for c in STOP_OUT.split(", ")])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        import pandas as pd
        if not self.state.exists():
            return
        entry, _, flatten, day, high, close, _ = self.state.get()
        self.close_out()
        yield pd.DataFrame([self.flattened(key, entry, flatten, day, high, close)], columns=[c.split()[0] for c in STOP_OUT.split(", ")])

    def close(self):
        pass


def stream_stops(bars, positions, mode, limits=None):
    """Exits and warnings of ``positions`` (account, symbol, entry, since as a timestamp; static) over streamed :func:`minute_bars`.

    A poll each minute: hard stop from the entry, trailing stop from the session's high since the position was opened, a warning at NEAR
    of either; modes that flatten close what is open at their minute, by timer where no tick comes. A symbol's bars meet every position in it.
    """
    lim = {**universe.risk(mode), **(limits or {})}
    step = StopMonitor(lim["stop_loss_pct"], lim["trailing_stop_pct"], lim["flatten_minute"])
    held = positions.where("entry > 0").select("account", "symbol", "entry", F.unix_millis("since").alias("since"))
    fed = bars.join(held.select("account", "symbol"), "symbol").select("account", "symbol", "at", "ms", "high", "close")
    out = fed.groupBy("account", "symbol").transformWithStateInPandas(
        step, STOP_OUT, "append", "EventTime", initialState=held.groupBy("account", "symbol"))
    return out.select("account", "symbol", F.timestamp_millis("ms").alias("ts"), "kind", "price", "high", "entry")


BREAK_OUT = "account string, day_ms long, ms long, equity double, loss_pct double"
BREAK_STATE = "start double, tripped int"


def minute_equity(equity, late=LATE):
    """One closed summary per account and minute: first and least equity."""
    m = equity.withWatermark("ts", late).groupBy("account", F.window("ts", "1 minute").alias("w")).agg(
        F.min_by("equity", F.struct("ts", "event_id")).alias("first"), F.min("equity").alias("least"))
    start = F.unix_millis("w.start")
    return m.select("account", F.expr(f"unix_millis(w.start) div {DAY} * {DAY}").alias("day_ms"), F.window_time("w").alias("at"), start.alias("ms"), "first", "least")


class Breaker(StatefulProcessor):
    """One account's day: trips once when a minute's least equity is down by the limit from the day's first; a timer frees the day."""

    def __init__(self, limit):
        self.limit = limit

    def init(self, handle):
        self.handle = handle
        self.state = handle.getValueState("day", BREAK_STATE)

    def handleInputRows(self, key, rows, timerValues):
        import pandas as pd
        start, tripped = self.state.get() if self.state.exists() else (None, 0)
        if start is None:
            self.handle.registerTimer(int(key[1]) + DAY)
        out, minutes = [], pd.concat(list(rows)).sort_values("ms")
        for ms, first, least in zip(minutes["ms"], minutes["first"], minutes["least"]):
            start = float(first) if start is None else start
            loss = (least - start) / start
            if not tripped and loss <= -self.limit:
                tripped = 1
                out.append((key[0], int(key[1]), int(ms), least, loss))
        self.state.update((start, tripped))
        if out:
            yield pd.DataFrame(out, columns=[c.split()[0] for c in BREAK_OUT.split(", ")])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.state.clear()
        return iter(())

    def close(self):
        pass


def stream_breaker(minutes, mode="day", limit=None):
    """Daily circuit breaker per account over streamed :func:`minute_equity`: trips once, latched until the next day."""
    limit = universe.risk(mode)["daily_loss_limit"] if limit is None else limit
    out = minutes.groupBy("account", "day_ms").transformWithStateInPandas(Breaker(limit), BREAK_OUT, "append", "EventTime")
    return out.select("account", F.timestamp_millis("day_ms").alias("day"), F.timestamp_millis("ms").alias("ts"), "equity", "loss_pct")
