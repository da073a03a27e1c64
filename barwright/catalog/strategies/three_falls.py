"""A strategy as a user would hand it in: after three falls in a row, buy the next higher close."""

from dataclasses import dataclass


@dataclass
class Signal:
    ts: object
    direction: str
    confidence: float
    entry_price: float
    stop_price: float
    target_price: float


def generate_signals(bars, context):
    out, falls, before = [], 0, None
    for ts, close in zip(bars["ts"], bars["close"]):
        if before is not None:
            if close > before and falls >= 3:
                out.append(Signal(ts, "long", context.get("confidence", 50.0), close, close * (1 - context["stop_pct"]), close * (1 + context["target_pct"])))
            falls = falls + 1 if close < before else 0
        before = close
    return out
