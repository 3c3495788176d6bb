"""State handlers of the keyed streams: the only code that runs in Python workers."""

from __future__ import annotations

import time
from collections.abc import Iterator
from types import SimpleNamespace

import pandas as pd
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

STALE_OUT = "station_id bigint, last_at timestamp, alert_at timestamp"


class StaleStation(StatefulProcessor):
    """ST-04: keeps the newest reading of a station and a timer for when it goes stale."""

    def __init__(self, minutes: int):
        self.gap_ms = minutes * 60_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "ms bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        newest = max(int(r["ts"].max().value // 1_000_000) for r in rows)
        known = self.last.get()[0] if self.last.exists() else None
        if known is None or newest > known:
            if known is not None:
                self.handle.deleteTimer(known + self.gap_ms)
            self.last.update((newest,))
            self.handle.registerTimer(newest + self.gap_ms)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        due = expiredTimerInfo.getExpiryTimeInMs()
        yield pd.DataFrame(
            {"station_id": [key[0]], "last_at": [pd.Timestamp(due - self.gap_ms, unit="ms")], "alert_at": [pd.Timestamp(due, unit="ms")]}
        )

    def close(self) -> None:
        pass


EXTREMES_OUT = "station_id bigint, local_date date, t_max_f double, t_min_f double, obs_count bigint, last_obs_at timestamp, revision bigint"


class RunningExtremes(StatefulProcessor):
    """ST-01: the readings of one station and day, by instant, and what they amount to.

    A new reading only widens the extremes. A corrected one replaces its predecessor; where that held an extreme, both are
    taken anew from the day's readings. The state of a day goes when its time is over.
    """

    def __init__(self, lateness_ms: int):
        self.lateness_ms = lateness_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.readings = handle.getValueState("readings", "at array<bigint>, temp array<double>")
        self.sums = handle.getValueState("sums", "high double, low double, n bigint, last bigint, revision bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(["poll", "temp_f"], ascending=[True, False], na_position="first")
        new = dict(zip(batch["at_us"].tolist(), [None if x != x else x for x in batch["temp_f"].tolist()]))
        if self.sums.exists():
            high, low, n, last, revision = self.sums.get()
            at, temp = self.readings.get()
            held = dict(zip(at, temp))
        else:
            high, low, n, last, revision, held = None, None, 0, None, 0, {}
            end = pd.Timestamp(key[1]) + pd.Timedelta(days=1)
            self.handle.registerTimer(end.value // 1_000_000 + self.lateness_ms)
        changed = {a: x for a, x in new.items() if a not in held or held[a] != x}
        if not changed:
            yield pd.DataFrame()
            return
        before = [held[a] for a in changed if held.get(a) is not None]
        taken_back = any(x == high or x == low for x in before)
        held.update(changed)
        known = [x for x in (held if taken_back else changed).values() if x is not None]
        known += [x for x in (high, low) if x is not None and not taken_back]
        high, low = (max(known), min(known)) if known else (None, None)
        n += sum(x is not None for x in changed.values()) - len(before)
        last = max([*changed, *([last] if last is not None else [])])
        self.readings.update((list(held), list(held.values())))
        self.sums.update((high, low, n, last, revision + 1))
        yield pd.DataFrame({"station_id": [key[0]], "local_date": [key[1]], "t_max_f": [high], "t_min_f": [low], "obs_count": [n], "last_obs_at": [pd.Timestamp(last, unit="us")], "revision": [revision + 1]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.readings.clear()
        self.sums.clear()
        yield pd.DataFrame()

    def close(self) -> None:
        pass


BIAS_OUT = (
    "station_id bigint, target_type string, target_date date, b_k double, u_k double, q_k double, r_k double, k_k double, "
    "epsilon double, state_version int, late boolean, arrived bigint"
)
BIAS_STATE = "b double, u double, q double, version int, last int, days array<int>, eps array<double>"


class OnlineBias(StatefulProcessor):
    """ST-05: the bias filter with its state kept between batches.

    State: filter values, last date and the recent innovations the noise terms need. A day at or
    before the last one is not applied but passed on as late, for a batch replay; ``arrived`` is the time of its batch.
    """

    WINDOW_DAYS = 30
    STATE = "bias"
    NEEDS = (
        "b_init", "u_init", "r_default", "gamma", "lambda_asym", "gap_inflate",
        "ewm_span_stable", "ewm_span_volatile", "ewm_vol_threshold",
    )

    def __init__(self, p):
        self.p = SimpleNamespace(**{f: getattr(p, f) for f in self.NEEDS})

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState(self.STATE, BIAS_STATE)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        s = initialState.iloc[0]
        self.state.update((float(s["b"]), float(s["u"]), float(s["q"]), int(s["version"]), int(s["last"]), [int(d) for d in s["days"]], [float(x) for x in s["eps"]]))

    def _q_base(self, xs: list[float], before: float) -> float:
        """Exponentially weighted variance of the steps between recent innovations."""
        if len(xs) < 2:
            return before
        ds = [b - a for a, b in zip(xs, xs[1:])]
        if len(ds) < 2:
            return 0.01
        p = self.p
        span = p.ewm_span_stable
        if len(ds) >= p.ewm_span_volatile:
            var = lambda v: sum((x - sum(v) / len(v)) ** 2 for x in v) / len(v)
            whole = var(ds)
            if whole > 0:
                ratio = var(ds[-p.ewm_span_volatile:]) / whole
                share = min(ratio / p.ewm_vol_threshold, 1.0)
                wide = p.ewm_span_stable - share * (p.ewm_span_stable - p.ewm_span_volatile)
                span = p.ewm_span_volatile if ratio > p.ewm_vol_threshold else int(wide)
        a = 2.0 / (span + 1)
        mean, acc = ds[0], 0.0
        for x in ds[1:]:
            d = x - mean
            mean, acc = mean + a * d, (1 - a) * (acc + a * d * d)
        return max(acc, 1e-6)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        p = self.p
        if self.state.exists():
            b, u, q, version, last, days, eps = self.state.get()
            days, eps = list(days), list(eps)
        else:
            b, u, q, version, last, days, eps = p.b_init, p.u_init, 0.0, 0, None, [], []
        batch = pd.concat(list(rows)).sort_values("target_date")
        out, now = [], time.time_ns() // 1000
        for date, e, r in zip(batch["target_date"], batch["epsilon"], batch["r_k"].fillna(p.r_default)):
            day = (pd.Timestamp(date) - pd.Timestamp("1970-01-01")).days
            if last is not None and day <= last:
                out.append((key[0], key[1], date, None, None, None, r, None, e, version, True, now))
                continue
            kept = [(d, x) for d, x in zip(days, eps) if d >= day - self.WINDOW_DAYS] + [(day, e)]
            days, eps = [d for d, _ in kept], [x for _, x in kept]
            noise = q + p.gamma * sum((x - b) ** 2 * (p.lambda_asym if x < b else 1.0) for x in eps[-5:])
            prior = u + noise * (1 + p.gap_inflate * (max(0, day - last - 1) if last is not None else 0))
            gain = prior / (prior + r) if prior + r else 0.5
            b, u, version, last = b + gain * (e - b), (1 - gain) * prior, version + 1, day
            q = self._q_base(eps, q)
            out.append((key[0], key[1], date, b, u, noise, r, gain, e, version, False, None))
        if last is not None:
            self.state.update((b, u, q, version, last, days, eps))
        cols = [c.split()[0] for c in BIAS_OUT.split(", ")]
        yield pd.DataFrame(out, columns=cols).astype({"arrived": "Int64"})

    def close(self) -> None:
        pass
