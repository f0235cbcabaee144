"""A plain, row-by-row statement of the session rules, for comparison only."""

from __future__ import annotations

import datetime as dt


def cut(ts):
    return ts.replace(microsecond=0)


def simulate(polls, max_gap, ignored=()):
    """polls: (device, ts, seq, app, title, is_stop) -> set of session tuples."""
    out = []
    by_device = {}
    for p in polls:
        by_device.setdefault(p[0], []).append(p)
    for device, rows in by_device.items():
        rows.sort(key=lambda r: (r[1], r[2]))
        current, last_ts = None, None

        def close(at):
            app, title, start, seq = current
            out.append((device, seq, app, title, cut(start), cut(at),
                        int((cut(at) - cut(start)).total_seconds())))

        for _, ts, seq, app, title, is_stop in rows:
            if last_ts is not None and ts - last_ts > dt.timedelta(seconds=max_gap):
                if current:
                    close(last_ts)
                current = None
            last_ts = ts
            if is_stop:
                if current:
                    close(ts)
                current = None
                continue
            if not app or not (title or "").strip() or any(k in title for k in ignored):
                continue
            if current is None or current[:2] != (app, title):
                if current:
                    close(ts)
                current = (app, title, ts, seq)
        if current:
            app, title, start, seq = current
            out.append((device, seq, app, title, cut(start), None, 0))
    return set(out)


def random_polls(rng, devices=40, polls=200, step=90):
    rows, seq = [], 0
    for device in range(devices):
        ts = dt.datetime(2024, 3, 9, 22, 0, 0)
        for _ in range(polls):
            seq += 1
            ts += dt.timedelta(microseconds=rng.choice(
                [0, 300_000, 1_000_000, 5_000_000, 59_999_999, 60_000_000, 60_000_001, step * 1_000_000]))
            app = rng.choice(["code", "chrome", "chrome", "", None])
            title = rng.choice(["a", "a", "b", " ", "　", None, "my Desktop"])
            rows.append((device, ts, seq, app, title, rng.random() < 0.02))
    return rows
