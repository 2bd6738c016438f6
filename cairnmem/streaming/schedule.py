"""When periodic work runs: triggers of streams, and intervals by idleness."""

# Seconds between rounds for the active, the quiet and the idle, and where those begin.
INTERVALS = (300.0, 900.0, 1800.0)
QUIET_AFTER, IDLE_AFTER = 900.0, 3600.0

# Seconds between rounds of the workers.
WORKERS = {"think": 1800.0, "decay": 3600.0, "sessions": 3600.0, "oplog_gc": 3600.0, "sync": 0.5}
#: Active memories under which thinking is skipped.
LEAST_TO_THINK = 10
#: Operations that collection keeps.
KEEP_OPERATIONS = 100_000


def interval(idle_seconds: float) -> float:
    """Seconds to the next round.

    >>> interval(10), interval(1000), interval(9999)
    (300.0, 900.0, 1800.0)
    """
    return INTERVALS[(idle_seconds >= QUIET_AFTER) + (idle_seconds >= IDLE_AFTER)]


def due(last_run: dict[str, float], now: float) -> list[str]:
    """Workers whose interval has passed, those that never ran first.

    >>> due({"think": 0.0, "decay": 0.0, "sessions": 0.0, "oplog_gc": 0.0}, 1800.0)
    ['sync', 'think']
    """
    waits = {w: now - last_run.get(w, float("-inf")) for w in WORKERS}
    return sorted((w for w, waited in waits.items() if waited >= WORKERS[w]), key=lambda w: (w in last_run, w))


def trigger(worker: str) -> dict[str, str]:
    """The argument of ``DataStreamWriter.trigger`` for a worker."""
    return {"processingTime": f"{WORKERS[worker]:g} seconds"} if WORKERS[worker] >= 1 else {"processingTime": f"{WORKERS[worker] * 1000:g} milliseconds"}
