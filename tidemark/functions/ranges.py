"""Query ranges, bucket sizes and axis ticks as expressions, so that whole tables of requests can be resolved."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.schema import DAY_MS

LAST_MS = 4_102_444_800_000
LADDER = [60_000, 900_000, 3_600_000, 4 * 3_600_000, 6 * 3_600_000, DAY_MS, 7 * DAY_MS]
NAMED = {"minute": 60_000, "15m": 900_000, "hour": 3_600_000, "4h": 4 * 3_600_000, "6h": 6 * 3_600_000, "day": DAY_MS, "week": 7 * DAY_MS}
#: Days back from now (None: all) and bucket of the ranges that are offered by name.
PRESETS = {"24h": (1, "15m"), "7d": (7, "hour"), "30d": (30, "4h"), "90d": (90, "day"), "180d": (180, "day"), "12m": (365, "week"), "all": (None, "week")}
MOST = 2000


def _c(x) -> Column:
    return F.lit(x) if x is None or isinstance(x, (int, float)) else F.col(x) if isinstance(x, str) else x


def _named(name: Column, values: dict) -> Column:
    out = F.lit(None)
    for k, v in values.items():
        out = F.when(name == k, F.lit(v)).otherwise(out)
    return out


def resolve_range(start, end, interval, now) -> Column:
    """Struct (start, stop, bucket) in ms: stop is now unless it is given, start seven days before unless it is given; the bucket is the first rung from the asked one that keeps the series short."""
    start, end, now = (_c(x).cast("long") for x in (start, end, now))
    stop = F.greatest(F.lit(1), F.least(F.coalesce(end, now), F.lit(LAST_MS)))
    first = F.greatest(F.lit(0), F.least(F.coalesce(start, stop - 7 * DAY_MS), stop - 1))
    wanted = F.coalesce(_named(_c(interval), NAMED), F.lit(DAY_MS))
    long = F.floor((stop - first) / MOST)  # whole numbers below 2^53 divide exactly enough to be floored
    fits = [F.when((F.lit(r) >= wanted) & (F.floor((stop - first) / r) <= MOST), F.lit(r)) for r in LADDER]
    return F.struct(first.cast("long").alias("start"), stop.cast("long").alias("stop"), F.coalesce(*fits, F.greatest(long + 1, F.lit(7 * DAY_MS))).cast("long").alias("bucket"))


def preset_range(name, now, earliest=None) -> Column:
    """Struct (start, stop, interval) of a preset; null for another name. `all` begins at the earliest row, which is null where there is none."""
    name, now = _c(name), _c(now).cast("long")
    back = now - _named(name, {k: d * DAY_MS for k, (d, _) in PRESETS.items() if d})
    start = F.when(name == "all", _c(earliest).cast("long")).otherwise(back)
    return F.when(name.isin(*PRESETS), F.struct(start.alias("start"), now.alias("stop"), _named(name, {k: i for k, (_, i) in PRESETS.items()}).alias("interval")))


def custom_interval(days) -> Column:
    """The bucket of a range of so many days."""
    days = _c(days)
    return F.when(days <= 2, "15m").when(days <= 14, "hour").when(days <= 60, "4h").when(days <= 200, "day").otherwise("week")


def nice_ticks(most) -> Column:
    """Struct (step, count): a whole step near a quarter of `most`, from the ladder 1, 2, 2.5, 5, 10 at its power of ten, and as many steps as reach `most`."""
    most = _c(most)
    power = F.pow(F.lit(10.0), F.floor(F.log10(F.greatest(most / 4, F.lit(0.25)))))
    rung = F.coalesce(*[F.when(4 * m * power >= most, F.lit(m)) for m in (1.0, 2.0, 2.5, 5.0)], F.lit(10.0))
    step = F.greatest(F.lit(1), F.floor(rung * power + 0.5)).cast("long")
    return F.struct(step.alias("step"), F.greatest(F.lit(1), F.ceil(most / step)).cast("long").alias("count"))
