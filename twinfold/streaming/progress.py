"""Smoothed rates of a scan, from samples of (files, bytes, seconds since start).

Rates are exponentially weighted: a sample weighs a tenth of its seconds, one at
most, the first one wholly; samples under half a second add to the next.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Seconds: least length of a sample, time that weighs one, and when a monitor reports, first and then.
LEAST, WHOLE, FIRST_REPORT, REPORT = 0.5, 10.0, 60.0, 300.0

_STEP = f"""
aggregate(samples,
  named_struct('now', 0D, 'files', 0L, 'bytes', 0L, 'held_files', 0L, 'held_bytes', 0L, 'fps', 0D, 'bps', 0D, 'first', true),
  (a, s) -> if(s.t - a.now < {LEAST}D,
    named_struct('now', a.now, 'files', a.files, 'bytes', a.bytes, 'held_files', a.held_files + s.files, 'held_bytes', a.held_bytes + s.bytes, 'fps', a.fps, 'bps', a.bps, 'first', a.first),
    named_struct('now', s.t, 'files', a.files + a.held_files + s.files, 'bytes', a.bytes + a.held_bytes + s.bytes, 'held_files', 0L, 'held_bytes', 0L,
      'fps', (1D - if(a.first, 1D, least((s.t - a.now) / {WHOLE}D, 1D))) * a.fps + if(a.first, 1D, least((s.t - a.now) / {WHOLE}D, 1D)) * ((a.held_files + s.files) / (s.t - a.now)),
      'bps', (1D - if(a.first, 1D, least((s.t - a.now) / {WHOLE}D, 1D))) * a.bps + if(a.first, 1D, least((s.t - a.now) / {WHOLE}D, 1D)) * ((a.held_bytes + s.bytes) / (s.t - a.now)),
      'first', false)))
"""


def ewma(samples: DataFrame, by: list[str]) -> DataFrame:
    """files, bytes, seconds, fps, bps of each scan; samples has t (double), files and bytes (bigint), a scan's fit one row."""
    grouped = samples.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("t", "files", "bytes"))).alias("samples"))
    out = grouped.select(*by, F.expr(_STEP).alias("p"))
    return out.select(*by, "p.files", "p.bytes", F.round("p.now").cast("bigint").alias("seconds"), "p.fps", "p.bps")


def iec(n: Column | str) -> Column:
    """Bytes with binary units: whole from ten of a unit on, else one decimal."""
    n = F.col(n) if isinstance(n, str) else n
    n = n.cast("double")
    step = F.greatest(F.lit(0), F.floor(F.log(1024.0, F.greatest(n, F.lit(1.0))) + 1e-12)).cast("int")
    value = F.floor(n / F.pow(F.lit(1024.0), step) * 10 + 0.5) / 10
    unit = F.element_at(F.array(*map(F.lit, ("B", "KiB", "MiB", "GiB", "TiB", "PiB", "EiB"))), step + 1)
    return F.when(n < 10, F.format_string("%d B", n.cast("bigint"))).when(value < 10, F.concat(F.format_string("%.1f ", value), unit)).otherwise(F.concat(F.format_string("%.0f ", value), unit))


def duration(seconds: Column | str) -> Column:
    s = F.col(seconds) if isinstance(seconds, str) else seconds
    h, m = F.floor(s / 3600), F.floor(s % 3600 / 60)
    head = F.when(h > 0, F.format_string("%dh%dm", h.cast("bigint"), m.cast("bigint"))).when(m > 0, F.format_string("%dm", m.cast("bigint"))).otherwise("")
    return F.concat(head, F.format_string("%ds", (s % 60).cast("bigint")))


def line(p: DataFrame) -> DataFrame:
    """p with a line of text for each row."""
    whole = lambda c: F.format_number(F.bround(c, 0), 0)
    text = F.concat(F.lit("Indexed "), F.format_number("files", 0), F.lit(" files ("), iec("bytes"), F.lit(") in "), duration("seconds"), F.lit(" ["), F.regexp_replace(whole(F.col("fps")), ",", ""), F.lit(" files/sec, "), iec(F.round("bps")), F.lit("/sec]"))
    return p.withColumn("line", text)


def reports(times: DataFrame, t: str = "t") -> DataFrame:
    """times with whether a monitor reports then: a minute at least after the start, then every five."""
    due = F.floor((F.col(t) - FIRST_REPORT) / REPORT)
    return times.withColumn("report_no", F.when(F.col(t) >= FIRST_REPORT, due.cast("bigint")))
