"""Radiometric operators: selects with bounded calibration tables, and choices among bursts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.band_math import clip

FLOOR = 1e-30


def intensity(i: Column, q: Column | None = None) -> Column:
    """DN squared, or i2 + q2 of complex samples."""
    return i * i if q is None else i * i + q * q


def sigma0_asar(power: Column, incidence_deg: Column, constant: float, gain: Column | None = None, spread: Column | None = None) -> Column:
    """Power times sin(incidence)/K, with the range spreading put in and the antenna gain taken out."""
    out = power * F.sin(F.radians(incidence_deg)) / constant
    if spread is not None:
        out = out * spread
    return out if gain is None else out / (gain * gain)


def sigma0_gain_table(power: Column, offset: float, gain: Column, complex_input: bool = False) -> Column:
    """Scaling by a gain for each column of the image, joined on x."""
    return power / (gain * gain) if complex_input else (power + offset) / gain


def sigma0_noise(power: Column, noise: Column, constant: float, incidence_deg: Column) -> Column:
    return constant * (power - noise) * F.sin(F.radians(incidence_deg))


def noise_by_record(records: list[tuple[float, float, list[float]]], time: Column, slant: Column) -> Column:
    """Noise at a line's time and a slant-range time from a header's records (time, reference, [c0, c1, ...] of powers of the slant-range time less the reference): that of the record before and the one after, linear in time between them; before the first and after the last, theirs."""
    longest = max(len(c) for _, _, c in records)
    rows = F.array(*[F.struct(F.lit(float(t)).alias("t"), F.lit(float(r)).alias("r"), F.array(*[F.lit(float(k)) for k in [*c, *[0.0] * (longest - len(c))]]).alias("c")) for t, r, c in sorted(records)])
    before = F.coalesce(F.try_element_at(F.filter(rows, lambda s: s["t"] <= time), F.lit(-1)), F.get(rows, F.lit(0)))
    after = F.coalesce(F.get(F.filter(rows, lambda s: s["t"] > time), F.lit(0)), F.try_element_at(rows, F.lit(-1)))
    value = lambda s: F.aggregate(F.reverse(s["c"]), F.lit(0.0), lambda a, k: a * (slant - s["r"]) + k)
    share = F.when((time >= before["t"]) & (after["t"] > before["t"]), (time - before["t"]) / F.when(after["t"] > before["t"], after["t"] - before["t"])).otherwise(0.0)
    return F.when(time.isNotNull(), value(before) + (value(after) - value(before)) * share)


def sigma0_reference(power: Column, rescale: float, constant: float, reference_range: float | None = None, exponent: float = 1.0, reference_deg: float | None = None) -> Column:
    out = power / (rescale * rescale * constant)
    if reference_range is not None:
        out = out * reference_range ** (2 * exponent)
    return out if reference_deg is None else out * F.sin(F.radians(F.lit(reference_deg)))


def calibrate(p, band: str, mission: str, incidence_deg: Column, constant: float = 1.0, **more) -> DataFrame:
    """y, x and sigma0 of a product's power band, by the model of its mission.

    ENVISAT and ERS: gain (optional) and spread (optional) Columns. ALOS: the
    constant in decibels. TSX: noise Column (noise_by_record() makes one). RS2: offset and gains, a DataFrame of
    x and gain that is joined by column of the image (columns without a gain are
    missing). CSK: rescale, reference_range,
    exponent and reference_deg. Others raise ValueError.
    """
    power, rows = F.col(band).cast("double"), p.pixels
    kind = mission.upper().split("-")[0]
    if kind in ("ENVISAT", "ERS1", "ERS2", "ERS"):
        out = sigma0_asar(power, incidence_deg, constant, more.get("gain"), more.get("spread"))
    elif kind == "ALOS":
        out = power * 10 ** (constant / 10)
    elif kind.startswith("TSX") or kind.startswith("TDX"):
        out = sigma0_noise(power, more.get("noise", F.lit(0.0)), constant, incidence_deg)
    elif kind in ("RS2", "RADARSAT"):
        rows = rows.join(more["gains"].select("x", F.col("gain").alias("_gain")), "x", "left")
        out = sigma0_gain_table(power, more.get("offset", 0.0), F.col("_gain"), more.get("complex_input", False))
    elif kind in ("CSK", "CSKS1", "CSKS2", "CSKS3", "CSKS4"):
        out = sigma0_reference(power, more.get("rescale", 1.0), constant, more.get("reference_range"), more.get("exponent", 1.0), more.get("reference_deg"))
    else:
        raise ValueError(f"no calibration for {mission}")
    return rows.select("y", "x", out.alias("sigma0"))


def gamma0(sigma0: Column, incidence_deg: Column) -> Column:
    return sigma0 / F.cos(F.radians(incidence_deg))


def beta0(sigma0: Column, incidence_deg: Column) -> Column:
    return sigma0 / F.sin(F.radians(incidence_deg))


def to_db(sigma0: Column) -> Column:
    return 10 * F.log10(clip(sigma0, FLOOR))


def remove_antenna_pattern(power: Column, gain: Column, spread: Column) -> Column:
    return power * gain * gain / spread


def deburst_peak(samples: DataFrame, keys: list[str], i: str, q: str) -> DataFrame:
    """Of the bursts at a place, the i and q with the greatest intensity."""
    power = F.col(i) * F.col(i) + F.col(q) * F.col(q)
    best = F.max_by(F.struct(i, q), F.struct(power, i, q))
    return samples.groupBy(*keys).agg(best.alias("b")).select(*keys, f"b.{i}", f"b.{q}")


def deburst_mean(samples: DataFrame, keys: list[str], burst: str, value: str, no_data: float = 0.0, bad_share: float = 0.4) -> DataFrame:
    """Mean of the valid samples at a place, over bursts with at most bad_share of invalid ones."""
    ok = (F.col(value) != no_data) & F.col(value).isNotNull()
    good = samples.groupBy(burst).agg(F.avg((~ok).cast("double")).alias("bad")).where(F.col("bad") <= bad_share).select(burst)
    return samples.where(ok).join(good, burst, "left_semi").groupBy(*keys).agg(F.avg(value).alias(value))


def burst_of_line(lines: DataFrame, bursts: DataFrame, time: str, step: float = 64.0) -> DataFrame:
    """For each line's time, the burst (burst, first, last) that holds it, first <= time < last; of those that overlap, the last one whose overlap with its predecessor is over by half.

    Bursts are cut to buckets of `step`, so the join is on a bucket and a range
    test. Lines in no burst are left out; without a time, too.
    """
    bucket = lambda c: F.floor(c / step).cast("long")
    cut = bursts.withColumn("bucket", F.explode(F.sequence(bucket(F.col("first")), bucket(F.col("last")))))
    hits = lines.withColumn("bucket", bucket(F.col(time))).join(cut, "bucket").where((F.col("first") <= F.col(time)) & (F.col(time) < F.col("last")))
    found = hits.groupBy(*lines.columns).agg(F.array_sort(F.collect_list(F.struct("first", "last", "burst"))).alias("b"))
    begun = F.filter("b", lambda x, i: (i == 0) | (F.col(time) > (F.get("b", F.greatest(i - 1, F.lit(0)))["last"] + x["first"]) / 2))
    return found.select(*lines.columns, F.element_at(begun, -1)["burst"].alias("burst"))
