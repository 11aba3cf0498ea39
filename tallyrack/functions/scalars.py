"""Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Readings of 2**47 and above are codes for "missing".
SENTINEL = float(2**47)
#: Bits of the clock-throttle mask.
THROTTLE_BITS = (
    (0x1, "GPU idle"), (0x2, "Application clocks setting"), (0x4, "SW power cap"), (0x8, "HW slowdown (temp/power/Pstate)"), (0x10, "Sync boost"),
    (0x20, "SW thermal slowdown"), (0x40, "HW thermal slowdown"), (0x80, "HW power brake"), (0x100, "Display clocks setting"),
)
#: Time limits that mean none.
NO_LIMIT = ("", "unlimited", "partition_limit", "infinite", "invalid", "none", "unknown")
#: States that count as failed.
FAILED = ("FAILED", "NODE_FAIL", "OUT_OF_MEMORY")


def null_sentinels(c: Column) -> Column:
    """Missing codes and NaN become NULL."""
    return F.when((c < SENTINEL) & ~F.isnan(c), c)


def clamp(c: Column, most: float) -> Column:
    """Rates that no hardware reaches become NULL."""
    return F.when(F.abs(c) <= most, c)


def parse_field_options(c: Column) -> Column:
    """``name,E,W=48,U=512B,R=S`` as (name, width, multiplier, unit, slow)."""
    option = lambda k: F.nullif(F.regexp_extract(c, rf"(?:^|,){k}=([^,]*)", 1), F.lit(""))
    unit = F.coalesce(option("U"), F.lit("#"))
    return F.struct(
        F.split_part(c, F.lit(","), F.lit(1)).alias("name"),
        F.coalesce(option("W").cast("int"), F.lit(64)).alias("width"),
        F.coalesce(F.nullif(F.regexp_extract(unit, r"^(\d+)", 1), F.lit("")).cast("long"), F.lit(1)).alias("multiplier"),
        F.regexp_replace(unit, r"^\d+", "").alias("unit"),
        F.coalesce(option("R") == "S", F.lit(False)).alias("slow"),
    )


def as_fqdn(host: Column, suffix: str) -> Column:
    """Short names get the suffix once, whatever its case; blank names become NULL."""
    h = F.trim(host)
    tail = "." + suffix.lstrip(".").lower()
    return F.when(h == "", None).when(F.lower(h).endswith(tail), h).otherwise(F.concat(h, F.lit(tail)))


def job_id(c: Column) -> Column:
    return F.nullif(c, F.lit("-"))


def device(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def expand_hostlist(c: Column) -> Column:
    """``c[001-003,007],d9`` as an array of names, zeros kept; one bracket in a name."""
    names = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"([^,\[]+(?:\[[^\]]*\][^,]*)?)"), 1)

    def ranged(name: Column) -> Column:
        head, tail = F.regexp_extract(name, r"^([^\[]*)\[", 1), F.regexp_extract(name, r"\]([^,]*)$", 1)

        def numbers(part: Column) -> Column:
            lo = F.split_part(part, F.lit("-"), F.lit(1))
            hi = F.when(F.contains(part, F.lit("-")), F.split_part(part, F.lit("-"), F.lit(2))).otherwise(lo)
            return F.transform(F.sequence(lo.cast("int"), hi.cast("int")), lambda i: F.concat(head, F.lpad(i.cast("string"), F.greatest(F.length(lo), F.length(i.cast("string"))), "0"), tail))

        return F.flatten(F.transform(F.split(F.regexp_extract(name, r"\[([^\]]*)\]", 1), ","), numbers))

    return F.flatten(F.transform(names, lambda n: F.when(F.contains(n, F.lit("[")), ranged(n)).otherwise(F.array(n))))


def parse_timelimit(c: Column) -> Column:
    """``D-HH:MM:SS`` in seconds; no limit, or anything else: NULL."""
    text = F.lower(F.trim(c))
    part = lambda k: F.nullif(F.regexp_extract(text, r"^(?:(\d+)-)?(\d+):(\d+):(\d+)$", k), F.lit("")).cast("double")
    seconds = F.coalesce(part(1), F.lit(0.0)) * 86400 + part(2) * 3600 + part(3) * 60 + part(4)
    return F.when(~text.isin(*NO_LIMIT), seconds)


def seconds_between(a: Column, b: Column) -> Column:
    return (F.unix_micros(b) - F.unix_micros(a)) / 1_000_000.0


def queue_wait_hours(submit: Column, start: Column) -> Column:
    return F.when(start >= submit, seconds_between(submit, start) / 3600)


def state_token(c: Column) -> Column:
    return F.upper(F.trim(F.split_part(F.trim(c), F.lit("+"), F.lit(1))))


def classify_state(c: Column) -> Column:
    t = state_token(c)
    return (
        F.when(t == "COMPLETED", "completed").when(t == "TIMEOUT", "timeout").when(t.isin(*FAILED), "failed")
        .when(t.startswith("CANCEL"), "canceled").when(t.startswith("PREEMPT"), "preempted")
    )


def decode_throttle(mask: Column) -> Column:
    """Names of the known bits of the low 32, joined by a comma; nothing known: empty."""
    m = F.coalesce(null_sentinels(mask).cast("long"), F.lit(0).cast("long"))
    known = F.array(*[F.when(m.bitwiseAND(F.lit(b).cast("long")) != 0, F.lit(name)) for b, name in THROTTLE_BITS])
    return F.array_join(known, ", ")


def estimate_samples(hosts: Column, runtime: Column, unknown_runtime: float = 3600.0) -> Column:
    """Hosts (one at least) times minutes of runtime, begun minutes whole and one at least."""
    return (F.greatest(F.coalesce(hosts, F.lit(1)), F.lit(1)) * F.greatest(F.ceil(F.coalesce(runtime, F.lit(unknown_runtime)) / 60), F.lit(1))).cast("long")


def time_bucket(c: Column, seconds: int = 300) -> Column:
    """The start of the bucket, in unix seconds."""
    return (F.floor(F.unix_seconds(c) / seconds) * seconds).cast("long")


def padded_window(start: Column, end: Column, now: Column, pad: int = 3600) -> tuple[Column, Column]:
    """Start less, end plus ``pad`` seconds; an open end is now, an end before the start is the start."""
    till = F.greatest(F.coalesce(end, now), start)
    return F.unix_seconds(start) - pad, F.unix_seconds(till) + pad


def fingerprint(*columns: Column) -> Column:
    """sha-256 of a canonical text of the inputs."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("~")) for c in columns]), 256)
