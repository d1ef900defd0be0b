"""Scalar expressions: addresses, wire numbers, calendar, text and the rule predicates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Indian Standard Time, ahead of UTC by so many seconds; calendar days and hours are in it.
IST = 19800
#: Private and other local IPv4 ranges as (first, last).
PRIVATE_RANGES = [
    ("10.0.0.0", "10.255.255.255"), ("172.16.0.0", "172.31.255.255"), ("192.168.0.0", "192.168.255.255"),
    ("100.64.0.0", "100.127.255.255"), ("127.0.0.0", "127.255.255.255"), ("169.254.0.0", "169.254.255.255"),
]
PROTOCOLS = {"TCP": 6, "UDP": 17, "ICMP": 1}


def ip(text: str) -> int:
    return reduce(lambda n, part: n * 256 + int(part), text.split("."), 0)


def inet_aton(text: Column) -> Column:
    """Dotted IPv4 text as a number; null for anything else."""
    parts = F.split(text, r"\.")
    number = reduce(lambda n, i: n * 256 + F.element_at(parts, i).try_cast("long"), range(2, 5), F.element_at(parts, 1).try_cast("long"))
    return F.when(text.rlike(r"^(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?!$)|$)){4}$"), number)


def inet_ntoa(number: Column) -> Column:
    """A number as dotted IPv4 text."""
    return F.concat_ws(".", *[F.shiftright(number, s).bitwiseAND(F.lit(255)).cast("string") for s in (24, 16, 8, 0)])


def uint(data: Column) -> Column:
    """Big-endian unsigned number from at most the last 8 bytes; above 2**63 - 1 it wraps. Empty is 0."""
    return F.coalesce(F.conv(F.hex(F.substring(data, -8, 8)), 16, -10).cast("long"), F.lit(0).cast("long"))


def field(data: Column, at: int | Column, size: int) -> Column:
    """The unsigned number in `size` bytes of a binary column from a 0-based place."""
    start = F.lit(at + 1) if isinstance(at, int) else at.cast("int") + 1
    return uint(F.substring(data, start, F.lit(size)))


def ms_to_timestamp(ms: Column) -> Column:
    return F.timestamp_millis(ms)


def epoch(ts: Column) -> Column:
    return F.unix_seconds(ts)


def at_epoch(seconds: Column) -> Column:
    return F.timestamp_seconds(seconds)


def ist_date(seconds: Column) -> Column:
    """The IST calendar date of epoch seconds, whatever the session's zone."""
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor((seconds + IST) / 86400).cast("int"))


def ist_hour(seconds: Column) -> Column:
    return F.floor(F.pmod(seconds + IST, F.lit(86400)) / 3600).cast("int")


def ist_clock(seconds: Column) -> Column:
    return duration(F.pmod(seconds + IST, F.lit(86400)))


def ist_text(seconds: Column) -> Column:
    return F.concat(ist_date(seconds).cast("string"), F.lit(" "), ist_clock(seconds))


def ist_seconds(naive: Column) -> Column:
    """Epoch seconds of an IST wall-clock time that was read as TIMESTAMP_NTZ."""
    days = F.datediff(naive.cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    return days * 86400 + F.hour(naive) * 3600 + F.minute(naive) * 60 + F.floor(F.second(naive)) - IST


def parse_time(text: Column) -> Column:
    """Epoch seconds of form input in five layouts, in IST where it names no zone; null for empty or other text."""
    text = F.trim(text)
    naive = [F.try_to_timestamp(text, F.lit(f)).cast("timestamp_ntz") for f in ("yyyy-MM-dd'T'HH:mm", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd HH:mm:ss")]
    zoned = F.unix_seconds(F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ssXXX")))
    return F.when(text.rlike(r"(Z|[+-]\d\d:\d\d)$"), zoned).otherwise(ist_seconds(F.coalesce(*naive)))


def parse_best_effort(text: Column) -> Column:
    """Epoch seconds of `yyyy-MM-dd HH:mm:ss` in UTC, else null."""
    return ist_seconds(F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss")).cast("timestamp_ntz")) + IST


def protocol_name(number: Column) -> Column:
    return F.when(number == 6, "TCP").when(number == 17, "UDP").when(number == 1, "ICMP").otherwise("OTH")


def protocol_number(name: Column) -> Column:
    """0 for a name that is none of the known ones."""
    name = F.upper(name)
    return F.when(name == "TCP", 6).when(name == "UDP", 17).when(name == "ICMP", 1).otherwise(0)


def human_bytes(n: Column) -> Column:
    """Units of 1024, one decimal from K on, halves to the even digit as C and Go print them; Java's formats round them up."""
    out = F.concat(n.cast("string"), F.lit(" B"))
    exact = n.cast("double").cast("long")  # what a double holds of a number beyond 2**53
    for i, unit in enumerate("KMGTPE"):
        bits = 10 * (i + 1)
        drop = max(0, bits - 56)  # bits that are 0 in numbers of this size; tenfold the others fits a long
        rest = F.shiftright(exact.bitwiseAND(F.lit((1 << bits) - 1)), drop) * 10
        tenth, over, half = F.shiftright(rest, bits - drop), rest.bitwiseAND(F.lit((1 << bits - drop) - 1)), 1 << bits - drop - 1
        tenths = F.shiftright(exact, bits) * 10 + tenth + F.when((over > half) | (over == half) & (tenth % 2 == 1), 1).otherwise(0)
        out = F.when(n >= F.lit(1 << bits), F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit(f" {unit}iB"))).otherwise(out)
    return out


def grouped(n: Column) -> Column:
    return F.format_number(n, 0)


def percent(n: Column, of: Column) -> Column:
    return F.concat(F.when(of == 0, F.lit(0)).otherwise(F.least(F.floor(n * 100 / F.greatest(of, F.lit(1))), F.lit(100))).cast("string"), F.lit("%"))


def duration(seconds: Column) -> Column:
    return F.when(seconds.isNotNull(), F.format_string("%02d:%02d:%02d", F.floor(seconds / 3600), F.floor(seconds % 3600 / 60), seconds % 60))


def round1(x: Column) -> Column:
    return F.floor(x * 10 + 0.5) / 10


def formula_safe(text: Column) -> Column:
    """A cell that a spreadsheet would run gets a leading quote."""
    return F.when(F.substring(text, 1, 1).isin("=", "+", "-", "@", "\t", "\r"), F.concat(F.lit("'"), text)).otherwise(text)


def or_dash(text: Column) -> Column:
    return F.coalesce(F.when(F.trim(text) != "", text), F.lit("—"))


def first_non_empty(*texts: Column) -> Column:
    return F.coalesce(*[F.when(t != "", t) for t in texts], F.lit(""))


def port_or_blank(n: Column) -> Column:
    return F.when(n > 0, n.cast("string")).otherwise("")


def or_any(seconds: Column) -> Column:
    return F.coalesce(F.substring(ist_text(seconds), 1, 16), F.lit("any"))


def exporter_key(isp: Column, address: Column) -> Column:
    return F.concat_ws("|", isp.cast("string"), inet_ntoa(address))


def archive_path(isp: Column, day: Column) -> Column:
    return F.concat(F.lit("isp_id="), isp.cast("string"), F.date_format(day, "'/year='yyyy'/month='MM'/day='dd"))


def is_zero_bytes(n: Column) -> Column:
    return n == 0


def is_dns(src_port: Column, dst_port: Column) -> Column:
    return (src_port == 53) | (dst_port == 53)


def is_private(number: Column) -> Column:
    """Whether an IPv4 number lies in a private or local range."""
    return reduce(lambda a, b: a | b, [number.between(ip(lo), ip(hi)) for lo, hi in PRIVATE_RANGES])


def is_private_v6(address: Column) -> Column:
    """Loopback, link-local or unique-local, of 16 bytes."""
    text = F.hex(address)
    return (F.length(address) == 16) & ((text == "0" * 31 + "1") | text.rlike("^FE[89AB]") | text.rlike("^F[CD]"))


def is_private_binary(address: Column) -> Column:
    """The test on wire bytes of either family, before coercion to IPv4."""
    return F.coalesce(F.when(F.length(address) == 4, is_private(uint(address))).otherwise(is_private_v6(address)), F.lit(False))


def coerce_ipv4(address: Column) -> Column:
    """The number of 4 wire bytes; anything else is 0."""
    return F.when(F.length(address) == 4, uint(address)).otherwise(F.lit(0).cast("long"))


def has_translation(src_ip: Column, src_port: Column, nat_ip: Column, nat_port: Column) -> Column:
    """Whether the public endpoint is there and differs from the private one."""
    return (nat_ip != 0) & ~((nat_ip == src_ip) & (nat_port == src_port))


def fnv1a(data: Column) -> Column:
    """32-bit FNV-1a of a binary column."""
    text = F.hex(data)
    places = F.when(F.length(data) > 0, F.sequence(F.lit(1), F.length(data))).otherwise(F.array().cast("array<int>"))
    octet = lambda i: F.conv(F.substring(text, i * 2 - 1, F.lit(2)), 16, 10).cast("long")
    return F.aggregate(places, F.lit(2166136261).cast("long"), lambda h, i: (h.bitwiseXOR(octet(i)) * F.lit(16777619).cast("long")).bitwiseAND(F.lit(4294967295).cast("long")))
