"""Vector expressions over array columns, evaluated in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column | str) -> Column:
    return (F.col(v) if isinstance(v, str) else v).cast("array<double>")


def dot(a: Column | str, b: Column | str) -> Column:
    """Inner product, summed left to right in double precision."""
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def distance(a: Column | str, b: Column | str) -> Column:
    return F.lit(1.0) - dot(a, b)


def norm(v: Column | str) -> Column:
    return F.sqrt(dot(v, v))


def normalized(v: Column | str) -> Column:
    """Unit vector; a zero, null-holding or non-finite vector raises."""
    d = doubles(v)
    n = norm(v)
    ok = F.forall(d, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & (n > 0)
    return F.when(ok, F.transform(d, lambda x: x / n)).otherwise(F.raise_error(F.lit("vector must be finite and not zero")).cast("array<double>"))


def windows(values: Column | str, size: int, hop: int, most: int = 21) -> Column:
    """Sliding windows: `size` values every `hop`, at most `most`; a partial tail is dropped, short input has none."""
    v = F.col(values) if isinstance(values, str) else values
    count = F.least(F.lit(most), F.floor((F.size(v) - size) / hop).cast("int") + 1)
    return F.when(F.size(v) >= size, F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.slice(v, i * hop + 1, size))).otherwise(F.array())


def level(seed: int, key: Column | str, m: int) -> Column:
    """Exponential graph level floor(-ln(u) / ln(m)), u from the MD5 of seed and key."""
    k = F.col(key) if isinstance(key, str) else key
    u = (F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), k.cast("string"))), 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.floor(-F.log(u) / F.log(F.lit(float(m)))).cast("int")


def hash_order(seed: int, key: Column | str) -> Column:
    """A seeded order that any engine can repeat."""
    return F.md5(F.concat(F.lit(f"{seed}:"), (F.col(key) if isinstance(key, str) else key).cast("string")))


def clock(seconds: Column | str) -> Column:
    """m:ss"""
    s = (F.col(seconds) if isinstance(seconds, str) else seconds).cast("long")
    return F.format_string("%d:%02d", F.floor(s / 60), s % 60)


def quoted(text: Column | str) -> Column:
    """Form encoding of a URL's query: only letters, digits and _.-~ stay, a space is a plus."""
    return F.replace(F.replace(F.url_encode(text), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
