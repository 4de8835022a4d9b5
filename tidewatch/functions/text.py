"""Identifiers, hashes and time text."""

from pyspark.sql import Column, functions as F


def short_id(prefix: str, *parts: Column) -> Column:
    """Readable label: prefix and eight hex digits of the MD5 of the joined parts.

    Thirty-two bits collide on large tables, so rows are always joined and counted on the
    parts themselves, never on this label.
    """
    digest = F.md5(F.concat_ws("|", *parts))
    return F.concat(F.lit(prefix + "-"), F.upper(F.substring(digest, 1, 8)))


def name_uuid(name: Column) -> Column:
    """Name-based UUID, version 3, without a name space."""
    h = F.md5(name)
    variant = F.conv(F.substring(h, 17, 2), 16, 10).cast("int").bitwiseAND(63).bitwiseOR(128)
    return F.concat(
        F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-3"), F.substring(h, 14, 3),
        F.lit("-"), F.lower(F.hex(variant)), F.substring(h, 19, 2), F.lit("-"), F.substring(h, 21, 12),
    )


def polynomial_hash_hex(text: Column) -> Column:
    """Upper-case hex of the 31-polynomial hash of the UTF-16 units, modulo 2**32."""
    units = F.regexp_extract_all(F.hex(F.encode(text, "UTF-16BE")), F.lit("(.{4})"), F.lit(1))
    total = F.aggregate(
        units, F.lit(0).cast("long"),
        lambda acc, unit: (acc * 31 + F.conv(unit, 16, 10).cast("long")) % 4294967296,
    )
    return F.hex(total)


_INSTANT = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{1,9})?(Z|[+-]\d{2}:\d{2})$"


def instant_ms(text: Column) -> Column:
    """Epoch milliseconds of an ISO-8601 instant, null for any other text."""
    return F.when(text.rlike(_INSTANT), F.unix_millis(text.try_cast("timestamp")))


def iso_instant(ms: Column) -> Column:
    """ISO-8601 text of epoch milliseconds; the fraction is left out when it is zero."""
    ts = F.timestamp_millis(ms)
    return F.when(
        ms % 1000 == 0, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    ).otherwise(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))


def has_word(text: Column, words) -> Column:
    """True where the lower-cased text contains one of the words."""
    lowered = F.lower(text)
    found = F.lit(False)
    for word in words:
        found = found | lowered.contains(word)
    return found


def last_wins(values: Column) -> Column:
    """A parsed map without repeated keys: of equal keys the last entry stays."""
    keys = F.map_keys(values)

    def is_last(entry: Column, place: Column) -> Column:
        return F.array_position(F.reverse(keys), entry["key"]) == F.size(keys) - place

    once = F.map_from_entries(F.filter(F.map_entries(values), is_last))
    return F.when(F.size(F.array_distinct(keys)) < F.size(keys), once).otherwise(values)


def first_of(values: Column, *keys: str) -> Column:
    """First non-null value of a map under the given keys."""
    return F.coalesce(*[values[key] for key in keys])
