"""Text expressions: identifiers, key=value lines, list arguments, locations, markers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed patterns and formats of the data contract.
IDENTIFIER_PATTERN = "^[a-z_][a-z0-9_]*$"
QUERY_BEGIN_PATTERN = r"^__MVP_QUERY_BEGIN_(\d+)__$"
QUERY_END_PATTERN = r"^__MVP_QUERY_END_(\d+)__$"
TIME_PATTERN = r"^Time:\s+([0-9]+(?:\.[0-9]+)?)\s+ms\s*$"
ROW_ID_PATTERN = r"^-?\d+$"
METADATA_VERSION_PATTERN = r"(?:^|/)v(\d+)\.metadata\.json$"


def _col(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def strip(value) -> Column:
    """Remove white space (blank, tab, line and page breaks) at both ends."""
    return F.trim(_col(value), F.lit(" \t\n\r\x0b\x0c"))


def is_identifier(value) -> Column:
    return _col(value).rlike(IDENTIFIER_PATTERN)


def setting_key_value(line) -> Column:
    """``struct(key, value)`` of an ``export KEY=value`` line, NULL for anything else."""
    text = strip(line)
    body = F.when(text.startswith("export "), strip(F.substring(text, 8, 1 << 30))).otherwise(text)
    at = F.instr(body, "=")
    value = strip(F.substr(body, at + 1))
    bare = F.regexp_replace(value, "^['\"]+|['\"]+$", "")
    pair = F.struct(strip(F.substr(body, F.lit(1), at - 1)).alias("key"), bare.alias("value"))
    usable = (F.length(text) > 0) & ~text.startswith("#") & (at > 0)
    return F.when(usable, pair)


def positive_ints(text) -> Column:
    """Comma list of positive integers in input order; NULL when any item is not one."""
    items = F.transform(F.split(_col(text), ","), lambda x: strip(x).try_cast("int"))
    bad = F.exists(items, lambda x: x.isNull() | (x < 1))
    return F.when(~bad, items)


def local_path(location) -> Column:
    """Path of a bare absolute path or ``file:`` URI with escapes decoded, else NULL."""
    raw = _col(location)
    rest = (
        F.when(raw.startswith("file:///"), F.substr(raw, F.lit(8)))
        .when(raw.startswith("file://localhost/"), F.substr(raw, F.lit(17)))
        .when(raw.startswith("file:/") & ~raw.startswith("file://"), F.substr(raw, F.lit(6)))
    )
    escaped = F.try_url_decode(F.replace(rest, F.lit("+"), F.lit("%2B")))
    plain = F.when(F.contains(raw, F.lit("%")), escaped).otherwise(rest)
    return F.when(raw.startswith("/"), raw).otherwise(plain)


def missing_markers(text, markers: list[str]) -> Column:
    """Markers that do not occur in ``text``, letter case ignored."""
    low = F.lower(_col(text))
    wanted = F.array(*[F.lit(m) for m in markers])
    return F.filter(wanted, lambda m: ~F.contains(low, F.lower(m)))


def scenario_label(mode, k, dop, round_no) -> Column:
    return F.format_string("%s-k%d-dop%d-r%d", _col(mode), _col(k), _col(dop), _col(round_no))


def metadata_version(path) -> Column:
    """Number in ``vN.metadata.json`` as an integer, NULL for other names."""
    digits = F.regexp_extract(_col(path), METADATA_VERSION_PATTERN, 1)
    return F.when(F.length(digits) > 0, digits.cast("long"))


def setting_or(settings, key: str, default) -> Column:
    """Map value with a default."""
    return F.coalesce(_col(settings)[key], F.lit(default))
