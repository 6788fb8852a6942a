"""Scalar functions as Column expressions: paths, relations, digests, numbers and instants. All run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Ticks of 100 ns from year 1 to 1970, names that devices have, labels of two sets.
TICKS_AT_EPOCH = 621_355_968_000_000_000
DEVICE = r"(?i)^(CON|PRN|AUX|NUL|COM[1-9¹²³]|LPT[1-9¹²³])(\.|$)"
LABELS = ("EXACT_CHART_SET", "A_SUBSET_OF_B", "B_SUBSET_OF_A", "HIGH_OVERLAP", "MEDIUM_OVERLAP", "SHARED_CHARTS")


def slashes(path: Column) -> Column:
    return F.translate(path, "\\", "/")


def parent(path: Column) -> Column:
    """What stands before the last slash; empty without one."""
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit(""))


def name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """From the name's last dot, lower case; empty without one."""
    return F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))


def stem(path: Column) -> Column:
    return F.regexp_replace(path, r"\.[^./]*$", "")


def depth(path: Column) -> Column:
    return F.size(F.split(path, "/")) - 1


def ancestors(path: Column, own: bool = False) -> Column:
    """Each folder above the path, outermost first; with own also the path itself."""
    parts = F.split(path, "/")
    n = F.size(parts) if own else F.size(parts) - 1
    return F.transform(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")), lambda i: F.array_join(F.slice(parts, 1, i), "/"))


def contains(folder: Column, path: Column) -> Column:
    return (path == folder) | F.startswith(path, F.concat(folder, F.lit("/")))


def relative(root: Column, path: Column) -> Column:
    return F.when(path == root, F.lit(".")).otherwise(F.substr(path, F.length(root) + 2))


def rooted(path: Column) -> Column:
    return path.rlike(r"^([/\\]|[A-Za-z]:)")


def unsafe_segment(segment: Column) -> Column:
    """Names that Windows would read as something else: devices, short names, reserved signs, a dot or space at the end."""
    return ~segment.isin(".", "..") & ((segment == "") | segment.rlike(r"[. ]$") | segment.rlike(r'[\x00-\x1f<>:"|?*]') | segment.rlike(DEVICE) | segment.rlike("~[0-9]"))


def lexical_resolve(base: Column, authored: Column) -> Column:
    """base/authored with `.` and `..` taken out; null where it climbs above the root."""
    start = F.when(base == "", F.array().cast("array<string>")).otherwise(F.split(slashes(base), "/"))

    def step(acc: Column, part: Column) -> Column:
        up = F.when(F.size(acc) > 0, F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
        return F.when(acc.isNull() | (part == "."), acc).when(part == "..", up).otherwise(F.concat(acc, F.array(part)))

    return F.array_join(F.aggregate(F.split(slashes(authored), "/"), start, step), "/")


def is_digest(value: Column, length: int = 64) -> Column:
    return value.rlike(f"^[0-9a-f]{{{length}}}$")


def padded_id(kind: Column, number: Column) -> Column:
    return F.format_string("%s_%06d", kind, number)


def coverage(common: Column, size: Column) -> Column:
    return common.cast("double") / size.cast("double")


def jaccard(common: Column, a: Column, b: Column) -> Column:
    return common.cast("double") / (a + b - common).cast("double")


def relationship(a: Column, b: Column, common: Column) -> Column:
    """Label of two sets by their sizes and their common part; thresholds are exact in integers. Impossible sizes raise."""
    a, b, common = a.cast("long"), b.cast("long"), common.cast("long")
    most = F.greatest(a, b)
    bad = (common <= 0) | (common > F.least(a, b))
    out = F.when(bad, F.raise_error(F.lit("common part must be positive and no larger than either set")).cast("string"))
    out = out.when((a == common) & (b == common), LABELS[0]).when(a == common, LABELS[1]).when(b == common, LABELS[2])
    return out.when(5 * common >= 4 * most, LABELS[3]).when(2 * common >= most, LABELS[4]).otherwise(LABELS[5])


def pair_count(n: Column) -> Column:
    n = n.cast("decimal(38,0)")
    return (n * (n - 1) / 2).cast("decimal(38,0)")


def strict_positive(text: Column) -> Column:
    """An int above 0 from digits alone; null otherwise."""
    value = F.when(text.rlike("^[0-9]+$"), F.try_to_number(text, F.lit("9" * 19)).cast("long"))
    return F.when((value > 0) & (value <= 2**31 - 1), value.cast("int"))


def floor_div(x: Column, n: int) -> Column:
    """x / n rounded down, in integers: ticks are larger than doubles hold exactly."""
    return F.call_function("div", x - F.pmod(x, F.lit(n)), F.lit(n))


def ticks_to_timestamp(ticks: Column) -> Column:
    """100 ns ticks since year 1 as an instant; the last digit goes, as instants hold microseconds."""
    return F.timestamp_micros(floor_div(ticks - F.lit(TICKS_AT_EPOCH), 10))


def ticks_to_text(ticks: Column) -> Column:
    """ISO 8601 with seven fractional digits and Z."""
    since = ticks - F.lit(TICKS_AT_EPOCH)
    whole = F.date_format(F.timestamp_seconds(floor_div(since, 10_000_000)), "yyyy-MM-dd'T'HH:mm:ss")
    return F.concat(whole, F.lit("."), F.lpad(F.pmod(since, F.lit(10_000_000)).cast("string"), 7, "0"), F.lit("Z"))


def ordinal(text: Column) -> Column:
    """A key that sorts as UTF-16 code units do; the default order is that of UTF-8 bytes."""
    return F.encode(text, "UTF-16BE")


def json_pointer(part: Column) -> Column:
    return F.replace(F.replace(part, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))


def token(value: Column) -> Column:
    """Canonical bytes of a cell: its length as four bytes and its UTF-8; null is four bytes of 255."""
    raw = F.encode(value.cast("string"), "UTF-8")
    return F.coalesce(F.concat(F.unhex(F.lpad(F.hex(F.octet_length(raw).cast("long")), 8, "0")), raw), F.unhex(F.lit("ffffffff")))


def build_revision(text: Column) -> Column:
    """state and revision of a build string `version+40 hex digits`, with `.dirty` or `-dirty` after it for a changed tree."""
    revision = F.regexp_extract(text, r"\+([0-9a-f]{40})(?:[.-]dirty)?$", 1)
    state = F.when(revision == "", "UNKNOWN").when(text.rlike("[.-]dirty$"), "DIRTY").otherwise("CLEAN")
    return F.struct(state.alias("state"), F.nullif(revision, F.lit("")).alias("revision"))
