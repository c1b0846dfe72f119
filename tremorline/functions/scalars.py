"""Column functions; all stay inside the JVM."""
from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

# File extensions that count as code.
CODE_EXTENSIONS = [
    ".py", ".js", ".ts", ".tsx", ".jsx", ".java", ".go", ".rs", ".rb",
    ".c", ".cpp", ".h", ".hpp", ".cs", ".kt", ".swift",
]

# Whole words that mark a bug-fix commit.
BUGFIX_PATTERN = (
    r"(?iU)\b(?:fix(?:e[ds])?|bug|error|defect|patch|issue|crash|fault|repair|resolve[ds]?|hotfix)\b"
)

# Band limits on the 0-100 risk score and their colours.
MEDIUM_FROM, HIGH_FROM, CRITICAL_FROM = 40.0, 70.0, 80.0
BAND_COLOURS = {"LOW": "#3fb950", "MED": "#d29922", "HIGH": "#f85149"}

# Upper limits of complexity grades 1-5; anything above is grade 6.
GRADE_LIMITS = (5.0, 10.0, 20.0, 30.0, 40.0)
HIGH_COMPLEXITY_ABOVE = 10.0


def file_suffix(path: Column) -> Column:
    """Last suffix of the last path segment, dot included; empty for dot-files and trailing dots."""
    return F.regexp_extract(path, r"[^/](\.[^./]+)$", 1)


def code_file_flag(path: Column) -> Column:
    return F.lower(file_suffix(path)).isin(CODE_EXTENSIONS)


def resolve_path(new_path: Column, old_path: Column) -> Column:
    return F.coalesce(new_path, old_path)


def is_bugfix_message(message: Column) -> Column:
    return F.coalesce(F.regexp_like(message, F.lit(BUGFIX_PATTERN)), F.lit(False))


def utc_commit_date(date: Column, offset: Column | None = None) -> Column:
    """Commit time in UTC. ``offset`` is the author's zone (e.g. ``+02:00``); none means UTC.

    The session time zone has to be UTC, as ``SESSION_DEFAULTS`` sets it.
    """
    moment = date.cast("timestamp")
    if offset is None:
        return moment
    return F.to_utc_timestamp(moment, F.coalesce(offset, F.lit("UTC")))


def moment(at: datetime | Column) -> Column:
    """A point in time as a column; datetimes without a zone are UTC."""
    if isinstance(at, Column):
        return at.cast("timestamp")
    return F.lit(at if at.tzinfo else at.replace(tzinfo=timezone.utc))


def lines_changed(added: Column, deleted: Column) -> Column:
    """Null when either side is unknown, so sums leave the row out."""
    return added + deleted


def repo_slug(url: Column) -> Column:
    """Struct of owner, name and ``owner_name``; missing owners read ``unknown``."""
    trimmed = F.regexp_replace(F.regexp_replace(url, r"/+\z", ""), r"\.git\z", "")
    parts = F.split(trimmed, "/")
    owner = F.when(F.size(parts) >= 2, F.try_element_at(parts, F.lit(-2))).otherwise(F.lit("unknown"))
    name = F.coalesce(F.try_element_at(parts, F.lit(-1)), F.lit("repo"))
    return F.struct(
        owner.alias("owner"), name.alias("name"), F.concat_ws("_", owner, name).alias("slug")
    )


def repo_display_name(url: Column) -> Column:
    """``owner / name`` for headings, or the URL itself when a part is empty."""
    parts = F.split(F.regexp_replace(url, r"/\z", ""), "/")
    owner = F.coalesce(F.try_element_at(parts, F.lit(-2)), F.lit(""))
    name = F.coalesce(F.try_element_at(parts, F.lit(-1)), F.lit(""))
    return F.when((owner != "") & (name != ""), F.concat(owner, F.lit(" / "), name)).otherwise(url)


def shorten_path(path: Column) -> Column:
    parts = F.filter(F.split(path, "/"), lambda part: ~part.isin("", "."))
    return F.when(F.size(parts) >= 2, F.concat_ws("/", F.slice(parts, -2, 2))).otherwise(path)


def exact_round(value: Column, decimals: int) -> Column:
    """Round the exact binary value, ties to even; SQL ``round`` and ``bround`` start from its decimal text.

    ``low`` is what the product with the power of ten lost, by Dekker's splitting (1971).
    """
    power = F.lit(float(10**decimals))
    head = value * F.lit(134217729.0) - (value * F.lit(134217729.0) - value)
    product = value * power
    low = (head * power - product) + (value - head) * power
    whole = F.floor(product)
    above_half = (product - whole) - F.lit(0.5) + low
    up = (above_half > 0) | ((above_half == 0) & (whole % 2 != 0))
    return (whole + up.cast("bigint")) / power


def fixed_text(value: Column, decimals: int) -> Column:
    return F.format_string(f"%.{decimals}f", exact_round(value, decimals))


def risk_score(probability: Column) -> Column:
    return exact_round(probability * 100, 1)


def risk_band(score: Column) -> Column:
    return F.when(score < MEDIUM_FROM, "LOW").when(score < HIGH_FROM, "MED").otherwise("HIGH")


def risk_colour(score: Column) -> Column:
    return (
        F.when(score < MEDIUM_FROM, BAND_COLOURS["LOW"])
        .when(score < HIGH_FROM, BAND_COLOURS["MED"])
        .otherwise(BAND_COLOURS["HIGH"])
    )


def is_critical(score: Column) -> Column:
    return score >= CRITICAL_FROM


def complexity_grade(mean: Column, limits: tuple[float, ...] = GRADE_LIMITS) -> Column:
    grade = F.lit(len(limits) + 1)
    for position in range(len(limits), 0, -1):
        grade = F.when(mean <= limits[position - 1], F.lit(position)).otherwise(grade)
    return grade.cast("bigint")


def high_complexity(mean: Column) -> Column:
    return (mean > HIGH_COMPLEXITY_ABOVE).cast("bigint")
