"""Expressions and transforms over file names, sizes and types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Types by file name ending, and what uploads allow.
MIME_BY_EXTENSION = {
    ".pdf": "application/pdf",
    ".png": "image/png",
    ".jpg": "image/jpeg",
    ".jpeg": "image/jpeg",
    ".tiff": "image/tiff",
    ".tif": "image/tiff",
    ".bmp": "image/bmp",
    ".webp": "image/webp",
}
MAX_MB = 50


def extension(name: Column) -> Column:
    """Lower-cased ending with its dot, or ''."""
    return F.lower(F.regexp_extract(name, r"[^/.](\.[^./]*)$", 1))


def mime_type(name: Column) -> Column:
    e = extension(name)
    out = F.when(F.lit(False), F.lit(""))
    for k, v in MIME_BY_EXTENSION.items():
        out = out.when(e == k, v)
    return out


def safe_name(name: Column) -> Column:
    """Base name with reserved characters as underscores; over 200 characters the stem is cut."""
    base = F.translate(F.regexp_extract(name, r"([^/]*)$", 1), '<>:"/\\|?*', "_________")
    e = F.regexp_extract(base, r"[^.](\.[^.]*)$", 1)
    stem = F.substring(base, F.lit(1), F.length(base) - F.length(e))
    return F.when(F.length(base) > 200, F.concat(F.substring(stem, F.lit(1), F.lit(200) - F.length(e)), e)).otherwise(base)


def validated(files: DataFrame, name: str, size: str, mime: str | None = None) -> DataFrame:
    """Verdict columns; bad rows are marked, not raised."""
    guessed = F.coalesce(F.col(mime) if mime else F.lit(None).cast("string"), mime_type(F.col(name)), F.lit("application/octet-stream"))
    allowed = guessed.isin(*sorted(set(MIME_BY_EXTENSION.values()))) | extension(F.col(name)).isin(*MIME_BY_EXTENSION)
    small = F.col(size) <= MAX_MB * 1024 * 1024
    return files.withColumns(
        {
            "mime": guessed,
            "valid": allowed & small,
            "error": F.when(~small, "too large").when(~allowed, "type not allowed"),
            "is_pdf": guessed == "application/pdf",
            "is_image": guessed.startswith("image/"),
        }
    )


def page_range(start: Column, end: Column, total: Column) -> tuple[Column, Column, Column]:
    """Start, end and an error flag: a start under 1 is 1, an end of -1 or past the total is the total."""
    s = F.greatest(start, F.lit(1))
    e = F.when((end == -1) | (end > total), total).otherwise(end)
    return s, e, (s > total) | (e < s)


def expired(files: DataFrame, modified: str, as_of, days: int) -> DataFrame:
    """Files older than so many days: the plan of a clean-up; deleting is the caller's."""
    return files.filter(F.col(modified) < F.lit(as_of) - F.expr(f"INTERVAL {days} DAYS"))
