"""Names, paths and other texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .values import blank

# File suffixes by language, and folders that no scan enters.
SUFFIXES = {"java": ("java",), "c": ("c", "h"), "cpp": ("cpp", "cc", "cxx", "c", "h", "hpp", "hh")}
IGNORED = ("target", "build", "node_modules")


def is_source(path: Column, language: str) -> Column:
    return F.lower(path).rlike(r"\.(?:" + "|".join(SUFFIXES[language]) + ")$")


def is_ignored(path: Column) -> Column:
    """Whether a part of the relative path starts with a dot or is a folder of IGNORED."""
    return F.exists(F.split(path, "/"), lambda part: part.startswith(".") | part.isin(*IGNORED))


def language_of(path: Column) -> Column:
    """Java, C or C++ by suffix; null for others. Headers are C++."""
    low = F.lower(path)
    return F.when(low.endswith(".java"), "Java").when(low.endswith(".c"), "C").when(low.rlike(r"\.(?:cpp|cc|cxx|h|hpp|hh)$"), "C++")


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, r"[/\\]"), -1)


def relativize(path: Column, root: Column) -> Column:
    """The path without the root before it."""
    return F.when(F.startswith(path, F.concat(root, F.lit("/"))), F.substr(path, F.length(root) + 2)).otherwise(path)


def file_key(value: Column) -> Column:
    """struct<project, path> of a `project:path` id; null if nothing stands before the first colon."""
    at = F.instr(value, ":")
    return F.when(at > 1, F.struct(F.substr(value, F.lit(1), at - 1).alias("project"), F.substr(value, at + 1).alias("path")))


def qualify(name: Column, owner: Column) -> Column:
    """A name without a dot gets the package of its owner."""
    package = F.regexp_extract(owner, r"^(.*)\.[^.]*$", 1)
    return F.when(name.contains(".") | (package == ""), name).otherwise(F.concat(package, F.lit("."), name))


def safe(name: Column) -> Column:
    return F.regexp_replace(name, r"[\[\]()\s]", "")


def short_name(value: Column) -> Column:
    """The last part of an id's name, before any signature; `external` for none."""
    base = F.substring_index(value, "#", 1)
    return F.coalesce(safe(F.substring_index(blank(base), ".", -1)), F.lit("external"))


def node_name(value: Column) -> Column:
    """A name that a diagram takes."""
    return F.regexp_replace(short_name(value), "[^A-Za-z0-9_]", "_")


def external_bucket(target: Column) -> Column:
    return F.concat(F.lit("ext:"), F.coalesce(target, F.lit("external")))


def macro_parameters(text: Column) -> Column:
    """What stands between the first `(` and the last `)`."""
    return blank(F.regexp_extract(text, r"(?s)\((.*)\)", 1))


def duration_text(millis: Column) -> Column:
    """`ms` below a second, else seconds with one decimal."""
    return F.when(millis < 1000, F.concat(millis.cast("string"), F.lit("ms"))).otherwise(F.concat(F.format_number(millis / 1000, 1), F.lit("s")))


def chat_url(base: Column) -> Column:
    """The completions address of a service by its base address."""
    cut = F.regexp_replace(base, "/+$", "")
    return F.when(cut.endswith("/chat/completions"), cut).when(cut.endswith("/v1"), F.concat(cut, F.lit("/chat/completions"))).otherwise(F.concat(cut, F.lit("/v1/chat/completions")))


def backoff_millis(base: Column, attempt: Column) -> Column:
    """base * 2^(min(attempt, 10) - 1), at most 15 s; jitter is the caller's."""
    return F.least(base * F.pow(F.lit(2), F.least(attempt, F.lit(10)) - 1), F.lit(15000)).cast("long")


def template(text: str, **values: Column) -> Column:
    """``text`` with each `${name}` replaced by a column."""
    out: list[Column] = []
    for i, part in enumerate(text.split("${")):
        name, end, rest = part.partition("}") if i else ("", "", part)
        out += ([F.coalesce(values[name].cast("string"), F.lit(""))] if end else []) + [F.lit(rest)]
    return F.concat(*out)
