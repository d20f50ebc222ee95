"""Column expressions over member paths, names and index lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_safe(path: Column) -> Column:
    """No backslash and no empty, ``.`` or ``..`` segment, so neither a leading nor a trailing slash."""
    return ~path.contains("\\") & ~path.rlike(r"(^|/)(\.{0,2})(/|\z)")


def is_warc(path: Column) -> Column:
    return is_safe(path) & path.rlike(r"^archive/[^/]+\.warc(\.gz)?\z")


def warc_gzip(name: Column) -> Column:
    """True for ``.warc.gz``, false for ``.warc``, null for other names."""
    return F.when(name.endswith(".warc.gz"), True).when(name.endswith(".warc"), False)


def is_cdxj_index(path: Column) -> Column:
    return is_safe(path) & path.rlike(r"^indexes/[^/]+\.cdxj?(\.gz)?\z")


def is_zipnum_data(path: Column) -> Column:
    return is_safe(path) & path.rlike(r"^indexes/[^/]+\.cdx\.gz\z")


def is_zipnum_summary(path: Column) -> Column:
    return is_safe(path) & path.rlike(r"^indexes/[^/]+\.idx\z")


def valid_index_name(name: Column) -> Column:
    return ~name.contains("/") & is_safe(name) & name.endswith(".cdx")


def valid_name(name: Column) -> Column:
    return name.rlike(r"\A[a-z0-9._-]+\z")


def zipnum_partner(path: Column) -> Column:
    """The summary of a data path and the data of a summary path; null for others."""
    return F.when(path.endswith(".cdx.gz"), F.concat(F.left(path, F.length(path) - 7), F.lit(".idx"))).when(
        path.endswith(".idx"), F.concat(F.left(path, F.length(path) - 4), F.lit(".cdx.gz")))


def requires_stored(path: Column) -> Column:
    return path.startswith("archive/") | path.endswith(".gz")


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def direct_name(path: Column, directory: str) -> Column:
    """Name of a direct child of ``directory``; null for other paths."""
    rest = F.substr(path, F.lit(len(directory) + 2))
    return F.when(path.startswith(directory + "/") & (rest != "") & ~rest.contains("/"), rest)


def resource_name(path: Column) -> Column:
    """The manifest's name for a member: its file name, with ``extraPages.jsonl`` spelt in lower case."""
    name = file_name(path)
    return F.when(name == "extraPages.jsonl", "extra-pages.jsonl").otherwise(name)


def archive_path(filename: Column) -> Column:
    return F.when(filename.startswith("archive/"), filename).otherwise(F.concat(F.lit("archive/"), filename))


def sibling_path(path: Column, name: Column) -> Column:
    """``name`` in the directory of ``path``."""
    return F.when(path.contains("/"), F.concat(F.regexp_replace(path, r"[^/]*$", ""), name)).otherwise(name)


def line_key(line: Column) -> Column:
    """Text before the first blank; null where there is none."""
    return F.when(F.instr(line, " ") > 0, F.substring_index(line, " ", 1))


def split_prefix(line: Column) -> Column:
    """Struct of key, ts_raw and json of an index line, cut at the first two blanks; null without those."""
    parts = F.split(line, " ", 3)
    return F.when(F.size(parts) == 3, F.struct(parts[0].alias("key"), parts[1].alias("ts_raw"), parts[2].alias("json")))


def content_type_essence(header: Column) -> Column:
    return F.nullif(F.trim(F.substring_index(header, ";", 1)), F.lit(""))
