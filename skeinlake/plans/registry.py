"""All core queries by name."""

from __future__ import annotations

from skeinlake.plans import archive, physical, pipeline


def queries() -> dict:
    return {**archive.QUERIES, **physical.QUERIES, **pipeline.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {**archive.SQL, **physical.SQL, **pipeline.SQL}
