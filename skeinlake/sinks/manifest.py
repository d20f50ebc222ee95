"""Checked builders of a package's metadata. Properties beside the modelled ones go into ``extra``; a clash of names is an error."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import UTC, datetime

from skeinlake.sinks.package import MODELLED, NAME, ROLES, PackageError


def _merge(own: dict, extra: dict, modelled: tuple[str, ...]) -> dict:
    for k in extra:
        if k in modelled:
            raise PackageError("EXTRA_COLLISION", k)
    return {k: v for k, v in own.items() if v not in (None, [], ())} | extra


def stamp(at: datetime | str | None) -> str | None:
    """RFC 3339 in UTC without trailing zeros; aware datetimes or finished text."""
    if at is None or isinstance(at, str):
        return at
    if at.tzinfo is None:
        raise PackageError("DATE_WITHOUT_ZONE")
    u = at.astimezone(UTC)
    fraction = f".{u.microsecond:06d}".rstrip("0").rstrip(".")
    return u.strftime("%Y-%m-%dT%H:%M:%S") + fraction + "Z"


@dataclass
class Source:
    title: str
    path: str | None = None
    email: str | None = None
    extra: dict = field(default_factory=dict)

    def row(self) -> dict:
        if not self.title:
            raise PackageError("MANIFEST_SOURCE")
        return _merge({"title": self.title, "path": self.path, "email": self.email}, self.extra, ("title", "path", "email"))


@dataclass
class License:
    name: str | None = None
    path: str | None = None
    title: str | None = None
    extra: dict = field(default_factory=dict)

    def row(self) -> dict:
        if not (self.name or self.path):
            raise PackageError("MANIFEST_LICENSE")
        return _merge({"name": self.name, "path": self.path, "title": self.title}, self.extra, ("name", "path", "title"))


@dataclass
class Contributor:
    title: str
    role: str | None = None
    path: str | None = None
    email: str | None = None
    organization: str | None = None
    extra: dict = field(default_factory=dict)

    def row(self) -> dict:
        if not self.title:
            raise PackageError("MANIFEST_CONTRIBUTOR")
        if self.role is not None and self.role not in ROLES:
            raise PackageError("MANIFEST_ROLE", self.role)
        own = {"title": self.title, "role": self.role, "path": self.path, "email": self.email, "organization": self.organization}
        return _merge(own, self.extra, tuple(own))


@dataclass
class Metadata:
    """``row()`` is what ``PackageWriter.finish`` takes."""

    name: str | None = None
    id: str | None = None
    title: str | None = None
    description: str | None = None
    keywords: list[str] = field(default_factory=list)
    homepage: str | None = None
    image: str | None = None
    version: str | None = None
    sources: list[Source] = field(default_factory=list)
    licenses: list[License] = field(default_factory=list)
    contributors: list[Contributor] = field(default_factory=list)
    created: datetime | str | None = None
    modified: datetime | str | None = None
    software: str | None = None
    main_page_url: str | None = None
    main_page_date: datetime | str | None = None
    extra: dict = field(default_factory=dict)

    def row(self) -> dict:
        if self.name is not None and not NAME.fullmatch(self.name):
            raise PackageError("MANIFEST_NAME", self.name)
        own = {k: getattr(self, k) for k in ("name", "id", "title", "description", "keywords", "homepage", "image", "version", "software")}
        own |= {k: [x.row() for x in getattr(self, k)] for k in ("sources", "licenses", "contributors")}
        own |= {"created": stamp(self.created), "modified": stamp(self.modified), "mainPageUrl": self.main_page_url, "mainPageDate": stamp(self.main_page_date)}
        return _merge(own, self.extra, MODELLED)
