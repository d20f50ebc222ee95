"""Instants from text in many spellings (problem 3): one regular expression, integer day arithmetic."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache
from zoneinfo import ZoneInfo

# English month and day names, and the usual offsets of zone abbreviations in minutes.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
DAYS = ("mon", "tue", "wed", "thu", "fri", "sat", "sun")
ABBREVIATIONS = {
    "z": 0, "ut": 0, "utc": 0, "gmt": 0, "wet": 0, "west": 60, "bst": 60, "cet": 60, "cest": 120, "met": 60, "mest": 120,
    "eet": 120, "eest": 180, "msk": 180, "sast": 120, "ist": 330, "npt": 345, "sgt": 480, "hkt": 480, "awst": 480, "kst": 540, "jst": 540,
    "acst": 570, "acdt": 630, "aest": 600, "aedt": 660, "nzst": 720, "nzdt": 780, "brt": -180, "brst": -120, "art": -180,
    "nst": -210, "ndt": -150, "ast": -240, "adt": -180, "est": -300, "edt": -240, "cst": -360, "cdt": -300,
    "mst": -420, "mdt": -360, "pst": -480, "pdt": -420, "akst": -540, "akdt": -480, "hst": -600,
}

_MONTH = "|".join(MONTHS)
_DAY = "|".join(DAYS)
_ZONE = r"(?:\s*(?P<off{0}>[+\-−]\d\d(?::?\d\d)?))?(?:\s*\[(?P<ann{0}>[A-Za-z_/+\-0-9]+)\])?(?:\s*(?P<abb{0}>[A-Za-z]{{1,5}})|\s+(?P<reg{0}>[A-Za-z]+(?:/[A-Za-z_+\-0-9]+)+))?"
_CLOCK = r"(?P<h{0}>\d{{1,2}}):(?P<mi{0}>\d\d)(?::(?P<s{0}>\d\d)(?:[.,](?P<f{0}>\d+))?)?(?:\s*(?P<ap{0}>[AaPp])\.?[Mm]\.?)?"
_TAIL = _CLOCK + _ZONE

#: Every spelling, as (name, body). A name is also the suffix of its groups.
FORMATS = (
    ("iso", r"(?P<y{0}>\d{{4}})-(?P<mo{0}>\d\d)-(?P<d{0}>\d\d)(?:(?:[Tt]|\s+)" + _TAIL + ")?"),
    ("slash", r"(?P<y{0}>\d{{4}})/(?P<mo{0}>\d{{1,2}})/(?P<d{0}>\d{{1,2}})(?:[T\s]\s*" + _TAIL + ")?"),
    ("ordinal", r"(?P<y{0}>\d{{4}})-(?P<yd{0}>\d{{3}})(?:[Tt\s]\s*" + _TAIL + ")?"),
    ("week", r"(?P<y{0}>\d{{4}})-?[Ww](?P<w{0}>\d\d)-?(?P<wd{0}>\d)(?:[Tt\s]\s*" + _TAIL + ")?"),
    ("basic", r"(?P<y{0}>\d{{4}})(?P<mo{0}>\d\d)(?P<d{0}>\d\d)[Tt](?P<h{0}>\d\d)(?P<mi{0}>\d\d)(?:(?P<s{0}>\d\d)(?:[.,](?P<f{0}>\d+))?)?" + _ZONE),
    ("digits", r"(?P<n{0}>-?\d+)(?:\.(?P<f{0}>\d+))?"),
    ("mail", r"(?:(?P<dow{0}>" + _DAY + r")[a-z]*,?\s+)?(?P<d{0}>\d{{1,2}})[\s\-](?P<mon{0}>" + _MONTH + r")[a-z]*\.?,?[\s\-](?P<y{0}>\d{{4}})(?:,?\s+" + _TAIL + ")?"),
    ("ctime", r"(?P<dow{0}>" + _DAY + r")[a-z]*\s+(?P<mon{0}>" + _MONTH + r")[a-z]*\s+(?P<d{0}>\d{{1,2}})\s+(?P<h{0}>\d\d):(?P<mi{0}>\d\d):(?P<s{0}>\d\d)(?:\.(?P<f{0}>\d+))?(?:\s+(?P<abb{0}>[A-Za-z]{{1,5}}))?\s+(?P<y{0}>\d{{4}})"),
    ("named", r"(?:(?P<dow{0}>" + _DAY + r")[a-z]*,?\s+)?(?P<mon{0}>" + _MONTH + r")[a-z]*\.?\s+(?P<d{0}>\d{{1,2}})(?:st|nd|rd|th)?,?\s+(?P<y{0}>\d{{4}})(?:,?\s+(?:at\s+)?" + _TAIL + ")?"),
    ("either", r"(?P<a{0}>\d{{1,2}})(?P<sep{0}>[/.\-])(?P<b{0}>\d{{1,2}})(?P=sep{0})(?P<y{0}>\d{{4}})(?:,?\s+" + _TAIL + ")?"),
)
ANY = re.compile("|".join(f"(?P<{n}>{body.format('_' + n)})" for n, body in FORMATS), re.IGNORECASE)
EXACT = re.compile(r"[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}Z")

DAY_US = 86_400_000_000


def days_from_civil(y: int, m: int, d: int) -> int:
    """Days since 1970-01-01 in the proleptic Gregorian calendar."""
    y -= m <= 2
    era = y // 400
    yoe = y - era * 400
    doy = (153 * (m + (-3 if m > 2 else 9)) + 2) // 5 + d - 1
    return era * 146097 + yoe * 365 + yoe // 4 - yoe // 100 + doy - 719468


def leap(y: int) -> bool:
    return y % 4 == 0 and (y % 100 != 0 or y % 400 == 0)


def day_number(y: int, m: int, d: int) -> int | None:
    """As days_from_civil; None where there is no such date."""
    if not (1 <= y <= 9999 and 1 <= m <= 12) or not 1 <= d <= (29 if m == 2 and leap(y) else (31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31)[m - 1]):
        return None
    return days_from_civil(y, m, d)


@lru_cache(maxsize=1024)
def _zone(name: str) -> ZoneInfo | None:
    try:
        return ZoneInfo(name)
    except Exception:  # noqa: BLE001 - unknown or malformed names alike
        return None


@lru_cache(maxsize=1 << 16)
def zone_offset_s(name: str, day: int, minute: int) -> int | None:
    """Offset of a local time in seconds: the first pass of a repeated hour, the offset before a skipped one."""
    from datetime import datetime, timedelta

    zone = _zone(name)
    if zone is None:
        return None
    local = datetime(1970, 1, 1) + timedelta(days=day, minutes=minute)
    return int(local.replace(tzinfo=zone, fold=0).utcoffset().total_seconds())


def _bare_digits(n: str, frac: str | None) -> int | None:
    if n.startswith("-"):
        return -_epoch(n[1:], frac) if len(n) <= 11 else None
    if frac is None and len(n) in (8, 12, 14, 17):
        day = day_number(int(n[:4]), int(n[4:6]), int(n[6:8]))
        h, mi, s = (int(n[i : i + 2] or 0) for i in (8, 10, 12))
        if day is None or h > 23 or mi > 59 or s > 59:
            return None
        return day * DAY_US + (h * 3600 + mi * 60 + s) * 1_000_000 + int(n[14:] or 0) * 1000
    return _epoch(n, frac)


def _epoch(n: str, frac: str | None) -> int | None:
    micros = int((frac or "").ljust(6, "0")[:6])
    if frac is not None and len(n) > 11:
        return None
    if 9 <= len(n) <= 11:
        return int(n) * 1_000_000 + micros
    if frac is None and len(n) in (13, 16, 19):
        return int(n) * 1000 if len(n) == 13 else int(n) if len(n) == 16 else int(n) // 1000
    return None


def parse_instant(text: str | None, zone: str | None = None, lo: int | None = None, hi: int | None = None) -> int | None:
    """Microseconds since 1970 UTC that ``text`` names, or None.

    ``zone`` is the IANA zone of text without any; null or unknown names mean UTC. ``lo`` and
    ``hi`` are the first and last day of the crawl, since 1970: where day and month could be
    swapped, the reading inside them holds, else the nearer one, else day before month.
    Impossible dates, hour 24, leap seconds, and a day name that contradicts its date are no instants.
    """
    if text is None:
        return None
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    m = ANY.fullmatch(text.strip())
    if m is None:
        return None
    kind = m.lastgroup
    g = {k[: -len(kind) - 1]: v for k, v in m.groupdict().items() if v is not None and k.endswith("_" + kind)}
    if kind == "digits":
        return _bare_digits(g["n"], g.get("f"))
    y = int(g["y"])
    if kind == "ordinal":
        yd = int(g["yd"])
        day = days_from_civil(y, 1, 1) + yd - 1 if y and 1 <= yd <= 365 + leap(y) else None
    elif kind == "week":
        w, wd = int(g["w"]), int(g["wd"])
        first = days_from_civil(y, 1, 4)
        monday = first - (first + 3) % 7
        following = days_from_civil(y + 1, 1, 4)
        weeks = (following - (following + 3) % 7 - monday) // 7
        day = monday + (w - 1) * 7 + wd - 1 if 1 <= w <= weeks and 1 <= wd <= 7 else None
    elif kind == "either":
        a, b = int(g["a"]), int(g["b"])
        readings = [x for x in dict.fromkeys((day_number(y, b, a), day_number(y, a, b))) if x is not None]
        if len(readings) > 1 and lo is not None and hi is not None:
            readings.sort(key=lambda x: max(lo - x, x - hi, 0))
        day = readings[0] if readings else None
    else:
        month = MONTHS.index(g["mon"].lower()) + 1 if "mon" in g else int(g["mo"])
        day = day_number(y, month, int(g["d"]))
        if day is not None and "dow" in g and (day + 3) % 7 != DAYS.index(g["dow"].lower()):
            return None
    if day is None:
        return None
    h, mi, s = int(g.get("h", 0)), int(g.get("mi", 0)), int(g.get("s", 0))
    if "ap" in g:
        if not 1 <= h <= 12:
            return None
        h = h % 12 + 12 * (g["ap"].lower() == "p")
    if h > 23 or mi > 59 or s > 59:
        return None
    if "off" in g:
        digits = g["off"][1:].replace(":", "")
        oh, om = int(digits[:2]), int(digits[2:] or 0)
        if oh > 18 or om > 59:
            return None
        offset = (oh * 60 + om) * (60 if g["off"][0] == "+" else -60)
    elif "abb" in g:
        if (minutes := ABBREVIATIONS.get(g["abb"].lower())) is None:
            return None
        offset = minutes * 60
    elif "reg" in g or "ann" in g:
        if (offset := zone_offset_s(g.get("reg") or g["ann"], day, h * 60 + mi)) is None:
            return None
    else:
        offset = zone_offset_s(zone, day, h * 60 + mi) if zone else 0
        offset = 0 if offset is None else offset
    return day * DAY_US + (h * 3600 + mi * 60 + s - offset) * 1_000_000 + int(g.get("f", "").ljust(6, "0")[:6])


def is_exact(text: str | None) -> bool:
    """Already exactly ``YYYY-MM-DDTHH:MM:SSZ``."""
    return text is not None and EXACT.fullmatch(text) is not None
