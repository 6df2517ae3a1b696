"""Column functions: distances, angles, names, labels and text parsing. All run inside Spark's generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0
MILES_PER_KM = 0.621371
WALK_MPH = 3.1


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


def half_up(x) -> Column:
    """Rounding of the client: halves go up, also below zero."""
    return F.floor(_c(x) + 0.5)


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle distance on a sphere of 6371 km."""
    lat1, lon1, lat2, lon2 = map(_c, (lat1, lon1, lat2, lon2))
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(
        F.sin(F.radians(lon2 - lon1) / 2), 2
    )
    return 2 * EARTH_KM * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def segment_fraction(px, py, ax, ay, bx, by) -> Column:
    """Place of the projection on a segment, clamped to 0..1; 0 where the segment is a point."""
    px, py, ax, ay, bx, by = map(_c, (px, py, ax, ay, bx, by))
    dx, dy = bx - ax, by - ay
    length2 = dx * dx + dy * dy
    t = ((px - ax) * dx + (py - ay) * dy) / F.when(length2 != 0, length2)
    return F.coalesce(F.least(F.lit(1.0), F.greatest(F.lit(0.0), t)), F.lit(0.0))


def point_segment_distance(px, py, ax, ay, bx, by) -> Column:
    px, py, ax, ay, bx, by = map(_c, (px, py, ax, ay, bx, by))
    t = segment_fraction(px, py, ax, ay, bx, by)
    return F.hypot(px - (ax + t * (bx - ax)), py - (ay + t * (by - ay)))


def angular_distance(a, b) -> Column:
    """Shortest angle between two headings, 0 to 180 degrees."""
    turn = F.pmod(_c(a) - _c(b), F.lit(360.0))
    return F.least(turn, 360.0 - turn)


def circular_blend(previous, heading, alpha) -> Column:
    """Headings blended as vectors, 0 to 360 degrees."""
    p, h, a = _c(previous), _c(heading), _c(alpha)
    s = (1 - a) * F.sin(F.radians(p)) + a * F.sin(F.radians(h))
    c = (1 - a) * F.cos(F.radians(p)) + a * F.cos(F.radians(h))
    return F.pmod(F.degrees(F.atan2(s, c)) + 360.0, F.lit(360.0))


def parse_clock_time(text) -> Column:
    """Minutes after midnight of 'h:mm AM'; 12 AM is 0; malformed text gives null."""
    pattern = r"^\s*(\d{1,2}):(\d{2})\s*([AaPp][Mm])\s*$"
    t = _c(text)
    hour = F.regexp_extract(t, pattern, 1)
    half = F.upper(F.regexp_extract(t, pattern, 3))
    h = F.when(hour != "", hour.cast("int"))
    m = F.when(hour != "", F.regexp_extract(t, pattern, 2).cast("int"))
    return F.when(half == "PM", F.when(h == 12, 12).otherwise(h + 12)).otherwise(F.when(h == 12, 0).otherwise(h)) * 60 + m


#: How texts name a room, and how a room number trails a building.
_DASH = "[-–]"
_KEYWORD = rf"(?i)(?:^|\s|{_DASH})\s*(?:room|rm|ste|suite|#)\s*([\w.\-]+)"
_TRAIL = r"(?i)^(.+?)\s+(\d+(?:\.\d+)?[a-z]?|[a-z]?\d+\.\d+[a-z]?)\s*$"


def strip_room_prefix(text) -> Column:
    return F.trim(F.regexp_replace(_c(text), r"(?i)^(?:room|rm|ste|suite|#)\s*", ""))


def location_building(text) -> Column:
    """Building part of a location text, before it is looked up in the dictionary."""
    t = F.trim(F.coalesce(_c(text), F.lit("")))
    before = F.regexp_extract(t, rf"^([\s\S]*?){_KEYWORD}", 1)
    keyword = F.trim(F.regexp_replace(before, rf"{_DASH}\s*$", ""))
    rest = F.trim(F.regexp_replace(t, _KEYWORD, ""))
    return (
        F.when(t == "", "")
        .when(t.rlike(_KEYWORD), F.when(keyword != "", keyword).otherwise(rest))
        .when(t.rlike(rf"\s{_DASH}\s"), F.trim(F.regexp_extract(t, rf"^([\s\S]*?)\s{_DASH}\s", 1)))
        .when(t.rlike(_TRAIL), F.trim(F.regexp_extract(t, _TRAIL, 1)))
        .otherwise(t)
    )


def location_room(text) -> Column:
    """Room part of a location text; empty when there is none."""
    t = F.trim(F.coalesce(_c(text), F.lit("")))
    return (
        F.when(t == "", "")
        .when(t.rlike(_KEYWORD), F.regexp_extract(t, _KEYWORD, 1))
        .when(t.rlike(rf"\s{_DASH}\s"), strip_room_prefix(F.trim(F.regexp_extract(t, rf"^[\s\S]*?\s{_DASH}\s([\s\S]*)$", 1))))
        .when(t.rlike(_TRAIL), F.regexp_extract(t, _TRAIL, 2))
        .otherwise("")
    )


def normalize_room(text) -> Column:
    """Room query without its prefix and without blanks around dots."""
    return F.regexp_replace(strip_room_prefix(F.trim(_c(text))), r"\s*\.\s*", ".")


def strip_room_part(text) -> Column:
    """Location without room and floor suffixes."""
    words = r"(room|rm|suite|ste|floor|fl|#)\s*[\w.]+"
    t = F.regexp_replace(_c(text), rf"(?i){_DASH}\s*{words}", "")
    return F.trim(F.regexp_replace(t, rf"(?i)\s+{words}", ""))


def clean_display_name(full_name, email) -> Column:
    """Name without control, direction and zero-width characters; else the email's local part; at most 80 characters."""
    t = F.trim(F.regexp_replace(F.coalesce(_c(full_name), F.lit("")), r"[\x00-\x1F\x7F-\x9F]", ""))
    t = F.regexp_replace(t, "[​-‏‪-‮⁠-⁤⁦-⁩﻿]", "")
    return F.substring(F.when(F.length(t) == 0, F.split_part(_c(email), F.lit("@"), F.lit(1))).otherwise(t), 1, 80)


def clean_detected_text(text) -> Column:
    """Detected room text in the form digit, dot, number, optional letter."""
    t = F.translate(F.trim(_c(text)), ",-~; |", "....")
    extra = F.substring(t, 6, 1000)
    letter = F.when(extra == "4", "A").when(extra == "8", "B").when(extra == "0", "D").otherwise("")
    return (
        F.when(t.rlike(r"^\d\.\d{4,}$"), F.concat(F.substring(t, 1, 5), letter))
        .when(t.rlike(r"^\d\d{3,4}[A-Za-z]?$"), F.concat(F.substring(t, 1, 1), F.lit("."), F.substring(t, 2, 1000)))
        .otherwise(t)
    )


def accent_bucket(identifier, buckets: int = 8) -> Column:
    """Bucket of the 32-bit hash 31 * h + code over the characters; the palette itself is presentation."""
    codes = F.transform(F.split(_c(identifier), ""), lambda ch: F.ascii(ch).cast("long"))
    wrap = lambda v: F.pmod(v + F.lit(2**31), F.lit(2**32)) - F.lit(2**31)
    h = F.aggregate(codes, F.lit(0).cast("long"), lambda acc, x: wrap(acc * 31 + x))
    return F.abs(h) % buckets


def initials(name) -> Column:
    """Two capital letters; 'U' for a blank name."""
    parts = F.filter(F.split(F.trim(F.coalesce(_c(name), F.lit(""))), r"\s+"), lambda p: p != "")
    two = F.concat(F.substring(F.get(parts, 0), 1, 1), F.substring(F.get(parts, 1), 1, 1))
    return F.when(F.size(parts) == 0, "U").when(F.size(parts) == 1, F.upper(F.substring(F.get(parts, 0), 1, 2))).otherwise(F.upper(two))


def age_label(ts, now) -> Column:
    mins = F.floor((F.unix_timestamp(_c(now)) - F.unix_timestamp(_c(ts))) / 60)
    say = lambda n, unit: F.concat(F.lit("Reported "), n.cast("string"), F.lit(f" {unit}"), F.when(n == 1, "").otherwise("s"), F.lit(" ago"))
    hours = F.floor(mins / 60)
    return (
        F.when(mins < 1, "Reported just now")
        .when(mins < 60, say(mins, "minute"))
        .when(hours < 24, say(hours, "hour"))
        .otherwise(say(F.floor(hours / 24), "day"))
    )


def walk_minutes(miles) -> Column:
    return F.greatest(F.lit(1), half_up(_c(miles) / WALK_MPH * 60)).cast("int")


def arrival(now, miles) -> Column:
    return _c(now) + F.make_dt_interval(mins=walk_minutes(miles))


#: The part of a full page that the shown image keeps.
CROP_LEFT, CROP_TOP, CROP_RIGHT, CROP_BOTTOM = 0.03, 0.06, 0.97, 0.84


def to_image(x, y, width, height) -> tuple[Column, Column]:
    return (
        (_c(x) - CROP_LEFT) / (CROP_RIGHT - CROP_LEFT) * _c(width),
        (_c(y) - CROP_TOP) / (CROP_BOTTOM - CROP_TOP) * _c(height),
    )


def from_image(px, py, width, height) -> tuple[Column, Column]:
    return (
        _c(px) / _c(width) * (CROP_RIGHT - CROP_LEFT) + CROP_LEFT,
        _c(py) / _c(height) * (CROP_BOTTOM - CROP_TOP) + CROP_TOP,
    )


def recurrence_label(kind, interval) -> Column:
    unit = F.when(_c(kind) == "daily", "day").when(_c(kind) == "weekly", "week").otherwise("month")
    many = F.concat(F.lit("Every "), _c(interval).cast("string"), F.lit(" "), unit, F.lit("s"))
    return F.when(_c(kind).isNull(), "Does not repeat").when(_c(interval) == 1, F.concat(F.lit("Every "), unit)).otherwise(many)


def date_label(day, today) -> Column:
    d, t = _c(day), _c(today)
    return F.when(d == t, "Today").when(d == F.date_add(t, 1), "Tomorrow").otherwise(F.date_format(d, "EEE, MMM d"))


def quarter_arc(p0, p1, p2, p3, tolerance: float = 0.25) -> Column:
    """Struct (cx, cy, r) when a cubic curve of points (x, y) is a quarter circle, else null."""
    p0, p1, p2, p3 = map(_c, (p0, p1, p2, p3))
    named = lambda **c: F.struct(*[v.alias(k) for k, v in c.items()])
    then = lambda value, f: F.get(F.transform(F.array(value), f), 0)  # names a value once, for small plans
    ends = named(
        x0=p0.x, y0=p0.y, x3=p3.x, y3=p3.y, t0x=p1.x - p0.x, t0y=p1.y - p0.y, t3x=p3.x - p2.x, t3y=p3.y - p2.y
    )

    def centre(e):
        det = e.t0y * -e.t3x + e.t0x * e.t3y
        t = ((e.x3 - e.x0) * -e.t3x + (e.y3 - e.y0) * -e.t3y) / F.when(F.abs(det) >= 1e-9, -det)
        return named(e=e, t=t)

    def radii(c):
        cx, cy = c.e.x0 - c.t * c.e.t0y, c.e.y0 + c.t * c.e.t0x
        return named(e=c.e, cx=cx, cy=cy)

    def sizes(c):
        return named(e=c.e, cx=c.cx, cy=c.cy, r0=F.hypot(c.e.x0 - c.cx, c.e.y0 - c.cy), r3=F.hypot(c.e.x3 - c.cx, c.e.y3 - c.cy))

    def verdict(c):
        r = (c.r0 + c.r3) / 2
        cosine = ((c.e.x0 - c.cx) * (c.e.x3 - c.cx) + (c.e.y0 - c.cy) * (c.e.y3 - c.cy)) / F.when(r != 0, r * r)
        angle = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine)))
        handle = lambda x, y: F.abs(F.hypot(x, y) / F.when(r != 0, r) - 0.5523)
        good = (
            (c.r0 >= 4)
            & (c.r3 >= 4)
            & (F.abs(c.r0 - c.r3) / F.when(c.r0 != 0, c.r0) <= tolerance)
            & (F.abs(angle - F.pi() / 2) <= tolerance * F.pi() / 2)
            & (handle(c.e.t0x, c.e.t0y) <= tolerance)
            & (handle(c.e.t3x, c.e.t3y) <= tolerance)
        )
        return F.when(good, named(cx=c.cx, cy=c.cy, r=r))

    return then(then(then(then(ends, centre), radii), sizes), verdict)


def zoom_from_span(span, width) -> Column:
    z = half_up(F.log2(360.0 * (_c(width) / 256.0) / _c(span)))
    return F.least(F.lit(20), F.greatest(F.lit(10), z)).cast("int")


def safe_url(url) -> Column:
    t = F.trim(_c(url))
    return F.when(t.rlike(r"(?i)^https?://[^\s/?#]+"), t)


#: Minutes that an alert of each type lasts.
ALERT_MINUTES = {"crowd": 30, "construction": 72 * 60, "elevator_down": 24 * 60, "building_closure": 8 * 60, "hazard": 30}


def alert_minutes(kind) -> Column:
    out = F.lit(60)
    for name, minutes in ALERT_MINUTES.items():
        out = F.when(_c(kind) == name, minutes).otherwise(out)
    return out


def alert_expiry(kind, ts) -> Column:
    return _c(ts) + F.make_dt_interval(mins=alert_minutes(kind))


def profile_display_name(*names, email, fallback: str = "User") -> Column:
    """First non-blank of the names, the email's local part, else the fallback."""
    filled = [F.nullif(F.trim(_c(n)), F.lit("")) for n in (*names, F.split_part(_c(email), F.lit("@"), F.lit(1)))]
    return F.coalesce(*filled, F.lit(fallback))
