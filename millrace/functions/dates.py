"""Date patterns: strftime, MySQL and Oracle styles to Java's, and date unit names."""

from __future__ import annotations

import re

#: What each code of a style means in Java's patterns.
STRFTIME = {
    "Y": "yyyy", "y": "yy", "m": "MM", "-m": "M", "d": "dd", "-d": "d", "H": "HH", "-H": "H", "I": "hh", "M": "mm", "S": "ss", "f": "SSSSSS", "p": "a", "j": "DDD",
    "A": "EEEE", "a": "E", "B": "MMMM", "b": "MMM", "z": "xx", "Z": "z", "F": "yyyy-MM-dd", "T": "HH:mm:ss", "D": "MM/dd/yy", "R": "HH:mm", "g": "SSS", "e": "d", "h": "MMM", "%": "%",
}
MYSQL = STRFTIME | {"i": "mm", "s": "ss", "M": "MMMM", "h": "hh", "W": "EEEE", "c": "M", "e": "d", "k": "H", "l": "h", "D": "d", "r": "hh:mm:ss a", "y": "yy"}
ORACLE = {
    "YYYY": "yyyy", "YY": "yy", "RRRR": "yyyy", "MM": "MM", "MONTH": "MMMM", "MON": "MMM", "DDD": "DDD", "DD": "dd", "DY": "E", "DAY": "EEEE", "HH24": "HH", "HH12": "hh", "HH": "hh",
    "MI": "mm", "SS": "ss", "FF9": "SSSSSSSSS", "FF6": "SSSSSS", "FF3": "SSS", "FF": "SSSSSS", "US": "SSSSSS", "MS": "SSS", "AM": "a", "PM": "a", "TZH:TZM": "xxx", "Q": "Q",
}
_ORACLE = re.compile('|'.join(sorted(ORACLE, key=len, reverse=True)) + '|"[^"]*"', re.I)


def quote_letters(text: str) -> str:
    return re.sub(r"[A-Za-z]+", lambda m: f"'{m[0]}'", text)


def to_java(pattern: str, style: str) -> str:
    """A date pattern in Java's letters."""
    if style in ("strftime", "mysql") and "%" in pattern:
        codes, out = (MYSQL if style == "mysql" else STRFTIME), ""
        for literal, code in re.findall(r"([^%]*)(%-?.|$)", pattern):
            if code and code[1:] not in codes:
                from ..front.dialects import UnsupportedSQL

                raise UnsupportedSQL(f"date code {code}")
            out += quote_letters(literal) + (codes[code[1:]] if code else "")
        return out
    if style == "oracle":
        at, out = 0, ""
        for m in _ORACLE.finditer(pattern):
            out += quote_letters(pattern[at : m.start()]) + (ORACLE.get(m[0].upper()) or "'" + m[0][1:-1] + "'")
            at = m.end()
        return out + quote_letters(pattern[at:])
    return pattern


#: Other names of date units.
UNITS = {
    "YEAR": "YEARS Y YY YYYY YR YRS", "QUARTER": "QUARTERS Q QQ QTR QTRS", "MONTH": "MONTHS MM MON MONS", "WEEK": "WEEKS W WK WW ISOWEEK WEEKISO", "DAY": "DAYS D DD DAYOFMONTH", "HOUR": "HOURS H HH HR HRS",
    "MINUTE": "MINUTES MI N MIN MINS", "SECOND": "SECONDS S SS SEC SECS", "MILLISECOND": "MILLISECONDS MS MSEC", "MICROSECOND": "MICROSECONDS US USEC", "DAYOFWEEK": "DOW DW WEEKDAY",
    "DAYOFWEEK_ISO": "ISODOW DAYOFWEEKISO", "DAYOFYEAR": "DOY DY", "EPOCH": "EPOCH_SECOND", "YEAROFWEEK": "ISOYEAR YEAROFWEEKISO", "DECADE": "DECADES", "CENTURY": "CENTURIES", "MILLENNIUM": "MILLENNIA",
}
_UNIT = {alias: unit for unit, aliases in UNITS.items() for alias in (unit, *aliases.split())}


def unit(text: str) -> str:
    """The normal name of a date unit or part."""
    from ..front.dialects import UnsupportedSQL

    found = _UNIT.get(text.strip("'\"").upper().split("(")[0])
    if not found:
        raise UnsupportedSQL(f"date unit {text}")
    return found
