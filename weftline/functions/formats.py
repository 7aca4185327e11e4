"""Date and time pictures of the schema and expression languages as Spark patterns."""

from __future__ import annotations

import re

_PART = re.compile(r"YYYY|yyyy|YY|yy|MMM|MON|Mon|HH24|HH12|HH|hh|MI|SSS|mmm|MM|mm|SS|ss|DDD|DD|dd|FF\d?|AM|PM|[A-Za-z]+|.", re.S)
#: What each part of a picture is in a Spark pattern. MM and mm depend on what precedes.
_AS = {"YYYY": "yyyy", "yyyy": "yyyy", "YY": "yy", "yy": "yy", "MMM": "MMM", "MON": "MMM", "Mon": "MMM", "HH24": "HH", "HH12": "hh", "HH": "HH", "hh": "hh", "MI": "mm", "SSS": "SSS", "mmm": "SSS", "SS": "ss", "ss": "ss", "DDD": "D", "DD": "dd", "dd": "dd", "AM": "a", "PM": "a"}


def spark_format(picture: str) -> str:
    """MM after the hours, whatever stands between, is minutes; elsewhere the month. With AM or PM hours are of twelve."""
    out, hours, minutes = [], False, False
    parts = _PART.findall(picture)
    twelve = any(x in ("AM", "PM") for x in parts)
    for part in parts:
        if part in ("MM", "mm"):
            if hours and not minutes or part == "mm":
                out.append("mm")
                minutes = True
            else:
                out.append("MM")
        elif part == "HH" and twelve:
            out.append("hh")
            hours = True
        elif part.startswith("FF"):
            out.append("S" * int(part[2:] or 3))
        else:
            out.append(_AS.get(part, f"'{part}'" if part.isalpha() else part))
            hours = hours or part in ("HH24", "HH12", "HH", "hh")
            minutes = minutes or part == "MI"
    return "".join(out)
