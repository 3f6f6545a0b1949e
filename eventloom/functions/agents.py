"""Browser, operating system and device type from a user agent text.

The rules cover the widespread browsers and systems. They are plain text tests
on the column itself: no shuffle, no Python, no per-row library.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column
from pyspark.sql import functions as F

# Texts that must all occur, and the name they stand for. The first
# match wins.
BROWSERS = (
    (("Edg/",), "Edge"),
    (("EdgA/",), "Edge"),
    (("EdgiOS/",), "Edge"),
    (("Edge/",), "Edge"),
    (("OPR/",), "Opera"),
    (("Opera",), "Opera"),
    (("SamsungBrowser/",), "Samsung Internet"),
    (("YaBrowser/",), "Yandex"),
    (("Vivaldi/",), "Vivaldi"),
    (("UCBrowser/",), "UCBrowser"),
    (("HeadlessChrome",), "Chrome Headless"),
    (("; wv)", "Chrome/"), "Chrome WebView"),
    (("CriOS/",), "Mobile Chrome"),
    (("FxiOS/",), "Mobile Firefox"),
    (("Firefox/", "Mobile"), "Mobile Firefox"),
    (("Chrome/", "Mobile"), "Mobile Chrome"),
    (("Chromium/",), "Chromium"),
    (("Chrome/",), "Chrome"),
    (("Firefox/",), "Firefox"),
    (("Version/", "Mobile", "Safari/"), "Mobile Safari"),
    (("Version/", "Safari/"), "Safari"),
    (("MSIE ",), "IE"),
    (("Trident/",), "IE"),
)

# Fixed values, as above.
SYSTEMS = (
    (("Windows Phone",), "Windows Phone"),
    (("Windows",), "Windows"),
    (("iPhone",), "iOS"),
    (("iPad",), "iOS"),
    (("iPod",), "iOS"),
    (("Android",), "Android"),
    (("CrOS",), "Chrome OS"),
    (("Macintosh",), "macOS"),
    (("Mac OS X",), "macOS"),
    (("Ubuntu",), "Ubuntu"),
    (("Fedora",), "Fedora"),
    (("Debian",), "Debian"),
    (("Linux",), "Linux"),
)

# Fixed values, as above.
DEVICES = (
    (("SmartTV",), "smarttv"),
    (("SMART-TV",), "smarttv"),
    (("AppleTV",), "smarttv"),
    (("GoogleTV",), "smarttv"),
    (("BRAVIA",), "smarttv"),
    (("Web0S",), "smarttv"),
    (("PlayStation",), "console"),
    (("Xbox",), "console"),
    (("Nintendo",), "console"),
    (("iPad",), "tablet"),
    (("Tablet",), "tablet"),
    (("Mobile",), "mobile"),
    (("iPhone",), "mobile"),
    (("iPod",), "mobile"),
    (("Android",), "tablet"),
)

UNKNOWN = "unknown"
DEFAULT_DEVICE = "desktop"


def _first_match(
    agent: Column, rules: tuple[tuple[tuple[str, ...], str], ...], default: str
) -> Column:
    result = F.when(F.coalesce(agent, F.lit("")) == "", F.lit(UNKNOWN))
    for texts, name in rules:
        found = reduce(and_, [agent.contains(text) for text in texts])
        result = result.when(found, F.lit(name))
    return result.otherwise(F.lit(default))


def browser(agent: Column) -> Column:
    return _first_match(agent, BROWSERS, UNKNOWN)


def system(agent: Column) -> Column:
    return _first_match(agent, SYSTEMS, UNKNOWN)


def device_type(agent: Column) -> Column:
    """An agent that names no device is a desktop; no agent is unknown."""
    return _first_match(agent, DEVICES, DEFAULT_DEVICE)
