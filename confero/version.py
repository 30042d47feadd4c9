"""The version that a deployment states: in the environment, else in a file of settings, else the built-in one."""

from __future__ import annotations

import datetime
import os
from collections.abc import Iterable, Mapping

VERSION, DATE = "0.2.0", "2026-11-26"


def settings(path: str) -> dict[str, str]:
    """KEY=value lines of a file; blank lines, comments and a missing file say nothing."""
    if not os.path.exists(path):
        return {}
    with open(path, encoding="utf-8") as f:
        lines = [x.strip() for x in f]
    return {k.strip(): v.strip() for k, _, v in (x.partition("=") for x in lines if "=" in x and not x.startswith("#"))}


def version_info(env: Mapping[str, str] = os.environ, paths: Iterable[str] = ("version.env",)) -> tuple[str, str]:
    """Version and date; each from the first place that states it."""
    file = next((settings(p) for p in paths if os.path.exists(p)), {})
    return tuple(env.get(key) or file.get(key) or own for key, own in (("APP_VERSION", VERSION), ("APP_VERSION_DATE", DATE)))


def shown_date(date: str) -> str:
    """Day, month, year; what is no ISO date stays as it is."""
    try:
        return datetime.date.fromisoformat(date).strftime("%d/%m/%Y")
    except ValueError:
        return date
