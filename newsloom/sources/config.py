"""Settings: a JSON file, some of it overridden by environment variables."""

from __future__ import annotations

import json
import os
import re

TRUE = {"1", "true", "yes", "sim", "on"}


def flag(value: str | None, fallback: bool = False) -> bool:
    return fallback if value in (None, "") else str(value).lower() in TRUE


def positive(value, fallback: int) -> int:
    """A positive whole number (leading digits count), else the fallback; so 0 cannot be set."""
    head = re.match(r"\s*\+?(\d+)", str(value or ""))
    return int(head[1]) if head and int(head[1]) > 0 else fallback


def load(path: str, environment: dict | None = None) -> dict:
    env = os.environ if environment is None else environment
    with open(env.get("RADAR_CONFIG_PATH") or path, encoding="utf-8") as f:
        out = json.load(f)
    out["sendEnabled"] = flag(env.get("SEND_ENABLED"))
    for key, name in (("maxPostsPerRun", "MAX_POSTS_PER_RUN"), ("maxPostsPerDay", "MAX_POSTS_PER_DAY"), ("lookbackHours", "LOOKBACK_HOURS")):
        out[key] = positive(env.get(name), out.get(key))
    return out
