"""Reading the JSON text that a model returned."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, functions as F

from colloquy.functions.text import NOT_BLANK, strip

# The fence lines a model may put around its JSON, and the warning.
LEADING_FENCE = r"(?md)^```(?:json)?\s*\n?"
TRAILING_FENCE = r"(?md)\n?```\s*$"
CLEANUP_WARNING = "Model output required cleanup (code fences removed)"


def strip_fences(raw: Column) -> Column:
    return strip(F.regexp_replace(F.regexp_replace(raw, LEADING_FENCE, ""), TRAILING_FENCE, ""))


def parse_strict(raw: Column) -> Column:
    """VARIANT of a JSON text, null when it is none."""
    return F.try_parse_json(F.when(raw.rlike(NOT_BLANK), raw))


def loads(raw: str) -> dict:
    """The object of a model's answer inside a task: strictly, then without its fences."""
    try:
        return json.loads(raw)
    except ValueError:
        bare = re.sub(r"\A\s*```(?:json)?\s*\n?|\n?```\s*\Z", "", raw)
        return json.loads(bare.strip())
