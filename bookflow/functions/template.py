"""Prompt templates: parsed once into literal and column parts, rendered as one concat."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from bookflow.constants import DEFAULT_PROMPT

_SLOT = re.compile(r"\{\{[\s﻿]*([A-Za-z0-9_]+)[\s﻿]*\}\}")


def render_template(template: str, values: dict[str, Column]) -> Column:
    """Fill ``{{ name }}`` slots; unknown names give '' and values are never expanded again."""
    parts: list[Column] = []
    pos = 0
    source = template or DEFAULT_PROMPT
    for slot in _SLOT.finditer(source):
        parts.append(F.lit(source[pos : slot.start()]))
        value = values.get(slot.group(1))
        if value is not None:
            parts.append(F.coalesce(value.cast("string"), F.lit("")))
        pos = slot.end()
    parts.append(F.lit(source[pos:]))
    return F.concat(*parts)
