"""Level spellings, level encoding and severity checks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spellings accepted from log lines.
LINE_LEVELS = {
    "error": ("error", "err", "fatal", "critical", "severe"),
    "warn": ("warn", "warning"),
    "info": ("info", "information", "notice"),
    "debug": ("debug", "trace", "verbose"),
}

# Spellings accepted from queued messages and direct ingestion.
MESSAGE_LEVELS = {
    "debug": ("debug", "dbg"),
    "info": ("info", "information", "log"),
    "warn": ("warn", "warning"),
    "error": ("error", "err", "fatal", "critical", "severe"),
}

# Words that decide the level of a plain-text line, in order of precedence.
PLAIN_TEXT_WORDS = (
    ("error", ("fatal", "critical", "severe", "error")),
    ("warn", ("warn",)),
    ("debug", ("debug", "trace")),
)

# Numeric codes of the four levels.
LEVEL_CODES = {"debug": 0, "info": 1, "warn": 2, "error": 3}


def _lookup(level: Column, spellings: dict[str, tuple[str, ...]]) -> Column:
    lowered = F.lower(level)
    case = None
    for name, accepted in spellings.items():
        hit = lowered.isin(*accepted)
        case = F.when(hit, name) if case is None else case.when(hit, name)
    return case.otherwise("info")


def line_level(level: Column) -> Column:
    """Level of a structured log line; anything unknown is ``info``."""
    return _lookup(level, LINE_LEVELS)


def message_level(level: Column) -> Column:
    """Level of a queued message; anything unknown (or null) is ``info``."""
    return _lookup(level, MESSAGE_LEVELS)


def plain_text_level(line: Column) -> Column:
    """Level guessed from the words inside a plain-text line."""
    lowered = F.lower(line)
    case = None
    for name, words in PLAIN_TEXT_WORDS:
        hit = F.lit(False)
        for word in words:
            hit = hit | lowered.contains(word)
        case = F.when(hit, name) if case is None else case.when(hit, name)
    return case.otherwise("info")


def level_code(level: Column) -> Column:
    """0 to 3 for debug to error, 1 for anything else."""
    lowered = F.lower(level)
    case = None
    for name, code in LEVEL_CODES.items():
        hit = lowered == name
        case = F.when(hit, code) if case is None else case.when(hit, code)
    return case.otherwise(LEVEL_CODES["info"])
