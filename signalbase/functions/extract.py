"""Numbers with units out of running text."""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from signalbase import config
from signalbase.functions.text import WHITE

_DIGITS = [c for c in map(chr, range(0x660, sys.maxunicode + 1)) if unicodedata.category(c) == "Nd"]
_ASCII = "".join(str(unicodedata.digit(c)) for c in _DIGITS)


def split_sentences(text: Column) -> Column:
    """Parts of a text between sentence marks and the white space after them, trimmed."""
    parts = F.split(text, f"(?<=[。！？.!?]){WHITE}+", -1)
    return F.transform(parts, lambda s: F.regexp_replace(s, f"^{WHITE}+|{WHITE}+$", ""))


def to_number(digits: Column) -> Column:
    """A double; decimal digits of any script count."""
    return F.translate(digits, "".join(_DIGITS), _ASCII).try_cast("double")


def param_pattern(units: Sequence[str] = config.UNITS) -> str:
    """A number and the first unit, in the order given, that follows it; no word boundary is asked for."""
    return rf"(?iu)(\p{{Nd}}+(?:\.\p{{Nd}}+)?){WHITE}*({'|'.join(map(re.escape, units))})"


def extract_params(text: Column, units: Sequence[str] = config.UNITS, most: int = config.PARAMS_PER_RECORD) -> Column:
    """The first ``most`` numbers with units, in order, as an array of structs."""
    pattern = F.lit(param_pattern(units))

    def of(sentence: Column) -> Column:
        raw, number, unit = (F.regexp_extract_all(sentence, pattern, F.lit(g)) for g in range(3))
        return F.transform(
            F.arrays_zip(raw.alias("raw"), number.alias("number"), unit.alias("unit")),
            lambda m: F.struct(
                m["raw"].alias("value_raw"),
                to_number(m["number"]).alias("value_numeric"),
                m["unit"].alias("unit"),
                F.substring(sentence, 1, config.EVIDENCE_CHARS).alias("evidence_text"),
                F.lit(config.PARAM_REASON).alias("extraction_reason"),
                F.lit(0.85).alias("confidence"),
            ),
        )

    return F.slice(F.flatten(F.transform(split_sentences(F.coalesce(text, F.lit(""))), of)), 1, most)
