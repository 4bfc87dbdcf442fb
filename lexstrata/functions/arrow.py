"""Functions that built-ins can't express, over Arrow batches: Unicode forms, JSON repair, fuzzy sentences, quantities."""

from __future__ import annotations

import json
import re
import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Customary units as (pattern, metric unit, factor, offset).
CUSTOMARY = (
    ("miles per hour|mph", "km/h", 1.609344, 0.0),
    ("miles?", "km", 1.609344, 0.0),
    ("feet|foot|ft", "m", 0.3048, 0.0),
    ("inch(?:es)?", "cm", 2.54, 0.0),
    ("pounds?|lbs?", "kg", 0.45359237, 0.0),
    ("degrees fahrenheit|°\\s*f", "celsius", 5 / 9, -32.0),
)
#: Metric units as (pattern, unit).
METRIC = (("킬로미터|kilomet(?:er|re)s?|km/h|km", "km"), ("센티미터|centimet(?:er|re)s?|cm", "cm"), ("미터|met(?:er|re)s?|m", "m"), ("킬로그램|kilograms?|kg", "kg"), ("섭씨|degrees? celsius|°\\s*c|celsius", "celsius"))
_NUMBER = r"(\d+(?:,\d{3})*(?:\.\d+)?)"


@F.pandas_udf(T.StringType())
def nfkc(column: pd.Series) -> pd.Series:
    """Compatibility form (STR-25)."""
    return column.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


@F.pandas_udf(T.StringType())
def casefold(column: pd.Series) -> pd.Series:
    """Full case folding (STR-3)."""
    return column.map(lambda x: None if x is None else x.casefold())


def json_part(text: str | None) -> str | None:
    """The first balanced JSON object or array in a text, fences and trailing commas taken away; null if none parses."""
    t = re.sub(r"```(?:json)?", "", text or "")
    for start in (m.start() for m in re.finditer(r"[\[{]", t)):
        depth, quoted, escaped = 0, False, False
        for i in range(start, len(t)):
            c = t[i]
            if quoted:
                quoted, escaped = (escaped or c != '"'), (c == "\\" and not escaped)
            elif c == '"':
                quoted = True
            elif c in "[{":
                depth += 1
            elif c in "]}":
                depth -= 1
                if not depth:
                    found = re.sub(r",\s*([\]}])", r"\1", t[start : i + 1])
                    try:
                        json.loads(found)
                        return found
                    except ValueError:
                        break
    return None


@F.pandas_udf(T.StringType())
def balanced_json(column: pd.Series) -> pd.Series:
    """json_part of each text (STR-23)."""
    return column.map(json_part)


@F.pandas_udf(T.StructType([T.StructField("sentence", T.StringType()), T.StructField("ratio", T.DoubleType())]))
def best_sentence(sentences: pd.Series, wanted: pd.Series) -> pd.DataFrame:
    """The sentence most like a text by difflib, null below 0.28 (STR-18)."""
    from difflib import SequenceMatcher

    out = []
    for s, w in zip(sentences, wanted, strict=True):
        scored = [(SequenceMatcher(None, x.lower(), (w or "").lower(), autojunk=False).ratio(), -i, x) for i, x in enumerate(s if s is not None else [])]
        best = max(scored, default=(0.0, 0, None))
        out.append((best[2], round(best[0], 6)) if best[0] >= 0.28 else (None, None))
    return pd.DataFrame(out, columns=["sentence", "ratio"])


def metric(text: str | None) -> str | None:
    """Customary quantities as metric ones, one decimal place (MTH-3)."""
    if text is None:
        return None
    for pattern, unit, factor, offset in CUSTOMARY:

        def by(m: re.Match, unit=unit, factor=factor, offset=offset) -> str:
            return f"{(float(m.group(1).replace(',', '')) + offset) * factor:.1f} {unit}"

        text = re.sub(rf"{_NUMBER}[\s-]*(?:{pattern})\b", by, text, flags=re.I)
    return text


@F.pandas_udf(T.StringType())
def to_metric(column: pd.Series) -> pd.Series:
    return column.map(metric)


def quantities(text: str | None) -> list[str]:
    """Sorted tokens `number unit` of all measurements, metric (NUM-2, NUM-3); what one pattern takes no other sees."""
    t, out = metric(unicodedata.normalize("NFKC", text or "")), []
    for pattern, unit in METRIC:

        def take(m: re.Match, unit=unit) -> str:
            out.append(f"{float(m.group(1).replace(',', '')):g} {unit}")
            return " "

        t = re.sub(rf"{_NUMBER}\s*(?:{pattern})(?![A-Za-z])", take, t, flags=re.I)
    return sorted(out)


@F.pandas_udf(T.ArrayType(T.StringType()))
def canonical_quantities(column: pd.Series) -> pd.Series:
    return column.map(quantities)
