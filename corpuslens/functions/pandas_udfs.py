"""The two functions that have no native form: YAML front matter and unified diffs, as Pandas UDFs."""

from __future__ import annotations

import difflib
import json
import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_END = re.compile(r"\n---\s*\n")


def front_matter_of(text: str | None) -> dict:
    """The mapping at a text's head; empty if there is none, it doesn't end, it can't be read or is no mapping."""
    import yaml

    if not text or not text.startswith("---"):
        return {}
    end = _END.search(text, 3)
    if not end:
        return {}
    try:
        found = yaml.safe_load(text[3 : end.start()])
    except yaml.YAMLError:
        return {}
    return found if isinstance(found, dict) else {}


@F.pandas_udf(T.StringType())
def front_matter(texts: pd.Series) -> pd.Series:
    """JSON with sorted keys; dates as ISO strings."""
    return texts.map(lambda t: json.dumps(front_matter_of(t), sort_keys=True, ensure_ascii=False, default=lambda x: x.isoformat() if hasattr(x, "isoformat") else str(x)))


@F.pandas_udf(T.ArrayType(T.StringType()))
def unified_diff(a: pd.Series, b: pd.Series, name_a: pd.Series, name_b: pd.Series, context: pd.Series) -> pd.Series:
    """Of two arrays of lines, with so many lines of context."""
    out = [list(difflib.unified_diff(list(x), list(y), fromfile=m, tofile=n, lineterm="", n=k)) for x, y, m, n, k in zip(a, b, name_a, name_b, context, strict=True)]
    return pd.Series(out, dtype=object)
