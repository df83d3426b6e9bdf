"""One spelling for label values, and column names that every writer accepts."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..columns import is_string, resolve_columns
from ..functions.text import sanitise_label

# Characters not allowed in feature names.
UNSAFE_NAME_PATTERN = r'[\[\]{}:",\s]'


def sanitize_categories(
    df: DataFrame,
    columns=None,
    lowercase: bool = True,
    strip_whitespace: bool = True,
    remove_punctuation: bool = False,
) -> DataFrame:
    names = [n for n in resolve_columns(df, columns, "string") if is_string(df.schema[n].dataType)]
    return df.withColumns({
        n: sanitise_label(F.col(f"`{n}`"), lowercase, strip_whitespace, remove_punctuation) for n in names
    })


def safe_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[re.sub(UNSAFE_NAME_PATTERN, "_", n) for n in df.columns])
