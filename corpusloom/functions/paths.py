"""Path spelling: one canonical form for the spellings that different hosts write."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


@F.pandas_udf(StringType())
def _nfc(text: pd.Series) -> pd.Series:
    return text.map(lambda s: unicodedata.normalize("NFC", s), na_action="ignore")


def canonical_path(path: Column) -> Column:
    """Forward slashes, no empty or ``.`` steps, no leading slash, composed characters; letter case is kept. Null stays null.

    Only paths with characters beyond ASCII cross into Python, for their Unicode form.
    """
    p = F.regexp_replace(path, r"[\\/]+", "/")
    p = F.regexp_replace(p, r"^(?:\./)+|(?<=/)(?:\./)+", "")
    p = F.regexp_replace(p, r"^/|/\.?$", "")
    return F.coalesce(_nfc(F.when(p.rlike(r"[^\x00-\x7F]"), p)), p)
