"""The one scalar function Spark lacks: Unicode composition, as a vectorised function. Imported only where it is used."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def compose(c: Column) -> Column:
    @F.pandas_udf("string")
    def nfc(s: pd.Series) -> pd.Series:
        return s.map(lambda t: t if t is None else unicodedata.normalize("NFC", t))

    return nfc(c)
