"""The one function that Spark has no expression for, as an Arrow-batched UDF."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

# a lambda goes to the workers as it is, so they need no package
_nfc = pandas_udf(lambda s: s.map(lambda t: None if t is None else unicodedata.normalize("NFC", t)), StringType())


def composed(text: Column) -> Column:
    """SC2: text in Unicode's composed form; ASCII text, which is, doesn't go through the UDF."""
    ascii_ = F.octet_length(text) == F.length(text)
    return F.coalesce(_nfc(F.when(~ascii_, text)), text)
