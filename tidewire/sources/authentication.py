"""Keyed proofs of a handshake transcript."""

from __future__ import annotations

import base64
import hashlib
import hmac

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

SEPARATOR = "\x1f"


def proof(secret: str, *parts: str) -> str:
    """Base64 of HMAC-SHA256 over the parts, joined by the unit separator."""
    return base64.b64encode(hmac.new(secret.encode(), SEPARATOR.join(parts).encode(), hashlib.sha256).digest()).decode()


def proof_column(secret: str, *parts: Column) -> Column:
    @F.pandas_udf(StringType())
    def run(joined: pd.Series) -> pd.Series:
        return joined.map(lambda x: proof(secret, x))

    return run(F.concat_ws(SEPARATOR, *parts))
