"""Column names and types shared by readers and operators."""

from __future__ import annotations

from pyspark.sql import types as T

LEVELS = (1, 2, 3)

# The column order of a headerless price file.
PRICE_COLUMNS = [
    "day",
    "timestamp",
    "product",
    *[f"bid_{kind}_{i}" for i in LEVELS for kind in ("price", "volume")],
    *[f"ask_{kind}_{i}" for i in LEVELS for kind in ("price", "volume")],
    "mid_price",
    "profit_and_loss",
]
PRICE_NUMBERS = PRICE_COLUMNS[3:]

# Every field as text: files carry header lines and stray words among the numbers.
PRICE_TEXT = T.StructType([T.StructField(c, T.StringType()) for c in PRICE_COLUMNS])

QUOTE_TEXT_FIELDS = ["timestamp", "product", "symbol", "side", "price", "quantity", "order_id", "type"]
