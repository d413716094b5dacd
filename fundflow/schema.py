"""Table shapes of the model (Spark types)."""
from pyspark.sql import types as T

MONEY = T.DecimalType(38, 18)

TRANSFER_COLUMNS = ["tx_hash", "block_time", "from_address", "to_address", "amount", "amount_usd"]
TRANSACTION_COLUMNS = ["hash", "block_time", "from", "to"]
ACTION_COLUMNS = TRANSFER_COLUMNS + ["label"]

# Inputs as stored: amounts and times may also be numbers and timestamps.
TRANSFERS = T.StructType([T.StructField(c, T.StringType()) for c in TRANSFER_COLUMNS])
TRANSACTIONS = T.StructType([T.StructField(c, T.StringType()) for c in TRANSACTION_COLUMNS])

ACTIONS = T.StructType([
    T.StructField("tx_hash", T.StringType()),
    T.StructField("block_time", T.StringType()),
    T.StructField("from_address", T.StringType()),
    T.StructField("to_address", T.StringType()),
    T.StructField("amount", MONEY),
    T.StructField("amount_usd", MONEY),
    T.StructField("label", T.StringType()),
])

NODES = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("short", T.StringType()),
    T.StructField("role", T.StringType()),
    T.StructField("total_sent", T.DoubleType()),
    T.StructField("total_received", T.DoubleType()),
    T.StructField("tx_count", T.LongType()),
])

EDGES = T.StructType([
    T.StructField("from", T.StringType()),
    T.StructField("to", T.StringType()),
    T.StructField("tx_hash", T.StringType()),
    T.StructField("amount_eth", T.DoubleType()),
    T.StructField("amount_usd", T.DoubleType()),
    T.StructField("timestamp", T.StringType()),
    T.StructField("label", T.StringType()),
])

TIMELINE_COLUMNS = ["from", "to", "amount", "ts_ms", "label", "hash"]
# Total order of events: time first, then every other field (Spark sorts are
# not stable, so ties are broken by value; exact duplicates are interchangeable).
EVENT_ORDER = ["ts_ms", "hash", "from", "to", "amount", "label"]
