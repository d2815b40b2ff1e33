"""The ticket table: column order, types, and the flag texts."""

from pyspark.sql import types as T

# The columns of a ticket and their order.
TEXT_COLUMNS = [
    "status", "date", "ticket_id", "event_group", "event_type", "client_raw", "client_normalized", "address_raw", "address_normalized", "address_city",
    "point_name", "problem_raw", "problem_normalized", "assignee", "author", "comment", "_table_name", "_sheet_name",
]
TICKET = T.StructType(
    [T.StructField(c, T.StringType()) for c in TEXT_COLUMNS]
    + [T.StructField("problem_tags", T.ArrayType(T.StringType())), T.StructField("point_key", T.StringType()), T.StructField("point_flags", T.ArrayType(T.StringType())), T.StructField("ingest_seq", T.LongType()), T.StructField("event_ts", T.TimestampNTZType())]
)
FLAG_GUESSED, FLAG_FORM, FLAG_SHARED, FLAG_TERRITORY = "identity guessed", "form filled", "one sign, several owners", "territories differ"
UNASSIGNED = "unassigned"
DASH = "—"
