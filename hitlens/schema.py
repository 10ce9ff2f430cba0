"""Raw line layouts and the canonical log table."""

from pyspark.sql import types as T

# Column order of each raw layout.
LAYOUTS = {
    "tsv11": ("date", "time", "ip", "method", "uri", "status", "bytes", "time-taken",
              "Referer", "User-Agent", "Cookie"),
    "space11": ("ip", "identity", "user", "timestamp", "method", "uri", "protocol", "status",
                "bytes", "referer", "user_agent"),
    "tsv9": ("timestamp", "ip", "method", "uri", "status", "bytes", "response_time",
             "referer", "user_agent"),
    "clf": ("ip", "identity", "user", "timestamp", "method", "uri", "protocol", "status",
            "bytes", "referer", "user_agent"),
}

# Raw name -> canonical name.
RENAMES = {
    "User-Agent": "user_agent",
    "Referer": "referer",
    "time-taken": "response_time",
    "Cookie": "cookie",
}

# File types accepted by the reader.
EXTENSIONS = ("log", "txt", "csv", "tsv")

CANONICAL = T.StructType([
    T.StructField("datetime", T.TimestampNTZType()),
    *[T.StructField(name, T.StringType()) for name in (
        "ip", "identity", "user", "method", "uri", "protocol", "status", "bytes",
        "response_time", "referer", "user_agent", "cookie")],
])
