"""What can be read and written, as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Format or codec, operation, state and what limits it.
CAPABILITIES = [
    *((f, op, "available", None) for f in ("tar", "cpio", "ar", "zip") for op in ("read", "write")),
    *((f, "read", "available", None) for f in ("iso9660", "cab", "xar")),
    *((f, "write", "unsupported", "reading only") for f in ("iso9660", "cab", "xar")),
    ("7z", "read", "unsupported", "told by its magic, not parsed"),
    ("7z", "write", "unsupported", None),
    *((c, op, "available", None) for c in ("gzip", "bzip2", "xz") for op in ("read", "write")),
    *(("zstd", op, "optional", "needs the package zstandard") for op in ("read", "write")),
    ("lz4", "read", "available", None),
    ("lz4", "write", "available", "stored blocks"),
    *((m, "read", "available", "ZIP method") for m in ("store", "deflate", "bzip2-member", "lzma-member", "zstd-member")),
    *((m, "read", "unsupported", "ZIP method") for m in ("deflate64", "aes", "ppmd")),
    *((m, "read", "unsupported", "CAB method") for m in ("quantum", "lzx")),
]


def capabilities(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CAPABILITIES, "name string, operation string, state string, remark string")
