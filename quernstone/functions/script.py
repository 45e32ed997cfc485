"""Traditional to simplified characters, with the table of the ICU library that Spark brings along."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Blocks of ideographs that are asked for: extension A, the common block, compatibility ideographs, the further planes.
BLOCKS = ((0x3400, 0x4DC0), (0x4E00, 0xA000), (0xF900, 0xFB00), (0x20000, 0x323B0))
# Characters whose simplified form depends on the phrase; they stay.
BY_PHRASE = "乾著瞭藉夥覆徵鍾"

_TABLES: dict[str, tuple[str, str]] = {}


def simplification(spark: SparkSession) -> tuple[str, str]:
    """Traditional characters and their simplified forms, one for one, for ``text.simplified``. Built once, by one call to the JVM."""
    if "icu" not in _TABLES:
        icu = spark.sparkContext._jvm.com.ibm.icu.text.Transliterator.getInstance("Traditional-Simplified")
        asked = [chr(c) for first, last in BLOCKS for c in range(first, last) if chr(c) not in BY_PHRASE]
        pairs = [(a, b) for a, b in zip(asked, icu.transliterate("\n".join(asked)).split("\n")) if a != b and len(b) == 1]
        _TABLES["icu"] = "".join(a for a, _ in pairs), "".join(b for _, b in pairs)
    return _TABLES["icu"]
