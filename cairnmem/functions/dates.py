"""Times in text."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def iso_seconds(text: Column) -> Column:
    """Seconds since 1970 of an ISO 8601 time, with or without fraction and zone (then UTC) or time of day; null for
    any other text."""
    day = text.rlike(r"^\d{4}-\d{2}-\d{2}$")
    full = text.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?$")
    zoned = text.rlike(r"(Z|[+-]\d{2}:?\d{2})$") & ~day
    plain = F.when(day | ~zoned, F.concat(text, F.when(day, "T00:00:00Z").otherwise("Z"))).otherwise(text)
    # A zone may come without its colon.
    plain = F.regexp_replace(plain, r"([+-]\d{2})(\d{2})$", "$1:$2")
    return F.when(day | full, F.unix_micros(F.try_to_timestamp(plain)) / F.lit(1e6))
