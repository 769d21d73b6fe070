"""Times of posts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def created(text: Column) -> Column:
    """The timestamp of a post's ``created_at``, in either of its formats; null where unreadable."""
    api = F.try_to_timestamp(F.substring(text, 5, 40), F.lit("MMM dd HH:mm:ss Z yyyy"))
    return F.coalesce(api, text.try_cast("timestamp"))
