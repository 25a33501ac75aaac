"""Where the ten rental relations come from, and where results go."""

from rentlens.sources.relations import RELATION_COLUMNS, Relations, from_jdbc, from_parquet
from rentlens.sources.sinks import write_result
from rentlens.sources.star import from_star

__all__ = [
    "RELATION_COLUMNS", "Relations", "from_jdbc", "from_parquet", "from_star", "write_result",
]
