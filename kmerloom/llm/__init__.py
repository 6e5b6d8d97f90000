"""Operations of a training-data pipeline, each by one named method.

``queries`` and ``oracle_sql`` register them; nothing else in the package imports this one.
"""

from .queries import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
