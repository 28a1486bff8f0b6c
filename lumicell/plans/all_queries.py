"""All core queries: importing the modules registers theirs beside those of `queries`."""

from __future__ import annotations

from . import aligned, further
from .queries import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "aligned", "further"]
