"""The catalogue of the engine's own queries and of the SQL that checks them."""

from __future__ import annotations

from . import filtering, flows, formats, records, relational, streams, texts, vectors  # noqa: F401
from .registry import ORACLE_SQL, QUERIES  # noqa: F401
