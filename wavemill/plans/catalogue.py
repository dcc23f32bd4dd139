"""All queries of the reference's operators; importing the modules registers them."""

from __future__ import annotations

from . import curation, detect, drift, matching, models, shapes, signal, sorting, timing, units  # noqa: F401
from .registry import ORACLE_SQL, QUERIES  # noqa: F401
