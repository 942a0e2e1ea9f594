"""The registered queries and their SQL."""

from __future__ import annotations

from . import forgetting, fusing, memory, retrieval, searching, texts

MODULES = (retrieval, memory, fusing, texts, searching, forgetting)
QUERIES: dict = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLES: dict = {k: v for m in MODULES for k, v in m.ORACLES.items()}
