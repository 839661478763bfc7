"""Every query of the engine with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from veristrata.plans import assembling, building, evaluation, judging, lexical, reporting, researching, splitting, streams

FLAGSHIP = "i02_bm25_top10"
QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}
for _module in (lexical, assembling, building, splitting, evaluation, judging, reporting, researching, streams):
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
