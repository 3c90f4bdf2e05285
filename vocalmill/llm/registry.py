"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import bpe, convtrie, decontamination, htmltext, langid, licenses, linededup, orderminhash, quality, ranking, simhash, toxicity, urlfilter

MODULES = (decontamination, orderminhash, licenses, quality, ranking, simhash, toxicity, htmltext, bpe, linededup, langid, convtrie, ranking, urlfilter)
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLE = {name: sql for module in MODULES for name, sql in module.ORACLE.items()}
