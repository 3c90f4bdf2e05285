"""All registered queries and their SQL."""

from __future__ import annotations

from .plans import chain, files, hotkeys, library, reviews, stores, streams, transcripts

QUERIES: dict = {**transcripts.QUERIES, **library.QUERIES, **streams.QUERIES, **files.QUERIES, **chain.QUERIES, **reviews.QUERIES, **stores.QUERIES, **hotkeys.QUERIES}
ORACLE: dict = {**transcripts.ORACLE, **library.ORACLE, **streams.ORACLE, **files.ORACLE, **chain.ORACLE, **reviews.ORACLE, **stores.ORACLE, **hotkeys.ORACLE}
