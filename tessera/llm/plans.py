"""The queries of this subpackage, with SQL where SQL can express them."""

from __future__ import annotations

from . import bpe, chat, html, lm, packing, quality, simhash, suffixes, urls, vectors

_MODULES = (quality, urls, suffixes, simhash, chat, bpe, html, vectors, lm, packing)
QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLE_SQL = {k: v for m in _MODULES for k, v in m.ORACLE_SQL.items()}
