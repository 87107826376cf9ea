"""Registered queries of the operators and of the pipeline."""

from __future__ import annotations

import corpus_pipeline
from semgraph.llm import (benchmark, discriminant, licences, lines, pages, personal, pieces, quality, simhash, tries,
                          urls, whitening)

MODULES = (lines, licences, simhash, pieces, benchmark, urls, quality, personal, pages, tries, whitening,
           discriminant)

QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.queries.items()}
SQL = {name: sql for module in MODULES for name, sql in module.QUERIES.sql.items()}

QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL:
    SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
