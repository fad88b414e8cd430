"""All registered queries outside the corpus subpackage, and their DuckDB equivalents."""

from sheetwise.plans import command_queries, document_queries, export_queries, layout_queries, relational_queries, section_queries, spec_queries, text_queries

MODULES = (text_queries, relational_queries, document_queries, layout_queries, export_queries, command_queries, spec_queries, section_queries)
QUERIES = {name: q for m in MODULES for name, q in m.QUERIES.items()}
ORACLES = {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
