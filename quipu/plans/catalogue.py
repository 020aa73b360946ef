"""All queries over the driver tables and their SQL, by name."""

from __future__ import annotations

from quipu.plans import cleaned, core, domain, edits, flows, loads, lookups, named, paths, reforms, rulesets, search, services, small, streamed, texts, vat

_TABLES = [m.R for m in (core, texts, domain, flows, search, services, rulesets, edits, reforms, lookups, streamed, paths, named, vat, loads, small, cleaned)]
QUERIES = {name: query for table in _TABLES for name, query in table.queries.items()}
SQL = {name: sql for table in _TABLES for name, sql in table.sql.items()}
