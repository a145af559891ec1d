"""All queries of the core by name, and the SQL each is held against."""

from __future__ import annotations

from papyrion.plans import files, functions, media, packages, problems, tables, texts

QUERIES = {**texts.QUERIES, **tables.QUERIES, **packages.QUERIES, **functions.QUERIES, **files.QUERIES, **media.QUERIES, **problems.QUERIES}
ORACLE = {**texts.ORACLE, **tables.ORACLE, **packages.ORACLE, **functions.ORACLE, **files.ORACLE, **media.ORACLE, **problems.ORACLE}
