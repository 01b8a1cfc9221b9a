"""All queries of the library over the tables of a folder, each with the SQL that DuckDB runs on the same tables."""

from __future__ import annotations

from pairlens.plans import forms, measures, outcomes, reports, texts

QUERIES = outcomes.QUERIES | texts.QUERIES | measures.QUERIES | reports.QUERIES | forms.QUERIES
ORACLE = outcomes.ORACLE | texts.ORACLE | measures.ORACLE | reports.ORACLE | forms.ORACLE
