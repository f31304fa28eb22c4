"""Relational operators: joins, aggregates, rankings, sets, bootstrap."""
