"""Operators for training data: deduplication, extraction, scoring, encoding, search, packing, personal data."""


def queries():
    from sieveline.llm.registered import QUERIES

    return dict(QUERIES)


def oracle_sql():
    from sieveline.llm.registered import SQL

    return dict(SQL)
