"""The subpackage hands out its queries however often it is asked, and whatever was imported before."""

import importlib

import __spark_entry__ as entry


def test_queries_can_be_asked_for_again():
    importlib.import_module("sieveline.llm.registered")
    first, second = entry.queries(), entry.queries()
    assert set(first) == set(second) and set(entry.oracle_sql()) <= set(second)
