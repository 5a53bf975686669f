"""Every registered query and its SQL, by operator id."""

from importlib import import_module

from plumbline.session import configure

GROUPS = ["retrieval", "grounding", "parsing", "checks", "scoring", "timeline", "ledger", "graph", "jobs", "trace", "library"]


def _modules():
    return [import_module(f"plumbline.plans.{g}") for g in GROUPS]


def _with_settings(fn):
    def run(spark, sf_dir):
        return fn(configure(spark), sf_dir)

    return run


def queries():
    return {name: _with_settings(fn) for m in _modules() for name, fn in m.QUERIES.items()}


def oracle_sql():
    return {name: sql for m in _modules() for name, sql in m.ORACLE.items()}


def flagship(spark, sf_dir):
    return queries()["q4_top_sections"](spark, sf_dir)
