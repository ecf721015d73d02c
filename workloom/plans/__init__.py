"""All registered queries, their checks, and the flagship query."""

from importlib import import_module

from workloom.plans import registry

SECTIONS = ["ingest", "refine", "combine", "measure", "people", "retrieval", "modelling", "training", "live"]


def _load():
    for section in SECTIONS:
        import_module(f"workloom.plans.{section}")


def all_queries():
    _load()
    return {name: registry.runnable(fn) for name, fn in registry.QUERIES.items()}


def all_checks():
    _load()
    return {name: registry.check_sql(sql) for name, sql in registry.CHECKS.items()}


def flagship(spark, folder):
    return all_queries()["flagship_pay_and_suitability"](spark, folder)
