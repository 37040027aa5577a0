"""All queries by name."""

from . import boards, commute, journeys, readings, texts, upkeep

PARTS = (readings, journeys, commute, boards, texts, upkeep)


def queries():
    return {name: query for part in PARTS for name, query in part.QUERIES.items()}


def oracle_sql():
    return {name: sql for part in PARTS for name, sql in part.SQL.items()}
