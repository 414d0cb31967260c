"""All registered queries and their SQL."""

from workload import charting, cleaning, deriving, featuring, flowing, modelling, planning, profiling, retrieving, testing

MODULES = [profiling, cleaning, deriving, featuring, testing, modelling, charting, planning, retrieving, flowing]
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
SQL = {name: sql for module in MODULES for name, sql in module.SQL.items()}
