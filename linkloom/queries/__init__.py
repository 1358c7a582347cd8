"""The registry of queries and of the SQL that gives the same rows."""

from linkloom.queries import dealt, graph, rebuild

QUERIES = {**dealt.QUERIES, **graph.QUERIES, **rebuild.QUERIES}
ORACLE = {**dealt.ORACLE, **graph.ORACLE, **rebuild.ORACLE}
