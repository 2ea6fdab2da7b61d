import re

from tidemark.llm import queries


def test_all_queries_are_registered():
    found = {m[0] for name in queries.QUERIES if (m := re.match(r"op\d+|pipeline", name))}
    assert found == {"pipeline", *(f"op{k}" for k in range(1, 11))} and set(queries.ORACLE_SQL) <= set(queries.QUERIES)
