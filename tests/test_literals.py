"""Queries over tables derived from the given ones also give the rows of their SQL on literal rows, which hold the odd cases."""

import re

import duckdb
import pytest
from test_oracle import TABLES, value

from quernel.operators import governance as G
from quernel.operators import sections as S
from quernel.plans import governance as P
from quernel.plans.registry import FIXTURES, QUERIES, SQL

DERIVED = [f for f in FIXTURES if f.source]


def literal(sql: str) -> str:
    for f in DERIVED:
        sql = sql.replace(f.cte(), f.literal())
    return sql


NAMES = sorted(n for n, sql in SQL.items() if literal(sql) != sql and not re.search(rf"\b(FROM|JOIN) ({'|'.join(TABLES)})\b", literal(sql)))


def test_most_are_covered():
    assert len(NAMES) > 70


@pytest.mark.parametrize("name", NAMES)
def test_literal_rows(spark, name):
    df = QUERIES[name](spark, None)
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    result = con.execute(literal(SQL[name]))
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(df.columns)
    want = [dict(zip(columns, r)) for r in result.fetchall()]
    rows = lambda rs: sorted((tuple(value(r[c]) for c in sorted(columns)) for r in rs), key=repr)
    assert rows([r.asDict() for r in df.collect()]) == rows(want)


def test_sections_of_literal_pages(spark):
    got = S.sections(S.with_frontmatter(P.MARKDOWN.df(spark))).collect()
    want = {r[:2]: r for r in P.SECTIONS.rows}
    assert {(r.name, r.emit_seq): (r.name, r.emit_seq, r.heading, " > ".join(r.heading_path), r.content, r.leaf, r.id) for r in got} == want


def test_gaps_of_a_literal_log(spark):
    got = {(r.canonical, r.reason, r.section, r.hits, tuple(r.samples)) for r in G.coverage_gaps(G.parse_lines(P.LOG.df(spark))).collect()}
    # "how long" fails twice more than it succeeds, "what else" once before a success of its own, "cited one" has no success
    assert got == {("cited one", "claim_unsupported", "a,b", 1, ("cited one",)), ("how long", "below_threshold", "a#b", 2, ("How long?", "how  long")), ("what else", "retrieval_empty", None, 1, ("what else",))}
