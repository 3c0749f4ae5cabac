"""Every registered query of the engine against its SQL in DuckDB, on the smallest test tables."""

import difflib
import hashlib
import os
import re

import duckdb
import pytest

from lumendoc.operators.reviews import FUZZY, similar
from lumendoc.plans import catalogue

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(DATA):
        pytest.skip("no test tables here")
    c = duckdb.connect()
    for t in TABLES:
        path = f"{DATA}/{t}.parquet"
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return c


def plain(row):
    return tuple(round(x, 6) if isinstance(x, float) else x for x in row)


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_query(spark, con, name):
    got = catalogue.QUERIES[name](spark, DATA)
    sql = catalogue.ORACLES.get(name)
    if sql is None:
        assert got.count() > 0
        return
    want = con.sql(sql)
    assert sorted(want.columns) == sorted(got.columns)
    assert sorted(map(plain, got.select(*want.columns).collect()), key=str) == sorted(map(plain, want.fetchall()), key=str)


def brute_groups(issues):
    groups = []
    for issue in issues:
        near = [g for g in groups if difflib.SequenceMatcher(None, g[0].lower(), issue.lower()).ratio() >= FUZZY]
        near[0].append(issue) if near else groups.append([issue])
    return groups


def test_fuzzy_dedup_against_brute_force(spark, con):
    """Every turn's three issues, compared pair by pair in the reviewers' order."""
    want = set()
    for conv_id, turn, text in con.sql("SELECT conv_id, turn, text FROM conversations").fetchall():
        words = re.split(r"\s+", text, flags=re.ASCII)
        groups = brute_groups((" ".join(words), " ".join(words[::-1]), " ".join(words).upper()))
        want |= {(conv_id, turn, hashlib.sha256(g[0].encode()).hexdigest(), len(g)) for g in groups}
    got = {(r["conv_id"], r["turn"], r["issue_sha256"], r["n_reviewers"]) for r in catalogue.QUERIES["fuzzy_dedup"](spark, DATA).collect()}
    assert got == want


def test_bounds_of_the_ratio_change_no_group(con):
    """Whole documents in pairs: the bounds rule out only what the ratio rules out."""
    texts = [x[0] for x in con.sql("SELECT text FROM documents WHERE text IS NOT NULL AND length(text) < 600 ORDER BY doc_id").fetchall()][:60]
    pairs = [(a, b) for k, a in enumerate(texts) for b in texts[k : k + 12]] + [("", ""), ("", "a"), ("ab", "BA")]
    assert [similar(a, b) for a, b in pairs] == [difflib.SequenceMatcher(None, a.lower(), b.lower()).ratio() >= FUZZY for a, b in pairs]
