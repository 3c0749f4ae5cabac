"""Neighbours, co-bucketed tables and the resampling draw against brute force."""

import collections
import datetime
import hashlib
import heapq
import math
import os
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lumendoc.llm import bucket_pair, importance_resampling, projected_neighbours

# --- projected neighbours ---------------------------------------------------


def test_chi_square_quantile():
    assert projected_neighbours.chi_square_quantile(0.95, 2) == pytest.approx(5.9915, abs=1e-3)
    assert projected_neighbours.chi_square_quantile(0.975, 16) == pytest.approx(28.845, abs=1e-3)


def vectors():
    rnd = np.random.default_rng(3)
    centres = rnd.standard_normal((6, 24))
    rows = [(k, (centres[k % 6] + rnd.standard_normal(24)).tolist(), "x", k) for k in range(1500)]
    hot = rows[0][1]
    rows += [(2000 + k, hot, "hot", 0) for k in range(700)]
    rows += [(3000 + k, [2 * x for x in hot], "scaled", 0) for k in range(3)]
    rows += [(4000, None, "", 0), (4050, [], "", 0), (4100, [0.0] * 24, "", 0), (4150, [float("nan")] * 24, "", 0), (4200, [float("inf")] + [1.0] * 23, "", 0), (4250, [None] + [1.0] * 23, "", 0)]
    rows += [(None, hot, "", 0), (4300, [1.0, 2.0], "short", 0), (50, rows[51][1], "repeated id", 0), (4350, [x * 1e200 for x in rows[9][1]], "large", 0), (-50, rows[8][1], "", 0)]
    return rows


SCHEMA = "vec_id long, embedding array<double>, query string, score int"


def exact_neighbours(rows, k=5, step=50):
    best = {}
    for i, v, *_ in rows:
        if i is None or not v or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            continue
        v = v + [0.0] * (24 - len(v))
        v = [x / max(map(abs, v)) for x in v] if max(map(abs, v)) > 1e100 else v
        best[i] = min(best.get(i, v), v)
    ids = np.array(sorted(best))
    x = np.array([best[i] for i in ids])
    x = x / np.sqrt((x * x).sum(1))[:, None]
    out = {}
    for q in np.flatnonzero(ids % step == 0):
        cos = x @ x[q]
        order = [j for j in np.lexsort((ids, -np.round(cos, 12))) if j != q][:k]
        out[int(ids[q])] = [(int(ids[j]), float(cos[j])) for j in order]
    return out


@pytest.mark.parametrize("how", [{}, {"cell_rows": 100, "query_rows": 20}])
def test_neighbours_recall_and_scores(spark, how):
    rows = vectors()
    want = exact_neighbours(rows)
    got = collections.defaultdict(list)
    for r in projected_neighbours.nearest(spark.createDataFrame(rows, SCHEMA).repartition(5), **how).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == set(want)
    hits = 0
    for q, near in want.items():
        mine = sorted(got[q])
        assert [x[0] for x in mine] == [1, 2, 3, 4, 5] and q not in [x[1] for x in mine]
        assert all(a[2] >= b[2] for a, b in zip(mine, mine[1:]))
        hits += len({x[1] for x in mine} & {x[0] for x in near})
        known = dict(near)
        assert all(abs(s - known[i]) < 1e-9 for _, i, s in mine if i in known)
    assert hits >= 0.95 * 5 * len(want)
    # of a vector that many share, the smallest ids come first, wherever they are
    assert [x[1] for x in sorted(got[0])] == [2000, 2001, 2002, 2003, 2004]
    assert [x[1] for x in sorted(got[2050])] == [0, 2000, 2001, 2002, 2003]


def test_neighbours_of_few_rows(spark):
    two = spark.createDataFrame([(0, [1.0, 0.0]), (7, [1.0, 1.0])], "vec_id long, embedding array<float>")
    got = projected_neighbours.nearest(two).collect()
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in got] == [(0, 1, 7)] and abs(got[0]["score"] - 0.5**0.5) < 1e-12
    assert projected_neighbours.nearest(two.limit(0)).count() == 0
    assert projected_neighbours.nearest(two.where("vec_id = 7")).count() == 0
    assert projected_neighbours.nearest(two.where("vec_id = 0")).count() == 0


def test_neighbours_query(spark):
    data = "/root/testdata/sf0.001"
    got = projected_neighbours.nearest_query(spark, data)
    assert [(f.name, f.dataType.simpleString()) for f in got.schema.fields] == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "double")]
    n = spark.read.parquet(f"{data}/embeddings.parquet").where("vec_id % 50 = 0").count()
    assert got.count() == 5 * n


# --- co-bucketed tables -----------------------------------------------------


def crc(text):
    return zlib.crc32(text.encode())


def sort_key(row, schema_key=0):
    def at(x):
        if x is None:
            return (0,)
        return (1, x.encode() if isinstance(x, str) else tuple(sorted(x.items())) if isinstance(x, dict) else x)

    own = row[schema_key]
    return ((0,) if own is None else (1, -own), *(at(x) for k, x in enumerate(row) if k != schema_key))


def check_pair(found, sales, lines, start_s, start_l, buckets=600):
    """The files and what is told of them, against lists of tuples whose first column is the key."""
    held = {r[0] for r in sales} - {None}
    in_sales, in_lines = (collections.Counter(r[0] for r in t if r[0] is not None) for t in (sales, lines))
    joined = collections.Counter()
    for k, n in in_sales.items():
        joined[crc(f"s{k}") % buckets] += n * in_lines[k]
    own = lambda r: buckets + 1 if r[0] is None else crc(f"s{r[0]}") % buckets
    told = {(r["table_name"], r["bucket"]): r for r in found}
    assert len(told) == len(found)
    seen = set()
    for name, rows, start, bucket in (("sales", sales, start_s, own), ("sale_lines", lines, start_l, lambda r: own(r) if r[0] is None or r[0] in held else buckets)):
        groups, starts = collections.defaultdict(list), collections.Counter(start(r) for r in rows)
        for r in rows:
            groups[bucket(r)].append(r)
        for b, group in groups.items():
            group.sort(key=sort_key)
            mine = told.pop((name, b))
            ids = ",".join("" if r[0] is None else str(r[0]) for r in group)
            flow = sorted(collections.Counter(start(r) for r in group).items())
            assert mine["n_rows"] == len(group) and mine["n_joined"] == (joined[b] if b < buckets else 0)
            assert mine["ids_sha256"] == hashlib.sha256(ids.encode()).hexdigest()
            assert mine["lineage_sha256"] == hashlib.sha256(",".join(f"{s}:{n}" for s, n in flow).encode()).hexdigest()
            stays = len(flow) == 1 and starts[flow[0][0]] == len(group)
            assert mine["rewritten"] != stays
            path = mine["path"].removeprefix("file://")
            t = pq.read_table(path)
            assert ",".join(t.column_names) == mine["columns"]
            values = [tuple(dict(x) if isinstance(x, list) else x for x in r.values()) for r in t.to_pylist()]
            assert values == [tuple(r) for r in group]
            seen.add(path)
    assert not told
    if seen:
        root = os.path.dirname(os.path.dirname(next(iter(seen))))
        assert {os.path.join(a, f) for a, _, fs in os.walk(root) for f in fs if not f.startswith(".")} == seen


@pytest.mark.parametrize("hot", [{}, {"hot": 2, "hot_rows": 10}])
def test_bucket_pair(spark, tmp_path, hot):
    rnd = random.Random(6)
    text = lambda: rnd.choice([None, "", "a", "B", "é", "z" * 300, "😀", "～"])
    at = lambda: datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=rnd.randrange(10**6))
    sales = [(k if k % 17 else None, text(), k % 3, at()) for k in range(120)] + [(5, "twice", 1, at())] * 2
    lines = [(rnd.choice([7, 7, 7, None, rnd.randrange(300)]), rnd.choice([None, 4, rnd.randrange(40)]), text(), rnd.random()) for _ in range(900)] + [(7, 4, "same", 0.5)] * 40
    s = spark.createDataFrame(sales, "sale_id long, file_number string, `number` int, sold timestamp_ntz").repartition(3)
    ln = spark.createDataFrame(lines, "sale_id long, item_id long, `salt` string, `a.b` double").repartition(4)
    started = lambda r: crc(f"s{r[0]}") % 20 if r[0] is not None else 3
    item = lambda r: 0 if r[1] is None else crc(str(r[1])) % 20
    out = bucket_pair.rewrite(
        spark, s, ln, F.coalesce(bucket_pair.bucket_of(F.col("sale_id"), buckets=20), F.lit(3)), F.coalesce(bucket_pair.bucket_of(F.col("item_id"), "", 20), F.lit(0)),
        root=f"file://{tmp_path}/pair", buckets=20, bits=1 << 10, **hot,
    )
    check_pair(out.collect(), sales, lines, started, item, 20)


def test_bucket_pair_of_empty_and_small_tables(spark, tmp_path):
    s = spark.createDataFrame([(1, "a"), (None, "b")], "sale_id long, x string")
    ln = spark.createDataFrame([(1, 2, {"k": 1}), (9, 2, None), (None, None, {"a": 1})], "sale_id long, item_id long, m map<string,int>")
    run = lambda a, b, to: bucket_pair.rewrite(spark, a, b, F.lit(0), F.coalesce(bucket_pair.bucket_of(F.col("item_id"), "", 20), F.lit(0)), root=f"{tmp_path}/{to}", buckets=20).collect()
    item = lambda r: 0 if r[1] is None else crc(str(r[1])) % 20
    rows = lambda df: [tuple(r) for r in df.collect()]
    check_pair(run(s, ln, "a"), rows(s), rows(ln), lambda r: 0, item, 20)
    check_pair(run(s.limit(0), ln, "b"), [], rows(ln), lambda r: 0, item, 20)
    check_pair(run(s, ln.limit(0), "c"), rows(s), [], lambda r: 0, item, 20)
    assert run(s.limit(0), ln.limit(0), "d") == []


def test_bucket_pair_query(spark):
    data = "/root/testdata/sf0.001"
    rows = lambda t: [tuple(r) for r in spark.read.parquet(f"{data}/{t}.parquet").collect()]
    own = lambda r: 601 if r[0] is None else crc(f"s{r[0]}") % 600
    check_pair(bucket_pair.pair_query(spark, data).collect(), rows("sales"), rows("sale_lines"), lambda r: own(r) - (own(r) % 4 == 1), lambda r: 0 if r[2] is None else crc(str(r[2])) % 600)


def test_key_filter_has_no_false_negatives(spark):
    keys = spark.createDataFrame([(k * 7919,) for k in range(500)] + [(None,), (-3,)], "k long").repartition(9)
    found = bucket_pair.key_filter(keys, 1 << 13)
    probe = bucket_pair.held(spark, found, 1 << 13)
    assert keys.where(probe("k")).count() == 501
    others = spark.range(10**6, 10**6 + 3000).select(F.col("id").alias("k")).where("k % 7919 <> 0")
    assert others.where(probe("k")).count() < 300


# --- importance resampling --------------------------------------------------


def words(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)


def brute_resample(docs, target, buckets=10_000, percent=10, least=20, seed=2024):
    of = lambda t: [crc(w) % buckets for w in words(t)]
    s, t = collections.Counter(x for _, d in docs for x in of(d)), collections.Counter(x for d in target for x in of(d))
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s_all + buckets) / ((s[b] + 1) * (t_all + buckets))))
    rows = []
    for doc, d in docs:
        own = of(d)
        h = int(hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, own))
        rows.append((doc, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    fit = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    drawn = collections.Counter((*r, k) for k, r in enumerate(fit[: percent * len(fit) // 100], 1))
    rest = collections.Counter(rows)
    for r, n in drawn.items():
        rest[r[:4]] -= n
    return drawn + collections.Counter({(*r, None): n for r, n in rest.items() if n})


def sample_docs():
    rnd = random.Random(9)
    vocabulary = [f"w{k}" for k in range(200)] + ["Ünï", "ǅabc", "x" * 31, "y" * 32, "z" * 33, "Q" * 500, "a-b_c", "9"]
    docs = [(k, " ".join(rnd.choice(vocabulary) for _ in range(rnd.choice([0, 5, 19, 20, 40, 300])))) for k in range(400)]
    docs += [(1000, docs[3][1])] * 150 + [(None, " ".join(vocabulary)), (None, None), (2000, None), (2001, ""), (2002, "long " * 300_000), (2003, "\x00.,"), (3, "another text " * 15)]
    return docs, [" ".join(vocabulary[:60]) * 3, None, "", "Ünï " * 50]


@pytest.mark.parametrize("how", [{}, {"run_rows": 7, "range_rows": 3}, {"percent": 100}, {"percent": 37, "range_rows": 10}])
def test_resampling(spark, how):
    docs, target = sample_docs()
    d = spark.createDataFrame([(*r, "s") for r in docs], "doc_id long, text string, score string").repartition(7)
    t = spark.createDataFrame([(x,) for x in target], "text string")
    got = importance_resampling.resample(d, t, **how).collect()
    assert collections.Counter(tuple(r[c] for c in ("doc_id", "n_features", "weight", "score", "rank")) for r in got) == brute_resample(docs, target, percent=how.get("percent", 10))


def test_resampling_of_little(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    few = spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id long, text string")
    assert importance_resampling.resample(none, few).count() == 0
    assert {(r["doc_id"], r["n_features"], r["rank"]) for r in importance_resampling.resample(few, none).collect()} == {(1, 3, None), (2, 0, None)}
    assert [r["rank"] for r in importance_resampling.resample(few, none, percent=100, min_words=1).collect() if r["doc_id"] == 1] == [1]


def test_word_buckets_across_stretches(monkeypatch):
    monkeypatch.setattr(importance_resampling, "STRETCH", 50)
    texts = ["Alpha beta " * 20, None, "", "γάμμα" * 30, "x" * 200 + " y", "end"]
    found, at = importance_resampling.word_buckets(pa.array(texts))
    for k, t in enumerate(texts):
        assert found[at[k] : at[k + 1]].tolist() == [crc(w) % 10_000 for w in words(t)]


def test_tournament_merges_sorted_lists():
    rnd = random.Random(1)
    for _ in range(200):
        runs = [sorted(((rnd.randrange(9), k), (k,)) for k in range(rnd.randrange(6))) for _ in range(rnd.randrange(9))]
        assert list(importance_resampling.tournament(runs)) == list(heapq.merge(*runs))


def test_resampling_query_equals_sql(spark):
    data = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{data}/{name}.parquet')").fetchall()
    want = collections.Counter(con.execute(importance_resampling.RESAMPLE_SQL).fetchall())
    got = importance_resampling.resample_query(spark, data).collect()
    assert collections.Counter(tuple(r[c] for c in ("doc_id", "n_features", "weight", "score", "rank")) for r in got) == want
