"""Rows told apart whatever their ids and columns; hashes of words that are made to collide."""

import collections
import random

import numpy as np
import pyarrow as pa
import pytest

from lumendoc.llm import exact_dedup, jaccard_join, lm_scoring, mixing, quality_rules, sentencepiece_codec, substring_dedup, tokens


def crafted(bits=10):
    """A word of 2**bits letters and its mirror, whose polynomials modulo 2**64 are equal for any odd base."""
    parity = [bin(k).count("1") % 2 for k in range(1 << bits)]
    return "".join("ab"[p] for p in parity), "".join("ba"[p] for p in parity)


@pytest.mark.parametrize("bits", [10, 11, 13])
def test_crafted_long_words_do_not_collide(bits):
    a, b = crafted(bits)
    h, _ = tokens.word_hashes(pa.array([a, b, a.upper(), "x " + b]))
    assert h[0] == h[2] and h[1] == h[4] and h[0] != h[1]


def test_crafted_runs_do_not_collide():
    a, b = (" ".join(x) for x in crafted(11))
    words = substring_dedup.Words(pa.array([a, b, a]))
    n = np.full(3, 1 << 11)
    h = words.run_hashes(words.at[:-1], n)
    assert h[0] == h[2] != h[1]


def test_crafted_words_in_the_join_and_the_model(spark):
    a, b = crafted()
    docs = spark.createDataFrame([(1, a), (2, b), (3, a)], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.near_duplicates(docs).collect()}
    assert got == {1: 1, 2: 2, 3: 1}
    base = {r["doc_id"]: r["n_known"] for r in lm_scoring.score(docs).collect()}
    assert set(base) == {1, 2, 3}


ODD = "doc_id long, text string, lang string, source string, n_chars int, `row key` string, `mix copies` int, m map<string,int>, `a.b` int"


def odd_rows():
    rnd = random.Random(4)
    word = lambda: f"{rnd.choice('bcdfgh')}{rnd.choice('aeiou')}{rnd.randrange(90)}"
    rows = []
    for k in range(60):
        doc = [None, k, 7][k % 3 if k > 8 else 1]
        rows.append((doc, " ".join(word() for _ in range(20 + k)), "en", "ab"[k % 2], 1, "x", 2, {"k": k}, k))
    rows += [rows[12]] * 3 + [(None, None, None, None, None, None, None, None, None), (None, "", "en", "a", 0, "", 0, {}, 0)]
    return rows


def test_copies_keep_null_and_repeated_ids(spark):
    docs = spark.createDataFrame(odd_rows(), ODD).repartition(3)
    key = lambda r: (r["doc_id"], r["text"], r["source"])
    out = mixing.copies(docs)
    assert out.columns == docs.columns
    got = out.collect()
    taken = collections.Counter()
    for r in got:
        taken[r["source"]] += len((r["text"] or "").split())
    plan = collections.Counter()
    for r in mixing.mix(docs).collect():
        plan[r["source"]] += r["taken"]
    assert dict(taken) == {k: n for k, n in plan.items() if n}
    rows = collections.Counter(key(r) for r in docs.collect())
    most = collections.Counter(key(r) for r in got)
    assert all(n <= mixing.MOST * rows[k] for k, n in most.items())
    assert {r["doc_id"] for r in got} >= {None, 7}


@pytest.mark.parametrize("stage", [quality_rules.keep_good, exact_dedup.keep_texts, jaccard_join.keep_firsts, mixing.copies])
def test_stages_take_odd_columns_and_empty_tables(spark, stage):
    docs = spark.createDataFrame(odd_rows(), ODD)
    if stage is exact_dedup.keep_texts:  # rows that are equal in id and text are one document
        assert stage(docs).count() == len({(r[0], r[1] or "") for r in odd_rows()})
    else:
        out = stage(docs)
        assert out.columns == docs.columns and 0 < out.count() <= 3 * docs.count()
    assert stage(docs.limit(0)).count() == 0


def test_near_copies_with_null_ids(spark):
    text = " ".join(f"w{k}" for k in range(100))
    rows = [(None, text, "a"), (None, text + " x", "a"), (5, text, "b"), (6, "other words here altogether", "b"), (None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `Row Key` string")
    left = jaccard_join.keep_firsts(docs, percent=80, size=5).collect()
    assert sorted((r["doc_id"] or 0) for r in left) == [0, 5, 6]


def test_encoding_rows_that_share_an_id(spark, request):
    from lumendoc.llm.sentencepiece_codec import encode

    rows = [(1, "one two"), (1, "three"), (None, "one two"), (1, None), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = collections.Counter((r["doc_id"], len(r["ids"]), r["same"]) for r in encode(docs, same="same").collect())
    assert sum(got.values()) == 5 and all(k[2] for k in got) and got[(None, 1, True)] == 1 and got[(1, 1, True)] == 1


def test_mixing_tells_when_steps_do_not_suffice(spark):
    bins = spark.createDataFrame([("a", 5, 10), ("b", 7, 1000)], "source string, size long, n long")
    goals = mixing.targets(spark.createDataFrame([("a", 50), ("b", 7000)], "source string, source_size long"))
    assert mixing.newton_rates(bins, goals).count() == 2
    with pytest.raises(ArithmeticError, match="after 1 steps"):
        mixing.newton_rates(bins, goals, max_steps=1)
