"""Substring dedup, WARC fixity and token counts against brute force."""

import collections
import gzip
import random

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lumendoc.llm import substring_dedup, token_counts, warc_fixity
from tests.llm.test_llm import SCHEMA, plain_words, shingle_set, texts


@pytest.fixture(scope="module")
def docs(spark):
    rnd = random.Random(11)
    word = lambda: f"w{rnd.randrange(3000)}"
    passage = [word() for _ in range(60)]
    rows = [(k, t) for k, t in enumerate(texts())]
    for k in range(30):
        lines = [" ".join(word() for _ in range(rnd.choice([5, 19, 20, 40]))) for _ in range(3)]
        if k % 3 == 0:
            p = list(passage)
            for _ in range(k // 10):
                p[rnd.randrange(60)] = word()
            lines.insert(rnd.randrange(4), " ".join(p))
        rows.append((1000 + k, "\n".join(lines)))
    rows += [(2000, "\n".join([" ".join(passage)] * 3)), (2001, None), (2002, "x" * 200_000)]
    return spark.createDataFrame([(k, t, "en", "s", 1, "r", 1, 2, 3, 4, 5) for k, t in rows], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def paragraphs_of(text, block=substring_dedup.BLOCK, passage=substring_dedup.PASSAGE):
    """(start, words) of a text's paragraphs: lines by plain splitting, blocks as the module places them."""
    out, at = set(), 0
    for line in (text or "").split("\n"):
        n = len(plain_words(line))
        if n >= substring_dedup.MIN_WORDS:
            out.add((at, n))
        at += n
    blocks = substring_dedup.Words(pa.array([text or ""])).blocks(block, passage)
    return out | {(int(b), block) for b in blocks}


def test_every_run_of_a_passage_holds_the_same_block():
    rnd = random.Random(8)
    shared = [f"s{k}" for k in range(400)]
    at = collections.defaultdict(set)
    for k in range(60):
        a = rnd.randrange(300)
        run = shared[a : a + rnd.randrange(50, 100)]
        words = [f"x{rnd.randrange(10**6)}" for _ in range(rnd.randrange(80))] + run + [f"y{rnd.randrange(10**6)}" for _ in range(rnd.randrange(80))]
        blocks = {s for s, n in paragraphs_of("".join(w + rnd.choice([" ", " ", "\n"]) for w in words)) if n == substring_dedup.BLOCK}
        for i in range(len(words) - 49):
            held = frozenset(b - i for b in blocks if i <= b <= i + 50 - substring_dedup.BLOCK)
            assert held
            at[tuple(words[i : i + 50])].add(held)
    assert all(frozenset.intersection(*x) for x in at.values())
    # the same words give the same blocks, whatever texts stand beside them in the batch
    text = " ".join(shared)
    alone = substring_dedup.Words(pa.array([text])).blocks(20, 50).tolist()
    beside = substring_dedup.Words(pa.array(["a b " * 40, text, None, "c " * 30]))
    assert [int(b - beside.at[1]) for b in beside.blocks(20, 50) if beside.text[b] == 1] == alone


@pytest.mark.parametrize("limits", [{}, {"cluster_sets": 3}])
def test_substring_dedup(docs, empty, limits):
    rows = substring_dedup.repeated(docs, recall=0.99999, most_bands=60, block_bands=60, **limits).collect()
    got = {(r["doc_id"], r["start"], r["n_words"]): r for r in rows}
    paras = {}
    for r in docs.select("doc_id", "text").collect():
        words = plain_words(r["text"])
        for start, n in paragraphs_of(r["text"]):
            w = words[start : start + n]
            paras[r["doc_id"], start, n] = frozenset(zip(*(w[k:] for k in range(5))))
    root = {k: k for k in paras}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in paras:
        for b in paras:
            if b < a and 100 * len(paras[a] & paras[b]) >= 80 * len(paras[a] | paras[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    sizes = collections.Counter(find(k) for k in paras)
    apart = lambda k, first: k[0] != first[0] or k[1] >= first[1] + first[2]
    real = {find(k) for k in paras if apart(k, find(k))}
    want = {k: find(k)[:2] for k in paras if find(k) in real}
    assert {k: (r["keep_doc_id"], r["keep_start"]) for k, r in got.items()} == want
    assert all(r["removed"] == apart(k, find(k)) and r["copies"] == sizes[find(k)] for k, r in got.items())
    assert {1000, 1003, 2000} <= {k[0] for k in got} and not {1001, 2002} & {k[0] for k in got}
    left = substring_dedup.removals(docs, **limits)
    assert left.where("doc_id = 2000").first()["text"] == ""
    assert left.count() == docs.count() and set(docs.columns) < set(left.columns)
    assert substring_dedup.repeated(empty).count() == 0


def test_passages_inside_lines(spark, tmp_path):
    rnd = random.Random(2)
    some = lambda n: [f"w{rnd.randrange(10**6)}" for _ in range(n)]
    runs = [some(n) for n in (20, 50, 54, 75, 200)]
    rows, held = [], collections.defaultdict(list)
    for k in range(24):
        words = some(rnd.randrange(150))
        for j in rnd.sample(range(5), 2) + ([3] if k % 5 == 0 else []):
            held[k].append((len(words), len(runs[j]), j))
            words += [x.upper() if k % 2 else x for x in runs[j]] + some(1 + rnd.randrange(150))
        rows.append((k, "".join(w + rnd.choice([" "] * 40 + ["\n"]) for w in words)))
    rows += [(100, None), (101, ""), (None, rows[0][1]), (102, " ".join(some(300)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = collections.defaultdict(list)
    for r in substring_dedup.repeats_query(spark, str(tmp_path)).collect():
        got[r["doc_id"]].append((r["start"], r["start"] + r["n_words"]))
        assert r["removed"] or r["doc_id"] == r["keep_doc_id"]
    for k, mine in held.items():
        for start, n, j in mine:
            if n >= 50 and sum(j == x for other in held.values() for *_, x in other) > 1:
                assert any(start <= a and b <= start + n for a, b in got[k]), (k, start, n)
        shared = {i for start, n, _ in mine for i in range(start, start + n)}
        for a, b in got[k]:  # a line that is nearly all of a shared run may have other words at its ends
            assert len(shared & set(range(a, b))) >= 0.8 * (b - a), (k, a, b)
    assert not {100, 101, 102, None} & set(got)
    assert substring_dedup.passages(docs.limit(0)).count() == 0
    cut = {r["doc_id"]: r for r in substring_dedup.removals(docs).collect() if r["doc_id"] is not None}
    for k, t in rows[:24]:
        gone = len(plain_words(t)) - len(plain_words(cut[k]["text"]))
        assert gone == cut[k]["n_removed"] and set(plain_words(cut[k]["text"])) <= set(plain_words(t))
    assert cut[102]["text"] == rows[-1][1] and sum(r["n_removed"] for r in cut.values()) > 300


def test_substring_dedup_of_repeated_ids(spark):
    rnd = random.Random(9)
    line = lambda: " ".join(f"w{rnd.randrange(10**6)}" for _ in range(30))
    a, b, c = line(), line(), line()
    rows = [(1, a), (1, b), (2, f"{c}\n{b}"), (3, c), (3, c)]
    got = {(r["doc_id"], r["start"], r["n_words"], r["keep_doc_id"], r["keep_start"], r["removed"]) for r in substring_dedup.repeated(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r["n_words"] == 30}
    assert got == {(1, 0, 30, 1, 0, False), (2, 30, 30, 1, 0, True), (2, 0, 30, 2, 0, False), (3, 0, 30, 2, 0, True)}


def test_bands_are_tuned():
    for t in (0.5, 0.8, 0.9):
        bands, rows = substring_dedup.tune(t)
        assert 1 - (1 - t**rows) ** bands >= substring_dedup.RECALL and bands <= substring_dedup.MOST_BANDS


def archive(spark, rows):
    return warc_fixity.lay_out(warc_fixity.seal(spark.createDataFrame(rows, "record_id long, url string, html string").select("record_id", warc_fixity.record_bytes(F.col("record_id"), F.col("url"), F.col("html")).alias("bytes"))), per_file=50)


def test_fixity(spark):
    rows = [(k, f"http://h{k % 3}/é" if k % 7 else None, "ü<b>" * (k * 37 % 900) if k % 11 else None) for k in range(400)]
    base = archive(spark, rows).cache()
    assert warc_fixity.audit(base, base).count() == 0
    hurt = base.where("record_id NOT IN (3, 399) AND file <> 5").withColumn("leaf", F.when(F.col("record_id").isin(10, 60, 61), F.lit("00")).otherwise(F.col("leaf")))
    hurt = hurt.unionByName(base.where("record_id = 20").withColumn("record_id", F.lit(-1).cast("long")).withColumn("offset", F.col("offset") + 3))
    got = {(r["record_id"], r["status"]) for r in warc_fixity.audit(base, hurt).collect()}
    want = {(3, "missing"), (399, "missing"), (10, "corrupt"), (60, "corrupt"), (61, "corrupt"), (-1, "extra")} | {(k, "missing") for k in range(250, 300)}
    assert got == want
    none = base.limit(0)
    assert warc_fixity.audit(none, none).count() == 0 and warc_fixity.audit(none, base).where("status = 'extra'").count() == 400


def test_descent_reads_only_bad_branches(spark):
    rows = [(k, "u", "x" * 30_000) for k in range(200)]
    base = warc_fixity.lay_out(archive(spark, rows).drop("file", "offset"), per_file=1000)
    n = warc_fixity.levels_of(base.agg(F.max("offset")).first()[0])
    levels = warc_fixity.build(base, n)
    assert levels[-1].count() == 1 and levels[0].count() > warc_fixity.FANOUT


def test_warc_files(spark, tmp_path):
    parts = [spark.range(1).select(warc_fixity.record_bytes(F.lit(k), F.lit("u"), F.lit(f"p{k}\r\n\r\n" * k)).alias("b")).first()["b"] for k in range(5)]
    (tmp_path / "a.warc").write_bytes(b"".join(parts))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(gzip.compress(p) for p in parts))
    got = warc_fixity.read_files(spark, str(tmp_path)).collect()
    for name in ("a.warc", "b.warc.gz"):
        mine = sorted((r for r in got if r["file"] == name), key=lambda r: r["offset"])
        assert [bytes(r["bytes"]) for r in mine] == [bytes(p) for p in parts] and [r["record_id"] for r in mine] == list(range(5))
        assert [r["offset"] for r in mine] == [sum(r["length"] for r in mine[:k]) for k in range(5)]
    one = warc_fixity.leaves(warc_fixity.read_files(spark, f"{tmp_path}/a.warc"))
    assert warc_fixity.audit(one, one).count() == 0


def test_fixity_sql(spark, tmp_path):
    rows = [(k, f"http://é{k}", "ß" * (k % 50)) for k in range(1200)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = con.sql(warc_fixity.FIXITY_SQL)
    got = warc_fixity.fixity_query(spark, str(tmp_path)).select(*want.columns).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want.fetchall())) and len(got) > 10


def brute_counts(text, sections, rule):
    encoding, lens = token_counts._encoding(open(token_counts.default_ranks(), "rb").read(), token_counts.default_pattern())
    owner = []
    for i, ch in enumerate(text):
        k = next((k for k, (a, b) in enumerate(sections) if a <= i < b), -1)
        owner += [k] * len(ch.encode())
    out, over, at = collections.Counter(), collections.Counter(), 0
    ids = encoding.encode_ordinary(text)
    for i in ids:
        mine = owner[at : at + lens[i]]
        at += lens[i]
        if rule == "most":
            n = collections.Counter(mine)
            best = max((v for k, v in n.items() if k >= 0), default=0)
            k = -1 if not best or n[-1] > best else min(k for k, v in n.items() if k >= 0 and v == best)
        else:
            k = mine[0] if rule == "first" else mine[-1]
        out[k] += 1
        over[k] += len(set(mine)) > 1
    return len(ids), out, over


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_token_counts(spark, docs, empty, rule):
    got = collections.defaultdict(dict)
    for r in token_counts.by_section(token_counts.attribute(docs, rule=rule)).collect():
        got[r["doc_id"]][r["section"]] = r
    for r in docs.select("doc_id", "text").where("length(text) < 30000 OR text IS NULL").collect():
        text, bounds = r["text"] or "", [0]
        bounds += [i + 1 for i, c in enumerate(text) if c == "\n"] + [len(text)]
        n, out, over = brute_counts(text, list(zip(bounds, bounds[1:])), rule)
        mine = got[r["doc_id"]]
        assert len(mine) == len(bounds) - 1 and all(x["doc_tokens"] == n for x in mine.values())
        assert {k: (x["start"], x["end"], x["n_tokens"], x["n_crossing"]) for k, x in mine.items()} == {k: (bounds[k], bounds[k + 1], out[k], over[k]) for k in range(len(bounds) - 1)}
    assert token_counts.attribute(empty).count() == 0


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_token_counts_of_given_sections(spark, rule):
    rnd = random.Random(4)
    rows = []
    for k, t in enumerate(x for x in texts() if x and len(x) < 3000):
        cuts = sorted(rnd.sample(range(len(t) + 1), min(len(t) + 1, rnd.choice([0, 2, 4, 8]))))
        rows.append((k, t, [(a, b) for a, b in zip(cuts[::2], cuts[1::2])]))
    rows.append((999, "some words", None))
    df = spark.createDataFrame(rows, "doc_id long, text string, parts array<struct<start:int,end:int>>")
    got = collections.defaultdict(dict)
    for r in token_counts.by_section(token_counts.attribute(df, sections="parts", rule=rule)).collect():
        got[r["doc_id"]][r["section"]] = (r["n_tokens"], r["n_crossing"])
    for k, t, parts in rows:
        n, out, over = brute_counts(t, parts or [], rule)
        want = {j: (out[j], over[j]) for j in range(len(parts or []))} | ({-1: (out[-1], over[-1])} if out[-1] else {})
        assert got[k] == want


def warc(body=b"x", ident="urn:uuid:1f8b08aa-0000", length=None):
    return b"WARC/1.0\r\nWARC-Record-ID: <" + ident.encode() + b">\r\nContent-Length: " + (str(len(body)) if length is None else length).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def test_damaged_warc_files():
    good = warc(b"one\r\n\r\nWARC is a word")
    for data in (good, gzip.compress(good)):
        ((at, used, raw, damage),) = warc_fixity.parse(data)
        assert (at, used, raw, damage) == (0, len(data), good, None)
    cases = {
        "no header": b"HTTP/1.1 200\r\n\r\njunk", "bad length": warc(length="12x"), "cut": warc(b"abc", length="99999"),
        "bad gzip": gzip.compress(good)[:12] + b"\xff" * 20 + gzip.compress(good)[32:],
    }
    for damage, bad in cases.items():
        for before in (b"", good, gzip.compress(good)):
            rows = list(warc_fixity.parse(before + bad))
            assert rows[-1][3] == damage and sum(r[1] for r in rows) == len(before + bad)
            assert [r[0] for r in rows] == [sum(r[1] for r in rows[:k]) for k in range(len(rows))]
            assert [r[3] for r in rows][: bool(before)] == [None] * bool(before)
            if damage != "cut":  # what follows is read again
                after = list(warc_fixity.parse(before + bad + good))
                assert after[-1][1:] == (len(good), good, None)
    assert list(warc_fixity.parse(b"")) == []
    assert [r[3] for r in warc_fixity.parse(gzip.compress(good)[:-9])] == ["cut"]
    assert [r[3] for r in warc_fixity.parse(b"WARC/1.0\r\nno end")] == ["cut"]
    big = gzip.compress(warc(random.Random(1).randbytes(300_000)), 1) * 3
    assert [r[3] for r in warc_fixity.parse(big)] == [None] * 3


def test_damaged_files_as_rows(spark, tmp_path):
    (tmp_path / "a.warc").write_bytes(warc() + b"junk" + warc(ident="urn:record:17") + warc(ident="urn:uuid:b", length="z"))
    got = warc_fixity.read_files(spark, str(tmp_path)).orderBy("offset").collect()
    assert [(r["record_id"], r["warc_id"], r["damage"]) for r in got] == [(None, "urn:uuid:1f8b08aa-0000", None), (None, None, "no header"), (17, "urn:record:17", None), (None, None, "bad length")]
    own = warc_fixity.leaves(warc_fixity.read_files(spark, str(tmp_path)), "warc_id")
    assert warc_fixity.audit(own, own.where("record_id IS NULL OR record_id <> 'urn:record:17'")).collect()[0]["record_id"] == "urn:record:17"


def test_records_without_ids_are_spread(spark):
    df = spark.range(3000).select(F.lit(None).cast("long").alias("record_id"), F.col("id").cast("string").cast("binary").alias("bytes"))
    laid = warc_fixity.lay_out(warc_fixity.seal(df))
    assert laid.select("file").distinct().count() > 500 and laid.where("file >= 0").count() == 0
    assert warc_fixity.audit(laid, laid).count() == 0
