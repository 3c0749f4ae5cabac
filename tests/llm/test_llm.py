"""Edge cases and brute-force comparisons of the llm operators on small rows."""

import collections
import hashlib
import math
import random
import re
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from lumendoc.llm import exact_dedup, jaccard_join, lm_scoring, mixing, quality_classifier, quality_rules, sentencepiece_codec

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rep string, digest int, label int, cluster int, mix_copies int, gone int"
WORDS = "the of and einer Straße été ñandú foo bar baz qux $$$ THE Of x1 , .".split()
RE_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def texts():
    rnd = random.Random(7)
    some = lambda n: " ".join(rnd.choice(WORDS) + str(rnd.randrange(400)) for _ in range(n))
    base = some(120)
    words = base.split()
    near = [" ".join(words[:k] + ["changed"] + words[k + 1 :]) for k in (5, 60, 61, 119)]
    far = [" ".join(w if i % 4 else "other" for i, w in enumerate(words))]
    return [
        None, "", " ", "\n\t ", "a", "one two", "One  TWO\n", "  lead", "trail  ", "a▁b 　 c\x00d", "line\nline\n\nline\nother", "the cat " * 30,
        "🙂 emoji é", "é", "x" * 3000, *[base] * 5, base.upper(), *near, *far, *(some(n) for n in (9, 10, 11, 12, 13, 40, 41, 400)), some(5000),
    ]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, [None, "en", "de", "fr"][k % 4], [None, "a", "b", "Z"][k % 4] if k % 3 else "a", None, "r", 1, 2, 3, 4, 5) for k, t in enumerate(texts())]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def plain_words(text):
    return RE_WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def against_sql(df, sql, docs):
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text", "lang", "source", "n_chars").toPandas())
    want = con.sql(sql)
    names = want.columns
    norm = lambda rows: sorted((tuple(round(x, 5) if isinstance(x, float) else x for x in r) for r in rows), key=str)
    assert sorted(names) == sorted(df.columns)
    assert norm(tuple(r) for r in df.select(*names).collect()) == norm(want.fetchall())


def test_sentencepiece_is_the_library(docs, empty):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.default_model())
    for entries in (300_000, 3):  # a table that is always full gives the same ids
        out = by_id(sentencepiece_codec.encode(docs, decoded="decoded", table_entries=entries))
        for k, t in enumerate(texts()):
            ids = sp.encode(t or "", add_eos=True)
            assert out[k]["ids"] == ids and out[k]["decoded"] == sp.decode(ids) and out[k]["rep"] == "r"
    enc = sentencepiece_codec.encode(docs, keep=["doc_id"])
    back = by_id(sentencepiece_codec.decode(enc))
    assert all(back[k]["decoded"] == sp.decode(sp.encode(t or "")) for k, t in enumerate(texts()))
    assert sentencepiece_codec.encode(empty, decoded="decoded").count() == 0


def test_exact_dedup(spark, docs, empty):
    index = exact_dedup.new_index(spark)
    out = index.add(docs)
    view = out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))
    against_sql(view, exact_dedup.DEDUP_SQL, docs)
    size = index.read().count()
    again = index.add(docs.withColumn("doc_id", F.col("doc_id") + 1000))  # all known
    assert again.where("kept").count() == 0 and index.read().count() == size
    fresh = index.add(docs.limit(1).withColumn("text", F.lit("never seen")))
    assert fresh.first()["kept"] and index.read().count() == size + 1
    assert index.add(empty).count() == 0
    nulls = exact_dedup.new_index(spark).add(docs.withColumn("doc_id", F.lit(None).cast("long")).where("text = 'a'"))
    assert nulls.first()["kept"] and nulls.first()["keep_id"] is None


def test_dedup_hot_text(spark):
    rows = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, F.lit("hot")).otherwise(F.concat(F.lit("t"), F.col("id"))).alias("text"))
    out = exact_dedup.new_index(spark).add(rows)
    assert out.count() == 4000 and out.where("kept").count() == 2001
    assert out.where("group_size = 2000 AND keep_id = 3998").count() == 2000


def test_quality_rules(docs, empty):
    out = quality_rules.judge(docs)
    against_sql(out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"), quality_rules.RULES_SQL, docs)
    got = by_id(out)
    for k, t in enumerate(texts()):
        w = RE_WORD.findall(t or "")
        seen = collections.defaultdict(list)
        for i in range(len(w) - 4):
            seen[tuple(w[i : i + 5])].append(i)
        places = {i + j for at in seen.values() if len(at) > 1 for i in at for j in range(5)}
        lines = [x for x in (t or "").split("\n") if RE_WORD.search(x)]
        assert (got[k]["n_words"], got[k]["n_repeat_words"], got[k]["n_dup_lines"]) == (len(w), len(places), len(lines) - len(set(lines)))
    assert quality_rules.judge(empty).count() == 0
    assert quality_rules.keep_good(docs).columns == docs.columns


def test_divergence_rejects_other_distributions(spark):
    rnd = random.Random(1)
    clean = [(k, " ".join(rnd.choice("the of and to house garden river stone".split()) + rnd.choice(["", "", ",", "."]) for _ in range(150)), "en") for k in range(40)]
    junk = [(100, " ".join(f"{rnd.choice('abcdef')}$$$### &&&" for _ in range(150)), "en"), (101, " ".join(str(rnd.randrange(10**6)) for _ in range(150)), None)]
    got = by_id(quality_rules.judge(spark.createDataFrame(clean + junk, "doc_id long, text string, lang string")))
    judged = {k: r["char_distance"] <= quality_rules.MAX_CHAR_DISTANCE for k, r in got.items()}
    assert all(judged[k] for k in range(40)) and not judged[100] and not judged[101]
    p = spark.range(1).select(quality_rules.js_distance(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(1.0))).alias("d")).first()["d"]
    assert abs(p - 1) < 1e-12


def test_every_language_has_a_reference(spark):
    """A clean document of a rare language, or of none, stays whatever else the table holds; the plans agree."""
    rnd = random.Random(3)
    say = lambda words: " ".join(rnd.choice(words.split()) for _ in range(150))
    english, german, other = "the of and to house garden river stone", "der die und den haus garten fluss stein", "kuca reka vrt kamen drvo most"
    rows = [(k, say(english), "en") for k in range(60)] + [(60 + k, say(german), "de") for k in range(3)] + [(70, say(other), "rare"), (71, say(german), None), (72, say(english), None)]
    rows += [(80, "$$$ 1234 " * 150, None), (81, None, None), (82, "", "empty")]
    data = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("source", F.lit("s")).withColumn("n_chars", F.length("text"))
    out = quality_rules.judge(data)
    against_sql(out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"), quality_rules.RULES_SQL, data)
    got = by_id(out)
    far = {k for k, r in got.items() if max(r["char_distance"], r["word_distance"]) > 0.3 and (r["n_words"] or 0) >= 100}
    assert len(got) == len(rows) and far == {80}
    other_plan = by_id(quality_rules.judge(data, few_bytes=0, block=1))
    assert other_plan == got
    nameless = quality_rules.judge(data.withColumn("lang", F.lit(None).cast("string")))
    assert nameless.where("char_distance IS NOT NULL").count() == 0 and nameless.where("kept = base_failed").count() == 0


def test_mixing(docs, empty):
    out = mixing.mix(docs)
    against_sql(out.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken"), mixing.MIX_SQL, docs)
    rows = out.collect()
    assert all(r["taken"] <= 3 * r["size"] and r["copies"] >= 0 for r in rows)
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, mixing.mix(docs).collect()), key=str)
    taken, largest = collections.Counter(), collections.Counter()
    for r in rows:
        taken[r["source"]] += r["taken"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    assert all(abs(taken[r["source"]] - r["target"]) <= largest[r["source"]] / 2 + 1 for r in rows)
    mixed = mixing.copies(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r["copies"] for r in rows)
    assert mixing.mix(empty).count() == 0


@pytest.mark.parametrize("sizes", [[100, 1, 1], [5, 5, 5, 5], [0, 10, 1000], [1], [0, 0], [7, 100, 3, 9, 2, 1000]])
def test_targets_by_the_rule(spark, sizes):
    names = [f"s{k}" for k in range(len(sizes))]
    got = {r["source"]: r["target"] for r in mixing.targets(spark.createDataFrame(list(zip(names, sizes)), "source string, source_size long")).collect()}
    weight, caps, total = [k % 3 + 1 for k in range(len(sizes))], [3 * s for s in sizes], sum(sizes)
    want, stopped = [0.0] * len(sizes), set()
    while True:
        free = [k for k in range(len(sizes)) if k not in stopped]
        left = total - sum(caps[k] for k in stopped)
        for k in free:
            want[k] = left * weight[k] / sum(weight[j] for j in free)
        over = {k for k in free if want[k] > caps[k]}
        if not over:
            break
        stopped |= over
        for k in over:
            want[k] = caps[k]
    assert all(math.isclose(got[n], w, rel_tol=1e-9, abs_tol=1e-9) for n, w in zip(names, want))


def test_lm_scoring(docs, empty):
    got = by_id(lm_scoring.score(docs, part_bytes=4000))
    cut = by_id(lm_scoring.score(docs, part_bytes=4000, slice_bytes=500, top=20))
    tokens = {k: [*plain_words(t), None] for k, t in enumerate(texts())}
    held = {k: zlib.crc32(str(k).encode()) % 10 == 0 for k in tokens}
    c = collections.Counter(w for k, ws in tokens.items() if not held[k] for w in ws)
    pairs = collections.Counter(p for k, ws in tokens.items() if not held[k] for p in zip([None, *ws], ws))
    n, v = sum(c.values()), len(c)
    single = lambda w: (c[w] + 0.1) / (n + 0.1 * (v + 1))
    once, twice = (sum(x == k for x in pairs.values()) for k in (1, 2))
    weight = 1 - once / (once + 2 * twice) * len(pairs) / n
    assert lm_scoring.LEAST_WEIGHT < weight < lm_scoring.MOST_WEIGHT
    off = []
    for k, ws in tokens.items():
        r = got[k]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[k], len(ws), sum(c[w] > 0 for w in ws), n)
        assert math.isclose(r["base_score"], sum(math.log10(single(w)) for w in ws), rel_tol=1e-9)
        assert math.isclose(cut[k]["base_score"], r["base_score"], rel_tol=1e-9) and math.isclose(cut[k]["score"], r["score"], rel_tol=1e-9)
        exact = sum(math.log10((1 - weight) * single(w) + weight * (pairs[a, w] / c[a] if c[a] else 0)) for a, w in zip([None, *ws], ws))
        off.append(abs(exact - r["score"]) / len(ws))
    assert sum(off) / len(off) < 0.1  # quantised counts and false positives, per token
    assert lm_scoring.score(empty).count() == 0


def test_lm_scoring_counts_pairs_seen_once(spark):
    ids = [k for k in range(200) if zlib.crc32(str(k).encode()) % 10]
    out = next(k for k in range(200) if not zlib.crc32(str(k).encode()) % 10)
    rows = [(k, f"a{k} b{k} c{k} d{k}") for k in ids]  # every pair stands once
    seen, turned = (" ".join(f"{x}{k}" for k in ids[:20] for x in order) for order in ("abcd", "dcba"))
    both = [lm_scoring.score(spark.createDataFrame([*rows, (out, t)], "doc_id long, text string")).where(f"doc_id = {out}").first() for t in (seen, turned)]
    n, v = 5 * len(ids), 4 * len(ids) + 1
    single = lambda c: (c + 0.1) / (n + 0.1 * (v + 1))
    p = lambda c, share: math.log10(0.9 * single(c) + 0.1 * share)
    want = p(1, 1 / len(ids)) + 60 * p(1, 1) + 19 * p(1, 0) + p(len(ids), 1)
    assert both[0]["base_score"] == pytest.approx(both[1]["base_score"])
    assert abs(both[0]["score"] - want) < 5 < both[0]["score"] - both[1]["score"]


def test_pair_weight_has_bounds():
    assert lm_scoring.pair_weight(0, 0, 0, 0) == lm_scoring.MOST_WEIGHT == lm_scoring.pair_weight(0, 5, 5, 10)
    assert lm_scoring.pair_weight(8, 0, 8, 8) == lm_scoring.LEAST_WEIGHT
    assert lm_scoring.pair_weight(6, 1, 10, 30) == pytest.approx(1 - 0.75 * 10 / 30)


def test_filter_reads_back_levels():
    import numpy as np

    h = lm_scoring.mix(np.arange(1, 5001, dtype=np.uint64))
    counts = np.arange(1, 5001) % 300 + 1
    f = lm_scoring.Filter(lm_scoring.make_bits(h, counts), np.array([len(lm_scoring.make_bits(h, counts))]), 0, 1)
    want = lm_scoring.LEVEL_COUNTS[lm_scoring.level_of(counts)]
    assert (f.counts(h) >= want).all() and (f.counts(h) == want).mean() > 0.9
    assert (f.counts(lm_scoring.mix(np.arange(10**6, 10**6 + 5000, dtype=np.uint64))) == 0).mean() > 0.9


def brute_components(sets, percent):
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if b < a and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: find(k) for k in sets}


def shingle_set(text, size=3):
    w = plain_words(text)
    return frozenset(zip(*(w[k:] for k in range(size)))) if len(w) >= size else frozenset([tuple(w)] if w else [])


@pytest.mark.parametrize("limits", [{}, {"cluster_sets": 2, "cluster_members": 300}])
def test_jaccard_join(docs, empty, limits):
    got = by_id(jaccard_join.near_duplicates(docs, **limits))
    sets = {k: shingle_set(t) for k, t in enumerate(texts())}
    want = brute_components(sets, 90)
    assert {k: (r["n_shingles"], r["component_id"]) for k, r in got.items()} == {k: (len(sets[k]), want[k]) for k in sets}
    assert jaccard_join.near_duplicates(empty).count() == 0
    kept = {r["doc_id"] for r in jaccard_join.keep_firsts(docs, **limits).select("doc_id").collect()}
    assert kept == {k for k in sets if want[k] == k}


@pytest.mark.parametrize("n_nodes", [3, 40, 5000])
def test_components(spark, n_nodes):
    from lumendoc.llm.components import connected_components

    rnd = random.Random(n_nodes)
    links = [(rnd.randrange(n_nodes), rnd.randrange(n_nodes)) for _ in range(n_nodes * 3 // 5)]
    links += [(10**6 + k, 10**6 + k + 1) for k in range(300)] + [(2 * 10**6 + rnd.randrange(500), 2 * 10**6) for _ in range(500)]  # a path and a hub
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    want = {x: find(x) for pair in links if pair[0] != pair[1] for x in pair}
    got = connected_components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r["node"]: r["component"] for r in got} == want and len(got) == len(want)


@pytest.mark.parametrize("percent", [70, 90])
def test_jaccard_join_finds_chains(spark, percent):
    rnd = random.Random(percent)
    rows = []
    for n in (11, 12, 13, 30, 60, 200):
        words = [f"w{rnd.randrange(10**6)}" for _ in range(n)]
        for _ in range(12):  # each a small change of the one before
            rows.append((len(rows), " ".join(words)))
            words = [*words]
            for _ in range(max(1, n // 60)):
                at = rnd.choice([0, len(words) - 1, rnd.randrange(len(words))])
                words[at] = f"w{rnd.randrange(10**6)}"
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_components({k: shingle_set(t) for k, t in rows}, percent)
    for limits in ({}, {"cluster_sets": 3}):
        got = {r["doc_id"]: r["component_id"] for r in jaccard_join.near_duplicates(df, percent=percent, **limits).collect()}
        assert got == want
    assert len(set(want.values())) < len(want)


def test_quality_classifier(spark, docs, empty):
    rnd = random.Random(5)
    rows, labels = [], []
    for k in range(600):
        bad = k % 5 == 0
        words = [rnd.choice(WORDS[:9]) + ("$$$" if bad and rnd.random() < 0.7 else "") for _ in range(rnd.randrange(20, 80))]
        rows.append((k, " ".join(words)))
        labels.append((k, 0 if bad else 1))
    lab = spark.createDataFrame([*labels, (3, None), (None, 1)], "doc_id long, quality int")
    data = spark.createDataFrame(rows, "doc_id long, text string")
    out = by_id(quality_classifier.score(data, *quality_classifier.fit(data, lab)))
    test = [k for k in out if out[k]["held_out"]]
    assert {k for k in out if zlib.crc32(str(k).encode()) % 5 == 0} == set(test)
    assert sum(out[k]["predicted"] == labels[k][1] for k in test) >= 0.95 * len(test)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in out.values())
    w, t = quality_classifier.fit(empty, lab)
    every = quality_classifier.score(docs, w, t).collect()
    assert len(every) == docs.count() and all(r["predicted"] == 1 for r in every)
    assert quality_classifier.score(empty, w, t).count() == 0


def test_pipeline_on_small_rows(spark, tmp_path, docs):
    import corpus_pipeline

    docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert all(r["ids"][-1] == 2 and r["n_tokens"] == len(r["ids"]) for r in out.collect())
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "exact_dedup", "jaccard_join", "mixing", "sentencepiece"]


def test_pipeline_drops_near_copies_by_the_rule(spark):
    import corpus_pipeline

    rnd = random.Random(3)
    rows = []
    for n in (30, 100, 300, 500):
        base = [f"w{rnd.randrange(10**6)}" for _ in range(n)]
        variants = [base, *([w if i % step else f"x{i}" for i, w in enumerate(base)] for step in (20, 45, 50, 60, 100)), *(base[: n * 100 // k] for k in (105, 115, 124, 130))]
        rows += [(len(rows) + k, " ".join(v), "en", "s", 1) for k, v in enumerate(variants)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    want = brute_components({r[0]: shingle_set(r[1], 5) for r in rows}, 80)
    kept = {r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()}
    assert kept == {k for k in want if want[k] == k}
    assert kept != {k for k, c in brute_components({r[0]: shingle_set(r[1]) for r in rows}, 90).items() if c == k}


def test_word_hash_is_of_the_bytes():
    import pyarrow as pa

    from lumendoc.llm import tokens

    h, at = tokens.word_hashes(pa.array(["Ab aB　", None, "ab"]))
    assert at.tolist() == [0, 2, 2, 3] and h[0] == h[2] and h[1] != h[0]
    assert hashlib.sha256(h.tobytes()).hexdigest() == hashlib.sha256(tokens.word_hashes(pa.array(["AB ab　 ab"]))[0].tobytes()).hexdigest()


def test_index_is_opened_again(spark, tmp_path):
    folder = f"file://{tmp_path}/index"
    docs = spark.range(40).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.col("id")).alias("text"))
    first = exact_dedup.DigestIndex(spark, folder, buckets=4)
    assert first.add(docs).where("kept").count() == 40
    first.close()
    again = exact_dedup.DigestIndex(spark.newSession(), folder)  # whatever its shuffle partitions are
    assert again.buckets == 4
    assert again.add(docs.withColumn("doc_id", F.col("doc_id") + 100)).where("kept").count() == 0 and again.read().count() == 40
    again.compact()
    assert again.read().count() == 40 and again.add(docs).where("kept").count() == 0  # known texts keep the rows that brought them
    with pytest.raises(ValueError):
        exact_dedup.DigestIndex(spark, folder, buckets=7)
    again.close()


def test_rows_under_one_id_are_kept_apart(spark, empty):
    import corpus_pipeline

    rows = [(1, "good"), (1, "dup"), (9, "dup"), (9, "dup"), (None, "dup"), (None, "alone"), (None, "alone"), (4, None), (5, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("*", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(1).cast("long").alias("n_chars"))
    left = corpus_pipeline.drop_copies(spark, docs, "").collect()
    assert sorted(((r["doc_id"], r["text"]) for r in left), key=str) == sorted([(1, "good"), (9, "dup"), (None, "alone"), (5, "")], key=str)
    words = [f"w{k}" for k in range(60)]
    rows = [(1, " ".join(words)), (1, "other words entirely"), (2, " ".join(words)), (None, " ".join(words[:-1])), (None, "a text without an id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("*", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(1).cast("long").alias("n_chars"))
    left = corpus_pipeline.drop_near_copies(spark, docs, "").collect()
    assert sorted(((r["doc_id"], len(r["text"])) for r in left), key=str) == sorted([(1, 20), (2, len(" ".join(words))), (None, 20)], key=str)
    assert corpus_pipeline.drop_bad(spark, docs, "").columns == docs.columns
    for stage in (corpus_pipeline.drop_bad, corpus_pipeline.drop_copies, corpus_pipeline.drop_near_copies):
        assert stage(spark, empty, "").count() == 0
