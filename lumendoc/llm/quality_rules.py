"""Quality rules: counting rules, then divergence from language references.

Base rules count words, symbols, repeated lines and repeated 5-word windows.
The method then compares two histograms of a document with its language's
reference by the Jensen-Shannon distance (base 2, 0 to 1): character classes,
and common words.  References are the pooled counts of all documents of a
language, taken over the whole table, for every language however rare.  Their
table is broadcast up to ``FEW_BYTES``, beyond that joined by sort-merge (which
adaptive execution splits where one language has most rows).  A document
without a language is held against the nearest reference of each histogram,
``BLOCK`` references a pass.  A document is judged only from ``MIN_CHARS``
characters (character classes) or ``MIN_WORDS`` words (common words) on.

Everything is built-in functions.  Windows are counted inside the row: the
words' hashes (64 bits) make window hashes; only a document that has a repeated
one sorts them to find the places.  No row leaves its partition but for the
references' sums.

Cases: null text has no words and fails the base rule, as an empty one does;
null ``lang`` is held against the nearest reference, and where the table names
no language at all, by the base rules alone; an empty table gives an empty result;
ties and repeated rows are judged alike; columns beside ``doc_id``, ``text``
and ``lang`` are ignored.
"""

from __future__ import annotations

from functools import reduce
from itertools import batched

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, WORD, drop_keyed, keyed, let, materialize, table

MIN_CHARS, MIN_WORDS = 200, 100
#: Distances above these fail.
MAX_CHAR_DISTANCE, MAX_WORD_DISTANCE = 0.3, 0.3
#: References (some 300 bytes each and the language's name) that are broadcast, and those a pass compares.
FEW_BYTES, BLOCK = 32 << 20, 64
#: Frequent short words of English, German, French and Spanish.
COMMON_WORDS = (
    "the", "of", "and", "to", "in", "is", "that", "for", "der", "die", "und", "den", "von", "zu", "das",
    "de", "la", "le", "et", "les", "des", "en", "un", "que", "el", "y", "los", "se",
)
#: Character classes as regular expressions of single characters; what is in none counts as other.
CLASSES = {"lower": r"\p{Ll}", "upper": r"\p{Lu}", "digit": "0-9", "stop": r".,;:?'\"()-", "loud": "!", "symbol": "#*$%&|<>"}


def _kept(text: Column, chars: str) -> Column:
    """How many characters of ``text`` are in a class."""
    return F.char_length(F.regexp_replace(text, f"[^{chars}]+", "")).cast("long")


def repeated_words(words: Column) -> Column:
    """How many words stand in 5-word windows that occur twice or more in the array."""

    def windows(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(h) - 5), lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(5))))

    def places(win: Column) -> Column:
        order = F.sort_array(F.transform(win, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
        return let(
            order,
            lambda s: F.size(
                F.array_distinct(
                    F.flatten(
                        F.transform(
                            F.filter(s, lambda e, k: (F.coalesce(F.get(s, k - 1)["x"] == e["x"], F.lit(False))) | (F.coalesce(F.get(s, k + 1)["x"] == e["x"], F.lit(False)))),
                            lambda e: F.sequence(e["i"], e["i"] + 4),
                        )
                    )
                )
            ),
        )

    counted = let(
        F.transform(words, lambda w: F.xxhash64(w)),
        lambda h: let(windows(h), lambda win: F.when(F.size(F.array_distinct(win)) == F.size(win), F.lit(0)).otherwise(places(win))),
    )
    return F.when(F.size(words) < 6, F.lit(0)).otherwise(counted).cast("long")


def duplicate_lines(text: Column) -> Column:
    """Lines with a word that are equal to an earlier one."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    return let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


def features(docs: DataFrame) -> DataFrame:
    """doc_id, lang, the base columns, and the counts ``chars`` and ``words`` of both histograms."""
    t = F.coalesce(F.col("text"), F.lit(""))
    found = let(F.regexp_extract_all(t, F.lit(WORD), F.lit(0)), lambda w: F.struct(F.size(w).cast("long").alias("n"), repeated_words(w).alias("r")))
    plain = F.concat(F.lit(" "), F.regexp_replace(F.lower(t), r"\P{L}+", "  "), F.lit(" "))
    base = docs.select(
        F.col("doc_id"),
        F.col("lang").cast("string").alias("lang"),
        found.alias("found"),
        F.char_length(F.regexp_replace(t, SPACE, "")).cast("long").alias("word_chars"),
        duplicate_lines(t).alias("n_dup_lines"),
        *(_kept(t, c).alias(f"c_{k}") for k, c in CLASSES.items()),
        let(
            plain,
            lambda p: F.array(
                *(((F.octet_length(p) - F.octet_length(F.replace(p, F.lit(f" {w} "), F.lit("")))) / (len(w) + 2)).cast("long") for w in COMMON_WORDS),
                # letters' runs in all: one pair of spaces stands between two
                (F.regexp_count(p, F.lit(r"\p{L}+"))).cast("long"),
            ),
        ).alias("words"),
    )
    known = reduce(lambda a, b: a + b, (F.col(f"c_{k}") for k in CLASSES))
    base = base.select(
        "doc_id", "lang", F.col("found.n").alias("n_words"), "word_chars", F.col("c_symbol").alias("n_symbols"), "n_dup_lines", F.col("found.r").alias("n_repeat_words"),
        F.array(*(F.col(f"c_{k}") for k in CLASSES), F.greatest(F.col("word_chars") - known, F.lit(0))).alias("chars"), "words",
    )
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return base.withColumn("base_failed", failed)


def _sum(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)


def shares(counts: Column) -> Column:
    """Of an array of counts, the share of each."""
    return let(counts, lambda c: let(F.greatest(_sum(c), F.lit(1.0)), lambda n: F.transform(c, lambda x: x / n)))


def with_rest(counts: Column, n: int) -> Column:
    """``n`` counts and a total become ``n`` counts and the rest of the total."""
    return let(counts, lambda c: F.concat(F.slice(c, 1, n), F.array(F.greatest(F.lit(0), F.get(c, F.lit(n)) - _sum(F.slice(c, 1, n)).cast("long")))))


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two distributions (arrays of equal length)."""
    half = lambda a, m: F.when(a > 0, a * F.log2(a / m)).otherwise(0.0)
    return F.sqrt(F.greatest(_sum(F.zip_with(p, q, lambda a, b: half(a, (a + b) / 2) + half(b, (a + b) / 2))) / 2, F.lit(0.0)))


def references(found: DataFrame) -> DataFrame:
    """Pooled histograms of every language, over the whole table."""
    n_c, n_w = len(CLASSES) + 1, len(COMMON_WORDS) + 1
    sums = lambda name, n: F.array(*(F.sum(F.col(name)[k]) for k in range(n))).alias(f"ref_{name}")
    return found.where(F.col("lang").isNotNull()).groupBy("lang").agg(sums("chars", n_c), sums("words", n_w))


def _distances(chars: Column, words: Column) -> tuple[Column, Column]:
    """A document's distances from a reference's two histograms."""
    n_w = len(COMMON_WORDS)
    return (
        js_distance(shares(F.col("chars")), shares(chars)),
        js_distance(shares(with_rest(F.col("words"), n_w)), shares(with_rest(words, n_w))),
    )


def _nearest(found: DataFrame, refs: DataFrame, block: int) -> DataFrame:
    """``found`` with the least of each distance over all references (null: there are none)."""
    out = found.withColumn("char_distance", F.lit(None).cast("double")).withColumn("word_distance", F.lit(None).cast("double"))
    for turn, rows in enumerate(batched(refs.toLocalIterator(), block)):
        if turn:
            out = materialize(out, "quality-nearest")
        each = F.lit([[list(r["ref_chars"]), list(r["ref_words"])] for r in rows])
        chars = F.array_min(F.transform(each, lambda q: _distances(q[0], q[1])[0]))
        words = F.array_min(F.transform(each, lambda q: _distances(q[0], q[1])[1]))
        out = out.withColumn("char_distance", F.least("char_distance", chars)).withColumn("word_distance", F.least("word_distance", words))
    return out


def judge(docs: DataFrame, *, few_bytes: int = FEW_BYTES, block: int = BLOCK) -> DataFrame:
    """Base columns, both distances and ``kept`` of every document."""
    found = materialize(features(docs), "quality-features")
    refs = materialize(references(found), "quality-references")
    n_bytes = refs.agg(F.sum(F.octet_length("lang") + 300)).first()[0] or 0
    refs_at = F.broadcast(refs) if n_bytes <= few_bytes else refs.hint("merge")
    char_distance, word_distance = _distances(F.col("ref_chars"), F.col("ref_words"))
    named = found.where(F.col("lang").isNotNull()).join(refs_at, "lang").withColumn("char_distance", char_distance).withColumn("word_distance", word_distance)
    columns = [*(c for c in found.columns if c not in ("chars", "words")), "char_distance", "word_distance"]
    out = named.select(*columns).unionByName(_nearest(found.where(F.col("lang").isNull()), refs, block).select(*columns))
    failed = ((F.col("word_chars") >= MIN_CHARS) & (F.col("char_distance") > MAX_CHAR_DISTANCE)) | ((F.col("n_words") >= MIN_WORDS) & (F.col("word_distance") > MAX_WORD_DISTANCE))
    return out.withColumn("kept", ~F.col("base_failed") & ~F.coalesce(failed, F.lit(False)))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows that ``judge`` keeps, each judged by itself, also where a doc_id is null or repeats."""
    known, key = keyed(docs)
    return drop_keyed(known, key, judge(known.withColumn("doc_id", F.col(key))).where(~F.col("kept")).select("doc_id"))


def rules_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _sql() -> str:
    """The same in DuckDB's SQL."""
    keys = list(CLASSES)
    cls = ",\n".join(f"length(regexp_replace(t, '[^{c.replace(chr(39), chr(39) * 2)}]+', '', 'g')) AS c{k}" for k, c in enumerate(CLASSES.values()))
    n_c, n_w = len(keys) + 1, len(COMMON_WORDS)
    count = ",\n".join(f"length(p) - length(replace(p, ' {w} ', '')) AS l{k}" for k, w in enumerate(COMMON_WORDS))
    known = " + ".join(f"c{k}" for k in range(len(keys)))
    cols = [f"c{k}" for k in range(n_c)] + [f"w{k}" for k in range(n_w + 1)]
    sums = ", ".join(f"sum({c}) AS {c}" for c in cols)
    pick = ", ".join(f"o.{c} AS r{c}" for c in cols)

    def js(p: list[str], q: list[str]) -> str:
        half = "CASE WHEN {0} > 0 THEN {0} * log2({0} / (({0} + {1}) / 2)) ELSE 0 END"
        return "sqrt(greatest((" + " + ".join(f"{half.format(a, b)} + {half.format(b, a)}" for a, b in zip(p, q)) + ") / 2, 0))"

    def shares(pre: str) -> tuple[str, list[str], list[str]]:
        tot = " + ".join(f"{pre}c{k}" for k in range(n_c))
        rest = f"{pre}w{n_w} - (" + " + ".join(f"{pre}w{k}" for k in range(n_w)) + ")"
        sel = [f"{pre}c{k}::double / greatest({tot}, 1) AS {pre}sc{k}" for k in range(n_c)]
        sel += [f"{pre}w{k}::double / greatest({pre}w{n_w}, 1) AS {pre}sw{k}" for k in range(n_w)] + [f"greatest({rest}, 0)::double / greatest({pre}w{n_w}, 1) AS {pre}sw{n_w}"]
        return ", ".join(sel), [f"{pre}sc{k}" for k in range(n_c)], [f"{pre}sw{k}" for k in range(n_w + 1)]

    (ds, dc, dw), (rs, rc, rw) = shares(""), shares("r")
    return rf"""
WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS t FROM documents),
wd AS (SELECT doc_id, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d),
win AS (SELECT doc_id, i, w[i:i+4] AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM wd WHERE len(w) >= 5)),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS r FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, x) AS n FROM win), range(0, 5) o(k) WHERE n > 1 GROUP BY doc_id),
li AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
f0 AS (SELECT doc_id, lang, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars, {cls},
       ' ' || regexp_replace(lower(t), '\P{{L}}+', '  ', 'g') || ' ' AS p FROM d),
f1 AS (SELECT *, {count}, len(regexp_extract_all(p, '\p{{L}}+')) AS w{n_w} FROM f0),
f AS (SELECT * EXCLUDE (p), greatest(word_chars - ({known}), 0) AS c{n_c - 1}, {", ".join(f"l{k} // {len(w) + 2} AS w{k}" for k, w in enumerate(COMMON_WORDS))} FROM f1),
o AS (SELECT lang, {sums} FROM f WHERE lang IS NOT NULL GROUP BY lang),
j AS (SELECT f.*, {pick} FROM f JOIN o ON f.lang = o.lang OR f.lang IS NULL),
s AS (SELECT doc_id, {ds}, {rs} FROM j),
v AS (SELECT doc_id, min({js(dc, rc)}) AS cd, min({js(dw, rw)}) AS wdist FROM s GROUP BY doc_id),
b AS (SELECT wd.doc_id, len(w) AS n_words, coalesce(r, 0) AS n_repeat_words, len(l) - len(list_distinct(l)) AS n_dup_lines
      FROM wd LEFT JOIN rep USING (doc_id) JOIN li USING (doc_id)),
z AS (SELECT b.doc_id, n_words, f.word_chars, f.c{keys.index("symbol")} AS n_symbols, n_dup_lines, n_repeat_words,
       n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, cd, wdist FROM b JOIN f USING (doc_id) LEFT JOIN v USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT coalesce((word_chars >= {MIN_CHARS} AND cd > {MAX_CHAR_DISTANCE}) OR (n_words >= {MIN_WORDS} AND wdist > {MAX_WORD_DISTANCE}), false) AS kept
FROM z
"""


RULES_SQL = _sql()
