"""Quality rules with adaptive thresholds, in DataFrame functions only.

Each document gets a few measures from its whole text. For every (language, source) the distribution of each
adaptive measure is kept as a mergeable quantile sketch: counts of integer buckets of equal relative width, which
are exact sums, so that partial sketches merge in any order to the same result. Thresholds are read from the sketch
of a document's own (language, source); where that has fewer than ``LEAST_DOCS`` documents, from the merged sketch of
its language, and else from that of all. They replace fixed cutoffs; a join brings them back to the documents.

A quartile is the least value of the sketch's first bucket up to which a quarter of the documents lie: it is within 1/32 of the
exact one, and equal values never part. Very long texts are measured whole, each by one task.

Defined results: a null text has no words; null languages and sources form groups of their own; rows with equal or
null ids each get a row; a measure that equals its fence passes; an empty table gives no rows; other columns of the input are
kept by ``rejected`` and ``passing``, whatever their names, and dropped by ``measure``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vecspark.llm.common import SPACE, spread, stored

#: Fewer documents than this don't make a sketch that is used by itself.
LEAST_DOCS = 50
#: Upper fence: the third quartile and so many interquartile ranges.
FENCE = 6
#: What a text of about a hundred words can resolve of each measure: some symbols, one line in thirty, a repeated window, some
#: capitals, half a character a word. A group's range is this at least, as a single event isn't to decide.
LEAST_RANGE = {"symbols": 5, "dup_lines": 30, "repeats": 25, "upper": 10, "word_length": 500}
#: Thresholds up to so many rows (under 100 bytes each) are broadcast; more are joined by key, in salted parts.
BROADCAST_ROWS = 100_000
SALTS = 16
SYMBOLS = "#*$%&|<>"

#: Adaptive measures, each in thousandths, as SQL on the measured columns. A document is rejected above a fence.
MEASURES = {
    "symbols": "1000 * n_symbols div greatest(word_chars, 1)",
    "dup_lines": "1000 * n_dup_lines div greatest(n_lines, 1)",
    "repeats": "1000 * n_repeat_words div greatest(n_words, 1)",
    "upper": "1000 * n_upper div greatest(word_chars, 1)",
    "word_length": "1000 * word_chars div greatest(n_words, 1)",
}

LEAST = "CASE name " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in LEAST_RANGE.items()) + " END"


def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated once."""
    return F.transform(F.array(value), use)[0]


def repeated_words(words: Column) -> Column:
    """Words in 5-word windows that are found twice or more in ``words``, first ones included.

    Windows are compared by hash first: equal windows have equal hashes, so distinct hashes prove that there is no
    repeat, which settles most texts. The others sort their windows, as strings, with their places.
    """

    def places(w: Column) -> Column:
        found = F.sort_array(F.transform(F.sequence(F.lit(1), F.size(w) - 4), lambda i: F.struct(F.concat_ws(" ", F.slice(w, i, 5)).alias("w"), i.alias("i"))))
        twice = lambda s: F.filter(s, lambda x, k: ((k > 0) & (F.get(s, k - 1)["w"] == x["w"])) | ((k + 1 < F.size(s)) & (F.get(s, k + 1)["w"] == x["w"])))
        return let(found, lambda s: F.sort_array(F.transform(twice(s), lambda x: x["i"])))

    def covered(p: Column) -> Column:
        return F.aggregate(F.transform(p, lambda x, k: F.least(F.lit(5), F.coalesce(F.get(p, k + 1) - x, F.lit(5)))), F.lit(0), lambda a, x: a + x)

    def counted(w: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(0), F.size(w) - 5), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(5)]))
        return F.when(let(hashes, lambda h: F.size(F.array_distinct(h)) == F.size(h)), F.lit(0)).otherwise(let(places(w), covered))

    return F.when(F.size(words) < 10, F.when(F.size(words) < 6, F.lit(0)).otherwise(let(places(words), covered))).otherwise(counted(words))


def measure(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, lang, source and the measures; no shuffle, whole texts."""
    return docs.select(_measures(docs["text"]).alias("m"), "doc_id", "lang", "source").select("doc_id", "lang", "source", "m.*")


def _measures(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))

    def of(t: Column) -> Column:
        words = F.filter(F.split(t, "[ \\t-\\r]+"), lambda x: x != "")
        lines = F.filter(F.split(t, "\n"), lambda x: F.translate(x, SPACE, "") != "")
        dense = F.translate(t, SPACE, "")
        long = lambda c: c.cast("long")
        return F.struct(
            let(words, lambda w: F.struct(long(F.size(w)).alias("n_words"), long(repeated_words(w)).alias("n_repeat_words"))).alias("w"),
            let(lines, lambda x: F.struct(long(F.size(x)).alias("n_lines"), long(F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines"))).alias("l"),
            let(dense, lambda d: F.struct(long(F.length(d)).alias("word_chars"), long(F.length(d) - F.length(F.translate(d, SYMBOLS, ""))).alias("n_symbols"), long(F.length(d) - F.length(F.translate(d, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))).alias("n_upper"))).alias("c"),
        )

    return let(
        let(text, of),
        lambda m: F.struct(
            m["w"]["n_words"].alias("n_words"), m["c"]["word_chars"].alias("word_chars"), m["c"]["n_symbols"].alias("n_symbols"), m["l"]["n_dup_lines"].alias("n_dup_lines"), m["w"]["n_repeat_words"].alias("n_repeat_words"),
            m["l"]["n_lines"].alias("n_lines"), m["c"]["n_upper"].alias("n_upper"),
            ((m["w"]["n_words"] < 10) | (100 * m["w"]["n_repeat_words"] > 20 * m["w"]["n_words"])).alias("base_failed"),
        ),
    )


#: Bucket of a measure x: x itself below 64, else its leading 6 bits, at the place of the highest. Relative width: 1/32.
BUCKET = "CASE WHEN {x} < 64 THEN {x} ELSE {shift} * 32 + ({x} >> {shift}) END"
#: Places to shift x right until 32 <= x < 64.
SHIFT = "(CASE " + " ".join(f"WHEN {{x}} < {64 << k} THEN {k}" for k in range(1, 40)) + " ELSE 40 END)"
#: The least value of bucket b.
VALUE = "CASE WHEN b < 64 THEN b ELSE (32 + b % 32) << (b // 32 - 1) END"


def sketches(measured: DataFrame) -> DataFrame:
    """Mergeable quantile sketches of documents that pass the base rules: rows (lang, source, name, b, n).

    Sums of counts, which are combined before the shuffle; a hot source adds one row a task and bucket.
    """
    x = measured.selectExpr("lang", "source", "base_failed", f"stack({len(MEASURES)}, {', '.join(f'{k!r}, cast({v} AS bigint)' for k, v in MEASURES.items())}) AS (name, x)")
    shift = SHIFT.format(x="x")
    counted = x.selectExpr("lang", "source", "name", "base_failed", BUCKET.format(x="x", shift=shift) + " AS b").groupBy("lang", "source", "name", "b")
    # the condition is in the sum: as a filter before it, Catalyst would take the measures twice
    return counted.agg(F.sum(F.when(F.col("base_failed"), 0).otherwise(1)).alias("n")).where("n > 0")


def thresholds(sketch: DataFrame) -> DataFrame:
    """One row for each (lang, source): lang, source and the fence of each measure, from its sketch or a merged one.

    level 0 is the sketch itself, 1 that of the language, 2 that of all; each row takes the least level with
    ``LEAST_DOCS`` documents, or level 2.
    """
    groups = sketch.select("lang", "source").distinct()
    levels = [
        sketch.select("lang", "source", "name", "b", "n", F.lit(0).alias("level")),
        sketch.groupBy("lang", "name", "b").agg(F.sum("n").alias("n")).select("lang", F.lit(None).cast("string").alias("source"), "name", "b", "n", F.lit(1).alias("level")),
        sketch.groupBy("name", "b").agg(F.sum("n").alias("n")).select(F.lit(None).cast("string").alias("lang"), F.lit(None).cast("string").alias("source"), "name", "b", "n", F.lit(2).alias("level")),
    ]
    merged = levels[0].unionByName(levels[1]).unionByName(levels[2])
    fences = (
        merged.groupBy("level", "lang", "source", "name").agg(F.sort_array(F.collect_list(F.struct("b", "n"))).alias("s"), F.sum("n").alias("docs"))
        .withColumn("q1", _quantile("s", "docs", 1)).withColumn("q3", _quantile("s", "docs", 3))
        .withColumn("fence", F.col("q3") + FENCE * F.greatest(F.col("q3") - F.col("q1"), F.expr(LEAST)))
        .groupBy("level", "lang", "source").pivot("name", list(MEASURES)).agg(F.first("fence"))
    )
    docs = merged.where(F.col("name") == "symbols").groupBy("level", "lang", "source").agg(F.sum("n").alias("docs"))
    key = ["level", "lang", "source"]
    fences = fences.alias("f").join(docs.alias("d"), [F.col(f"f.{k}").eqNullSafe(F.col(f"d.{k}")) for k in key]).select(*[f"f.{k}" for k in key], "docs", *[F.col(k).alias(f"max_{k}") for k in MEASURES])
    names = [f"max_{k}" for k in MEASURES]
    pick = lambda n: [F.col(c).alias(f"{c}_{n}") for c in ("docs", *names)]
    own = fences.where("level = 0").select(F.col("lang").alias("l0"), F.col("source").alias("s0"), *pick(0))
    by_lang = fences.where("level = 1").select(F.col("lang").alias("l1"), *pick(1))
    of_all = fences.where("level = 2").select(*pick(2))
    joined = groups.join(own, F.col("lang").eqNullSafe(F.col("l0")) & F.col("source").eqNullSafe(F.col("s0")), "left").join(by_lang, F.col("lang").eqNullSafe(F.col("l1")), "left").join(F.broadcast(of_all), F.lit(True), "left")
    return joined.select("lang", "source", *[F.expr(f"CASE WHEN docs_0 >= {LEAST_DOCS} THEN {c}_0 WHEN docs_1 >= {LEAST_DOCS} THEN {c}_1 ELSE {c}_2 END").alias(c) for c in names])


def _quantile(s: str, docs: str, quarter: int) -> Column:
    """Of sorted (b, n): the least value of the first bucket up to which a quarter (or three) of the documents lie."""
    walk = F.expr(f"aggregate({s}, named_struct('c', 0L, 'b', -1L), (a, x) -> named_struct('c', a.c + x.n, 'b', CASE WHEN a.b < 0 AND 4 * (a.c + x.n) >= {quarter} * {docs} THEN cast(x.b AS bigint) ELSE a.b END)).b")
    return let(walk, lambda b: F.when(b < 64, b).otherwise(F.call_function("shiftleft", 32 + b % 32, (F.floor(b / 32) - 1).cast("int"))))


def rejected(docs: DataFrame, limits: DataFrame) -> DataFrame:
    """``docs``, which has the measures, with ``kept``: false where the base rules fail or a measure is above its fence.

    ``limits`` is a stored table. It is broadcast while its row count is within ``BROADCAST_ROWS``; beyond that both
    sides are joined by key, each key of the limits in ``SALTS`` copies and the documents dealt over them.
    """
    over = F.lit(False)
    for k, v in MEASURES.items():
        over = over | F.coalesce(F.expr(v) > F.col(f"max_{k}"), F.lit(False))
    names = [f"max_{k}" for k in MEASURES]
    limits = limits.select(F.col("lang").alias("_lang"), F.col("source").alias("_source"), *names)
    same = F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source"))
    if limits.count() <= BROADCAST_ROWS:
        joined = docs.join(F.broadcast(limits), same, "left")
    else:
        salted = limits.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = docs.withColumn("_own", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")).join(salted, same & (F.col("_own") == F.col("_salt")), "left").drop("_own", "_salt")
    return joined.withColumn("kept", ~F.col("base_failed") & ~over).drop("_lang", "_source", *names)


def limits_of(measured: DataFrame) -> DataFrame:
    """The stored thresholds; the measures are read once, for the sketches, which are stored too."""
    return stored(thresholds(stored(sketches(measured), "sketches")), "limits")


def quality(docs: DataFrame) -> DataFrame:
    """doc_id, the base measures, base_failed and kept, for every row of ``docs`` (doc_id, text, lang, source)."""
    measured = stored(measure(spread(docs.select("doc_id", "text", "lang", "source"))), "quality")
    return rejected(measured, limits_of(measured)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def passing(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns. Measures are taken once and stored beside the rows; no text is shuffled."""
    docs = spread(docs)
    clash = [c for c in docs.columns if c not in ("doc_id", "text", "lang", "source")]
    packed = docs.select("doc_id", "lang", "source", F.struct("text", *clash).alias("_row"), _measures(F.col("text")).alias("_m")).select("doc_id", "lang", "source", "_row", "_m.*")
    measured = stored(packed, "measured")
    row = [F.col(c) if c in ("doc_id", "lang", "source") else F.col(f"_row.{c}").alias(c) for c in docs.columns]
    return rejected(measured, limits_of(measured.drop("_row"))).where("kept").select(*row)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _sql() -> str:
    ws = "[ \\t-\\r]+"
    big = lambda v: v.replace(" div ", " // ")
    shift = SHIFT.format(x="x")
    stack = " UNION ALL ".join(f"SELECT lang, source, '{k}' AS name, {big(v)} AS x FROM m WHERE NOT base_failed" for k, v in MEASURES.items())
    q = lambda n: f"(SELECT min(b) FROM c c2 WHERE c2.level = c.level AND c2.lang IS NOT DISTINCT FROM c.lang AND c2.source IS NOT DISTINCT FROM c.source AND c2.name = c.name AND 4 * c2.upto >= {n} * c2.docs)"
    over = " OR ".join(f"coalesce({big(v)} > (SELECT fence FROM t WHERE t.name = '{k}' AND t.lang IS NOT DISTINCT FROM m.lang AND t.source IS NOT DISTINCT FROM m.source), false)" for k, v in MEASURES.items())
    return rf"""
    WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS text, row_number() OVER () AS rid FROM documents),
    w AS (SELECT *, list_filter(string_split_regex(text, '{ws}'), lambda x: x <> '') AS words, list_filter(string_split(text, chr(10)), lambda x: regexp_replace(x, '{ws}', '', 'g') <> '') AS lines, regexp_replace(text, '{ws}', '', 'g') AS dense FROM d),
    g AS (SELECT rid, i, array_to_string(words[i:i + 4], ' ') AS gram FROM w, LATERAL (SELECT unnest(range(1, len(words) - 3)) AS i) r),
    twice AS (SELECT rid, gram FROM g GROUP BY rid, gram HAVING count(*) > 1),
    cover AS (SELECT DISTINCT rid, i + k AS at FROM g JOIN twice USING (rid, gram), range(0, 5) r(k)),
    rep AS (SELECT rid, count(*) AS n FROM cover GROUP BY rid),
    m0 AS (SELECT doc_id, lang, source, len(words)::BIGINT AS n_words, length(dense)::BIGINT AS word_chars, (length(dense) - length(regexp_replace(dense, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
      (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words, len(lines)::BIGINT AS n_lines, (length(dense) - length(regexp_replace(dense, '[A-Z]', '', 'g')))::BIGINT AS n_upper
      FROM w LEFT JOIN rep USING (rid)),
    m AS (SELECT *, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed FROM m0),
    s AS (SELECT lang, source, name, {BUCKET.format(x="x", shift=shift)} AS b, count(*) AS n FROM ({stack}) GROUP BY ALL),
    l AS (SELECT 0 AS level, lang, source, name, b, n FROM s UNION ALL SELECT 1, lang, NULL, name, b, sum(n) FROM s GROUP BY lang, name, b UNION ALL SELECT 2, NULL, NULL, name, b, sum(n) FROM s GROUP BY name, b),
    c AS (SELECT *, sum(n) OVER (PARTITION BY level, lang, source, name ORDER BY b) AS upto, sum(n) OVER (PARTITION BY level, lang, source, name) AS docs FROM l),
    f0 AS (SELECT DISTINCT level, lang, source, name, docs, {q(1)} AS b1, {q(3)} AS b3 FROM c),
    f1 AS (SELECT level, lang, source, name, docs, {VALUE.replace("b", "b1")} AS q1, {VALUE.replace("b", "b3")} AS q3 FROM f0),
    f AS (SELECT *, q3 + {FENCE} * greatest(q3 - q1, {LEAST}) AS fence FROM f1),
    t AS (SELECT f.lang, f.source, f.name, CASE WHEN f.docs >= {LEAST_DOCS} THEN f.fence WHEN g.docs >= {LEAST_DOCS} THEN g.fence ELSE h.fence END AS fence
      FROM f JOIN f g ON g.level = 1 AND g.lang IS NOT DISTINCT FROM f.lang AND g.name = f.name JOIN f h ON h.level = 2 AND h.name = f.name WHERE f.level = 0)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT ({over}) AS kept FROM m
    """


SQL = {"op10_quality": _sql()}
