"""Quality rules by distribution divergence, in DataFrame and SQL functions only.

Hard rules come first: a document of few words, or one whose three-word windows
repeat too much, fails.  What is left is compared with a reference of its
language: the Jensen-Shannon distance (base 2, from 0 to 1) between histograms
of character classes, and between histograms of the language's most common
words with all others as one more bin.  Short texts give noisy histograms, so
each comparison has a least length under which it says nothing.

References are learned from the corpus: one pass counts words by language, and a
second measures every document, whose counts of classes are then added up by
language.  A language has a reference of its own if it holds ``LEAST_SHARE`` of
all words, so there are at most ``1 / LEAST_SHARE`` of them and their broadcast
has a fixed bound; all other documents are compared with all languages together.

Everything about one document is computed inside its row by array functions:
no text is shuffled, only counts are, and a task needs about 200 bytes of memory
for each word of its longest text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

WORD = r"[^\x20\x09-\x0D]"
SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]+"
#: Classes of a word's characters, each of what those before leave; what none takes is a last class.
CLASSES = ("[a-z]+", r"\p{Lu}+", r"\p{L}+", r"\p{N}+", r"""[.,;:'"()\-]+""", "[!?]+", r"[#*$%&|<>@/\\^_~=+{}\[\]`]+")
#: Hard rules: fewest words, and the largest percentage of words in repeated windows.
LEAST_WORDS, MOST_REPEATED = 50, 50
#: Common words in a language's reference, and the most bytes of one.
COMMON, COMMON_BYTES = 32, 8
#: Fewest characters and words that a histogram is compared from.
LEAST_CHARS, LEAST_COUNTED = 200, 100
#: Largest Jensen-Shannon distances of a document that is kept.
MOST_CLASSES, MOST_WORDS = 0.22, 0.35
#: Documents with a larger share of symbols or of capitals aren't counted in references of classes.
MOST_SYMBOLS, MOST_CAPITALS = 0.02, 0.3
#: Share of all words that gives a language its own reference.
LEAST_SHARE = 0.001
#: Most repeated hashes that are looked up one by one; beyond, all windows of the text are sorted.
FEW = 64


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACES), "")


def repeated_words(words: Column) -> Column:
    """Words that stand in a three-word window found twice or more in ``words``.

    A text whose windows all have hashes of their own has none.  Otherwise the
    windows of repeated hashes are sorted by hash and then by the words
    themselves, so equal ones are neighbours; their places, in order, cover three
    words each, or as many as lie beyond the one before.
    """
    n = F.size(words)
    none, every = F.lit(0).cast("long"), F.sequence(F.lit(0), n - 3)
    windows = F.slice(F.arrays_zip(words.alias("a"), F.slice(words, 2, n).alias("b"), F.slice(words, 3, n).alias("c")), 1, n - 2)
    same = lambda x, y: F.coalesce(x["t"].eqNullSafe(y["t"]), F.lit(False))

    def suspects(z: Column, h: Column) -> Column:
        twice = lambda s: F.array_distinct(F.filter(s, lambda x, k: x == F.get(s, k - 1)))
        chosen = lambda d: F.when(F.size(d) <= FEW, F.filter(every, lambda i: F.array_contains(d, F.get(h, i)))).otherwise(every)
        return F.transform(_let(_let(F.sort_array(h), twice), chosen), lambda i: F.struct(F.get(h, i).alias("h"), F.get(z, i).alias("t"), i.alias("i")))

    def places(s: Column) -> Column:
        return F.sort_array(F.transform(F.filter(s, lambda x, k: same(x, F.get(s, k - 1)) | same(x, F.get(s, k + 1))), lambda x: x["i"]))

    def covered(p: Column) -> Column:
        each = F.transform(p, lambda at, k: F.coalesce(F.least(F.lit(3), at - F.get(p, k - 1)), F.lit(3)))
        return F.aggregate(each, none, lambda total, x: total + x)

    def counted(z: Column) -> Column:
        return _let(F.transform(z, lambda x: F.xxhash64(x)), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), none).otherwise(_let(_let(F.sort_array(suspects(z, h)), places), covered)))

    return F.when(n < 4, none).otherwise(_let(windows, counted))


def duplicate_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(WORD))
    return _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def with_classes(rows: DataFrame, letters: str) -> DataFrame:
    """``rows`` with ``_c0``, ``_c1``, ...: characters of each class in a text without white space, and ``_signs``: its symbols.

    Each class is cut out of what those before have left, so only the first one reads the whole text.
    """
    left = letters
    for k, c in enumerate(CLASSES):
        rows = rows.withColumn(f"_left{k}", F.regexp_replace(left, c, "")).withColumn(f"_c{k}", (F.length(left) - F.length(f"_left{k}")).cast("long"))
        left = f"_left{k}"
    signs = F.length("_left3") - F.length(F.regexp_replace("_left3", SYMBOLS, ""))
    rows = rows.withColumn(f"_c{len(CLASSES)}", F.length(left).cast("long")).withColumn("_signs", signs.cast("long"))
    return rows.drop(*[f"_left{k}" for k in range(len(CLASSES))])


BINS = [f"_c{k}" for k in range(len(CLASSES) + 1)]


def distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two arrays of shares."""
    part = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0))
    terms = F.zip_with(p, q, lambda x, y: part(x, (x + y) / 2) + part(y, (x + y) / 2))
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), lambda a, b: a + b) / 2))


def _all_languages() -> Column:
    return F.lit(None).cast("string").alias("lang")


def _joined(rows: DataFrame, refs: DataFrame) -> DataFrame:
    """``rows`` with the other columns of ``refs`` (lang, null for all languages; at most 1 / LEAST_SHARE rows) of their ``_known``."""
    return rows.join(F.broadcast(refs.withColumnRenamed("lang", "_lang")), F.col("_known").eqNullSafe(F.col("_lang")), "left").drop("_lang")


def word_references(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", common_words: int = COMMON, least_words: int = LEAST_WORDS, least_share: float = LEAST_SHARE) -> DataFrame:
    """One row a language with a reference, and one of all languages together (``lang`` null), written.

    ``words`` are the most common words with a letter (ties: smaller first) and
    ``shares`` theirs, after the share of all others.  Documents of fewer than
    ``least_words`` words aren't counted.
    """
    rows = docs.select(F.col(f"`{lang_col}`").cast("string").alias("lang"), words_of(F.col(f"`{text_col}`").cast("string")).alias("w")).where(F.size("w") >= least_words)
    short = F.when(F.octet_length("word") <= COMMON_BYTES, F.col("word"))  # all longer words are one row of counts
    own = common.written(rows.select("lang", F.explode("w").alias("word")).groupBy("lang", short.alias("word")).agg(F.count("*").alias("n")), "words")
    pooled = own.groupBy("word").agg(F.sum("n").alias("n")).select(_all_languages(), "word", "n", F.lit(True).alias("pooled"))
    every = own.where("lang IS NOT NULL").withColumn("pooled", F.lit(False)).unionByName(pooled)
    totals = every.groupBy("lang", "pooled").agg(F.sum("n").alias("total"))
    place = F.row_number().over(W.partitionBy("lang", "pooled").orderBy(F.desc("n"), "word"))
    tops = every.where(F.col("word").rlike(r"\p{L}")).withColumn("place", place).where(F.col("place") <= common_words)
    tops = tops.groupBy(F.col("lang").alias("_lang"), F.col("pooled").alias("_pooled")).agg(F.sort_array(F.collect_list(F.struct("place", "word", "n"))).alias("tops"))
    made = totals.join(tops, F.col("lang").eqNullSafe(F.col("_lang")) & (F.col("pooled") == F.col("_pooled")))
    shares = F.transform("tops", lambda t: t["n"] / F.col("total"))
    rest = F.greatest(F.lit(0.0), 1 - F.aggregate(shares, F.lit(0.0), lambda a, b: a + b))
    made = common.written(made.select("lang", "pooled", "total", F.transform("tops", lambda t: t["word"]).alias("words"), F.concat(F.array(rest), shares).alias("shares")), "references")
    whole = made.where("pooled").agg(F.sum("total")).first()[0] or 0
    return made.where(F.col("pooled") | (F.col("total") >= F.lit(least_share) * F.lit(whole))).select("lang", "words", "shares")


def class_references(measured: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """``lang`` (null: all languages together) and ``classes``, the shares of character classes in it.

    ``measured`` has ``_known``, ``_bins``, ``rule_n_words``, ``rule_n_symbols``
    and ``rule_word_chars``.  Short documents, those of many symbols and those
    mostly of capitals aren't counted.
    """
    chars = F.col("rule_word_chars")
    plain = (F.col("rule_n_words") >= least_words) & (F.col("rule_n_symbols") <= MOST_SYMBOLS * chars) & (F.get("_bins", 1) <= MOST_CAPITALS * chars)
    sums = measured.where(plain).groupBy("_known").agg(*[F.sum(F.get("_bins", k)).alias(c) for k, c in enumerate(BINS)])
    sums = common.written(sums, "classes")  # a row for each language
    rows = sums.where("_known IS NOT NULL").withColumnRenamed("_known", "lang").unionByName(sums.agg(*[F.sum(c).alias(c) for c in BINS]).select(_all_languages(), *BINS))
    bins = F.array(*[F.col(c).cast("double") for c in BINS])
    whole = F.aggregate(bins, F.lit(0.0), lambda a, b: a + b)
    return rows.select("lang", F.when(whole > 0, F.transform(bins, lambda c: c / whole)).alias("classes"))


def judged(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", keep: list[str] | None = None, most_classes: float = MOST_CLASSES, most_words: float = MOST_WORDS) -> DataFrame:
    """``docs`` (or only their columns ``keep``) with the measures, both distances, ``base_failed`` and ``kept`` (prefixed ``rule_``).

    What is returned of a document is written once with its measures.  The prefix
    gets underscores in front while a column kept has such a name.  A distance is
    null where the text is too short for it or no document is long enough for a
    reference; a null distance refuses nothing.  Null and empty texts have no
    words and fail.  Repeated rows are judged one by one, and they count each in
    the references.  A null or rare language is compared with all languages
    together.  Very long texts are judged whole.  An empty table gives an empty
    result.
    """
    kept = docs.columns if keep is None else keep
    refs = word_references(docs, text_col, lang_col)
    known = F.broadcast(refs.where("lang IS NOT NULL").select(F.col("lang").alias("_known")))  # as many rows as references at most
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("_text")
    rows = docs.select(F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in kept]).alias("_row"), F.col(f"`{lang_col}`").cast("string").alias("_own"), text)
    rows = _joined(rows.join(known, F.col("_own") == F.col("_known"), "left"), refs.withColumnRenamed("words", "_words").withColumnRenamed("shares", "_shares"))
    rows = rows.withColumn("_list", words_of(F.col("_text"))).withColumn("_letters", F.array_join("_list", ""))
    rows = with_classes(rows, "_letters").withColumn("_n", F.size("_list").cast("long")).withColumn("_chars", F.length("_letters").cast("long"))
    hits = F.array_remove(F.transform("_list", lambda w: F.array_position(F.col("_words"), w)), F.lit(0).cast("long"))
    counts = lambda h: F.concat(F.array(F.col("_n") - F.size(h)), F.transform(F.sequence(F.lit(1), F.size("_words")), lambda k: (F.size(h) - F.size(F.array_remove(h, k.cast("long")))).cast("long")))
    shares = lambda c, whole: F.transform(c, lambda x: x / whole)
    found = {"n_words": F.col("_n"), "word_chars": F.col("_chars"), "n_symbols": F.col("_signs"), "n_dup_lines": duplicate_lines(F.col("_text")), "n_repeat_words": repeated_words(F.col("_list"))}
    by_word = F.when(F.col("_n") >= LEAST_COUNTED, distance(shares(_let(hits, counts), F.col("_n")), F.col("_shares")))
    rows = common.written(rows.select("_row", "_known", *[c.alias(f"rule_{k}") for k, c in found.items()], by_word.alias("rule_word_distance"), F.array(*BINS).alias("_bins")), "measured")
    by_class = F.when(F.col("rule_word_chars") >= LEAST_CHARS, distance(shares(F.col("_bins"), F.col("rule_word_chars")), F.col("classes")))
    rows = _joined(rows, class_references(rows)).withColumn("rule_class_distance", by_class)
    failed = (F.col("rule_n_words") < LEAST_WORDS) | (100 * F.col("rule_n_repeat_words") > MOST_REPEATED * F.col("rule_n_words"))
    near = F.coalesce(F.col("rule_class_distance") <= most_classes, F.lit(True)) & F.coalesce(F.col("rule_word_distance") <= most_words, F.lit(True))
    rows = rows.withColumn("rule_base_failed", failed).withColumn("rule_kept", ~failed & near)
    names = [f"rule_{k}" for k in (*found, "class_distance", "word_distance", "base_failed", "kept")]
    prefix = "rule_"
    while {prefix + x.removeprefix("rule_") for x in names} & {c.lower() for c in kept}:
        prefix = "_" + prefix
    return rows.select(*[F.col(f"_row.`{c}`") for c in kept], *[F.col(x).alias(prefix + x.removeprefix("rule_")) for x in names])


COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def query(spark, sf_dir: str) -> DataFrame:
    """op13: every document by the hard rules and its distance from its language."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    return judged(docs, keep=["doc_id"]).select("doc_id", *[F.col(f"rule_{c}").alias(c) for c in COLUMNS])


def _distance_sql(p: str, q: str) -> str:
    part = lambda x: f"CASE WHEN {x} > 0 THEN {x} * log2({x} / (({p}[i] + {q}[i]) / 2)) ELSE 0 END"
    return f"sqrt(greatest(0, list_sum(list_transform(range(1, len({q}) + 1), lambda i: {part(f'{p}[i]')} + {part(f'{q}[i]')})) / 2))"


_CHAIN_SQL = ", ".join(f"regexp_replace(l{k}, '{c.replace(chr(39), chr(39) * 2)}', '', 'g') AS l{k + 1}" for k, c in enumerate(CLASSES))
_BINS_SQL = ", ".join([*[f"length(l{k}) - length(l{k + 1})" for k in range(len(CLASSES))], f"length(l{len(CLASSES)})"])

ORACLE_SQL = rf"""
WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS text, regexp_replace(coalesce(text, ''), '{SPACES}', '', 'g') AS l0,
        regexp_extract_all(coalesce(text, ''), '{WORD}+') AS words FROM documents),
    chain AS (SELECT *, {_CHAIN_SQL} FROM d),
    m AS (SELECT *, [{_BINS_SQL}] AS bins, length(l4) - length(regexp_replace(l4, '{SYMBOLS}', '', 'g')) AS signs FROM chain),
    grams AS (SELECT doc_id, i, words[i] AS a, words[i + 1] AS b, words[i + 2] AS c FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM d)),
    twice AS (SELECT doc_id, unnest([i, i + 1, i + 2]) AS place FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM grams) WHERE n > 1),
    repeats AS (SELECT doc_id, count(DISTINCT place) AS n FROM twice GROUP BY 1),
    lines AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '{WORD}') GROUP BY 1),
    counted AS (SELECT lang, CASE WHEN strlen(w) <= {COMMON_BYTES} THEN w END AS word, count(*) AS n FROM (SELECT lang, unnest(words) AS w FROM d WHERE len(words) >= {LEAST_WORDS}) GROUP BY ALL),
    every AS (SELECT lang, FALSE AS pooled, word, n FROM counted WHERE lang IS NOT NULL UNION ALL SELECT NULL, TRUE, word, sum(n) FROM counted GROUP BY ALL),
    totals AS (SELECT lang, pooled, sum(n) AS total FROM every GROUP BY ALL),
    tops AS (SELECT lang, pooled, list(word ORDER BY place) AS words, list(n ORDER BY place) AS ns
        FROM (SELECT *, row_number() OVER (PARTITION BY lang, pooled ORDER BY n DESC, word) AS place FROM every WHERE regexp_matches(word, '\p{{L}}')) WHERE place <= {COMMON} GROUP BY ALL),
    refs AS (SELECT totals.lang, pooled, words, list_prepend(greatest(0, 1 - list_sum(list_transform(ns, lambda n: n::DOUBLE / total))), list_transform(ns, lambda n: n::DOUBLE / total)) AS shares
        FROM totals JOIN tops USING (pooled) WHERE totals.lang IS NOT DISTINCT FROM tops.lang AND (pooled OR total >= {LEAST_SHARE} * (SELECT sum(total) FROM totals WHERE pooled))),
    o AS (SELECT m.*, k.lang AS own FROM m LEFT JOIN refs k ON k.lang = m.lang),
    used AS (SELECT * FROM o WHERE signs <= {MOST_SYMBOLS} * length(l0) AND length(l1) - length(l2) <= {MOST_CAPITALS} * length(l0) AND len(words) >= {LEAST_WORDS}),
    flat AS (SELECT own, i, bins[i] AS n FROM used, range(1, {len(CLASSES) + 2}) r(i)),
    sums AS (SELECT own, FALSE AS pooled, i, sum(n) AS n FROM flat WHERE own IS NOT NULL GROUP BY ALL UNION ALL SELECT NULL, TRUE, i, sum(n) FROM flat GROUP BY ALL),
    classes AS (SELECT own, list(n::DOUBLE / whole ORDER BY i) AS classes FROM (SELECT *, sum(n) OVER (PARTITION BY own, pooled) AS whole FROM sums) GROUP BY own),
    compared AS (SELECT o.*, classes, shares, list_prepend(len(o.words) - len(list_filter(o.words, lambda w: list_contains(refs.words, w))), list_transform(refs.words, lambda c: len(list_filter(o.words, lambda w: w = c)))) AS counts
        FROM o LEFT JOIN refs ON refs.lang IS NOT DISTINCT FROM o.own LEFT JOIN classes ON classes.own IS NOT DISTINCT FROM o.own),
    shared AS (SELECT *, list_transform(bins, lambda x: x / length(l0)) AS p, list_transform(counts, lambda x: x / len(words)) AS w FROM compared),
    judged AS (SELECT doc_id, len(words) AS n_words, length(l0) AS word_chars, signs, CASE WHEN length(l0) >= {LEAST_CHARS} THEN {_distance_sql("p", "classes")} END AS by_class,
        CASE WHEN len(words) >= {LEAST_COUNTED} THEN {_distance_sql("w", "shares")} END AS by_word FROM shared),
    ruled AS (SELECT doc_id, n_words, word_chars, signs AS n_symbols, coalesce(lines.n, 0) AS n_dup_lines, coalesce(repeats.n, 0) AS n_repeat_words, by_class, by_word,
        n_words < {LEAST_WORDS} OR 100 * coalesce(repeats.n, 0) > {MOST_REPEATED} * n_words AS base_failed FROM judged LEFT JOIN lines USING (doc_id) LEFT JOIN repeats USING (doc_id))
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
    NOT base_failed AND coalesce(by_class <= {MOST_CLASSES}, TRUE) AND coalesce(by_word <= {MOST_WORDS}, TRUE) AS kept FROM ruled
"""
