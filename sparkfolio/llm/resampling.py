"""Importance resampling towards a target distribution, from hashed n-grams of a position table.

Texts become a table of (document, position, word).  For orders above 1 a window
over a document's positions puts the following words behind each word, so one
row yields its n-grams of every order.  N-grams are hashed into buckets; counts
by bucket of the corpus and of the target give each bucket a gain, and the mean
gain of a document's n-grams is its weight.  A Gumbel draw that depends on the
seed and the document alone is added, and the highest scores are the sample:
drawing without replacement in proportion to the weights, equal in reruns.

A document's rows leave one task, so sums by document are added up before they
are shuffled; sums by bucket are at most ``buckets`` rows a task, and the gains
that are broadcast are ``buckets`` rows whatever the input.  Ranks come from a
sort in ranges.  For orders above 1 a document is cut in blocks of ``BLOCK``
positions that overlap by what the last n-grams need, so its length doesn't
bound anything.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

#: What stands between words, once A-Z are lower-cased.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Positions of a document that one window sees.
BLOCK = 1 << 16
#: Seed of the draw, hash buckets, longest n-gram, percentage drawn, fewest words of a document that can be drawn.
SEED, BUCKETS, ORDERS, SHARE, LEAST_WORDS = 2024, 10_000, 1, 10, 20


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(F.coalesce(text.cast("string"), F.lit("")), CAPITALS, SMALL), BETWEEN), "")


def ngrams(rows: DataFrame, by: list[str], orders: int = ORDERS) -> DataFrame:
    """``by`` (which names a document), ``order`` and ``ngram`` of each n-gram of the column ``text``, up to ``orders`` words.

    A document without words has one row whose n-gram is null.
    """
    table = rows.select(*by, F.posexplode_outer(words_of(F.col("text"))).alias("pos", "word"))
    if orders == 1:
        return table.select(*by, F.lit(1).alias("order"), F.col("word").alias("ngram"))
    own = F.coalesce(F.floor(F.col("pos") / BLOCK), F.lit(0))
    first = F.when((own > 0) & (F.col("pos") % BLOCK < orders - 1), own - 1).otherwise(own)  # also ends the n-grams of the block before
    table = table.withColumn("_own", own).withColumn("_block", F.explode(F.sequence(first, own)))
    following = W.partitionBy(*by, "_block").orderBy("pos")
    grams = [F.col("word")]
    for k in range(1, orders):
        grams.append(F.concat(grams[-1], F.lit(" "), F.lead("word", k).over(following)))  # null beyond the end
    listed = F.array(*[F.struct(F.lit(k + 1).alias("order"), g.alias("ngram")) for k, g in enumerate(grams)])
    table = table.select(*by, "_own", "_block", listed.alias("_grams")).where("_own = _block")
    return table.select(*by, F.explode("_grams").alias("g")).select(*by, "g.order", "g.ngram").where("ngram IS NOT NULL OR order = 1")


def bucket_of(ngram: Column, buckets: int) -> Column:
    return F.crc32(F.encode(ngram, "UTF-8")) % buckets


def bucket_counts(rows: DataFrame, orders: int, buckets: int, name: str) -> DataFrame:
    """N-grams of ``rows`` (key, text) by bucket, written: ``buckets`` rows at most."""
    grams = ngrams(rows.select("key", "text"), ["key"], orders).where("ngram IS NOT NULL")
    return common.written(grams.select(bucket_of(F.col("ngram"), buckets).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n")), name)


def gains(corpus: DataFrame, target: DataFrame, buckets: int) -> DataFrame:
    """``bucket`` and ``gain`` of every bucket: thousandths of the log of its share in the target over that in the corpus."""
    whole, wanted = (x.agg(F.sum("n")).first()[0] or 0 for x in (corpus, target))
    rows = corpus.sparkSession.range(buckets).select(F.col("id").alias("bucket"))
    for side, name in ((corpus, "s"), (target, "t")):
        rows = rows.join(F.broadcast(side.select("bucket", F.col("n").alias(name))), "bucket", "left")  # buckets rows at most
    s, t = (F.coalesce(F.col(c), F.lit(0)).cast("double") for c in ("s", "t"))
    ratio = (t + 1) * F.lit(float(whole + buckets)) / ((s + 1) * F.lit(float(wanted + buckets)))
    return rows.select("bucket", F.floor(1000 * F.log(ratio)).alias("gain"))


def gumbel(doc_id: Column, seed: int) -> Column:
    """Thousandths of a Gumbel number that follows from the seed and the id; a null id counts as an empty one."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(F.encode(name, "UTF-8"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def scored(rows: DataFrame, target: DataFrame, orders: int = ORDERS, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """``rows`` (key, id, text) as ``key``, ``id``, ``n_words``, ``n_features``, ``weight`` and ``score``, written.

    ``target`` has the columns ``key`` and ``text``.
    """
    weights = F.broadcast(gains(bucket_counts(rows, orders, buckets, "corpus"), bucket_counts(target, orders, buckets, "target"), buckets))
    grams = ngrams(rows.select("key", "id", "text"), ["key", "id"], orders).withColumn("bucket", bucket_of(F.col("ngram"), buckets))
    sums = grams.join(weights, "bucket", "left").groupBy("key", "id").agg(F.count("ngram").alias("n_features"), F.sum(F.when(F.col("ngram").isNotNull() & (F.col("order") == 1), 1).otherwise(0)).alias("n_words"), F.sum("gain").alias("_sum"))
    weight = F.when(F.col("n_features") > 0, F.floor(F.col("_sum") / F.col("n_features"))).otherwise(F.lit(0)).cast("long")
    return common.written(sums.select("key", "id", "n_words", "n_features", weight.alias("weight"), (weight + gumbel(F.col("id"), seed)).alias("score")), "scored")


def _ranked(rows: DataFrame, target: DataFrame, target_col: str, orders: int, buckets: int, share: int, least_words: int, seed: int) -> DataFrame:
    wanted = target.select(F.monotonically_increasing_id().alias("key"), F.col(f"`{target_col}`").cast("string").alias("text"))
    found = scored(rows, wanted, orders, buckets, seed)
    able = F.col("n_words") >= least_words
    n = found.where(able).count() * share // 100
    placed = common.placed(found.where(able), [F.desc("score"), F.col("id").asc_nulls_last(), F.col("key")], "ranked")
    some = placed.select(*found.columns, F.when(F.col("_place") < n, F.col("_place") + 1).cast("long").alias("rank"))
    return some.unionByName(found.where(~able).withColumn("rank", F.lit(None).cast("long")))


def ranked(docs: DataFrame, target: DataFrame, text_col: str = "text", id_col: str = "doc_id", target_col: str = "text", orders: int = ORDERS, buckets: int = BUCKETS, share: int = SHARE, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """Every document as ``key``, ``id``, ``n_words``, ``n_features``, ``weight``, ``score`` and ``rank``.

    Of the documents with at least ``least_words`` words, ``share`` percent
    (rounded down) are drawn and get ranks from 1 by falling score, ties to the
    smaller id; all others have a null rank.  Null and empty texts have no
    features and weight 0.  Null ids come last among equal scores and share one
    draw; repeated rows are documents of their own.  Very long texts are counted
    whole.  Other columns play no part.  An empty corpus gives an empty result,
    an empty target gains that fall with a bucket's count.
    """
    return _ranked(common.keyed(docs, id_col, text_col), target, target_col, orders, buckets, share, least_words, seed)


def drawn(docs: DataFrame, target: DataFrame, text_col: str = "text", id_col: str = "doc_id", target_col: str = "text", orders: int = ORDERS, buckets: int = BUCKETS, share: int = SHARE, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """The rows of ``docs`` that ``ranked`` draws, with all their columns and no others."""
    rows = common.keyed(docs, id_col, text_col, whole=True)
    found = _ranked(rows.select("key", "id", "text"), target, target_col, orders, buckets, share, least_words, seed)
    return rows.join(found.where("rank IS NOT NULL").select(F.col("key").alias("_chosen")), F.col("key") == F.col("_chosen")).select("row.*")


def query(spark, sf_dir: str) -> DataFrame:
    """op11: a tenth of the documents, drawn towards the texts of ``benchmark``."""
    found = ranked(common.table(spark, sf_dir, "documents").select("doc_id", "text"), common.table(spark, sf_dir, "benchmark").select("text"))
    return found.select(F.col("id").alias("doc_id"), "n_features", "weight", "score", "rank")


#: CRC-32 of each value of a list of texts, by its table of 256 entries (polynomial 0xEDB88320).
CRC_SQL = """bits(i, c, k) AS (SELECT i, i, 0 FROM range(256) r(i) UNION ALL
        SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
    crc_table AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
    crc AS (SELECT x, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(octet_length(encode(x))), lambda j: ('0x' || substr(hex(encode(x)), 2 * j + 1, 2))::BIGINT)),
            lambda a, b: xor(a >> 8, t[1 + (xor(a, b) & 255)])), 4294967295) AS crc FROM crc_inputs, crc_table)"""

ORACLE_SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, '{CAPITALS}', '{SMALL}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM documents),
    b AS (SELECT unnest(regexp_extract_all(translate(text, '{CAPITALS}', '{SMALL}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark),
    crc_inputs AS (SELECT DISTINCT w AS x FROM d UNION SELECT w FROM b),
    {CRC_SQL},
    dc AS (SELECT doc_id, crc % {BUCKETS} AS bucket FROM d JOIN crc ON x = w),
    s AS (SELECT bucket, count(*) AS s FROM dc GROUP BY 1),
    t AS (SELECT crc % {BUCKETS} AS bucket, count(*) AS t FROM b JOIN crc ON x = w GROUP BY 1),
    g AS (SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM d) + {BUCKETS})::DOUBLE / ((s + 1)::DOUBLE * ((SELECT count(*) FROM b) + {BUCKETS})::DOUBLE))) AS BIGINT) AS gain FROM s LEFT JOIN t USING (bucket)),
    w AS (SELECT doc_id, count(*) AS n, CAST(floor(sum(gain)::DOUBLE / count(*)) AS BIGINT) AS weight FROM dc JOIN g USING (bucket) GROUP BY 1),
    h AS (SELECT doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
            CAST(floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || doc_id), 1, 8))::BIGINT::DOUBLE + 0.5) / 4294967296.0::DOUBLE))) AS BIGINT) AS draw
        FROM documents LEFT JOIN w USING (doc_id)),
    r AS (SELECT *, row_number() OVER (PARTITION BY n_features >= {LEAST_WORDS} ORDER BY weight + draw DESC, doc_id) AS place,
            (SELECT count(*) FROM h WHERE n_features >= {LEAST_WORDS}) * {SHARE} // 100 AS drawn FROM h)
SELECT doc_id, n_features, weight, weight + draw AS score, CASE WHEN n_features >= {LEAST_WORDS} AND place <= drawn THEN place END AS rank FROM r
"""
