"""The engine's queries on the shared tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geometry as geo
from ..functions import scalar as sc
from ..functions import printing as pr
from ..operators import aggregates, finalize, joins, rules, search, selection, windows
from ..operators.running import percentile_rank
from ..sources import store

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its name, with the SQL of its rows."""

    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with ``t``, the microsecond of their time."""
    return table(spark, sf_dir, "events").withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")))


HOUR = 3_600_000_000
SESSIONS = """s AS (SELECT event_id, user_id, event_type, value, epoch_us(ts) AS t,
    CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) > 14400000000 THEN 1 ELSE 0 END AS brk FROM events),
  g AS (SELECT *, CAST(sum(brk) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM s)"""


def _sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.gap_sessions(events(spark, sf_dir), ["user_id"], "t", 4 * HOUR, "event_id")


@query(f"""WITH {SESSIONS}, b AS (SELECT *, row_number() OVER (PARTITION BY user_id, session ORDER BY value DESC, event_id) AS place,
    count(*) OVER (PARTITION BY user_id, session) AS n_events FROM g)
  SELECT user_id, session, event_id AS best_event, round(value, 6) AS best_value, n_events FROM b WHERE place = 1""")
def event_sessions(spark, sf_dir):
    """The best event of each session of each user."""
    rows = _sessions(spark, sf_dir).withColumn("n_events", F.count("*").over(W.partitionBy("user_id", "session")))
    best = windows.winners(rows, ["user_id", "session"], [F.desc("value"), F.col("event_id")])
    return best.select("user_id", "session", F.col("event_id").alias("best_event"), F.round("value", 6).alias("best_value"), "n_events")


@query(f"WITH {SESSIONS} SELECT event_id, user_id, session FROM g")
def gap_sessions(spark, sf_dir):
    return _sessions(spark, sf_dir).select("event_id", "user_id", "session")


@query("""SELECT l_orderkey, l_linenumber, CAST(round(100.0 * count(*) OVER (ORDER BY l_extendedprice RANGE UNBOUNDED PRECEDING) / count(*) OVER ()) AS INTEGER) AS pct FROM lineitem""")
def percentile(spark, sf_dir):
    return percentile_rank(table(spark, sf_dir, "lineitem"), "l_extendedprice", "pct").select("l_orderkey", "l_linenumber", "pct")


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
  r AS (SELECT user_id, event_id, t, rn, t AS anchor, 0 AS w FROM e WHERE rn = 1
    UNION ALL SELECT e.user_id, e.event_id, e.t, e.rn, CASE WHEN e.t - r.anchor > 21600000000 THEN e.t ELSE r.anchor END,
      CASE WHEN e.t - r.anchor > 21600000000 THEN r.w + 1 ELSE r.w END FROM r JOIN e ON e.user_id = r.user_id AND e.rn = r.rn + 1)
  SELECT event_id, user_id, CAST(w AS BIGINT) AS moment FROM r""")
def anchored_windows(spark, sf_dir):
    found = windows.anchored_windows(events(spark, sf_dir), ["user_id"], "t", 6 * HOUR, "event_id", "moment")
    return found.select("event_id", "user_id", F.col("moment").cast("long").alias("moment"))


@query("""SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders) WHERE n = 1""")
def cluster_winner(spark, sf_dir):
    return windows.winners(table(spark, sf_dir, "orders"), ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")]).select("o_custkey", "o_orderkey")


@query(f"""WITH {SESSIONS}, p AS (SELECT *, row_number() OVER (PARTITION BY user_id, session ORDER BY value DESC, event_id) AS turn FROM g)
  SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY turn, value DESC, event_id) AS pick FROM p WHERE turn <= 2""")
def first_picks_cap2(spark, sf_dir):
    return windows.ranked_picks(_sessions(spark, sf_dir), ["user_id"], "session", [F.desc("value"), F.col("event_id")]).select("user_id", "event_id", "pick")


@query(f"""WITH {SESSIONS}, p AS (SELECT *, row_number() OVER (PARTITION BY user_id, session ORDER BY value DESC) AS place FROM g)
  SELECT user_id, session, count(*) AS n, CAST(sum(CASE WHEN value > 50 THEN 1 ELSE 0 END) AS BIGINT) AS n_kept, count(DISTINCT event_type) AS moments,
    round(avg(CASE WHEN place <= 3 THEN value END), 6) AS merit, round(avg(CASE WHEN event_type = 'click' THEN 1.0 ELSE 0.0 END), 6) AS flag_share FROM p GROUP BY ALL""")
def event_stats(spark, sf_dir):
    found = aggregates.event_stats(_sessions(spark, sf_dir), ["user_id", "session"], "value", F.col("value") > 50, "event_type", F.col("event_type") == "click")
    return found.withColumn("merit", F.round("merit", 6)).withColumn("flag_share", F.round("flag_share", 6))


@query(r"""WITH w AS (SELECT DISTINCT source, doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '')) AS tag FROM documents),
  c AS (SELECT source, tag, count(*) AS n FROM w GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, tag) AS rank FROM c)
  SELECT source, tag, n, rank FROM r WHERE rank <= 10""")
def top_tags(spark, sf_dir):
    return aggregates.top_tags(table(spark, sf_dir, "documents"), ["source"], sc.words(F.col("text")))


@query("""WITH c AS (SELECT o_custkey, o_orderpriority, count(*) AS votes FROM orders GROUP BY ALL)
  SELECT o_custkey, o_orderpriority, votes FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY votes DESC, o_orderpriority DESC) AS n FROM c) WHERE n = 1""")
def mode_tiebreak(spark, sf_dir):
    return aggregates.mode(table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderpriority")


@query("""WITH c AS (SELECT c_nationkey, c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL),
  r AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY n) AS i FROM c)
  SELECT c_nationkey, round(CASE WHEN sum(n) = 0 THEN 0.0 ELSE 2.0 * sum(i * n) / (count(*) * sum(n)) - (count(*) + 1.0) / count(*) END, 6) AS gini FROM r GROUP BY c_nationkey""")
def gini(spark, sf_dir):
    counts = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left").groupBy("c_nationkey", "c_custkey").agg(F.count("o_orderkey").alias("n"))
    return aggregates.gini(counts, ["c_nationkey"], "n").withColumn("gini", F.round("gini", 6))


@query("""WITH x AS (SELECT lang, n_chars, quality = 1 AS good FROM documents JOIN labels USING (doc_id)),
  r AS (SELECT *, rank() OVER (PARTITION BY lang ORDER BY n_chars) + (count(*) OVER (PARTITION BY lang, n_chars) - 1) / 2.0 AS rk FROM x),
  a AS (SELECT lang, sum(CASE WHEN good THEN rk ELSE 0 END) AS s, sum(CASE WHEN good THEN 1 ELSE 0 END) AS p, sum(CASE WHEN good THEN 0 ELSE 1 END) AS q FROM r GROUP BY lang)
  SELECT lang, round(CASE WHEN p > 0 AND q > 0 THEN (s - p * (p + 1) / 2.0) / (p * q) ELSE 0.5 END, 6) AS auc FROM a""")
def auc(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").withColumn("good", F.col("quality") == 1)
    return aggregates.auc(rows, ["lang"], "n_chars", "good").withColumn("auc", F.round("auc", 6))


@query("""WITH x AS (SELECT label, generate_subscripts(embedding, 1) AS place, unnest(embedding) AS v FROM embeddings)
  SELECT label, CAST(place - 1 AS INTEGER) AS place, round(avg(CAST(v AS DOUBLE)), 6) AS mean FROM x GROUP BY ALL""")
def vector_mean(spark, sf_dir):
    means = aggregates.vector_mean(table(spark, sf_dir, "embeddings"), ["label"], "embedding")
    return means.select("label", F.posexplode("mean").alias("place", "m")).select("label", "place", F.round("m", 6).alias("mean"))


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = joins.band_pairs(table(spark, sf_dir, "embeddings"), "vec_id", "vec_id", 120, ["embedding"]).withColumn("distance", sc.l2(F.col("a_embedding"), F.col("b_embedding")))
    return pairs.where("distance <= 1.19").select("a", "b", "distance")


@query("""SELECT a.vec_id AS a, b.vec_id AS b, round(list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS distance
  FROM embeddings a JOIN embeddings b ON b.vec_id > a.vec_id AND b.vec_id - a.vec_id <= 120
  WHERE list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) <= 1.19""")
def near_links(spark, sf_dir):
    """Links of vectors that stand at most 120 numbers apart."""
    return _links(spark, sf_dir).withColumn("distance", F.round("distance", 6))


@query()
def complete_linkage(spark, sf_dir):
    """Clusters in which every pair is linked, numbered by their smallest vector."""
    from ..operators import cluster

    return cluster.complete_linkage(cluster.connected(_links(spark, sf_dir)))


@query("""SELECT doc_id, bit_count(xor(doc_id * 2654435761, n_chars * 40503)) AS bits FROM documents""")
def hamming(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", sc.hamming(F.col("doc_id") * 2654435761, F.col("n_chars") * 40503).cast("int").alias("bits"))


@query(r"""WITH w AS (SELECT doc_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '')) AS ws FROM documents)
  SELECT a.doc_id, round(CASE WHEN len(list_distinct(list_concat(a.ws, b.ws))) > 0 THEN len(list_intersect(a.ws, b.ws)) * 1.0 / len(list_distinct(list_concat(a.ws, b.ws))) ELSE 0 END, 6) AS jaccard
  FROM w a JOIN w b ON b.doc_id = a.doc_id + 1""")
def jaccard(spark, sf_dir):
    """How alike the words of each document and the next are."""
    ws = table(spark, sf_dir, "documents").select("doc_id", sc.words(F.col("text")).alias("a"))
    after = ws.select((F.col("doc_id") - 1).alias("doc_id"), F.col("a").alias("b"))
    return ws.join(after, "doc_id").select("doc_id", F.round(sc.jaccard(F.col("a"), F.col("b")), 6).alias("jaccard"))


@query("""WITH c AS (SELECT event_id, user_id, epoch_us(ts) AS t FROM events WHERE event_type = 'click'), p AS (SELECT event_id AS buy_id, user_id, epoch_us(ts) AS u FROM events WHERE event_type = 'purchase'),
  j AS (SELECT event_id, buy_id, row_number() OVER (PARTITION BY event_id ORDER BY abs(t - u), buy_id) AS n FROM c JOIN p ON c.user_id = p.user_id AND t // 86400000000 = u // 86400000000)
  SELECT event_id, buy_id FROM j WHERE n = 1""")
def nearest_borrow(spark, sf_dir):
    """The purchase of the same user and day that is nearest to each click."""
    rows = events(spark, sf_dir)
    clicks = rows.where("event_type = 'click'").select("event_id", "user_id", "t")
    buys = events(spark, sf_dir).where("event_type = 'purchase'").select(F.col("event_id").alias("buy_id"), "user_id", F.col("t").alias("u"))
    return windows.nearest_same_bucket(clicks, buys, ["user_id"], "t", "u", "event_id", "buy_id", 24.0 * HOUR).select("event_id", "buy_id")


@query("""SELECT o_orderkey, c_custkey IS NOT NULL AS hit FROM orders LEFT JOIN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) ON o_custkey = c_custkey""")
def lookup_split(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey")
    hits, misses = joins.lookup_split(orders, table(spark, sf_dir, "customer").where("c_acctbal > 0").select("c_custkey"), ["c_custkey"])
    return hits.select("o_orderkey", F.lit(True).alias("hit")).unionByName(misses.select("o_orderkey", F.lit(False).alias("hit")))


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def anti_semi(spark, sf_dir):
    """Customers without an urgent order."""
    urgent = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return store.orphans(table(spark, sf_dir, "customer").select("c_custkey"), urgent, ["c_custkey"])


@query("""SELECT p_partkey, prefix FROM part JOIN (SELECT DISTINCT left(p_name, 3 + p_partkey % 3) AS prefix FROM part) ON starts_with(p_name, prefix)""")
def prefix_join(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    prefixes = table(spark, sf_dir, "part").select(F.expr("left(p_name, cast(3 + p_partkey % 3 as int))").alias("prefix")).distinct()
    return joins.prefix_join(part.select("p_partkey", "p_name"), "p_name", prefixes, "prefix").select("p_partkey", "prefix")


@query("""WITH a AS (SELECT c_nationkey AS k, count(*) AS n FROM customer WHERE c_acctbal > 5000 GROUP BY 1), b AS (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1)
  SELECT coalesce(a.k, b.k) AS k, a.n AS before_n, b.n AS after_n, CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'deleted' WHEN a.n = b.n THEN 'same' ELSE 'changed' END AS change FROM a FULL JOIN b ON a.k = b.k""")
def full_outer_diff(spark, sf_dir):
    a = table(spark, sf_dir, "customer").where("c_acctbal > 5000").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("n"))
    b = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("n"))
    return joins.difference(a, b, ["k"], ["n"])


@query("""WITH e AS (SELECT o_orderkey, CAST(epoch(o_orderdate) AS BIGINT) AS used, CAST(round(o_totalprice) AS BIGINT) AS size, o_orderpriority = '1-URGENT' AS pinned FROM orders),
  t AS (SELECT sum(size) AS total FROM e), l AS (SELECT *, sum(size) OVER (ORDER BY used, o_orderkey ROWS UNBOUNDED PRECEDING) AS up FROM e WHERE NOT pinned)
  SELECT o_orderkey, total - (up - size) > 1000000000 AS evict FROM l, t UNION ALL SELECT o_orderkey, false FROM e WHERE pinned""")
def lru_evict(spark, sf_dir):
    """Which orders leave a store of 1 GB, oldest first; urgent ones are pinned."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("used"), F.round("o_totalprice").cast("long").alias("size"), (F.col("o_orderpriority") == "1-URGENT").alias("pinned"))
    return selection.evictions(rows, "used", "o_orderkey", "size", "pinned", 1_000_000_000).select("o_orderkey", "evict")


@query("""WITH w AS (SELECT n_nationkey, count(o_orderkey) AS weight FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1),
  q AS (SELECT n_nationkey, i, weight / i AS v FROM w, range(1, 101) r(i) WHERE weight > 0), s AS (SELECT n_nationkey FROM q ORDER BY v DESC, n_nationkey, i LIMIT 100)
  SELECT w.n_nationkey, weight, (SELECT count(*) FROM s WHERE s.n_nationkey = w.n_nationkey) AS seats FROM w""")
def dhondt(spark, sf_dir):
    """A hundred seats for nations by their orders."""
    weights = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "customer"), F.col("n_nationkey") == F.col("c_nationkey"), "left").join(table(spark, sf_dir, "orders"), F.col("o_custkey") == F.col("c_custkey"), "left").groupBy("n_nationkey").agg(F.count("o_orderkey").alias("weight"))
    return selection.highest_averages(weights, "n_nationkey", "weight", 100)


@query("""WITH m AS (SELECT c_nationkey, avg(c_acctbal) AS merit FROM customer GROUP BY 1), b AS (SELECT list_sort(list(merit))[CAST(floor((count(*) - 1) / 2) AS INTEGER) + 1] AS bar FROM m),
  r AS (SELECT *, row_number() OVER (ORDER BY merit DESC, c_nationkey) AS place FROM m)
  SELECT c_nationkey, CASE WHEN merit < bar THEN 'brief' WHEN place <= 4 THEN 'featured' ELSE 'normal' END AS tier FROM r, b""")
def median_bar(spark, sf_dir):
    merits = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.avg("c_acctbal").alias("merit"))
    return selection.median_bar(merits, "c_nationkey", "merit", 4).select("c_nationkey", "tier")


@query("""SELECT c_nationkey, count(*) FILTER (c_acctbal >= 7500) AS featured, count(*) FILTER (c_acctbal >= 2500 AND c_acctbal < 7500) AS normal, count(*) FILTER (c_acctbal < 2500) AS brief FROM customer GROUP BY 1""")
def tier_counts(spark, sf_dir):
    tier = F.when(F.col("c_acctbal") >= 7500, "featured").when(F.col("c_acctbal") >= 2500, "normal").otherwise("brief")
    return table(spark, sf_dir, "customer").withColumn("tier", tier).groupBy("c_nationkey").pivot("tier", ["featured", "normal", "brief"]).count().na.fill(0)


@query("""WITH a AS (SELECT user_id, avg(value) AS v FROM events WHERE ts < TIMESTAMP '2024-01-15' GROUP BY 1), b AS (SELECT user_id, avg(value) AS v FROM events WHERE ts >= TIMESTAMP '2024-01-15' GROUP BY 1)
  SELECT a.user_id FROM a JOIN b USING (user_id) WHERE NOT a.v >= 50 AND b.v >= 50""")
def rank_delta(spark, sf_dir):
    """Users whose mean value rose to 50 in the second half."""
    rows = table(spark, sf_dir, "events")
    half = lambda test: rows.where(test).groupBy("user_id").agg(F.avg("value").alias("v"))
    return joins.risen(half("ts < TIMESTAMP_NTZ '2024-01-15'"), half("ts >= TIMESTAMP_NTZ '2024-01-15'"), "user_id", "v", F.col("v") >= 50)


RULES = [("large", "block", "l_quantity > 48"), ("deep_discount", "warn", "l_discount >= 0.1"), ("no_tax", "warn", "l_tax = 0"), ("returned", "block", "l_returnflag = 'R' AND l_quantity > 45")]


@query("""SELECT l_orderkey, l_linenumber, r.rule, r.severity FROM (SELECT l_orderkey, l_linenumber, unnest(list_filter([
    CASE WHEN l_quantity > 48 THEN {'rule': 'large', 'severity': 'block'} END, CASE WHEN l_discount >= 0.1 THEN {'rule': 'deep_discount', 'severity': 'warn'} END,
    CASE WHEN l_tax = 0 THEN {'rule': 'no_tax', 'severity': 'warn'} END, CASE WHEN l_returnflag = 'R' AND l_quantity > 45 THEN {'rule': 'returned', 'severity': 'block'} END], lambda x: x IS NOT NULL)) AS r FROM lineitem)""")
def findings(spark, sf_dir):
    return rules.findings(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], [(n, s, F.expr(t)) for n, s, t in RULES])


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 48 THEN 'large' WHEN l_discount >= 0.1 THEN 'deep_discount' WHEN l_tax = 0 THEN 'no_tax' WHEN l_returnflag = 'R' AND l_quantity > 45 THEN 'returned' END AS rule FROM lineitem""")
def first_broken(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", rules.first_broken([(n, s, F.expr(t)) for n, s, t in RULES]).alias("rule"))


@query("""WITH d AS (SELECT user_id, CASE WHEN value < lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) THEN 1 ELSE 0 END AS down FROM events)
  SELECT user_id, count(*) AS n, CAST(sum(down) AS BIGINT) AS inversions FROM d GROUP BY 1""")
def inversions(spark, sf_dir):
    return windows.inversions(table(spark, sf_dir, "events"), ["user_id"], [F.col("ts"), F.col("event_id")], "value")


@query(r"""WITH w AS (SELECT doc_id, list_distinct(regexp_split_to_array(lower(text), '[^a-z0-9]+')) AS ws FROM documents),
  s AS (SELECT doc_id, len(list_intersect(['the', 'license', 'apache', 'thing'], ws)) AS score FROM w)
  SELECT doc_id, CAST(score AS INTEGER) AS score FROM s WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 10""")
def keyword_search(spark, sf_dir):
    """The ten best matches of a few words (a top-k report)."""
    return search.keyword_search(table(spark, sf_dir, "documents"), "the licenses, Apache things", sc.words(F.col("text")), [F.col("doc_id")], 10).select("doc_id", "score")


@query("""SELECT p_brand, p_partkey, CAST((n - 1) // 4 AS INTEGER) AS chunk, CAST((n - 1) % 4 AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS n FROM part)""")
def chunk_rows(spark, sf_dir):
    return windows.chunks(table(spark, sf_dir, "part"), ["p_brand"], [F.col("p_partkey")], 4).select("p_brand", "p_partkey", "chunk", "place")


@query("""WITH r AS (SELECT o_custkey, min(o_orderdate) AS a, max(o_orderdate) AS b FROM orders GROUP BY 1)
  SELECT o_custkey, CASE WHEN CAST(a AS DATE) = CAST(b AS DATE) THEN strftime(a, '%-d %b %Y') WHEN strftime(a, '%Y%m') = strftime(b, '%Y%m') THEN strftime(a, '%-d') || '-' || strftime(b, '%-d %b %Y')
    WHEN strftime(a, '%Y') = strftime(b, '%Y') THEN strftime(a, '%-d %b') || ' - ' || strftime(b, '%-d %b %Y') ELSE strftime(a, '%-d %b %Y') || ' - ' || strftime(b, '%-d %b %Y') END AS label FROM r""")
def date_label(spark, sf_dir):
    ranges = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min("o_orderdate").cast("timestamp").alias("a"), F.max("o_orderdate").cast("timestamp").alias("b"))
    return ranges.select("o_custkey", sc.date_range(F.col("b"), F.col("a")).alias("label"))


@query("""SELECT user_id, event_id, CAST(age AS INTEGER) AS age FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS age FROM events) WHERE age <= 50""")
def history_last_k(spark, sf_dir):
    return windows.last_versions(table(spark, sf_dir, "events"), ["user_id"], [F.desc("event_id")], 50).select("user_id", "event_id", "age")


@query("""WITH s AS (SELECT l_returnflag, list_sort(list(l_extendedprice)) AS v FROM lineitem GROUP BY 1)
  SELECT l_returnflag, v[CAST(round((len(v) - 1) * 0.1) AS BIGINT) + 1] AS p10, v[CAST(round((len(v) - 1) * 0.5) AS BIGINT) + 1] AS p50, v[CAST(round((len(v) - 1) * 0.9) AS BIGINT) + 1] AS p90 FROM s""")
def nearest_rank_pct(spark, sf_dir):
    return aggregates.nearest_rank(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice", [0.1, 0.5, 0.9])


LAT, LON = "(c_custkey * 37 % 1700) / 10.0 - 85.0", "(c_custkey * 101 % 3590) / 10.0 - 179.0"


@query(f"""WITH p AS (SELECT c_custkey, radians({LAT}) AS la, radians({LON}) AS lo FROM customer)
  SELECT a.c_custkey, round(2 * 6371.0088 * asin(least(1.0, sqrt(pow(sin((b.la - a.la) / 2), 2) + cos(a.la) * cos(b.la) * pow(sin((b.lo - a.lo) / 2), 2)))), 3) AS km FROM p a JOIN p b ON b.c_custkey = a.c_custkey + 1""")
def haversine(spark, sf_dir):
    """Kilometres from each customer's made-up place to the next one's."""
    places = table(spark, sf_dir, "customer").select("c_custkey", F.expr(LAT).cast("double").alias("lat"), F.expr(LON).cast("double").alias("lon"))
    after = places.select((F.col("c_custkey") - 1).alias("c_custkey"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    return places.join(after, "c_custkey").select("c_custkey", F.round(sc.haversine(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2")), 3).alias("km"))


@query(f"""WITH p AS (SELECT c_nationkey, radians({LAT}) AS la, radians({LON}) AS lo FROM customer), s AS (SELECT c_nationkey, sum(cos(la) * cos(lo)) AS x, sum(cos(la) * sin(lo)) AS y, sum(sin(la)) AS z FROM p GROUP BY 1)
  SELECT c_nationkey, round(degrees(asin(z / sqrt(x * x + y * y + z * z))), 4) AS lat, round(degrees(atan2(y, x)), 4) AS lon FROM s WHERE sqrt(x * x + y * y + z * z) >= 1e-9""")
def spherical_centroid(spark, sf_dir):
    places = table(spark, sf_dir, "customer").select("c_nationkey", F.expr(LAT).cast("double").alias("lat"), F.expr(LON).cast("double").alias("lon"))
    found = aggregates.spherical_centroid(places, ["c_nationkey"], "lat", "lon").where("lat IS NOT NULL")
    return found.select("c_nationkey", F.round("lat", 4).alias("lat"), F.round("lon", 4).alias("lon"))


@query("""WITH d AS (SELECT DISTINCT user_id, epoch_us(ts) // 86400000000 AS day FROM events), b AS (SELECT *, CASE WHEN day - lag(day) OVER (PARTITION BY user_id ORDER BY day) > 2 THEN 1 ELSE 0 END AS brk FROM d),
  i AS (SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY day ROWS UNBOUNDED PRECEDING) AS run FROM b)
  SELECT user_id, CAST(run AS BIGINT) AS run, min(day) AS first_day, max(day) AS last_day FROM i GROUP BY user_id, run""")
def day_runs(spark, sf_dir):
    """Runs of days with events, bridging gaps of one day."""
    days = events(spark, sf_dir).select("user_id", sc.day_number(F.col("t") / 1_000_000).alias("day")).distinct()
    return windows.islands(days, ["user_id"], "day", 1, "run").groupBy("user_id", "run").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"))


@query("""SELECT l_suppkey, min(l_orderkey * 10 + l_linenumber) AS first_at FROM lineitem GROUP BY 1""")
def ordered_distinct(spark, sf_dir):
    return windows.ordered_distinct(table(spark, sf_dir, "lineitem"), "l_suppkey", F.col("l_orderkey") * 10 + F.col("l_linenumber"))


@query("""SELECT o_orderkey, 'p' || lpad(CAST(o_orderkey % 90 AS VARCHAR), 2, '0') || '-z' || CAST(o_custkey % 4 AS VARCHAR) || '-' || left(sha256(CAST(o_orderkey AS VARCHAR)), 8) AS name FROM orders""")
def export_names(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return orders.select("o_orderkey", sc.file_name(F.col("o_orderkey") % 90, F.col("o_custkey") % 4, F.sha2(F.col("o_orderkey").cast("string"), 256)).alias("name"))


@query("""WITH w AS (SELECT p_partkey, 600 + p_partkey * 7 % 900 AS w, 500 + p_partkey * 13 % 700 AS h, (p_partkey * 17 % 101) / 100.0 AS fx, (p_partkey * 29 % 101) / 100.0 AS fy FROM part),
  a AS (SELECT *, w * 1.0 / h AS asp FROM w), c AS (SELECT *, CASE WHEN asp > 1.5 THEN 1.5 / asp ELSE 1.0 END AS cw, CASE WHEN asp > 1.5 THEN 1.0 ELSE asp / 1.5 END AS ch FROM a)
  SELECT p_partkey, round(greatest(0.0, least(1 - cw, fx - cw / 2)), 6) AS x, round(greatest(0.0, least(1 - ch, fy - ch / 2)), 6) AS y, round(cw, 6) AS w, round(ch, 6) AS h, round(least(asp, 1.5) / greatest(asp, 1.5), 6) AS fit FROM c""")
def crop_choice(spark, sf_dir):
    """Crops of made-up pictures to 3:2 around made-up points of interest."""
    k = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select("p_partkey", (600 + k * 7 % 900).alias("w"), (500 + k * 13 % 700).alias("h"), ((k * 17 % 101) / 100.0).alias("fx"), ((k * 29 % 101) / 100.0).alias("fy"))
    rows = rows.withColumn("c", geo.choose_crop(F.col("w"), F.col("h"), F.lit(1.5), F.col("fx"), F.col("fy")))
    return rows.select("p_partkey", *[F.round(f"c.{n}", 6).alias(n) for n in "xywh"], F.round(geo.aspect_fit(F.col("w") / F.col("h"), F.lit(1.5)), 6).alias("fit"))


@query("""WITH n AS (SELECT o_orderkey, o_custkey, o_totalprice * 2 AS o_totalprice FROM orders WHERE o_orderkey % 10 = 0 UNION ALL SELECT o_orderkey + 10000000, o_custkey, 1.0 FROM orders WHERE o_orderkey % 10 = 1)
  SELECT o_orderkey, o_custkey, round(o_totalprice, 2) AS o_totalprice FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM n) UNION ALL SELECT o_orderkey, o_custkey, round(o_totalprice, 2) FROM n""")
def upsert(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    changed = orders.where("o_orderkey % 10 = 0").withColumn("o_totalprice", F.col("o_totalprice") * 2)
    added = orders.where("o_orderkey % 10 = 1").withColumn("o_orderkey", F.col("o_orderkey") + 10000000).withColumn("o_totalprice", F.lit(1.0))
    out = store.upserted(orders, changed.unionByName(added), ["o_orderkey"])
    return out.withColumn("o_totalprice", F.round("o_totalprice", 2))


@query("""WITH k AS (SELECT o_custkey, o_orderkey, o_totalprice, o_orderstatus, CASE WHEN o_orderkey % 23 = 0 THEN 'exclude' WHEN o_orderkey % 31 = 0 THEN 'include' ELSE 'auto' END AS state FROM orders),
  c AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM k WHERE state = 'auto' AND o_orderstatus <> 'P')
  SELECT o_orderkey FROM c WHERE n = 1 UNION ALL SELECT o_orderkey FROM k WHERE state = 'include'""")
def cull(spark, sf_dir):
    """One order of each customer, with overrides; pending ones are skipped."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderstatus")
    state = F.when(F.col("o_orderkey") % 23 == 0, "exclude").when(F.col("o_orderkey") % 31 == 0, "include")
    overrides = table(spark, sf_dir, "orders").select("o_orderkey", state.alias("state")).where("state IS NOT NULL")
    return selection.cull(orders, "o_custkey", [F.desc("o_totalprice"), F.col("o_orderkey")], F.col("o_orderstatus") == "P", overrides, "o_orderkey").select("o_orderkey")


@query("""WITH s AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) SELECT user_id, event_type, round(CASE WHEN max(n) OVER (PARTITION BY user_id) = 0 THEN 0 ELSE n * 1.0 / max(n) OVER (PARTITION BY user_id) END, 6) AS bar FROM s""")
def event_bars(spark, sf_dir):
    """Counts of a user's events as shares of the largest."""
    counts = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    most = F.max("n").over(W.partitionBy("user_id"))
    return counts.select("user_id", "event_type", F.round(F.when(most == 0, 0.0).otherwise(F.col("n") / most), 6).alias("bar"))


@query("""WITH k AS (SELECT p_brand, least(3, floor((p_partkey % 97) / 97.0 * 4)) AS r, least(3, floor((p_partkey % 89) / 89.0 * 4)) AS g, least(3, floor((p_partkey % 83) / 83.0 * 4)) AS b FROM part),
  c AS (SELECT p_brand, CAST((r * 4 + g) * 4 + b AS BIGINT) AS cell, count(*) AS n FROM k GROUP BY ALL), t AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, cell) AS rank FROM c)
  SELECT p_brand, cell, rank, round(n * 1.0 / sum(n) OVER (PARTITION BY p_brand), 6) AS weight FROM t WHERE rank <= 6""")
def palette(spark, sf_dir):
    """The main colour cells of each brand's made-up colours."""
    k = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select("p_brand", (k % 97 / 97.0).alias("r"), (k % 89 / 89.0).alias("g"), (k % 83 / 83.0).alias("b"))
    return aggregates.palette(rows, ["p_brand"], "r", "g", "b").select("p_brand", F.col("cell").cast("long").alias("cell"), "rank", F.round("weight", 6).alias("weight"))


@query("""SELECT o_orderkey, CASE WHEN c.c_custkey IS NOT NULL THEN 'known' WHEN s.s_suppkey IS NOT NULL THEN 'failed' ELSE 'new' END AS state FROM orders
  LEFT JOIN (SELECT c_custkey FROM customer WHERE c_acctbal > 3000) c ON o_custkey = c.c_custkey LEFT JOIN supplier s ON o_custkey = s.s_suppkey""")
def photo_state(spark, sf_dir):
    """Known, failed or new, with that precedence."""
    scan = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("key"))
    known = table(spark, sf_dir, "customer").where("c_acctbal > 3000").select(F.col("c_custkey").alias("key"))
    failed = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"))
    return joins.state_of(scan, known, failed, "key").select("o_orderkey", "state")


@query(f"""WITH c AS (SELECT c_nationkey, CAST(round(({LAT}) / 10) AS INTEGER) AS la, CAST(round(({LON}) / 10) AS INTEGER) AS lo FROM customer), n AS (SELECT c_nationkey, la, lo, count(*) AS n FROM c GROUP BY ALL)
  SELECT c_nationkey, la, lo, n FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY n DESC, la DESC, lo DESC) AS place FROM n) WHERE place = 1""")
def busiest_cell(spark, sf_dir):
    """The cell of ten degrees with most customers of each nation; ties to the greatest cell."""
    cells = table(spark, sf_dir, "customer").select("c_nationkey", F.struct(F.round(F.expr(f"cast(({LAT}) as double)") / 10).cast("int").alias("la"), F.round(F.expr(f"cast(({LON}) as double)") / 10).cast("int").alias("lo")).alias("cell"))
    return aggregates.mode(cells, ["c_nationkey"], "cell").select("c_nationkey", "cell.la", "cell.lo", F.col("votes").alias("n"))


@query("SELECT o_custkey, CASE WHEN count(DISTINCT o_orderstatus) > 1 THEN 'mixed' ELSE coalesce(min(o_orderstatus), '') END AS label FROM orders GROUP BY 1")
def format_label(spark, sf_dir):
    """The one status of a customer's orders, or mixed."""
    low, high = F.min("o_orderstatus"), F.max("o_orderstatus")
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.when(low != high, "mixed").otherwise(F.coalesce(low, F.lit(""))).alias("label"))


@query("""SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_discount, l_tax, l_linenumber) AS place FROM lineitem""")
def reading_order(spark, sf_dir):
    """Slots of each page by x, then y."""
    place = F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_discount", "l_tax", "l_linenumber"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", place.alias("place"))


@query("""SELECT a.l_orderkey, a.l_linenumber AS a, b.l_linenumber AS b,
    round((least(a.l_discount + 0.05, b.l_discount + 0.05) - greatest(a.l_discount, b.l_discount)) * (least(a.l_tax + 0.05, b.l_tax + 0.05) - greatest(a.l_tax, b.l_tax)), 6) AS area
  FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber
  WHERE least(a.l_discount + 0.05, b.l_discount + 0.05) - greatest(a.l_discount, b.l_discount) > 0.000001 AND least(a.l_tax + 0.05, b.l_tax + 0.05) - greatest(a.l_tax, b.l_tax) > 0.000001""")
def overlaps(spark, sf_dir):
    """Pairs of boxes of one page that overlap; discounts and taxes are their corners."""
    box = geo.rect(F.col("l_discount"), F.col("l_tax"), F.lit(0.05), F.lit(0.05))
    rows = lambda n: table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").alias(n), box.alias(f"box_{n}"))
    pairs = rows("a").join(rows("b"), "l_orderkey").where("a < b").withColumn("shared", geo.intersect(F.col("box_a"), F.col("box_b")))
    return pairs.where("shared.w > 0.000001 AND shared.h > 0.000001").select("l_orderkey", "a", "b", F.round(geo.area(F.col("shared")), 6).alias("area"))


@query("SELECT l_orderkey, l_linenumber, round(l_quantity / sum(l_quantity) OVER (PARTITION BY l_orderkey), 6) AS weight FROM lineitem")
def normalised_weights(spark, sf_dir):
    total = F.sum("l_quantity").over(W.partitionBy("l_orderkey"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(F.col("l_quantity") / total, 6).alias("weight"))


@query("""SELECT n_nationkey, count(s_suppkey) AS n, n_nationkey IN (SELECT s_nationkey FROM supplier GROUP BY 1 HAVING count(*) >= 2) AS enough FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1""")
def placed_per_event(spark, sf_dir):
    """Suppliers of every nation, also of those without any, against a floor of two."""
    counts = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "supplier"), F.col("n_nationkey") == F.col("s_nationkey"), "left").groupBy("n_nationkey").agg(F.count("s_suppkey").alias("n"))
    return counts.withColumn("enough", F.col("n") >= 2)


@query("""WITH l AS (SELECT user_id, event_id, event_type, lag(event_type) OVER w AS p, lag(event_type, 2) OVER w AS q FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
  SELECT user_id, event_id, event_type IS DISTINCT FROM p AS varied, coalesce(event_type = p AND p = q, false) AS third FROM l""")
def variety(spark, sf_dir):
    """Whether an event differs from the one before, and whether it is the third of its type in a row."""
    order = W.partitionBy("user_id").orderBy("ts", "event_id")
    one, two = F.lag("event_type").over(order), F.lag("event_type", 2).over(order)
    same = F.coalesce((F.col("event_type") == one) & (one == two), F.lit(False))
    return table(spark, sf_dir, "events").select("user_id", "event_id", (~F.col("event_type").eqNullSafe(one)).alias("varied"), same.alias("third"))


@query("""WITH n AS (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS n FROM part)
  SELECT p_brand, 0 AS line, CAST(count(*) AS VARCHAR) AS cells FROM n GROUP BY 1 UNION ALL
  SELECT p_brand, CAST(n // 5 + 1 AS INTEGER), string_agg(CAST(p_partkey AS VARCHAR), ',' ORDER BY n) FROM n GROUP BY p_brand, n // 5""")
def sheet_rows(spark, sf_dir):
    """A header line with the number of parts of each brand, and lines of five parts."""
    rows = windows.chunks(table(spark, sf_dir, "part"), ["p_brand"], [F.col("p_partkey")], 5)
    head = rows.groupBy("p_brand").agg(F.lit(0).alias("line"), F.count("*").cast("string").alias("cells"))
    cells = F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct("place", "p_partkey"))), lambda s: s["p_partkey"].cast("string")))
    lines = rows.groupBy("p_brand", "chunk").agg(cells.alias("cells")).select("p_brand", (F.col("chunk") + 1).alias("line"), "cells")
    return head.unionByName(lines)


@query("""WITH f AS (SELECT o_custkey, o_orderpriority, min(o_orderkey) AS first_at FROM orders GROUP BY ALL)
  SELECT o_custkey, o_orderpriority, place FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY first_at) AS place FROM f) WHERE place <= 3""")
def first_seen(spark, sf_dir):
    """The first three priorities that each customer used."""
    first = table(spark, sf_dir, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.min("o_orderkey").alias("first_at"))
    place = F.row_number().over(W.partitionBy("o_custkey").orderBy("first_at"))
    return first.withColumn("place", place).where("place <= 3").select("o_custkey", "o_orderpriority", "place")


@query("""WITH c AS (SELECT count(*) AS n FROM customer), o AS (SELECT count(DISTINCT o_custkey) AS n FROM orders) SELECT c.n AS known, o.n AS placed, greatest(0, c.n - o.n) AS left_out FROM c, o""")
def funnel(spark, sf_dir):
    """Customers in all, those with orders, and the others."""
    known = table(spark, sf_dir, "customer").agg(F.count("*").alias("known"))
    placed = table(spark, sf_dir, "orders").agg(F.countDistinct("o_custkey").alias("placed"))
    both = known.withColumn("one", F.lit(1)).join(placed.withColumn("one", F.lit(1)), "one")
    return both.select("known", "placed", F.greatest(F.lit(0), F.col("known") - F.col("placed")).alias("left_out"))


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as records: a label's vectors follow each other by a second, one label has no time."""
    rows = table(spark, sf_dir, "embeddings")
    at = F.when(F.col("label") != 3, F.col("vec_id") + F.col("label") * 86_400)
    place = lambda i: F.element_at("embedding", i).cast("double")
    hashed = (F.col("vec_id") * 2654435761).bitwiseAND(1048575)
    few = lambda n: F.pmod("vec_id", F.lit(n))
    extra = [F.when(few(7) == 0, (few(3) - 1) * 3600).alias("offset"), F.when(few(3) > 0, few(3) * 0.25).alias("quality"), F.when(few(11) == 0, 0.95).otherwise(0.1).alias("clipped_low"), F.when(few(13) == 0, 0.92).otherwise(0.0).alias("clipped_high"), (few(17) == 0).alias("refused")]
    return rows.select(*extra, F.format_string("/%08d", "vec_id").alias("path"), "vec_id", at.alias("at"), F.col("embedding").alias("print"), hashed.alias("phash"), F.round(place(1), 1).alias("aesthetic"), F.round(place(2), 1).alias("sharpness"), F.slice("embedding", 1, F.pmod("vec_id", F.lit(4)).cast("int")).alias("faces"), (place(3) > 0.3).alias("is_utility"))


#: Vectors here are farther apart than pictures' are, so limits are wider.
WIDE = {"close": 1.0, "near": 1.19, "most_bits": 7}
LINKED = """r AS (SELECT vec_id, CASE WHEN label <> 3 THEN vec_id + label * 86400 END AS t, CAST(embedding AS DOUBLE[]) AS e, (vec_id * 2654435761) & 1048575 AS h FROM embeddings),
  p AS (SELECT a.vec_id AS x, b.vec_id AS y, list_distance(a.e, b.e) AS d, bit_count(xor(a.h, b.h)) AS bits FROM r a JOIN r b ON b.vec_id > a.vec_id AND coalesce(abs(a.t - b.t), 0) <= 120),
  l AS (SELECT * FROM p WHERE d <= 1.0 OR (bits <= 7 AND d <= 1.19))"""


@query(f"WITH {LINKED} SELECT x AS a, y AS b, round(d, 6) AS distance FROM l")
def similar_links(spark, sf_dir):
    """Near-duplicates by vector, or by hash and vector, within two minutes; undated rows meet all others."""
    links = finalize.similar_links(_records(spark, sf_dir), "vec_id", "at", "print", "phash", **WIDE)
    return links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.round("distance", 6).alias("distance"))


@query(f"""WITH RECURSIVE {LINKED}, b AS (SELECT x, y FROM l UNION SELECT y, x FROM l), c AS (SELECT x AS node, x AS reached FROM b UNION SELECT c.node, b.y FROM c JOIN b ON b.x = c.reached)
  SELECT node, min(reached) AS component FROM c GROUP BY node""")
def link_components(spark, sf_dir):
    """The connected components that near-duplicates form."""
    from ..operators import cluster

    return cluster.components(finalize.similar_links(_records(spark, sf_dir), "vec_id", "at", "print", "phash", **WIDE))


@query("""WITH RECURSIVE r AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS i, vec_id, CASE WHEN label <> 3 THEN vec_id + label * 86400 END AS w, CASE WHEN vec_id % 7 = 0 THEN (vec_id % 3 - 1) * 3600 END AS o,
    CAST(embedding AS DOUBLE[]) AS e, (vec_id * 2654435761) & 1048575 AS h, round(embedding[1]::DOUBLE, 1) AS aes, round(embedding[2]::DOUBLE, 1) AS sharp FROM embeddings),
  k AS (SELECT a.i, coalesce(a.o, (SELECT arg_min(b.o, abs(b.w - a.w) * 1000000 + b.i) FROM r b WHERE b.o IS NOT NULL AND b.w // 86400 = a.w // 86400)) AS o FROM r a WHERE a.w IS NOT NULL),
  t AS (SELECT r.*, k.o AS utc, w - coalesce(k.o, 0) AS t FROM r LEFT JOIN k USING (i)),
  p AS (SELECT a.i AS x, b.i AS y, list_distance(a.e, b.e) AS d, bit_count(xor(a.h, b.h)) AS bits FROM t a JOIN t b ON b.i > a.i AND coalesce(abs(a.t - b.t), 0) <= 120),
  l AS (SELECT x, y, row_number() OVER (ORDER BY d, x, y) AS k FROM p WHERE d <= 1.0 OR (bits <= 7 AND d <= 1.19)),
  n AS (SELECT (SELECT count(*) FROM r) AS n, (SELECT list(x * 1000000 + y) FROM l) AS pairs),
  c(k, c) AS (SELECT 0, range(n) FROM n UNION ALL SELECT l.k, CASE WHEN c[x + 1] <> c[y + 1] AND
      len(list_filter(pairs, lambda q: (c[q // 1000000 + 1] = c[x + 1] AND c[q % 1000000 + 1] = c[y + 1]) OR (c[q // 1000000 + 1] = c[y + 1] AND c[q % 1000000 + 1] = c[x + 1]))) = len(list_filter(c, lambda q: q = c[x + 1])) * len(list_filter(c, lambda q: q = c[y + 1]))
      THEN list_transform(c, lambda q: CASE WHEN q = c[y + 1] THEN c[x + 1] ELSE q END) ELSE c END FROM c JOIN l ON l.k = c.k + 1, n),
  m AS (SELECT unnest(c) AS c, unnest(range(len(c))) AS i FROM c ORDER BY k DESC LIMIT (SELECT count(*) FROM r)),
  f AS (SELECT i, min(i) OVER (PARTITION BY c) AS first FROM m),
  g AS (SELECT *, dense_rank() OVER (ORDER BY first) - 1 AS cluster FROM f JOIN t USING (i)),
  b AS (SELECT *, CASE WHEN t - lag(t) OVER (ORDER BY t, i) > 14400 THEN 1 ELSE 0 END AS brk FROM g WHERE t IS NOT NULL),
  v AS (SELECT i, CAST(sum(brk) OVER (ORDER BY t, i) AS BIGINT) AS event FROM b),
  s AS (SELECT g.*, coalesce(event, (SELECT max(event) + 1 FROM v)) AS event, CAST(round(100.0 * count(*) OVER (ORDER BY aes) / count(*) OVER ()) AS INT) AS aes_pct, CAST(round(100.0 * count(*) OVER (ORDER BY sharp) / count(*) OVER ()) AS INT) AS sharp_pct,
    e[3] > 0.3 OR vec_id % 17 = 0 AS skip, vec_id % 11 = 0 OR vec_id % 13 = 0 AS dark, CASE WHEN vec_id % 3 > 0 THEN vec_id % 3 * 0.25 ELSE -1 END AS q FROM g LEFT JOIN v USING (i)),
  z AS (SELECT *, row_number() OVER (PARTITION BY cluster, skip ORDER BY dark, sharp_pct DESC, q DESC, aes_pct DESC, i) AS place FROM s)
  SELECT printf('/%08d', vec_id) AS path, cluster AS near_dup_cluster, event AS event_cluster, aes_pct AS aesthetic_pct, sharp_pct AS sharpness_pct, CAST(vec_id % 4 AS INT) AS face_count, utc AS utc_offset_sec, NOT skip AND place = 1 AS kept FROM z""")
def finalized(spark, sf_dir):
    """All that a set of records derives as a whole."""
    out = finalize.finalized(_records(spark, sf_dir), offset="offset", quality="quality", clipped=("clipped_low", "clipped_high"), refused="refused", **WIDE)
    return out.select("path", "near_dup_cluster", F.col("event_cluster").cast("long").alias("event_cluster"), "aesthetic_pct", "sharpness_pct", "face_count", "utc_offset_sec", "kept")


SPEC = pr.PrintSpec(11.0, 8.5, 0.125, 0.5, 0.25, 200, 300)
SLOTS = """s AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 2 = 0 THEN 'left' ELSE 'right' END AS side, (l_partkey % 13) / 16.0 AS x, (l_suppkey % 11) / 16.0 AS y, (1 + l_quantity % 6) / 16.0 AS w, (1 + l_quantity % 5) / 16.0 AS h FROM lineitem),
  k AS (SELECT *, x + w AS r, y + h AS b, 0.125 / 11.0 AS u, 0.125 / 8.5 AS v, 0.25 / 11.0 AS su, 0.25 / 8.5 AS sv, 0.5 / 11.0 AS g FROM s)"""


def _slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").withColumn("side", F.when(F.col("l_linenumber") % 2 == 0, "left").otherwise("right"))
    q = F.col("l_quantity").cast("double")
    return rows.withColumn("slot", pr.rect(F.col("l_partkey") % 13 / 16, F.col("l_suppkey") % 11 / 16, (1 + q % 6) / 16, (1 + q % 5) / 16))


@query(f"""WITH {SLOTS} SELECT l_orderkey, l_linenumber,
  y >= v - 1e-9 AND b <= 1 - v + 1e-9 AND CASE WHEN side = 'left' THEN x >= u - 1e-9 AND r <= 1 + 1e-9 ELSE x >= -1e-9 AND r <= 1 - u + 1e-9 END AS in_trim,
  y >= v + sv - 1e-9 AND b <= 1 - v - sv + 1e-9 AND CASE WHEN side = 'left' THEN x >= u + su - 1e-9 AND r <= 1 + 1e-9 ELSE x >= -1e-9 AND r <= 1 - u - su + 1e-9 END AS in_safe,
  CASE WHEN side = 'left' THEN r <= 1 - g + 1e-9 ELSE x >= g - 1e-9 END AS clear,
  round(greatest(0, CASE WHEN side = 'left' THEN least(r, 1) - greatest(x, 1 - g) ELSE least(r, g) - greatest(x, 0) END) * greatest(0, least(b, 1) - y), 6) AS in_fold,
  round(w * 11.0 / (h * 8.5), 6) AS aspect FROM k""")
def page_geometry(spark, sf_dir):
    """Trim, safe area, fold and aspect of slots."""
    rows, slot, side = _slots(spark, sf_dir), F.col("slot"), F.col("side")
    checks = {"in_trim": pr.in_trim(SPEC, slot, side), "in_safe": pr.in_safe_margin(SPEC, slot, side), "clear": pr.clear_of_gutter(SPEC, slot, side), "in_fold": F.round(pr.gutter_overlap_area(SPEC, slot, side), 6), "aspect": F.round(pr.slot_aspect(SPEC, slot), 6)}
    return rows.select("l_orderkey", "l_linenumber", *[c.alias(n) for n, c in checks.items()])


@query(f"""WITH {SLOTS}, d AS (SELECT *, CASE WHEN side = 'left' THEN x ELSE 1 - r END AS outer_, CASE WHEN side = 'left' THEN 1 - r ELSE x END AS fold,
    CASE WHEN side = 'left' THEN u ELSE g END AS lo, CASE WHEN side = 'left' THEN 1 - g ELSE 1 - u END AS hi FROM k)
  SELECT l_orderkey, l_linenumber, concat_ws(',', CASE WHEN outer_ > 1e-6 AND outer_ < u - 1e-6 THEN 'bleed ' || side END, CASE WHEN y > 1e-6 AND y < v - 1e-6 THEN 'bleed top' END,
    CASE WHEN 1 - b > 1e-6 AND 1 - b < v - 1e-6 THEN 'bleed bottom' END, CASE WHEN fold > 1e-6 AND fold < g - 1e-6 THEN 'gutter' END,
    CASE WHEN least(r, hi) - greatest(x, lo) < 0.05 - 1e-6 OR least(b, 1 - v) - greatest(y, v) < 0.05 - 1e-6 THEN 'hidden' END) AS broken,
    CASE WHEN x < -1e-6 OR y < -1e-6 OR r > 1 + 1e-6 OR b > 1 + 1e-6 THEN 'off canvas' WHEN w < 0.05 - 1e-6 OR h < 0.05 - 1e-6 THEN 'too small' ELSE 'good' END AS problem FROM d""")
def print_rules(spark, sf_dir):
    """The print rules and the structural rule that each slot breaks."""
    rows, slot = _slots(spark, sf_dir), F.col("slot")
    return rows.select("l_orderkey", "l_linenumber", F.concat_ws(",", pr.findings(SPEC, slot, F.col("side"))).alias("broken"), F.coalesce(pr.box_problem(slot), F.lit("good")).alias("problem"))


@query(f"""WITH {SLOTS} SELECT a.l_orderkey, a.l_linenumber AS slot, b.l_linenumber AS other FROM k a JOIN k b ON a.l_orderkey = b.l_orderkey AND a.side = b.side AND a.l_linenumber < b.l_linenumber
  WHERE least(a.r, b.r) - greatest(a.x, b.x) > 0.0005 + 1e-6 AND least(a.b, b.b) - greatest(a.y, b.y) > 0.0005 + 1e-6""")
def overlapping_boxes(spark, sf_dir):
    """Slots of an order's page that overlap."""
    a = _slots(spark, sf_dir).select("l_orderkey", "side", F.col("l_linenumber").alias("slot"), F.col("slot").alias("a"))
    b = _slots(spark, sf_dir).select("l_orderkey", "side", F.col("l_linenumber").alias("other"), F.col("slot").alias("b"))
    return a.join(b, ["l_orderkey", "side"]).where((F.col("slot") < F.col("other")) & pr.overlapping(F.col("a"), F.col("b"))).select("l_orderkey", "slot", "other")


@query(f"""WITH {SLOTS}, f AS (SELECT *, 400 + (l_orderkey % 30) * 100 AS px, 0.1 AS cx, 0.9 AS cr, (l_orderkey % 10) / 10.0 AS fx, (l_orderkey % 10) / 10.0 + 0.1 AS fr, (l_linenumber % 9) / 10.0 AS fy FROM k),
  m AS (SELECT *, fx >= cx - 1e-9 AND fr <= cr + 1e-9 AS inside, least(fr, cr) - greatest(fx, cx) > 0 AS met, x + (fx - cx) * w / 0.8 AS px0, x + (fr - cx) * w / 0.8 AS px1, y + fy * h AS py0, y + (fy + 0.1) * h AS py1 FROM f)
  SELECT l_orderkey, l_linenumber, CASE WHEN px * 0.8 / (w * 11.0) < 200 THEN 'resolution' WHEN NOT inside AND met THEN 'clipped' WHEN NOT inside THEN 'stands'
    WHEN NOT CASE WHEN side = 'left' THEN px1 <= 1 - g + 1e-9 ELSE px0 >= g - 1e-9 END THEN 'gutter'
    WHEN NOT (py0 >= v + sv - 1e-9 AND py1 <= 1 - v - sv + 1e-9 AND CASE WHEN side = 'left' THEN px0 >= u + su - 1e-9 AND px1 <= 1 + 1e-9 ELSE px0 >= -1e-9 AND px1 <= 1 - u - su + 1e-9 END) THEN 'safe margin' ELSE 'stands' END AS verdict FROM m""")
def placement_rules(spark, sf_dir):
    """The first hard rule that a picture with one face breaks in its slot."""
    rows = _slots(spark, sf_dir)
    face = pr.rect(F.col("l_orderkey") % 10 / 10, F.col("l_linenumber") % 9 / 10, F.lit(0.1), F.lit(0.1))
    crop = pr.rect(F.lit(0.1), F.lit(0.0), F.lit(0.8), F.lit(1.0))
    verdict = pr.rejects(SPEC, 400 + F.col("l_orderkey") % 30 * 100, F.array(face), crop, F.col("slot"), F.col("side"))
    return rows.select("l_orderkey", "l_linenumber", F.coalesce(verdict, F.lit("stands")).alias("verdict"))


from . import picks  # noqa: E402, F401  registers its queries
