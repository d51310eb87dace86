"""Joins, statistics, mixing, sampling and arithmetic over tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessel.functions import geometry as G
from tessel.operators import datasets as D
from tessel.operators import ranking as R
from tessel.operators.numbering import numbered
from tessel.queries import query


@query("a17_relevance_map", "SELECT CAST(quality AS VARCHAR) AS query_id, CAST(doc_id AS VARCHAR) AS corpus_id, max(toxic + quality) AS score FROM labels WHERE toxic + quality > 0 GROUP BY 1, 2")
def relevance_map(spark, tables):
    rows = tables("labels").select(F.col("quality").cast("string").alias("query_id"), F.col("doc_id").cast("string").alias("corpus_id"), (F.col("toxic") + F.col("quality")).alias("score"))
    return rows.where("score > 0").groupBy("query_id", "corpus_id").agg(F.max("score").alias("score"))


@query("j10_coverage", "SELECT count(*) AS n_rows, count(DISTINCT doc_id) AS n_ids, count(*) FILTER (WHERE doc_id NOT IN (SELECT doc_id FROM labels)) AS missing_rows, count(DISTINCT doc_id) FILTER (WHERE doc_id NOT IN (SELECT doc_id FROM labels)) AS missing_ids, round(count(DISTINCT doc_id) FILTER (WHERE doc_id IN (SELECT doc_id FROM labels)) / CAST(count(DISTINCT doc_id) AS DOUBLE), 6) AS covered FROM documents")
def coverage(spark, tables):
    return D.coverage(tables("documents"), tables("labels"), "doc_id")


@query("j10_uncovered", "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def uncovered(spark, tables):
    return D.uncovered(tables("documents"), tables("labels"), "doc_id").select("doc_id", "lang")


@query("j3_p1_lookup", "SELECT o_orderkey, coalesce(c_name, CAST(o_custkey AS VARCHAR)) AS path FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 2 = 0) c ON o_custkey = c_custkey")
def lookup(spark, tables):
    names = tables("customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").cast("string").alias("name"), F.col("c_name").alias("rel_path"))
    return D.lookup(tables("orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("k")), names, "k", "path").select("o_orderkey", "path")


@query("p3_existence_filter", "SELECT doc_id FROM documents SEMI JOIN labels USING (doc_id)")
def existence(spark, tables):
    return D.existing(tables("documents").select("doc_id"), tables("labels").select(F.col("doc_id").alias("path")), "doc_id")


@query("p14_allow_list", "SELECT o_orderkey FROM orders WHERE CAST(o_custkey AS VARCHAR) IN (SELECT CAST(c_custkey AS VARCHAR) FROM customer WHERE c_custkey <= 50)")
def allow_list(spark, tables):
    ids = tables("customer").where("c_custkey <= 50").select(F.col("c_custkey").cast("string").alias("k"))
    return tables("orders").withColumn("k", F.col("o_custkey").cast("string")).join(ids, "k", "left_semi").select("o_orderkey")


@query("j4_position_lookup", "SELECT doc_id, coalesce(p, -1) AS position FROM documents LEFT JOIN (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS p FROM labels) USING (doc_id)")
def position_lookup(spark, tables):
    at = numbered(tables("labels").select("doc_id"), "doc_id", out="p")
    return tables("documents").select("doc_id").join(at, "doc_id", "left").select("doc_id", F.coalesce("p", F.lit(-1)).alias("position"))


@query("j9_left_join_default", "SELECT d.doc_id, coalesce(l.quality, -1) AS quality FROM documents d LEFT JOIN labels l USING (doc_id)")
def left_join_default(spark, tables):
    return tables("documents").join(tables("labels"), "doc_id", "left").select("doc_id", F.coalesce("quality", F.lit(-1)).alias("quality"))


@query("u4_intersection", "SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels")
def intersection(spark, tables):
    return tables("documents").select("doc_id").intersect(tables("labels").select("doc_id"))


@query("u5_difference", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def difference(spark, tables):
    return tables("documents").select("doc_id").subtract(tables("labels").select("doc_id"))


@query("u6_a30_union_distinct", "SELECT count(*) AS n FROM (SELECT o_custkey AS k FROM orders UNION SELECT c_custkey FROM customer)")
def union_distinct(spark, tables):
    return tables("orders").select(F.col("o_custkey").alias("k")).union(tables("customer").select("c_custkey")).distinct().agg(F.count("*").alias("n"))


@query("u1_u12_union_aligned", "SELECT o_orderkey AS id, o_totalprice AS price, CAST(NULL AS INTEGER) AS line, false AS is_augmented FROM orders UNION ALL SELECT l_orderkey, l_extendedprice, l_linenumber, true FROM lineitem")
def union_aligned(spark, tables):
    a = tables("orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price"), F.lit(False).alias("is_augmented"))
    b = tables("lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_extendedprice").alias("price"), F.col("l_linenumber").alias("line"), F.lit(True).alias("is_augmented"))
    return a.unionByName(b, allowMissingColumns=True)


@query("u7_u10_first_exhausted", """WITH s AS (SELECT 'customer' AS source, c_custkey AS id, row_number() OVER (ORDER BY c_custkey) - 1 AS n, 0 AS i FROM customer UNION ALL SELECT 'supplier', s_suppkey, row_number() OVER (ORDER BY s_suppkey) - 1, 1 FROM supplier)
SELECT source, id, n * 2 + i AS place FROM s WHERE n < (SELECT count(*) FROM supplier)""")
def first_exhausted(spark, tables):
    return D.interleave_round_robin({"customer": tables("customer").select(F.col("c_custkey").alias("id")), "supplier": tables("supplier").select(F.col("s_suppkey").alias("id"))}, "id")


@query("u7_u10_all_exhausted", """WITH a AS (SELECT c_custkey AS id, row_number() OVER (ORDER BY c_custkey) - 1 AS n FROM customer), b AS (SELECT s_suppkey AS id, row_number() OVER (ORDER BY s_suppkey) - 1 AS n FROM supplier)
SELECT 'customer' AS source, id, n * 2 AS place FROM a UNION ALL SELECT 'supplier', b.id, a.n * 2 + 1 FROM a JOIN b ON a.n % (SELECT count(*) FROM supplier) = b.n WHERE a.n < (SELECT count(*) - 1 FROM customer)""")
def all_exhausted(spark, tables):
    return D.interleave_round_robin({"customer": tables("customer").select(F.col("c_custkey").alias("id")), "supplier": tables("supplier").select(F.col("s_suppkey").alias("id"))}, "id", "all_exhausted")


@query("u8_u9_weighted_mix", """WITH t AS (SELECT i AS place, CASE WHEN CAST('0x' || substr(md5((i // 8) || ':1'), 1, 7) AS BIGINT) / CAST(268435456 AS DOUBLE) < 0.3 THEN 'customer' ELSE 'orders' END AS source FROM (SELECT unnest(range(0, 2000)) AS i)),
n AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY place) - 1 AS nth FROM t),
r AS (SELECT 'orders' AS source, o_orderkey AS id, row_number() OVER (ORDER BY o_orderkey) - 1 AS at_, (SELECT count(*) FROM orders) AS size FROM orders UNION ALL SELECT 'customer', c_custkey, row_number() OVER (ORDER BY c_custkey) - 1, (SELECT count(*) FROM customer) FROM customer)
SELECT place, n.source, id FROM n JOIN r ON n.source = r.source AND nth % size = at_""")
def weighted_mix(spark, tables):
    sources = {"orders": tables("orders").select(F.col("o_orderkey").alias("id")), "customer": tables("customer").select(F.col("c_custkey").alias("id"))}
    return D.interleave_weighted(sources, {"orders": 0.7, "customer": 0.3}, "id", total=2000, batch=8, seed=1).select("place", "source", "id")


@query("l1_l2_hash_sample", "SELECT o_orderkey FROM orders ORDER BY md5(o_orderkey || ':3'), o_orderkey LIMIT 50")
def hash_sample(spark, tables):
    return D.sample(tables("orders"), "o_orderkey", 50, seed=3).select("o_orderkey")


@query("l3_l4_packed_batches")
def packed_batches(spark, tables):
    groups = tables("lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.col("l_orderkey") * 10 + F.col("l_linenumber"))).alias("items"))
    return D.pack_groups(groups.select(F.col("l_orderkey").alias("group_pos"), F.lit("s").alias("signature"), "items"), 8, pad=True)


@query("l5_contiguous_shards", "WITH n AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS p FROM orders) SELECT o_orderkey, CAST(p // CAST(ceil((SELECT count(*) FROM orders) / 7) AS BIGINT) AS INTEGER) AS shard FROM n")
def contiguous_shards(spark, tables):
    return D.shards(tables("orders").select("o_orderkey"), "o_orderkey", 7)


@query("l6_round_robin_shards", "SELECT o_orderkey, CAST((row_number() OVER (ORDER BY o_orderkey) - 1) % 7 AS INTEGER) AS shard FROM orders")
def round_robin_shards(spark, tables):
    return D.shards(tables("orders").select("o_orderkey"), "o_orderkey", 7, contiguous=False)


@query("l8_chunks", "SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1) // 64 AS chunk FROM orders")
def chunks(spark, tables):
    return D.chunked(tables("orders").select("o_orderkey"), "o_orderkey", 64)


@query("l9_largest", "SELECT p_partkey, CAST(ceil((p_size * 37) / CAST(14 AS DOUBLE)) * ceil((p_partkey % 900) / CAST(14 AS DOUBLE)) + 2 AS BIGINT) AS tokens FROM part ORDER BY tokens DESC, p_partkey LIMIT 10")
def largest(spark, tables):
    return tables("part").select("p_partkey", G.patch_tokens(F.col("p_size") * 37, F.col("p_partkey") % 900).alias("tokens")).orderBy(F.desc("tokens"), "p_partkey").limit(10)


@query("l10_sorted_counts", "SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand ORDER BY n DESC, p_brand")
def sorted_counts(spark, tables):
    return tables("part").groupBy("p_brand").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "p_brand")


@query("l11_existing_steps", "SELECT s AS step FROM (SELECT unnest(range(0, 2001, 100)) AS s) SEMI JOIN orders ON s = o_orderkey")
def existing_steps(spark, tables):
    steps = spark.range(0, 2001, 100).select(F.col("id").alias("step"))
    return steps.join(tables("orders").select(F.col("o_orderkey").alias("step")), "step", "left_semi")


@query("l12_latest_checkpoint", "SELECT 'run/checkpoint-' || max(o_orderkey) AS path, max(o_orderkey) AS step FROM orders")
def latest_checkpoint(spark, tables):
    return D.latest(tables("orders").select(F.concat(F.lit("run/checkpoint-"), F.col("o_orderkey").cast("string")).alias("path")))


@query("p8_first_rows", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 100")
def first_rows(spark, tables):
    return tables("orders").select("o_orderkey").orderBy("o_orderkey").limit(100)


@query("w11_even_selection", """WITH n AS (SELECT o_custkey, o_orderkey, row_number() OVER w - 1 AS p, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)), m AS (SELECT *, least(4, n) AS m FROM n)
SELECT o_custkey, o_orderkey FROM m WHERE CASE WHEN m = 1 THEN p = 0 ELSE list_contains(list_transform(range(0, m), lambda i: i * (n - 1) // (m - 1)), p) END""")
def even_selection(spark, tables):
    return D.even_selection(tables("orders").select("o_custkey", "o_orderkey"), "o_custkey", "o_orderkey", 4)


@query("w11_keep_mask", """WITH n AS (SELECT o_custkey, o_orderkey, row_number() OVER w - 1 AS p, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)), m AS (SELECT *, greatest(1, n - CAST(round_even(n * 0.5, 0) AS BIGINT)) AS m FROM n)
SELECT o_orderkey, n = 1 OR CASE WHEN m = 1 THEN p = 0 ELSE list_contains(list_transform(range(0, m), lambda i: i * (n - 1) // (m - 1)), p) END AS keep FROM m""")
def keep_mask(spark, tables):
    return D.keep_mask(tables("orders").select("o_custkey", "o_orderkey"), 0.5, "o_custkey", "o_orderkey").select("o_orderkey", "keep")


@query("w14_rounded_frames", "SELECT p_partkey, list_transform(range(0, 5), lambda i: CAST(round_even(i * (p_size - 1) / CAST(4 AS DOUBLE), 0) AS BIGINT)) AS frames FROM part")
def rounded_frames(spark, tables):
    return tables("part").select("p_partkey", G.even_indices(F.col("p_size"), F.lit(5), rounded=True).alias("frames"))


@query("a12_counts_by_attribute", "SELECT 'brand' AS attribute, coalesce(p_brand, 'Unknown') AS value, count(*) AS n FROM part GROUP BY 2 UNION ALL SELECT 'type', coalesce(p_type, 'Unknown'), count(*) FROM part GROUP BY 2")
def counts_by_attribute(spark, tables):
    one = lambda c, name: tables("part").groupBy(F.coalesce(F.col(c), F.lit("Unknown")).alias("value")).agg(F.count("*").alias("n")).select(F.lit(name).alias("attribute"), "value", "n")
    return one("p_brand", "brand").unionByName(one("p_type", "type"))


@query("a13_size_histogram", "SELECT CASE WHEN p_size < 10 THEN '0-10' WHEN p_size < 20 THEN '10-20' WHEN p_size < 30 THEN '20-30' WHEN p_size < 40 THEN '30-40' ELSE '40+' END AS bucket, count(*) AS n, round(100 * count(*) / CAST((SELECT count(*) FROM part) AS DOUBLE), 6) AS percent, min(p_size) AS smallest, max(p_size) AS largest FROM part GROUP BY 1")
def size_histogram(spark, tables):
    s = F.col("p_size")
    bucket = F.when(s < 10, "0-10").when(s < 20, "10-20").when(s < 30, "20-30").when(s < 40, "30-40").otherwise("40+")
    per = tables("part").groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), F.min("p_size").alias("smallest"), F.max("p_size").alias("largest"))
    return per.withColumn("percent", F.round(100 * F.col("n") / F.sum("n").over(Window.partitionBy()).cast("double"), 6))


@query("a14_distinct_summary", "SELECT count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers, count(DISTINCT l_orderkey) AS orders, round(avg(l_discount), 3) AS mean_discount FROM lineitem")
def distinct_summary(spark, tables):
    return tables("lineitem").agg(F.countDistinct("l_partkey").alias("parts"), F.countDistinct("l_suppkey").alias("suppliers"), F.countDistinct("l_orderkey").alias("orders"), F.round(F.avg("l_discount"), 3).alias("mean_discount"))


@query("a18_weighted_mean", "SELECT event_type, round(sum(value * (event_id % 5 + 1)) / sum(event_id % 5 + 1), 6) AS mean FROM events GROUP BY event_type")
def weighted_mean(spark, tables):
    w = F.col("event_id") % 5 + 1
    return tables("events").groupBy("event_type").agg(F.round(F.sum(F.col("value") * w) / F.sum(w), 6).alias("mean"))


@query("a18_running_mean", "SELECT event_id, round(sum(value * (event_id % 5 + 1)) OVER w / sum(event_id % 5 + 1) OVER w, 9) AS running_mean FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)")
def running_mean(spark, tables):
    rows = tables("events").withColumn("w", F.col("event_id") % 5 + 1)
    return D.running_mean(rows, "value", "w", "event_id", "user_id").select("event_id", F.round("running_mean", 9).alias("running_mean"))


@query("a21_group_composition", "WITH g AS (SELECT user_id, bool_or(event_type = 'click') AS a, bool_or(event_type <> 'click') AS o FROM events GROUP BY 1) SELECT CASE WHEN a AND o THEN 'both' WHEN a THEN 'only_augmented' ELSE 'only_original' END AS composition, count(*) AS n FROM g GROUP BY 1")
def composition(spark, tables):
    return D.composition(tables("events").withColumn("aug", F.col("event_type") == "click"), "user_id", "aug")


@query("a22_mean_times", "SELECT 'overall' AS method, round(avg(value), 6) AS seconds FROM events UNION ALL SELECT event_type, round(avg(value), 6) FROM events GROUP BY 1")
def mean_times(spark, tables):
    per = tables("events").groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("seconds")).withColumnRenamed("event_type", "method")
    return tables("events").agg(F.round(F.avg("value"), 6).alias("seconds")).select(F.lit("overall").alias("method"), "seconds").unionByName(per)


@query("a23_parts_coverage", "SELECT count(*) FILTER (WHERE n > 1) AS with_parts, round(avg(n), 6) AS mean_parts FROM (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1)")
def parts_coverage(spark, tables):
    per = tables("lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    return per.agg(F.count_if(F.col("n") > 1).alias("with_parts"), F.round(F.avg("n"), 6).alias("mean_parts"))


@query("a28_best_run", "SELECT l_orderkey AS run, round(sum(l_quantity), 6) AS r1, round(sum(l_discount), 6) AS r5 FROM lineitem GROUP BY 1 ORDER BY r1 DESC, r5 DESC, run LIMIT 1")
def best_run(spark, tables):
    runs = tables("lineitem").groupBy(F.col("l_orderkey").alias("run")).agg(F.round(F.sum("l_quantity"), 6).alias("r1"), F.round(F.sum("l_discount"), 6).alias("r5"))
    return D.best_run(runs, ["r1", "r5"], "run")


@query("a29_success_counts", "SELECT count(*) FILTER (WHERE l_returnflag = 'R') AS ok, count(*) FILTER (WHERE l_returnflag <> 'R') AS failed FROM lineitem")
def success_counts(spark, tables):
    return tables("lineitem").agg(F.count_if(F.col("l_returnflag") == "R").alias("ok"), F.count_if(F.col("l_returnflag") != "R").alias("failed"))


@query("a32_completion", "SELECT l_orderkey, bool_and(l_linestatus = 'F') AS complete FROM lineitem GROUP BY 1")
def completion(spark, tables):
    return tables("lineitem").groupBy("l_orderkey").agg(F.bool_and(F.col("l_linestatus") == "F").alias("complete"))


@query("p5_required_fields", "SELECT p_partkey AS sample_id, p_name AS source, p_brand AS edited FROM part WHERE p_name <> '' AND p_brand <> ''")
def required_fields(spark, tables):
    return tables("part").where("p_name <> '' AND p_brand <> ''").select(F.col("p_partkey").alias("sample_id"), F.col("p_name").alias("source"), F.col("p_brand").alias("edited"))


@query("p10_p11_unnest", "SELECT l_orderkey, unnest(CASE WHEN count(*) > 2 THEN list(l_linenumber ORDER BY l_linenumber) ELSE [0] END) AS part FROM lineitem GROUP BY 1")
def unnest(spark, tables):
    per = tables("lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list("l_linenumber")).alias("parts"))
    # an absent or empty list stands for the whole
    parts = F.when(F.size("parts") > 2, F.col("parts")).otherwise(F.array(F.lit(0)))
    return per.select("l_orderkey", F.explode(parts).alias("part"))


@query("p12_sample_structs", "SELECT o_orderkey, o_orderstatus AS query_text, o_orderpriority AS pos_text FROM orders")
def sample_structs(spark, tables):
    rows = tables("orders").select("o_orderkey", F.struct(F.col("o_orderstatus").alias("query_text"), F.col("o_orderpriority").alias("pos_text")).alias("sample"))
    return rows.select("o_orderkey", "sample.*")


@query("p16_large_images", "SELECT p_partkey, p_size * 40 * (p_partkey % 900) > 1000000 OR CAST(ceil(p_size * 40 / CAST(14 AS DOUBLE)) * ceil((p_partkey % 900) / CAST(14 AS DOUBLE)) + 2 AS BIGINT) > 400 AS large FROM part")
def large_images(spark, tables):
    return tables("part").select("p_partkey", G.is_large_image(F.col("p_size") * 40, F.col("p_partkey") % 900).alias("large"))


@query("p18_row_signature", "SELECT CASE WHEN l_discount > 0.05 THEN 'l_orderkey,l_tax' ELSE 'l_discount,l_orderkey,l_tax' END AS signature, count(*) AS n FROM lineitem GROUP BY 1")
def row_signature(spark, tables):
    rows = tables("lineitem").select("l_orderkey", "l_tax", F.when(~(F.col("l_discount") > 0.05), F.col("l_discount")).alias("l_discount"))
    return rows.groupBy(F.array_join(D.signature(rows), ",").alias("signature")).agg(F.count("*").alias("n"))


@query("p20_mode_switch", "SELECT count(*) AS n FROM lineitem WHERE l_returnflag = 'A'")
def mode_switch(spark, tables):
    return tables("lineitem").withColumn("is_augmented", F.col("l_returnflag") == "A").where("is_augmented").agg(F.count("*").alias("n"))


@query("p21_metric_alias", "SELECT p_partkey, coalesce(CASE WHEN p_partkey % 2 = 0 THEN p_size END, p_size * 2) / CAST(100 AS DOUBLE) AS recall_at_1 FROM part")
def metric_alias(spark, tables):
    rows = tables("part").select("p_partkey", F.when(F.col("p_partkey") % 2 == 0, F.col("p_size")).alias("recall_at_1"), (F.col("p_size") * 2).alias("r_at_1"))
    return rows.select("p_partkey", (F.coalesce("recall_at_1", "r_at_1") / F.lit(100.0)).alias("recall_at_1"))


@query("j14_grid_neighbours", """WITH p AS (SELECT vec_id // 100 AS t, (vec_id % 100) // 10 AS i, vec_id % 10 AS j, vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)
SELECT a.id AS src, b.id AS dst FROM p a JOIN p b ON a.t = b.t AND ((a.i = b.i AND a.j + 1 = b.j) OR (a.i + 1 = b.i AND a.j = b.j)) WHERE list_distance(a.v, b.v) < 1.3""")
def grid_neighbours(spark, tables):
    e = tables("embeddings").select(F.floor(F.col("vec_id") / 100).alias("t"), F.floor(F.col("vec_id") % 100 / 10).alias("i"), (F.col("vec_id") % 10).alias("j"), F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector"))
    return D.patch_components_edges(e, 1.3)


@query("m6_smart_resize", """WITH s AS (SELECT p_partkey, p_size * 20 + 30 AS h, p_partkey % 900 + 60 AS w FROM part), b AS (SELECT *, greatest(28, CAST(round_even(h / CAST(28 AS DOUBLE), 0) * 28 AS BIGINT)) AS hb, greatest(28, CAST(round_even(w / CAST(28 AS DOUBLE), 0) * 28 AS BIGINT)) AS wb FROM s)
SELECT p_partkey, CASE WHEN hb * wb > 401408 THEN CAST(floor(h / sqrt(h * w / CAST(401408 AS DOUBLE)) / 28) * 28 AS BIGINT) WHEN hb * wb < 3136 THEN CAST(ceil(h * sqrt(CAST(3136 AS DOUBLE) / (h * w)) / 28) * 28 AS BIGINT) ELSE hb END AS height,
CASE WHEN hb * wb > 401408 THEN CAST(floor(w / sqrt(h * w / CAST(401408 AS DOUBLE)) / 28) * 28 AS BIGINT) WHEN hb * wb < 3136 THEN CAST(ceil(w * sqrt(CAST(3136 AS DOUBLE) / (h * w)) / 28) * 28 AS BIGINT) ELSE wb END AS width FROM b""")
def smart_resize(spark, tables):
    r = G.smart_resize(F.col("p_size") * 20 + 30, F.col("p_partkey") % 900 + 60, most=401408)
    return tables("part").select("p_partkey", r.alias("r")).select("p_partkey", "r.height", "r.width")


@query("m7_smart_frames", "WITH s AS (SELECT p_partkey, p_size * 13 AS total FROM part), n AS (SELECT *, CAST(floor(least(least(greatest(total / CAST(25 AS DOUBLE) * 2, 4), floor(least(768, total) / CAST(2 AS DOUBLE)) * 2), total) / 2) * 2 AS BIGINT) AS n FROM s) SELECT p_partkey, CASE WHEN n >= 2 AND n <= total THEN n END AS frames FROM n")
def smart_frames(spark, tables):
    return tables("part").select("p_partkey", G.smart_frames(F.col("p_size") * 13, F.lit(25.0)).alias("frames"))


@query("m9_fit_within", "SELECT p_partkey, CASE WHEN greatest(w, h) <= 500 THEN w WHEN w > h THEN 500 ELSE CAST(trunc(w * 500 / CAST(h AS DOUBLE)) AS BIGINT) END AS width, CASE WHEN greatest(w, h) <= 500 THEN h WHEN w > h THEN CAST(trunc(h * 500 / CAST(w AS DOUBLE)) AS BIGINT) ELSE 500 END AS height FROM (SELECT p_partkey, p_size * 20 AS w, p_partkey % 900 + 1 AS h FROM part)")
def fit_within(spark, tables):
    r = G.fit_within(F.col("p_size") * 20, F.col("p_partkey") % 900 + 1, 500)
    return tables("part").select("p_partkey", r.alias("r")).select("p_partkey", "r.width", "r.height")


@query("m10_center_crop", "SELECT p_partkey, CAST(round_even((round_even(w * (224 / CAST(least(w, h) AS DOUBLE)), 0) - 224) / 2, 0) AS BIGINT) AS \"left\", CAST(round_even((round_even(h * (224 / CAST(least(w, h) AS DOUBLE)), 0) - 224) / 2, 0) AS BIGINT) AS top FROM (SELECT p_partkey, p_size * 20 AS w, p_partkey % 900 + 1 AS h FROM part)")
def center_crop(spark, tables):
    r = G.center_crop(F.col("p_size") * 20, F.col("p_partkey") % 900 + 1, 224)
    return tables("part").select("p_partkey", r.alias("r")).select("p_partkey", "r.left", "r.top")


@query("m11_linear_schedule", "SELECT s AS step, round(CASE WHEN s < 10 THEN s / CAST(10 AS DOUBLE) ELSE greatest(0, (100 - s) / CAST(90 AS DOUBLE)) END, 9) AS factor FROM (SELECT unnest(range(0, 101)) AS s)")
def linear_schedule(spark, tables):
    return spark.range(101).select(F.col("id").alias("step"), F.round(G.linear_schedule(F.col("id"), 10, 100), 9).alias("factor"))


@query("m11_keyframe_schedule", "SELECT s AS step, round(CASE WHEN s <= 0 THEN 0 WHEN s <= 10 THEN s / CAST(10 AS DOUBLE) WHEN s <= 50 THEN 1 - (s - 10) / CAST(40 AS DOUBLE) * 0.5 ELSE 0.5 END, 9) AS factor FROM (SELECT unnest(range(0, 101)) AS s)")
def keyframe_schedule(spark, tables):
    return spark.range(101).select(F.col("id").alias("step"), F.round(G.keyframe_schedule(F.col("id"), [(0, 0.0), (10, 1.0), (50, 0.5)]), 9).alias("factor"))


@query("m12_l7_padding", "SELECT p_partkey, (8 - p_size % 8) % 8 AS missing FROM part")
def padding(spark, tables):
    return tables("part").select("p_partkey", G.padding(F.col("p_size"), 8).alias("missing"))


@query("m13_optimal_bands", "SELECT 25 AS bands, 10 AS rows")
def optimal_bands(spark, tables):
    return spark.createDataFrame([G.optimal_bands(0.7, 256)], "bands int, rows int")


@query("j8_zip_by_position", "SELECT a.o_orderkey, b.c_custkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS n FROM orders) a JOIN (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS n FROM customer) b USING (n)")
def zip_by_position(spark, tables):
    a = numbered(tables("orders").select("o_orderkey"), "o_orderkey", out="n")
    return a.join(numbered(tables("customer").select("c_custkey"), "c_custkey", out="n"), "n").select("o_orderkey", "c_custkey")


@query("u2_accumulated_rounds", "SELECT l_linenumber AS round, sum(count(*)) OVER (ORDER BY l_linenumber)::BIGINT AS n FROM lineitem GROUP BY 1")
def accumulated_rounds(spark, tables):
    per = tables("lineitem").groupBy(F.col("l_linenumber").alias("round")).agg(F.count("*").alias("c"))
    return per.select("round", F.sum("c").over(Window.orderBy("round")).alias("n"))


@query("w5_missing_rank_last", "SELECT o_custkey AS query_id, o_orderkey AS candidate_id, row_number() OVER (PARTITION BY o_custkey ORDER BY round(o_totalprice, 0) DESC, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey ELSE 1000000000 END, o_orderkey) AS new_rank FROM orders")
def missing_rank_last(spark, tables):
    rows = tables("orders").select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("candidate_id"), F.round("o_totalprice", 0).alias("score"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderkey")).alias("original_rank"))
    return R.rerank(rows).select("query_id", "candidate_id", "new_rank")
