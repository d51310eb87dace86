"""Round trips through the readers and writers: what is written to the shared folder is read again."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessel.plans.lineage import shared_dir
from tessel.queries import query
from tessel.sources import cache, files, services


def _place(spark) -> str:
    return f"{shared_dir(spark)}/files-{uuid.uuid4().hex}"


@query("s1_json_annotations", "SELECT vec_id AS pairid, 'img' || vec_id AS reference, {'members': ['img' || vec_id, 'x']}.members[1] AS first_member FROM embeddings")
def annotations(spark, tables):
    path = _place(spark)
    rows = tables("embeddings").select(F.col("vec_id").alias("pairid"), F.concat(F.lit("img"), "vec_id").alias("reference"), F.struct(F.array(F.concat(F.lit("img"), "vec_id"), F.lit("x")).alias("members")).alias("img_set"))
    rows.agg(F.to_json(F.collect_list(F.struct(*rows.columns))).alias("value")).write.text(path)
    return files.read_annotations(spark, path).select("pairid", "reference", F.col("img_set.members")[0].alias("first_member"))


@query("s2_json_split", "SELECT 'n' || lpad(CAST(vec_id AS VARCHAR), 6, '0') AS name, './img/' || vec_id || '.png' AS rel_path, CAST(vec_id AS INTEGER) AS pos FROM embeddings")
def split(spark, tables):
    path = _place(spark)
    e = tables("embeddings").select(F.struct(F.concat(F.lit("n"), F.lpad(F.col("vec_id").cast("string"), 6, "0")).alias("k"), F.concat(F.lit("./img/"), "vec_id", F.lit(".png")).alias("v")).alias("e"))
    e.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list("e"))))).write.text(path)
    return files.read_split(spark, path)


@query("s3_jsonl_scan", "SELECT CAST(o_orderkey AS VARCHAR) AS sample_id, o_orderstatus AS category FROM orders WHERE o_orderkey % 10 <> 0")
def jsonl(spark, tables):
    path = _place(spark)
    line = F.when(F.col("o_orderkey") % 10 == 0, F.lit('{"sample_id": ')).otherwise(F.to_json(F.struct(F.col("o_orderkey").cast("string").alias("sample_id"), F.col("o_orderstatus").alias("category"))))
    tables("orders").select(line.alias("value")).write.text(path)
    rows, _ = files.read_jsonl(spark, path)
    return rows.select("sample_id", "category")


@query("s5_csv_scan", "SELECT n_nationkey, n_name FROM nation")
def csv(spark, tables):
    path = _place(spark) + ".csv"
    tables("nation").select("n_nationkey", "n_name").write.option("header", True).csv(path)
    return files.read_table(spark, path, ", ".join(f"{n} {t}" for n, t in tables("nation").select("n_nationkey", "n_name").dtypes))


@query("s6_catalog", "SELECT r_regionkey, r_name FROM region")
def catalog(spark, tables):
    path = _place(spark)
    tables("region").write.parquet(path)
    return files.Catalog({("store/regions", "", "train"): path}).load(spark, "store/regions").select("r_regionkey", "r_name")


@query("s12_embedding_cache", "SELECT vec_id, len(embedding) AS dim FROM embeddings")
def embedding_cache(spark, tables):
    folder, e = _place(spark), tables("embeddings")
    make = lambda ids: ids.join(e, "vec_id")
    cache.cached(e.select("vec_id"), "vec_id", folder, make)
    return cache.cached(e.select("vec_id"), "vec_id", folder, make).select("vec_id", F.size("embedding").cast("long").alias("dim"))


@query("s13_s14_json_sinks", "SELECT event_type, count(*) * 2 AS n FROM events GROUP BY 1")
def json_sinks(spark, tables):
    path = _place(spark)
    files.write_json(tables("events").select("event_type"), path, {"kind": "events"})
    files.append_log(tables("events").select("event_type"), path)
    return spark.read.schema("event_type string").json(path).groupBy("event_type").agg(F.count("*").alias("n"))


@query("s15_submission", "SELECT CAST(o_custkey AS VARCHAR) AS key, list(CAST(o_orderkey AS VARCHAR) ORDER BY o_orderkey) AS names FROM orders GROUP BY 1")
def submission(spark, tables):
    path = _place(spark)
    rank = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    ranked = tables("orders").select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("candidate_id"), rank.alias("rank"))
    files.submission(ranked, "rc2", "recall").coalesce(1).write.text(path)
    return files.read_submission(spark, path)


@query("s19_service", "SELECT p_partkey, CASE WHEN p_partkey % 50 = 0 THEN NULL ELSE upper(p_name) END AS answer FROM part")
def service(spark, tables):
    def make():
        def client(items):
            if any(int(x.split("|")[0]) % 50 == 0 for x in items):
                raise services.TooLong
            return [x.split("|", 1)[1].upper() for x in items]

        return client

    rows = tables("part").select("p_partkey", F.concat("p_partkey", F.lit("|"), "p_name").alias("asked"))
    return services.call_service(rows, make, "asked").select("p_partkey", "answer")


@query("s23_allow_list_file", "SELECT CAST(c_custkey AS VARCHAR) AS id FROM customer")
def allow_list(spark, tables):
    path = _place(spark)
    tables("customer").select(F.concat(F.lit("  "), "c_custkey", F.lit(" \n"))).write.text(path)
    return files.read_allow_list(spark, path)


@query("s26_first_existing", "SELECT count(*) AS n FROM region")
def first_existing(spark, tables):
    path = _place(spark)
    tables("region").write.parquet(path)
    return spark.read.parquet(files.first_existing(spark, [path + "-none", path])).agg(F.count("*").alias("n"))


@query("g8_embed", "SELECT p_partkey, CAST(len(p_name) AS DOUBLE) AS length FROM part")
def embed(spark, tables):
    make = lambda: lambda items: [[float(len(x)), 1.0] for x in items]
    return services.embed(tables("part").select("p_partkey", "p_name"), make, "p_name").select("p_partkey", F.col("embedding")[0].cast("double").alias("length"))
