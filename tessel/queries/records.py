"""Settings, records, images and named strategies."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import functions as F

from tessel.functions import parsing as P
from tessel.functions import vectors as V
from tessel.operators import dedup
from tessel.operators import records as R
from tessel.plans.lineage import shared_dir
from tessel.queries import query
from tessel.sources import config, files


def _place(spark) -> str:
    return f"{shared_dir(spark)}/records-{uuid.uuid4().hex}"


def _small(rows, *columns) -> list:
    """The rows of a table of fixed size (nations, regions), to make files of."""
    return sorted(tuple(r) for r in rows.select(*columns).collect())


@query("s4_category_scan", "SELECT 'c' || n_nationkey AS candidate, n_name AS target, lower(replace(r_name, ' ', '_')) AS category FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_regionkey <> 2")
def category_scan(spark, tables):
    path = _place(spark)
    names = dict(_small(tables("region"), "r_regionkey", "r_name"))
    for key, name in names.items():
        if key != 2:  # a category without a file
            rows = [{"candidate": f"c{k}", "target": n, "captions": ["a", "b"]} for k, n, r in _small(tables("nation"), "n_nationkey", "n_name", "n_regionkey") if r == key]
            config.put_text(spark, f"{path}/cap.{name.lower().replace(' ', '_')}.train.json", json.dumps(rows))
    config.put_text(spark, f"{path}/cap.other.val.json", "[]")
    return files.read_categories(spark, path).select("candidate", "target", "category")


@query("s7_settings", "SELECT k, coalesce(CASE WHEN k % 5 <> 0 THEN n_name END, 'unknown') AS name FROM (SELECT unnest(range(0, 30)) AS k) s LEFT JOIN nation ON n_nationkey = k")
def settings(spark, tables):
    path = _place(spark) + ".yaml"
    lines = [f"  k{k}: {'null' if k % 5 == 0 else n}" for k, n in _small(tables("nation"), "n_nationkey", "n_name")]
    config.put_text(spark, path, "# names\nnames:\n" + "\n".join(lines) + "\nother: [1, 2]\n")
    found = config.read_settings(spark, path, {"names": {f"k{k}": "unknown" for k in range(30)}})
    return spark.createDataFrame([(int(k[1:]), v) for k, v in found["names"].items()], "k long, name string")


def _images(spark, tables) -> str:
    path = _place(spark)
    for k, name in _small(tables("nation"), "n_nationkey", "n_name"):
        config.put_text(spark, f"{path}/r{k % 3}/frame{k}.{'JPG' if k % 2 else 'png'}" if k % 4 else f"{path}/r{k % 3}/frame{k}.txt", name)
    return path


@query("s8_image_listing", "SELECT 'r' || n_nationkey % 3 || '/frame' || n_nationkey || CASE WHEN n_nationkey % 2 = 1 THEN '.JPG' ELSE '.png' END AS path, CAST(length(n_name) AS BIGINT) AS length FROM nation WHERE n_nationkey % 4 <> 0")
def image_listing(spark, tables):
    return files.list_images(spark, _images(spark, tables)).select(F.regexp_extract("path", r"(r\d+/[^/]+)$", 1).alias("path"), "length")


@query("s9_image_load", "SELECT n_nationkey, CASE WHEN n_nationkey % 4 <> 0 THEN n_name ELSE 'white' END AS content FROM nation")
def image_load(spark, tables):
    path = _images(spark, tables)
    k = F.col("n_nationkey")
    # an image that is not there gets the placeholder
    name = F.concat(F.lit(f"{path}/r"), k % 3, F.lit("/frame"), k, F.when(k % 2 == 1, ".JPG").otherwise(".png"))
    rows = tables("nation").select("n_nationkey", name.alias("image"))
    return files.load_images(rows, path, "image", b"white").select("n_nationkey", F.col("content").cast("string").alias("content"))


@query("s10_frame_listing", "SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS frame, n_nationkey AS nation FROM nation WHERE n_nationkey % 4 <> 0 AND n_nationkey % 3 = 1")
def frame_listing(spark, tables):
    found = files.load_frames(spark, f"{_images(spark, tables)}/r1")
    return found.select("frame", F.regexp_extract("path", r"frame(\d+)", 1).cast("int").alias("nation"))


@query("s11_fetch", "SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN n_name WHEN 1 THEN n_name WHEN 2 THEN upper('http://x/' || n_nationkey) END AS content FROM nation")
def fetch(spark, tables):
    path = _place(spark)
    for k, name in _small(tables("nation"), "n_nationkey", "n_name"):
        if k % 4 == 1:
            config.put_text(spark, f"{path}/n{k}.bin", name)
    k = F.col("n_nationkey")
    address = F.when(k % 4 == 0, F.concat(F.lit("data:text/plain;base64,"), F.base64(F.col("n_name").cast("binary")))).when(k % 4 == 2, F.concat(F.lit("http://x/"), k)).otherwise(F.concat(F.lit(f"{path}/n"), k, F.lit(".bin")))
    got = files.fetch(tables("nation").select("n_nationkey", address.alias("address")), "address", client=lambda a: a.upper().encode())
    return got.select("n_nationkey", F.col("content").cast("string").alias("content"))


@query("s17_report", "SELECT CAST(o_custkey AS VARCHAR) AS query_id, CAST(min(o_orderkey) AS VARCHAR) AS first, CAST(count(*) AS VARCHAR) AS n, 'recall' AS metric FROM orders GROUP BY 1")
def report(spark, tables):
    path = _place(spark)
    grid = tables("orders").groupBy(F.col("o_custkey").alias("query_id")).agg(F.min("o_orderkey").alias("first"), F.count("*").alias("n"))
    files.write_report(grid, path, grid.agg(F.count("*").alias("queries")), {"metric": "recall"})
    table = lambda name: spark.read.option("header", True).csv(f"{path}/{name}")
    return table("grid").withColumn("metric", F.lit(table("metadata").where("name = 'metric'").first()["value"]))


@query("s18_saved_representatives")
def saved_representatives(spark, tables):
    return dedup.save_representatives(tables("benchmark").select("item_id", "text"), _place(spark), "item_id", "text", compat=False).select("item_id")


@query("s22_arguments", "SELECT r_name AS name, CAST(r_regionkey AS VARCHAR) AS value FROM region")
def arguments(spark, tables):
    path = _place(spark) + ".json"
    config.save_args(spark, path, {name: key for key, name in _small(tables("region"), "r_regionkey", "r_name")})
    return spark.createDataFrame([(k, str(v)) for k, v in config.load_args(spark, path).items()], "name string, value string")


@query("s24_template_file", "SELECT CAST(row_number() OVER (ORDER BY r_regionkey) - 1 AS INTEGER) AS pos, r_name AS name, 'Ask about ' || r_name || e'\\nin two lines.' AS body FROM region")
def template_file(spark, tables):
    path = _place(spark) + ".md"
    config.put_text(spark, path, "intro\n" + "\n".join(f"### {name}\nAsk about {name}\nin two lines.\n" for _, name in _small(tables("region"), "r_regionkey", "r_name")))
    return files.read_template(spark, path)


@query("s24_block_file", "SELECT CAST(row_number() OVER (ORDER BY r_regionkey) - 1 AS INTEGER) AS pos, 'Example of ' || r_name AS block FROM region")
def block_file(spark, tables):
    path = _place(spark) + ".txt"
    config.put_text(spark, path, "\n-----\n".join(f"Example of {name}" for _, name in _small(tables("region"), "r_regionkey", "r_name")))
    return files.read_blocks(spark, path)


@query("s25_json_retry", "SELECT n_nationkey AS k, n_name AS name FROM nation")
def json_retry(spark, tables):
    path, asked = _place(spark) + ".json", []

    def read():
        asked.append(1)
        if len(asked) < 3:  # not there yet
            return spark.read.schema("k int, name string").json(path)
        config.put_text(spark, path, json.dumps([{"k": k, "name": n} for k, n in _small(tables("nation"), "n_nationkey", "n_name")]))
        return config.read_json(spark, path, "k int, name string")

    return config.with_retry(read, wait=0.01)


@query("p17_shapes", """SELECT event_id, CASE event_id % 7 WHEN 0 THEN [event_type, 'b'] WHEN 1 THEN [event_type, 'b', 'c'] WHEN 2 THEN [event_type, 'b'] WHEN 3 THEN [event_type] WHEN 4 THEN [event_type, 'z'] WHEN 5 THEN [event_type] ELSE []::VARCHAR[] END AS captions FROM events""")
def shapes(spark, tables):
    e = F.col("event_type")
    made = ['["%s", "b"]', '[["%s"], ["b", "c"]]', '{"x": ["q"], "y": ["%s", "b"], "z": ["r", "s"]}', '{"x": "%s"}', '{"a": {"t": "%s"}, "b": {"t": "z"}}', "%s", "%.0s "]
    text = F.lit(None).cast("string")
    for k, form in enumerate(made):
        text = F.when(F.col("event_id") % 7 == k, F.format_string(form, e)).otherwise(text)
    return tables("events").select("event_id", R.captions(text).alias("captions"))


@query("p19_dataset_name", "SELECT n_nationkey, 'nations' AS global_dataset_name FROM nation")
def dataset_name(spark, tables):
    return R.with_source(tables("nation").select("n_nationkey"), "nations")


@query("j5_other_images", "SELECT p_partkey FROM part WHERE p_partkey % 5 IN (3, 4)")
def other_images(spark, tables):
    k = F.col("p_partkey") % 5
    own = F.concat(F.lit("img/p"), "p_partkey", F.lit(".png"))
    candidate = F.when(k == 0, F.concat(F.lit("./"), own)).when(k == 1, F.concat(F.lit("/data/x/../"), own)).when(k == 2, F.concat(F.lit("p"), "p_partkey", F.lit(".png"))).when(k == 3, F.concat(F.lit("/elsewhere/"), own)).otherwise(F.lit("img/q.png"))
    rows = tables("part").select("p_partkey", candidate.alias("candidate"), own.alias("reference"), F.lit("img/t.png").alias("target"))
    return R.other_images(rows, "candidate", "reference", "target", "/data").select("p_partkey")


@query("u3_gather", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey % 8, o_orderkey) - 1 AS pos FROM orders")
def gather(spark, tables):
    return R.gathered(tables("orders").select("o_orderkey", (F.col("o_orderkey") % 8).alias("worker")), "worker", "o_orderkey").select("o_orderkey", "pos")


@query("u11_batch_share", "SELECT p_partkey, CAST(floor(CASE WHEN p_size / CAST(20 AS DOUBLE) <= 1 THEN p_size / CAST(20 AS DOUBLE) * 256 ELSE p_size / CAST(20 AS DOUBLE) END) AS BIGINT) AS n FROM part")
def batch_share(spark, tables):
    return tables("part").select("p_partkey", R.batch_share(F.col("p_size") / F.lit(20.0), 256).alias("n"))


@query("x9_media_items", "SELECT conv_id, list(CASE turn % 3 WHEN 0 THEN 'image:' ELSE 'video:' END || turn ORDER BY turn) FILTER (WHERE turn % 3 <> 1) AS items FROM conversations GROUP BY conv_id HAVING count(*) FILTER (WHERE turn % 3 <> 1) > 0")
def media_items(spark, tables):
    kind = F.when(F.col("turn") % 3 == 0, "image").when(F.col("turn") % 3 == 1, "text").otherwise("video")
    part = F.struct(kind.alias("type"), F.col("turn").cast("string").alias("value"))
    said = tables("conversations").select("conv_id", "turn", F.struct(F.array(part, F.struct(F.lit("text").alias("type"), F.lit("x").alias("value"))).alias("content")).alias("m"))
    per = said.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "m"))), lambda x: x["m"]).alias("messages"))
    items = F.transform(P.media_items(F.col("messages")), lambda x: F.concat(x["type"], F.lit(":"), x["value"]))
    return per.select("conv_id", items.alias("items")).where(F.size("items") > 0)


@query("m15_last_token", "SELECT vec_id, list_transform(embedding[((vec_id % 4) * 16 + 1):((vec_id % 4) * 16 + 16)], lambda x: round(CAST(x AS DOUBLE), 5) + 0.0) AS pooled FROM embeddings")
def last_token(spark, tables):
    mask = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: (i <= F.col("vec_id") % 4).cast("int"))
    rows = tables("embeddings").select("vec_id", R.pooled(V.slices(F.col("embedding").cast("array<double>"), 16, 4), mask).alias("v"))
    return rows.select("vec_id", F.transform("v", lambda x: F.round(x, 5) + F.lit(0.0)).alias("pooled"))


@query("w13_stage_bounds", "SELECT conv_id, turn, 'Decompose Intents' AS name, CAST(length(role) + 2 AS INTEGER) AS start, CAST(length(role) + 2 + 18 + length(role) + 1 AS INTEGER) AS \"end\" FROM conversations UNION ALL SELECT conv_id, turn, 'Local Edits', CAST(length(role) * 2 + 21 AS INTEGER), CAST(length(role) * 2 + 21 + 19 AS INTEGER) FROM conversations")
def stage_bounds(spark, tables):
    said = F.concat("role", F.lit("\nDecompose Intents\n"), "role", F.lit("\n## LOCAL edits\nnone"))
    rows = tables("conversations").where("role is not null").select("conv_id", "turn", F.inline(P.stage_bounds(said)))
    return rows


@query("g1_registry", "SELECT o_orderkey, 'orders_by_name' AS global_dataset_name FROM orders")
def registry(spark, tables):
    name = "orders_by_name"
    if name not in files.LOADERS:
        files.loader(name)(lambda read: read("orders").select("o_orderkey"))
    return files.load(name, tables)


@query("g2_dataset_hooks", "SELECT o_orderkey AS sample, o_orderstatus AS text, false AS is_augmented FROM orders UNION ALL SELECT o_orderkey, o_orderstatus || ' again', true FROM orders WHERE o_orderkey % 3 = 0")
def dataset_hooks(spark, tables):
    class Orders(R.Dataset):
        def load(self):
            return tables("orders").select("o_orderkey", "o_orderstatus")

        def original(self, rows):
            return rows.select(F.col("o_orderkey").alias("sample"), F.col("o_orderstatus").alias("text"))

        def augmented(self, rows):
            return rows.where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("sample"), F.concat("o_orderstatus", F.lit(" again")).alias("text"))

    return Orders(spark).samples()


@query("g3_row_map", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS place, upper(o_orderpriority) AS said FROM orders QUALIFY place % 2 = 0")
def row_map(spark, tables):
    rows = R.mapped(tables("orders").select("o_orderkey", "o_orderpriority"), lambda pdf: pdf.assign(place=pdf["index"], said=pdf["o_orderpriority"].str.upper())[["o_orderkey", "place", "said"]], "o_orderkey long, place long, said string", order="o_orderkey")
    return R.filtered(rows, lambda pdf: pdf["place"] % 2 == 0)


@query("g4_processors", "SELECT conv_id, turn, trim(CASE turn % 2 WHEN 0 THEN '<|vision_start|><|image_pad|><|vision_end|>' ELSE '<image>' END || ' Find: ' || coalesce(role, '')) AS said FROM conversations")
def processors(spark, tables):
    family = F.when(F.col("turn") % 2 == 0, "qwen2_vl").otherwise("llava")
    return tables("conversations").select("conv_id", "turn", R.process(family, F.lit("Find:"), F.coalesce("role", F.lit(""))).alias("said"))


@query("g7_losses", """WITH t AS (SELECT p_partkey, p_size / CAST(50 AS DOUBLE) AS own, [(p_partkey % 7) / CAST(10 AS DOUBLE), (p_partkey % 3) / CAST(4 AS DOUBLE)] AS others FROM part)
SELECT p_partkey, 'info_nce' AS loss, round(ln(exp(own / 0.07) + exp(others[1] / 0.07) + exp(others[2] / 0.07)) - own / 0.07, 5) + 0.0 AS value FROM t
UNION ALL SELECT p_partkey, 'margin', round((greatest(others[1] - own + 0.2, 0) + greatest(others[2] - own + 0.2, 0)) / 2, 5) + 0.0 FROM t""")
def losses(spark, tables):
    own, others = F.col("p_size") / F.lit(50.0), F.array((F.col("p_partkey") % 7) / F.lit(10.0), (F.col("p_partkey") % 3) / F.lit(4.0))
    named = F.array(*[F.struct(F.lit(name).alias("loss"), (F.round(make(own, others), 5) + F.lit(0.0)).alias("value")) for name, make in sorted(R.LOSSES.items())])
    return tables("part").select("p_partkey", F.inline(named))


@query("g9_collator", """WITH g AS (SELECT l_orderkey, list(l_linenumber ORDER BY l_linenumber) AS a FROM lineitem GROUP BY 1), n AS (SELECT *, row_number() OVER (ORDER BY l_orderkey) - 1 AS place FROM g)
SELECT place // 16 AS batch, place % 16 AS row, CAST(unnest(range(0, len(a))) AS INTEGER) AS item, unnest(a) AS text, unnest(list_transform(a, lambda x: x * 2)) AS image FROM n""")
def collator(spark, tables):
    per = tables("lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list("l_linenumber")).alias("text"))
    rows = per.select("l_orderkey", "text", F.transform("text", lambda x: x * 2).alias("image"))
    return R.collated(rows, ["text", "image"], 16, "l_orderkey")
