"""Readers and writers of annotation, split, table and text files; all distributed, all with a declared schema."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.functions.text import natural_key
from tessel.operators.numbering import numbered
from tessel.sources import schemas


def read_annotations(spark: SparkSession, path: str, schema: str = schemas.ANNOTATIONS) -> DataFrame:
    """A JSON array of objects, one row each; a file is one task's work, so large sets come as many files or lines."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_split(spark: SparkSession, path: str) -> DataFrame:
    """(name, rel_path, pos) of a JSON object from names to paths, in the order of the file."""
    whole = spark.read.text(path, wholetext=True)
    entries = F.map_entries(F.from_json("value", "map<string,string>"))
    return whole.select(F.posexplode(entries).alias("pos", "e")).select("e.key", "e.value", "pos").toDF("name", "rel_path", "pos")


def read_jsonl(spark: SparkSession, path: str, schema: str = schemas.EDITS) -> tuple[DataFrame, DataFrame]:
    """(rows, malformed): the lines that can be read, and those that cannot, as they are with their file."""
    names = spark.createDataFrame([], schema).columns
    rows = spark.read.schema(schema + ", _malformed STRING").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_malformed").json(path)
    rows = rows.withColumn("_file", F.col("_metadata.file_path"))
    return rows.where("_malformed is null").select(*names), rows.where("_malformed is not null").select("_file", F.col("_malformed").alias("line"))


def read_categories(spark: SparkSession, folder: str, pattern: str = "cap.*.train.json", schema: str = schemas.FASHION) -> DataFrame:
    """One file for each category, with the category from its name; categories without a file are just not there."""
    rows = spark.read.schema(schema).option("multiLine", True).option("pathGlobFilter", pattern).json(folder)
    return rows.withColumn("category", F.regexp_extract(F.col("_metadata.file_path"), r"cap\.(\w+)\.", 1))


def read_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """CSV or Parquet by the ending of the path; another ending is an error."""
    low = path.lower().rstrip("/")
    if low.endswith(".csv"):
        reader = spark.read.option("header", True)
        return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)
    if low.endswith(".parquet"):
        return spark.read.parquet(path)
    raise ValueError(f"neither .csv nor .parquet: {path}")


class Catalog:
    """Datasets by (repository, subset, split), as paths of Parquet tables."""

    def __init__(self, paths: dict[tuple[str, str, str], str]):
        self.paths = dict(paths)

    def load(self, spark: SparkSession, repo: str, subset: str = "", split: str = "train") -> DataFrame:
        try:
            return spark.read.parquet(self.paths[repo, subset, split])
        except KeyError:
            raise KeyError(f"no dataset {repo}/{subset}/{split}") from None


LOADERS: dict[str, Callable[..., DataFrame]] = {}


def loader(name: str):
    """Registers a function that loads a dataset under a name."""

    def register(build: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        if name in LOADERS:
            raise ValueError(f"loader {name} is there already")
        LOADERS[name] = build
        return build

    return register


def load(name: str, *args, **how) -> DataFrame:
    """What the loader of this name gives, with the name in global_dataset_name."""
    if name not in LOADERS:
        raise KeyError(f"no loader {name}; there are {sorted(LOADERS)}")
    return LOADERS[name](*args, **how).withColumn("global_dataset_name", F.lit(name))


def read_allow_list(spark: SparkSession, path: str) -> DataFrame:
    """(id): one id in a line, trimmed; blank lines are passed over."""
    return spark.read.text(path).select(F.trim("value").alias("id")).where("id <> ''")


def read_blocks(spark: SparkSession, path: str, separator: str = r"\n\s*---+\s*\n") -> DataFrame:
    """(pos, block) of a text file that a line of dashes splits."""
    whole = spark.read.text(path, wholetext=True)
    blocks = F.filter(F.transform(F.split("value", separator), lambda x: F.trim(x)), lambda x: x != "")
    return whole.select(F.posexplode(blocks).alias("pos", "block"))


def first_existing(spark: SparkSession, candidates: list[str]) -> str | None:
    """The first of the paths that is there, in any file system that Spark can read."""
    jvm = spark._jvm
    for c in candidates:
        p = jvm.org.apache.hadoop.fs.Path(c)
        if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
            return c
    return None


def list_images(spark: SparkSession, folder: str, endings: tuple[str, ...] = ("jpg", "jpeg", "png", "bmp", "gif", "webp")) -> DataFrame:
    """(path, length, modificationTime) of all images below a folder, by path; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "length", "modificationTime")
    return files.where(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*endings)).orderBy("path")


def _bare(path: Column) -> Column:
    """A path without the many ways to write that it is local."""
    return F.regexp_replace(path, "^file:/*", "/")


def load_frames(spark: SparkSession, folder: str, pattern: str | None = None) -> DataFrame:
    """(frame, path) of the images of a folder in natural order, frame from 0; with ``pattern`` those whose path it matches."""
    found = list_images(spark, folder)
    found = found.where(F.col("path").rlike(pattern)) if pattern else found
    keyed = found.select("path", natural_key(F.col("path")).alias("key"))
    return numbered(keyed, "key", out="frame").select("frame", "path")


def fetch(rows: DataFrame, column: str, out: str = "content", client: Callable[[str], bytes] | None = None) -> DataFrame:
    """``rows`` with the bytes that an address names: a data URI's, or a file's of any file system that Spark reads; other
    addresses are asked of ``client``, and are null without one. So is what is not there."""
    address = F.col(column)
    coded = F.regexp_extract(address, r"(?s)^data:[^,]*?;base64,(.*)$", 1)
    plain = F.regexp_extract(address, r"(?s)^data:[^,]*?,(.*)$", 1)
    made = rows.withColumn(out, F.when(address.rlike("^data:[^,]*;base64,"), F.unbase64(coded)).when(address.startswith("data:"), F.url_decode(plain).cast("binary")))
    spark = rows.sparkSession
    remote = address.rlike("^https?://")

    def read(batches):
        for pdf in batches:
            pdf[out] = [client(a) if client else None for a in pdf[column]]
            yield pdf

    schema = made.schema
    asked = made.where(remote).mapInPandas(read, schema)
    named = made.where(~F.coalesce(remote | address.startswith("data:"), F.lit(True)))
    folders = [r[0] for r in named.select(F.regexp_replace(column, "/[^/]*$", "").alias("f")).distinct().toLocalIterator()]  # a row for each folder
    files = spark.read.format("binaryFile").load(folders).select(F.col("path").alias("__p"), F.col("content").alias("__c")) if folders else spark.createDataFrame([], "__p string, __c binary")
    got = named.join(files, _bare(F.col(column)) == _bare(F.col("__p")), "left").withColumn(out, F.col("__c")).drop("__p", "__c")
    return made.where(F.coalesce(address.startswith("data:"), F.lit(True))).unionByName(asked).unionByName(got)


def read_template(spark: SparkSession, path: str, head: str = r"^#{2,}\s*(.+?)\s*$") -> DataFrame:
    """(pos, name, body) of a template file: a body under each heading line."""
    whole = spark.read.text(path, wholetext=True)
    parts = F.split(F.concat(F.lit("\n"), "value"), r"\n(?=#{2,}\s*\S)")
    kept = F.filter(parts, lambda x: x.rlike(r"^#{2,}"))
    first = lambda c: F.regexp_extract(c, f"(?m){head}", 1)
    return whole.select(F.posexplode(kept).alias("pos", "x")).select("pos", first(F.col("x")).alias("name"), F.regexp_replace(F.regexp_replace("x", r"^[^\n]*\n?", ""), r"^\s+|\s+$", "").alias("body"))


def load_images(rows: DataFrame, folder: str, key: str, placeholder: bytes | None = None) -> DataFrame:
    """``rows`` with the content of the file that ``key`` names; the placeholder, or null, where there is none."""
    files = rows.sparkSession.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select(F.col("path").alias("__path"), F.col("content").alias("__content"))
    out = rows.join(files, _bare(rows[key]) == _bare(F.col("__path")), "left").drop("__path")
    return out.withColumn("content", F.coalesce("__content", F.lit(placeholder) if placeholder is not None else F.lit(None).cast("binary"))).drop("__content")


# sinks


def write_report(grid: DataFrame, path: str, summary: DataFrame, metadata: dict[str, str]) -> None:
    """A report as three tables under one path: the grid of ranks, the summary, and what the run was."""
    grid.write.mode("overwrite").option("header", True).csv(f"{path}/grid")
    summary.write.mode("overwrite").option("header", True).csv(f"{path}/summary")
    grid.sparkSession.createDataFrame(sorted(metadata.items()), "name string, value string").coalesce(1).write.mode("overwrite").option("header", True).csv(f"{path}/metadata")


def write_json(df: DataFrame, path: str, summary: dict[str, str] | None = None) -> None:
    """JSON lines, written by Spark's committer, so that readers see all or nothing; a summary of one row beside it."""
    df.write.mode("overwrite").json(path)
    if summary:
        df.sparkSession.createDataFrame([tuple(summary.values())], list(summary)).coalesce(1).write.mode("overwrite").json(f"{path}.summary")


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def submission(ranked: DataFrame, version: str, metric: str, key: str = "query_id", name: str = "candidate_id") -> DataFrame:
    """One row of JSON {version, metric, key: [names by rank]}. The result is one document by its nature: as large as
    the queries of a submission, which one reader has to hold."""
    per = ranked.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", name))), lambda x: x[name].cast("string")).alias("names"))
    entries = per.agg(F.array_sort(F.collect_list(F.struct(F.col(key).cast("string").alias("k"), F.col("names").alias("v")))).alias("e"))
    body = F.to_json(F.map_from_entries("e"))
    head = F.to_json(F.struct(F.lit(version).alias("version"), F.lit(metric).alias("metric")))
    return entries.select(head.alias("h"), body.alias("b")).select(F.concat(F.expr("substring(h, 1, length(h) - 1)"), F.expr("if(length(b) > 2, ',', '')"), F.expr("substring(b, 2)")).alias("value"))


def read_submission(spark: SparkSession, path: str) -> DataFrame:
    """(key, names) of a submission file."""
    m = F.from_json("value", "map<string,string>")
    return spark.read.text(path, wholetext=True).select(F.explode(m).alias("key", "v")).where("key not in ('version', 'metric')").select("key", F.from_json("v", "array<string>").alias("names"))
