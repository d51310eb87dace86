"""Records of training sets: shapes, sources, images, batches and the tables of named strategies."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.functions import text as X
from tessel.functions import vectors as V
from tessel.operators.numbering import numbered


def captions(value: Column) -> Column:
    """The captions in a value of any of the shapes in which they are saved, as JSON: a list, lists in a list, an object
    of lists (the longest, of equal ones the first key's), an object of objects (all their values) or of texts, a text."""
    t = F.trim(value)
    nested = F.flatten(F.from_json(t, "array<array<string>>"))
    listed = F.from_json(t, "array<string>")
    values = F.transform(F.array_sort(F.map_entries(F.from_json(t, "map<string,string>"))), lambda e: e["value"])
    lists = F.transform(F.filter(values, lambda v: v.startswith("[")), lambda v: F.from_json(v, "array<string>"))
    longest = F.aggregate(lists, F.array().cast("array<string>"), lambda a, x: F.when(F.size(x) > F.size(a), x).otherwise(a))
    inner = F.flatten(F.transform(F.filter(values, lambda v: v.startswith("{")), lambda v: F.map_values(F.from_json(v, "map<string,string>"))))
    plain = F.filter(values, lambda v: v.isNotNull())
    object_ = F.when(F.size(lists) > 0, longest).when(F.size(inner) > 0, inner).otherwise(plain)
    return F.when(t.rlike(r"^\[\s*\["), nested).when(t.startswith("["), listed).when(t.startswith("{"), object_).when(F.length(t) > 0, F.array(t)).otherwise(F.array().cast("array<string>"))


def with_source(rows: DataFrame, name: str, column: str = "global_dataset_name") -> DataFrame:
    """``rows`` with the name of the dataset that they are from."""
    return rows.withColumn(column, F.lit(name))


def basename(path: Column) -> Column:
    return F.element_at(F.split(F.regexp_replace(path, "/+$", ""), "/"), -1)


def same_image(a: Column, b: Column, base: str) -> Column:
    """Whether two paths name one image: as whole paths under ``base``, or by their last names where one is only a name.
    A null names nothing."""
    whole = X.full_path(a, base) == X.full_path(b, base)
    only = ~a.contains("/") | ~b.contains("/")
    return F.coalesce(whole | (only & (basename(a) == basename(b))), F.lit(False))


def other_images(rows: DataFrame, candidate: str, reference: str, target: str, base: str) -> DataFrame:
    """The rows whose candidate is neither the reference's image nor the target's."""
    return rows.where(~same_image(F.col(candidate), F.col(reference), base) & ~same_image(F.col(candidate), F.col(target), base))


def gathered(rows: DataFrame, rank: str, place: str, out: str = "pos") -> DataFrame:
    """The rows of all workers as one list: by the worker's rank, and by their place in its list."""
    return numbered(rows, rank, place, out=out)


def batch_share(share: Column, whole: Column | int) -> Column:
    """A source's part of a batch: a share of the whole up to 1, else a number of rows."""
    whole = whole if isinstance(whole, Column) else F.lit(whole)
    return F.floor(F.when(share <= 1, share * whole).otherwise(share)).cast("long")


def mapped(rows: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str, order: str | None = None) -> DataFrame:
    """``fn`` over batches of rows; with ``order`` they carry their place in it in a column ``index``."""
    given = numbered(rows, order, out="index") if order else rows

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield fn(pdf)

    return given.mapInPandas(of, schema)


def filtered(rows: DataFrame, keep: Callable[[pd.DataFrame], pd.Series], order: str | None = None) -> DataFrame:
    """The rows for which ``keep`` holds, which sees batches of rows."""
    given = numbered(rows, order, out="index") if order else rows
    return given.mapInPandas(lambda batches: (pdf[keep(pdf)] for pdf in batches), given.schema).select(*rows.columns)


def collated(rows: DataFrame, lists: list[str], size: int, order: str) -> DataFrame:
    """(batch, slot, lists...): the parallel lists of each row flattened, ``size`` rows to a batch in the order given; slot
    is the place of an item in its batch's rows: (place of the row, place in its lists)."""
    placed = numbered(rows.select(order, *lists), order, out="at")
    flat = placed.select(F.floor(F.col("at") / size).alias("batch"), F.pmod("at", F.lit(size)).alias("row"), F.posexplode(F.arrays_zip(*lists)).alias("item", "x"))
    return flat.select("batch", "row", "item", *[F.col("x")[c].alias(c) for c in lists])


class Dataset(ABC):
    """A dataset of original and generated samples, by hooks that give DataFrames of the same columns."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    @abstractmethod
    def load(self) -> DataFrame:
        """The annotations."""

    @abstractmethod
    def original(self, rows: DataFrame) -> DataFrame:
        """Samples of annotations."""

    def augmented(self, rows: DataFrame) -> DataFrame:
        """Samples that were generated for annotations; none by default."""
        return self.original(rows).limit(0)

    def samples(self) -> DataFrame:
        rows = self.load()
        first = self.original(rows).withColumn("is_augmented", F.lit(False))
        return first.unionByName(self.augmented(rows).withColumn("is_augmented", F.lit(True)), allowMissingColumns=True)


#: What makes a model's input of an instruction and a text, by the family of models.
PROCESSORS: dict[str, Callable[[Column, Column], Column]] = {family: lambda instruction, text, family=family: X.prompt(instruction, text, F.lit(family), image=True) for family in ("qwen2_vl", "qwen2_5_vl", "llava")}


def process(family: Column, instruction: Column, text: Column) -> Column:
    """The input for each row's family; a family without a processor raises."""
    out = F.raise_error(F.concat(F.lit("no processor for "), family)).cast("string")
    for name, make in PROCESSORS.items():
        out = F.when(family == name, make(instruction, text)).otherwise(out)
    return out


#: Losses by name: each makes a column of the similarities of the target and of the other candidates of a row.
LOSSES: dict[str, Callable[[Column, Column], Column]] = {}


def loss(name: str):
    """Registers a loss."""

    def register(make: Callable[[Column, Column], Column]) -> Callable[[Column, Column], Column]:
        if name in LOSSES:
            raise ValueError(f"loss {name} is there already")
        LOSSES[name] = make
        return make

    return register


@loss("info_nce")
def info_nce(own: Column, others: Column, temperature: float = 0.07) -> Column:
    scaled = F.transform(F.concat(F.array(own), others), lambda x: x / F.lit(temperature))
    top = F.array_max(scaled)
    return F.log(F.aggregate(scaled, F.lit(0.0), lambda s, x: s + F.exp(x - top))) + top - own / F.lit(temperature)


@loss("margin")
def margin(own: Column, others: Column, gap: float = 0.2) -> Column:
    return F.aggregate(others, F.lit(0.0), lambda s, x: s + F.greatest(x - own + F.lit(gap), F.lit(0.0))) / F.greatest(F.size(others), F.lit(1))


def pooled(hidden: Column, mask: Column) -> Column:
    """The hidden state of the last token that the mask holds."""
    return V.last_token(hidden, mask)
