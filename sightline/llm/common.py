"""What the operators share: tables, shared storage, word splitting, worker-side Arrow maps."""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sightline.session import shared_folder

TOKENIZERS = os.environ.get("PUBLIC_TOKENIZERS", "/opt/tokenizers")

#: A word is a run of anything but ASCII white space.
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def vocabulary(name: str) -> str:
    """Place of a public tokenizer's file: `public_tokenizers.path`, or the folder in TOKENIZERS."""
    try:
        import public_tokenizers
    except ImportError:
        return os.path.join(TOKENIZERS, name)
    return public_tokenizers.path(name)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def fresh_folder(spark: SparkSession, label: str) -> str:
    """A new path below the folder that driver and executors share."""
    return f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """`df` as a Parquet table in the shared folder, so that later jobs reread it and never redo it."""
    path = fresh_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def words(text: Column) -> Column:
    """Words of a text as an array without nulls or empty strings (null: none).

    ASCII white space becomes a blank first: replacing and splitting at one literal character is
    many times cheaper in the JVM than a pattern.
    """
    plain = F.coalesce(text, F.lit(""))
    for c in "\t\n\x0b\x0c\r":
        plain = F.replace(plain, F.lit(c), F.lit(" "))
    return F.array_remove(F.split(plain, " "), "")


def unused(columns: list[str], name: str) -> str:
    """`name`, with underscores before it until no column is called so, in upper or lower case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def arrow_map(df: DataFrame, batch: Callable[[pa.RecordBatch], dict | None], schema: str | StructType) -> DataFrame:
    """`batch` turns one Arrow batch into columns of `schema` (any number of rows)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            if part.num_rows:
                columns = batch(part)
                if columns is not None:
                    yield pa.RecordBatch.from_pydict(columns)

    return df.mapInArrow(run, schema)
