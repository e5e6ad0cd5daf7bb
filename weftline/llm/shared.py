"""What the operators of this subpackage share: written tables and plain text helpers."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.plans.tables import shared_folder

# The white space that separates words, as a Java regular expression and as characters.
SPACE = r"[\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\f\r"
#: How Parquet takes rows of some MB each: it looks at sizes after each row, not after the first 100, and ends a row group
#: at 16 MB. Tasks that write or read then hold a few such rows, however many there are.
WIDE = {"parquet.block.size": 16 << 20, "parquet.block.size.row.check.min": 1, "parquet.page.size.row.check.min": 1}


def saved(df: DataFrame, name: str, *, wide: bool = False) -> DataFrame:
    """df written as Parquet into the shared folder and read again: lineage ends there, and every reader sees the same rows.

    wide: rows hold some MB each.
    """
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/weftline/{name}-{uuid.uuid4().hex}"
    df.write.options(compression="zstd", **(WIDE if wide else {})).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Removes tables that `saved` wrote and nothing will read again."""
    for table in tables:
        jvm = table.sparkSession.sparkContext._jvm
        for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(table.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def words(text: Column) -> Column:
    """The words of a text, an empty array for null, empty and blank texts."""
    # btrim takes the ends off first, so that split gives no empty word beside them
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE_CHARS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE))


def hash_bucket(key: Column, digits: int = 3) -> Column:
    """The first hexadecimal digits of the key's MD5 as an integer."""
    return F.conv(F.substring(F.md5(key), 1, digits), 16, 10).cast("int")


def id_key(doc_id: Column) -> Column:
    """A record key as text; null becomes an empty key."""
    return F.coalesce(doc_id.cast("string"), F.lit(""))
