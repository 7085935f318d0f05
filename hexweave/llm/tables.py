"""What the operators share on the Spark side: reading, folds, passing a column through Arrow."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from hexweave.llm.text import chunks
from hexweave.storage import cut, shared_dir

#: Rows of texts, or of pairs of texts, that go to Python at a time.
TEXT_ROWS = 500


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(column: str, parts: int) -> Column:
    """crc32 of the id as text, modulo `parts`; null for a null id."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % parts


def text_struct(schema: str, kernel: Callable[[object], dict[str, np.ndarray | list]]) -> Column:
    """A struct of what `kernel` says of a row's `text`: it gets chunks of texts and gives a dict of columns.

    `schema` names the struct's fields in DDL. Other columns stay on the JVM's side, whatever their names.
    """
    kind = to_arrow_type(T.StructType.fromDDL(schema))

    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            parts = []
            for _, texts in chunks(column):
                made = kernel(texts)
                fields = [made[f.name] if isinstance(made[f.name], pa.Array) else pa.array(made[f.name], f.type) for f in kind]
                parts.append(pa.StructArray.from_arrays(fields, fields=list(kind)))
            yield pa.concat_arrays(parts) if parts else pa.array([], kind)

    return F.arrow_udf(run, schema)(F.col("text"))


def own_name(columns: list[str], wanted: str) -> str:
    """`wanted`, or with a number where a column has that name already (Spark's names ignore case)."""
    taken = {c.lower() for c in columns}
    return next(n for n in (wanted, *(f"{wanted}_{k}" for k in range(len(taken) + 1))) if n.lower() not in taken)


def map_texts(
    docs: DataFrame, keep: list[str], schema: str, kernel: Callable[[object], dict[str, np.ndarray | list]]
) -> DataFrame:
    """Each row's kept columns and, beside them, what `kernel` says of its `text`; only the text goes to Python."""
    own = own_name(docs.columns, "told")
    return docs.select(*keep, text_struct(schema, kernel).alias(own)).select(*keep, f"{own}.*")


def cut_texts(df: DataFrame, rows: int = TEXT_ROWS) -> DataFrame:
    """cut(df) where texts go to Python: in batches of at most `rows` rows, which bounds what both sides hold of them."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = conf.get(key)
    conf.set(key, rows)
    try:
        return cut(df)
    finally:
        conf.set(key, was)


def cut_buckets(df: DataFrame, by: str, buckets: int, rows: int = TEXT_ROWS) -> DataFrame:
    """cut_texts(df) as a table in `buckets` buckets by the column `by`, which a grouping by it need not shuffle again."""
    spark = df.sparkSession
    name, key = f"cut_{uuid.uuid4().hex}", "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(key)
    spark.conf.set(key, rows)
    try:
        df.write.format("parquet").option("compression", "zstd").bucketBy(buckets, by).option("path", f"{shared_dir(spark)}/{name}").saveAsTable(name)
    finally:
        spark.conf.set(key, was)
    return spark.table(name)


def whole_groups(rows: DataFrame, kernel: Callable[[pa.Table], Iterator[pa.RecordBatch]], schema: str, order: tuple[str | Column, ...] = ()) -> DataFrame:
    """What `kernel` makes of tables that hold whole groups, one or more, sorted by the column `group` and then `order`.

    A task holds the rows of one group and a batch more, so groups are to be of a bounded size.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            group = batch.column(batch.schema.get_field_index("group")).to_numpy()
            ends = np.flatnonzero(np.append(group[1:] != group[:-1], False)) + 1
            if held and len(group) and held[-1].column(batch.schema.get_field_index("group"))[-1].as_py() != group[0]:
                yield from kernel(pa.Table.from_batches(held))
                held = []
            if len(ends):
                yield from kernel(pa.Table.from_batches([*held, batch.slice(0, ends[-1])]))
                held = []
            if batch.num_rows:
                held.append(batch.slice(ends[-1] if len(ends) else 0))
        if held:
            yield from kernel(pa.Table.from_batches(held))

    return rows.repartition("group").sortWithinPartitions("group", *order).mapInArrow(run, schema)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, parts: int = 5, held_out: int = 0) -> DataFrame:
    """(text, y): at most `per_class` rows of each label, from rows outside the held-out fold, in an order by hash.

    A document with several labels has the largest. The chosen ids, at most 2 * per_class, are what is broadcast.
    """
    known = labels.filter(F.col(label).isin(0, 1) & (fold("doc_id", parts) != held_out)).groupBy("doc_id").agg(F.max(label).alias("y"))
    order = (F.xxhash64("doc_id"), "doc_id")
    picked = known.filter("y = 0").orderBy(*order).limit(per_class).unionByName(known.filter("y = 1").orderBy(*order).limit(per_class))
    return docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("text", "y")
