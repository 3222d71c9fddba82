"""Sources: tables in folders or databases, system catalogs, cards, business context."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

S = T.StringType()
COLUMN = T.StructType(
    [
        T.StructField("name", S),
        T.StructField("data_type", S),
        T.StructField("is_nullable", T.BooleanType()),
        T.StructField("is_primary_key", T.BooleanType()),
        T.StructField("is_foreign_key", T.BooleanType()),
        T.StructField("default_value", S),
        T.StructField("description", S),
    ]
)
FOREIGN_KEY = T.StructType(
    [
        T.StructField("column", S),
        T.StructField("referenced_table", S),
        T.StructField("referenced_column", S),
        T.StructField("constraint_name", S),
    ]
)
INDEX = T.StructType(
    [
        T.StructField("name", S),
        T.StructField("columns", T.ArrayType(S)),
        T.StructField("is_unique", T.BooleanType()),
    ]
)
CARD = T.StructType(
    [
        T.StructField("id", S),
        T.StructField("object_type", S),
        T.StructField("name", S),
        T.StructField("table", S),
        T.StructField("schema", S),
        T.StructField("description", S),
        T.StructField("columns", T.ArrayType(COLUMN)),
        T.StructField("primary_key", T.ArrayType(S)),
        T.StructField("foreign_keys", T.ArrayType(FOREIGN_KEY)),
        T.StructField("indexes", T.ArrayType(INDEX)),
        T.StructField("sample_queries", T.ArrayType(S)),
        T.StructField("business_tags", T.ArrayType(S)),
    ]
)
CONTEXT = T.StructType(
    [
        T.StructField("name", S),
        T.StructField("description", S),
        T.StructField("purpose", S),
        T.StructField("tags", T.ArrayType(S)),
        T.StructField("common_queries", T.ArrayType(S)),
        T.StructField("business_terms", T.MapType(S, T.ArrayType(S))),
        T.StructField("kpi_columns", T.MapType(S, S)),
        T.StructField("column_meanings", T.MapType(S, S)),
    ]
)


def preview(df: DataFrame, order: list[str], n: int = 10) -> DataFrame:
    """First rows in a stated order."""
    return df.orderBy(*order).limit(n)


def lookup(df: DataFrame, **key) -> DataFrame:
    """Rows with the given key values; the test reaches the scan as a pushed filter."""
    for column, value in key.items():
        df = df.where(F.col(column) == F.lit(value))
    return df


def database_table(
    spark: SparkSession,
    url: str,
    table: str,
    user: str,
    password: str,
    partition_column: str | None = None,
    bounds: tuple[int, int] | None = None,
    partitions: int = 64,
    fetch_rows: int = 10000,
) -> DataFrame:
    """Relational table over JDBC, read in parallel ranges of a numeric column when one is given."""
    reader = (
        spark.read.format("jdbc")
        .option("url", url)
        .option("dbtable", table)
        .option("user", user)
        .option("password", password)
        .option("fetchsize", fetch_rows)
        .option("pushDownAggregate", "true")
        .option("pushDownLimit", "true")
    )
    if partition_column:
        if bounds is None:
            raise ValueError("bounds are needed with partition_column")
        reader = (
            reader.option("partitionColumn", partition_column)
            .option("lowerBound", bounds[0])
            .option("upperBound", bounds[1])
            .option("numPartitions", partitions)
        )
    return reader.load()


# What each catalog table is read from; names and types as the catalog operators expect.
CATALOG_QUERIES = {
    "pg_namespace": "SELECT oid::bigint AS oid, nspname::text FROM pg_namespace",
    "pg_class": (
        "SELECT oid::bigint AS oid, relname::text, relnamespace::bigint, relkind::text FROM pg_class"
    ),
    "pg_attribute": (
        "SELECT attrelid::bigint, attname::text, attnum::int FROM pg_attribute WHERE attnum > 0"
    ),
    "pg_description": "SELECT objoid::bigint, objsubid::int, description FROM pg_description",
    "pg_index": (
        "SELECT i.relname::text AS indexname, x.indrelid::bigint, x.indisunique, "
        "string_to_array(x.indkey::text, ' ')::int[] AS indkey "
        "FROM pg_index x JOIN pg_class i ON i.oid = x.indexrelid"
    ),
    "info_columns": (
        "SELECT table_schema::text, table_name::text, column_name::text, udt_name::text, "
        "is_nullable::text, column_default::text, ordinal_position::int FROM information_schema.columns"
    ),
    "table_constraints": (
        "SELECT constraint_name::text, table_schema::text, table_name::text, constraint_type::text "
        "FROM information_schema.table_constraints"
    ),
    "key_column_usage": (
        "SELECT constraint_name::text, table_schema::text, table_name::text, column_name::text, "
        "ordinal_position::int, position_in_unique_constraint::int FROM information_schema.key_column_usage"
    ),
    "constraint_column_usage": (
        "SELECT r.constraint_name::text, r.constraint_schema::text, u.table_name::text, u.column_name::text, "
        "u.ordinal_position::int FROM information_schema.referential_constraints r "
        "JOIN information_schema.key_column_usage u ON u.constraint_name = r.unique_constraint_name "
        "AND u.constraint_schema = r.unique_constraint_schema"
    ),
}


def database_catalog(spark: SparkSession, url: str, user: str, password: str) -> dict[str, DataFrame]:
    """System catalog tables over JDBC, ready for the catalog operators."""
    reader = spark.read.format("jdbc").option("url", url).option("user", user).option("password", password)
    return {name: reader.option("query", sql).load() for name, sql in CATALOG_QUERIES.items()}


def footer_statistics(
    spark: SparkSession, paths: Mapping[str, str], columns: Mapping[str, Sequence[str]]
) -> DataFrame:
    """(table_name, row_count, column_name, min_value, max_value) of Parquet tables.

    ``columns`` are integers or dates, whose extremes the file footers hold: no data page is
    read. The aggregates are pushed into the scan in a session of their own, so the caller's
    settings stay. An empty table has 0 rows and NULL extremes.
    """
    own = spark.newSession()
    own.conf.set("spark.sql.sources.useV1SourceList", "")
    own.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    out = None
    for name, path in paths.items():
        parts = [(F.min(c), F.max(c)) for c in columns[name]]
        row = own.read.parquet(path).agg(F.count(F.lit(1)).alias("row_count"), *[e for pair in parts for e in pair])
        ends = row.columns[1:]
        spread = ", ".join(
            f"'{c}', string(`{ends[2 * i]}`), string(`{ends[2 * i + 1]}`)" for i, c in enumerate(columns[name])
        )
        row = row.select(
            F.lit(name).alias("table_name"),
            # Where no file holds a row, the sum of the pushed counts is NULL, though a count is
            # planned as never NULL; ``nullif`` keeps the planner from dropping the default.
            F.coalesce(F.nullif("row_count", F.lit(-1)), F.lit(0).cast("bigint")).alias("row_count"),
            F.expr(f"stack({len(parts)}, {spread}) as (column_name, min_value, max_value)"),
        )
        out = row if out is None else out.unionAll(row)
    return out


def lake_catalog(
    spark: SparkSession,
    tables: Mapping[str, DataFrame],
    keys: Mapping[str, Sequence[str]],
    references: Mapping[str, Sequence[tuple[str, str, str]]] | None = None,
    not_null: Mapping[str, Sequence[str]] | None = None,
    schema: str = "lake",
) -> dict[str, DataFrame]:
    """Catalog of a folder of tables, from their schemas and declared constraints.

    Only metadata passes through the driver: one row per column or constraint.
    Returns the inputs of :func:`vigilframe.operators.catalog.cards`.
    """
    references, not_null = references or {}, not_null or {}
    cols = [
        (
            schema, name, f.name, f.dataType.simpleString(), f.name not in set(not_null.get(name, ())),
            None, "", i,
        )
        for name, df in tables.items()
        for i, f in enumerate(df.schema.fields, start=1)
    ]
    pks = [(schema, name, c, i) for name, key in keys.items() for i, c in enumerate(key, start=1)]
    fks = [
        (schema, name, column, f"{schema}.{table}", target, f"fk_{name}_{column}")
        for name, found in references.items()
        for column, table, target in found
    ]
    table = "table_schema string, table_name string"
    return {
        "tabs": spark.createDataFrame([(schema, n, "") for n in tables], f"{table}, table_comment string"),
        "cols": spark.createDataFrame(
            cols,
            f"{table}, column_name string, data_type string, is_nullable boolean, column_default string, "
            "column_comment string, ordinal_position int",
        ),
        "pks": spark.createDataFrame(pks, f"{table}, column_name string, ordinal_position int"),
        "fks": spark.createDataFrame(
            fks,
            f"{table}, column_name string, referenced_table string, referenced_column string, "
            "constraint_name string",
        ),
        "idx": spark.createDataFrame(
            [], f"{table}, indexname string, columns array<string>, is_unique boolean"
        ),
    }


def cards(spark: SparkSession, path: str, one_per_file: bool = False) -> DataFrame:
    """Table cards from JSON: one document per file, or one per line."""
    return spark.read.schema(CARD).option("multiLine", one_per_file).json(path)


def business_context(spark: SparkSession, yaml_path: str) -> DataFrame:
    """Business context of tables from one mapping file (a small, hand-written dimension)."""
    try:
        import yaml
    except ImportError as exc:
        raise RuntimeError("reading a YAML mapping needs the yaml module") from exc
    mapping = yaml.safe_load(Path(yaml_path).read_text(encoding="utf-8")) or {}
    fields = [f.name for f in CONTEXT.fields if f.name != "name"]
    rows = [(name, *[entry.get(f) for f in fields]) for name, entry in mapping.items()]
    return spark.createDataFrame(rows, CONTEXT)
