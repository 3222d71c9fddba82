"""Catalog joins and cards (C4-C12), card sinks (A4-A6), search documents (I1-I3, I11)."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigilframe.functions import scalars
from vigilframe.operators import catalog as C
from vigilframe.session import new_table_path, written
from vigilframe.sources import readers, sinks
from vigilframe.suite.base import query

USER = "NOT IN ('pg_catalog', 'information_schema')"

# The twins read the derived catalog by what its tables mean, not by joining them as the library does:
# a table is an order, its schema a nation, a column a line of the order.
OWNERS = f"""(SELECT c.oid, c.relname AS table_name, c.relkind, c.relnamespace AS space,
      (SELECT n.nspname FROM {{pg_namespace}} n WHERE n.oid = c.relnamespace) AS table_schema
    FROM {{pg_class}} c
    WHERE c.relnamespace IN (SELECT n.oid FROM {{pg_namespace}} n WHERE n.nspname {USER}))"""
TABLES = f"""
    SELECT table_schema, table_name, CASE WHEN space < 20 THEN 'Orders table ' || table_name ELSE '' END AS table_comment
    FROM {OWNERS} WHERE relkind = 'r'"""


def tables(t):
    return C.tables(t.pg_class, t.pg_namespace, t.pg_description)


@query("c4_catalog_tables", TABLES)
def _(t):
    return tables(t)


COLUMNS = f"""
    SELECT o.table_schema, o.table_name, a.attname AS column_name,
      CASE WHEN a.flag = 'A' THEN 'int4' WHEN a.flag = 'N' THEN 'varchar' ELSE 'timestamptz' END AS data_type,
      a.line_status <> 'F' AS is_nullable, CASE WHEN a.weight >= 45 THEN 'now()' END AS column_default,
      CASE WHEN a.flag = 'R' THEN 'Part ' || CAST(a.ref_key AS STRING) ELSE '' END AS column_comment,
      a.attnum AS ordinal_position
    FROM {{pg_attribute}} a, {OWNERS} o WHERE a.attrelid = o.oid"""


def columns(t, nested=False):
    return C.columns(t.info_columns, t.pg_class, t.pg_namespace, t.pg_attribute, t.pg_description, nested)


@query("c5_catalog_columns", COLUMNS)
def _(t):
    return columns(t)


# Lines of large quantity form the key.
PKS = f"""
    SELECT o.table_schema, o.table_name, a.attname AS column_name, a.attnum AS ordinal_position
    FROM {{pg_attribute}} a, {OWNERS} o WHERE a.attrelid = o.oid AND a.weight >= 30"""


def primary_keys(t, nested=False):
    return C.primary_keys(t.table_constraints, t.key_column_usage, nested)


@query("c6_primary_keys", PKS)
def _(t):
    return primary_keys(t)


# Every flagged column points somewhere: alone to the id of its part's table, or, in one
# table of five, together with the others to the columns of one table.
FKS = f"""
    SELECT o.table_schema, o.table_name, a.attname AS column_name,
      CASE WHEN a.attrelid % 5 = 0 THEN o.table_schema || '.tbl_' || CAST(a.attrelid + 1 AS STRING)
           ELSE o.table_schema || '.tbl_' || CAST(a.ref_key AS STRING) END AS referenced_table,
      CASE WHEN a.attrelid % 5 = 0 THEN 'ref_' || CAST(a.attnum AS STRING) ELSE 'id' END AS referenced_column,
      CASE WHEN a.attrelid % 5 = 0 THEN 'fkc_' || o.table_name
           ELSE 'fk_' || o.table_name || '_' || a.attname END AS constraint_name
    FROM {{pg_attribute}} a, (SELECT c.oid, c.relname AS table_name,
        (SELECT n.nspname FROM {{pg_namespace}} n WHERE n.oid = c.relnamespace) AS table_schema
      FROM {{pg_class}} c) o
    WHERE o.oid = a.attrelid AND a.flag = 'A' AND o.table_schema {USER}"""


def foreign_keys(t):
    return C.foreign_keys(t.table_constraints, t.key_column_usage, t.constraint_column_usage)


@query("c7_foreign_keys", FKS)
def _(t):
    return foreign_keys(t)


INDEXES = f"""
    SELECT n.nspname AS table_schema, c.relname AS table_name, k.indexname,
      string_agg('col_' || CAST(k.attnum AS STRING), ',' ORDER BY k.weight DESC, k.attnum DESC) AS cols,
      bool_or(k.indisunique) AS is_unique
    FROM {{index_keys}} k JOIN {{pg_class}} c ON c.oid = k.indrelid
    JOIN {{pg_namespace}} n ON n.oid = c.relnamespace
    WHERE n.nspname {USER} GROUP BY 1, 2, 3"""


def indexes(t, nested=False):
    keys = F.sort_array(F.collect_list(F.struct("weight", "attnum")), asc=False)
    pg_index = t.index_keys.groupBy("indrelid", "indexname", "indisunique").agg(
        F.transform(keys, lambda k: k["attnum"]).alias("indkey")
    )
    return C.index_columns(pg_index, t.pg_class, t.pg_namespace, t.pg_attribute, nested)


@query("c8_index_columns", INDEXES)
def _(t):
    return indexes(t).select(*C.TABLE, "indexname", F.array_join("columns", ",").alias("cols"), "is_unique")


@query(
    "d17_index_uniqueness",
    f"""SELECT table_schema, is_unique, count(*) AS indexes FROM ({INDEXES}) GROUP BY 1, 2""",
)
def _(t):
    return indexes(t).groupBy("table_schema", "is_unique").agg(F.count(F.lit(1)).alias("indexes"))


def cards(t):
    t.keep("pg_class", "pg_attribute")
    return C.cards(tables(t), columns(t, nested=True), primary_keys(t, nested=True), foreign_keys(t), indexes(t, nested=True))


_KEY = "table_schema || '.' || table_name"
CARD_PARTS = f"""
    tabs AS MATERIALIZED ({TABLES}), cols AS MATERIALIZED ({COLUMNS}), pks AS MATERIALIZED ({PKS}),
    fks AS MATERIALIZED ({FKS}), idx AS ({INDEXES}),
    flagged AS MATERIALIZED (
      SELECT c.*, p.column_name IS NOT NULL AS is_pk, f.column_name IS NOT NULL AS is_fk
      FROM cols c LEFT JOIN pks p USING (table_schema, table_name, column_name)
      LEFT JOIN fks f USING (table_schema, table_name, column_name)),
    col_text AS (
      SELECT table_schema, table_name, count(*) AS n,
        string_agg(column_name || ':' || data_type || CASE WHEN is_pk AND is_fk THEN ' (PK, FK)'
          WHEN is_pk THEN ' (PK)' WHEN is_fk THEN ' (FK)' ELSE '' END, '; ' ORDER BY ordinal_position) AS ct,
        string_agg(column_name, ', ' ORDER BY ordinal_position) AS names
      FROM flagged GROUP BY 1, 2),
    pk_text AS (
      SELECT table_schema, table_name, string_agg(column_name, ', ' ORDER BY ordinal_position) AS pt,
        string_agg(column_name || ' = :' || column_name, ' AND ' ORDER BY ordinal_position) AS predicate
      FROM pks GROUP BY 1, 2),
    fk_text AS (
      SELECT table_schema, table_name,
        string_agg(column_name || ' -> ' || referenced_table || '(' || referenced_column || ')', '; '
          ORDER BY column_name) AS ft,
        string_agg('SELECT t.* FROM ' || {_KEY} || ' t JOIN ' || referenced_table || ' r ON t.' || column_name
          || ' = r.' || referenced_column || ' LIMIT 10;', ' | ' ORDER BY column_name)
          FILTER (WHERE rn <= 2) AS joins
      FROM (SELECT *, row_number() OVER (PARTITION BY table_schema, table_name ORDER BY column_name) AS rn
            FROM fks) GROUP BY 1, 2),
    ix_text AS (
      SELECT table_schema, table_name, string_agg(indexname || CASE WHEN is_unique THEN ' (UNIQUE) on '
          ELSE ' (NON-UNIQUE) on ' END || replace(cols, ',', ', '), '; ' ORDER BY indexname) AS xt
      FROM idx GROUP BY 1, 2),
    card AS (
      SELECT {_KEY} AS id, table_schema, table_name, nullif(table_comment, '') AS description,
        coalesce(n, 0) AS num_columns, ct, names, coalesce(pt, '') AS pt, ft, xt,
        concat_ws(' | ', 'SELECT * FROM ' || {_KEY} || ' LIMIT 10;',
          'SELECT * FROM ' || {_KEY} || ' WHERE ' || predicate || ';', joins) AS samples
      FROM tabs LEFT JOIN col_text USING (table_schema, table_name)
      LEFT JOIN pk_text USING (table_schema, table_name) LEFT JOIN fk_text USING (table_schema, table_name)
      LEFT JOIN ix_text USING (table_schema, table_name))"""


@query(
    "c9_table_cards",
    f"""WITH {CARD_PARTS}
        SELECT id, description, ct AS columns_text, pt AS primary_key, coalesce(ft, '') AS relations_text,
          coalesce(xt, '') AS indexes_text, samples AS sample_queries FROM card""",
)
def _(t):
    blank = F.lit("")
    return cards(t).select(
        "id",
        "description",
        C.columns_text(F.col("columns")).alias("columns_text"),
        F.array_join("primary_key", ", ").alias("primary_key"),
        F.coalesce(C.relations_text(F.col("foreign_keys")), blank).alias("relations_text"),
        F.coalesce(C.indexes_text(F.col("indexes")), blank).alias("indexes_text"),
        F.array_join("sample_queries", " | ").alias("sample_queries"),
    )


@query(
    "g2_key_flags",
    f"WITH {CARD_PARTS} SELECT {_KEY} AS id, column_name, is_pk, is_fk FROM flagged "
    "JOIN tabs USING (table_schema, table_name)",
)
def _(t):
    c = cards(t).select("id", F.explode("columns").alias("c"))
    return c.select(
        "id",
        F.col("c.name").alias("column_name"),
        F.col("c.is_primary_key").alias("is_pk"),
        F.col("c.is_foreign_key").alias("is_fk"),
    )


@query(
    "a6_card_index",
    f"""WITH {CARD_PARTS} SELECT id, id AS name, table_schema AS "schema", id AS "table",
          CAST(num_columns AS INT) AS num_columns FROM card""",
)
def _(t):
    """Cards written as JSON and read back (A5); their summary written beside them and read back."""
    root = new_table_path(t.spark, "cards")
    sinks.write_cards(cards(t), f"{root}/cards")
    stored = readers.cards(t.spark, f"{root}/cards")
    sinks.write_card_index(stored, f"{root}/index")
    index = t.spark.read.schema(sinks.card_index(stored).schema).json(f"{root}/index")
    return index.withColumn("num_columns", F.greatest("num_columns", F.lit(0)))


# --- business context -------------------------------------------------------------------


def context(t):
    """Business context documents from the per-table and per-column rows."""
    cols = t.context_columns
    meanings = cols.groupBy("name").agg(
        F.map_from_entries(F.collect_list(F.struct("column_name", "meaning"))).alias("column_meanings"),
        F.map_from_entries(
            F.collect_list(F.when(F.col("kpi_description").isNotNull(), F.struct("column_name", "kpi_description")))
        ).alias("kpi_columns"),
    )
    base = t.context_tables.select(
        "name", "description", "purpose",
        F.split("tags_csv", ",").alias("tags"),
        F.split("queries_text", r"\|").alias("common_queries"),
        F.create_map("term", F.split("synonyms_text", r"\|")).alias("business_terms"),
    )
    return base.join(meanings, "name", "left")


def enriched(t):
    """Cards with their context. Whole cards are dealt once more, by name: a query that also indexes them writes them first, so
    that what they were made from is off the disk by then."""
    return C.enrich(written(cards(t), "cards") if t.writes_cards else cards(t), context(t))


@query(
    "c10_context_unmatched",
    f"WITH {CARD_PARTS} SELECT id AS name FROM card WHERE id NOT IN (SELECT name FROM {{context_tables}})",
)
def _(t):
    return C.unmatched(cards(t), context(t))


@query(
    "c11_column_meanings",
    f"""WITH {CARD_PARTS}
        SELECT c.id, f.column_name,
          CASE WHEN t.name IS NOT NULL AND x.meaning IS NOT NULL THEN x.meaning
               ELSE nullif(f.column_comment, '') END AS description,
          t.name IS NOT NULL AND x.kpi_description IS NOT NULL AS is_kpi,
          CASE WHEN t.name IS NOT NULL THEN x.kpi_description END AS kpi_description
        FROM card c JOIN flagged f USING (table_schema, table_name)
        LEFT JOIN {{context_tables}} t ON t.name = c.id
        LEFT JOIN {{context_columns}} x ON x.name = c.id AND x.column_name = f.column_name""",
)
def _(t):
    c = enriched(t).select("id", F.explode("columns").alias("c"))
    return c.select(
        "id", F.col("c.name").alias("column_name"), F.col("c.description").alias("description"),
        F.coalesce("c.is_kpi", F.lit(False)).alias("is_kpi"), F.col("c.kpi_description").alias("kpi_description"),
    )


@query(
    "c12_fk_sample_lineitem_orders",
    """SELECT l.* FROM {lineitem} l JOIN {orders} o ON l.l_orderkey = o.o_orderkey
       ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice LIMIT 10""",
)
def _(t):
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    # o_orderkey is a declared key, so a semi join returns the same rows as the join.
    joined = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi")
    return readers.preview(joined, order)


_CTX = """
    ctx AS (SELECT t.name, t.description, t.purpose, t.queries_text, t.term,
              replace(t.synonyms_text, '|', ', ') AS syn FROM {context_tables} t),
    kpi AS (SELECT x.name, string_agg(x.column_name || ': ' || x.kpi_description, '; ' ORDER BY f.ordinal_position)
              AS kt, string_agg('  - ' || x.column_name || '(' || f.data_type || '): ' || x.kpi_description, chr(10)
              ORDER BY f.ordinal_position) AS kt2
            FROM {context_columns} x JOIN flagged f
              ON f.table_schema || '.' || f.table_name = x.name AND f.column_name = x.column_name
            WHERE x.kpi_description IS NOT NULL AND x.name IN (SELECT name FROM ctx) GROUP BY x.name)"""
_L = C.CONTENT
_S = C.SEARCHABLE
DOCUMENTS = f"""
    WITH {CARD_PARTS}, {_CTX}
    SELECT 'acme_db1_' || replace(c.id, '.', '_') AS id, c.table_schema AS db_schema, c.id AS table_name,
      c.id AS display_name, coalesce(x.description, c.description, '') AS description,
      concat_ws(chr(10), '{_L['name']}: ' || c.id,
        '{_L['description']}: ' || nullif(coalesce(x.description, c.description), ''),
        '{_L['purpose']}: ' || x.purpose,
        '{_L['queries']}: ' || replace(x.queries_text, '|', ' | '),
        '{_L['terms']}: ' || x.term || '(' || x.syn || ')',
        '{_L['kpi']}: ' || k.kt,
        '{_L['columns']}: ' || coalesce(c.ct, ''),
        '{_L['primary_key']}: ' || c.pt,
        '{_L['foreign_keys']}: ' || c.ft,
        '{_L['indexes']}: ' || c.xt,
        '{_L['samples']}: ' || c.samples) AS content,
      coalesce(c.ct, '') AS columns_text, coalesce(c.ft, '') AS relations_text,
      c.samples AS sample_queries_text, 'acme' AS tenant_id, 'db1' AS connection_id, c.id AS table_id
    FROM card c LEFT JOIN ctx x ON x.name = c.id LEFT JOIN kpi k ON k.name = c.id"""


def documents(t):
    return C.search_documents(enriched(t), F.lit("acme"), F.lit("db1"))


@query("i1_search_documents", DOCUMENTS)
def _(t):
    return documents(t).drop("business_tags")


@query(
    "i2_searchable_text",
    f"""WITH {CARD_PARTS}, {_CTX}
        SELECT c.id, concat_ws(chr(10), '{_S['name']}: ' || c.id,
          '{_S['description']}: ' || nullif(coalesce(x.description, c.description), ''),
          '{_S['purpose']}: ' || x.purpose,
          '{_S['kpi']}:' || chr(10) || k.kt2,
          '{_S['columns']}: ' || coalesce(c.names, ''),
          '{_S['queries']}:' || chr(10) || '  - ' || replace(x.queries_text, '|', chr(10) || '  - '),
          '{_S['terms']}:' || chr(10) || '  - ' || x.term || ': ' || x.syn,
          '{_S['samples']}:' || chr(10) || '  ' || array_to_string(string_split(c.samples, ' | ')[1:3],
             chr(10) || '  ')) AS searchable_text
        FROM card c LEFT JOIN ctx x ON x.name = c.id LEFT JOIN kpi k ON k.name = c.id""",
)
def _(t):
    return C.searchable_text(enriched(t))


@query(
    "i3_enriched_cards",
    f"""WITH {CARD_PARTS}
        SELECT c.id, coalesce(t.description, c.description) AS description, t.purpose AS business_purpose,
          coalesce(t.queries_text, '') AS common_queries, coalesce(t.tags_csv, '') AS tags,
          coalesce(t.term || '(' || replace(t.synonyms_text, '|', ', ') || ')', '') AS terms
        FROM card c LEFT JOIN {{context_tables}} t ON t.name = c.id""",
)
def _(t):
    blank = F.lit("")
    return enriched(t).select(
        "id", "description", "business_purpose",
        F.coalesce(F.array_join("common_queries", "|"), blank).alias("common_queries"),
        F.array_join("business_tags", ",").alias("tags"),
        F.coalesce(scalars.term_list(F.col("business_terms")), blank).alias("terms"),
    )


@query(
    "i11_common_queries",
    f"SELECT 'acme_db1_' || replace(c.id, '.', '_') AS id, coalesce(t.queries_text, '') AS common_queries "
    f"FROM (WITH {CARD_PARTS} SELECT id FROM card) c LEFT JOIN {{context_tables}} t ON t.name = c.id",
)
def _(t):
    return C.common_queries(documents(t)).select("id", F.array_join("common_queries", "|").alias("common_queries"))


# Whole-number columns of the given tables.
NUMBERS = {
    "region": ["r_regionkey"],
    "nation": ["n_nationkey", "n_regionkey"],
    "customer": ["c_custkey", "c_nationkey"],
    "supplier": ["s_suppkey", "s_nationkey"],
    "part": ["p_partkey", "p_size"],
    "orders": ["o_orderkey", "o_custkey"],
    "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"],
    "events": ["event_id", "user_id"],
    "documents": ["doc_id", "n_chars"],
    "embeddings": ["vec_id", "label"],
    "pages": ["page_id"],
    "benchmark": ["item_id"],
    "labels": ["doc_id", "quality", "toxic"],
    "conversations": ["conv_id", "turn"],
}


@query(
    "a4_table_statistics",
    " UNION ALL ".join(
        f"SELECT '{table}' AS table_name, count(*) AS row_count, '{c}' AS column_name, "
        f"CAST(min({c}) AS VARCHAR) AS min_value, CAST(max({c}) AS VARCHAR) AS max_value FROM {table}"
        for table, columns in NUMBERS.items()
        for c in columns
    ),
)
def _(t):
    paths = {name: f"{t.folder}/{name}.parquet" for name in NUMBERS}
    return readers.footer_statistics(t.spark, paths, NUMBERS)
