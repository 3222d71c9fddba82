"""Scalar functions (H) and small filters over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigilframe.functions import scalars
from vigilframe.operators import catalog as C
from vigilframe.operators import search as S
from vigilframe.operators.quality import pct, text_columns
from vigilframe.session import new_table_path
from vigilframe.sources import readers, sinks
from vigilframe.suite.base import query
from vigilframe.suite.catalog import FKS, PKS, USER, context, foreign_keys, primary_keys
from vigilframe.suite.search import bench_queries, scores_sql, written_index


@query(
    "a5_card_source",
    """SELECT 'tbl_' || CAST(o_orderkey AS STRING) AS id, o_orderpriority AS description,
         count(l.l_orderkey) AS n FROM {orders} LEFT JOIN {lineitem} l ON o_orderkey = l_orderkey
       GROUP BY o_orderkey, o_orderpriority""",
)
def _(t):
    """Documents with nested columns written as JSON and read with the card schema."""
    cols = t.lineitem.groupBy("l_orderkey").agg(
        F.sort_array(F.collect_list(F.struct(F.concat(F.lit("c"), F.col("l_linenumber").cast("string")).alias("name"))))
        .alias("columns")
    )
    cards = t.orders.join(cols, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(
        F.concat(F.lit("tbl_"), F.col("o_orderkey").cast("string")).alias("id"),
        F.col("o_orderpriority").alias("description"),
        "columns",
    )
    path = new_table_path(t.spark, "cards")
    sinks.write_cards(cards, path)
    back = readers.cards(t.spark, path)
    size = F.when(F.col("columns").isNull(), 0).otherwise(F.size("columns"))
    return back.select("id", "description", size.cast("bigint").alias("n"))


@query(
    "b12_user_schemas",
    f"SELECT c.oid, n.nspname FROM {{pg_class}} c JOIN {{pg_namespace}} n ON c.relnamespace = n.oid "
    f"WHERE c.relkind = 'r' AND n.nspname {USER}",
)
def _(t):
    spaces = C.user_schemas(t.pg_namespace, "nspname").withColumnRenamed("oid", "relnamespace")
    return t.pg_class.where(F.col("relkind") == "r").join(spaces, "relnamespace").select("oid", "nspname")


@query(
    "b13_category_columns",
    """SELECT 'o_orderstatus' AS column_name, count(DISTINCT o_orderstatus) AS categories FROM {orders}
       UNION ALL SELECT 'o_orderpriority', count(DISTINCT o_orderpriority) FROM {orders}""",
)
def _(t):
    """Text columns found in the schema, with their number of categories."""
    names = text_columns(t.orders)
    values = t.orders.select(*names).unpivot([], names, "column_name", "value").distinct()
    return values.where(F.col("value").isNotNull()).groupBy("column_name").agg(F.count(F.lit(1)).alias("categories"))


@query(
    "f5_score_top_k",
    f"""WITH {scores_sql("SELECT page_id AS doc_id, html AS text FROM {pages}",
                         "SELECT item_id AS query_id, text FROM {benchmark}")}
        SELECT query_id, doc_id, score, rank FROM ranked WHERE rank <= 3""",
)
def _(t):
    return S.keyword_search(written_index(t, t.pages, "page_id", "html"), bench_queries(t), 3)


@query(
    "f8_key_order",
    f"""SELECT table_schema, table_name, string_agg(column_name, ',' ORDER BY ordinal_position) AS key_columns
        FROM ({PKS}) GROUP BY 1, 2""",
)
def _(t):
    ordered = F.sort_array(F.collect_list(F.struct("ordinal_position", "column_name")))
    return primary_keys(t).groupBy(*C.TABLE).agg(
        F.array_join(F.transform(ordered, lambda c: c["column_name"]), ",").alias("key_columns")
    )


@query(
    "h1_last_name_part",
    "SELECT page_id, lower(regexp_extract(url, '([^.]*)$', 1)) AS last_part FROM {pages}",
)
def _(t):
    return t.pages.select("page_id", scalars.last_name_part(F.col("url")).alias("last_part"))


@query(
    "h3_joined_lists",
    """SELECT o_custkey, string_agg(DISTINCT o_orderstatus, '; ' ORDER BY o_orderstatus) AS statuses,
         string_agg(DISTINCT o_orderpriority, ' | ' ORDER BY o_orderpriority) AS priorities
       FROM {orders} GROUP BY 1""",
)
def _(t):
    """Lists of the distinct values; both columns have a handful of values."""
    return t.orders.groupBy("o_custkey").agg(
        F.array_join(F.sort_array(F.collect_set("o_orderstatus")), "; ").alias("statuses"),
        F.array_join(F.sort_array(F.collect_set("o_orderpriority")), " | ").alias("priorities"),
    )


@query(
    "h4_column_flags",
    """SELECT l_orderkey, l_partkey, l_linenumber, l_returnflag || ':' || l_linestatus
         || CASE WHEN l_quantity >= 30 AND l_discount = 0 THEN ' (PK, FK)' WHEN l_quantity >= 30 THEN ' (PK)'
            WHEN l_discount = 0 THEN ' (FK)' ELSE '' END AS flag_text FROM {lineitem}""",
)
def _(t):
    column = F.struct(
        F.col("l_returnflag").alias("name"),
        F.col("l_linestatus").alias("data_type"),
        (F.col("l_quantity") >= 30).alias("is_primary_key"),
        (F.col("l_discount") == 0).alias("is_foreign_key"),
    )
    flagged = t.lineitem.select("l_orderkey", "l_partkey", "l_linenumber", column.alias("c"))
    return flagged.select(
        "l_orderkey", "l_partkey", "l_linenumber", C.column_flags(F.col("c")).alias("flag_text")
    )


@query(
    "h5_marked_list",
    """SELECT doc_id, lang || '|' || source AS items FROM {documents}""",
)
def _(t):
    """Items between a marker and the end of its line, blanks dropped."""
    text = F.concat(F.lit("intro\nlist: "), "lang", F.lit(" |  | "), "source", F.lit("\n"), F.col("text"))
    return t.documents.select(
        "doc_id", F.array_join(scalars.marked_list(text, "list:"), "|").alias("items")
    )


@query(
    "h5_marked_text",
    """SELECT doc_id, array_to_string(list_filter(list_transform(string_split(regexp_extract(text, 'the([^\n]*)', 1), '|'),
         lambda x: trim(x)), lambda x: x <> ''), '|') AS items FROM {documents}""",
)
def _(t):
    """What follows the first marker on its line, searched in the whole texts."""
    return t.documents.select("doc_id", F.array_join(scalars.marked_list(F.col("text"), "the"), "|").alias("items"))


@query(
    "h6_contains_append",
    """SELECT doc_id, contains(text, 'the') AS has_term,
         CASE WHEN contains(text, 'the') THEN source || ' orders' ELSE source END AS appended FROM {documents}""",
)
def _(t):
    has = F.contains("text", F.lit("the"))
    return t.documents.select(
        "doc_id", has.alias("has_term"),
        F.when(has, F.concat("source", F.lit(" orders"))).otherwise(F.col("source")).alias("appended"),
    )


@query(
    "h8_first_token",
    # Upper case of sharp s is two letters in Spark, as in the language rules; DuckDB keeps one.
    r"""SELECT doc_id, upper(split_part(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ', 1)) AS first_token,
          len(regexp_extract_all(upper(text), '[A-Z_]+')) AS tokens
        FROM (SELECT doc_id, replace(text, 'ß', 'ss') AS text FROM {documents})""",
)
def _(t):
    collapsed = F.trim(F.regexp_replace("text", r"\s+", " "))
    return t.documents.select(
        "doc_id",
        F.upper(F.substring_index(collapsed, " ", 1)).alias("first_token"),
        F.size(F.regexp_extract_all(F.upper("text"), F.lit("([A-Z_]+)"), 1)).cast("bigint").alias("tokens"),
    )


@query(
    "h9_percentages",
    """SELECT source, round(sum(quality) * 100.0E0 / count(*), 2) AS pct2,
         round(sum(quality) * 100.0E0 / count(*), 1) AS pct1
       FROM {fx_label_nulls} WHERE quality IS NOT NULL GROUP BY 1""",
)
def _(t):
    known = t.fx_label_nulls.where(F.col("quality").isNotNull())
    good, n = F.sum("quality"), F.count(F.lit(1))
    return known.groupBy("source").agg(pct(good, n, 2).alias("pct2"), pct(good, n, 1).alias("pct1"))


@query(
    "h11_defaults",
    "SELECT doc_id, coalesce(quality, -1) AS quality, coalesce(CAST(toxic AS STRING), 'unknown') AS toxic "
    "FROM {fx_label_nulls}",
)
def _(t):
    return t.fx_label_nulls.select(
        "doc_id", F.coalesce("quality", F.lit(-1)).alias("quality"),
        F.coalesce(F.col("toxic").cast("string"), F.lit("unknown")).alias("toxic"),
    )


@query(
    "h12_cast_text",
    "SELECT CAST(user_id AS STRING) AS user_text, CAST(event_id AS STRING) AS event_text FROM {events}",
)
def _(t):
    return t.events.select(
        F.col("user_id").cast("string").alias("user_text"), F.col("event_id").cast("string").alias("event_text")
    )


@query("h14_korea_time", "SELECT event_id, ts + INTERVAL '9' HOUR AS local_time FROM {events}")
def _(t):
    return t.events.select("event_id", scalars.to_korea_time(F.col("ts")).alias("local_time"))


@query(
    "h16_array_size_slice",
    """SELECT doc_id, CAST(len(string_split(text, ' ')) AS BIGINT) AS n,
         array_to_string(string_split(text, ' ')[1:3], ' ') AS first_three FROM {documents}""",
)
def _(t):
    parts = F.split("text", " ")
    return t.documents.select(
        "doc_id", F.size(parts).cast("bigint").alias("n"), F.array_join(F.slice(parts, 1, 3), " ").alias("first_three")
    )


@query(
    "h17_map_lookup",
    """SELECT x.name, x.column_name, x.meaning FROM {context_columns} x
       JOIN {context_tables} t ON t.name = x.name WHERE x.column_name IN ('col_1', 'col_2')""",
)
def _(t):
    """Meaning of two columns looked up in the map of each table."""
    wanted = F.explode(F.array(F.lit("col_1"), F.lit("col_2")))
    found = context(t).select("name", "column_meanings", wanted.alias("column_name"))
    return found.select(
        "name", "column_name", F.try_element_at("column_meanings", F.col("column_name")).alias("meaning")
    ).where(F.col("meaning").isNotNull())


@query(
    "h17_map_entries",
    """SELECT x.name, x.column_name, x.meaning, len(x.names) AS entries
       FROM (SELECT name, column_name, meaning, list(column_name) OVER (PARTITION BY name) AS names FROM {context_columns}) x
       JOIN {context_tables} t ON t.name = x.name""",
)
def _(t):
    """Every name of every table's map, looked up in it."""
    known = context(t).where(F.col("column_meanings").isNotNull())
    found = known.select(
        "name", "column_meanings", F.explode(F.map_keys("column_meanings")).alias("column_name"),
        F.size("column_meanings").cast("bigint").alias("entries"),
    )
    meaning = F.try_element_at("column_meanings", F.col("column_name"))
    return found.select("name", "column_name", meaning.alias("meaning"), "entries")


@query(
    "h19_truthy_default",
    """SELECT page_id, CASE WHEN nullif(regexp_extract(url, 'ref=([a-z]*)', 1), '') IS NOT NULL
         THEN regexp_extract(url, 'ref=([a-z]*)', 1) ELSE url END AS label FROM {pages}""",
)
def _(t):
    ref = F.regexp_extract("url", "ref=([a-z]*)", 1)
    return t.pages.select("page_id", scalars.first_truthy(ref, F.col("url")).alias("label"))


_SAMPLE_KEY = "table_schema || '.' || table_name"


@query(
    "h21_sample_queries",
    f"""SELECT id, concat_ws(' | ', 'SELECT * FROM ' || id || ' LIMIT 10;',
          'SELECT * FROM ' || id || ' WHERE ' || predicate || ';', joins) AS samples
        FROM (SELECT {_SAMPLE_KEY} AS id,
                string_agg(column_name || ' = :' || column_name, ' AND ' ORDER BY ordinal_position) AS predicate
              FROM ({PKS}) GROUP BY 1)
        LEFT JOIN (SELECT {_SAMPLE_KEY} AS id, string_agg('SELECT t.* FROM ' || {_SAMPLE_KEY} || ' t JOIN '
              || referenced_table || ' r ON t.' || column_name || ' = r.' || referenced_column || ' LIMIT 10;', ' | '
              ORDER BY column_name) AS joins
            FROM (SELECT *, row_number() OVER (PARTITION BY table_schema, table_name ORDER BY column_name) AS rn
                  FROM ({FKS})) WHERE rn <= 2 GROUP BY 1) USING (id)""",
)
def _(t):
    t.keep("pg_class", "pg_attribute")
    keys = F.sort_array(F.collect_list(F.struct("ordinal_position", "column_name")))
    links = F.sort_array(F.collect_list(F.struct(F.col("column_name").alias("column"), "referenced_table", "referenced_column")))
    pks = primary_keys(t).groupBy(*C.TABLE).agg(F.transform(keys, lambda k: k["column_name"]).alias("pk"))
    fks = foreign_keys(t).groupBy(*C.TABLE).agg(links.alias("fk"))
    name = F.concat_ws(".", *C.TABLE)
    samples = scalars.sample_queries(name, F.col("pk"), F.coalesce("fk", F.array()))
    return pks.join(fks, C.TABLE, "left").select(name.alias("id"), F.array_join(samples, " | ").alias("samples"))
