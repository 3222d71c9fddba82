"""Catalog analytics: system-catalog joins, table cards, business context, search documents.

All joins are equi-joins on table or constraint keys. Columns, keys and
indexes are nested per table; their number per table is bounded by the
database, so the arrays stay small however many tables there are. What belongs
to a table is nested before it is dealt and joined, so that joins see a row per
table; operators give its rows one by one, or ``nested`` for the cards.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilframe.functions import scalars

SYSTEM_SCHEMAS = ["pg_catalog", "information_schema"]
TABLE = ["table_schema", "table_name"]
# Dealt, joined and grouped by: the hash in front makes sorting by two texts as fast as by a number.
KEY = ["_h", *TABLE]

# Labels of the search document and of the searchable text. Stored
# documents and the query extraction depend on them.
CONTENT = {
    "name": "테이블명",
    "description": "설명",
    "purpose": "업무 용도",
    "queries": "자주 분석하는 지표",
    "terms": "관련 업무 용어",
    "kpi": "주요 지표 컬럼",
    "columns": "전체 컬럼",
    "primary_key": "Primary Key",
    "foreign_keys": "Foreign Keys",
    "indexes": "Indexes",
    "samples": "예시 SQL",
}
SEARCHABLE = {
    "name": "테이블",
    "description": "설명",
    "purpose": "용도",
    "kpi": "주요 지표 컬럼",
    "columns": "전체 컬럼",
    "queries": "자주 분석하는 지표",
    "terms": "관련 용어",
    "samples": "예시 SQL",
}


def user_schemas(df: DataFrame, column: str) -> DataFrame:
    return df.where(~F.col(column).isin(SYSTEM_SCHEMAS))


def _keyed(df: DataFrame) -> DataFrame:
    return df.withColumn("_h", F.xxhash64(*TABLE))


def _nested(rows: DataFrame, by: list[str], name: str) -> DataFrame:
    """Rows nested per key as an array of structs; a NULL in the key joins nothing and is left out."""
    rest = [c for c in rows.columns if c not in by]
    return rows.dropna(subset=by).groupBy(*by).agg(F.collect_list(F.struct(*rest)).alias(name))


def _of_table(df: DataFrame, rows: Column, nested: bool) -> DataFrame:
    """The rows of each table, as array ``_rows`` or one by one."""
    return df.select(*KEY, rows.alias("_rows")) if nested else df.select(*TABLE, F.inline(rows))


def tables(pg_class: DataFrame, pg_namespace: DataFrame, pg_description: DataFrame) -> DataFrame:
    """Ordinary tables outside the system schemas, with their comment or ''."""
    comments = pg_description.where(F.col("objsubid") == 0).select(
        F.col("objoid").alias("oid"), F.col("description").alias("_d")
    )
    spaces = user_schemas(pg_namespace, "nspname").select(
        F.col("oid").alias("relnamespace"), F.col("nspname").alias("table_schema")
    )
    return (
        pg_class.where(F.col("relkind") == "r")
        .join(spaces, "relnamespace")
        .join(comments, "oid", "left")
        .select(
            "table_schema",
            F.col("relname").alias("table_name"),
            F.coalesce("_d", F.lit("")).alias("table_comment"),
        )
    )


def columns(
    info_columns: DataFrame,
    pg_class: DataFrame,
    pg_namespace: DataFrame,
    pg_attribute: DataFrame,
    pg_description: DataFrame,
    nested: bool = False,
) -> DataFrame:
    """Columns of user schemas with type, nullability, default and comment."""
    spaces = pg_namespace.select(
        F.col("oid").alias("relnamespace"), F.col("nspname").alias("table_schema")
    )
    owners = pg_class.select("oid", F.col("relname").alias("table_name"), "relnamespace").join(
        spaces, "relnamespace"
    )
    # Attributes and comments meet in one grouping by the table's oid; so columns are dealt once, by their table.
    attributes = pg_attribute.select(
        F.col("attrelid").alias("oid"), F.struct(F.col("attname").alias("column_name"), "attnum").alias("_a")
    )
    comments = pg_description.select(
        F.col("objoid").alias("oid"), F.struct(F.col("objsubid").alias("attnum"), F.col("description").alias("_d")).alias("_c")
    )
    by_oid = (
        attributes.unionByName(comments, allowMissingColumns=True)
        .dropna(subset=["oid"])
        .groupBy("oid")
        .agg(F.collect_list("_a").alias("_a"), F.collect_list("_c").alias("_c"))
    )

    def commented(a: Column) -> Column:
        """An attribute once per comment, or once without."""
        own = F.filter("_c", lambda c: c["attnum"] == a["attnum"])["_d"]
        own = F.when(F.size(own) > 0, own).otherwise(F.array(F.lit(None).cast("string")))
        return F.transform(own, lambda d: F.struct(a["column_name"].alias("column_name"), d.alias("_d")))

    described = owners.join(by_oid, "oid", "left").select(*TABLE, F.flatten(F.transform("_a", commented)).alias("_c"))
    infos = _nested(
        _keyed(user_schemas(info_columns, "table_schema")).select(
            *KEY, "column_name", "udt_name", "is_nullable", "column_default", "ordinal_position"
        ),
        KEY, "_i",
    )

    def rows(i: Column) -> Column:
        """A column once per comment, or once without."""
        own = F.filter("_c", lambda c: c["column_name"] == i["column_name"])["_d"]
        own = F.when(F.size(own) > 0, own).otherwise(F.array(F.lit(None).cast("string")))
        return F.transform(
            own,
            lambda d: F.struct(
                i["column_name"].alias("column_name"),
                i["udt_name"].alias("data_type"),
                (F.upper(i["is_nullable"]) == "YES").alias("is_nullable"),
                i["column_default"].alias("column_default"),
                F.coalesce(d, F.lit("")).alias("column_comment"),
                i["ordinal_position"].alias("ordinal_position"),
            ),
        )

    return _of_table(infos.join(_keyed(described), KEY), F.flatten(F.transform("_i", rows)), nested)


def primary_keys(table_constraints: DataFrame, key_column_usage: DataFrame, nested: bool = False) -> DataFrame:
    """Key columns in order; matched on constraint name, schema and table."""
    keys = user_schemas(table_constraints, "table_schema").where(
        F.col("constraint_type") == "PRIMARY KEY"
    )
    names = _nested(_keyed(keys).select("constraint_name", *KEY), KEY, "_k")
    used = _nested(
        _keyed(key_column_usage).select(*KEY, "constraint_name", "column_name", "ordinal_position"), KEY, "_u"
    )
    rows = lambda u: F.transform(
        F.filter("_k", lambda k: k["constraint_name"] == u["constraint_name"]),
        lambda k: F.struct(u["column_name"].alias("column_name"), u["ordinal_position"].alias("ordinal_position")),
    )
    return _of_table(used.join(names, KEY), F.flatten(F.transform("_u", rows)), nested)


def foreign_keys(
    table_constraints: DataFrame, key_column_usage: DataFrame, constraint_column_usage: DataFrame
) -> DataFrame:
    """Foreign-key columns with the table and column they point to.

    The columns of a composite key meet those they refer to by their position.
    """
    on = ["_h", "constraint_name", "table_schema"]
    keyed = lambda df: df.withColumn("_h", F.xxhash64("constraint_name", "table_schema"))
    kinds = keyed(table_constraints.where(F.col("constraint_type") == "FOREIGN KEY")).select(*on)
    # Nested, so that constraints are dealt once for both joins.
    targets = _nested(
        keyed(constraint_column_usage.select(
            "constraint_name",
            F.col("constraint_schema").alias("table_schema"),
            F.concat_ws(".", "constraint_schema", "table_name").alias("referenced_table"),
            F.col("column_name").alias("referenced_column"),
            F.col("ordinal_position").alias("position_in_unique_constraint"),
        )),
        on, "_t",
    )
    same = F.filter("_t", lambda t: t["position_in_unique_constraint"] == F.col("position_in_unique_constraint"))
    return (
        keyed(user_schemas(key_column_usage, "table_schema"))
        .join(kinds, on, "left_semi")
        .join(targets, on)
        .withColumn("_t", F.explode(same))
        .select(*TABLE, "column_name", "_t.referenced_table", "_t.referenced_column", "constraint_name")
    )


def index_columns(
    pg_index: DataFrame,
    pg_class: DataFrame,
    pg_namespace: DataFrame,
    pg_attribute: DataFrame,
    nested: bool = False,
) -> DataFrame:
    """Indexes with their columns in key order.

    ``pg_index`` holds (indexname, indrelid, indisunique, indkey array of
    attribute numbers).
    """
    spaces = user_schemas(pg_namespace, "nspname").select(
        F.col("oid").alias("relnamespace"), F.col("nspname").alias("table_schema")
    )
    owners = (
        pg_class.select(F.col("oid").alias("indrelid"), F.col("relname").alias("table_name"), "relnamespace")
        .join(spaces, "relnamespace")
        .drop("relnamespace")
    )
    names = _nested(pg_attribute.select(F.col("attrelid").alias("indrelid"), "attnum", "attname"), ["indrelid"], "_n")
    named = F.flatten(
        F.transform(
            "indkey",
            lambda k, i: F.transform(
                F.filter("_n", lambda n: n["attnum"] == k),
                lambda n: F.struct(i.alias("ord"), n["attname"].alias("attname")),
            ),
        )
    )
    parts = (
        _keyed(
            pg_index.select("indexname", "indrelid", "indisunique", "indkey")
            .join(owners, "indrelid")
            .join(names, "indrelid")
            .select(*TABLE, "indexname", "indisunique", named.alias("_c"))
            .where(F.size("_c") > 0)
        )
        .groupBy(*KEY)
        .agg(F.collect_list(F.struct("indexname", "indisunique", "_c")).alias("_x"))
    )

    def index(name: Column) -> Column:
        own = F.filter("_x", lambda x: x["indexname"].eqNullSafe(name))
        return F.struct(
            name.alias("indexname"),
            F.sort_array(F.flatten(own["_c"]))["attname"].alias("columns"),
            F.array_max(own["indisunique"]).alias("is_unique"),
        )

    return _of_table(parts, F.transform(F.array_distinct(F.col("_x")["indexname"]), index), nested)


def cards(tabs: DataFrame, cols: DataFrame, pks: DataFrame, fks: DataFrame, idx: DataFrame) -> DataFrame:
    """One nested document per table.

    The parts come row by row or nested by table; they are dealt by table and meet in one grouping.
    A part whose table is NULL belongs to none.
    """

    def part(df: DataFrame, name: str, order: str, item: Callable[[Callable[[str], Column]], Column]) -> DataFrame:
        row = lambda get: F.struct(get(order).alias("_o"), item(get).alias("_v"))
        if "_rows" in df.columns:
            items = F.transform("_rows", lambda r: row(lambda c: r[c]))
        else:
            df, items = _keyed(df), F.array(row(F.col))
        return df.dropna(subset=TABLE).select(*KEY, items.alias(name)).repartition(*KEY)

    parts = [
        _keyed(tabs).select(*KEY, F.array("table_comment").alias("_tabs")).repartition(*KEY),
        part(cols, "columns", "ordinal_position", lambda get: F.struct(
            get("column_name").alias("name"), get("data_type").alias("data_type"),
            get("is_nullable").alias("is_nullable"), get("column_default").alias("default_value"),
            F.nullif(get("column_comment"), F.lit("")).alias("description"),
        )),
        part(pks, "primary_key", "ordinal_position", lambda get: get("column_name")),
        part(fks, "foreign_keys", "column_name", lambda get: F.struct(
            get("column_name").alias("column"), get("referenced_table").alias("referenced_table"),
            get("referenced_column").alias("referenced_column"), get("constraint_name").alias("constraint_name"),
        )),
        part(idx, "indexes", "indexname", lambda get: F.struct(
            get("indexname").alias("name"), get("columns").alias("columns"), get("is_unique").alias("is_unique"),
        )),
    ]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    lists = [c for c in rows.columns if c not in KEY]
    grouped = rows.groupBy(*KEY).agg(*[F.flatten(F.collect_list(c)).alias(c) for c in lists])
    items = lambda c: F.sort_array(c)["_v"]
    some = lambda c: F.when(F.size(c) > 0, items(c)).alias(c)
    joined = grouped.where(F.size("_tabs") > 0).select(
        *TABLE, F.explode("_tabs").alias("table_comment"),
        some("columns"), items("primary_key").alias("primary_key"), some("foreign_keys"), some("indexes"),
    )
    pk = F.col("primary_key")
    flagged = F.transform(
        "columns",
        lambda c: F.struct(
            c["name"].alias("name"),
            c["data_type"].alias("data_type"),
            c["is_nullable"].alias("is_nullable"),
            F.array_contains(pk, c["name"]).alias("is_primary_key"),
            F.coalesce(F.array_contains(F.col("foreign_keys")["column"], c["name"]), F.lit(False)).alias("is_foreign_key"),
            c["default_value"].alias("default_value"),
            c["description"].alias("description"),
        ),
    )
    name = F.concat_ws(".", *TABLE)
    return joined.select(
        name.alias("id"),
        F.lit("table").alias("object_type"),
        name.alias("name"),
        name.alias("table"),
        F.col("table_schema").alias("schema"),
        F.nullif(F.col("table_comment"), F.lit("")).alias("description"),
        flagged.alias("columns"),
        "primary_key",
        "foreign_keys",
        "indexes",
        scalars.sample_queries(name, pk, F.coalesce("foreign_keys", F.array())).alias("sample_queries"),
        F.array().cast("array<string>").alias("business_tags"),
    )


def enrich(card: DataFrame, context: DataFrame) -> DataFrame:
    """Cards with business context by table name; tables without context keep their own text.

    Column descriptions are replaced where the context has a meaning, and
    columns named as KPI are marked.
    """
    extra = context.select(
        "name",
        F.col("description").alias("_d"),
        F.col("purpose").alias("business_purpose"),
        "common_queries",
        "business_terms",
        F.col("tags").alias("_tags"),
        "kpi_columns",
        "column_meanings",
    )
    joined = card.join(extra, "name", "left")
    meaning = lambda c: F.try_element_at("column_meanings", c["name"])
    kpi = lambda c: F.try_element_at("kpi_columns", c["name"])
    cols = F.transform(
        "columns",
        lambda c: c.withField("description", F.coalesce(meaning(c), c["description"]))
        .withField("is_kpi", kpi(c).isNotNull())
        .withField("kpi_description", kpi(c)),
    )
    return (
        joined.withColumn("description", F.coalesce("_d", "description"))
        .withColumn("business_tags", F.coalesce("_tags", "business_tags"))
        .withColumn("columns", cols)
        .drop("_d", "_tags", "kpi_columns", "column_meanings")
    )


def unmatched(card: DataFrame, context: DataFrame) -> DataFrame:
    """Tables the business context does not mention."""
    return card.select("name").join(context.select("name"), "name", "left_anti")


# --- texts ---------------------------------------------------------------------------


def column_flags(c: Column) -> Column:
    pk, fk = c["is_primary_key"], c["is_foreign_key"]
    shown = F.when(pk & fk, F.lit(" (PK, FK)")).when(pk, F.lit(" (PK)")).when(fk, F.lit(" (FK)"))
    return F.concat(c["name"], F.lit(":"), c["data_type"], F.coalesce(shown, F.lit("")))


def columns_text(cols: Column) -> Column:
    return F.array_join(F.transform(cols, column_flags), "; ")


def relations_text(fks: Column) -> Column:
    return F.array_join(
        F.transform(
            fks,
            lambda f: F.concat(
                f["column"], F.lit(" -> "), f["referenced_table"], F.lit("("), f["referenced_column"], F.lit(")")
            ),
        ),
        "; ",
    )


def indexes_text(idx: Column) -> Column:
    kind = lambda i: F.when(i["is_unique"], "UNIQUE").otherwise("NON-UNIQUE")
    return F.array_join(
        F.transform(
            idx,
            lambda i: F.concat(
                i["name"], F.lit(" ("), kind(i), F.lit(") on "), F.array_join(i["columns"], ", ")
            ),
        ),
        "; ",
    )


def _kpi_items(separator: str, with_type: bool) -> Column:
    kpis = F.filter("columns", lambda c: F.coalesce(c["is_kpi"], F.lit(False)))
    head = lambda c: F.concat(c["name"], F.lit("("), c["data_type"], F.lit(")")) if with_type else c["name"]
    prefix = "  - " if with_type else ""
    return F.array_join(
        F.transform(
            kpis,
            lambda c: F.concat(F.lit(prefix), head(c), F.lit(": "), F.coalesce(c["kpi_description"], F.lit(""))),
        ),
        separator,
    )


def _line(label: str, text: Column, always: bool = False) -> Column:
    shown = F.concat(F.lit(f"{label}: "), F.coalesce(text, F.lit("")))
    return shown if always else F.when(F.coalesce(text, F.lit("")) != "", shown)


def search_documents(card: DataFrame, tenant: Column, connection: Column) -> DataFrame:
    """Flat search document per enriched card; sections in a fixed order, empty ones left out."""
    lab = CONTENT
    cols_text, rels_text = columns_text(F.col("columns")), relations_text(F.col("foreign_keys"))
    samples = F.array_join("sample_queries", " | ")
    content = F.concat_ws(
        "\n",
        _line(lab["name"], F.col("name"), True),
        _line(lab["description"], F.col("description")),
        _line(lab["purpose"], F.col("business_purpose")),
        _line(lab["queries"], F.array_join("common_queries", " | ")),
        _line(lab["terms"], scalars.term_list(F.col("business_terms"))),
        _line(lab["kpi"], _kpi_items("; ", False)),
        _line(lab["columns"], cols_text, True),
        _line(lab["primary_key"], F.array_join("primary_key", ", "), True),
        _line(lab["foreign_keys"], rels_text),
        _line(lab["indexes"], indexes_text(F.col("indexes"))),
        _line(lab["samples"], samples),
    )
    return card.select(
        scalars.composite_id(tenant, connection, scalars.safe_id(F.col("id"))).alias("id"),
        F.col("schema").alias("db_schema"),
        F.col("table").alias("table_name"),
        F.col("name").alias("display_name"),
        F.coalesce("description", F.lit("")).alias("description"),
        content.alias("content"),
        F.coalesce(cols_text, F.lit("")).alias("columns_text"),
        F.coalesce(rels_text, F.lit("")).alias("relations_text"),
        samples.alias("sample_queries_text"),
        "business_tags",
        tenant.alias("tenant_id"),
        connection.alias("connection_id"),
        F.col("id").alias("table_id"),
    )


def searchable_text(card: DataFrame) -> DataFrame:
    """Text for search with KPI columns first and at most three sample statements."""
    lab = SEARCHABLE
    names = F.array_join(F.transform("columns", lambda c: c["name"]), ", ")

    def block(label: str, lines: Column) -> Column:
        return F.when(F.coalesce(lines, F.lit("")) != "", F.concat(F.lit(f"{label}:\n"), lines))

    bullets = F.array_join(F.transform("common_queries", lambda q: F.concat(F.lit("  - "), q)), "\n")
    terms = F.array_join(
        F.transform(
            F.map_entries("business_terms"),
            lambda e: F.concat(F.lit("  - "), e["key"], F.lit(": "), F.array_join(e["value"], ", ")),
        ),
        "\n",
    )
    samples = F.array_join(
        F.transform(F.slice("sample_queries", 1, 3), lambda q: F.concat(F.lit("  "), q)), "\n"
    )
    text = F.concat_ws(
        "\n",
        _line(lab["name"], F.col("name"), True),
        _line(lab["description"], F.col("description")),
        _line(lab["purpose"], F.col("business_purpose")),
        block(lab["kpi"], _kpi_items("\n", True)),
        _line(lab["columns"], names, True),
        block(lab["queries"], bullets),
        block(lab["terms"], terms),
        block(lab["samples"], samples),
    )
    return card.select("id", text.alias("searchable_text"))


def common_queries(documents: DataFrame) -> DataFrame:
    """Queries listed in the content of search documents."""
    return documents.select(
        "id", scalars.marked_list(F.col("content"), f"{CONTENT['queries']}:").alias("common_queries")
    )
