"""Cards, business context, sinks and search on small inputs."""

import json
import math

import pytest
from pyspark.sql import functions as F

from vigilframe.fixtures import FOREIGN_KEYS, PRIMARY_KEYS, TABLE_COLUMNS, Lake
from vigilframe.operators import catalog as C
from vigilframe.operators import search as S
from vigilframe.session import new_table_path
from vigilframe.sources import readers, sinks
from vigilframe.streaming import jobs


@pytest.fixture(scope="module")
def cards(spark):
    lake = Lake(spark, "/root/testdata/sf0.001")
    tables = {n: getattr(lake, n) for n in TABLE_COLUMNS}
    return C.cards(**readers.lake_catalog(spark, tables, PRIMARY_KEYS, FOREIGN_KEYS)).cache()


def test_cards_of_a_lake(cards):
    card = cards.where(F.col("table") == "lake.lineitem").first()
    assert [c["name"] for c in card["columns"]] == TABLE_COLUMNS["lineitem"]
    assert [c["name"] for c in card["columns"] if c["is_primary_key"]] == PRIMARY_KEYS["lineitem"]
    assert [c["name"] for c in card["columns"] if c["is_foreign_key"]] == ["l_orderkey", "l_partkey"]
    assert card["sample_queries"] == [
        "SELECT * FROM lake.lineitem LIMIT 10;",
        "SELECT * FROM lake.lineitem WHERE l_orderkey = :l_orderkey AND l_linenumber = :l_linenumber;",
        "SELECT t.* FROM lake.lineitem t JOIN lake.orders r ON t.l_orderkey = r.o_orderkey LIMIT 10;",
        "SELECT t.* FROM lake.lineitem t JOIN lake.part r ON t.l_partkey = r.p_partkey LIMIT 10;",
    ]


def test_cards_survive_json_and_business_context(spark, cards, tmp_path):
    path = new_table_path(spark, "cards")
    sinks.write_cards(cards, path)
    back = readers.cards(spark, path)
    assert back.count() == len(TABLE_COLUMNS)
    mapping = tmp_path / "tables.yaml"
    mapping.write_text(
        """
lake.orders:
  description: "Orders"
  purpose: "Revenue"
  tags: ["sales"]
  common_queries: ["Orders per day", "Revenue"]
  business_terms:
    order: ["Purchase", "Sale"]
  kpi_columns:
    o_totalprice: "Amount"
  column_meanings:
    o_orderkey: "Order number"
""",
        encoding="utf-8",
    )
    rich = C.enrich(back, readers.business_context(spark, str(mapping)))
    assert C.unmatched(back, readers.business_context(spark, str(mapping))).count() == len(TABLE_COLUMNS) - 1
    doc = C.search_documents(rich, F.lit("t"), F.lit("c")).where(F.col("table_name") == "lake.orders").first()
    lines = doc["content"].split("\n")
    assert lines[0] == "테이블명: lake.orders" and lines[1] == "설명: Orders"
    assert "관련 업무 용어: order(Purchase, Sale)" in lines and "주요 지표 컬럼: o_totalprice: Amount" in lines
    assert doc["id"] == "t_c_lake_orders"
    found = C.common_queries(C.search_documents(rich, F.lit("t"), F.lit("c"))).where(F.col("id") == doc["id"]).first()
    assert found["common_queries"] == ["Orders per day", "Revenue"]
    text = C.searchable_text(rich).where(F.col("id") == "lake.orders").first()["searchable_text"]
    assert "  - o_totalprice(double): Amount" in text


def test_one_card_per_file(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"id": "s.a", "name": "s.a", "columns": []}, indent=2), encoding="utf-8")
    (tmp_path / "b.json").write_text(json.dumps({"id": "s.b", "name": "s.b"}, indent=2), encoding="utf-8")
    rows = readers.cards(spark, str(tmp_path), one_per_file=True).orderBy("id").collect()
    assert [r["id"] for r in rows] == ["s.a", "s.b"]


def test_jdbc_ranges_need_bounds(spark):
    with pytest.raises(ValueError):
        readers.database_table(spark, "jdbc:postgresql://x/y", "t", "u", "p", partition_column="id")


def test_upsert_prefers_newer_then_update(spark):
    base = spark.createDataFrame([(1, "a", 1), (2, "b", 5)], "id int, v string, at int")
    new = spark.createDataFrame([(1, "A", 1), (2, "B", 4), (3, "C", 1)], "id int, v string, at int")
    rows = sinks.upsert(base, new, ["id"], "at").orderBy("id").collect()
    assert [(r["id"], r["v"]) for r in rows] == [(1, "A"), (2, "b"), (3, "C")]


def test_appends_add_up(spark):
    path = new_table_path(spark, "history")
    df = spark.createDataFrame([("h1", "2024-01-01 10:00:00"), ("h2", "2024-01-02 10:00:00")], "history_id string, at string")
    df = df.select("history_id", F.col("at").cast("timestamp_ntz").alias("executed_at"))
    sinks.append_history(df, path)
    sinks.append_history(df, path)
    back = spark.read.parquet(path)
    assert back.count() == 4
    assert back.where(F.col("executed_date") == "2024-01-01").count() == 2


def test_bm25_by_hand(spark):
    docs = spark.createDataFrame([(1, "Red red fox"), (2, "blue fox jumps, high"), (3, ""), (4, "owl")], "doc_id int, text string")
    asked = spark.createDataFrame([("q", "RED fox?"), ("none", "zebra")], "query_id string, text string")
    got = {(r["query_id"], r["doc_id"]): r["score"] for r in S.keyword_search(S.build_index(docs), asked).collect()}
    n, avg = 3, 8 / 3

    def part(df, tf, dl):
        idf = math.log(1 + (n - df + 0.5) / (df + 0.5))
        return idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avg))

    assert set(got) == {("q", 1), ("q", 2)}
    assert got[("q", 1)] == pytest.approx(part(1, 2, 3) + part(2, 1, 3), abs=1e-6)
    assert got[("q", 2)] == pytest.approx(part(2, 1, 4), abs=1e-6)


def test_retry_rule(spark):
    docs = spark.createDataFrame([(1, "orders count"), (2, "오늘 메모"), (3, "x"), (4, "y")], "doc_id int, text string")
    asked = spark.createDataFrame([("a", "오늘 주문"), ("b", "주문")], "query_id string, text string")
    rows = S.search_with_retry(S.build_index(docs), asked, 3, low_score=99.0).collect()
    # "b" has no hit at first, so it is answered as it is; "a" is kept only if strictly better.
    assert {r["query_id"] for r in rows} == {"a"}
    assert S.SYNONYMS["매출액"] == "revenue"
    text = spark.range(1).select(S.expand(F.lit("매출액 건수"))).first()[0]
    assert text == "매출액 건수 count revenue revenue"


def test_empty_and_zero_vectors(spark):
    vectors = spark.createDataFrame([(1, []), (2, [0.0, 0.0]), (3, [1.0, 0.0])], "vec_id int, embedding array<double>")
    checked = {r["vec_id"]: r["is_valid"] for r in S.dimension_check(vectors, 2).collect()}
    assert checked == {1: False, 2: True, 3: True}
    asked = vectors.where("vec_id = 3").select(F.col("vec_id").alias("query_id"), "embedding")
    good = vectors.where(F.size("embedding") == 2)
    assert [r["doc_id"] for r in S.vector_search(good, asked, 5).collect()] == [3]


def test_stream_continues_from_its_checkpoint(spark):
    """Two runs over growing input give each closed window once."""
    source, out, checkpoint = jobs.paths(spark, "twice", "in", "out", "checkpoint")
    events = Lake(spark, "/root/testdata/sf0.001").events
    early = F.col("ts") < F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")
    for part in (early, ~early):
        events.where(part).write.mode("append").parquet(source)
        stream = jobs.file_stream(spark, source, events.schema)
        jobs.run_to_table(jobs.windowed_metric(jobs.with_event_time(stream)), out, checkpoint)
    got = spark.read.parquet(out)
    batch = jobs.windowed_metric(jobs.with_event_time(events))
    last = events.agg(F.max("ts") - F.make_dt_interval(mins=F.lit(10))).first()[0]
    closed = batch.where(F.col("window_end") <= F.lit(last))
    assert got.exceptAll(closed).count() == 0 and closed.exceptAll(got).count() == 0


def test_vector_search_takes_any_number_of_queries(spark):
    """More queries than any batch holds, in several blocks; equal vectors are searched once."""
    from vigilframe.operators import search

    rng = __import__("random").Random(1)
    stock = [(i, [rng.random() for _ in range(4)]) for i in range(30)]
    vectors = spark.createDataFrame(stock, "vec_id int, embedding array<double>")
    kinds = [[rng.random() for _ in range(4)] for _ in range(7)]
    asked = spark.range(12000).selectExpr("id as query_id", "cast(id % 7 as int) as kind").join(
        spark.createDataFrame(list(enumerate(kinds)), "kind int, embedding array<double>"), "kind"
    )
    got = search.vector_search(vectors, asked, 2, block_bytes=200).where("query_id < 7").collect()

    def cosine(a, b):
        return sum(x * y for x, y in zip(a, b)) / sum(x * x for x in a) ** 0.5 / sum(x * x for x in b) ** 0.5

    for q, vector in enumerate(kinds):
        want = sorted(stock, key=lambda r: -cosine(r[1], vector))[:2]
        assert [r["doc_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q] == [i for i, _ in want]


def test_statistics_come_from_footers(spark):
    from pyspark.sql import functions as F

    from vigilframe.session import new_table_path
    from vigilframe.sources import readers

    full, empty = new_table_path(spark, "full"), new_table_path(spark, "empty")
    rows = spark.range(5, 1000).select(F.col("id").alias("a"), F.when(F.col("id") > 7, F.expr("date '2024-01-01' + int(id)")).alias("d"))
    rows.repartition(3).write.parquet(full)
    rows.limit(0).write.parquet(empty)
    before = spark.conf.get("spark.sql.sources.useV1SourceList")
    got = readers.footer_statistics(spark, {"full": full, "empty": empty}, {"full": ["a", "d"], "empty": ["a"]})
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("COUNT(*)") == 2 and "MIN(a)" in plan and "MAX(d)" in plan
    assert "PushedAggregation: []" not in plan
    assert spark.conf.get("spark.sql.sources.useV1SourceList") == before
    assert sorted(map(tuple, got.collect()), key=str) == [
        ("empty", 0, "a", None, None),
        ("full", 995, "a", "5", "999"),
        ("full", 995, "d", "2024-01-09", "2026-09-26"),
    ]


def test_columns_meet_their_comments_by_table(spark):
    """Columns are dealt by their table only; those without attribute or comment stay, repeated ones stay repeated."""
    schema = "table_schema string, table_name string, column_name string, udt_name string, is_nullable string, column_default string, ordinal_position int"
    info = spark.createDataFrame([("s", "t", c, "int4", "NO", None, i) for i, c in enumerate("abbcd")] + [("pg_catalog", "t", "a", "int4", "NO", None, 1)], schema)
    classes = spark.createDataFrame([(1, "t", 9, "r"), (2, "u", 9, "r")], "oid long, relname string, relnamespace int, relkind string")
    spaces = spark.createDataFrame([(9, "s"), (8, "pg_catalog")], "oid int, nspname string")
    attributes = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "c", 3), (1, "c", 4), (2, "a", 1), (None, "a", 1)], "attrelid long, attname string, attnum int")
    comments = spark.createDataFrame([(1, 1, "A"), (1, 3, "C"), (1, 3, "C2"), (2, 1, "other"), (None, 1, "x")], "objoid long, objsubid int, description string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = C.columns(info, classes, spaces, attributes, comments)
        got = sorted((r["column_name"], r["column_comment"]) for r in found.collect())
        plan = found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == [("a", "A"), ("b", ""), ("b", ""), ("c", ""), ("c", "C"), ("c", "C2"), ("d", "")]
    dealt = [line for line in plan.splitlines() if "hashpartitioning(" in line]
    assert dealt and not any("column_name" in x or "attnum" in x for x in dealt)


def test_cards_are_stored_compressed(spark, cards, tmp_path):
    sinks.write_cards(cards, str(tmp_path / "cards"))
    sinks.write_card_index(cards, str(tmp_path / "index"))
    for part in ("cards", "index"):
        assert {p.suffix for p in (tmp_path / part).glob("part-*")} == {".gz"}


def test_cards_meet_in_one_grouping(spark):
    """Parts are grouped once and joined never; a repeated table has a card each, one without a name has no parts."""
    tabs = spark.createDataFrame([("s", "t", "x"), ("s", "t", "y"), ("s", "u", None), ("s", None, "z")], "table_schema string, table_name string, table_comment string")
    cols = spark.createDataFrame(
        [("s", "t", "b", "int4", True, None, "", 2), ("s", "t", "a", "int4", False, None, "A", 1), ("s", None, "n", "int4", True, None, "", 1), ("s", "gone", "g", "int4", True, None, "", 1)],
        "table_schema string, table_name string, column_name string, data_type string, is_nullable boolean, column_default string, column_comment string, ordinal_position int",
    )
    pks = cols.where("ordinal_position = 1").select(*C.TABLE, "column_name", "ordinal_position")
    fks = spark.createDataFrame([("s", "t", "b", "s.u", "id", "fk")], "table_schema string, table_name string, column_name string, referenced_table string, referenced_column string, constraint_name string")
    idx = spark.createDataFrame([("s", "t", "ix", ["b", "a"], True)], "table_schema string, table_name string, indexname string, columns array<string>, is_unique boolean")
    found = C.cards(tabs, cols, pks, fks, idx)
    full = ([("a", True, False, "A"), ("b", False, True, None)], ["a"], [("b", "s.u", "id", "fk")], [("ix", ["b", "a"], True)])
    got = {
        (r["name"], r["description"]): (
            r["columns"] and [(c["name"], c["is_primary_key"], c["is_foreign_key"], c["description"]) for c in r["columns"]],
            r["primary_key"], r["foreign_keys"] and [tuple(f) for f in r["foreign_keys"]],
            r["indexes"] and [tuple(i) for i in r["indexes"]],
        )
        for r in found.collect()
    }
    empty = (None, [], None, None)
    assert got == {("s.t", "x"): full, ("s.t", "y"): full, ("s.u", None): empty, ("s", "z"): empty}
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_nested_parts_hold_the_rows_of_the_operators(spark):
    """A row per table, its rows nested, with repeated and missing parts."""
    constraints = spark.createDataFrame([("k", "s", "t", "PRIMARY KEY"), ("k", "s", "t", "PRIMARY KEY"), ("f", "s", "t", "FOREIGN KEY")], "constraint_name string, table_schema string, table_name string, constraint_type string")
    usage = spark.createDataFrame([("k", "s", "t", "a", 1), ("k", "s", "t", "b", 2), ("f", "s", "t", "c", 1), ("k", "s", None, "d", 1)], "constraint_name string, table_schema string, table_name string, column_name string, ordinal_position int")
    flat = C.primary_keys(constraints, usage)
    nested = C.primary_keys(constraints, usage, nested=True)
    assert sorted(map(tuple, flat.collect())) == [("s", "t", c, i) for c, i in (("a", 1), ("a", 1), ("b", 2), ("b", 2))]
    assert nested.count() == 1
    assert sorted(map(tuple, nested.select(*C.TABLE, F.inline("_rows")).collect())) == sorted(map(tuple, flat.collect()))

    classes = spark.createDataFrame([(1, "t", 9, "r")], "oid long, relname string, relnamespace int, relkind string")
    spaces = spark.createDataFrame([(9, "s")], "oid int, nspname string")
    attributes = spark.createDataFrame([(1, "a", 1), (1, "b", 2)], "attrelid long, attname string, attnum int")
    index = spark.createDataFrame([("ix", 1, None, [2, 1, 7]), ("ix", 1, True, [1]), ("no", 1, False, [7]), (None, 1, None, [1])], "indexname string, indrelid long, indisunique boolean, indkey array<int>")
    flat = C.index_columns(index, classes, spaces, attributes)
    assert sorted(map(tuple, flat.collect()), key=str) == sorted([("s", "t", "ix", ["a", "b", "a"], True), ("s", "t", None, ["a"], None)], key=str)
    assert C.index_columns(index, classes, spaces, attributes, nested=True).count() == 1


def test_kept_catalog_tables_are_joined_where_they_lie(spark, tmp_path):
    """Columns and tables of a kept catalog lie in buckets of the table's id: no shuffle brings them together."""
    source = Lake(spark, "/root/testdata/sf0.001")
    orders = [(1, 5, "1-URGENT"), (2, 6, "2-HIGH"), (2, 6, "2-HIGH"), (None, 7, "2-HIGH")]
    lines = [(1, 1), (1, 2), (2, 1), (2, 1), (3, 1), (None, 1)]
    for name, rows, schema in (
        ("orders", orders, "o_orderkey long, o_custkey long, o_orderpriority string"),
        ("lineitem", [(*r, "A", 7, 50.0, "F") for r in lines], "l_orderkey long, l_linenumber int, l_returnflag string, l_partkey long, l_quantity double, l_linestatus string"),
    ):
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    source.nation.write.parquet(str(tmp_path / "nation.parquet"))
    plain = Lake(spark, str(tmp_path))
    kept = Lake(spark, str(tmp_path)).keep("pg_class", "pg_attribute")
    for name in ("pg_class", "pg_attribute", "index_keys", "info_columns"):
        expected, got = (sorted(map(tuple, getattr(lake, name).collect()), key=str) for lake in (plain, kept))
        assert got == expected and got
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = kept.index_keys._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in plan and "Exchange" not in plan
