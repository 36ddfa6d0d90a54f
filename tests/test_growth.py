"""Steps whose work must grow with what they are given: tables so large that all pairs of them would not end in time."""

import threading
from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

from waymark.engine import Engine, Scan
from waymark.operators import lineage
from waymark.plans import tables
from waymark.sources.files import from_rows

MANY = 150_000


@contextmanager
def within(spark, seconds):
    """Jobs are cancelled, and so fail, after so many seconds."""
    late = threading.Timer(seconds, spark.sparkContext.cancelAllJobs)
    late.start()
    try:
        yield
    finally:
        late.cancel()


def test_findings_on_one_column_with_a_table_behind_each(spark):
    k = F.col("id").cast("string")
    scan = Scan.__new__(Scan)
    scan.findings = spark.range(MANY).select(F.lit("PEOPLE").alias("short"), F.lit("CODE").alias("key"), F.concat(F.lit("out_"), k).alias("target"), k.alias("stmt"))
    end = F.concat(F.lit("OUT_"), k)
    ends = spark.range(MANY).select(F.lit("r").alias("root"), end.alias("end"), end.alias("prod"), F.lit("suffix").alias("how"), F.explode(F.array(F.struct(F.lit("PEOPLE").alias("short"), F.lit("CODE").alias("key")), F.struct(end.alias("short"), F.lit("X").alias("key")))).alias("x"))
    scan.led = ends.select("root", "end", "prod", "how", "x.*").union(spark.createDataFrame([("r", "OUT_1", "OUT_1", "suffix", "OUT_0", "X"), ("r", "OUT_2", "OUT_2", "suffix", "OUT_0", "X")], "root string, end string, prod string, how string, short string, key string"))
    with within(spark, 60):
        placed = scan._placed
        assert placed.count() == MANY + 2
        assert {(r["prod"], r["how"]) for r in placed.where("stmt = '0'").collect()} == {("OUT_0", "suffix"), ("OUT_1", "suffix"), ("OUT_2", "suffix")}


@pytest.mark.parametrize("name", ["hold", "$VARIABLES"])
def test_names_that_every_file_has_for_itself(spark, name):
    """Temporary tables and variables of one name in many files meet their own file's only."""
    fenced = F.concat(F.lit("#F_"), F.col("id"), F.lit(f"_SQL.{name.upper()}"))
    front = spark.range(MANY).select(F.lit(name.upper()).alias("short"), fenced.alias("ds"))
    rows = spark.range(MANY).select(F.col("id").alias("stmt"), fenced.alias("table"), F.lit(name.upper()).alias("s_short"), fenced.alias("s_ds"))
    with within(spark, 60):
        met = lineage.reading(front, rows, False).select("ds", "s_ds", "by")
        assert met.count() == MANY and met.where("ds <> s_ds or by <> 'name'").count() == 0
        plain = spark.createDataFrame([(name.upper(), ""), (name.upper(), "D")], "short string, ds string")
        assert lineage.reading(plain, rows, False).count() == 0  # a fenced name is no plain table's


def test_what_was_read_from_a_large_tree_is_not_sent_whole(spark, monkeypatch, capsys):
    """Spark takes what was parsed for as small as the table it came from; joins of a large tree's frames don't go by that."""
    monkeypatch.setattr(tables, "PARTITION", 1000)
    texts = spark.range(200).select(F.format_string("a_%d.sql", "id").alias("file"), F.format_string("CREATE TABLE m_%d AS SELECT a, b FROM raw.t_%d", "id", "id").alias("text"))
    t = Engine(spark).read_all(from_rows(texts)).tables
    for joined in (t.flows.join(t.statements, "stmt"), t.uses.join(t.flows, "stmt"), t.statements.join(t.files, "file")):
        joined.explain()
        plan = capsys.readouterr().out
        assert "SortMergeJoin" in plan and "Broadcast" not in plan
