"""More of the engine over generated code: pipes step by step, clauses it doesn't know, structs, calls and surer ways.

As in ``generated``, a row's key chooses a text and is written into it, and SQL over the
same rows says what must be found.
"""

from __future__ import annotations

import io
import tarfile
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from waymark.engine import Ask, Engine, Repo
from waymark.functions.shared import shared_path
from waymark.operators import lineage, narrative, published
from waymark.operators.history import History
from waymark.plans.generated import _key, _repo, _texts, _values
from waymark.plans.queries import read
from waymark.sources import files as source

#: A step of a pipe over t_#, the name that its column a has afterwards, and the kinds of its own uses of a.
FIRST: list[tuple[str, str, str]] = [
    ("WHERE k > 0", "a", ""), ("EXTEND a + 1 AS x", "x", "transform"), ("SET a = a * 2", "a", "excluded transform"), ("RENAME a AS x", "x", "select"), ("DROP z", "a", ""), ("AS q", "q.a", ""),
    ("SELECT a AS x", "x", "select"), ("AGGREGATE MAX(a) AS x GROUP BY k", "x", "dedup_key"), ("DISTINCT", "a", ""), ("ORDER BY k", "a", ""), ("LIMIT 5", "a", ""), ("JOIN u_# AS u ON t_#.k = u.k", "t_#.a", ""),
    ("LEFT JOIN u_# AS u USING (k)", "t_#.a", ""), ("UNION ALL (SELECT * FROM u_#)", "a", ""), ("WINDOW SUM(a) OVER (PARTITION BY k) AS x", "x", "transform"), ("ASSERT k > 0 AS 'm'", "a", ""),
    ("TABLESAMPLE SYSTEM (10 PERCENT)", "a", ""), ("PIVOT (SUM(a) AS s FOR m IN ('x' AS x1))", "s_x1", "pivoted"), ("WITH w AS (SELECT 1 AS z)", "a", ""), ("EXCEPT DISTINCT (SELECT a FROM u_#)", "a", ""),
]
#: A step that uses a column, and the kinds of use.
SECOND: list[tuple[str, str]] = [
    ("WHERE {} > 0", "filter"), ("SELECT {} AS y", "select"), ("ORDER BY {}", "sort"), ("EXTEND {} + 1 AS y", "transform"), ("AGGREGATE COUNT(*) AS c GROUP BY {}", "select aggregation"), ("JOIN w_# AS w ON w.k = {}", "join_key"),
    ("ORDER BY {} |> LIMIT 3", "ranking"),
]
PIPES = [(f"FROM t_# |> {one} |> {two.format(name)}", f"{kinds} {more}".split()) for one, name, kinds in FIRST for two, more in SECOND]


def pipe_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each step of a pipe, and each that may follow it: how a column of the table is used, under whatever name it has by then."""
    repo = _repo_of(spark, sf_dir, [(f"q{v}/s_#.sql", sql) for v, (sql, _) in enumerate(PIPES)])
    own = F.col("table") == F.concat(F.lit("t_"), _key().cast("string"))
    told = repo.tables.uses.where(own & (F.col("column") == "a")).select(F.regexp_extract("file", r"^q(\d+)/", 1).cast("int").alias("variant"), "kind", "file").distinct()
    counted = told.groupBy("variant", "kind").agg(F.count("*").alias("files"))
    refused = repo.tables.problems.groupBy(F.regexp_extract("file", r"^q(\d+)/", 1).cast("int").alias("variant"), F.lit("refused").alias("kind")).agg(F.count("*").alias("files"))
    return counted.unionByName(refused)


def _repo_of(spark: SparkSession, sf_dir: str, variants: list[tuple[str, str]]) -> Repo:
    """A tree with a file for each customer."""
    return Engine(spark).read_all(source.from_rows(_texts(spark, sf_dir, variants, "customer", "c_custkey")))


PIPES_SQL = f"""
WITH said(variant, kind) AS ({_values(sorted({(v, k) for v, (_, kinds) in enumerate(PIPES) for k in kinds}))})
SELECT variant, kind, count(*) AS files FROM said JOIN customer ON c_custkey % {len(PIPES)} = variant GROUP BY ALL
"""

#: A statement with a name in a place that the reader may not know; the name is zed_# wherever it counts.
UNKNOWN: list[str] = [
    "SELECT a FROM t_# |> FROBNICATE zed_#", "SELECT a FROM t_# WHERE b = 1 FROBNICATE zed_#", "SELECT a FROM t_# MATCH_RECOGNIZE (PARTITION BY zed_# DEFINE q AS v > 1)", "DELETE FROM t_# RETURNING zed_#",
    "DELETE FROM t_# WHERE b = 1 RETURNING zed_#", "UPDATE t_# SET a = 1 WHERE b = 2 RETURNING zed_#", "INSERT INTO x_# (a) SELECT a FROM t_# ON CONFLICT zed_# DO NOTHING", "CREATE TABLE x_# WEIGHED BY zed_# AS SELECT a FROM t_#",
    "MERGE x_# USING t_# ON x_#.k = t_#.k WHEN MATCHED THEN UPDATE SET v = 1 OUTPUT zed_#", "SELECT a FROM t_# CONNECT BY PRIOR zed_#", "SELECT a FROM t_# GROUP BY a FOR UPDATE OF zed_#", "SELECT a FROM t_# LIMIT 3 WEIGHTED zed_#",
    "SELECT a FROM t_# WINDOW w AS (zed_# SPLIT)", "CREATE VIEW x_# SORTED zed_# AS SELECT a FROM t_#", "INSERT INTO x_# WITH zed_# (SELECT a FROM t_#)", "EXPORT DATA WITH zed_# AS SELECT a FROM t_#",
]
#: Statements without such a name, which must give no problem.
KNOWN: list[str] = [
    "CREATE TABLE x_# PARTITION BY DATE(d) CLUSTER BY k OPTIONS (description = 'x', labels = [('a', 'b')]) AS SELECT d, k FROM t_#", "CREATE TABLE x_# (a INT64 NOT NULL OPTIONS (description = 'q'), b STRING) OPTIONS (expiration_timestamp = NULL)",
    "SELECT a, COUNT(*) AS n FROM t_# GROUP BY GROUPING SETS ((a), ())", "SELECT x FROM t_#, UNNEST(items) AS x WITH OFFSET AS o WHERE o > 1", "SELECT EXTRACT(DAY FROM d) AS x, SAFE_CAST(a AS NUMERIC) AS y, a::INT AS z FROM t_# TABLESAMPLE SYSTEM (10 PERCENT)",
    "INSERT OVERWRITE TABLE x_# PARTITION (dt = '2020') SELECT a FROM t_#", "CREATE EXTERNAL TABLE x_# (a STRING) WITH PARTITION COLUMNS (b STRING) OPTIONS (format = 'CSV')", "SELECT FIRST_VALUE(a IGNORE NULLS) OVER (w ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS v FROM t_# WINDOW w AS (PARTITION BY b ORDER BY c)",
]
_TREES = [(f"q{v}/s_#.sql", sql) for v, sql in enumerate(UNKNOWN + KNOWN)]


def unread_clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names in clauses that the reader may not know: each is told as a use or in a problem, and nothing known is."""
    t = _repo_of(spark, sf_dir, _TREES).tables
    name = F.concat(F.lit("zed_"), _key().cast("string"))
    used = t.uses.where(F.upper("column") == F.upper(name)).select("file")
    said = t.problems.where(F.contains(F.concat("message", F.lit(" "), "snippet"), name)).select("file")
    told = used.unionByName(said).distinct().withColumn("told", F.lit(True))
    asked = t.problems.select("file").distinct().withColumn("problem", F.lit(True))
    both = t.files.select("file").join(told, "file", "left").join(asked, "file", "left")
    return both.select("file", F.coalesce("told", F.lit(False)).alias("told"), (F.coalesce("problem", F.lit(False)) & F.col("told").isNull()).alias("wrongly"))


UNREAD_SQL = f"""
SELECT 'q' || (c_custkey % {len(_TREES)}) || '/s_' || c_custkey || '.sql' AS "file", c_custkey % {len(_TREES)} < {len(UNKNOWN)} AS told, false AS wrongly FROM customer
"""


def unread_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A column used only where the reader doesn't follow: the answer isn't "none"; whatever is asked, it isn't complete."""
    repo = _repo(spark, sf_dir, [("s_#.sql", "CREATE TABLE out_pub AS SELECT a FROM raw.t WHERE b = 1 LIMIT 3 WEIGHTED zed")])
    rows = []
    for table, column in (("raw.t", "zed"), ("raw.gone", "nowhere")):
        scan = repo.scan([Ask(table, [column])], published.parse_rule("_pub"), "removal")
        rows.append((column, scan.risk, scan.coverage["complete"]))
    return spark.createDataFrame(rows, "asked string, risk string, complete boolean")


RISK_SQL = """SELECT * FROM (VALUES ('zed', 'unknown', false), ('nowhere', 'none', false)) v(asked, risk, complete) WHERE (SELECT count(*) FROM supplier) > 0"""


def shared_procedures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two files that call one procedure: its temporary tables are theirs, and theirs its, but neither sees the other's."""
    repo = _repo(spark, sf_dir, [("a_#.sql", "CREATE TEMP TABLE hold AS SELECT b FROM raw.one_#;\nCALL p_#();\nCREATE TABLE a_# AS SELECT b FROM kept")],
                 [("b_#.sql", "CREATE TEMP TABLE other AS SELECT b FROM raw.two_#;\nCALL p_#();\nCREATE TABLE b_# AS SELECT b FROM hold")],
                 [("p_#.sql", "CREATE PROCEDURE p_#()\nBEGIN\n  CREATE TEMP TABLE kept AS SELECT b FROM raw.three_#;\n  CREATE TABLE p_# AS SELECT b FROM hold;\n  CALL deep_#();\nEND")],
                 [("d_#.sql", "CREATE PROCEDURE deep_#()\nBEGIN\n  CREATE TABLE d_# AS SELECT b FROM other;\nEND")])
    k = read(spark, sf_dir, "supplier").select(F.explode(F.array(*(F.concat(F.lit(f"raw.{n}_"), "s_suppkey") for n in ("one", "two", "three")))).alias("table"), F.lit("b").alias("column"))
    nodes, _, _ = lineage.walk_columns(repo.tables.flows, lineage.column_start(k), repo.catalog)
    return nodes.where("not startswith(at_table, '#') and hop > 0").select("root", F.col("at_table").alias("table")).distinct()


SHARED_SQL = """
SELECT 'raw.' || n || '_' || s_suppkey || '.b' AS root, t || '_' || s_suppkey AS "table" FROM supplier, (VALUES ('one', 'p'), ('two', 'd'), ('three', 'a')) v(n, t)
"""


def surer_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A short way through a star whose columns are listed nowhere, and a longer one that is certain: the surer one counts."""
    repo = _repo(spark, sf_dir, [("m_#.sql", "CREATE TABLE mid_# AS SELECT * FROM raw.u_#")], [("r_#.sql", "CREATE TABLE out_# AS SELECT a FROM mid_#")],
                 [("n_#.sql", "SELECT 1"), ("n_#.sql", "CREATE TABLE s_# AS SELECT a FROM raw.u_#;\nINSERT INTO mid_# (a) SELECT a FROM s_#"), ("n_#.sql", "CREATE TABLE s_# AS SELECT * FROM raw.u_#;\nINSERT INTO mid_# SELECT * FROM s_#")])
    start = read(spark, sf_dir, "supplier").select(F.concat(F.lit("raw.u_"), "s_suppkey").alias("table"), F.lit("a").alias("column"))
    nodes, _, _ = lineage.walk_columns(repo.tables.flows, lineage.column_start(start), repo.catalog)
    found = lineage.findings(nodes, repo.tables.uses, repo.tables.statements, "removal").where("startswith(file, 'r_')")
    return found.select("file", F.col("hop").cast("bigint").alias("hop"), F.col("inferred_hops").cast("bigint").alias("inferred"))


SURER_SQL = """SELECT 'r_' || s_suppkey || '.sql' AS "file", 1::BIGINT AS hop, CASE WHEN s_suppkey % 3 = 1 THEN 0 ELSE 1 END::BIGINT AS inferred FROM supplier"""


def struct_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of structs through tables that pass the struct on whole, rename it, spread it, or take one field."""
    repo = _repo(spark, sf_dir, [("v_#.sql", "CREATE TABLE v_# AS SELECT STRUCT(a AS code, STRUCT(b AS deep, c AS low) AS more) AS payload FROM raw.t_#")],
                 [("w_#.sql", "CREATE TABLE w_# AS SELECT payload AS p FROM v_#")],
                 [("x_#.sql", "CREATE TABLE x_# AS SELECT p.code AS x FROM w_#"), ("x_#.sql", "CREATE TABLE x_# AS SELECT w.p.more.deep AS x FROM w_# AS w"), ("x_#.sql", "CREATE TABLE x_# AS SELECT UPPER(p.more.low) AS x FROM w_#"), ("x_#.sql", "CREATE TABLE x_# AS SELECT p.more AS x FROM w_#")])
    start = read(spark, sf_dir, "supplier").select(F.concat(F.lit("raw.t_"), "s_suppkey").alias("table"), F.explode(F.array(F.lit("a"), F.lit("b"), F.lit("c"))).alias("column"))
    nodes, _, _ = lineage.walk_columns(repo.tables.flows, lineage.column_start(start), repo.catalog)
    return nodes.where("hop > 0 and inferred = 0").select("root", F.col("at_table").alias("table"), F.col("at_column").alias("column")).distinct()


STRUCT_SQL = """
WITH f(c, path) AS (VALUES ('a', '.code'), ('b', '.more.deep'), ('c', '.more.low')),
x(variant, c, shown) AS (VALUES (0, 'a', 'x'), (1, 'b', 'x'), (2, 'c', 'x'), (3, 'b', 'x.deep'), (3, 'c', 'x.low'))
SELECT 'raw.t_' || s_suppkey || '.' || c AS root, 'v_' || s_suppkey AS "table", 'payload' || path AS "column" FROM supplier, f
UNION ALL SELECT 'raw.t_' || s_suppkey || '.' || c, 'w_' || s_suppkey, 'p' || path FROM supplier, f
UNION ALL SELECT 'raw.t_' || s_suppkey || '.' || c, 'x_' || s_suppkey, shown FROM supplier JOIN x ON s_suppkey % 4 = variant
"""


def tuple_variables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variables set together take the columns of a query in order."""
    repo = _repo(spark, sf_dir, [("v_#.sql", "DECLARE p, q INT64;\nSET (p, q) = (SELECT a, b FROM raw.s_#);\nCREATE TABLE v_# AS SELECT c FROM raw.o_# WHERE d > q")])
    start = read(spark, sf_dir, "supplier").select(F.concat(F.lit("raw.s_"), "s_suppkey").alias("table"), F.explode(F.array(F.lit("a"), F.lit("b"))).alias("column"))
    nodes, _, _ = lineage.walk_columns(repo.tables.flows, lineage.column_start(start), repo.catalog)
    return nodes.where("not startswith(at_table, '#') and hop > 0").select("root", F.col("at_table").alias("table")).distinct()


TUPLE_SQL = """SELECT 'raw.s_' || s_suppkey || '.b' AS root, 'v_' || s_suppkey AS "table" FROM supplier"""


def many_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A name for each part, looked up in the text of a file for each customer: the lines that have it whole."""
    k, n = F.col("c_custkey"), F.lit(7)
    body = F.concat_ws("\n", F.concat(F.lit("x = get('col_"), k, F.lit("')")), F.lit("nothing"), F.concat(F.lit("-- col_"), k * n, F.lit(" and Col_"), k + 1, F.lit(", not xcol_"), k + 2, F.lit(" nor p-col_9")))
    files = read(spark, sf_dir, "customer").select(F.concat(F.lit("a_"), k, F.lit(".py")).alias("file"), body.alias("text"))
    wanted = read(spark, sf_dir, "part").select(F.concat(F.lit("col_"), "p_partkey").alias("name")).unionByName(spark.createDataFrame([("p-col_9",), ("no.such-name",)], "name string"))
    found = Engine(spark).read_all(source.from_rows(files)).search(wanted)
    return found.select("file", F.col("line_no").cast("bigint").alias("line_no"), "name")


MANY_SQL = """
WITH p AS (SELECT DISTINCT p_partkey AS k FROM part), c AS (SELECT c_custkey AS k FROM customer)
SELECT 'a_' || k || '.py' AS "file", 1::BIGINT AS line_no, 'col_' || k AS name FROM c WHERE k IN (SELECT k FROM p)
UNION ALL SELECT 'a_' || k || '.py', 3, CASE WHEN 7 * k IN (SELECT k FROM p) THEN 'col_' || 7 * k WHEN k + 1 IN (SELECT k FROM p) THEN 'col_' || (k + 1) ELSE 'p-col_9' END FROM c
"""


def archived_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A packed tar of the suppliers of each nation, written to the shared folder and read back by ranges."""
    folder = shared_path(spark, "archives")

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(folder)
        system.create_dir(root, recursive=True)
        nation = int(rows["nation"].iloc[0])
        with system.open_output_stream(f"{root}/n{nation}.tar.gz", compression=None) as f, tarfile.open(fileobj=f, mode="w|gz") as tar:
            for name, text in sorted(zip(rows["name"], rows["text"])):
                info = tarfile.TarInfo(f"owner-repo-0123abc/{name}")
                info.size = len(text.encode())
                tar.addfile(info, io.BytesIO(text.encode()))
        return pd.DataFrame({"nation": [nation]})

    key = F.col("s_suppkey").cast("string")
    rows = read(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("bigint").alias("nation"), F.concat(F.lit("sql/s_"), key, F.when(F.col("s_suppkey") % 5 == 0, ".md").otherwise(".sql")).alias("name"), F.concat(F.lit("SELECT a FROM raw.t_"), key).alias("text"))
    rows.groupBy("nation").applyInPandas(pack, "nation bigint").write.format("noop").mode("overwrite").save()
    tree = source.read_archive(spark, folder)
    return tree.files.select("file", "text").unionByName(tree.unread.select("file", F.col("kind").alias("text")))


ARCHIVED_SQL = """
SELECT 'sql/s_' || s_suppkey || CASE WHEN s_suppkey % 5 = 0 THEN '.md' ELSE '.sql' END AS "file", CASE WHEN s_suppkey % 5 = 0 THEN 'not_code' ELSE 'SELECT a FROM raw.t_' || s_suppkey END AS text FROM supplier
"""


def history_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An answer for each region, saved and given a status, before and after its events are made one table."""
    h = History(spark, shared_path(spark, "history"), most=0)
    names = [r["r_name"] for r in read(spark, sf_dir, "region").orderBy("r_regionkey").select("r_name").collect()]
    made = [h.save(name, "low", change="removal") for name in names[:3]]
    h.set_status(made[0], "In progress")
    h.compact()
    made += [h.save(name, "high") for name in names[3:]]
    h.set_status(made[0], "Closed")
    h.set_status(made[3], "Verified")
    h.compact()
    h.set_status(made[1], "Verified")
    return h.rows().select("subject", "risk", "status", "change")


HISTORY_SQL = """
SELECT r_name AS subject, CASE WHEN n < 3 THEN 'low' ELSE 'high' END AS risk, CASE n WHEN 0 THEN 'Closed' WHEN 1 THEN 'Verified' WHEN 3 THEN 'Verified' ELSE 'New' END AS status, CASE WHEN n < 3 THEN 'removal' ELSE 'unknown' END AS change
FROM (SELECT r_name, row_number() OVER (ORDER BY r_regionkey) - 1 AS n FROM region)
"""


def walked_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings by published table, the most first: for each nation a published table that all of its suppliers' files feed, and one that only a star reaches."""
    k, n = F.col("s_suppkey").cast("string"), F.col("s_nationkey").cast("string")
    rows = read(spark, sf_dir, "supplier")
    own = rows.select(F.concat(F.lit("a_"), k, F.lit(".sql")).alias("file"), F.concat(F.lit("CREATE TABLE mid_"), k, F.lit(" AS SELECT code AS c FROM raw.people WHERE code > 0;\nINSERT INTO nation_"), n, F.lit("_pub (d) SELECT c FROM mid_"), k).alias("text"))
    repo = Engine(spark).read_all(source.from_rows(own))
    s = repo.scan([Ask("raw.people", ["code"])], published.parse_rule("_pub"), "removal")
    order = Window.orderBy(F.desc("findings"), F.upper("prod"))
    return s.groups.withColumn("place", F.row_number().over(order)).select("prod", "matched", F.col("findings").cast("bigint").alias("findings"), F.col("breaking").cast("bigint").alias("breaking"), F.col("nearest").cast("bigint").alias("nearest"), F.col("place").cast("bigint").alias("place"), F.size("statements").cast("bigint").alias("statements"))


GROUPS_SQL = """
SELECT 'nation_' || s_nationkey || '_pub' AS prod, 'suffix' AS matched, 2 * count(*) AS findings, 2 * count(*) AS breaking, 0::BIGINT AS nearest, row_number() OVER (ORDER BY count(*) DESC, upper('nation_' || s_nationkey || '_pub')) AS place, 2 * count(*) AS statements
FROM supplier GROUP BY s_nationkey
"""


def walked_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an answer counts and how sure it is, over a file for each supplier: found, hidden in text, not followed, not opened."""
    repo = _repo(spark, sf_dir, [("a_#.sql", "CREATE TABLE out_#_pub AS SELECT code FROM raw.people"), ("a_#.sql", "CREATE TABLE mid_# AS SELECT * FROM raw.people"), ("a_#.sql", "SELECT tag('code') AS x FROM raw.other_#"), ("a_#.sql", "TRUNCATE TABLE raw.people"), ("a_#.ipynb", "{}"), ("a_#.sql", "SELECT FROM WHERE code")])
    s = repo.scan([Ask("raw.people", ["code"])], published.parse_rule("_pub"), "removal")
    stats, gaps = s.stats, {g["what"]: g["count"] for g in s.coverage["gaps"]}
    pick = lambda *words: sum(v for what, v in gaps.items() if all(w in what for w in words))
    rows = [("published", stats["productionTables"]), ("files", stats["filesWithImpact"]), ("breaking", stats["breakingUsages"]), ("unread", stats["couldNotRead"]), ("hidden", pick("out of reach")), ("opaque", pick("followed")), ("closed", pick("type")), ("complete", int(s.coverage["complete"])), ("high", int(s.risk == "high"))]
    return spark.createDataFrame(rows, "what string, n bigint")


STATS_SQL = """
WITH v AS (SELECT s_suppkey % 6 AS v FROM supplier), c AS (SELECT count(*) FILTER (v = 0) AS a, count(*) FILTER (v = 1) AS b, count(*) FILTER (v = 2) AS h, count(*) FILTER (v = 3) AS o, count(*) FILTER (v = 4) AS n, count(*) FILTER (v = 5) AS u FROM v)
SELECT 'published' AS what, a AS n FROM c UNION ALL SELECT 'files', a + b FROM c UNION ALL SELECT 'breaking', a FROM c UNION ALL SELECT 'unread', u FROM c UNION ALL SELECT 'hidden', h + o + u FROM c UNION ALL SELECT 'opaque', o FROM c
UNION ALL SELECT 'closed', n FROM c UNION ALL SELECT 'complete', 0 FROM c UNION ALL SELECT 'high', 0 FROM c
"""


def walked_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How each statement takes a table that is asked about whole."""
    repo = _repo(spark, sf_dir, [("a_#.sql", "CREATE TABLE x_# AS SELECT 1 AS one FROM raw.people"), ("a_#.sql", "CREATE TABLE x_# AS SELECT t.a FROM raw.t_# t JOIN raw.people p ON p.k = t.k"), ("a_#.sql", "CREATE TABLE x_# CLONE raw.people"), ("a_#.sql", "EXPORT DATA OPTIONS (uri='gs://b/#/*.csv') AS SELECT k FROM raw.people"), ("a_#.sql", "SELECT a FROM raw.people_old")],
                 [("b_#.sql", "CREATE TABLE y_# AS SELECT * FROM x_#")])
    s = repo.scan([Ask("raw.people", whole=True)], published.parse_rule("y_*"), "removal")
    return s.findings.select("file", F.col("detail").alias("role"), F.col("hop").cast("bigint").alias("hop"), "breaking")


TABLES_SQL = """
SELECT 'a_' || s_suppkey || '.sql' AS "file", ['read', 'joined', 'copied', 'exported'][(s_suppkey % 5 + 1)::INT] AS role, 0::BIGINT AS hop, true AS breaking FROM supplier WHERE s_suppkey % 5 < 4
UNION ALL SELECT 'b_' || s_suppkey || '.sql', 'read', 1, true FROM supplier WHERE s_suppkey % 5 < 3
"""

#: A file, and what is told of it by hand: the statement that can't be followed, the line, and the score that orders it.
BY_HAND: list[tuple[str, str, int]] = [
    ("a_#.sql", "SELECT 1;\nCALL d.fill('people')", 7), ("a_#.py", 'q = """\nGRANT SELECT ON raw.people TO x\n"""\n', 5), ("a_#.sql", "SELECT x FROM raw.other", 0), ("a_#.sql", "SELECT FROM code", 7), ("a_#.ipynb", "{}", 1), ("a_#.sql", "SELECT a FROM raw.t GROUP BY", 3),
]


def by_hand_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a person has to look at, what bears on the question first."""
    repo = _repo(spark, sf_dir, [(f, x) for f, x, _ in BY_HAND])
    s = repo.scan([Ask("raw.people", ["code"])], published.parse_rule("_pub"), "removal")
    return s.by_hand.select("file", F.col("score").cast("bigint").alias("score")).distinct()


BY_HAND_SQL = f"""
WITH v(variant, file, score) AS ({_values([(k, f, n) for k, (f, _, n) in enumerate(BY_HAND)])})
SELECT replace(file, '#', s_suppkey::VARCHAR) AS "file", score::BIGINT AS score FROM v JOIN supplier ON s_suppkey % {len(BY_HAND)} = variant WHERE score > 0
"""


def answer_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An answer as JSON, part by part: rows that lead to several published tables stand in it once."""
    repo = _repo(spark, sf_dir, [("a_#.sql", "CREATE TABLE m_# AS SELECT code AS c FROM raw.people")], [("b_#.sql", "CREATE TABLE one_#_pub AS SELECT c FROM m_#;\nCREATE TABLE two_#_pub AS SELECT c FROM m_#"), ("b_#.sql", "CREATE TABLE side_# AS SELECT c FROM m_#")])
    s = repo.scan([Ask("raw.people", ["code"])], published.parse_rule("_pub"), "removal")
    told = narrative.document(s).where("part in ('groups', 'rows', 'other', 'reached', 'head')")
    said = F.coalesce(F.get_json_object("json", "$.prod"), F.get_json_object("json", "$.target"), F.get_json_object("json", "$.at_table"), F.get_json_object("json", "$.risk"))
    return told.select("part", said.alias("said"), F.coalesce(F.json_array_length(F.get_json_object("json", "$.groups")), F.lit(0)).cast("bigint").alias("groups"))


DOCUMENT_SQL = """
WITH s AS (SELECT s_suppkey AS k, s_suppkey % 2 = 0 AS two FROM supplier), p AS (SELECT unnest(['one_', 'two_']) || k || '_pub' AS prod FROM s WHERE two)
SELECT 'head' AS part, 'medium' AS said, 0::BIGINT AS groups UNION ALL SELECT 'groups', prod, 0 FROM p UNION ALL SELECT 'reached', prod, 0 FROM p UNION ALL SELECT 'reached', 'm_' || k, 0 FROM s UNION ALL SELECT 'reached', 'side_' || k, 0 FROM s WHERE NOT two
UNION ALL SELECT 'rows', 'm_' || k, 2 FROM s WHERE two UNION ALL SELECT 'rows', 'one_' || k || '_pub', 2 FROM s WHERE two UNION ALL SELECT 'other', 'm_' || k, 0 FROM s WHERE NOT two UNION ALL SELECT 'other', 'side_' || k, 0 FROM s WHERE NOT two
"""


#: A file, and what the reader tells of it beside uses: (what, value).
TOLD: list[tuple[str, str, str, str]] = [
    ("stem_#.sql", "SELECT a FROM raw.t_#", "named after its file", "stem_#"), ("p_#.sql", "CREATE TABLE x_# AS SELECT {cols}, b FROM raw.t_#", "a placeholder in the select list", "x_#"),
    ("l_#.sql", "LOAD DATA INTO d.x_# (a STRING, b INT64) FROM FILES (format = 'CSV', uris = ['gs://x'])", "columns stated by a load", "a,b"), ("d_#.sql", "CREATE TABLE x_# AS SELECT b FROM raw.t_# WHERE e = 'lit_#'", "a literal", "lit_#"),
    ("d_#.sql", "CREATE TABLE x_# AS SELECT b FROM raw.t_# WHERE e IN ('lit_#', 'm')", "a literal", "lit_#, m"), ("h_#.sql", "SELECT a FROM raw.t_# WHERE {{ cond }} AND b = {v}", "named after its file", "h_#"),
    ("c_#.sql", "TRUNCATE TABLE raw.t_#", "can't be followed", "OTHER"), ("c_#.sql", "CALL d.fill_#(1)", "can't be followed", "CALL"), ("c_#.sql", "GRANT SELECT ON TABLE raw.t_# TO 'x'", "can't be followed", "OTHER"),
    ("e_#.py", "q = \"\"\"SELECT a FROM raw.t_#\"\"\"\nrun(q, destination='d.o_#')\n", "named by its program", "o_#"), ("r_#.sql", "EXECUTE IMMEDIATE 'CREATE TABLE x_# AS SELECT a FROM raw.t_#'", "run as text", "x_#"),
    ("g_#.sql", "CREATE TABLE x_# AS SELECT * FROM raw.nowhere_#", "columns listed nowhere", "x_#"),
]


def reader_told(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is told of statements beside their uses: how they got their target, literals, columns of loads, what can't be followed, gaps."""
    repo = _repo(spark, sf_dir, [(f, x) for f, x, _, _ in TOLD])
    t = repo.tables
    s = t.statements
    parts = [
        s.where("named_by = 'file'").select("file", F.lit("named after its file").alias("what"), F.col("target").alias("value")), s.where("named_by = 'program'").select("file", F.lit("named by its program"), "target"),
        s.where("star_note <> ''").select("file", F.lit("a placeholder in the select list"), "target"), s.where("opaque").select("file", F.lit("can't be followed"), "kind"), s.where("as_text").select("file", F.lit("run as text"), "target"),
        t.uses.where("kind = 'filter' and detail <> ''").select("file", F.lit("a literal"), "detail"), t.columns.where("kind = 'LOAD'").groupBy("file").agg(F.array_sort(F.collect_list("name")).alias("n")).select("file", F.lit("columns stated by a load"), F.array_join("n", ",")),
        repo.gaps.where("contains(table, 'x_')").select("file", F.lit("columns listed nowhere"), "table"), t.problems.select("file", F.lit("not read"), "message"),
    ]
    out = parts[0]
    for more in parts[1:]:
        out = out.union(more)
    return out


TOLD_SQL = f"""
WITH v(variant, file, what, value) AS ({_values([(k, f, w, x) for k, (f, _, w, x) in enumerate(TOLD)])})
SELECT replace(file, '#', s_suppkey::VARCHAR) AS "file", what, replace(value, '#', s_suppkey::VARCHAR) AS value FROM v JOIN supplier ON s_suppkey % {len(TOLD)} = variant
UNION ALL SELECT 'p_' || s_suppkey || '.sql', 'columns listed nowhere', 'x_' || s_suppkey FROM supplier WHERE s_suppkey % {len(TOLD)} = 1
"""


def letter_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summary and the reply of an answer with more published tables than are listed."""
    repo = _repo(spark, sf_dir, [("a_#.sql", "CREATE TABLE out_#_pub AS SELECT id FROM raw.people WHERE code = 1")])
    s = repo.scan([Ask("raw.people", ["code"])], published.parse_rule("_pub"), "removal")
    said = narrative.summarise(s)
    lines = [("headline", said["headline"]), *(("point", p) for p in said["points"] if "affected" in p or "break" in p), ("actions", str(len(said["actions"]))), ("reply", narrative.reply(s, "Ana").splitlines()[0]), ("signed", narrative.reply(s).splitlines()[-1])]
    return spark.createDataFrame(lines, "part string, said string")


LETTER_SQL = """
WITH t AS (SELECT 'out_' || s_suppkey || '_pub' AS prod FROM supplier), n AS (SELECT count(*) AS n FROM t), f AS (SELECT string_agg(prod, ', ' ORDER BY upper(prod)) AS first FROM (SELECT prod FROM t ORDER BY upper(prod) LIMIT 6))
SELECT 'headline' AS part, 'Risk: medium. Something breaks, and can be changed here.' AS said
UNION ALL SELECT 'point', n || ' published tables affected: ' || first || ' and ' || (n - 6) || ' more.' FROM n, f
UNION ALL SELECT 'point', n || ' uses in ' || n || ' files would break.' FROM n UNION ALL SELECT 'actions', '6' UNION ALL SELECT 'reply', 'Dear Ana,' UNION ALL SELECT 'signed', 'Regards'
"""


def trail_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes on the trail: stars, tables built in several files, names that stand for several tables, targets named by files."""
    repo = _repo(spark, sf_dir, [("a_#.sql", "CREATE TABLE one.s_# AS SELECT * FROM raw.people"), ("a_#.sql", "CREATE TABLE one.s_# AS SELECT code FROM raw.people"), ("stem_#.sql", "SELECT code FROM raw.people")], [("b_#.sql", "SELECT 1"), ("b_#.sql", "CREATE TABLE two.s_# AS SELECT code FROM raw.people"), ("b_#.sql", "SELECT 1")])
    s = repo.scan([Ask("raw.people", ["code"])], published.parse_rule("_pub"), "removal")
    return s.notes.where("kind <> ''").select("kind", "table", F.regexp_replace("detail", "a_|b_|[.]sql", "").alias("detail"))


NOTES_SQL = """
SELECT 'takes every column' AS kind, 'one.s_' || s_suppkey AS "table", 'its columns are listed nowhere' AS detail FROM supplier WHERE s_suppkey % 3 = 0
UNION ALL SELECT 'built in several files', 'S_' || s_suppkey, s_suppkey || ', ' || s_suppkey FROM supplier WHERE s_suppkey % 3 = 1
UNION ALL SELECT 'stands for several tables', 'S_' || s_suppkey, 'ONE, TWO' FROM supplier WHERE s_suppkey % 3 = 1
UNION ALL SELECT 'named after its file', 'stem_' || s_suppkey, 'stem_' || s_suppkey FROM supplier WHERE s_suppkey % 3 = 2
"""


ALL: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "pipe_steps": (pipe_steps, PIPES_SQL), "unread_clauses": (unread_clauses, UNREAD_SQL), "unread_risk": (unread_risk, RISK_SQL), "shared_procedures": (shared_procedures, SHARED_SQL),
    "surer_ways": (surer_ways, SURER_SQL), "struct_walk": (struct_walk, STRUCT_SQL), "tuple_variables": (tuple_variables, TUPLE_SQL), "many_names": (many_names, MANY_SQL),
    "archived_trees": (archived_trees, ARCHIVED_SQL), "history_kept": (history_kept, HISTORY_SQL), "walked_groups": (walked_groups, GROUPS_SQL), "walked_stats": (walked_stats, STATS_SQL), "walked_tables": (walked_tables, TABLES_SQL), "by_hand_order": (by_hand_order, BY_HAND_SQL), "answer_document": (answer_document, DOCUMENT_SQL), "reader_told": (reader_told, TOLD_SQL),
    "letter_written": (letter_written, LETTER_SQL), "trail_notes": (trail_notes, NOTES_SQL),
}
