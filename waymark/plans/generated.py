"""The engine over code generated from the driver's tables, a file for each row, with the SQL that must agree.

A row's key chooses one of several texts and is written into it, so that every file names
tables of its own; what the engine must find is counted by SQL over the same rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.engine import Ask, Engine, Repo
from waymark.functions import text
from waymark.operators import catalog, lineage, published, usages
from waymark.plans.queries import read
from waymark.sources import files as source
from waymark.sources import notices

Variant = tuple[str, str]


def _texts(spark: SparkSession, sf_dir: str, variants: list[Variant], table: str = "supplier", key: str = "s_suppkey") -> DataFrame:
    """(file, text): for each supplier, or row of another table, the variant that its key falls on, with its key for the mark #."""
    k = F.col(key)

    def pick(at: int) -> Column:
        of = F.array(*(F.lit(v[at]) for v in variants))
        return F.replace(F.element_at(of, (k % len(variants) + 1).cast("int")), F.lit("#"), k.cast("string"))

    return read(spark, sf_dir, table).select(pick(0).alias("file"), pick(1).alias("text"))


def _repo(spark: SparkSession, sf_dir: str, *families: list[Variant]) -> Repo:
    """A tree with one file of each family for each supplier."""
    rows = [_texts(spark, sf_dir, f) for f in families]
    every = rows[0]
    for more in rows[1:]:
        every = every.unionByName(more)
    return Engine(spark).read_all(source.from_rows(every))


def _key(column: str = "file") -> Column:
    return F.regexp_extract(column, r"_(\d+)", 1).cast("bigint")


def _values(rows: list[tuple]) -> str:
    def one(v: object) -> str:
        return ("true" if v else "false") if isinstance(v, bool) else str(v) if isinstance(v, int) else "'" + str(v).replace("'", "''") + "'"

    return "VALUES " + ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows)


# --- statements -------------------------------------------------------------------------

#: A statement, and the (table's letter, column, kind) of the uses in it.
USES: list[tuple[str, str]] = [
    ("SELECT a FROM t_#", "t a select"),
    ("SELECT UPPER(a) AS b FROM t_#", "t a transform"),
    ("SELECT b FROM t_# WHERE a = 'x'", "t b select, t a filter"),
    ("SELECT t.b FROM t_# t JOIN u_# u ON t.k = u.k", "t b select, t k join_key, u k join_key"),
    ("SELECT b FROM t_# t JOIN u_# u USING (k)", "t b select, u b select, t k join_key, u k join_key"),
    ("SELECT b, COUNT(*) AS n FROM t_# GROUP BY b HAVING MAX(a) > 1", "t b select, t b aggregation, t a filter, t a dedup_key"),
    ("SELECT b FROM t_# QUALIFY ROW_NUMBER() OVER (PARTITION BY k ORDER BY o) = 1", "t b select, t k dedup_key, t o ranking"),
    ("SELECT MAX(a) AS x FROM t_#", "t a dedup_key"),
    ("SELECT SUM(a) AS x FROM t_#", "t a transform"),
    ("SELECT b FROM t_# ORDER BY a", "t b select, t a sort"),
    ("SELECT b FROM t_# ORDER BY a LIMIT 5", "t b select, t a ranking"),
    ("SELECT SUM(a) OVER w AS x FROM t_# WINDOW w AS (PARTITION BY k ORDER BY o)", "t a transform, t k dedup_key, t o ranking"),
    ("SELECT a, COUNT(*) AS n FROM t_# GROUP BY GROUPING SETS ((a, b), (a))", "t a select, t a aggregation, t b aggregation"),
    ("SELECT a FROM t_# GROUP BY CUBE (a, b)", "t a select, t a aggregation, t b aggregation"),
    ("SELECT b FROM t_# WHERE k IN (SELECT k FROM u_# WHERE z > 1)", "t b select, t k filter, u k select, u z filter"),
    ("SELECT * FROM t_#", "t * star"),
    ("SELECT * EXCEPT (a) FROM t_#", "t * star, t a excluded"),
    ("SELECT * REPLACE (UPPER(a) AS a) FROM t_#", "t * star, t a excluded, t a transform"),
    ("SELECT * FROM t_# PIVOT (SUM(v) FOR m IN ('x', 'y'))", "t v pivoted, t m pivoted"),
    ("SELECT * FROM t_# UNPIVOT (v FOR m IN (jan, feb))", "t jan pivoted, t feb pivoted"),
    ("CREATE TABLE x_# PARTITION BY DATE(d) CLUSTER BY k AS SELECT d, k FROM t_#", "t d select, t k select, t d layout, t k layout"),
    ("MERGE t_# USING u_# ON t_#.k = u_#.k WHEN MATCHED AND u_#.f THEN UPDATE SET v = u_#.v", "t k join_key, u k join_key, u f filter, u v select"),
    ("UPDATE t_# SET a = b WHERE c = 1", "t a transform, t b transform, t c filter"),
    ("DELETE FROM t_# WHERE c = 1", "t c filter"),
    ("ALTER TABLE t_# RENAME COLUMN a TO b", "t a renamed"),
    ("ALTER TABLE t_# DROP COLUMN a", "t a dropped"),
    ("ALTER TABLE t_# ALTER COLUMN a SET DATA TYPE STRING", "t a retyped"),
    ("FROM t_# |> WHERE a > 1 |> SELECT b", "t a filter, t b select"),
    ("EXECUTE IMMEDIATE 'DELETE FROM t_# WHERE c = 1'", "t c filter"),
    ("WITH w AS (SELECT a AS b FROM t_#) SELECT w.b FROM w WHERE w.b > 0", "t a select, t a filter"),
    ("SELECT s.b FROM (SELECT a AS b FROM t_#) s", "t a select"),
    ("SELECT CASE WHEN a = 1 THEN b ELSE c END AS x FROM t_#", "t a transform, t b transform, t c transform"),
    ("SELECT CAST(a AS STRING) AS x FROM t_#", "t a transform"),
    ("SELECT a FROM t_# UNION ALL SELECT b FROM u_#", "t a select, u b select"),
    ("DELETE FROM t_# USING u_# WHERE t_#.k = u_#.z", "t k filter, u z filter"),
    ("DELETE a FROM t_# a JOIN u_# b ON a.k = b.k WHERE b.z = 1", "t k join_key, u k join_key, u z filter"),
    ("SELECT e.v FROM APPENDS(TABLE t_#, NULL, NULL) e", "t v select"),
    ("SELECT b FROM t_# JOIN EXTERNAL_QUERY('c', 'SELECT 1') e ON e.k = t_#.k", "t b select, t k join_key"),
    ("SET (p, q) = (SELECT a, b FROM t_#)", "t a select, t b select"),
    ("UPDATE t_# SET s.f = u_#.g FROM u_# WHERE t_#.k = u_#.k", "t s.f transform, u g transform, t k filter, u k filter"),
    ("SELECT b, ROW_NUMBER() OVER (PARTITION BY k ORDER BY o) AS rn FROM t_# QUALIFY rn = 1", "t b select, t k dedup_key, t o ranking"),
    ("CREATE TABLE FUNCTION x_#(d STRING) AS (SELECT b FROM t_# WHERE c = d)", "t b select, t c filter"),
    ("SELECT t FROM t_# AS t", "t * star"),
    ("SELECT * RENAME (a AS z) FROM t_#", "t * star"),
    ("SELECT ARRAY(SELECT i.b FROM u_# AS i WHERE i.k = t_#.k) AS x FROM t_#", "u b select, u k filter, t k filter"),
    ("SELECT DISTINCT ON (k) a FROM t_# ORDER BY k, o", "t a select, t k dedup_key, t k sort, t o sort"),
    ("UPDATE d.t_# SET d.t_#.a = 1 WHERE b = 2", "t a transform, t b filter"),
    ("SELECT 1 AS one FROM t_#, UNNEST(t_#.items) AS i WHERE i > 0", "t items transform, t items filter"),
    ("SELECT SUM(a) OVER (PARTITION BY k ORDER BY o ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS s FROM t_#", "t a transform, t k dedup_key, t o ranking"),
    ("SELECT r.a FROM t_#(TABLE u_#, 3) AS r", "t a select"),
    ("TRUNCATE TABLE t_#;\nSELECT a FROM u_#", "u a select"),
    ("SELECT b FROM t_# WHERE d = CURRENT_DATE", "t b select, t d filter, t CURRENT_DATE filter"),
    ("SELECT a FROM t_# WHERE EXISTS (SELECT 1 FROM u_# WHERE u_#.k = t_#.k)", "t a select, u k filter, t k filter"),
]


def reader_uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    repo = _repo(spark, sf_dir, [(f"q{v}/s_#.sql", sql) for v, (sql, _) in enumerate(USES)])
    own = F.regexp_extract("table", r"^(?:d\.)?([a-z]+)_(\d+)$", 2).cast("bigint") == _key()
    told = repo.tables.uses.where(own).select(F.regexp_extract("file", r"^q(\d+)/", 1).cast("int").alias("variant"), F.regexp_extract("table", r"([a-z])_\d+$", 1).alias("letter"), "column", "kind", "file").distinct()
    return told.groupBy("variant", "letter", "column", "kind").agg(F.count("*").alias("files"))


USES_SQL = f"""
WITH said(variant, letter, "column", kind) AS ({_values([(v, *use.split()) for v, (_, uses) in enumerate(USES) for use in uses.split(', ')])})
SELECT variant, letter, "column", kind, count(*) AS files FROM said JOIN supplier ON s_suppkey % {len(USES)} = variant GROUP BY ALL
"""

#: A statement that builds x_#, and the (table's letter, column, column of x) of what goes on.
FLOWS: list[tuple[str, str]] = [
    ("CREATE TABLE x_# AS SELECT a, UPPER(b) AS c FROM t_#", "t a a, t b c"),
    ("INSERT INTO x_# (p, q) SELECT a, b FROM t_#", "t a p, t b q"),
    ("CREATE VIEW x_# AS WITH w AS (SELECT a AS m FROM t_#) SELECT m AS n FROM w", "t a n"),
    ("CREATE TABLE x_# AS SELECT a AS k FROM t_# UNION ALL SELECT b FROM u_#", "t a k, u b k"),
    ("MERGE x_# USING u_# ON x_#.k = u_#.k WHEN NOT MATCHED THEN INSERT (k, v) VALUES (u_#.k, u_#.w)", "u k k, u w v"),
    ("UPDATE x_# SET v = u_#.w FROM u_# WHERE x_#.k = u_#.k", "u w v"),
    ("CREATE TABLE x_# AS SELECT CASE WHEN a > 0 THEN b END AS c FROM t_#", "t a c, t b c"),
    ("CREATE TABLE x_# AS SELECT s.a AS c FROM t_# s JOIN u_# USING (k)", "t a c"),
    ("CREATE TABLE x_# AS SELECT STRUCT(a AS p, b AS q) AS c FROM t_#", "t a c.p, t b c.q, t a c, t b c"),
    ("CREATE TABLE x_# AS SELECT MAX(a) OVER (PARTITION BY k) AS c FROM t_#", "t a c"),
    ("CREATE TABLE x_# AS SELECT s.p AS c FROM (SELECT STRUCT(a AS p, b AS q) AS s FROM t_#)", "t a c"),
    ("CREATE TABLE x_# AS SELECT s.* FROM (SELECT STRUCT(a AS p, b AS q) AS s FROM t_#)", "t a p, t b q"),
    ("CREATE TABLE x_# AS SELECT s.m.n.o AS c FROM (SELECT STRUCT(STRUCT(STRUCT(a AS o, b AS w) AS n) AS m) AS s FROM t_#)", "t a c"),
    ("CREATE TABLE x_# AS SELECT s.m.* FROM (SELECT STRUCT(b AS q, STRUCT(a AS o) AS m) AS s FROM t_#)", "t a o"),
    ("CREATE TABLE x_# AS SELECT AS VALUE STRUCT(a AS p, b AS q) FROM t_#", "t a p, t b q"),
    ("CREATE TABLE x_# AS SELECT s_x1 AS c FROM t_# PIVOT (SUM(v) AS s FOR m IN ('x' AS x1, 'y'))", "t v c, t m c"),
    ("CREATE TABLE x_# AS SELECT x AS c FROM t_# PIVOT (SUM(v) FOR m IN ('x', 'y'))", "t v c, t m c"),
    ("CREATE TABLE x_# AS SELECT v AS c FROM t_# UNPIVOT (v FOR m IN (jan, feb))", "t jan c, t feb c"),
    ("CREATE TABLE x_# AS SELECT r.* EXCEPT (z) FROM (SELECT ANY_VALUE(w) AS r FROM t_# AS w GROUP BY k)", "t * *"),
    ("CREATE TABLE x_# AS SELECT a, b FROM t_# UNION ALL BY NAME SELECT c AS b, d AS a FROM u_#", "t a a, t b b, u d a, u c b"),
    ("CREATE TABLE x_# AS SELECT ARRAY(SELECT i.b FROM u_# AS i) AS c FROM t_#", "u b c"),
    ("CREATE TABLE x_# AS FROM t_# |> SET b = a + 1 |> SELECT b AS c", "t a c"),
]


def reader_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    repo = _repo(spark, sf_dir, [(f"q{v}/s_#.sql", sql) for v, (sql, _) in enumerate(FLOWS)])
    mine = (F.col("target") == F.concat(F.lit("x_"), _key().cast("string"))) & (F.regexp_extract("table", r"_(\d+)$", 1).cast("bigint") == _key())
    told = repo.tables.flows.where(mine).where("how <> 'carried'")
    told = told.select(F.regexp_extract("file", r"^q(\d+)/", 1).cast("int").alias("variant"), F.substring("table", 1, 1).alias("letter"), "column", "out", "file").where("letter <> 'x'").distinct()
    return told.groupBy("variant", "letter", "column", "out").agg(F.count("*").alias("files"))


FLOWS_SQL = f"""
WITH said(variant, letter, "column", out) AS ({_values([(v, *flow.split()) for v, (_, flows) in enumerate(FLOWS) for flow in flows.split(', ')])})
SELECT variant, letter, "column", out, count(*) AS files FROM said JOIN supplier ON s_suppkey % {len(FLOWS)} = variant GROUP BY ALL
"""

# --- programs, scripts and markup ---------------------------------------------------------

_Q = "SELECT c_# AS d\nFROM raw.t_#\nWHERE c_# > 0"
#: A file that holds one query, and the 1-based line that the query starts on.
HOLDERS: list[tuple[str, str, int]] = [
    ("a_#.py", 'x = 1\nq = """\n' + _Q + '\n"""\n', 3),
    ("a_#.py", 'q = ("SELECT c_# AS d "\n     "FROM raw.t_# WHERE c_# > 0")\n', 1),
    ("a_#.py", '# a note\nsql = "SELECT c_# AS d "\nsql += "FROM raw.t_#"\nrun(sql)\n', 2),
    ("a_#.sh", "set -e\nbq query <<EOF\n" + _Q + "\nEOF\n", 3),
    ("a_#.sh", "# don't stop\npsql -c 'SELECT c_# AS d FROM raw.t_#'\n", 2),
    ("a_#.sh", "impala-shell -q \\\n  \"" + _Q + '"\n', 2),
    ("a_#.yaml", "steps:\n  - name: x\n    sql: |\n      SELECT c_# AS d\n      FROM raw.t_#\n    after: y\n", 4),
    ("a_#.yml", 'query: "SELECT c_# AS d FROM raw.t_#"\n', 1),
    ("a_#.xml", "<a>\n<statement><![CDATA[SELECT c_# AS d FROM raw.t_# WHERE c_# > 0]]></statement>\n</a>\n", 2),
    ("a_#.xml", "<a>\n\n<command>SELECT c_# AS d FROM raw.t_# WHERE c_# &gt; 0</command>\n</a>\n", 3),
    ("A_#.java", 'class A {\n  String q = "SELECT c_# AS d FROM raw.t_# WHERE c_# > 0";\n}\n', 2),
    ("A_#.scala", 'object A {\n  val q = """' + _Q + '"""\n}\n', 2),
    ("a_#.sql", "-- a note\n" + _Q + ";\n", 2),
    ("a_#.sql.j2", _Q + "\n", 1),
]


def held_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _repo(spark, sf_dir, [(f, x) for f, x, _ in HOLDERS]).tables
    told = t.statements.select("stmt", "file", (F.col("line") + 1).cast("bigint").alias("line")).join(t.uses.where("kind = 'select'").select("stmt", "table", "column"), "stmt")
    return told.select("file", "line", "table", "column")


HELD_SQL = f"""
WITH v(variant, file, line) AS ({_values([(k, f, n) for k, (f, _, n) in enumerate(HOLDERS)])})
SELECT replace(file, '#', s_suppkey::VARCHAR) AS "file", line::BIGINT AS line, 'raw.t_' || s_suppkey AS "table", 'c_' || s_suppkey AS "column" FROM v JOIN supplier ON s_suppkey % {len(HOLDERS)} = variant
"""

#: A program, the table it writes (nothing: none), whether more SQL is written in it than could be taken.
WRITERS: list[tuple[str, str, str, bool]] = [
    ("w_#.py", 'q = """' + _Q + '"""\nspark.sql(q).write.saveAsTable("mart.o_#")\n', "o_#", False),
    ("w_#.py", 'q = """' + _Q + '"""\njob(q, destination="p.d.o_#")\n', "o_#", False),
    ("w_#.py", 'q = """' + _Q + '"""\ndf.to_gbq("d.o_#")\n', "o_#", False),
    ("w_#.py", 'q = """' + _Q + '"""\nc = {"destinationTable": {"projectId": "p", "tableId": "o_#"}}\n', "o_#", False),
    ("w_#.sh", "bq query --destination_table=d.o_# <<EOF\n" + _Q + "\nEOF\n", "o_#", False),
    ("w_#.py", 'q = """' + _Q + '"""\nprint(q)\n', "", False),
    ("w_#.py", 'q = "SELECT " + columns + " FROM " + table\n', "", True),
    ("w_#.py", 'q = """' + _Q + '"""\na.saveAsTable("o_#")\nb.saveAsTable("p_#")\n', "", False),
]


def written_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _repo(spark, sf_dir, [(f, x) for f, x, _, _ in WRITERS]).tables
    target = t.statements.groupBy("file").agg(F.max("target").alias("target"))
    return t.files.select("file").join(target, "file", "left").join(t.problems_by_file().select("file", "places"), "file", "left").select(
        "file", F.coalesce("target", F.lit("")).alias("target"), F.coalesce("places", F.lit(0)).alias("problems")
    )


WRITTEN_SQL = f"""
WITH v(variant, file, target, gap) AS ({_values([(k, f, t, g) for k, (f, _, t, g) in enumerate(WRITERS)])})
SELECT replace(file, '#', s_suppkey::VARCHAR) AS "file", replace(target, '#', s_suppkey::VARCHAR) AS target, gap::BIGINT AS problems FROM v JOIN supplier ON s_suppkey % {len(WRITERS)} = variant
"""


def sql_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Programs that run SQL files: by path, by last part, and missing."""
    repo = _repo(spark, sf_dir, [("jobs/r_#.py", 'run("sql/x_#.sql")\n'), ("jobs/r_#.py", 'run("../there/x_#.sql.j2")\n'), ("jobs/r_#.yaml", "path: gone/x_#.sql\n")],
                 [("lib/sql/x_#.sql", "SELECT 1"), ("other/x_#.sql.j2", "SELECT 1"), ("other/y_#.sql", "SELECT 1")])
    found, missing = repo.sql_files()
    return found.select("file", "run", "by").unionByName(missing.select("file", F.lit("").alias("run"), F.lit("missing").alias("by")))


REFERENCES_SQL = """
SELECT 'jobs/r_' || s_suppkey || CASE s_suppkey % 3 WHEN 2 THEN '.yaml' ELSE '.py' END AS "file",
  CASE s_suppkey % 3 WHEN 0 THEN 'lib/sql/x_' || s_suppkey || '.sql' WHEN 1 THEN 'other/x_' || s_suppkey || '.sql.j2' ELSE '' END AS run, ['path', 'name', 'missing'][(s_suppkey % 3 + 1)::INT] AS "by" FROM supplier
"""

# --- rewrites -----------------------------------------------------------------------------

#: A templated or scripted text, and the tables that it reads.
REWRITES: list[tuple[str, str]] = [
    ("CREATE TABLE x_# AS SELECT a FROM {{ ref('t_#') }}", "t_#"),
    ("{{ config(materialized='table') }}\nSELECT a FROM {{ source('raw', 't_#') }}", "t_#"),
    ("CREATE TABLE x_# AS SELECT a FROM ${env}.t_#", "env.t_#"),
    ("CREATE TABLE x_# AS SELECT a FROM {dataset}.t_#", "dataset.t_#"),
    ("SELECT a FROM {% if x %} t_# {% else %} u_# {% endif %}", "t_#, u_#"),
    ("SELECT a FROM {% if x %} t_# {% elif y %} u_# {% elif z %} v_# {% endif %} WHERE b = 1", "t_#, u_#, v_#"),
    ("CREATE SNAPSHOT TABLE x_# CLONE t_#", "t_#"),
    ("CREATE TABLE x_# COPY t_#", "t_#"),
    ("CREATE PROCEDURE p_#()\nBEGIN\n  IF a > 1 THEN\n    INSERT INTO x_# SELECT a FROM t_#;\n  END IF;\nEND", "t_#"),
    ("EXECUTE IMMEDIATE 'INSERT INTO x_# SELECT a FROM t_#'", "t_#"),
    ('config {\n  type: "table"\n}\nSELECT a FROM ${ref("t_#")}', "t_#"),
    ("EXPORT DATA OPTIONS (uri='gs://b/#/*.csv') AS SELECT a FROM t_#", "t_#"),
    ("SELECT a FROM t_# FOR SYSTEM_TIME AS OF ts WHERE b = 1", "t_#"),
    ("{% set c = ['a', 'b'] %}\nSELECT {% for x in c %}{{ x }}, {% endfor %} d FROM t_#", "t_#"),
    ("BEGIN TRANSACTION;\nINSERT INTO x_# SELECT a FROM t_#;\nCOMMIT TRANSACTION;", "t_#"),
    ("BEGIN;\nINSERT INTO x_# SELECT a FROM t_#;\nCOMMIT;", "t_#"),
    ("START TRANSACTION;\nINSERT INTO x_# SELECT a FROM t_#;\nROLLBACK;", "t_#"),
    ("BEGIN\n  BEGIN\n    IF EXISTS (SELECT 1 FROM u_#) THEN\n      CASE WHEN y = 1 THEN INSERT INTO x_# SELECT CASE WHEN a THEN b END FROM t_#; END CASE;\n    ELSE\n      RAISE USING MESSAGE = 'no';\n    END IF;\n  END;\nEXCEPTION WHEN ERROR THEN\n  RAISE;\nEND", "t_#, u_#"),
    ("lab: LOOP\n  SET i = i + 1;\n  IF i > 3 THEN LEAVE lab; END IF;\nEND LOOP lab;\nREPEAT INSERT INTO x_# SELECT a FROM t_#; UNTIL i > 9 END REPEAT;", "t_#"),
    ("SELECT ';' AS x, a FROM t_#; -- b; c\nSELECT b FROM u_# /* ; */;", "t_#, u_#"),
]


def rewritten_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _repo(spark, sf_dir, [(f"q{v}/s_#.sql", sql) for v, (sql, _) in enumerate(REWRITES)]).tables
    told = t.statements.select("file", F.explode("sources").alias("table")).where("not startswith(table, '#')").distinct()
    problems = t.problems_by_file().select("file", "places")
    return told.join(problems, "file", "left").select("file", "table", F.coalesce("places", F.lit(0)).alias("problems"))


REWRITTEN_SQL = f"""
WITH said(variant, "table") AS ({_values([(v, x) for v, (_, tables) in enumerate(REWRITES) for x in tables.split(', ')])})
SELECT 'q' || variant || '/s_' || s_suppkey || '.sql' AS "file", replace("table", '#', s_suppkey::VARCHAR) AS "table", 0::BIGINT AS problems FROM said JOIN supplier ON s_suppkey % {len(REWRITES)} = variant
"""


def template_arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files with several if-blocks one after the other, and one statement that never reads: no arm and no failure is lost."""
    n = 5
    blocks = ["\n".join(f"SELECT a FROM {{% if c{k} %}} yes{k}_# {{% else %}} no{k}_# {{% endif %}};" for k in range(m)) for m in range(1, n + 1)]
    t = _repo(spark, sf_dir, [(f"q{m}/s_#.sql", b + "\nSELECT FROM WHERE;") for m, b in enumerate(blocks, 1)]).tables
    read_ = t.statements.select("file", F.explode("sources").alias("table")).groupBy("file").agg(F.count_distinct("table").alias("tables"))
    return read_.join(t.problems_by_file().select("file", "places"), "file", "left").select("file", "tables", F.coalesce("places", F.lit(0)).alias("problems"))


ARMS_SQL = """SELECT 'q' || (s_suppkey % 5 + 1) || '/s_' || s_suppkey || '.sql' AS "file", 2 * (s_suppkey % 5 + 1) AS tables, 1::BIGINT AS problems FROM supplier"""


def script_variables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variables of scripts carry a column on, past any length of statement; temporary tables are their file's own."""
    long = ", ".join(f"c{k} AS d{k}" for k in range(900))
    repo = _repo(spark, sf_dir, [
        ("v_#.sql", "DECLARE top DEFAULT (SELECT MAX(b) FROM raw.src_#);\nCREATE TABLE v_# AS SELECT " + long + " FROM raw.other_# WHERE d > top"),
        ("v_#.sql", "CREATE TEMP TABLE hold AS SELECT b FROM raw.src_#;\nCREATE TABLE v_# AS SELECT b FROM hold"),
        ("v_#.sql", "FOR one IN (SELECT b FROM raw.src_#)\nDO\n  INSERT INTO v_# (z) SELECT one.b FROM one;\nEND FOR;"),
    ], [("w_#.sql", "CREATE TABLE w_# AS SELECT b FROM hold"), ("w_#.sql", "CALL p_#();\nCREATE TABLE w_# AS SELECT b FROM kept"), ("w_#.sql", "CREATE TABLE w_# AS SELECT b FROM kept")],
       [("p_#.sql", "SELECT 1"), ("p_#.sql", "CREATE PROCEDURE p_#()\nBEGIN\n  CREATE TEMP TABLE kept AS SELECT b FROM raw.src_#;\nEND"), ("p_#.sql", "SELECT 1")])
    start = read(spark, sf_dir, "supplier").select(F.concat(F.lit("raw.src_"), "s_suppkey").alias("table"), F.lit("b").alias("column"))
    nodes, _, _ = lineage.walk_columns(repo.tables.flows, lineage.column_start(start), repo.catalog)
    return nodes.where("not startswith(at_table, '#') and hop > 0").select("root", F.col("at_table").alias("table")).distinct()


VARIABLES_SQL = """
SELECT 'raw.src_' || s_suppkey || '.b' AS root, 'v_' || s_suppkey AS "table" FROM supplier
UNION ALL SELECT 'raw.src_' || s_suppkey || '.b', 'w_' || s_suppkey FROM supplier WHERE s_suppkey % 3 = 1
"""

# --- joins and walks ----------------------------------------------------------------------

#: A condition on the shards that a statement reads, and what it says of the shard 20260105.
SHARDS: list[tuple[str, str]] = [
    ("_TABLE_SUFFIX = '20260105'", "reads"), ("_TABLE_SUFFIX >= '20260101' AND b > 1", "reads"), ("_TABLE_SUFFIX BETWEEN '20260106' AND '20260109'", "excluded"), ("_TABLE_SUFFIX IN ('20260101', '20260102')", "excluded"),
    ("_TABLE_SUFFIX <> '20260105'", "excluded"), ("_TABLE_SUFFIX > day", "maybe"), ("_TABLE_SUFFIX = '20250101' OR b = 1", "maybe"), ("'20260105' = _TABLE_SUFFIX", "maybe"), ("b = 1", "reads"),
]


def shard_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements that read a shard through a pattern, by what their literals say of it."""
    repo = _repo(spark, sf_dir, [("s_#.sql", f"CREATE TABLE out_# AS SELECT a FROM `d.e#_*` WHERE {c}") for c, _ in SHARDS])
    start = read(spark, sf_dir, "supplier").select(F.concat(F.lit("d.e"), "s_suppkey", F.lit("_20260105")).alias("table"), F.lit("a").alias("column"))
    nodes, _, _ = lineage.walk_columns(repo.tables.flows, lineage.column_start(start), repo.catalog)
    found = lineage.findings(nodes, repo.tables.uses, repo.tables.statements, "removal")
    return found.where("kind = 'select'").select("file", "target", "certain", F.col("hop").cast("bigint").alias("hop"))


SHARD_WALK_SQL = f"""
WITH v(variant, verdict) AS ({_values([(k, v) for k, (_, v) in enumerate(SHARDS)])})
SELECT 's_' || s_suppkey || '.sql' AS "file", 'out_' || s_suppkey AS target, verdict = 'reads' AS certain, 0::BIGINT AS hop FROM v JOIN supplier ON s_suppkey % {len(SHARDS)} = variant WHERE verdict <> 'excluded'
"""

DEPTH = 33


def star_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views that take all columns of the view before them, deeper than any fixed number of rounds."""
    n = read(spark, sf_dir, "nation").select("n_nationkey", F.explode(F.sequence(F.lit(1), F.lit(DEPTH))).alias("d")).where("n_nationkey < 3")
    sql = F.concat(F.lit("CREATE VIEW c"), "n_nationkey", F.lit("_"), "d", F.lit(" AS SELECT * FROM c"), "n_nationkey", F.lit("_"), F.col("d") - 1)
    first = read(spark, sf_dir, "nation").where("n_nationkey < 3").select(F.concat(F.lit("ddl/"), "n_nationkey", F.lit(".sql")).alias("file"), F.concat(F.lit("CREATE TABLE c"), "n_nationkey", F.lit("_0 (k INT64, v STRING)")).alias("text"))
    texts = n.select(F.concat(F.lit("v/"), "n_nationkey", F.lit("_"), "d", F.lit(".sql")).alias("file"), sql.alias("text")).unionByName(first)
    c = Engine(spark).read_all(source.from_rows(texts)).catalog
    return c.groupBy("column", F.col("pos").cast("bigint").alias("pos"), "derived").agg(F.count("*").alias("tables"))


STAR_CHAIN_SQL = f"""
SELECT "column", pos::BIGINT AS pos, derived, (CASE WHEN derived THEN {DEPTH} ELSE 1 END * (SELECT count(*) FROM nation WHERE n_nationkey < 3))::BIGINT AS tables
FROM (VALUES ('k', 0), ('v', 1)) c("column", pos), (VALUES (true), (false)) d(derived)
"""


def name_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that stand for several tables or are spelled in several ways, and tables built in several files."""
    repo = _repo(spark, sf_dir, [("a_#.sql", "CREATE TABLE one.t_# AS SELECT a FROM raw.s_#"), ("a_#.sql", "CREATE TABLE one.T_# AS SELECT a FROM raw.s_#"), ("a_#.sql", "CREATE TABLE one.t_# AS SELECT a FROM raw.s_#")],
                 [("b_#.sql", "CREATE TABLE two.t_# AS SELECT a FROM raw.s_#"), ("b_#.sql", "SELECT a FROM one.t_#"), ("b_#.sql", "SELECT a FROM t_#")])
    told = catalog.ambiguous(repo.tables).where("startswith(key, 'T_')").join(catalog.rebuilt(repo.tables), "key", "left")
    return told.select("key", F.array_join("datasets", ",").alias("datasets"), F.size("spellings").cast("bigint").alias("spellings"), "ambiguous", F.coalesce(F.size("files"), F.lit(0)).cast("bigint").alias("built_in"))


NAME_REPORT_SQL = """
SELECT 'T_' || s_suppkey AS key, CASE s_suppkey % 3 WHEN 0 THEN 'ONE,TWO' ELSE 'ONE' END AS datasets, CASE s_suppkey % 3 WHEN 1 THEN 2 ELSE 1 END::BIGINT AS spellings,
  s_suppkey % 3 <> 1 AS ambiguous, CASE s_suppkey % 3 WHEN 0 THEN 2 ELSE 0 END::BIGINT AS built_in FROM supplier
"""

# --- what stays out of sight ---------------------------------------------------------------

#: A file, and how it names the column area_code of raw.people: by which part of an answer it is listed.
SIGHT: list[tuple[str, str, str]] = [
    ("h_#.sql", "CREATE TABLE o_# AS SELECT area_code FROM raw.people", "found"),
    ("h_#.sql", "SELECT tag('area_code') AS x FROM raw.elsewhere_#", "hidden"),
    ("h_#.sql", "SELECT column_name FROM d.INFORMATION_SCHEMA.COLUMNS WHERE column_name = 'area_code'", "hidden"),
    ("h_#.sql", "CALL d.fill_#('x');\nCREATE TABLE o_# AS SELECT a FROM raw.b_#", ""),
    ("h_#.sql", "CREATE SEARCH INDEX i_# ON raw.people (area_code)", "referenced"),
    ("h_#.py", "# area_code is only spoken of\nx = 1\n", "mentioned"),
    ("h_#.sql", "SELECT a FROM raw.other_#", ""),
]


def out_of_sight(spark: SparkSession, sf_dir: str) -> DataFrame:
    repo = _repo(spark, sf_dir, [(f, x) for f, x, _ in SIGHT])
    s = repo.scan([Ask("raw.people", ["area_code"])], published.parse_rule("o_*"), "removal")
    parts = {"found": s.findings, "hidden": s.hidden, "referenced": s.references, "mentioned": s.mentions.join(s.hidden, "file", "left_anti").join(s.references, "file", "left_anti")}
    out = None
    for what, df in parts.items():
        part = df.select("file").distinct().withColumn("what", F.lit(what))
        out = part if out is None else out.unionByName(part)
    return out


SIGHT_SQL = f"""
WITH v(variant, file, what) AS ({_values([(k, f, w) for k, (f, _, w) in enumerate(SIGHT)])})
SELECT replace(file, '#', s_suppkey::VARCHAR) AS "file", what FROM v JOIN supplier ON s_suppkey % {len(SIGHT)} = variant WHERE what <> ''
"""


def name_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a name is written in quotes, and on how many lines."""
    k = F.col("s_suppkey")
    body = F.concat(F.lit("-- tag\n"), F.array_join(F.transform(F.sequence(F.lit(1), (k % 7 + 1).cast("int")), lambda i: F.concat(F.lit("x = get('tag', "), i.cast("string"), F.lit(")"))), "\n"))
    files = read(spark, sf_dir, "supplier").select(F.concat(F.lit("p_"), k, F.lit(".py")).alias("file"), F.when(k % 4 == 0, F.lit("-- tag\nx")).otherwise(body).alias("text"))
    from waymark.engine import places

    found = places(files, files.select("file", F.lit("tag").alias("name")))
    return found.select("file", F.col("line").cast("bigint").alias("line"), "places")


PLACES_SQL = """SELECT 'p_' || s_suppkey || '.py' AS "file", CASE WHEN s_suppkey % 4 = 0 THEN 1 ELSE 2 END::BIGINT AS line, CASE WHEN s_suppkey % 4 = 0 THEN 1 ELSE s_suppkey % 7 + 1 END::BIGINT AS places FROM supplier"""


def attribute_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a column asked about: found, mentioned, unknown."""
    repo = _repo(spark, sf_dir, [("a_#.sql", "CREATE TABLE o_# AS SELECT seen FROM raw.people"), ("a_#.sql", "CREATE TABLE o_# AS SELECT spoken, seen FROM raw.people"), ("a_#.py", "# spoken\n")],
                 [("ddl/people_#.sql", "CREATE TABLE raw.people (seen INT64, spoken INT64)")])
    s = repo.scan([Ask("raw.people", ["seen", "spoken", "nowhere"])], published.parse_rule("zz"), "rename")
    return s.attributes.select(F.regexp_extract("root", r"([^.]*)$", 1).alias("column"), "found", F.col("findings").cast("bigint").alias("findings"), F.col("mentioned_in").cast("bigint").alias("mentioned_in"), "lookup_failed", F.array_join("table_columns", ",").alias("table_columns"))


ATTRIBUTES_SQL = """
WITH n AS (SELECT count(*) AS total, count(*) FILTER (s_suppkey % 3 = 0) AS a, count(*) FILTER (s_suppkey % 3 = 1) AS b, count(*) FILTER (s_suppkey % 3 = 2) AS c FROM supplier)
SELECT 'seen' AS "column", a + b > 0 AS found, a + b AS findings, total + a + b AS mentioned_in, false AS lookup_failed, '' AS table_columns FROM n
UNION ALL SELECT 'spoken', b > 0, b, total + b + c, false, '' FROM n UNION ALL SELECT 'nowhere', false, 0, 0, true, 'seen,spoken' FROM n
"""


def exported_feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deliveries out of the warehouse, and published tables that stop loading without losing a column."""
    repo = _repo(spark, sf_dir, [("a_#.sql", "CREATE TABLE mid_# AS SELECT id, v FROM raw.src WHERE flag = 1")],
                 [("b_#.sql", "EXPORT DATA OPTIONS (uri='gs://out/#/*.csv') AS SELECT id FROM raw.src WHERE flag = 2"), ("b_#.sql", "CREATE TABLE out_#_pub AS SELECT id FROM mid_#")])
    s = repo.scan([Ask("raw.src", ["flag"])], published.parse_rule("_PUB"), "removal")
    # a filter's column is carried under its name, so the tables it filters are on the trail and their users aren't
    return s.feeds.select("uri", "breaking").unionByName(s.stops.select(F.col("table").alias("uri"), F.lit(True).alias("breaking")))


FEEDS_SQL = """
SELECT CASE s_suppkey % 2 WHEN 0 THEN 'gs://out/' || s_suppkey ELSE 'out_' || s_suppkey || '_pub' END AS uri, true AS breaking FROM supplier
"""


def branch_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths as a tree, their common beginnings once."""
    c = read(spark, sf_dir, "customer").select(F.lit("r").alias("root"), F.array(F.col("c_nationkey").cast("string"), "c_mktsegment", F.col("c_custkey").cast("string")).alias("path"))
    tree = lineage.tree_of(c)
    return tree.groupBy(F.col("depth").cast("bigint").alias("depth"), "leaf").agg(F.count("*").alias("nodes"), F.count_distinct("parent").alias("parents"))


TREE_SQL = """
SELECT 0::BIGINT AS depth, false AS leaf, count(DISTINCT c_nationkey) AS nodes, 1::BIGINT AS parents FROM customer
UNION ALL SELECT 1, false, count(DISTINCT c_nationkey || '/' || c_mktsegment), count(DISTINCT c_nationkey) FROM customer
UNION ALL SELECT 2, true, count(DISTINCT c_nationkey || '/' || c_mktsegment || '/' || c_custkey), count(DISTINCT c_nationkey || '/' || c_mktsegment) FROM customer
"""

# --- files ----------------------------------------------------------------------------------

#: How a text is written, and whether it is read (as utf-8, utf-16 and so on) or why not.
ENCODINGS = [("utf-8", ""), ("utf-8-sig", ""), ("utf-16", ""), ("utf-16-le", ""), ("utf-16-be", ""), ("utf-32", ""), ("latin-1", ""), ("nul", "not_text")]


def decoded_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "SELECT 'é' AS name, a FROM t"
    raw = [said.encode(e) if e != "nul" else b"SELECT \0 a FROM t" for e, _ in ENCODINGS]
    k = F.col("s_suppkey")
    rows = read(spark, sf_dir, "supplier").select(F.concat(F.lit("f_"), k, F.lit(".sql")).alias("path"), F.element_at(F.array(*(F.lit(bytearray(x)) for x in raw)), (k % len(raw) + 1).cast("int")).alias("content"))
    tree = source.from_contents(rows.withColumn("length", F.octet_length("content").cast("bigint")))
    return tree.files.select("file", (F.col("text") == said).alias("same"), F.lit("").alias("why")).unionByName(tree.unread.select("file", F.lit(False).alias("same"), F.col("kind").alias("why")))


DECODED_SQL = f"""SELECT 'f_' || s_suppkey || '.sql' AS "file", s_suppkey % {len(ENCODINGS)} <> {len(ENCODINGS) - 1} AS same, CASE WHEN s_suppkey % {len(ENCODINGS)} = {len(ENCODINGS) - 1} THEN 'not_text' ELSE '' END AS why FROM supplier"""

#: A path, and how it is taken.
PATHS = [
    ("a/b_#.sql", "read"), ("a/b_#.sql.j2", "read"), ("a/b_#.PY", "read"), ("node_modules/b_#.sql", "skipped_folder"), ("dist/b_#.txt", "ignored"), ("a/b_#.ipynb", "unknown_type"),
    ("a/b_#.md", "not_code"), ("a/b_#.sql.bak", "not_code"), ("a/b_#", "not_code"), ("a/big_#.sql", "too_long"),
]


def folder_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    path = F.replace(F.element_at(F.array(*(F.lit(p) for p, _ in PATHS)), (k % len(PATHS) + 1).cast("int")), F.lit("#"), k.cast("string"))
    rows = read(spark, sf_dir, "supplier").select(F.concat(F.lit("file:/root/build/repo/"), path).alias("path"), F.when(path.contains("big"), 2_000_001).otherwise(8).cast("bigint").alias("length"), F.encode(F.lit("SELECT 1"), "UTF-8").alias("content"))
    return Engine(spark).read_all(source.from_contents(rows, "/root/build/repo")).summary()


SUMMARY_SQL = f"""
WITH v(variant, path, what) AS ({_values([(k, p, w) for k, (p, w) in enumerate(PATHS)])})
SELECT what, CASE WHEN path LIKE '%.sql.j2' THEN '.sql' WHEN path LIKE '%.%' THEN lower(regexp_extract(path, '(\\.[^.]+)$', 1)) ELSE '' END AS ext, count(*) AS files FROM v JOIN supplier ON s_suppkey % {len(PATHS)} = variant GROUP BY ALL
"""

# --- notices ----------------------------------------------------------------------------------

#: A notice, the kind of change, whether the whole table changes, the columns it names.
NOTICES = [
    ("The table t_# will be dropped on 18 September 2026.", "removal", True, ""),
    ("Column area_code of t_# will change its format on 2026-10-02.", "value_change", False, "area_code"),
    ("We are renaming the table t_#.", "rename", True, ""),
    ("The data type of t_#.id is widened from November 5, 2026 on.", "type_change", False, "id"),
    ("t_# and its id, area_code: the entire table goes. Decommission by 2027-01-31", "removal", True, "area_code,id"),
    ("Nothing about any of it.", "unknown", False, ""),
]
_DATES = ["2026-09-18", "2026-10-02", "", "2026-11-05", "2027-01-31", ""]


def notice_asks(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = read(spark, sf_dir, "supplier").select(F.concat(F.lit("raw.t_"), "s_suppkey").alias("table"), F.concat(F.lit("T_"), "s_suppkey").alias("key"), F.explode(F.array(F.lit("id"), F.lit("area_code"))).alias("column"))
    told = notices.extract(_texts(spark, sf_dir, [("n_#", t) for t, *_ in NOTICES]).select("file", F.lit("").alias("subject"), F.col("text").alias("body")), known)
    ask = F.get("asks", F.lit(0))
    return told.select("file", "change", "effective", F.coalesce(ask["table"], F.lit("")).alias("table"), F.coalesce(ask["whole"], F.lit(False)).alias("whole"), F.coalesce(F.array_join(ask["columns"], ","), F.lit("")).alias("columns"))


NOTICES_SQL = f"""
WITH v(variant, change, effective, whole, columns) AS ({_values([(k, c, _DATES[k], w, cs) for k, (_, c, w, cs) in enumerate(NOTICES)])})
SELECT 'n_' || s_suppkey AS "file", change, effective, CASE WHEN variant = 5 THEN '' ELSE 'raw.t_' || s_suppkey END AS "table", whole, columns FROM v JOIN supplier ON s_suppkey % {len(NOTICES)} = variant
"""


def mail_senders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mails read on the driver's side of the reader: who wrote, when, and which team."""
    n = read(spark, sf_dir, "nation").select("n_nationkey", "n_name").orderBy("n_nationkey").collect()
    rows = []
    for r in n:
        raw = f"From: Ana {r['n_name'].title()} <ana@sys{r['n_nationkey']}.example>\nSubject: Change {r['n_nationkey']}\nDate: Tue, 01 Sep 2026 10:00:00 +0000\n\nThe table changes.\n\nRegards,\nAna\nMaster Data Team\n"
        got = notices.enrich(notices.read_upload("a.eml" if r["n_nationkey"] % 2 else "pasted.txt", raw.encode()))
        rows.append((r["n_nationkey"], got["subject"], got["from_email"], got["team"], got["source_kind"]))
    return spark.createDataFrame(rows, "n_nationkey bigint, subject string, sender string, team string, kind string")


MAIL_SQL = "SELECT n_nationkey, 'Change ' || n_nationkey AS subject, 'ana@sys' || n_nationkey || '.example' AS sender, 'Master Data Team' AS team, CASE WHEN n_nationkey % 2 = 1 THEN 'eml' ELSE 'pasted' END AS kind FROM nation"


def whole_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = ["# will be retired", "we are migrating the table #", "removal of #", "column x of # changes", "# has news", "the table # is to be archived"]
    rows = _texts(spark, sf_dir, [(f"t_#:{k}", s.replace("#", "t_#")) for k, s in enumerate(said)])
    return rows.select("file", text.whole_table(F.col("text"), F.split("file", ":")[0]).alias("whole"))


WHOLE_TABLES_SQL = """SELECT 't_' || s_suppkey || ':' || (s_suppkey % 6) AS "file", s_suppkey % 6 NOT IN (3, 4) AS whole FROM supplier"""


def list_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pasted list held against known tables, then against the text of files."""
    rule = published.parse_rule("\n".join(f"- mart.t_{k}" for k in range(1, 13)) + "\n- x.T_3\n- t_3\n- !!")
    known = read(spark, sf_dir, "supplier").where("s_suppkey <= 8").select(F.concat(F.lit("mart.t_"), "s_suppkey", F.when(F.col("s_suppkey") % 2 == 0, "_20260101").otherwise("")).alias("table"))
    files = read(spark, sf_dir, "supplier").where("s_suppkey between 9 and 10").select(F.concat(F.lit("f"), "s_suppkey").alias("file"), F.concat(F.lit("see t_"), "s_suppkey").alias("text"))
    told = published.check(rule, known, files).select("key", "found", "how", "mentions")
    return told.withColumn("duplicates", F.lit(len(rule.duplicates)).cast("bigint")).withColumn("same", F.lit(len(rule.same)).cast("bigint")).withColumn("rejected", F.lit(len(rule.rejected)).cast("bigint"))


LIST_SQL = """
SELECT 'T_' || k AS key, k <= 8 AND n > 0 AS found, CASE WHEN k > 8 OR n = 0 THEN '' WHEN k % 2 = 0 THEN 'shard' ELSE 'name' END AS how, CASE WHEN k BETWEEN 9 AND 10 THEN n ELSE 0 END AS mentions,
  2::BIGINT AS duplicates, 2::BIGINT AS same, 1::BIGINT AS rejected
FROM (SELECT k, (SELECT count(*) FROM supplier WHERE s_suppkey = k) AS n FROM range(1, 13) t(k))
"""


def located_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The line that a filter on a column stands on, among lines that only name it, and the lines about it."""
    k = F.col("s_suppkey")
    pad = F.concat(F.array_join(F.array_repeat(F.lit("  a,"), (k % 5 + 1).cast("int")), "\n"), F.lit("\n"))
    body = F.concat(F.lit("SELECT\n"), pad, F.lit("  code\nFROM t\nWHERE code = 1\nORDER BY code"))
    rows = read(spark, sf_dir, "supplier").select(k.alias("key"), body.alias("text"))
    at = usages.locate(F.col("text"), F.lit("code"), F.lit("filter"), F.lit(0), F.size(F.split("text", "\n")) - 1)
    placed = rows.withColumn("at", at)
    return placed.select("key", F.col("at").cast("bigint").alias("line"), F.array_join(F.transform(usages.snippet(F.col("text"), F.col("at"), 1), lambda x: x["text"]), "|").alias("shown"))


LOCATED_SQL = "SELECT s_suppkey AS key, (s_suppkey % 5 + 4)::BIGINT AS line, 'FROM t|WHERE code = 1|ORDER BY code' AS shown FROM supplier"


ALL: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "reader_uses": (reader_uses, USES_SQL), "reader_flows": (reader_flows, FLOWS_SQL), "held_queries": (held_queries, HELD_SQL), "written_tables": (written_tables, WRITTEN_SQL),
    "sql_references": (sql_references, REFERENCES_SQL), "rewritten_sources": (rewritten_sources, REWRITTEN_SQL), "template_arms": (template_arms, ARMS_SQL), "script_variables": (script_variables, VARIABLES_SQL),
    "shard_walk": (shard_walk, SHARD_WALK_SQL), "star_chain": (star_chain, STAR_CHAIN_SQL), "name_report": (name_report, NAME_REPORT_SQL), "out_of_sight": (out_of_sight, SIGHT_SQL), "name_places": (name_places, PLACES_SQL),
    "attribute_report": (attribute_report, ATTRIBUTES_SQL), "exported_feeds": (exported_feeds, FEEDS_SQL), "branch_tree": (branch_tree, TREE_SQL), "decoded_files": (decoded_files, DECODED_SQL),
    "folder_summary": (folder_summary, SUMMARY_SQL), "notice_asks": (notice_asks, NOTICES_SQL), "mail_senders": (mail_senders, MAIL_SQL), "whole_tables": (whole_tables, WHOLE_TABLES_SQL),
    "list_checks": (list_checks, LIST_SQL), "located_lines": (located_lines, LOCATED_SQL),
}
