"""The engine's operators over the driver's tables, each with the SQL that must agree."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.engine import Ask, Engine, Repo, word_hits
from waymark.functions import names, text
from waymark.operators import history, lineage, published, usages
from waymark.sources.files import extension, from_rows

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
#: A warehouse of our own over the driver's tables.
PIPELINE = {
    "staging/orders_clean.sql": "CREATE OR REPLACE TABLE staging.orders_clean AS\nSELECT o.o_orderkey AS order_id, o.o_custkey AS cust_id, o.o_orderdate AS ordered_on, o.o_totalprice\nFROM raw.orders o\nWHERE o.o_orderstatus <> 'X';",
    "staging/lines_clean.sql": "CREATE OR REPLACE TABLE staging.lines_clean AS\nSELECT l_orderkey AS order_id, l_shipdate AS shipped_on,\n  l_extendedprice * (1 - l_discount) AS net\nFROM raw.lineitem\nWHERE l_shipdate IS NOT NULL;",
    "curated/order_facts.sql": "CREATE OR REPLACE TABLE curated.order_facts AS\nWITH last_line AS (\n  SELECT order_id, MAX(shipped_on) AS last_ship, SUM(net) AS revenue\n  FROM staging.lines_clean GROUP BY order_id)\nSELECT o.order_id, o.cust_id, o.ordered_on, x.last_ship, x.revenue\nFROM staging.orders_clean o JOIN last_line x ON x.order_id = o.order_id;",
    "jobs/segments.py": 'SQL = """\nSELECT c.c_mktsegment AS segment, n.n_name AS nation, f.last_ship, f.revenue\nFROM curated.order_facts f\nJOIN raw.customer c ON c.c_custkey = f.cust_id\nJOIN raw.nation n ON n.n_nationkey = c.c_nationkey\n"""\nspark.sql(SQL).write.saveAsTable("segment_sales")\n',
    "publish/segment_sales_pub.sql": "INSERT INTO mart.segment_sales_pub (segment, nation, ship_month, revenue)\nSELECT segment, nation, SUBSTR(last_ship, 1, 7), SUM(revenue)\nFROM segment_sales GROUP BY segment, nation, SUBSTR(last_ship, 1, 7);",
    "publish/late_orders_pub.sql": "CREATE TABLE mart.late_orders_pub AS\nSELECT order_id FROM (\n  SELECT order_id, ROW_NUMBER() OVER (PARTITION BY cust_id ORDER BY last_ship DESC) AS rn FROM curated.order_facts)\nWHERE rn = 1;",
    "views/all_facts.sql": "CREATE VIEW curated.all_facts AS SELECT * EXCEPT (revenue) FROM curated.order_facts;",
}
PUBLISHED = "segment_sales_pub\nlate_orders_pub"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def warehouse(spark: SparkSession, sf_dir: str) -> Repo:
    """The pipeline above, with the tables' own schemas as its catalogue."""
    ddl = {f"ddl/{t}.sql": f"CREATE TABLE raw.{t} ({', '.join(f'{f.name} {f.dataType.simpleString()}' for f in read(spark, sf_dir, t).schema)});" for t in TABLES}
    return Engine(spark).read_texts(ddl | PIPELINE)


def _answer(spark: SparkSession, sf_dir: str, change: str, *asks: Ask):
    return warehouse(spark, sf_dir).scan(list(asks), published.parse_rule(PUBLISHED), change)


def lineage_shipdate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _answer(spark, sf_dir, "removal", Ask("raw.lineitem", ["l_shipdate"])).findings
    return found.select("file", "table", "column", "kind", F.array_join("kinds", ",").alias("kinds"), F.col("hop").cast("bigint").alias("hop"), "certain", "breaking", "no_local_fix", "target")


SHIPDATE_SQL = """
SELECT * FROM (VALUES
 ('staging/lines_clean.sql', 'raw.lineitem', 'l_shipdate', 'filter', 'filter,select', 0, true, true, false, 'staging.lines_clean'),
 ('curated/order_facts.sql', 'staging.lines_clean', 'shipped_on', 'dedup_key', 'dedup_key,select', 1, true, true, true, 'curated.order_facts'),
 ('jobs/segments.py', 'curated.order_facts', 'last_ship', 'select', 'select', 2, true, true, false, 'segment_sales'),
 ('publish/late_orders_pub.sql', 'curated.order_facts', 'last_ship', 'ranking', 'ranking', 2, true, true, true, 'mart.late_orders_pub'),
 ('views/all_facts.sql', 'curated.order_facts', 'last_ship', 'star', 'star', 2, true, false, false, 'curated.all_facts'),
 ('publish/segment_sales_pub.sql', 'segment_sales', 'last_ship', 'transform', 'aggregation,transform', 3, true, true, false, 'mart.segment_sales_pub')
) t("file", "table", "column", kind, kinds, hop, certain, breaking, no_local_fix, target)
"""


def lineage_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _answer(spark, sf_dir, "removal", Ask("raw.lineitem", ["l_shipdate"]))
    return s.groups.select("prod", "matched", "findings", "breaking", F.array_join("through", " ").alias("through"))


#: By the pipeline above: shipped_on, last_ship and ship_month lead to both published tables; the statements on the way to one are those of lineage_shipdate but for the other's own.
GROUPS_SQL = """
WITH on_the_way(prod, "table", "column", breaking) AS (VALUES
 ('mart.segment_sales_pub', 'raw.lineitem', 'l_shipdate', true), ('mart.segment_sales_pub', 'staging.lines_clean', 'shipped_on', true), ('mart.segment_sales_pub', 'curated.order_facts', 'last_ship', true), ('mart.segment_sales_pub', 'segment_sales', 'last_ship', true),
 ('mart.late_orders_pub', 'raw.lineitem', 'l_shipdate', true), ('mart.late_orders_pub', 'staging.lines_clean', 'shipped_on', true), ('mart.late_orders_pub', 'curated.order_facts', 'last_ship', true))
SELECT prod, 'name' AS matched, count(*) AS findings, count(*) FILTER (breaking) AS breaking, string_agg("table" || '.' || "column", ' ' ORDER BY "table" || '.' || "column") AS through FROM on_the_way GROUP BY prod
"""


def lineage_branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _answer(spark, sf_dir, "value_change", Ask("raw.lineitem", ["l_discount"]))
    return s.branches.select(F.array_join("path", " > ").alias("path"), F.col("hops").cast("bigint").alias("hops"))


BRANCHES_SQL = """
SELECT * FROM (VALUES
 ('raw.lineitem.l_discount > staging.lines_clean.net > curated.order_facts.revenue > segment_sales.revenue > mart.segment_sales_pub.revenue', 4)
) t(path, hops)
"""


def lineage_whole_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _answer(spark, sf_dir, "removal", Ask("raw.nation", whole=True))
    return s.findings.select("file", "table", F.col("detail").alias("role"), F.col("hop").cast("bigint").alias("hop"), "target")


WHOLE_SQL = """
SELECT * FROM (VALUES ('jobs/segments.py', 'raw.nation', 'joined', 0, 'segment_sales'), ('publish/segment_sales_pub.sql', 'segment_sales', 'read', 1, 'mart.segment_sales_pub')) t("file", "table", role, hop, target)
"""


def lineage_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _answer(spark, sf_dir, "removal", Ask("raw.orders", ["o_orderstatus", "o_clerk"]))
    rows = [*((k, v) for k, v in s.stats.items()), ("complete", int(s.coverage["complete"]))]
    return spark.createDataFrame(rows, "name string, value bigint").withColumn("risk", F.lit(s.risk))


#: By the pipeline above: o_orderstatus is used once, in the filter of staging.orders_clean, which then is no longer built, nor are the two published tables behind it; nothing uses o_clerk.
STATS_SQL = """
SELECT name, n::BIGINT AS value, 'medium' AS risk FROM (VALUES
 ('productionTables', 0), ('tablesReached', 1), ('intermediateTables', 1), ('attributesImpacted', 1), ('filesWithImpact', 1), ('breakingUsages', 1), ('inferredFindings', 0), ('couldNotRead', 0),
 ('neverOpened', 0), ('tablesNotVisible', 0), ('trailsCutShort', 0), ('productionStopsLoading', 2), ('feedsBroken', 0), ('wholeTables', 0), ('complete', 1)) t(name, n)
"""


def catalog_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = warehouse(spark, sf_dir).catalog
    return c.select("table", F.col("pos").cast("bigint").alias("pos"), "column", "derived").where("table like 'curated.%' or table = 'raw.nation'")


CATALOG_SQL = """
SELECT * FROM (VALUES ('raw.nation', 0, 'n_nationkey', false), ('raw.nation', 1, 'n_name', false), ('raw.nation', 2, 'n_regionkey', false),
 ('curated.order_facts', 0, 'order_id', true), ('curated.order_facts', 1, 'cust_id', true), ('curated.order_facts', 2, 'ordered_on', true), ('curated.order_facts', 3, 'last_ship', true), ('curated.order_facts', 4, 'revenue', true),
 ('curated.all_facts', 0, 'order_id', true), ('curated.all_facts', 1, 'cust_id', true), ('curated.all_facts', 2, 'ordered_on', true), ('curated.all_facts', 3, 'last_ship', true)) t("table", pos, "column", derived)
"""


def lineage_warehouse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A warehouse of one file for each part, each table built from another one: read, catalogued and scanned."""
    p = F.col("p_partkey")
    source = F.when(p == 1, F.lit("raw.root")).otherwise(F.concat(F.lit("stage.t_"), F.floor(p / 2)))
    sql = F.concat(
        F.lit("CREATE OR REPLACE TABLE stage.t_"), p, F.lit(" AS\nWITH x AS (\n  SELECT key, amount, CASE WHEN amount > "), p, F.lit(" THEN 'a' ELSE 'b' END AS size_class\n  FROM "), source,
        F.lit(")\nSELECT x.key, x.amount, x.size_class, ROW_NUMBER() OVER (PARTITION BY x.key ORDER BY x.amount DESC) AS rn\nFROM x\nWHERE x.key IS NOT NULL"),
    )
    texts = read(spark, sf_dir, "part").select(F.concat(F.lit("sql/"), p % 100, F.lit("/t_"), p, F.lit(".sql")).alias("file"), sql.alias("text"))
    repo = Engine(spark).read_all(from_rows(texts))
    s = repo.scan([Ask("raw.root", ["key"])], published.parse_rule("t_*00"), "rename")
    return s.findings.groupBy(F.col("hop").cast("bigint").alias("hop")).agg(F.count("*").alias("findings"), F.count_if("breaking").alias("breaking"), F.count_distinct("target").alias("tables"))


WAREHOUSE_SQL = "SELECT floor(log2(p_partkey))::BIGINT AS hop, count(*) AS findings, count(*) AS breaking, count(DISTINCT p_partkey) AS tables FROM part WHERE p_partkey > 0 GROUP BY 1"


# --- text and names -------------------------------------------------------------------

def word_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("file"), "text")
    return word_hits(docs, ["the", "und", "les"]).select(F.col("file").alias("doc_id"), F.col("line_no").cast("bigint").alias("line_no"), "name")


WORD_SQL = r"""
SELECT doc_id, i AS line_no, lower(regexp_extract(line, '(?i)(^|[^\p{L}\p{N}_])(the|und|les)($|[^\p{L}\p{N}_])', 2)) AS name
FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1)::BIGINT AS i FROM documents)
WHERE regexp_matches(line, '(?i)(^|[^\p{L}\p{N}_])(the|und|les)($|[^\p{L}\p{N}_])')
"""


def mention_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    hits = word_hits(docs.select(F.col("doc_id").alias("file"), "text"), ["this", "nicht", "pour"])
    joined = hits.join(docs.select(F.col("doc_id").alias("file"), "source"), "file")
    return joined.groupBy("source", "name").agg(F.count("*").alias("lines"), F.count_distinct("file").alias("documents"))


MENTION_SQL = r"""
SELECT source, name, count(*) AS lines, count(DISTINCT doc_id) AS documents FROM (
  SELECT doc_id, source, lower(regexp_extract(line, '(?i)(^|[^\p{L}\p{N}_])(nicht|this|pour)($|[^\p{L}\p{N}_])', 2)) AS name
  FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line FROM documents)
  WHERE regexp_matches(line, '(?i)(^|[^\p{L}\p{N}_])(nicht|this|pour)($|[^\p{L}\p{N}_])')) GROUP BY ALL
"""


def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", text.strip_html(F.col("html")).alias("text"))


PAGE_SQL = r"""
SELECT page_id, trim(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace(
  regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'),
  '(?i)<br[^>]*>|</(p|div|tr|li|h[1-6]|table|ul|ol)>', chr(10), 'g'), '(?i)</t[dh]>', chr(9), 'g'), '<[^>]+>', '', 'g'),
  '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '[ \t]+\n', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g')) AS text FROM pages
"""


def name_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read(spark, sf_dir, "nation")
    name = F.concat(F.lit("`prj."), F.col("n_regionkey").cast("string"), F.lit("."), F.col("n_name"), F.when(F.col("n_nationkey") % 2 == 0, "$20260101").otherwise(""), F.lit("`"))
    c = names.canonical(name)
    return n.select("n_nationkey", c.alias("canonical"), names.short(c).alias("short"), names.dataset(c).alias("dataset"), names.is_metadata(c).alias("metadata"))


NAME_SQL = r"""
SELECT n_nationkey, n_regionkey || '.' || n_name AS canonical, upper(n_name) AS short, n_regionkey::VARCHAR AS dataset, false AS metadata FROM nation
"""


def same_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    a = n.select(F.col("n_nationkey").alias("a_key"), F.when(F.col("n_nationkey") % 3 == 0, F.col("n_name")).when(F.col("n_nationkey") % 3 == 1, F.concat(F.lit("mart."), "n_name")).otherwise(F.concat(F.lit("#F."), "n_name")).alias("a"), names.short(F.col("n_name")).alias("k"))
    b = n.select(F.col("n_nationkey").alias("b_key"), F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("MART."), F.lower("n_name"))).otherwise(F.concat(F.lit("raw."), "n_name")).alias("b"), names.short(F.col("n_name")).alias("k"))
    return a.join(b, "k").select("a_key", "b_key", names.same_table(F.col("a"), F.col("b")).alias("same"))


SAME_SQL = """
SELECT n_nationkey AS a_key, n_nationkey AS b_key, CASE n_nationkey % 3 WHEN 0 THEN true WHEN 1 THEN n_nationkey % 2 = 0 ELSE false END AS same FROM nation
"""


def shard_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = read(spark, sf_dir, "events").select(F.date_format("ts", "yyyyMMdd").alias("suffix")).groupBy("suffix").agg(F.count("*").alias("events"))
    shards = shards.withColumn("name", F.concat(F.lit("raw.events_"), "suffix"))
    some = F.array(F.struct(F.lit(">=").alias("op"), F.lit("20240105").alias("value")), F.struct(F.lit("<").alias("op"), F.lit("20240120").alias("value")), F.struct(F.lit("<>").alias("op"), F.lit("20240110").alias("value")))
    return shards.select("suffix", "events", names.suffix_verdict(F.col("suffix"), some).alias("verdict"), names.wildcard(F.lit("raw.events_*"), F.col("name")).alias("covered"), names.family(F.col("name"))["family"].alias("family"))


SHARD_SQL = """
SELECT suffix, count(*) AS events, CASE WHEN suffix >= '20240105' AND suffix < '20240120' AND suffix <> '20240110' THEN 'reads' ELSE 'excluded' END AS verdict, 'shard' AS covered, 'EVENTS' AS family
FROM (SELECT strftime(ts, '%Y%m%d') AS suffix FROM events) GROUP BY suffix
"""


def families(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part").select("p_partkey", F.regexp_replace("p_brand", "[^A-Za-z0-9]", "_").alias("brand"))
    ending = F.element_at(F.array(*map(F.lit, ["_20260101", "_RUN_DATE", "_ds", "", "_202601", "_x", "_2026_01_01", "_env"])), (F.col("p_partkey") % 8 + 1).cast("int"))
    f = names.family(F.concat(F.lit("mart."), "brand", ending))
    return p.select("p_partkey", f["family"].alias("family"), f["how"].alias("how"))


FAMILY_SQL = """
SELECT p_partkey, CASE WHEN e IN (3, 5) THEN '' ELSE b END AS family, CASE WHEN e IN (0, 4, 6) THEN 'shard' WHEN e IN (1, 2, 7) THEN 'placeholder' ELSE '' END AS how
FROM (SELECT p_partkey, upper(regexp_replace(p_brand, '[^A-Za-z0-9]', '_', 'g')) AS b, p_partkey % 8 AS e FROM part)
"""


def published_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rule = published.parse_rule("| table | owner |\n| mart.customer_pub | a |\n| part_* | b |\n| _FINAL | c |")
    p = read(spark, sf_dir, "part").select("p_partkey", F.concat(F.element_at(F.array(*map(F.lit, ["x.customer_pub", "part_", "raw.a_final", "customer_pub_20260101", "other"])), (F.col("p_partkey") % 5 + 1).cast("int")), F.when(F.col("p_partkey") % 5 == 1, F.col("p_size").cast("string")).otherwise("")).alias("name"))
    return p.select("p_partkey", published.match(rule, F.col("name")).alias("how"))


PUBLISHED_SQL = "SELECT p_partkey, ['name', 'glob', 'suffix', 'shard', ''][(p_partkey % 5 + 1)::INT] AS how FROM part"


def change_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = ["The column will be decommissioned", "It is renamed", "The ISO format", "a wider data type", "nothing", "Retire and rename"]
    d = read(spark, sf_dir, "documents").select("doc_id", F.concat(F.element_at(F.array(*map(F.lit, given)), (F.col("doc_id") % 6 + 1).cast("int")), F.lit(" on 2026-0"), (F.col("doc_id") % 9 + 1).cast("string"), F.lit("-1"), (F.col("doc_id") % 10).cast("string"), F.lit(". And more.")).alias("t"))
    return d.select("doc_id", text.change_kind(F.col("t")).alias("change"), text.parse_date(F.col("t")).alias("effective"), text.first_sentence(F.col("t")).alias("summary"))


CHANGE_SQL = """
SELECT doc_id, ['removal', 'rename', 'value_change', 'type_change', 'unknown', 'removal'][doc_id % 6 + 1] AS change, '2026-0' || (doc_id % 9 + 1) || '-1' || (doc_id % 10) AS effective,
  ['The column will be decommissioned', 'It is renamed', 'The ISO format', 'a wider data type', 'nothing', 'Retire and rename'][doc_id % 6 + 1] || ' on 2026-0' || (doc_id % 9 + 1) || '-1' || (doc_id % 10) || '.' AS summary FROM documents
"""


def first_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", text.first_sentence(F.col("text")).alias("first"), text.change_kind(F.col("text")).alias("change"))


SENTENCE_SQL = r"""
SELECT conv_id, turn, substr(CASE WHEN cut <> '' THEN cut ELSE flat END, 1, 200) AS first,
  CASE WHEN regexp_matches(low, 'decommission|removed|removal|dropped|retire|sunset|deleted|deletion') THEN 'removal' WHEN contains(low, 'rename') OR contains(low, 'renaming') THEN 'rename'
    WHEN regexp_matches(low, 'format|value|iso|full country') THEN 'value_change' WHEN regexp_matches(low, 'data type|datatype|length|precision|varchar|widened') THEN 'type_change' ELSE 'unknown' END AS change
FROM (SELECT *, regexp_extract(flat, '^(.*?[.!?])(?:\s|$)', 1) AS cut FROM (SELECT conv_id, turn, lower(coalesce(text, '')) AS low, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS flat FROM conversations))
"""


def page_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = extension(F.concat(F.regexp_replace("url", r"[?#].*$", ""), F.element_at(F.array(*map(F.lit, ["/a.sql", "/b.sql.j2", "/c.PY", "/d.sql.bak", "/none"])), (F.col("page_id") % 5 + 1).cast("int"))))
    return read(spark, sf_dir, "pages").select(e.alias("ext")).groupBy("ext").agg(F.count("*").alias("files"))


TYPES_SQL = "SELECT ['.sql', '.sql', '.py', '.bak', ''][page_id % 5 + 1] AS ext, count(*) AS files FROM pages GROUP BY 1"


# --- walks over rows ------------------------------------------------------------------

def _geography(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions, nations, customers and orders as tables that feed each other."""
    n, c, o = (read(spark, sf_dir, t) for t in ("nation", "customer", "orders"))
    rows = n.select(F.concat(F.lit("R"), "n_regionkey").alias("a"), F.concat(F.lit("N"), "n_nationkey").alias("b"))
    rows = rows.unionByName(c.select(F.concat(F.lit("N"), "c_nationkey").alias("a"), F.concat(F.lit("C"), "c_custkey").alias("b")))
    rows = rows.unionByName(o.select(F.concat(F.lit("C"), "o_custkey").alias("a"), F.concat(F.lit("O"), F.col("o_orderkey") % 500).alias("b")))
    rows = rows.unionByName(spark.createDataFrame([("N3", "R0"), ("O1", "C7")], "a string, b string"))  # rings
    return rows.distinct()


_GEOGRAPHY_SQL = """edges AS (
  SELECT 'R' || n_regionkey AS a, 'N' || n_nationkey AS b FROM nation UNION SELECT 'N' || c_nationkey, 'C' || c_custkey FROM customer
  UNION SELECT 'C' || o_custkey, 'O' || (o_orderkey % 500) FROM orders UNION SELECT 'N3', 'R0' UNION SELECT 'O1', 'C7')"""


def _as_flows(edges: DataFrame, column: str = "k") -> DataFrame:
    return edges.select(
        F.concat_ws(">", "a", "b").alias("stmt"), F.lit("f").alias("file"), F.col("a").alias("table"), F.col("a").alias("s_short"), F.lit("").alias("s_ds"), F.lit(column).alias("column"), F.lit(column).alias("out"),
        F.lit("direct").alias("how"), F.lit("").alias("without"), F.lit(True).alias("certain"), F.lit(False).alias("star"), F.col("b").alias("target"), F.col("b").alias("t_short"), F.lit("").alias("t_ds"),
    )


def column_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = lineage.column_start(spark.createDataFrame([("R0", "k"), ("N3", "k")], "table string, column string"))
    nodes, _, _ = lineage.walk_columns(_as_flows(_geography(spark, sf_dir)), start)
    return nodes.select("root", F.col("short").alias("table"), F.col("hop").cast("bigint").alias("hop"))


CLOSURE_SQL = f"""
WITH RECURSIVE {_GEOGRAPHY_SQL}, w(root, node, hop) AS (
  SELECT r || '.k', r, 0::BIGINT FROM (VALUES ('R0'), ('N3')) t(r)
  UNION SELECT w.root, e.b, w.hop + 1 FROM w JOIN edges e ON e.a = w.node WHERE w.hop < 8)
SELECT root, node AS "table", min(hop) AS hop FROM w GROUP BY root, node
"""


def closure_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = lineage.column_start(spark.createDataFrame([("R0", "k")], "table string, column string"))
    nodes, _, cut = lineage.walk_columns(_as_flows(_geography(spark, sf_dir)), start, max_hops=2)
    reached = nodes.agg(F.count("*").alias("n")).withColumn("what", F.lit("reached"))
    return reached.unionByName(cut.agg(F.count("*").alias("n")).withColumn("what", F.lit("cut"))).select("what", "n")


CUT_SQL = f"""
WITH {_GEOGRAPHY_SQL}, h1 AS (SELECT DISTINCT b FROM edges WHERE a = 'R0'), h2 AS (SELECT DISTINCT e.b FROM edges e JOIN h1 ON e.a = h1.b WHERE e.b <> 'R0' AND e.b NOT IN (SELECT b FROM h1))
SELECT 'reached' AS what, 1 + (SELECT count(*) FROM h1) + (SELECT count(*) FROM h2) AS n
UNION ALL SELECT 'cut', count(*) FROM h2 WHERE b IN (SELECT a FROM edges)
"""


def table_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _geography(spark, sf_dir).select(
        F.concat_ws(">", "a", "b").alias("stmt"), F.lit("f").alias("file"), F.col("b").alias("target"), F.col("b").alias("t_short"), F.lit("").alias("t_ds"), F.lit("").alias("copied"), F.lit("").alias("export_uri"),
        F.lit(False).alias("joined"), F.col("a").alias("table"), F.col("a").alias("s_short"), F.lit("").alias("s_ds"),
    )
    readers, _ = lineage.walk_tables(e, spark.createDataFrame([("R1",)], "table string"))
    return readers.groupBy(F.col("hop").cast("bigint").alias("hop")).agg(F.count("*").alias("statements"), F.count_distinct("table").alias("tables"))


TABLES_SQL = f"""
WITH RECURSIVE {_GEOGRAPHY_SQL}, w(node, hop) AS (SELECT 'R1', 0::BIGINT UNION SELECT e.b, w.hop + 1 FROM w JOIN edges e ON e.a = w.node WHERE w.hop < 8),
d AS (SELECT node, min(hop) AS hop FROM w GROUP BY node)
SELECT d.hop, count(*) AS statements, count(DISTINCT d.node) AS tables FROM d JOIN edges e ON e.a = d.node GROUP BY d.hop
"""


def stops_loading(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _as_flows(_geography(spark, sf_dir)).select("s_short", "t_short", "target")
    broken = spark.createDataFrame([("R2", "s1"), ("R3", "s2")], "target string, stmt string")
    none = spark.createDataFrame([("N0",)], "short string")
    found, _ = lineage.stops_loading(e, broken, F.col("table").startswith("N"), none)
    return found.select("table", F.array_join("via", " > ").alias("via"), "because")


STOPS_SQL = f"""
WITH RECURSIVE {_GEOGRAPHY_SQL}, w(node, via, because, hop) AS (
  SELECT n, n, s, 0 FROM (VALUES ('R2', 's1'), ('R3', 's2')) t(n, s)
  UNION ALL SELECT e.b, w.via || ' > ' || e.b, w.because, w.hop + 1 FROM w JOIN edges e ON e.a = w.node
  WHERE w.hop < 6 AND left(e.b, 1) IN ('R', 'N') AND NOT contains(w.via || ' > ', e.b || ' > '))
SELECT node AS "table", arg_min(via, (hop, replace(via, ' > ', '>'))) AS via, arg_min(because, (hop, replace(via, ' > ', '>'))) AS because
FROM w WHERE node LIKE 'N%' AND node <> 'N0' GROUP BY node
"""


def longest_branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer").select(F.lit("r").alias("root"), F.array(F.col("c_nationkey").cast("string"), F.col("c_mktsegment"), F.col("c_custkey").cast("string")).alias("p"), "c_custkey")
    some = c.select("root", F.when(F.col("c_custkey") % 3 == 0, F.slice("p", 1, 1)).when(F.col("c_custkey") % 3 == 1, F.slice("p", 1, 2)).otherwise(F.col("p")).alias("path")).distinct()
    return lineage.longest_only(some).select(F.array_join("path", "/").alias("path"), F.col("hops").cast("bigint").alias("hops"))


LONGEST_SQL = """
WITH p AS (SELECT DISTINCT CASE c_custkey % 3 WHEN 0 THEN c_nationkey::VARCHAR WHEN 1 THEN c_nationkey || '/' || c_mktsegment ELSE c_nationkey || '/' || c_mktsegment || '/' || c_custkey END AS path FROM customer)
SELECT path, (len(string_split(path, '/')) - 1)::BIGINT AS hops FROM p WHERE NOT EXISTS (SELECT 1 FROM p q WHERE starts_with(q.path, p.path || '/'))
"""


# --- usages ---------------------------------------------------------------------------

_KINDS = list(usages.LABELS)


def _uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    kind = F.element_at(F.array(*map(F.lit, _KINDS)), (F.pmod(F.col("event_id") * 7 + F.length("event_type"), F.lit(len(_KINDS))) + 1).cast("int"))
    return e.select(
        F.col("user_id").alias("stmt"), F.col("event_type").alias("column"), kind.alias("kind"), (F.col("event_id") % 3 != 0).alias("certain"),
        F.when(F.col("event_id") % 2 == 0, F.col("event_id").cast("string")).otherwise("").alias("detail"), F.lit("").alias("alias"), F.col("event_id").cast("int").alias("line"),
    )


_USES_SQL = f"uses AS (SELECT user_id AS stmt, event_type AS col, ({_KINDS!r})[((event_id * 7 + length(event_type)) % {len(_KINDS)} + 1)::INT] AS kind, event_id % 3 <> 0 AS certain, CASE WHEN event_id % 2 = 0 THEN event_id::VARCHAR ELSE '' END AS detail, event_id AS line FROM events)"


def usage_primary(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = usages.primary(_uses(spark, sf_dir), "stmt", "column")
    return head.select("stmt", "column", "kind", "certain", "detail", F.array_join("kinds", ",").alias("kinds"))


PRIMARY_SQL = f"""
WITH {_USES_SQL}, best AS (SELECT * FROM uses QUALIFY row_number() OVER (PARTITION BY stmt, col, kind ORDER BY certain DESC, detail = '', line, detail) = 1)
SELECT stmt, col AS "column", kind, certain, detail, kinds FROM (
  SELECT *, array_to_string(list_sort(list_distinct(list(kind) OVER (PARTITION BY stmt, col))), ',') AS kinds, row_number() OVER (PARTITION BY stmt, col ORDER BY list_position({_KINDS!r}, kind), certain DESC, line) AS n FROM best) WHERE n = 1
"""


def usage_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = _uses(spark, sf_dir)
    out = None
    for change in usages.CHANGES:
        part = u.groupBy("kind").agg(F.count("*").alias("uses")).select(F.lit(change).alias("change"), "kind", "uses", usages.label(F.col("kind")).alias("label"), usages.breaks(F.col("kind"), change).alias("breaking"), usages.no_local_fix(F.col("kind"), change).alias("no_local_fix"))
        out = part if out is None else out.unionByName(part)
    return out


BREAKS_SQL = f"""
WITH {_USES_SQL}, b(change, kind) AS (VALUES {', '.join(f"('{c}', '{k}')" for c, ks in usages.BREAKS.items() for k in sorted(ks))}), l(kind, label) AS (VALUES {', '.join(f"('{k}', '{v}')" for k, v in usages.LABELS.items())})
SELECT c.change, u.kind, count(*) AS uses, any_value(l.label) AS label, (c.change, u.kind) IN (SELECT (change, kind) FROM b) AS breaking, u.kind IN ('ranking', 'dedup_key') AND c.change IN ('removal', 'rename') AS no_local_fix
FROM uses u JOIN l ON l.kind = u.kind, (SELECT DISTINCT change FROM b) c GROUP BY c.change, u.kind
"""


def line_locator(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").select("doc_id", "text", F.size(F.split("text", "\n", -1)).alias("n"))
    at = usages.locate(F.col("text"), F.lit("the"), F.lit("select"), F.lit(0), F.col("n") - 1)
    placed = d.select("doc_id", "text", at.alias("at"))
    return placed.select("doc_id", F.col("at").cast("bigint").alias("line"), F.size(usages.snippet(F.col("text"), F.col("at"))).cast("bigint").alias("shown"))


LOCATOR_SQL = r"""
WITH scored AS (
  SELECT doc_id, i - 1 AS place, len(lines) AS n, CASE WHEN regexp_matches(line, '(^|[^\p{L}\p{N}_])THE($|[^\p{L}\p{N}_])') THEN 1 + 2 * contains(line, 'SELECT')::INT + 2 * contains(line, ' AS ')::INT ELSE 0 END AS score
  FROM (SELECT doc_id, lines, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM (SELECT doc_id, string_split(upper(text), chr(10)) AS lines FROM documents WHERE text IS NOT NULL))),
best AS (SELECT doc_id, any_value(n) AS n, CASE WHEN max(score) > 0 THEN arg_min(place, 10000 * (5 - score) + place) ELSE 0 END AS line FROM scored GROUP BY doc_id)
SELECT doc_id, line::BIGINT AS line, (least(line + 2, n - 1) - greatest(line - 2, 0) + 1)::BIGINT AS shown FROM best
UNION ALL SELECT doc_id, NULL, NULL FROM documents WHERE text IS NULL
"""


def history_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select(F.col("user_id").alias("id"), F.col("event_type").alias("status"), F.col("event_id").alias("event"))
    return history.latest(e)


HISTORY_SQL = "SELECT user_id AS id, arg_max(event_type, event_id) AS status FROM events GROUP BY user_id"


ALL: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "lineage_shipdate": (lineage_shipdate, SHIPDATE_SQL), "lineage_groups": (lineage_groups, GROUPS_SQL), "lineage_branches": (lineage_branches, BRANCHES_SQL),
    "lineage_whole_table": (lineage_whole_table, WHOLE_SQL), "lineage_stats": (lineage_stats, STATS_SQL), "catalog_columns": (catalog_columns, CATALOG_SQL), "lineage_warehouse": (lineage_warehouse, WAREHOUSE_SQL),
    "word_search": (word_search, WORD_SQL), "mention_counts": (mention_counts, MENTION_SQL), "page_text": (page_text, PAGE_SQL), "name_parts": (name_parts, NAME_SQL),
    "same_tables": (same_tables, SAME_SQL), "shard_reads": (shard_reads, SHARD_SQL), "families": (families, FAMILY_SQL), "published_names": (published_names, PUBLISHED_SQL),
    "change_words": (change_words, CHANGE_SQL), "first_sentences": (first_sentences, SENTENCE_SQL), "page_types": (page_types, TYPES_SQL), "column_closure": (column_closure, CLOSURE_SQL),
    "closure_cut": (closure_cut, CUT_SQL), "table_closure": (table_closure, TABLES_SQL), "stops_loading": (stops_loading, STOPS_SQL), "longest_branches": (longest_branches, LONGEST_SQL),
    "usage_primary": (usage_primary, PRIMARY_SQL), "usage_breaks": (usage_breaks, BREAKS_SQL), "line_locator": (line_locator, LOCATOR_SQL),
    "history_latest": (history_latest, HISTORY_SQL), 
}
