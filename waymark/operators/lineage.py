"""Following columns and tables through statements.

Reachability is a set: a column of a table is visited once for each thing asked about, at
the least number of steps, so diamonds don't multiply. It is visited again only when a longer
way is surer: one with fewer steps through stars whose columns are listed nowhere, or all of
whose tables the SQL states. Paths are listed afterwards from the steps, up to a bound that
is reported when it is met. Every loop ends when a round finds nothing new; a step limit only
marks what was cut short.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.functions import names
from waymark.functions.shared import SENT, settle, unsent
from waymark.operators import usages
from waymark.plans.reader import HELD

MOST_PATHS = 10_000


def _alike(ds_a: Column, ds_b: Column) -> Column:
    """The dataset rule, given equal short names; datasets of fenced names are whole names and must agree."""
    fenced = ds_a.startswith("#") | ds_b.startswith("#")
    return F.when(fenced, ds_a == ds_b).otherwise((ds_a == "") | (ds_b == "") | (ds_a == ds_b))


def _meets(short: str, ds: str) -> Column:
    """What names of one table have in common: the short name, and all of a fenced one, whose short name any number of files may share."""
    return F.when(F.startswith(F.col(ds), F.lit("#")), F.col(ds)).otherwise(F.col(short))


def reading(front: DataFrame, rows: DataFrame, wild: bool) -> DataFrame:
    """``front`` (short, ds, ...) with the ``rows`` (s_short, s_ds, table, ...) that can mean the same table; by says how."""
    plain = front.withColumn("meets", _meets("short", "ds")).join(rows.withColumn("meets", _meets("s_short", "s_ds")), "meets").drop("meets")
    plain = plain.where(_alike(F.col("ds"), F.col("s_ds"))).withColumn("by", F.lit("name"))
    if not wild:
        return plain
    shown = F.when(F.col("ds") != "", F.concat_ws(".", "ds", "short")).otherwise(F.col("short"))
    patterns = rows.where("endswith(table, '*')").withColumn("stem", _stem("s_short"))
    # each beginning of a name meets the patterns with this stem: a join on equal text
    covered = front.withColumn("stem", F.explode(_beginnings("short"))).join(patterns, "stem").drop("stem")
    covered = covered.withColumn("by", names.wildcard(F.col("table"), shown)).where("by <> '' and not startswith(ds, '#')")
    if "conditions" in rows.columns:  # shards that the statement leaves out by its literals aren't read
        suffix = F.expr("substring(short, length(regexp_replace(s_short, '[*]$', '')) + 1)")
        read = names.suffix_verdict(suffix, F.coalesce("conditions", F.array().cast("array<struct<op: string, value: string>>")))
        whole = (F.col("by") == "family") | F.endswith("short", F.lit("*"))  # no one shard is asked about
        covered = covered.withColumn("by", F.when(whole, F.col("by")).when(read == "maybe", "maybe").when(read == "reads", F.col("by")).otherwise("")).where("by <> ''")
    asked = front.where("endswith(short, '*')").withColumn("stem", _stem("short"))
    shards = rows.where("not endswith(table, '*')").select("s_short").distinct().withColumn("stem", F.explode(_beginnings("s_short")))
    named = asked.join(shards, "stem").drop("stem").join(rows.where("not endswith(table, '*')"), "s_short")
    named = named.withColumn("by", names.wildcard(shown, F.col("table"))).where("by <> '' and not startswith(s_ds, '#')")
    return plain.unionByName(covered).unionByName(named)


def _stem(column: str) -> Column:
    """A pattern without its star and the separators before it."""
    return F.regexp_replace(column, "_*[*]$", "")


def _beginnings(column: str) -> Column:
    return F.transform(F.sequence(F.lit(0), F.length(column)), lambda k: F.substring(F.col(column), F.lit(1), k))


def _conditions(rows: DataFrame) -> list[str]:
    return ["conditions"] if "conditions" in rows.columns else []


def has_wildcards(rows: DataFrame, front: DataFrame) -> bool:
    one = F.lit(1).alias("one")
    return not rows.where("endswith(table, '*')").select(one).unionByName(front.where("endswith(short, '*')").select(one)).isEmpty()


def merged(seen: DataFrame, front: DataFrame, rounds: int) -> DataFrame:
    """``seen`` and a settled ``front``; every eighth round they are settled as one, which keeps plans short."""
    both = seen.unionByName(front)
    return settle(both) if rounds % 8 == 0 else both


def column_start(asked: DataFrame) -> DataFrame:
    """The first front of a column walk from (table, column)."""
    t = F.col("table")
    return asked.select(
        F.concat_ws(".", "table", "column").alias("root"), names.short(t).alias("short"),
        F.when(names.is_fenced(t), F.upper(t)).otherwise(names.dataset(t)).alias("ds"), t.alias("at_table"),
        F.upper("column").alias("key"), F.col("column").alias("at_column"), F.lit(0).alias("hop"), F.lit(0).alias("inferred"), F.lit(True).alias("sure"),
    )


def _field_of(inner: Column, outer: Column) -> Column:
    """Whether one dotted name is a field of another."""
    return F.startswith(inner, F.concat(outer, F.lit(".")))


def _takes(column: Column, key: Column) -> Column:
    """Whether what takes a column takes this one: itself, a field of it, or the struct it is in."""
    name = F.upper(column)
    return (name == key) | _field_of(key, name) | _field_of(name, key)


def _carries(flow_column: Column, without: Column, key: Column) -> Column:
    return _takes(flow_column, key) | (flow_column == "*") & ~F.array_contains(F.split(without, ","), key)


def walk_columns(flows: DataFrame, start: DataFrame, known: DataFrame | None = None, max_hops: int = 0, most_rounds: int = 1000) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, steps, cut): columns reached, the steps between them, and nodes where the limit stopped the walk.

    A step through a star whose target's columns are not ``known`` (key, column) is
    inferred, and so is all that follows; a step on the bare fact that a statement uses
    the column is carried. A place has labels (steps inferred, tables stated), those that
    no other label of it is as good as; a new one opens it again. Its node tells the fewest
    steps, and the best label. A field of a struct goes on under the struct's new name.
    """
    stars = has_wildcards(flows, start)
    nodes = front = settle(start)
    steps, cut = [], None
    who = ["root", "short", "ds", "key"]
    listed = unsent(settle(known.select(F.col("key").alias("k_key"), F.upper("column").alias("k_column")).distinct())) if known is not None else None
    for hop in range(1, most_rounds + 1):
        n = front.count()
        if not n:
            break
        # the flows of a large tree aren't sent whole; a front is, while it is small
        there = reading(F.broadcast(front) if n <= SENT else front, flows.select("stmt", "file", "table", "s_short", "s_ds", "column", "out", "how", "without", "certain", "star", "target", "t_short", "t_ds", *_conditions(flows)), stars)
        there = there.where(_carries(F.col("column"), F.col("without"), F.col("key")) & (F.col("without") != HELD))
        deeper = (F.col("how") == "direct") & _field_of(F.col("key"), F.upper("column"))
        new_column = F.when((F.col("column") == "*") & (F.col("out") == "*"), F.col("at_column")).when(deeper, F.concat("out", F.expr("substring(at_column, length(column) + 1)"))).otherwise(F.col("out"))
        onward = there.withColumn("to_column", new_column).withColumn("to_key", F.upper("to_column"))
        if listed is not None:
            onward = onward.join(listed, (F.col("t_short") == F.col("k_key")) & (F.substring_index("to_key", ".", 1) == F.col("k_column")), "left")
            unseen = F.col("k_key").isNull()
        else:
            unseen = F.lit(True)
        guess = ((F.col("how") == "star") | F.col("star")) & unseen
        stated = F.col("certain") & (F.col("by") != "maybe")
        onward = onward.select(
            "root", F.col("at_table").alias("from_table"), F.col("short").alias("from_short"), F.col("key").alias("from_key"), F.col("at_column").alias("from_column"), "stmt", "file", "how", "by",
            F.col("t_short").alias("short"), F.col("t_ds").alias("ds"), F.col("target").alias("at_table"), F.col("to_key").alias("key"), F.col("to_column").alias("at_column"),
            F.lit(hop).alias("hop"), (F.col("inferred") + guess.cast("int")).alias("inferred"), (F.col("sure") & stated).alias("sure"),
        )
        if max_hops and hop > max_hops:
            beyond = onward.join(nodes.select(*who), who, "left_anti")
            cut = settle(beyond.select("root", F.col("from_table").alias("table"), F.col("from_column").alias("column")).distinct())
            break
        onward = settle(_better(onward.distinct(), nodes.select(*who, "inferred", "sure"), who))
        steps.append(onward.drop("fresh"))
        front = onward.where("fresh").select(nodes.columns)
        nodes = merged(nodes, front, hop)
    else:
        cut = front.select("root", F.col("at_table").alias("table"), F.col("at_column").alias("column"))
    every = settle(reduce(DataFrame.unionByName, [x.select(steps[0].columns) for x in steps])) if steps else _no_steps(nodes)
    if cut is None:
        cut = nodes.where("false").select("root", F.col("at_table").alias("table"), F.col("at_column").alias("column"))
    label = F.min(F.struct("inferred", (~F.col("sure")).alias("unsure"))).alias("label")
    name = F.min_by(F.struct("at_table", "at_column"), F.struct("hop", "inferred", ~F.col("sure"), "at_table", "at_column")).alias("name")
    best = nodes.groupBy(*who).agg(F.min("hop").alias("hop"), label, name)
    best = best.select("root", "short", "ds", "name.at_table", "key", "name.at_column", "hop", "label.inferred", (~F.col("label.unsure")).alias("sure"))
    return settle(best.select(nodes.columns)), every, cut


def _better(rows: DataFrame, labels: DataFrame, who: list[str]) -> DataFrame:
    """``rows`` with fresh: those whose label (inferred, sure) is better in something than each earlier one of their place."""
    both = rows.withColumn("old", F.lit(False)).unionByName(labels.withColumn("old", F.lit(True)), allowMissingColumns=True)
    order = Window.partitionBy(*who).orderBy(F.desc("old"), "inferred", F.desc("sure"), "at_table", "at_column")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    any_, sure = F.min("inferred").over(before), F.min(F.when(F.col("sure"), F.col("inferred"))).over(before)
    least = F.coalesce(F.when(F.col("sure"), sure).otherwise(any_), F.col("inferred") + 1)
    return both.withColumn("fresh", F.col("inferred") < least).where("not old").drop("old")


def _fresh(rows: DataFrame, seen: DataFrame, who: list[str], *order: Column | str) -> DataFrame:
    """``rows`` with fresh: the first of each place that ``seen`` (who) doesn't have. One frame is settled a hop.

    Both go through one window: a join would have Spark multiply its estimates of their
    sizes hop by hop, up to numbers that take longer than the walk.
    """
    both = rows.withColumn("old", F.lit(False)).unionByName(seen.withColumn("old", F.lit(True)), allowMissingColumns=True)
    at = F.row_number().over(Window.partitionBy(*who).orderBy(F.desc("old"), *order))
    return both.withColumn("n", at).where("not old").withColumn("fresh", F.col("n") == 1).drop("n", "old")


def _no_steps(nodes: DataFrame) -> DataFrame:
    empty = F.lit("")
    return nodes.where("false").select(
        "root", F.col("at_table").alias("from_table"), F.col("short").alias("from_short"), F.col("key").alias("from_key"), F.col("at_column").alias("from_column"),
        empty.alias("stmt"), empty.alias("file"), empty.alias("how"), empty.alias("by"), "short", "ds", "at_table", "key", "at_column", "hop", "inferred", "sure",
    )


def findings(nodes: DataFrame, uses: DataFrame, statements: DataFrame, change: str) -> DataFrame:
    """One row for each statement and column it uses on the trail, headed by its most telling use."""
    wild = has_wildcards(uses, nodes)
    hit = reading(nodes, uses.select("stmt", "table", "s_short", "s_ds", "column", "kind", "alias", "detail", "certain", "via_star", "line", *_conditions(uses)), wild)
    named = _takes(F.col("column"), F.col("key"))
    hit = hit.where(named | (F.col("column") == "*") & ~F.array_contains(F.split("detail", ","), F.col("key")))
    hit = hit.withColumn("certain", F.col("certain") & F.col("by").isin("name", "shard", "both")).withColumn("detail", F.when(F.col("column") == "*", "").otherwise(F.col("detail")))
    starry = Window.partitionBy("stmt", "short", "ds", "key", "root")
    hit = hit.withColumn("named", F.max(named).over(starry)).where("column <> '*' or not named")
    by = ["root", "stmt", "short", "ds", "key"]
    head = usages.primary(hit, *by)
    about = statements.select("stmt", "file", F.col("line").alias("starts"), "line_end", "target", "copied", "as_text", "export_uri", "named_by", "sql")
    kind = F.col("kind")
    told = head.join(about, "stmt").select(
        "root", "stmt", "file", (F.col("line") + 1).alias("line"), F.col("at_table").alias("table"), F.col("at_column").alias("column"), "short", "key", "kind", "kinds",
        usages.label(kind).alias("label"), "alias", "detail", "hop", F.col("inferred").alias("inferred_hops"), (F.col("certain") & F.col("sure")).alias("certain"), F.col("via_star"),
        "target", "copied", "as_text", "export_uri", "named_by", usages.breaks(kind, change).alias("breaking"), usages.no_local_fix(kind, change).alias("no_local_fix"),
    )
    told = told.withColumn("impact", usages.sentence(kind, F.col("column"), F.col("detail"), F.col("breaking"), change))
    one = ["stmt", "file", "line", "table", "column", "key", "short", "kind"]
    rest = [c for c in told.columns if c not in one and c not in ("root", "hop", "inferred_hops", "certain")]
    return told.groupBy(*one).agg(
        F.min("hop").alias("hop"), F.min("inferred_hops").alias("inferred_hops"), F.max("certain").alias("certain"), F.array_sort(F.collect_set("root")).alias("roots"),
        *(F.first(c).alias(c) for c in rest),
    )


def upstream_of(steps: DataFrame, ends: DataFrame) -> DataFrame:
    """(root, end, short, key): for each table in ``ends`` (short) the columns of the trail that lead to it.

    Ends are bits, 64 to a word, and go back along the steps as words that are or-ed
    together: what is held is a word for each column and 64 tables it leads to, not a row
    for each pair. They become rows again in what is returned.
    """
    edges = settle(steps.select("root", "from_short", "from_key", "short", "key").distinct())
    place = ["root", "short", "key"]
    numbered = settle(settle(edges.select("short").join(ends, "short", "left_semi").distinct()).withColumn("id", F.monotonically_increasing_id()))
    word, bit = F.shiftright("id", 6).alias("word"), F.expr("shiftleft(1L, cast(id & 63 as int))").alias("bits")
    seen = front = settle(edges.join(numbered, "short").select(*place, word, bit).distinct())
    rounds = 0
    while not front.isEmpty():
        rounds += 1
        back = front.join(edges, place).select("root", F.col("from_short").alias("short"), F.col("from_key").alias("key"), "word", "bits")
        told = back.withColumn("new", F.lit(True)).unionByName(seen.withColumn("new", F.lit(False)))
        there = F.coalesce(F.bit_or(F.when(~F.col("new"), F.col("bits"))), F.lit(0).cast("bigint"))
        come = F.coalesce(F.bit_or(F.when(F.col("new"), F.col("bits"))), F.lit(0).cast("bigint"))
        both = settle(told.groupBy(*place, "word").agg(there.alias("there"), come.alias("come")))
        seen = both.select(*place, "word", F.col("there").bitwiseOR(F.col("come")).alias("bits"))
        front = both.select(*place, "word", F.col("come").bitwiseAND(F.bitwise_not("there")).alias("bits")).where("bits <> 0")
    bits = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda k: F.call_function("getbit", F.col("bits"), k) == 1)
    each = seen.select(*place, "word", F.explode(bits).alias("bit"))
    named = numbered.select(F.col("short").alias("end"), word, F.expr("cast(id & 63 as int)").alias("bit"))
    return each.join(named, ["word", "bit"]).select("root", "end", "short", "key")


def paths(start: DataFrame, steps: DataFrame, most: int = MOST_PATHS) -> tuple[DataFrame, bool]:
    """(path, hops) from each start to where its trail ends, as 'table.column' strings, and whether ``most`` was met."""
    edges = settle(steps.select("root", F.concat_ws(".", "from_short", "from_key").alias("a"), F.concat_ws(".", "short", "key").alias("b"), "at_table", "at_column", "how").distinct())
    label = F.concat_ws(".", "at_table", "at_column")
    front = settle(start.select("root", F.concat_ws(".", "short", "key").alias("a"), F.array(F.concat_ws(".", "short", "key")).alias("seen"), F.array(label).alias("path")))
    done, met = [], False
    while True:
        n = front.count()
        if not n:
            break
        if n > most:
            front, met = settle(front.orderBy("root", F.array_join("path", ">")).limit(most)), True
        onward = front.join(edges, ["root", "a"]).where(~F.array_contains("seen", F.col("b")))
        grown = settle(onward.select("root", F.col("b").alias("a"), F.concat("seen", F.array("b")).alias("seen"), F.concat("path", F.array(label)).alias("path")).distinct())
        went = grown.select("root", F.slice("seen", 1, F.size("seen") - 1).alias("seen")).distinct()
        done.append(front.join(went, ["root", "seen"], "left_anti").select("root", "path"))
        front = grown
    every = settle(reduce(DataFrame.unionByName, done).distinct()) if done else start.select("root", F.array(label).alias("path")).where("false")
    return longest_only(every), met


def longest_only(branches: DataFrame) -> DataFrame:
    """Branches (root, path) that don't merely begin another one: prefixes are looked up, not compared in pairs."""
    prefixes = branches.select("root", F.explode(F.transform(F.sequence(F.lit(1), F.size("path") - 1), lambda k: F.slice("path", 1, k))).alias("path")).where("size(path) > 0") \
        .join(branches, ["root", "path"], "left_semi").distinct()
    return branches.join(prefixes, ["root", "path"], "left_anti").withColumn("hops", F.size("path") - 1)


def tree_of(branches: DataFrame) -> DataFrame:
    """(root, depth, parent, node, leaf): the tree that branches make when their common beginnings are one."""
    at = F.transform(F.sequence(F.lit(1), F.size("path")), lambda k: F.slice("path", 1, k))
    steps = branches.select("root", F.size("path").alias("n"), F.posexplode(at).alias("depth", "prefix"))
    joined = F.array_join("prefix", " > ")
    above = F.array_join(F.slice("prefix", 1, F.size("prefix") - 1), " > ")
    return steps.groupBy("root", "depth", above.alias("parent"), joined.alias("node")).agg(F.max(F.col("depth") == F.col("n") - 1).alias("leaf"))


def table_edges(statements: DataFrame) -> DataFrame:
    """(stmt, file, table, s_short, s_ds, joined, copied, export_uri, target, t_short, t_ds): each table that a statement reads, and whether it joins it."""
    rows = statements.select("stmt", "file", "target", "t_short", "t_ds", "copied", "export_uri", "joins", F.explode("sources").alias("table"))
    t = F.col("table")
    return rows.withColumn("joined", F.array_contains("joins", t)).drop("joins").withColumn("s_short", names.short(t)).withColumn("s_ds", F.when(names.is_fenced(t), F.upper(t)).otherwise(names.dataset(t)))


def walk_tables(edges: DataFrame, tables: DataFrame, max_hops: int = 0) -> tuple[DataFrame, DataFrame]:
    """(readers, nodes) of whole tables (table): every statement that reads them, at the fewest steps, and the tables they build."""
    t = F.col("table")
    start = tables.select(t.alias("root"), names.short(t).alias("short"), names.dataset(t).alias("ds"), t.alias("at_table"), F.lit(0).alias("hop"))
    wild = has_wildcards(edges, start)
    nodes = front = settle(start)
    found, hop = [], 0
    while not front.isEmpty() and not (max_hops and hop >= max_hops):
        hop += 1
        role = F.when(F.col("copied") != "", "copied").when(F.col("export_uri") != "", "exported").when(F.col("joined"), "joined").otherwise("read")
        hit = reading(front, edges, wild).select("root", "stmt", "file", F.col("at_table").alias("table"), F.col("hop").alias("at_hop"), role.alias("role"), "target", "by", "t_short", "t_ds")
        seen = nodes.select("root", F.col("short").alias("t_short"), F.col("ds").alias("t_ds"))
        hit = settle(_fresh(hit, seen, ["root", "t_short", "t_ds"], "target", "stmt"))
        found.append(hit.select("root", "stmt", "file", "table", F.col("at_hop").alias("hop"), "role", "target", "by"))
        front = hit.where("fresh and target <> ''").select("root", F.col("t_short").alias("short"), F.col("t_ds").alias("ds"), F.col("target").alias("at_table"), F.lit(hop).alias("hop"))
        nodes = merged(nodes, front, hop)
    readers = reduce(DataFrame.unionByName, found) if found else None
    if readers is None:
        readers = start.where("false").select("root", F.lit("").alias("stmt"), F.lit("").alias("file"), F.col("at_table").alias("table"), "hop", F.lit("").alias("role"), F.lit("").alias("target"), F.lit("").alias("by"))
    first = Window.partitionBy("root", "stmt").orderBy("hop", "table")
    return readers.withColumn("n", F.row_number().over(first)).where("n = 1").drop("n"), nodes


def stops_loading(edges: DataFrame, broken: DataFrame, published: Column, groups: DataFrame, most: int = 0) -> tuple[DataFrame, bool]:
    """(table, via, because): published tables downstream of targets of ``broken`` findings (target, stmt), by the fewest steps.

    Tables in ``groups`` (short) are left out: their columns are affected already. All
    tables are visited; with ``most`` the walk stops beyond so many, and says so.
    """
    t = F.col("target")
    start = broken.where("target <> ''").groupBy(names.short(t).alias("short")).agg(F.min(t).alias("at_table"), F.min("stmt").alias("because"))
    front = seen = settle(start.withColumn("via", F.array("at_table")))
    links = edges.where("target <> ''").select(F.col("s_short").alias("short"), F.col("t_short").alias("next"), F.col("target").alias("next_table")).distinct()
    capped = False
    rounds = 0
    while not front.isEmpty():
        rounds += 1
        if most and seen.count() > most:
            capped = True
            break
        new = front.join(links, "short").where("next <> short")
        new = new.groupBy("next").agg(F.min(F.struct(F.size("via").alias("n"), F.array_join("via", ">").alias("k"), "via", "because", "next_table")).alias("x"))
        new = new.select(F.col("next").alias("short"), F.col("x.next_table").alias("at_table"), F.col("x.because").alias("because"), F.concat("x.via", F.array("x.next_table")).alias("via"))
        front = settle(new.join(seen.select("short"), "short", "left_anti").select(seen.columns))
        seen = merged(seen, front, rounds)
    found = seen.join(groups, "short", "left_anti").select(F.col("at_table").alias("table"), "via", "because")
    return found.where(published), capped


def risk(found: int, no_fix: int, breaking: int, unread_on_topic: bool, mentioned: bool, unknown_types: bool) -> str:
    """none is only said when nothing was found and nothing relevant stayed unread."""
    if not found:
        return "unknown" if unread_on_topic else "low" if mentioned else "unknown" if unknown_types else "none"
    return "high" if no_fix else "medium" if breaking else "low"
