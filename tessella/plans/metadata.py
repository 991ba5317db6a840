"""Catalogue queries: the tables seen as a tree of groups (region / nation), variables and attributes."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.functions import convert as V
from tessella.operators.tree import breadth_first
from tessella.plans.registry import query
from tessella.runtime import table

TREE = "(SELECT '/' || r_name || '/' || n_name || '/' || c_name AS path, c_name AS name, '/' || r_name || '/' || n_name AS grp, r_name, n_name, c_custkey, c_mktsegment, c_acctbal, c_nationkey FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"


def tree(spark, d):
    """Variables with their full path; groups are small tables."""
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    c = table(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    grp = F.concat(F.lit("/"), "r_name", F.lit("/"), "n_name")
    return c.select(F.concat(grp, F.lit("/"), "c_name").alias("path"), F.col("c_name").alias("name"), grp.alias("grp"), "r_name", "n_name", "c_custkey", "c_mktsegment", "c_acctbal", "c_nationkey")


@query(f"SELECT path, '/' || split_part(path, '/', 2) AS top, name FROM {TREE}")
def meta_fullname(spark, d):
    return tree(spark, d).select("path", F.concat(F.lit("/"), F.get(F.split("path", "/"), F.lit(1))).alias("top"), F.element_at(F.split("path", "/"), -1).alias("name"))


@query(f"SELECT grp, min(path) AS path FROM {TREE} WHERE c_mktsegment = 'BUILDING' GROUP BY grp")
def meta_find_att(spark, d):
    """The first variable of each group whose attribute has the value."""
    return tree(spark, d).where(F.col("c_mktsegment") == "BUILDING").groupBy("grp").agg(F.min("path").alias("path"))


@query(f"SELECT path, 3 AS depth FROM {TREE} UNION ALL SELECT DISTINCT grp, 2 FROM {TREE}")
def meta_all_vars(spark, d):
    t = tree(spark, d)
    return t.select("path", F.lit(3).alias("depth")).union(t.select("grp", F.lit(2)).distinct())


@query("""SELECT o_orderkey AS var, coalesce('/' || n_name, CAST(o_orderkey % 40 AS VARCHAR)) AS dim, coalesce(n_nationkey + 1, o_orderkey % 40) AS length, n_nationkey IS NOT NULL AS shared
FROM orders LEFT JOIN nation ON o_orderkey % 40 = n_nationkey""")
def meta_dim_resolve(spark, d):
    """A dimension name is looked up in the group; one that is missing but numeric is anonymous with that length."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("var"), (F.col("o_orderkey") % 40).alias("want"))
    n = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("want"), F.concat(F.lit("/"), "n_name").alias("dim"), (F.col("n_nationkey") + 1).cast("long").alias("len"))
    return o.join(n, "want", "left").select("var", F.coalesce("dim", F.col("want").cast("string")).alias("dim"), F.coalesce("len", "want").alias("length"), F.col("dim").isNotNull().alias("shared"))


@query("SELECT length, name FROM (SELECT p_size AS length, min(p_name) AS name, count(DISTINCT p_name) AS n FROM part WHERE p_partkey % 7 = 0 GROUP BY p_size) WHERE n = 1")
def meta_dim_bylen(spark, d):
    """A second dimension is found by its length where exactly one dimension has that length."""
    p = table(spark, d, "part").where(F.col("p_partkey") % 7 == 0)
    return p.groupBy(F.col("p_size").alias("length")).agg(F.min("p_name").alias("name"), F.countDistinct("p_name").alias("n")).where("n = 1").select("length", "name")


@query("SELECT l_partkey AS dim, greatest(max(l_linenumber), any_value(p_size)) AS length FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_partkey")
def meta_dim_extend(spark, d):
    """A shared dimension grows to the longest variable that uses it."""
    used = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("dim")).agg(F.max("l_linenumber").alias("n"))
    p = table(spark, d, "part").select(F.col("p_partkey").alias("dim"), "p_size")
    return used.join(p, "dim").select("dim", F.greatest("n", "p_size").alias("length"))


@query("SELECT event_id AS owner, event_type AS att FROM events WHERE event_type NOT IN ('click', 'error')")
def meta_hide_atts(spark, d):
    hidden = spark.createDataFrame([("click",), ("error",), *((a,) for a in V.HIDDEN_ATTRIBUTES)], "att string")
    return table(spark, d, "events").select(F.col("event_id").alias("owner"), F.col("event_type").alias("att")).join(F.broadcast(hidden), "att", "left_anti").select("owner", "att")


@query(f"SELECT c_mktsegment AS typedef, CASE WHEN count(DISTINCT r_name) > 1 THEN '' WHEN count(DISTINCT n_name) > 1 THEN '/' || min(r_name) ELSE min(grp) END AS place FROM {TREE} GROUP BY c_mktsegment UNION ALL SELECT n_name, min(grp) FROM {TREE} GROUP BY n_name")
def meta_common_parent(spark, d):
    """The deepest group that holds every use of a typedef: the common prefix of the least and greatest path."""
    t = tree(spark, d)
    uses = t.select(F.col("c_mktsegment").alias("typedef"), "grp").union(t.select("n_name", "grp"))
    ends = uses.groupBy("typedef").agg(F.split(F.min("grp"), "/").alias("a"), F.split(F.max("grp"), "/").alias("b"))
    same = F.filter(F.sequence(F.lit(1), F.size("a")), lambda k: F.slice(F.col("a"), F.lit(1), k) == F.slice(F.col("b"), F.lit(1), k))
    return ends.select("typedef", F.array_join(F.slice("a", F.lit(1), F.size(same)), "/").alias("place"))


@query("SELECT n_name AS grp FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_suppkey % 3 = 0)")
def meta_empty_groups(spark, d):
    s = table(spark, d, "supplier").where(F.col("s_suppkey") % 3 == 0).select(F.col("s_nationkey").alias("n_nationkey"))
    return table(spark, d, "nation").join(s, "n_nationkey", "left_anti").select(F.col("n_name").alias("grp"))


@query("SELECT conv_id, turn, 'FileAnnotation.' || (row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC)) AS name FROM conversations")
def meta_annot(spark, d):
    w = Window.partitionBy("conv_id").orderBy(F.col("turn").desc())
    return table(spark, d, "conversations").select("conv_id", "turn", F.concat(F.lit("FileAnnotation."), F.row_number().over(w)).alias("name"))


@query("SELECT p_partkey AS var, p_name AS name FROM part WHERE p_partkey % 5 <> 0")
def meta_hide_vars(spark, d):
    title = F.when(F.col("p_partkey") % 5 == 0, F.concat(F.lit(V.NOT_A_VARIABLE), F.lit("         10"))).otherwise(F.concat(F.lit(V.NON_COORD), "p_name"))
    p = table(spark, d, "part").select(F.col("p_partkey").alias("var"), title.alias("t")).where(~F.col("t").startswith(V.NOT_A_VARIABLE))
    return p.select("var", F.regexp_replace("t", f"^{V.NON_COORD}", "").alias("name"))


@query("SELECT o_orderkey AS obj, CASE WHEN o_orderkey % 4 = 0 THEN 'group' WHEN o_orderkey % 4 = 1 THEN 'variable' WHEN o_orderkey % 4 = 2 THEN 'typedef' ELSE 'unknown' END AS kind FROM orders")
def meta_classify(spark, d):
    """Objects by their messages: group; datatype and layout: variable; datatype alone: typedef; else unknown."""
    k = F.col("o_orderkey") % 4
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("obj"), (k == 0).alias("g"), k.isin(1, 2).alias("t"), (k == 1).alias("l"))
    return o.select("obj", F.when(F.col("g"), "group").when(F.col("t") & F.col("l"), "variable").when(F.col("t"), "typedef").otherwise("unknown").alias("kind"))


@query("SELECT p_partkey AS dim, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_name END AS name, CAST(p_size AS BIGINT) AS length FROM part")
def meta_fake_dims(spark, d):
    name = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("fakeDim"), "p_partkey")).otherwise(F.col("p_name"))
    p = table(spark, d, "part").select(F.col("p_partkey").alias("dim"), name.alias("name"), F.col("p_size").cast("long").alias("length"))
    return p.withColumn("name", F.when(F.col("name").startswith("fakeDim"), "").otherwise(F.col("name")))


@query("SELECT p_partkey AS vdata, p_partkey % 6 = 0 AS attribute FROM part WHERE p_partkey % 6 NOT IN (1, 2) AND p_size > 1")
def meta_vdata_filter(spark, d):
    """Vdata that become variables or attributes; dimension values, chunk tables and empty ones do not."""
    classes = F.array(*[F.lit(c) for c in ("Attr0.0", "DimVal0.1", "_HDF_CHK_TBL_0", "Data", "", "Ancillary_Data")])
    p = table(spark, d, "part").select(F.col("p_partkey").alias("vdata"), F.get(classes, (F.col("p_partkey") % 6).cast("int")).alias("class"), (F.col("p_size") - 1).alias("n"))
    return p.where(~F.col("class").startswith("DimVal") & ~F.col("class").startswith("_HDF_CHK_TBL") & (F.col("n") > 0)).select("vdata", F.col("class").startswith("Attr0.").alias("attribute"))


@query("SELECT CAST(n AS BIGINT) AS node, CAST(CASE WHEN n = 0 THEN 0 ELSE floor(ln(n + 1) / ln(2) + 1e-9) END AS BIGINT) AS depth FROM range(0, 25) t(n)")
def meta_tree(spark, d):
    """Hard links to a tree: breadth first from the root, links back to nodes already placed are dropped."""
    n = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("node"))
    links = n.where("node > 0").select(F.floor((F.col("node") - 1) / 2).alias("parent"), "node").union(n.select("node", F.lit(0).cast("long")))
    return breadth_first(links, n.where("node = 0"))


@query("SELECT doc_id AS att, length(text) > 4000 AS promoted FROM documents")
def att_promote(spark, d):
    """String attributes of more than 4000 characters become variables."""
    return table(spark, d, "documents").select(F.col("doc_id").alias("att"), (F.length("text") > 4000).alias("promoted"))


@query("SELECT r_name AS grp, '  dimensions:' || chr(10) || string_agg('    ' || n_name || ' = ' || (n_nationkey + 1) || ' ;', chr(10) ORDER BY n_name) AS cdl FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_name")
def cdl_dump(spark, d):
    """Dimension sections of a text dump, sorted by name."""
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    line = F.concat(F.lit("    "), "n_name", F.lit(" = "), (F.col("n_nationkey") + 1).cast("string"), F.lit(" ;"))
    return n.groupBy(F.col("r_name").alias("grp")).agg(F.concat(F.lit("  dimensions:\n"), F.array_join(F.sort_array(F.collect_list(line)), "\n")).alias("cdl"))


@query("SELECT DISTINCT s_nationkey AS required FROM supplier WHERE s_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_nationkey % 3 = 0)")
def odl_missing_dims(spark, d):
    need = table(spark, d, "supplier").select(F.col("s_nationkey").alias("required"))
    found = table(spark, d, "nation").where(F.col("n_nationkey") % 3 == 0).select("n_nationkey")
    return need.exceptAll(need.where("false")).distinct().join(found, F.col("required") == F.col("n_nationkey"), "left_anti")


@query("""SELECT doc_id, line, sum(step) OVER (PARTITION BY doc_id ORDER BY line) AS depth FROM (
SELECT doc_id, line, CASE line % 4 WHEN 0 THEN 1 WHEN 3 THEN -1 ELSE 0 END AS step FROM (SELECT doc_id, unnest(range(0, len(string_split(text, chr(10))))) AS line FROM documents))""")
def odl_lines(spark, d):
    """Nesting depth of GROUP and END_GROUP lines by a running sum."""
    kinds = F.array(F.lit("GROUP=A"), F.lit("X=1"), F.lit("Y=2"), F.lit("END_GROUP=A"))
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "raw")).select("doc_id", F.col("line").cast("long").alias("line"), F.get(kinds, F.col("line") % 4).alias("odl"))
    step = F.when(F.col("odl").startswith("GROUP"), 1).when(F.col("odl").startswith("END_GROUP"), -1).otherwise(0)
    return lines.select("doc_id", "line", F.sum(step).over(Window.partitionBy("doc_id").orderBy("line")).alias("depth"))


@query("SELECT page_id, url FROM pages WHERE (ends_with(url, 'top') OR ends_with(url, 'x')) AND NOT ends_with(url, '.html')")
def file_filter(spark, d):
    """Name filters: any of the included suffixes and none of the skipped."""
    u = F.col("url")
    return table(spark, d, "pages").where((u.endswith("top") | u.endswith("x")) & ~u.endswith(".html")).select("page_id", "url")


@query("SELECT o_orderkey AS k, CASE o_orderkey % 6 WHEN 0 THEN 'netcdf3' WHEN 1 THEN 'netcdf3.2' WHEN 2 THEN 'netcdf3.5' WHEN 3 THEN 'hdf5' WHEN 4 THEN 'hdf4' END AS format FROM orders")
def fmt_sniff(spark, d):
    """File formats by the first bytes of the content."""
    from tessella.sources.sniff import MAGIC, format_column

    heads = F.array(*[F.unhex(F.lit((m + b"\0\0\0\0").hex())) for _, m in MAGIC], F.unhex(F.lit("00112233445566778899")))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), format_column(F.get(heads, (F.col("o_orderkey") % 6).cast("int"))).alias("format"))
