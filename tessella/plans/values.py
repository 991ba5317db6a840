"""Values: conversions, comparison, aggregation, compound and variable-length data."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.functions import convert as V
from tessella.operators import cells as C
from tessella.plans.algebra import EMB, embedding
from tessella.plans.registry import query
from tessella.runtime import table

# aggregation and comparison

@query("SELECT event_type, round(sum(CASE WHEN isfinite(value) THEN value END), 3) AS total, count(*) AS n FROM events GROUP BY event_type")
def agg_sum_finite(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.round(C.finite_sum(F.col("value")), 3).alias("total"), F.count(F.lit(1)).alias("n"))


@query("SELECT event_type, user_id % 5 AS stat, count(*) AS calls, CAST(sum(event_id % 1000) AS BIGINT) AS ns, round(CAST(sum(event_id % 1000) AS DOUBLE) / count(*), 6) AS per_call FROM events GROUP BY ROLLUP (event_type, user_id % 5)")
def stat_rollup(spark, d):
    """Timing statistics by (stats, stat) with total rows, the longest time first."""
    e = table(spark, d, "events").withColumn("stat", F.col("user_id") % 5).withColumn("t", F.col("event_id") % 1000)
    return e.rollup("event_type", "stat").agg(F.count(F.lit(1)).alias("calls"), F.sum("t").alias("ns"), F.round(F.sum("t") / F.count(F.lit(1)), 6).alias("per_call")).orderBy(F.col("ns").desc(), "event_type", "stat")


@query("SELECT source || ':' || lang AS type, count(*) AS n FROM documents GROUP BY 1")
def cat_count_by_type(spark, d):
    return table(spark, d, "documents").groupBy(F.concat_ws(":", "source", "lang").alias("type")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT p_name AS name, count(*) AS n FROM part GROUP BY p_name HAVING count(*) > 1")
def dup_names(spark, d):
    return table(spark, d, "part").groupBy(F.col("p_name").alias("name")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


PAIRS = f"(SELECT a.d0, a.d1, a.value AS x, b.value AS y FROM {EMB} a JOIN {EMB} b ON a.d0 + 1 = b.d0 AND a.d1 = b.d1)"


def neighbours(spark, d):
    """Each vector's cells, and the next vector's under the same indices."""
    e = embedding(spark, d)
    return e, e.select((F.col("d0") - 1).alias("d0"), "d1", "value")


@query(f"SELECT d0, count(*) FILTER (x IS DISTINCT FROM y) AS n_diff FROM {PAIRS} GROUP BY d0")
def arr_count_diff(spark, d):
    return C.count_diff(*neighbours(spark, d), ["d0", "d1"], ("d0",), "inner")


@query(f"SELECT d0, bool_and(x IS NOT DISTINCT FROM y) AS equal FROM {PAIRS} GROUP BY d0")
def arr_equal(spark, d):
    return C.arrays_equal(*neighbours(spark, d), ["d0", "d1"], ("d0",), "inner")


@query("SELECT p_partkey AS k, CASE WHEN greatest(abs(p_retailprice), abs(p_size * 45.0)) < 1e-8 THEN abs(p_retailprice - p_size * 45.0) < 1e-8 ELSE abs(p_retailprice - p_size * 45.0) / greatest(abs(p_retailprice), abs(p_size * 45.0)) < 0.05 END AS near FROM part")
def near_equal(spark, d):
    a, b = F.col("p_retailprice"), F.col("p_size") * F.lit(45.0)
    return table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.when(F.greatest(F.abs(a), F.abs(b)) < 1e-8, F.abs(a - b) < 1e-8).otherwise(C.near_equal(a, b, 0.05)).alias("near"))


# enums and text

@query("SELECT n_nationkey AS k, CASE n_regionkey WHEN 0 THEN 'AF' WHEN 1 THEN 'AM' WHEN 2 THEN 'AS' WHEN 3 THEN 'EU' ELSE 'Unknown enum number=' || n_regionkey END AS label FROM nation")
def enum_convert(spark, d):
    return table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), V.convert_enums(F.col("n_regionkey"), {0: "AF", 1: "AM", 2: "AS", 3: "EU"}).alias("label"))


def char_cells(df, key: str, text: str, width: int):
    """A CHAR(key, width) variable: a byte per cell, NUL padded."""
    code = F.transform(F.sequence(F.lit(1), F.lit(width)), lambda i: F.ascii(F.substring(F.col(text), i, F.lit(1))))
    return df.select(F.col(key).alias("d0"), F.posexplode(code).alias("d1", "value"))


def rows_to_strings(cells):
    packed = F.sort_array(F.collect_list(F.struct("d1", "value")))
    return cells.groupBy("d0").agg(packed.alias("p")).select("d0", V.bytes_to_string(F.transform("p", lambda x: x["value"])).alias("value"))


@query("SELECT n_nationkey AS d0, n_name AS value FROM nation")
def char_rows_to_strings(spark, d):
    return rows_to_strings(char_cells(table(spark, d, "nation"), "n_nationkey", "n_name", 24))


@query("SELECT string_agg(r_name, '' ORDER BY r_regionkey) AS value FROM region")
def char_to_string(spark, d):
    """All dimensions of a CHAR variable without padding collapse into one string."""
    cells = table(spark, d, "region").select("r_regionkey", F.posexplode(F.transform(F.split("r_name", ""), lambda c: F.ascii(c))).alias("d1", "value")).where("value > 0")
    packed = F.sort_array(F.collect_list(F.struct("r_regionkey", "d1", "value")))
    return cells.agg(packed.alias("p")).select(V.bytes_to_string(F.transform("p", lambda x: x["value"])).alias("value"))


@query("SELECT c_custkey AS k, c_name AS value FROM customer")
def str_z(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("k"), V.string_z(F.concat("c_name", F.lit("\0junk"))).alias("value"))


@query(r"SELECT p_partkey AS k, regexp_replace(replace(replace(replace(p_name || '/' || p_type, '/', '_'), ' ', '_'), ',', '_'), '[\x00-\x1f]', '', 'g') AS value FROM part")
def name_valid(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("k"), V.valid_name(F.concat(F.lit(" \x02"), "p_name", F.lit("/"), "p_type", F.lit("\n "))).alias("value"))


@query(r"SELECT page_id AS k, replace(replace(url, '\', '\\'), '.', '\.') AS value FROM pages")
def name_escape(spark, d):
    return table(spark, d, "pages").select(F.col("page_id").alias("k"), V.backslash_escape(F.col("url")).alias("value"))


@query("SELECT page_id AS k, url AS value FROM pages")
def name_unescape(spark, d):
    return table(spark, d, "pages").select(F.col("page_id").alias("k"), V.backslash_unescape(V.backslash_escape(F.col("url"))).alias("value"))


@query(r"""SELECT doc_id AS k, md5(replace(replace(replace(CASE WHEN contains(text, '\') THEN replace(a, '\', '\\') ELSE a END, '''', '\'''), '"', '\"'), '', '')) AS value
FROM (SELECT doc_id, text, replace(replace(replace(text, chr(10), '\n'), chr(13), '\r'), chr(9), '\t') AS a FROM documents)""")
def cdl_escape(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("k"), F.md5(V.escape_cdl(F.col("text"))).alias("value"))


@query("SELECT c_custkey AS k, '0X' || hex(c_name) AS value FROM customer")
def opaque_hex(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("k"), V.hex_text(F.encode("c_name", "UTF-8")).alias("value"))


@query("""SELECT p_partkey AS k, CASE WHEN length(w) >= 5 THEN w ELSE w || '.' || substr(f, 1, 5 - length(w)) END AS value
FROM (SELECT p_partkey, split_part(t, '.', 1) AS w, split_part(t, '.', 2) AS f FROM (SELECT p_partkey, CAST(CAST(p_retailprice AS DECIMAL(30, 10)) AS VARCHAR) AS t FROM part))""")
def sig_fig(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("k"), V.sig_fig(F.col("p_retailprice"), 5).alias("value"))


@query("SELECT n_nationkey AS k, n_nationkey % 5 < 3 AS is_meta FROM nation")
def eos_is_meta(spark, d):
    names = F.array(F.lit("StructMetadata.0"), F.lit("coremetadata"), F.lit("SwathStructure_1"), F.lit("Data"), F.lit("Metadata"))
    return table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), V.is_eos_metadata(F.get(names, F.col("n_nationkey") % 5)).alias("is_meta"))


@query("SELECT o_custkey AS k, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) AS value FROM orders GROUP BY o_custkey")
def arr_show(spark, d):
    packed = F.sort_array(F.collect_list("o_orderkey"))
    return table(spark, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.array_join(packed, ",").alias("value"))


@query("SELECT n_nationkey AS k, CASE n_nationkey % 5 WHEN 0 THEN 'ubyte' WHEN 1 THEN 'ushort' WHEN 2 THEN 'uint' WHEN 3 THEN 'uint64' ELSE 'double' END AS value FROM nation")
def type_signedness(spark, d):
    kinds = ["byte", "short", "int", "int64", "double"]
    table_ = F.array(*[F.lit(V.with_signedness(k, False)) for k in kinds])
    return table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.get(table_, F.col("n_nationkey") % 5).alias("value"))


# numbers and bits

@query("SELECT o_orderkey AS k, o_orderkey % 256 AS u1, o_orderkey % 65536 AS u2 FROM orders")
def u_widen(spark, d):
    k = F.col("o_orderkey")
    signed = lambda bits: (k % (1 << bits)) - F.when(k % (1 << bits) >= 1 << bits - 1, 1 << bits).otherwise(0)
    return table(spark, d, "orders").select(k.alias("k"), V.unsigned(signed(8).cast("byte"), 8).alias("u1"), V.unsigned(signed(16).cast("short"), 16).alias("u2"))


@query("SELECT o_orderkey AS k, CAST(CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey ELSE 18446744073709551616 - o_orderkey END AS VARCHAR) AS value FROM orders")
def u_widen_neg(spark, d):
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select(k.alias("k"), V.unsigned(F.when(k % 2 == 0, k).otherwise(-k), 64).cast("string").alias("value"))


@query("SELECT o_orderkey AS k, CAST(length(bin(o_orderkey + 1)) - 1 AS BIGINT) AS value FROM orders")
def log2_floor(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), V.log2_floor(F.col("o_orderkey") + 1).alias("value"))


@query("SELECT o_orderkey AS k, (o_orderkey >> 3) & 1 = 1 AS b3, (o_orderkey >> 10) & 1 = 1 AS b10 FROM orders")
def bit_set(spark, d):
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select(k.alias("k"), V.bit_set(k, 3).alias("b3"), V.bit_set(k, 10).alias("b10"))


@query("SELECT o_orderkey AS k, (4 - o_orderkey % 4) % 4 AS pad FROM orders")
def pad4(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), V.padding(F.col("o_orderkey")).alias("pad"))


@query("SELECT p_partkey AS k, ((p_partkey * 7) & 16383) * 65536 + (p_partkey & 65535) AS tag, (p_partkey * 7) & 16383 AS code, p_partkey & 65535 AS ref FROM part")
def tag_pack(spark, d):
    tag = V.tag_id(F.col("p_partkey") * 7, F.col("p_partkey"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("k"), tag.alias("tag"), F.shiftright(tag, 16).alias("code"), tag.bitwiseAND(0xFFFF).alias("ref"))


@query("SELECT o_orderkey AS k, o_orderkey AS value, CASE WHEN o_orderkey < 256 THEN 1 WHEN o_orderkey < 65536 THEN 2 ELSE 4 END AS width FROM orders")
def varint_le(spark, d):
    k = F.col("o_orderkey")
    data = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda b: F.floor(k / F.pow(F.lit(256.0), b)).cast("long").bitwiseAND(255))
    width = F.when(k < 256, 1).when(k < 65536, 2).otherwise(4)
    return table(spark, d, "orders").select(k.alias("k"), V.little_endian(data).alias("value"), width.alias("width"))


@query("""SELECT o_orderkey AS k, (CASE WHEN o_orderkey & 1 <> 0 THEN 'NC_WRITE ' ELSE '' END) || (CASE WHEN o_orderkey & 8 <> 0 THEN 'NC_DISKLESS ' ELSE '' END)
|| (CASE WHEN o_orderkey & 16 <> 0 THEN 'NC_MMAP ' ELSE '' END) || (CASE WHEN o_orderkey & 32 <> 0 THEN 'NC_64BIT_DATA ' ELSE '' END)
|| (CASE WHEN o_orderkey & 64 <> 0 THEN 'NC_UDF0 ' ELSE '' END) || (CASE WHEN o_orderkey & 128 <> 0 THEN 'NC_UDF1 ' ELSE '' END)
|| (CASE WHEN o_orderkey & 256 <> 0 THEN 'NC_CLASSIC_MODEL ' ELSE '' END) || (CASE WHEN o_orderkey & 512 <> 0 THEN 'NC_64BIT_OFFSET ' ELSE '' END)
|| (CASE WHEN o_orderkey & 4096 <> 0 THEN 'NC_NETCDF4 ' ELSE '' END) || (CASE WHEN o_orderkey & 131072 <> 0 THEN 'NC_NOATTCREORD ' ELSE '' END)
|| (CASE WHEN o_orderkey & 262144 <> 0 THEN 'NC_NODIMSCALE_ATTACH ' ELSE '' END) AS value FROM orders""")
def fmt_mode_bits(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), V.mode_text(F.col("o_orderkey")).alias("value"))


@query("SELECT o_orderkey // 4 AS grp, min(o_custkey) AS least, CAST(sum(o_custkey) AS BIGINT) AS total FROM orders GROUP BY 1")
def flt_unshuffle(spark, d):
    """Four customer keys an array, shuffled into byte planes and back."""
    o = table(spark, d, "orders").groupBy(F.floor(F.col("o_orderkey") / 4).alias("grp")).agg(F.sort_array(F.collect_list("o_custkey")).alias("v"))
    m = F.size("v")
    planes = F.transform(F.sequence(F.lit(0), m * 4 - 1), lambda i: F.floor(F.get(F.col("v"), i % m) / F.pow(F.lit(256.0), F.floor(i / m))).cast("long").bitwiseAND(255))
    back = V.unshuffle(F.col("planes"), 4)
    values = F.transform(F.sequence(F.lit(0), F.size("v") - 1), lambda k: V.little_endian(F.slice(F.col("raw"), k * 4 + 1, F.lit(4))))
    out = o.withColumn("planes", planes).withColumn("raw", back).withColumn("out", values)
    return out.select("grp", F.array_min("out").alias("least"), F.aggregate("out", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


# compound, variable-length and opaque values

ITEMS = "(SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) - 1 AS pos FROM lineitem)"


def records(spark, d):
    """A compound array per order, members in line order."""
    li = table(spark, d, "lineitem")
    member = F.struct(F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp"), F.col("l_quantity").alias("qty"), F.col("l_extendedprice").alias("price"), F.col("l_shipdate").alias("ship"))
    return li.groupBy(F.col("l_orderkey").alias("k")).agg(F.sort_array(F.collect_list(member)).alias("data"))


@query(f"SELECT l_orderkey AS k, pos, l_linenumber AS line, l_partkey AS part, l_quantity AS qty FROM {ITEMS}")
def cmp_build(spark, d):
    return records(spark, d).select("k", F.posexplode("data").alias("pos", "r")).select("k", F.col("pos").cast("long").alias("pos"), "r.line", "r.part", "r.qty")


@query(f"SELECT l_orderkey AS k, count(*) AS n, CAST(sum(l_partkey) AS BIGINT) AS parts, max(l_quantity) AS most FROM {ITEMS} GROUP BY l_orderkey")
def cmp_member(spark, d):
    r = records(spark, d).select("k", F.col("data.part").alias("part"), F.col("data.qty").alias("qty"))
    return r.select("k", F.size("part").cast("long").alias("n"), F.aggregate("part", F.lit(0).cast("long"), lambda a, x: a + x).alias("parts"), F.array_max("qty").alias("most"))


@query("SELECT o_orderkey AS k, CASE o_orderstatus WHEN 'F' THEN 'final' WHEN 'O' THEN 'open' ELSE 'partial' END AS status, c_name AS customer, c_mktsegment AS segment FROM orders JOIN customer ON o_custkey = c_custkey")
def cmp_nested(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.struct(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment")).alias("customer"))
    status = F.when(F.col("o_orderstatus") == "F", "final").when(F.col("o_orderstatus") == "O", "open").otherwise("partial")
    r = table(spark, d, "orders").join(c, "o_custkey").select(F.struct(F.col("o_orderkey").alias("k"), status.alias("status"), "customer").alias("r"))
    return r.select("r.k", "r.status", F.col("r.customer.name").alias("customer"), "r.customer.segment")


@query(f"SELECT l_orderkey AS k, count(*) FILTER (l_quantity > 25) AS large, string_agg('P' || l_partkey, ',' ORDER BY pos) AS names FROM {ITEMS} GROUP BY l_orderkey")
def cmp_vlen_member(spark, d):
    r = records(spark, d).select("k", F.struct(F.transform("data", lambda x: F.concat(F.lit("P"), x["part"])).alias("names"), F.col("data.qty").alias("qty")).alias("s"))
    return r.select("k", F.size(F.filter("s.qty", lambda q: q > 25)).cast("long").alias("large"), F.array_join("s.names", ",").alias("names"))


@query("SELECT o_custkey AS k, count(*) AS n, min(o_orderkey) AS lo, max(o_orderkey) AS hi FROM orders GROUP BY o_custkey")
def vlen_build(spark, d):
    v = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.sort_array(F.collect_list("o_orderkey")).alias("v"))
    return v.select("k", F.size("v").cast("long").alias("n"), F.col("v")[0].alias("lo"), F.element_at("v", -1).alias("hi"))


@query("""SELECT a.k, a.v IS NOT DISTINCT FROM b.v AS equal FROM (SELECT conv_id AS k, string_agg(role, ',' ORDER BY turn) AS v FROM conversations GROUP BY conv_id) a
JOIN (SELECT conv_id - 1 AS k, string_agg(role, ',' ORDER BY turn) AS v FROM conversations GROUP BY conv_id) b ON a.k = b.k""")
def vlen_equal(spark, d):
    v = table(spark, d, "conversations").groupBy(F.col("conv_id").alias("k")).agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]).alias("v"))
    return v.join(v.select((F.col("k") - 1).alias("k"), F.col("v").alias("w")), "k").select("k", F.col("v").eqNullSafe(F.col("w")).alias("equal"))


@query("SELECT c_custkey AS k, i AS elem, hex(substr(c_name, CAST(i * 6 + 1 AS BIGINT), 6)) AS value FROM customer, range(0, 3) t(i)")
def opaque_elem(spark, d):
    """Elements of 6 bytes cut from an opaque buffer."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.encode("c_name", "UTF-8").alias("data"))
    return c.select("k", "data", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("elem")).select("k", F.col("elem").cast("long").alias("elem"), F.hex(F.substring("data", F.col("elem") * 6 + 1, F.lit(6))).alias("value"))


@query("SELECT o_orderkey AS k, o_totalprice - lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS step FROM orders")
def odometer_step(spark, d):
    """Difference to the element before within a customer's variable-length list."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), (F.col("o_totalprice") - F.lag("o_totalprice").over(w)).alias("step"))
