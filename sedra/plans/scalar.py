"""Queries of typed arithmetic, strings, dates, arrays, JSON and row transforms."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import transforms as t
from ..functions import typed
from ..sources.store import printed
from .registry import query


@query("""SELECT p_partkey, (p_size + 7)::INT AS a, (p_size - 7)::INT AS b, (p_size * 7)::INT AS c, (p_size // 7)::INT AS d, round(p_retailprice / 7, 6) AS e, (p_partkey // p_size)::BIGINT AS f FROM part""")
def arith_matrix(table):
    """Results have the left type."""
    size, key, price, seven = F.col("p_size"), F.col("p_partkey"), F.col("p_retailprice"), F.lit(7)
    four = {n: typed.arith(size, op, seven, "int") for n, op in zip("abcd", "+-*/")}
    return table("part").select("p_partkey", *[c.alias(n) for n, c in four.items()], F.round(typed.arith(price, "/", seven, "double"), 6).alias("e"), typed.arith(key, "/", size, "bigint").alias("f"))


@query("""SELECT p_partkey, (p_size % 7)::INT AS rest, (p_size + 1)::INT AS up, (p_size - 1)::INT AS down, (p_size + p_partkey)::INT AS added, (p_size * 3)::INT AS times, (p_partkey % p_size)::BIGINT AS own FROM part""")
def assign_matrix(table):
    """Remainder, ++, --, compound assignment and an operator of one's own."""
    ops, size, key = typed.Operators(), F.col("p_size"), F.col("p_partkey")
    ops.register("bigint", "rest", "int", lambda a, b: a % b)
    assigned = {"up": ("++", "int", None), "down": ("--", "int", None), "added": ("+=", "bigint", key), "times": ("*=", "int", F.lit(3))}
    out = {n: ops.assign("int", op, kind, size, b) for n, (op, kind, b) in assigned.items()}
    return table("part").select("p_partkey", ops.apply("int", "%", "int", size, F.lit(7)).alias("rest"), *[c.alias(n) for n, c in out.items()], ops.apply("bigint", "rest", "int", key, size).alias("own"))


@query("SELECT p_partkey, floor(sqrt(p_size))::INT AS r, round(sqrt(p_retailprice), 6) AS s FROM part")
def sqrt_trunc(table):
    return table("part").select("p_partkey", typed.root(F.col("p_size"), "int").alias("r"), F.round(typed.root(F.col("p_retailprice"), "double"), 6).alias("s"))


@query("SELECT l_orderkey, l_linenumber, trunc(l_quantity)::INT AS i, l_linenumber::DOUBLE AS d, l_linenumber::VARCHAR AS s, (l_linenumber > 3)::VARCHAR AS b, abs(trunc(l_extendedprice)::BIGINT) AS l FROM lineitem")
def cast_matrix(table):
    n = F.col("l_linenumber")
    return table("lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("int").alias("i"), n.cast("double").alias("d"), n.cast("string").alias("s"), (n > 3).cast("string").alias("b"), F.abs(F.col("l_extendedprice").cast("bigint")).alias("l"))


@query("SELECT p_partkey, CASE WHEN p_size < 25 THEN -1 WHEN p_size > 25 THEN 1 ELSE 0 END AS c FROM part")
def three_way(table):
    return table("part").select("p_partkey", typed.compare(F.col("p_size"), F.lit(25)).alias("c"))


@query("SELECT c_custkey, c_name || '/' || c_mktsegment AS joined, substr(c_name, 1, 4) AS head, length(c_name)::INT AS n, lower(c_mktsegment) AS low FROM customer")
def str_ops(table):
    return table("customer").select("c_custkey", F.concat("c_name", F.lit("/"), "c_mktsegment").alias("joined"), F.substring("c_name", 1, 4).alias("head"), F.length("c_name").alias("n"), F.lower("c_mktsegment").alias("low"))


@query("SELECT o_orderkey, day(o_orderdate)::INT AS d, month(o_orderdate)::INT AS m, year(o_orderdate)::INT AS y, make_date(year(o_orderdate), month(o_orderdate), 1) AS first FROM orders")
def date_parts(table):
    d = F.col("o_orderdate")
    return table("orders").select("o_orderkey", F.day(d).alias("d"), F.month(d).alias("m"), F.year(d).alias("y"), F.make_date(F.year(d), F.month(d), F.lit(1)).alias("first"))


@query("""SELECT event_id, hour(ts)::INT AS h, minute(ts)::INT AS m, second(ts)::INT AS s, date_trunc('second', ts) AS built, strptime(strftime(ts, '%Y/%m/%d %H-%M'), '%Y/%m/%d %H-%M') AS parsed FROM events""")
def ts_parts(table):
    """Times split, built from their parts, and parsed from text."""
    d = F.col("ts")
    built = F.make_timestamp_ntz(F.year(d), F.month(d), F.day(d), F.hour(d), F.minute(d), F.second(d))
    parsed = F.to_timestamp_ntz(F.date_format(d, "yyyy/MM/dd HH-mm"), F.lit("yyyy/MM/dd HH-mm"))
    return table("events").select("event_id", F.hour(d).alias("h"), F.minute(d).alias("m"), F.second(d).alias("s"), built.alias("built"), parsed.alias("parsed"))


@query("""SELECT c_custkey, CASE WHEN left(c_name, 12) < left(c_mktsegment, 12) THEN -1 WHEN left(c_name, 12) > left(c_mktsegment, 12) THEN 1 ELSE 0 END AS compared,
c_name || left(c_mktsegment, 3) AS appended, left(rpad(c_name, 25, '.'), 25) AS resized FROM customer""")
def str_more(table):
    """Comparison of the first n characters, appending n characters, resizing."""
    head = lambda c, n: F.substring(c, 1, n)
    return table("customer").select("c_custkey", typed.compare(head("c_name", 12), head("c_mktsegment", 12)).alias("compared"), F.concat("c_name", head("c_mktsegment", 3)).alias("appended"), F.rpad("c_name", 25, ".").alias("resized"))


@query("""SELECT o_orderkey, o_orderkey::VARCHAR::BIGINT AS n, o_totalprice::VARCHAR::DOUBLE AS d, strftime(o_orderdate, '%Y-%m-%d')::DATE AS day, try_cast(o_orderstatus AS INT) AS none FROM orders""")
def cast_text(table):
    """Text to numbers and dates; what can't be read is null."""
    text = lambda c: F.col(c).cast("string")
    return table("orders").select("o_orderkey", text("o_orderkey").cast("bigint").alias("n"), text("o_totalprice").cast("double").alias("d"), F.date_format("o_orderdate", "yyyy-MM-dd").cast("date").alias("day"), F.col("o_orderstatus").try_cast("int").alias("none"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%A, %B %-d, %Y') AS s, o_orderdate::DATE AS back FROM orders")
def date_format(table):
    """Written with a pattern, and parsed again."""
    day = F.to_date(F.date_format("o_orderdate", "yyyy/MM/dd"), "yyyy/MM/dd")
    return table("orders").select("o_orderkey", F.date_format("o_orderdate", "EEEE, MMMM d, yyyy").alias("s"), day.alias("back"))


@query("SELECT o_orderkey, (o_orderdate::DATE - DATE '1970-01-01' + 2440588)::INT AS jdn, o_orderdate::DATE AS back FROM orders")
def julian_day(table):
    jdn = typed.julian_day(F.col("o_orderdate"))
    return table("orders").select("o_orderkey", jdn.alias("jdn"), typed.from_julian_day(jdn).alias("back"))


@query("SELECT vec_id, len(embedding)::INT AS n, embedding[3] AS third, len(list_append(embedding, 1.5))::INT AS more FROM embeddings")
def array_ops(table):
    return table("embeddings").select("vec_id", F.size("embedding").alias("n"), F.element_at("embedding", 3).alias("third"), F.size(F.array_append("embedding", F.lit(1.5).cast("float"))).alias("more"))


@query("""SELECT vec_id, CASE WHEN embedding < list_reverse(embedding) THEN -1 WHEN embedding > list_reverse(embedding) THEN 1 ELSE 0 END AS compared, len(embedding[:-2])::INT AS popped, embedding[2:4][3] AS sliced FROM embeddings""")
def array_more(table):
    """Arrays compared, without their last element, and sliced."""
    e = F.col("embedding")
    return table("embeddings").select("vec_id", typed.compare(e, F.reverse(e)).alias("compared"), F.size(F.slice(e, 1, F.size(e) - 1)).alias("popped"), F.element_at(F.slice(e, 2, 3), 3).alias("sliced"))


_LIST = "'[' || event_id || ',{\"u\":' || user_id || '},\"' || event_type || '\"]'"


@query(f"SELECT event_id, json_array_length({_LIST})::INT AS n, json_extract_string({_LIST}, '$[2]') AS third, json_extract_string({_LIST}, '$[1].u')::BIGINT AS inner_ FROM events")
def json_array(table):
    """The length of a JSON array, and values by index."""
    text = F.concat(F.lit("["), "event_id", F.lit(',{"u":'), "user_id", F.lit('},"'), "event_type", F.lit('"]'))
    return table("events").select("event_id", F.json_array_length(text).alias("n"), F.get_json_object(text, "$[2]").alias("third"), F.get_json_object(text, "$[1].u").cast("bigint").alias("inner_"))


@query(f"""SELECT event_id, CASE json_type({_LIST}, '$[' || (event_id % 4) || ']') WHEN 'VARCHAR' THEN 'text' WHEN 'OBJECT' THEN 'object' WHEN 'UBIGINT' THEN 'number' ELSE 'none' END AS kind FROM events""")
def json_kind(table):
    """The type of what a path made at run time leads to."""
    text = F.concat(F.lit("["), "event_id", F.lit(',{"u":'), "user_id", F.lit('},"'), "event_type", F.lit('"]'))
    found = F.try_variant_get(F.parse_json(text), F.concat(F.lit("$["), F.col("event_id") % 4, F.lit("]")), "variant")
    kind = F.schema_of_variant(found)
    return table("events").select("event_id", F.when(kind == "STRING", "text").when(kind.startswith("OBJECT"), "object").when(kind == "BIGINT", "number").otherwise("none").alias("kind"))


@query("SELECT event_id, len(json_keys(props))::INT AS n, array_to_string(list_sort(json_keys(props)), ',') AS keys FROM events")
def json_keys(table):
    keys = F.json_object_keys("props")
    return table("events").select("event_id", F.size(keys).alias("n"), F.array_join(F.sort_array(keys), ",").alias("keys"))


@query("SELECT event_id, json_extract_string(props, '$.' || json_keys(props)[1]) AS first FROM events")
def json_get(table):
    """The value of the first key, by a path made at run time."""
    return table("events").select("event_id", F.try_variant_get(F.parse_json("props"), F.concat(F.lit("$."), F.get(F.json_object_keys("props"), F.lit(0))), "string").alias("first"))


@query("SELECT c_custkey, c_name, c_nationkey, c_acctbal FROM customer")
def json_roundtrip(table):
    """Rows to JSON text and back."""
    rows = table("customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal")
    return rows.select(F.from_json(F.to_json(F.struct("*")), rows.schema).alias("r")).select("r.*")


@query("SELECT event_id, 500 AS v FROM events")
def pc_default(table):
    return table("events").select("event_id", t.default_value(F.col("value"), 500).alias("v"))


@query("SELECT event_id, coalesce(CASE WHEN value > 50 THEN value END, -1.0) AS v FROM events")
def pc_default_null(table):
    return table("events").select("event_id", t.default_value(F.when(F.col("value") > 50, F.col("value")), -1.0, True).alias("v"))


@query("SELECT p_partkey, round((p_size - 1) / 49.0, 6) AS v FROM part")
def pc_minmax(table):
    return table("part").select("p_partkey", F.round(t.min_max(F.col("p_size"), 1, 50), 6).alias("v"))


@query("SELECT event_id, (row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) + 9)::INT AS v FROM events")
def pc_sequence(table):
    return table("events").select("event_id", t.sequence([F.col("ts"), F.col("event_id")], 10, [F.col("event_type")]).alias("v"))


@query("""SELECT event_id, date_trunc('week', ts)::DATE AS week_start, date_trunc('quarter', ts)::DATE AS quarter_start, (dayofweek(ts) + 1)::INT AS day_of_week, dayofyear(ts)::INT AS day_of_year, weekofyear(ts)::INT AS week, quarter(ts)::INT AS quarter FROM events""")
def pc_date_units(table):
    units = ("day_of_week", "day_of_year", "week", "quarter")
    return table("events").select("event_id", t.date_bucket(F.col("ts"), "week").alias("week_start"), t.date_bucket(F.col("ts"), "quarter").alias("quarter_start"), *[t.DATE_UNITS[u](F.col("ts")).alias(u) for u in units])


@query("SELECT p_partkey, p_size * 2 AS twice, p_size * 2 + 1 AS more FROM part")
def preptup_chain(table):
    """A later column reads an earlier target."""
    return t.chain(table("part"), [("twice", F.col("p_size") * 2), ("more", F.col("twice") + 1)], ["p_partkey"])


@query("SELECT strftime(o_orderdate, '%Y.%m.%d') || ' ' || o_orderkey || ' ' || coalesce(CASE WHEN o_custkey % 2 = 0 THEN o_orderstatus END, '') AS line FROM orders")
def print_rows(table):
    """Rows as text; nulls are empty."""
    rows = table("orders").select("o_orderdate", "o_orderkey", F.when(F.col("o_custkey") % 2 == 0, F.col("o_orderstatus")).alias("s"))
    return printed(rows, {"o_orderdate": "yyyy.MM.dd"}, " ")
