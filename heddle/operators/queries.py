"""The operators as queries over the test tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.functions import hashing, numbers
from heddle.operators import history, indexes, queues, reads, topics, writes
from heddle.operators.read_sequence import From, Node, Template, mapped, read_sequence
from heddle.operators.reads import Relation
from heddle.plans import expressions as E
from heddle.plans.columns import Compiler

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None):
    def register(function):
        QUERIES[name] = function
        if sql:
            SQL[name] = sql
        return function

    return register


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def orders_of(spark, d) -> Relation:
    return Relation(t(spark, d, "orders"), "o_custkey", "o_orderkey")


def sparse(df: DataFrame) -> DataFrame:
    """Orders with a sparse attribute."""
    return df.withColumn("note", F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderpriority")))


SPARSE = "(SELECT *, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority END AS note FROM orders)"
N = lambda x: {"N": str(x)}
S = lambda x: {"S": x}


# -- reads --------------------------------------------------------------------------------------


@query(
    "flagship",
    """SELECT o_orderkey, o_totalprice, o_orderstatus FROM (SELECT * FROM orders WHERE o_custkey = 10 AND o_orderkey BETWEEN 1 AND 100000 ORDER BY o_orderkey LIMIT 20)
       WHERE o_totalprice > 1000 AND o_orderstatus <> 'P'""",
)
def flagship(spark, d):
    return reads.query(
        orders_of(spark, d), "o_custkey = :c AND o_orderkey BETWEEN :a AND :b", bound={":c": N(10), ":a": N(1), ":b": N(100000), ":p": N(1000), ":s": S("P")},
        filter="o_totalprice > :p AND #s <> :s", names={"#s": "o_orderstatus"}, projection="o_orderkey, o_totalprice, #s", limit=20,
    ).rows()


@query("s1_get_item", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey = 7")
def get_item(spark, d):
    return reads.get_item(Relation(t(spark, d, "orders"), "o_orderkey"), {"o_orderkey": 7}, [("o_orderkey",), ("o_custkey",), ("o_totalprice",)])


@query("s3_transact_get", "SELECT o.o_orderkey AS ordinal, o.o_custkey * 2 AS c_custkey, c.c_name, c.c_acctbal FROM orders o LEFT JOIN customer c ON c.c_custkey = o.o_custkey * 2 WHERE o.o_orderkey <= 100")
def transact_get(spark, d):
    keys = t(spark, d, "orders").where("o_orderkey <= 100").select(F.col("o_orderkey").alias("ordinal"), (F.col("o_custkey") * 2).alias("c_custkey"))
    return reads.transact_get(Relation(t(spark, d, "customer"), "c_custkey"), keys).select("ordinal", "c_custkey", "c_name", "c_acctbal")


@query("s4_query_descending", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = 10 ORDER BY o_orderkey DESC LIMIT 5")
def query_descending(spark, d):
    return reads.query(orders_of(spark, d), "o_custkey = :c", bound={":c": N(10)}, forward=False, limit=5).rows().select("o_orderkey", "o_totalprice")


@query("s5_query_index", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_custkey = 10 AND o_orderdate >= TIMESTAMP '1995-01-01' ORDER BY o_orderdate, o_orderkey LIMIT 50")
def query_index(spark, d):
    index = indexes.index(Relation(t(spark, d, "orders"), "o_orderkey"), "o_custkey", "o_orderdate", "INCLUDE", ("o_totalprice",))
    return reads.query(index, "o_custkey = :c AND o_orderdate >= :d", bound={":c": N(10), ":d": S("1995-01-01 00:00:00")}, limit=50).rows().select("o_orderkey", "o_orderdate")


@query("s6_scan_filter", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE (l_quantity BETWEEN 10 AND 20 OR l_returnflag IN ('R', 'A')) AND NOT l_discount > 0.05")
def scan_filter(spark, d):
    table = Relation(t(spark, d, "lineitem"), "l_orderkey", "l_linenumber")
    bound = {":a": N(10), ":b": N(20), ":r": S("R"), ":s": S("A"), ":x": N("0.05")}
    return reads.whole_scan(table, "(l_quantity BETWEEN :a AND :b OR l_returnflag IN (:r, :s)) AND NOT l_discount > :x", bound=bound).select("l_orderkey", "l_linenumber", "l_quantity")


@query("s6_scan_page", "SELECT o_orderkey FROM (SELECT * FROM orders ORDER BY o_custkey, o_orderkey LIMIT 500) WHERE o_totalprice > 50000")
def scan_page(spark, d):
    return reads.scan(orders_of(spark, d), filter="o_totalprice > :p", bound={":p": N(50000)}, projection="o_orderkey", limit=500).rows()


@query("s8_source_page", "SELECT o_custkey, o_orderkey, o_totalprice FROM orders WHERE o_custkey = 10 AND o_orderkey > 100")
def source_page(spark, d):
    own = reads.query(orders_of(spark, d), "o_custkey = :c AND o_orderkey > :a", bound={":c": N(10), ":a": N(100)})
    return reads.source_page(own).select("key.o_custkey", "key.o_orderkey", "item.o_totalprice")


CONDITIONS = {
    "eq": ("o_orderstatus = :f", "o_orderstatus = 'F'"),
    "eq_number": ("o_custkey = :n", "o_custkey = 10"),
    "eq_other_type": ("o_custkey = :f", "FALSE"),
    "ne_missing": ("note <> :u", "coalesce(note <> '1-URGENT', TRUE)"),
    "less": ("o_totalprice < :p", "o_totalprice < 50000"),
    "reversed": (":p <= o_totalprice", "o_totalprice >= 50000"),
    "between": ("o_orderkey BETWEEN :n AND :m", "o_orderkey BETWEEN 10 AND 500"),
    "in_set": ("o_orderpriority IN (:u, :h)", "o_orderpriority IN ('1-URGENT', '2-HIGH')"),
    "exists": ("attribute_exists(note)", "note IS NOT NULL"),
    "not_exists": ("attribute_not_exists(note)", "note IS NULL"),
    "unknown": ("attribute_exists(nothing.at.all)", "FALSE"),
    "type": ("attribute_type(note, :tag)", "note IS NOT NULL"),
    "begins": ("begins_with(note, :d)", "coalesce(starts_with(note, '2'), FALSE)"),
    "contains": ("contains(note, :e)", "coalesce(contains(note, 'I'), FALSE)"),
    "size": ("size(note) > :eight", "coalesce(length(note) > 6, FALSE)"),
    "not_missing": ("NOT note = :u", "NOT coalesce(note = '1-URGENT', FALSE)"),
    "precedence": ("o_orderstatus = :f OR note = :u AND NOT o_totalprice < :p", "o_orderstatus = 'F' OR (coalesce(note = '1-URGENT', FALSE) AND NOT o_totalprice < 50000)"),
    "text_order": ("o_orderpriority > :three", "o_orderpriority > '3'"),
    "paths": ("o_custkey < o_orderkey", "o_custkey < o_orderkey"),
}
BOUND = {":f": S("F"), ":n": N(10), ":m": N(500), ":u": S("1-URGENT"), ":h": S("2-HIGH"), ":p": N("5e4"), ":tag": S("S"), ":d": S("2"), ":e": S("I"), ":eight": N(6), ":three": S("3")}


@query("p_conditions", f"SELECT o_orderkey, {', '.join(f'{sql} AS c_{name}' for name, (_, sql) in CONDITIONS.items())} FROM {SPARSE}")
def conditions(spark, d):
    own = sparse(t(spark, d, "orders"))
    compiler = Compiler(own.schema)
    return own.select("o_orderkey", *[compiler.condition(E.condition(text, bound=BOUND, whole=False)).alias(f"c_{name}") for name, (text, _) in CONDITIONS.items()])


@query("j3_count", "SELECT count(*) AS count FROM (SELECT * FROM orders WHERE o_custkey = 10 ORDER BY o_orderkey LIMIT 10) WHERE o_totalprice > 1000")
def count_select(spark, d):
    return reads.query(orders_of(spark, d), "o_custkey = :c", filter="o_totalprice > :p", bound={":c": N(10), ":p": N(1000)}, select="COUNT", limit=10).rows()


@query("j4_keys_only", f"SELECT note, o_orderkey FROM {SPARSE} WHERE note IS NOT NULL")
def keys_only(spark, d):
    return indexes.index(Relation(sparse(t(spark, d, "orders")), "o_orderkey"), "note", None, "KEYS_ONLY").items.select("note", "o_orderkey")


@query(
    "l4_byte_budget",
    """SELECT o_custkey, o_orderkey, page_bytes FROM (SELECT o_custkey, o_orderkey, CAST(sum(100 + o_orderkey % 50) OVER w AS BIGINT) AS page_bytes, row_number() OVER w AS n FROM orders
       WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING)) WHERE (page_bytes <= 600 OR n = 1) AND n <= 4""",
)
def byte_budget(spark, d):
    return reads.budgeted(orders_of(spark, d), F.lit(100) + F.col("o_orderkey") % 50, 600, 4).select("o_custkey", "o_orderkey", F.col("page_bytes").cast("long").alias("page_bytes"))


@query("l5_seek", "SELECT o_custkey, o_orderkey FROM orders WHERE (o_custkey, o_orderkey) > (50, 3000)")
def seek(spark, d):
    table = orders_of(spark, d)
    return table.items.where(reads.after(table, {"o_custkey": 50, "o_orderkey": 3000})).select("o_custkey", "o_orderkey")


@query("l7_capacity", "SELECT o_orderstatus, sum(greatest(1, ceil((o_orderkey % 20000) / 4096.0)) * 0.5) AS units FROM orders GROUP BY o_orderstatus")
def capacity(spark, d):
    return t(spark, d, "orders").groupBy("o_orderstatus").agg(F.sum(reads.capacity_units(F.col("o_orderkey") % 20000, False)).alias("units"))


@query("l8_billing", "SELECT event_type AS operation, count(*) AS calls, CAST(sum(event_id) AS BIGINT) AS bytes, sum(greatest(1, ceil(event_id / 4096.0)) * 1.0) AS units FROM events GROUP BY event_type")
def billing(spark, d):
    return reads.billing(t(spark, d, "events").select(F.col("event_type").alias("operation"), F.col("event_id").alias("bytes")))


# -- dependent reads --------------------------------------------------------------------------------


@query(
    "r1_read_sequence",
    """SELECT c_custkey, o_orderkey, o_totalprice FROM (SELECT c.c_custkey, o.o_orderkey, o.o_totalprice, row_number() OVER (PARTITION BY c.c_custkey ORDER BY o.o_orderkey) AS n
       FROM customer c JOIN orders o ON o.o_custkey = c.c_custkey WHERE c.c_nationkey = 3) WHERE n <= 3""",
)
def sequence(spark, d):
    customers = Relation(t(spark, d, "customer"), "c_nationkey", "c_custkey")
    nodes = [Node("customers", "QUERY", customers, {"c_nationkey": 3}), Node("orders", "QUERY", orders_of(spark, d), {"o_custkey": From("customers", "c_custkey")}, many=True, limit=3)]
    return read_sequence(nodes)["orders"].select(F.col("__parent.c_custkey").alias("c_custkey"), "o_orderkey", "o_totalprice")


@query("r3_three_steps", "SELECT n_name, r_name, count(*) AS customers FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY 1, 2")
def three_steps(spark, d):
    customers = t(spark, d, "customer")
    nation = mapped(customers, Relation(t(spark, d, "nation"), "n_nationkey"), "c_nationkey")
    region = mapped(nation, Relation(t(spark, d, "region"), "r_regionkey"), "n_regionkey")
    return region.groupBy("n_name", "r_name").agg(F.count("*").alias("customers"))


@query("r10_mapped_edge", "SELECT l_orderkey, l_linenumber, p_name FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_quantity > 45")
def mapped_edge(spark, d):
    rows = t(spark, d, "lineitem").where("l_quantity > 45").select("l_orderkey", "l_linenumber", F.array(F.col("l_suppkey"), F.col("l_partkey")).alias("indexer_values"))
    return mapped(rows, Relation(t(spark, d, "part"), "p_partkey"), "", indexer=1).select("l_orderkey", "l_linenumber", "p_name")


# -- writes -------------------------------------------------------------------------------------------


def customers(spark, d):
    return t(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal")


@query(
    "w1_put",
    """WITH r AS (SELECT c_custkey * 2 AS c_custkey, 'new' AS c_name, 1.5 AS c_acctbal FROM customer WHERE c_custkey % 5 = 0),
       ok AS (SELECT r.* FROM r LEFT JOIN customer c USING (c_custkey) WHERE c.c_custkey IS NULL OR c.c_acctbal < 1000)
       SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM ok) UNION ALL SELECT c_custkey, c_name, CAST(c_acctbal AS DOUBLE) FROM ok""",
)
def put(spark, d):
    state = customers(spark, d)
    requests = state.where("c_custkey % 5 = 0").select((F.col("c_custkey") * 2).alias("c_custkey"), F.lit("new").alias("c_name"), F.lit(1.5).alias("c_acctbal"))
    return writes.put(state, requests, ["c_custkey"], E.condition("attribute_not_exists(c_custkey) OR c_acctbal < :m", bound={":m": N(1000)}))[0]


@query(
    "w2_update",
    """SELECT c_custkey, c_name, c_acctbal + CASE WHEN k IS NOT NULL THEN 10.0 ELSE 0.0 END AS c_acctbal, k AS visits FROM customer LEFT JOIN
       (SELECT o_custkey, count(*) AS k FROM orders GROUP BY 1) ON o_custkey = c_custkey""",
)
def update(spark, d):
    requests = t(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("k"))
    state = customers(spark, d).withColumn("visits", F.lit(None).cast("long"))
    return writes.update_columns(state, requests, ["c_custkey"], {"c_acctbal": F.col("c_acctbal") + 10.0, "visits": F.coalesce("visits", F.lit(0)) + F.col("new.k")})[0]


@query("w8_delete", "SELECT c_custkey, c_name, c_acctbal FROM customer WHERE NOT (c_custkey % 3 = 0 AND c_acctbal < 5000)")
def delete(spark, d):
    state = customers(spark, d)
    return writes.delete(state, state.where("c_custkey % 3 = 0").select("c_custkey"), ["c_custkey"], E.condition("c_acctbal < :m", bound={":m": N(5000)}))[0]


@query(
    "w9_batch_write",
    """SELECT c_custkey, CASE WHEN c_custkey % 4 = 1 THEN 'put' ELSE c_name END AS c_name, c_acctbal FROM customer WHERE c_custkey % 4 <> 2""",
)
def batch_write(spark, d):
    state = customers(spark, d)
    requests = state.where("c_custkey % 4 IN (1, 2)").select("c_custkey", F.lit("put").alias("c_name"), "c_acctbal", F.when(F.col("c_custkey") % 4 == 1, "PUT").otherwise("DELETE").alias("action"))
    return writes.batch_write(state, requests, ["c_custkey"])


@query(
    "w10_transact",
    """WITH m AS (SELECT c_custkey, c_name, c_acctbal, c_custkey // 3 AS txn FROM customer), v AS (SELECT txn, bool_and(c_acctbal > 0) AS ok FROM m GROUP BY txn)
       SELECT c_custkey, c_name, CASE WHEN ok THEN c_acctbal - 1 ELSE c_acctbal END AS c_acctbal FROM m JOIN v USING (txn)""",
)
def transact(spark, d):
    state = customers(spark, d)
    members = state.select(F.floor(F.col("c_custkey") / 3).alias("txn"), F.col("c_custkey").alias("ordinal"), F.lit("PUT").alias("kind"), F.lit("funded").alias("rule"), "c_custkey", "c_name", (F.col("c_acctbal") - 1).alias("c_acctbal"))
    return writes.transact(state, members, ["c_custkey"], {"funded": F.col("c_acctbal") > 0})[0]


@query(
    "w1_put_outcomes",
    """SELECT k AS c_custkey, c_custkey IS NULL OR c_acctbal < 1000 AS accepted, c_custkey IS NOT NULL AS existed, CASE WHEN c_acctbal < 1000 THEN c_name END AS old_name
       FROM (SELECT c_custkey * 2 AS k FROM customer) LEFT JOIN customer ON c_custkey = k""",
)
def put_outcomes(spark, d):
    state = customers(spark, d)
    requests = state.select((F.col("c_custkey") * 2).alias("c_custkey"), F.lit("new").alias("c_name"), F.lit(0.0).alias("c_acctbal"))
    found = writes.put(state, requests, ["c_custkey"], E.condition("attribute_not_exists(c_custkey) OR c_acctbal < :m", bound={":m": N(1000)}), returns="ALL_OLD")[1]
    return found.select("c_custkey", "accepted", "existed", F.col("old.c_name").alias("old_name"))


@query(
    "w8_delete_outcomes",
    """SELECT k AS c_custkey, coalesce(c_acctbal < 5000, FALSE) AS accepted, c_custkey IS NOT NULL AS existed, CASE WHEN c_acctbal < 5000 THEN c_acctbal END AS old_balance
       FROM (SELECT c_custkey * 3 AS k FROM customer) LEFT JOIN customer ON c_custkey = k""",
)
def delete_outcomes(spark, d):
    state = customers(spark, d)
    found = writes.delete(state, state.select((F.col("c_custkey") * 3).alias("c_custkey")), ["c_custkey"], E.condition("c_acctbal < :m", bound={":m": N(5000)}), returns="ALL_OLD")[1]
    return found.select("c_custkey", "accepted", "existed", F.col("old.c_acctbal").alias("old_balance"))


#: Two transactions on every pair of customers: the first holds if the first customer is funded, the second always.
TWO_EACH = """(SELECT p.txn * 2 + o.o AS txn, c_custkey, o.o FROM (SELECT c_custkey, c_custkey // 2 AS txn FROM customer) p, (SELECT unnest([0, 1]) AS o) o)"""


def two_transactions(spark, d):
    state = customers(spark, d)
    pair = F.floor(F.col("c_custkey") / 2)
    rule = F.when((F.col("second") == 0) & (F.col("c_custkey") % 2 == 0), F.lit("funded"))
    both = state.withColumn("second", F.explode(F.array(F.lit(0), F.lit(1))))
    kind = F.when(F.col("second") == 0, "PUT").otherwise("UPDATE")
    members = both.select((pair * 2 + F.col("second")).alias("txn"), F.col("c_custkey").alias("ordinal"), kind.alias("kind"), rule.alias("rule"), "c_custkey", F.when(F.col("second") == 0, "put").alias("c_name"), F.lit(7.0).alias("c_acctbal"))
    return writes.transact(state, members, ["c_custkey"], {"funded": F.col("c_acctbal") > 0}, updates={"c_acctbal": F.col("c_acctbal") + F.col("new.c_acctbal")})


FUNDED = "(SELECT c_custkey // 2 AS pair, bool_and(c_custkey % 2 = 1 OR c_acctbal > 0) AS holds FROM customer GROUP BY 1)"


@query(
    "w10_transact_outcomes",
    f"""SELECT (c_custkey // 2) * 2 + o AS txn, c_custkey, CASE WHEN o = 0 AND c_custkey % 2 = 0 AND c_acctbal <= 0 THEN 'ConditionalCheckFailed' WHEN o = 1 AND holds THEN 'TransactionConflict' ELSE 'None' END AS reason,
        CASE WHEN o = 0 THEN holds ELSE NOT holds END AS applied FROM customer JOIN {FUNDED} ON pair = c_custkey // 2, (SELECT unnest([0, 1]) AS o)""",
)
def transact_outcomes(spark, d):
    return two_transactions(spark, d)[1].select("txn", "c_custkey", "reason", "applied")


@query(
    "w10_transact_update",
    f"SELECT c_custkey, CASE WHEN holds THEN 'put' ELSE c_name END AS c_name, CASE WHEN holds THEN 7.0 ELSE c_acctbal + 7.0 END AS c_acctbal FROM customer JOIN {FUNDED} ON pair = c_custkey // 2",
)
def transact_update(spark, d):
    return two_transactions(spark, d)[0].select("c_custkey", "c_name", "c_acctbal")


@query("j1_nested_projection", "SELECT o_orderkey, o_totalprice AS price, o_custkey AS buyer, o_orderstatus AS state FROM orders")
def nested_projection(spark, d):
    """Two members of one name under two maps keep their places."""
    nested = t(spark, d, "orders").select("o_orderkey", F.struct(F.col("o_totalprice").alias("x"), F.lit(1).alias("y")).alias("a"), F.struct(F.col("o_custkey").alias("x"), F.struct(F.col("o_orderstatus").alias("z")).alias("w")).alias("b"))
    found = reads.scan(Relation(nested, "o_orderkey"), projection="o_orderkey, a.x, b.x, b.w.z").rows()
    return found.select("o_orderkey", F.col("a.x").alias("price"), F.col("b.x").alias("buyer"), F.col("b.w.z").alias("state"))


@query("p1_map_equality", "SELECT o_orderkey, o_orderstatus = 'F' AS is_literal, o_orderstatus = 'F' AS is_other, FALSE AS is_wider FROM orders")
def map_equality(spark, d):
    """A map equals another of the same members in any order, and no larger one."""
    make = lambda *members: F.struct(*[F.col(c).alias(n) if isinstance(c, str) else c.alias(n) for n, c in members])
    own = t(spark, d, "orders").select("o_orderkey", make(("s", "o_orderstatus"), ("n", F.lit(1))).alias("m"), make(("n", F.lit(1)), ("s", F.lit("F"))).alias("f"), F.create_map(F.lit("s"), F.col("o_orderstatus")).alias("g"))
    compiler = Compiler(own.schema)
    literal, wider = {"M": {"n": {"N": "1"}, "s": {"S": "F"}}}, {"M": {"s": {"S": "F"}, "t": {"S": "F"}}}
    test = lambda text, **bound: compiler.condition(E.condition(text, bound={f":{k}": v for k, v in bound.items()} or None))
    return own.select("o_orderkey", test("m = :l", l=literal).alias("is_literal"), test("m = f").alias("is_other"), test("g = :w", w=wider).alias("is_wider"))


@query(
    "w11_replay",
    "SELECT event_id AS token, CASE WHEN event_id % 3 <> 0 OR event_id % 2 = 0 THEN 'NEW' WHEN event_id % 9 = 0 THEN 'MISMATCH' ELSE 'REPLAY' END AS outcome FROM events",
)
def replay(spark, d):
    events = t(spark, d, "events")
    requests = events.select(F.col("event_id").alias("token"), F.lit("d").alias("digest"))
    receipts = events.where("event_id % 3 = 0").select(F.col("event_id").alias("token"), F.when(F.col("event_id") % 9 == 0, "x").otherwise("d").alias("digest"), F.lit("stored").alias("response"), (F.col("event_id") % 2).alias("expires_at"))
    return writes.replay(requests, receipts, 0).select("token", "outcome")


@query(
    "w12_capped_put",
    """SELECT c_custkey, c_nationkey FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, c_nationkey FROM (SELECT c_custkey, c_nationkey,
       (SELECT count(*) FROM customer h WHERE h.c_custkey % 2 = 0 AND h.c_nationkey = f.c_nationkey) + row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS n FROM customer f WHERE c_custkey % 2 = 1) WHERE n <= 32""",
)
def capped(spark, d):
    rows = t(spark, d, "customer").select("c_custkey", "c_nationkey")
    return writes.capped_put(rows.where("c_custkey % 2 = 0"), rows.where("c_custkey % 2 = 1"), ["c_custkey"], "c_nationkey", 32)


# -- functions ---------------------------------------------------------------------------------------------


@query("f10_routing", "SELECT c_custkey, CAST(('0x' || substr(sha256(CAST(c_custkey AS VARCHAR)), 1, 16))::UBIGINT AS VARCHAR) AS hash, CAST((('0x' || substr(sha256(CAST(c_custkey AS VARCHAR)), 1, 8))::BIGINT * 16) >> 32 AS INTEGER) AS part FROM customer")
def routing(spark, d):
    return t(spark, d, "customer").select("c_custkey", hashing.routing_hash(F.col("c_custkey")).cast("string").alias("hash"), hashing.partition_of(F.col("c_custkey"), 16).alias("part"))


@query("f12_digest", "SELECT event_id, md5(props) AS digest FROM events")
def digest(spark, d):
    return t(spark, d, "events").select("event_id", hashing.body_digest(F.col("props")).alias("digest"))


# -- indexes, expiry, retention --------------------------------------------------------------------------------


@query(
    "b1_index_maintenance",
    """WITH c AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority END AS a, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority END AS b FROM orders)
       SELECT o_orderkey, 'DELETE' AS action, a AS note FROM c WHERE a IS NOT NULL AND b IS NULL UNION ALL SELECT o_orderkey, 'PUT', b FROM c WHERE b IS NOT NULL AND a IS NULL""",
)
def maintenance(spark, d):
    o = t(spark, d, "orders")
    note = lambda m: F.struct(F.when(F.col("o_orderkey") % m == 0, F.col("o_orderpriority")).alias("note"))
    changes = o.select("o_orderkey", note(3).alias("old"), note(2).alias("new"))
    return indexes.maintenance(changes, ["o_orderkey"], ["note"], ["note"]).select("o_orderkey", "action", "entry.note")


@query("b8_expiry_sweep", "SELECT event_id FROM events WHERE NOT (event_id % 4 <> 0 AND event_id * 10 <= 5000)")
def expiry(spark, d):
    items = t(spark, d, "events").select("event_id", F.when(F.col("event_id") % 4 != 0, F.col("event_id") * 10).alias("ttl"))
    victims = indexes.expired(items, "ttl", 5000, ["event_id"])
    return indexes.sweep(items, "ttl", victims, ["event_id"]).select("event_id")


@query(
    "b9_history_cleanup",
    """WITH h AS (SELECT user_id, event_id, ts, lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events),
       b AS (SELECT user_id, min(CASE WHEN ts > TIMESTAMP '2024-01-15' THEN coalesce(p, event_id) END) AS k, max(event_id) AS live FROM h GROUP BY user_id)
       SELECT user_id, event_id FROM events JOIN b USING (user_id) WHERE event_id < least(coalesce(k, live), live)""",
)
def history_cleanup(spark, d):
    cutoff = F.lit("2024-01-15").cast("timestamp_ntz")
    return indexes.removable_history(t(spark, d, "events"), ["user_id"], "event_id", "ts", cutoff).select("user_id", "event_id")


@query(
    "b10_lane_trim",
    """WITH f AS (SELECT user_id % 8 AS lane, min(event_id) AS first FROM events WHERE ts > TIMESTAMP '2024-01-20' GROUP BY 1)
       SELECT user_id % 8 AS lane, event_id FROM events JOIN f ON f.lane = user_id % 8 WHERE event_id >= first""",
)
def lane_trim(spark, d):
    log = t(spark, d, "events").withColumn("lane", F.col("user_id") % 8)
    return indexes.trim_lanes(log, "lane", "event_id", "ts", F.lit("2024-01-20").cast("timestamp_ntz")).select("lane", "event_id")


@query("b12_receipt_trim", "SELECT event_id FROM events WHERE ts > TIMESTAMP '2024-01-10'")
def receipt_trim(spark, d):
    return indexes.trim_receipts(t(spark, d, "events").withColumnRenamed("ts", "expires_at"), F.lit("2024-01-10").cast("timestamp_ntz")).select("event_id")


FNV = "list_reduce(list_prepend(CAST(2166136261 AS BIGINT), list_transform(range(1, length(event_type) + 1), lambda i: CAST(ascii(substr(event_type, i, 1)) AS BIGINT))), lambda h, b: xor(h, b) * 16777619 % 4294967296) % 256"


@query("b14_change_markers", f"SELECT CAST({FNV} AS BIGINT) AS slot, event_type, max(event_id) AS latest FROM events GROUP BY 1, 2")
def markers(spark, d):
    return history.change_markers(t(spark, d, "events"), "event_type", "event_id", hashing.change_slot_column(F.col("event_type")))


# -- history and streams -----------------------------------------------------------------------------------------


@query("a5_current_state", "SELECT user_id, arg_max(event_id, event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY user_id HAVING arg_max(event_type, event_id) <> 'click'")
def current_state(spark, d):
    return history.current(t(spark, d, "events").select("user_id", "event_id", "value", "event_type"), ["user_id"], ["event_id"], F.col("event_type") == "click").select("user_id", "event_id", "value")


@query(
    "t5_stream_records",
    """WITH s AS (SELECT user_id, event_id, CASE WHEN event_type <> 'click' THEN value END AS new FROM events), r AS (SELECT *, lag(new) OVER (PARTITION BY user_id ORDER BY event_id) AS old FROM s)
       SELECT user_id, event_id, CASE WHEN old IS NULL THEN 'INSERT' WHEN new IS NULL THEN 'REMOVE' ELSE 'MODIFY' END AS event_name, old AS old_value, new AS new_value FROM r WHERE old IS NOT NULL OR new IS NOT NULL""",
)
def stream_records(spark, d):
    log = t(spark, d, "events").select("user_id", "event_id", "value", "event_type")
    records = history.images(log, ["user_id"], ["event_id"], F.col("event_type") == "click")
    return history.view(records, "NEW_AND_OLD_IMAGES").select("user_id", "event_id", "event_name", F.col("old.value").alias("old_value"), F.col("new.value").alias("new_value"))


@query("t1_records_page", "SELECT lane, event_id FROM (SELECT user_id % 4 AS lane, event_id, row_number() OVER (PARTITION BY user_id % 4 ORDER BY event_id) AS n FROM events WHERE event_id > 100) WHERE n <= 50")
def records_page(spark, d):
    log = t(spark, d, "events").withColumn("lane", F.col("user_id") % 4)
    return history.records_page(log, "lane", "event_id", {0: 100, 1: 100, 2: 100, 3: 100}, 50)[0].select("lane", "event_id")


@query("b13_item_history", "SELECT event_id, value FROM events WHERE user_id = 3 AND event_id < 5000 ORDER BY event_id DESC")
def item_history(spark, d):
    return history.item_history(t(spark, d, "events"), {"user_id": 3}, ["event_id"], forward=False, after=5000).select("event_id", "value")


@query("t12_append_once", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_id END AS kept_seq, row_number() OVER (ORDER BY event_id % 3 <> 0, event_id) AS place FROM events")
def append_once(spark, d):
    events = t(spark, d, "events").select("event_id", F.col("event_id").alias("seq"))
    batch = events.where("event_id % 2 = 0").select("event_id").unionByName(events.select("event_id"))
    stream = history.append_once(events.where("event_id % 3 = 0"), batch, "event_id", "seq")
    return reads.places(stream, ["seq"]).select("event_id", F.when(F.col("event_id") % 3 == 0, F.col("seq")).alias("kept_seq"), "place")


@query(
    "t22_last_writer_wins",
    "SELECT user_id, arg_max(event_id, (CAST(floor(value) AS BIGINT), event_id % 2, event_id)) AS event_id FROM events GROUP BY user_id",
)
def last_writer(spark, d):
    events = t(spark, d, "events").select("user_id", "event_id", F.floor("value").alias("physical_ms"), F.lit(0).alias("logical"), (F.col("event_id") % 2).alias("origin"), F.col("event_id").alias("position"), F.lit(0).alias("ordinal"))
    order = history.event_order(F.lit(1))
    state = history.winners(events.where("event_id % 2 = 0"), ["user_id"], order)
    return history.import_events(state, events.where("event_id % 2 = 1"), ["user_id"], order).select("user_id", "event_id")


# -- queues and topics ---------------------------------------------------------------------------------------------


def messages(spark, d):
    return t(spark, d, "events").select(
        F.lpad(F.col("event_id").cast("string"), 12, "0").alias("message_id"), F.col("event_type").alias("queue"), F.col("props").alias("body"), F.lit(0).alias("receive_count"),
        F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("r"), F.col("event_id").cast("string"))).alias("receipt"), F.col("event_id").alias("created_at"), (F.col("event_id") * 7 % 1000).alias("visible_at"), (F.col("event_id") * 11 % 1500).alias("expires_at"),
    )


MESSAGES = "(SELECT lpad(CAST(event_id AS VARCHAR), 12, '0') AS message_id, event_type AS queue, CASE WHEN event_id % 5 = 0 THEN 'r' || event_id END AS receipt, event_id * 7 % 1000 AS visible_at, event_id * 11 % 1500 AS expires_at FROM events)"


@query(
    "a2_queue_counts",
    f"""SELECT queue, count(*) FILTER (visible_at <= 500) AS visible, count(*) FILTER (visible_at > 500 AND receipt IS NOT NULL) AS in_flight, count(*) FILTER (visible_at > 500 AND receipt IS NULL) AS delayed
        FROM {MESSAGES} WHERE expires_at > 500 GROUP BY queue""",
)
def queue_counts(spark, d):
    return queues.counts(messages(spark, d), 500)


@query("t13_receive", f"SELECT queue, message_id FROM (SELECT *, row_number() OVER (PARTITION BY queue ORDER BY visible_at, message_id) AS n FROM {MESSAGES} WHERE visible_at <= 500) WHERE n <= 10 AND expires_at > 500")
def receive(spark, d):
    return queues.receive(messages(spark, d), 500, 10)[1].select("queue", "message_id")


@query("t14_delete_by_receipt", f"SELECT queue, message_id FROM {MESSAGES} WHERE receipt IS NULL OR CAST(message_id AS BIGINT) % 10 <> 0")
def delete_message(spark, d):
    own = messages(spark, d)
    return queues.delete(own, own.where("receipt IS NOT NULL AND CAST(message_id AS BIGINT) % 10 = 0").select("queue", "receipt"))[0].select("queue", "message_id")


@query("t15_send_policy", "SELECT event_id AS message_id, CAST(1000 + (event_id % 10) * 1000 AS BIGINT) AS visible_at, CAST(61000 AS BIGINT) AS expires_at FROM events")
def send(spark, d):
    requests = t(spark, d, "events").select(F.col("event_id").alias("message_id"), F.col("event_type").alias("queue"), F.col("props").alias("body"), (F.col("event_id") % 10).alias("delay_s"))
    return queues.send(requests, 1000, retention_s=60).select("message_id", "visible_at", "expires_at")


@query("t26_queue_cleanup", f"SELECT message_id FROM {MESSAGES} WHERE expires_at > 700 AND queue <> 'click'")
def queue_cleanup(spark, d):
    return queues.cleanup(messages(spark, d), spark.createDataFrame([("click",)], "queue string"), 700).select("message_id")


# -- further forms -----------------------------------------------------------------------------------------


@query("a3_set_add", "SELECT o_custkey, array_to_string(list_sort(list_distinct(list(o_orderpriority))), ',') AS priorities FROM orders GROUP BY o_custkey")
def set_add(spark, d):
    o = t(spark, d, "orders")
    sets = lambda odd, name: o.where(F.col("o_orderkey") % 2 == odd).groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias(name))
    state = sets(0, "priorities")
    union = F.array_union(F.coalesce("priorities", F.array().cast("array<string>")), F.col("new.added"))
    after, _ = writes.update_columns(state, sets(1, "added"), ["o_custkey"], {"priorities": union})
    return after.select("o_custkey", F.array_join(F.array_sort("priorities"), ",").alias("priorities"))


@query("w3_general_update", """SELECT c_custkey, CAST(c_custkey % 2 = 0 AS BOOLEAN) AS accepted, CASE WHEN c_custkey % 2 = 0 THEN '{"n":{"N":"' || (c_custkey + 2) || '"}}' END AS returned FROM customer""")
def general_update(spark, d):
    own = t(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("pk"), "c_custkey")
    state = own.select("pk", F.to_json(F.struct(F.struct(F.col("pk").alias("S")).alias("pk"), F.struct(F.col("pk").alias("N")).alias("n"), F.struct((F.col("c_custkey") % 2).cast("string").alias("N")).alias("odd"))).alias("item"))
    rows = writes.update_items(state, own.select("pk"), ["pk"], "SET n = n + :two", bound={":two": N(2), ":zero": N(0)}, condition="odd = :zero", returns="UPDATED_NEW")
    return rows.select(F.col("pk").cast("long").alias("c_custkey"), "accepted", "returned")


@query("f13_item_size", "SELECT c_custkey, CAST(4 + octet_length(encode(c_name)) + 3 + 1 AS BIGINT) AS size FROM customer")
def item_size(spark, d):
    from heddle.functions import values

    item = F.to_json(F.struct(F.struct(F.col("c_name").alias("S")).alias("name"), F.struct(F.lit(True).alias("BOOL")).alias("yes")))
    return t(spark, d, "customer").select("c_custkey", values.item_size_column(item).alias("size"))


@query("l6_last_key", "SELECT count(*) AS scanned, max(o_orderkey) AS last_key FROM (SELECT o_orderkey FROM orders WHERE o_custkey = 10 ORDER BY o_orderkey LIMIT 4)")
def last_key(spark, d):
    page = reads.query(orders_of(spark, d), "o_custkey = :c", bound={":c": N(10)}, limit=4).page()
    return spark.createDataFrame([(page.scanned, (page.last_key or {}).get("o_orderkey"))], "scanned long, last_key long")


@query("r6_selector", "SELECT o_totalprice AS value FROM orders WHERE o_custkey = 10 ORDER BY o_orderkey LIMIT 1 OFFSET 2")
def selector(spark, d):
    from heddle.operators.read_sequence import select

    return select(reads.query(orders_of(spark, d), "o_custkey = :c", bound={":c": N(10)}).rows(), "$.Query.Items[2].o_totalprice", ["o_orderkey"])


@query("t4_iterator", "SELECT event_id, user_id FROM events WHERE event_id > 9000")
def iterator(spark, d):
    return history.start_at(t(spark, d, "events"), "event_id", "AFTER_SEQUENCE_NUMBER", 9000).select("event_id", "user_id")


@query("t6_keys_only_view", "SELECT user_id, event_id, CASE WHEN lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) IS NULL THEN 'INSERT' ELSE 'MODIFY' END AS event_name FROM events")
def keys_only_view(spark, d):
    return history.view(history.images(t(spark, d, "events").select("user_id", "event_id", "value"), ["user_id"], ["event_id"]), "KEYS_ONLY")


@query("t8_cursor", "SELECT event_id FROM events WHERE event_id > 50 ORDER BY event_id LIMIT 20")
def cursor(spark, d):
    rows, _ = history.read_cursor(t(spark, d, "events").select("event_id"), "event_id", 50, 20)
    return spark.createDataFrame(rows, "event_id long")


@query(
    "t10_pressure",
    """WITH RECURSIVE l AS (SELECT user_id % 8 AS part, event_id // 100 AS tick, sum(value) / 500.0 AS x FROM events GROUP BY 1, 2), s AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY tick) AS n FROM l),
       c AS (SELECT part, tick, n, x AS e, greatest(-2.0, least(4.0, x - 1)) AS i, CASE WHEN x >= 1 THEN 1 ELSE 0 END AS h, CASE WHEN x <= 0.35 THEN 1 ELSE 0 END AS l FROM s WHERE n = 1
             UNION ALL SELECT part, tick, n, e, greatest(-2.0, least(4.0, i + e - 1)), CASE WHEN x >= 1 THEN h + 1 ELSE 0 END, CASE WHEN x <= 0.35 THEN l + 1 ELSE 0 END
             FROM (SELECT s.part, s.tick, s.n, s.x, CASE WHEN c.e <= 0 THEN s.x ELSE 0.4 * s.x + 0.6 * c.e END AS e, c.i, c.h, c.l FROM c JOIN s ON s.part = c.part AND s.n = c.n + 1)),
       p AS (SELECT part, tick, e + 0.2 * i AS pressure, h, l FROM c)
       SELECT part, tick, round(pressure, 6) AS pressure, CAST(h AS INTEGER) AS high_streak, CAST(l AS INTEGER) AS low_streak,
              CASE WHEN h >= 3 AND pressure >= 1.3 THEN 'SPLIT' WHEN l >= 12 AND pressure <= 0.35 THEN 'DRAIN' ELSE 'KEEP' END AS action FROM p""",
)
def load_pressure(spark, d):
    loads = t(spark, d, "events").groupBy((F.col("user_id") % 8).alias("part"), F.floor(F.col("event_id") / 100).alias("tick")).agg(F.sum("value").alias("load"))
    return history.pressure(loads, "part", "tick", "load", 500.0).select("part", "tick", F.round("pressure", 6).alias("pressure"), "high_streak", "low_streak", "action")


@query("b3_build_states", "SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'BLOCKED' WHEN event_id % 5 = 0 THEN 'SCANNING' WHEN event_id % 3 = 0 THEN 'ACTIVE' ELSE 'CATCHING_UP' END AS phase FROM events")
def build_phases(spark, d):
    builds = t(spark, d, "events").select("event_id", F.when(F.col("event_id") % 3 == 0, 9).otherwise(1).alias("cursor"), F.lit(0).alias("low"), F.lit(9).alias("high"), (F.col("event_id") % 5 != 0).alias("scanned"), F.lit(9).alias("projected_through"), (F.col("event_id") % 7 == 0).cast("int").alias("conflicts"))
    return indexes.build_states(builds).select("event_id", "phase")


@query("b7_ttl_index", "SELECT event_id, CAST(event_id * 3 AS BIGINT) AS ttl_seconds FROM events WHERE event_id % 2 = 0")
def ttl_index(spark, d):
    items = t(spark, d, "events").select("event_id", F.when(F.col("event_id") % 2 == 0, F.col("event_id") * 3.0).otherwise(F.col("event_id") + 0.5).alias("ttl"))
    return indexes.ttl_index(items, "ttl").select("event_id", "ttl_seconds")


@query("b11_orphans", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def orphans(spark, d):
    owners = t(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return indexes.orphans(t(spark, d, "lineitem").select("l_orderkey", "l_linenumber"), owners, ["l_orderkey"])


# -- topics, every event and customer ------------------------------------------------------------------------

SETTLED_AT = 10**12  # after every event


def all_topic_tables(spark, d):
    """Every event is published to its user's topic; every customer subscribes to one topic, chosen by c_custkey."""
    events = t(spark, d, "events")
    publications = events.select(F.col("event_id").alias("publication_id"), F.col("user_id").cast("string").alias("topic"), F.col("event_id").alias("accepted_at"))
    topics = F.broadcast(events.agg((F.max("user_id") + 1).alias("topics")))  # one row
    own = t(spark, d, "customer").crossJoin(topics).withColumn("topic", (F.col("c_custkey") % F.col("topics")).cast("string"))
    since = F.col("c_custkey") * 10
    subscriptions = own.select(
        F.concat_ws("-", "c_custkey", "topic").alias("subscription_id"), "topic", F.lit("sqs").alias("protocol"), F.col("c_name").alias("endpoint"), (F.col("c_custkey") % 3 != 0).alias("confirmed"),
        since.alias("subscribed_at"), F.when(F.col("c_custkey") % 2 == 0, since + 100).alias("unsubscribed_at"),
    )
    return publications, subscriptions


FAN_OUT_ALL = """(SELECT e.event_id AS publication_id, CAST(e.user_id AS VARCHAR) AS topic, c.c_custkey || '-' || e.user_id AS subscription_id
 FROM (SELECT *, c_custkey % (SELECT max(user_id) + 1 FROM events) AS topic FROM customer) c JOIN events e ON e.user_id = c.topic
 WHERE c.c_custkey % 3 <> 0 AND c.c_custkey * 10 <= e.event_id AND (c.c_custkey % 2 <> 0 OR c.c_custkey * 10 + 100 > e.event_id))"""


@query("t19_fan_out_all", f"SELECT publication_id, subscription_id FROM {FAN_OUT_ALL}")
def fan_out_all(spark, d):
    return queues.fan_out(*all_topic_tables(spark, d)).select("publication_id", "subscription_id")


@query("t20_settle_all", f"SELECT publication_id, subscription_id, CASE WHEN publication_id % 2 = 0 THEN 'DELIVERED' ELSE 'RETRY_SCHEDULED' END AS status, CAST(CASE WHEN publication_id % 2 = 0 THEN publication_id ELSE {SETTLED_AT} + 250 END AS BIGINT) AS due_at FROM {FAN_OUT_ALL}")
def settle_all(spark, d):
    claimed = queues.claim(queues.fan_out(*all_topic_tables(spark, d)), "worker-1", SETTLED_AT, 1000, None)
    outcomes = claimed.select("delivery_id", "owner", "generation", (F.col("publication_id") % 2 == 0).alias("ok"))
    return queues.settle(claimed, outcomes, SETTLED_AT, 250, 3).select("publication_id", "subscription_id", "status", "due_at")


@query("t20_settle_twice", f"SELECT publication_id, subscription_id, CASE WHEN publication_id % 2 = 0 THEN 'DELIVERED' ELSE 'RETRY_SCHEDULED' END AS status, CAST(publication_id % 2 AS INTEGER) AS attempts, TRUE AS unowned, CASE WHEN publication_id % 2 = 1 THEN 'late' END AS last_error FROM {FAN_OUT_ALL}")
def settle_twice(spark, d):
    """A repeated outcome and a later, opposite one change nothing."""
    claimed = queues.claim(queues.fan_out(*all_topic_tables(spark, d)), "worker-1", SETTLED_AT, 1000, None)
    outcomes = claimed.select("delivery_id", "owner", "generation", (F.col("publication_id") % 2 == 0).alias("ok"), F.lit("late").alias("error"))
    once = queues.settle(claimed, outcomes, SETTLED_AT, 250, 3)
    again = queues.settle(once, outcomes.withColumn("ok", ~F.col("ok")), SETTLED_AT + 9, 250, 3)
    return again.select("publication_id", "subscription_id", "status", "attempts", F.col("owner").isNull().alias("unowned"), "last_error")


@query("t25_notification_all", """SELECT publication_id, subscription_id, '{"Type":"Notification","MessageId":"' || publication_id || '","TopicArn":"' || topic || '","Message":"m' || publication_id || '"}' AS body FROM """ + FAN_OUT_ALL)
def notifications_all(spark, d):
    publications, subscriptions = all_topic_tables(spark, d)
    deliveries = queues.fan_out(publications, subscriptions)
    texts = publications.select("publication_id", "topic", F.concat(F.lit("m"), F.col("publication_id").cast("string")).alias("message"), F.lit(False).alias("raw"))
    return queues.notification(deliveries, texts).join(deliveries.select("delivery_id", "publication_id", "subscription_id"), "delivery_id").select("publication_id", "subscription_id", "body")


# -- dependent reads with inputs that are missing in some rows -----------------------------------------------


def sparse_parts(spark, d, missing: str) -> DataFrame:
    """The parts that a third of the orders name."""
    orders = Relation(t(spark, d, "orders").withColumn("wanted", F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderkey"))), "o_orderkey")
    nodes = [Node("orders", "QUERY", orders), Node("parts", "GET", Relation(t(spark, d, "part"), "p_partkey"), {"p_partkey": From("orders", "wanted", missing)}, many=True)]
    return read_sequence(nodes)["parts"].select("p_partkey", "p_brand")


@query("r4_skip_missing", "SELECT o_orderkey AS p_partkey, p_brand FROM orders LEFT JOIN part ON p_partkey = o_orderkey WHERE o_orderkey % 3 = 0")
def skip_missing(spark, d):
    return sparse_parts(spark, d, "SKIP")


@query("r4_null_missing", "SELECT DISTINCT CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey END AS p_partkey, p_brand FROM orders LEFT JOIN part ON p_partkey = CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey END")
def null_missing(spark, d):
    return sparse_parts(spark, d, "NULL")


@query(
    "r7_two_parents",
    """SELECT o_orderkey, c_name FROM (SELECT o_orderkey, 'n' || (SELECT n_name FROM nation WHERE n_nationkey = 3) || '#' || o_custkey AS key FROM orders) o
       JOIN (SELECT c_name, 'n' || n_name || '#' || c_custkey AS key FROM customer JOIN nation ON n_nationkey = c_nationkey) c USING (key)""",
)
def two_parents(spark, d):
    """A template of an iterated node's value and the single value of another."""
    nation = Relation(t(spark, d, "nation"), "n_nationkey")
    orders = Relation(t(spark, d, "orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("customer")), "o_orderkey")
    names = t(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    keyed = t(spark, d, "customer").join(names, "c_nationkey").select("c_name", F.concat(F.lit("n"), "n_name", F.lit("#"), F.col("c_custkey").cast("string")).alias("key"))
    key = Template("n{nation}#{id}", {"nation": From("nation", "n_name"), "id": From("orders", "customer")})
    nodes = [Node("nation", "GET", nation, {"n_nationkey": 3}), Node("orders", "QUERY", orders), Node("customers", "QUERY", Relation(keyed, "key"), {"key": key}, many=True, limit=100, iterate="orders")]
    return read_sequence(nodes)["customers"].select(F.col("__parent.o_orderkey").alias("o_orderkey"), "c_name")


# -- reference operators over whole tables -----------------------------------------------------------------


@query("s2_batch_get_all", "SELECT * FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def batch_get_all(spark, d):
    return reads.batch_get(Relation(t(spark, d, "customer"), "c_custkey"), t(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")))


@query("j1_projection_all", "SELECT o_orderkey, o_orderstatus FROM orders")
def projection_all(spark, d):
    return reads.scan(Relation(t(spark, d, "orders"), "o_orderkey"), projection="o_orderkey, #s", names={"#s": "o_orderstatus"}).rows()


@query("r2_dependent_get_all", "SELECT DISTINCT o_custkey AS c_custkey, c_name FROM orders LEFT JOIN customer ON c_custkey = o_custkey")
def dependent_get_all(spark, d):
    nodes = [Node("orders", "QUERY", Relation(t(spark, d, "orders"), "o_orderkey")), Node("customers", "GET", Relation(t(spark, d, "customer"), "c_custkey"), {"c_custkey": From("orders", "o_custkey")}, many=True)]
    return read_sequence(nodes)["customers"].select("c_custkey", "c_name")


@query("r7_string_template_all", "SELECT DISTINCT 'cust#' || o_custkey || '#v1' AS key, c_name FROM orders JOIN customer ON c_custkey = o_custkey")
def template_all(spark, d):
    keyed = t(spark, d, "customer").withColumn("key", F.concat(F.lit("cust#"), F.col("c_custkey").cast("string"), F.lit("#v1")))
    key = Template("cust#{id}#v1", {"id": From("orders", "customer")})
    orders = t(spark, d, "orders").withColumn("customer", F.col("o_custkey").cast("string"))
    nodes = [Node("orders", "QUERY", Relation(orders, "o_orderkey")), Node("customers", "BATCH_GET", Relation(keyed, "key"), {"key": key}, many=True)]
    return read_sequence(nodes)["customers"].select("key", "c_name")


@query("f5_canonical_number_all", "SELECT c_custkey, CAST(c_custkey AS VARCHAR) || '.5' AS number, CASE WHEN c_custkey = 0 THEN '0' ELSE '-0.00' || rtrim(CAST(c_custkey AS VARCHAR), '0') END AS raw FROM customer")
def canonical_number_all(spark, d):
    text = F.col("c_custkey").cast("string")
    return t(spark, d, "customer").select("c_custkey", numbers.canonical_column(F.concat(F.lit("+00"), text, F.lit(".500e0"))).alias("number"), numbers.canonical_column(F.concat(F.lit("-"), text, F.lit("e-"), (F.length(text) + 2).cast("string"))).alias("raw"))


@query("f7_number_order_all", "SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal, c_custkey) AS place FROM customer")
def number_order_all(spark, d):
    own = t(spark, d, "customer").withColumn("k", numbers.sort_key_column(F.col("c_acctbal").cast("decimal(20,2)").cast("string")))
    return reads.places(own, ["k", "c_custkey"]).select("c_custkey", "place")


# -- topics and subscriptions as tables --------------------------------------------------------------------


def subscribed(spark, d):
    """A topic for every user; every customer asks for two subscriptions, one of them of a kind or topic that may not be."""
    none = spark.createDataFrame([], "topic string, display_name string, created_at long")
    held = topics.create(none, t(spark, d, "events").select(F.concat(F.lit("user-"), "user_id").alias("topic")), 1)
    empty = spark.createDataFrame([], "subscription_id string, topic string, protocol string, endpoint string, raw boolean, confirmed boolean, token string, subscribed_at long, unsubscribed_at long")
    key = F.col("c_custkey")
    kind = F.when(key % 4 == 0, "sqs").when(key % 4 == 1, "http").when(key % 4 == 2, "https").otherwise("email")
    asked = t(spark, d, "customer").select(F.concat(F.lit("user-"), (key % 100).cast("string")).alias("topic"), kind.alias("protocol"), F.concat(F.lit("http://"), "c_name").alias("endpoint"))
    return held, *topics.subscribe(held, empty, asked, 2)


ASKED = """(SELECT 'user-' || (c_custkey % 100) AS topic, CASE c_custkey % 4 WHEN 0 THEN 'sqs' WHEN 1 THEN 'http' WHEN 2 THEN 'https' ELSE 'email' END AS protocol, 'http://' || c_name AS endpoint FROM customer)"""
TOPICS = "(SELECT DISTINCT 'user-' || user_id AS topic FROM events)"


@query(
    "t18_subscribe",
    f"""SELECT topic, protocol, endpoint, CASE WHEN protocol = 'email' THEN 'UnsupportedProtocol' WHEN protocol = 'https' THEN 'InvalidEndpoint'
        WHEN topic NOT IN (SELECT topic FROM {TOPICS}) THEN 'NotFound' END AS error FROM (SELECT DISTINCT * FROM {ASKED})""",
)
def subscribe(spark, d):
    return subscribed(spark, d)[2].select("topic", "protocol", "endpoint", "error")


@query(
    "t18_topic_attributes",
    f"""SELECT topic, CAST(count(*) FILTER (protocol = 'sqs' OR length(endpoint) % 2 = 0 AND protocol = 'http') AS BIGINT) AS confirmed,
        CAST(count(*) FILTER (protocol = 'http' AND length(endpoint) % 2 = 1) AS BIGINT) AS pending FROM {TOPICS} LEFT JOIN (SELECT DISTINCT * FROM {ASKED}) USING (topic) GROUP BY topic""",
)
def topic_attributes(spark, d):
    held, subscriptions, _ = subscribed(spark, d)
    after, _ = topics.confirm(subscriptions, subscriptions.where("length(endpoint) % 2 = 0 AND token IS NOT NULL").select("topic", "token"))
    return topics.attributes(held, after).select("topic", "confirmed", "pending")
