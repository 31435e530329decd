import pytest
from pyspark.sql import functions as F

from heddle.operators import history, indexes, queries, queues, read_sequence, reads, writes
from heddle.plans import expressions as E
from heddle.sources.catalog import Catalog, CatalogError, Table


@pytest.fixture(scope="module")
def table(spark):
    rows = [(f"p{i % 3}", i, i * 10, "x" * (i % 5)) for i in range(30)]
    return reads.Relation(spark.createDataFrame(rows, "pk string, sk int, n int, note string"), "pk", "sk")


def test_pages_continue_to_the_end(table):
    start, seen = None, []
    while True:
        page = reads.query(table, "pk = :p", bound={":p": {"S": "p1"}, ":n": {"N": "100"}}, filter="n > :n", limit=4, start=start).page()
        assert page.count <= page.scanned <= 4
        seen += [i["sk"] for i in page.items]
        if page.last_key is None:
            break
        start = page.last_key
    assert seen == [i for i in range(30) if i % 3 == 1 and i * 10 > 100]


def test_backward_page_and_full_last_page(table):
    page = reads.query(table, "pk = :p", bound={":p": {"S": "p0"}}, forward=False, limit=10).page()
    assert [i["sk"] for i in page.items] == list(range(27, -1, -3)) and page.last_key is None
    assert page.units == 0.5


def test_byte_budget_stops_a_page(table):
    page = reads.query(table, "pk = :p", bound={":p": {"S": "p0"}}).page(size=F.lit(400_000))
    assert page.scanned == 2 and page.last_key == {"pk": "p0", "sk": 3}


def test_rejected_reads(table):
    with pytest.raises(reads.ReadError):
        reads.normalised_limit(0, 1, 2)
    assert reads.normalised_limit(50_000, 100, 10_000) == 10_000
    with pytest.raises(reads.ReadError):
        reads.scan(table, segment=1)
    with pytest.raises(reads.ReadError):
        reads.query(table, "pk = :p", bound={":p": {"S": "a"}}, select="COUNT", projection="n")
    with pytest.raises(reads.ReadError):
        reads.get_item(table, {"pk": "p0"})
    keys_only = indexes.index(table, "note", None, "KEYS_ONLY")
    with pytest.raises(reads.ReadError):
        reads.query(keys_only, "note = :n", bound={":n": {"S": "x"}}, projection="n")
    with pytest.raises(reads.ReadError):
        reads.batch_get_request(table, [{"pk": "p0", "sk": 1}] * 2)
    assert reads.batch_get_request(table, [{"pk": "p0", "sk": 0}, {"pk": "p9", "sk": 0}]).count() == 1


def test_tokens():
    assert reads.from_token(reads.token({"pk": "a", "sk": 1})) == {"pk": "a", "sk": "1"}


def test_sequence_schedule_and_tokens(table):
    a = read_sequence.Node("a", "QUERY", table, {"pk": "p1"})
    b = read_sequence.Node("b", "GET", table, {"pk": read_sequence.From("a", "pk"), "sk": read_sequence.From("a", "sk")}, many=True)
    assert read_sequence.schedule([b, a]) == [["a"], ["b"]]
    text = read_sequence.token([a, b], {"a": 3})
    assert read_sequence.resume([a, b], text) == {"a": 3}
    with pytest.raises(read_sequence.SequenceError):
        read_sequence.resume([a], text)
    with pytest.raises(read_sequence.SequenceError):
        read_sequence.resume([a, b], text.replace("3", "4", 1))
    with pytest.raises(read_sequence.SequenceError):
        read_sequence.schedule([read_sequence.Node("x", "GET", table, {"pk": read_sequence.From("x", "pk")})])
    with pytest.raises(read_sequence.SequenceError):
        read_sequence.read_sequence([a, read_sequence.Node("c", "QUERY", table, {"pk": read_sequence.From("a", "pk")}, many=True)])
    assert read_sequence.read_sequence([a, b])["b"].count() == 10
    assert [r.value for r in read_sequence.select(table.items.where("pk = 'p1'"), "$.Query.Items[1].n", ["sk"]).collect()] == [40]


def test_missing_get_keeps_its_invocation(spark, table):
    parent = reads.Relation(spark.createDataFrame([("p1", 1), ("p1", 1), ("zz", 1), (None, 1)], "k string, sk int"), "k")
    nodes = [read_sequence.Node("a", "QUERY", parent), read_sequence.Node("b", "GET", table, {"pk": read_sequence.From("a", "k"), "sk": read_sequence.From("a", "sk")}, many=True)]
    rows = {r.pk: r.n for r in read_sequence.read_sequence(nodes)["b"].collect()}
    assert rows == {"p1": 10, "zz": None}
    nodes[1].key["pk"] = read_sequence.From("a", "k", "ERROR")
    with pytest.raises(Exception, match="missing"):
        read_sequence.read_sequence(nodes)["b"].collect()


def test_transaction_reasons(spark):
    state = spark.createDataFrame([(1, 10), (2, 0)], "id int, n int")
    members = spark.createDataFrame([("t1", 0, "PUT", "positive", 1, 5), ("t2", 0, "PUT", "positive", 2, 5), ("t2", 1, "PUT", None, 3, 5), ("t3", 0, "PUT", None, 4, 1), ("t3", 1, "DELETE", None, 4, 1)], "txn string, ordinal int, kind string, rule string, id int, n int")
    after, outcome = writes.transact(state, members, ["id"], {"positive": F.col("n") > 0})
    assert {(r.id, r.n) for r in after.collect()} == {(1, 5), (2, 0)}
    assert {(r.txn, r.ordinal): r.reason for r in outcome.collect()} == {("t1", 0): "None", ("t2", 0): "ConditionalCheckFailed", ("t2", 1): "None", ("t3", 0): "DuplicateItem", ("t3", 1): "DuplicateItem"}


def test_general_update(spark):
    state = spark.createDataFrame([("a", '{"pk":{"S":"a"},"n":{"N":"1"}}'), ("b", '{"pk":{"S":"b"},"n":{"S":"x"}}')], "pk string, item string")
    requests = spark.createDataFrame([("a",), ("b",), ("c",)], "pk string")
    rows = {r.pk: r for r in writes.update_items(state, requests, ["pk"], "ADD n :v", bound={":v": {"N": "2"}}, returns="UPDATED_NEW").collect()}
    assert rows["a"].returned == '{"n":{"N":"3"}}' and rows["a"].accepted
    assert not rows["b"].accepted and "type" in rows["b"].error
    assert rows["c"].new_item == '{"n":{"N":"2"}}'
    with pytest.raises(writes.WriteError):
        writes.update_items(state, requests, ["pk"], "SET pk = :v", bound={":v": {"S": "z"}})
    with pytest.raises(writes.WriteError):
        writes.reject_legacy({"Expected": {}})


def test_put_condition_sees_the_absent_item(spark):
    state = spark.createDataFrame([(1, 5)], "id int, n int")
    after, outcome = writes.put(state, spark.createDataFrame([(1, 6), (2, 7)], "id int, n int"), ["id"], E.condition("attribute_not_exists(id)"))
    assert {(r.id, r.n) for r in after.collect()} == {(1, 5), (2, 7)}
    assert {r.id: (r.accepted, r.existed) for r in outcome.collect()} == {1: (False, True), 2: (True, False)}


def test_two_requests_on_one_item_fail(spark):
    twice = spark.createDataFrame([(1, "PUT"), (1, "DELETE")], "id int, action string")
    with pytest.raises(Exception, match="two requests"):
        writes.check_distinct(twice, ["id"]).collect()


def test_index_states_and_expiry(spark):
    builds = spark.createDataFrame([(1, 0, 5, False, 0, 0), (3, 0, 5, True, 3, 0), (5, 0, 5, True, 5, 0), (5, 0, 5, True, 5, 1)], "cursor int, low int, high int, scanned boolean, projected_through int, conflicts int")
    assert [r.phase for r in indexes.build_states(builds).collect()] == ["SCANNING", "CATCHING_UP", "ACTIVE", "BLOCKED"]
    assert indexes.ttl_transition("DISABLED", True, 0) == ("ENABLING", 1) and indexes.ttl_transition("ENABLING", None, 1) == ("ENABLED", 1)
    with pytest.raises(ValueError):
        indexes.ttl_transition("DISABLED", False, 0)
    items = spark.createDataFrame([(1, 5), (2, 50), (3, None)], "id int, ttl int")
    victims = indexes.expired(items, "ttl", 10, ["id"])
    renewed = spark.createDataFrame([(1, 99), (2, 50), (3, None)], "id int, ttl int")
    assert indexes.sweep(renewed, "ttl", victims, ["id"]).count() == 3  # expiry moved meanwhile
    assert indexes.sweep(items, "ttl", victims, ["id"]).count() == 2
    assert indexes.retention_hours(-1) is None
    with pytest.raises(ValueError):
        indexes.retention_hours(5)
    lag = spark.createDataFrame([(100,), (500,), (1000,), (4000,)], "ms int").select(indexes.lag_policy(F.col("ms")).alias("p")).collect()
    assert [(r.p.delayed, round(r.p.throttled, 2)) for r in lag] == [(False, 0.0), (True, 0.0), (True, 0.1), (True, 0.9)]


def test_cursor_and_clock(spark):
    stream = spark.createDataFrame([(i,) for i in range(5)], "seq int")
    rows, at = history.read_cursor(stream, "seq", None, 3)
    assert [r.seq for r in rows] == [0, 1, 2] and at == 2
    assert history.read_cursor(stream, "seq", 4, 3) == ([], 4)
    assert history.advance(2, 2, True) == 2
    for bad in ((2, 1, True), (None, 9, False)):
        with pytest.raises(history.StreamError):
            history.advance(*bad)
    assert history.advance_clock(10, (5, 3)) == (10, 0) and history.advance_clock(5, (7, 3), (7, 9)) == (7, 10)


def test_bucketed_images_equal_images(spark):
    rows = [(k, i, f"v{i}", i % 4 == 0) for k in range(3) for i in range(k, 40, k + 1)]
    log = spark.createDataFrame(rows, "k int, seq long, v string, gone boolean")
    want = history.images(log, ["k"], ["seq"], F.col("gone"))
    got = history.images_by_bucket(log, ["k"], "seq", F.col("gone"), width=7)
    assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect()))


def test_lineage_split_once(spark):
    lanes = spark.createDataFrame([("a", None, False, 0, 100)], "lane string, parent string, sealed boolean, low long, high long")
    split = history.lineage_split(lanes, "a", 40)
    assert {(r.lane, r.sealed, r.low, r.high) for r in split.collect()} == {("a", True, 0, 100), ("a.0", False, 0, 40), ("a.1", False, 40, 100)}
    assert history.lineage_split(split, "a", 40).count() == 3


def test_pressure_splits_after_three_high_samples(spark):
    rows = [("p", i, 200.0) for i in range(4)] + [("q", i, 10.0) for i in range(13)]
    out = history.pressure(spark.createDataFrame(rows, "part string, at int, load double"), "part", "at", "load", 100.0)
    actions = {(r.part, r["at"]): r.action for r in out.collect()}
    assert actions["p", 1] == "KEEP" and actions["p", 2] == "SPLIT" and actions["q", 10] == "KEEP" and actions["q", 11] == "DRAIN"


def test_queue_round_trip(spark):
    sent = queues.send(spark.createDataFrame([(f"m{i}", "q", "b") for i in range(3)], "message_id string, queue string, body string"), 0)
    after, got = queues.receive(sent, 0, 2, 30)
    assert sorted(r.message_id for r in got.collect()) == ["m0", "m1"]
    assert after.count() == 3 and queues.receive(after, 0, 10)[1].count() == 1
    gone, stale = queues.delete(after, got.select("queue", "receipt"))
    assert gone.count() == 1 and stale.count() == 0
    assert queues.delete(gone, got.select("queue", "receipt"))[1].count() == 2
    back = queues.change_visibility(after, got.select("queue", "receipt", F.lit(0).alias("timeout_s")), 5)
    assert queues.receive(back, 5, 10)[1].count() == 3
    with pytest.raises(queues.QueueError):
        queues.send(sent, 0, delay_s=901)
    assert queues.publish_once(sent, sent).count() == 3


def test_delivery_guard(spark):
    pubs = spark.createDataFrame([("p", "t", 5)], "publication_id string, topic string, accepted_at long")
    subs = spark.createDataFrame([("s", "t", "sqs", "q", True, 0, None)], "subscription_id string, topic string, protocol string, endpoint string, confirmed boolean, subscribed_at long, unsubscribed_at long")
    claimed = queues.claim(queues.fan_out(pubs, subs), "w", 10, 100, 5)
    assert queues.claim(claimed, "v", 50, 100, 5).first().owner == "w"
    stale = claimed.select("delivery_id", "owner", (F.col("generation") - 1).alias("generation"), F.lit(True).alias("ok"))
    assert queues.settle(claimed, stale, 20, 10, 3).first().status == "PENDING"
    failed = claimed.select("delivery_id", "owner", "generation", F.lit(False).alias("ok"))
    row = queues.settle(claimed, failed, 20, 10, 1).first()
    assert (row.status, row.attempts) == ("FAILED", 1)


def test_catalog(spark, tmp_path):
    catalog = Catalog(spark, f"file://{tmp_path}")
    made = catalog.create(Table("orders", "pk", attributes={"pk": "S"}))
    with pytest.raises(CatalogError):
        catalog.create(Table("orders", "pk", attributes={"pk": "S"}))
    with pytest.raises(CatalogError):
        Table("ab", "pk", attributes={"pk": "S"}).check()
    catalog.write("orders", spark.createDataFrame([("a", 1)], "pk string, n int"))
    assert reads.get_item(catalog.read("orders"), {"pk": "a"}).first().n == 1
    assert catalog.list() == (["orders"], None)
    catalog.update("orders", protected=True)
    with pytest.raises(CatalogError):
        catalog.delete("orders")
    catalog.update("orders", protected=False)
    catalog.delete("orders")
    assert catalog.create(Table("orders", "pk", attributes={"pk": "S"})).table_id != made.table_id


def test_streams_equal_batches(spark, tmp_path):
    from heddle.streaming.flows import State, append_stream, current_state, index_maintenance

    log = spark.createDataFrame([(i % 4, i, f"v{i}") for i in range(20)], "k int, seq long, v string")
    source = str(tmp_path / "log")
    for part in range(3):
        log.where(F.col("seq") % 3 == part).coalesce(1).write.mode("append").parquet(source)
    read = lambda: spark.readStream.schema("k int, seq long, v string").option("maxFilesPerTrigger", 1).parquet(source)
    state = State(spark, f"file://{tmp_path}/state", "k int, seq long, v string")
    current_state(read(), state, ["k"], "seq", str(tmp_path / "c1")).awaitTermination()
    assert {(r.k, r.seq) for r in state.read().collect()} == {(0, 16), (1, 17), (2, 18), (3, 19)}
    appended = State(spark, f"file://{tmp_path}/append", "k int, seq long, v string")
    append_stream(read(), appended, "v", "seq", str(tmp_path / "c2")).awaitTermination()
    assert appended.read().select("v").distinct().count() == 20 == appended.read().count()
    changes = str(tmp_path / "changes")
    spark.createDataFrame([(1, 1, None, ("a",)), (1, 2, ("a",), ("b",)), (2, 1, None, ("c",))], "id int, seq long, old struct<note:string>, new struct<note:string>").write.parquet(changes)
    entries = State(spark, f"file://{tmp_path}/index", "id int, note string")
    stream = spark.readStream.schema("id int, seq long, old struct<note:string>, new struct<note:string>").parquet(changes)
    index_maintenance(stream, entries, ["id"], ["note"], ["note"], str(tmp_path / "c3")).awaitTermination()
    assert {(r.id, r.note) for r in entries.read().collect()} == {(1, "b"), (2, "c")}


@pytest.fixture
def topic_folder(spark, tmp_path):
    """5,000 events over 7 users, one with most of them, and 400 customers."""
    events = spark.range(5000).selectExpr("id AS event_id", "IF(id % 9 = 0, id % 7, 3) AS user_id")
    customers = spark.range(400).selectExpr("id AS c_custkey", "concat('c', id) AS c_name")
    events.write.parquet(f"{tmp_path}/events.parquet")
    customers.write.parquet(f"{tmp_path}/customer.parquet")
    user = lambda e: e % 7 if e % 9 == 0 else 3
    pairs = {(e, f"{c}-{c % 7}") for e in range(5000) for c in range(400) if c % 7 == user(e) and c % 3 and c * 10 <= e and (c % 2 or c * 10 + 100 > e)}
    return str(tmp_path), pairs


def test_every_publication_and_subscriber_is_fanned_out_settled_and_notified(spark, topic_folder):
    from heddle.operators import queries

    folder, pairs = topic_folder
    rows = queries.QUERIES["t19_fan_out_all"](spark, folder).collect()
    assert sorted(map(tuple, rows)) == sorted(pairs) and max(e for e, _ in pairs) > 1000
    settled = queries.QUERIES["t20_settle_all"](spark, folder).collect()
    want = sorted((e, s, *(("DELIVERED", e) if e % 2 == 0 else ("RETRY_SCHEDULED", queries.SETTLED_AT + 250))) for e, s in pairs)
    assert sorted(map(tuple, settled)) == want
    bodies = queries.QUERIES["t25_notification_all"](spark, folder).collect()
    assert sorted((r.publication_id, r.subscription_id) for r in bodies) == sorted(pairs)


def test_places_of_ties_nulls_and_no_rows_come_from_ranges(spark):
    kept = [(i, None if i % 11 == 0 else i % 3 if i % 2 else i * 7 % 1000) for i in range(2000)]
    rows = spark.createDataFrame(kept, "id long, k long")
    placed = reads.places(rows, ["k", "id"])
    order = sorted(kept, key=lambda r: (r[1] is not None, r[1] or 0, r[0]))
    assert {r.id: r.place for r in placed.collect()} == {i: n + 1 for n, (i, _) in enumerate(order)}
    assert "Exchange SinglePartition" not in placed._jdf.queryExecution().executedPlan().toString()
    assert reads.places(rows.where("id < 0"), ["k", "id"]).collect() == []


def test_whole_table_queries_read_past_the_prefixes(spark, tmp_path):
    from heddle.operators import queries

    spark.range(3000).selectExpr("id AS o_orderkey", "id % 700 AS o_custkey", "'O' AS o_orderstatus").write.parquet(f"{tmp_path}/orders.parquet")
    spark.range(600).selectExpr("id AS c_custkey", "concat('c', id) AS c_name", "CAST(id % 5 AS double) AS c_acctbal").write.parquet(f"{tmp_path}/customer.parquet")
    run = lambda name: [tuple(r) for r in queries.QUERIES[name](spark, str(tmp_path)).collect()]
    assert sorted(run("j1_projection_all")) == [(i, "O") for i in range(3000)]
    assert sorted(r[0] for r in run("s2_batch_get_all")) == list(range(600))
    assert sorted(run("r2_dependent_get_all")) == [(i, f"c{i}" if i < 600 else None) for i in range(700)]
    assert sorted(run("r7_string_template_all")) == sorted((f"cust#{i}#v1", f"c{i}") for i in range(600))
    numbers = {r[0]: r[1:] for r in run("f5_canonical_number_all")}
    assert len(numbers) == 600 and numbers[0] == ("0.5", "0") and numbers[100] == ("100.5", "-0.001")
    assert {p: c for c, p in run("f7_number_order_all")} == {n + 1: c for n, c in enumerate(sorted(range(600), key=lambda c: (c % 5, c)))}


def test_missing_inputs_are_skipped_or_null_beside_rows_that_have_them(spark, tmp_path):
    from heddle.operators import queries

    spark.range(9).selectExpr("id AS o_orderkey").write.parquet(f"{tmp_path}/orders.parquet")
    spark.range(5).selectExpr("id AS p_partkey", "concat('b', id) AS p_brand").write.parquet(f"{tmp_path}/part.parquet")
    run = lambda name: {tuple(r) for r in queries.QUERIES[name](spark, str(tmp_path)).collect()}
    assert run("r4_skip_missing") == {(0, "b0"), (3, "b3"), (6, None)}
    assert run("r4_null_missing") == {(0, "b0"), (3, "b3"), (6, None), (None, None)}


def test_a_settled_delivery_is_not_settled_again(spark):
    pubs = spark.createDataFrame([("p", "t", 5)], "publication_id string, topic string, accepted_at long")
    subs = spark.createDataFrame([("s", "t", "sqs", "q", True, 0, None)], "subscription_id string, topic string, protocol string, endpoint string, confirmed boolean, subscribed_at long, unsubscribed_at long")
    claimed = queues.claim(queues.fan_out(pubs, subs), "w", 10, 100, 5)
    outcome = lambda ok: claimed.select("delivery_id", "owner", "generation", F.lit(ok).alias("ok"), F.lit("no answer").alias("error"))
    failed = queues.settle(claimed, outcome(False), 20, 10, 3)
    row = queues.settle(failed, outcome(False), 21, 10, 3).first()
    assert (row.status, row.attempts, row.owner, row.last_error, row.updated_at, row.due_at) == ("RETRY_SCHEDULED", 1, None, "no answer", 20, 30)
    done = queues.settle(claimed, outcome(True), 20, 10, 3)
    row = queues.settle(done, outcome(False), 21, 10, 3).first()
    assert (row.status, row.attempts, row.last_error, row.updated_at) == ("DELIVERED", 0, None, 20)
    unclaimed = queues.fan_out(pubs, subs).withColumn("owner", F.lit("w"))
    assert queues.settle(unclaimed, unclaimed.select("delivery_id", "owner", "generation", F.lit(True).alias("ok")), 20, 10, 3).first().status == "PENDING"


def test_a_failed_transaction_takes_no_item(spark):
    state = spark.createDataFrame([(1, 10, "a"), (2, 0, "b")], "id int, n int, s string")
    rows = [("t1", 0, "PUT", None, 1, 5, "x"), ("t1", 1, "PUT", "positive", 2, 5, "x"), ("t2", 0, "UPDATE", "positive", 1, 7, None), ("t3", 0, "UPDATE", None, 1, 9, None), ("t4", 0, "UPDATE", None, 9, 4, None)]
    members = spark.createDataFrame(rows, "txn string, ordinal int, kind string, rule string, id int, n int, s string")
    after, outcome = writes.transact(state, members, ["id"], {"positive": F.col("n") > 0})
    assert {(r.id, r.n, r.s) for r in after.collect()} == {(1, 7, "a"), (2, 0, "b"), (9, 4, None)}
    assert {(r.txn, r.ordinal): (r.reason, r.applied) for r in outcome.collect()} == {("t1", 0): ("None", False), ("t1", 1): ("ConditionalCheckFailed", False), ("t2", 0): ("None", True), ("t3", 0): ("TransactionConflict", False), ("t4", 0): ("None", True)}
    for bad in ({"rule": "no such rule"}, {"kind": "UPSERT"}):
        changed = members.withColumns({k: F.lit(v) for k, v in bad.items()})
        with pytest.raises(Exception, match="unknown kind or rule"):
            writes.transact(state, changed, ["id"], {"positive": F.col("n") > 0})[0].collect()
    many = spark.range(101).selectExpr("'t' AS txn", "CAST(id AS int) AS ordinal", "'PUT' AS kind", "CAST(NULL AS string) AS rule", "CAST(id AS int) AS id", "1 AS n", "'x' AS s")
    assert writes.transact(state, many, ["id"], {})[0].count() == 2
    large = many.where("id < 20").withColumn("s", F.repeat(F.lit("y"), 300_000))
    assert {r.reason for r in writes.transact(state, large, ["id"], {})[1].collect()} == {"TooLarge"}


def test_writes_shuffle_the_state_once_and_return_old_items(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        state = spark.range(50).selectExpr("CAST(id AS int) AS id", "CAST(id AS int) AS n")
        requests = spark.range(40, 60).selectExpr("CAST(id AS int) AS id", "-1 AS n")
        rule = E.condition("n < :n", bound={":n": {"N": "45"}})
        after, outcome = writes.put(state, requests, ["id"], rule, returns="ALL_OLD")
        plan = after._jdf.queryExecution().sparkPlan().toString()
        assert plan.count("Join") == 1
        assert {(r.id, r.n) for r in after.collect()} == {(i, -1 if 40 <= i < 45 else i) for i in range(50)}
        assert {r.id: r.old and r.old.n for r in outcome.collect()} == {i: i if i < 45 else None for i in range(40, 60)}
        after, outcome = writes.delete(state, requests, ["id"], rule, returns="ALL_OLD")
        assert after.count() == 45 and {r.id: r.accepted for r in outcome.collect()} == {i: i < 45 for i in range(40, 60)}
        after, _ = writes.update_columns(state, requests, ["id"], {"n": F.coalesce("n", F.lit(0)) + 100, "m": F.col("new.n")})
        assert {(r.id, r.n, r.m) for r in after.collect()} == {(i, i, None) for i in range(40)} | {(i, i + 100 if i < 50 else 100, -1) for i in range(40, 60)}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_request_forms_keep_their_limits(spark):
    state = spark.createDataFrame([(1, "a")], "id int, s string")
    assert {(r.id, r.s) for r in writes.batch_write_request(state, [{"action": "PUT", "id": 2, "s": "b"}, {"action": "DELETE", "id": 1}], ["id"]).collect()} == {(2, "b")}
    for bad in ([], [{"action": "PUT", "id": i} for i in range(26)], [{"action": "PUT", "id": 1}, {"action": "DELETE", "id": 1}], [{"action": "PUT", "id": 1, "s": "x" * 500_000}], [{"action": "ADD", "id": 1}]):
        with pytest.raises(writes.WriteError):
            writes.batch_write_request(state, bad, ["id"])
    table = reads.Relation(state, "id")
    assert [(r.id, r.s) for r in reads.transact_get_request(table, [{"id": 5}, {"id": 1}]).collect()] == [(5, None), (1, "a")]
    with pytest.raises(reads.ReadError):
        reads.transact_get_request(table, [{"id": i} for i in range(101)])


def test_maps_are_equal_by_their_members(spark):
    from heddle.plans.columns import Compiler

    rows = [(1, (5, "x"), ("x", 5), {"a": 5}), (2, (5, None), (None, 5), {"a": 5, "b": None}), (3, None, None, None)]
    df = spark.createDataFrame(rows, "id int, m struct<n:int,s:string>, f struct<s:string,n:int>, g map<string,int>")
    test = lambda text, value=None: {r.id: r.c for r in df.select("id", Compiler(df.schema).condition(E.condition(text, bound={":v": value} if value else None)).alias("c")).collect()}
    assert test("m = :v", {"M": {"s": {"S": "x"}, "n": {"N": "5"}}}) == {1: True, 2: False, 3: False}
    assert test("m = :v", {"M": {"n": {"N": "5"}}}) == {1: False, 2: True, 3: False}
    assert test("m = :v", {"M": {"n": {"S": "5"}}}) == {1: False, 2: False, 3: False}
    assert test("g = :v", {"M": {"a": {"N": "5"}}}) == {1: True, 2: True, 3: False}
    assert test("m = f") == {1: True, 2: True, 3: False}
    assert test("m <> :v", {"M": {"n": {"N": "5"}, "s": {"S": "x"}}}) == {1: False, 2: True, 3: True}


def test_projections_keep_the_nesting(spark):
    df = spark.createDataFrame([(1, (1, 2), ((7,), 8), [10, 20, 30]), (2, None, None, None)], "id int, a struct<x:int,y:int>, b struct<w:struct<z:int>,x:int>, l array<int>")
    table = reads.Relation(df, "id")
    rows = reads.scan(table, projection="id, a.x, b.x, b.w.z, l[2], l[0], nothing").rows().collect()
    assert rows[0].a.asDict() == {"x": 1} and rows[0].b.asDict(recursive=True) == {"x": 8, "w": {"z": 7}} and rows[0].l == [10, 30] and rows[0].nothing is None
    assert rows[1].a is None and rows[1].b is None and rows[1].l is None
    page = reads.scan(table, projection="id, a.x, b.x, b.w.z, l[2], l[0]").page()
    assert page.items == [{"id": 1, "a": {"x": 1}, "b": {"x": 8, "w": {"z": 7}}, "l": [10, 30]}, {"id": 2}]


def test_a_filter_on_what_an_index_leaves_out_is_an_error(spark):
    df = spark.createDataFrame([(1, 2, 3)], "id int, n int, hidden int")
    index = reads.Relation(df, "n", base_key=("id",), projected=("id", "n"))
    with pytest.raises(reads.ReadError, match="hidden"):
        reads.query(index, "n = :n", bound={":n": {"N": "2"}, ":h": {"N": "3"}}, filter="size(hidden) > :h OR NOT hidden = :h")
    assert reads.query(index, "n = :n", bound={":n": {"N": "2"}, ":h": {"N": "1"}}, filter="id >= :h").rows().count() == 1


def test_a_seek_reaches_the_scan_and_a_page_collects_its_budget(spark, tmp_path):
    spark.range(2000).selectExpr("id % 5 AS pk", "id AS sk", "repeat('x', 2000) AS body").write.parquet(f"{tmp_path}/t")
    table = reads.Relation(spark.read.parquet(f"{tmp_path}/t"), "pk", "sk")
    own = reads.scan(table, start={"pk": 3, "sk": 1000})
    assert "GreaterThanOrEqual(pk,3)" in own.rows()._jdf.queryExecution().executedPlan().toString()
    assert {(r.pk, r.sk) for r in own.rows().collect()} == {(i % 5, i) for i in range(2000) if (i % 5, i) > (3, 1000)}
    back = reads.query(table, "pk = :p", bound={":p": {"N": "3"}}, forward=False, start={"pk": 3, "sk": 1000})
    assert [r.sk for r in back.rows().collect()] == [i for i in range(999, -1, -1) if i % 5 == 3]
    page = reads.scan(table).page(most=1000)
    assert page.last_key is not None and page.scanned <= 100
    seen, start, pages = [], None, 0
    while True:
        page = reads.query(table, "pk = :p", bound={":p": {"N": "1"}}, start=start, limit=10_000).page()
        seen += [i["sk"] for i in page.items]
        start, pages = page.last_key, pages + 1
        if start is None:
            break
    assert seen == list(range(1, 2000, 5)) and pages == 1


def test_pages_stop_after_one_mebibyte(spark):
    df = spark.range(30).selectExpr("1 AS pk", "id AS sk", "repeat('x', 100000) AS body")
    table, start, sizes = reads.Relation(df, "pk", "sk"), None, []
    while True:
        page = reads.query(table, "pk = :p", bound={":p": {"N": "1"}}, start=start).page()
        sizes.append(page.scanned)
        if (start := page.last_key) is None:
            break
    assert sum(sizes) == 30 and sizes == [10, 10, 10]


def test_the_first_invocation_of_a_key_survives(spark):
    parents = reads.Relation(spark.createDataFrame([(1, "k", "zz"), (2, "k", "aa"), (3, "j", "mm")], "id int, wanted string, mark string"), "id")
    child = reads.Relation(spark.createDataFrame([("k", 1), ("j", 2)], "pk string, n int"), "pk")
    nodes = [read_sequence.Node("a", "QUERY", parents), read_sequence.Node("b", "GET", child, {"pk": read_sequence.From("a", "wanted")}, many=True)]
    rows = {r.pk: r.m for r in read_sequence.read_sequence(nodes)["b"].select("pk", F.col("__parent.mark").alias("m")).collect()}
    assert rows == {"k": "zz", "j": "mm"}
    with pytest.raises(read_sequence.SequenceError, match="not a string"):
        read_sequence.read_sequence([nodes[0], read_sequence.Node("b", "GET", child, {"pk": read_sequence.Template("x{i}", {"i": read_sequence.From("a", "id")})}, many=True)])


def test_a_node_bound_from_two_others(spark):
    orgs = reads.Relation(spark.createDataFrame([("o1", "red"), ("o2", "blue")], "org string, colour string"), "org")
    users = reads.Relation(spark.createDataFrame([("u1",), ("u2",)], "user string"), "user")
    seats = reads.Relation(spark.createDataFrame([("red#u1", 1), ("red#u2", 2), ("blue#u1", 3)], "pk string, seat int"), "pk")
    key = read_sequence.Template("{c}#{u}", {"c": read_sequence.From("org", "colour"), "u": read_sequence.From("users", "user")})
    node = lambda **more: read_sequence.Node("seats", "GET", seats, {"pk": key}, many=True, **more)
    first = [read_sequence.Node("org", "GET", orgs, {"org": "o1"}), read_sequence.Node("users", "QUERY", users)]
    assert {(r.pk, r.seat) for r in read_sequence.read_sequence([*first, node(iterate="users")])["seats"].collect()} == {("red#u1", 1), ("red#u2", 2)}
    with pytest.raises(read_sequence.SequenceError, match="must name"):
        read_sequence.read_sequence([*first, node()])
    both = [read_sequence.Node("org", "QUERY", orgs), first[1], node(iterate="users")]
    with pytest.raises(Exception, match="(?i)more than one row|too_many_rows"):
        read_sequence.read_sequence(both)["seats"].collect()


def test_pressure_follows_the_controller(spark):
    from heddle.functions import hashing

    loads = [150.0, 300.0, 20.0, 10.0, 500.0, 400.0, 390.0, 380.0, 5.0] + [1.0] * 30
    rows = {r["at"]: r for r in history.pressure(spark.createDataFrame([("p", i, x) for i, x in enumerate(loads)], "part string, at int, load double"), "part", "at", "load", 100.0).collect()}
    smooth, total, high, low = 0.0, 0.0, 0, 0
    for i, x in enumerate(v / 100 for v in loads):
        smooth = x if smooth <= 0 else 0.4 * x + 0.6 * smooth
        total = min(4.0, max(-2.0, total + smooth - 1))
        high, low = (high + 1, 0) if x >= 1 else (0, low + 1) if x <= 0.35 else (0, 0)
        want = "SPLIT" if high >= 3 and smooth + 0.2 * total >= 1.3 else "DRAIN" if low >= 12 and smooth + 0.2 * total <= 0.35 else "KEEP"
        assert (rows[i].high_streak, rows[i].low_streak, rows[i].action) == (high, low, want) and rows[i].pressure == pytest.approx(smooth + 0.2 * total)
    texts = ["", "a", "orders", "é漢"]
    got = spark.createDataFrame([(x,) for x in texts], "t string").select("t", hashing.change_slot_column(F.col("t")).alias("s")).collect()
    assert {r.t: r.s for r in got} == {x: hashing.change_slot(x) for x in texts}


def test_topics_and_subscriptions(spark):
    from heddle.operators import topics

    none = spark.createDataFrame([], "topic string, display_name string, created_at long")
    names = lambda *given: spark.createDataFrame([(n,) for n in given], "topic string")
    held = topics.create(topics.create(none, names("a", "b", "a"), 1), names("a", "c"), 5)
    assert sorted((r.topic, r.created_at) for r in held.collect()) == [("a", 1), ("b", 1), ("c", 5)]
    for wrong in ("", "x.fifo", "x y", "x" * 257, None):
        with pytest.raises(Exception, match="invalid topic name"):
            topics.create(none, names(wrong), 1).collect()

    empty = spark.createDataFrame([], "subscription_id string, topic string, protocol string, endpoint string, raw boolean, confirmed boolean, token string, subscribed_at long, unsubscribed_at long")
    asked = spark.createDataFrame([("a", "sqs", "q"), ("a", "http", "http://x"), ("a", "http", "http://x"), ("a", "https", "http://x"), ("zz", "sqs", "q"), ("a", "mail", "x"), ("a", "sqs", ""), ("a", None, None)], "topic string, protocol string, endpoint string")
    subs, results = topics.subscribe(held, empty, asked, 7)
    errors = sorted((r.protocol or "", r.endpoint or "", r.error) for r in results.where("error IS NOT NULL").collect())
    assert errors == [("", "", "UnsupportedProtocol"), ("https", "http://x", "InvalidEndpoint"), ("mail", "x", "UnsupportedProtocol"), ("sqs", "", "InvalidEndpoint"), ("sqs", "q", "NotFound")]
    again, same = topics.subscribe(held, subs, asked, 9)
    assert again.count() == 2 and {r[0] for r in same.select("subscription_id").dropna().collect()} == {r[0] for r in subs.select("subscription_id").collect()}
    shown = lambda s: {r.topic: (r.confirmed, r.pending) for r in topics.attributes(held, s).collect()}
    assert shown(subs) == {"a": (1, 1), "b": (0, 0), "c": (0, 0)}
    tokens = subs.where("token IS NOT NULL").select("topic", "token")
    after, lost = topics.confirm(subs, tokens.unionByName(spark.createDataFrame([("a", "no")], "topic string, token string")))
    assert shown(after)["a"] == (2, 0) and [r.token for r in lost.collect()] == ["no"]
    ended = topics.unsubscribe(after, after.where("protocol = 'sqs'").select("subscription_id"), 11)
    assert shown(ended)["a"] == (1, 0) and ended.count() == 2
    assert [t.count() for t in topics.delete(held, ended, names("a", "none"))] == [2, 0]

    sent = spark.createDataFrame([("1", "a", "m", None), ("2", "no", "m", None), ("3", "a", "", None), ("4", "a", "m", "s" * 101)], "publication_id string, topic string, message string, subject string")
    accepted, refused = topics.publish(held, sent, 12)
    assert [r.publication_id for r in accepted.collect()] == ["1"] and sorted(r.error for r in refused.collect()) == ["EmptyMessage", "InvalidParameter", "NotFound"]
    assert [r.topic for r in topics.page(held, "topic", "a", 1).collect()] == ["b"]
    assert topics.set_attribute(held, "topic", "a", "DisplayName", "A").where("display_name = 'A'").count() == 1
    with pytest.raises(Exception, match="unsupported"):
        topics.set_attribute(held, "topic", "a", "Policy", "x")


def test_expiry_is_read_by_value(spark):
    """Doubles of 10^7 and more, whose text has an exponent, are seconds like any other."""
    rows = [(0, 5.0, 5), (1, 9_999_999.0, 9_999_999), (2, 1e7, 10**7), (3, 17_999_997.0, 17_999_997), (4, -2e10, -2 * 10**10), (5, 2.0**62, 2**62), (6, -(2.0**63), -(2**63)), (7, -0.0, 0)]
    out = [(20, 0.5), (21, 10_000_000.5), (22, 2.0**63), (23, -1e19), (24, float("nan")), (25, float("inf")), (26, None), (27, float("-inf"))]
    items = spark.createDataFrame([r[:2] for r in rows] + out, "id int, ttl double")
    assert {r.id: r.ttl_seconds for r in indexes.ttl_index(items, "ttl").collect()} == {r[0]: r[2] for r in rows}
    floats = spark.createDataFrame([(1, 16777216.0), (2, 2.0**63), (3, 0.5)], "id int, ttl float")
    assert [(r.id, r.ttl_seconds) for r in indexes.ttl_index(floats, "ttl").collect()] == [(1, 2**24)]
    texts = [("1", 12345678), ("2", None), ("3", 2**63 - 1), ("4", None)]
    exact = spark.createDataFrame(list(zip("1234", ["12345678.00", "12345678.01", "9223372036854775807", "9223372036854775808"])), "id string, t string").selectExpr("id", "cast(t as decimal(38,2)) ttl")
    assert {r.id: r.ttl_seconds for r in indexes.ttl_index(exact, "ttl").collect()} == {k: v for k, v in texts if v is not None}
    assert indexes.ttl_index(spark.createDataFrame([(1, "5")], "id int, ttl string"), "ttl").isEmpty()
    victims = indexes.expired(items, "ttl", 10**7, ["id"])
    assert sorted(r.id for r in victims.collect()) == [0, 1, 2, 4, 6, 7]
    assert indexes.sweep(items, "ttl", victims, ["id"]).count() == len(rows) + len(out) - 6


def test_appended_numbers_do_not_depend_on_the_dealing(spark, tmp_path):
    """Rows enough that range bounds by a random sample would differ between two runs."""
    events = spark.range(40_000).select(F.col("id").alias("event_id"), F.concat(F.lit("e"), "id").alias("props"))
    held = events.where("event_id < 10").select("event_id", F.col("event_id").cast("int").alias("seq"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = history.append_once(held, events.unionByName(events), "event_id", "seq")
        for part in (out.where("event_id >= 0"), out.where("seq >= 0")):
            assert part.where("seq <> event_id").isEmpty() and part.count() == 40_000
        events.write.parquet(f"{tmp_path}/events.parquet")
        rows = queries.QUERIES["t12_append_once"](spark, str(tmp_path)).collect()
        order = sorted(range(40_000), key=lambda i: (i % 3 != 0, i))
        assert {(r.event_id, r.kept_seq, r.place) for r in rows} == {(i, i if i % 3 == 0 else None, n) for n, i in enumerate(order, 1)}
        assert len(rows) == 40_000
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_places_on_both_sides_of_every_bound(spark):
    for n in (0, 1, 19, 20, 21, 40, 61, 200):
        rows = spark.createDataFrame([(i % 7 if i % 7 else None, f"{i:03}") for i in range(n)], "a int, b string")
        got = {(r.a, r.b): r.place for r in reads.places(rows, ["a", "b"]).collect()}
        assert got == {k: i for i, k in enumerate(sorted(got, key=lambda k: (k[0] or 0, k[1])), 1)} and len(got) == n


def test_pressure_is_one_pass_over_a_series(spark):
    """A long series, its state carried from batch to batch; no list of a partition's samples, no join back to them."""
    n = 20_000
    load = lambda p, i: float((i * 7919 + p * 31) % 211)
    samples = spark.createDataFrame([(f"p{p}", i, load(p, i), i % 3) for i in reversed(range(n)) for p in (0, 1)], "part string, at int, load double, mark int").repartition(8)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "997")
    try:
        out = history.pressure(samples, "part", "at", "load", 100.0, queue=True)
        rows = {(r["part"], r["at"]): r for r in out.collect()}
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert "collect_list" not in plan and "Join" not in plan
    assert out.columns == ["part", "at", "load", "mark", "pressure", "high_streak", "low_streak", "action"] and len(rows) == 2 * n
    for p in (0, 1):
        smooth, total, high, low = 0.0, 0.0, 0, 0
        for i in range(n):
            x = load(p, i) / 100.0
            smooth = x if smooth <= 0 else 0.4 * x + 0.6 * smooth
            total = max(-2.0, min(4.0, total + smooth - 1.0))
            high, low = (high + 1 if x >= 1 else 0), (low + 1 if x <= 0.35 else 0)
            r = rows[f"p{p}", i]
            want = "ADD" if high >= 3 and smooth + 0.2 * total >= 1.2 else "DRAIN" if low >= 12 and smooth + 0.2 * total <= 0.35 else "KEEP"
            assert (r.pressure, r.high_streak, r.low_streak, r.action, r.load, r.mark) == (smooth + 0.2 * total, high, low, want, load(p, i), i % 3)


def test_pressure_keeps_every_sample_once(spark):
    """Two samples at one time stay two, in the order of their loads; one without a time comes last."""
    rows = [("a", 1, 200.0), ("a", 1, 100.0), ("a", None, 50.0), ("a", 2, 0.0), ("b", 1, None), ("b", 2, 300.0), ("c", 1, float("nan"))]
    out = history.pressure(spark.createDataFrame(rows, "part string, at int, load double"), "part", "at", "load", 100.0)
    got = sorted(((r["part"], r["at"], r.load, r.pressure, r.high_streak, r.low_streak) for r in out.collect()), key=lambda r: (r[0], r[1] or 9, str(r[2])))
    assert len(got) == len(rows)
    assert [(r[4], r[5]) for r in got] == [(1, 0), (2, 0), (0, 1), (0, 0), (0, 0), (1, 0), (1, 0)]
    smooth = [1.0, 1.4, 0.84, 0.704]
    total = [0.0, 0.4, 0.24, -0.056]
    assert [r[3] for r in got[:4]] == pytest.approx([e + 0.2 * i for e, i in zip(smooth, total, strict=True)])
    assert [r[3] for r in got[4:6]] == [None, None] and got[6][3] != got[6][3]
