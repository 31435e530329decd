"""Queues and topics: each step a function from state and requests to state and results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RECEIVE_MOST, DELAY_MOST, BODY_BYTES = 10, 900, 262_144
#: Columns of a message row; times are epoch milliseconds.
MESSAGE = "message_id string, queue string, body string, receive_count int, receipt string, created_at long, visible_at long, expires_at long"


class QueueError(ValueError):
    pass


def send(requests: DataFrame, now: int, *, delay_s: int = 0, retention_s: int = 345_600) -> DataFrame:
    """Message rows from (message_id, queue, body[, delay_s]); body sizes and delays are checked."""
    if not 0 <= delay_s <= DELAY_MOST:
        raise QueueError("a delay is 0 to 900 seconds")
    delay = F.coalesce("delay_s", F.lit(delay_s)) if "delay_s" in requests.columns else F.lit(delay_s)
    body = F.when(F.octet_length("body") > BODY_BYTES, F.raise_error(F.lit("message body too large"))).otherwise(F.col("body"))
    return requests.select(
        "message_id", "queue", body.alias("body"), F.lit(0).alias("receive_count"), F.lit(None).cast("string").alias("receipt"),
        F.lit(now).cast("long").alias("created_at"), (F.lit(now) + delay * 1000).cast("long").alias("visible_at"), F.lit(now + retention_s * 1000).cast("long").alias("expires_at"),
    )


def receive(messages: DataFrame, now: int, most: int = 1, timeout_s: int = 30) -> tuple[DataFrame, DataFrame]:
    """(messages after, received): per queue the first ``most`` due rows by (visible_at, message_id).

    Expired ones among them are deleted and still take a place; the others get a receipt,
    one more receive and a new visibility. The choice is a rank over due rows only.
    """
    if not 1 <= most <= RECEIVE_MOST:
        raise QueueError("1 to 10 messages are received")
    w = Window.partitionBy("queue").orderBy("visible_at", "message_id")
    page = messages.where(F.col("visible_at") <= now).withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= most).drop("__n")
    live = page.where(F.col("expires_at") > now)
    receipt = F.sha2(F.concat_ws("/", "message_id", (F.col("receive_count") + 1).cast("string"), F.lit(str(now))), 256)
    taken = live.withColumns({"receipt": receipt, "receive_count": F.col("receive_count") + 1, "visible_at": F.lit(now + timeout_s * 1000).cast("long")})
    rest = messages.join(page.select("queue", "message_id"), ["queue", "message_id"], "left_anti")
    return rest.unionByName(taken), taken


def delete(messages: DataFrame, receipts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(messages after, receipts that no longer name a message). receipts: queue, receipt."""
    return messages.join(receipts, ["queue", "receipt"], "left_anti"), receipts.join(messages, ["queue", "receipt"], "left_anti")


def change_visibility(messages: DataFrame, requests: DataFrame, now: int) -> DataFrame:
    """requests: queue, receipt, timeout_s. Only the current receipt of a message counts."""
    own = messages.join(requests, ["queue", "receipt"], "left")
    return own.withColumn("visible_at", F.when(F.col("timeout_s").isNotNull(), F.lit(now) + F.col("timeout_s") * 1000).otherwise(F.col("visible_at")).cast("long")).select(*messages.columns)


def counts(messages: DataFrame, now: int) -> DataFrame:
    """Unexpired messages per queue: visible, in flight (a receipt, not due), delayed (no receipt, not due)."""
    due = F.col("visible_at") <= now
    held = F.col("receipt").isNotNull()
    total = lambda test: F.sum(F.when(test, 1).otherwise(0)).cast("long")
    return messages.where(F.col("expires_at") > now).groupBy("queue").agg(total(due).alias("visible"), total(~due & held).alias("in_flight"), total(~due & ~held).alias("delayed"))


def purge(messages: DataFrame, queue: str) -> DataFrame:
    return messages.where(F.col("queue") != queue)


def cleanup(messages: DataFrame, retired: DataFrame, now: int) -> DataFrame:
    """Without messages that have expired or whose queue is retired (column queue)."""
    return messages.where(F.col("expires_at") > now).join(retired, "queue", "left_anti")


def publish_once(messages: DataFrame, batch: DataFrame) -> DataFrame:
    """Identity-stable publication: a message id already in the queue is not added again."""
    fresh = batch.dropDuplicates(["queue", "message_id"]).join(messages.select("queue", "message_id"), ["queue", "message_id"], "left_anti")
    return messages.unionByName(fresh.select(*messages.columns))


def attribute_digest(body: Column) -> Column:
    return F.md5(body.cast("binary"))


# -- topics -----------------------------------------------------------------------------------


def fan_out(publications: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Deliveries: every publication to the confirmed subscriptions its topic had when it was accepted."""
    own = subscriptions.where("confirmed")
    joined = publications.join(own, "topic").where((F.col("subscribed_at") <= F.col("accepted_at")) & (F.col("unsubscribed_at").isNull() | (F.col("unsubscribed_at") > F.col("accepted_at"))))
    return joined.select(
        F.sha2(F.concat_ws("/", "publication_id", "subscription_id"), 256).alias("delivery_id"), "publication_id", "subscription_id", "protocol", "endpoint",
        F.lit("PENDING").alias("status"), F.lit(0).alias("attempts"), F.lit(0).cast("long").alias("generation"), F.lit(None).cast("string").alias("owner"), F.col("accepted_at").alias("due_at"), F.lit(None).cast("long").alias("lease_until"),
        F.lit(None).cast("string").alias("last_error"), F.col("accepted_at").cast("long").alias("updated_at"),
    )


def claim(deliveries: DataFrame, owner: str, now: int, lease_ms: int, most: int | None) -> DataFrame:
    """Up to ``most`` due rows (None: all of them) without a live lease go to the owner, a generation higher."""
    free = F.col("status").isin("PENDING", "RETRY_SCHEDULED") & (F.col("due_at") <= now) & (F.col("lease_until").isNull() | (F.col("lease_until") <= now))
    if most is None:
        own = deliveries.withColumn("__mine", F.when(free, True))
    else:
        chosen = deliveries.where(free).orderBy("due_at", "delivery_id").limit(most).select("delivery_id", F.lit(True).alias("__mine"))
        own = deliveries.join(F.broadcast(chosen), "delivery_id", "left")  # ``most`` rows
    mine = F.col("__mine").isNotNull()
    return own.withColumns(
        {"generation": F.when(mine, F.col("generation") + 1).otherwise(F.col("generation")), "owner": F.when(mine, F.lit(owner)).otherwise(F.col("owner")), "lease_until": F.when(mine, F.lit(now + lease_ms).cast("long")).otherwise(F.col("lease_until"))}
    ).select(*deliveries.columns)


def settle(deliveries: DataFrame, outcomes: DataFrame, now: int, base_ms: int, attempts_most: int) -> DataFrame:
    """outcomes: delivery_id, owner, generation, ok[, error]. Only the current claim settles, and once.

    A failure counts an attempt; the last one fails the delivery, others are due again after
    base * 2^min(attempts - 1, 10). A settled delivery has no owner, so that the same outcome
    given again, or a late one, changes nothing.
    """
    given = outcomes if "error" in outcomes.columns else outcomes.withColumn("error", F.lit(None).cast("string"))
    own = deliveries.join(given.withColumnsRenamed({"owner": "__owner", "generation": "__generation", "ok": "__ok", "error": "__error"}), "delivery_id", "left")
    valid = (F.col("owner") == F.col("__owner")) & (F.col("generation") == F.col("__generation")) & (F.col("generation") > 0)
    failed = F.coalesce(valid & ~F.col("__ok"), F.lit(False))
    passed = F.coalesce(valid & F.col("__ok"), F.lit(False))
    attempts = F.col("attempts") + F.when(failed, 1).otherwise(0)
    wait = F.lit(base_ms) * F.pow(F.lit(2.0), F.least(attempts - 1, F.lit(10)))
    return own.withColumns(
        {
            "status": F.when(passed, "DELIVERED").when(failed & (attempts >= attempts_most), "FAILED").when(failed, "RETRY_SCHEDULED").otherwise(F.col("status")),
            "due_at": F.when(failed & (attempts < attempts_most), (F.lit(now) + wait).cast("long")).otherwise(F.col("due_at")),
            "lease_until": F.when(passed | failed, F.lit(None)).otherwise(F.col("lease_until")).cast("long"),
            "owner": F.when(~(passed | failed), F.col("owner")),
            "last_error": F.when(passed, F.lit(None).cast("string")).when(failed, F.coalesce("__error", F.lit("failed"))).otherwise(F.col("last_error")),
            "updated_at": F.when(passed | failed, F.lit(now).cast("long")).otherwise(F.col("updated_at")),
            "attempts": attempts,
        }
    ).select(*deliveries.columns)


def notification(deliveries: DataFrame, publications: DataFrame) -> DataFrame:
    """The body of every delivery: the message as it is if raw, else a JSON notification."""
    joined = deliveries.join(publications, "publication_id")
    body = F.to_json(F.struct(F.lit("Notification").alias("Type"), F.col("publication_id").cast("string").alias("MessageId"), F.col("topic").alias("TopicArn"), F.col("message").alias("Message")))
    return joined.select("delivery_id", F.when(F.col("raw"), F.col("message")).otherwise(body).alias("body"))
