"""Topics and subscriptions as tables: each request batch a function from state to state and results.

topics: topic, display_name, created_at. subscriptions: subscription_id, topic, protocol,
endpoint, raw, confirmed, token, subscribed_at, unsubscribed_at; ``queues.fan_out`` reads them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heddle.operators.queues import BODY_BYTES, QueueError

# Fixed values of the interface
PROTOCOLS = {"sqs": "", "http": "http://", "https": "https://"}
TOPIC_ATTRIBUTES, SUBSCRIPTION_ATTRIBUTES = ("DisplayName",), ("RawMessageDelivery",)
NAME, NAME_BYTES, SUBJECT_CHARACTERS, PAGE_MOST = "^[A-Za-z0-9_-]+$", 256, 100, 100


def valid_name(name: Column) -> Column:
    return F.coalesce(name.rlike(NAME) & (F.octet_length(name) <= NAME_BYTES), F.lit(False))


def create(topics: DataFrame, names: DataFrame, now: int) -> DataFrame:
    """The topics after; names (topic) that exist already change nothing, invalid ones are an error."""
    name = F.when(valid_name(F.col("topic")), F.col("topic")).otherwise(F.raise_error(F.lit("invalid topic name")))
    fresh = names.select(name.alias("topic")).distinct().join(topics.select("topic"), "topic", "left_anti")
    return topics.unionByName(fresh.select("topic", F.lit(None).cast("string").alias("display_name"), F.lit(now).cast("long").alias("created_at")))


def delete(topics: DataFrame, subscriptions: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(topics, subscriptions) without the named topics; a name without a topic changes nothing."""
    gone = names.select("topic").distinct()
    return topics.join(gone, "topic", "left_anti").select(*topics.columns), subscriptions.join(gone, "topic", "left_anti").select(*subscriptions.columns)


def subscribe(topics: DataFrame, subscriptions: DataFrame, requests: DataFrame, now: int) -> tuple[DataFrame, DataFrame]:
    """requests: topic, protocol, endpoint. (subscriptions after, results with subscription_id or error).

    Topic, protocol and endpoint name a subscription: asked for again it is the one there is.
    Queues are confirmed at once, web endpoints wait for their token.
    """
    begins = F.coalesce(*[F.when(F.col("protocol") == p, F.col("endpoint").startswith(start) & (F.col("endpoint") != "")) for p, start in PROTOCOLS.items()], F.lit(False))
    known = topics.select("topic", F.lit(True).alias("__known"))
    error = F.when(~F.coalesce(F.col("protocol").isin(*PROTOCOLS), F.lit(False)), "UnsupportedProtocol").when(~begins, "InvalidEndpoint").when(F.col("__known").isNull(), "NotFound")
    checked = requests.select("topic", "protocol", "endpoint").distinct().join(known, "topic", "left").withColumn("error", error).drop("__known")
    held = subscriptions.where("unsubscribed_at IS NULL").select("topic", "protocol", "endpoint", F.col("subscription_id").alias("__held"))
    placed = checked.join(held, ["topic", "protocol", "endpoint"], "left")
    name = F.sha2(F.concat_ws("\n", "topic", "protocol", "endpoint", F.lit(str(now))), 256)
    results = placed.select("topic", "protocol", "endpoint", F.when(F.col("error").isNull(), F.coalesce("__held", name)).alias("subscription_id"), "error", F.col("__held").isNotNull().alias("__old"))
    waits = F.col("protocol") != "sqs"
    fresh = results.where("error IS NULL AND NOT __old").select(
        "subscription_id", "topic", "protocol", "endpoint", F.lit(False).alias("raw"), (~waits).alias("confirmed"), F.when(waits, F.sha2(F.concat(F.lit("token/"), F.col("subscription_id")), 256)).alias("token"),
        F.lit(now).cast("long").alias("subscribed_at"), F.lit(None).cast("long").alias("unsubscribed_at"),
    )
    return subscriptions.unionByName(fresh), results.drop("__old")


def confirm(subscriptions: DataFrame, tokens: DataFrame) -> tuple[DataFrame, DataFrame]:
    """tokens: topic, token. (subscriptions after, tokens that name none)."""
    given = tokens.select("topic", "token").distinct()
    own = subscriptions.join(given.withColumn("__given", F.lit(True)), ["topic", "token"], "left")
    after = own.withColumn("confirmed", F.col("confirmed") | F.col("__given").isNotNull()).select(*subscriptions.columns)
    return after, given.join(subscriptions.select("topic", "token"), ["topic", "token"], "left_anti")


def unsubscribe(subscriptions: DataFrame, ids: DataFrame, now: int) -> DataFrame:
    """ids: subscription_id. The rows stay, ended, for publications accepted before."""
    own = subscriptions.join(ids.select("subscription_id").distinct().withColumn("__gone", F.lit(True)), "subscription_id", "left")
    ended = F.when(F.col("__gone") & F.col("unsubscribed_at").isNull(), F.lit(now).cast("long")).otherwise(F.col("unsubscribed_at"))
    return own.withColumn("unsubscribed_at", ended).select(*subscriptions.columns)


def set_attribute(table: DataFrame, key: str, value: str, attribute: str, given: str) -> DataFrame:
    """DisplayName of a topic, RawMessageDelivery of a subscription; others are refused."""
    if attribute in TOPIC_ATTRIBUTES and "display_name" in table.columns:
        return table.withColumn("display_name", F.when(F.col(key) == value, F.lit(given)).otherwise(F.col("display_name")))
    if attribute in SUBSCRIPTION_ATTRIBUTES and "raw" in table.columns:
        return table.withColumn("raw", F.when(F.col(key) == value, F.lit(given == "true")).otherwise(F.col("raw")))
    raise QueueError(f"unsupported attribute {attribute}")


def attributes(topics: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Per topic its display name and the numbers of its confirmed and pending subscriptions."""
    total = lambda test: F.sum(test.cast("long"))
    live = subscriptions.where("unsubscribed_at IS NULL").groupBy("topic").agg(total(F.col("confirmed")).alias("c"), total(~F.col("confirmed")).alias("p"))
    zero = F.lit(0).cast("long")
    return topics.join(live, "topic", "left").select("topic", F.coalesce("display_name", F.lit("")).alias("display_name"), F.coalesce("c", zero).alias("confirmed"), F.coalesce("p", zero).alias("pending"))


def page(table: DataFrame, key: str, after: str | None = None, limit: int = PAGE_MOST) -> DataFrame:
    """The next rows in the order of the key; the last one's key continues the list."""
    if not 1 <= limit <= PAGE_MOST:
        raise QueueError("a page has 1 to 100 rows")
    return (table if after is None else table.where(F.col(key) > after)).orderBy(key).limit(limit)


def publish(topics: DataFrame, requests: DataFrame, now: int) -> tuple[DataFrame, DataFrame]:
    """requests: publication_id, topic, message, subject. (publications accepted, requests refused with their error)."""
    too_long = (F.octet_length("message") > BODY_BYTES) | (F.coalesce(F.char_length("subject"), F.lit(0)) > SUBJECT_CHARACTERS)
    error = F.when(F.col("__known").isNull(), "NotFound").when(F.col("message").isNull() | (F.col("message") == ""), "EmptyMessage").when(too_long, "InvalidParameter")
    checked = requests.join(topics.select("topic", F.lit(True).alias("__known")), "topic", "left").withColumn("error", error).drop("__known")
    accepted = checked.where("error IS NULL").select("publication_id", "topic", "message", "subject", F.lit(now).cast("long").alias("accepted_at"))
    return accepted, checked.where("error IS NOT NULL")
