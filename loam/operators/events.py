"""Sessions, events, limits and the classifiers around them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loam.functions.crypto import hmac_sha256_hex, same_hex, too_large
from loam.functions.storage import materialize
from loam.functions.text import mask_nested, redact_homes
from loam.operators.vectors import QUERY_BYTES, VECTOR_BYTES, most_similar

# Seconds after a rotation in which a replay is harmless, days a session lives, and days of a mature card.
GRACE_SECONDS, SESSION_DAYS, MATURE_DAYS = 60, 30, 21
STATUSES = ["draft", "review", "approved", "published", "flagged"]


def timestamp(c: Column) -> Column:
    """Either of the two text formats that the tables hold; null if unparsable."""
    return F.coalesce(F.try_to_timestamp(c, F.lit("yyyy-MM-dd HH:mm:ss")), F.try_to_timestamp(c, F.lit("yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")), F.try_to_timestamp(c))


def session_state(revoked_at: Column, expires_at: Column, found: Column, now: Column) -> Column:
    """not_found, rotated_recently, revoked, expired or ok, of timestamps; an unparsable expiry, null, is expired."""
    since = F.unix_millis(now) - F.unix_millis(revoked_at)
    return (
        F.when(~F.coalesce(found, F.lit(False)), "not_found")
        .when(revoked_at.isNotNull() & (since <= GRACE_SECONDS * 1000), "rotated_recently")
        .when(revoked_at.isNotNull(), "revoked")
        .when(expires_at.isNull() | (expires_at <= now), "expired")
        .otherwise("ok")
    )


def classify_tokens(tokens: DataFrame, sessions: DataFrame, now: Column, key: str = "refresh_token_hash") -> DataFrame:
    """``tokens`` with user_id and state of the session that each names."""
    own = sessions.select(key, "user_id", "revoked_at", "expires_at").withColumn("_found", F.lit(True))
    joined = tokens.join(own, key, "left")
    return joined.withColumn("state", session_state(F.col("revoked_at"), F.col("expires_at"), F.col("_found"), now)).drop("_found", "revoked_at", "expires_at")


def revoke_reused(sessions: DataFrame, classified: DataFrame, now: Column) -> DataFrame:
    """``sessions`` with all live ones of users who presented a revoked token revoked at ``now``."""
    users = classified.where("state = 'revoked'").select("user_id").distinct().withColumn("_reuse", F.lit(True))
    marked = sessions.join(users, "user_id", "left")
    return marked.withColumn("revoked_at", F.when(F.col("_reuse") & F.col("revoked_at").isNull(), now).otherwise(F.col("revoked_at"))).select(*sessions.columns)


def ingest(events: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``events`` with replayed: true for all but a key's first event, by ``order``."""
    return events.withColumn("replayed", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) > 1)


def verified(events: DataFrame, secret: str) -> DataFrame:
    """``events`` (payload, signature) with state: too_large, forged or ok."""
    good = same_hex(F.col("signature"), hmac_sha256_hex(F.col("payload"), secret))
    return events.withColumn("state", F.when(too_large(F.col("payload")), "too_large").when(~good, "forged").otherwise("ok"))


def payload_state(payload: Column, header_key: Column | None = None) -> Column:
    """Struct of state (ok, malformed, bad_id, bad_type), event_id and event_type of a JSON payload."""
    parsed = F.try_parse_json(payload)
    get = lambda p: F.try_variant_get(parsed, p, "string")
    own = F.coalesce(get("$.id"), get("$.event_id"), *([header_key] if header_key is not None else []))
    kind = F.coalesce(get("$.type"), get("$.event_type"))
    ok_id, ok_kind = F.length(own).between(1, 128), F.length(kind).between(1, 64)
    state = F.when(parsed.isNull(), "malformed").when(~F.coalesce(ok_id, F.lit(False)), "bad_id").when(~F.coalesce(ok_kind, F.lit(False)), "bad_type").otherwise("ok")
    return F.struct(state.alias("state"), own.alias("event_id"), kind.alias("event_type"))


def over_limit(events: DataFrame, ts: str, keys: list[str], seconds: int, limit: int) -> DataFrame:
    """window_start, keys, n: tumbling windows in which a key has more than ``limit`` events."""
    counted = events.groupBy(F.window(ts, f"{seconds} seconds").alias("w"), *keys).agg(F.count("*").alias("n"))
    return counted.where(F.col("n") > limit).select(F.col("w.start").alias("window_start"), *keys, "n")


def breaker(calls: DataFrame, ts: str, failed: str, least: int = 20, share: float = 0.5) -> DataFrame:
    """window_start, calls, failures, open: sliding minutes, open when over half of at least twenty calls failed."""
    w = calls.groupBy(F.window(ts, "60 seconds", "10 seconds").alias("w")).agg(F.count("*").alias("calls"), F.count_if(failed).alias("failures"))
    return w.select(F.col("w.start").alias("window_start"), "calls", "failures", ((F.col("calls") >= least) & (F.col("failures") > F.col("calls") * share)).alias("open"))


def last_writes(writes: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last write of each key wins."""
    others = [c for c in writes.columns if c != key]
    return writes.groupBy(key).agg(F.max_by(F.struct(*others), F.struct(*order)).alias("row")).select(key, "row.*").select(*writes.columns)


def progress(rows: DataFrame, now: Column, by: list[str] = ["user_id"]) -> DataFrame:  # noqa: B006
    """Reviews, correct answers, mature cards and due cards; zeros where there is nothing to sum."""
    total = lambda c: F.coalesce(F.sum(F.coalesce(c, F.lit(0))), F.lit(0)).cast("long").alias(c)
    return rows.groupBy(*by).agg(total("total_reviews"), total("correct_count"), F.count_if(F.col("fsrs_interval") >= MATURE_DAYS).alias("mature"), F.count_if(F.col("fsrs_next_review") <= now).alias("due"))


def by_status(rows: DataFrame, status: str, statuses: list[str] = STATUSES) -> DataFrame:
    """pos, status, n for every status, in order, also without rows; unknown statuses are dropped."""
    spark = rows.sparkSession
    every = spark.createDataFrame(list(enumerate(statuses)), "pos int, status string")
    counted = rows.groupBy(F.col(status).alias("status")).agg(F.count("*").alias("n"))
    return every.join(counted, "status", "left").select("pos", "status", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


# Paths and messages of the classifiers, in the order they are tried.
PRIVATE = ["/api/auth/", "/api/user/", "/api/progress/", "/api/payment/", "/api/webhooks/"]
PUBLIC = {"/api/content/": 300, "/api/search/": 60}
NETWORK_ONLY = ["/api/ai/", "/api/payment/", "/api/progress/", "/api/user/"]
NEVER_RETRY = r"(?i)D1_CONSTRAINT|D1_TRIGGER|UNIQUE constraint failed|NOT NULL constraint failed|CHECK constraint failed|FOREIGN KEY constraint failed"
RETRY = r"(?i)timeout|network|D1_ERROR.*5\d\d|D1_DUMP_ERROR|unreachable"


def _begins(path: Column, prefixes: list[str]) -> Column:
    return reduce(Column.__or__, [path.startswith(p) for p in prefixes])


def cache_policy(path: Column) -> Column:
    out = F.when(_begins(path, PRIVATE), "private, no-store")
    for prefix, ttl in PUBLIC.items():
        out = out.when(path.startswith(prefix), f"public, max-age={ttl}")
    return out.otherwise("no-store")


def fetch_strategy(method: Column, same_origin: Column, path: Column) -> Column:
    return F.when((method != "GET") | ~same_origin, "skip").when(_begins(path, NETWORK_ONLY), "network-only").when(path.startswith("/api/"), "stale-while-revalidate").otherwise("cache-first")


def retry_class(message: Column) -> Column:
    return F.when(message.rlike(NEVER_RETRY), "no").when(message.rlike(RETRY), "yes").otherwise("no")


def backoff_ms(attempt: Column, base: int = 1000, factor: int = 2, most: int = 16_000) -> Column:
    """The wait before attempt + 1, attempts counted from 0."""
    return F.least(F.lit(base) * F.pow(F.lit(factor), attempt), F.lit(most)).cast("int")


def without_limiter(environment: Column) -> Column:
    return F.when(environment.isin("production", "staging"), "deny").otherwise("allow")


def top_similar(vectors: DataFrame, queries: DataFrame, k: int = 5, floor: float = 0.6, digits: int = 9, nudge: float = 0.0, vector_bytes: int = VECTOR_BYTES, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """query_id, rank, vec_id, similarity: each query's ``k`` most similar vectors of its label, above ``floor``.

    Similarities are rounded to ``digits``, ``nudge`` added before, and ranked as rounded; ties go by vec_id.

    ``vectors`` and ``queries`` have vec_id, embedding, label. The label is the filter that comes first; embeddings of another length are never
    similar. A label's vectors and its queries are dealt into parts of bounded bytes; every two parts meet in a task of their own, which
    multiplies them as matrices and keeps the ``k`` best of each query. All pairs of a label are compared, so the work grows with their number.
    """
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    # A norm of null or zero gives no similarity, a NaN one does: it ranks first.
    directed = lambda rows: rows.select("vec_id", "label", "embedding", F.size("embedding").alias("width"), norm.alias("norm")).where(F.col("label").isNotNull() & F.col("vec_id").isNotNull() & (F.col("norm") > 0))
    held, asked = directed(vectors), directed(queries).withColumnRenamed("vec_id", "query_id")
    parts = lambda rows, most, name: rows.groupBy("label", "width").agg(F.ceil(F.count("*") * F.col("width") * 8 / most).cast("int").alias(name))
    sizes = materialize(parts(held, vector_bytes, "parts").join(parts(asked, query_bytes, "blocks"), ["label", "width"]), "labels")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    unit = ["label", "width", "part", "block"]
    held = held.join(sizes, ["label", "width"]).select("label", "width", own("vec_id", "parts").alias("part"), every("blocks").alias("block"), "vec_id", "embedding", "norm")
    asked = asked.join(sizes, ["label", "width"]).select("label", "width", every("parts").alias("part"), own("query_id", "blocks").alias("block"), "query_id", "embedding", "norm")
    asked = asked.select(*[F.col(c).alias(c) for c in asked.columns])  # columns of its own, where both sides come from one table
    names = {"query_id": asked, "vec_id": held}
    schema = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c, rows in names.items()) + ", similarity double"
    best = asked.groupBy(*unit).cogroup(held.groupBy(*unit)).applyInArrow(most_similar(k, floor, digits, nudge), schema)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "similarity")


def by_truth(similar: DataFrame, nodes: DataFrame) -> DataFrame:
    """``similar`` (vec_id, similarity) with truth_weight and score, their product; ``nodes`` has vec_id and truth_weight."""
    joined = similar.join(nodes.select("vec_id", "truth_weight"), "vec_id")
    return joined.withColumn("score", F.col("similarity") * F.col("truth_weight"))


def by_priority(rows: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` rows by exam_priority, then exam_frequency, both descending with nulls last, then id."""
    return rows.orderBy(F.desc_nulls_last("exam_priority"), F.desc_nulls_last("exam_frequency"), "id").limit(limit)


def new_sessions(logins: DataFrame, now: Column) -> DataFrame:
    """Rows for the sessions of ``logins`` (id, user_id, refresh_token_hash, user_agent, ip_hash): live for SESSION_DAYS."""
    return logins.select(
        "id", "user_id", "refresh_token_hash", now.alias("created_at"), now.alias("last_used_at"), (now + F.make_dt_interval(F.lit(SESSION_DAYS))).alias("expires_at"),
        F.lit(None).cast("timestamp").alias("revoked_at"), "user_agent", "ip_hash",
    )


def unexpired(sessions: DataFrame, now: Column) -> DataFrame:
    """``sessions`` without those that ran out before ``now`` and were never revoked; revoked ones stay for the reuse check."""
    return sessions.where(~F.coalesce((F.col("expires_at") <= now) & F.col("revoked_at").isNull(), F.lit(False)))


# Days in which an order may be taken back, days that personal data are kept, and years that contracts are.
REFUND_DAYS, PERSONAL_DAYS, CONTRACT_YEARS = 7, 365 * 3, 5
REPLAY_SECONDS = 300


def retention(at: Column, now: Column) -> Column:
    """What may or must be done with a record of ``at``: struct of refundable, personal_due and contract_due."""
    return F.struct(
        (now <= at + F.make_dt_interval(F.lit(REFUND_DAYS))).alias("refundable"),
        (now > at + F.make_dt_interval(F.lit(PERSONAL_DAYS))).alias("personal_due"),
        (now > F.add_months(at, 12 * CONTRACT_YEARS).cast("timestamp") + (at - F.date_trunc("day", at))).alias("contract_due"),
    )


def in_replay_window(sent: Column, received: Column) -> Column:
    """Whether the two times are within five minutes; null times are not."""
    return F.coalesce(F.abs(F.unix_seconds(sent) - F.unix_seconds(received)) <= REPLAY_SECONDS, F.lit(False))


#: The longest ids of a payment, and the largest amount.
LONGEST_ID, LARGEST_AMOUNT = 128, 100_000_000


def payment_state(payload: Column) -> Column:
    """ok, malformed, bad_user, bad_transaction or bad_amount of a payment's JSON: userId, transactionId, amountKRW."""
    parsed = F.try_parse_json(payload)
    text_of = lambda p: F.when(F.schema_of_variant(F.variant_get(parsed, p, "variant")) == "STRING", F.variant_get(parsed, p, "string"))
    amount = F.try_variant_get(parsed, "$.amountKRW", "double")
    numeric = F.schema_of_variant(F.variant_get(parsed, "$.amountKRW", "variant")) != "STRING"
    whole = numeric & (amount == F.floor(amount)) & (amount > 0) & (amount <= LARGEST_AMOUNT)
    named = lambda p: F.coalesce(F.length(text_of(p)).between(1, LONGEST_ID), F.lit(False))
    return F.when(parsed.isNull(), "malformed").when(~named("$.userId"), "bad_user").when(~named("$.transactionId"), "bad_transaction").when(~F.coalesce(whole, F.lit(False)), "bad_amount").otherwise("ok")


#: The levels of a log in order, and how many causes of an error are written.
LEVELS, CAUSES = ["debug", "info", "warn", "error"], 8


def causes(chain: Column) -> Column:
    """An error and its causes (array of name, message, stack), home folders removed from stacks, cut after CAUSES."""
    kept = F.transform(F.slice(chain, 1, CAUSES), lambda e: F.struct(e["name"].alias("name"), e["message"].alias("message"), redact_homes(e["stack"]).alias("stack")))
    cut = F.array(F.struct(F.lit("CauseChainTruncated").alias("name"), F.lit(f"cause chain exceeded {CAUSES}").alias("message"), F.lit(None).cast("string").alias("stack")))
    return F.when(F.size(chain) > CAUSES, F.concat(kept, cut)).otherwise(kept)


def log_lines(records: DataFrame, service: str, least: str = "debug", environment: str = "development") -> DataFrame:
    """stream, line: a JSON line for every record (level, message, timestamp, context, error) of at least the level ``least``.

    The context is masked by its schema. A record that can't be written whole has its fixed fields written, and failing that a fixed line.
    """
    rank = F.array_position(F.array(*map(F.lit, LEVELS)), F.col("level"))
    rows = records.where(rank > LEVELS.index(least))
    head = [F.col("level"), F.col("message"), F.lit(service).alias("service"), F.lit(environment).alias("environment"), F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("timestamp")]
    kind = records.schema["context"].dataType
    masked = [mask_nested(f.name, F.col(f"context.{f.name}"), f.dataType).alias(f.name) for f in kind.fields]
    whole = F.to_json(F.struct(*head, *masked, causes(F.col("error")).alias("error")))
    last = F.concat(F.lit('{"level":"'), F.col("level"), F.lit(f'","message":"LOG_EMIT_FAILED","service":"{service}"}}'))
    return rows.select(F.when(F.col("level").isin("warn", "error"), "error").otherwise("log").alias("stream"), F.coalesce(whole, F.to_json(F.struct(*head)), last).alias("line"))
