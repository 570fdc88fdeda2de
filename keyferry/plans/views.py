"""The given tables seen as keyspaces, runs, logs, reports and change events.

Every view covers its whole table. The divisors below shape the data (which keys a target lacks, which
node owns a key); they do not make a query smaller.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keyferry import schemas
from keyferry.functions.values import octets
from keyferry.session import apply_conf

col, lit = F.col, F.lit


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return apply_conf(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    schema = table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parquet*")


def text(column: str) -> Column:
    return col(column).cast("string")


def label(prefix: str, number: Column) -> Column:
    return F.concat(lit(prefix), number.cast("string"))


def epoch(column: str) -> Column:
    return F.unix_timestamp(col(column).cast("timestamp"))


def source_of(orders: DataFrame) -> DataFrame:
    return orders.select(
        label("order:", col("o_orderkey")).alias("key"),
        lit("string").alias("type"),
        F.concat_ws("|", text("o_custkey"), "o_orderstatus", "o_orderpriority").alias("value"),
        F.when(col("o_orderkey") % 5 == 0, 3600).otherwise(-1).cast("long").alias("ttl_s"),
        (col("o_orderkey") % 3).cast("int").alias("node"),
    )


def source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_of(table(spark, sf_dir, "orders"))


def target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The source without every tenth key, with some stale values, plus keys only the target has."""
    orders = table(spark, sf_dir, "orders").filter(col("o_orderkey") % 10 != 3)
    stale = F.when(col("o_orderkey") % 17 == 0, "|stale").otherwise("")
    copied = source_of(orders.withColumn("o_orderpriority", F.concat("o_orderpriority", stale)))
    ghosts = table(spark, sf_dir, "customer").filter(col("c_custkey") % 50 == 0)
    return copied.unionByName(
        ghosts.select(
            label("ghost:", col("c_custkey")).alias("key"),
            lit("string").alias("type"),
            lit("x").alias("value"),
            lit(-1).cast("long").alias("ttl_s"),
            lit(0).alias("node"),
        )
    )


def known(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The source as it was at an earlier date."""
    early = col("o_orderdate") < lit("2001-01-01").cast("timestamp_ntz")
    return source_of(table(spark, sf_dir, "orders").filter(early))


def raw_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with repeated keys and hash tags."""
    return table(spark, sf_dir, "lineitem").select(
        F.concat(lit("li:{"), text("l_orderkey"), lit("}:"), text("l_linenumber")).alias("key"),
        lit("string").alias("type"),
        F.concat_ws("|", text("l_partkey"), text("l_suppkey"), "l_returnflag").alias("value"),
        lit(-1).cast("long").alias("ttl_s"),
        (col("l_suppkey") % 3).cast("int").alias("node"),
    )


def listed_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A key list: orders with a returned line. Keys repeat."""
    returned = table(spark, sf_dir, "lineitem").filter(col("l_returnflag") == "R")
    return returned.select(label("order:", col("l_orderkey")).alias("key"))


def typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One container per row: order fields, conversation words, document words, part name words."""

    def container(name: str, key: Column, kind: str, **filled: Column) -> DataFrame:
        empty = {
            "str": lit(None).cast("string"),
            "hash": lit(None).cast("map<string,string>"),
            "list": lit(None).cast("array<string>"),
            "set": lit(None).cast("array<string>"),
            "zset": lit(None).cast("array<struct<member:string,score:bigint>>"),
        }
        shown = {**empty, **filled}
        return table(spark, sf_dir, name).select(
            key.alias("key"), lit(kind).alias("type"), *[value.alias(c) for c, value in shown.items()]
        )

    fields = F.create_map(
        lit("status"), col("o_orderstatus"), lit("priority"), col("o_orderpriority"), lit("customer"), text("o_custkey")
    )
    name_words = F.transform(
        F.split("p_name", " "), lambda w, i: F.struct(w.alias("member"), (col("p_size") - i).cast("long").alias("score"))
    )
    talk = F.concat_ws(":", lit("talk"), text("conv_id"), text("turn"))
    return (
        container("orders", label("order:", col("o_orderkey")), "hash", hash=fields)
        .unionByName(container("conversations", talk, "list", list=F.split("text", " ")))
        .unionByName(
            container("documents", label("doc:", col("doc_id")), "set", set=F.array_distinct(F.split("text", " ")))
        )
        .unionByName(container("part", label("part:", col("p_partkey")), "zset", zset=name_words))
    )


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        label("doc:", col("doc_id")).alias("key"), lit("string").alias("type"), col("text").alias("value"), "source"
    )


def changes_of(events: DataFrame) -> DataFrame:
    kind = col("event_type")
    return events.select(
        label("node-", col("user_id") % 3).alias("node_id"),
        label("user:", col("user_id")).alias("key"),
        F.when(kind == "view", "expire").when(kind == "error", "del").otherwise("set").alias("op"),
        F.when(kind.isin("signup", "click", "purchase"), col("props")).alias("value"),
        F.when(kind == "view", 60 + col("event_id") % 100).cast("long").alias("ttl_s"),
        lit(None).cast("string").alias("new_key"),
        col("ts").cast("timestamp").alias("ts"),
        col("event_id").alias("offset"),
    )


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes_of(table(spark, sf_dir, "events"))


def renamed_changes_of(events: DataFrame) -> DataFrame:
    """The change events with every seventh one as a rename to one of the next keys, or to the same."""
    moved = col("offset") % 7 == 0
    user = F.substring_index("key", ":", -1).cast("long")
    return changes_of(events).select(
        "node_id",
        "key",
        F.when(moved, "rename").otherwise(col("op")).alias("op"),
        F.when(~moved, col("value")).alias("value"),
        F.when(~moved, col("ttl_s")).alias("ttl_s"),
        F.when(moved, label("user:", user + col("offset") % 4)).alias("new_key"),
        "ts",
        "offset",
    )


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keyspace that the change events apply to."""
    return table(spark, sf_dir, "customer").select(
        label("user:", col("c_custkey")).alias("key"),
        lit("string").alias("type"),
        col("c_name").alias("value"),
        lit(-1).cast("long").alias("ttl_s"),
        col("c_nationkey").cast("int").alias("node"),
    )


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = col("event_type")
    level = (
        F.when(kind == "error", "ERROR")
        .when(kind == "purchase", "WARN")
        .when(kind.isin("signup", "view"), "INFO")
        .otherwise("DEBUG")
    )
    source_text = label("sync.go:", col("user_id"))
    return table(spark, sf_dir, "events").select(
        col("event_id").alias("id"),
        F.date_format(col("ts").cast("timestamp"), "yyyy-MM-dd HH:mm:ss.SSS").alias("timestamp"),
        level.alias("level"),
        kind.alias("message"),
        source_text.alias("source"),
        F.md5(text("event_id")).alias("request_id"),
        label("task-", col("user_id") % 7).alias("task_id"),
        col("props").alias("fields"),
        F.when(kind == "error", F.concat(lit("at "), source_text)).alias("stack"),
    )


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        label("task-", col("user_id") % 7).alias("task_id"),
        col("event_type").alias("metric_name"),
        col("value").alias("metric_value"),
        epoch("ts").alias("timestamp"),
    )


def progress_of(events: DataFrame) -> DataFrame:
    return events.select(
        label("task-", col("user_id") % 7).alias("task_id"),
        label("worker-", col("user_id") % 4).alias("worker_id"),
        lit(1).cast("long").alias("keys_processed"),
        octets(col("props")).alias("bytes_sent"),
        F.when(col("event_type") == "error", 1).otherwise(0).cast("long").alias("error_count"),
        col("ts").cast("timestamp").alias("ts"),
    )


def progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return progress_of(table(spark, sf_dir, "events"))


def convergence_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One iteration per calendar day and task. The four tasks stop for four different reasons."""
    task = col("task")
    days = (
        table(spark, sf_dir, "events")
        .groupBy((col("user_id") % 4).alias("task"), F.to_date("ts").alias("day"))
        .agg(F.count("*").alias("n"))
        .withColumn("iteration", F.row_number().over(W.partitionBy("task").orderBy("day")))
    )
    minute = lit("2024-01-01").cast("timestamp") + F.make_dt_interval(mins=col("iteration"))
    return days.select(
        label("task-", task).alias("task_id"),
        "iteration",
        (col("n") + F.when(task == 0, 0).when(task == 3, 2000).otherwise(1000)).alias("change_count"),
        F.when(task == 1, 10_000_000).otherwise(100_000).cast("long").alias("total_keys"),
        F.when(task == 3, minute).otherwise(col("day").cast("timestamp")).alias("ts"),
    )


def checkpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        label("task-", col("l_suppkey") % 3).alias("task_id"),
        label("worker-", col("l_suppkey") % 4).alias("worker_id"),
        (col("l_partkey") % 16384).cast("int").alias("slot_id"),
        F.when(col("l_returnflag") == "A", "0").otherwise(text("l_orderkey")).alias("cursor"),
        F.floor("l_quantity").alias("keys_migrated"),
        F.floor("l_extendedprice").alias("bytes_migrated"),
        F.concat_ws(":", text("l_orderkey"), text("l_linenumber")).alias("last_key"),
        epoch("l_shipdate").alias("updated_at"),
        (col("l_orderkey") * 10 + col("l_linenumber")).alias("seq"),
    )


def checkpoint_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checkpoints(spark, sf_dir).groupBy("task_id").agg(F.countDistinct("worker_id").cast("int").alias("workers"))


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag = col("l_returnflag")
    return table(spark, sf_dir, "lineitem").select(
        label("task-", col("l_orderkey") % 7).alias("task_id"),
        label("order:", col("l_orderkey")).alias("key"),
        col("l_linenumber").alias("attempt"),
        F.when(flag == "A", "ok").when(flag == "R", "skipped").otherwise("failed").alias("outcome"),
    )


def errors_of(resolved: DataFrame) -> DataFrame:
    seq = F.substring_index("key", ":", -1).cast("long")
    moment = F.timestamp_seconds(1_700_000_000 + seq)
    return resolved.filter(col("outcome") != "ok").select(
        "task_id",
        seq.alias("seq"),
        "key",
        lit("string").alias("type"),
        col("outcome").alias("reason"),
        F.concat_ws(" ", lit('restore of "key" refused,'), col("outcome"), "detail").alias("detail"),
        F.date_format(moment, "yyyy-MM-dd HH:mm:ss").alias("timestamp"),
    )


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = col("c_custkey")
    status = F.element_at(
        F.array(*[lit(s) for s in ("pending", "running", "paused", "completed", "failed")]), (number % 5 + 1).cast("int")
    )
    return table(spark, sf_dir, "customer").select(
        label("task-", number).alias("id"),
        col("c_name").alias("name"),
        status.alias("status"),
        (1_700_000_000 + 60 * number).alias("created_at"),
    )


def run_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored options of every run. Some keep all keys, some have no options or unreadable ones that keep all too."""
    number = col("c_custkey")
    prefixes = F.array(label("order:", 1000 + number % 9000), label("order:7", number % 1000))
    rule = F.struct(
        F.when(number % 500 == 0, "all").when(number % 3 == 1, "keys").otherwise("prefix").alias("mode"),
        prefixes.alias("prefixes"),
        F.array(label("order:", number), label("order:", number * 7), lit("ghost:1")).alias("keys"),
        F.array(label("order:", 10_000 + number % 90_000), label("order:", number * 7)).alias("exclude_prefixes"),
    )
    policy = F.when(number % 4 == 0, "replace").when(number % 4 == 1, "unknown")
    stored = F.to_json(F.struct(rule.alias("key_filter"), policy.alias("conflict_policy")))
    config = F.when(number % 500 == 7, lit(None)).when(number % 500 == 8, "{broken").otherwise(stored)
    return table(spark, sf_dir, "customer").select(label("task-", number).alias("id"), config.alias("config"))


def run_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per run: its orders, each standing for 5000 keys, by outcome."""
    status, low = col("o_orderstatus"), col("o_orderpriority") == "5-LOW"

    def keys(condition: Column) -> Column:
        return F.count_if(condition) * 5000

    return (
        table(spark, sf_dir, "orders")
        .groupBy("o_custkey")
        .agg(
            keys(lit(True)).alias("keys_total"),
            keys(~low & (status == "F")).alias("keys_migrated"),
            keys(~low & (status == "O")).alias("keys_skipped"),
            keys(low).alias("keys_filtered"),
            keys(~low & (status == "P")).alias("keys_failed"),
        )
        .withColumn("task_id", label("task-", col("o_custkey")))
        .withColumn("started_at", 1_700_000_000 + col("o_custkey"))
        .drop("o_custkey")
    )


def run_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.length(F.concat_ws("|", text("o_custkey"), "o_orderstatus", "o_orderpriority")).cast("long")
    done = col("o_orderstatus") == "F"
    stats = table(spark, sf_dir, "orders").groupBy("o_custkey")
    return stats.agg(
        F.count("*").alias("total_keys"),
        F.count_if(done).alias("migrated_keys"),
        F.sum(size).alias("total_bytes"),
        F.coalesce(F.sum(F.when(done, size)), lit(0)).alias("migrated_bytes"),
        F.count_if(col("o_orderstatus") == "P").alias("error_count"),
    ).select(label("task-", col("o_custkey")).alias("task_id"), "*").drop("o_custkey")


def verify_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    matched = (col("o_orderkey") % 101).cast("int")
    return table(spark, sf_dir, "orders").select(
        col("o_orderkey").alias("id"),
        label("task-", col("o_custkey")).alias("task_id"),
        label("batch-", col("o_orderkey")).alias("batch_id"),
        lit(100).alias("total_keys"),
        matched.alias("matched_keys"),
        (100 - matched).alias("mismatched_keys"),
        lit(0).alias("missing_keys"),
        epoch("o_orderdate").alias("created_at"),
    )


def run_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole run records."""
    number, started, ended = col("c_custkey"), col("status") != "pending", col("status").isin("completed", "failed")
    created = 1_700_000_000 + 60 * number
    whole = runs(spark, sf_dir).join(
        table(spark, sf_dir, "customer").select(label("task-", number).alias("id"), number, "c_nationkey", "c_mktsegment"), "id"
    )
    return whole.select(
        "id",
        "name",
        "status",
        label("cluster-", col("c_nationkey")).alias("source"),
        label("cluster-", (col("c_nationkey") + 1) % 25).alias("target"),
        col("c_mktsegment").alias("config"),
        "created_at",
        (created + 30).alias("updated_at"),
        F.when(started, created + 10).alias("started_at"),
        F.when(ended, created + 50).alias("completed_at"),
    )


def stats_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole stats records: ``run_stats`` with large and skipped keys and times."""
    more = table(spark, sf_dir, "orders").groupBy(label("task-", col("o_custkey")).alias("task_id")).agg(
        F.count_if(col("o_totalprice") > 300_000).alias("large_keys_count"),
        F.count_if(col("o_orderstatus") == "O").alias("skipped_keys_count"),
        F.min(epoch("o_orderdate")).alias("start_time"),
        F.max(epoch("o_orderdate")).alias("end_time"),
    )
    return run_stats(spark, sf_dir).join(more, "task_id").select(schemas.STATS.names)


def verify_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole verify records: ``verify_batches`` with extra keys and details."""
    more = table(spark, sf_dir, "orders").select(
        col("o_orderkey").alias("id"), (col("o_orderkey") % 3).cast("int").alias("extra_keys"), col("o_orderpriority").alias("details")
    )
    return verify_batches(spark, sf_dir).join(more, "id").select(schemas.VERIFY.names)


def node_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four report sections per node. Some nodes miss their version or show an unreadable memory."""
    node, cluster = col("s_suppkey"), col("s_nationkey")
    keys = 1000 + node * 37 % 5000

    def by_cluster(values: list[int], divisor: int) -> Column:
        return F.element_at(F.array(*[lit(v).cast("long") for v in values]), (cluster % divisor + 1).cast("int"))

    average = by_cluster([300, 5000, 50_000, 500_000, 2_000_000], 5)
    ops = by_cluster([5, 120, 1500, 40_000], 4) + node % 3
    memory = F.when(node % 17 == 0, "n/a").otherwise((keys * average).cast("string"))
    version = F.when(node % 13 != 0, label("redis_version:6.2.", node % 5))
    sections = {
        "server": F.concat_ws("\r\n", lit("# Server"), version, lit("os:Linux")),
        "clients": F.concat_ws("\r\n", lit("# Clients"), label("connected_clients:", 10 + node * 13 % 90), lit("")),
        "memory": F.concat_ws(
            "\r\n",
            lit("# Memory"),
            F.concat(lit("used_memory:"), memory),
            lit("used_memory_human:1M"),
            label("maxmemory:", (1 + node % 4) * 1_073_741_824),
        ),
        "stats": F.concat_ws("\r\n", lit("# Stats"), label("instantaneous_ops_per_sec:", ops)),
    }
    rows = F.array(*[F.struct(lit(s).alias("section"), info.alias("info")) for s, info in sections.items()])
    return table(spark, sf_dir, "supplier").select(
        cluster.cast("string").alias("cluster"),
        F.lpad(node.cast("string"), 8, "0").alias("node"),
        keys.alias("keys"),
        F.when(node % 11 == 0, 300).otherwise(10_000).alias("maxclients"),
        F.inline(rows),
    )
