"""Round trips through files, and streams that run on what is there and stop.

Each writes to the shared folder and reads it back; the SQL beside it is that of the table itself."""

from __future__ import annotations

from pyspark.sql import functions as F

from rowmill import sources, streaming
from rowmill.catalog import query, read
from rowmill.functions import text
from rowmill.operators.cut import fresh_path
from rowmill.plans.summaries import rounded
from rowmill.streaming import resume


@query("SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def csv_round_trip(spark, d):
    """Written with odd column names; read back they are stripped and in small letters."""
    path = fresh_path(spark)
    c = read(spark, d, "customer")
    sources.export_delimited(c.toDF(*(f" {x.upper()} " for x in c.columns)), path)
    return sources.read_delimited(spark, path, schema=c.schema).select(*c.columns)


@query("SELECT o_orderkey, o_totalprice AS amount, o_orderdate::DATE AS day FROM orders")
def typed_input(spark, d):
    """Pipe-separated lines, some without their last field, and informats for money and dates."""
    path = fresh_path(spark)
    o = read(spark, d, "orders")
    line = F.concat_ws("|", F.col("o_orderkey").cast("string"), F.concat(F.lit("$"), F.format_number("o_totalprice", 2)), F.date_format("o_orderdate", "yyyy-MM-dd"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderstatus")))
    o.select(line.alias("value")).write.text(path)
    got = sources.read_input(spark, path, {"o_orderkey": F.col("o_orderkey").try_cast("bigint"), "amount": text.currency("amount"), "day": F.col("day").try_cast("date"), "status": None})
    return got.select("o_orderkey", "amount", "day")


@query("SELECT p_partkey, p_brand, p_size FROM part")
def fixed_width(spark, d):
    """Columns by position, with a header and a trailer record that are dropped."""
    path = fresh_path(spark)
    body = read(spark, d, "part").select(F.concat(F.lit("D "), F.lpad(F.col("p_partkey").cast("string"), 12, " "), F.rpad("p_brand", 12, " "), F.lpad(F.col("p_size").cast("string"), 5, " ")).alias("value"))
    ends = read(spark, d, "region").where("r_regionkey < 2").select(F.when(F.col("r_regionkey") == 0, "H header").otherwise("T trailer").alias("value"))
    body.unionByName(ends).write.text(path)
    layout = {"kind": (1, 1, "string"), "p_partkey": (3, 12, "bigint"), "p_brand": (15, 12, "string"), "p_size": (27, 5, "int")}
    return sources.read_fixed(spark, path, layout, ("H", "T"), "kind").drop("kind")


@query("SELECT n_nationkey, n_name, code FROM nation JOIN (VALUES (1, 'x'), (7, 'y'), (24, NULL)) v(k, code) ON k = n_nationkey")
def inline_rows(spark, d):
    rows = sources.from_lines(spark, {"n_nationkey": "int", "code": "string"}, ["1 x", "", "  7   y ", "24"])
    return read(spark, d, "nation").join(rows, "n_nationkey").select("n_nationkey", "n_name", "code")


@query("SELECT event_id, event_type, value FROM events WHERE event_type <> 'view'")
def partitioned_table(spark, d):
    """Written by event type; the filter prunes folders."""
    path = fresh_path(spark)
    sources.write_table(read(spark, d, "events").select("event_id", "event_type", "value"), path, partition_by=["event_type"])
    return sources.read_table(spark, path).where("event_type <> 'view'").select("event_id", "event_type", "value")


@query("SELECT r_regionkey, r_name, NULL::BIGINT AS n FROM region UNION ALL SELECT n_nationkey, n_name, NULL FROM nation")
def append_aligned(spark, d):
    base = read(spark, d, "region").withColumn("n", F.lit(None).cast("long"))
    data = read(spark, d, "nation").select(F.col("n_nationkey").alias("r_regionkey"), F.col("n_name").alias("r_name"), F.col("n_regionkey").alias("other"))
    return sources.append(base, data)


@query("SELECT count(DISTINCT doc_id // 500)::BIGINT AS n_files, sum(octet_length(encode(text)) + 1)::BIGINT AS bytes, sum(len(string_split(text, chr(10))))::BIGINT AS lines FROM documents WHERE text IS NOT NULL")
def file_scan(spark, d):
    """Documents as files of a tree, 500 ids to a file, found again with size, sha-256 and lines."""
    path = fresh_path(spark)
    docs = read(spark, d, "documents").where("text is not null").select(F.expr("doc_id div 500").alias("part"), F.col("text").alias("value"))
    docs.repartition("part").write.partitionBy("part").option("lineSep", "\n").text(path)
    got = sources.scan_files(spark, path, "*.txt")
    return got.agg(F.count(F.lit(1)).alias("n_files"), F.sum("size").alias("bytes"), F.sum("lines").alias("lines"))


@query("SELECT conv_id, turn, role, text, part FROM (SELECT *, CASE WHEN conv_id % 10 < 9 THEN 'train' ELSE 'validation' END AS part FROM conversations)")
def jsonl_sink(spark, d):
    """Training and validation rows as JSON lines, in two folders."""
    path = fresh_path(spark)
    c = read(spark, d, "conversations")
    for part, cond in (("train", "conv_id % 10 < 9"), ("validation", "conv_id % 10 = 9")):
        sources.write_jsonl(c.where(cond), f"{path}/{part}")
    back = lambda p: spark.read.schema(c.schema).json(f"{path}/{p}").withColumn("part", F.lit(p))
    return back("train").unionByName(back("validation")).select("conv_id", "turn", "role", "text", "part")


def _stream(spark, d):
    """The events as a stream of files, at most two a trigger.  Event times as timestamps with zone."""
    path = fresh_path(spark)
    e = read(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    e.repartitionByRange(4, "ts").write.parquet(path)
    return sources.stream_files(spark, path, e.schema, 2)


def _collected(spark, stream, mode="append"):
    """Run the stream over all that is there into a table, and read that."""
    path = fresh_path(spark)
    q = stream.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", fresh_path(spark)).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


@query("SELECT event_id, user_id, event_type, value, CASE WHEN value >= 90 THEN 'URGENT' WHEN value >= 50 THEN 'REVIEW' ELSE 'PASS' END AS queue FROM events")
def stream_routes(spark, d):
    out = streaming.stream_route(_stream(spark, d).drop("ts", "props"), "value", [(50, "REVIEW"), (90, "URGENT")], "PASS")
    return _collected(spark, out)


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_dedup(spark, d):
    out = streaming.stream_dedup(_stream(spark, d), ["user_id", "event_type"], "ts", "400 days").select("user_id", "event_type")
    return _collected(spark, out)


@query("SELECT ts::DATE AS day, count(*)::BIGINT AS n, count(*) FILTER (value > 50)::BIGINT AS ok, round(avg(value), 6) AS mean_value FROM events GROUP BY 1")
def stream_daily(spark, d):
    """Days below the watermark are written as they close; the last ones by one more batch of the same query."""
    return rounded(_upserted(spark, streaming.stream_daily(_stream(spark, d), "ts", F.col("value") > 50, "value"), ["day"]), 6)


def _upserted(spark, stream, keys):
    """Every state of a windowed aggregate, batch by batch, and the last one of each key."""
    path, at = fresh_path(spark), fresh_path(spark)

    def step(batch, number):
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    streaming.run_batches(stream, at, step, "update")
    rows = spark.read.option("basePath", path).parquet(path)
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*(c for c in stream.columns if c not in keys)), "_batch").alias("_x"))
    return last.select(*keys, "_x.*")


@query("""SELECT user_id, w AS start, w + INTERVAL 24 HOUR AS end, count(*)::BIGINT AS n, round(sum(value), 6) AS total FROM (SELECT *, unnest(generate_series(time_bucket(INTERVAL 6 HOUR, ts) - INTERVAL 18 HOUR, time_bucket(INTERVAL 6 HOUR, ts), INTERVAL 6 HOUR)) AS w FROM events) GROUP BY 1, 2""")
def stream_velocity(spark, d):
    out = streaming.stream_velocity(_stream(spark, d), "user_id", "ts", "value", "24 hours", "6 hours")
    return rounded(_upserted(spark, out, ["user_id", "start", "end"]), 6)


@query("""WITH x AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 12 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM x)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 12 HOUR AS end, count(*)::BIGINT AS n FROM s GROUP BY user_id, k HAVING max(ts) + INTERVAL 12 HOUR < (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""")
def stream_sessions(spark, d):
    """Sessions that have closed by the watermark; those still open are not written."""
    return _collected(spark, streaming.stream_sessions(_stream(spark, d), "user_id", "ts", "12 hours"))


@query("SELECT user_id, max(event_id) AS event_id, count(*)::BIGINT AS n FROM events GROUP BY 1")
def stream_upsert(spark, d):
    """Each micro-batch is merged into a target by key: the next version of the table is written beside the last."""
    root, at = fresh_path(spark), fresh_path(spark)
    kind = "user_id long, event_id long, n long"
    stream = _stream(spark, d)

    def step(batch, number):
        new = batch.groupBy("user_id").agg(F.max("event_id").alias("event_id"), F.count(F.lit(1)).alias("n"))
        old = spark.read.schema(kind).parquet(f"{root}/v{number - 1}") if number else spark.createDataFrame([], kind)
        new.unionByName(old).groupBy("user_id").agg(F.max("event_id").alias("event_id"), F.sum("n").alias("n")).write.mode("overwrite").parquet(f"{root}/v{number}")
        step.last = number

    step.last = -1
    streaming.run_batches(stream, at, step)
    streaming.run_batches(stream, at, step)  # resumes at the checkpoint: nothing is read twice
    return spark.read.schema(kind).parquet(f"{root}/v{step.last}")


@query("""WITH b AS (SELECT *, row_number() OVER (ORDER BY ts DESC, event_id DESC) AS n FROM events) SELECT count(*)::BIGINT AS n, round(avg(value), 6) AS mean_value, avg(value) < 55 AS alert FROM b WHERE n <= 100""")
def stream_quality(spark, d):
    """After every micro-batch the last 100 rows so far are measured; the last measure is that of the table."""
    keep, at = fresh_path(spark), fresh_path(spark)
    stream = _stream(spark, d).select("event_id", "ts", "value")

    def step(batch, number):
        old = spark.read.schema(batch.schema).parquet(f"{keep}/v{number - 1}") if number else batch.limit(0)
        batch.unionByName(old).orderBy(F.desc("ts"), F.desc("event_id")).limit(100).write.mode("overwrite").parquet(f"{keep}/v{number}")
        step.last = number

    step.last = -1
    streaming.run_batches(stream, at, step)
    last = spark.read.parquet(f"{keep}/v{step.last}")
    return last.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean_value"), (F.avg("value") < 55).alias("alert"))


@query("SELECT event_type, count(*) AS n, count(DISTINCT event_id) AS events, round(sum(value), 4) AS total FROM events GROUP BY 1")
def stream_resume(spark, d):
    """A batch fails midway once; the stream is restarted at its checkpoint and no row is lost or counted twice."""
    source, sink, at = fresh_path(spark), fresh_path(spark), fresh_path(spark)
    rows = read(spark, d, "events").select("event_id", "event_type", "value")
    rows.repartition(4, "event_id").write.parquet(source)
    stream = sources.stream_files(spark, source, rows.schema, max_files=1)
    failed = []

    def step(batch, number):
        if number == 1 and not failed:
            failed.append(number)
            return batch.withColumn("value", F.when(F.col("event_id") % 100 == 1, F.raise_error(F.lit("fails once"))).otherwise(F.col("value")))
        return batch

    resume.run_resumable(stream, sink, at, step)
    out = resume.written(spark, sink, at, "event_id long, event_type string, value double")
    return out.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("event_id").alias("events"), F.round(F.sum("value"), 4).alias("total"))


@query("SELECT count(*) AS n, count(DISTINCT k) AS keys, round(sum(p), 2) AS total FROM (SELECT o_orderkey AS k, o_totalprice AS p FROM orders WHERE o_orderkey >= 1000 AND o_orderstatus = 'F')")
def database_table(spark, d):
    """A table written to a database in the shared folder and read back in parts by key, its filter pushed down."""
    o = read(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    url = sources.embedded_url(fresh_path(spark), create=True)
    sources.write_jdbc(o, url, "ORDERS_COPY", mode="overwrite", createTableColumnTypes="o_orderstatus VARCHAR(8)")
    lo, hi = o.agg(F.min("o_orderkey"), F.max("o_orderkey")).head()
    back = sources.read_jdbc(spark, url, "ORDERS_COPY", "o_orderkey", lo or 0, (hi or 0) + 1, 4).where("o_orderkey >= 1000 AND o_orderstatus = 'F'")
    return back.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("o_orderkey").alias("keys"), F.round(F.sum("o_totalprice"), 2).alias("total"))
