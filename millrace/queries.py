"""A query per operator over the driver's tables, with the same question in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import lineage
from .envelope import from_events
from .functions import codecs, payload
from .operators import batches, faults, framing, metrics, pacing, queueing, replay, routing, timeline
from .plans import scenario
from .plans.pipeline import Pipeline, RuntimeConfig
from .sources import files, pcap
from .streaming import pipelines

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

SINKS = [11, 22, 33, 44]
HOUR_NS = 3_600_000_000_000

#: events as the envelope, in SQL.
ENV = """env AS (SELECT event_id AS sequence, epoch_us(ts) * 1000 AS ts_ns,
  CASE event_type WHEN 'click' THEN 1 WHEN 'error' THEN 2 WHEN 'purchase' THEN 3 WHEN 'signup' THEN 4 WHEN 'view' THEN 5 ELSE 0 END AS schema_id,
  event_type = 'error' AS suspect, user_id AS key, CAST(round(value * 100) AS BIGINT) AS price, props AS payload FROM events)"""
SINK_OF = "CASE {} WHEN 0 THEN 11 WHEN 1 THEN 22 WHEN 2 THEN 33 ELSE 44 END"


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_events(spark.read.parquet(f"{sf_dir}/events.parquet"))


def _ticked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).withColumn("tick", F.floor(F.col("ts_ns") / HOUR_NS).cast("long"))


def _tick_coded(rows: DataFrame) -> DataFrame:
    return rows.withColumn("data", codecs.tick_encode(F.col("sequence"), F.col("price"), F.col("key")))


# ---------------------------------------------------------------- decoding, filtering, encoding


@query(f"WITH {ENV} SELECT sequence, ts_ns, CAST(schema_id AS INTEGER) AS schema_id, suspect, key, price FROM env WHERE NOT suspect AND price >= 5000")
def decode_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).filter("NOT suspect AND price >= 5000").select("sequence", "ts_ns", "schema_id", "suspect", "key", "price")


@query(f"WITH {ENV} SELECT sequence, price, key AS quantity FROM env")
def codec_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tick_coded(events(spark, sf_dir)).select(codecs.tick_decode(F.col("data")).alias("m")).select("m.*")


@query(f"WITH {ENV} SELECT CAST({SINK_OF.format('key % 4')} AS BIGINT) AS sink_id, count(*) AS n, CAST(sum(price) AS BIGINT) AS total FROM env WHERE price >= 1000 GROUP BY 1")
def pipeline_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: encode to ticks, decode, filter, route by key, add up per sink."""
    made = Pipeline().read(_tick_coded(events(spark, sf_dir)).select("data")).decode("data", codecs.tick_decode).filter("price >= 1000")
    return made.route(lambda df: routing.by_key(df, F.col("quantity"), SINKS)).routed().groupBy("sink_id").agg(F.count("*").alias("n"), F.sum("price").alias("total"))


@query(f"WITH {ENV} SELECT sequence, ts_ns, CAST(schema_id AS BIGINT) AS schema_id, suspect, payload, CAST(ceil((32 + strlen(payload)) / 64.0) * 64 AS BIGINT) AS slot_bytes FROM env")
def slot_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.encode("payload", "utf-8")
    rows = events(spark, sf_dir).select(codecs.slot_encode(F.col("schema_id"), F.col("suspect"), F.col("sequence"), F.col("ts_ns"), body).alias("slot"), codecs.slot_size(F.length(body)).alias("slot_bytes"))
    return rows.select(codecs.slot_decode(F.col("slot")).alias("m"), "slot_bytes").select("m.sequence", "m.ts_ns", "m.schema_id", "m.suspect", F.decode("m.payload", "utf-8").alias("payload"), "slot_bytes")


@query(f"WITH {ENV} SELECT sequence, CAST(9000 + key % 7 AS BIGINT) AS port, payload, CAST(42 + strlen(payload) AS BIGINT) AS frame_bytes FROM env")
def udp_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).select("sequence", codecs.udp_frame(F.encode("payload", "utf-8"), 9000 + F.col("key") % 7).alias("frame"))
    return rows.select("sequence", codecs.udp_parse(F.col("frame")).alias("m"), F.length("frame").cast("long").alias("frame_bytes")).select("sequence", "m.port", F.decode("m.payload", "utf-8").alias("payload"), "frame_bytes")


# ---------------------------------------------------------------- framing


def _document_blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select(F.col("doc_id").cast("string").alias("path"), F.encode(F.coalesce("text", F.lit("")), "utf-8").alias("content"))


@query("SELECT CAST(doc_id AS VARCHAR) AS path, i AS record_index, i * 64 AS file_offset, hex(encode(text))[i * 128 + 1:i * 128 + 128] AS record FROM (SELECT doc_id, text, unnest(range(strlen(text) // 64)) AS i FROM documents)")
def frame_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return framing.fixed(_document_blobs(spark, sf_dir), 64).select("path", "record_index", "file_offset", F.hex("record").alias("record"))


@query(
    "SELECT path, i - 1 AS record_index, CAST(coalesce(sum(strlen(line) + 1) OVER (PARTITION BY path ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS file_offset, line || chr(10) AS record "
    "FROM (SELECT CAST(doc_id AS VARCHAR) AS path, unnest(range(1, len(l))) AS i, unnest(l[1:len(l) - 1]) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))"
)
def frame_delim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return framing.delimited(_document_blobs(spark, sf_dir), 10, 1 << 20).select("path", "record_index", "file_offset", F.decode("record", "utf-8").alias("record"))


def _framed_by_key(rows: DataFrame, width: int = 1 << 17) -> DataFrame:
    """The records of a file per key, framed from blobs of ``width`` values of the sequence each.

    A blob's place in its file is the prefix sum of the blobs before it, so no
    value grows with the rows of a key.
    """
    body = F.encode("payload", "utf-8")
    record = F.concat(codecs.uint_be(F.length(body), 1), body)
    at = F.coalesce(F.floor(F.col("sequence") / width), F.lit(-1)).cast("long")
    ranged = rows.select(F.col("key").cast("string").alias("of"), at.alias("at"), "sequence", record.alias("r"))
    blobs = ranged.groupBy("of", "at").agg(F.expr("listagg(r) WITHIN GROUP (ORDER BY sequence, r)").alias("content"))
    before = W.partitionBy("of").orderBy("at").rowsBetween(W.unboundedPreceding, -1)
    sizes = ranged.groupBy("of", "at").agg(F.count("r").alias("n"), F.sum(F.length("r")).alias("size"))
    bases = sizes.select("of", "at", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n"), F.coalesce(F.sum("size").over(before), F.lit(0)).alias("size"))
    # A blob's name holds its place, so what is joined are blobs and not their records.
    same = F.col("b.of").eqNullSafe(F.col("s.of")) & (F.col("b.at") == F.col("s.at"))
    named = blobs.alias("b").join(bases.alias("s"), same).select(F.concat_ws("/", "s.n", "s.size", "b.of").alias("path"), "content")
    part = lambda k: F.get(F.split("path", "/", 3), F.lit(k))
    out = framing.length_prefixed(named, 1, 255)
    return out.select(part(2).alias("path"), (F.col("record_index") + part(0).cast("long")).alias("record_index"), (F.col("file_offset") + part(1).cast("long")).alias("file_offset"), F.decode(F.expr("substring(record, 2)"), "utf-8").alias("record"))


@query(
    "SELECT CAST(user_id AS VARCHAR) AS path, row_number() OVER w - 1 AS record_index, CAST(coalesce(sum(strlen(props) + 1) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS file_offset, props AS record "
    "FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)"
)
def frame_len_prefixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _framed_by_key(events(spark, sf_dir))


@query("SELECT CAST(r_regionkey AS VARCHAR) AS path, i AS record_index, l AS loop_index, r_name[i * 2 + 1:i * 2 + 2] AS record FROM (SELECT r_regionkey, r_name, unnest(range(strlen(r_name) // 2)) AS i FROM region), (SELECT CAST(unnest(range(3)) AS INTEGER) AS l)")
def eof_loop(spark: SparkSession, sf_dir: str) -> DataFrame:
    region = spark.read.parquet(f"{sf_dir}/region.parquet").select(F.col("r_regionkey").cast("string").alias("path"), F.encode("r_name", "utf-8").alias("content"))
    return framing.looped(framing.fixed(region, 2), 3).select("path", "record_index", "loop_index", F.decode("record", "utf-8").alias("record"))


# ---------------------------------------------------------------- files


def _joined_sql(key: str, size: str, table: str, order: str, record: str) -> str:
    """Records of files that hold the rows of a key in their order, one behind the other."""
    return (
        f"SELECT CAST({key} AS VARCHAR) AS file, row_number() OVER w - 1 AS record_index, CAST(coalesce(sum({size}) OVER (PARTITION BY {key} ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS file_offset, "
        f"{record} AS record FROM {table} WINDOW w AS (PARTITION BY {key} ORDER BY {order})"
    )


def _named(records: DataFrame, first: int = 1) -> DataFrame:
    return records.select(F.regexp_extract("path", "[^/]+$", 0).alias("file"), "record_index", "file_offset", F.decode(F.expr(f"substring(record, {first})"), "utf-8").alias("record"))


@query(_joined_sql("doc_id // 1000", "strlen(line) + 1", "(SELECT doc_id, replace(coalesce(text, ''), chr(10), ' ') AS line FROM documents)", "doc_id", "line || chr(10)"))
def frame_delim_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as the lines of a file a thousand, each file read by ranges of 100,000 bytes."""
    line = F.concat(F.translate(F.coalesce("text", F.lit("")), "\n", " "), F.lit("\n"))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.floor(F.col("doc_id") / 1000).alias("file"), "doc_id", F.encode(line, "utf-8").alias("data"))
    folder = files.ordered_files(docs, "file", "doc_id", "data", lineage.new_path(spark, "lines"))
    return _named(files.read(spark, folder, max_len=1 << 24, split=100_000))


@query(_joined_sql("event_id // 4000", "strlen(props) + 2", "events", "event_id", "props"))
def frame_prefixed_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as records behind a length of two bytes, a file for four thousand, each file framed by blocks of 50,000 bytes in parallel."""
    body = F.encode("payload", "utf-8")
    rows = events(spark, sf_dir).select(F.floor(F.col("sequence") / 4000).alias("file"), "sequence", F.concat(codecs.uint_be(F.length(body), 2), body).alias("data"))
    folder = files.ordered_files(rows, "file", "sequence", "data", lineage.new_path(spark, "prefixed"))
    return _named(files.read(spark, folder, "length_prefixed", prefix=2, max_payload=4096, block=50_000, fan=8), 3)


@query("SELECT c_name || chr(10) AS record, CAST(strlen(c_name) + 1 AS BIGINT) AS n FROM customer")
def file_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names written as text files, a line each, and read back through the framed file source."""
    out = lineage.new_path(spark, "lines")
    spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_name").write.text(out)
    return files.read(spark, out).select(F.decode("record", "utf-8").alias("record"), F.octet_length("record").cast("long").alias("n"))


@query(f"WITH {ENV} SELECT CAST(key % 16 AS VARCHAR) AS file, row_number() OVER (PARTITION BY key % 16 ORDER BY ts_ns, sequence) - 1 AS pkt_index, ts_ns, payload FROM env")
def capture_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as UDP frames in 16 groups of capture files, committed together, of 100,000 bytes at most, read back as one sequence a group."""
    out = lineage.new_path(spark, "captures")
    frame = codecs.udp_frame(F.encode("payload", "utf-8"), F.lit(9000))
    pcap.save(events(spark, sf_dir).select((F.col("key") % 16).alias("path"), F.col("sequence").alias("pkt_index"), "ts_ns", frame.alias("data")), out, nanoseconds=True, roll=100_000)
    read = pcap.load(spark, out).withColumn("m", codecs.udp_parse(F.col("data")))
    return read.select(F.col("path").alias("file"), "pkt_index", "ts_ns", F.decode("m.payload", "utf-8").alias("payload"))


# ---------------------------------------------------------------- routing


def _sums(routed: DataFrame) -> DataFrame:
    return routed.groupBy("sink_id").agg(F.count("*").alias("n"), F.sum("price").alias("total"))


def _sums_sql(sink: str, where: str = "true") -> str:
    return f"WITH {ENV} SELECT CAST({sink} AS BIGINT) AS sink_id, count(*) AS n, CAST(sum(price) AS BIGINT) AS total FROM env WHERE {where} GROUP BY 1"


@query(_sums_sql("7"))
def route_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sums(routing.fixed(events(spark, sf_dir), 7))


@query(_sums_sql("0"))
def route_drop_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sums(routing.drop_all(events(spark, sf_dir)))


@query(_sums_sql(SINK_OF.format("key % 4")))
def route_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sums(routing.by_key(events(spark, sf_dir), F.col("key"), SINKS))


@query(_sums_sql(SINK_OF.format("schema_id % 4")))
def route_schema_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sums(routing.by_schema(events(spark, sf_dir), SINKS))


@query(_sums_sql("CASE WHEN sequence % 2 = 0 THEN 1 ELSE 0 END"))
def route_callback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sums(routing.by_callback(events(spark, sf_dir), lambda df: F.when(F.col("sequence") % 2 == 0, 1)))


@query(_sums_sql(SINK_OF.format("(sequence_place % 4)")).replace("FROM env", "FROM (SELECT *, row_number() OVER (ORDER BY sequence) - 1 AS sequence_place FROM env WHERE NOT suspect)"))
def route_round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only rows that reach placement move the turn on."""
    return _sums(routing.round_robin(events(spark, sf_dir).filter("NOT suspect"), SINKS))


@query(f"WITH {ENV} SELECT sequence, CAST({SINK_OF.format('schema_id % 4')} AS BIGINT) AS sink_id FROM env WHERE schema_id % 4 NOT IN (0, 1)")
def route_unregistered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.unregistered(routing.by_schema(events(spark, sf_dir), SINKS), [11, 22]).select("sequence", "sink_id")


# ---------------------------------------------------------------- batches and back-pressure


@query("SELECT doc_id, hex(encode(text))[1:200] AS data, CAST(strlen(text) AS BIGINT) AS original_len, strlen(text) > 100 AS truncated FROM documents")
def batch_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return batches.truncated(docs, 100, "text").select("doc_id", F.hex("text").alias("data"), "original_len", "truncated")


@query(f"WITH {ENV} SELECT tick, accepted, count(*) AS n FROM (SELECT ts_ns // {HOUR_NS} AS tick, row_number() OVER (PARTITION BY ts_ns // {HOUR_NS} ORDER BY sequence) <= 10 AS accepted FROM env) GROUP BY 1, 2")
def batch_capacity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batches.capped(_ticked(spark, sf_dir), 10).groupBy("tick", "accepted").agg(F.count("*").alias("n"))


@query(f"WITH {ENV} SELECT payload, count(*) AS n, strlen(payload) > 8 AS oversized FROM env GROUP BY 1, 3")
def batch_oversized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batches.sized(events(spark, sf_dir), 8).groupBy("payload", "oversized").agg(F.count("*").alias("n"))


@query(
    f"WITH {ENV}, r AS (SELECT *, schema_id % 2 + 1 AS s, (row_number() OVER (ORDER BY sequence) - 1) // 100 AS b FROM env), k AS (SELECT *, row_number() OVER (PARTITION BY b, s ORDER BY sequence) AS i FROM r), "
    "o AS (SELECT *, row_number() OVER (PARTITION BY b, i <= 30 ORDER BY sequence) AS j FROM k) "
    "SELECT CAST(CASE WHEN i <= 30 THEN s WHEN j <= 30 THEN 9 ELSE 0 END AS BIGINT) AS sink_id, count(*) AS n, CAST(sum(price) AS BIGINT) AS total FROM o GROUP BY 1"
)
def bp_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Back-pressure as a setting of a pipeline: batches of 100, of which every sink takes 30, the overflow sink too; what finds it full drops."""
    config = RuntimeConfig(batch_size=100, capacity=30, backpressure="overflow", overflow_sink=9)
    made = Pipeline().read(events(spark, sf_dir)).route(lambda df: df.withColumn("sink_id", (F.col("schema_id") % 2 + 1).cast("long"))).configured(config)
    return _sums(made.routed())


def _kept_sql(order: str) -> str:
    return f"WITH {ENV} SELECT sequence, tick FROM (SELECT sequence, ts_ns // {HOUR_NS} AS tick, row_number() OVER (PARTITION BY ts_ns // {HOUR_NS} ORDER BY sequence {order}) AS r FROM env) WHERE r <= 5"


@query(_kept_sql("ASC"))
def bp_drop_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queueing.drop_newest(_ticked(spark, sf_dir), 5).select("sequence", "tick")


@query(_kept_sql("ASC"))
def bp_drop_oldest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queueing.drop_oldest(_ticked(spark, sf_dir), 5).select("sequence", "tick")


@query(_kept_sql("DESC"))
def bp_drop_oldest_true(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queueing.drop_oldest(_ticked(spark, sf_dir), 5, evict=True).select("sequence", "tick")


@query(f"WITH {ENV} SELECT tick, CAST(CASE WHEN r <= 5 THEN 1 WHEN r <= 8 THEN 2 ELSE 0 END AS BIGINT) AS sink_id, count(*) AS n FROM (SELECT ts_ns // {HOUR_NS} AS tick, row_number() OVER (PARTITION BY ts_ns // {HOUR_NS} ORDER BY sequence) AS r FROM env) GROUP BY 1, 2")
def bp_overflow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queueing.overflow(_ticked(spark, sf_dir), 5, 1, 2, 3).groupBy("tick", "sink_id").agg(F.count("*").alias("n"))


def _arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ticked(spark, sf_dir).groupBy(F.col("schema_id").alias("run"), "tick").agg(F.count("*").alias("arrivals"))


_ARRIVALS = f"{ENV}, a AS (SELECT CAST(schema_id AS INTEGER) AS run, ts_ns // {HOUR_NS} AS tick, count(*) AS arrivals FROM env GROUP BY 1, 2)"


@query(f"WITH {_ARRIVALS}, x AS (SELECT *, sum(arrivals - 3) OVER (PARTITION BY run ORDER BY tick) AS x FROM a) SELECT run, tick, arrivals, CAST(x - least(0, min(x) OVER (PARTITION BY run ORDER BY tick)) AS BIGINT) AS occupancy FROM x")
def queue_unbounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queueing.unbounded(_arrivals(spark, sf_dir), 3)


@query(
    f"WITH RECURSIVE {_ARRIVALS}, n AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY tick) AS i FROM a), "
    "q AS (SELECT run, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS tick, CAST(0 AS BIGINT) AS arrivals, CAST(0 AS BIGINT) AS written, CAST(0 AS BIGINT) AS consumed, CAST(0 AS BIGINT) AS occupancy FROM (SELECT DISTINCT run FROM n) "
    "UNION ALL SELECT n.run, n.i, n.tick, n.arrivals, least(n.arrivals, 6 - q.occupancy), least(q.occupancy + least(n.arrivals, 6 - q.occupancy), 3), q.occupancy + least(n.arrivals, 6 - q.occupancy) - least(q.occupancy + least(n.arrivals, 6 - q.occupancy), 3) FROM q JOIN n ON n.run = q.run AND n.i = q.i + 1) "
    "SELECT run, tick, arrivals, written, arrivals - written AS overflow, consumed, occupancy FROM q WHERE i > 0"
)
def queue_bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queueing.bounded(_arrivals(spark, sf_dir), 6, 3, block=64)


@query(f"WITH {ENV} SELECT ts_ns // {HOUR_NS} AS tick, count(*) AS n FROM env GROUP BY 1")
def tick_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.per_tick(events(spark, sf_dir), "ts_ns", HOUR_NS)


# ---------------------------------------------------------------- pacing, payloads, faults


@query("SELECT t AS tick, least((t + 1) * 1000000 // 333333 - t * 1000000 // 333333, 64) AS arrivals FROM range(2000) r(t)")
def pace_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pacing.arrivals(spark, 2000, pacing.Pattern("fixed_rate", pps=3000), 1_000_000)


@query("SELECT t AS tick, CASE WHEN t % 5 < 3 THEN least(4, 10 - t % 5 * 4) ELSE 0 END AS arrivals FROM range(2000) r(t)")
def pace_burst(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pacing.arrivals(spark, 2000, pacing.Pattern("burst", size=10, gap_ns=2_000_000, batch=4), 1_000_000)


@query("SELECT t AS tick, CAST(256 AS BIGINT) AS arrivals FROM range(500) r(t)")
def pace_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pacing.arrivals(spark, 500, pacing.Pattern("full_speed", batch=256), 1_000_000)


@query("SELECT i + 1 AS sequence, i // 3 AS tick, i // 3 * 1000000 + i % 3 AS ts_ns FROM range(3000) r(i)")
def pace_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pacing.packets(pacing.arrivals(spark, 1000, pacing.Pattern("full_speed", batch=3), 1_000_000), 1_000_000)


@query("SELECT i AS sequence, 'AAPL' AS symbol, 100000 + i % 1000 AS bid, 100001 + i % 1000 AS ask FROM range(1, 5001) r(i)")
def payload_market_quote(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.range(1, 5001).select(payload.market_quote(F.col("id")).alias("p")).select(payload.market_quote_decode(F.col("p")).alias("m"))
    return rows.select("m.sequence", "m.symbol", "m.bid", "m.ask")


@query("SELECT i AS sequence, 'MSFT' AS symbol, 100 + i % 50 AS price, CAST(strlen('35=Q|55=MSFT|44=' || (100 + i % 50) || '|34=' || i || '|') AS BIGINT) AS body_bytes FROM range(1, 5001) r(i)")
def payload_fix_quote(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.range(1, 5001).select(payload.fix_quote(F.col("id"), "MSFT").alias("p")).select(payload.fix_decode(F.col("p")).alias("m"), codecs.read_uint_be(F.col("p"), 0, 2).alias("body_bytes"))
    return rows.select(F.col("m")["34"].cast("long").alias("sequence"), F.col("m")["55"].alias("symbol"), F.col("m")["44"].cast("long").alias("price"), "body_bytes")


_LCG = "g AS (SELECT CAST(1 AS BIGINT) AS k, CAST(1 AS HUGEINT) AS x UNION ALL SELECT k + 1, (x * 6364136223846793005 + 1) % 18446744073709551616 FROM g WHERE k < {n})"


def _lcg(n: int) -> str:
    # 2^64 times 2^63 is over HUGEINT: the product goes in two halves.
    step = "((x % 4294967296) * 6364136223846793005 + (((x // 4294967296) * 6364136223846793005) % 4294967296) * 4294967296 + 1) % 18446744073709551616"
    return _LCG.format(n=n).replace("(x * 6364136223846793005 + 1) % 18446744073709551616", step)


@query(f"WITH RECURSIVE {_lcg(5000)} SELECT k AS sequence, CAST(x // 4294967296 AS DOUBLE) / 4294967295 < 0.05 AS dropped FROM g")
def fault_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return faults.drops(spark.range(1, 5001).withColumnRenamed("id", "sequence"), faults.Faults(drop_rate=0.05))


@query(None)
def fault_drop_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drops over the whole stream of events: the n-th in sequence takes the n-th draw. A recursive SQL is too slow for it."""
    placed = routing.numbered(events(spark, sf_dir).select("sequence"), name="place").withColumn("place", F.col("place") + 1)
    return faults.drops(placed, faults.Faults(drop_rate=0.05), "place").select("sequence", "dropped")


@query(None)
def fault_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).select(F.col("key").alias("source"), "sequence", F.encode("payload", "utf-8").alias("payload"))
    out = faults.mixed(rows, faults.Faults(drop_rate=0.05, corrupt_rate=0.02, spike_rate=0.1, spike_ns=500_000, seed=7))
    return out.select("source", "sequence", F.hex("payload").alias("payload"), "dropped", "corrupted", "spike_ns")


# ---------------------------------------------------------------- timeline and replay


@query(
    f"WITH {ENV}, c AS (SELECT key, ts_ns AS at, price AS rate FROM env WHERE suspect) "
    "SELECT e.sequence, e.key, coalesce(c.rate, -1) AS rate FROM env e ASOF LEFT JOIN c ON e.key = c.key AND e.ts_ns >= c.at"
)
def timeline_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event with the price of its user's latest error; -1 before the first."""
    rows = events(spark, sf_dir)
    changes = rows.filter("suspect").select("key", "ts_ns", F.col("price").alias("rate"), F.col("sequence").alias("place"))
    return timeline.as_of(rows.select("sequence", "key", "ts_ns"), changes, "key", "ts_ns", ["rate"]).select("sequence", "key", F.coalesce("rate", F.lit(-1)).alias("rate"))


def _release_sql(due: str) -> str:
    return f"WITH {ENV}, f AS (SELECT sequence, key, greatest(ts_ns - first_value(ts_ns) OVER (PARTITION BY key ORDER BY sequence), 0) AS delta FROM env) SELECT sequence, key, CAST(max({due}) OVER (PARTITION BY key ORDER BY sequence) AS BIGINT) AS release_ns FROM f"


@query(_release_sql("delta"))
def replay_original(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay.original_timing(events(spark, sf_dir), "key").select("sequence", "key", "release_ns")


@query(_release_sql("CAST(trunc(delta * 2.5::DOUBLE) AS BIGINT)"))
def replay_scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay.original_timing(events(spark, sf_dir), "key", factor=2.5).select("sequence", "key", "release_ns")


_PAUSES = f"p AS (SELECT user_id AS key, hour * {HOUR_NS} AS from_ns, (hour + 30) * {HOUR_NS} AS to_ns FROM (SELECT DISTINCT user_id FROM events), (SELECT unnest([24, 100, 400]) AS hour) WHERE user_id % 3 = 0)"
_DUE = "d AS (SELECT sequence, key, max(greatest(ts_ns - first_ns, 0)) OVER (PARTITION BY key ORDER BY sequence) AS due FROM (SELECT *, first_value(ts_ns) OVER (PARTITION BY key ORDER BY sequence) AS first_ns FROM env))"


def _pauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third user's replay is paused for thirty hours, three times."""
    users = events(spark, sf_dir).select("key").distinct().filter("key % 3 = 0")
    at = F.explode(F.array(*[F.struct(F.lit(h * HOUR_NS).alias("at_ns"), F.lit(on).alias("paused")) for start in (24, 100, 400) for h, on in ((start, True), (start + 30, False))]))
    return users.select("key", at.alias("c")).select("key", "c.*")


@query(f"WITH {ENV}, {_DUE}, {_PAUSES} SELECT sequence, d.key, coalesce(to_ns, due) AS release_ns FROM d LEFT JOIN p ON p.key = d.key AND due >= from_ns AND due < to_ns")
def replay_paused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A paused replay lets nothing go; resumed, what fell due goes at once."""
    due = replay.original_timing(events(spark, sf_dir), "key").select("sequence", "key", "release_ns")
    return replay.paused(due, _pauses(spark, sf_dir), "key")


@query(f"WITH {ENV}, {_DUE}, {_PAUSES} SELECT sequence, d.key, due + CAST(30 * {HOUR_NS} * (SELECT count(*) FROM p WHERE p.key = d.key AND from_ns - CASE from_ns // {HOUR_NS} WHEN 24 THEN 0 WHEN 100 THEN 30 ELSE 60 END * {HOUR_NS} <= due) AS BIGINT) AS release_ns FROM d")
def replay_paused_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A paused clock: resumed, distances are as they were recorded."""
    due = replay.original_timing(events(spark, sf_dir), "key").select("sequence", "key", "release_ns")
    return replay.paused(due, _pauses(spark, sf_dir), "key", keep_distances=True)


@query(f"WITH {ENV} SELECT sequence, (row_number() OVER (ORDER BY sequence) - 1) // 100 * 3000000 AS release_ns FROM env")
def replay_burst(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay.burst(events(spark, sf_dir), 100, 2_500_000, 1_000_000).select("sequence", "release_ns")


@query(f"WITH {ENV} SELECT sequence FROM env ORDER BY sequence LIMIT 51")
def replay_single_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay.single_step(events(spark, sf_dir).select("sequence"), 50)


# ---------------------------------------------------------------- sources together, counters


@query("SELECT 'event' AS source, event_id AS sequence FROM events UNION ALL SELECT 'order', o_orderkey FROM orders")
def merge_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = events(spark, sf_dir).select(F.lit("event").alias("source"), "sequence")
    return left.unionByName(spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.lit("order").alias("source"), F.col("o_orderkey").alias("sequence")))


@query("SELECT event_type AS metric, 'counter' AS kind, CAST(count(*) AS DOUBLE) AS value FROM events GROUP BY 1")
def metrics_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.counters(spark.read.parquet(f"{sf_dir}/events.parquet"), "event_type")


def _metrics_sql(rows: dict[str, tuple[str, str]], source: str) -> str:
    return " UNION ALL ".join(f"SELECT '{name}' AS metric, '{kind}' AS kind, CAST(({value}) AS DOUBLE) AS value {source}" for name, (kind, value) in rows.items())


@query(
    f"WITH {ENV}, p AS (SELECT suspect, price < 1000 AS refused, CASE WHEN suspect THEN 20 ELSE 42 + strlen(payload) END AS b, (row_number() OVER (ORDER BY sequence) - 1) // 64 AS batch FROM env), "
    "g AS (SELECT batch, count(*) AS n, sum(b) AS b, sum(CAST(suspect AS INT)) AS f, sum(CAST(refused AS INT)) AS r FROM p GROUP BY batch) "
    + _metrics_sql(
        {
            "net.packets_received": ("counter", "SELECT sum(n) FROM g"),
            "net.packets_dropped": ("counter", "SELECT sum(r) FROM g"),
            "net.bytes_received": ("counter", "SELECT sum(b) FROM g"),
            "net.batches_polled": ("counter", "SELECT count(*) FROM g"),
            "net.batch_size": ("histogram", "SELECT median(n) FROM g"),
            "net.rx_ring_occupancy": ("gauge", "SELECT max_by(n, batch) / 64.0 FROM g"),
            "net.parse_failures": ("counter", "SELECT sum(f) FROM g"),
            "net.sink_write_failures": ("counter", "SELECT sum(r) FROM g"),
        },
        "",
    )
)
def metrics_net(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames in batches of 64; suspect ones are cut short and fail to parse, cheap ones find their sink full."""
    frame = codecs.udp_frame(F.encode("payload", "utf-8"), F.lit(9000))
    rows = events(spark, sf_dir).withColumn("data", F.when(F.col("suspect"), F.substring(frame, 1, 20)).otherwise(frame))
    return metrics.net(rows, 64, codecs.udp_parse(F.col("data")).isNull(), F.col("price") < 1000)


@query(
    "WITH d AS (SELECT string_split(coalesce(text, ''), chr(10)) AS l, strlen(coalesce(text, '')) AS b FROM documents), r AS (SELECT unnest(l[1:len(l) - 1]) AS line FROM d) "
    + _metrics_sql(
        {
            "storage.bytes_read": ("counter", "SELECT 2 * sum(b) FROM d"),
            "storage.records_read": ("counter", "SELECT 2 * count(*) FROM r WHERE strlen(line) + 1 <= 500"),
            "storage.parse_errors": ("counter", "SELECT 2 * ((SELECT count(*) FROM r WHERE strlen(line) + 1 > 500) + (SELECT count(*) FROM d WHERE strlen(l[len(l)]) >= 500))"),
            "storage.eof_reached": ("counter", "SELECT 2 * count(*) FROM d"),
            "storage.loop_count": ("counter", "SELECT 1"),
        },
        "",
    )
)
def metrics_storage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of lines, gone over twice; a line over 500 bytes is a parse error, and so is a tail that already has as many."""
    blobs = _document_blobs(spark, sf_dir)
    return metrics.storage(blobs, framing.delimited(blobs, 10, 500, permissive=True), loops=2)


@query(
    f"WITH {ENV}, o AS (SELECT strlen(payload) > 8 AS large, ts_ns // {HOUR_NS} AS tick, sequence FROM env), t AS (SELECT row_number() OVER (PARTITION BY tick ORDER BY sequence) <= 4 AS fits FROM o WHERE NOT large) "
    + _metrics_sql(
        {
            "memory.messages_written": ("counter", "SELECT count(*) FROM t WHERE fits"),
            "memory.ring_full": ("counter", "SELECT count(*) FROM t WHERE NOT fits"),
            "memory.oversized": ("counter", "SELECT count(*) FROM o WHERE large"),
        },
        "",
    )
)
def metrics_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ring of four slots of eight bytes, emptied every hour."""
    return metrics.memory(_ticked(spark, sf_dir), 4, 8)


@query(
    f"WITH {ENV}, r AS (SELECT *, schema_id % 2 + 1 AS s, (row_number() OVER (ORDER BY sequence) - 1) // 100 AS b FROM env), k AS (SELECT *, row_number() OVER (PARTITION BY b, s ORDER BY sequence) AS i FROM r) "
    + _metrics_sql(
        {
            "runtime.steps": ("counter", "SELECT count(DISTINCT b) FROM k"),
            "runtime.messages_out": ("counter", "SELECT count(*) FROM k WHERE i <= 30"),
            "runtime.messages_dropped": ("counter", "SELECT count(*) FROM k WHERE i > 30"),
            "runtime.backpressure_events": ("counter", "SELECT count(*) FROM k WHERE i > 30"),
            "runtime.workers": ("gauge", "SELECT 4"),
        },
        "",
    )
)
def metrics_runtime(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a pipeline of batches of 100 reports, whose sinks take 30 rows of each; a row that is dropped met a full sink."""
    config = RuntimeConfig(batch_size=100, capacity=30, backpressure="drop_newest")
    made = Pipeline().read(events(spark, sf_dir)).route(lambda df: df.withColumn("sink_id", (F.col("schema_id") % 2 + 1).cast("long"))).configured(config)
    return metrics.runtime(made.routed(), 100, F.col("sink_id") == 0, workers=4)


@query(f"WITH {ENV}, {_DUE} SELECT 'storage.replay_lag_ns' AS metric, 'gauge' AS kind, CAST({24 * 7} * {HOUR_NS} - max(due) AS DOUBLE) AS value FROM d WHERE due <= {24 * 7} * {HOUR_NS}")
def metrics_replay_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far a replay of all users' events lags behind its clock after a week."""
    return metrics.storage_replay(replay.original_timing(events(spark, sf_dir), "key"), 24 * 7 * HOUR_NS)


@query(f"WITH {ENV}, t AS (SELECT schema_id, ts_ns // {HOUR_NS} AS tick, count(*) AS n FROM env GROUP BY 1, 2), c AS (SELECT CAST(schema_id AS INTEGER) AS schema_id, tick, CAST(sum(n) OVER (PARTITION BY schema_id ORDER BY tick) AS BIGINT) AS total FROM t) SELECT schema_id, tick, total, CAST(total - coalesce(lag(total) OVER (PARTITION BY schema_id ORDER BY tick), 0) AS BIGINT) AS delta FROM c")
def pps_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    per_tick = _ticked(spark, sf_dir).groupBy("schema_id", "tick").agg(F.count("*").alias("n"))
    total = per_tick.select("schema_id", "tick", F.sum("n").over(W.partitionBy("schema_id").orderBy("tick")).alias("total"))
    return metrics.history(total, by="schema_id")


@query(f"WITH {ENV} SELECT key, count(*) AS n, CAST(sum(CASE WHEN suspect THEN 1 ELSE 0 END) AS DOUBLE) / count(*) AS drop_ratio FROM env GROUP BY 1")
def drop_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = events(spark, sf_dir).groupBy("key").agg(F.count("*").alias("n"), F.sum(F.col("suspect").cast("long")).alias("d"))
    return out.select("key", "n", metrics.ratio(F.col("d").cast("double"), F.col("n")).alias("drop_ratio"))


@query("SELECT event_id, event_type FROM events ORDER BY event_id DESC LIMIT 80")
def events_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.tail(spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "event_type"), 80, "event_id")


# ---------------------------------------------------------------- scenarios: counters that follow from their settings

_STATS = "SELECT '{0}' AS scenario, CAST({1} AS BIGINT) AS ticks, CAST({2} AS BIGINT) AS generated, CAST({3} AS BIGINT) AS dropped, CAST({4} AS BIGINT) AS written, CAST({5} AS BIGINT) AS consumed, CAST({6} AS BIGINT) AS overflow, CAST({7} AS BIGINT) AS clock_ns"
_GOLDEN = {
    "constant_rate": (1000, 100000, 0, 100000, 100000, 0, 1000000000),
    "market_open_burst": (5000, 1219984, 0, 1219984, 1219984, 0, 5000000000),
    "queue_overflow": (1000, 256000, 0, 16000, 16000, 240000, 100000000),
    "packet_loss": (10000, 100000, 5062, 94938, 94938, 0, 10000000000),
    "gaussian_rate": (1000, 49687, 0, 49687, 49687, 0, 1000000000),
    "protocol_quotes": (1000, 10000, 0, 10000, 10000, 0, 1000000000),
}


def _add_scenario(name: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return scenario.stats(spark, scenario.BUILTINS[name])

    QUERIES[f"scenario_{name}"] = run
    ORACLES[f"scenario_{name}"] = _STATS.format(name, *_GOLDEN[name])


for _name in _GOLDEN:
    _add_scenario(_name)


# ---------------------------------------------------------------- additions that have no counterpart: event time


@query(
    "WITH s AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS fresh FROM events), n AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM s) "
    "SELECT user_id, epoch_us(min(ts)) AS start_us, count(*) AS n FROM n GROUP BY user_id, k"
)
def session_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    out = rows.groupBy("user_id", F.session_window("ts", "1 hour")).agg(F.count("*").alias("n"))
    return out.select("user_id", F.unix_micros("session_window.start").alias("start_us"), "n")


@query(
    """WITH b AS (SELECT event_type, ts, event_id * 4 // (SELECT max(event_id) + 1 FROM events) AS k, (epoch_us(ts) // 21600000000 + 1) * 21600000 AS window_end FROM events),
    m AS (SELECT k, max(epoch_us(ts)) // 1000 - 86400000 AS seen FROM b GROUP BY k),
    w AS (SELECT k, max(seen) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS mark FROM m)
    SELECT event_type, window_end, count(*) AS n FROM b JOIN w USING (k) WHERE (mark IS NULL OR window_end > mark) AND window_end <= (SELECT max(seen) FROM m) GROUP BY 1, 2"""
)
def late_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a stream in four parts, a query each from one checkpoint: counts by six hours and type, rows over a day late are dropped, windows come out when they are closed."""
    given = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    parts = given.agg(F.max("event_id") + 1).first()[0]
    folder = lineage.new_path(spark, "late")
    for k in range(4):
        given.filter(F.floor(F.col("event_id") * 4 / parts) == k).drop("event_id").write.mode("append").parquet(f"{folder}/in")
        rows = spark.readStream.schema("event_type string, ts timestamp").parquet(f"{folder}/in")
        counts = pipelines.windowed_counts(rows, "ts", "6 hours", "1 day", ["event_type"]).select("event_type", F.unix_millis(F.col("window.end")).alias("window_end"), "n")
        counts.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start(f"{folder}/out").awaitTermination()
    return spark.read.schema("event_type string, window_end long, n long").parquet(f"{folder}/out")
