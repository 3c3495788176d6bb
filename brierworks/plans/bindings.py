"""Domain tables derived from the provided warehouse tables, in Spark and as SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType


_SCHEMAS: dict[str, StructType] = {}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """Scan a table; its schema is read from the footer once per path and declared afterwards."""
    path = f"{sf}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def events(spark, sf):
    return table(spark, sf, "events")


def station():
    return F.expr("user_id % 20")


def lead():
    return F.expr("(event_id * 7) % 120")


def forecasts(spark, sf) -> DataFrame:
    """One daily forecast per non-view event."""
    return events(spark, sf).filter("event_type <> 'view'").select(
        F.col("event_id").alias("run_id"),
        station().alias("station_id"),
        F.col("event_type").alias("source_id"),
        F.to_date("ts").alias("target_date"),
        F.col("value").alias("high_f"),
        (F.col("value") / 2).alias("low_f"),
        lead().alias("lead_hours"),
    )


def runs(spark, sf) -> DataFrame:
    return events(spark, sf).filter("event_type <> 'view'").select(
        F.col("event_id").alias("run_id"), F.col("event_type").alias("source_id"), F.col("ts").alias("issued_at")
    )


def readings(spark, sf) -> DataFrame:
    """Station readings: the view events."""
    return events(spark, sf).filter("event_type = 'view'").select(
        F.col("event_id").alias("reading_id"), station().alias("station_id"), "ts", F.col("value").alias("temp_f")
    )


def observations(spark, sf) -> DataFrame:
    return (
        readings(spark, sf)
        .groupBy("station_id", F.to_date("ts").alias("target_date"))
        .agg(F.max("temp_f").alias("observed_high_f"), F.min("temp_f").alias("observed_low_f"))
    )


def stations(spark, sf) -> DataFrame:
    """Station dimension. Time zone and office are fixed functions of the id."""
    zones = F.array(*[F.lit(z) for z in ZONES])
    ids = events(spark, sf).select(station().alias("station_id")).distinct()
    return ids.select(
        "station_id",
        F.element_at(zones, (F.col("station_id") % 4 + 1).cast("int")).alias("tz"),
        (F.col("station_id") % 7).alias("office"),
        F.concat(F.lit("C"), F.lpad(F.col("station_id").cast("string"), 2, "0")).alias("city_code"),
        (F.col("station_id") % 5 != 4).alias("is_active"),
    )


ZONES = ("America/New_York", "America/Chicago", "America/Denver", "America/Phoenix")


def graded(spark, sf) -> DataFrame:
    """Probabilities with known outcomes: one per order."""
    return table(spark, sf, "orders").select(
        "o_orderkey",
        F.expr("o_custkey % 20").alias("station_id"),
        F.expr("CASE WHEN o_orderkey % 2 = 0 THEN 'HIGH' ELSE 'LOW' END").alias("target_type"),
        F.expr("concat('h', cast(o_orderkey % 5 + 1 as string))").alias("lead_bracket"),
        F.to_date("o_orderdate").alias("target_date"),
        F.expr("((o_orderkey * 37) % 1000) / 1000.0D").alias("p"),
        F.expr("((o_orderkey * 53) % 90 + 5) / 100.0D").alias("price"),
        F.expr("CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END").alias("outcome"),
    )


def positions(spark, sf) -> DataFrame:
    """One position per order; station from the customer, office from the customer's region."""
    o = table(spark, sf, "orders")
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    n = table(spark, sf, "nation").select("n_nationkey", "n_regionkey")
    joined = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
    return joined.select(
        F.col("o_orderkey").alias("position_id"),
        F.expr("c_custkey % 20").alias("station_id"),
        F.col("n_regionkey").alias("office"),
        F.to_date("o_orderdate").alias("target_date"),
        F.expr("CASE WHEN o_orderkey % 2 = 0 THEN 'HIGH' ELSE 'LOW' END").alias("target_type"),
        F.expr("(o_orderkey * 11) % 400 * 1.0D").alias("bin_lower"),
        F.expr("(o_orderkey * 11) % 400 + 60.0D").alias("bin_upper"),
        F.expr("concat('T', cast(o_orderkey % 997 as string))").alias("ticker"),
        F.expr("(o_orderkey % 90 + 5) / 100.0D").alias("entry_price"),
        F.expr("o_orderkey % 40 + 1").alias("contracts"),
        F.expr("CASE WHEN o_orderpriority LIKE '1%' OR o_orderpriority LIKE '2%' THEN 'MAKER' ELSE 'TAKER' END").alias("order_type"),
        F.expr("CASE o_orderstatus WHEN 'O' THEN CASE WHEN o_orderkey % 7 = 0 THEN 'PAPER_OPEN' ELSE 'OPEN' END WHEN 'F' THEN 'SETTLED' ELSE 'FILLED' END").alias("status"),
    )


def book_levels(spark, sf) -> DataFrame:
    """Order-book levels: one per line item, the part as ticker."""
    return table(spark, sf, "lineitem").select(
        F.col("l_partkey").alias("ticker"),
        F.expr("cast(1 + l_linenumber * 5 + round(l_discount * 100) as int)").alias("price"),
        F.col("l_quantity").alias("quantity"),
    )


def snapshots(spark, sf) -> DataFrame:
    """Dated order-book headers per ticker: best price and depth of one order line."""
    return table(spark, sf, "lineitem").select(
        F.col("l_partkey").alias("ticker"),
        F.expr("l_orderkey * 10 + l_linenumber").alias("snapshot_id"),
        F.col("l_shipdate").alias("snapshot_at"),
        F.expr("round(l_discount * 100) / 100").alias("price"),
        F.expr("CASE WHEN l_tax = 0 THEN 0 ELSE l_quantity END").alias("depth"),
    )


# The same tables as common table expressions.
SQL = {
    "fc": """fc AS (SELECT event_id AS run_id, user_id % 20 AS station_id, event_type AS source_id,
        CAST(ts AS DATE) AS target_date, ts AS issued_at, value AS high_f, value / 2 AS low_f,
        (event_id * 7) % 120 AS lead_hours FROM events WHERE event_type <> 'view')""",
    "rd": """rd AS (SELECT event_id AS reading_id, user_id % 20 AS station_id, ts, value AS temp_f
        FROM events WHERE event_type = 'view')""",
    "obs": """obs AS (SELECT user_id % 20 AS station_id, CAST(ts AS DATE) AS target_date,
        max(value) AS observed_high_f, min(value) AS observed_low_f
        FROM events WHERE event_type = 'view' GROUP BY 1, 2)""",
    "latest": """latest AS (SELECT * FROM fc QUALIFY row_number() OVER (
        PARTITION BY station_id, source_id, target_date ORDER BY issued_at DESC, run_id DESC) = 1)""",
    "err": """err AS (
        SELECT l.station_id, source_id, l.target_date, 'HIGH' AS target_type, lead_hours,
               high_f AS f_raw, observed_high_f AS observed, high_f - observed_high_f AS e
        FROM latest l JOIN obs o ON l.station_id = o.station_id AND l.target_date = o.target_date
        UNION ALL
        SELECT l.station_id, source_id, l.target_date, 'LOW', lead_hours, low_f, observed_low_f, low_f - observed_low_f
        FROM latest l JOIN obs o ON l.station_id = o.station_id AND l.target_date = o.target_date)""",
    "errb": """errb AS (SELECT *, CASE WHEN lead_hours < 12 THEN 'h1' WHEN lead_hours < 24 THEN 'h2'
        WHEN lead_hours < 48 THEN 'h3' WHEN lead_hours < 72 THEN 'h4' ELSE 'h5' END AS lead_bracket FROM err)""",
    "st": """st AS (SELECT DISTINCT user_id % 20 AS station_id,
        ['America/New_York', 'America/Chicago', 'America/Denver', 'America/Phoenix'][(user_id % 20 % 4 + 1)::INT] AS tz,
        user_id % 20 % 7 AS office, 'C' || lpad((user_id % 20)::VARCHAR, 2, '0') AS city_code,
        user_id % 20 % 5 <> 4 AS is_active FROM events)""",
    "graded": """graded AS (SELECT o_orderkey, o_custkey % 20 AS station_id,
        CASE WHEN o_orderkey % 2 = 0 THEN 'HIGH' ELSE 'LOW' END AS target_type,
        'h' || (o_orderkey % 5 + 1)::VARCHAR AS lead_bracket, CAST(o_orderdate AS DATE) AS target_date,
        ((o_orderkey * 37) % 1000) / 1000.0::DOUBLE AS p, ((o_orderkey * 53) % 90 + 5) / 100.0::DOUBLE AS price,
        CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS outcome FROM orders)""",
    "pos": """pos AS (SELECT o_orderkey AS position_id, c_custkey % 20 AS station_id, n_regionkey AS office,
        CAST(o_orderdate AS DATE) AS target_date, CASE WHEN o_orderkey % 2 = 0 THEN 'HIGH' ELSE 'LOW' END AS target_type,
        (o_orderkey * 11) % 400 * 1.0::DOUBLE AS bin_lower, (o_orderkey * 11) % 400 + 60.0::DOUBLE AS bin_upper,
        'T' || (o_orderkey % 997)::VARCHAR AS ticker, (o_orderkey % 90 + 5) / 100.0::DOUBLE AS entry_price,
        o_orderkey % 40 + 1 AS contracts,
        CASE WHEN o_orderpriority LIKE '1%' OR o_orderpriority LIKE '2%' THEN 'MAKER' ELSE 'TAKER' END AS order_type,
        CASE o_orderstatus WHEN 'O' THEN CASE WHEN o_orderkey % 7 = 0 THEN 'PAPER_OPEN' ELSE 'OPEN' END WHEN 'F' THEN 'SETTLED' ELSE 'FILLED' END AS status
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)""",
    "lv": """lv AS (SELECT l_partkey AS ticker, CAST(1 + l_linenumber * 5 + round(l_discount * 100) AS INT) AS price,
        l_quantity AS quantity FROM lineitem)""",
    "snap": """snap AS (SELECT l_partkey AS ticker, l_orderkey * 10 + l_linenumber AS snapshot_id, l_shipdate AS snapshot_at,
        round(l_discount * 100) / 100 AS price, CASE WHEN l_tax = 0 THEN 0 ELSE l_quantity END AS depth FROM lineitem)""",
}
NEEDS = {"latest": ["fc"], "err": ["fc", "latest", "obs"], "errb": ["fc", "latest", "obs", "err"]}


def with_tables(*names: str, extra: str = "") -> str:
    """A WITH clause holding the named tables and what they need; ``extra`` adds further ones."""
    order: list[str] = []
    for name in names:
        for dep in [*NEEDS.get(name, []), name]:
            if dep not in order:
                order.append(dep)
    parts = [SQL[n] for n in order] + ([extra] if extra else [])
    return "WITH " + ",\n".join(parts) + "\n"
