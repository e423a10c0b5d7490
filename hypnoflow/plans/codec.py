"""Queries on codecs: quantising, sensor frames, EDF text fields, annotations, configuration predicates, complex numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import signal as sig
from .tables import rounded, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


@query("SELECT event_id, CAST(greatest(-2048.0, least(2047.0, floor((value - 1.0) * 4095.0 / 249.0 - 2048.0 + 0.5))) AS INTEGER) AS digital FROM events")
def quantise_int16(spark: SparkSession, sf_dir: str) -> DataFrame:
    digital = sig.physical_to_digital(F.col("value"), *[F.lit(x) for x in (1.0, 250.0, -2048.0, 2047.0)])
    return table(spark, sf_dir, "events").select("event_id", digital.alias("digital"))


@query("SELECT l_orderkey, l_linenumber, round(-100.0 + (l_partkey % 65536 - 32768 + 32768) * 200.0 / 65535.0, 6) + 0.0 AS physical, CAST(0 AS DOUBLE) AS flat FROM lineitem")
def dequantise_int16(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("l_partkey") % 65536 - 32768
    p = sig.digital_to_physical(d, *[F.lit(x) for x in (-100.0, 100.0, -32768.0, 32767.0)])
    flat = sig.digital_to_physical(d, *[F.lit(x) for x in (-100.0, 100.0, 5.0, 5.0)])
    return rounded(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", p.alias("physical"), flat.alias("flat")), "physical", "flat")


@query("""WITH a AS (SELECT l_orderkey, l_linenumber, l_extendedprice - 30000.0 AS x FROM lineitem), b AS (SELECT *, x + 180.0 - 360.0 * floor((x + 180.0) / 360.0) - 180.0 AS w FROM a)
SELECT l_orderkey, l_linenumber, round(w, 6) + 0.0 AS wrapped, round(radians(w), 6) + 0.0 AS rad FROM b""")
def wrap_angle(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = sig.wrap_angle(F.col("l_extendedprice") - 30000.0)
    return rounded(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", w.alias("wrapped"), F.radians(w).alias("rad")), "wrapped", "rad")


@query("""WITH a AS (SELECT vec_id, radians(CAST(embedding[1] AS DOUBLE) * 720) AS x, radians(CAST(embedding[2] AS DOUBLE) * 360) AS y FROM embeddings),
g AS (SELECT vec_id, sin(y) AS gx, -sin(x) * cos(y) AS gy, cos(x) * cos(y) AS gz FROM a), r AS (SELECT vec_id, degrees(atan2(gx, gz)) AS roll, abs(degrees(atan2(gy, sqrt(gx * gx + gz * gz)))) AS incl FROM g)
SELECT vec_id, round(roll + 180.0 - 360.0 * floor((roll + 180.0) / 360.0) - 180.0, 6) + 0.0 AS roll, round(incl, 6) + 0.0 AS inclination FROM r""")
def body_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    roll, incl = sig.body_position(F.col("embedding")[0].cast("double") * 720, F.col("embedding")[1].cast("double") * 360)
    return rounded(e.select("vec_id", roll.alias("roll"), incl.alias("inclination")), "roll", "inclination")


#: A frame as hexadecimal text from an order's key: flags, rate (one or two bytes), energy, two beat intervals.
HR_HEX = "printf('%02x', o_orderkey % 32) || CASE WHEN o_orderkey % 2 = 1 THEN printf('%02x%02x', 40 + o_custkey % 160, o_custkey % 2) ELSE printf('%02x', 40 + o_custkey % 160) END || CASE WHEN o_orderkey // 8 % 2 = 1 THEN printf('%02x%02x', o_custkey % 256, 1) ELSE '' END || CASE WHEN o_orderkey // 16 % 2 = 1 THEN printf('%02x%02x%02x%02x', o_orderkey % 256, 3, o_custkey % 256, 2) ELSE '' END"


@query("""SELECT o_orderkey, CAST(40 + o_custkey % 160 + CASE WHEN o_orderkey % 2 = 1 THEN 256 * (o_custkey % 2) ELSE 0 END AS INTEGER) AS heart_rate, CASE WHEN o_orderkey // 2 % 2 = 1 THEN o_orderkey // 4 % 2 = 1 END AS contact,
  CASE WHEN o_orderkey // 8 % 2 = 1 THEN CAST(o_custkey % 256 + 256 AS INTEGER) END AS energy, CASE WHEN o_orderkey // 16 % 2 = 1 THEN 2 ELSE 0 END AS n_rr,
  CASE WHEN o_orderkey // 16 % 2 = 1 THEN round((o_orderkey % 256 + 768 + o_custkey % 256 + 512) / 1024.0, 6) ELSE 0.0 END AS rr_sum FROM orders""")
def rr_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    byte = lambda x: F.lpad(F.lower(F.hex(x)), 2, "0")
    bit = lambda i: F.getbit(key, F.lit(i)) == 1
    rate = F.when(bit(0), F.concat(byte(40 + cust % 160), byte(cust % 2))).otherwise(byte(40 + cust % 160))
    energy = F.when(bit(3), F.concat(byte(cust % 256), F.lit("01"))).otherwise("")
    rr = F.when(bit(4), F.concat(byte(key % 256), F.lit("03"), byte(cust % 256), F.lit("02"))).otherwise("")
    frame = F.unhex(F.concat(byte(key % 32), rate, energy, rr))
    decoded = table(spark, sf_dir, "orders").select("o_orderkey", frame.alias("frame")).select("o_orderkey", sig.heart_rate_frame(F.col("frame")).alias("d"))
    total = F.aggregate("d.rr", F.lit(0.0), lambda a, x: a + x)
    return rounded(decoded.select("o_orderkey", "d.heart_rate", "d.contact", "d.energy", F.size("d.rr").alias("n_rr"), total.alias("rr_sum")), "rr_sum")


@query("SELECT o_orderkey, round((CASE WHEN o_orderkey % 65536 >= 32768 THEN o_orderkey % 65536 - 65536 ELSE o_orderkey % 65536 END) / 100.0, 2) + 0.0 AS celsius FROM orders")
def temp_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    frame = F.unhex(F.concat(F.lpad(F.hex(key % 256), 2, "0"), F.lpad(F.hex(F.floor(key / 256) % 256), 2, "0")))
    return rounded(table(spark, sf_dir, "orders").select("o_orderkey", sig.temperature_frame(frame).alias("celsius")), "celsius", places=2)


@query("""WITH f AS (SELECT o_orderkey, o_orderkey * 37 % 65536 AS u, o_custkey * 91 % 65536 AS w FROM orders WHERE o_orderkey % 4 <> 0), s AS (SELECT o_orderkey, CASE WHEN u >= 32768 THEN u - 65536 ELSE u END AS a, CASE WHEN w >= 32768 THEN w - 65536 ELSE w END AS b FROM f)
SELECT o_orderkey, round(a / 32768.0 * 16, 4) + 0.0 AS acc_x, round(b / 32768.0 * 2000, 2) + 0.0 AS gyro_y, round(a / 32768.0 * 180, 3) + 0.0 AS angle_z FROM s""")
def imu_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    le = lambda x: F.concat(F.lpad(F.hex(x % 256), 2, "0"), F.lpad(F.hex(F.floor(x / 256)), 2, "0"))
    u, w, zero = le(F.col("o_orderkey") * 37 % 65536), le(F.col("o_custkey") * 91 % 65536), F.lit("0000")
    head = F.when(F.col("o_orderkey") % 4 == 0, "5562").otherwise("5561")
    frame = F.unhex(F.concat(head, u, zero, zero, zero, w, zero, zero, zero, u))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", frame.alias("frame")).where(sig.is_imu_frame(F.col("frame"))).select("o_orderkey", sig.imu_frame(F.col("frame")).alias("d"))
    return rows.select("o_orderkey", (F.col("d.acc")[0] + 0.0).alias("acc_x"), (F.col("d.gyro")[1] + 0.0).alias("gyro_y"), (F.col("d.angle")[2] + 0.0).alias("angle_z"))


@query("""SELECT o_orderkey, rpad('0', 8, ' ') || rpad(o_orderpriority || ' patient', 80, ' ') || rpad(printf('Order %d', o_orderkey), 80, ' ') || strftime(o_orderdate, '%d.%m.%y%H.%M.%S') || rpad('512', 8, ' ') || rpad('EDF+C', 44, ' ') || rpad('-1', 8, ' ') || substr(printf('%.6f', 30.0), 1, 8) || rpad('1', 4, ' ') AS header,
  CAST(strftime(o_orderdate, '%Y') AS INTEGER) AS year FROM orders""")
def edf_header_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.col("o_orderdate")
    fields = [("0", 8), (F.concat("o_orderpriority", F.lit(" patient")), 80), (F.format_string("Order %d", "o_orderkey"), 80)]
    text = [sig.fixed(F.lit(v) if isinstance(v, str) else v, w) for v, w in fields]
    rest = [sig.fixed(F.lit(v), w) for v, w in (("512", 8), ("EDF+C", 44), ("-1", 8), ("30.000000", 8), ("1", 4))]
    header = F.concat(*text, sig.header_start(day), *rest)
    rows = table(spark, sf_dir, "orders").select("o_orderkey", header.alias("header"))
    again = sig.parse_header_start(F.substring("header", 169, 8), F.substring("header", 177, 8))
    return rows.select("o_orderkey", "header", F.year(again).alias("year"))


@query("""SELECT p_partkey, p_brand, CAST(coalesce(sum(2 * p_size) OVER (PARTITION BY p_brand ORDER BY p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS byte_offset,
  CAST(sum(2 * p_size) OVER (PARTITION BY p_brand) AS BIGINT) AS record_bytes FROM part""")
def edf_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("p_brand")
    before = F.coalesce(F.sum(F.col("p_size") * 2).over(w.orderBy("p_partkey").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return table(spark, sf_dir, "part").select("p_partkey", "p_brand", before.cast("bigint").alias("byte_offset"), F.sum(F.col("p_size") * 2).over(w).cast("bigint").alias("record_bytes"))


@query("SELECT event_id, '+' || printf('%.3f', event_id / 8.0) || CASE WHEN event_id % 3 = 0 THEN chr(21) || printf('%.3f', event_id % 50 / 4.0) ELSE '' END || chr(20) || event_type || chr(20) || '|' AS tal FROM events")
def tal_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    lasting = F.when(F.col("event_id") % 3 == 0, F.col("event_id") % 50 / 4.0)
    tal = sig.build_tal(F.col("event_id") / 8.0, lasting, F.col("event_type"))
    return table(spark, sf_dir, "events").select("event_id", F.translate(tal, "\x00", "|").alias("tal"))


@query("SELECT event_id, event_id / 8.0 AS onset, CASE WHEN event_id % 3 = 0 THEN event_id % 50 / 4.0 END AS duration, event_type AS text, CAST(1.5 AS DOUBLE) AS record_time FROM events")
def tal_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    lasting = F.when(F.col("event_id") % 3 == 0, F.col("event_id") % 50 / 4.0)
    block = F.concat(F.lit("+1.500\x14\x14\x00"), sig.build_tal(F.col("event_id") / 8.0, lasting, F.col("event_type")), F.lit("\x00\x00"))
    rows = table(spark, sf_dir, "events").select("event_id", block.alias("b")).select("event_id", F.explode(sig.parse_tals(F.col("b"))).alias("a"), sig.first_onset(F.col("b")).alias("record_time"))
    return rows.select("event_id", "a.onset", "a.duration", "a.text", "record_time")


@query("""SELECT c_custkey, printf('MCH-%d', c_custkey) || ' ' || CASE WHEN c_nationkey % 2 = 0 THEN 'F' ELSE 'X' END || ' ' || upper(strftime(DATE '1950-01-15' + CAST(c_custkey % 20000 AS INTEGER), '%d-%b-%Y')) || ' ' || replace(replace(c_name, '#', ' '), ' ', '_') AS patient FROM customer""")
def patient_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    sex = F.when(F.col("c_nationkey") % 2 == 0, "F")
    born = F.date_add(F.lit("1950-01-15").cast("date"), (F.col("c_custkey") % 20000).cast("int"))
    text = sig.patient_id(F.format_string("MCH-%d", "c_custkey"), sex, born, F.replace("c_name", F.lit("#"), F.lit(" ")))
    return table(spark, sf_dir, "customer").select("c_custkey", text.alias("patient"))


@query("SELECT o_orderkey, 'Startdate ' || upper(strftime(o_orderdate, '%d-%b-%Y')) || ' ' || printf('PSG-%d', o_custkey) || ' X ' || replace(o_orderpriority, ' ', '_') AS recording FROM orders")
def recording_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = sig.recording_id(F.col("o_orderdate"), F.format_string("PSG-%d", "o_custkey"), F.lit(None).cast("string"), F.col("o_orderpriority"))
    return table(spark, sf_dir, "orders").select("o_orderkey", text.alias("recording"))


@query("""SELECT c_custkey, (c_mktsegment = 'BUILDING' AND c_nationkey = 3) OR (c_mktsegment = 'MACHINERY' OR c_nationkey = 7) AS shown, true AS always, false AS never,
  CASE WHEN length(c_mktsegment) < 9 THEN 'min_length' WHEN length(c_mktsegment) > 9 THEN 'max_length' END AS error FROM customer""")
def visibility_dnf(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = [{"conditions": [("c_mktsegment", "BUILDING"), ("c_nationkey", 3)]}, {"mode": "any", "conditions": [("c_mktsegment", "MACHINERY"), ("c_nationkey", 7)]}]
    return table(spark, sf_dir, "customer").select("c_custkey", sig.visible_if(groups).alias("shown"), sig.visible_if(None).alias("always"), sig.visible_if([]).alias("never"), sig.field_error(F.col("c_mktsegment"), True, 9, 9).alias("error"))


@query("""WITH a AS (SELECT o_orderkey, CAST(o_custkey % 17 - 8 AS DOUBLE) AS re, CAST(o_orderkey % 13 - 6 AS DOUBLE) AS im FROM orders)
SELECT o_orderkey, round((re * 2.0 - im * 3.0), 6) + 0.0 AS mul_re, round((re * 3.0 + im * 2.0), 6) + 0.0 AS mul_im, round((re * 2.0 + im * 3.0) / 13.0, 6) + 0.0 AS div_re, round((im * 2.0 - re * 3.0) / 13.0, 6) + 0.0 AS div_im,
  round(sqrt(re * re + im * im), 6) AS magnitude, round(atan2(im, re), 6) + 0.0 AS phase, round(re - 2.0, 6) + 0.0 AS sub_re, round(-im, 6) + 0.0 AS conj_im FROM a""")
def complex_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = sig.complex_of(F.col("o_custkey") % 17 - 8.0, F.col("o_orderkey") % 13 - 6.0)
    b = sig.complex_of(F.lit(2.0), F.lit(3.0))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", a.alias("a"), b.alias("b"))
    a, b = F.col("a"), F.col("b")
    product, quotient = sig.c_mul(a, b), sig.c_div(a, b)
    out = rows.select("o_orderkey", product["re"].alias("mul_re"), product["im"].alias("mul_im"), quotient["re"].alias("div_re"), quotient["im"].alias("div_im"), sig.c_abs(a).alias("magnitude"), sig.c_phase(a).alias("phase"), sig.c_sub(a, b)["re"].alias("sub_re"), sig.c_conj(a)["im"].alias("conj_im"))
    return rounded(out, *out.columns[1:])


@query("SELECT o_orderkey, CAST(floor(least(30000.0, 250.0 * pow(2.0, o_orderkey % 12))) AS BIGINT) AS wait_ms FROM orders")
def backoff_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", sig.backoff_cap(F.col("o_orderkey") % 12, 250, 30000).alias("wait_ms"))


@query("SELECT p_brand, array_to_string(list(p_partkey ORDER BY p_partkey DESC)[1:3], ',') AS newest, array_to_string(list_filter(list(p_size ORDER BY p_partkey), lambda x: x <> 7)[1:5], ',') AS kept, array_to_string(list_append(list(p_partkey ORDER BY p_partkey)[1:1], -1) || list(p_partkey ORDER BY p_partkey)[2:3], ',') AS inserted FROM part GROUP BY p_brand")
def array_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.array_sort(F.collect_list(F.struct("p_partkey", "p_size"))).alias("a"))
    edits = {"newest": F.slice(F.reverse(F.col("a.p_partkey")), 1, 3), "kept": F.slice(F.filter("a.p_size", lambda x: x != 7), 1, 5), "inserted": F.array_insert(F.slice("a.p_partkey", 1, 3), 2, F.lit(-1).cast("bigint"))}
    return g.select("p_brand", *[F.array_join(x, ",").alias(n) for n, x in edits.items()])


@query("SELECT n_nationkey, CAST(greatest(ceil((n_nationkey + 1) * 2.5 * 300.0) + n_nationkey * 30, 2 * n_nationkey * 30) AS BIGINT) AS capacity FROM nation")
def buffer_capacity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.series import capacity

    n = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select("n_nationkey", capacity((n + 1) * F.lit(2.5), n * 30).cast("bigint").alias("capacity"))
