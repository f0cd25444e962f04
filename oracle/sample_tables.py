"""Service requests derived from the order tables in FIXTURES.md.

One line item becomes one request. Faults follow from key arithmetic, so any
engine that reads the same files produces the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dueward.schemas import RAW_COLUMNS, ROW_ID, ROW_PLACE
from dueward.session import use_utc


# Stored columns in use. Declared, so that planning reads no file footer.
_SCHEMAS = {
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                "l_returnflag string, l_linestatus string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_orderdate timestamp_ntz, "
              "o_orderpriority string",
    "customer": "c_custkey bigint, c_mktsegment string",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string",
    "supplier": "s_suppkey bigint, s_nationkey int",
    "nation": "n_nationkey int, n_regionkey int",
    "region": "r_regionkey int, r_name string",
}


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(_SCHEMAS[name]).parquet(f"{folder}/{name}.parquet")


def _iso(day):
    return F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit("T00:00:00.000"))


def _packed(*texts: str) -> Column:
    """Texts as one: the length of each (a dash for NULL) and a comma, then the texts."""
    lengths = [F.coalesce(F.char_length(t).cast("string"), F.lit("-")) for t in texts]
    return F.concat(*[x for n in lengths for x in (n, F.lit(","))], *[F.coalesce(t, F.lit("")) for t in texts])


def _unpacked(packed: str, *names: str) -> list[Column]:
    """The texts of :func:`_packed`, under these names."""
    found, at = [], F.char_length(F.substring_index(packed, ",", len(names))) + 2
    for k, name in enumerate(names):
        size = F.substring_index(F.substring_index(packed, ",", k + 1), ",", -1).try_cast("int")
        found.append(F.substring(F.col(packed), at, size).alias(name))
        at = at + F.coalesce(size, F.lit(0))
    return found


def service_requests(spark: SparkSession, folder: str) -> DataFrame:
    """The 18 raw text columns, a stable row identity, a number in source order and the order key.

    Join strategies are left to the optimizer: the fixed five- and 25-row tables
    and whatever fits its size check are broadcast, the rest is sort-merged. Lines
    meet their parts first, while they are narrow, and orders their customers. A part's
    texts travel as one value, behind their lengths.
    """
    use_utc(spark)
    line = _table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.col("l_quantity").cast("int").alias("days"), "l_returnflag", "l_linestatus",
    )
    order = _table(spark, folder, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority",
        F.col("o_orderdate").cast("date").alias("day"),
    )
    customer = _table(spark, folder, "customer").select("c_custkey", "c_mktsegment")
    part = _table(spark, folder, "part").select("p_partkey", _packed("p_type", "p_brand", "p_name").alias("p_texts"))
    supplier = _table(spark, folder, "supplier").select("s_suppkey", "s_nationkey")
    nation = _table(spark, folder, "nation").select("n_nationkey", "n_regionkey")
    region = _table(spark, folder, "region").select("r_regionkey", "r_name")
    placed = order.join(customer, order.o_custkey == customer.c_custkey)
    joined = (
        line.join(part, line.l_partkey == part.p_partkey)
        .join(placed, line.l_orderkey == F.col("o_orderkey"))
        .join(supplier, line.l_suppkey == supplier.s_suppkey)
        .join(nation, F.col("s_nationkey") == nation.n_nationkey)
        .join(region, F.col("n_regionkey") == region.r_regionkey)
        # An exact copy is a second element, not a second scan.
        .withColumn("copy", F.explode(F.when(F.col("l_orderkey") % 97 == 0, F.array(F.lit(0), F.lit(1)))
                                      .otherwise(F.array(F.lit(0)))))
        .select("*", *_unpacked("p_texts", "p_type", "p_brand", "p_name"))
    )
    part_key, cust_key = F.col("l_partkey"), F.col("c_custkey")
    status = (
        F.when((F.col("l_linestatus") == "F") & (part_key % 50 == 0), " CLOSED ")
        .when(F.col("l_linestatus") == "F", "Closed")
        .when(F.col("l_returnflag") == "N", "Open")
        .when(F.col("l_returnflag") == "A", "Cancelled")
        .when(part_key % 7 == 0, "Pending")
        .otherwise("Started")
    )
    closed_day = F.date_add("day", F.col("days") - F.when(part_key % 149 == 0, 60).otherwise(0))
    due_day = F.date_add("day", (F.lit(10) + F.col("l_suppkey") % 15
                                 - F.when(part_key % 157 == 0, 60).otherwise(0)).cast("int"))
    nothing = F.lit(None).cast("string")
    columns = {
        "unique_key": F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")),
        "created_date": F.when(part_key % 211 == 0, "not-a-date").when(part_key % 199 == 0, nothing)
                         .otherwise(_iso(F.col("day"))),
        "closed_date": F.when((status == "Open") | (part_key % 61 == 0), nothing).otherwise(_iso(closed_day)),
        "due_date": F.when(F.col("l_suppkey") % 10 == 0, nothing).otherwise(_iso(due_day)),
        "agency": F.col("r_name"),
        # Some rows of one agency, outside every tested scope, carry its former name.
        "agency_name": F.concat(F.lit("Department of "), F.col("r_name"), F.when(
            (F.col("r_name") == "MIDDLE EAST") & (part_key % 173 == 0), " (former)").otherwise("")),
        "complaint_type": F.col("p_type"),
        "descriptor": F.col("p_brand"),
        "descriptor_2": nothing,
        "status": status,
        "borough": F.when(cust_key % 37 == 0, "Unspecified").when(cust_key % 41 == 0, nothing)
                    .when(cust_key % 43 == 0, F.lower("c_mktsegment")).otherwise(F.col("c_mktsegment")),
        "incident_zip": F.when(cust_key % 53 == 0, "12345.0").when(cust_key % 59 == 0, "123")
                         .when(cust_key % 67 == 0, nothing).otherwise(F.lpad(cust_key.cast("string"), 5, "0")),
        "latitude": F.when(cust_key % 83 == 0, "bad").when(cust_key % 89 == 0, "95.0")
                     .when(cust_key % 71 == 0, nothing).when(cust_key % 73 == 0, "35.0").otherwise("40.75"),
        "longitude": F.when(cust_key % 71 == 0, nothing).when(cust_key % 79 == 0, "-200.0").otherwise("-73.9"),
        "location_type": F.col("p_name"),
        "open_data_channel_type": F.col("o_orderpriority"),
        "resolution_description": F.col("o_orderstatus"),
        "resolution_action_updated_date": nothing,
    }
    row_id = F.concat_ws("-", *[F.col(c).cast("string") for c in
                                ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "copy")])
    return joined.select(
        *[columns[c].alias(c) for c in RAW_COLUMNS],
        row_id.alias(ROW_ID),
        ((F.col("l_orderkey") * 16 + F.col("l_linenumber")) * 2 + F.col("copy")).alias(ROW_PLACE),
        F.col("l_orderkey").alias("order_key"),
    )


def as_landed(requests: DataFrame, *, orders_per_page: int = 500, limit: int = 2000) -> DataFrame:
    """Lay the sample requests out as landed pages, with known faults.

    A page covers a fixed number of orders, so its size does not grow with the
    data. Every fifth page is out of order and page 3 arrives a second time.
    """
    text = F.col("created_date")
    disordered = F.col("page_number") % 5 == 0
    in_page = Window.partitionBy("page_number").orderBy(
        F.when(~disordered, F.coalesce(text, F.lit(""))), F.when(~disordered, F.col("unique_key")), ROW_ID)
    placed = requests.withColumn(
        "page_number", F.floor(F.col("order_key") / orders_per_page).cast("bigint") + 1
    ).withColumn("pos", (F.row_number().over(in_page) - 1).cast("bigint"))
    copies = placed.withColumn("page_number", F.explode(
        F.when(F.col("page_number") == 3, F.array(F.col("page_number"), F.lit(1_000_003).cast("bigint")))
        .otherwise(F.array("page_number"))))
    return copies.select(
        "page_number", ((F.col("page_number") - 1) * limit).alias("offset"),
        F.lit(limit).cast("bigint").alias("requested_limit"), "pos",
        F.to_json(F.struct(*RAW_COLUMNS)).alias("record"), *RAW_COLUMNS, ROW_ID)
