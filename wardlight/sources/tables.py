"""Table loading and the binding of the logical clinical tables to the driver's parquet tables.

Every logical table is a lazy projection over one parquet scan (no collect, no cache): Catalyst
prunes unused columns and pushes filters on physical columns into the scan. On a real deployment
the same logical tables would come from ``read_jdbc`` or a parquet lake partitioned by
``tenant_id``; only this module changes.

Binding (driver tables → logical names):

patients      customer   id=c_custkey, tenant_id=c_custkey mod 5, first/last = parts of c_name
doctors       supplier   id=s_suppkey, tenant_id=s_suppkey mod 5, experience=floor(|acctbal|/500)
appointments  orders     id=o_orderkey, patient_id=o_custkey, doctor_id=o_custkey div 15,
                         opd_date=o_orderdate, status P/F/O → 0/1/4, department_id=o_orderpriority
prescriptions orders     one header per order, problem=o_orderpriority, created_at=o_orderdate
items         lineitem⋈part  candidate item tables split by l_returnflag (A, N, R)
messages      conversations
vectors       embeddings tenant_id = label
requests      events     key = user_id
departments   nation     words for the doctors' department ids
dependents    events     patient_id=user_id, no tenant of their own
schedules     supplier   one per doctor; scheduleDays lineitem, no tenant of their own
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlight.sources.mapping import EntityMapping

DRIVER_TABLES = ("region nation customer supplier part orders lineitem events documents "
                 "embeddings pages benchmark labels conversations").split()

N_TENANTS = 5
# Fifteen customers per supplier at every scale factor, so every supplier is reached.
DOCTOR_OF_ORDER = "o_custkey div 15"

# Appointment status codes (0 pending, 1 completed, 4 cancelled).
STATUS_CODES = {"pending": 0, "completed": 1, "cancelled": 4}

# Candidate tables, in priority order, for prescription headers and items.
HEADER_CANDIDATES = ("prescriptions", "opd_prescriptions", "ipd_prescriptions")
ITEM_CANDIDATES = ("prescription_medicines", "prescription_items",
                   "opd_prescription_items", "ipd_prescription_items")
# Driver binding of the item candidates: lineitem rows split by return flag; the fourth is absent.
ITEM_SPLIT = {"prescription_medicines": "A", "prescription_items": "N",
              "opd_prescription_items": "R"}


def read_table(spark: SparkSession, sf_dir: str, name: str, spread: bool = False) -> DataFrame:
    """A parquet table, listed anew.

    ``spread``: a scan with fewer input splits than the session's default parallelism (one small
    file with a single row group) is round-robin redistributed, so row-wise CPU work after the scan
    (regex cleaning, JSON parsing, document assembly) uses every core. Large inputs have many
    splits and are left untouched (no extra shuffle). Off unless asked for.
    """
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    df = spark.read.parquet(path)
    if spread:
        par = spark.sparkContext.defaultParallelism
        if df.rdd.getNumPartitions() < par:
            df = df.repartition(par)
    return df


class LazyTables(Mapping):
    """``{entity: DataFrame}`` whose frames are only built when a query asks for them."""

    def __init__(self, builders: dict):
        self._builders = builders
        self._built: dict[str, DataFrame] = {}

    def __getitem__(self, key: str) -> DataFrame:
        if key not in self._built:
            self._built[key] = self._builders[key]()
        return self._built[key]

    def __iter__(self):
        return iter(self._builders)

    def __len__(self) -> int:
        return len(self._builders)


def read_jdbc(spark: SparkSession, url: str, table: str, *, partition_column: str | None = None,
              lower: int | None = None, upper: int | None = None, num_partitions: int = 64,
              properties: dict | None = None) -> DataFrame:
    """A MySQL (or any JDBC) table as a parallel scan split on ``partition_column``.

    Filters written on the returned DataFrame are pushed into the WHERE clause by Spark's JDBC
    source; bound values never become SQL text.
    """
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table)
    for k, v in (properties or {}).items():
        reader = reader.option(k, v)
    if partition_column is not None:
        reader = (reader.option("partitionColumn", partition_column)
                  .option("lowerBound", lower).option("upperBound", upper)
                  .option("numPartitions", num_partitions))
    return reader.load()


def write_by_tenant(df: DataFrame, path: str, tenant_col: str = "tenant_id",
                    mode: str = "overwrite") -> None:
    """Lay a logical table out as ``<path>/tenant_id=<t>/`` so the mandatory tenant filter (F1)
    becomes partition pruning. Rows are rebalanced by tenant: AQE joins small tenants and splits one
    with a third of all rows, so the number of files follows the bytes, not tasks times tenants."""
    df.hint("rebalance", tenant_col).write.mode(mode).partitionBy(tenant_col).parquet(path)


def read_by_tenant(spark: SparkSession, path: str, tenant_col: str = "tenant_id") -> DataFrame:
    """Read a tenant-partitioned table with the partition column declared as a string (the
    library-wide tenant type), so ``tenant_id = 't'`` prunes folders without any cast."""
    from pyspark.sql import types as T
    inferred = spark.read.parquet(path).schema
    fields = [T.StructField(f.name, T.StringType(), True) if f.name == tenant_col else f
              for f in inferred.fields]
    return spark.read.schema(T.StructType(fields)).parquet(path)


def _tenant(key: Column) -> Column:
    return F.pmod(key, F.lit(N_TENANTS)).cast("string")


def _first(name: Column) -> Column:
    return F.split_part(name, F.lit("#"), F.lit(1))


def _last(name: Column) -> Column:
    return F.split_part(name, F.lit("#"), F.lit(2))


class Catalog:
    """Logical clinical tables bound to one directory of driver parquet tables."""

    def __init__(self, spark: SparkSession, sf_dir: str, spread: bool = False):
        """``spread``: redistribute single-split scans (see ``read_table``); worth it for row-heavy
        narrow pipelines (passage building, JSON parsing), not for join-heavy plans."""
        self.spark = spark
        self.sf_dir = sf_dir
        self.spread = spread

    def raw(self, name: str) -> DataFrame:
        return read_table(self.spark, self.sf_dir, name, spread=self.spread)

    # ---- entities -------------------------------------------------------------------------
    def patients(self) -> DataFrame:
        c = self.raw("customer")
        return c.select(
            F.col("c_custkey").alias("id"),
            _tenant(F.col("c_custkey")).alias("tenant_id"),
            _first(F.col("c_name")).alias("first_name"),
            _last(F.col("c_name")).alias("last_name"),
            F.when(F.col("c_nationkey") % 2 == 0, F.lit("female")).otherwise(F.lit("male")).alias("gender"),
            F.when(F.col("c_acctbal") >= 0,
                   F.date_format(F.date_add(F.lit("1950-01-01").cast("date"),
                                            (F.col("c_custkey") % 20000).cast("int")), "yyyy-MM-dd"))
             .otherwise(F.lit("")).alias("dob"),
            F.col("c_mktsegment").alias("segment"),
            F.col("c_nationkey").alias("nation_id"),
            F.col("c_acctbal").alias("balance"),
        )

    def doctors(self) -> DataFrame:
        s = self.raw("supplier")
        return s.select(
            F.col("s_suppkey").alias("id"),
            _tenant(F.col("s_suppkey")).alias("tenant_id"),
            _first(F.col("s_name")).alias("first_name"),
            _last(F.col("s_name")).alias("last_name"),
            F.floor(F.abs(F.col("s_acctbal")) / 500).cast("int").alias("experience"),
            F.col("s_nationkey").cast("string").alias("doctor_department_id"),
            F.when(F.col("s_acctbal") >= 0,
                   F.concat(F.lit("Specialty "), (F.col("s_nationkey") % 7).cast("string")))
             .otherwise(F.lit("")).alias("specialist"),
        )

    def appointments(self) -> DataFrame:
        return self.bind_appointments(self.raw("orders"))

    @staticmethod
    def bind_appointments(o: DataFrame) -> DataFrame:
        """The appointments projection over an orders frame (batch or stream)."""
        return o.select(
            F.col("o_orderkey").alias("id"),
            _tenant(F.col("o_custkey")).alias("tenant_id"),
            F.col("o_custkey").alias("patient_id"),
            F.expr(DOCTOR_OF_ORDER).alias("doctor_id"),
            F.col("o_orderdate").alias("opd_date"),
            F.when(F.col("o_orderstatus") == "P", 0).when(F.col("o_orderstatus") == "F", 1)
             .when(F.col("o_orderstatus") == "O", 4).alias("status"),
            F.col("o_orderpriority").alias("department_id"),
            F.col("o_totalprice").alias("amount"),
            F.col("o_orderdate").alias("created_at"),
            F.col("o_orderdate").alias("updated_at"),
        )

    def prescriptions(self) -> DataFrame:
        o = self.raw("orders")
        return o.select(
            F.col("o_orderkey").alias("id"),
            _tenant(F.col("o_custkey")).alias("tenant_id"),
            F.col("o_custkey").alias("patient_id"),
            F.expr(DOCTOR_OF_ORDER).alias("doctor_id"),
            F.col("o_orderstatus").alias("status"),
            F.col("o_orderpriority").alias("problem"),
            F.when(F.col("o_orderstatus") == "F", F.lit("CBC")).otherwise(F.lit("")).alias("test"),
            F.when(F.col("o_totalprice") > 250000, F.lit("Rest and fluids")).alias("advice"),
            F.when(F.col("o_orderpriority") == "1-URGENT", 1).otherwise(0).alias("diabetic"),
            F.col("o_orderdate").alias("created_at"),
            F.col("o_orderdate").alias("updated_at"),
        )

    def item_rows(self, flag: str) -> DataFrame:
        """One candidate item table: lineitem rows of one return flag (the filter reaches the scan)."""
        li = self.raw("lineitem").where(F.col("l_returnflag") == flag)
        return li.select(
            F.col("l_orderkey").alias("prescription_id"),
            F.col("l_linenumber").alias("line_no"),
            F.col("l_partkey").alias("part_id"),
            F.col("l_suppkey").alias("supplier_id"),
            F.col("l_extendedprice").alias("price"),
            F.col("l_quantity").cast("string").alias("dosage"),
            F.concat(F.col("l_linenumber").cast("string"), F.lit(" days")).alias("duration"),
            F.when(F.col("l_linestatus") == "O", F.lit("morning")).otherwise(F.lit("night")).alias("time"),
            F.when(F.col("l_discount") >= 0.05, F.lit("after food")).otherwise(F.lit("")).alias("comment"),
        )

    def item_tables(self) -> dict[str, DataFrame]:
        """The candidate item tables that exist, by physical name (absent ones are missing)."""
        return {t: self.item_rows(flag) for t, flag in ITEM_SPLIT.items()}

    def medicine_names(self) -> DataFrame:
        return self.raw("part").select(F.col("p_partkey").alias("part_id"), F.col("p_name").alias("medicine_name"))

    def with_medicine_names(self, items: DataFrame) -> DataFrame:
        """Item rows + medicine name (inner join on the part, like the item tables' own join). The
        names are hashed, so no task sorts its items."""
        return items.join(self.medicine_names().hint("shuffle_hash"), "part_id", "inner")

    def holidays(self) -> DataFrame:
        """doctor_holidays: one row per (doctor, day) derived from returned lines."""
        li = self.raw("lineitem")
        return (li.where(F.col("l_returnflag") == "R")
                .select(F.col("l_suppkey").alias("doctor_id"),
                        _tenant(F.col("l_suppkey")).alias("tenant_id"),
                        F.to_date("l_shipdate").alias("date")))

    def departments(self) -> DataFrame:
        """Names of the doctors' departments."""
        return self.raw("nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))

    def dependents(self) -> DataFrame:
        """One row per event; the tenant is the patient's."""
        return self.raw("events").select(
            F.col("event_id").alias("id"), F.col("user_id").alias("patient_id"), F.col("event_type").alias("relation"),
            F.col("ts").alias("created_at"))

    def schedules(self) -> DataFrame:
        """One row per doctor."""
        return self.raw("supplier").select(
            (F.col("s_suppkey") + 100_000_000).alias("id"), _tenant(F.col("s_suppkey")).alias("tenant_id"), F.col("s_suppkey").alias("doctor_id"))

    def schedule_days(self) -> DataFrame:
        """One row per line; doctor and tenant are those of the schedule."""
        return self.raw("lineitem").select(
            (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), (F.col("l_suppkey") + 100_000_000).alias("schedule_id"),
            F.to_date("l_shipdate").alias("available_on"), F.col("l_quantity").cast("int").alias("max_tokens"))

    def messages(self) -> DataFrame:
        return self.bind_messages(self.raw("conversations"))

    @staticmethod
    def bind_messages(c: DataFrame) -> DataFrame:
        return c.select(F.col("conv_id").cast("string").alias("session_id"),
                        F.col("turn").alias("seq"), "role", F.col("text").alias("content"))

    def vectors(self) -> DataFrame:
        e = self.raw("embeddings")
        return e.select(F.col("vec_id").alias("id"), F.col("label").cast("string").alias("tenant_id"),
                        "embedding")

    def requests(self) -> DataFrame:
        return self.bind_requests(self.raw("events"))

    @staticmethod
    def bind_requests(e: DataFrame) -> DataFrame:
        return e.select("event_id", F.col("user_id").alias("key"), "ts")

    def tables(self) -> Mapping[str, DataFrame]:
        return LazyTables({"patients": self.patients, "doctors": self.doctors,
                           "appointments": self.appointments, "prescriptions": self.prescriptions,
                           "doctorHolidays": self.holidays, "dependents": self.dependents,
                           "schedules": self.schedules, "scheduleDays": self.schedule_days,
                           "departments": self.departments})


# Logical mappings for the driver binding (alias → physical column of the Catalog frames).
DRIVER_MAPPINGS: dict[str, EntityMapping] = {
    "patients": EntityMapping("patients", "patients", {
        "id": "id", "tenant": "tenant_id", "firstName": "first_name", "lastName": "last_name",
        "gender": "gender", "dob": "dob", "department": "segment", "nation": "nation_id",
        "balance": "balance"}),
    "doctors": EntityMapping("doctors", "doctors", {
        "id": "id", "tenant": "tenant_id", "firstName": "first_name", "lastName": "last_name",
        "experience": "experience", "department": "doctor_department_id", "specialty": "specialist"},
        lookups={"department": ("departments", "id", "name")}),
    "appointments": EntityMapping("appointments", "appointments", {
        "id": "id", "tenant": "tenant_id", "patient": "patient_id", "doctor": "doctor_id",
        "department": "department_id", "scheduledAt": "opd_date", "status": "status",
        "amount": "amount", "createdAt": "created_at", "updatedAt": "updated_at"}),
    "prescriptions": EntityMapping("prescriptions", "prescriptions", {
        "id": "id", "tenant": "tenant_id", "patient": "patient_id", "doctor": "doctor_id",
        "status": "status", "problemDescription": "problem", "test": "test", "advice": "advice",
        "diabetic": "diabetic", "createdAt": "created_at", "updatedAt": "updated_at"}),
    "doctorHolidays": EntityMapping("doctorHolidays", "doctor_holidays", {
        "doctor": "doctor_id", "tenant": "tenant_id", "date": "date"}),
    "dependents": EntityMapping("dependents", "dependents", {
        "id": "id", "patient": "patient_id", "relation": "relation", "createdAt": "created_at"}),
    "schedules": EntityMapping("schedules", "schedules", {"id": "id", "doctor": "doctor_id", "tenant": "tenant_id"}),
    "scheduleDays": EntityMapping("scheduleDays", "schedule_days", {
        "id": "id", "schedule": "schedule_id", "availableOn": "available_on", "maxTokens": "max_tokens"}),
}
