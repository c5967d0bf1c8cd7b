"""Domain views over order, line, event, text and conversation tables.

``Views(spark, folder)`` derives every input of the library from the given
Parquet tables; each property is a lazy DataFrame.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from neraca.operators.ordered import running_sum

MONEY = "decimal(18,2)"


def party(c: Column) -> Column:
    """15-digit taxpayer id of a customer or supplier key (one shared id space)."""
    return F.lpad(c.cast("string"), 15, "0")


class Views:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def spread(self, name: str) -> DataFrame:
        """The table dealt out evenly over the shuffle partitions, for parsing that keeps a core
        busy whatever the sizes of the files."""
        return self.table(name).hint("rebalance")

    @cached_property
    def invoice(self) -> DataFrame:
        return self._invoice(self.table("orders"))

    @cached_property
    def spread_invoice(self) -> DataFrame:
        return self._invoice(self.spread("orders"))

    def _invoice(self, orders: DataFrame) -> DataFrame:
        sellers = (
            self.table("lineitem").groupBy("l_orderkey").agg(F.min("l_suppkey").alias("seller"))
        )
        orders = orders.select(
            "o_orderkey", "o_custkey", "o_orderdate", F.col("o_totalprice").cast(MONEY).alias("dpp")
        )
        vat = F.round(F.col("dpp") * F.lit("0.11").cast("decimal(3,2)"), 2).cast(MONEY)
        return (
            orders.join(sellers, F.col("o_orderkey") == F.col("l_orderkey"))
            .select(
                F.col("o_orderkey").alias("row_idx"),
                F.col("o_orderkey").cast("string").alias("nomor_faktur"),
                F.to_date("o_orderdate").alias("tanggal"),
                party(F.col("seller")).alias("npwp_penjual"),
                party(F.col("o_custkey")).alias("npwp_pembeli"),
                "dpp",
                vat.alias("ppn"),
            )
            .withColumn("total", (F.col("dpp") + F.col("ppn")).cast(MONEY))
        )

    @cached_property
    def withholding(self) -> DataFrame:
        """One slip per order and supplier.  Every fourth order's slips name no payer; those of the
        next are dated and priced near the order's invoice."""
        # Dealt out by order once: the slips are grouped and joined with their orders where they lie.
        lines = self.table("lineitem").repartition("l_orderkey").groupBy("l_orderkey", "l_suppkey").agg(
            F.min("l_shipdate").alias("shipped"), F.sum(F.col("l_extendedprice").cast(MONEY)).cast(MONEY).alias("gross")
        )
        orders = self.table("orders").select("o_orderkey", "o_custkey", "o_orderdate", F.col("o_totalprice").cast(MONEY).alias("price"))
        key = F.col("l_orderkey")
        share = F.lit(1).cast("decimal(3,2)") + ((key % 5) - 2).cast("decimal(3,0)") * F.lit("0.01").cast("decimal(3,2)")
        near = key % 4 == 1
        bruto = F.when(near, F.round(F.col("price") * share, 2).cast(MONEY)).otherwise(F.col("gross"))
        return lines.join(orders, key == F.col("o_orderkey")).select(
            (key * 1000 + F.col("l_suppkey")).alias("row_idx"),
            F.concat_ws("/", "l_orderkey", "l_suppkey").alias("nomor_bukti_potong"),
            F.when(near, F.date_add(F.to_date("o_orderdate"), (key % 9).cast("int"))).otherwise(F.to_date("shipped")).alias("tanggal"),
            party(F.col("l_suppkey")).alias("npwp_dipotong"),
            F.when(key % 4 == 0, "").otherwise(party(F.col("o_custkey"))).alias("npwp_pemotong"),
            bruto.alias("bruto"),
            F.round(bruto * F.lit("0.02").cast("decimal(3,2)"), 2).cast(MONEY).alias("pph"),
        )

    @cached_property
    def bank(self) -> DataFrame:
        return self._bank(self.table("orders"))

    @cached_property
    def spread_bank(self) -> DataFrame:
        return self._bank(self.spread("orders"))

    def _bank(self, orders: DataFrame) -> DataFrame:
        key = F.col("o_orderkey")
        price = F.col("o_totalprice").cast(MONEY)
        total = price + F.round(price * F.lit("0.11").cast("decimal(3,2)"), 2).cast(MONEY)
        drift = F.lit(1).cast("decimal(3,2)") + ((key % 7) - 3).cast("decimal(3,0)") * F.lit(
            "0.01"
        ).cast("decimal(3,2)")
        zero = F.lit(0).cast(MONEY)
        return orders.select(
            key.alias("row_idx"),
            party(F.col("o_custkey")).alias("account_number"),
            F.date_add(F.to_date("o_orderdate"), (key % 9).cast("int")).alias("tanggal"),
            F.concat(F.lit("PEMBAYARAN FAKTUR "), key.cast("string")).alias("keterangan"),
            F.when(key % 5 != 0, F.round(total.cast(MONEY) * drift, 2).cast(MONEY))
            .otherwise(zero)
            .alias("debet"),
            F.when(key % 5 == 0, price).otherwise(zero).alias("kredit"),
        )

    @cached_property
    def ledger_rows(self) -> DataFrame:
        """Ledger without balances: event rows as debit or credit of an account."""
        amount = F.col("value").cast(MONEY)
        is_debit = F.col("event_type").isin("purchase", "error")
        zero = F.lit(0).cast(MONEY)
        return self.table("events").select(
            F.col("event_id").alias("row_idx"),
            F.col("user_id").alias("account"),
            "ts",
            F.to_date("ts").alias("tanggal"),
            F.col("event_type").alias("keterangan"),
            F.when(is_debit, amount).otherwise(zero).alias("debet"),
            F.when(is_debit, zero).otherwise(amount).alias("kredit"),
        )

    @cached_property
    def ledger(self) -> DataFrame:
        """Ledger with reported balances; a planted break on every 97th row."""
        running = running_sum(
            self.ledger_rows,
            ["account"],
            ["ts", "row_idx"],
            F.col("kredit") - F.col("debet"),
            "chain",
        )
        planted = F.when(F.col("row_idx") % 97 == 0, 1000).otherwise(0).cast(MONEY)
        return running.withColumn("saldo", (F.col("chain") + planted).cast(MONEY)).drop("chain")

    @cached_property
    def texts(self) -> DataFrame:
        """Extracted texts with a document type by source number."""
        number = F.regexp_extract("source", r"(\d+)", 1).cast("int") % 5
        kinds = F.array(*[F.lit(k) for k in DOCUMENT_TYPES])
        return self.table("documents").select(
            F.col("doc_id"),
            F.get(kinds, number).alias("document_type"),
            F.col("text").alias("extracted_text"),
            F.concat(F.get(kinds, number), F.lit("_"), F.col("doc_id").cast("string"), F.lit(".pdf")).alias(
                "original_filename"
            ),
        )

    @cached_property
    def batches(self) -> DataFrame:
        status = F.create_map(*[F.lit(v) for pair in ORDER_STATUS.items() for v in pair])
        return self.table("orders").select(
            F.col("o_orderkey").alias("id"),
            F.col("o_custkey").alias("user_id"),
            F.element_at(status, F.col("o_orderstatus")).alias("status"),
            F.col("o_orderdate").alias("created_at"),
            F.col("o_orderpriority").alias("priority"),
        )

    @cached_property
    def files(self) -> DataFrame:
        """One uploaded file per order and supplier."""
        returned = F.max(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)) == 1
        done = F.min(F.when(F.col("l_linestatus") == "F", 1).otherwise(0)) == 1
        return (
            self.table("lineitem")
            .groupBy("l_orderkey", "l_suppkey")
            .agg(
                F.when(returned & done, "failed").when(done, "completed").otherwise("processing").alias("status"),
                F.max("l_shipdate").alias("created_at"),
                F.max("l_partkey").alias("content"),
            )
            .select(
                (F.col("l_orderkey") * 1000 + F.col("l_suppkey")).alias("id"),
                F.col("l_orderkey").alias("batch_id"),
                F.concat(
                    F.get(F.array(*[F.lit(k) for k in DOCUMENT_TYPES]), (F.col("l_suppkey") % 5).cast("int")),
                    F.lit("_"),
                    F.col("l_suppkey").cast("string"),
                    F.lit(".pdf"),
                ).alias("name"),
                F.get(F.array(*[F.lit(k) for k in DOCUMENT_TYPES]), (F.col("l_suppkey") % 5).cast("int")).alias("type"),
                "status",
                "created_at",
                F.md5(F.col("content").cast("string")).alias("file_hash"),
            )
        )

    @cached_property
    def messages(self) -> DataFrame:
        return self.table("conversations").select(
            F.col("conv_id").alias("session_id"), F.col("turn"), "role", F.col("text").alias("content")
        )

    @cached_property
    def stream_events(self) -> DataFrame:
        return self.table("events").select("event_id", "ts", F.col("user_id").alias("actor"), "event_type", "value")


# Document types and the states of a batch.
DOCUMENT_TYPES = ["faktur_pajak", "pph21", "pph23", "rekening_koran", "invoice"]
ORDER_STATUS = {"F": "completed", "O": "processing", "P": "partial"}
