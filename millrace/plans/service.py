"""What a job service offers, as functions over Parquet tables partitioned by job. The store holds whole products:
replay, export and evaluation read nothing else."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import evaluating, exporting, records
from millrace.sources import lookups
from millrace.sources.staging import rowwise

TABLES = ("jobs", "products", "corrections")


class Service:
    """A missing table raises FileNotFoundError, a job or product that a table lacks KeyError."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def _write(self, df: DataFrame, table: str, by: str, mode: str = "append") -> None:
        """mode overwrite replaces the partitions that df has, and no others."""
        df.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(self._path(table))

    def _read(self, table: str) -> DataFrame:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self._path(table))
        if not p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
            raise FileNotFoundError(self._path(table))
        return self.spark.read.option("mergeSchema", True).parquet(self._path(table))

    def set_job(self, job_id: str, status: str, processed: int, total: int) -> None:
        """A job's state is its last row."""
        row = [(job_id, status, processed, total)]
        self._write(self.spark.createDataFrame(row, "job_id string, status string, processed int, total int").withColumn("at", F.current_timestamp()), "jobs", "job_id")

    def process(self, job_id: str, products: DataFrame, attributes: DataFrame | None = None) -> None:
        """Stores a job's products, whole records with their attributes; the job ends DONE or FAILED. The job's
        partition is replaced, so a job that is run again has its rows once, under the same ids."""
        total = products.count()
        self.set_job(job_id, "RUNNING", 0, total)
        if attributes is None:
            attributes = products.select("seq", F.lit(None).cast("int").alias("slot")).limit(0)
        try:
            r = lambda c: F.col(f"record.{c}").alias(c)
            columns = ["product_id", "mfg_part_num", "part_desc", "part_manuf_raw", "manufacturer_name", "brand_name", "classpath", "mfr_url", "confidence", "confidence_band"]
            made = records.records(products, attributes, job_id)
            self._write(made.select("seq", *map(r, columns), F.to_json("record").alias("data_json"), F.lit(job_id).alias("job_id")), "products", "job_id", "overwrite")
        except Exception:
            self.set_job(job_id, "FAILED", 0, total)
            raise
        self.set_job(job_id, "DONE", total, total)

    def job(self, job_id: str) -> dict:
        row = self._read("jobs").where(F.col("job_id") == job_id).orderBy(F.desc("at"), F.desc("processed")).first()
        if row is None:
            raise KeyError(job_id)
        return row.asDict()

    def results(self, job_id: str) -> DataFrame:
        """The job's partition only."""
        return self._read("products").where(F.col("job_id") == job_id)

    def replay(self, job_id: str, limit: int | None = None) -> DataFrame:
        """The job's products in input order, the first ones only where there is a limit."""
        return lookups.first_rows(self.results(job_id), "seq", limit)

    def records(self, job_id: str) -> DataFrame:
        """seq, record of the job's products, read tolerantly."""
        return records.parsed(self.results(job_id)).select("seq", "record")

    def product(self, job_id: str, product_id: str) -> dict:
        row = records.parsed(self.results(job_id).where(F.col("product_id") == product_id)).first()
        if row is None:
            raise KeyError(product_id)
        return row.record.asDict(True)

    def review(self, product_id: str, field: str, value: str) -> None:
        """A log only; corrections are not applied."""
        self._write(self.spark.createDataFrame([(product_id, field, value)], "product_id string, field string, value string").withColumn("at", F.current_timestamp()), "corrections", "field")

    def delivery(self, job_id: str, columns: list[str] | None = None) -> DataFrame:
        """seq and the delivery columns of the job's stored products; a job that runs gives what it has so far."""
        self.job(job_id)
        return exporting.delivery(records.flat(self.records(job_id)), columns)

    def export(self, job_id: str, path: str, columns: list[str] | None = None) -> None:
        exporting.write_csv(self.delivery(job_id, columns), path)

    def scored(self, job_id: str, labelled: DataFrame, true_attributes: DataFrame) -> DataFrame:
        """The evaluation of each stored product. labelled: seq, Mfg_Part_Num, classpath, manufacturer, and
        descriptions if any; true_attributes: its seq, label, value. Products meet the last labelled row of their part number."""
        stored = self.records(job_id)
        made = records.flat(stored)
        truth = exporting.last_by_key(labelled, "Mfg_Part_Num", "seq").withColumnRenamed("seq", "t_seq")
        met = made.select("seq", "Mfg_Part_Num").join(rowwise(truth), "Mfg_Part_Num")
        wanted = met.select("seq", "t_seq").join(rowwise(true_attributes.withColumnRenamed("seq", "t_seq")), "t_seq").drop("t_seq")
        return evaluating.evaluate(made, met.drop("Mfg_Part_Num", "t_seq"), records.attributes_of(stored), wanted)

    def evaluate(self, job_id: str, labelled: DataFrame, true_attributes: DataFrame) -> dict:
        """Totals of scored(), with the counts of all and of unscored products."""
        done = self.scored(job_id, labelled, true_attributes)
        total = self.results(job_id).count()
        summary = evaluating.summarize(done).first().asDict()
        out = {"job_id": job_id, "rows_total": total, "rows_unscored": total - summary["rows_scored"], **summary}
        return out | ({"note": "no products in this job matched a labelled part number"} if not summary["rows_scored"] else {})
