"""The append-only store: raw reports, and for every run of an analysis what it produced.

Nothing is updated in place. A report's outcome is that of its latest run; its records are those of
its latest run that succeeded, so a failed rerun leaves the older records standing and an empty one
hides them. A run's outcome is written last: rows of a run that broke off before are never read.

Raw reports lie in folders by the first digits of their digest and by batch, so a batch is compared
with the folders of its own digests, and a batch whose analysis broke off is found by its marker,
however large the store is. One writer at a time: two could store the same text twice.
"""

from __future__ import annotations

import datetime as dt
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.utils import AnalysisException

from ..functions.turkish import reporting_day
from ..operators.extraction import LONGEST_REASON, outcomes, records, scan, understood
from .catalog import Catalog
from .reference_data import PROVINCES, provinces
from .star import Star

LONGEST_TEXT = 10_000
SCHEMAS = {
    "raw_report": "raw_report_id string, raw_text string, text_hash string, submitted_at timestamp",
    "analysis_result": "raw_report_id string, run_ts timestamp, status string, analyzed_at timestamp, incident_count int, failure_reason string, warnings array<string>",
    "incident": "raw_report_id string, run_ts timestamp, id bigint, occurred_on date, date_source string, province_scope string, province_code smallint, event_type string, classification string, created_at timestamp",
    "incident_metric": "raw_report_id string, run_ts timestamp, incident_id bigint, metric_type string, metric_value bigint",
    "incident_shared_province": "raw_report_id string, run_ts timestamp, incident_id bigint, province_code smallint",
    "incident_keyword": "raw_report_id string, run_ts timestamp, incident_id bigint, keyword string, keyword_role string, char_start int, char_end int",
    "refused": "raw_text string, submitted_at timestamp, line string, error_code string, detail string, refused_at timestamp",
    "signal": "raw_report_id string, run_ts timestamp, incidents array<struct<id:bigint,occurred_on:date,event_type:string,province_codes:array<smallint>>>",
}

#: Folders of raw reports, of the letter h and the digest's first digits.
FOLDERS = "prefix string, batch string"
PREFIX = "concat('h', substring(text_hash, 1, 2))"


def work_folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share: below spark.checkpoint.dir, or, where that is unset
    and all run on one machine, a local one."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"{(root or tempfile.mkdtemp()).rstrip('/')}/store-{uuid.uuid4().hex}"


def utf16_length(text: str) -> F.Column:
    """Length in UTF-16 units: characters beyond the basic plane count twice."""
    return F.length(text) + F.length(text) - F.length(F.regexp_replace(text, r"[\x{10000}-\x{10FFFF}]", ""))


def validated(submissions: DataFrame, longest: int = LONGEST_TEXT) -> DataFrame:
    """With error_code: blank text, too long text, or null. A text has no more UTF-16 units than bytes and no
    fewer than characters, so few are counted."""
    blank = F.col("raw_text").isNull() | ~F.col("raw_text").rlike(r"[^\s\p{Z}\x1c-\x1f]")
    long = (F.octet_length("raw_text") > longest) & ((F.length("raw_text") > longest) | (utf16_length("raw_text") > longest))
    return submissions.withColumn("error_code", F.when(blank, "report.text.blank").when(long, "report.text.too-long"))


def hashed(submissions: DataFrame) -> DataFrame:
    """With the text's digest, the submission time in milliseconds, and an id where there is none."""
    rows = submissions.withColumns({"text_hash": F.sha2("raw_text", 256), "submitted_at": F.date_trunc("millisecond", "submitted_at")})
    made = F.substring(F.sha2(F.concat_ws("|", "text_hash", F.col("submitted_at").cast("string")), 256), 1, 24)
    return rows.withColumn("raw_report_id", F.coalesce("raw_report_id", made) if "raw_report_id" in rows.columns else made)


def first_of_each(rows: DataFrame) -> DataFrame:
    """The first submission of every text. Texts are grouped by digest with partial aggregation, so a
    text that is submitted over and over is no hot key."""
    row = F.struct("submitted_at", "raw_report_id", "raw_text")
    return rows.groupBy("text_hash").agg(F.min(row).alias("r")).select("r.raw_report_id", "r.raw_text", "text_hash", "r.submitted_at")


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        #: Batches stored by this object that nobody has begun to analyse.
        self.fresh: set[str] = set()

    def read(self, table: str) -> DataFrame:
        if table == "raw_report":
            return self._raw(f"{self.path}/raw_report").drop("prefix", "batch")
        try:
            return self.spark.read.schema(SCHEMAS[table]).option("recursiveFileLookup", "true").parquet(f"{self.path}/{table}")
        except AnalysisException:
            return self.spark.createDataFrame([], SCHEMAS[table])

    def _raw(self, *paths: str) -> DataFrame:
        """Raw reports below the paths, of which some may not exist, with their folders."""
        schema = f"{SCHEMAS['raw_report']}, {FOLDERS}"
        there = [p for p in paths if self._files(p)]
        if not there:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/raw_report").parquet(*there)

    def _hadoop(self, path: str) -> tuple:
        folder = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), folder

    def _files(self, path: str) -> list[str]:
        """What a path, possibly with wildcards, names."""
        system, folder = self._hadoop(path)
        return [f.getPath().toString() for f in system.globStatus(folder) or ()]

    def append(self, table: str, rows: DataFrame, name: str | None = None) -> DataFrame:
        """Adds rows, in a folder of their own; returns what was added. Under a name, they replace what was
        added under it before, so that work done again adds nothing twice."""
        folder = f"{self.path}/{table}/{name or uuid.uuid4().hex}"
        rows.select(*[f.name for f in StructType.fromDDL(SCHEMAS[table])]).write.mode("overwrite").parquet(folder)
        return self.spark.read.schema(SCHEMAS[table]).parquet(folder)

    def submit(self, submissions: DataFrame) -> DataFrame:
        """Stores new texts; receipts: raw_text, raw_report_id, submitted_at, newly_stored, error_code.
        A text that is stored already is answered with the stored report, which stays the first; of
        equal texts of one batch the first submission alone is newly stored."""
        batch = uuid.uuid4().hex
        checked = validated(submissions)
        mine = hashed(checked.where("error_code is null"))
        firsts = first_of_each(mine).withColumn("prefix", F.expr(PREFIX))
        folders = [r["prefix"] for r in mine.select(F.expr(PREFIX).alias("prefix")).distinct().collect()]
        older = self._raw(*(f"{self.path}/raw_report/prefix={p}" for p in folders)).where(F.col("batch") != batch)
        older = older.groupBy("text_hash").agg(F.min_by(F.struct("raw_report_id", "submitted_at"), F.struct("submitted_at", "raw_report_id")).alias("old"))
        known = firsts.join(older, "text_hash", "left")
        fresh = known.where("old is null").select("raw_report_id", "raw_text", "text_hash", "submitted_at", "prefix", F.lit(batch).alias("batch"))
        system, marker = self._hadoop(f"{self.path}/_pending/{batch}")
        system.mkdirs(marker)
        self.fresh.add(batch)
        fresh.repartition("prefix").write.mode("append").partitionBy("prefix", "batch").parquet(f"{self.path}/raw_report")
        told = known.select("text_hash", F.coalesce("old", F.struct("raw_report_id", "submitted_at")).alias("r"), F.col("old").isNull().alias("is_new"))
        order = Window.partitionBy("text_hash").orderBy("submitted_at", "raw_report_id")
        accepted = mine.withColumn("k", F.row_number().over(order)).select("raw_text", "text_hash", "k").join(told, "text_hash").select(
            "raw_text", "r.raw_report_id", "r.submitted_at", (F.col("is_new") & (F.col("k") == 1)).alias("newly_stored"), F.lit(None).cast("string").alias("error_code")
        )
        none = [F.lit(None).cast(t).alias(c) for c, t in (("raw_report_id", "string"), ("submitted_at", "timestamp"), ("newly_stored", "boolean"))]
        return accepted.unionByName(checked.where("error_code is not null").select("raw_text", *none, "error_code"))

    def reports_of(self, text_hash: str) -> DataFrame:
        """The report of a digest, from the folder of its first digits."""
        return self._raw(f"{self.path}/raw_report/prefix=h{text_hash[:2]}").drop("prefix", "batch").where(F.col("text_hash") == text_hash)

    def analyse(self, reports: DataFrame, run_ts: dt.datetime, catalog: Catalog | None = None, provinces: dict[int, str] | None = None, zone: str = "Europe/Istanbul") -> None:
        """Runs the extraction over raw reports and appends what it gives; never fails for one report.
        The day of a report is its submission day in the zone."""
        known = list(range(1, len(PROVINCES) + 1)) if provinces is None else [*provinces]
        read = understood(scan(reports.withColumn("ref_date", reporting_day("submitted_at", zone)), catalog, provinces, brief=True)).persist()
        found, outcome = records(read), outcomes(read)
        stamp = F.lit(run_ts).cast("timestamp")
        strange = F.exists(F.concat("shared_province_codes", F.array("province_code")), lambda c: c.isNotNull() & ~c.isin(*known))
        rows = found.withColumns({"run_ts": stamp, "created_at": stamp, "strange": strange, "id": F.xxhash64("raw_report_id", stamp, "ordinal")}).persist()
        bad = rows.where("strange").select("raw_report_id").distinct().withColumn("unknown", F.lit(True))
        good = rows.join(bad, "raw_report_id", "left_anti")
        self.append("incident", good)
        self.append("incident_metric", good.select("raw_report_id", "run_ts", F.col("id").alias("incident_id"), F.explode("metrics").alias("m")).select("raw_report_id", "run_ts", "incident_id", "m.metric_type", "m.metric_value"))
        self.append("incident_shared_province", good.select("raw_report_id", "run_ts", F.col("id").alias("incident_id"), F.explode("shared_province_codes").alias("province_code")))
        self.append("incident_keyword", good.select("raw_report_id", "run_ts", F.col("id").alias("incident_id"), F.explode("keywords").alias("k")).select("raw_report_id", "run_ts", "incident_id", F.substring("k.keyword", 1, 128).alias("keyword"), F.col("k.role").alias("keyword_role"), "k.char_start", "k.char_end"))
        counts = good.groupBy("raw_report_id").agg(F.count("*").cast("int").alias("n"))
        failed = (F.col("status") == "FAILED") | F.col("unknown").isNotNull()
        reason = F.substring(F.coalesce("failure_reason", F.when(F.col("unknown").isNotNull(), "ValueError: unknown province code")), 1, LONGEST_REASON)
        result = outcome.join(bad, "raw_report_id", "left").join(counts, "raw_report_id", "left").select(
            "raw_report_id", stamp.alias("run_ts"), F.when(failed, "FAILED").otherwise("ANALYZED").alias("status"), stamp.alias("analyzed_at"),
            F.when(failed, 0).otherwise(F.coalesce("n", F.lit(0))).alias("incident_count"), reason.alias("failure_reason"), F.when(failed, F.array().cast("array<string>")).otherwise(F.col("warnings")).alias("warnings"),
        )
        written = self.append("analysis_result", result)
        codes = F.when(F.col("province_code").isNotNull(), F.array("province_code")).otherwise(F.col("shared_province_codes"))
        self._announce(written, good.select("raw_report_id", "run_ts", "id", "occurred_on", "event_type", codes.alias("province_codes")))
        rows.unpersist()
        read.unpersist()

    def _announce(self, outcome: DataFrame, found: DataFrame) -> None:
        """Appends the signals of runs; found: their records with province_codes."""
        keys = ["raw_report_id", "run_ts"]
        each = found.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("id", "occurred_on", "event_type", "province_codes"))).alias("incidents"))
        good = outcome.where("status = 'ANALYZED'").select(*keys)
        self.append("signal", good.join(each, keys, "left").withColumn("incidents", F.coalesce("incidents", F.array())))

    def announce_missing(self, reports: DataFrame) -> None:
        """Signals of the reports' successful runs that have none: those of a process that ended between the
        outcome and the signal, whose records are complete, as an outcome is written after them."""
        keys = ["raw_report_id", "run_ts"]
        ids = reports.select("raw_report_id").distinct()
        silent = self.read("analysis_result").where("status = 'ANALYZED'").join(ids, "raw_report_id", "left_semi").join(self.read("signal").select(*keys), keys, "left_anti").persist()
        if silent.take(1):
            shared = self.read("incident_shared_province").groupBy(*keys, F.col("incident_id").alias("id")).agg(F.array_sort(F.collect_set("province_code")).alias("codes"))
            found = self.read("incident").join(silent.select(*keys), keys, "left_semi").join(shared, [*keys, "id"], "left")
            own = F.when(F.col("province_code").isNotNull(), F.array("province_code")).otherwise(F.coalesce("codes", F.array()))
            self._announce(silent, found.select(*keys, "id", "occurred_on", "event_type", own.cast("array<smallint>").alias("province_codes")))
        silent.unpersist()

    def reprocess(self, raw_report_ids: list[str], run_ts: dt.datetime, **options) -> None:
        """Runs stored reports again, with their original submission time."""
        self.analyse(self.read("raw_report").where(F.col("raw_report_id").isin(*raw_report_ids)), run_ts, **options)

    def pending(self) -> list[str]:
        """Batches whose analysis has not come to its end."""
        return [p.rsplit("/", 1)[1] for p in self._files(f"{self.path}/_pending/*")]

    def _of_batches(self, batches: list[str]) -> DataFrame:
        """Raw reports of batches."""
        return self._raw(*(f for b in batches for f in self._files(f"{self.path}/raw_report/prefix=*/batch={b}")))

    def unanalysed(self, batches: list[str] | None = None) -> DataFrame:
        """Reports of pending batches without any outcome: new ones, and those of a run that broke off.
        Outcomes are looked up only for batches that another run may have begun."""
        batches = self.pending() if batches is None else batches
        reports = self._of_batches(batches)
        new, begun = reports.where(F.col("batch").isin(*self.fresh)), reports.where(~F.col("batch").isin(*self.fresh))
        if set(batches) - self.fresh:
            new = new.unionByName(begun.join(self.read("analysis_result").select("raw_report_id"), "raw_report_id", "left_anti"))
        return new.drop("prefix", "batch")

    def analyse_pending(self, run_ts: dt.datetime, **options) -> None:
        """Analyses what is pending, announces what a run that broke off analysed and did not announce, and
        takes the batches' markers away."""
        batches = self.pending()
        if not batches:
            return
        begun = [b for b in batches if b not in self.fresh]
        if begun:
            self.announce_missing(self._of_batches(begun))
        reports = self.unanalysed(batches)
        self.fresh.difference_update(batches)
        self.analyse(reports, run_ts, **options)
        for batch in batches:
            system, marker = self._hadoop(f"{self.path}/_pending/{batch}")
            system.delete(marker, True)

    def star(self) -> Star:
        """The store as it now reads."""
        runs = self.read("analysis_result")
        good = latest(runs.where("status = 'ANALYZED'")).select("raw_report_id", "run_ts")
        current = {t: self.read(t).join(good, ["raw_report_id", "run_ts"], "left_semi") for t in ("incident", "incident_metric", "incident_shared_province", "incident_keyword")}
        province = provinces(self.spark)
        incident = current["incident"].drop("run_ts")
        children = [current[t].drop("raw_report_id", "run_ts") for t in ("incident_metric", "incident_shared_province", "incident_keyword")]
        return Star(incident, *children, province, latest(runs).drop("run_ts"))


def latest(runs: DataFrame) -> DataFrame:
    """Each report's latest run, by partial aggregation."""
    rest = [c for c in runs.columns if c != "raw_report_id"]
    return runs.groupBy("raw_report_id").agg(F.max_by(F.struct(*rest), "run_ts").alias("r")).select("raw_report_id", *(f"r.{c}" for c in rest))
