"""Streaming ingestion: submissions in, analysed reports and signals out."""

from __future__ import annotations

import datetime as dt
import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.store import SCHEMAS, Store, validated

#: The fields of a submission, each with the types that its JSON value may have.
FIELDS = {"raw_text": ("STRING", "VOID"), "submitted_at": ("STRING", "VOID")}
UNREADABLE = "request.bad-request"


def submissions(spark: SparkSession, folder: str) -> DataFrame:
    """JSON submissions as they arrive in a folder, one a line."""
    return read_lines(spark.readStream.text(folder))


def read_lines(lines: DataFrame) -> DataFrame:
    """What each line (value) submits: raw_text, submitted_at, and line, error_code, detail.

    A submission is an object of the known fields; each may be absent or null. A line that is broken, is no
    object, names a field twice or one that is not known, or has a value of another type, such as a time
    that is none, has an error_code and the others stand. Names are told apart by case. An absent time is
    that of the batch. What follows the object in its line is not read. Blank and null lines are no
    submissions. Other columns are not looked at.
    """
    read = lines.select(F.col("value").alias("line")).where(F.col("line").rlike(r"[^\x00-\x20]"))
    fields = read.withColumn("fields", F.expr("try_cast(try_parse_json(line) as map<string, variant>)"))
    value = {f: F.element_at("fields", f) for f in FIELDS}
    strange = F.array_except(F.map_keys("fields"), F.array(*map(F.lit, FIELDS)))
    mistyped = F.filter(F.array(*(F.when(~F.schema_of_variant(value[f]).isin(*types), f) for f, types in FIELDS.items())), lambda f: f.isNotNull())
    known = fields.select(
        "line", "fields", strange.alias("strange"), mistyped.alias("mistyped"),
        F.try_variant_get(value["raw_text"], "$", "string").alias("raw_text"),
        F.try_variant_get(value["submitted_at"], "$", "timestamp").alias("at"),
        F.try_variant_get(value["submitted_at"], "$", "string").alias("told_at"),
    )
    detail = (
        F.when(F.col("fields").isNull(), "not a JSON object")
        .when(F.size("strange") > 0, F.concat(F.lit("unknown field: "), F.array_join(F.array_sort("strange"), ", ")))
        .when(F.size("mistyped") > 0, F.concat(F.lit("wrong type: "), F.array_join("mistyped", ", ")))
        .when(F.col("told_at").isNotNull() & F.col("at").isNull(), "wrong type: submitted_at")
    )
    bad = detail.isNotNull()
    return known.select(
        F.when(~bad, F.col("raw_text")).alias("raw_text"), F.when(~bad, F.coalesce("at", F.current_timestamp())).alias("submitted_at"),
        "line", F.when(bad, UNREADABLE).alias("error_code"), detail.alias("detail"),
    )


def ingest(stream: DataFrame, store: Store, checkpoint: str, clock: Callable[[], dt.datetime] = lambda: dt.datetime.now(dt.timezone.utc), trigger: dict | None = None, **options) -> StreamingQuery:
    """Stores, analyses and announces every micro-batch of raw_text, submitted_at, or of what read_lines gives.

    Texts are compared with the stored ones of equal first digits instead of kept in the stream's
    state, which would grow for ever. Work is chosen by what is pending, so a batch that is run again
    after a failure repeats nothing that was finished and misses nothing that was not. Refused
    submissions go to the table refused, in a folder that the batch names: a batch run again replaces
    its own.
    """
    source = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]

    def batch(rows: DataFrame, number: int) -> None:
        told = rows if "error_code" in rows.columns else rows.withColumns({c: F.lit(None).cast("string") for c in ("line", "error_code", "detail")})
        told = validated(told.withColumnRenamed("error_code", "unreadable")).withColumn("error_code", F.coalesce("unreadable", "error_code")).drop("unreadable")
        # a line that is stored has all that matters in its text
        told = told.withColumn("line", F.when(F.col("error_code").isNotNull(), F.col("line"))).persist()
        store.append("refused", told.where("error_code is not null").withColumn("refused_at", F.lit(clock()).cast("timestamp")), f"{source}-{number}")
        store.submit(told.where("error_code is null").select("raw_text", "submitted_at"))
        store.analyse_pending(clock(), **options)
        told.unpersist()

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def signal_stream(spark: SparkSession, store: Store) -> DataFrame:
    """Signals as they are appended."""
    return spark.readStream.schema(SCHEMAS["signal"]).option("recursiveFileLookup", "true").parquet(f"{store.path}/signal")
