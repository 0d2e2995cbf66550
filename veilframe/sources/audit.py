"""An audit trail: lines of value-free records, written once however often a batch runs.

A batch of records has a number and a folder.  Spark's committer puts a batch's files there at once or not at all; a
batch that runs again - a retried job, a stream after a restart - takes its own folder's place and no other.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: The fields of each contract, and which of them may be missing.
CONTRACTS = {
    "protection-scope/1": ({"contract", "scope", "reversible", "mode", "placeholders", "protected", "masked"}, {"by", "recall", "policy_hash"}),
    "protection-scope/2": ({"contract", "scope", "reversible", "mode", "placeholders", "stand_ins", "protected", "masked"}, {"by", "recall", "policy_hash"}),
    "restoration-scope/1": ({"contract", "scope", "clean", "restored", "tampered", "unknown"}, {"by", "unused"}),
}
LINE = "audit-line/1"


def refusal(record: Column) -> Column:
    """Why a record is none that is audited; null for those that are.  A contract's fields are closed."""
    contract = F.get_json_object(record, "$.contract")
    keys = F.json_object_keys(record)
    out = F.when(keys.isNull(), "not a JSON object").when(contract.isNull() | ~contract.isin(*CONTRACTS), "not a contract that is audited")
    for name, (must, may) in CONTRACTS.items():
        lists = lambda names: F.array(*map(F.lit, sorted(names)))
        unknown, missing = F.size(F.array_except(keys, lists(must | may))), F.size(F.array_except(lists(must), keys))
        out = out.when((contract == name) & (unknown > 0), "fields that its contract doesn't have").when((contract == name) & (missing > 0), "fields that its contract has are missing")
    return out


@dataclass(frozen=True)
class Counts:
    written: int
    dropped: int


class AuditTrail:
    """Appends records (scope, record) to a folder that all tasks reach; strict ones fail on a record they refuse, others count it."""

    def __init__(self, path: str, by: str = "", strict: bool = True):
        self.path, self.by, self.strict = path.rstrip("/"), by, strict

    def lines(self, records: DataFrame, at: Column | str) -> DataFrame:
        """(value, refused): a stamped line a record.  ``at`` is a time or a text to stamp with; times are in UTC, to the millisecond."""
        stamp = F.lit(at) if isinstance(at, str) else F.date_format(F.to_utc_timestamp(at, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
        why = refusal(F.col("record"))
        line = F.concat(F.lit(f'{{"line":"{LINE}","at":"'), stamp, F.lit('","record":'), F.col("record"), F.lit("}"))
        if self.strict:
            line = F.when(why.isNull(), line).otherwise(F.raise_error(F.concat(F.lit("audit: "), why)))
        return records.select(line.alias("value"), why.alias("refused"))

    def append(self, records: DataFrame, batch: int, at: Column | str | None = None) -> Counts:
        """Writes a batch; the same batch again takes its own place.  Counts are taken while it is written."""
        seen = Observation()
        lines = self.lines(records, F.current_timestamp() if at is None else at)
        lines = lines.observe(seen, F.count_if(F.col("refused").isNull()).alias("written"), F.count_if(F.col("refused").isNotNull()).alias("dropped"))
        lines.where("refused is null").select("value").write.mode("overwrite").text(f"{self.path}/batch={batch}")
        found = seen.get
        return Counts(found["written"], found["dropped"])

    def stream(self, records: DataFrame, checkpoint: str, at: Column | str | None = None) -> StreamingQuery:
        """Starts appending a stream of records, a batch a micro-batch."""
        return records.writeStream.foreachBatch(lambda batch, number: self.append(batch, number, at) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def read(self, spark: SparkSession) -> DataFrame:
        """(batch, at, record) of all lines."""
        parsed = F.from_json("value", "line string, at string")
        body = F.col("value").substr(F.instr("value", '"record":') + 9, F.length("value") - F.instr("value", '"record":') - 9)
        return spark.read.schema("value string, batch int").option("basePath", self.path).text(self.path).select("batch", parsed["at"].alias("at"), body.alias("record"))
