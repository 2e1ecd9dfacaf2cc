"""Secret scans over an incremental blob ledger.

Texts are content-addressed: a blob is the SHA-256 of a text.  The ledger is a folder of two append-only tables,
``scanned`` (blob, rule, version) and ``findings`` (blob, rule, version, start, end).  A scan looks only at pairs of blob
and rule version that ``scanned`` has not got, appends to both, and joins the findings of the current rule versions back
to every path that holds the blob, in whatever version of the corpus.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path


@dataclass(frozen=True)
class Rule:
    """A named pattern with a version; ``screen`` is a Java pattern that any text with a finding matches, and ``keep``
    (its source is part of the version) says which matches count.  A group named ``span`` is the finding, else the match."""

    name: str
    version: str
    pattern: str
    screen: str
    keep: Callable[[re.Match], bool] = lambda m: True
    base: bool = False

    def spans(self, text: str) -> Iterator[tuple[int, int]]:
        for m in re.finditer(self.pattern, text, re.ASCII):
            if self.keep(m):
                yield m.span("span") if "span" in m.re.groupindex else m.span()


RULES: tuple[Rule, ...] = (
    Rule("assign", "1", r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]", lambda m: len(m[1]) >= 8, True),
    Rule("access", "1", r"AKIA[A-Z0-9]+", r"AKIA[A-Z0-9]{12}", lambda m: m.end() - m.start() >= 16, True),
    Rule("hex", "1", r"[0-9a-f]{32,}", r"[0-9a-f]{32}", base=True),
    Rule("private_key", "1", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", r"-----BEGIN [A-Z ]*PRIVATE KEY"),
    # begins only where a run of its characters does: the first eyJ of a run decides for all of them, so time stays linear
    Rule("web_token", "2", r"(?<![A-Za-z0-9_-])(?:(?!eyJ)[A-Za-z0-9_-])*+(?P<span>eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+)", r"[A-Za-z0-9_-]{8}\.eyJ"),
)

_FINDINGS = "blob string, rule string, version string, start int, end int"


def blob_of(text: str = "text"):
    return F.sha2(F.coalesce(F.col(text), F.lit("")), 256)


class Ledger:
    """The two tables under one folder; both may be missing at first."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, (path or new_path(spark, "blob-ledger")).rstrip("/")

    def _read(self, name: str, schema: str) -> DataFrame:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def scanned(self) -> DataFrame:
        return self._read("scanned", "blob string, rule string, version string")

    def findings(self) -> DataFrame:
        return self._read("findings", _FINDINGS)

    def is_empty(self) -> bool:
        return not self.scanned().head(1)

    def scan(self, docs: DataFrame, rules: Sequence[Rule] = RULES) -> None:
        """Scan what is new of ``docs`` and append to the ledger.

        Two passes over the rows, both without moving texts between machines as a rule: the first makes the set of
        blobs by hashing and combining before the shuffle; the second moves only the texts that some rule's screen
        lets through.  Findings are appended before the marks, so a job that dies between the two is repeated and
        never leaves a blob that is marked but not scanned; readers take findings as a set.
        """
        spark = self.spark
        rule_of = spark.createDataFrame([(r.name, r.version) for r in rules], "rule string, version string")
        blobs = docs.select(blob_of().alias("blob")).distinct()
        seen = None if self.is_empty() else self.scanned().join(F.broadcast(rule_of), ["rule", "version"]).groupBy("blob").agg(F.collect_set("rule").alias("done"))
        # the screen: texts that some rule may match; a blob's copies are one row after the shuffle
        screen = F.lit(False)
        for r in rules:
            screen = screen | F.col("text").rlike(r.screen)
        texts = docs.where(F.coalesce(screen, F.lit(False))).select(blob_of().alias("blob"), "text").dropDuplicates(["blob"])
        texts = texts.withColumn("done", F.array().cast("array<string>")) if seen is None else texts.join(seen, "blob", "left").withColumn("done", F.coalesce("done", F.array().cast("array<string>")))
        texts = texts.where(F.size("done") < len(rules))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out: list[tuple[str, str, str, int, int]] = []
                for blob, text, done in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    out += [(blob, r.name, r.version, s, e) for r in rules if r.name not in done for s, e in r.spans(text)]
                if out:
                    c = list(zip(*out, strict=True))
                    yield pa.RecordBatch.from_arrays([*[pa.array(x, pa.string()) for x in c[:3]], pa.array(c[3], pa.int32()), pa.array(c[4], pa.int32())], names=["blob", "rule", "version", "start", "end"])

        texts.mapInArrow(run, _FINDINGS).write.mode("append").parquet(f"{self.path}/findings")
        marks = blobs.select("blob", F.explode(F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(r.version).alias("version")) for r in rules])).alias("r")).select("blob", "r.*")
        if seen is not None:
            marks = marks.join(self.scanned(), ["blob", "rule", "version"], "left_anti")
        marks.write.mode("append").parquet(f"{self.path}/scanned")

    def joined(self, docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
        """``blob`` and ``found`` for each row of ``docs``: its columns but ``text``, and the sorted array of
        struct(start, place, rule, end); empty where there is nothing."""
        place = self.spark.createDataFrame([(r.name, r.version, i) for i, r in enumerate(rules)], "rule string, version string, place int")
        found = self.findings().distinct().join(F.broadcast(place), ["rule", "version"]).groupBy("blob").agg(F.array_sort(F.collect_list(F.struct("start", "place", "rule", "end"))).alias("found"))
        rows = docs.withColumn("blob", blob_of()).drop("text")
        empty = F.array().cast("array<struct<start:int,place:int,rule:string,end:int>>")
        return rows.join(found, "blob", "left").withColumn("found", F.coalesce("found", empty))


def scan(docs: DataFrame, rules: Sequence[Rule] = RULES, ledger: Ledger | None = None) -> DataFrame:
    """Bring the ledger (a new one, if none is given) up to date with ``docs`` and return each row's findings.

    * very long texts are scanned whole, in time in proportion to their length.
    * null text: the blob of the empty text, no findings; an empty table adds nothing and gives no rows.
    * copies, also of texts that an earlier run has seen, are scanned once and all get the findings.
    * columns ``blob`` and ``found`` of the input are replaced; others pass through.
    """
    ledger = ledger or Ledger(docs.sparkSession)
    docs = docs.drop("blob", "found")
    ledger.scan(docs, rules)
    return ledger.joined(docs, rules)


def printed(found: str, only: str = "true") -> str:
    return f"array_join(transform(filter({found}, f -> {only}), f -> concat(f.rule, ':', f.start, ':', f.end)), ',')"
