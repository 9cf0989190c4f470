"""Secret scans over every historical version of a text, by an incremental ledger of blobs.

Method. A version's text is addressed by the SHA-256 of its bytes, so all versions and copies with one
text are one blob. The ledger holds, for each blob and version of the rules, what was found. A run takes
the distinct blobs of its versions, drops those the ledger has for this version of the rules, scans the
rest, appends them to the ledger, and joins findings back to all versions by blob. With new rules, or new
texts, only unseen pairs are scanned.

All of it is DataFrame work. Positions come from the texts between matches and the matches themselves,
whose lengths add up. A blob shared by many rows is made distinct before the shuffle (map-side), and only blobs with findings are joined back.

Defined results: null text counts as empty and has no findings; a null key is kept; repeated rows are all
returned; a text of any length is scanned whole; further columns are ignored, or carried by ``masked``.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

SPAN = "struct<start:int,rank:int,end:int,kind:string>"


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern`` whose ``group`` has at least ``least`` characters; a finding spans the whole match."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


#: The rules every scan has, and formats of well-known issuers.
BASE_RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]{32,}", 0, 32),
)
MORE_RULES = (
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
    Rule("code_host", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("maps", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("payment", r"[sr]k_live_[0-9A-Za-z]{24,}"),
    # to the END line; where there is none, to the end of the block of base64
    Rule("private_key", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----(?:[A-Za-z0-9+/=:, \t\r\n]*(?:-[A-Za-z0-9+/=:, \t\r\n]+){0,16}"
                        r"-----END [A-Z ]{0,20}PRIVATE KEY-----|[ \t\r\n]*[A-Za-z0-9+/=\r\n]{16,})?"),
    Rule("url_login", r"[A-Za-z][A-Za-z0-9+.-]{1,20}://[A-Za-z0-9._%+-]+:[A-Za-z0-9._%+!$*-]{3,}@"),
)
RULES = BASE_RULES + MORE_RULES


def rules_version(rules: Sequence[Rule]) -> str:
    """A name that changes with the rules."""
    import hashlib

    return hashlib.sha256(repr(tuple(rules)).encode()).hexdigest()[:16]


def _rule_spans(text: Column, rule: Rule, rank: int) -> Column:
    pattern, none = F.lit(rule.pattern), F.array().cast(f"array<{SPAN}>")
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    value = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else found
    steps = F.zip_with(
        F.split(text, rule.pattern, -1), F.arrays_zip(found.alias("match"), value.alias("value")),
        lambda part, m: F.struct(F.char_length(part).alias("between"), F.char_length(m["match"]).alias("size"),
                                 F.char_length(m["value"]).alias("kept")))

    def add(state: Column, step: Column) -> Column:
        start = state["at"] + step["between"]
        end = start + F.coalesce(step["size"], F.lit(0))
        span = F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(rule.kind).alias("kind"))
        more = F.when(step["kept"] >= rule.least, F.array(span)).otherwise(none)
        return F.struct(end.alias("at"), F.concat(state["spans"], more).alias("spans"))

    empty = F.struct(F.lit(0).alias("at"), none.alias("spans"))
    return F.when(text.rlike(rule.pattern), F.aggregate(steps, empty, add)["spans"]).otherwise(none)


def text_spans(text: Column, rules: Sequence[Rule] = RULES) -> Column:
    """All findings of a text by start, then by the order of the rules."""
    return F.sort_array(F.concat(*[_rule_spans(text, rule, rank) for rank, rule in enumerate(rules)]))


def blob_of(text: Column) -> Column:
    """Address of a text: SHA-256 of its bytes."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


class BlobLedger:
    """Findings by (blob, rules) in a folder that all machines share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self.schema = f"blob binary, rules string, spans array<{SPAN}>"

    def entries(self) -> DataFrame:
        """What is there; nothing at first."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        there = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)
        return self.spark.read.schema(self.schema).parquet(self.folder) if there else (
            self.spark.createDataFrame([], self.schema))

    def scan(self, versions: DataFrame, text: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
        """Scan what is unseen, append it, and return (blob, spans) of all blobs in the ledger with findings."""
        version = rules_version(rules)
        body = F.coalesce(F.col(text), F.lit(""))
        blobs = versions.select(blob_of(F.col(text)).alias("blob"), body.alias("text")).dropDuplicates(["blob"])
        known = self.entries().where(F.col("rules") == version).select("blob")
        (blobs.join(known, "blob", "left_anti")
         .select("blob", F.lit(version).alias("rules"), text_spans(F.col("text"), rules).alias("spans"))
         .write.mode("append").parquet(self.folder))
        return self.entries().where((F.col("rules") == version) & (F.size("spans") > 0)).select("blob", "spans")


def scan_documents(docs: DataFrame, ledger: BlobLedger, rules: Sequence[Rule] = RULES, key: str = "doc_id",
                   text: str = "text") -> DataFrame:
    """(key, spans) of every row."""
    found = ledger.scan(docs, text, rules)
    return (
        docs.select(F.col(key).alias(key), blob_of(F.col(text)).alias("_blob"))
        .join(found.withColumnRenamed("blob", "_blob"), "_blob", "left")
        .select(key, F.coalesce("spans", F.array().cast(f"array<{SPAN}>")).alias("spans")))


def masked(docs: DataFrame, ledger: BlobLedger, rules: Sequence[Rule] = RULES, text: str = "text") -> DataFrame:
    """All rows and columns, with each finding in the text (overlapping ones together) replaced by ``[secret]``."""
    found = ledger.scan(docs, text, rules)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), blob_of(F.col(text)).alias("blob"))
    body = F.col("row")[text]

    def add(state: Column, span: Column) -> Column:
        gap = F.substring(body, state["at"] + 1, F.greatest(span["start"] - state["at"], F.lit(0)))
        fresh = span["start"] >= state["at"]
        return F.struct(
            F.greatest(state["at"], span["end"]).alias("at"),
            F.when(fresh, F.concat(state["out"], gap, F.lit("[secret]"))).otherwise(state["out"]).alias("out"))

    done = F.aggregate("spans", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), add,
                       lambda s: F.concat(s["out"], F.substring(body, s["at"] + 1, F.char_length(body))))
    return rows.join(found, "blob", "left").select(
        F.col("row").withField(text, F.when(F.col("spans").isNotNull(), done).otherwise(body)).alias("row")).select("row.*")


def as_text(spans: Column) -> Column:
    """kind:start:end of all spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digests(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts of the base kinds, the digest of base findings, and all findings as text."""
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["rank"] < len(BASE_RULES))
    return found.select(
        key, *[of(r.kind).alias(f"n_{r.kind}") for r in BASE_RULES],
        F.sha2(as_text(base), 256).alias("base_sha256"), as_text(F.col("spans")).alias("spans"))
