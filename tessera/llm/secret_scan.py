"""Secret scans with an incremental, content-addressed ledger.

A version of a file (here: a document) is known by the SHA-256 of its text.
The ledger holds one row for each blob and rule version that was ever scanned,
with the spans found, also when there are none.  A scan reduces the versions
to distinct blobs, drops the pairs of blob and rule version that the ledger
has, scans the rest and appends it; findings are then joined back to every
path (document) that holds the blob.  Everything is built from Spark SQL
functions.

Defined results: null text reads as empty, an empty text has no spans, and a
row with a null or repeated id gets its own result row.  Copies are scanned
once.  An empty table gives an empty ledger and an empty result.  Columns
besides the named ones are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import whole_text
from tessera.llm.spans import SPANS, Rule, count_kind, rule_spans, spans_text
from tessera.session import scratch_path

#: Fixed by the contract: kinds in this order, their patterns and lengths.
RULES = [
    Rule("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
                   r"""([A-Za-z0-9+/_.=-]+)""", lambda hit, value: F.length(value) >= 6, group=1,
         hint=lambda t: F.contains(t, F.lit("=")) | F.contains(t, F.lit(":"))),
    # runs of the same characters, so a minimum length in the loop drops no later match
    Rule("access", r"AKIA[A-Z0-9]{16,}+", lambda hit, value: F.lit(True),
         hint=lambda t: F.contains(t, F.lit("AKIA"))),
    Rule("hex", r"[0-9a-f]{24,}+", lambda hit, value: F.lit(True)),
]


def blobs(docs: DataFrame, text: str = "text") -> DataFrame:
    """(blob, text) of the distinct texts; copies merge before the shuffle."""
    return (docs.select(F.unhex(F.sha2(whole_text(text), 256)).alias("blob"), whole_text(text).alias("text"))
            .groupBy("blob").agg(F.first("text").alias("text")))


def scan_new(docs: DataFrame, ledger: DataFrame | None = None, rules: list[Rule] = RULES,
             text: str = "text") -> DataFrame:
    """Ledger rows (blob, rule, version, spans) of the pairs not in ``ledger``."""
    found = blobs(docs, text)
    if ledger is not None:
        done = ledger.groupBy("blob").agg(F.collect_set(F.concat_ws("@", "rule", "version")).alias("done"))
        found = found.join(done, "blob", "left")
    else:
        found = found.withColumn("done", F.lit(None).cast("array<string>"))
    known = F.coalesce("done", F.array().cast("array<string>"))
    found = found.withColumn("known", known)
    pair = [F.array_contains("known", f"{r.kind}@{r.version}") for r in rules]
    todo = F.lit(False)
    for p in pair:
        todo = todo | ~p
    rows = [F.when(~p, F.struct(F.lit(r.kind).alias("rule"), F.lit(r.version).alias("version"),
                                rule_spans(F.col("text"), r, i).alias("spans")))
            for i, (r, p) in enumerate(zip(rules, pair))]
    return (found.filter(todo).select("blob", F.explode(F.array(*rows)).alias("row"))
            .filter(F.col("row").isNotNull()).select("blob", "row.*"))


def update_ledger(docs: DataFrame, path: str, rules: list[Rule] = RULES, text: str = "text") -> DataFrame:
    """Append what ``docs`` adds to the ledger at ``path`` and return it all.
    A ledger that does not exist yet is empty."""
    spark = docs.sparkSession
    schema = f"blob binary, rule string, version string, spans {SPANS}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)
    old = spark.read.schema(schema).parquet(path) if there else None
    scan_new(docs, old, rules, text).write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)


def findings(docs: DataFrame, ledger: DataFrame, rules: list[Rule] = RULES, doc_id: str = "doc_id",
             text: str = "text") -> DataFrame:
    """(doc_id, spans) of every document, from the ledger's current rules."""
    current = [f"{r.kind}@{r.version}" for r in rules]
    order = F.map_from_arrays(F.array(*[F.lit(r.kind) for r in rules]),
                              F.array(*[F.lit(i) for i in range(len(rules))]))
    # a pair that two runs both appended counts once
    by_blob = (ledger.filter(F.concat_ws("@", "rule", "version").isin(current) & (F.size("spans") > 0))
               .withColumn("spans", F.transform("spans", lambda s: F.struct(
                   s["start"].alias("start"), F.element_at(order, F.col("rule")).alias("kind"),
                   s["end"].alias("end"))))
               .groupBy("blob").agg(F.array_sort(F.flatten(F.collect_set("spans"))).alias("spans")))
    paths = docs.select(F.col(doc_id).alias("doc_id"),
                        F.unhex(F.sha2(whole_text(text), 256)).alias("blob"))
    return paths.join(by_blob, "blob", "left").select(
        "doc_id", F.coalesce("spans", F.array().cast(SPANS)).alias("spans"))


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rules: list[Rule] = RULES,
         ledger_path: str | None = None) -> DataFrame:
    """Per document the number of spans of each rule, the digest of the span
    list and the list.  Without ``ledger_path`` a new ledger is begun below
    spark.checkpoint.dir."""
    path = ledger_path or scratch_path(docs.sparkSession, "secret-ledger")
    ledger = update_ledger(docs, path, rules, text)
    found = findings(docs, ledger, rules, doc_id, text)
    line = spans_text(F.col("spans"), [r.kind for r in rules])
    return found.select("doc_id", *(count_kind(F.col("spans"), i).alias(f"n_{r.kind}")
                                    for i, r in enumerate(rules)),
                        F.sha2(line, 256).alias("base_sha256"), line.alias("spans"))
