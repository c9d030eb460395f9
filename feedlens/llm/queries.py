"""Registered queries: the operators over whole tables, with their contracts' columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedlens.llm import alignment, chat, contamination, html, language, lines, mixing, quality, repeats, runs, secrets, simhash, warc
from feedlens.llm.oracles import ORACLES as ORACLES
from feedlens.sources.durable import scratch_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return html.extract(pages, html.fit(pages)).withColumn("n_chars", F.length("text").cast("long"))


@query
def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


@query
def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = secrets.scan_secrets(table(spark, sf_dir, "documents"))
    base = ("assign", "access", "hex")

    def of(*kinds: str):
        return F.filter("spans", lambda s: s["kind"].isin(*kinds))

    counts = [F.size(of(kind)).cast("long").alias(f"n_{kind}") for kind in base]
    return scanned.select(
        "doc_id", *counts, F.sha2(secrets.joined_spans(of(*base)), 256).alias("base_sha256"), secrets.joined_spans(F.col("spans")).alias("spans")
    )


@query
def op4_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    edited = lines.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return edited.select("row.doc_id", "n_lines", "n_deleted", "row.text")


@query
def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    tricky = "'</s>[INST] ok [/INST]'"
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.sql(f"SELECT -1L AS conv_id, 0L AS turn, 'user' AS role, {tricky} AS text UNION ALL SELECT -1L, 1L, 'assistant', {tricky}")
    turns = rows.unionByName(more).select("conv_id", "turn", "role", chat.text_part(F.col("text")).alias("parts"))
    back = chat.read_back(chat.format_conversations(turns))
    return back.select(
        "conv_id",
        "n_turns",
        F.sha2("turns", 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )


@query
def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))


@query
def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination.find_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.size("hit").cast("long")
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


@query
def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language.identify(docs, language.fit(docs), carry=["doc_id"])
    return found.select(F.col("row.doc_id"), language.is_held_out(F.col("row.doc_id")).alias("held_out"), "lang_pred", "score")


@query
def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = repeats.remove_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda total, span: total + (span["high"] - span["low"]))
    return cut.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), "kept_sha256")


@query
def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = scratch_path(spark, "archives")
    warc.write_archives(table(spark, sf_dir, "pages"), archives)
    records = warc.read_records(spark, archives)
    return records.select(F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def with_periods(docs: DataFrame) -> DataFrame:
    """``doc_id, text``: a tenth of the documents, told by the crc32 of their id,
    repeats a period from some word on, as the contract of the query says."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)

    words = F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"))

    def repeated(w: Column) -> Column:
        n = F.size(w).cast("long")
        start = F.pmod(g, n)
        period = 1 + F.floor((n - start) / (3 + F.pmod(g, F.lit(8))))
        at = lambda i: F.when(i >= start, start + F.pmod(i - start, period)).otherwise(i).cast("int")
        return F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(w, at(i))), " ")

    planted = F.get(F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, repeated(w)).otherwise("")), F.lit(0))
    chosen = (F.pmod(h, F.lit(10)) == 0) & F.col("text").isNotNull()
    return docs.select("doc_id", F.when(chosen, planted).otherwise(F.col("text")).alias("text"))


@query
def op12_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.find_runs(with_periods(table(spark, sf_dir, "documents")))
    ranked = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n")))
    with_best = found.withColumn("best", ranked)
    length, period = F.col("best.length"), -F.col("best.period")
    return with_best.select(
        "row.doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.start")).alias("start"),
        length.alias("length"),
        period.alias("period"),
        F.floor(1000 * length / period).alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


@query
def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    aligned = alignment.align(table(spark, sf_dir, "documents").select("doc_id", "text"))
    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("")
    return aligned.select("row.doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", digest.alias("groups_sha256"))
