"""The dealt queries opN over the given tables, with oracle SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from candlewick.llm import decontaminate, linear, lines, merkle, packing, quality, secrets, simhash, sqltext, substrings, toxicity, urls, variants, warc
from candlewick.llm.shared import learning_fold, table

#: Where the dealt tokenizer files are; any other place may be given.
VOCABULARY = "byte_bpe_50k.json"


def vocabulary(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces of at most 1024 tokens, and the sequence and offset of each."""
    return packing.packed(table(spark, sf_dir, "documents"), vocabulary())


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document: 3-word shingles, links at 2 or fewer differing bits."""
    out = simhash.groups(table(spark, sf_dir, "documents"))
    return out.select("doc_id", simhash.hexadecimal().alias("fingerprint"), "component_id")


def digest(names: str) -> Column:
    """SHA-256 of a list of texts, comma-joined."""
    return F.sha2(F.array_join(names, ",").cast("binary"), 256)


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document inside any 10-word window of a benchmark item, and the items met."""
    out = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda total, span: total + span["n_words"])
    return out.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), digest("items").alias("items_sha256"),
                      (hit > 0).alias("contaminated"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a WARC record, written and read back."""
    pages = table(spark, sf_dir, "pages")
    read = warc.round_trip(pages)
    number = lambda c: F.nullif(F.substring(c, len("urn:page:") + 1, 1 << 20), F.lit("")).cast(pages.schema["page_id"].dataType)
    own = F.col("record_type") == "response"
    return read.select(number("record_id").alias("page_id"),
                       F.when(own, F.octet_length("payload")).otherwise(F.col("full_bytes")).cast("long").alias("payload_bytes"),
                       F.when(own, F.sha2("payload", 256)).otherwise(F.substring_index("digest", ":", -1)).alias("payload_digest"),
                       "record_type", number("refers_to").alias("refers_to"))


def probabilities(scored: DataFrame, folds: int, held: int) -> DataFrame:
    return scored.select("doc_id", (~learning_fold("doc_id", folds, held)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document by a classifier of hashed word runs; rows with remainder 1 of 3 are not learned from."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    weights = linear.fitted(docs, table(spark, sf_dir, "labels"), "quality", folds=3, held=1)
    return probabilities(linear.scored(docs, weights), 3, 1)


def op5_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document: counts and places of the base kinds, and places of all kinds."""
    found = secrets.spans(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, secrets.BASE), F.sha2(secrets.listed(kinds=secrets.BASE).cast("binary"), 256).alias("base_sha256"),
                        secrets.listed().alias("spans"))


#: The stated rules. Fixed values.
URL_RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict for every page's url: the stated rules, else combinations mined from the urls that they decide."""
    return urls.judged(table(spark, sf_dir, "pages"), URL_RULES)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule statistics of every document, the base decision, and the posterior's."""
    out = quality.judged(table(spark, sf_dir, "documents"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
                      (~failed & (F.col("good") >= 0.5)).alias("kept"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the words of 20-word windows that start earlier too."""
    out = substrings.deduplicated(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; rows with remainder 0 of 5 are not learned from."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    weights = toxicity.fitted(docs, table(spark, sf_dir, "labels"))
    return probabilities(linear.scored(docs, weights, toxicity.SETTINGS), 5, 0)


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of seven letters or more that occur twice or more, with the frequent word that each is a spelling of."""
    counts = variants.word_counts(table(spark, sf_dir, "documents"))
    return variants.spelling_forms(counts.filter("n >= 2")).select("word", "form", "root", "n", "n_near", "form_n")


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of documents, and the check of a copy in which n_chars of every seventh id or so is one more."""
    docs = table(spark, sf_dir, "documents")
    entry = lambda n_chars: merkle.leaf(F.col("doc_id"), F.col("source"), F.col("lang"), n_chars, F.col("text"))
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    leaves = docs.select("doc_id", "lang", entry(F.col("n_chars")).alias("leaf"), F.when(tampered, entry(F.col("n_chars") + 1)).alias("changed"))
    proven = merkle.manifest(leaves)
    again = merkle.folded(F.coalesce("changed", "leaf"), F.col("path"))
    out = proven.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("path")).alias("proof_sha256"), again.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that three or more documents hold, but for the largest id that holds them."""
    out = lines.without_repeated_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


QUERIES = {f.__name__: f for f in (
    op1_best_fit_packing, op2_warc, op3_quality_classifier, op4_simhash_near_dedup, op5_secret_scans, op6_url_filters, op7_quality_rules,
    op8_substring_dedup, op9_benchmark_decontamination, op10_toxicity, op11_spelling_variants, op12_merkle_manifest, op13_line_dedup)}

ORACLES: dict[str, str] = dict(sqltext.ORACLES)
