"""The training-data queries and their SQL, as the repository's entry point adds them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import fim, oracles, periodic
from lodestone.llm.decontaminate import contaminated
from lodestone.llm.html_extract import extract_html
from lodestone.llm.jaccard_join import jaccard_join
from lodestone.llm.licenses import scan_licenses
from lodestone.llm.line_dedup import WHOLE, dedup_lines
from lodestone.llm.minhash import minhash_near_duplicates
from lodestone.llm.packing import pack
from lodestone.llm.pii import pseudonymise
from lodestone.llm.quality import quality_rules
from lodestone.llm.secrets import scan_secrets
from lodestone.llm.url_filter import filter_urls

#: The tokenizer of the packing query; its folder is that of the installed public tokenizers.
TOKENIZER = "word_bpe_49k.json"

#: The session setting with the key of pseudonyms; Spark hides settings of such names in its pages and logs.
PII_KEY = "spark.lodestone.pii.secret"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pii_key(spark: SparkSession) -> str:
    """The session's key; where it has none, on one machine (as in tests) a known one, and on a cluster an error, since anyone could
    undo pseudonyms made with a key that is public."""
    if key := spark.conf.get(PII_KEY, None):
        return key
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"{PII_KEY} must hold the key of the pseudonyms")
    return "a key for tests alone"


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_feistel_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with pseudonyms for the personal data in its text; the key is the session's."""
    return pseudonymise(_read(spark, sf_dir, "documents").select("doc_id", "text"), pii_key(spark))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four words a shingle, links at a Jaccard similarity of 0.85."""
    return jaccard_join(_read(spark, sf_dir, "documents"), k=4, percent=85)


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict on every page's url; labels are those of the page's number."""
    return filter_urls(_read(spark, sf_dir, "pages"), _read(spark, sf_dir, "labels"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and distribution divergence, with references fitted on the good ones of `labels`."""
    out = quality_rules(_read(spark, sf_dir, "documents").select("doc_id", "lang", "text"), _read(spark, sf_dir, "labels"))
    return out.drop("lang", "text")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences of at most 4096 tokens."""
    return pack(_read(spark, sf_dir, "documents"), tokenizer_path(), 4096, 1)


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract_html(_read(spark, sf_dir, "pages"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a document and a benchmark item of which it holds a copy."""
    return contaminated(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and template matches of every document."""
    return scan_licenses(_read(spark, sf_dir, "documents"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document, by fixed patterns and by the randomness battery."""
    return scan_secrets(_read(spark, sf_dir, "documents"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without its repeated lines; the kept text itself and what went."""
    return dedup_lines(_read(spark, sf_dir, "documents").select("doc_id", "text"), **WHOLE)


def op11_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five words a shingle, links at a Jaccard similarity of 0.85, found by their signatures."""
    return minhash_near_duplicates(_read(spark, sf_dir, "documents"), k=5, percent=85).drop("n_copies")


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document rearranged, and restored from that."""
    return fim.digests(fim.arrange(_read(spark, sf_dir, "documents")))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of every document, a tenth of which repeat some of their words by the query's own doing."""
    return periodic.digests(periodic.periodic_runs(periodic.with_planted_runs(_read(spark, sf_dir, "documents"))))


QUERIES = {f.__name__: f for f in (op1_feistel_pii, op2_ngram_jaccard_join, op3_url_filter, op4_quality_rules, op5_best_fit_packing, op6_html_extraction, op7_decontamination, op8_license_scan, op9_secret_scan, op10_line_dedup, op11_minhash_near_dedup, op12_fill_in_middle, op13_periodic_runs)}
QUERIES |= {name: (lambda spark, sf_dir, f=QUERIES[of], columns=columns.split(): f(spark, sf_dir).select(*columns)) for name, (of, columns) in oracles.BASE.items()}
ORACLES: dict[str, str] = dict(oracles.SQL)
