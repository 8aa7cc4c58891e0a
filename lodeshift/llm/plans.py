"""The queries of the llm problems."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeshift.llm.canonical import map_values
from lodeshift.llm.mixing import balanced_mix, shares
from lodeshift.llm.names import resolve_names, variant_pairs, with_variants
from lodeshift.llm.pii import find_pii, redact_pii
from lodeshift.llm.scans import find_noise, reflow, wrong_glyphs
from lodeshift.llm.sentences import sentences
from lodeshift.llm.tokens import TOKENIZERS, count_tokens, encode_corpus
from lodeshift.session import fixed_rows, latest, shuffle_width, table

TOKENIZER_DIR = os.environ.get("LODESHIFT_TOKENIZERS", TOKENIZERS)


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores where a table has fewer splits than cores; else as it is, no shuffle."""
    spark = df.sparkSession
    return df if df.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism else df.repartition(shuffle_width(spark))


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line once. Distributed by number of partitions, so that its one exchange also feeds all cores."""
    lines = table(spark, sf_dir, "line_blocks").select("block_id", "text", "loaded_at").repartition(shuffle_width(spark), "block_id")
    return latest(lines, "block_id", "text")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    skills = table(spark, sf_dir, "ontology_skills").select("canonical", F.explode(F.concat(F.array("canonical"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("name"))
    titles = table(spark, sf_dir, "title_families").select("family", F.explode("keywords").alias("name"))
    names = {
        "skill_matches": [(r["name"], r["canonical"]) for r in fixed_rows(skills)],
        "title_matches": [(r["name"], r["family"]) for r in fixed_rows(titles)],
    }
    parts = [map_values(spread(table(spark, sf_dir, t).select("match_id", "raw")), "match_id", "raw", n).select(F.lit(t).alias("origin"), "match_id", "entry") for t, n in names.items()]
    return parts[0].unionByName(parts[1])


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_corpus(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), "doc_id", "text", TOKENIZER_DIR)


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), "doc_id", "text")


def _resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    employers = table(spark, sf_dir, "experience").select(F.lit("employer").alias("field"), F.col("employer").alias("name"))
    schools = table(spark, sf_dir, "education").select(F.lit("institution").alias("field"), F.col("institution").alias("name"))
    aliases = [(r["alias"], r["canonical"]) for r in fixed_rows(table(spark, sf_dir, "employer_aliases").where("alias is not null and canonical is not null"))]
    suffixes = [r["suffix"] for r in fixed_rows(table(spark, sf_dir, "legal_suffixes").where("suffix is not null"))]
    return resolve_names(employers.unionByName(schools), aliases, suffixes)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variant_pairs(_resolved(spark, sf_dir))


def p2_organisations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(field, name, organisation, variants): every spelling with its class and how many others mean the same, no pairs."""
    return with_variants(_resolved(spark, sf_dir))


def _scan_noise(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    experience = table(spark, sf_dir, "experience").select("employer", "title", "location", "start_date", "end_date")
    bullets = table(spark, sf_dir, "experience").select(F.explode("bullets").alias("bullet"))
    resumes = table(spark, sf_dir, "resumes").select("full_name", "summary", "skills", F.regexp_replace("email", r"[@._+0-9-]+", " ").alias("mail"))
    education = table(spark, sf_dir, "education").select("institution", "field")
    texts = [df.select(F.explode(F.array(*df.columns)).alias("text")) for df in (experience, bullets, resumes, education)]
    clean = texts[0].unionByName(texts[1]).unionByName(texts[2]).unionByName(texts[3]).where("text is not null")
    return find_noise(table(spark, sf_dir, "line_blocks"), clean)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    noise = _scan_noise(spark, sf_dir)
    glyphs = wrong_glyphs(table(spark, sf_dir, "glyphs"), noise["marked"], noise["wrong"])
    return (
        noise["kinds"].select(F.lit("line_blocks").alias("origin"), F.col("block_id").alias("row_id"), "kind")
        .unionByName(glyphs.select(F.lit("glyphs").alias("origin"), F.col("glyph_id").alias("row_id"), F.lit("misread").alias("kind")))
    )


def p4_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reflow(_scan_noise(spark, sf_dir))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(_blocks(spark, sf_dir), "block_id", "text").select("block_id", "pii_type", "start_pos")


def p3_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redact_pii(_blocks(spark, sf_dir), "block_id", "text")


def _mix(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    documents = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    docs = documents.select("doc_id", "source", count_tokens("text", TOKENIZER_DIR).alias("tokens"))
    targets = table(spark, sf_dir, "mix_targets")
    return balanced_mix(docs, targets), targets


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mix(spark, sf_dir)[0]


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shares(*_mix(spark, sf_dir))
