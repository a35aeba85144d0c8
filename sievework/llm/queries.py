"""The registered queries of the corpus operators, each over its whole table with production parameters."""

from __future__ import annotations

import hashlib
import os

from pyspark.sql import functions as F

from sievework.llm import bpe, codes, decontaminate, hmm, html, jaccard, lines, merkle, passages, pii, quality, simhash, warc
from sievework.llm.oracles import ORACLES as ORACLES
from sievework.llm.shared import Scratch, table

#: Folder of the public vocabularies; a parameter of the deployment.
TOKENIZERS = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")


def op1_hmm(spark, sf_dir):
    return hmm.score(table(spark, sf_dir, "documents"), Scratch(spark, "hmm"))


def op2_passages(spark, sf_dir):
    return passages.find(table(spark, sf_dir, "documents"), Scratch(spark, "passages"))


def op3_pii(spark, sf_dir):
    return pii.find(table(spark, sf_dir, "documents"))


def op4_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    found = quality.assess(docs, Scratch(spark, "quality"))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return found.select("doc_id", *counts, "base_failed", "kept", "lang", "log_perplexity")


def op5_warc(spark, sf_dir):
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op6_lines(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lines.dedup(docs, Scratch(spark, "lines")).select("doc_id", "n_lines", "n_removed", "text")


def op7_decontaminate(spark, sf_dir):
    return decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), Scratch(spark, "decontaminate"))


def op8_html(spark, sf_dir):
    return html.extract(table(spark, sf_dir, "pages"))


def op9_jaccard(spark, sf_dir):
    """class_id: the smallest doc_id that links lead to; n_links: rows linked to; n_text_links: different texts linked to."""
    found = jaccard.join(table(spark, sf_dir, "documents").select("doc_id", "text"), Scratch(spark, "jaccard"))
    found = found.select("doc_id", "group_id", "n_links", "n_text_links")
    first = found.filter("n_links > 0").groupBy("group_id").agg(F.min("doc_id").alias("first"))
    return found.join(first, "group_id", "left").select("doc_id", F.coalesce("first", "doc_id").alias("class_id"), "n_links", "n_text_links")


def op10_bpe(spark, sf_dir):
    return bpe.token_digests(table(spark, sf_dir, "documents"), f"{TOKENIZERS}/byte_bpe_50k.json")


def op11_codes(spark, sf_dir):
    scratch = Scratch(spark, "codes")
    found = codes.compress(table(spark, sf_dir, "embeddings"), scratch)
    digest = hashlib.sha256(",".join(map(str, found.books.ravel().tolist())).encode()).hexdigest()
    code = F.array_join(F.transform("codes", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")
    return codes.label_errors(found.rows, scratch).select("vec_id", code.alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def op12_simhash(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), Scratch(spark, "simhash"))


def op13_merkle(spark, sf_dir):
    return merkle.verified(merkle.manifest(table(spark, sf_dir, "documents"), Scratch(spark, "merkle")))


QUERIES = {"op1_hmm": op1_hmm, "op2_passages": op2_passages, "op3_pii": op3_pii, "op4_quality": op4_quality, "op5_warc": op5_warc, "op6_lines": op6_lines, "op7_decontaminate": op7_decontaminate, "op8_html": op8_html, "op9_jaccard": op9_jaccard, "op10_bpe": op10_bpe, "op11_codes": op11_codes, "op12_simhash": op12_simhash, "op13_merkle": op13_merkle}
