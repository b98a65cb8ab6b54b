"""Empty tables, clashing column names, repeated rows and ties, for the operators and the pipeline's stages."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from vellum.llm import bpe, chat, exact, fingerprint, langid, lines, merkle, neardup, packing, simhash

RANKS, WORDS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.path("word_bpe_49k.json")
OPERATORS = {
    "exact": exact.deduplicate, "bpe": lambda d: bpe.encode(d, RANKS, public_tokenizers.PATTERN), "near": neardup.find, "packing": lambda d: packing.pack(d, WORDS), "fingerprint": fingerprint.fingerprints,
    "simhash": simhash.find, "merkle": merkle.manifest, "lines": lines.lines_of, "language": langid.languages_of,
}
CLASHING = ["fingerprint", "keep_id", "group_size", "n_tokens", "lang_pred", "score", "sequence_id", "component_id", "n_shingles", "leaf", "__gone", "__text", "first_id", "removed", "v", "key", "rep", "run", "N"]


def table(spark):
    rows = [(1, "one two three four five six\nanother line that is long enough", "en", "a", 3), (2, "one two three four five six\nanother line that is long enough", "en", "b", 3), (3, None, None, None, None), (4, "", "de", "c", 0), (5, "das ist ein ganz anderer Text hier", "de", "a", 9)]
    rows += [rows[0], (5, "das ist ein ganz anderer Text hier!", "de", "a", 9)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")


def plain(df):
    return sorted(map(str, df.select(sorted(df.columns)).collect()))


@pytest.mark.parametrize("name", list(OPERATORS))
def test_clashing_names_change_nothing(spark, name):
    # One partition, so that rows are read in one order; repeated rows are alike anyway.
    docs = table(spark).coalesce(1)
    if name == "packing":
        docs = docs.dropDuplicates(["doc_id"])
    clashing = docs.select("*", *(F.lit("mine").alias(c) for c in CLASHING))
    assert plain(OPERATORS[name](clashing)) == plain(OPERATORS[name](docs))


@pytest.mark.parametrize("name", list(OPERATORS))
def test_empty_tables_give_no_rows(spark, name):
    assert OPERATORS[name](table(spark).filter("doc_id > 100")).count() == 0


def test_conversations_with_equal_turns_long_texts_and_clashing_names(spark):
    long = "x<|im_end|>" * 100_000
    rows = [(1, 0, "user", "a", "mine", "mine"), (1, 0, "user", "a", "mine", "mine"), (1, 0, "assistant", "b", "mine", "mine"), (2, 0, "assistant", long, "mine", "mine"), (3, None, "user", None, "mine", "mine")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, n_turns string, formatted string")
    found = {r["conv_id"]: r for r in chat.chats_of(df).collect()}
    assert (found[1]["n_turns"], found[1]["loss_chars"], found[2]["loss_chars"], found[3]["n_turns"]) == (3, 1, len(long), 1) and -1 in found
    assert set(r["conv_id"] for r in chat.chats_of(df.filter("conv_id > 100")).collect()) == {-1}


@pytest.mark.parametrize("stage", ["lines", "near", "packing"])
def test_stages_take_odd_rows(spark, stage):
    docs = table(spark)
    run = dict(corpus_pipeline.STAGES)[stage]
    more = docs.select("*", *(F.lit("mine").alias(c) for c in CLASHING))
    out = run(spark, more if stage != "packing" else more.dropDuplicates(["doc_id"]), "unused")
    if stage != "packing":
        assert set(more.columns) <= set(out.columns)
        kept = {r["doc_id"] for r in out.collect()}
        assert kept == ({1, 2, 3, 4, 5} if stage == "lines" else {1, 3, 4, 5})
    assert run(spark, more.filter("doc_id > 100"), "unused").count() == 0
