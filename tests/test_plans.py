"""What the physical plans must and must not hold."""

import pytest

from textgauge import catalog

NO_PYTHON = [
    n
    for n in catalog.QUERIES
    if n
    not in {
        # user models and vocabulary look-ups run in Python workers
        "encode_ids", "decode_roundtrip", "bpe_pieces", "chunk_vocab", "score_chunks", "evaluate_model",
        "decode_by_join", "count_lm_vocab",
        # pairs of bytes are counted by position in Arrow batches
        "scaling_curve", "count_lm_perplexity", "benchmark_perplexity", "perplexity_by_quality",
        "generate_greedy", "generate_sampled",
    }
]
NARROW = [
    "subsample_docs", "subsample_orders", "split_train_test", "split_exact", "truncate_stop",
    "logits_cross_entropy",
]


@pytest.mark.parametrize("name", NO_PYTHON)
def test_stays_in_the_jvm(spark, small, plan, name):
    text = plan(catalog.QUERIES[name](spark, small))
    assert "Python" not in text and "MapInPandas" not in text and "MapInArrow" not in text
    assert "CartesianProduct" not in text


@pytest.mark.parametrize("name", NARROW)
def test_needs_no_shuffle(spark, small, plan, name):
    assert "Exchange" not in plan(catalog.QUERIES[name](spark, small))


@pytest.mark.parametrize("name", ["pretokens", "chunk_docs", "window_counts", "byte_tokens"])
def test_texts_are_tokenized_once(spark, small, plan, name):
    text = plan(catalog.QUERIES[name](spark, small))
    assert text.count("regexp_extract_all") + text.count("StringDecode") == 1
    assert "Exchange" not in text.replace("REPARTITION_BY_NUM", "").replace("Exchange hashpartitioning(doc_id", "")


@pytest.mark.parametrize("name", ["chunk_stats", "token_profile", "shift_pairs"])
def test_counts_combine_before_the_shuffle(spark, small, plan, name):
    text = plan(catalog.QUERIES[name](spark, small))
    assert "partial_" in text
    assert text.count("regexp_extract_all") + text.count("StringDecode") == 1


def test_vocabulary_needs_one_pass(spark, small, plan):
    """The counts of counts and the ranking share the shuffled token counts."""
    df = catalog.QUERIES["vocab_topk"](spark, small)
    df.collect()
    text = plan(df)
    assert "partial_count" in text and "ReusedExchange" in text


def test_ranks_are_limited_before_the_shuffle(spark, small, plan):
    text = plan(catalog.QUERIES["retained_checkpoints"](spark, small))
    assert "WindowGroupLimit" in text and "Partial" in text


def test_scans_read_only_what_they_need(spark, small, plan):
    assert "ReadSchema: struct<doc_id:bigint,lang:string>" in plan(catalog.QUERIES["subsample_docs"](spark, small))
    assert "ReadSchema: struct<user_id:bigint,event_type:string>" in plan(catalog.QUERIES["pass_at_k"](spark, small))


def test_encoding_is_not_repeated(spark, small, plan):
    text = plan(catalog.QUERIES["decode_roundtrip"](spark, small))
    assert text.count("ArrowEvalPython") == 2 and text.count("regexp_extract_all") == 1


def test_models_get_windows_not_documents(spark, small, plan):
    """The window is cut before the UDF; otherwise each of its rows would carry its document."""
    text = plan(catalog.QUERIES["score_chunks"](spark, small))
    assert "loss(input_ids#" in text and "loss(slice" not in text
    assert text.index("ArrowEvalPython") < text.index("Generate explode(array(slice")


def test_evaluated_once_across_a_shuffle(spark, plan):
    """A shuffle behind chunking moves windows only."""
    from textgauge.operators import chunking, tokenizing

    docs = spark.createDataFrame([(1, "abc" * 50)], "doc_id long, text string")
    chunks = chunking.chunk(tokenizing.byte_tokenize(docs), 8, 2).repartition(3, "chunk_idx")
    text = plan(chunks.selectExpr("chunk_idx", "size(input_ids) AS n", "hash(input_ids) AS h"))
    assert text.index("Exchange") < text.index("slice(")


@pytest.mark.parametrize("name", ["leaked_rows", "split_overlap"])
def test_keys_move_without_texts(spark, small, plan, name):
    shuffled = [line for line in plan(catalog.QUERIES[name](spark, small)).splitlines() if "Exchange" in line]
    assert shuffled and not any("text#" in line for line in shuffled)


def test_ranking_is_cut_before_the_shuffle(spark, small, plan):
    text = plan(catalog.QUERIES["topk_topp"](spark, small))
    assert "WindowGroupLimit" in text and "Partial" in text.split("WindowGroupLimit")[-1]
