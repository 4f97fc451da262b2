"""Tokenizers, vocabularies and BPE."""

import json
import random

import pytest
import tokenizers
from pyspark.sql import functions as F
from tokenizers import models, pre_tokenizers, trainers

from textgauge.functions import tokens
from textgauge.operators import bpe, tokenizing

TEXTS = [
    "",
    "a",
    "\t\tif x:\n        return  1   \n",
    "we're they'll I'd it's   done   ",
    "a\u00a0\u00a0b",
    "\u00a0!",
    "a\u2003\u2003x",
    "a\u0085\u0085b",
    "\u3000\u3000中",
    "e\u0301 and n\u0303",
    "smile 😀😀 end",
    "nul\u0000byte",
    "a\u2028b\r\n\r\nc",
]


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def by_doc(df, col):
    return [r[col] for r in df.orderBy("doc_id").collect()]


def test_pretokens_agree_with_the_published_splitter(spark):
    split = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
    got = by_doc(tokenizing.pretokenize(frame(spark, TEXTS)), "tok")
    for text, toks in zip(TEXTS, got):
        assert "".join(toks) == text
        spans = [text[a:b] for _, (a, b) in split.pre_tokenize_str(text)]
        assert toks == spans


def test_bytes_and_back(spark):
    coded = tokenizing.byte_tokenize(frame(spark, TEXTS))
    assert by_doc(coded, "input_ids") == [list(t.encode()) for t in TEXTS]
    assert by_doc(tokenizing.byte_detokenize(coded), "text") == TEXTS


def test_missing_text_is_empty(spark):
    df = spark.createDataFrame([(0, None)], "doc_id long, text string")
    row = df.select(tokens.byte_ids(F.col("text")).alias("b"), tokens.pretokens(F.col("text")).alias("t"))
    assert tuple(row.first()) == ([], [])


def vocab_of(spark):
    df = tokenizing.pretokenize(frame(spark, ["b a b c", "a b", "zz zz"]))
    return df, tokenizing.build_vocab(df, 3)


def test_vocab_order_and_specials(spark):
    _, vocab = vocab_of(spark)
    rows = [tuple(r) for r in vocab.orderBy("id").collect()]
    # " b" twice, then the first of the single ones in token order
    assert rows == [
        (0, "<unk>", 0), (1, "<|endoftext|>", 0), (2, " b", 2), (3, " a", 1), (4, " c", 1),
    ]


def test_vocab_report_pads_with_eos(spark):
    _, vocab = vocab_of(spark)
    assert tuple(tokenizing.vocab_report(vocab).first()) == (5, 0, 1, 1)
    own = tokenizing.Special(pad="<unk>")
    assert tokenizing.vocab_report(vocab, own).first()["pad_id"] == 0


@pytest.mark.parametrize("limit", [10, 2])
def test_encode_keeps_empty_documents(spark, limit):
    """Within the limit the vocabulary is sent to the data, above it joined: same result."""
    _, vocab = vocab_of(spark)
    df = tokenizing.pretokenize(frame(spark, ["", "x b a", " b b"]))
    out = tokenizing.encode(df, vocab, limit=limit)
    assert by_doc(out, "input_ids") == [[], [0, 2, 3], [2, 2]]
    assert by_doc(out, "attention_mask") == [[], [1, 1, 1], [1, 1]]


def test_decode_skips_specials(spark):
    _, vocab = vocab_of(spark)
    df = spark.createDataFrame([(0, [2, 1, 3, 0]), (1, [])], "doc_id long, input_ids array<int>")
    assert by_doc(tokenizing.decode(df, vocab), "text") == [" b<|endoftext|> a<unk>", ""]
    assert by_doc(tokenizing.decode(df, vocab, skip=("<unk>", "<|endoftext|>")), "text") == [" b a", ""]


def test_hot_token_in_the_join(spark):
    """One token is most of the corpus; salts spread it and nothing is lost."""
    texts = [" the" * 400 for _ in range(20)] + ["rare"]
    df = tokenizing.pretokenize(frame(spark, texts))
    vocab = tokenizing.build_vocab(df, 5)
    joined = by_doc(tokenizing.encode_by_join(df, vocab, salts=4), "input_ids")
    assert joined == by_doc(tokenizing.encode(df, vocab), "input_ids")
    assert [len(i) for i in joined] == [400] * 20 + [1]


def test_profile(spark):
    df = spark.createDataFrame([(i, n) for i, n in enumerate([1, 2, 3, 10])], "doc_id long, n long")
    row = tokenizing.token_profile(df, F.col("n"), 3).first().asDict()
    assert row == {
        "docs": 4, "tokens": 16, "mean_len": 4.0, "q25": 1.75, "median": 2.5, "q75": 4.75,
        "max_len": 10, "short_share": 0.5,
    }


def trained(texts, size):
    tok = tokenizers.Tokenizer(models.BPE())
    tok.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False)
    tok.train_from_iterator(
        texts,
        trainers.BpeTrainer(
            vocab_size=size,
            show_progress=False,
            initial_alphabet=pre_tokenizers.ByteLevel.alphabet(),
        ),
    )
    return tok


def test_bpe_equals_the_tokenizers_package(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    extra = [(10_000 + i, t) for i, t in enumerate(TEXTS)]
    tok = trained([t for _, t in rows], 1500)
    tok.model.save(str(tmp_path))
    merges, ids = bpe.read_bpe(spark, str(tmp_path / "merges.txt"), str(tmp_path / "vocab.json"))
    assert len(merges) > 1000
    df = tokenizing.pretokenize(spark.createDataFrame(rows + extra, "doc_id long, text string"))
    got = {r["doc_id"]: r["input_ids"] for r in bpe.bpe_encode(df, merges, ids).collect()}
    assert got == {i: tok.encode(t).ids for i, t in rows + extra}


def test_bpe_by_hand(spark):
    df = spark.createDataFrame([(0, ["aaaa", "abab", "b"]), (1, [])], "doc_id long, tok array<string>")
    merges = [(b"a", b"a"), (b"a", b"b"), (b"ab", b"ab")]
    out = by_doc(bpe.bpe_encode(df, merges), "input_ids")
    assert out == [[256, 256, 258, 98], []]


def test_bpe_long_pretoken(spark):
    random.seed(3)
    word = "".join(random.choice("ab") for _ in range(20_000))
    tok = trained(["abababbbaaab" * 20], 300)
    df = spark.createDataFrame([(0, [word])], "doc_id long, tok array<string>")
    merges = [(a.encode(), b.encode()) for a, b in json.loads(tok.to_str())["model"]["merges"]]
    alphabet = {c: bytes([b]) for b, c in enumerate(bpe.printable_bytes())}
    ids = {b"".join(alphabet[c] for c in k): v for k, v in tok.get_vocab().items()}
    assert by_doc(bpe.bpe_encode(df, merges, ids), "input_ids") == [tok.encode(word).ids]


def test_bpe_refuses_unreachable_merges(spark):
    df = spark.createDataFrame([(0, ["x"])], "doc_id long, tok array<string>")
    with pytest.raises(ValueError, match="never made"):
        bpe.bpe_encode(df, [(b"ab", b"c")])


def test_both_routes_give_the_same_rows(spark):
    """Also with repeated keys, repeated rows, rows without a key and rows without tokens."""
    rows = [(1, ["a", "b"]), (1, ["b"]), (1, ["b"]), (2, []), (3, ["z", "a", "a"]), (None, ["b", "z"]), (None, ["b", "z"])]
    df = spark.createDataFrame(rows, "doc_id int, tok array<string>")
    vocab = spark.createDataFrame([(0, "<unk>"), (1, "a"), (2, "b")], "id int, token string")
    key = lambda r: str(tuple(r))
    sent, joined = (sorted(map(tuple, tokenizing.encode(df, vocab, limit=k).select("doc_id", "input_ids", "attention_mask").collect()), key=str) for k in (10, 2))
    assert sent == joined and len(sent) == len(rows)
    coded = tokenizing.encode(df, vocab)
    shown, joined = (sorted(map(key, tokenizing.decode(coded, vocab, skip=("<unk>",), limit=k).select("doc_id", "text").collect())) for k in (10, 2))
    assert shown == joined and len(shown) == len(rows)


def test_queue_of_pairs_joins_like_whole_passes():
    rng = random.Random(11)

    def passes(parts, pairs):
        while True:
            best = min((pairs[p] for p in zip(parts, parts[1:]) if p in pairs), default=None)
            if best is None:
                return parts
            out, i = [], 0
            while i < len(parts):
                if i + 1 < len(parts) and (parts[i], parts[i + 1]) == best[1:3]:
                    out.append(best[3])
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out

    for _ in range(300):
        made, pairs = 4, {}
        for rank in range(rng.randrange(1, 14)):
            a, b = rng.randrange(made), rng.randrange(made)
            joined = made if rng.random() < 0.7 else rng.randrange(4, made + 1)  # a piece may be made in two ways
            if (a, b) not in pairs and joined not in (a, b):
                pairs[a, b] = (rank, a, b, joined)
                made = max(made, joined + 1)
        word = [rng.randrange(4) for _ in range(rng.randrange(0, 60))]
        try:
            want = passes(list(word), pairs)
        except MemoryError:
            continue
        assert bpe.join_pairs(list(word), pairs) == want
