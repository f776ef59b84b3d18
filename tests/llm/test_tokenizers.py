import random

import numpy as np
import pytest
from tests.llm.fixtures import edge_rows, table

public_tokenizers = pytest.importorskip("public_tokenizers")

from phraseforge.llm import pieces, token_counts  # noqa: E402

ALPHABET = ["a", "b", "s", "t", "re", " ", "  ", "   ", "\n", "\t", "'", "'s", "'ll", "'LL", "!", "1", "23", "é", "ñ", "中", "😀", "\xa0",
            "　", "\x85", "\x1c", "ing", "tion", "the", "▁", "\x00", "<s>", "<0x41>", "́", "==", "<|endoftext|>", "<|", "Ⅷ", "²"]


def random_texts(n, seed):
    r = random.Random(seed)
    return ["".join(r.choices(ALPHABET, k=r.randint(0, 20))) for _ in range(n)]


LONG = ["aaaaaaaaa" * 50, " " * 200, "a" + " " * 300 + "b", "x" * 3000, "\n" * 500, "中文字符" * 300, "-" * 77 + "a", "'", " ", "a ",
        "".join(random.Random(5).choices("abcdefghijklmnopqrstuvwxyz", k=4000))]


@pytest.fixture(scope="module")
def piece_path():
    return public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def bpe_path():
    return public_tokenizers.path("byte_bpe_50k.json")


def test_token_counts_equal_the_library(bpe_path):
    from tokenizers import Tokenizer

    texts = random_texts(4000, 1) + LONG
    want = [len(e.ids) for e in Tokenizer.from_file(bpe_path).encode_batch(texts, add_special_tokens=False)]
    assert token_counts.count_block(token_counts.ByteBPE(bpe_path), texts).tolist() == want


def test_token_counts_of_edge_rows(spark, bpe_path):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe_path)
    rows = edge_rows()
    got = token_counts.count_tokens(table(spark, rows, "n_tokens,n_bytes"), bpe_path).collect()
    want = [(d, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 512) for d, t, *_ in rows]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert token_counts.count_tokens(table(spark, rows).limit(0), bpe_path).count() == 0


def test_token_counts_keep_ids_of_any_type(spark, bpe_path):
    docs = spark.createDataFrame([("D-3", "one two"), (None, None)], "doc_id string, text string")
    assert {r["doc_id"]: r["n_tokens"] for r in token_counts.count_tokens(docs, bpe_path).collect()} == {"D-3": 2, None: 0}


def test_piece_ids_equal_the_library(piece_path):
    import sentencepiece

    texts = random_texts(4000, 2) + LONG
    model, library = pieces.PieceModel(piece_path), sentencepiece.SentencePieceProcessor(model_file=piece_path)
    offsets, ids = pieces.encode_block(model, texts)
    want = library.encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == want
    assert pieces.decode_block(model, offsets, ids) == library.decode(want)


def test_streaming_keeps_a_bounded_window(piece_path):
    import sentencepiece

    model, library = pieces.PieceModel(piece_path), sentencepiece.SentencePieceProcessor(model_file=piece_path)
    text = "▁" + "".join(random.Random(3).choices("etaoinshrdlu", k=6000))
    stream, out, held = pieces.StreamingViterbi(model), [], 0
    for at in range(0, len(text), 50):
        out += stream.feed(text[at:at + 50])
        held = max(held, len(stream._chars))
    assert out + stream.close() == library.encode(text[1:])
    assert held < 20 * model.longest


def test_round_trip_of_edge_rows(spark, piece_path):
    rows = edge_rows()
    docs = table(spark, rows, "ids_,decoded,n_tokens")
    coded = pieces.decode(pieces.encode(docs, piece_path), piece_path, output="again")
    got = coded.collect()
    assert len(got) == len(rows)
    assert all(r["again"] == (r["text"] or "") for r in got)
    assert sorted(str(r["decoded"]) for r in got) == sorted(str(None if r[0] is None else f"x{r[0]}") for r in rows)
    assert pieces.encode(docs.limit(0), piece_path).count() == 0
    both = pieces.round_trip(docs, piece_path).collect()
    assert all(r["round_trip"] for r in both) and sorted((str(r["doc_id"]), r["ids"]) for r in both) == sorted((str(r["doc_id"]), r["ids"]) for r in got)
    empty = [r for r in got if not r["text"]]
    assert empty and all(r["ids"] == [] for r in empty)


def test_merging_overlapping_pairs(bpe_path):
    model = token_counts.ByteBPE(bpe_path)
    lengths = np.arange(1, 40)
    symbols = np.repeat(model.first[ord("a")], lengths.sum())
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe_path)
    want = [len(library.encode("a" * n).ids) for n in lengths.tolist()]
    assert token_counts.merge_counts(model, symbols, lengths).tolist() == want
