"""Thue-Morse texts and their complements: equal under every polynomial hash modulo a power of two."""

import pytest
from tests.llm.fixtures import table

from phraseforge.llm import pieces, quality_rules, substring_dedup, suffix_dedup, token_counts

public_tokenizers = pytest.importorskip("public_tokenizers")
SIZES = (512, 1024, 4096)


def thue_morse(n, a, b):
    return "".join(b if i.bit_count() & 1 else a for i in range(n))


def both(n):
    return [thue_morse(n, "a", "b"), thue_morse(n, "b", "a")]


@pytest.mark.parametrize("n", SIZES)
def test_tokenizers_keep_them_apart(n):
    import sentencepiece
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    want = [len(e.ids) for e in Tokenizer.from_file(path).encode_batch(both(n), add_special_tokens=False)]
    assert token_counts.count_block(token_counts.ByteBPE(path), both(n)).tolist() == want
    path = public_tokenizers.path("piece_bpe_32k.model")
    offsets, ids = pieces.encode_block(pieces.PieceModel(path), both(n))
    want = sentencepiece.SentencePieceProcessor(model_file=path).encode(both(n))
    assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == want


def test_no_repeats_between_them(spark):
    rows = []
    for n in SIZES:
        for x in both(n):
            rows.append((len(rows), " ".join([x, *(f"w{n}x{i}" for i in range(60))])))
    docs = table(spark, rows)
    # the words after the first one repeat, the first one never does
    assert all(r["n_removed"] == (60 if r["doc_id"] % 2 else 0) for r in substring_dedup.remove_repeats(docs).collect())
    assert {(r["start"], r["n_words"]) for r in suffix_dedup.repeated_passages(docs).collect()} == {(1, 60)}
    lone = table(spark, [(i, " ".join([x, *(f"v{n}x{k}" for k in range(19))])) for n in SIZES for i, x in enumerate(both(n), n)])
    assert all(r["n_removed"] == 0 for r in substring_dedup.remove_repeats(lone).collect())


def test_lines_and_windows_are_told_apart(spark):
    rows = [(n, "\n".join(x + " one" for x in both(n)) + "\n" + " ".join(both(n))) for n in SIZES]
    for r in quality_rules.judge(table(spark, rows)).collect():
        assert r["n_dup_lines"] == 0 and r["n_repeat_words"] == 0
