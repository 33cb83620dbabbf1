import public_tokenizers
import pytest
import sentencepiece

from accessloom.llm.token_counts import token_counts

MODEL = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    None, "", " ", "  a", "a ", "a  b", "a\n\nb", "\n", "\nx", "x\n", "a \n b", "a▁b", "▁", "▁▁ x", "<s>hi</s>", "\U0001f600 \U0001f600",
    "a\tb", "a" * 5000, "word " * 20000, " \n \n", "a\x00b", "é ï\n  é", "same text", "same text",
]


def test_counts_equal_the_library_and_clashing_columns_are_harmless(spark):
    docs = spark.createDataFrame([(i, x, 7, "k") for i, x in enumerate(TEXTS)], "doc_id long, text string, batch int, key string")
    got = {r.doc_id: r for r in token_counts(docs, MODEL).collect()}
    lib = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    assert len(got) == len(TEXTS)
    for i, x in enumerate(TEXTS):
        n = len(lib.encode(x or ""))
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((x or "").encode()), n, n > 4096), repr(x)[:40]


@pytest.mark.parametrize("rows, want", [([], []), ([(None, "a b"), (None, "a b"), (3, None)], [(None, 2), (None, 2), (3, 0)])])
def test_empty_tables_null_ids_and_repeated_rows(spark, rows, want):
    got = token_counts(spark.createDataFrame(rows, "doc_id long, text string"), MODEL).collect()
    assert sorted(((r.doc_id, r.n_tokens) for r in got), key=str) == sorted(want, key=str)
