"""The ids of whole documents against the library, and their text."""

import sentencepiece
from test_operators import DOC, texts

from basinsift.llm import pieces


def test_ids_of_documents_and_back(spark):
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    vocabulary, library = pieces.Vocabulary(path), sentencepiece.SentencePieceProcessor(model_file=path)
    rows = list(enumerate([*texts(40, 8, 40), "  two  spaces ", "a\nb\tc", "漢字 ☃ naïve", "x" * 200, "don't stop", "", None]))
    for frequent in (3, 1000):
        got = {r["doc_id"]: r for r in pieces.encode_documents(spark.createDataFrame(rows, DOC).repartition(3), vocabulary, frequent).collect()}
        for k, text in rows:
            assert got[k]["ids"] == library.encode(text or "") and got[k]["decoded"] == (text or "") and got[k]["exact"]


def test_unlike_ids_are_not_exact():
    assert pieces.decode_bytes([1, 7], {1: "▁a".encode(), 2: b"b"}) == b"a"
