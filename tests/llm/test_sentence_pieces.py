import random

import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor

from quern.llm import sentence_pieces as sp

PATH = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "  a  b ", "a\x00b", "▁x▁▁ y", "héllo 你好 𓀀 �", "<s> </s> <unk> <0x41>", "\n\n \t x", " " * 3000, "ab" * 5000, "aaaa bbbb", "é‍👩‍👩‍👧", "the" * 700 + " the"]


@pytest.fixture(scope="module")
def vocabulary():
    return sp.load(PATH)


@pytest.fixture(scope="module")
def library():
    return SentencePieceProcessor(model_file=PATH)


def random_texts(n: int) -> list[str]:
    r = random.Random(5)
    alphabet = "aeinrst  ▁\n.0你é'-ا<>" + "th"
    return ["".join(r.choices(alphabet, k=r.randrange(400))) for _ in range(n)]


def test_encoder_is_the_librarys(vocabulary, library):
    encoder, decoder = sp.Encoder(vocabulary), sp.Decoder(vocabulary)
    for text in ODD + random_texts(300):
        ids = memoryview(encoder.encode(text)).cast("i").tolist()
        assert ids == library.encode(text), text[:50]
        assert decoder.decode(ids) == library.decode(ids), text[:50]


def test_decoder_on_any_ids(vocabulary, library):
    r, decoder = random.Random(6), sp.Decoder(vocabulary)
    for _ in range(500):
        ids = [r.choice([1, 2, 259, r.randrange(3, 259), r.randrange(1, 32000)]) for _ in range(r.randrange(12))]
        assert decoder.decode(ids) == library.decode(ids), ids


def test_leftmost_of_equal_scores():
    for merge in (sp.merge, sp.merge_few):
        assert merge(list("aaa"), {"aa": 0}) == ["aa", "a"]
        assert merge(list("abab"), {"ab": 1, "ba": 0, "bab": 2}) == ["a", "bab"]


def test_whole_table(spark, vocabulary):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    done = sp.decode(sp.encode(docs, vocabulary), vocabulary)
    got = sp.library_differences(done, PATH).first()
    assert got["n_rows"] == docs.count() and (got["n_ids"], got["n_texts"]) == (0, 0)


def test_odd_rows(spark, vocabulary, library):
    rows = [(k, t, "x") for k, t in enumerate(ODD)] + [(None, None, None), (0, "", "x"), (3, ODD[3], None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, IDS string")
    done = sp.decode(sp.encode(docs, vocabulary), vocabulary)
    assert done.columns == ["doc_id", "text", "ids", "decoded"]
    for r in done.collect():
        theirs = library.encode(r["text"] or "")
        assert r["ids"] == theirs and r["decoded"] == library.decode(theirs)
    report = sp.piece_report(docs, PATH)
    assert report.count() == len(rows)
    assert report.where("doc_id is null").first()["n_tokens"] == 0
    assert sp.piece_report(docs.where("doc_id > 100"), PATH).count() == 0


def test_very_long_text(spark, vocabulary, library):
    text = " ".join(random_texts(1)[0] + str(k) for k in range(8000)) + "x" * 200_000
    got = sp.encode(spark.createDataFrame([(1, text)], "doc_id long, text string"), vocabulary).first()
    assert got["ids"] == library.encode(text)


def test_other_models_are_refused(tmp_path):
    data = open(PATH, "rb").read()
    (tmp_path / "unigram.model").write_bytes(data + b"\x12\x02\x18\x01")  # a trainer_spec of another type
    with pytest.raises(ValueError):
        sp.load(str(tmp_path / "unigram.model"))
