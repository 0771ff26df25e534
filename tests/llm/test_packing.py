import zlib

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from quire.llm import packing

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def reference():
    import public_tokenizers

    held = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda text: held.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(text=st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from(" \t\n\r\x0b\x0c\x85\xa0\u2028\u3000'sé1a<|endoftext|>")), max_size=40), marks=st.lists(st.integers(0, 40), max_size=3))
def test_ranks_give_the_tokenizer_files_ids(reference, text, marks):
    for at in marks:
        text = f"{text[:at]}<|endoftext|>{text[at:]}"
    assert packing.token_ids(text).tolist() == reference(text)


def test_added_tokens_are_matched_as_the_file_does(spark, reference):
    rows = packing.pack(spark.createDataFrame([(1, "hello <|endoftext|> world"), (2, None)], "doc_id long, text string")).orderBy("doc_id", "start").collect()
    ids = [np.frombuffer(b"".join(r.ids for r in rows if r.doc_id == k), "<u4").tolist() for k in (1, 2)]
    assert ids == [[*reference("hello <|endoftext|> world"), 1], [1]] and ids[0] == [31373, 220, 50256, 995, 1]


def test_pieces_cover_every_document_once(messy, messy_rows, reference):
    rows = packing.pack(messy).collect()
    assert len({r.sequence_id for r in rows}) == len(rows) and {r.offset for r in rows} == {0}
    docs = {}
    for r in rows:
        assert r.length == 1 << r.bucket <= 2048 and len(r.ids) == 4 * r.length
        docs.setdefault(r.doc_id, []).append(r)
    counts = {}
    for r in messy_rows:
        counts.setdefault(r[0], []).append([*reference(r[1] or ""), 1])
    for doc_id, texts in counts.items():
        got = sorted(docs[doc_id], key=lambda r: (r.doc_tokens, r.start))
        assert sum(r.length for r in got) == sum(map(len, texts))
        if len(texts) == 1:
            ids = np.concatenate([np.frombuffer(r.ids, "<u4") for r in got])
            assert ids.tolist() == texts[0] and [r.start for r in got] == np.cumsum([0] + [r.length for r in got])[:-1].tolist()
            assert zlib.crc32(got[0].ids) == zlib.crc32(np.array(texts[0][: got[0].length], "<u4").tobytes())


def test_decomposition_empty_tables_and_buckets(spark, messy, empty, tmp_path):
    assert packing.piece_lengths(2048 * 2 + 5) == [2048, 2048, 4, 1] and packing.piece_lengths(1) == [1]
    assert packing.pack(empty).count() == 0
    packing.write_buckets(packing.pack(messy), str(tmp_path / "b"))
    back = spark.read.parquet(str(tmp_path / "b"))
    assert back.where("length != shiftleft(1, bucket)").count() == 0 and back.count() == packing.pack(messy).count()
