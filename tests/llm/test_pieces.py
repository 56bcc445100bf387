import hashlib
import struct

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from chronolex.llm import pieces as P

from .helpers import SF, awkward, clashing

sentencepiece = pytest.importorskip("sentencepiece")
public = pytest.importorskip("public_tokenizers")
MODEL = public.path("piece_bpe_32k.model")
SP = sentencepiece.SentencePieceProcessor(model_file=MODEL)
TABLE = P.PrefixTable(P.read_vocabulary(MODEL))


def want(text):
    ids = SP.encode(text or "", add_bos=True, add_eos=True)
    return struct.pack(f"<{len(ids)}I", *ids), SP.decode(ids)


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(), st.text("ab the\n\t ▁é漢😀<s>/0x1", max_size=60)))
def test_equals_the_library(text):
    ids, decoded = want(text)
    assert TABLE.encode(text) == ids
    assert TABLE.decode(ids) == decoded


@pytest.mark.parametrize("text", ["a" * 300, " " * 101, "=" * 77, "-" * 1001, "▁▁ ▁", "\n \n", "\x00", "x " * 20_000])
def test_runs_and_blanks(text):
    ids, decoded = want(text)
    assert TABLE.encode(text) == ids and TABLE.decode(ids) == decoded


def test_query_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: r for r in P.digest(docs, MODEL).collect()}
    for r in docs.collect():
        ids, decoded = want(r.text)
        assert tuple(got[r.doc_id]) == (r.doc_id, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())


def test_awkward_rows(spark):
    docs = clashing(awkward(spark))
    got = sorted(r.ids_sha256 for r in P.digest(docs, MODEL).collect())
    assert got == sorted(hashlib.sha256(want(r.text)[0]).hexdigest() for r in docs.collect())
    assert P.digest(docs.limit(0), MODEL).count() == 0
