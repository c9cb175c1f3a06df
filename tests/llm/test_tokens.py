import public_tokenizers
import pytest
import sentencepiece
from docloom.llm.tokens import PieceCounter, count_tokens
from hypothesis import given, settings
from hypothesis import strategies as st

from .helpers import AWKWARD, doc_frame

MODEL = str(public_tokenizers.path("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def pair():
    with open(MODEL, "rb") as f:
        return PieceCounter(f.read()), sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.mark.parametrize(
    "text",
    ["", " ", "  a  ", "Hello  world\n\tfoo <s> </s> <unk>", "é中😀 x<0x0A>", "a▁b \x00c", "aaaaaaaaaaaaaaaa" * 50, "1,234.5%%% it's (un)done", "0  aa", "  in  the   hat", "a" + " " * 40 + "b", "  \n   x", "   ".join(["the", "in", "and"] * 9)],
)
def test_equals_library(pair, text):
    counter, library = pair
    assert counter.count(text) == len(library.encode(text))


@settings(max_examples=5000, deadline=None)
@given(st.text(alphabet=st.sampled_from("abet hin▁  \n.,é中<s>/0'😀ß"), max_size=60))
def test_equals_library_on_any_text(pair, text):
    counter, library = pair
    assert counter.count(text) == len(library.encode(text))


def test_query_rows(spark, pair):
    _, library = pair
    long = "thanedble the, anea! " * 5000
    rows = [*AWKWARD, (9, long, "s0")]
    got = count_tokens(doc_frame(spark, rows), MODEL).collect()
    want = sorted((str(r[0]), len((r[1] or "").encode()), len(library.encode(r[1] or ""))) for r in rows)
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in got) == want
    assert {r.doc_id for r in got if r.over_limit} == {9}
    assert count_tokens(doc_frame(spark, []), MODEL).count() == 0
