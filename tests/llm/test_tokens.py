"""BPE encoding, decoding and counts against the tokenizers library."""

import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from odd_rows import ODD
from hearthspark.llm import bpe, machine, token_columns

PATH = public_tokenizers.path("byte_bpe_50k.json")
PARTS = [
    "a", "e", "th", "ing", " ", "  ", "\n", "'", "'s", "'re", "'ll", "'v", "'r", "1", "23", "é", "ß", "中", "　",
    "\xa0", "\x85", "\x1c", "​", "!", "...", "--", "😀", "\t", "A", "ſ", "²", "Ⅷ", "́", "<|endoftext|>", "<|end",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def words(ids) -> bytes:
    return np.array(ids, dtype="<u4").tobytes()


def texts(n: int, seed: int) -> list[str]:
    pick = random.Random(seed)
    return ["".join(pick.choice(PARTS) for _ in range(pick.randrange(60))) for _ in range(n)]


def test_compiled_and_streaming_encoders_match_the_library(library):
    some = texts(1500, 1)
    want = [words(e.ids) for e in library.encode_batch(some, add_special_tokens=False)]
    counts, ids = machine.tokenize(PATH, [t.encode() for t in some], True)
    assert ids == want
    assert counts.tolist() == [len(w) // 4 for w in want]
    run = bpe.Encoder(PATH)
    assert [b"".join(run.stream(t)) for t in some] == want


def test_long_pieces_stay_bounded(library):
    pick = random.Random(3)
    letters = "".join(pick.choice("abcdefgh") for _ in range(20_000))
    for text in ("a" * 20_000, " " * 9_000 + "x", letters, "x y " * 5_000, "\n" * 7_000):
        want = words(library.encode(text, add_special_tokens=False).ids)
        assert machine.tokenize(PATH, [text.encode()], True)[1] == [want]
        assert b"".join(bpe.Encoder(PATH).stream(text)) == want


def test_pending_bytes_stay_below_the_lookahead():
    pairs = bpe.byte_pairs(PATH)
    bound, pick = pairs.lookahead(), random.Random(4)
    for text in (b"a" * 2000, b"-=" * 1000, bytes(pick.choice(b"abcdeth ") for _ in range(3000))):
        open_ = bpe.PieceEncoder(pairs)
        for i in range(len(text)):
            open_.pending += text[i : i + 1]
            pairs.grow(open_.pending, open_.last)
            at = pairs.stable(open_.pending, open_.last)
            open_.pending, open_.last = open_.pending[at:], [-1]
            pairs.grow(open_.pending, open_.last)
            assert len(open_.pending) <= bound


def test_tables_that_overflow_start_anew(library, monkeypatch):
    monkeypatch.setattr(machine, "STATES", 300)
    some = texts(300, 9)
    fresh = machine.Machine(bpe.BytePairs(PATH))
    plain = [t.replace("<|endoftext|>", "") for t in some]
    want = [words(e.ids) for e in library.encode_batch(plain, add_special_tokens=False)]
    assert machine.run(fresh, [t.encode() for t in plain], True)[1] == want


def test_columns_on_odd_rows(odd, docs, library):
    both = token_columns.encode_and_decode(odd.withColumnRenamed("source", "ids"), PATH).collect()
    counts = token_columns.count_tokens(odd, PATH).collect()
    want = sorted(
        (str(i), words(library.encode(t or "", add_special_tokens=False).ids), t or "") for i, t in ODD
    )
    assert sorted((str(r.doc_id), bytes(r.ids), r.decoded) for r in both) == want
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in counts) == sorted(
        (i, len(t.encode()), len(ids) // 4) for i, ids, t in want
    )
    assert counts[0].lang == "en"
    assert token_columns.encode_and_decode(docs([]), PATH).count() == 0
    assert token_columns.count_tokens(docs([]), PATH).count() == 0


def test_decoding_alone(odd):
    ids = odd.select("doc_id", "text", token_columns.encoded(odd.text, PATH).alias("ids"))
    back = ids.select("text", token_columns.decoded(ids.ids, PATH).alias("said"))
    assert back.filter("coalesce(text, '') != said").count() == 0
