"""Cross-tokenizer alignment against the tokenizers' own libraries and plain loops."""

import hashlib
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from odd_rows import ODD
from tokenizers import Tokenizer

from hearthspark.llm import alignment, queries

SF_DIR = "/root/testdata/sf0.001"
PATHS = queries.tokenizer(), public_tokenizers.path("piece_bpe_32k.model")
COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def brute(texts):
    """The measures of each text, by loops over tokens."""
    both = Tokenizer.from_file(PATHS[0])
    both.encode_special_tokens = True
    pieces = sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    bytes_of = {c: b for c, b in alignment.byte_characters().items()}

    def cut(text):
        if not text:
            return []
        a = both.encode(" " + text, add_special_tokens=False).ids
        b = pieces.encode(text)
        word_a = [bytes(bytes_of[c] for c in both.id_to_token(i)) for i in a]
        word_b = [
            bytes([int(p[3:5], 16)]) if pieces.is_byte(i) else p.replace("▁", " ").encode()
            for i, p in ((i, pieces.id_to_piece(i)) for i in b)
        ]
        if b"".join(word_a) != (" " + text).encode() or b"".join(word_b) != (" " + text).encode():
            return []
        groups, x, y, at_x, at_y = [], [], [], 0, 0
        a, b = list(zip(a, word_a, strict=True)), list(zip(b, word_b, strict=True))
        while a or b:
            if at_x <= at_y:
                i, w = a.pop(0)
                x.append(i)
                at_x += len(w)
            else:
                i, w = b.pop(0)
                y.append(i)
                at_y += len(w)
            if at_x == at_y:
                groups.append((x, y))
                x, y = [], []
        return groups

    cuts = [cut(t) for t in texts]
    linked = [Counter((i, j) for x, y in c for i in x for j in y) for c in cuts]
    counts = Counter(p for pairs in linked for p in pairs)
    best = {}
    for (i, _), n in counts.items():
        best[i] = max(best.get(i, 0), n)
    out = []
    for c, pairs in zip(cuts, linked, strict=True):
        line = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in c)
        out.append(
            (
                sum(len(x) for x, _ in c),
                sum(len(y) for _, y in c),
                len(c),
                sum(pairs.values()),
                sum(n for p, n in pairs.items() if counts[p] == best[p[0]]),
                sum(n * counts[p] for p, n in pairs.items()),
                hashlib.sha256(line.encode()).hexdigest() if line else "",
            )
        )
    return out


def found(df):
    return sorted(((r.doc_id, *(r[c] for c in COLUMNS)) for r in df.collect()), key=str)


def expected(rows):
    return sorted(((i, *m) for (i, _), m in zip(rows, brute([t for _, t in rows]), strict=True)), key=str)


STRANGE = [
    (20, "▁ a lower block that is a space on one side"),
    (21, "ﬁne ligatures ½ and ® <s> </s> <unk> <0x41> <|endoftext|> stay plain"),
    (22, "  two  spaces\t\ttabs\r\n\r\n   lines "),
    (23, "\x00 zero"),
    (24, "中文字符没有空格" * 30),
    (25, "กขค" * 40 + "😀😃" * 20),
    (26, "a" * 3000 + "=-" * 500),
    (27, "don't we'll 'S I'M 12345678 ٣٤٥"),
]


def test_odd_and_strange_texts(docs):
    rows = ODD + STRANGE
    assert found(alignment.align(docs(rows), *PATHS)) == expected(rows)


def test_query_by_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()]
    assert found(queries.op11_alignment(spark, SF_DIR)) == expected(rows)


@pytest.mark.parametrize(("size", "wide"), [(1, 1), (300, 3)])
def test_chunks_and_wide_groups_change_nothing(docs, monkeypatch, size, wide):
    rows = ODD + STRANGE
    monkeypatch.setattr(alignment, "WIDE", wide)
    both = alignment.tokenizers(*PATHS)
    texts = [t.encode() for _, t in rows if t]
    narrow = alignment.Alignment(both, texts)
    monkeypatch.setattr(alignment, "WIDE", 1 << 40)
    plain = alignment.Alignment(both, texts)
    assert narrow.pair.tolist() == plain.pair.tolist() and narrow.times.tolist() == plain.times.tolist()
    chunk = alignment._Chunk(3)
    for k in range(0, len(texts), size):
        some = texts[k : k + size]
        chunk.add(some, alignment.np.ones(len(some), dtype=int), alignment.Alignment(both, some))
    *parts, listed = list(chunk.rows())
    assert sum(p.num_rows for p in parts) == len(texts)
    pairs = listed.column("pairs")[0].as_py()
    assert [p["pair"] for p in pairs] == sorted(set(plain.pair.tolist()))


def test_copies_weigh_as_documents(docs):
    rows = [(i, "one text in a third of all rows") for i in range(3000)] + [(5000 + i, f"text {i % 7}") for i in range(40)] + [(None, None)] * 30
    assert found(alignment.align(docs(rows), *PATHS)) == expected(rows)


def test_columns_of_the_same_names_and_no_rows(spark, docs):
    clash = docs([(1, "a b"), (2, None)]).selectExpr("doc_id", "text", "'mine' AS n_a", "'own' AS chunk", "'own' AS pair", "'k' AS key")
    out = alignment.align(clash, *PATHS)
    assert out.columns == ["doc_id", "chunk", "pair", "key", *COLUMNS]
    assert {r.doc_id: (r.n_a > 0, r.chunk) for r in out.collect()} == {1: (True, "own"), 2: (False, "own")}
    assert alignment.align(docs([]), *PATHS).count() == 0
