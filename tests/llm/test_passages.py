"""Repeated passages and test items against brute force."""

import random

import pytest

from odd_rows import ODD
from hearthspark.llm import decontamination, substrings


def prose(pick: random.Random, sentences: int, vocabulary: int = 4000) -> list[str]:
    return [" ".join(f"t{pick.randrange(vocabulary)}" for _ in range(pick.randrange(4, 14))) + "." for _ in range(sentences)]


def brute_spans(rows):
    """Byte ranges that go, by row: of the places of a span all but the first."""
    places: dict = {}
    cuts = []
    for at, (i, text) in enumerate(rows):
        found = substrings.Sentences([(text or "").encode()])
        raw = (text or "").encode()
        parts = [(int(a), int(b)) for a, b in zip(found.start, found.end, strict=True)]
        assert b"".join(raw[a:b] for a, b in parts) == raw.lstrip(b" \n\t\x0b\x0c\r") if parts else True
        cuts.append(parts)
        for k in range(len(parts) - substrings.RUN + 1):
            words = [raw[a:b].lower().split() for a, b in parts[k : k + substrings.RUN]]
            if sum(map(len, words)) >= substrings.WORDS:
                places.setdefault(str(words), []).append(((i is None, i or 0), text, k, at))
    gone: dict[int, set[int]] = {}
    for found in places.values():
        first = min(x[:3] for x in found)
        for x in found:
            if x[:3] != first:
                gone.setdefault(x[3], set()).update(range(x[2], x[2] + substrings.RUN))
    out = []
    for at, (i, text) in enumerate(rows):
        raw = (text or "").encode()
        lead = cuts[at][0][0] if cuts[at] else len(raw)
        kept = raw[:lead] + b"".join(raw[a:b] for k, (a, b) in enumerate(cuts[at]) if k not in gone.get(at, ()))
        out.append((str(i), None if text is None else kept.decode()))
    return out


def test_repeated_passages(odd, docs):
    pick = random.Random(1)
    passage, second = prose(pick, 6), prose(pick, 5)
    rows = [(100 + k, " ".join(prose(pick, 5) + passage + prose(pick, 4))) for k in range(4)]
    rows += [(90, " ".join(passage[:4] + prose(pick, 3))), (120, "\n".join(prose(pick, 3) + second + second))]
    unbroken = " ".join(f"u{pick.randrange(9000)}" for _ in range(80))
    rows += [(130, unbroken), (131, "Quite another beginning, " + unbroken + " and end")]
    table = odd.unionByName(docs(rows)).withColumnRenamed("source", "removed")
    found = substrings.remove_repeated(table).collect()
    assert sorted(((str(r.doc_id), r.text) for r in found), key=str) == sorted(brute_spans(ODD + rows), key=str)
    text = {r.doc_id: r.text for r in found if r.doc_id is not None and r.doc_id >= 90}
    assert sum(passage[2] in t for t in text.values()) == 1
    assert text[131].count("u") < 40
    assert substrings.remove_repeated(docs([])).count() == 0


def test_hot_spans_are_cut_alike(docs, monkeypatch):
    """A passage that a third of all documents share, with all hashes hot and with none."""
    pick = random.Random(21)
    passage = prose(pick, 7)
    rows = [(k, " ".join(prose(pick, 4) + (passage if k % 3 == 0 else []) + prose(pick, 3))) for k in range(300)]
    want = sorted(brute_spans(rows))
    for hot in (1 << 40, 1024, 0):
        monkeypatch.setattr(substrings, "HOT", hot)
        assert sorted((str(r.doc_id), r.text) for r in substrings.remove_repeated(docs(rows)).collect()) == want


def test_a_clean_corpus_stays(docs):
    pick = random.Random(2)
    rows = [(k, " ".join(prose(pick, 12))) for k in range(20)]
    found = {r.doc_id: r for r in substrings.remove_repeated(docs(rows)).collect()}
    assert all(found[i].text == t and found[i].removed == [] for i, t in rows)


def running(pick: random.Random, words: int) -> str:
    return " ".join(f"r{pick.randrange(9000)}" for _ in range(words))


def chars(pick: random.Random, n: int, stop: str) -> str:
    return "".join(chr(0x4E00 + pick.randrange(3000)) + (stop if k % 17 == 16 else "") for k in range(n))


def thai(pick: random.Random, n: int) -> str:
    return "".join(chr(0xE01 + pick.randrange(46)) for _ in range(n))


KINDS = {
    "lines": ("\n", lambda pick: "\n".join(running(pick, 1 + k % 3) for k in range(27))),
    "running": (" ", lambda pick: running(pick, 51)),
    "chinese": ("", lambda pick: chars(pick, 60, "")),
    "chinese with stops": ("", lambda pick: chars(pick, 60, "\u3002")),
    "thai": ("", lambda pick: thai(pick, 80)),
    "danda": (" ", lambda pick: " ".join(running(pick, 8) + "\u0964" for _ in range(7))),
}


@pytest.mark.parametrize("kind", KINDS)
def test_passages_of_other_kinds(docs, kind):
    gap, make = KINDS[kind]
    pick = random.Random(14)
    around = chars if kind.startswith("chinese") else None
    rows, passages = [], []
    for k in range(60):
        passages.append(make(pick))
        for place in range(2):
            ends = [around(pick, 23, "") if around else thai(pick, 23) if kind == "thai" else running(pick, 20 + place) for _ in range(2)]
            rows.append((2 * k + place, gap.join([ends[0], passages[-1], ends[1]])))
    found = {r.doc_id: r for r in substrings.remove_repeated(docs(rows)).collect()}
    assert all(found[2 * k].text == rows[2 * k][1] for k in range(60))
    lost = [k for k in range(60) if not found[2 * k + 1].removed]
    assert len(lost) == 0
    for k in range(60):
        raw, cut = rows[2 * k + 1][1].encode(), found[2 * k + 1].removed
        at = raw.index(passages[k].encode())
        assert all(a >= at and b <= at + len(passages[k].encode()) + 1 for a, b in cut)


@pytest.mark.parametrize("sent", [decontamination.SENT, 0])
def test_contained_items(spark, odd, docs, sent):
    pick = random.Random(3)
    item = [f"q{pick.randrange(3000)}" for _ in range(60)]
    near = item[:30] + ["changed"] + item[31:]
    rows = [
        (200, " ".join(f"r{pick.randrange(3000)}" for _ in range(3000)) + " " + " ".join(item) + " end"),
        (201, " ".join(item[:20])),
        (202, " ".join(w.upper() + "," for w in near)),
        (203, "short item"),
    ]
    items = [(1, " ".join(item)), (1, " ".join(item)), (2, "Short, item!"), (3, None), (4, ""), (None, " ".join(item[10:40])), (5, "no match at all in any text")]
    tests = spark.createDataFrame(items, "item_id long, text string")
    found = decontamination.contained_items(odd.unionByName(docs(rows)), tests, sent=sent).collect()
    got = sorted((str(r.doc_id), str(r.item_id)) for r in found)
    assert got == [("200", "1"), ("200", "None"), ("202", "1"), ("202", "None"), ("203", "2")] or got == [
        ("200", "1"), ("200", "None"), ("202", "1"), ("203", "2")
    ]
    whole = {(r.doc_id, r.item_id): (r.n_shared, r.n_shingles) for r in found}
    assert whole[200, 1] == (56, 56) and whole[202, 1] == (51, 56)
    kept = decontamination.decontaminated(odd.unionByName(docs(rows)), tests)
    assert kept.count() == len(ODD) + 1
    empty = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.contained_items(odd, empty, sent=sent).count() == 0
    assert decontamination.contained_items(docs([]), tests, sent=sent).count() == 0
