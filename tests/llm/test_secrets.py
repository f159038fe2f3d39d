"""Secret scan: rules against character loops, the network's slopes and pieces, planted secrets without a rule."""

import hashlib
import string

import numpy as np
from odd_rows import ODD

from hearthspark.llm import queries, secrets

SF_DIR = "/root/testdata/sf0.001"
NAMES = ["password", "passwd", "secret", "token", "api_key", "apikey"]
VALUE = set(string.ascii_letters + string.digits + "+/_.=-")


def _run(text, at, chars):
    end = at
    while end < len(text) and text[end] in chars:
        end += 1
    return end


def brute(text):
    """(start, end, kind) of the rules, character by character."""
    out = []
    low = "".join(c.lower() if c in string.ascii_uppercase else c for c in text)
    at = 0
    while at < len(text):
        end = None
        for name in NAMES:
            if not low.startswith(name, at):
                continue
            # An optional quote before and after may also be left out, as long as the rest matches.
            for quote in (1, 0):
                p = at + len(name)
                if quote:
                    if p >= len(text) or text[p] not in "\"'":
                        continue
                    p += 1
                p = _run(text, p, " ")
                if p >= len(text) or text[p] not in ":=":
                    continue
                p = _run(text, p + 1, " ")
                if p < len(text) and text[p] in "\"'":
                    p += 1
                stop = _run(text, p, VALUE)
                if stop > p:
                    end, value = stop, p
                    break
            if end:
                break
        if end:
            if end - value >= 8:
                out.append((at, end, 0))
            at = end
        else:
            at += 1
    at = 0
    while (at := text.find("AKIA", at)) >= 0:
        end = _run(text, at, string.ascii_uppercase + string.digits)
        if end - at >= 16:
            out.append((at, end, 1))
        at = max(end, at + 4)
    at = 0
    while at < len(text):
        end = _run(text, at, "0123456789abcdef")
        if end - at >= 32:
            out.append((at, end, 2))
        at = end + 1
    return sorted(out, key=lambda x: (x[0], x[2]))


HARD = [
    "token = \"abcdefgh\" TOKEN:'x' Api_Key=1234567.= apikey  :  'ABCDEFGH/+' passwd=short",
    "ſecret = abcdefghij toKen = abcdefghij toKen=abcdefghij",
    "token: secret=abcdefgh1 password=token=abcdefghij secret= password: 'q",
    "AKIAAKIAAKIAAKIA AKIA123 AKIA" + "Z9" * 6 + "a xAKIA" + "0" * 20,
    "😀" * 5 + " " + "0123456789abcdef" * 2 + "g" + "a" * 31 + " " + "b" * 33,
    "token\"=" + "f" * 40 + ", token' : \"" + "e" * 32,
    "token\"\" = abcdefghij token = \n abcdefghij token\t=abcdefghij",
    "",
]


def test_rules_by_brute_force():
    for text in HARD:
        assert [x[:3] for x in secrets.findings(text)] == brute(text), text
    rng = np.random.default_rng(3)
    parts = ["token", "Secret", "api_key", "passwd", "AKIA", "0123456789abcdef", "=", ":", " ", '"', "'", "xyz", "A1B2C3D4", "-", "ß", "\n", "."]
    for _ in range(3000):
        text = "".join(parts[int(k)] for k in rng.integers(0, len(parts), 14))
        assert [x[:3] for x in secrets.findings(text)] == brute(text), text


def lines(text, rows):
    return ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, b, k in rows)


def test_query_keeps_the_base_findings(spark):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    found = queries.op13_secrets(spark, SF_DIR).collect()
    assert sorted(r.doc_id for r in found) == sorted(texts)
    for r in found:
        want = brute(texts[r.doc_id])
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == kind for _, _, k in want) for kind in range(3))
        assert r.base_sha256 == hashlib.sha256(lines(texts[r.doc_id], want).encode()).hexdigest()
        spans = r.spans.split(",") if r.spans else []
        assert [s for s in spans if not s.startswith("model:")] == (lines("", want).split(",") if want else [])
        assert len(spans) == len(want) + r.n_model
        assert spans == sorted(spans, key=lambda s: (int(s.split(":")[1]), secrets.KINDS.index(s.split(":")[0])))


def test_odd_documents_clashing_columns_and_no_rows(docs):
    out = secrets.scan(docs(ODD).selectExpr("doc_id", "text", "'mine' AS spans", "'own' AS __kept", "'b' AS base"))
    assert out.columns == ["doc_id", "__kept", "base", "n_assign", "n_access", "n_hex", "n_model", "base_sha256", "spans"]
    rows = out.collect()
    assert len(rows) == len(ODD) and {r.spans for r in rows} == {""}
    assert {r.base_sha256 for r in rows} == {hashlib.sha256(b"").hexdigest()}
    assert secrets.scan(docs([])).count() == 0


def test_slopes_are_those_of_the_loss():
    rng = np.random.default_rng(0)
    model = secrets.Network.fresh(1)
    rows = [secrets._codes("ab ", "".join(rng.choice(list("abc012"), int(n))), " z") for n in (3, 40, 300)]
    secret, share = np.array([True, False, True]), np.array([0.7, 1.1, 0.9])

    def loss():
        p = secrets._logistic(model.logits(rows))
        return float((-(secret * np.log(p) + ~secret * np.log(1 - p)) * share).mean())

    for name, slope in model._slopes(rows, secret, share).items():
        weights = model.weights[name]
        for at in rng.permutation(weights.size)[:25]:
            place = np.unravel_index(at, weights.shape)
            kept = weights[place]
            weights[place] = kept + 1e-5
            up = loss()
            weights[place] = kept - 1e-5
            down = loss()
            weights[place] = kept
            assert abs((up - down) / 2e-5 - slope[place]) < 1e-5, name


def test_long_candidates_are_read_whole(monkeypatch):
    rng = np.random.default_rng(5)
    model = secrets.Network.fresh(2)
    rows = [secrets._codes("x", "".join(rng.choice(list("abcXYZ019"), n)), "y") for n in (1, 100, 122, 123, 124, 125, 126, 1000, 5000)]
    parts = model.logits(rows)
    monkeypatch.setattr(secrets, "PIECE", 6000)
    assert np.allclose(parts, model.logits(rows))


def _secret(rng, alphabet, n):
    return "".join(rng.choice(list(alphabet), n))


def test_network_adds_planted_secrets_and_spares_words(docs):
    rng = np.random.default_rng(11)
    word = lambda n: "".join(rng.choice(["er", "tion", "an", "st", "lich", "ment"], n))
    mixed = string.ascii_letters + string.digits
    rows, planted = [], {}
    for k in range(400):
        quiet = " ".join(word(int(n)) for n in rng.integers(1, 12, 30))
        rows.append((k, f"{quiet} {word(9)} 4111{_secret(rng, string.digits, 12)}"))
    for k in range(400, 600):
        value = _secret(rng, mixed, 30) if k % 2 else _secret(rng, "0123456789abcdef", 40)
        rows.append((k, f"{word(3)} token = \"{value}\" {word(4)}"))
    for k in range(600, 660):
        value = _secret(rng, mixed, 24) if k % 2 else _secret(rng, "0123456789abcdef", 28)
        text = f"{word(3)} {word(2)} {value} {word(4)}"
        rows.append((k, text))
        planted[k] = f"model:{text.index(value)}:{text.index(value) + len(value)}"
    found = {r.doc_id: r for r in secrets.scan(docs(rows)).collect()}
    caught = sum(found[k].spans == s for k, s in planted.items())
    assert caught >= 0.9 * len(planted)
    assert sum(found[k].n_model > 0 for k in range(400)) <= 8
    assert all(found[k].n_assign == 1 for k in range(400, 600))


def test_counts_by_kind_of_several_findings(docs):
    texts = HARD + ["token=abcdefgh AKIA" + "A" * 14 + " " + " ".join(c * 40 for c in "abcdef") + " secret: abcdefghi"]
    found = secrets.scan(docs(list(enumerate(texts)))).collect()
    assert len(found) == len(texts)
    for r in found:
        want = [k for _, _, k in brute(texts[r.doc_id])]
        assert (r.n_assign, r.n_access, r.n_hex) == (want.count(0), want.count(1), want.count(2))


def _scored(spark, n=3000, seed=4):
    rng = np.random.default_rng(seed)
    secret = rng.random(n) < 0.2
    shape = rng.random(n) < 0.5
    x = rng.normal(0, 1.5, n) + np.where(secret, 3 - shape, -3)
    return secret, shape, x, spark.createDataFrame(list(zip(secret.tolist(), shape.tolist(), x.tolist())), "secret boolean, hexadecimal boolean, x double").repartition(5)


def test_calibration_reads_the_whole_fold(spark):
    secret, shape, x, scored = _scored(spark)
    model = secrets.Network.fresh()
    secrets.calibrate(model, scored, 0.25)
    n, m = secret.sum(), (~secret).sum()
    target = np.where(secret, (n + 1) / (n + 2), 1 / (m + 2))
    a, b = model.scale, model.shift - np.log(0.25 * m / n)
    away = secrets._logistic(a * x + b) - target
    assert abs((away * x).sum()) < 1e-2 and abs(away.sum()) < 1e-2
    p = secrets._logistic(model.scale * x + model.shift)
    for hexadecimal in (False, True):
        own = p[secret & (shape == hexadecimal)]
        highest = np.sort(own)[int((1 - secrets.RECALL) * len(own))]
        below = min(highest, np.sort(p[~secret])[int(np.ceil(secrets.RECALL * m)) - 1])
        assert below <= model.thresholds[hexadecimal] <= highest
        assert (own >= model.thresholds[hexadecimal]).mean() >= secrets.RECALL


def test_rounds_and_thresholds_take_every_candidate(docs, monkeypatch):
    rng = np.random.default_rng(17)
    rows = [(k, f"{_secret(rng, 'rstaeiou', 20)} token = \"{_secret(rng, string.ascii_letters + string.digits, 30)}\" {_secret(rng, 'lmno', 20)}") for k in range(150)]
    monkeypatch.setattr(secrets, "FIT_ROWS", 16)
    monkeypatch.setattr(secrets, "SLICE", 32)
    monkeypatch.setattr(secrets, "NUMBERED", 64)
    seen, told = [], []
    slopes, calibrate = secrets._slopes_of_all, secrets.calibrate

    def counted(slices, model, share, spare, k):
        found = slopes(slices, model, share, spare, k)
        if k == 0:
            seen.extend((r.before, r.value, r.after) for r in slices.selectExpr("inline(examples)").collect())
            # The same sums from one pass over all rows, moved as the slices move them.
            want = {name: 0 for name in found}
            for r in slices.collect():
                some = [(e.before, e.value, e.after) for e in r.examples]
                label = np.array([e.secret for e in r.examples])
                dice = np.random.default_rng([k, r.slice])
                shown = secrets._placed(some, label, dice, dice.random(len(some)) < 0.5, spare)
                each = model._slopes([secrets._codes(*x) for x in shown], label, np.where(label, share[True], share[False]))
                want = {name: want[name] + each[name] * len(some) for name in want}
            assert all(np.allclose(want[name], found[name], rtol=1e-9, atol=1e-12) for name in want)
        return found

    def asked(model, scored, odds):
        told.append(scored.count())
        calibrate(model, scored, odds)

    monkeypatch.setattr(secrets, "_slopes_of_all", counted)
    monkeypatch.setattr(secrets, "calibrate", asked)
    table = docs(rows)
    read = table.select(secrets._read("text").alias("__read"))
    every = {(r.before, r.value, r.after) for r in read.selectExpr("inline(__read.candidates)").collect()}
    assert secrets.fit(read) is not None
    assert len(every) == 450 and len(seen) == len(set(seen)) and set(seen) < every
    # Parts of 64 hold every fourth, rounded up, of each label.
    assert 450 / 4 <= told[0] <= 450 / 4 + 8 and told[0] + len(seen) == 450


def test_every_ordinary_run_of_the_fold_counts_for_the_threshold(spark):
    rng = np.random.default_rng(8)
    text, own, hidden = rng.normal(-8, 1.5, 2000), rng.normal(4, 1, 100), rng.normal(4, 1, 12)
    for missed in (hidden[:0], hidden):
        rows = [(False, False, float(v)) for v in (*text, *missed)] + [(True, False, float(v)) for v in own]
        model = secrets.Network.fresh()
        secrets.calibrate(model, spark.createDataFrame(rows, "secret boolean, hexadecimal boolean, x double").repartition(3), 0.05)
        at = (np.log(model.thresholds[0] / (1 - model.thresholds[0])) - model.shift) / model.scale
        # Not only those below the highest 2 %, and not the secrets that no rule found.
        assert abs(at - (np.sort(own)[2] + text.max()) / 2) < 1e-6


def test_calibration_reads_whole_values(docs, monkeypatch):
    rng = np.random.default_rng(23)
    values = [_secret(rng, string.ascii_letters + string.digits, 40 + 10 * k) for k in range(60)]
    rows = [(k, f"{_secret(rng, 'rstaeiou', 300)} token = \"{v}\"") for k, v in enumerate(values)]
    read_moved, lengths = secrets._read_moved, []

    def spied(slices, model, spare):
        lengths.extend(len(r.value) for r in slices.selectExpr("inline(examples)").collect())
        return read_moved(slices, model, spare)

    monkeypatch.setattr(secrets, "_read_moved", spied)
    assert secrets.fit(docs(rows).select(secrets._read("text").alias("__read"))) is not None
    assert max(lengths) > secrets.FIT_CHARS and lengths.count(300) == 15
