"""Toxicity, mixing, pseudonyms, vectors, quotations and the pipeline against brute force, with awkward rows."""

import datetime
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidegrid.llm import components, hnsw, mixing, pii, queries, quotes, toxicity
from tests.llm.test_text import docs_of, line_rows, lines_by_hand, near_by_hand, prose, written

BAD = ["scoundrel", "blackguard", "knave", "rascal"]


# --- toxicity ----------------------------------------------------------------


def toxic_tables(n=1500):
    rng = random.Random(11)
    rows, labels = [], []
    for i in range(n):
        w = prose(rng, rng.choice((5, 30, 200))).split()
        toxic = rng.random() < 0.15
        for _ in range(rng.randint(2, 5) if toxic else 0):
            w.insert(rng.randrange(len(w)), rng.choice((str, str.upper))(rng.choice(BAD)) + rng.choice(("", ",", "!")))
        rows.append((i, " ".join(w)))
        if rng.random() < 0.8:
            labels.append((i, int(toxic)))
    truth = dict((i, any(b in t.lower() for b in BAD)) for i, t in rows)
    return rows, labels, truth


def test_toxicity_on_held_out_rows(spark, tmp_path):
    rows, labels, truth = toxic_tables()
    folder = written(spark, [*rows, (9000, None), (9001, ""), (None, "a knave and a rascal")], tmp_path, labels=([*labels, (None, 1), (9000, None)], "doc_id long, toxic int"))
    got = {r.doc_id: r for r in queries.op1_toxicity(spark, folder).collect()}
    assert len(got) == len(rows) + 3 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items() if i is not None) and got[None].held_out is False
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0]
    right = sum(got[i].predicted == truth[i] for i in held) / len(held)
    caught = sum(got[i].predicted for i in held if truth[i]) / sum(truth[i] for i in held)
    assert right > 0.97 and caught > 0.9
    assert got[9000].score == got[9001].score < 0.5


def test_held_out_labels_are_not_read(spark):
    rows, labels, _ = toxic_tables(400)
    turned = [(i, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, t in labels]
    fit = lambda x: toxicity.fit(docs_of(spark, rows), spark.createDataFrame(x, "doc_id long, toxic int"))
    a, b = fit(labels), fit(turned)
    assert a.bias == b.bias and (a.weights == b.weights).all()


def test_toxicity_of_repeated_rows(spark):
    """Held-out and unjudged texts do not shape the model; a repeated row counts once."""
    rows, labels, _ = toxic_tables(400)
    said = spark.createDataFrame(labels, "doc_id long, toxic int")
    fit = lambda r: toxicity.fit(docs_of(spark, r), said)
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    model = fit(rows)
    same = [fit([(i, "quite different" if held(i) else t) for i, t in rows]), fit([*rows, *[rows[1]] * 300, (None, "x")])]
    assert all(m.bias == model.bias and (m.weights == model.weights).all() for m in same)
    scored = toxicity.score(docs_of(spark, [rows[0]] * 3 + [(1, "long " * 400_000)]), model).collect()
    assert len(scored) == 4 and len({r.score for r in scored if r.doc_id == 0}) == 1 and all(0 <= r.score <= 1 for r in scored)


def test_toxicity_samples_are_bounded(spark):
    rows, labels, truth = toxic_tables(1500)
    docs, said = docs_of(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(docs, said, max_positive=100, max_unlabelled=500)
    again = toxicity.fit(docs.repartition(7), said.repartition(3), max_positive=100, max_unlabelled=500)
    assert model.bias == again.bias and (model.weights == again.weights).all()
    held = [r for r in toxicity.score(docs, model).collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert sum((r.score >= 0.5) == truth[r.doc_id] for r in held) / len(held) > 0.9


def test_toxicity_without_positives(spark):
    model = toxicity.fit(docs_of(spark, [(1, "x")]), spark.createDataFrame([(1, 0)], "doc_id long, toxic int"))
    out = toxicity.score(docs_of(spark, [(1, "x"), (2, None)]), model)
    assert out.columns == ["doc_id", "text", "key", "n", "bucket", "score"] and [r.score for r in out.collect()] == [0, 0]
    assert toxicity.score(docs_of(spark, []), model).count() == 0


def test_risk_is_prior_corrected():
    """A fifth of the unlabelled rows are positive; their feature still gets a large weight and neutral ones none."""
    rng = np.random.default_rng(0)
    neutral = lambda: rng.integers(10, 200, 20)
    pos = [np.unique(np.append(neutral(), 3)) for _ in range(300)]
    unl = [np.unique(np.append(neutral(), 3) if rng.random() < 0.2 else neutral()) for _ in range(2000)]
    m = toxicity.fit_risk(pos, unl, 0.2, 256)
    assert m.weights[3] > 3 and m.bias < -1 and np.abs(np.delete(m.weights, 3)).max() < m.weights[3] / 3


# --- mixing ------------------------------------------------------------------


def fill(total, children):
    """children: name, weight, cap. Shares by the slow way: full children leave one at a time."""
    share, left, open_ = {}, total, sorted(children, key=lambda c: (c[2] / c[1], c[0]))
    while open_ and open_[0][2] * sum(c[1] for c in open_) <= left * open_[0][1]:
        n, _, cap = open_.pop(0)
        share[n], left = cap, left - cap
    weight, run, before = sum(c[1] for c in open_), 0, 0
    for n, w, _ in open_:
        run += w
        share[n], before = left * run // weight - before, left * run // weight
    return share


def mixed_by_hand(rows, budget, epochs, weights, seed=0):
    """rows: doc_id, (domain, lang, source), tokens."""
    tokens = {}
    for _, leaf, n in rows:
        tokens[leaf] = tokens.get(leaf, 0) + n
    shares = {(): min(budget, epochs * sum(tokens.values()))}
    for depth, level in enumerate(mixing.LEVELS):
        new = {}
        for parent, total in shares.items():
            caps = {}
            for leaf, n in tokens.items():
                if leaf[:depth] == parent:
                    caps[leaf[depth]] = caps.get(leaf[depth], 0) + n * epochs
            for name, s in fill(total, [(c, weights.get(level, {}).get(c, 1), cap) for c, cap in caps.items()]).items():
                new[(*parent, name)] = s
        shares = new
    out = {}
    for leaf, n in tokens.items():
        q, rest = divmod(shares[leaf], max(n, 1))
        turn = lambda i: hashlib.md5(f"{seed}:{q}:{'' if i is None else i}".encode()).hexdigest()
        ahead = 0
        for i, _, k in sorted((r for r in rows if r[1] == leaf), key=lambda r: (turn(r[0]), r[2])):
            whole = rest > 0 and ahead + k <= rest
            out.setdefault((i, k), []).append((q + whole, 0 if whole else max(0, rest - ahead)))
            ahead += k
    return shares, {key: sorted(v) for key, v in out.items()}


@pytest.mark.parametrize("percent,epochs", [(100, 4), (60, 1), (500, 2), (0, 3)])
def test_mixing(spark, percent, epochs):
    rng = random.Random(9)
    names = [(d, la, s) for d in ("web", "books") for la in ("en", "de", None) for s in ("s1", "s2", "s3")]
    raw = [(i, *rng.choice(names[: 1 + i % len(names)]), prose(rng, rng.choice((0, 1, 7, 40)))) for i in range(600)] + [(3, "web", "en", "s1", "a b"), (None, "web", "en", "s1", None), (None, "web", "en", "s1", "x")]
    docs = spark.createDataFrame([(i, t, la, s, d, 1, 2) for i, d, la, s, t in raw], "doc_id long, text string, lang string, source string, d string, tokens int, share int")
    weights = {"domain": {"web": 1, "books": 5}, "lang": {"en": 7}, "source": {"s3": 3}}
    weighed = mixing.weigh(docs, F.col("d")).cache()
    rows = [(i, (d, la or "", s), len((t or "").split())) for i, d, la, s, t in raw]
    total = sum(n for *_, n in rows) * percent // 100
    shares, want = mixed_by_hand(rows, total, epochs, weights)
    assert sum(shares.values()) == min(total, epochs * sum(n for *_, n in rows))
    got = {}
    for r in mixing.mix(weighed, percent=percent, max_epochs=epochs, weights=weights).collect():
        got.setdefault((r.doc_id, r.n_tokens), []).append((r.copies, r.cut_tokens))
    assert {k: sorted(v) for k, v in got.items()} == want
    taken = sum(n * c + cut for (_, n), v in got.items() for c, cut in v)
    assert taken == sum(shares.values())
    assert mixing.mix(weighed.limit(0), percent=percent, max_epochs=epochs).count() == 0
    with pytest.raises(ValueError):
        mixing.mix(weighed, weights={"lang": {"en": 0}})


def test_descent_by_hand():
    """The same steps in plain loops: risk, its non-negative correction, and Adam with a soft threshold."""
    import math

    rng = random.Random(6)
    rows, n_pos, prior, shrink, rate, size = [sorted(rng.sample(range(6), rng.randint(1, 4))) for _ in range(14)], 5, 0.45, 0.002, 0.1, 6
    w, m, v, turned = [math.log(prior / (1 - prior))] + [0.0] * size, [0.0] * (size + 1), [0.0] * (size + 1), 0
    for t in range(1, 61):
        f = [w[0] + sum(w[1 + c] for c in r) for r in rows]
        sigmoid = [1 / (1 + math.exp(-x)) for x in f]
        minus = [math.log1p(math.exp(x)) for x in f]  # the loss of calling a row negative
        rest = sum(minus[n_pos:]) / (len(rows) - n_pos) - prior * sum(minus[:n_pos]) / n_pos
        turned += rest < 0
        g = [0.0] * (size + 1)
        for i, r in enumerate(rows):
            negative = -prior * sigmoid[i] / n_pos if i < n_pos else sigmoid[i] / (len(rows) - n_pos)
            slope = -negative if rest < 0 else negative - (prior * (1 - sigmoid[i]) / n_pos if i < n_pos else 0)
            for c in [0, *(1 + c for c in r)]:
                g[c] += slope
        for c in range(size + 1):
            m[c], v[c] = 0.9 * m[c] + 0.1 * g[c], 0.999 * v[c] + 0.001 * g[c] ** 2
            pace = rate / (math.sqrt(v[c] / (1 - 0.999**t)) + 1e-4)
            w[c] -= pace * m[c] / (1 - 0.9**t)
            if c:
                w[c] = math.copysign(max(0.0, abs(w[c]) - pace * shrink), w[c])
    of, column = (np.array(x) for x in zip(*((i, c) for i, r in enumerate(rows) for c in r), strict=True))
    got, bias = toxicity._descend(of, column, len(rows), n_pos, prior, shrink, 60, rate)
    assert np.allclose(got, w[1:]) and np.isclose(bias, w[0]) and turned


# --- pseudonyms --------------------------------------------------------------


def luhn(digits):
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def feistel_by_hand(a, b, big_a, big_b, key, tweak):
    for i in range(1, pii.ROUNDS + 1):
        half = b if i % 2 else a
        h = int(hashlib.sha256(f"{key}|{tweak}|{i}|{half}".encode()).hexdigest()[:15], 16)
        a, b = ((a + h) % big_a, b) if i % 2 else (a, (b + h) % big_b)
    return a, b


def test_pseudonyms(spark):
    rows = [
        (1, "card 4111 1111 1111 1111, again 4111111111111111; not 4111111111111112."), (2, "4111-1111-1111-1111"), (3, "born 1984-02-29 or 29.02.1984 or 1984/02/29, never 1983-02-29 nor 2300-01-01"),
        (4, "call +1 (743) 555-3824 or 743-555-3824"), (5, "ssn 123-45-6789, bad 000-12-3456 and 666-12-3456"), (6, "host 10.0.0.1 not 10.0.0.256 nor v1.2.3.4.5"), (7, None), (8, ""), (9, "plain text"), (11, "to Hein.19@mail5.example.com, é.a+1@x.org. or x@y, Hein.19@mail5.example.com"),
        (10, "x" * 200_000 + " 10.0.0.1"), (10, "10.0.0.1"), (None, "10.0.0.1é 10.0.0.1"),
    ]
    df = docs_of(spark, rows)
    out = pii.pseudonymise(df, "k1")
    assert out.columns == ["doc_id", "text", "key", "n", "bucket", "n_replaced"]
    got = {r.doc_id: r for r in out.where("doc_id <> 10").collect()}
    cards = re.findall(r"[0-9](?:[ -]?[0-9]){15}", got[1].text)
    flat = [c.replace(" ", "") for c in cards]
    assert flat[0] == flat[1] != "4" + "1" * 15 and luhn(flat[0]) and flat[2] == "4111111111111112" and got[1].n_replaced == 2 and re.fullmatch(r"card \d{4} \d{4} \d{4} \d{4}, again \d{16}; not \d{16}\.", got[1].text)
    assert got[2].text.replace("-", "") == flat[0]
    a, b = feistel_by_hand(4111111, 11111111, 10**7, 10**8, "k1", "card15")
    assert flat[0][:15] == f"{a:07d}{b:08d}"
    y, d, z = re.search(r"born (\S+) or (\S+) or (\S+),", got[3].text).groups()
    assert y == z.replace("/", "-") == "-".join(reversed(d.split("."))) and "1983-02-29" in got[3].text and "2300-01-01" in got[3].text and got[3].n_replaced == 3
    np.datetime64(y)
    phones = re.findall(r"\d", got[4].text.replace("+1", ""))
    assert phones[:10] == phones[10:] and got[4].n_replaced == 2
    assert got[5].n_replaced == 1 and "000-12-3456" in got[5].text and "666-12-3456" in got[5].text and "123-45-6789" not in got[5].text
    assert got[6].n_replaced == 1 and "10.0.0.256" in got[6].text and "v1.2.3.4.5" in got[6].text
    assert (got[7].text, got[8].text, got[9].text, got[9].n_replaced) == (None, "", "plain text", 0)
    first, second, third = re.search(r"^to (\S+), (\S+)\. or x@y, (\S+)$", got[11].text).groups()
    assert first == third != "Hein.19@mail5.example.com" and re.fullmatch(r"[A-Z][a-z]{3}\.\d\d@mail5\.example\.com", first) and re.fullmatch(r"é\.[a-z]\+\d@x\.org", second) and got[11].n_replaced == 3
    hosts = {r.text[-20:].split()[-1] for r in out.where("doc_id = 10").collect()}
    assert len(hosts) == 1 and hosts == {re.search(r"host (\S+) not", got[6].text)[1]}
    back = pii.pseudonymise(out.drop("n_replaced"), "k1", inverse=True)
    assert sorted((str(r.doc_id), str(r.text)) for r in back.collect()) == sorted((str(i), str(t)) for i, t in rows)
    other = pii.pseudonymise(df, "k2").where("doc_id = 2").first()
    assert other.text != got[2].text
    assert pii.pseudonymise(docs_of(spark, []), "k").count() == 0
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def email_by_hand(m, key):
    local, domain = m.split("@")
    half = len(local) // 2
    a, b = local[:half], local[half:]

    def shifted(x, digest):
        out = ""
        for i, c in enumerate(x):
            by = digest[i % 32]
            for first, size in (("a", 26), ("A", 26), ("0", 10)):
                if ord(first) <= ord(c) < ord(first) + size:
                    c = chr((ord(c) - ord(first) + by) % size + ord(first))
                    break
            out += c
        return out

    for i in range(1, pii.ROUNDS + 1):
        digest = hashlib.sha256(f"{key}|email|{len(local)}|{i}|{b if i % 2 else a}".encode()).digest()
        a, b = (shifted(a, digest), b) if i % 2 else (a, shifted(b, digest))
    return f"{a}{b}@{domain}"


def pseudonym_by_hand(kind, m, key):
    """The pseudonym of one valid value, in plain arithmetic."""
    digits = re.sub(r"\D", "", m)
    refill = lambda new: re.sub(r"\d", lambda _, it=iter(new): next(it), m)
    if kind == "email":
        return email_by_hand(m, key)
    if kind == "phone":
        local = digits[-10:]
        a, b = feistel_by_hand(int(local[:5]), int(local[5:]), 10**5, 10**5, key, "phone")
        return refill(digits[:-10] + f"{a:05d}{b:05d}")
    if kind == "ip":
        o = [int(x) for x in m.split(".")]
        a, b = feistel_by_hand(o[0] * 256 + o[1], o[2] * 256 + o[3], 1 << 16, 1 << 16, key, "ip")
        return f"{a >> 8}.{a % 256}.{b >> 8}.{b % 256}"
    if kind == "ssn":
        areas = [x for x in range(1, 900) if x != 666]
        area, group, serial = map(int, m.split("-"))
        a, b = feistel_by_hand(areas.index(area) * 99 + group - 1, serial - 1, 898 * 99, 9999, key, "ssn")
        return f"{areas[a // 99]:03d}-{a % 99 + 1:02d}-{b + 1:04d}"
    if kind == "date":
        form = "%d.%m.%Y" if "." in m else "%Y/%m/%d" if "/" in m else "%Y-%m-%d"
        zero = datetime.date(1800, 1, 1)
        day = (datetime.datetime.strptime(m, form).date() - zero).days
        a, b = feistel_by_hand(day // 773, day % 773, 189, 773, key, "date")
        return (zero + datetime.timedelta(a * 773 + b)).strftime(form)
    n = len(digits) - 1
    a, b = feistel_by_hand(int(digits[: n // 2]), int(digits[n // 2 : n]), 10 ** (n // 2), 10 ** (n - n // 2), key, f"card{n}")
    payload = f"{a:0{n // 2}d}{b:0{n - n // 2}d}"
    return refill(payload + next(c for c in "0123456789" if luhn(payload + c)))


def test_pseudonyms_by_hand(spark):
    """Random values of every kind, in running text, against plain arithmetic; and back."""
    rng = random.Random(3)
    number = lambda n: "".join(rng.choice("0123456789") for _ in range(n))

    def value(kind):
        if kind == "email":
            return "".join(rng.choice("abcxyzABC0189._%+-") for _ in range(rng.randint(1, 40))).lstrip("._%+-") + "q@mail.example.org"
        if kind == "phone":
            p = number(10)
            return rng.choice(("", "+1 ", "+1-")) + rng.choice((f"({p[:3]}) {p[3:6]}-{p[6:]}", f"{p[:3]}.{p[3:6]}.{p[6:]}", f"{p[:3]}-{p[3:6]}-{p[6:]}"))
        if kind == "ip":
            return ".".join(str(rng.choice((0, 9, 10, 99, 100, 255, rng.randrange(256)))) for _ in range(4))
        if kind == "ssn":
            return f"{rng.choice((1, 665, 667, 899)):03d}-{rng.choice((1, 50, 99)):02d}-{rng.choice((1, 5000, 9999)):04d}"
        if kind == "date":
            d = datetime.date(1800, 1, 1) + datetime.timedelta(rng.choice((0, 146_096, rng.randrange(146_097))))
            return d.strftime(rng.choice(("%Y-%m-%d", "%Y/%m/%d", "%d.%m.%Y")))
        payload = number(rng.randint(12, 18))
        whole = payload + next(c for c in "0123456789" if luhn(payload + c))
        return whole if rng.random() < 0.5 or len(whole) != 16 else "-".join(re.findall("....", whole))

    rows, want = [], {}
    for i in range(300):
        found = [(k, value(k)) for k in rng.choices(("email", "phone", "ip", "ssn", "date", "card"), k=rng.randint(1, 4))]
        glue = [rng.choice(("see ", "; and ", "\n", "(so) ")) for _ in found]
        rows.append((i, "".join(g + v + " end" for g, (_, v) in zip(glue, found, strict=True))))
        want[i] = "".join(g + pseudonym_by_hand(k, v, "key") + " end" for g, (k, v) in zip(glue, found, strict=True)), len(found)
    out = pii.pseudonymise(docs_of(spark, rows), "key")
    assert {r.doc_id: (r.text, r.n_replaced) for r in out.collect()} == want
    assert {r.doc_id: r.text for r in pii.pseudonymise(out, "key", inverse=True).collect()} == dict(rows)


def test_pseudonyms_of_long_texts(spark):
    """No pattern may recurse once a character or a repeated part."""
    n = 1_000_000
    texts = ["x@" + "a." * (n // 2), "x@" + "ab." * (n // 3), ">" * n, "1" * n, "1 " * (n // 2), "@" * n, "a@" * (n // 2), "1." * (n // 2), "." * n, "1-" * (n // 2)]
    rows = [(i, t + " 10.0.0.1") for i, t in enumerate(texts)]
    out = pii.pseudonymise(docs_of(spark, rows), "k").select("doc_id", F.length("text").alias("n"), "n_replaced").collect()
    assert sorted(r.doc_id for r in out) == list(range(len(texts))) and all(r.n_replaced >= 1 and r.n >= n - 2 for r in out)


def test_cards_beside_other_numbers(spark):
    card, odd = "4111 1111 1111 1111", "10.0.0.1 010.0.0.1"
    rows = [(1, f"{card} 42 items"), (2, f"12 {card}"), (3, f"{card} {card}"), (4, odd), (5, "3782 822463 10005")]
    got = {r.doc_id: r for r in pii.pseudonymise(docs_of(spark, rows), "k").collect()}
    assert [got[i].n_replaced for i in range(1, 6)] == [1, 1, 2, 1, 1] and all(card not in got[i].text for i in (1, 2, 3))
    assert got[1].text.endswith(" 42 items") and got[2].text.startswith("12 ") and got[4].text.endswith(" 010.0.0.1")
    back = pii.pseudonymise(docs_of(spark, [(i, r.text) for i, r in got.items()]), "k", inverse=True)
    assert {r.doc_id: r.text for r in back.collect()} == dict(rows)


def test_feistel_is_a_permutation(spark):
    days = spark.range(189 * 773)
    pair = pii.feistel(F.floor(F.col("id") / 773), F.col("id") % 773, F.lit(189), F.lit(773), "k", F.lit("date"))
    assert days.select(pair.alias("p")).where("p.a between 0 and 188 and p.b between 0 and 772").distinct().count() == 189 * 773


# --- vectors -----------------------------------------------------------------


def vectors_by_hand(rows, threshold=0.9):
    good = [(i, np.array(v, float) / np.abs(np.array(v, float)).max()) for i, v in rows if v and not any(x is None or not np.isfinite(x) for x in v) and any(v) and i is not None]
    links, root = {i: 0 for i, _ in good}, {i: i for i, _ in good}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(good)):
        for b in range(a):
            x, y = good[a][1], good[b][1]
            if len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= threshold:
                p, q = find(good[a][0]), find(good[b][0])
                root[max(p, q)] = min(p, q)
                links[good[a][0]] += 1
                links[good[b][0]] += 1
    return {i: (links.get(i, 0), find(i) if i in root else i) for i, _ in rows}


def vector_rows():
    rng = np.random.default_rng(12)
    rows = [(i, rng.normal(size=16).round(3).tolist()) for i in range(250)]
    for i in range(250, 420):
        base = np.array(rows[int(rng.integers(0, 40))][1])
        rows.append((i, (base + rng.normal(size=16) * rng.choice([0, 0.05, 0.3])).round(3).tolist()))
    rows += [(900, None), (901, []), (902, [0.0] * 16), (903, [1.0] * 15 + [None]), (904, [float("nan")] + [1.0] * 15), (905, [float("inf")] + [1.0] * 15), (906, [1.0, 2.0]), (907, [2.0, 4.0]), (908, [1e300] * 16), (909, [1e-300] * 16)]
    return rows


def test_vectors(spark):
    rows = vector_rows()
    df = spark.createDataFrame([(i, v, "x", 3) for i, v in rows], "vec_id long, embedding array<double>, rep string, shard int").repartition(5)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in hnsw.near_duplicates(df, min_shards=3).collect()}
    want = vectors_by_hand(rows)
    assert {i: v[:2] for i, v in got.items()} == want and all(k == (i == c) for i, (_, c, k) in got.items())
    assert hnsw.near_duplicates(df.limit(0)).count() == 0


def test_vectors_awkward_ids(spark):
    v = [1.0, 0.0]
    rows = spark.createDataFrame([(None, v), (2, v), (2, v), (1, v)], "vec_id long, embedding array<float>")
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in hnsw.near_duplicates(rows).collect()), key=str)
    assert got == [(1, 2, 1, True), (2, 2, 1, False), (2, 2, 1, False), (None, 0, None, True)]


@pytest.mark.parametrize("groups", [1, 40])
def test_graph_recall(groups):
    rng = np.random.default_rng(groups)
    centres = rng.normal(size=(groups, 24))
    v = centres[rng.integers(0, groups, 3000)] + rng.normal(size=(3000, 24)) * (0.15 if groups > 1 else 0.3)
    u = hnsw.units(v.ravel(), 24)
    a, b = hnsw.Graph(u).linked(u[:500], 0.9, 16)
    true = {(int(i), int(j)) for i, j in zip(*np.nonzero(u[:500] @ u.T >= 0.9))}
    found = set(zip(a.tolist(), b.tolist()))
    assert found <= true and len(found) == len(a) and len(found) >= 0.97 * len(true)


def test_audits_count_each_query_alike():
    """A hot group's links do not hide that lone pairs are missed, and a query is no link of its own."""
    rng = np.random.default_rng(2)
    v = np.concatenate([rng.normal(size=(1, 24)) + rng.normal(size=(1500, 24)) * 0.15, rng.normal(size=(1500, 24))])
    pairs = np.arange(1500, 3000, 3)
    v[pairs + 1] = v[pairs] + rng.normal(size=(len(pairs), 24)) * 0.02
    u = hnsw.units(v.ravel(), 24)
    graph, some = hnsw.Graph(u), np.arange(0, 3000, 4)
    ef, true, found = hnsw._audit(graph, u[some], some, 0.9, 0.99)
    near = u[some] @ u.T >= 0.9
    near[np.arange(len(some)), some] = False
    assert true == near.sum() and found <= true
    a, b = graph.linked(u[some], 0.9, ef)
    hit = np.bincount(a[some[a] != b], minlength=len(some))
    linked = near.sum(axis=1) > 0
    assert np.mean(hit[linked] / near.sum(axis=1)[linked]) >= 0.99
    assert hnsw._audit(graph, u[some[:0]], some[:0], 0.9, 0.99)[1:] == (0, 0)


def test_components(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(0, 200)] + [(1000, 1000 + i) for i in range(300)] + [(rng.randrange(2000, 3000), rng.randrange(2000, 3000)) for _ in range(500)] + [(7, 7), (None, 3)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            p, q = find(a), find(b)
            root[max(p, q)] = min(p, q)
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in list(root)}


# --- quotations --------------------------------------------------------------


def test_quotes(spark):
    rows = [
        (1, 0, "user", "Hello there\nHow are you?"), (1, 1, "bot", "On Monday, A wrote:\n> hello   THERE\n> how are you?\nFine"), (1, 2, "user", ">> Hello there\n> Fine\nGood"), (1, 3, "x", "> Fine\n> Good\n> Hello there\nMixed"),
        (1, 4, "x", "> nobody said this\nAlone"), (1, 5, "x", "> later words\nEarly"), (1, 6, "x", "later words"), (2, 0, "x", "> Hello there\nOther room"), (2, 1, None, None), (2, 2, "x", "> \n>\nBlank"), (None, 1, "x", "> a\nb"), (3, None, "x", "c"), (3, 1, "x", ""),
        (4, 0, "x", "say"), (4, 0, "y", "say too"), (4, 1, "x", "> say\nreply"),
        (6, 0, "x", "One fine line\nand the next\n\nLast part"), (6, 1, "y", "yes\nthanks\nsee you\nbye"), (6, 2, "x", "> thanks\n> yes\n> bye\n\n> one fine line\n> AND the next\nPassages before lines"), (6, 3, "y", "> and the next\n> thanks\n> bye\nCut"),
        (6, 4, "y", "> one fine line\n> and the next\n>\n> last part\n>> yes\nBoth"),
        (5, 0, "x", "deep words"), (5, 1, "y", "other"), (5, 2, "x", "> On Tue, A wrote:\n>> deep words\n>>> other\nok"),
    ]
    df = spark.createDataFrame([(*r, 1, "p") for r in rows], "conv_id long, turn long, role string, text string, depth int, parent string")
    got = {(r.conv_id, r.turn, r.role): (r.parent, r.root, r.depth, r.said) for r in quotes.link(df).collect()}
    assert got[1, 1, "bot"] == (0, 0, 1, "Fine") and got[1, 2, "user"] == (1, 0, 2, "Good") and got[1, 3, "x"] == (2, 0, 3, "Mixed")
    assert got[1, 4, "x"] == (None, 4, 0, "Alone") and got[1, 5, "x"] == (None, 5, 0, "Early") and got[2, 0, "x"] == (None, 0, 0, "Other room")
    assert got[2, 1, None] == (None, 1, 0, "") and got[2, 2, "x"] == (None, 2, 0, "Blank") and got[None, 1, "x"] == (None, 1, 0, "b") and got[3, None, "x"] == (None, None, 0, "c")
    assert got[4, 1, "x"] == (0, 0, 1, "reply") and len(got) == len(rows)
    assert got[5, 2, "x"] == (0, 0, 1, "ok")
    assert got[6, 2, "x"] == (0, 0, 1, "\nPassages before lines") and got[6, 3, "y"] == (1, 1, 1, "Cut") and got[6, 4, "y"] == (0, 0, 1, "Both")
    found = quotes.link(df).collect()
    place = {(r.conv_id, r.turn, r.role): r.position for r in found}
    assert [place[6, t, r] for t, r in ((0, "x"), (1, "y"), (2, "x"), (3, "y"), (4, "y"))] == [0, 0, 1, 1, 2] and place[None, 1, "x"] == place[3, None, "x"] == 0
    passages = {(r.conv_id, r.turn): [(p.level, p.n) for p in r.passages] for r in quotes.parse(df).where("conv_id = 6").collect()}
    assert passages[6, 0] == [(0, 2), (0, 1)] and passages[6, 2] == [(1, 3), (1, 2), (0, 1)] and passages[6, 4] == [(1, 2), (1, 1), (2, 1), (0, 1)]
    import duckdb

    con, plain = duckdb.connect(), [r for r in rows if r[0] is not None and r[1] is not None and r[0] != 4]
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", plain)
    for conv_id, root, turn, role, parent, depth, position, said in con.execute(f"SELECT conv_id, root, turn, role, parent, depth, position, said FROM ({queries.ORACLE_SQL['op8_quotes']})").fetchall():
        assert (*got[conv_id, turn, role], place[conv_id, turn, role]) == (parent, root, depth, said, position)
    chain = spark.createDataFrame([(9, i, "u", f"> word {i - 1}\nword {i}" if i else "word 0") for i in range(40)], "conv_id long, turn long, role string, text string")
    assert [(r.root, r.depth) for r in quotes.link(chain).orderBy("turn").collect()] == [(0, i) for i in range(40)]
    assert quotes.link(df.limit(0)).count() == 0
    n = 1_000_000
    long = [(1, 0, "u", "word"), (1, 1, "u", ">" * n + " word\nx"), (1, 2, "u", "> " * (n // 2) + "word"), (1, 3, "u", "> word\n" * 20_000 + "y"), (1, 4, "u", " \t" * (n // 2))]
    long = spark.createDataFrame(long, "conv_id long, turn long, role string, text string")
    assert [r.said for r in quotes.link(long).orderBy("turn").collect()] == ["word", "x", "", "y", " \t" * (n // 2)]
    assert "Python" not in quotes.parse(df)._jdf.queryExecution().executedPlan().toString()


# --- pipeline ----------------------------------------------------------------


def test_pipeline(spark, tmp_path):
    rows, labels, truth = toxic_tables(700)
    rng = random.Random(2)
    common = "a line that very many of the documents have in common"
    rows = [(i, t if i % 3 else f"{t}\n{common}") for i, t in rows]
    rows += [(5000 + i, rows[i][1] + " " + rng.choice(("tail", ""))) for i in range(100)] + [(8000, None), (8001, "")]
    full = [(i, t, "en" if (i or 0) % 3 else "de", f"src{(i or 0) % 7}", len(t or ""), "extra") for i, t in rows]
    docs = spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, more string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    at, seen = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, at, str(tmp_path))
        out.write.parquet(f"{tmp_path}/stage-{len(seen)}")
        at = spark.read.parquet(f"{tmp_path}/stage-{len(seen)}")
        seen[name] = at
        if name != "BPE":
            assert at.columns == docs.columns and [f.dataType for f in at.schema] == [f.dataType for f in docs.schema]
    text = {n: {r.doc_id: r.text for r in seen[n].collect()} for n in list(seen)[:4]}
    clean = text["toxicity"]
    first = dict(rows)
    assert all(first[i] == t for i, t in clean.items())
    bad = lambda t: any(b in (t or "").lower() for b in ("scoundrel", "blackguard", "knave", "rascal"))
    assert sum(bad(t) for t in clean.values()) <= 0.1 * sum(map(bad, first.values())) and sum(not bad(first[i]) for i in clean) >= 0.98 * sum(not bad(t) for t in first.values())
    lines = {i: t for i, *_, t in lines_by_hand(list(clean.items()))}
    assert text["line dedup"] == lines and all(r.n_chars == len(r.text) for r in seen["line dedup"].collect())
    near = near_by_hand(list(lines.items()))
    assert text["MinHash near-dedup"] == {i: t for i, t in lines.items() if near[i][1] == i}
    leaf = {i: (queries.DOMAINS[int(s[3:]) % 4], la, s) for i, _, la, s, *_ in full}
    kept = [(i, leaf[i], len(t.split())) for i, t in text["MinHash near-dedup"].items()]
    _, mixed = mixed_by_hand(kept, sum(n for *_, n in kept) * corpus_pipeline.MIX_PERCENT // 100, 1, queries.MIX_WEIGHTS)
    assert {*text["mixing"]} == {i for i, _, n in kept if not n or mixed[i, n][0] != (0, 0)}
    last = seen["BPE"].collect()
    assert {r.doc_id for r in last} == {*text["mixing"]} and all(r.restored and 4 * r.n_tokens == len(r.ids) for r in last)
    again = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted((r.doc_id, bytes(r.ids)) for r in again.collect()) == sorted((r.doc_id, bytes(r.ids)) for r in last)


def test_pipeline_near_copies_between_80_and_85_percent(spark, tmp_path):
    base = [f"w{j}" for j in range(104)]
    texts = [base, [*base[:20], "x", *base[21:50], "y", *base[51:]], [*base[:20], "p", *base[21:40], "q", *base[41:60], "r", *base[61:80], "s", *base[81:]]]
    docs = docs_of(spark, [(i, " ".join(t)) for i, t in enumerate(texts)])  # 90 of 110 shingles between 0 and 1, under 0.7 elsewhere
    out = corpus_pipeline.drop_near_duplicates(spark, docs, str(tmp_path))
    assert sorted(r.doc_id for r in out.collect()) == [0, 2]


def test_pipeline_of_nothing(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
