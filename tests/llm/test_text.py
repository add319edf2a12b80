"""Line dedup, MinHash, BPE, winnowing and licences against brute force, with awkward rows."""

import hashlib
import json
import os
import random
import re
import textwrap

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegrid.llm import _text, bpe, licenses, linededup, minhash, queries, winnow

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WS = "\x20\x09\x0a\x0b\x0c\x0d"


def docs_of(spark, rows):
    """Extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], "doc_id long, text string, key string, n long, bucket int")


def test_result_columns_replace_those_of_the_table(spark):
    from tidegrid.llm import pii

    df = docs_of(spark, [(1, "a\nb"), (2, None)]).withColumns({"n_lines": F.lit("x"), "n_dropped": F.lit("y"), "n_replaced": F.lit("z")})
    lines = linededup.dedup_lines(df)
    assert lines.columns == ["doc_id", "text", "key", "n", "bucket", "n_replaced", "n_lines", "n_dropped"] and sorted(r.n_lines for r in lines.collect()) == [1, 2]
    out = pii.pseudonymise(df, "k")
    assert out.columns[-1] == "n_replaced" and {r.n_replaced for r in out.collect()} == {0}


def written(spark, rows, folder, **tables):
    spark.createDataFrame(rows, "doc_id long, text string").write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    for name, (data, schema) in tables.items():
        spark.createDataFrame(data, schema).write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    return str(folder)


def prose(rng, n, vocabulary=400):
    return " ".join(rng.choice(WORDS[:vocabulary]) for _ in range(n))


WORDS = ["".join(random.Random(i).choices("abcdefghijklmnopqrstuvwxyzéß", k=random.Random(i).randint(2, 9))) for i in range(2000)]


# --- line dedup --------------------------------------------------------------


def lines_by_hand(rows, min_chars=20, min_docs=3):
    keys = lambda t: [x.strip(WS).translate(LOWER) for x in t.split("\n")]
    holders = {}
    for i, t in rows:
        for k in keys(t or ""):
            if i is not None and len(k) >= min_chars:
                holders.setdefault(k, set()).add(i)
    gone = {k: max(v) for k, v in holders.items() if len(v) >= min_docs}
    out = []
    for i, t in rows:
        kept = [x for x, k in zip((t or "").split("\n"), keys(t or "")) if i is None or k not in gone or gone[k] == i]
        out.append((i, len((t or "").split("\n")), len((t or "").split("\n")) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def line_rows():
    rng = random.Random(4)
    pool = [prose(rng, 6) for _ in range(40)] + ["é" * 19, "é" * 20, "short"]
    rows = [(i, "\n".join(rng.choice(("", " ", "\t")) + rng.choice((str, str.upper, str.title))(rng.choice(pool)) + rng.choice(("", "\r", " \x0b")) for _ in range(rng.randint(0, 12)))) for i in range(120)]
    hot = "this line stands in very many documents of the table"
    rows += [(1000 + i, "\n".join([hot, f"own line of document number {i}", hot])) for i in range(300)]
    return rows + [(5000, None), (5001, ""), (5002, "\n\n"), (5003, "\n".join([hot] * 25_000)), (None, hot), (7, rows[7][1]), (8, "another text of eight, and long enough\n" + hot)]


@pytest.mark.parametrize("partitions", [1, 13])
def test_lines(spark, partitions):
    rows = line_rows()
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = linededup.dedup_lines(docs_of(spark, rows).repartition(5))
        got = sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in out.collect()), key=str)
        assert out.columns == ["doc_id", "text", "key", "n", "bucket", "n_lines", "n_dropped"]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == lines_by_hand(rows)
    assert linededup.dedup_lines(docs_of(spark, [])).count() == 0


def test_keep_bitmaps_are_bits(spark):
    import zlib

    text = "\n".join(["a line of twenty characters or more", "own"] * 5)
    got = linededup.keep_bitmaps(docs_of(spark, [(i, text) for i in range(3)])).orderBy("doc_id").collect()
    assert [(r.doc_id, r.n_dropped) for r in got] == [(0, 5), (1, 5)]
    bits = np.unpackbits(np.frombuffer(zlib.decompress(got[0].keep), np.uint8), bitorder="little")
    assert bits.tolist() == [0, 1] * 4 + [0] + [1] * 7


# --- shingles and MinHash ----------------------------------------------------


def shingle_set(text, k=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()


def near_by_hand(rows):
    sets = {i: shingle_set(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = [i for i in sorted(sets) if sets[i]]
    words = {g: j for j, g in enumerate({g for s in sets.values() for g in s})}
    has = np.zeros((len(ids), len(words)), np.float32)
    for row, i in enumerate(ids):
        has[row, [words[g] for g in sets[i]]] = 1
    common, size = has @ has.T, has.sum(axis=1)
    for a, b in np.argwhere(100 * common >= 85 * (size[:, None] + size - common)):
        p, q = find(ids[a]), find(ids[b])
        root[max(p, q)] = min(p, q)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def near_rows():
    rng = random.Random(8)
    rows = []
    for g in range(25):
        base = prose(rng, rng.choice((3, 5, 6, 12, 40, 150, 600))).split()
        for _ in range(rng.randint(1, 9)):
            w = list(base)
            for _ in range(rng.choice((0, 0, 1, 1, 2, 4))):
                w[rng.randrange(len(w))] = rng.choice(WORDS)
            rows.append((len(rows) * 3, rng.choice((" ", "\n", "  ")).join(w).title() if g % 2 else " ".join(w)))
    # A chain: each is near the next only.
    chain = prose(rng, 200).split()
    for step in range(8):
        chain = [rng.choice(WORDS) if j in range(step * 12, step * 12 + 9) else x for j, x in enumerate(chain)]
        rows.append((len(rows) * 3, " ".join(chain)))
    rows += [(9001, None), (9002, ""), (9003, " \n\t "), (9004, "one two"), (9005, "ONE  two"), (9006, "one two three")]
    return rows


def test_near_duplicates(spark):
    rows = near_rows()
    rng = random.Random(1)
    rng.shuffle(rows)
    got = minhash.near_duplicates(docs_of(spark, rows).repartition(6)).collect()
    want = near_by_hand(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want and len(got) == len(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_duplicates_just_below_the_threshold(spark):
    """Edited copies without their original, none like another, and one true link between two that meet the others least."""
    rng = random.Random(12)
    base, edits = rng.sample(WORDS, 600), []
    while len(edits) < 121:
        new = {*rng.sample(range(7, 590, 5), 6 if len(edits) < 120 else 8)}
        if all(len(new & e) < 3 for e in edits):
            edits.append(new)
    edits.append({*sorted(edits[-1])[1:], max(set(range(7, 590, 5)) - edits[-1])})
    rows = [((i + 60) % 122, " ".join(f"own{i}x{j}" if j in e else w for j, w in enumerate(base))) for i, e in enumerate(edits)]
    want = near_by_hand(rows)
    assert [i for i, (_, root) in want.items() if i != root] == [59]
    got = minhash.near_duplicates(docs_of(spark, rows).repartition(6), bins=4, rows=1).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want


def template_rows(n, further, seed):
    """Texts of one template, six words of each replaced, and some that differ from one of them by six further words."""
    rng = random.Random(seed)
    base = [rng.choice(WORDS) for _ in range(600)]

    def edited(words):
        out = list(words)
        for j in rng.sample(range(600), 6):
            out[j] = f"own{rng.randrange(10**9)}"
        return out

    texts = [edited(base) for _ in range(n)]
    texts += [edited(rng.choice(texts)) for _ in range(further)]
    ids = rng.sample(range(10 * len(texts)), len(texts))
    return [(i, " ".join(t)) for i, t in zip(ids, texts, strict=True)]


@pytest.mark.parametrize("seed, cell, size", [(11, 2048, 4 << 20), (4, 2048, 1 << 20), (5, 40, 1 << 17)])
def test_near_duplicates_of_a_template(spark, monkeypatch, seed, cell, size):
    """Most pairs lie just below the threshold; the blocks are many where cell and size are small."""
    rows = template_rows(300, 4, seed)
    monkeypatch.setattr(minhash, "_CELL", cell)
    monkeypatch.setattr(minhash, "_BYTES", size)
    want = near_by_hand(rows)
    assert 20 < len({c for _, c in want.values()}) < 250
    got = minhash.near_duplicates(docs_of(spark, rows).repartition(6)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want


def test_signatures_of_linking_pairs_agree():
    rng = np.random.default_rng(3)
    least = minhash.least_agreement(minhash.BINS, 80)
    assert 0.5 * minhash.BINS < least < 0.7 * minhash.BINS and minhash.least_agreement(4, 85) == 0
    for n in (9, 27, 90, 270, 900, 3000):
        for _ in range(150):
            pool = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1))
            cut = len(pool) // 10  # both lack another tenth: a similarity of 0.8
            x, y = (minhash.signature(pool[s]) for s in (slice(cut, None), slice(0, len(pool) - cut)))
            assert (x == y).sum() >= least


def test_near_duplicates_awkward(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (1, "quite another text that shares its id"), (None, "a b c d e f"), (4, "a b c d e f")]
    got = {(r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(docs_of(spark, rows)).collect()}
    assert got == {(1, 1, True), (None, None, True), (4, 1, False)}
    assert minhash.near_duplicates(docs_of(spark, [])).count() == 0


def test_one_long_text(spark):
    text = " ".join(f"w{i}" for i in range(300_000))
    got = minhash.near_duplicates(docs_of(spark, [(1, text), (2, text + " tail")])).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == {(1, 299_996, 1), (2, 299_997, 1)}


def test_signature_estimates_similarity():
    rng = np.random.default_rng(0)
    for n in (3, 40, 1000):
        hits = []
        for _ in range(60):
            x = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
            y = np.unique(np.concatenate([x[: len(x) * 2 // 3], rng.integers(0, 1 << 63, n // 3, dtype=np.uint64)]))
            true = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
            hits.append((minhash.signature(x) == minhash.signature(y)).mean() - true)
        assert abs(np.mean(hits)) < 0.06


def test_word_hashes_do_not_depend_on_chunks(monkeypatch):
    import pyarrow as pa

    texts = [prose(random.Random(i), i % 50) for i in range(200)] + ["", " x ", "\n"]
    whole = [s.tolist() for _, _, d, o in _text.chunks(pa.array(texts)) for s in _text.shingles(*_text.words(d, o), 5)]
    monkeypatch.setattr(_text, "CHUNK", 64)
    cut = [s.tolist() for _, _, d, o in _text.chunks(pa.array(texts)) for s in _text.shingles(*_text.words(d, o), 5)]
    assert whole == cut and [len(s) for s in whole] == [len(shingle_set(t)) for t in texts]


# --- BPE ---------------------------------------------------------------------


def bpe_texts():
    rng = random.Random(3)
    chars = [chr(i) for i in range(32, 127)] + list("äéñ漢字　\x85\xa0\x1c\x1f\t\n🎉ß٣½́")
    texts = ["".join(rng.choices(chars, k=rng.randint(0, 80))) for _ in range(1500)] + ["".join(rng.choices("abetionsrh", k=rng.randint(0, 40))) for _ in range(1500)]
    texts += ["a" * n for n in range(60)] + ["!" * n + "=" * n + " " * n for n in range(40)] + ["thein" * 4000, "", "<|endoftext|>", "x<|endoftext|> y<|endoftext|><|endoftext|>", "<|endoftext|", "don't I'LL we've"]
    return texts


def test_bpe_equals_the_library(spark):
    from tokenizers import Tokenizer

    path = queries.vocabulary()
    tok, texts = Tokenizer.from_file(path), bpe_texts()
    c = bpe.Codec(path)
    want = [np.array(e.ids, "<u4").tobytes() for e in tok.encode_batch(texts, add_special_tokens=False)]
    assert c.encode(texts) == want and c.encode(texts) == want
    assert [c.decode(w) for w in want] == [tok.decode(np.frombuffer(w, "<u4").tolist(), skip_special_tokens=False) for w in want] == texts
    assert not all(c.pairs.values())  # some words did fail and were merged exactly
    df = docs_of(spark, [*enumerate(texts), (None, None), (1, texts[1])])
    out = bpe.round_trip(df, path)
    assert out.columns == ["doc_id", "key", "n", "bucket", "ids", "decoded"]
    got = {r.doc_id: (bytes(r.ids), r.decoded) for r in out.collect()}
    assert all(got[i] == (want[i], t) for i, t in enumerate(texts)) and got[None] == (b"", "")
    back = bpe.decode(bpe.encode(df, path), path, text="again")
    assert back.where(F.coalesce("text", F.lit("")) != F.col("again")).isEmpty() and bpe.encode(df.limit(0), path).count() == 0


def test_bpe_cache_is_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "_CACHE", 50)
    c = bpe.Codec(queries.vocabulary())
    texts = bpe_texts()[:600]
    want = bpe.Codec(queries.vocabulary()).encode(texts)
    got = [x for i in range(0, 600, 7) for x in c.encode(texts[i : i + 7])]
    assert got == want and len(c.words) <= 50 and all(len(w) <= 64 for w in c.words)


# --- winnowing ---------------------------------------------------------------


def test_winnow_query(spark, tmp_path):
    rng = random.Random(6)
    rows = [(i * 2, prose(rng, rng.choice((0, 1, 3, 4, 11, 12, 50, 400)))) for i in range(900)]
    rows[5], rows[6], rows[7], rows[8] = (10, None), (12, "...!!"), (14, "漢🎉" * 9), (16, rows[20][1])
    got = {r.doc_id: r for r in queries.op9_winnow(spark, written(spark, rows, tmp_path)).collect()}
    assert len(got) == 900
    texts = [t or "" for _, t in sorted(rows)]
    for k, (i, _) in enumerate(sorted(rows)):
        t, after = texts[k], texts[(k + 1) % 900]
        m = len(t) // 4
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256((t[: len(t) - m] + after[:m]).encode()).hexdigest()
        assert 0 <= got[i].near_next <= 1 and 0 <= got[i].near_edited <= 1
        if len(t) > 1500:
            assert got[i].near_edited > 0.4 and got[i].near_next < 0.1
    by_text = {}
    for i, t in rows:
        by_text.setdefault(t or "", set()).add(got[i].fingerprint)
    assert all(len(v) == 1 for v in by_text.values())


def test_winnowing_guarantee_and_rightmost_ties(spark):
    w, k = winnow.WINDOW, winnow.K
    rng = random.Random(2)
    shared = prose(rng, w + k - 1)
    rows = [(i, f"{prose(rng, rng.randint(0, 30))} {shared} {prose(rng, rng.randint(0, 30))}") for i in range(30)] + [(90, "same " * 40)]
    df = winnow.winnowed(docs_of(spark, rows), "text", "p").select("doc_id", "p", winnow.hashes("p").alias("h")).collect()
    sets = {r.doc_id: set(r.h) for r in df}
    assert all(sets[0] & sets[i] for i in range(30))
    far = (1 << 31) - 1
    places = {r.doc_id: [far - (x & far) for x in r.p] for r in df}
    assert places[90] == list(range(w - 1, 40 - k + 1))  # all equal: the last of each window
    for r in df:
        assert places[r.doc_id] == sorted(set(places[r.doc_id]))


def test_winnow_awkward_ids(spark, tmp_path):
    rows = [(5, "b b b b b b b b"), (5, "a a a a a a a a"), (None, "c c c c"), (9, "d d d d d d d d")]
    got = sorted((str(r.doc_id), r.edited_sha256) for r in queries.op9_winnow(spark, written(spark, rows, tmp_path / "a")).collect())
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    # By (id, text); the last goes on with the first, and a null id with nothing.
    want = [("5", sha("a a a a a a b b")), ("5", sha("b b b b b b d d")), ("9", sha("d d d d d d a a")), ("None", sha("c c c "))]
    assert got == sorted(want)
    assert queries.op9_winnow(spark, written(spark, [], tmp_path / "b")).count() == 0


def test_bpe_refuses_other_kinds_of_files(tmp_path):
    with open(queries.vocabulary(), encoding="utf-8") as f:
        spec = json.load(f)
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"decoder": None}, {"model": spec["model"] | {"ignore_merges": True}}, {"model": spec["model"] | {"byte_fallback": True}}):
        path = tmp_path / "other.json"
        path.write_text(json.dumps(spec | change), encoding="utf-8")
        with pytest.raises(ValueError, match="asks for"):
            bpe.Codec(str(path))


# --- licences ----------------------------------------------------------------


def test_licenses(spark):
    mit = dict(licenses.REGISTRY[:1])["MIT"]
    variants = [
        mit, mit.upper(), re.sub(r"\s+", "  ", re.sub(r"(?m)^Copyright.*$", "", mit)), mit.replace('"', "“").replace("Copyright (c) <year> <holder>", "© 2020 Somebody"),
        mit.replace("sublicense", "sub-licence").replace("COPYRIGHT HOLDERS", "copyright owners").replace("NONINFRINGEMENT", "non-infringement"),
    ]
    rows = [*enumerate(variants), (10, mit + " and more"), (11, "prose\nReleased under the MIT License.\nLicensed under the Apache licence, version 2.0\n"), (12, None), (13, ""), (14, "?!"), (None, mit), (0, variants[0])]
    got = {(r.doc_id, r.license, r.notices) for r in licenses.scan(docs_of(spark, rows)).collect()}  # the third is one line, so a notice too
    assert got == {*((i, "MIT", "MIT" if i == 2 else "") for i in range(5)), (10, None, ""), (11, None, "Apache-2.0,MIT"), (12, None, ""), (13, None, ""), (14, None, ""), (None, "MIT", "")}
    assert licenses.scan(docs_of(spark, [])).count() == 0
    # Every licence of the registry, wrapped at several widths, under any title or none, and with British spellings.
    spelt = [(name, re.sub(r"\blicense", "licence", text.replace("organization", "organisation"))) for name, text in licenses.REGISTRY]
    known = [(i * 10 + j, name, "\n\n".join(textwrap.fill(x, width, break_on_hyphens=False) for x in text.split("\n\n"))) for i, (name, text) in enumerate(spelt) for j, width in enumerate((41, 60, 70, 78))]
    assert any(re.search(r"(?mi)^copyright (?:notice|holder)", text) for *_, text in known)
    got = {r.doc_id: r.license for r in licenses.scan(docs_of(spark, [(i, text) for i, _, text in known])).collect()}
    assert got == {i: name for i, name, _ in known}
    sql = f"SELECT doc_id, license, notices FROM ({queries.ORACLE_SQL['op2_license_scan']})"
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [(i, text) for i, _, text in known])
    assert {r[0]: r[1] for r in con.execute(sql).fetchall()} == got
    assert {name for name, *_ in licenses._FULL} >= {"MIT", "BSD-2-Clause", "BSD-3-Clause", "Apache-2.0", "Unlicense"}
    one = licenses.scan(docs_of(spark, [(1, "Be kind.")]), [("B", "be KIND"), ("A", "be, kind!")]).first()
    assert one.license == "A"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, sf_dir, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "conversations"):
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, sf_dir).toArrow(), con.execute(queries.ORACLE_SQL[name]).to_arrow_table()
    rows = lambda t: sorted(zip(*(map(str, t[c].to_pylist()) for c in sorted(t.column_names))))
    assert sorted(got.column_names) == sorted(want.column_names) and rows(got) == rows(want)


# --- winnowing by hand ---------------------------------------------------------


def long_hash(x, seed):
    import struct

    import xxhash

    return struct.unpack("<q", struct.pack("<Q", xxhash.xxh64_intdigest(x if isinstance(x, bytes) else struct.pack("<q", x), seed & (1 << 64) - 1)))[0]


def prints_by_hand(text, k=4, window=8):
    """(hash, position) of the smallest hash of each window of k-grams, the rightmost on ties; texts of k words at least."""
    import regex

    words = [long_hash(w.encode(), 42) for w in regex.findall(r"[\p{L}\p{N}]+", text.lower())]
    both = lambda a, b: long_hash(b, long_hash(a, 42))
    grams = [both(both(words[i], words[i + 1]), both(words[i + 2], words[i + 3])) & 0xFFFFFFFF for i in range(len(words) - k + 1)]
    chosen = []
    for b in range(max(1, len(grams) - window + 1)):
        least = min(grams[b : b + window])
        at = max(i for i in range(b, min(b + window, len(grams))) if grams[i] == least)
        if (least, at) not in chosen:
            chosen.append((least, at))
    return chosen


def test_fingerprints_by_hand(spark, tmp_path):
    rng = random.Random(31)
    rows = [(i * 2, prose(rng, rng.choice((9, 10, 11, 12, 40, 300)), rng.choice((3, 400)))) for i in range(60)] + [(500, "same words " * 50), (501, "Same, WORDS! " * 50)]
    got = {r.doc_id: r for r in queries.op9_winnow(spark, written(spark, rows, tmp_path)).collect()}
    shown = lambda f: " ".join(f"{h:X}:{i}" for h, i in f)
    for at, (i, text) in enumerate(rows):
        following = rows[(at + 1) % len(rows)][1]
        cut = len(text) // 4
        edited = text[: len(text) - cut] + following[:cut]
        own, other, ahead = prints_by_hand(text), prints_by_hand(edited), prints_by_hand(following)
        assert got[i].fingerprint == shown(own) and got[i].edited_fingerprint == shown(other)
        a, b, c = ({h for h, _ in f} for f in (own, other, ahead))
        assert got[i].near_edited == len(a & b) / len(a | b) and got[i].near_next == len(a & c) / len(a | c)
