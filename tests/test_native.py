"""Codec, files and the array API, without Spark."""

import hashlib
import os
import tarfile

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import tidegrid
from tidegrid import LegacyReader, LegacyWriter, Metadata, Reader, Writer, cache
from tidegrid.api import infer_precision
from tidegrid.functions import crypto
from tidegrid.model import CrcError, FormatError, PasswordError, SessionIOError, WriteConflictError
from tidegrid.sources import blocks as codec

T0, FS = 1_577_836_800_000_000, 256.0


def wave(n, scale=50.0, seed=0):
    t = np.arange(n)
    return scale * np.sin(2 * np.pi * t / 137) + np.random.default_rng(seed).normal(0, 0.05 * scale, n)


def test_crypto_vectors():
    key, plain = bytes(range(16)), bytes.fromhex("00112233445566778899aabbccddeeff")
    assert crypto.aes_ecb(plain, key, True).hex() == "69c4e0d86a7b0430d8cdb78070b4c55a"
    assert crypto.aes_ecb(crypto.aes_ecb(plain * 3, key, True), key, False) == plain * 3
    with pytest.raises(FormatError):
        crypto.aes_ecb(b"short", key, True)
    assert crypto._head(b"abc") == hashlib.sha256(b"abc").digest()[:16]
    # A second implementation of the checksum, bit by bit.
    state = crypto.CRC_START
    for byte in b"123456789" * 500:
        state ^= byte
        for _ in range(8):
            state = state >> 1 ^ (crypto.POLYNOMIAL if state & 1 else 0)
    data = b"123456789" * 500
    assert crypto.crc(data) == state == crypto.crc(data[1234:], crypto.crc(data[:1234]))
    assert crypto.crc_rows([data, b"", data[:7]]).tolist() == [state, crypto.CRC_START, crypto.crc(data[:7])]


def test_passwords():
    one, two = crypto.validation_fields("pass1", "pass2")
    assert [crypto.access(p, one, two).level for p in ("", "no", "pass1", "pass2")] == [0, 0, 1, 2]
    assert crypto.access("pass2", one, two).key1 == crypto.password_bytes("pass1")
    assert crypto.password_bytes("é") == "é".encode()[-1:].ljust(16, b"\0")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.one_of(st.integers(-300, 300), st.integers(-(2**31), 2**31 - 1)), max_size=60), min_size=1, max_size=6), st.booleans())
def test_blocks_round_trip(lists, secret):
    keys = crypto.access("b", *crypto.validation_fields("a", "b"))
    blocks = [codec.Block(np.array(x, np.int32), -T0, i % 2 == 0) for i, x in enumerate(lists)]
    raw = codec.encode(blocks, 2 if secret else 0, keys)
    back = codec.decode(raw, keys)
    assert all(len(r) % 8 == 0 for r in raw)
    assert [(b.samples.tolist(), b.discontinuity, b.start_time) for b in back] == [(b.samples.tolist(), b.discontinuity, b.start_time) for b in blocks]
    if secret and any(lists):
        with pytest.raises(PasswordError):
            codec.decode(raw)


#: Blocks whose last interval is so narrow that one digit more than its lower end lies beyond it.
NARROW = (
    [9883413, 6069909, 5763795, 5172779, 5193206, 5244945, 2047657, 4466279, 2730653, 8379045, 261916, 7494637, 319286, 7372887, 4857252, 5438106],
    [9038413, 7894832, 3274258, 3421999, 7894472, 9648781, 6337053, 7244494, 7710074, 3848525, 4039469, 2033490, 10009574, 1937024, 779187, 4670706],
    [10269219, 9203605, 4121674, 5772167, 6050062, 3982273, 368714, 5934821, 4062271, 9076533, 9159420, 6948388, 8420173, 1065107, 9667639, 5338916],
)


@pytest.mark.parametrize("copies", [1, 30])
def test_codes_that_end_in_a_narrow_interval(copies):
    raw = codec.encode([codec.Block(np.array(x, np.int32), -T0, False) for x in NARROW] * copies)
    assert [b.samples.tolist() for b in codec.decode(raw)] == [*NARROW] * copies
    # Whatever stands where the padding is, the last sample holds.
    for r in raw[: len(NARROW)]:
        kept = r.rstrip(bytes([codec.PAD]))
        for pad in (0, 255):
            assert codec.decode([kept + bytes([pad]) * (len(r) - len(kept))], check=False)[0].samples.tolist() in NARROW


def test_damaged_blocks():
    raw = codec.encode([codec.Block(wave(500).astype(np.int32), -T0, True)])[0]
    flipped = bytearray(raw)
    flipped[320] ^= 1
    with pytest.raises(CrcError):
        codec.decode([bytes(flipped)])
    for cut in (raw[:100], raw[:-8]):
        with pytest.raises(FormatError):
            codec.decode([cut])
    counters = bytearray(raw)
    counters[32:36] = (1 << 30).to_bytes(4, "little")
    with pytest.raises(FormatError):
        codec.decode([bytes(counters)], check=False)


@pytest.mark.parametrize("passwords", [("", ""), ("pass1", "pass2")])
def test_write_and_read(tmp_path, passwords):
    path = tmp_path / "s.mefd"
    x = wave(4000)
    x[500:700] = np.nan
    x[2000:2600] = np.nan
    with Writer(path, password1=passwords[0], password2=passwords[1]) as w:
        assert w.write("b", x, T0, FS, precision=3) == {"samples_written": 3200, "blocks": 3, "gaps_skipped": 2, "segment": 0}
        w.write_int32("a", np.arange(5), 0.5, T0 + 0.4, FS, valid=[1, 0, 1, 1, 1])
    r = Reader(path, passwords[1])
    assert r.channels == ["a", "b"]
    y = r.read("b")
    assert (np.isnan(x) == np.isnan(y)).all() and np.nanmax(np.abs(x - y)) <= 0.6e-3
    assert r.info("b")["number_of_samples"] == 3200 and r.info("b")["end_time"] - r.info("b")["start_time"] == 15_625_000
    raw = r.read_raw("a")
    assert raw["samples"].tolist() == [0, 0, 2, 3, 4] and raw["valid"].tolist() == [1, 0, 1, 1, 1]
    assert [len(x["samples"]) for x in r.read_runs("b")] == [500, 1300, 1400]
    middle = T0 + 1_000_000
    assert np.array_equal(np.concatenate([r.read("b", T0, middle), r.read("b", middle, T0 + 4_000_000)]), r.read("b", T0, T0 + 4_000_000), equal_nan=True)
    assert [len(r.read("b", *w)) for w in ((T0, T0), (T0 + 5, T0), (T0 - 1_000_000, T0))] == [0, 0, 256]
    assert np.array_equal(r.read("b", float(T0), np.int64(middle)), r.read("b", T0, middle), equal_nan=True)
    with pytest.raises(TypeError):
        r.read("b", "now")
    with pytest.raises(IndexError):
        r.read("zz")
    if passwords[0]:
        for wrong in ("", "nope"):
            with pytest.raises(PasswordError):
                Reader(path, wrong)
        assert Reader(path, "pass1").info("b")["section3_available"] is False


def test_one_password_is_refused(tmp_path):
    for p in (("a", ""), ("", "b")):
        with pytest.raises(PasswordError):
            Writer(tmp_path / "s.mefd", password1=p[0], password2=p[1])
    assert not (tmp_path / "s.mefd").exists()


def test_append(tmp_path):
    path = tmp_path / "s.mefd"
    w = Writer(path)
    w.write("c", wave(2000, 0.01), T0, FS)
    first = Reader(path).info("c")["units_conversion_factor"]
    end = Reader(path).info("c")["end_time"]
    assert w.write("c", wave(2000, 0.01, 1), end, FS)["segment"] == 0
    Writer(path).write("c", wave(2000, 0.02, 2), end + 7_812_500 + 5_000_000, FS)
    r = Reader(path)
    assert r.info("c")["units_conversion_factor"] == first and r.info("c")["number_of_samples"] == 6000 and r.info("c")["n_segments"] == 1
    y = r.read("c")
    assert len(y) == 7280 and np.flatnonzero(np.isnan(y)).tolist() == list(range(4000, 5280))
    assert len(r.read_runs("c")) == 3
    late = r.info("c")["end_time"]
    for bad in (dict(start_uutc=late - 100_000, fs=FS), dict(start_uutc=late, fs=512.0), dict(start_uutc=late, fs=FS, precision=1)):
        with pytest.raises(WriteConflictError):
            w.write("c", wave(100), **bad)
    assert Reader(path).info("c")["number_of_samples"] == 6000
    assert w.write("c", wave(100, 0.01), late + 86_400_000_000, FS, new_segment=True)["segment"] == 1
    rows = Reader(path).segments("c")
    assert [(x["segment"], x["start_sample"], x["number_of_samples"]) for x in rows] == [(0, 0, 6000), (1, 6000, 100)]
    sizes = {n: os.path.getsize(path / "c.timd" / "c-000000.segd" / f"c-000000.{n}") for n in ("tdat", "tidx", "tmet")}
    assert sizes["tmet"] == 16384 and sizes["tidx"] == 1024 + 56 * rows[0]["number_of_blocks"]
    data = (path / "c.timd" / "c-000000.segd" / "c-000000.tdat").read_bytes()
    assert crypto.crc(data[1024:]) == int.from_bytes(data[4:8], "little") and crypto.crc(data[4:1024]) == int.from_bytes(data[:4], "little")


def test_all_gaps_write_nothing(tmp_path):
    w = Writer(tmp_path / "s.mefd")
    assert w.write("c", np.full(500, np.nan), T0, FS) == {"samples_written": 0, "blocks": 0, "gaps_skipped": 0, "segment": 0}
    assert Reader(tmp_path / "s.mefd").channels == []


def test_counts_guard(tmp_path):
    w = Writer(tmp_path / "s.mefd")
    with pytest.raises(TypeError):
        w.write_int32("c", [1.5], 1.0, T0, FS)
    with pytest.raises(ValueError):
        w.write_int32("c", [2**31], 1.0, T0, FS)
    w.write_int32("c", [2**31 - 1, -(2**31)], 1.0, T0, FS)
    assert Reader(tmp_path / "s.mefd").read_raw("c")["samples"].tolist() == [2**31 - 1, -(2**31)]
    with pytest.raises(ValueError):
        w.write("d", [1e9, 2e9], T0, FS, precision=3)


def test_fractional_rate(tmp_path):
    x = wave(2000)
    Writer(tmp_path / "s.mefd", block_length=100).write("c", x, T0, 512.5, precision=3)
    r = Reader(tmp_path / "s.mefd")
    assert r.info("c")["end_time"] - T0 == 3_902_439 and len(r.toc("c")) == 20
    assert np.abs(r.read("c") - x).max() <= 0.6e-3


def test_precision_rule():
    for scale in (0.01, 0.1, 1, 10, 100):
        x = np.random.default_rng(5).normal(0, scale, 1000)
        p = infer_precision(x)
        step = np.abs(np.diff(x)).mean()
        assert step * 10**p >= 1000 > step * 10 ** (p - 1)
    assert infer_precision([np.nan, np.nan]) == 0 and infer_precision([4.0, 4.0]) == 0
    assert infer_precision([1.0, np.nan, 1e-9]) == 0


def test_records(tmp_path):
    for i, passwords in enumerate((("", ""), ("p", "q"))):
        path = tmp_path / f"s{i}.mefd"
        w = Writer(path, password1=passwords[0], password2=passwords[1])
        w.write("c", wave(100), T0, FS)
        w.write_annotations([{"time": T0 + 2.6, "text": "two"}, {"time": T0, "type": "EDFA", "text": "é", "duration": 5e5}, {"time": T0 + 1, "type": "Odd"}])
        w.write_annotations([{"time": T0 + 9, "text": "own"}], "c")
        w.write_annotations([], "c")
        r = Reader(path, passwords[1])
        got = r.records()
        assert [(x["time"], x["type"], x.get("text"), x.get("duration")) for x in got] == [(T0, "EDFA", "é", 500_000), (T0 + 1, "Odd", None, None), (T0 + 3, "Note", "two", None)]
        assert [x["text"] for x in r.records("c")] == ["own"] and r.records("none") == []


def test_metadata(tmp_path):
    meta = Metadata()
    meta.subject.id, meta.acquisition.low_frequency_filter, meta.subject.gmt_offset = "S1", 0.5, 3600
    Writer(tmp_path / "s.mefd", metadata=meta, password1="a", password2="b").write("c", wave(10), T0, FS)
    back = Reader(tmp_path / "s.mefd", "b").metadata
    assert back.subject == meta.subject and back.acquisition.low_frequency_filter == 0.5 and back.acquisition.channel_description == "c"
    masked = Reader(tmp_path / "s.mefd", "a")
    assert masked.info("c")["subject_id"] is None and masked.metadata.subject == Metadata().subject
    Writer(tmp_path / "t.mefd", metadata={"subject_ID": b"S2", "notch_filter": 50.0}).write("c", wave(10), T0, FS)
    plain = Reader(tmp_path / "t.mefd").metadata
    assert plain.subject.id == "S2" and plain.acquisition.notch_filter == 50.0


def test_archives(tmp_path):
    path = tmp_path / "s.mefd"
    w = Writer(path)
    w.write("c" * 120, wave(3000), T0, FS)
    w.write_annotations([{"time": T0, "text": "x"}])
    tar = tidegrid.archive_session(path)
    first = open(tar, "rb").read()
    tidegrid.archive_session(path, overwrite=True)
    assert open(tar, "rb").read() == first
    a, b = Reader(path), Reader(tar)
    assert np.array_equal(a.read("c" * 120), b.read("c" * 120)) and a.records() == b.records() and a.info("c" * 120) == b.info("c" * 120)
    assert "::" in b.segments("c" * 120)[0]["path"]
    out = tidegrid.extract_session(tar, tmp_path / "o.mefd")
    assert np.array_equal(Reader(out).read("c" * 120), a.read("c" * 120))
    for call in (lambda: tidegrid.archive_session(path), lambda: tidegrid.extract_session(tar, out), lambda: tidegrid.archive_session(path, path / "in.mefd.tar"), lambda: Writer(tar), lambda: Writer(tmp_path / "plain"), lambda: Reader(tmp_path / "none.mefd")):
        with pytest.raises(SessionIOError):
            call()
    packed = tmp_path / "z.mefd.tar"
    packed.write_bytes(b"\x1f\x8b" + bytes(600))
    with pytest.raises(FormatError):
        Reader(packed)
    evil = tmp_path / "e.mefd.tar"
    with tarfile.open(evil, "w") as t:
        t.add(__file__, "../evil.txt")
    with pytest.raises(FormatError):
        tidegrid.extract_session(evil)
    assert not (tmp_path / "e.mefd").exists()


@pytest.mark.parametrize("name,error", [("tmet", (CrcError, FormatError)), ("tidx", FormatError), ("tdat", FormatError)])
def test_damaged_files_raise(tmp_path, name, error):
    path = tmp_path / "s.mefd"
    Writer(path).write("c", wave(6000), T0, FS)
    f = path / "c.timd" / "c-000000.segd" / f"c-000000.{name}"
    f.write_bytes(f.read_bytes()[:-60])
    with pytest.raises(error):
        Reader(path).read("c")
    if name == "tmet":
        whole = bytearray(f.read_bytes() + bytes(60))
        whole[9000] ^= 1
        f.write_bytes(bytes(whole))
        with pytest.raises(CrcError):
            Reader(path)


def test_incomplete_segments_are_left_out(tmp_path):
    path = tmp_path / "s.mefd"
    w = Writer(path)
    w.write("c", wave(100), T0, FS)
    w.write("d", wave(100), T0, FS)
    (path / "d.timd" / "d-000000.segd" / "d-000000.tidx").unlink()
    assert Reader(path).channels == ["c"]


def test_cache(tmp_path, monkeypatch):
    monkeypatch.setenv("XDG_CACHE_HOME", str(tmp_path / "home"))
    path, where = tmp_path / "s.mefd", tmp_path / "snap.json"
    w = Writer(path, metadata={"subject_id": "secret"})
    w.write("c", wave(100), T0, FS)
    plain = Reader(path, cache=where)
    assert "secret" not in where.read_text()
    warm = Reader(path, cache=where)
    assert warm._session is None and warm.info("c")["number_of_samples"] == 100 and warm.info("c")["subject_id"] is None
    assert np.array_equal(warm.read("c"), plain.read("c"))
    w.write("c", wave(100), T0 + 1_000_000, FS)
    assert Reader(path, cache=where).info("c")["number_of_samples"] == 200
    Reader(path, cache="auto")
    assert cache.place(str(path), "auto").exists()
    Writer(path)
    assert not cache.place(str(path), "auto").exists()
    where.write_text("{broken")
    assert Reader(path, cache=where).info("c")["number_of_samples"] == 200


def test_legacy_shapes(tmp_path, capsys):
    w = LegacyWriter(tmp_path / "s.mefd", overwrite=True)
    w.data_units, w.mef_block_len, w.section3_dict["subject_ID"] = "mV", 64, b"S9"
    x = wave(300)
    x[100:150] = np.nan
    assert w.write_data(x, "b", T0, FS, precision=2) and w.write_data(np.arange(10), "a", T0, FS, precision=1)
    w.write_annotations([{"time": T0, "text": "hi"}])
    r = LegacyReader(tmp_path / "s.mefd")
    assert r.channels == ["a", "b"] and r.get_property("fsamp") == [FS, FS] and r.get_property("ufact", "a") == 0.1 and r.get_property("nsamp", "zz") is None
    assert r.properties == sorted(r.bi[0]) and r.get_channel_info("b")["unit"] == [b"mV"] and r.get_annotations()[0]["text"] == "hi"
    assert np.allclose(r.get_data("b"), x, atol=0.006, equal_nan=True) and isinstance(r.get_data(["a"]), list)
    got = r.get_data(["b", "zz", 0, "b"])
    assert [len(g) for g in got] == [300, 10] and np.allclose(got[1], np.arange(10) * 0.1)
    with pytest.raises(ValueError):
        r.get_raw_data("zz")
    assert w.get_mefblock_len(FS) == 64 and LegacyWriter(tmp_path / "t.mefd").get_mefblock_len(5000.0) == 5000
    (tmp_path / "s.mefd" / "s.rdat").write_bytes(b"short")
    assert LegacyReader(tmp_path / "s.mefd").get_annotations() is None and "WARNING" in capsys.readouterr().out


#: Shapes of published sessions: rate, gap, span in microseconds, grid length, factor, precision, further segment, passwords.
SHAPES = {
    "plain": (256.0, None, 7_812_500, 2000, 0.001, 3, False, ("", "")),
    "long gap": (256.0, (800, 1400), 7_812_500, 2000, 0.001, 3, False, ("", "")),
    # Published with 7,812,500, by a writer that stores short gaps inside a block; a real gap rounds its second run's start and length apart.
    "short gap": (256.0, (1000, 1010), 7_812_501, 2000, 0.001, 3, False, ("", "")),
    "two segments": (256.0, None, 16_625_000, 4256, 0.001, 3, True, ("", "")),
    "coarse": (256.0, None, 7_812_500, 2000, 0.01, 2, False, ("", "")),
    "locked": (256.0, None, 7_812_500, 2000, 0.001, 3, False, ("pass1", "pass2")),
    "fractional rate": (512.5, None, 3_902_439, 2000, 0.001, 3, False, ("", "")),
}


@pytest.mark.parametrize("shape", SHAPES)
def test_published_shapes(tmp_path, shape):
    fs, gap, length, n, factor, precision, further, passwords = SHAPES[shape]
    i = np.arange(2000)
    x = 50 * np.sin(2 * np.pi * i / 137) + 15 * np.sin(2 * np.pi * i / 31) + np.random.default_rng(20260702).normal(0, 2.5, 2000)
    if gap:
        x[gap[0] : gap[1]] = np.nan
    w = Writer(tmp_path / "s.mefd", password1=passwords[0], password2=passwords[1])
    w.write("ch1", x, T0, fs, precision=precision)
    if further:
        w.write("ch1", x, T0 + 7_812_500 + 1_000_000, fs, precision=precision, new_segment=True)
    w.write_annotations([{"time": T0 + 100_000, "text": "onset"}, {"time": T0 + 500_000, "text": "offset"}])
    r = Reader(tmp_path / "s.mefd", passwords[1])
    info, got = r.info("ch1"), r.read("ch1")
    assert (info["start_time"], info["end_time"] - info["start_time"], info["sampling_frequency"]) == (T0, length, fs)
    assert len(got) == n and np.isclose(info["units_conversion_factor"], factor, rtol=1e-12)
    assert np.allclose(got[:2000], x, atol=factor * 0.51, equal_nan=True) and np.isnan(got[2000:2256]).all()
    assert len(r.segments("ch1")) == 1 + further and [(a["time"] - T0, a["text"]) for a in r.records()] == [(100_000, "onset"), (500_000, "offset")]
    if further:
        assert np.allclose(got[2256:], x, atol=factor * 0.51)


def test_backends(tmp_path):
    Writer(tmp_path / "s.mefd").write("c", wave(10), T0, FS)
    assert len(Reader(tmp_path / "s.mefd", "", "cpp").read("c")) == 10
    with pytest.raises(ValueError):
        Reader(tmp_path / "s.mefd", backend="other")
