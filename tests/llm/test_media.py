import gzip
import hashlib
import io
import re
import struct
import zipfile
import zlib

from hypothesis import given, settings
from hypothesis import strategies as st

from chronoloom.llm import media
from chronoloom.llm.queries import op7_media


def png():
    def chunk(name, body):
        return struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0\0")) + chunk(b"IEND", b"")


def zipped():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a.txt", "hello")
    return out.getvalue()


GIF = b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0x80, 0, 0) + bytes(6) + b"\x2c" + struct.pack("<HHHHB", 0, 0, 1, 1, 0) + b"\x02\x02D\x01\x00" + b"\x3b"
GOOD = {"png": png(), "gif": GIF, "zip": zipped(), "gzip": gzip.compress(b"hello world" * 50), "pdf": b"%PDF-1.4\nx\n%%EOF", "wav": media.wav(b"\1\2\3\4"), "bmp": b"BM" + struct.pack("<IIII", 60, 0, 54, 40) + bytes(42)}


def segment(mark, body):
    return b"\xff" + bytes([mark]) + struct.pack(">H", len(body) + 2) + body


def riff(form, *chunks):
    body = form + b"".join(name + struct.pack("<I", len(x)) + x + bytes(len(x) & 1) for name, x in chunks)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def box(name, body=b""):
    return struct.pack(">I", 8 + len(body)) + name + body


def ogg_page(body, flags=0):
    return b"OggS\0" + bytes([flags]) + bytes(20) + bytes([1, len(body)]) + body


JPEG = b"\xff\xd8" + segment(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0") + b"\xff\xff" + segment(0xC0, bytes(15)) + segment(0xDA, bytes(10)) + b"\x11\xff\x00\x22\xff\xd9"
FLAC = b"fLaC" + struct.pack(">I", 34) + bytes(34) + struct.pack(">I", 0x84000000 | 8) + bytes(8) + b"\xff\xf8" + bytes(20)
GOOD |= {
    "jpeg": JPEG, "ogg": ogg_page(b"head", 2) + ogg_page(b"tail" * 9, 4), "mp4": box(b"ftyp", b"isom\0\0\2\0") + box(b"moov", box(b"mvhd", bytes(9))) + box(b"mdat", bytes(33)),
    "webp": riff(b"WEBP", (b"VP8 ", bytes(11))), "avi": riff(b"AVI ", (b"LIST", b"hdrl" + bytes(8)), (b"idx1", bytes(16))),
}


def test_jpeg_needs_a_frame_before_its_scan():
    no_frame = b"\xff\xd8" + segment(0xE0, bytes(14)) + segment(0xDA, bytes(10)) + b"\x11\xff\xd9"
    assert media.sniff(no_frame)[0] is None and media.sniff(JPEG)[0] == ("jpeg", len(JPEG), 2, len(JPEG) - 4)


def test_flac_ends_at_the_next_signature_or_the_value():
    assert media.sniff(FLAC)[0] == ("flac", len(FLAC), 54, len(FLAC) - 54)
    assert media.sniff(b"xx" + FLAC + b"rest")[1] == [("flac", 2, len(FLAC) + 4)]
    assert media.sniff(b"xx" + FLAC + GOOD["png"])[1] == [("flac", 2, len(FLAC)), ("png", 2 + len(FLAC), len(GOOD["png"]))]
    for cut in (b"fLaC" + bytes(60), FLAC[:20], FLAC[:46], FLAC[:54] + b"no frame", b"fLaC" + struct.pack(">I", 0x80000000 | 33) + bytes(33)):
        assert media.sniff(cut)[0] is None
    assert media.sniff(FLAC[:54])[0] == ("flac", 54, 54, 0)


def test_zip_whose_content_holds_end_records():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("b.bin", zipped() + b"PK\x05\x06" + bytes(18))
        z.writestr("c.txt", "more")
        z.comment = b"a comment"
    data = out.getvalue()
    assert media.sniff(data)[0] == ("zip", len(data), 0, len(data))
    assert media.sniff(b"__" + data + b"__")[1] == [("zip", 2, len(data))]
    bad = bytearray(zipped())
    bad[-12] ^= 1  # number of entries
    assert media.sniff(bytes(bad))[0] is None


def test_every_kind_is_recognised_and_carved():
    for kind, data in GOOD.items():
        own, inside = media.sniff(data)
        assert own[:2] == (kind, len(data)) and not inside
        own, inside = media.sniff(b"text before " + data + b" and after")
        assert own is None and inside == [(kind, 12, len(data))]
    together = b"..".join(GOOD.values())
    assert [k for k, _, _ in media.sniff(b"-" + together)[1]] == list(GOOD)


def test_magic_alone_is_not_enough():
    for magic in media.MAGICS:
        assert media.sniff(b"____" + magic + b" text") == (None, [])
    for data in GOOD.values():
        assert media.sniff(data[:-1])[0] is None
    broken = bytearray(GOOD["png"])
    broken[20] ^= 1
    assert media.sniff(bytes(broken))[0] is None


@settings(max_examples=150, deadline=None)
@given(st.binary(max_size=200), st.sampled_from(list(media.MAGICS)), st.binary(max_size=200))
def test_nothing_crashes(a, magic, b):
    media.sniff(a + magic + b)


@settings(max_examples=50, deadline=None)
@given(st.binary(max_size=300))
def test_wav_round_trip(samples):
    own, _ = media.sniff(media.wav(samples))
    assert own[0] == "wav" and media.wav(samples)[own[2] : own[2] + own[3]] == samples


def test_inspect(spark):
    rows = [(1, 9, "image/jpeg", GOOD["png"], 5), (2, 9, "Image/PNG; q=1", GOOD["png"], 5), (3, None, None, None, None), (None, 0, "text/plain", b"", 1), (4, 1, "text/plain", b"x%PDF-1.0%%EOF", 1), (4, 1, "text/plain", b"x%PDF-1.0%%EOF", 1)]
    df = spark.createDataFrame(rows, "doc_id long, n_bytes long, declared string, media binary, detected long")
    got = {r.doc_id: r for r in media.inspect(df).collect()}
    assert (got[1].detected, got[1].corrected, got[2].corrected) == ("image/png", True, False)
    assert got[3].body_bytes == 0 and got[3].detected == got[None].detected == media.UNKNOWN and got[None].sample_mean is None
    assert [tuple(e) for e in got[4].embedded] == [("pdf", 1, 13)]
    assert media.inspect(df).count() == 6 and media.inspect(df.limit(0)).count() == 0


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = op7_media(spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        raw = (texts[r.doc_id] or "").encode()
        payload = raw + b"\xff" * (-len(raw) % 576 or (0 if raw else 576))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        stored = b"RIFF" + struct.pack("<I", 36 + len(payload)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, 16000, 16000, 1, 8) + b"data" + struct.pack("<I", len(payload)) + payload
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
        inside = "|".join(f"{k}:{at}:{n}" for k, at, n in media.sniff(stored)[1])
        head, mean, tail = re.fullmatch(r"(.*) mean=([0-9.]+) (.*)", r.feature).groups()
        assert (head, tail) == (f"audio/wav corrected=true samples={len(payload)} blocks={len(payload) // 576}", f"embedded={inside}")
        assert abs(float(mean) - sum(payload) / len(payload)) < 1e-6  # Java rounds halves up


def test_empty_text_fills_one_block(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "x" * 576)], "doc_id long, text string")
    assert {r.doc_id: r.body_bytes for r in media.inspect(media.store_texts(df)).collect()} == {1: 576, 2: 576, 3: 576}
