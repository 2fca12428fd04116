import hashlib
import json
import random
import struct
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lakeloom.llm import audio, chat


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=5000))
def test_bytes_come_back(data):
    media = audio.encode(data)
    payload, n, found = audio.decode(media)
    assert n == len(data) and payload[:n] == data and not any(payload[n:]) and len(payload) % 64 == 0 and payload
    assert found.bad_checksums == 0 and found.resyncs == 0
    assert found.vbr_frames == len(found.offsets) and found.samples == 1152 * len(found.offsets)
    for a in found.offsets:
        assert audio.read_header(media[a : a + 4]) is not None


def test_payload_full_of_false_sync_words_and_long_ones():
    for data in (b"\xff\xfa\xe4\xc0" * 3000, bytes(1 << 20), random.Random(1).randbytes(300_001)):
        payload, n, found = audio.decode(audio.encode(data))
        assert payload[:n] == data and found.resyncs == 0


def test_resynchronises_and_counts_wrong_checksums():
    media = bytearray(audio.encode(b"abc" * 2000))
    offsets = audio.scan_stream(bytes(media)).offsets
    junk = bytes(media[: offsets[2]]) + b"\x00\xff\x12junk\xff" * 5 + bytes(media[offsets[2] :])
    found = audio.scan_stream(junk)
    assert len(found.offsets) == len(offsets) and found.resyncs == 1
    media[offsets[1] + 5] ^= 1
    assert audio.scan_stream(bytes(media)).bad_checksums == 1
    assert audio.scan_stream(b"").offsets == [] and audio.scan_stream(b"\xff" * 50).offsets == []


def test_checksum_of_the_format():
    assert audio.crc16(b"") == 0xFFFF
    assert audio.crc16(b"123456789") == 0xAEE7  # polynomial 0x8005 from 0xFFFF, not reflected


def crc_of_bits(bits):
    crc = 0xFFFF
    for b in bits:
        crc = (crc << 1 ^ (0x8005 if (crc >> 15) ^ int(b) else 0)) & 0xFFFF
    return crc


@pytest.mark.parametrize(
    ("head", "covered"),
    [
        (b"\xff\xfe\x44\xc0", "0001" + "0" * 124),  # Layer I, mono: 32 allocations of 4 bits
        (b"\xff\xfe\x44\x50", "1" + "0" * 159),  # Layer I, joint stereo: 8 of both and 24 shared
        (b"\xff\xfc\x44\xc0", "0001" + "0" * 84 + "10"),  # Layer II, mono, 64 kbit/s at 48 kHz: 27 subbands, one selection
        (b"\xff\xfc\x14\xc0", "0000" * 2 + "000" * 5 + "011" + "01"),  # Layer II, mono, 32 kbit/s: 8 subbands
        (b"\xff\xf4\x84\xc0", "0" * 73 + "01" + "11"),  # version 2, Layer II, mono: 30 subbands
    ],
)
def test_checksums_of_layers_one_and_two(head, covered):
    bits = "".join(f"{b:08b}" for b in head[2:]) + covered
    body = int(covered.ljust(512, "0"), 2).to_bytes(64, "big")
    frame = (head + crc_of_bits(bits).to_bytes(2, "big") + body).ljust(audio.read_header(head).length, b"\0")[: audio.read_header(head).length]
    bad = frame[:6] + bytes([frame[6] ^ 64]) + frame[7:]
    assert audio.scan_stream(frame * 3).bad_checksums == 0
    assert audio.scan_stream(frame + bad + frame).bad_checksums == 1


def test_other_tags_and_tables():
    text = lambda name, body: name + len(body).to_bytes(4, "big") + b"\0\0" + body
    frames = text(b"TIT2", b"\x01" + "Tïtle".encode("utf-16")) + text(b"TPE1", b"\0Caf\xe9\0") + text(b"TXXX", b"\x01" + "k".encode("utf-16") + b"\0\0" + "v".encode("utf-16")) + text(b"APIC", b"\0x")
    tag = b"ID3\x03\0\0" + bytes([0, 0, len(frames) >> 7, len(frames) & 127]) + frames
    last = b"TAG" + b"Song".ljust(30, b"\0") + b"Band".ljust(30) + bytes(30) + b"1999" + b"note".ljust(28, b"\0") + b"\0\x07\x11"
    plain = b"\xff\xfb\x94\xc0".ljust(384, b"\0")
    table = (b"\xff\xfb\x94\xc0" + bytes(32) + b"VBRI" + bytes(6) + struct.pack(">IIHHHH", 1536, 3, 2, 1, 2, 1) + b"abcd").ljust(384, b"\0")
    found = audio.scan_stream(tag + table + plain * 3 + last)
    assert (len(found.offsets), found.samples, found.vbr_frames, found.vbr_bytes, found.vbr_toc) == (3, 3 * 1152, 3, 1536, b"abcd")
    v1 = {"title": "Song", "artist": "Band", "year": "1999", "comment": "note", "track": "7", "genre": "17"}
    assert found.tags == {"TIT2": "Tïtle", "TPE1": "Café", "k": "v"} | {f"id3v1.{k}": v for k, v in v1.items()}
    old = b"TT2\0\0\x04\0abc"
    assert audio.scan_stream(b"ID3\x02\0\0\0\0\0" + bytes([len(old)]) + old + plain * 2).tags == {"TT2": "abc"}


def test_media_query_columns(spark):
    texts = ["", None, "héllo\n" * 500, "a" * 64, "same", "same"]
    rows = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, media string")
    got = {r["doc_id"]: r for r in audio.index_media(audio.store_texts(rows)).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        padded = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"]) == (len(raw), len(padded))
        assert r["payload_sha256"] == hashlib.sha256(padded).hexdigest() and r["tail_crc32"] == zlib.crc32(padded[-64:])
        assert r["seconds"] == pytest.approx(len(r["seek_offsets"]) * 1152 / 48000)
    assert got[4]["media_sha256"] == got[5]["media_sha256"]
    assert audio.index_media(audio.store_texts(rows.limit(0))).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "", "a\nb", "[INST]", "\\"]), st.text(alphabet=st.sampled_from(list("ab\\\n<>/s[]INST é")), max_size=30)), max_size=6))
def test_template_is_reversible(turns):
    text = "".join(chat.write_turn(r, t) for r, t in turns)
    assert [(r, t) for r, t, _ in chat.read_turns(text)] == turns
    assert [t for r, t, masked in chat.read_turns(text) if masked] == [t for r, t in turns if r == "assistant"]


def test_broken_conversations_are_errors():
    for bad in ("<s>", "x", "[INST]user\nhi</s>", "<s>a</s>b", "[/INST]", "<s>a<s>b</s>"):
        with pytest.raises(ValueError):
            list(chat.read_turns(bad))


LAYOUTS = [
    ({"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": None}]}, [("user", "q"), ("assistant", "")]),
    ({"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]}, [("user", "q"), ("assistant", "a")]),
    ({"instruction": "do", "input": "it", "output": "ok"}, [("user", "do"), ("user", "it"), ("assistant", "ok")]),
    ({"instruction": "do", "input": "", "output": "ok", "extra": 3}, [("user", "do"), ("assistant", "ok")]),
    ({"prompt": "p", "completion": "c"}, [("user", "p"), ("assistant", "c")]),
    ({"question": "p", "answer": "c", "context": "x"}, [("system", "x"), ("user", "p"), ("assistant", "c")]),
    ({"role": "system", "text": "s"}, [("system", "s")]),
]


def test_layouts_become_canonical_turns(spark):
    rows = [(i, 0, json.dumps(r)) for i, (r, _) in enumerate(LAYOUTS)] + [(90, 0, "{broken"), (91, 0, None), (92, 0, "[1]"), (93, 0, '{"foo": {"bar": [1, {"x": null}]}}')]
    got = {}
    for r in chat.canonical_turns(spark.createDataFrame(rows, "conv_id long, turn long, record string")).orderBy("conv_id", "part").collect():
        got.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    for i, (_, want) in enumerate(LAYOUTS):
        assert got[i] == want
    assert all(got[i] == [("", "")] for i in (90, 91, 92, 93))
    same = {"messages": [{"content": "z", "role": "y"}] * 5}
    assert chat.fingerprint(same) == chat.fingerprint({"messages": [{"role": "a", "content": "b"}]})
    assert chat.fingerprint(same) != chat.fingerprint({"prompt": "a", "completion": "b"})


def test_conversations_are_read_back(spark):
    rows = [(1, 1, "assistant", "x<s>"), (1, 0, "user", None), (None, None, None, "n"), (2, 0, "assistant", "a"), (2, 0, "assistant", "a"), (2, 1, "assistant", "\\[INST]")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat.digest_conversations(chat.format_conversations(spark, df)).collect()}
    assert set(got) == {1, 2, None}
    assert got[1]["turns_sha256"] == hashlib.sha256(b"user\n\nassistant\nx<s>\n").hexdigest() and got[1]["loss_chars"] == 4
    assert got[2]["n_turns"] == 3 and got[2]["loss_sha256"] == hashlib.sha256(b"aa\\[INST]").hexdigest()
    assert got[None]["n_turns"] == 1 and got[None]["loss_chars"] == 0
    assert chat.digest_conversations(chat.format_conversations(spark, df.limit(0))).count() == 0
