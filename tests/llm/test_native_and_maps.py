"""Line dedup, packing, personal data, exact dedup and media columns against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tracewell.llm import media, pii
from tracewell.llm.exact_dedup import drop_exact, exact_groups
from tracewell.llm.line_dedup import dedup_lines
from tracewell.llm.packing import Encoder, Packer, pack
from tracewell.llm.common import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SPACE = " \t\n\x0b\x0c\r"


def lower(s):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in s)


def docs(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", "s", 0) for i, t in zip(ids, texts)], SCHEMA)


TEXTS = ["Same line here\nother one that stays\n\n", "  SAME line here\t\nx\nshort", None, "", "same line here\nsame line here", "É same LINE here\n" * 3, "a\r\nlong enough line\r", "long enough line", "z" * 50_000 + "\nsame line here"]


def line_truth(rows):
    held = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            held[lower(line.strip(SPACE))].add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(k := lower(x.strip(SPACE))) >= 10 and len(held[k]) > 1 and i != min(held[k]))]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out)


def test_line_dedup(spark):
    rows = list(enumerate(TEXTS))
    df = docs(spark, TEXTS).withColumnRenamed("source", "row_key").withColumnRenamed("lang", "Pos")
    out = dedup_lines(df)
    assert out.columns[:5] == df.columns
    assert sorted((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in out.collect()) == line_truth(rows)


def test_line_dedup_of_clashing_columns(spark):
    df = docs(spark, ["a line of text"] * 2).selectExpr("doc_id", "text", "'x' as n_lines", "'y' as N_Dropped", "7 as line_row", "8 as line_row_of", "9 as row_key_", "1 as sh", "2 as line_dropped")
    out = dedup_lines(df)
    assert out.columns == [*df.columns, "_n_lines", "_n_dropped"]
    assert sorted((r.doc_id, r.n_lines, r.N_Dropped, r.line_row, r._n_lines, r._n_dropped, r.text) for r in out.collect()) == [(0, "x", "y", 7, 1, 0, "a line of text"), (1, "x", "y", 7, 1, 1, "")]


def test_line_dedup_repeated_rows_null_ids_and_threshold(spark):
    df = docs(spark, ["a line of text", "a line of text", "a line of text"], [3, 3, None])
    out = sorted((r.doc_id is None, r.n_dropped, r.text) for r in dedup_lines(df).collect())
    assert out == [(False, 0, "a line of text"), (False, 0, "a line of text"), (True, 1, "")]
    three = dedup_lines(docs(spark, ["a line of text"] * 2 + ["b line of text"] * 3), min_docs=3)
    assert sorted((r.doc_id, r.n_dropped) for r in three.collect()) == [(0, 0), (1, 0), (2, 0), (3, 1), (4, 1)]
    assert dedup_lines(docs(spark, [])).count() == 0


def test_exact_groups(spark):
    texts = ["Ab", "aB", "É", "é", None, "", "ab ", "x" * 100_000, "X" * 100_000]
    groups = defaultdict(list)
    for i, t in enumerate(texts):
        groups[lower(t or "")].append(i)
    want = sorted((i, max(g), len(g), i == max(g), hashlib.sha256(k.encode()).hexdigest()) for k, g in groups.items() for i in g)
    df = docs(spark, texts).withColumnRenamed("source", "h").withColumnRenamed("lang", "norm")
    assert sorted(tuple(r) for r in exact_groups(df, keep="max").collect()) == want
    assert sorted(r.doc_id for r in drop_exact(df).collect()) == sorted(min(g) for g in groups.values())
    assert exact_groups(docs(spark, [])).count() == 0
    odd = docs(spark, ["q", "q", "r", "r"], [None, None, 7, 7])
    assert sorted((r.doc_id is None, r.keep_id, r.group_size, r.kept) for r in exact_groups(odd).collect()) == [(False, 7, 2, True)] * 2 + [(True, None, 2, True)] * 2


@pytest.fixture(scope="module")
def enc():
    return Encoder(tokenizer_path())


WORDS = st.lists(st.one_of(st.sampled_from(["Hello", "it's", "'ll", "don't", "x'sy", "42", "3.14", "é", "Straße", "ŒUVRE", "日本", "<|endoftext|>", "<|x", "½", "²", "\x1c", "\xa0", "\x85", "é", "''s", "İ", "—", "a_b", "µ", "ª"]), st.text(max_size=8)), max_size=12)


@settings(max_examples=150, deadline=None)
@given(words=WORDS, gap=st.sampled_from([" ", "\n", "", "\t ", "\x0b"]))
def test_encoder_is_the_library(enc, words, gap):
    text = gap.join(words).encode("utf-8", "ignore").decode()
    assert np.frombuffer(enc.encode([text])[0], "<u4").tolist() == enc.tokenizer.encode(text, add_special_tokens=False).ids


@settings(max_examples=60, deadline=None)
@given(lengths=st.lists(st.one_of(st.integers(1, 90), st.integers(1, 700)), max_size=120), early=st.integers(1, 40))
def test_packer_loses_and_pads_nothing(lengths, early):
    p = Packer(64, 8)
    out = []
    for i, n in enumerate(lengths):
        p.add(i, n)
        if i % early == 0:
            p.close()
            out += p.pieces()
    p.finish()
    out += p.pieces()
    got, sequences = defaultdict(list), defaultdict(list)
    for d, s, n, q, o in out:
        got[d].append((s, n))
        sequences[q].append((o, n))
    for i, n in enumerate(lengths):
        at = 0
        for s, m in sorted(got[i]):
            assert s == at and m > 0
            at += m
        assert at == n
    for parts in sequences.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 64 and at & (at - 1) == 0
    assert p.held == 0


def test_packer_cuts_few_documents():
    rng = random.Random(1)
    p = Packer()
    lengths = [int(rng.lognormvariate(6.5, 1)) + 1 for _ in range(5000)]
    for i, n in enumerate(lengths):
        p.add(i, n)
        if p.held > 1 << 20:
            p.close()
    p.finish()
    needed = sum(-(-n // 4096) for n in lengths)
    assert len(p.pieces()) < 1.3 * needed


def test_pack(spark):
    texts = ["Some words here. " * 900, None, "", "tiny", "é日本 " * 30, *["doc number %d says hello" % i * (i % 40) for i in range(200)]]
    lib = Encoder(tokenizer_path()).tokenizer
    ids = {i: lib.encode(t or "", add_special_tokens=False).ids + [2] for i, t in enumerate(texts)}
    rows = pack(docs(spark, texts).repartition(3), with_ids=True).collect()
    pieces = defaultdict(list)
    for r in rows:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert r.ids == part and r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes()) and r.doc_tokens == len(ids[r.doc_id])
        pieces[r.doc_id] += range(r.start, r.start + r.length)
    assert {k: sorted(v) for k, v in pieces.items()} == {k: list(range(len(v))) for k, v in ids.items()}
    assert pack(docs(spark, [])).count() == 0


def base_truth(text):
    def digits(s):
        return [int(c) for c in s if c in "0123456789"]

    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, "email", m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, "ip", m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = digits(m[0])
        s = sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(reversed(d)))
        if 12 <= len(d) <= 19 and s % 10 == 0:
            out.append((m.start(), 2, "card", m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(digits(m[0])) <= 15:
            out.append((m.start(), 3, "phone", m.end()))
    return [(k, a, b) for a, _, k, b in sorted(out)]


PARTS = st.sampled_from(["a.b@c.de", "x@y", "@", "z@q.w.e-r", "1.2.3.4", "256.1.1.1", "1.2.3.4.5", "001.2.3.0255", "4111 1111 1111 1111", "4111-1111-1111-1112", "5500000000000004", "+1 (415) 555-2671", "+49", "+33 1 23 45 67 89 01", ".", "-", " ", "7", "  ", "é", "a", "+", "%", "٣", "0000000000000000000", "\n"])


@settings(max_examples=400, deadline=None)
@given(st.lists(PARTS, max_size=14).map("".join))
def test_base_spans(text):
    assert [s[:3] for s in pii.find_spans(text) if s[0] in pii.BASE] == base_truth(text)


def test_other_spans_and_linear_time(spark):
    text = "My IBAN is GB82 WEST 1234 5698 7654 32 and ssn: 078-05-1120; part 123-45-6789 no"
    assert [(k, text[a:b]) for k, a, b, _ in pii.find_spans(text)][0] == ("iban", "GB82 WEST 1234 5698 7654 32")
    assert ("ssn", 48) in [(k, a) for k, a, *_ in pii.find_spans(text)]
    assert pii.find_spans("part 123-45-6789 in stock") == []
    assert pii.find_spans("GB82 WEST 1234 5698 7654 33") == []
    for long in ("a" * 300_000, "1" * 300_000, "a@" * 100_000, "1.2." * 75_000, "+1" * 100_000, "A1" * 100_000, "1-" * 100_000, "415 555 2671 " * 20_000, "(1234)" * 50_000):
        pii.find_spans(long)
    out = pii.pii_spans(docs(spark, ["a@b.co 1.2.3.4", None, ""])).orderBy("doc_id").collect()
    assert [r.spans for r in out] == ["email:0:6,ip:7:14", "", ""] and [r.n_ip for r in out] == [1, 0, 0]
    assert out[0].base_sha256 == hashlib.sha256(b"email:0:6,ip:7:14").hexdigest()
    assert [r.text for r in pii.redact(docs(spark, ["to a@b.co.", None])).orderBy("doc_id").collect()] == ["to [email].", None]
    assert pii.pii_spans(docs(spark, [])).count() == 0


@pytest.mark.parametrize(
    "text, kinds",
    [
        ("Call (415) 555-2671 today", ["tel"]), ("box (415) 555-2671 today", []), ("order 415-555-2671, call it in", []), ("tel 0171 555 2671", ["tel"]), ("tel 1.234.567.8901", []),
        ("tracking DE89370400440532013000", []), ("DE89370400440532013000", ["iban"]), ("tracking, account DE89370400440532013000", ["iban"]), ("ssn 078-05-1120", ["ssn"]), ("ssn on order 078-05-1120", []),
        ("call 4111 1111 1111 1111", ["card"]), ("call +1 (415) 555-2671", ["phone"]), ("call 415 555 2671 or 4111 1111 1111 1111 or 415 555 2672", ["tel", "card", "tel"]),
    ],
)
def test_context_speaks_for_and_against(text, kinds):
    assert [k for k, *_ in pii.find_spans(text)] == kinds


@pytest.mark.parametrize(
    "text, ibans",
    [
        ("DE89 3704 0044 0532 0130 00 GB82 WEST 1234 5698 7654 32", ["DE89 3704 0044 0532 0130 00", "GB82 WEST 1234 5698 7654 32"]),
        ("DE89370400440532013000 GB82WEST12345698765432 DE89370400440532013000", ["DE89370400440532013000", "GB82WEST12345698765432", "DE89370400440532013000"]),
        ("RE24 IBAN DE89 3704 0044 0532 0130 00", ["DE89 3704 0044 0532 0130 00"]),
        ("AB12 CD34 DE89 3704 0044 0532 0130 00 EUR 12", ["DE89 3704 0044 0532 0130 00"]),
        ("RE24 DE89 3704 0044 0532 0130 01", []),
        ("XDE89370400440532013000", []),
    ],
)
def test_ibans_next_to_each_other(text, ibans):
    assert [text[a:b] for k, a, b, _ in pii.find_spans(text) if k == "iban"] == ibans
    pii.find_spans("AB12 CD34 " * 10_000)


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=40_000))
def test_media_round_trip(raw):
    padded = media.pad(raw)
    (track,) = media.probe(stored := media.mux(padded))
    assert media.payload(stored, track) == padded and padded.startswith(raw) and len(padded) % 576 == 0 and padded
    assert track.codec == "raw8" and track.duration == len(padded) == track.deltas.sum()
    assert all(stored[a:b] == padded[k * 576 : k * 576 + 576] for k, (a, b) in zip(track.keyframes, track.keyframe_ranges()))


def test_media_rejects_broken_files_and_reads_other_layouts():
    stored = media.mux(media.pad(b"x" * 20_000))
    for cut in range(0, 700, 7):
        try:
            media.probe(stored[:cut])
        except media.MediaError:
            pass
    # 64-bit mdat before moov, co64 and one size for all samples
    data = b"ab" * 50
    mdat = media.struct.pack(">I4sQ", 1, b"mdat", 16 + len(data)) + data
    stbl = media.box(b"stbl", media.full(b"stsd", media.struct.pack(">I", 1), media.box(b"mp4a", bytes(28))), media.full(b"stts", media.struct.pack(">3I", 1, 10, 5)), media.full(b"stsc", media.struct.pack(">4I", 1, 1, 5, 1)), media.full(b"stsz", media.struct.pack(">2I", 10, 10)), media.full(b"co64", media.struct.pack(">IQQ", 2, 16, 66)))
    (t,) = media.probe(mdat + media.box(b"moov", media.box(b"trak", media.box(b"mdia", media.full(b"mdhd", media.struct.pack(">IIIIHH", 0, 0, 10, 50, 0, 0)), media.box(b"minf", stbl)))))
    assert t.codec == "mp4a" and t.seconds == 5 and len(t.keyframes) == 10 and media.payload(mdat, t) == data


def track_of(*tables, head=b""):
    """A moov with one track of these sample tables."""
    b, f = media.box, media.full
    tkhd = f(b"tkhd", media.struct.pack(">IIII", 0, 0, 7, 0))
    mdhd = f(b"mdhd", media.struct.pack(">IIII", 0, 0, 10, 50))
    return b(b"moov", head, b(b"trak", tkhd, b(b"mdia", mdhd, b(b"minf", b(b"stbl", *tables)))))


def numbers(*n):
    return media.struct.pack(f">{len(n)}I", *n)


@pytest.mark.parametrize(
    "data",
    [
        media.box(b"moov", media.box(b"trak", media.box(b"mdia", media.box(b"mdhd")))),
        media.box(b"moov", media.box(b"trak", media.box(b"mdia", media.box(b"hdlr")), media.box(b"tkhd"))),
        track_of(media.full(b"stsz", numbers(1, 2)), media.full(b"stco", numbers(2, 0, 0)), media.full(b"stsc", numbers(2, 2, 1, 1, 1, 1, 1))),
        track_of(media.full(b"stsz", numbers(1, 2)), media.full(b"stco", numbers(1, 0)), media.full(b"stsc", numbers(1, 1, 2, 1)), media.full(b"stts", numbers(1, 2**32 - 1, 1))),
        track_of(media.full(b"stsz", numbers(1, 2**32 - 1)), media.full(b"stco", numbers(1, 0)), media.full(b"stsc", numbers(1, 1, 2**32 - 1, 1))),
        track_of(media.full(b"stsz", numbers(1, 2)), media.full(b"stco", numbers(1, 0)), media.full(b"stsc", numbers(1, 1, 2**32 - 1, 1))),
        track_of(media.full(b"stsz", numbers(0, 2**31))),
        track_of(media.full(b"stsz", numbers(1, 2)), media.full(b"stco", numbers(1, 2**32 - 1)), media.full(b"stsc", numbers(1, 1, 2, 1))),
        track_of(media.full(b"stsz", numbers(1, 2)), media.full(b"co64", numbers(1, 2**32 - 1, 2**32 - 1)), media.full(b"stsc", numbers(1, 1, 2, 1))),
        track_of() + media.box(b"moof", media.box(b"traf", media.full(b"trun", numbers(1)))),
        track_of() + media.box(b"moof", media.box(b"traf", media.full(b"tfhd", numbers(7)), media.full(b"trun", numbers(2**31)))),
        track_of() + media.box(b"moof", media.box(b"traf", media.full(b"tfhd", numbers(7)), media.full(b"trun", numbers(9, 1), flags=0x200))),
    ],
)
def test_hostile_files_are_errors_in_bounded_memory(data):
    import resource

    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    with pytest.raises(media.MediaError):
        media.probe(data)
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 100_000


def test_nesting_of_any_depth_is_walked():
    data = b""
    for _ in range(3000):
        data = media.box(b"moov", data)
    assert media.probe(data) == []
    assert len(media.probe(media.box(b"udta", track_of()))) == 1


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=80), st.lists(st.tuples(st.integers(0, 900), st.integers(0, 255)), max_size=6))
def test_any_bytes_are_tracks_or_a_media_error(raw, changes):
    data = bytearray(media.mux(media.pad(raw)))
    for at, value in changes:
        data[at % len(data)] = value
    for some in (raw, bytes(data)):
        try:
            media.probe(some)
        except media.MediaError:
            pass


def test_fragmented_files_and_compact_sizes():
    payload = bytes(range(100))
    trex = media.box(b"mvex", media.full(b"trex", numbers(7, 1, 5, 10, 0x10000)))
    head = track_of(media.full(b"stsz", numbers(0, 0)), head=trex)

    def moof(data_offset):
        first = media.box(b"traf", media.full(b"tfhd", numbers(7), flags=0x20000), media.full(b"trun", numbers(3, data_offset, 0, 20, 30, 10), flags=0x205), media.full(b"trun", numbers(4)))
        return media.box(b"moof", media.full(b"mfhd", numbers(1)), first)

    frag = moof(len(moof(0)) + 8)
    data = head + frag + media.box(b"mdat", payload)
    (t,) = media.probe(data)
    start = len(head) + len(frag) + 8
    assert t.sizes.tolist() == [20, 30, 10, 10, 10, 10, 10] and t.offsets[0] == start and media.payload(data, t) == payload
    assert t.keyframes.tolist() == [0] and t.duration == 50 and t.deltas.tolist() == [5] * 7
    for bits, packed in ((4, b"\x53\x20"), (8, b"\x05\x03\x02"), (16, b"\0\x05\0\x03\0\x02")):
        tables = lambda at: track_of(media.full(b"stz2", numbers(bits, 3), packed), media.full(b"stco", numbers(1, at)), media.full(b"stsc", numbers(1, 1, 3, 1)))  # noqa: B023, E731
        data = tables(len(tables(0)) + 8) + media.box(b"mdat", b"0123456789")
        (t,) = media.probe(data)
        assert t.sizes.tolist() == [5, 3, 2] and media.payload(data, t) == b"0123456789"


def test_media_columns(spark):
    df = docs(spark, ["é" * 1000, None, "", "é" * 1000], [1, 2, None, 1])
    rows = media.media_digests(df).collect()
    assert Counter(r.n_bytes for r in rows) == {2000: 2, 0: 2} and len({tuple(r)[1:] for r in rows if r.n_bytes}) == 1
    empty = next(r for r in rows if r.doc_id is None)
    assert empty.payload_bytes == 576 and empty.payload_sha256 == hashlib.sha256(b"\xff" * 576).hexdigest() and empty.tail_crc32 == zlib.crc32(b"\xff" * 32)
    probed = media.probe_media(media.media_files(df)).collect()
    assert all(r.tracks[0].codec == "raw8" for r in probed)
    assert media.media_digests(docs(spark, [])).count() == 0
