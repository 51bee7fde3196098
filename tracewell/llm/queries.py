"""The registered queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell.llm.common import table


def op1_line_dedup(spark, sf_dir):
    from tracewell.llm.line_dedup import dedup_lines

    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op2_packing(spark, sf_dir):
    from tracewell.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"))


def op3_pii(spark, sf_dir):
    from tracewell.llm.pii import pii_spans

    return pii_spans(table(spark, sf_dir, "documents"))


def op4_exact_dedup(spark, sf_dir):
    from tracewell.llm.exact_dedup import exact_groups

    return exact_groups(table(spark, sf_dir, "documents"), keep="max")


def op5_quality(spark, sf_dir):
    from tracewell.llm.quality_crf import fit, quality

    docs = table(spark, sf_dir, "documents")
    return quality(docs, fit(docs, table(spark, sf_dir, "labels")))


def op6_toxicity(spark, sf_dir):
    from tracewell.llm.toxicity import fit, toxicity

    docs = table(spark, sf_dir, "documents")
    return toxicity(docs, fit(docs, table(spark, sf_dir, "labels")))


def op7_mixing(spark, sf_dir):
    from tracewell.llm.mixing import mix

    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix(docs).select("doc_id", "source", F.coalesce(F.char_length("text"), F.lit(0)).cast("long").alias("chars"), "block", "slot", "order")


def op8_near_dedup(spark, sf_dir):
    from tracewell.llm.minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op9_main_text(spark, sf_dir):
    from tracewell.llm.html_extract import main_text

    return main_text(table(spark, sf_dir, "pages"))


def op10_media(spark, sf_dir):
    from tracewell.llm.media import media_digests

    return media_digests(table(spark, sf_dir, "documents"))


def queries():
    return {f.__name__: f for f in (op1_line_dedup, op2_packing, op3_pii, op4_exact_dedup, op5_quality, op6_toxicity, op7_mixing, op8_near_dedup, op9_main_text, op10_media)}


_SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

OP1_SQL = f"""
WITH parts AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
lines AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM parts),
keyed AS (SELECT doc_id, line, pos, translate(trim(line, {_SPACE}), {_LOWER}) AS k FROM lines),
shared AS (SELECT k, min(doc_id) AS first FROM keyed WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) >= 2),
marked AS (SELECT keyed.*, shared.k IS NOT NULL AND keyed.doc_id <> shared.first AS gone FROM keyed LEFT JOIN shared USING (k))
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

OP4_SQL = f"""
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), {_LOWER}) AS norm FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256
FROM t
"""

#: Full word sets, joined on their shingles, and links followed from every class to all that it reaches.
OP8_SQL = f"""
WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_LOWER}), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
),
tokens AS (SELECT doc_id, len(w) AS m, unnest(w) AS t, unnest(range(len(w))) AS pos FROM words),
five AS (
    SELECT doc_id, t || ' ' || lead(t, 1) OVER o || ' ' || lead(t, 2) OVER o || ' ' || lead(t, 3) OVER o || ' ' || lead(t, 4) OVER o AS g
    FROM tokens WHERE m >= 5 WINDOW o AS (PARTITION BY doc_id ORDER BY pos)
    UNION ALL
    SELECT doc_id, array_to_string(w, ' ') FROM words WHERE len(w) BETWEEN 1 AND 4
),
sets AS (
    SELECT d.doc_id, coalesce(f.s, []) AS s
    FROM words d LEFT JOIN (SELECT doc_id, list(DISTINCT g ORDER BY g) AS s FROM five WHERE g IS NOT NULL GROUP BY doc_id) f ON f.doc_id = d.doc_id
),
classes AS (SELECT min(doc_id) AS rep, s, len(s) AS n FROM sets WHERE len(s) > 0 GROUP BY s),
held AS (SELECT rep, n, unnest(s) AS g FROM classes),
pairs AS (
    SELECT x.rep AS a, y.rep AS b, any_value(x.n + y.n) AS both_n, count(*) AS common
    FROM held x JOIN held y ON x.g = y.g AND x.rep <> y.rep AND 100 * least(x.n, y.n) >= 75 * greatest(x.n, y.n) GROUP BY x.rep, y.rep
),
links AS (SELECT a, b FROM pairs WHERE 100 * common >= 75 * (both_n - common)),
reach AS (SELECT rep AS id, rep AS root FROM classes UNION SELECT l.b, r.root FROM reach r JOIN links l ON l.a = r.id),
roots AS (SELECT id, min(root) AS root FROM reach GROUP BY id),
placed AS (
    SELECT d.doc_id, len(d.s) AS n_shingles, coalesce(r.root, d.doc_id) AS component_id
    FROM sets d LEFT JOIN classes c ON d.s = c.s LEFT JOIN roots r ON r.id = c.rep
)
SELECT doc_id, n_shingles, component_id, doc_id = component_id AS kept FROM placed
"""


def _u32(x) -> str:
    return f"printf('%08X', CAST({x} AS BIGINT))"


def _op10_sql() -> str:
    """The container spelt out in hex digits, box by box, for one track of 576-byte samples in chunks of 16 with offsets of 32 bits; CRC-32 bit by bit.

    A part is SQL for its digits and SQL for its bytes. c: samples, k: chunks, r: runs of chunks, starts: where the samples begin.
    """
    hexed = lambda kind: kind.encode().hex().upper()
    zeros = lambda n: "00" * n
    digits = lambda s: (f"'{s}'", len(s) // 2)
    u32 = lambda x: (_u32(x), 4)
    each = lambda what, count: (f"array_to_string([{_u32(what)} for i in range({count})], '')", f"4 * {count}")

    def box(kind: str, *parts: tuple) -> tuple:
        size = " + ".join(["8", *(str(n) for _, n in parts)])
        return " || ".join([_u32(size), f"'{hexed(kind)}'", *(sql for sql, _ in parts)]), size

    duration = ("printf('%016X', CAST(c * 576 AS BIGINT))", 8)
    matrix = "00010000" + zeros(12) + "00010000" + zeros(12) + "40000000"
    whole, last = f"{_u32(1)} || {_u32(16)} || {_u32(1)}", f"{_u32('k')} || {_u32('c - 16 * (k - 1)')} || {_u32(1)}"
    runs = (f"CASE WHEN r = 2 THEN {whole} || {last} WHEN k > 1 THEN {whole} ELSE {last} END", "12 * r")
    none = digits(zeros(4))
    stbl = box(
        "stbl",
        box("stsd", none, u32(1), box("raw8", digits(zeros(6) + "0001" + zeros(8) + "0001" + "0008" + zeros(4) + "BB800000"))),
        box("stts", none, u32(1), u32("c"), u32(576)),
        box("stsc", none, u32("r"), runs),
        box("stsz", none, none, u32("c"), each("576", "c")),
        box("stss", none, u32("k"), each("16 * i + 1", "k")),
        box("stco", none, u32("k"), each("starts + 9216 * i", "k")),
    )
    minf = box("minf", box("smhd", digits(zeros(8))), box("dinf", box("dref", none, u32(1), box("url ", digits("00000001")))), stbl)
    mdhd = box("mdhd", digits("01000000" + zeros(16) + "0000BB80"), duration, digits("55C40000"))
    hdlr = box("hdlr", digits(zeros(8) + hexed("soun") + zeros(12) + hexed("bytes") + "00"))
    tkhd = box("tkhd", digits("01000003" + zeros(16) + "00000001" + zeros(4)), duration, digits(zeros(8) + zeros(4) + "01000000" + matrix + zeros(8)))
    mvhd = box("mvhd", digits("01000000" + zeros(16) + "0000BB80"), duration, digits("00010000" + "0100" + zeros(10) + matrix + zeros(24) + "00000002"))
    ftyp = box("ftyp", digits(hexed("isom") + "00000200" + hexed("isomiso2mp41")))
    moov = box("moov", mvhd, box("trak", tkhd, box("mdia", mdhd, hdlr, minf)))
    mdat = box("mdat", ("body", "576 * c"))
    return f"""
WITH RECURSIVE texts AS (SELECT DISTINCT coalesce(text, '') AS text FROM documents),
sized AS (SELECT text, octet_length(encode(text)) AS n, greatest(1, (octet_length(encode(text)) + 575) // 576) AS c FROM texts),
padded AS (SELECT text, n, c, (c + 15) // 16 AS k, hex(encode(text)) || repeat('FF', c * 576 - n) AS body FROM sized),
runs AS (SELECT *, CASE WHEN k > 1 AND c % 16 > 0 THEN 2 ELSE 1 END AS r FROM padded),
placed AS (SELECT *, {ftyp[1]} + {moov[1]} + 8 AS starts FROM runs),
stored AS (SELECT *, unhex({ftyp[0]} || {moov[0]} || {mdat[0]}) AS media FROM placed),
tails AS (SELECT DISTINCT right(body, 64) AS tail FROM padded),
crc AS (
    SELECT tail, 0 AS i, CAST(4294967295 AS BIGINT) AS v FROM tails
    UNION ALL
    SELECT tail, i + 1, xor(v >> 1, CASE WHEN (v + ((instr('0123456789ABCDEF', substr(tail, 2 * (i // 8) + CASE WHEN i % 8 < 4 THEN 2 ELSE 1 END, 1)) - 1) >> (i % 4))) % 2 = 1
                                         THEN CAST(3988292384 AS BIGINT) ELSE 0 END)
    FROM crc WHERE i < 256
),
sums AS (SELECT tail, xor(v, CAST(4294967295 AS BIGINT)) AS tail_crc32 FROM crc WHERE i = 256),
told AS (
    SELECT text, CAST(n AS BIGINT) AS n_bytes, CAST(c * 576 AS BIGINT) AS payload_bytes, sha256(unhex(body)) AS payload_sha256, tail_crc32,
           CAST(octet_length(media) AS BIGINT) AS media_bytes, sha256(media) AS media_sha256,
           'codec=raw8;handler=soun;duration=' || c * 576 || '/48000;samples=' || c || ';keyframes='
           || array_to_string([(starts + 9216 * i) || '-' || (starts + 9216 * i + 576) for i in range(k)], ',') AS feature
    FROM stored JOIN sums ON tail = right(body, 64)
)
SELECT doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature
FROM documents d JOIN told ON told.text = coalesce(d.text, '')
"""


def oracle_sql():
    return {"op1_line_dedup": OP1_SQL, "op4_exact_dedup": OP4_SQL, "op8_near_dedup": OP8_SQL, "op10_media": _op10_sql()}
