import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairlens.llm import chat, flac, media, warc

SF = "/root/testdata/sf0.001"


def test_flac_round_trip():
    r = random.Random(1)
    payloads = [b"\0" * 64, b"a" * 640, r.randbytes(64 * 33), bytes(range(256)) * 4, bytes((i // 3) % 256 for i in range(64 * 50)), b"\xff\0" * 320]
    payloads += [bytes(int(128 + 100 * np.sin(i / 9) + r.random()) for i in range(4096)), b"text of some words. " * 960]
    stored = flac.encode(payloads)
    assert [b"".join(b) for b in flac.decode(stored)] == payloads
    assert len(stored[6]) < 0.6 * 4096  # a linear predictor is worth it
    first, block = flac.decode_at(stored[7], 5000)
    assert first <= 5000 < first + len(block) and payloads[7][first : first + len(block)] == block


def test_flac_checks_its_frames():
    stored = flac.encode([b"some words here " * 64])[0]
    for at in (len(stored) - 1, len(stored) - 40, flac.Stream(stored).first + 5):
        broken = bytearray(stored)
        broken[at] ^= 4
        with pytest.raises(ValueError):
            flac.decode([bytes(broken)])


def test_flac_without_seek_table():
    stored = flac.encode([b"some words here " * 200])[0]
    first = flac.Stream(stored).first
    bare = b"fLaC\x80" + stored[5:42] + stored[first:]
    assert b"".join(flac.decode([bare])[0]) == b"some words here " * 200


def test_rice_escape_and_orders():
    """A frame made by hand: fixed order 3, two partitions, the second with raw 5-bit residuals."""
    x = [0, 1, 3, 6, 10, 15, 21, 28, 36, 45, 54, 63, 73, 82, 92, 100]
    d = np.diff(np.array(x), n=3).tolist()
    bits = "0" + "001011" + "0" + "".join(f"{v & 255:08b}" for v in x[:3]) + "00" + "0001" + f"{1:04b}"
    for v in d[:5]:
        u = 2 * v if v >= 0 else -2 * v - 1
        bits += "0" * (u >> 1) + "1" + str(u & 1)
    bits += "1111" + f"{5:05b}" + "".join(f"{v & 31:05b}" for v in d[5:])
    head = flac._header(0, 16)
    frame = head + int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")
    frame += int(flac.crc16(np.frombuffer(frame, np.uint8), np.array([0]), np.array([len(frame)]))[0]).to_bytes(2, "big")
    samples, ends, _ = flac.decode_frames(frame, [0])
    assert samples[0].tolist() == x and ends[0] == len(frame)


def test_media(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", F.lit(1).alias("media")).unionByName(spark.createDataFrame([(-1, None, 1), (-2, "", 1), (-2, "", 1)], "doc_id long, text string, media int"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    stored = media.store(docs)
    rows = media.digests(stored).collect()
    assert len(rows) == docs.count()
    for r in rows:
        n, p = media.payload(texts[r.doc_id])
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (n, len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
    blocks = media.pcm_blocks(stored.where("doc_id = 1")).orderBy("block").collect()
    assert [b.sample_offset for b in blocks] == [1024 * i for i in range(len(blocks))] and b"".join(bytes(b.pcm) for b in blocks) == media.payload(texts[1])[1]
    assert media.digests(media.store(docs.limit(0))).count() == 0


def test_chat(spark):
    rows = [(1, 0, "user", "hi <|end|>\n <\\|x| <|turn|>"), (1, 1, "user", "again"), (1, 2, "assistant", None), (1, 3, "assistant", "<|next|>"), (1, 3, "assistant", "<|next|>"), (1, 9, "system", "é日<"), (2, 0, None, ""), (3, 5, "assistant", "|<\\\\|"), (None, 0, "us<|text|>er", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("turns", F.lit(1))
    chats = chat.format_chats(df)
    got = {r.conv_id: r for r in chat.digests(chats).collect()}
    for conv in (1, 2, 3, None):
        mine = sorted((t, r or "", x or "") for c, t, r, x in rows if c == conv)
        said = "".join(f"{r}\n{x}\n" for _, r, x in mine)
        loss = "".join(x for _, r, x in mine if r == "assistant")
        assert (got[conv].n_turns, got[conv].turns_sha256) == (len(mine), hashlib.sha256(said.encode()).hexdigest())
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    first = chats.where("conv_id = 1").first()
    assert first.formatted.count("<|turn|>") == 3 and first.formatted.count("<|next|>") == 3  # neighbours of one role are one run
    assert chat.digests(chat.format_chats(df.limit(0))).count() == 0


def test_chat_repeated_rows(spark):
    """Repeated rows at the start of the first run and of a later one."""
    rows = [(1, 0, "user", "hi")] * 2 + [(1, 1, "assistant", "well <|"), (1, 2, "user", "more")] + [(1, 3, "assistant", "yes")] * 3 + [(1, 4, "assistant", "so")] + [(2, 0, "assistant", "")] * 2 + [(3, None, "user", "x")] * 2
    chats = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {r.conv_id: r for r in chat.digests(chats).collect()}
    for conv in (1, 2, 3):
        mine = [(r, x) for c, _, r, x in rows if c == conv]
        said, loss = "".join(f"{r}\n{x}\n" for r, x in mine), "".join(x for r, x in mine if r == "assistant")
        assert (got[conv].n_turns, got[conv].turns_sha256) == (len(mine), hashlib.sha256(said.encode()).hexdigest())
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_warc(spark):
    pages = spark.createDataFrame([(1, "http://a/", "<html><head><title>T</title></head><body><p>One &amp;amp; <b>two</b></p><script>x<y</script><!-- no -->three<br>four</body></html>"), (2, None, None), (2, None, None)], "page_id long, url string, html string").withColumn("text", F.lit("x"))
    rows = warc.derivatives(warc.responses(pages)).collect()
    assert len(rows) == 9
    one = {r.warc_type: r for r in rows if r.page_id == 1}
    assert one["conversion"].block == "One &amp; two\nthree\nfour"
    assert one["metadata"].refers_to == one["conversion"].refers_to == one["response"].record_id
    assert one["response"].block_digest == "sha256:" + hashlib.sha256(one["response"].block.encode()).hexdigest()
    assert one["conversion"].record_id in one["metadata"].block and "source-content-type: text/html; charset=utf-8" in one["metadata"].block
    for r in rows:
        head, body = r.record.split("\r\n\r\n", 1)
        assert body == r.block + "\r\n\r\n" and f"Content-Length: {len(r.block.encode())}" in head
    assert warc.derivatives(warc.responses(pages.limit(0))).count() == 0


def test_warc_keeps_header_lines(spark):
    header = "HTTP/1.1 301 Moved\r\nContent-Type: text/html\r\nContent-Length: 9\r\nLocation: http://b/\r\nX-Long: one\r\n two\r\nDate:now\r\n\r\n"
    resp = spark.createDataFrame([(1, "<urn:uuid:1>", "http://a/", header, "<p>x</p>")], "page_id long, record_id string, target_uri string, http_header string, payload string")
    block = warc.derivatives(resp).where("warc_type = 'metadata'").first().block
    assert block.endswith("\r\nsource-content-length: 9\r\nsource-location: http://b/\r\nsource-x-long: one two\r\nsource-date: now\r\n")
    assert block.count("source-content-type") == 1 and "source-status: 301" in block


def test_warc_dates_references_and_repeated_pages(spark):
    page = "<p>a &lt;b&gt; &eacute;&#233;&#xE9;&#x1F600; &amp;amp; &nosuch; &; &#xD800; AT&T &copy;</p>"
    pages = spark.createDataFrame([(1, "http://a/", page)] * 3 + [(2, "http://a/", page)], "page_id long, url string, html string")
    rows = warc.derivatives(warc.responses(pages, "2026-01-02T03:04:05Z")).collect()
    assert len({r.record_id for r in rows}) == 12
    ids = {r.record_id for r in rows if r.warc_type == "response"}
    assert all(r.refers_to in ids for r in rows if r.warc_type != "response")
    assert {r.block for r in rows if r.warc_type == "conversion"} == {"a <b> éé\u00e9\U0001f600 &amp; &nosuch; &; &#xD800; AT&T ©"}
    for r in rows:
        head = dict(x.split(": ", 1) for x in r.record.split("\r\n\r\n", 1)[0].split("\r\n")[1:])
        assert {"WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length"} <= set(head) and head["WARC-Date"] == "2026-01-02T03:04:05Z"
    first = sorted(map(tuple, rows))
    assert first == sorted(map(tuple, warc.derivatives(warc.responses(pages, "2026-01-02T03:04:05Z")).collect()))


def test_media_form_and_null_streams(spark):
    """The stored form's own columns, and rows without a stream."""
    docs = spark.createDataFrame([(1, "ab" * 50), (2, "ab" * 50), (3, "x")], "doc_id long, text string")
    stored = media.store(docs).unionByName(spark.createDataFrame([(4, 0, None)], "doc_id long, n_bytes long, media binary"))
    held = {r.doc_id: r.media for r in stored.collect()}
    got = {r.doc_id: r for r in media.digests(stored).collect()}
    for i in (1, 2, 3):
        assert (got[i].media_bytes, got[i].media_sha256) == (len(held[i]), hashlib.sha256(held[i]).hexdigest())
        x = [b - 128 for b in media.payload("x" if i == 3 else "ab" * 50)[1]]
        turns = sum((a < 0) != (b < 0) for a, b in zip(x, x[1:]))
        assert got[i].feature == f"peak={max(map(abs, x))};mean={sum(x) * 1000 // len(x)};square={sum(v * v for v in x) * 1000 // len(x)};crossings={turns}"
    assert got[1][1:] == got[2][1:] and got[4].media_sha256 is None
    assert media.pcm_blocks(stored).where("doc_id = 4").count() == 0 and media.pcm_blocks(stored.where("doc_id = 4")).count() == 0


def test_responses_with_nulls(spark):
    """Null payloads and headers are empty, null ids are made from the row, null URIs have no line."""
    rows = [(1, None, None, "HTTP/1.1 200 OK\r\nA: b\r\n\r\n", None), (2, None, "u", None, "<p>x</p>"), (None, "<urn:uuid:1>", "v", None, None)]
    resp = spark.createDataFrame(rows, "page_id long, record_id string, target_uri string, http_header string, payload string")
    got = warc.derivatives(resp).collect()
    assert len(got) == 9 and all(r.block is not None and r.record_id and r.content_length == len(r.block.encode()) and r.record.endswith(r.block + "\r\n\r\n") for r in got)
    assert len({r.record_id for r in got}) == 9 and {r.record_id for r in warc.derivatives(resp).collect()} == {r.record_id for r in got}
    by = {(r.page_id, r.warc_type): r for r in got}
    assert by[(1, "response")].block == rows[0][3] and "WARC-Target-URI" not in by[(1, "response")].record and by[(2, "conversion")].block == "x" and by[(2, "response")].block == "<p>x</p>"
    assert all(by[(p, k)].refers_to == by[(p, "response")].record_id for p in (1, 2, None) for k in ("metadata", "conversion"))


def test_intermediates_of_two_threads(spark):
    import threading

    from pairlens.llm import common

    kept, inside, done = {}, threading.Event(), threading.Event()

    def other():
        kept["other"] = common.materialize(spark.range(3))
        inside.set()
        done.wait(60)

    with common.intermediates(spark):
        t = threading.Thread(target=other)
        t.start()
        inside.wait(60)
        kept["own"] = common.materialize(spark.range(2))
    assert kept["other"].count() == 3
    done.set()
    t.join()
    path = spark._jvm.org.apache.hadoop.fs.Path(kept["own"]._pairlens_path)
    assert not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
