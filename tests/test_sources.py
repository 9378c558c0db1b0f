import csv
import ipaddress
import io
import os
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from doclake.functions import network as net
from doclake.operators.identity import upload_uri
from doclake.sources import csv_splits, detect, files as fs, sections as sx


def archive(*names):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        for name in names:
            z.writestr(name, "content")
    return buffer.getvalue()


DETECTED = [
    (b"%PDF-2.0\nbody", None, "pdf"),
    (b"%PDF-", "table.csv", "pdf"),
    (b" %PDF-1.7", "late.bin", "unknown"),
    (archive("word/styles.xml"), None, "docx"),
    (archive("docProps/app.xml", "xl/sharedStrings.xml"), "x", "xlsx"),
    (archive("word/footnotes.xml"), "sums.xlsx", "docx"),
    (archive("xl/a", "word/b"), "x.csv", "docx"),
    (archive("other/a"), "x.CSV", "csv"),
    (b"tree;height\noak,21\n", None, "csv"),
    (b"oak beech elm\n", "trees.csv", "csv"),
    (b"a\nb\nc\nd\ne,f\n", None, "csv"),
    (b"a\nb\nc\nd\ne\nf,g\n", None, "unknown"),
    (b"a\r\nb\r\nc\rd\x0be,f", None, "csv"),
    (b"", "trees.pdf", "unknown"),
    (bytes(range(128, 256)), None, "unknown"),
    (b"PK\x03\x04 cut off", None, "unknown"),
    (b"PK\x03\x04 cut off", "lie.docx", "docx"),
    (archive("a")[:-30].replace(b"\x14\x00", b"\xff\x00") + archive("a")[-30:], "odd.csv", "csv"),
    ("é,".encode() + b"a" * 4092 + "é".encode(), None, "csv"),
    ("é,".encode() + b"a" * 4092 + b"b" + "é".encode(), None, "csv"),
    ("é,".encode() + b"a" * 4091 + b"\xc3", None, "unknown"),
    (b"noext", "noext", "unknown"),
]


def test_detection(spark):
    rows = [(i, bytearray(d), n) for i, (d, n, _) in enumerate(DETECTED)]
    df = spark.createDataFrame(rows, "i int, content binary, file_name string")
    got = {r.i: r.file_type for r in detect.detect_types(df).collect()}
    expected = {}
    for i, (data, name, kind) in enumerate(DETECTED):
        if name is None and b"," in data and kind in ("csv", "unknown"):  # the sniff, read in plain Python
            try:
                lines = data[:4096].decode("utf-8").splitlines()[:5]
                kind = "csv" if any("," in line for line in lines) else "unknown"
            except UnicodeDecodeError:
                kind = "unknown"
        expected[i] = kind
    assert got == expected


def test_public_addresses_are_those_of_the_standard_library(spark):
    pick = random.Random(1)
    ips = ["127.8.7.6", "10.20.30.40", "172.31.255.1", "9.9.9.9", "100.127.0.9", "2a00:1450::5", "fd12::9", "", "host", "1.2.3", "01.2.3.4", "1::2::3", "::1.2.3.4"]
    for low, high in (*net.BLOCKED_V4, *net.BLOCKED_V6):
        for edge in (int(low, 16), int(high, 16)):
            kind = ipaddress.IPv4Address if len(low) == 8 else ipaddress.IPv6Address
            ips += [str(kind(n)) for n in (edge - 1, edge, edge + 1) if 0 <= n < 2 ** (4 * len(low))]
    ips += [str(ipaddress.IPv4Address(pick.getrandbits(32))) for _ in range(200)]
    ips += [str(ipaddress.IPv6Address((0x2 << 124) | pick.getrandbits(124))) for _ in range(200)]

    def public(text):
        try:
            ip = ipaddress.ip_address(text)
        except ValueError:
            return None
        if getattr(ip, "ipv4_mapped", None):
            return False
        return not (ip.is_private or ip.is_loopback or ip.is_link_local or ip.is_multicast or ip.is_reserved or ip.is_unspecified)

    rows = spark.createDataFrame([(i,) for i in ips], "ip string").select("ip", net.is_public_ip(F.col("ip")).alias("p")).collect()
    assert {r.ip: r.p for r in rows} == {ip: public(ip) for ip in ips}


URLS = {
    "http://127.9.9.9:81/a": "not_public",
    "https://[fd00::5]:8443/a?b": "not_public",
    "http://user:pw@172.20.1.1/": "not_public",
    "mailto:someone@good.example": "bad_url",
    "gopher://9.9.9.9/1": "bad_url",
    "https:///path-only": "bad_url",
    "https://[::1/open": "bad_url",
    "http://9.9.9.9/a b|c[1]%.pdf": "ok",
    "https://both.example/x": "not_public",
    "https://GOOD.example:8443/x": "ok",
    "https://under_score.example/x": "needs_dns",
    "https://bücher.example/x": "needs_dns",
}


def test_urls(spark):
    dns = spark.createDataFrame(
        [("both.example", "8.8.8.8"), ("both.example", "10.0.0.1"), ("good.example", "8.8.4.4")], "host string, ip string"
    )
    urls = spark.createDataFrame([(u,) for u in URLS], "url string")
    assert {r.url: r.verdict for r in fs.screen_urls(urls, dns).collect()} == URLS
    names = spark.createDataFrame([("http://a/b/c.pdf?x=1",), ("http://a/b/",), ("http://a",)], "url string")
    assert [r[0] for r in names.select(net.url_basename(F.col("url"))).collect()] == ["c.pdf", None, None]


def test_size_cap_keeps_the_exact_limit(spark):
    df = spark.createDataFrame([("a", 26_214_400), ("b", 26_214_401)], "source_uri string, length long")
    kept, rejects = fs.split_by_size(df)
    assert [r.source_uri for r in kept.collect()] == ["a"]
    assert [(r.source_uri, r.reason) for r in rejects.collect()] == [("b", "too_large")]


def test_upload_name(spark):
    df = spark.createDataFrame([("x.csv",), ("",), (None,)], "n string")
    names = [r[0] for r in df.select(upload_uri(F.col("n"), F.encode(F.lit("a"), "UTF-8"))).collect()]
    assert names == ["x.csv", "upload-ca978112ca1b", "upload-ca978112ca1b"]


def test_folder_scan_is_flat_and_sees_every_name(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "deep.csv").write_bytes(b"x")
    (tmp_path / "to.csv").symlink_to(tmp_path / "sub" / "deep.csv")
    names = ["a b+c%41.csv", "é.txt", "_x", ".x", ".x.crc", "_SUCCESS", ".c.crc", "c", "#h?.csv", "empty"]
    for name in names:
        (tmp_path / name).write_bytes(b"" if name == "empty" else name.encode())
    want = {n: b"" if n == "empty" else n.encode() for n in names} | {"to.csv": b"x"}
    for folder in (str(tmp_path), f"file://{tmp_path}"):
        for parts in (1, 3, 40):
            rows = fs.read_files(fs.scan_folder(spark, folder, parts)).collect()
            assert {r.file_name: bytes(r.content) for r in rows} == want and len(rows) == len(want)
            assert all(r.length == len(want[r.file_name]) and not r.cut for r in rows)
            assert all(abs(r.modificationTime.timestamp() - os.stat(tmp_path / r.file_name).st_mtime) < 1 for r in rows)
    (tmp_path / "none").mkdir()
    assert fs.scan_folder(spark, str(tmp_path / "none")).count() == 0


def test_heads_of_long_files(spark, tmp_path):
    for name, data in {"long": b"a," * 500, "pdf": b"%PDF-" + b"x" * 995, "short": b"b" * 9}.items():
        (tmp_path / name).write_bytes(data)
    rows = {r.file_name: r for r in fs.read_files(fs.scan_folder(spark, str(tmp_path)), 100, 10, (b"%PDF-",)).collect()}
    assert {n: (len(r.content), r.cut) for n, r in rows.items()} == {"long": (10, True), "pdf": (1000, False), "short": (9, False)}


def test_batches_of_content_are_bounded(spark, tmp_path, monkeypatch):
    from doclake.sources import folder

    for i in range(9):
        (tmp_path / f"f{i}").write_bytes(bytes([i]) * 100)
    monkeypatch.setattr(folder, "BATCH_BYTES", 250)
    rows = fs.read_files(fs.scan_folder(spark, str(tmp_path), 1)).collect()
    assert {r.file_name: set(r.content) for r in rows} == {f"f{i}": {i} for i in range(9)}


def csv_texts(spark, data):
    df = spark.createDataFrame([("d", bytearray(data))], "document_id string, content binary")
    return [(r.position, r.text) for r in sorted(fs.csv_sections(df).collect(), key=lambda r: r.position)]


def test_csv(spark):
    assert csv_texts(spark, b"tree,height\noak,21\nelm,17\n") == [(0, "tree: oak; height: 21"), (1, "tree: elm; height: 17")]
    assert csv_texts(spark, b"") == [] and csv_texts(spark, b"tree,height\n") == []
    wide = b"tree,note\noak," + b"x" * 200_000 + b"\n"
    assert [len(t) for _, t in csv_texts(spark, wide)] == [len("tree: oak; note: ") + 200_000]
    ragged = b'A,,C\n1,2\n"x, ""y""\nz",2,3,4\n , ,\n\n7,8,\xff\n'
    assert csv_texts(spark, ragged) == [(0, "A: 1"), (1, 'A: x, "y"\nz; C: 3'), (2, "A: 7; C: �")]


def odd_csv(pick, lines):
    """Lines with quoted line breaks, doubled, stray and unclosed quotes, blanks and bytes that are no text."""
    cells = ["x", "", " ", '"q, 1"', '"two\nlines"', '"a ""b""\n\n,c"', 'mid"dle', '"shut"more', "é", '""', '"\r\n"']
    out = []
    for _ in range(lines):
        line = ",".join(pick.choice(cells) for _ in range(pick.randint(0, 4)))
        out.append(line + pick.choice(["\n", "\n", "\r\n"]))
    data = "".join(out).encode()
    return data + pick.choice([b"", b"last,\xff", b'open,"to the\nend', b"\n"])


@pytest.mark.parametrize("split_bytes", [1, 7, 64, 1 << 20])
def test_csv_splits_give_what_the_whole_file_gives(spark, tmp_path, monkeypatch, split_bytes):
    """Any split of any file: the records, their positions and the header; files that cannot be read are named."""
    monkeypatch.setattr(csv_splits, "MOST_TASKS", 6)
    pick = random.Random(split_bytes)
    whole, refused = {}, set()
    for i in range(20):
        data = odd_csv(pick, pick.randint(0, 30 if split_bytes == 1 else 120))
        if i == 3:
            data = b""
        if i == 4:
            data = b"h\n" + b"a,b\n" * 40 + b"bare\rreturn\n" + b"c\n" * 40
        (tmp_path / f"f{i}").write_bytes(data)
        try:
            whole[f"f{i}"] = list(csv_splits.whole_records(data))
        except csv.Error:
            refused.add(f"f{i}")
    assert "f4" in refused and len(whole) > 5
    records, bad = csv_splits.read_splits(fs.scan_folder(spark, str(tmp_path)), split_bytes)
    got = {}
    for r in records.collect():
        got.setdefault(os.path.basename(r.path), []).append((r.position, r.header, r["values"]))
    assert {n: sorted(rows) for n, rows in got.items()} == {n: rows for n, rows in whole.items() if rows}
    assert {os.path.basename(r.path) for r in bad.collect()} == refused


def test_a_cell_over_many_splits(spark, tmp_path, monkeypatch):
    body = "line\n" * 300
    (tmp_path / "f").write_bytes(f'a,b\n1,"{body}"\n2,x\n'.encode())
    monkeypatch.setattr(csv_splits, "MOST_TASKS", 6)
    records, _ = csv_splits.read_splits(fs.scan_folder(spark, str(tmp_path)), 100)
    assert sorted((r.position, r["values"]) for r in records.collect()) == [(0, ["1", body]), (1, ["2", "x"])]


def test_sheets(spark):
    cells = [("d", 0, "Trees", 0, 0, "tree"), ("d", 0, "Trees", 0, 1, "place"), ("d", 0, "Trees", 0, 2, "height")]
    cells += [("d", 0, "Trees", 1, 0, "oak"), ("d", 0, "Trees", 1, 2, "21"), ("d", 0, "Trees", 2, 0, "elm"), ("d", 0, "Trees", 2, 1, None)]
    cells += [("d", 0, "Trees", 3, 0, " "), ("d", 0, "Trees", 3, 1, None), ("d", 0, "Trees", 4, 2, "9")]
    cells += [("d", 1, "Blank", 0, 0, " "), ("d", 1, "Blank", 1, 0, "a"), ("d", 1, "Blank", 1, 1, "b"), ("d", 2, "Bare", 5, 0, "c")]
    df = spark.createDataFrame(cells, "document_id string, sheet_idx int, sheet_name string, row_idx int, col_idx int, value string")
    for block in (4096, 2):
        rows = sorted(sx.sheet_sections(df, block).collect(), key=lambda r: r.position)
        assert [(r.position, r.sheet_name, r.text) for r in rows] == [
            (0, "Trees", "tree: oak; place: ; height: 21"),
            (1, "Trees", "tree: elm; place: "),
            (2, "Trees", "tree: ; place: ; height: 9"),
            (3, "Blank", "a; b"),
            (4, "Bare", "c"),
        ]


def test_blocks_and_pages(spark):
    prose = spark.createDataFrame(
        [("d", 0, "Heading 1", " On trees "), ("d", 1, None, "Oaks grow slowly."), ("d", 2, "Normal", "  ")],
        "document_id string, seq int, style_name string, text string",
    )
    cells = spark.createDataFrame(
        [("d", 0, 0, 0, "tree"), ("d", 0, 0, 1, " height"), ("d", 0, 1, 0, " "), ("d", 0, 1, 1, ""), ("d", 0, 2, 0, "oak"), ("d", 0, 2, 1, "21"), ("d", 1, 0, 0, " ")],
        "document_id string, table_idx int, row_idx int, col_idx int, text string",
    )
    rows = sorted(sx.block_sections(prose, cells).collect(), key=lambda r: r.position)
    blocked = sorted(sx.block_sections(prose, cells, block=1).collect(), key=lambda r: r.position)
    assert rows == blocked
    assert [(r.position, r.section_type, r.text) for r in rows] == [
        (0, "heading", "On trees"),
        (1, "paragraph", "Oaks grow slowly."),
        (2, "table", "tree | height\noak | 21"),
    ]
    pages = spark.createDataFrame([("d", 0, "one"), ("d", 1, " \n"), ("d", 2, "three")], "document_id string, page_idx int, text string")
    assert sorted((r.position, r.page_number) for r in sx.page_sections(pages).collect()) == [(0, 1), (2, 3)]


@pytest.mark.parametrize("kind", ["pdf", "docx", "xlsx"])
def test_a_kind_without_a_decoder_is_a_reject_of_its_own(spark, kind):
    typed = spark.createDataFrame([("d", "u", kind, "c", bytearray(b"x"))], "document_id string, source_uri string, file_type string, checksum string, content binary")
    assert [r.reason for r in fs.unit_rejects(fs.decode(typed)).collect()] == ["no_decoder"]
    own = {kind: lambda data: [{"kind": "page", "i": 0, "text": data.decode()}]}
    assert [r.text for r in fs.decode(typed, own).where("kind = 'page'").collect()] == ["x"]


def test_records_of_small_splits_share_tasks_and_are_not_broadcast(spark, tmp_path):
    """The files' columns meet the splits before these are read; a join after it would broadcast the records."""
    for i in range(8):
        (tmp_path / f"f{i}.csv").write_bytes(b"a,b\n" + b"".join(b"%d,%d\n" % (i, n) for n in range(400)))
    listed = fs.scan_folder(spark, str(tmp_path)).select(
        "path", "length", F.col("file_name").alias("document_id"), F.lit("u").alias("source_uri"), F.lit("csv").alias("file_type")
    )
    units = fs.csv_split_units(listed, 20).where("kind = 'record'").select("document_id", "source_uri", "file_type", "j", "cells")
    plan = units._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("MapInArrow") < plan.index("Join")
    assert units.rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism
    got = sorted((r.document_id, r.source_uri, r.file_type, r.j, tuple(r.cells)) for r in units.collect())
    assert got == sorted((f"f{i}.csv", "u", "csv", n, (str(i), str(n))) for i in range(8) for n in range(400))
