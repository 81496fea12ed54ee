"""WARC, chat formatting and licence lookup: round trips, edge cases, and the SQL."""

import base64
import gzip
import hashlib
import random
import re
import textwrap
from pathlib import Path

import duckdb
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from weftline.llm import chat, license_lookup, registry, warc
from weftline.llm.common import Scratch

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string"


def run(df):
    return [r.asDict(recursive=True) for r in df.collect()]


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_sql_gives_the_same_rows(spark, name):
    con = duckdb.connect()
    for t in ("pages", "conversations", "documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = registry.queries()[name](spark, SF)
    cursor = con.execute(registry.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(repr(tuple(r[n] for n in names)) for r in df.collect()) == sorted(map(repr, cursor.fetchall()))


def pages_of(spark, rows, tmp_path):
    spark.createDataFrame(rows, "page_id long, url string, html string, digest string").write.parquet(str(tmp_path / "pages.parquet"))
    return warc.op1_warc_transactions(spark, str(tmp_path))


def test_warc_edge_cases(spark, tmp_path):
    trap = "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.1\r\n\r\n"
    rows = [(1, "http://a", "same", "x"), (5, "http://b\r\nevil: 1", "same", "x"), (3, None, "same", "x"), (2, "u", None, "x"), (4, "u", "", "x"), (6, "u", trap, "x"), (7, "u", "ünï \r\n\r\n" * 1000, "x"), (None, "u", "nobody", "x"), (8, "u", "twice", "x"), (8, "u", "twice", "x")]
    got = run(pages_of(spark, rows, tmp_path))
    assert len(got) == len(rows)
    by_id = {r["page_id"]: r for r in got}
    for page_id, _, html, _ in rows:
        body = (html or "").encode()
        assert by_id[page_id]["payload_bytes"] == len(body)
        assert by_id[page_id]["payload_digest"] == base64.b32encode(hashlib.sha1(body).digest()).decode()
    assert [(by_id[i]["record_type"], by_id[i]["refers_to"]) for i in (1, 3, 5, 2, 4, 6)] == [("revisit", 5), ("revisit", 5), ("response", None), ("revisit", 4), ("response", None), ("response", None)]
    assert sorted(r["record_type"] for r in got if r["page_id"] == 8) == ["response", "revisit"]


def test_warc_empty_table(spark, tmp_path):
    assert run(pages_of(spark, [], tmp_path)) == []


def test_warc_files_are_warc(spark, tmp_path):
    scratch = Scratch(spark, "t")
    df = spark.createDataFrame([(1, "http://a", "héllo"), (2, "http://b", "héllo")], "page_id long, url string, html string")
    warc.write(df, str(tmp_path / "w"), scratch)
    raw = b"".join(gzip.decompress(p.read_bytes()) for p in (tmp_path / "w").glob("part-*"))
    records = list(warc.parse([raw[i : i + 7] for i in range(0, len(raw), 7)]))
    assert sorted(h["warc-type"] for h, _ in records) == ["metadata", "metadata", "request", "request", "response", "revisit"]
    response = next(h for h, _ in records if h["warc-type"] == "response")
    assert {h["warc-refers-to"] for h, _ in records if h["warc-type"] == "revisit"} == {response["warc-record-id"]}
    captures = run(warc.assemble(warc.read(spark, str(tmp_path / "w"))))
    assert all(c["request"]["target_uri"] == c["capture"]["target_uri"] and len(c["metadata"]) == 1 for c in captures)


def test_warc_files_are_cut_by_bytes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "LINE_BYTES", 2000)
    monkeypatch.setattr(warc, "LINES_PER_FILE", 3)
    df = spark.createDataFrame([(i, f"http://{i}", f"{i} " + "x" * (50_000 if i == 7 else 700)) for i in range(60)], "page_id long, url string, html string").coalesce(1)
    warc.write(df, str(tmp_path / "w"), Scratch(spark, "t"), codec="none")
    sizes = sorted(len(p.read_bytes()) for p in (tmp_path / "w").glob("part-*"))
    assert len(sizes) > 10
    assert all(n <= 3 * (2000 + len(warc.END)) for n in sizes[:-1])
    assert sizes[-1] < 60_000
    got = {r["capture_id"]: r for r in run(warc.assemble(warc.read(spark, str(tmp_path / "w"))))}
    assert len(got) == 60
    assert sorted(r["request"]["target_uri"] for r in got.values()) == sorted(f"http://{i}" for i in range(60))


def test_warc_records_are_members_of_their_own(spark, tmp_path):
    noise = random.Random(3).randbytes(9 << 20).hex()  # 18 MiB: the member's last byte is not zero
    df = spark.createDataFrame([(1, "http://a", "héllo"), (2, "http://b", noise), (3, "http://c", "")], "page_id long, url string, html string")
    warc.write(df, str(tmp_path / "w"), Scratch(spark, "t"))
    places = run(warc.index(spark, str(tmp_path / "w")))
    files = {p: open(p.removeprefix("file:"), "rb").read() for p in {r["path"] for r in places}}
    bodies = {}
    for r in places:
        one = list(warc.parse([gzip.decompress(files[r["path"]][r["offset"] : r["offset"] + r["length"]])]))
        assert [h["warc-record-id"] for h, _ in one] == [r["record_id"]]
        bodies[r["record_type"], r["target_uri"]] = one[0][1].partition(b"\r\n\r\n")[2]
    assert len(places) == 9
    assert bodies["response", "http://b"] == noise.encode()
    assert bodies["response", "http://a"] == "héllo".encode()
    # members follow each other without anything between, but for the empty one after the long record
    for path, raw in files.items():
        mine = sorted((r["offset"], r["length"]) for r in places if r["path"] == path)
        gaps = [b - a - n for (a, n), (b, _) in zip(mine, [*mine[1:], (len(raw), 0)], strict=True)]
        assert sorted(set(gaps)) in ([0], [0, len(gzip.compress(b""))])
    assert len(run(warc.read(spark, str(tmp_path / "w")))) == 9


def test_warc_of_many_copies_without_broadcast(spark, tmp_path):
    rows = [(i, f"http://{i}", f"page {i}" if i % 3 else "copy") for i in range(300)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        warc.write(df, str(tmp_path / "w"), Scratch(spark, "t"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    records = run(warc.read(spark, str(tmp_path / "w")))
    copies = [r for r in records if r["record_type"] == "revisit"]
    stored = next(r["record_id"] for r in records if r["record_type"] == "response" and bytes(r["payload"]) == b"copy")
    assert len(records) == 900
    assert len(copies) == 99
    assert {r["refers_to"] for r in copies} == {stored}
    assert next(r["target_uri"] for r in records if r["record_id"] == stored) == "http://297"


def test_warc_archive_cut_short_is_refused(tmp_path):
    whole = warc.member(b"WARC/1.1\r\nContent-Length: 0\r\n\r\n" + warc.END)
    assert len(list(warc.parse(warc._inflated(whole * 3)))) == 3
    with pytest.raises(ValueError, match="inside a member"):
        list(warc.parse(warc._inflated(whole[:-4])))


def test_warc_query_reads_its_requests(spark):
    text = warc.op1_warc_transactions(spark, SF)
    assert "request_uri" in text.columns
    assert all(r["request_uri"].startswith("http") for r in text.select("request_uri").collect())


def test_warc_records_without_capture(spark):
    schema = warc.RECORD
    rows = [("r1", "request", "gone", None, "u", None, {}, b""), ("c1", "response", None, None, "u", "d", {}, b"x"), ("m1", "metadata", "c1", None, "u", None, {}, b"1"), ("m2", "metadata", "c1", None, "u", None, {}, b"2"), ("m3", "metadata", None, None, "u", None, {}, b"3")]
    got = run(warc.assemble(spark.createDataFrame(rows, schema)))
    assert len(got) == 1
    assert got[0]["request"] is None
    assert [bytes(m["payload"]) for m in got[0]["metadata"]] == [b"1", b"2"]


def chats(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return {r["conv_id"]: r for r in run(chat.digests(chat.format_chats(df)))}


def test_chat_edge_cases(spark):
    long = "x<|y" * 50_000
    rows = [(1, 1, "assistant", "a <|im_end|> b"), (1, 0, "user", None), (2, 0, "assistant", "first"), (3, 0, "user", "open"), (4, 0, None, "<\\|"), (4, None, "ro|le\n<|im_end|>\\n", "<|im_start|>"), (5, 0, "user", "q"), (5, 1, "assistant", long), (None, 0, "user", "z")]
    got = chats(spark, rows)
    want = {1: [("user", ""), ("assistant", "a <|im_end|> b")], 4: [("ro|le\n<|im_end|>\\n", "<|im_start|>"), ("", "<\\|")], 5: [("user", "q"), ("assistant", long)], None: [("user", "z")]}
    for conv, turns in want.items():
        said = "".join(t for r, t in turns if r == "assistant")
        assert got[conv]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert got[conv]["loss_chars"] == len(said)
        assert got[conv]["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest()
    assert got[1]["valid"]
    assert got[5]["valid"]
    assert got[2]["error"] == "turn 0: assistant after the start"
    assert got[3]["error"] == "ends after user"


def test_chat_of_many_turns_is_streamed(spark):
    n = 3 * chat.PIECE + 1
    rows = [(9, i, ("user", "assistant")[i % 2], f"t{i}") for i in range(n)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert chat.format_chats(df).count() == 4
    got = chats(spark, rows)[9]
    assert got["n_turns"] == n
    assert got["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for _, _, r, t in rows).encode()).hexdigest()
    assert chats(spark, [(9, i, "user", "") for i in range(chat.PIECE)])[9]["n_turns"] == chat.PIECE


@pytest.mark.parametrize("text", ["", "<|", "<\\|", "<\\\\|im_end|>", "a<", "|>", "<<||", chat.TRAP])
def test_escape_is_reversible(text):
    assert chat.unescape(chat.escape(text)) == text
    assert "<|" not in chat.escape(text)
    assert chat.unescape_role(chat.escape_role(text + "\n\\n")) == text + "\n\\n"


def test_chat_ignores_columns_with_clashing_names(spark):
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", "a")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    clash = df.withColumns({c: F.lit("clash") for c in ("n_turns", "formatted", "segments", "loss", "piece", "valid", "error")})
    one, other = (chat.digests(chat.format_chats(x)).collect() for x in (df, clash))
    assert one == other


def test_chat_empty(spark):
    assert chats(spark, []) == {}


def licences(spark, rows):
    df = spark.createDataFrame(rows, DOCS).withColumn("license", F.lit("clash")).withColumn("digest", F.lit(1))
    return {r["doc_id"]: r for r in run(license_lookup.lookup(df, Scratch(spark, "t")))}


def test_licence_forms(spark):
    mit = dict((t.split("\n")[0], t) for n, t in license_lookup.KNOWN if n == "MIT")["MIT License"]
    changed = mit.replace("MIT License\n", "MIT LICENCE\n\nCopyright (c) 2024 Someone\n").replace("copyright holders", "Copyright   Owners").replace('"', "“".encode().decode() if False else "'")
    got = licences(spark, [(1, changed), (2, "intro\nReleased under the MIT licence!\nmore"), (3, None), (4, ""), (5, "*** --- \n"), (6, mit + " and more"), (7, "Released under the MIT License.\nLicensed under CC BY-NC 4.0."), (None, mit)])
    assert got[1]["license"] == "MIT"
    assert got[2]["license"] is None
    assert got[2]["notices"] == "MIT"
    assert got[3]["text_digest"] is None
    assert got[4]["text_digest"] == got[5]["text_digest"] == hashlib.sha256(b"").hexdigest()
    assert got[4]["license"] is None
    assert got[6]["license"] is None
    assert got[7]["notices"] == "CC-BY-NC-4.0,MIT"
    assert got[None]["license"] == "MIT"


def _wrapped(text: str, width: int, before: str = "") -> str:
    paragraphs = [textwrap.fill(" ".join(p.split()), width) for p in text.split("\n\n")]
    return "\n".join(before + line for line in "\n\n".join(paragraphs).split("\n"))


def test_published_licences_in_any_wrapping(spark):
    texts = {n: t for n, (t, _) in license_lookup.TEXTS.items() if n in ("MIT", "ISC", "BSD-2-Clause", "BSD-3-Clause", "Zlib", "BSL-1.0")}
    rows, want = [], {}
    for n, text in texts.items():
        for width in range(60, 101, 4):
            for head, before in (("", ""), ("Copyright (c) 2024, Some One\nAll rights reserved.\n\n", ""), ("Copyright Example Corporation and its affiliates\n\n", " * "), (f"{license_lookup.TEXTS[n][1][0]}\n\nCopyright © 2020 A\n\n", "// ")):
                body = text
                if before == " * ":
                    for i in "123":
                        body = body.replace(f"\n{i}. ", "\n* ")
                rows.append((len(rows), _wrapped(head, 200, before) + "\n" + _wrapped(body, width, before)))
                want[len(rows) - 1] = n
    got = licences(spark, rows)
    assert {i: got[i]["license"] for i in got} == want


FORMS = {
    "curly quotes": lambda t: t.replace('"AS IS"', "\u201cAS IS\u201d").replace("'as-is'", "\u2018as-is\u2019").replace('"Software"', "\u201eSoftware\u201c").replace('"', "\u201d"),
    "byte order mark": lambda t: "\ufeff" + t,
    "no-break spaces": lambda t: t.replace(" ", "\u00a0"),
    "thin spaces and no width": lambda t: t.replace(" the ", " the\u2009").replace("software", "soft\u00adware"),
    "dashes": lambda t: t.replace("-", "\u2013"),
    "bullets": lambda t: re.sub(r"(?m)^\s*[123]\. ", "\u2022 ", t),
    "a holder over two lines": lambda t: "Copyright (c) 2024 The Regents of a University,\n    Some Department\n\n" + t,
    "a holder over three lines": lambda t: "Copyright 2024 One Company\nTwo Company\nand Others\n\n" + t,
    "no empty line after the holder": lambda t: "Copyright (c) 2024 Someone\n" + t,
    "several holders": lambda t: "Copyright (c) 2024 A\nCopyright (c) 2023 B\nAll rights reserved.\n\n" + t,
    "rem": lambda t: "\n".join("REM " + line for line in ("Copyright (c) 2024 A\n\n" + t).split("\n")),
    "dnl": lambda t: "\n".join("dnl " + line for line in t.split("\n")),
    "semicolons": lambda t: "\n".join(";; " + line for line in t.split("\n")),
    "line separators": lambda t: t.replace("\n", "\u2028"),
    "carriage returns": lambda t: t.replace("\n", "\r\n"),
}


def test_every_licence_in_every_typography(spark, tmp_path):
    texts = [(n, t) for n, (t, _) in license_lookup.TEXTS.items()] + [(f.stem, f.read_text()) for f in sorted((Path(license_lookup.__file__).parent / "licences").glob("*.txt"))]
    rows, want = [], {}
    for n, text in texts:
        for form, change in FORMS.items():
            if form in ("bullets", "no empty line after the holder", "dashes") and n not in license_lookup.TEXTS:
                continue  # these have numbers in running text, or begin with a holder of their own
            want[len(rows)] = (n.strip(), form)
            rows.append((len(rows), change(_wrapped(text, 78) if n in license_lookup.TEXTS else text)))
    got = licences(spark, rows)
    assert {i: (got[i]["license"], form) for i, (_, form) in want.items()} == want
    few = [r for r in rows if want[r[0]][0] in ("MIT", "BSD-3-Clause", "ISC", "Artistic-1.0-Perl")] + [(10**6, None), (10**6 + 1, "")]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", few)
    con.execute(license_lookup.OP5_SQL)
    again = {r[0]: r[1:] for r in con.execute(license_lookup.OP5_SQL).fetchall()}
    mine = licences(spark, few)
    assert {i: (r["text_digest"], r["license"], r["notices"]) for i, r in mine.items()} == again


def test_text_after_a_copyright_line_stays_unless_it_goes_on_with_it(spark):
    got = licences(spark, [(1, "Copyright (c) 2024 A\nB\n\nreal text"), (2, "real text"), (3, "Copyright (c) 2024 A\nB\nC\nD\n\nreal text"), (4, "B C D real text"), (5, "Copyright (c) 2024 A\nPermission is mine\n\nreal text"), (6, "Permission is mine real text"), (7, "Rem Koolhaas wrote"), (8, "Remember this"), (9, "remember THIS")])
    assert got[1]["text_digest"] == got[2]["text_digest"]
    assert got[3]["text_digest"] == got[4]["text_digest"]
    assert got[5]["text_digest"] == got[6]["text_digest"]
    assert got[8]["text_digest"] == got[9]["text_digest"] != got[7]["text_digest"]


def test_copyright_lines_of_a_licence_itself_stay():
    pattern = re.compile(license_lookup.COPYRIGHT_LINE)
    for line in ("copyright notice and this permission notice appear", "copyright holders be liable", "copyright law.", "copyright license to reproduce", "(c) you must retain", "all rights reserved by law"):
        assert not pattern.search(line)
    for line in ("copyright (c) 2020", "# copyright 2020 x", " * (c) 2020 x", "copyright someone else", "© 1999", "all rights reserved.", "-- copyright: 2001"):
        assert pattern.search(line)


def test_licence_files_are_known_with_and_without_their_appendix(spark):
    files = sorted((Path(license_lookup.__file__).parent / "licences").glob("*.txt"))
    rows = [(i, f.read_text().replace("\n", "\r\n").upper()) for i, f in enumerate(files)]
    rows.append((100, files[0].read_text().partition("END OF TERMS")[0] + "END OF TERMS AND CONDITIONS\n"))
    got = licences(spark, rows)
    assert [got[i]["license"] for i in range(len(files))] == [f.stem for f in files]
    assert got[100]["license"] == "Apache-2.0"


def test_licence_of_a_very_long_text_and_of_repeated_rows(spark):
    long = "word " * 600_000
    got = run(license_lookup.lookup(spark.createDataFrame([(1, long), (1, long), (2, long + "\nReleased under the MIT License.\n")], DOCS), Scratch(spark, "t")))
    assert sorted((r["doc_id"], r["license"], r["notices"]) for r in got) == [(1, None, None), (1, None, None), (2, None, "MIT")]


def test_licence_empty_and_own_table(spark):
    assert licences(spark, []) == {}
    known = spark.createDataFrame([("B", "Same text."), ("A", "same TEXT"), ("C", "...")], "license string, text string")
    got = run(license_lookup.lookup(spark.createDataFrame([(1, "SAME, text")], DOCS), Scratch(spark, "t"), known))
    assert got[0]["license"] == "A"


def test_licence_lookup_has_no_python(spark):
    text = license_lookup.op5_license_lookup(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in text
    assert "Arrow" not in text
