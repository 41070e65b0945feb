import io
import json
import os
import struct
import time
import zipfile

import pytest

from lodestone.engine import BusyError, SearchEngine
from lodestone.sources import extraction, files, store
from lodestone.sources.manifest import ConflictError, Manifest


def docx(text: str) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document xmlns:w='x'><w:p><w:r><w:t>{text}</w:t></w:r><w:r><w:t> MVP</w:t></w:r></w:p></w:document>")
        z.writestr("word/other.xml", "<a>no</a>")
    return out.getvalue()


def test_decoding():
    text = "本地文档搜索，支持中文"
    assert files.decode_bytes(text.encode()) == files.decode_bytes(text.encode("gb18030")) == text
    assert files.decode_bytes(b"\xff\xfe" + text.encode("utf-16-le")) == files.decode_bytes(b"\xfe\xff" + text.encode("utf-16-be")) == text
    assert files.decode_bytes(b"\xef\xbb\xbfabc\xff") == "abc�"


def test_markup():
    assert files.markup_text("<w:p xmlns:w='x'><w:r><w:t>本地搜索</w:t></w:r><w:r><w:t> MVP</w:t></w:r></w:p>") == "本地搜索 MVP"
    assert files.markup_text("<t><row><v>1</v><v>2 &amp; 3</v></row><row>x<![CDATA[no]]></row></t>") == "1 2 & 3\n x\n"
    assert files.office_text(docx("本地搜索"), "docx") == "本地搜索 MVP\n"


def test_bad_files():
    with pytest.raises(ValueError, match="invalid"):
        files.extract_text(b"not a zip archive", "docx")
    with pytest.raises(ValueError, match="encrypted"):
        files.extract_text(b"%PDF-1.7\n1 0 obj << /Encrypt 2 0 R >>\n%%EOF", "PDF")
    with pytest.raises(ValueError, match="no text"):
        files.extract_text(b" \n ", "txt")
    assert files.extract_isolated(docx("a"), "docx") == ("a MVP", None)
    assert "timeout" in files.extract_isolated(docx("a" * 10), "docx", deadline=0)[1]


def test_vocabulary_and_batches():
    pieces = [b"", b"a", b"b", b"ab", b"abc", b"c"]
    data = b"RWKVTOK1" + struct.pack("<I", len(pieces)) + b"".join(struct.pack("<H", len(p)) + p for p in pieces)
    found = files.read_vocabulary(data)
    assert found == {p: i for i, p in enumerate(pieces) if i}
    assert files.LongestMatch(found).encode("abcabb") == [4, 3, 2]
    for bad in (b"no", data[:-1]):
        with pytest.raises(ValueError):
            files.read_vocabulary(bad)
    plan = files.plan_batches([3000, 100, 120, 140, 160])
    assert sorted(i for b in plan for i in b) == list(range(5)) and all(len(b) <= 4 for b in plan) and plan[-1] == [0]
    assert files.plan_batches([]) == [] and files.padded_tokens([3, 4], [[0, 1]]) == (7, 8)


def test_manifest_refuses_a_taken_number(spark, tmp_path):
    m = Manifest(spark, f"file://{tmp_path}/m")
    assert m.last() is None
    m.publish(1, {"a": 1})
    with pytest.raises(ConflictError):
        m.publish(1, {"a": 2})
    assert m.sequences() == [1] and m.last() == {"a": 1}


def test_engine_over_folders(spark, tmp_path):
    root = tmp_path / "in"
    (root / "sub").mkdir(parents=True)
    (root / "搜索需求.txt").write_text("本地文档搜索，支持中文\n\n关键词查询", encoding="gb18030")
    (root / "sub" / "b.docx").write_bytes(docx("quarterly budget report"))
    (root / "bad.docx").write_bytes(b"not a zip archive")
    (root / "skip.bin").write_bytes(b"x")
    e = SearchEngine(spark, f"file://{tmp_path}/store", [str(root), str(tmp_path / "nowhere")])
    e.sync()
    s = e.stats().first()
    assert (s.document_count, s.chunk_count, s.failed_count, s.extensions) == (2, 2, 2, ["docx", "txt"])
    assert {(r.category) for r in e.failures().collect()} == {"corrupt", "offline"}
    for mode in ("keyword", "semantic", "hybrid"):
        assert e.search("搜索需求", mode).first().name == "搜索需求.txt"
    assert e.search("budget", extension="txt").count() == 0
    with pytest.raises(ValueError):
        e.search("  ")
    version = e.store.version()
    # nothing changed: no document is written anew
    before = {r.id: r.indexed_at for r in e.documents().collect()}
    e.sync()
    assert {r.id: r.indexed_at for r in e.documents().collect()} == before and e.store.version() == version + 1
    # a change, a new file and a deletion, as the watcher tells of them
    time.sleep(0.01)
    (root / "搜索需求.txt").write_text("完全不同的内容", encoding="utf-8")
    os.remove(root / "sub" / "b.docx")
    (root / "new.md").write_text("fresh notes")
    paths = spark.createDataFrame([(str(root / "搜索需求.txt"),), (str(root / "sub"),), (str(root / "new.md"),), ("/elsewhere/x.txt",)], "path string")
    e.apply_changes(paths)
    assert sorted(r.name for r in e.documents().collect()) == ["new.md", "搜索需求.txt"]
    assert e.search("完全不同", "keyword").first().name == "搜索需求.txt" and e.search("budget", "keyword").count() == 0
    assert e.reconcile() == []
    # what is hidden counts as well, a root that is a file is offline
    (root / "_dir").mkdir()
    (root / "_dir" / ".c.md").write_text("hidden words")
    (root / "_b.txt").write_text("underscored words")
    lone = tmp_path / "lone.txt"
    lone.write_text("a file is no root")
    e.sync([str(root), str(lone)])
    assert {r.name for r in e.documents().collect()} >= {".c.md", "_b.txt", "new.md"}
    assert {r.path for r in e.failures().where("category = 'offline'").collect()} == {str(lone)}
    shown = e.stats().first()
    assert (shown.index_stage, shown.status, shown.total_files, shown.processed_files) == ("ready", "ready", 5, 5) and shown.index_total_elapsed_ms >= shown.index_scan_ms > 0
    assert e.document(str(root / "new.md")).first().name == "new.md" and e.setting("embedding_profile") and e.chunk(1).count() == 0
    # vectors of another model are made anew
    t = e.store.read()
    e.store.commit(e.store.version(), {"settings": t["settings"].where("key <> 'embedding_profile'").unionByName(spark.createDataFrame([("embedding_profile", "old")], "key string, value string"))})
    assert e.reconcile() == ["vectors cleared", "indexed"] and e.reconcile() == []
    e._busy.acquire()
    with pytest.raises(BusyError):
        e.sync()
    e._busy.release()


def test_legacy_import(spark, tmp_path):
    legacy = {"directories": ["/a", "/a/b"], "documents": [{"id": "1", "path": "/a/bc.txt", "name": "bc.txt", "extension": "txt", "modified_ms": 1, "size": 2, "chunks": [{"text": "hello world"}]}], "failures": [{"path": "/x", "reason": "r"}], "last_indexed": "2024-01-01T00:00:00Z"}
    (tmp_path / "index.json").write_text(json.dumps(legacy, indent=1))
    e = SearchEngine(spark, f"file://{tmp_path}/store")
    assert e.import_legacy(str(tmp_path / "index.json")) and not e.import_legacy(str(tmp_path / "index.json"))
    assert e.store.read()["documents"].first().root == "/a/b" and e.search("hello", "keyword").count() == 1


def test_a_folder_that_cannot_be_read_keeps_its_documents(spark, tmp_path, monkeypatch):
    root = tmp_path / "in"
    (root / "sub").mkdir(parents=True)
    (root / "a.txt").write_text("one")
    (root / "sub" / "b.txt").write_text("two")
    (root / "link.txt").symlink_to(root / "a.txt")
    found, status, failed = files.scan_roots(spark, [str(root)])
    assert {r.path for r in found.collect()} == {str(root / "a.txt"), str(root / "sub" / "b.txt")} and status.first().complete and failed.count() == 0
    broken = next(files.list_folder(str(root / "nowhere")))
    assert broken[1] == "error" and "No such file" in broken[4]
    e = SearchEngine(spark, f"file://{tmp_path}/store", [str(root)])
    e.sync()
    os.rename(root / "sub", root / "away")
    (root / "sub").symlink_to(tmp_path / "dead")
    status, failed = (x.collect() for x in files.scan_roots(spark, [str(root), str(root / "sub")])[1:])
    assert {r.root: r.complete for r in status} == {str(root): True, str(root / "sub"): False} and [r.path for r in failed] == [str(root / "sub")]


def test_pdf_without_a_library():
    import zlib

    content = zlib.compress(b"BT /F1 12 Tf 72 720 Td (Annual \\(draft\\) report) Tj 0 -14 Td [(Bud) -20 (get) -400 (total)] TJ ET")
    cmap = b"1 begincodespacerange <00> <FF> endcodespacerange 2 beginbfchar <01> <672C> <02> <5730> endbfchar"
    body = b"%PDF-1.4\n1 0 obj << /Type /Pages /Kids [2 0 R 6 0 R] /Count 2 >> endobj\n"
    body += b"2 0 obj << /Type /Page /Parent 1 0 R /Contents 3 0 R /Resources << /Font << /F1 4 0 R >> >> >> endobj\n"
    body += b"3 0 obj << /Length %d /Filter /FlateDecode >> stream\n%s\nendstream endobj\n" % (len(content), content)
    body += b"4 0 obj << /Type /Font >> endobj\n5 0 obj << /Type /Font /ToUnicode 8 0 R >> endobj\n"
    body += b"6 0 obj << /Type /Page /Parent 1 0 R /Contents 7 0 R /Resources << /Font << /F2 5 0 R >> >> >> endobj\n"
    body += b"7 0 obj << /Length 30 >> stream\nBT /F2 9 Tf <0102> Tj ET\nendstream endobj\n8 0 obj << >> stream\n%s\nendstream endobj\n%%%%EOF" % cmap
    assert extraction.plain_pdf_text(body).split("\n")[1:] and files.plain_lines(extraction.plain_pdf_text(body)) == "Annual (draft) report\nBudget total\n本地"
    with pytest.raises(ValueError, match="invalid"):
        extraction.plain_pdf_text(b"nothing")


def test_store_keeps_what_changes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "COMPACT", 3)
    s = store.Store(spark, f"file://{tmp_path}/store")
    rows = lambda *ids: spark.createDataFrame([(i, f"{d}", 0, t) for i, d, t in ids], "id bigint, document_id string, position int, text string")
    gone = lambda *ids: spark.createDataFrame([(i,) for i in ids], "document_id string")
    s.change(0, gone("a"), {"chunks": rows((1, "a", "x"), (2, "b", "y"))}, {})
    old = s.read()
    s.change(1, gone("a"), {"chunks": rows((3, "a", "z"))}, {})
    assert {(r.document_id, r.text) for r in s.read()["chunks"].collect()} == {("b", "y"), ("a", "z")}
    assert {(r.document_id, r.text) for r in old["chunks"].collect()} == {("a", "x"), ("b", "y")}
    s.change(2, gone("b"), {"chunks": rows()}, {})
    s.change(3, gone("c"), {"chunks": rows((4, "c", "w"))}, {})
    assert {(r.document_id, r.text) for r in s.read()["chunks"].collect()} == {("a", "z"), ("c", "w")}
    assert len(s._entry(4)["tables"]["chunks"]) == 1 and s._entry(4)["removed"] == []
    with pytest.raises(ConflictError):
        s.change(3, gone("c"), {}, {})
