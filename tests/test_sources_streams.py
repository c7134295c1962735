"""Files and streams."""

import zipfile

import pytest

from docweave import session
from docweave.sources import files
from docweave.streaming import streams


def test_load_documents(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.txt").write_text("hello")
    (tmp_path / "sub" / "b.md").write_text("hello")
    (tmp_path / "c.txt").write_text(" \n")
    (tmp_path / "d.exe").write_text("no")
    (tmp_path / "e.docx").write_bytes(b"broken")
    ns = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    with zipfile.ZipFile(tmp_path / "f.docx", "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{ns}"><w:body><w:p><w:r><w:t>Hi</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>1</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>2</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>')
    got = {r["name"]: (r["status"], r["content"]) for r in files.load_documents(spark, str(tmp_path)).collect()}
    assert got == {"a.txt": ("loaded", "hello"), "b.md": ("duplicate", None), "c.txt": ("empty", None), "e.docx": ("failed", None), "f.docx": ("loaded", "Hi\n\n1 | 2")}
    assert files.discovered(spark, str(tmp_path), recursive=False).count() == 4


def test_read_csv_finds_the_delimiter(spark, tmp_path):
    p = tmp_path / "t.csv"
    p.write_text("a;b;c\n1;2;3\n")
    assert files.read_csv(spark, str(p)).first().asDict() == {"a": "1", "b": "2", "c": "3"}
    assert files.text_columns(["id", "Question", "Answer"]) == ("Question", "Answer")


def test_incremental_stream_reads_each_file_once(spark, tmp_path, small):
    src, out, cp = (str(tmp_path / x) for x in ("in", "out", "cp"))
    events = spark.read.parquet(f"{small}/events.parquet").selectExpr("event_id", "cast(ts as timestamp) as ts", "user_id", "event_type", "value")
    events.where("event_id < 500").write.parquet(src)
    run = lambda: streams.run_available(streams.first_seen(streams.table_stream(spark, src, events.schema), ["event_id"], "ts"), out, cp)
    run()
    events.where("event_id between 490 and 600").write.mode("append").parquet(src)
    run()
    ids = [r[0] for r in spark.read.parquet(out).select("event_id").collect()]
    assert len(ids) == len(set(ids)) and set(range(500)) <= set(ids)


def test_session_and_hour_windows(spark, tmp_path, small):
    src = str(tmp_path / "in")
    events = spark.read.parquet(f"{small}/events.parquet").selectExpr("event_id", "cast(ts as timestamp) as ts", "user_id", "event_type", "value")
    events.write.parquet(src)
    stream = streams.table_stream(spark, src, events.schema)
    for n, counted in enumerate((streams.windowed_counts(stream, "ts", "event_type", "value"), streams.session_counts(stream, "ts", "user_id"))):
        out = str(tmp_path / f"out{n}")
        streams.run_available(counted, out, str(tmp_path / f"cp{n}"))
        total = spark.read.parquet(out).agg({"n": "sum"}).first()[0]
        assert 0 < total <= events.count()


def test_a_cluster_without_a_shared_folder_is_refused():
    for master in ("spark://host:7077", "yarn", "k8s://host", "local-cluster[3,2,1000]"):
        with pytest.raises(ValueError):
            session.check_one_machine(master)
    for master in ("local", "local[4]", "local[*]"):
        session.check_one_machine(master)
