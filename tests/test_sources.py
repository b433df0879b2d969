import io
import json
import os
import time
import zipfile

from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpus_ops.sources import files, sinks
from corpus_ops.sources.records import decode, from_json, mapped, normal
from corpus_ops.streaming import metrics


def test_mapping_priorities():
    assert [m["role"] for m in mapped({"messages": [{"role": "human", "content": "a"}, {"role": "x", "content": "b"}], "text": "c"}, "s").messages] == ["user", "user"]
    assert mapped({"conversations": [{"from": "gpt", "value": "v"}, {"from": "human"}]}, "s").messages == [{"role": "assistant", "content": "v"}]
    alpaca = mapped({"instruction": "Sum", "input": "1 2", "output": "3"}, "s")
    assert alpaca.messages[0]["content"] == "Sum\n\n1 2"
    assert [m["role"] for m in mapped({"system": "S", "prompt": "p", "completion": "c"}, "s").messages] == ["system", "user", "assistant"]
    assert mapped({"id": 5, "lang": "en", "score": 0.5}, "s") is None
    assert mapped({"id": 5, "odd": "x" * 100}, "s").text == "x" * 100
    assert mapped({"a": "x" * 40, "b": "y" * 40}, "s") is None
    assert mapped({"text": " ", "body": "b"}, "s").text == "b"
    assert from_json("{broken", "s") is None and from_json("3", "s") is None and from_json('"t"', "s").text == "t"


def test_decoding():
    assert decode("café".encode("latin-1")) == "café"
    assert decode("em — dash".encode()) == "em — dash"
    assert decode("wide".encode("utf-16")) == "wide" and decode("﻿mark".encode()) == "mark"
    assert decode(b"\x81\x8d") == "\x81\x8d"


@given(st.binary(max_size=60))
def test_decoding_never_fails(raw):
    assert isinstance(decode(raw), str)


@given(st.text(max_size=60))
def test_normal_is_stable(text):
    assert normal(normal(text)) == normal(text) and "\r" not in normal(text)


def make(folder):
    put = lambda name, data: (os.makedirs(os.path.dirname(folder / name), exist_ok=True), (folder / name).write_bytes(data if isinstance(data, bytes) else data.encode()))
    put("a/b.txt", "Some prose.\r\nMore.")
    put("a-b/c.md", "# Title")
    put("page.html", "<html><head><style>x{}</style></head><body><nav>menu</nav><p>Only &amp; this</p><script>no()</script><footer>f</footer></body></html>")
    put("d.jsonl", '{"text": "prose line"}\n\n{"prompt": "p", "completion": "c"}\n{broken\n{"id": 1}\n')
    put("d.json", json.dumps({"version": 1, "data": [{"text": f"t{i}"} for i in range(5)]}))
    put("qa.csv", "id,question,answer\n1,why,because\n")
    put("empty.csv", "\n")
    put("bad.json", "{")
    put("blank.txt", " \n")
    put("x.bin", b"\0\1")
    put("node_modules/skip.txt", "no")
    put(".hidden.txt", "no")
    put("nb.ipynb", json.dumps({"cells": [{"cell_type": "code", "source": ["x = 1\n", "y"], "outputs": ["z"]}, {"cell_type": "markdown", "source": "text"}, {"source": ""}]}))
    book = io.BytesIO()
    with zipfile.ZipFile(book, "w") as z:
        z.writestr("c2.xhtml", "<p>" + "second chapter " * 20 + "</p>")
        z.writestr("c1.xhtml", "<p>short</p>")
    put("b.epub", book.getvalue())
    word = io.BytesIO()
    ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    with zipfile.ZipFile(word, "w") as z:
        z.writestr("word/document.xml", f"<w:document {ns}><w:body><w:p><w:r><w:t>Para</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>")
    put("w.docx", word.getvalue())
    return str(folder)


def test_folder_to_records(spark, tmp_path):
    root = make(tmp_path / "in")
    rows = {r.source: r for r in files.records(spark, root).collect()}
    assert rows["a/b.txt"].text == "Some prose.\nMore." and rows["page.html"].text == "Only & this"
    assert rows["d.jsonl:0"].text == "prose line" and [m.role for m in rows["d.jsonl:2"].messages] == ["user", "assistant"]
    assert rows["d.json:4"].text == "t4" and rows["qa.csv:0"].messages[1].content == "because"
    assert rows["nb.ipynb"].text == "```python\nx = 1\ny\n```\n\ntext" and rows["w.docx"].text == "Para\na\tb"
    assert "b.epub#c2.xhtml" in rows and "b.epub#c1.xhtml" not in rows
    why = {r.path: r.status for r in rows.values() if r.status}
    assert why == {"empty.csv": "no header row", "bad.json": "JSONDecodeError", "blank.txt": "no content"}
    assert {r.reason: r.n_files for r in files.skipped(files.records(spark, root)).collect()}["no content"] == 1
    order = [r.path for r in files.scan(spark, root).orderBy(F.split("path", "/")).collect()]
    assert order[:2] == ["a/b.txt", "a-b/c.md"] and "x.bin" not in order and not [p for p in order if "node_modules" in p]
    assert [r.folder for r in files.folders(spark, root).collect()][:2] == ["a", "a-b"]


def test_corpus_hash(spark, tmp_path):
    one, two = make(tmp_path / "one"), make(tmp_path / "two")
    first = files.corpus_hash(spark, one)
    assert first == files.corpus_hash(spark, two)
    (tmp_path / "two" / "a" / "b.txt").write_text("other")
    assert first != files.corpus_hash(spark, two)
    assert files.object_hash({"a": 1, "b": 2}) == files.object_hash({"b": 2, "a": 1})
    assert files.cache_key("h", near=True) != files.cache_key("h", near=False) and len(files.tokenizer_id("h", 4096)) == 16


def test_sinks(spark, tmp_path):
    docs = spark.createDataFrame([(2, "b"), (1, "a")], "rec_id long, text string")
    sinks.write_documents(docs, str(tmp_path / "docs"))
    assert [r.rec_id for r in sinks.read_documents(spark, str(tmp_path / "docs")).collect()] == [1, 2]
    sinks.write_documents(docs, str(tmp_path / "gz"), gzip_json=True)
    assert spark.read.json(str(tmp_path / "gz")).count() == 2
    packed = spark.createDataFrame([("train", 0, 1, [1, 2]), ("val", 0, 2, [3])], "split string, shard long, ord long, ids array<int>")
    sinks.write_shards(packed, str(tmp_path / "shards"))
    assert [r.ids for r in sinks.open_split(spark, str(tmp_path / "shards"), "val").collect()] == [[3]]
    sinks.write_generated(docs, str(tmp_path / "gen"), {"teacher": "t"})
    sinks.write_analysis(docs.limit(1), str(tmp_path / "one"))
    sinks.write_manifest(docs, str(tmp_path / "many"))
    assert sinks.cached(spark, str(tmp_path / "none")) is None and sinks.cached(spark, str(tmp_path / "docs")).count() == 2


def test_small_readers(spark, tmp_path):
    (tmp_path / "p.txt").write_text("hi\nfirst prompt\nsecond prompt\nfirst prompt\n")
    assert {(r.ord, r.prompt) for r in files.prompts(spark, str(tmp_path / "p.txt")).collect()} == {(1, "first prompt"), (2, "second prompt")}
    (tmp_path / "config.json").write_text(json.dumps({"hidden_size": 4096, "num_hidden_layers": 32, "num_attention_heads": 32, "num_key_value_heads": 8, "intermediate_size": 14336, "vocab_size": 128256}))
    assert 7.5e9 < files.model_config(spark, str(tmp_path / "config.json")).first().n_params < 8.5e9
    (tmp_path / "w.log").write_text("a" * 50 + "end")
    assert files.log_tail(spark, str(tmp_path / "w.log"), 3) == "end"
    (tmp_path / "s").mkdir()
    for n in (10, 200, 30):
        (tmp_path / "s" / f"step_{n:06d}.txt").write_text(str(n))
    assert [r.step for r in files.samples(spark, str(tmp_path / "s"), 2).collect()] == [200, 30]


def test_metrics_file_is_followed(spark, tmp_path):
    path = tmp_path / "metrics.jsonl"
    path.write_text('{"step": 1, "loss": 2.5}\n\n{"step": 2, "val_loss": 2}\n{"step": 3, "lo')
    rows, line = metrics.read_from(str(path), 0)
    assert [r[1] for r in rows] == [1, 2] and line == 3
    got = []
    push = lambda: metrics.push(metrics.follow(spark, str(path)), got.extend, str(tmp_path / "check")).awaitTermination()
    push()
    assert sorted(r["step"] for r in got) == [1, 2]
    path.write_text('{"step": 1, "loss": 2.5}\n\n{"step": 2, "val_loss": 2}\n{"step": 3, "loss": 1}\n')
    push()
    assert sorted(r["step"] for r in got) == [1, 2, 3] and metrics.read_from(str(tmp_path / "none"), 4) == ([], 4)


def test_streams_of_tables(spark, tmp_path):
    schema = "run_id string, worker_no int, line_no long, step long, loss double, val_loss double, tokens_per_sec long, elapsed_s double, logged_at timestamp_ntz, received_at timestamp_ntz"
    at = time.strptime("2025-01-01", "%Y-%m-%d")
    import datetime

    t = datetime.datetime(*at[:6])
    rows = [("r", 0, k, k, 1.0, None, 5, 1.0, t, t) for k in (1, 2, 2)]
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))

    def all_of(df, mode):
        query = df.writeStream.format("memory").queryName("out").outputMode(mode).trigger(availableNow=True).start()
        query.awaitTermination()
        return spark.table("out").collect()

    stream = metrics.lines_of(spark, str(tmp_path / "in"))
    assert sorted(r.line_no for r in all_of(metrics.once(stream), "append")) == [1, 2]
    assert [r.n_lines for r in all_of(metrics.rates(stream), "complete")] == [3]
    spark.createDataFrame([("a",), (" a",), ("b",)], "text string").write.parquet(str(tmp_path / "docs"))
    docs = spark.readStream.schema("text string").parquet(str(tmp_path / "docs"))
    assert len(all_of(metrics.unseen_documents(docs), "append")) == 2
