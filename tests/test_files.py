"""Readers and writers on real files, several splits and parts included."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lingospan.sources import readers, writers
from lingospan.sources.lines import read_lines
from lingospan.streaming import incremental


def put(tmp_path, name, text):
    path = tmp_path / name
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_line_numbers_over_splits(spark, tmp_path):
    lines = [f"line {i} " + "x" * (i % 50) for i in range(20000)]
    put(tmp_path, "a.txt", "\n".join(lines) + "\n")
    put(tmp_path, "b.txt", "only\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40000")
    try:
        df = read_lines(spark, str(tmp_path))
        assert df.rdd.getNumPartitions() > 1 or df.count()
        got = df.filter(F.col("file").endswith("a.txt")).orderBy("line_no").collect()
        assert [r.line for r in got] == lines and [r.line_no for r in got] == list(range(len(lines)))
        assert df.filter(F.col("file").endswith("b.txt")).select("line_no", "line").collect() == [(0, "only")]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_labelled_tsv(spark, tmp_path):
    path = put(tmp_path, "l.tsv", "C\tdoc one\nbad line\nE\tx\ty\nG\t\n")
    rows, rejects = readers.read_labelled_tsv(spark, path)
    assert {(r["class"], r.content) for r in rows.collect()} == {("C", "doc one"), ("G", "")}
    assert {r.line_no for r in rejects.collect()} == {1, 2}


ITEM = '<n><codes class="bip:topics:1.0">{codes}</codes><codes class="x"><code code="MCAT"/></codes><t>{text}</t></n>'


def test_news_xml(spark, tmp_path):
    code = '<code code="{}"/>'.format
    items = {
        "one": ITEM.format(codes=code("CCAT") + code("C15"), text="<p>a &amp; b</p><p>c<i>d</i>e</p>"),
        "two": ITEM.format(codes=code("CCAT") + code("ECAT"), text="<p>a</p>"),
        "none": ITEM.format(codes=code("C15"), text="<p>a</p>"),
        "empty_p": ITEM.format(codes=code("GCAT"), text="<p>a</p><p/>"),
        "broken": "<n><codes",
    }
    folder = tmp_path / "rcv" / "sub1"
    folder.mkdir(parents=True)
    for name, xml in items.items():
        (folder / f"{name}.xml").write_text(xml)
    rows, rejects = readers.read_news_xml(spark, str(tmp_path / "rcv"))
    assert [tuple(r) for r in rows.collect()] == [("sub1", "one", "CCAT", "a & b c")]
    assert {r.file_name for r in rejects.collect()} == {"two", "none", "empty_p", "broken"}


def test_word_vectors(spark, tmp_path):
    path = put(tmp_path, "v.vec", "4 2\na 1 2\nb 3 4\na 5 6\nc 7 8\n")
    got = {r.word: (r.idx, r.vec) for r in readers.read_word_vectors(spark, path).collect()}
    assert got == {"a": (2, [5.0, 6.0]), "b": (1, [3.0, 4.0]), "c": (3, [7.0, 8.0])}
    first = {r.word: r.idx for r in readers.read_word_vectors(spark, path, 2).collect()}
    assert first == {"a": 0, "b": 1}


def test_long_vector_files_are_read_whole(spark):
    lines = spark.range(200_010).select(F.col("id").alias("line_no"), F.concat_ws(" ", F.concat(F.lit("w"), "id"), F.lit("1 2")).alias("line"))
    assert readers.parse_word_vectors(lines).count() == 200_010


def test_saving_a_model_again_replaces_it(spark, tmp_path):
    def save(model, n):
        table = spark.createDataFrame([(model, i) for i in range(n)], "model_id string, v int")
        writers.save_model_bundle(table, table, table, str(tmp_path / "bundle"))

    save("a", 3)
    save("b", 2)
    save("a", 1)
    for saved in writers.load_model_bundle(spark, str(tmp_path / "bundle")):
        assert {r.model_id: r["count"] for r in saved.groupBy("model_id").count().collect()} == {"a": 1, "b": 2}


def test_vector_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(0, "en", "a", [0.5, -1.25]), (1, "fr", "é", [2.0, 0.0])], "idx long, lang string, word string, vec array<double>")
    path = str(tmp_path / "vec")
    writers.write_word_vectors(df, path)
    lines = [r.value for r in spark.read.text(path).collect()]
    assert sorted(lines) == sorted(["2 2", "a 0.500000 -1.250000", "é 2.000000 0.000000"])
    prefixed = [r.line for r in writers.format_lang_prefixed_vectors(df, "jap").orderBy("idx").collect()]
    assert prefixed == ["eng:a 0.500000 -1.250000", "jap:é 2.000000 0.000000"]


@pytest.mark.parametrize(
    "text, sep, options, expected",
    [
        ("甲 One\n", " ", {"lower_english": True}, ("甲", "one")),
        ("one,甲\n", ",", {"reverse": True}, ("甲", "one")),
        ("甲\tone\n", "\t", {}, ("甲", "one")),
        ("甲,5,One\n", ",", {"columns": (0, 2)}, ("甲", "One")),
    ],
)
def test_bidict(spark, tmp_path, text, sep, options, expected):
    row = readers.read_bidict(spark, put(tmp_path, "d", text), sep, **options).first()
    assert (row.src_word, row.tgt_word) == expected


def ranked(df, *keys):
    out = {}
    for r in df.orderBy("rank").collect():
        out.setdefault(tuple(r[k] for k in keys), []).append(r.word)
    return out


def test_topic_formats(spark, tmp_path):
    lftm = readers.read_topics(spark, put(tmp_path, "t1", "noise\nTopic0: a b\n\nTopic1: c\n"), "lftm", 2)
    assert ranked(lftm, "topic_id") == {(0,): ["a", "b"], (1,): ["c"]}
    dash = readers.read_topics(spark, put(tmp_path, "t2", "a,1\nb,2\n-\nc,3\n"), "csv_dash", 2)
    assert ranked(dash, "topic_id") == {(0,): ["a", "b"], (1,): ["c"]}
    poly = readers.read_topics(spark, put(tmp_path, "t3", "0\t0.1\ncn\t2\t.1\t甲 乙 \nen\t2\t.1\ta b \n"), "polylingual", 1)
    assert ranked(poly, "topic_id", "side") == {(0, "src"): ["甲", "乙"], (0, "tgt"): ["a", "b"]}
    mtm = readers.read_topics(spark, put(tmp_path, "t4", "t   a:1   b:2\nt   c:1\nt   d:1\nt   e:1   f:1\n"), "mtm", n_topics=2)
    assert ranked(mtm, "topic_id", "side") == {(0, "src"): ["a", "b"], (1, "src"): ["c"], (0, "tgt"): ["d"], (1, "tgt"): ["e", "f"]}
    with pytest.raises(ValueError):
        readers.read_topics(spark, put(tmp_path, "t5", "Topic0: a\n"), "lftm", 2)


def test_weights(spark, tmp_path):
    assert readers.read_theta(spark, put(tmp_path, "th", "0.1 0.9 \n")).first().theta == [0.1, 0.9]
    rho = readers.read_rho(spark, put(tmp_path, "rho", "head\n1 2\n3 4\n9 9\n"), 2)
    assert {(r.src_topic, r.tgt_topic): r.w for r in rho.collect()} == {(0, 0): 1, (0, 1): 2, (1, 0): 3, (1, 1): 4}


def test_perplexity(spark, tmp_path):
    log = "x\n-7.25 per-word bound, 152.2 perplexity estimate\nPROGRESS\n-6.5 per-word bound, 90.5 perplexity\n"
    got = readers.parse_perplexity_log(read_lines(spark, put(tmp_path, "log", log))).orderBy("iter").collect()
    assert [tuple(r) for r in got] == [(0, -7.25, 152.2), (1, -6.5, 90.5)]


def test_interleaved_needs_pairs(spark, tmp_path):
    got = readers.read_interleaved_pairs(spark, put(tmp_path, "p", "a  b\nc\n")).orderBy("side").collect()
    assert [(r.pair_id, r.side, r.tokens) for r in got] == [(0, 0, ["a", "b"]), (0, 1, ["c"])]
    with pytest.raises(ValueError):
        readers.read_interleaved_pairs(spark, put(tmp_path, "q", "a\n"))


def test_corpus_files_are_ordered(spark, tmp_path):
    rows = [(i, s, "en" if s else "fr", [f"d{i}s{s}"]) for i in range(300) for s in (0, 1)]
    df = spark.createDataFrame(rows, "pair_id long, side int, lang string, tokens array<string>").repartition(7)
    writers.write_interleaved_corpus(df, str(tmp_path / "c"))
    parts = sorted((tmp_path / "c").glob("part-*"))
    text = "".join(p.read_text() for p in parts).split()
    assert text == [f"d{i}s{s}" for i in range(300) for s in (0, 1)]
    writers.write_two_file_corpus(df, str(tmp_path / "two"))
    french = sorted((tmp_path / "two" / "lang=fr").glob("part-*"))
    assert "".join(p.read_text() for p in french).split() == [f"d{i}s0" for i in range(300)]


def test_stream_restarts_where_it_stopped(spark, tmp_path):
    docs, out, progress = (str(tmp_path / n) for n in ("docs", "out", "progress"))
    schema = "doc_id long, text string"
    spark.createDataFrame([(1, "a b"), (2, "")], schema).write.parquet(docs)

    def run():
        stream = incremental.document_stream(spark, docs, schema)
        text = F.col("text")
        incremental.process_available(
            stream, lambda b: b.select("doc_id", *incremental.nlp_result(text, F.split(text, " "))), out, progress
        )
        return {r.doc_id: (r.status, r.version) for r in incremental.latest(spark.read.parquet(out), ["doc_id"]).collect()}

    assert run() == {1: ("done", 0), 2: ("error", 0)}
    spark.createDataFrame([(2, "c"), (3, "d")], schema).write.mode("append").parquet(docs)
    assert run() == {1: ("done", 0), 2: ("done", 1), 3: ("done", 1)}


def test_table_stream_reads_a_file_and_a_folder(spark, tmp_path):
    one, parts = tmp_path / "one", tmp_path / "parts"
    schema = "doc_id long, text string"
    rows = [(i, "a b" if i % 3 else "") for i in range(20)]
    spark.createDataFrame(rows, schema).repartition(4).write.parquet(str(parts / "documents.parquet"))
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "written"))
    one.mkdir()
    next((tmp_path / "written").glob("part-*.parquet")).rename(one / "documents.parquet")
    # A table beside it is not read.
    spark.createDataFrame([(99, "c")], schema).write.parquet(str(parts / "pages.parquet"))
    for folder in (one, parts):
        stream = incremental.table_stream(spark, f"{folder}/documents.parquet", schema)
        incremental.process_available(stream, lambda b: b, str(folder / "out"), str(folder / "progress"))
        assert sorted(r.doc_id for r in spark.read.parquet(str(folder / "out")).collect()) == list(range(20))


def test_polylingual_weights(spark):
    lines = [(0, "#doc\tname\ttopic"), (1, "0\ta\t0.25\t0.75\t"), (2, "1\tb c\t1.0\t0"), (3, "2\tbroken"), (4, "3\t\t0.5\t0.5")]
    rows = readers.parse_theta_polylingual(spark.createDataFrame(lines, "line_no long, line string")).orderBy("lang_seq").collect()
    assert [tuple(r) for r in rows] == [(0, "a", [0.25, 0.75]), (1, "b c", [1.0, 0.0]), (3, "", [0.5, 0.5])]
