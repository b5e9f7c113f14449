"""S2-S4, L1-L11 on hand-written rows (FIXTURES section 2), W1-W3/S6 round trip."""

import os

from pyspark.sql import functions as F

from corpuskit.operators import lexicon
from corpuskit.sources import artefacts, csv, jsonl, sinks, text, xml

ROWS = [
    "1. ren;rens;sb.",
    "ren;ren;adj.,sb.",
    "Null;null;sb.",
    "kat;katte;adj., sb.",
    'abe;"abe; lille";sb.',
    "A;12. Kat 3. x;sb. pl.",
    ";;",
]


def _lex(spark, tmp_out):
    p = os.path.join(tmp_out, "dict.csv")
    with open(p, "w", encoding="utf-8") as fh:
        fh.write("\n".join(ROWS) + "\n")
    return csv.read_dictionary(spark, p)


def test_csv_reader(spark, tmp_out):
    lex = _lex(spark, tmp_out)
    rows = [tuple(r) for r in lex.collect()]
    assert ("abe", "abe; lille", "sb.") in rows
    assert (None, None, None) in rows
    assert ("Null", "null", "sb.") in rows


def test_word_lists(spark, tmp_out):
    lex = _lex(spark, tmp_out)
    small = {r.word for r in lexicon.small_dictionary(lex).collect()}
    full = {r.word for r in lexicon.full_dictionary(lex).collect()}
    plain = {r.word for r in lexicon.word_list(lex, "word").collect()}
    assert "ren" in small            # ban looks at the raw word ("rens")
    assert "null" in small and "null" in full
    assert "kat" not in small        # " sb." has a leading space
    assert "abe; lille" in plain and "abe; lille" not in full
    assert "kat x" in plain and "kat x" not in full
    assert "a" not in small          # one character


def test_readers(spark, tmp_out):
    j = os.path.join(tmp_out, "a.jsonl")
    with open(j, "w", encoding="utf-8") as fh:
        fh.write('{"text": "Hej med dig", "id": 1}\n{"text": "To", "x": [1]}\n')
    assert [r.text for r in jsonl.read_jsonl_field(spark, j).collect()] == ["Hej med dig", "To"]
    t = os.path.join(tmp_out, "a.txt")
    with open(t, "w", encoding="utf-8") as fh:
        fh.write("en\nto\n")
    df = text.read_lines(spark, t, lang="da", source="wiki")
    assert [(r.lang, r.source, r.text) for r in df.collect()] == [("da", "wiki", "en"), ("da", "wiki", "to")]
    x = os.path.join(tmp_out, "dump.xml")
    with open(x, "w", encoding="utf-8") as fh:
        fh.write("<mediawiki><page><title>A</title><id>7</id><revision><id>1</id>"
                 "<text xml:space=\"preserve\">Hej verden</text></revision></page></mediawiki>")
    pages = xml.read_dump_pages(spark, x).collect()
    assert [(p.page_id, p.title, p.text) for p in pages] == [(7, "A", "Hej verden")]


def test_sinks_and_artefacts(spark, tmp_out):
    df = spark.createDataFrame([("da", "a b"), ("sv", "c d")], "lang string, text string")
    sinks.write_corpus(df, os.path.join(tmp_out, "corpus"))
    back = spark.read.parquet(os.path.join(tmp_out, "corpus"))
    assert sorted(r.text for r in back.where("lang = 'da'").collect()) == ["a b"]
    sinks.write_lines(df, os.path.join(tmp_out, "lines"))
    assert sorted(r.value for r in spark.read.text(os.path.join(tmp_out, "lines")).collect()) == ["a b", "c d"]
    vocab = spark.createDataFrame([(0, "<pad>", 0.0, True), (5, "kat", -1.0, False)], "id int, token string, lp double, special boolean")
    words = spark.createDataFrame([("kat", 3)], "word string, length bigint")
    tok = artefacts.TokeniserTables(vocab, words, words, ["e", "n", "s"])
    d = os.path.join(tmp_out, "tok")
    artefacts.save_tokeniser(tok, d)
    back = artefacts.load_tokeniser(spark, d)
    assert back.interfixes == ["e", "n", "s"]
    assert sorted(map(tuple, back.vocab.collect())) == sorted(map(tuple, vocab.collect()))
    assert back.dictionaries().count() == 2   # no length tier lost on load


def test_files_to_masked_rows(spark, tmp_path):
    """From text files and a dictionary file to masked training rows."""
    from corpuskit.plans import jobs
    from corpuskit.sources import csv, text
    for name in ("a", "b"):
        (tmp_path / f"{name}.txt").write_text("\n".join(
            f'<doc id="{i}">\nDer Hund {name}{i} geht in den Garten. Die Katze bleibt im Haus {i % 7}.\n</doc>' for i in range(120)))
    (tmp_path / "words.csv").write_text("Haus;Haus;sb.\nGarten;Garten;sb.\nTür;Türen;sb.\nHaustürschlüssel;x;sb.\n")
    lines = text.read_keyed_lines(spark, [str(tmp_path / "a.txt"), str(tmp_path / "b.txt")], lang="de")
    rows = lines.collect()
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append((r.line_no, r.text))
    assert len(by_doc) == 2
    for doc in by_doc.values():
        assert [n for n, _ in sorted(doc)] == list(range(360)) and sorted(doc)[3][1] == '<doc id="1">'
    corpus = jobs.build_corpus(lines)
    assert corpus.count() == 480
    tok = jobs.build_tokeniser(corpus, csv.read_dictionary(spark, str(tmp_path / "words.csv")), vocab_size=200)
    out = jobs.build_mlm_data(corpus, tok, max_length=32)
    got = out.collect()
    assert len(got) == int(0.99 * 480) and all(len(r.input_ids) == len(r.labels) == len(r.attention_mask) for r in got)


def test_wrong_number_of_fields_raises(spark, tmp_path):
    import pytest
    from corpuskit.sources import csv
    (tmp_path / "bad.csv").write_text("a;b;c;d\n")
    with pytest.raises(Exception):
        csv.read_dictionary(spark, str(tmp_path / "bad.csv")).collect()


def test_buckets_flatten_to_the_list(spark):
    """A4: the words grouped by length, flattened again, are the list."""
    words = spark.createDataFrame([(w,) for w in ("a", "bb", "cc", "ddd")], "word string").withColumn("length", F.length("word"))
    grouped = words.groupBy("length").agg(F.collect_list("word").alias("ws"))
    assert sorted(r.w for r in grouped.select(F.explode("ws").alias("w")).collect()) == ["a", "bb", "cc", "ddd"]


def test_streamed_files_equal_the_batch(spark, tmp_path):
    from corpuskit.operators import clean
    from corpuskit.streaming import sentences
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.txt").write_text("Ja. Det er en test! Kom nu her.\n\n<doc id=1>\n")
    (src / "b.txt").write_text("Endnu en linje. Nej.\n")

    def run():
        stream = sentences.stream_sentences(spark, str(src), lang="da", max_files_per_trigger=1)
        sentences.start_sentence_sink(stream, str(tmp_path / "out"), str(tmp_path / "check"), once=True).awaitTermination()
        return sorted(r.sent for r in spark.read.parquet(str(tmp_path / "out")).collect())
    lines = spark.read.text(str(src)).withColumnRenamed("value", "text")
    want = sorted(r.sent for r in clean.keep_sentences(clean.split_sentences(clean.clean_lines(lines))).collect())
    assert run() == want and len(want) == 3
    (src / "c.txt").write_text("Den tredje fil.\n")
    assert run() == sorted([*want, "Den tredje fil."])
