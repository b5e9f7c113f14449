"""Streamed encoding equals the batch, encodes a word once, and may be run again."""

from pyspark.sql import functions as F

from corpuskit.operators import clean, compound, encode, tokens, unigram
from corpuskit.streaming import encoding
from test_compound import FULL, SMALL, _dicts

KEYS = ["doc_id"]
SCHEMA = "doc_id long, sent string"
FIRST = [(1, "Sonnentag im garten"), (2, "der blumentopf im haus"), (None, "im haus"), (3, ""), (4, None)]
SECOND = [(5, "sonnentag ﬁn"), (5, "sonnentag ﬁn"), (None, "<mask> im zeitsplan"), (6, "x" * 40 + " im")]
THIRD = [(7, "im haus zeitsplan"), (8, "neue wörter")]


def _model(spark):
    words = spark.createDataFrame([(w, 3) for w in "sonne tag garten blume topf zeit plan haus im der n s fin".split()], "w string, f long")
    seeds = unigram.seed_pieces(words, 500)
    return unigram.finalize(seeds.select("piece", "lp"), 500)


def _batch(spark, rows, vocab, dicts, length):
    sents = spark.createDataFrame(rows, SCHEMA)
    words = tokens.word_freq(tokens.pretokenise(sents, "sent", keep=[]))
    ids = encode.word_ids_unigram(words, vocab, compound.compound_splits(words.select("w"), dicts))
    got = encode.encode_sentences(sents, ids, KEYS).select("doc_id", encode.add_specials(F.col("ids"), length).alias("input_ids"))
    return _rows(got)


def _rows(df):
    return sorted(((r.doc_id, r.input_ids) for r in df.collect()), key=str)


def _run(spark, tmp_path, encoder):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", "1").parquet(str(tmp_path / "in"))
    encoding.start_encoding(stream, encoder, str(tmp_path / "check"), once=True).awaitTermination()


def _encoder(spark, tmp_path, length=12):
    return encoding.Encoder(spark, _model(spark), KEYS, str(tmp_path / "words"), str(tmp_path / "out"),
                            _dicts(spark, SMALL, FULL), max_length=length)


def test_stream_equals_batch_also_after_a_restart(spark, tmp_path):
    add = lambda rows: spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    add(FIRST), add(SECOND)
    _run(spark, tmp_path, _encoder(spark, tmp_path))
    add(THIRD)
    encoder = _encoder(spark, tmp_path)  # a new driver
    _run(spark, tmp_path, encoder)
    want = _batch(spark, FIRST + SECOND + THIRD, _model(spark), _dicts(spark, SMALL, FULL), 12)
    assert _rows(encoder.encoded()) == want and len(want) == 11
    # every word was encoded in one batch only
    assert encoder.table().groupBy("w").count().where("count > 1").isEmpty()
    assert encoder.table().select("batch").distinct().count() == 3


def test_a_batch_run_again_replaces_its_own(spark, tmp_path):
    encoder = _encoder(spark, tmp_path)
    encoder(spark.createDataFrame(FIRST, SCHEMA), 0)
    # words of a batch that broke off before its sentences were written
    spark.createDataFrame([("im", [99])], encoding.WORD_TABLE).write.parquet(encoder._folder(encoder.table_dir, 1))
    for _ in range(2):
        encoder(spark.createDataFrame(SECOND, SCHEMA), 1)
    assert _rows(encoder.encoded()) == _batch(spark, FIRST + SECOND, _model(spark), _dicts(spark, SMALL, FULL), 12)


def test_an_empty_batch_and_another_vocabulary(spark, tmp_path):
    encoder = _encoder(spark, tmp_path)
    encoder(spark.createDataFrame([], SCHEMA), 0)
    assert encoder.table().count() == 0 and encoder.encoded().count() == 0
    other = encoding.Encoder(spark, unigram.finalize(unigram.seed_pieces(
        spark.createDataFrame([("haus", 2)], "w string, f long")).select("piece", "lp"), 50), KEYS,
        str(tmp_path / "words"), str(tmp_path / "out2"))
    assert other.table_dir != encoder.table_dir
