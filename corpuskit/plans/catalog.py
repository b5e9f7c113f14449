"""Registered queries: one per operator of the survey's inventory.

Each query takes ``(spark, sf_dir)``, reads the given parquet tables and
returns a DataFrame whose columns match the DuckDB oracle in ``oracle.py``.
Array results are also rendered as strings so the oracle can compare them.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..operators import abbreviations, clean, compound, encode, evaluate, lexicon, mlm, sampling, tokens, unigram
from ..functions.joins import lookup_join
from ..session import cut_lineage, ensure_checkpoint_dir, forget, read_table, stored, table_path
from ..sources import csv, jsonl
from ..streaming import encoding

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(name: str):
    def register(fn):
        QUERIES[name] = fn
        return fn
    return register


# --- shared building blocks ---------------------------------------------------

def documents(spark, d):
    return read_table(spark, d, "documents").select("doc_id", "lang", "source", "text")


def kept_sentences(spark, d):
    return clean.sentences(documents(spark, d))


def sentence_tokens(spark, d):
    return tokens.pretokenise(kept_sentences(spark, d), "sent", keep=["doc_id", "lang", "line_no", "sent_no"])


def corpus_words(spark, d):
    """Distinct pre-tokens of the kept sentences with frequencies (K3),
    materialised once: every later step (splits, lattices, joins) reads it."""
    return stored(tokens.count_words(kept_sentences(spark, d), "sent"))


def lang_words(spark, d):
    """The same per language: ``(lang, w, f)``."""
    return stored(tokens.count_words(kept_sentences(spark, d), "sent", ["lang"]))


def derived_lexicon(spark, d):
    """The stand-in dictionary (small), materialised once: both word lists,
    their scalar subqueries and size checks read it."""
    return cut_lineage(lexicon.derive_lexicon(read_table(spark, d, "documents")))


def dictionaries(spark, d):
    """Both word lists, materialised once (small; read by size checks and joins)."""
    return cut_lineage(lexicon.dictionaries(derived_lexicon(spark, d)))


def _join_ints(c):
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",")


# --- S1, P2-P6, K2, K3: corpus and tokens ---------------------------------------

@query("lang_stats")
def lang_stats(spark, d):
    """Flagship: sentences, pre-tokens and distinct pre-tokens per language."""
    # One pass: a sentence's first row (token 0, or the only row of a sentence
    # without pre-tokens) counts the sentence.  The (lang, token) aggregate is
    # combined map-side; the per-language one is tiny.
    t = tokens.pretokenise(kept_sentences(spark, d), "sent", keep=["lang"], keep_empty=True)
    per_type = t.groupBy("lang", "token").agg(F.count("token").alias("n"),
                                              F.sum((F.coalesce("tok_no", F.lit(0)) == 0).cast("long")).alias("firsts"))
    return per_type.groupBy("lang").agg(F.sum("firsts").cast("bigint").alias("n_sentences"),
                                        F.sum("n").cast("bigint").alias("n_tokens"),
                                        F.count("token").alias("n_types"))


@query("corpus_lines")
def corpus_lines(spark, d):
    return clean.corpus_lines(documents(spark, d)).select(
        "doc_id", "lang", "source", F.col("line_no").cast("bigint").alias("line_no"), "text")


@query("sentence_split")
def sentence_split(spark, d):
    s = clean.split_sentences(clean.corpus_lines(documents(spark, d)))
    return s.select("doc_id", "lang", F.col("line_no").cast("bigint").alias("line_no"),
                    F.col("sent_no").cast("bigint").alias("sent_no"), "sent")


def titled_lines(spark, d):
    """Stand-in for text with abbreviations: a title or "ca." before some words of every line."""
    titled = F.regexp_replace(F.regexp_replace("text", r"([.!?]) (\p{Lu})", "$1 Dr. $2"), r" (\p{Ll}{9,}) ", " ca. $1 ")
    return clean.corpus_lines(documents(spark, d)).select(
        "doc_id", "lang", F.col("line_no").cast("bigint").alias("line_no"), titled.alias("text"))


@query("abbreviation_list")
def abbreviation_list(spark, d):
    """P5: the words of the corpus that are abbreviations, with their counts."""
    return abbreviations.abbreviations(cut_lineage(abbreviations.abbreviation_counts(titled_lines(spark, d))))


@query("sentence_split_learnt")
def sentence_split_learnt(spark, d):
    """P5 with the learnt abbreviations."""
    lines = titled_lines(spark, d)
    s = abbreviations.split_sentences(lines, cut_lineage(abbreviations.abbreviation_counts(lines)))
    return s.select("doc_id", "lang", "line_no", F.col("sent_no").cast("bigint").alias("sent_no"), "sent")


@query("sentence_filter")
def sentence_filter(spark, d):
    return kept_sentences(spark, d).select(
        "doc_id", "lang", F.col("line_no").cast("bigint").alias("line_no"),
        F.col("sent_no").cast("bigint").alias("sent_no"), "sent")


@query("sentence_text")
def sentence_text(spark, d):
    return clean.sentence_text(documents(spark, d)).select(
        "doc_id", F.col("line_no").cast("bigint").alias("line_no"), "text")


@query("normalise")
def normalise(spark, d):
    """K1: kept sentences after NFKC and lower-casing."""
    s = tokens.normalise(kept_sentences(spark, d), "sent")
    return s.select("doc_id", F.col("line_no").cast("bigint").alias("line_no"),
                    F.col("sent_no").cast("bigint").alias("sent_no"), F.lower("sent").alias("sent"))


@query("pretokenise")
def pretokenise(spark, d):
    return sentence_tokens(spark, d).select(
        "doc_id", F.col("line_no").cast("bigint").alias("line_no"), F.col("sent_no").cast("bigint").alias("sent_no"),
        F.col("tok_no").cast("bigint").alias("tok_no"), "token")


@query("word_freq")
def word_freq(spark, d):
    return corpus_words(spark, d)


@query("special_token_scan")
def special_token_scan(spark, d):
    """K5 over the raw text of all three text tables."""
    conv = read_table(spark, d, "conversations").select(F.col("conv_id").alias("rec_id"), "text")
    docs = read_table(spark, d, "documents").select(F.col("doc_id").alias("rec_id"), "text")
    bench = read_table(spark, d, "benchmark").select(F.col("item_id").alias("rec_id"), "text")
    both = sampling.concat_corpora({"documents": docs, "conversations": conv, "benchmark": bench})
    found = tokens.special_tokens(both, "text", keep=["origin", "rec_id"])
    return found.groupBy("origin", "token", "token_id").agg(F.count(F.lit(1)).alias("n"))


# --- S2, P1, U1, U2: other sources ------------------------------------------------

@query("json_field")
def json_field(spark, d):
    ev = read_table(spark, d, "events")
    return ev.select("event_id", jsonl.json_field(F.col("props"), "k").alias("k"))


@query("page_text")
def page_text(spark, d):
    return clean.page_lines(read_table(spark, d, "pages")).select(
        "page_id", F.col("line_no").cast("bigint").alias("line_no"), "text")


def wiki_pages(spark, d):
    """Stand-in for dump pages: every document's text with a page's usual markup around it."""
    docs = read_table(spark, d, "documents")
    head = ["{{Infobox\n| lang = {{lang|", F.col("lang"), "}}\n| from = [[", F.col("source"), "]]\n}}\n'''Page ",
            F.col("doc_id").cast("string"), "'''<ref name=a>{{cite|", F.col("source"), "}}</ref> &amp; [[", F.col("lang"),
            "|the ", F.col("lang"), " part]]<ref name=a />\n== [[Text]] of it ==\n"]
    tail = ["\n{| class=\"x\"\n|-\n| {{n|1}} || [[", F.col("source"), "]]\n|}\n* [[File:a.jpg|thumb|see [[", F.col("source"),
            "|it]] {{clear}}]]''more'' at [https://example.org/ the site]\n# open {{ end\n<!-- [[x -->[[Category:",
            F.col("lang"), "]]__NOTOC__"]
    parts = [F.lit(x) if isinstance(x, str) else x for x in [*head, F.col("text"), *tail]]
    return docs.select(F.col("doc_id").alias("page_id"), F.concat(*parts).alias("text"))


@query("wikitext_lines")
def wikitext_lines(spark, d):
    """P1 on wiki markup: the lines of running text of every page."""
    return clean.wiki_lines(wiki_pages(spark, d)).select("page_id", F.col("line_no").cast("bigint").alias("line_no"), "text")


@query("corpus_concat")
def corpus_concat(spark, d):
    docs = read_table(spark, d, "documents").select(F.col("doc_id").alias("rec_id"), F.lit(0).cast("bigint").alias("part"), "text")
    conv = read_table(spark, d, "conversations").select(F.col("conv_id").alias("rec_id"), F.col("turn").alias("part"), "text")
    bench = read_table(spark, d, "benchmark").select(F.col("item_id").alias("rec_id"), F.lit(0).cast("bigint").alias("part"), "text")
    return sampling.concat_corpora({"documents": docs, "conversations": conv, "benchmark": bench}).select(
        "origin", "rec_id", "part", "text")


@query("corpus_interleave")
def corpus_interleave(spark, d):
    docs = read_table(spark, d, "documents").select("doc_id", "lang")
    return sampling.interleave(docs, "lang", ["doc_id"]).select("lang", "doc_id", "rank", "position")


# --- L1-L11: lexicon ----------------------------------------------------------------

@query("lexicon")
def lexicon_q(spark, d):
    return derived_lexicon(spark, d)


@query("lexicon_explode")
def lexicon_explode(spark, d):
    return lexicon.explode_types(derived_lexicon(spark, d))


@query("noun_rows")
def noun_rows(spark, d):
    return lexicon.noun_rows(derived_lexicon(spark, d))


@query("word_list")
def word_list(spark, d):
    return lexicon.ordered_by_length(lexicon.word_list(derived_lexicon(spark, d), "word"))


@query("small_dictionary")
def small_dictionary(spark, d):
    return lexicon.ordered_by_length(lexicon.small_dictionary(derived_lexicon(spark, d)))


@query("full_dictionary")
def full_dictionary(spark, d):
    return lexicon.ordered_by_length(lexicon.full_dictionary(derived_lexicon(spark, d)))


@query("length_buckets")
def length_buckets(spark, d):
    return lexicon.length_buckets(dictionaries(spark, d))


@query("dictionary_lookup")
def dictionary_lookup(spark, d):
    return compound.word_lookup(corpus_words(spark, d).select("w"), dictionaries(spark, d))


# --- C1-C5: compounds -----------------------------------------------------------------

def _splits(spark, d):
    return compound.compound_splits(corpus_words(spark, d).select("w"), dictionaries(spark, d))


@query("compound_split")
def compound_split(spark, d):
    s = _splits(spark, d)
    return s.select("w", F.size("cuts").cast("bigint").alias("n_cuts"), _join_ints(F.col("cuts")).alias("cuts"),
                    F.array_join("parts", " ").alias("parts"))


@query("compound_parts")
def compound_parts(spark, d):
    s = _splits(spark, d)
    return s.select("w", F.posexplode("parts").alias("part_no", "part")).select(
        "w", F.col("part_no").cast("bigint").alias("part_no"), "part")


@query("compound_tokens")
def compound_tokens(spark, d):
    words = corpus_words(spark, d)
    splits = cut_lineage(compound.compound_splits(words.select("w"), dictionaries(spark, d)).select("w", "parts"))
    out = compound.compound_tokens(sentence_tokens(spark, d).drop("lang"), splits, "token", freq=words)
    return out.select("doc_id", F.col("line_no").cast("bigint").alias("line_no"),
                      F.col("sent_no").cast("bigint").alias("sent_no"), F.col("tok_no").cast("bigint").alias("tok_no"),
                      F.col("part_no").cast("bigint").alias("part_no"), "piece")


# --- U3-U6: split, shuffle, batches ---------------------------------------------------------

SENT_KEY = ["doc_id", "line_no", "sent_no"]


def split_sentences_table(spark, d):
    """Kept sentences with their split, materialised once: words, vocabulary and
    encoding read this table and never the documents again."""
    s = kept_sentences(spark, d).select(
        "doc_id", F.col("line_no").cast("bigint").alias("line_no"), F.col("sent_no").cast("bigint").alias("sent_no"), "sent")
    return sampling.train_test_split(s, SENT_KEY)


@query("train_test_split")
def train_test_split(spark, d):
    return split_sentences_table(spark, d).select(*SENT_KEY, "split", "row_idx")


@query("epoch_shuffle")
def epoch_shuffle(spark, d):
    train = split_sentences_table(spark, d).where(F.col("split") == "train").select(*SENT_KEY)
    return sampling.shuffle_order(train, SENT_KEY, epoch=1).select(*SENT_KEY, F.col("epoch").cast("bigint").alias("epoch"), "position")


@query("batch_assign")
def batch_assign(spark, d):
    test = split_sentences_table(spark, d).where(F.col("split") == "test")
    return sampling.assign_batches(test).select(*SENT_KEY, "row_idx", "batch")


# --- E2, E4-E10, M1-M3: ids, specials, padding, masking (word-level vocabulary) ---------
#
# A word-level vocabulary (ids by frequency) makes every id exactly checkable in
# SQL; the same functions take the Unigram ``(w, ids)`` table (``encode_docs``).

def _table_words(sents):
    """Distinct pre-tokens of a sentence table, materialised once."""
    return stored(tokens.count_words(sents, "sent"))


def _token_rows(spark, d):
    """The sentences with their split as stored pre-tokens: words and ids read
    these, the text is cut into pre-tokens once."""
    sents = split_sentences_table(spark, d)
    rows = encode.token_rows(sents, "sent", [*SENT_KEY, "split", "row_idx"])
    forget(sents)
    return rows


def _sentence_ids(spark, d, split=None, keep=(*SENT_KEY, "split", "row_idx")):
    """``(keys, split, row_idx, ids)`` of the sentences (of one ``split``) and the
    vocabulary, from one tokenisation."""
    rows = _token_rows(spark, d)
    vocab = stored(encode.word_vocab(stored(encode.row_words(rows))))
    wanted = rows if split is None else rows.where(F.col("split") == split)
    return encode.encode_rows(wanted, encode.word_ids_from_vocab(vocab), keep), vocab


@query("vocab_lookup")
def vocab_lookup(spark, d):
    """Every pre-token of the benchmark items looked up in the corpus vocabulary."""
    vocab = cut_lineage(encode.word_vocab(corpus_words(spark, d)))
    wanted = tokens.pretokenise(read_table(spark, d, "benchmark").select("text"), "text", keep=[]).select("token")
    return encode.vocab_lookup(vocab, wanted)


@query("word_vocab")
def word_vocab(spark, d):
    return encode.word_vocab(corpus_words(spark, d)).select("id", "token", "special")


@query("token_ids")
def token_ids(spark, d):
    return _sentence_ids(spark, d)[0].select(*SENT_KEY, F.size("ids").cast("bigint").alias("n_ids"),
                                          _join_ints(F.col("ids")).alias("ids"))


@query("add_specials")
def add_specials(spark, d):
    s, _ = _sentence_ids(spark, d)
    wrapped = encode.add_specials(F.col("ids"), 128)
    return s.select(*SENT_KEY, F.size(wrapped).cast("bigint").alias("n_ids"), _join_ints(wrapped).alias("input_ids"))


@query("truncate")
def truncate(spark, d):
    """E4 alone: ids cut to leave room for the two wrapping ids."""
    s, _ = _sentence_ids(spark, d)
    cut = F.slice(F.col("ids"), 1, 126)
    return s.select(*SENT_KEY, F.size(cut).cast("bigint").alias("n_ids"), _join_ints(cut).alias("ids"))


@query("pad_batch")
def pad_batch(spark, d):
    s = _sentence_ids(spark, d, "train")[0].withColumn("input_ids", encode.add_specials(F.col("ids"), 128))
    p = encode.pad_batches(s)
    return p.select(*SENT_KEY, "row_idx", _join_ints(F.col("input_ids")).alias("input_ids"),
                    _join_ints(F.col("attention_mask")).alias("attention_mask"))


@query("pad_fixed")
def pad_fixed(spark, d):
    s, _ = _sentence_ids(spark, d, "test")
    ids = encode.add_specials(F.col("ids"), 512)
    return s.select(*SENT_KEY, _join_ints(encode.pad_to(ids, 512)).alias("input_ids"),
                    _join_ints(encode.attention_mask(ids, 512)).alias("attention_mask"))


@query("length_views")
def length_views(spark, d):
    """M3: the padded 128-id view of all rows, and the 512-id view of the test rows."""
    s, _ = _sentence_ids(spark, d)
    a, b = (encode.add_specials(F.col("ids"), n) for n in (128, 512))
    test = F.col("split") == "test"
    return s.select(*SENT_KEY, "split", F.size(a).cast("bigint").alias("len_128"), F.size(b).cast("bigint").alias("len_512"),
                    _join_ints(encode.pad_to(a, 128)).alias("view_128"),
                    F.when(test, _join_ints(encode.pad_to(b, 512))).alias("view_512"))


@query("mlm_mask")
def mlm_mask(spark, d):
    s, vocab = _sentence_ids(spark, d, "test")
    s = s.withColumn("input_ids", encode.pad_to(encode.add_specials(F.col("ids"), 512), 512))
    m = mlm.mask(s, SENT_KEY, vocab.count(), epoch=0)
    return m.select(*SENT_KEY, _join_ints(F.col("input_ids")).alias("input_ids"), _join_ints(F.col("labels")).alias("labels"))


@query("mlm_epochs")
def mlm_epochs(spark, d):
    s, vocab = _sentence_ids(spark, d, "train")
    s = s.withColumn("input_ids", encode.add_specials(F.col("ids"), 128))
    s = s.select(*SENT_KEY, "input_ids", F.explode(F.array(F.lit(0).cast("bigint"), F.lit(1).cast("bigint"))).alias("epoch"))
    m = mlm.mask(s, SENT_KEY, vocab.count(), epoch="epoch")
    return m.select(*SENT_KEY, "epoch",
                    F.size(F.filter("labels", lambda x: x != P.IGNORE_INDEX)).cast("bigint").alias("n_selected"),
                    F.size(F.filter("input_ids", lambda x: x == P.MASK_ID)).cast("bigint").alias("n_masked"))


@query("decode_ids")
def decode_ids(spark, d):
    ids, vocab = _sentence_ids(spark, d, keep=SENT_KEY)
    s = ids.select(*SENT_KEY, encode.add_specials(F.col("ids"), 128).alias("ids"))
    dec = encode.decode(s, vocab, SENT_KEY, "ids")
    return dec.select(*SENT_KEY, F.array_join("tokens", " ").alias("text"))


@query("tokeniser_compare")
def tokeniser_compare(spark, d):
    """E11 for the two checkable tokenisers, whitespace and compound parts, per
    language: tokens, share of pre-tokens that stay whole, vocabulary size."""
    per = lang_words(spark, d)
    words = stored(per.select("w").distinct())
    splits = cut_lineage(compound.compound_splits(words, dictionaries(spark, d)).select("w", "parts"))
    joined = lookup_join(per, splits, "w", "left", salt_cols=["lang"]).withColumn("parts", F.coalesce("parts", F.array("w")))
    counts = joined.groupBy("lang").agg(
        F.sum("f").alias("n_pretokens"), F.count(F.lit(1)).alias("n_pretoken_types"),
        F.sum(F.col("f") * F.size("parts")).cast("bigint").alias("n_compound_parts"),
        F.round(F.sum(F.when(F.size("parts") == 1, F.col("f")).otherwise(0)) / F.sum("f"), 6).alias("share_unsplit"))
    types = joined.select("lang", F.explode("parts").alias("part")).groupBy("lang").agg(
        F.countDistinct("part").alias("n_part_types"))
    return counts.join(types, "lang")


# --- Q1-Q3: evaluation on the embeddings table (64 logits, label) -------------------------

@query("mlm_eval")
def mlm_eval(spark, d):
    # four positions a sequence
    e = read_table(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 4).alias("seq_id"), (F.col("vec_id") % 4).alias("pos"),
                                                  F.col("label"), F.col("embedding").alias("logits"))
    m = evaluate.mlm_metrics(e)
    return m.select("n_seqs", "n_scored", *[F.round(c, 6).alias(c) for c in ("perplexity", "perplexity_exact", "accuracy")])


@query("row_loss")
def row_loss(spark, d):
    e = read_table(spark, d, "embeddings").select(F.col("vec_id").alias("row_id"), F.col("label"),
                                                  F.col("embedding").alias("logits"))
    r = evaluate.row_metrics(e)
    return r.select("row_id", F.round("loss", 6).alias("loss"), F.col("correct").cast("bigint").alias("correct"))


# --- V2-V6, E1, Q5: Unigram ------------------------------------------------------------------

def training_words(spark, d):
    """Pre-tokens after compound splitting, with frequencies: the trainer's input."""
    words = corpus_words(spark, d)
    splits = compound.compound_splits(words.select("w"), dictionaries(spark, d))
    parts = (words.join(splits.select("w", "parts"), "w", "left")
                  .select(F.explode(F.coalesce("parts", F.array("w"))).alias("w"), "f"))
    return stored(parts.groupBy("w").agg(F.sum("f").cast("bigint").alias("f")))


@query("lexicon_scan")
def lexicon_scan(spark, d):
    """S3: the derived dictionary through a delimited file and back."""
    path = f"{ensure_checkpoint_dir(spark)}/lexicon-{uuid.uuid4().hex}"
    (derived_lexicon(spark, d).select("base", "word", "type").write.option("sep", ";").option("quote", '"')
     .option("escape", '"').csv(path))
    return csv.read_dictionary(spark, path)


@query("unigram_seed")
def unigram_seed(spark, d):
    s = unigram.seed_pieces(training_words(spark, d))
    return s.select("piece", F.col("freq").cast("bigint").alias("freq"), F.col("score").cast("bigint").alias("score"),
                    F.round("lp", 6).alias("lp"))


def _seed_model(words):
    return cut_lineage(unigram.seed_pieces(words).select("piece", "lp"))


@query("unigram_estep")
def unigram_estep(spark, d):
    words = training_words(spark, d)
    c = unigram.e_step(words, _seed_model(words))
    return c.select("piece", F.round("c", 4).alias("c"))


@query("unigram_mstep")
def unigram_mstep(spark, d):
    words = training_words(spark, d)
    m = unigram.m_step(unigram.e_step(words, _seed_model(words)))
    return m.select("piece", F.round("c", 4).alias("c"), F.round("lp", 6).alias("lp"))


@query("unigram_prune")
def unigram_prune(spark, d):
    words = training_words(spark, d)
    m = cut_lineage(unigram.m_step(unigram.e_step(words, _seed_model(words))).select("piece", "lp"))
    target = max(m.count() // 2, 1)
    return unigram.prune(words, m, target).select("piece", F.round("lp", 6).alias("lp"))


@query("vocab_table")
def vocab_table(spark, d):
    return unigram.train(training_words(spark, d), vocab_size=P.VOCAB_SIZE)


@query("vocab_pruned")
def vocab_pruned(spark, d):
    """V1-V6 to half the size, so that rounds of pruning take place."""
    return unigram.train(training_words(spark, d), vocab_size=P.VOCAB_SIZE // 2)


def _trained_vocab(spark, d):
    """The vocabulary after all rounds of EM and pruning (V1-V6)."""
    return unigram.train(training_words(spark, d), vocab_size=P.VOCAB_SIZE)


def _seed_vocab(words):
    return cut_lineage(unigram.finalize(_seed_model(words), P.VOCAB_SIZE))


@query("unigram_viterbi")
def unigram_viterbi(spark, d):
    words = training_words(spark, d)
    enc = unigram.encode_words(words.select("w"), _seed_vocab(words))
    return enc.select("w", _join_ints(F.col("ids")).alias("ids"), F.array_join("tokens", " ").alias("tokens"),
                      F.round("score", 6).alias("score"))


@query("encode_unk")
def encode_unk(spark, d):
    """Words of the whole corpus encoded with a vocabulary of the benchmark
    items; those with characters that it lacks, and their unknown ids."""
    items = read_table(spark, d, "benchmark").select(F.col("text").alias("sent"))
    seeds = cut_lineage(unigram.seed_pieces(_table_words(items)).select("piece", "lp"))
    vocab = cut_lineage(unigram.finalize(seeds, P.VOCAB_SIZE, seeds.where(F.length("piece") == 1)))
    enc = unigram.encode_words(corpus_words(spark, d).select("w"), vocab)
    unknown = F.filter("ids", lambda x: x == P.UNK_ID)
    return enc.select("w", F.size(unknown).cast("bigint").alias("n_unk")).where(F.col("n_unk") > 0)


@query("encode_docs")
def encode_docs(spark, d):
    return _encoded_docs(spark, d, _seed_vocab(training_words(spark, d)))


@query("encode_trained")
def encode_trained(spark, d):
    """E2-E6 with the trained vocabulary."""
    return _encoded_docs(spark, d, _trained_vocab(spark, d))


@query("encode_stream")
def encode_stream(spark, d):
    """E2-E5 on a stream of the documents' files, a word encoded once in its life; the
    vocabulary is that of ``encode_docs``."""
    folder = f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    table = spark.read.parquet(table_path(d, "documents")).select("doc_id", "lang", "source", "text")
    # as a pattern: a stream's source may then be a folder or a single file
    source = table_path(d, "document[s]")
    files = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 16).parquet(source)
    sents = clean.sentences(files).select("doc_id", *[F.col(c).cast("bigint").alias(c) for c in SENT_KEY[1:]], "sent")
    encoder = encoding.Encoder(spark, _seed_vocab(training_words(spark, d)), SENT_KEY, f"{folder}/words", f"{folder}/ids",
                               dictionaries(spark, d), max_length=128)
    encoding.start_encoding(sents, encoder, folder, once=True).awaitTermination()
    return encoder.encoded().select(*SENT_KEY, _join_ints(F.col("input_ids")).alias("input_ids"))


def _encoded_docs(spark, d, vocab):
    rows = _token_rows(spark, d)
    words = cut_lineage(encode.row_words(rows))
    splits = compound.compound_splits(words.select("w"), dictionaries(spark, d))
    wid = cut_lineage(encode.word_ids_unigram(words, vocab, splits))
    # stored: the padding shuffles them once more, and the tokens are not needed for it
    ids = stored(encode.encode_rows(rows.where(F.col("split") == "train"), wid, [*SENT_KEY, "row_idx"]))
    forget(rows)
    s = ids.withColumn("input_ids", encode.add_specials(F.col("ids"), 128))
    p = encode.pad_batches(s)
    return p.select(*SENT_KEY, _join_ints(F.col("input_ids")).alias("input_ids"),
                    _join_ints(F.col("attention_mask")).alias("attention_mask"))


@query("corpus_perplexity")
def corpus_perplexity(spark, d):
    return _perplexity(spark, d, _seed_vocab(training_words(spark, d)))


@query("trained_perplexity")
def trained_perplexity(spark, d):
    """Q5 under the trained vocabulary."""
    return _perplexity(spark, d, _trained_vocab(spark, d))


@query("tokeniser_compare_trained")
def tokeniser_compare_trained(spark, d):
    """E11, third column: per language, the trained Unigram tokens of the compound
    parts, the share of pre-tokens that stay whole, and the pieces in use."""
    per = lang_words(spark, d)
    words = stored(per.select("w").distinct())
    splits = compound.compound_splits(words, dictionaries(spark, d))
    ids = cut_lineage(encode.word_ids_unigram(words, _trained_vocab(spark, d), splits))
    joined = lookup_join(per, ids, "w", "left", salt_cols=["lang"])
    counts = joined.groupBy("lang").agg(
        F.sum("f").alias("n_pretokens"), F.sum(F.col("f") * F.size("ids")).cast("bigint").alias("n_unigram_tokens"),
        F.round(F.sum(F.when(F.size("ids") == 1, F.col("f")).otherwise(0)) / F.sum("f"), 6).alias("share_whole"))
    types = joined.select("lang", F.explode("ids").alias("id")).distinct().groupBy("lang").agg(
        F.count(F.lit(1)).alias("n_piece_types"))
    return counts.join(types, "lang")


def _perplexity(spark, d, vocab):
    # counted per language and word: occurrences are never joined
    per = lang_words(spark, d)
    words = per.select("w").distinct()
    enc = cut_lineage(unigram.encode_words(words, vocab).select("w", "score", F.size("ids").alias("n_pieces")))
    q = evaluate.corpus_perplexity(lookup_join(per, enc, "w", "left", salt_cols=["lang"]), weight="f")
    return q.select("lang", F.col("n_words").cast("bigint").alias("n_words"), F.col("n_pieces").cast("bigint").alias("n_pieces"),
                    F.round("perplexity", 4).alias("perplexity"))
