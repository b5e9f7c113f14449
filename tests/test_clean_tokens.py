"""P1-P6, K2, K5 goldens (FIXTURES section 4) and plan checks."""

from pyspark.sql import functions as F

from corpuskit.operators import clean, tokens


def test_sentence_split_and_filter(spark):
    df = spark.createDataFrame([(1, "Hej. Det er en test! Ja.")], "doc_id long, text string")
    s = clean.keep_sentences(clean.split_sentences(df))
    assert [r.sent for r in s.collect()] == ["Det er en test!"]


def test_pretokenise_golden(spark):
    df = spark.createDataFrame([(1, "kat_2 koster 3,5 kr.!?")], "doc_id long, text string")
    t = tokens.pretokenise(df, "text", keep=["doc_id"]).orderBy("tok_no")
    assert [r.token for r in t.collect()] == ["kat_2", "koster", "3", ",", "5", "kr", ".!?"]


def test_line_filters(spark):
    df = spark.createDataFrame([(1, '<doc id="1">\nx\n   \na</doc>')], "doc_id long, text string")
    out = clean.corpus_lines(df.withColumn("lang", F.lit("da")).withColumn("source", F.lit("s")))
    assert [r.text for r in out.collect()] == ["x"]


def test_special_tokens_in_raw_text(spark):
    df = spark.createDataFrame([(1, "Hej <mask> og <S> </s>")], "doc_id long, text string")
    found = tokens.special_tokens(df, "text", keep=["doc_id"]).orderBy("tok_no").collect()
    assert [(r.token, r.token_id) for r in found] == [("<mask>", 4), ("</s>", 2)]


def _tokens(spark, text, **kw):
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    return [r.token for r in tokens.pretokenise(df, "text", keep=["doc_id"], **kw).orderBy("tok_no").collect()]


def test_text_is_normalised_before_it_is_cut(spark):
    assert _tokens(spark, "20 m² Raum") == ["20", "m2", "raum"]
    assert _tokens(spark, "№5 ﬁsch Ｋat") == ["no5", "fisch", "kat"]
    assert _tokens(spark, "Cafe\u0301 \u1112\u1161") == ["caf\u00e9", "\ud558"]


def test_special_tokens_come_before_nfkc(spark):
    # one in the raw text counts; one that only NFKC makes is ordinary text
    assert _tokens(spark, "m² <mask> ＜mask＞ ＜/s＞", with_specials=True) == ["m2", "<mask>", "<", "mask", ">", "</", "s", ">"]


def test_stable_ranges_hold_no_character_that_nfkc_changes():
    import re
    import unicodedata
    from corpuskit.functions import patterns as P
    stable = re.compile("[" + P.NFKC_STABLE + "]")
    for c in (chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000):
        if stable.match(c):
            assert unicodedata.normalize("NFKC", c) == c and not unicodedata.combining(c), hex(ord(c))


def test_only_changing_rows_go_through_python(spark):
    df = spark.createDataFrame([(1, "plain äöü"), (2, "m²"), (3, None)], "doc_id long, text string")
    out = {r.doc_id: r.text for r in tokens.normalise(df).collect()}
    assert out == {1: "plain äöü", 2: "m2", 3: None}


def test_single_word_specials(spark):
    df = spark.createDataFrame([(1, "a<mask> <mask> <s>x (</s>)")], "doc_id long, text string")
    found = tokens.special_tokens(df, "text", keep=["doc_id"], single_word=True).orderBy("tok_no").collect()
    assert [r.token for r in found] == ["<mask>", "</s>"]


def _page(spark, html):
    df = spark.createDataFrame([(1, html)], "page_id long, html string")
    return [r.text for r in clean.page_lines(df).orderBy("line_no").collect()]


def test_html_blocks_end_at_their_own_tag(spark):
    assert _page(spark, "<head><script>var a;</script><title>SECRET</title></head><p>shown</p>") == ["shown"]
    assert _page(spark, "<header>Top</header><nav><style>x{}</style>menu</nav><p>shown</p>") == ["Top", "shown"]


def test_html_entities(spark):
    assert _page(spark, "<p>&uuml;ber &#8217;x&#x2019; &euro;5 &nope; AT&T &amp;lt; a &lt; b &#xD800; &</p>") == [
        "über \u2019x\u2019 €5 &nope; AT&T &lt; a < b &#xD800; &"]


def test_sentence_text_needs_no_shuffle(spark):
    df = spark.createDataFrame([(1, "da", "s", "Ja. Det er en test!  Kom nu her. Hej\nNej")], "doc_id long, lang string, source string, text string")
    out = clean.sentence_text(df)
    assert [(r.line_no, r.text) for r in out.collect()] == [(0, "Det er en test!\nKom nu her.")]
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()


def test_html_text(spark):
    html = ("<html><head><title>T</title><style>p{}</style></head><body><nav>menu</nav>"
            "<!-- c --><p>Hello &amp; bye</p><p>Next<br>line</p><script>var x='</p>';</script></body></html>")
    df = spark.createDataFrame([(1, html)], "page_id long, html string")
    out = [r.text for r in clean.page_lines(df).orderBy("line_no").collect()]
    assert out == ["Hello & bye", "Next", "line"]


def test_cleaning_is_one_stage(spark):
    df = spark.createDataFrame([(1, "da", "s", "A b. C d.")], "doc_id long, lang string, source string, text string")
    plan = clean.sentences(df)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "BatchEvalPython" not in plan


def test_line_breaks_are_those_of_the_pattern(spark):
    import re

    from corpuskit.functions import patterns as P
    texts = ["a\r\nb", "a\r\r\nb\n\rc", "\r", "\n\n", "", "a\r", "\r\n\r\n", "a\u0085b\u2028c\x0bd", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {}
    for r in clean.split_lines(df).orderBy("doc_id", "line_no").collect():
        got.setdefault(r.doc_id, []).append(r.text)
    assert got == {i: re.split(P.LINE_BREAK, t) for i, t in enumerate(texts) if t is not None}


ODD = ["Kat kat, KAT. kat,", "ΟΔΟΣ ΟΔΟΣ. ΟΔΟΣ ΣΑΣ Σ", "x \u0308y cafe\u0301 caf\u00e9", "№5 ﬁsch Ｋat m²  20", "a\u00a0b\u2003c\td\x0be",
       "  ", "", "<mask> <S> _x_9 a-b…", "İstanbul ISTANBUL ſ", "\u1112 \u1161 \u1112\u1161", "Kat, " * 50, None]


def test_counted_words_are_those_of_the_pretokens(spark):
    df = spark.createDataFrame([(i % 2, t) for i, t in enumerate(ODD)] + [(None, "kat Kat")], "lang long, sent string")
    rows = lambda x: sorted(map(tuple, x.collect()), key=str)
    pretokens = tokens.pretokenise(df, "sent", keep=["lang"])
    assert rows(tokens.count_words(df, "sent")) == rows(tokens.word_freq(pretokens))
    per = pretokens.groupBy("lang", F.col("token").alias("w")).agg(F.count(F.lit(1)).alias("f"))
    assert rows(tokens.count_words(df, "sent", ["lang"]).select("lang", "w", "f")) == rows(per)


def test_corpus_words_normalise_no_text_twice(spark, tmp_path, monkeypatch):
    """The words of a corpus: what goes through NFKC and the pre-tokeniser are the
    distinct stretches between blanks, however often they occur."""
    from corpuskit.plans import catalog
    text = "\n".join(f"Die Katze sieht den Hund {i % 3}." for i in range(500))
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame([(1, "de", "s", text)], "doc_id long, lang string, source string, text string").write.parquet(path)
    seen, plain = [], tokens.normalise
    monkeypatch.setattr(tokens, "normalise", lambda df, *a: seen.append(df.count()) or plain(df, *a))
    words = {r.w: r.f for r in catalog.corpus_words(spark, str(tmp_path)).collect()}
    assert words["katze"] == 500 and words["."] == 500 and words["2"] == 166
    assert seen == [8]  # 5 words and 3 numbers with their stop


def test_token_pattern_for_the_jvm_is_the_given_one(spark):
    """Every character of the first planes by itself, next to a letter and next to a mark."""
    from corpuskit.functions import patterns as P
    chars = [chr(c) for c in range(1, 0x30000) if not 0xD800 <= c < 0xE000]
    df = spark.createDataFrame([("".join(f"{c}a{c}-" for c in chars[i:i + 4096]),) for i in range(0, len(chars), 4096)], "t string")
    given = F.regexp_extract_all(F.lower("t"), F.lit(P.TOKEN), 0)
    assert df.where(~given.eqNullSafe(tokens.token_array(F.col("t")))).count() == 0
