"""P1 and S4 on wiki markup: goldens, and folding against plain rewriting."""

import random

from pyspark.sql import functions as F

from corpuskit.functions.patterns import WIKI_DROP_NAMESPACES
from corpuskit.functions.wikitext import BRACKETS, fold, link_text
from corpuskit.operators import clean
from corpuskit.sources import xml

DROP = frozenset(WIKI_DROP_NAMESPACES)
GOLDENS = [
    ("a {{b|{{c}} d}} e", "a e"),
    ("[[Kat]] og [[Hund|hunden]] og [[Ulv|]]", "Kat og hunden og Ulv"),
    ("[[Fil:x.jpg|thumb|en [[kat|kats]] hale]]Tekst [[Kategori:Dyr]]", "Tekst "),
    ("[[:Kategori:Dyr]]", "Kategori:Dyr"),
    ("x{{a|}} y", "x y"),
    ("foran\n{| class=a\n| {{b}} || [[c]]\n|}\nefter", "foran\n\nefter"),
    ("{{åben [[a]] uden ende", "{{åben a uden ende"),
    ("uden start }} og ]] slut", "uden start }} og ]] slut"),
    ("'''Fed''' ''kursiv''", "Fed kursiv"),
    ("== Overskrift ==\n* punkt\n## to", "Overskrift\npunkt\nto"),
    ("se [https://x.org/a siden] nu<ref>{{bog}}</ref><ref name=b />.", "se siden nu."),
    ("a<!-- {{ -->b &amp; c__TOC__", "ab & c"),
    ("", ""),
    (None, None),
]


def test_goldens(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(GOLDENS)], "page_id int, text string")
    got = {r.page_id: r.t for r in df.select("page_id", clean.wikitext_text(F.col("text")).alias("t")).collect()}
    assert [got[i] for i in range(len(GOLDENS))] == [want for _, want in GOLDENS]


def rewritten(text):
    """Take the first closing bracket with an open one of its kind before it, resolve, start again."""
    pairs = {"}}": "{{", "]]": "[[", "|}": "{|"}
    parts = [(p, i % 2 == 1) for i, p in enumerate(BRACKETS.split(text))]
    while True:
        for i, (p, is_bracket) in enumerate(parts):
            kind = p.strip(" \t:") if is_bracket else ""
            opens = [j for j in range(i) if parts[j][1] and parts[j][0].strip(" \t:") == pairs.get(kind)]
            if kind in pairs and opens:
                body = "".join(x for x, _ in parts[opens[-1] + 1:i])
                parts[opens[-1]:i + 1] = [(link_text(body, DROP) if kind == "]]" else "", False)]
                break
        else:
            return "".join(x for x, _ in parts)


def test_fold_equals_rewriting():
    rng = random.Random(7)
    bits = ["{{", "}}", "[[", "]]", "\n{|", "\n|}", "|", "a", "b ", "File:", "\n", "{", "}", ":"]
    for _ in range(3000):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(25)))
        assert fold(text, DROP) == rewritten(text), text


def test_fold_is_linear_in_open_brackets():
    n = 200_000
    assert fold("[[" * n + "x", DROP) == "[[" * n + "x"
    assert fold("{{" + "[[" * n + "}}x", DROP) == "x"
    assert fold("{{" * n + "}}" * n, DROP) == ""


def test_lines_of_articles(spark, tmp_path):
    page = "<page><title>{t}</title><ns>{ns}</ns><id>{i}</id>{r}<revision><id>1</id><text>{x}</text></revision></page>"
    rows = [("A", 0, 1, "", "{{i|a}}Hej [[verden|alle]]\n\n== B ==\nSlut"), ("Diskussion:A", 1, 2, "", "nej"),
            ("B", 0, 3, '<redirect title="A" />', "#REDIRECT [[A]]")]
    path = tmp_path / "dump.xml"
    path.write_text("<mediawiki>" + "".join(page.format(t=t, ns=n, i=i, r=r, x=x) for t, n, i, r, x in rows) + "</mediawiki>")
    assert xml.read_dump_pages(spark, str(path)).count() == 3
    pages = xml.read_dump_pages(spark, str(path), articles_only=True)
    got = sorted((r.page_id, r.line_no, r.text) for r in clean.wiki_lines(pages).collect())
    assert got == [(1, 0, "Hej alle"), (1, 2, "B"), (1, 3, "Slut")]
