"""P5 with learnt abbreviations: goldens on a small corpus."""

from pyspark.sql import functions as F

from corpuskit.operators import abbreviations as A

LINES = (["Das gilt z.B. hier.  Dr. Kunze kam.", "Prof. Adam, ca. zehn Leute und Dr. Bo. Alle gingen heim.",
          "Sie gingen heim und Adam blieb. Bo kam oft und kam oft heim.", "Wer war hier? Prof. Ada war hier."] * 6
         + ["Ein Satz mit Wortende. Ein Satz mit Wortende."] * 3 + ["Was z.B. Katzen tun. Kunze schlief."] * 2)


def frame(spark, lines=LINES, lang="de"):
    return spark.createDataFrame([(i, lang, t) for i, t in enumerate(lines)], "id int, lang string, text string")


def test_the_list(spark):
    counts = A.abbreviation_counts(frame(spark))
    by_word = {r.word: (r.n_stop, r.n_plain, r.n_lower) for r in counts.collect()}
    assert by_word["z.b"] == (8, 0, 6) and by_word["ca"] == (6, 0, 6) and by_word["dr"] == (12, 0, 0)
    assert by_word["hier"] == (12, 6, 0) and by_word["wortende"] == (6, 0, 0)
    # "wortende" is long and always ends its sentence; "hier", "heim" and "kam" also lack the stop
    got = sorted(r.word for r in A.abbreviations(counts).collect())
    assert got == ["ca", "dr", "prof", "z.b"]


def sentences(spark, lines, lang="de"):
    known = A.abbreviation_counts(frame(spark))
    rows = A.split_sentences(frame(spark, lines, lang), known).collect()
    return [[r.sent for r in sorted(rows, key=lambda r: r.sent_no) if r.id == i] for i in range(len(lines))]


def test_no_boundary_after_an_abbreviation(spark):
    got = sentences(spark, ["Das gilt z.B. Hunden.  Dr. Kunze kam!", "(Prof. Ada) ging. Dr.", "Kein Ende", "", "Dr.  Adam.", "xDr. Adam"])
    assert got == [["Das gilt z.B. Hunden.", "Dr. Kunze kam!"], ["(Prof. Ada) ging.", "Dr."], ["Kein Ende"], [""],
                   ["Dr.  Adam."], ["xDr.", "Adam"]]
    # another language has its own list
    assert sentences(spark, ["Dr. Kunze kam."], "da") == [["Dr.", "Kunze kam."]]
    assert sentences(spark, ["Dr. Kunze kam."], None) == [["Dr.", "Kunze kam."]]


def test_null_language_and_empty_table(spark):
    counts = A.abbreviation_counts(frame(spark, lang=None))
    rows = A.split_sentences(frame(spark, ["Dr. Kunze kam. Ende."], None), counts).collect()
    assert sorted(r.sent for r in rows) == ["Dr. Kunze kam.", "Ende."]
    none = frame(spark).limit(0)
    assert A.split_sentences(none, A.abbreviation_counts(none)).count() == 0
    left = A.split_sentences(frame(spark, ["A. B. C"]), A.abbreviation_counts(none)).select(F.col("sent")).collect()
    assert [r.sent for r in left] == ["A.", "B.", "C"]
