"""Arabic fixtures for what the driver's tables, which hold no Arabic, can't show."""

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import chars, marks, translit
from corpusloom.functions.verbalize import verbalize
from corpusloom.operators import corpus, features, sequences
from corpusloom.sources import sinks


def each(spark, values, expr, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, t {kind}")
    return [r.x for r in rows.select("i", expr(F.col("t")).alias("x")).orderBy("i").collect()]


def test_what_is_arabic(spark):
    assert each(spark, ["كتاب", "abc", "٣", "a ب", "", None, "ﷺ"], chars.is_arabic_word) == [True, False, True, True, False, None, False]
    assert each(spark, ["ك", "ء", "ي", "َ", "٣", "a", "ـ"], chars.is_arabic_letter)[:3] == [True, True, True]
    assert each(spark, ["َ", "٣", "a"], chars.is_arabic_letter) == [False, False, False]


def test_folding_and_identity(spark):
    assert each(spark, ["أحمد", "إلى", "آخر", "ٱسم", "على", "مدرسة", "كتاب", None], chars.fold_orthography) == ["احمد", "الي", "اخر", "اسم", "علي", "مدرسه", "كتاب", None]
    assert each(spark, ["عَلَى", "عَلِيّ", "مَدْرَسَة~", "كـتـاب", "«أ»^"], chars.word_identity)[:4] == ["علي", "علي", "مدرسه", "كتاب"]


def test_cleaning(spark):
    assert each(spark, ["كِتا​ب ـ١٢­", "عَلَم ٣"], chars.normalize_characters) == ["كتاب 12", "علم 3"]
    assert each(spark, ["عَلَم"], lambda c: chars.normalize_characters(c, False)) == ["عَلَم"]
    assert each(spark, ["عَلَم، كِتاب! (abc) ١٢", "«قِف»"], chars.strip_junk) == ["عَلَم كِتاب  ", "قِف"]


def test_variant_strings(spark):
    rows = spark.createDataFrame([("قال جيم", "قال جيم"), ("قال جيم", "ق~ال ج~يم"), ("قال جيم", "ق~ا جيم")], "p string, d string")
    got = [r.v for r in rows.select(marks.variant_string(F.col("p"), F.col("d")).alias("v")).collect()]
    assert [len(v) for v in got] == [7, 7, 7] and got[0] == "0000000" and set(got[1]) <= set("012") and got[2][:4] == "0000"


def test_targets_in_their_own_script(spark):
    vocabulary = {"|": 4, "ك": 7, "ت": 8, "ا": 9, "ب": 10, "A": 3, "b": 0, "B": 6}
    got = each(spark, ["كتاب a", "b؟ب", ""], lambda c: translit.native_targets(c, vocabulary))
    assert [[(x["id"], x["source"]) for x in row] for row in got] == [[(7, 0), (8, 1), (9, 2), (10, 3), (4, 4), (3, 5)], [(6, 0), (10, 2)], []]


def test_expanded_targets(spark):
    assert each(spark, [[5, 5, 6], []], lambda c: sequences.expand_targets(c, 0), "array<int>") == [[0, 5, 0, 5, 0, 6, 0], [0]]


def test_means_of_subwords(spark):
    rows = spark.createDataFrame([(1, 0, [1.0, 3.0]), (1, 0, [3.0, 5.0]), (1, 1, [7.0, 7.0])], "uid int, word int, v array<double>")
    got = {(r.uid, r.word): (r["mean"], r.n) for r in features.mean_by(rows, ["uid", "word"], "v", 2).collect()}
    assert got == {(1, 0): ([2.0, 4.0], 2), (1, 1): ([7.0, 7.0], 1)}


def test_manifest_as_json_lines(spark, tmp_path):
    rows = spark.createDataFrame([("1", None, "كتاب", 2.5, "train", "x")], "uid string, audio_path string, text string, duration double, split string, speaker string")
    sinks.write_jsonl(rows, str(tmp_path / "m"))
    line = spark.read.text(str(tmp_path / "m")).first().value
    assert '"text":"كتاب"' in line and '"audio_path":null' in line
    sinks.write_manifest(rows, str(tmp_path / "p"))
    assert (tmp_path / "p/split=train").is_dir()


@pytest.mark.parametrize(
    ("text", "said"),
    [("معايا 10000", "مية"), ("معايا ١٢٣٤٥٦٧٨٩", "واحد"), ("قال: نعم.", "قال نعم"), ("", ""), ("abc", "ايه بي سي")],
)
def test_traps_of_reading(text, said):
    """Four equal digits shrink to two; nine digits are a phone; marks go without a space where punctuation isn't kept."""
    got = verbalize(text, punctuation=False)
    assert said in got and not any(c.isdigit() for c in got)
    assert verbalize("معايا 10000", guard_digits=True) != verbalize("معايا 10000")
    assert verbalize("كلمة،تانية", punctuation=False) == "كلمةتانية"


def test_labels_by_white_space_and_by_words_agree_without_punctuation(spark):
    texts = spark.createDataFrame([("علم كتاب",), ("قال نعم لا",)], "text string")
    row = texts.select(chars.split_spaces(F.col("text")).alias("a"), chars.words(F.col("text")).alias("b")).collect()
    assert all(r.a == r.b for r in row)


def test_marked_words_without_counterpart(spark):
    pairs = spark.createDataFrame([("u", "علم كتاب قال", "عِلم كتاب"), ("v", "علم", None), ("w", None, "عِلم")], "uid string, text string, diacritized string")
    got = sorted((r.uid, r.pos, r.word, r.form) for r in corpus.marked_occurrences(pairs).collect())
    assert got == [("u", 0, "علم", "عِلم"), ("u", 1, "كتاب", "كتاب")]
