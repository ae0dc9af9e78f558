"""Plan API, SQL names, reports and the command line."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from corpusloom import cli
from corpusloom.functions import register
from corpusloom.operators import batching, cluster, features
from corpusloom.plans import config, plan, report
from corpusloom.sources import pcm


def test_plan_views(spark):
    lexicon = spark.createDataFrame([("lead", ["a", "b"], [30, 10])], "word string, patterns array<string>, counts array<long>")
    texts = spark.createDataFrame([(1, "Lead a row")], "uid int, text string")
    p = plan.analyze(texts, lexicon, marked=spark.createDataFrame([(1, 0, 1)], "uid int, idx int, code int"))
    per = plan.complexity(p)
    table = {r["index"]: r for r in plan.complexity_table(p).collect()}
    assert (table[0].readings, table[0].code, table[0].source, round(table[0].confidence, 3)) == (2, 1, "user", 0.25)
    assert (table[1].code, table[1].confidence, table[1].source) == (None, None, "unambiguous")
    lost = spark.createDataFrame([(1, 2, "no reading"), (1, 9, "gone")], "uid int, idx int, reason string")
    lines = plan.complexity_report(p, texts, per, lost).first().report.split("\n")
    assert lines[0] == "text: Lead a row" and lines[1].startswith("sentence difficulty 0.") and lines[2] == ""
    assert lines[3] == "  #  word             read    diff  depth    conf  source" and lines[4] == "-" * 62
    assert lines[5] == "  0  Lead                2   0.000      3   0.250  user"
    assert lines[6] == "  1  a                   1   0.000      3       -  unambiguous"
    assert lines[8:] == ["", "diacritics that could not be applied:", "  row: no reading", "  #9: gone"]
    got = plan.to_dict(p, texts, per).first()
    assert got.text == "Lead a row" and got.overrides == {"0": 1} and [w.word for w in got.words] == ["Lead", "a", "row"]


def test_prepare_inputs(spark):
    lexicon = spark.createDataFrame([("lead", ["a", "b"], [30, 10])], "word string, patterns array<string>, counts array<long>")
    texts = spark.createDataFrame([(1, "Lead it"), (2, "..."), (3, None), (4, " a  b ")], "uid int, text string")
    rows = {r.uid: r for r in plan.prepare_inputs(texts, lexicon, {" ": 4, "l": 5, "e": 6, "a": 7, "d": 8}).collect()}
    assert sorted(rows) == [1, 4]
    assert rows[1].text == "lead it" and rows[1].words == ["lead", "it"] and rows[1].n_codes == [2, 1]
    assert rows[1].ids == [1, 5, 6, 7, 8, 4, 3, 3, 2] and rows[1].word_index == [-1, 0, 0, 0, 0, -1, 1, 1, -1]
    assert len(rows[1].variants) == 9 and rows[4].variants == [0] * 5  # "a b" is shorter than what was typed


def test_sql_names(spark):
    assert "tokenize_with_offsets" in register.register(spark)
    got = spark.sql("select t.* from values ('ab, c9'), (null) as d(text), lateral tokenize_with_offsets(text) t order by start").collect()
    assert [tuple(r) for r in got] == [(0, "ab", 0, 2), (1, "c9", 4, 6)]
    row = spark.sql("select number_words(n) as w, verbalize(t) as v from values (3L, 'a 3'), (null, null) as x(n, t)").collect()
    assert row[0].w and row[0].v and row[1].w is None and row[1].v is None


def test_reports():
    assert report.table_lines(["a", "long"], [["xyz", 1]]) == ["a    long", "---------", "xyz  1   "]
    assert report.table_lines(["a"], []) == ["a", "-"]
    assert [report.spoken_seconds(s) for s in (-1, 59.94, 60, 3599, 3660)] == ["0.0s", "59.9s", "1m 0s", "59m 59s", "1h 1m"]
    said = []
    with pytest.raises(ValueError), report.stage("one", said.append):
        raise ValueError
    assert said[0] == "one" and said[1].startswith("one FAILED after")
    now = iter([0.0, 2.0])
    rate = report.Throughput(lambda: next(now))
    rate.update(6)
    rate.update(4)
    assert rate.rate() == (1.0, 5.0)
    checks = report.Preflight()
    checks.check("fine")(lambda: "ok")
    checks.check("bad")(lambda: 1 / 0)
    assert not checks.passed and checks.lines() == ["PASS  fine: ok", "FAIL  bad: ZeroDivisionError: division by zero"]


def test_command(spark, tmp_path):
    (tmp_path / "metadata.csv").write_text("file_name,transcript,duration\n" + "".join(f"{i}.wav,عِلم {w},1\n" for i, w in enumerate(["عَلَم", "كِتاب"] * 10)), encoding="utf-8")
    out = str(tmp_path / "out")
    tables = cli.run(spark, str(tmp_path), out, limit=12)
    assert sorted(tables) == sorted(cli.STAGES) and tables["manifest"].count() == 12 and tables["vocab"].count() > 5
    assert {r.text for r in tables["manifest"].collect()} == {"علم علم", "علم كتاب"}  # normalised
    words = {(r.word, r.pattern): r.n for r in tables["lexicon"].collect()}  # mined from the raw text, by folded words
    assert len(words) == 3 and sum(words.values()) == 24 and sorted({w for w, _ in words}) == ["علم", "كتاب"]
    assert cli.run(spark, str(tmp_path), out, "manifest")["manifest"].count() == 12  # made once
    assert cli.run(spark, str(tmp_path), out, "vocab", force=True)["manifest"].count() == 12  # force names its stage only
    assert cli.run(spark, str(tmp_path), out, "vocab", force=True, upstream=True)["manifest"].count() == 20


def test_command_skips_and_aligns(spark, tmp_path, caplog):
    """Every reason to skip a row, durations from headers, splits kept, and labels from marked transcripts with other word counts."""
    (tmp_path / "wavs").mkdir()
    for name, seconds in (("ok1", 2), ("ok2", 3), ("ok3", 2), ("short", 0.2), ("long", 30)):
        (tmp_path / f"wavs/{name}.wav").write_bytes(pcm.encode(np.zeros(int(seconds * 100)), 100))
    rows = [
        ("ok1", "wavs/ok1.wav", "عندي ٣ كتب", None, "dev"), ("ok2", "wavs/ok2.wav", "عِلم كتير", 2.5, None), ("ok3", "wavs/ok3.wav", "كتاب", None, "train"), ("short", "wavs/short.wav", "كتاب", 0.0, None), ("long", "wavs/long.wav", "كتاب", None, None),
        ("gone", "wavs/gone.wav", "كتاب", 2.0, None), ("blank", "wavs/ok1.wav", " - ", None, None), ("wordy", "wavs/ok1.wav", "كلمة " * 60, None, None), ("huge", "wavs/ok1.wav", "كلمة " * 120, None, None), ("nowhere", None, "كتاب", 2.0, None),
    ]
    spark.createDataFrame(rows, "id string, path string, text string, duration double, split string").coalesce(1).write.json(str(tmp_path / "metadata/all.jsonl"))
    marked = [("ok1", "عندي تلاتة كتب", "عَندي! تلاتَة كُتُب"), ("ok2", "علم كتير", "عِلم، زيادة كِتير"), ("other", "علم", "عَلَم")]
    spark.createDataFrame(marked, "uid string, text string, diacritized string").coalesce(1).write.json(str(tmp_path / "diacritized.jsonl"))
    settings = config.Config(text=config.Text(max_words=40, max_chars=400), discovery=config.Discovery(min_word_freq=1, min_pattern_count=1))
    with caplog.at_level("INFO", logger="corpusloom"):
        tables = cli.run(spark, str(tmp_path), str(tmp_path / "out"), settings=settings, audio=True)
    kept = {r.uid: r for r in tables["manifest"].collect()}
    assert sorted(kept) == ["ok1", "ok2", "ok3"] and (kept["ok1"].duration, kept["ok2"].duration, kept["ok3"].duration) == (2.0, 2.5, 2.0)
    assert kept["ok1"].text == "عندي تلاتة كتب" and kept["ok2"].text == "علم كتير" and kept["ok1"].split == "dev" and kept["ok3"].split == "train" and kept["ok2"].split
    said = "\n".join(caplog.messages)
    for reason, n in (("no_path", 1), ("missing_audio", 1), ("empty_text", 1), ("too_long_text", 1), ("duration", 2), ("word_count", 1)):
        assert any(line.split() == [reason, str(n)] for line in caplog.messages), said
    assert "KEPT ONLY 30% OF THE CORPUS; largest cause: duration (2)" in said
    lexicon = {r.word: r.example for r in tables["lexicon"].collect()}
    assert lexicon["علم"] == "عِلم" and lexicon["كتب"] == "كُتُب" and lexicon["كتير"] == "كِتير" and "زيادة" not in lexicon  # "other" isn't in the manifest
    variants = {r.uid: len(r.variants) for r in tables["variants"].collect()}
    assert variants == {"ok1": len("عندي تلاتة كتب"), "ok2": len("علم كتير")}
    with pytest.raises(ValueError, match="every utterance was filtered out"):
        cli.run(spark, str(tmp_path), str(tmp_path / "none"), "manifest", settings=config.Config(text=config.Text(min_duration=50.0, max_duration=60.0)))
    with pytest.raises(FileNotFoundError):
        cli.run(spark, str(tmp_path), str(tmp_path / "out"), "lexicon", force=True, marked=str(tmp_path / "nothing.jsonl"))


def test_slices_and_codes(spark):
    buffer = spark.range(5).select(F.col("id").alias("pos"), (F.col("id") * 10).alias("value"))
    offsets = lambda rows: spark.createDataFrame(rows, "uid int, start long, length int")
    got = {r.uid: r["values"] for r in batching.ragged_slices(buffer, offsets([(1, 1, 3), (2, 0, 0), (3, 2, 2)]), "uid").collect()}
    assert got == {1: [10, 20, 30], 2: [], 3: [20, 30]}
    with pytest.raises(Exception, match="ends within the slice of 4"):
        batching.ragged_slices(buffer, offsets([(4, 3, 3)]), "uid").collect()
    plan_rows = spark.createDataFrame([(1, 0, 2, 1), (1, 1, 1, 0)], "uid int, idx int, n_codes int, code int")
    index = spark.createDataFrame([(1, [-1, 0, 0, -1, 1]), (2, [-1, -1])], "uid int, word_index array<int>")
    assert {r.uid: r.codes for r in batching.plan_char_codes(plan_rows, index, 7).collect()} == {1: [7, 1, 1, 7, 7], 2: [7, 7]}


def test_vectors(spark):
    rows = spark.createDataFrame([(1, 0, 5), (1, 9, 1)], "uid int, idx int, code int")
    vectors = spark.createDataFrame([(1, [[1.0, 2.0]])], "uid int, vectors array<array<double>>")
    assert [r.vector for r in features.label_vectors(rows, vectors).collect()] == [[1.0, 2.0]]
    shares = spark.createDataFrame([("a", 2, 0.5), ("a", 1, 0.5), ("b", 3, 0.1)], "k string, item int, share double")
    assert {r.k: r.item for r in features.draw(shares, "k", "item", "share", temperature=0).collect()} == {"a": 1, "b": 3}
    cold = {r.k: r.item for r in features.draw(spark.createDataFrame([(str(i), j, 0.4 + 0.2 * j) for i in range(50) for j in (0, 1)], "k string, item int, share double"), "k", "item", "share", temperature=0.02).collect()}
    assert set(cold.values()) == {1}
    x = np.random.default_rng(0).normal(size=(40, 6)) @ np.diag([9, 5, 1, 0.1, 0.1, 0.1])
    mean, axes, scale = cluster.fit_projection(x, 2)
    low = cluster.whitened(x, 2)
    assert low.shape == (40, 2) and np.allclose(mean, x.mean(0)) and scale > 0 and pd.notna(axes).all()
