import csv
import io
import os
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tonelake.sources.csvranges import Lines, can_split, csv_records, read_csv_ranges
from tonelake.sources.reviews import read_reviews


def inside_after(line, inside):
    """The state after a line by stepping through its characters."""
    state, i = ("quoted" if inside else "begin"), 0
    while i < len(line):
        c = line[i]
        if state == "quoted" and c == '"':
            if line[i + 1 : i + 2] == '"':
                i += 1
            else:
                state = "closed"
        elif state == "begin" and c == '"':
            state = "quoted"
        elif c == "," and state != "quoted":
            state = "begin"
        elif state == "begin":
            state = "plain"
        i += 1
    return state == "quoted"


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text('",a\r', max_size=8), min_size=1, max_size=9), st.booleans())
def test_states_of_lines(texts, inside):
    want = [inside]
    for t in texts:
        want.append(inside_after(t, want[-1]))
    got = Lines('"', ",").states(pa.array(texts), inside)
    assert got.tolist() == want


def written(folder, rows, end="\n", name="r.csv", **options):
    out = io.StringIO()
    csv.writer(out, lineterminator=end, **options).writerows([("Id", "Score", "Text"), *rows])
    path = os.path.join(folder, name)
    with open(path, "w", encoding="utf-8", newline="") as file:
        file.write(out.getvalue())
    return path


def sample(n, seed=1):
    rng = random.Random(seed)
    pieces = ['say "hi"', "\n", "a, b", "\r\n", "", "ünï", '"', "\n\n", "plain words", " x "]
    return [
        (str(i), str(rng.randint(1, 5)), "t" + "".join(rng.choices(pieces, k=rng.randint(1, 6))) + "t")
        for i in range(n)
    ]


def as_rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture
def small_ranges(spark):
    names = {"spark.sql.files.maxPartitionBytes": "173b", "spark.sql.files.openCostInBytes": "0"}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_one_file_in_many_tasks(spark, folder, small_ranges, end):
    rows = sample(200)
    rows[40] = ("40", "3", "long " + "line, \n" * 200)  # a record over many ranges
    rows[41] = ("41", "3", 'q"' + '"\n' * 100 + "x")
    path = written(folder, rows, end, quoting=csv.QUOTE_ALL if end == "\r\n" else csv.QUOTE_MINIMAL)
    got = read_csv_ranges(spark, path, ["Id", "Score", "Text"], {})
    whole = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    assert as_rows(got) == sorted(rows)
    if end == "\n":  # in files of CRLF Spark's reader changes CRLF inside texts too
        assert as_rows(whole) == sorted(rows)
    assert csv_records(spark, path).rdd.getNumPartitions() > 20


def test_many_files_stray_quotes_and_blank_lines(spark, folder, small_ranges):
    text = 'Id,Score,Text\n1,5,a 5" screen\n\n2,4,"two\n\nlines, ""so"""\r\n3,1,say "no\n4,2,"x\n"\n'
    os.makedirs(f"{folder}/all.csv")
    for i in range(5):
        with open(f"{folder}/all.csv/part-{i}.csv", "w", encoding="utf-8", newline="") as file:
            file.write(text if i else "Id,Score,Text\n")
    got = read_csv_ranges(spark, f"{folder}/all.csv", ["Id", "Score", "Text"], {})
    want = [("1", "5", 'a 5" screen'), ("2", "4", 'two\n\nlines, "so"'), ("3", "1", 'say "no'), ("4", "2", "x\n")]
    assert as_rows(got) == sorted(want * 4)


def test_options(spark, folder, small_ranges):
    rows = sample(60, 4)
    path = written(folder, rows, delimiter=";", quotechar="'")
    got = read_reviews(spark, path, keep=("Id",), csv_options={"sep": ";", "quote": "'", "escape": "'"})
    assert len(as_rows(got)) == 60
    got = read_csv_ranges(spark, path, ["Id", "Score", "Text"], {"sep": ";", "quote": "'", "escape": "'"})
    assert as_rows(got) == sorted(rows)
    assert can_split({"sep": ";"}) and can_split(None)
    for options in ({"escape": "\\"}, {"mode": "DROPMALFORMED"}, {"sep": "||"}, {"lineSep": "x"}):
        assert not can_split(options)


def test_records_of_wrong_width_fail(spark, folder):
    path = written(folder, [("1", "5", "fine"), ("2", "4", "more", "fields")])
    with pytest.raises(Exception, match="MALFORMED|malformed"):
        read_reviews(spark, path).collect()
    header = written(folder, [], name="none.csv")
    assert read_reviews(spark, header).count() == 0
    assert np.array_equal(as_rows(csv_records(spark, header)), [])
